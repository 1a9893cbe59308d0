"""Tables that several writers append to: a log of numbered commits, and an index of keys.

A table's folder has `log/`, one JSON entry a commit, and `data/`, a folder for each commit's files that no other commit touches. A commit is its entry: files without
one are not there. An entry appears whole under its number or not at all, and a number is given once, so of two writers one gets the number and the other has to look at
what was committed meanwhile. Readers take the entries up to a number and see that state for good; an entry that replaces the table hides those before it.

Appending keeps out rows whose key is stored. With its rows a commit writes the 64-bit hashes of its keys, in folders by bucket of the hash. An append reads the hashes of its own
keys' buckets only; where a hash is met the stored keys of that bucket are compared, so equal hashes of different keys lose nothing. If another commit comes first, the
rows are held against that commit's keys alone and the next number is tried.

Columns may be added (`evolve`), never dropped or retyped; older files have nulls there. Keys with a null are stored and compared as null.

Entries are created by a link on file systems that are mounted (file:), elsewhere by a rename that refuses an existing target; a store without either must not hold such a table.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lake import missing_columns

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer committed first, each time."""


class Table:
    """The table at a folder; `key` are the columns that an append keeps from repeating, none for a table that is only replaced."""

    def __init__(self, spark: SparkSession, at: str, key: list[str] | tuple[str, ...] = (), kind: str = "parquet"):
        self.spark, self.at, self.key, self.kind = spark, at.rstrip("/"), list(key), kind
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.at).getFileSystem(spark._jsc.hadoopConfiguration())

    # The log.

    def numbers(self) -> list[int]:
        log = self._path(f"{self.at}/log")
        if not self._files.exists(log):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def entry(self, number: int) -> dict[str, Any]:
        stream = self._files.open(self._path(f"{self.at}/log/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def entries(self, upto: int | None = None) -> list[dict[str, Any]]:
        """The entries that make up the table at a number, from the last that replaced it on."""
        found = []
        for number in reversed([n for n in self.numbers() if upto is None or n <= upto]):
            found.append(self.entry(number))
            if found[-1]["mode"] == "replace":
                break
        return found[::-1]

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max(self.numbers(), default=0)

    def _commit(self, entry: dict[str, Any]) -> bool:
        """Write the entry under its number, or say that the number is taken."""
        body = json.dumps(entry).encode()
        log, name = self._path(f"{self.at}/log"), f"{entry['number']:012d}.json"
        self._files.mkdirs(log)
        draft = self._path(log, f".{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(body), 0, len(body))
        out.close()
        try:
            if self._files.getScheme() == "file":
                folder = log.toUri().getPath()
                try:
                    os.link(f"{folder}/{draft.getName()}", f"{folder}/{name}")
                except FileExistsError:
                    return False
                return True
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
            options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(draft, self._path(log, name), options)
            except Exception:
                if self._files.exists(self._path(log, name)):
                    return False
                raise
            return True
        finally:
            self._files.delete(draft, False)

    # Reading.

    def schema(self, entries: list[dict[str, Any]] | None = None) -> T.StructType | None:
        entries = self.entries() if entries is None else entries
        return T.StructType.fromJson(entries[-1]["schema"]) if entries else None

    def read(self, upto: int | None = None, schema: str | T.StructType | None = None) -> DataFrame:
        """The table after commit `upto`, the last by default; with `schema`, no rows of it where nothing has been committed."""
        entries = self.entries(upto)
        if not entries:
            if schema is None:
                raise FileNotFoundError(f"{self.at} has no commits")
            return self.spark.createDataFrame([], schema)
        return self._rows(entries, self.schema(entries))

    def _rows(self, entries: list[dict[str, Any]], schema: T.StructType) -> DataFrame:
        paths = [f"{self.at}/data/{e['data']}/rows" for e in entries if e["data"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(self.kind).load(paths)

    # Writing.

    def _hash(self, columns: list[str]) -> Any:
        return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])

    def _known(self, keys: DataFrame, entries: list[dict[str, Any]]) -> DataFrame | None:
        """Which of the keys (with their hash and bucket) the entries hold; None if surely none."""
        entries = [e for e in entries if e["data"]]
        if not entries:
            return None
        wanted = sorted(r["bucket"] for r in keys.select("bucket").distinct().collect())
        paths = [f"{self.at}/data/{e['data']}/keys/bucket={b}" for e in entries for b in wanted if str(b) in e["buckets"]]
        if not paths:
            return None
        hashes = self.spark.read.schema("hash long").parquet(*paths)
        met = keys.join(hashes.distinct(), "hash", "left_semi")
        if met.isEmpty():
            return None
        stored = self._rows(entries, self.schema(entries)).select(*self.key)
        same = stored.withColumn("hash", self._hash(self.key)).join(F.broadcast(met.select("hash").distinct()) if met.count() < 10_000 else met.select("hash").distinct(), "hash", "left_semi")
        return same.select(*self.key).distinct()

    def _without(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        other = known.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(self.key)])
        return rows.join(other, [rows[c].eqNullSafe(other[f"__{i}"]) for i, c in enumerate(self.key)], "left_anti")

    def _write(self, rows: DataFrame) -> dict[str, Any]:
        """The rows' files and the hashes of their keys; not yet part of the table."""
        name = uuid.uuid4().hex
        at = f"{self.at}/data/{name}"
        rows.write.format(self.kind).save(f"{at}/rows")
        buckets = {}
        if self.key:
            back = self.spark.read.schema(rows.schema).format(self.kind).load(f"{at}/rows")
            hashes = back.select(self._hash(self.key).alias("hash")).distinct().withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
            hashes.repartition("bucket").sortWithinPartitions("bucket", "hash").write.partitionBy("bucket").parquet(f"{at}/keys")
            buckets = {str(r["bucket"]): r["n"] for r in self.spark.read.schema("hash long, bucket int").parquet(f"{at}/keys").groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        return {"data": name, "buckets": buckets}

    def _drop(self, name: str) -> None:
        self._files.delete(self._path(f"{self.at}/data/{name}"), True)

    def _shaped(self, rows: DataFrame, schema: T.StructType | None) -> DataFrame:
        if schema is None:
            return rows
        if strange := set(rows.columns) - set(schema.names):
            raise ValueError(f"no columns {sorted(strange)} here; add them by evolve")
        return rows.select([(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def append(self, rows: DataFrame, attempts: int = 20) -> int:
        """Add the rows whose key is not stored yet, all rows of a new key; the number of rows added. A batch that adds nothing makes no commit."""
        seen: list[dict[str, Any]] = self.entries()
        shaped = self._shaped(rows, self.schema(seen))
        number = seen[-1]["number"] if seen else 0
        against, made = seen, None
        for _ in range(attempts):
            if made is not None:
                shaped = self.spark.read.schema(shaped.schema).format(self.kind).load(f"{self.at}/data/{made['data']}/rows")
            known = None
            if self.key and against:
                hashed = shaped.select(*self.key).distinct().withColumn("hash", self._hash(self.key)).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
                known = self._known(hashed, against)
            if made is None or known is not None:
                before = made
                made = self._write(shaped if known is None else self._without(shaped, known))
                if before is not None:
                    self._drop(before["data"])
            written = self._rows([made], shaped.schema).count()
            if not written:
                self._drop(made["data"])
                return 0
            if self._commit({"number": number + 1, "mode": "append", "schema": json.loads((self.schema(seen) or shaped.schema).json()), **made}):
                return written
            seen = self.entries()
            against = [e for e in seen if e["number"] > number]
            if against and against[0]["mode"] == "replace" or self.schema(seen) != shaped.schema:
                self._drop(made["data"])  # another table now: from the beginning
                return self.append(rows, attempts - 1) if attempts > 1 else self._lost()
            number = seen[-1]["number"]
        self._drop(made["data"])
        return self._lost()

    def _lost(self) -> int:
        raise Conflict(f"{self.at}: other writers were first each time")

    def replace(self, rows: DataFrame, attempts: int = 20) -> int:
        """Put the rows in place of the table: readers see the old one until the commit, the new one after. The number of rows."""
        made = self._write(rows)
        for _ in range(attempts):
            if self._commit({"number": self.version() + 1, "mode": "replace", "schema": json.loads(rows.schema.json()), **made}):
                return self._rows([made], rows.schema).count()
        self._drop(made["data"])
        return self._lost()

    def evolve(self, wanted: dict[str, str], types: frozenset[str], attempts: int = 20) -> list[tuple[str, str]]:
        """Add the columns of `wanted` (name: type) that are not there, and read them back: the whole table has them, as nulls. What was added."""
        for _ in range(attempts):
            entries = self.entries()
            schema = self.schema(entries)
            if schema is None:
                raise FileNotFoundError(f"{self.at} has no commits")
            have = {f.name: f.dataType.simpleString() for f in schema}
            new = missing_columns(wanted, have, types)
            if not new:
                return []
            grown = T.StructType([*schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in new)).fields])
            number = entries[-1]["number"] + 1
            if self._commit({"number": number, "mode": "append", "schema": json.loads(grown.json()), "data": "", "buckets": {}}):
                back = self.read(number)
                lost = [n for n, k in new if dict(back.dtypes).get(n) != k]
                if lost or back.where(" or ".join(f"`{n}` is not null" for n, _ in new)).limit(1).count():
                    raise PySparkException(f"{self.at}: {lost or new} not read back as added")
                return new
        self._lost()
        return []
