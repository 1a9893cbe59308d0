"""Substring dedup with a log-structured fingerprint index.

A window is 35 consecutive words of one document. Every word that is covered by a window whose word sequence also
starts anywhere else (the same document included) is removed; windows are judged on the input.

Index. Each window has a fingerprint: the least hash among its 8-word runs. Neighbouring windows mostly share the
place of that minimum (an anchor), so about one entry in fourteen windows is kept, and equal windows have equal
fingerprints. A batch of documents becomes one immutable run of anchors, bucketed and sorted by fingerprint. It is
merge-joined with the runs before it, bucket by bucket and without a shuffle, to find the fingerprints that repeat;
when there are more than `fan_in` runs they are compacted into one. An index with a folder of its own outlives the session: each
append ends by writing a state file, and `open` goes on from the last one that is whole.

Verification. Anchors that repeat are only candidates. Their documents are read again and each candidate window is
compared by 128 bits of two independent hashes over all its 35 words, which no regularity of the words cancels
(see words.py): two windows that differ agree with probability 2**-128, about 1e-12 in all for 1e13 windows.

Skew. A task settles the repeats that it sees itself and sends only one witness of them, so a passage that a
third of all documents hold costs one entry a task and not one a document.

Rows: null text has no words. A null doc_id is a document like any other. Rows that repeat a doc_id and its text are copies of each other: all their windows repeat,
so one of them goes to the index for the sake of other documents, and the others need no search, however many they are.
Texts below 35 words lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.shared import Scratch, shuffle_parts, small

from .words import U, Words, gram_starts, grams, pieces, thrifty, words

GRAM = 8
#: Entries that a task holds before it sends them; bounds its memory.
HELD = 200_000
#: Bytes of text hashed at once.
PIECE = 1 << 19
#: A null doc_id in keys.
NO_ID = -(1 << 63)
KEY = ("k1", "k2")


def _least_at(g: np.ndarray, width: int) -> np.ndarray:
    """For each i, the place of the first minimum of g[i:i + width]."""
    at, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(g[right] < g[left], right, left)
        have += step
    return at


def anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the anchor, first window, number of windows) of each run of windows with one anchor."""
    starts = gram_starts(w, window)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    k = min(GRAM, window)
    at = _least_at(grams(w, k), window - k + 1)[starts]
    cut = np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))
    edge = np.flatnonzero(cut)
    return at[edge], starts[edge], np.diff(np.append(edge, len(starts)))


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy() for c in KEY)


def _fingerprints(window: int):
    """(k1, k2, text) -> entries. kind 0: to the index; 1: known to repeat, not to the index; 2: a witness, to the index only."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        fp, k1, k2, start, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(fp, kind="stable")
        fp, k1, k2, start, n = (x[order] for x in (fp, k1, k2, start, n))
        edge = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1]))) if len(fp) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(fp)))
        kind = np.where(np.repeat(size > 1, size), 1, 0)
        seen = edge[size > 1]
        rows = [np.concatenate((x, x[seen])) for x in (fp, k1, k2, start, n)] + [np.concatenate((kind, np.full(len(seen), 2)))]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[5].astype(np.int32)), pa.array(rows[0].view(np.int64)), pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[3].astype(np.int32)), pa.array(rows[4].astype(np.int32))],
            names=["kind", "fp", "k1", "k2", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for part in pieces(batch, most=PIECE):
                w = words(part.column("text"))
                at, start, n = anchors(w, window)
                doc = np.searchsorted(w.first, start, side="right") - 1
                k1, k2 = _keys(part)
                held.append((grams(w, min(GRAM, window))[at] if len(at) else np.zeros(0, U), k1[doc], k2[doc], start - w.first[doc], n))
                many += len(at)
                if many >= HELD:
                    yield flush(held)
                    held, many = [], 0
        if many:
            yield flush(held)

    return run


def repeats(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which (one, two) pairs occur more than once."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    out = np.zeros(len(one), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


SPAN = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<i4"), ("n", "<i4")])


def _spans(k1: np.ndarray, k2: np.ndarray, start: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive windows (of one document and one value of `extra`), and each run's place."""
    if not len(start):
        return np.zeros(0, SPAN), np.zeros(0, np.int64)
    cut = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (start[1:] != start[:-1] + 1) | (extra[1:] != extra[:-1])))
    edge = np.flatnonzero(cut)
    out = np.zeros(len(edge), SPAN)
    out["k1"], out["k2"], out["start"], out["n"] = k1[edge], k2[edge], start[edge], np.diff(np.append(edge, len(start)))
    return out, edge


def _candidates(window: int, buckets: int):
    """(k1, k2, text, spans) -> for each bucket of fingerprints, the candidate windows' hashes; and what is settled already."""

    def flush(held: list[tuple[np.ndarray, ...]], number: int) -> pa.RecordBatch:
        one, two, bucket, k1, k2, start = (np.concatenate(x) for x in zip(*held))
        again = repeats(one, two)
        settled, _ = _spans(k1[again], k2[again], start[again], np.zeros(int(again.sum())))
        order = np.lexsort((two[again], one[again]))
        a, b = one[again][order], two[again][order]
        seen = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        wit1, wit2, wit_at = a[seen], b[seen], bucket[again][order][seen]
        one, two, bucket, k1, k2, start = (x[~again] for x in (one, two, bucket, k1, k2, start))
        spans, edge = _spans(k1, k2, start, bucket)
        by = np.argsort(bucket[edge], kind="stable")
        spans, run_at = spans[by], bucket[edge][by]
        size = spans["n"].astype(np.int64)
        pick = np.repeat(edge[by], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        one, two = one[pick], two[pick]
        first = np.concatenate(([0], np.cumsum(size)))
        by = np.argsort(wit_at, kind="stable")
        wit1, wit2, wit_at = wit1[by], wit2[by], wit_at[by]
        names, bodies = [number % buckets], [_pack(settled, np.zeros(0, U), np.zeros(0, U), True)]
        for x in np.unique(np.concatenate((run_at, wit_at))).tolist():
            i, j = np.searchsorted(run_at, [x, x + 1])
            p, q = np.searchsorted(wit_at, [x, x + 1])
            names.append(x)
            bodies.append(_pack(spans[i:j], np.concatenate((one[first[i] : first[j]], wit1[p:q])), np.concatenate((two[first[i] : first[j]], wit2[p:q])), False))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(bodies, pa.binary())], names=["bucket", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, many, number = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in pieces(batch, most=PIECE):
                w = words(part.column("text"), hashes=2)
                spans = part.column("spans")
                flat = spans.flatten()
                per = np.diff(spans.offsets.to_numpy()) if len(spans) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(part.num_rows), per)
                start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy().astype(np.int64)
                order = np.lexsort((start, doc))
                doc, start, n = doc[order], start[order], n[order]
                place = np.repeat(w.first[doc] + start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                doc = np.repeat(doc, n)
                if not len(place):
                    continue
                k = min(GRAM, window)
                g = grams(w, k)
                bucket = (g[_least_at(g, window - k + 1)[place]] % U(buckets)).astype(np.int32)
                k1, k2 = _keys(part)
                held.append((grams(w, window)[place], grams(w, window, 1)[place], bucket, k1[doc], k2[doc], place - w.first[doc]))
                many += len(place)
                if many >= 2 * HELD:
                    yield flush(held, number)
                    held, many, number = [], 0, number + 1
        if many:
            yield flush(held, number)

    return run


def _pack(spans: np.ndarray, one: np.ndarray, two: np.ndarray, settled: bool) -> bytes:
    return np.array([settled, len(spans), len(one)], dtype=np.uint32).tobytes() + spans.tobytes() + one.tobytes() + two.tobytes()


def _unpack(body) -> tuple[bool, np.ndarray, np.ndarray, np.ndarray]:
    raw = bytes(body)
    settled, n, m = np.frombuffer(raw, np.uint32, 3).tolist()
    at = 12 + n * SPAN.itemsize
    return bool(settled), np.frombuffer(raw, SPAN, n, 12), np.frombuffer(raw, U, m, at), np.frombuffer(raw, U, m, at + 8 * m)


def _confirm(table: pa.Table) -> pa.Table:
    """One bucket: the candidate windows of which another is the same."""
    out, spans, one, two = [], [], [], []
    for body in table["body"]:
        settled, s, a, b = _unpack(body.as_buffer())
        if settled:
            out.append(s)
            continue
        n = int(s["n"].sum())
        spans.append((s, n))
        one.append(a)
        two.append(b)
    if one:
        hit = repeats(np.concatenate(one), np.concatenate(two))
        at = 0
        for (s, n), a in zip(spans, one):
            mine, at = hit[at : at + n], at + len(a)
            size = s["n"].astype(np.int64)
            start = np.repeat(s["start"].astype(np.int64), size) + np.arange(n) - np.repeat(np.cumsum(size) - size, size)
            out.append(_spans(np.repeat(s["k1"], size)[mine], np.repeat(s["k2"], size)[mine], start[mine], np.zeros(int(mine.sum())))[0])
    found = np.concatenate(out) if out else np.zeros(0, SPAN)
    return pa.table({"k1": pa.array(found["k1"]), "k2": pa.array(found["k2"]), "start": pa.array(found["start"]), "n": pa.array(found["n"])})


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key that tells texts apart even where doc_id is null or repeated."""
    return docs.withColumns({"k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "k2": F.xxhash64(F.col("text").cast("string"))})


def _per_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("spans"))


class SubstringIndex:
    """Sorted immutable runs of anchors. `append` adds a batch, `spans` gives the verified windows that repeat.

    With `at`, a folder of the shared store, the index stays there, and a later session opens it again; without, it is gone
    with the application.
    """

    def __init__(self, spark: SparkSession, window: int = 35, fan_in: int = 4, at: str | None = None):
        self.spark, self.window, self.fan_in = spark, window, fan_in
        self.scratch = Scratch(spark, "substrings", at)
        self.parts = min(shuffle_parts(spark), 100_000)
        self.runs: list[str] = []
        self.settled: list[str] = []
        self.repeated: str | None = None
        self.made = 0

    @classmethod
    def open(cls, spark: SparkSession, at: str, window: int = 35, fan_in: int = 4) -> SubstringIndex:
        """The index in the folder `at`, as its last whole state file has it; a new one if there is none."""
        index = cls(spark, window, fan_in, at)
        whole = [x for x in index.scratch.names("state") if "_SUCCESS" in index.scratch.names(f"state/{x}")]
        if whole:
            state = json.loads(spark.read.text(index.scratch.path(f"state/{max(whole)}")).first()[0])
            if state["window"] != window:
                raise ValueError(f"the index has windows of {state['window']} words")
            index.parts, index.runs, index.settled, index.repeated, index.made = (state[x] for x in ("parts", "runs", "settled", "repeated", "made"))
        return index

    def _save(self) -> None:
        """The state file: a batch counts once it is there, and a failed append leaves the one before."""
        state = json.dumps({"window": self.window, "parts": self.parts, "runs": self.runs, "settled": self.settled, "repeated": self.repeated, "made": self.made})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(self.scratch.path(f"state/{self.made:09d}"))

    def _table(self, name: str) -> DataFrame:
        """One run; a session that does not know the table yet learns that its files are bucketed and sorted."""
        if not self.spark.catalog.tableExists(name):
            columns = "fp BIGINT, k1 BIGINT, k2 BIGINT, start INT, n INT, kind INT"
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.parts} BUCKETS LOCATION '{self.scratch.path(name)}'")
        return self.spark.table(name)

    def _run(self, rows: DataFrame) -> str:
        """Write one run: a table bucketed and sorted by fingerprint, one file a bucket."""
        self.made += 1
        name = f"run_{self.made}_{uuid.uuid4().hex}"
        (rows.select("fp", *KEY, "start", "n", "kind").repartition(self.parts, "fp").sortWithinPartitions("fp").write
            .bucketBy(self.parts, "fp").sortBy("fp").option("compression", "zstd").option("path", self.scratch.path(name)).saveAsTable(name))
        return name

    def append(self, docs: DataFrame) -> None:
        """Add a batch (doc_id, text): a new run, merge-joined with those before it."""
        mark = uuid.uuid4().hex
        rows = self.scratch.keep(_keyed(docs).select(*KEY, F.col("text").cast("string")).mapInArrow(thrifty(_fingerprints(self.window)), "kind int, fp long, k1 long, k2 long, start int, n int"), f"fp_{mark}")
        self.scratch.keep(rows.where("kind = 1").select(*KEY, "start", "n"), f"settled_{mark}")
        name = self._run(rows.where("kind <> 1"))
        # A witness stands for at least two anchors that are settled already.
        counts = self._table(name).groupBy("fp").agg(F.count("*").alias("m"))
        fresh = counts.where("m > 1").select("fp")
        for old in self.runs:
            fresh = fresh.unionByName(counts.select("fp").join(self._table(old).select("fp").distinct(), "fp"))
        if self.repeated is not None:
            fresh = fresh.unionByName(self.scratch.kept(self.repeated))
        self.scratch.keep(fresh.distinct(), f"repeated_{mark}")
        before, self.repeated = self.repeated, f"repeated_{mark}"
        self.settled.append(f"settled_{mark}")
        self.runs.append(name)
        old = self._merge() if len(self.runs) > self.fan_in else []
        self._save()
        self._forget(old)
        self.scratch.drop(f"fp_{mark}", *([before] if before else []))

    def compact(self) -> None:
        """Merge all runs into one."""
        old = self._merge()
        self._save()
        self._forget(old)

    def _merge(self) -> list[str]:
        """Make one run of all, and return those that it replaces."""
        old = self.runs
        merged = self._table(old[0])
        for name in old[1:]:
            merged = merged.unionByName(self._table(name))
        self.runs = [self._run(merged)]
        return old

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.drop(name)

    def close(self) -> None:
        """Take the runs out of the session's catalog; their files stay."""
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def candidates(self) -> DataFrame:
        """k1, k2, spans of the windows whose fingerprint repeats."""
        hits = self.spark.createDataFrame([], "k1 long, k2 long, start int, n int")
        for name in self.settled:
            hits = hits.unionByName(self.scratch.kept(name))
        for name in self.runs:
            hits = hits.unionByName(self._table(name).where("kind = 0").join(self.scratch.kept(self.repeated), "fp", "left_semi").select(*KEY, "start", "n"))
        return _per_document(hits)

    def spans(self, keyed: DataFrame) -> DataFrame:
        """k1, k2, spans of the verified windows that repeat; `keyed` are all documents appended, with k1, k2 and text.

        The documents are dealt by key here, and a caller that joins the spans with the same `keyed` in the same
        query finds them dealt already: Spark reuses the exchange, so texts are shuffled once.
        """
        hits = Scratch(self.spark, "candidates").keep(self.candidates(), "candidates")
        sent = keyed.join(hits, list(KEY)).mapInArrow(thrifty(_candidates(self.window, 8 * self.parts)), "bucket int, body binary")
        found = sent.groupBy("bucket").applyInArrow(_confirm, "k1 long, k2 long, start int, n int")
        return _per_document(found)


def _cut(window: int, columns: list[str]):
    """(carried, text, copy, spans) -> the columns with n_words, n_removed and kept_text; rows marked as copies for the index are no rows of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.invert(batch.column("copy")))
            kept, total, gone = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                found = (text.as_py() or "").encode().split()
                marks = spans.as_py()
                if marks and len(found) >= window:
                    step = np.zeros(len(found) + 1, dtype=np.int64)
                    start, n = np.array([x["start"] for x in marks]), np.array([x["n"] for x in marks])
                    n = np.minimum(n, len(found) - window + 1 - start)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + n - 1 + window, -1)
                    left = np.cumsum(step)[:-1] == 0
                    total.append(len(found))
                    found = list(itertools.compress(found, left.tolist()))
                else:
                    total.append(len(found))
                gone.append(total[-1] - len(found))
                kept.append(b" ".join(found).decode())
            others = iter(batch.column("carried").flatten()[1:])
            yield pa.RecordBatch.from_arrays([*(batch.column("text") if c == "text" else next(others) for c in columns), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*columns, "n_words", "n_removed", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, window: int = 35, batches: int = 3, fan_in: int = 2, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add `docs` to an index in `batches` batches (compacted beyond `fan_in` runs) and cut every repeated window out.

    Returns, for every row, the columns named in `carry` and n_words, n_removed, kept_text (the words that stay,
    joined by one space).
    """
    spark = docs.sparkSession
    columns = list(dict.fromkeys(carry))
    # In a struct, so that no carried column clashes with those of the index; the text is sent once.
    others = F.struct(F.lit(True).alias("row"), *[F.col(c) for c in columns if c != "text"]).alias("carried")
    keyed = _keyed(docs.select(others, "doc_id", F.col("text").cast("string").alias("text"))).select("carried", "doc_id", "text", *KEY, F.lit(False).alias("copy"))
    kept = Scratch(spark, "repeated-rows")
    twice = kept.keep(keyed.groupBy(*KEY).count().where("count > 1").select(*KEY), "twice")
    many, repeated = twice.count(), None
    if many:
        repeated = keyed.join(small(twice, many, 24), list(KEY), "left_semi")
        keyed = keyed.join(small(twice, many, 24), list(KEY), "left_anti").select(*keyed.columns)
        keyed = keyed.unionByName(repeated.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("carried", "doc_id", "text")], F.lit(True).alias("copy")))
    index = SubstringIndex(spark, window, fan_in)
    for i in range(batches):
        index.append(keyed.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i) if batches > 1 else keyed)
    rows = keyed.join(index.spans(keyed.select("text", *KEY)), list(KEY), "left").select("carried", "text", "copy", "spans")
    index.close()
    index.scratch.drop(*index.scratch.names())  # what is still needed is written apart
    if repeated is not None:
        every = F.array(F.struct(F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("n")))
        rows = rows.unionByName(repeated.select("carried", "text", "copy", every.alias("spans")))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return rows.mapInArrow(thrifty(_cut(window, columns)), f"{out}, n_words long, n_removed long, kept_text string")
