"""Two writers of one table, readers of a state, columns that come later."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import commits

ROWS = "document_id string, version string, field string"


def keys_of(df):
    return sorted(map(tuple, df.select("document_id", "version").collect()), key=str)


def test_two_appends_of_one_key_leave_one(spark, tmp_path, monkeypatch):
    """The second writer has read the log before the first commits; it has to look again."""
    at = str(tmp_path / "t")
    one, two = commits.Table(spark, at, ["document_id", "version"]), commits.Table(spark, at, ["document_id", "version"])
    both = spark.createDataFrame([("a", "1", "x"), ("a", "1", "y"), ("b", "1", "x")], ROWS)
    commit = commits.Table._commit

    def slow(self, entry):
        if self is two and one.version() == 0:
            assert one.append(both) == 3
        return commit(self, entry)

    monkeypatch.setattr(commits.Table, "_commit", slow)
    assert two.append(spark.createDataFrame([("b", "1", "z"), ("c", "2", "z")], ROWS)) == 1
    assert keys_of(one.read()) == [("a", "1"), ("a", "1"), ("b", "1"), ("c", "2")]
    assert one.version() == 2 and two.append(both) == 0 and one.version() == 2


def test_writers_at_once(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = spark.range(40).selectExpr("cast(id as string) AS document_id", "'1' AS version", "'x' AS field")
    added, errors = [], []

    def write(low):
        try:
            added.append(commits.Table(spark, at, ["document_id", "version"]).append(rows.where(f"cast(document_id as int) between {low} and {low + 19}")))
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=write, args=(low,)) for low in (0, 10, 20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    table = commits.Table(spark, at, ["document_id", "version"])
    assert not errors and sum(added) == 40 == table.read().count() == table.read().distinct().count()


def test_null_keys_and_equal_hashes(spark, tmp_path, monkeypatch):
    table = commits.Table(spark, str(tmp_path / "t"), ["document_id", "version"])
    odd = spark.createDataFrame([(None, "1", "x"), ("a", None, "x"), ("", "1", "x")], ROWS)
    assert table.append(odd) == 3 and table.append(odd) == 0
    monkeypatch.setattr(commits.Table, "_hash", lambda self, columns: F.lit(7).cast("long"))
    table = commits.Table(spark, str(tmp_path / "u"), ["document_id", "version"])
    assert table.append(odd) == 3 and table.append(odd.unionByName(spark.createDataFrame([("b", "1", "y")], ROWS))) == 1


def test_an_append_reads_the_hashes_of_its_buckets_only(spark, tmp_path):
    """The other buckets' hashes are gone, and nothing is missed."""
    import shutil

    table = commits.Table(spark, str(tmp_path / "t"), ["document_id"])
    table.append(spark.range(2000).selectExpr("cast(id as string) AS document_id", "'1' AS version", "'x' AS field"))
    entry = table.entries()[0]
    assert len(entry["buckets"]) == commits.BUCKETS
    new = spark.createDataFrame([("new", "1", "x")], ROWS)
    bucket = new.select(F.pmod(table._hash(["document_id"]), F.lit(commits.BUCKETS))).first()[0]
    for other in range(commits.BUCKETS):
        if other != bucket:
            shutil.rmtree(tmp_path / f"t/data/{entry['data']}/keys/bucket={other}")
    assert table.append(new) == 1


def test_readers_see_the_old_or_the_new_table(spark, tmp_path, monkeypatch):
    table = commits.Table(spark, str(tmp_path / "t"))
    assert table.read(schema=ROWS).count() == 0
    table.replace(spark.createDataFrame([("a", "1", "x")], ROWS))
    before = table.read()
    seen = []
    commit = commits.Table._commit
    monkeypatch.setattr(commits.Table, "_commit", lambda self, entry: (seen.append(keys_of(commits.Table(spark, self.at).read())), commit(self, entry))[1])
    table.replace(spark.createDataFrame([("b", "1", "x"), ("c", "1", "x")], ROWS))
    assert seen == [[("a", "1")]] and keys_of(before) == [("a", "1")] == keys_of(table.read(1)) and keys_of(table.read()) == [("b", "1"), ("c", "1")]
    with pytest.raises(Exception):  # a write that fails leaves the table as it was
        table.replace(spark.createDataFrame([("d", "1", "x")], ROWS).withColumn("field", F.raise_error(F.lit("broken"))))
    assert keys_of(table.read()) == [("b", "1"), ("c", "1")]


def test_a22_columns_come_later(spark, tmp_path):
    table = commits.Table(spark, str(tmp_path / "t"), ["document_id"])
    table.append(spark.createDataFrame([("a", "1", "x")], ROWS))
    types = frozenset({"string", "int"})
    assert table.evolve({"field": "string", "tier": "int"}, types) == [("tier", "int")] and table.evolve({"tier": "int"}, types) == []
    for bad in ({"tier": "string"}, {"more": "blob"}):
        with pytest.raises(ValueError):
            table.evolve(bad, types)
    table.append(spark.createDataFrame([("b", "1", "x", 2)], f"{ROWS}, tier int"))
    table.append(spark.createDataFrame([("c", "1", "y")], ROWS))
    assert sorted(map(tuple, table.read().select("document_id", "tier").collect())) == [("a", None), ("b", 2), ("c", None)]
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([("d", 1)], "document_id string, other int"))
    assert table.read(1).columns == ["document_id", "version", "field"]
