"""Streams: exact figures equal to a batch's, and a run that breaks off between two sinks."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import drift
from ledgerline.operators.commits import Table
from ledgerline.streaming import jobs

EVENTS = "ts timestamp, document string, confidence double, abstained boolean"


def event(day, hour, document, confidence, abstained=False):
    return (datetime.datetime(2024, 3, day, hour), document, confidence, abstained)


def put(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{number}")


def test_o2_windows_are_exact(spark, tmp_path):
    """Repeated documents count once, an even number of confidences has its true median, a late event does not come back; as many findings after a second run."""
    first = [event(1, h, f"d{h % 5}", c, h % 3 == 0) for h, c in enumerate([0.1, 0.9, None, 0.4, 0.4, 0.8, 0.2])] + [event(2, 3, "x", None)]
    second = [event(3, 1, "y", 0.5), event(2, 5, "x", 0.7), event(2, 6, None, 0.9, None)]
    late = [event(1, 1, "late", 0.0), event(4, 1, "z", 0.5)]
    for number, rows in enumerate((first, second, late)):
        put(spark, f"{tmp_path}/in", number, rows, EVENTS)
    bands = {"median_confidence": (0.3, 0.5), "abstention_rate": (0.0, 0.3)}

    def run():
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        jobs.watch(jobs.with_event_time(stream, late="0 seconds"), bands, 1, f"{tmp_path}/out", f"{tmp_path}/check", parts=3).awaitTermination()
        return sorted(map(tuple, Table(spark, f"{tmp_path}/out").read().select("day", "measure", "documents", "value", "state").collect()))

    batch = spark.createDataFrame(first + second, EVENTS).withColumn("day", F.col("ts").cast("date"))
    wanted = drift.assess(drift.window_summary(batch, ["day"]), bands, 1).select("day", "measure", "documents", "value", "state")
    rounded = lambda rows: [(*r[:3], None if r[3] is None else round(r[3], 9), r[4]) for r in rows]
    found = run()
    # The last day's window is open; the one before closed when the last file came.
    closed = sorted(map(tuple, wanted.where("day < '2024-03-03'").collect()))
    assert rounded([r for r in found if r[0] < datetime.date(2024, 3, 3)]) == rounded(closed) and [r[2] for r in found if r[0].day == 1] == [5, 5]
    assert run() == found


def test_f5_state_of_windows_is_spark_s_own(spark, tmp_path):
    """No row passes a Python worker, an event that is late in an open window counts, and values that are no numbers are unscored."""
    rows = [event(1, 5, "a", 0.5), event(1, 6, "b", float("nan"), None), event(2, 9, "c", 0.1)], [event(2, 1, "d", 0.3, True), event(2, 2, "d", 0.3), event(3, 1, "e", 0.5)], [event(4, 1, "f", 0.5)]
    for number, own in enumerate(rows):
        put(spark, f"{tmp_path}/in", number, own, EVENTS)
    stream = jobs.with_event_time(spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), late="0 seconds")
    query = jobs.drift_parts(stream).writeStream.format("memory").queryName("f5").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [o["operatorName"] for o in query.lastProgress["stateOperators"]] == ["stateStoreSave"]
    closed = spark.createDataFrame(spark.table("f5").collect(), "start timestamp, document string, confidence double, rows long, abstained long, judged long")
    got = {r["start"].day: (r["rows"], r["documents"], r["median_confidence"], r["abstention_rate"], r["unscored"]) for r in jobs.whole_windows(closed).collect()}
    assert got == {1: (2, 2, 0.5, 0.0, 1), 2: (3, 2, 0.3, 1 / 3, 0), 3: (1, 1, 0.5, 0.0, 0)}


FIELDS = "path string, fields array<struct<field: string, value: string, confidence: double, verdict: string>>"


def reading(number, confidence=0.9):
    return (f"incoming/en/invoice/{number}.pdf", [("total", "5", confidence, "verified"), ("date", None, None, None)])


def test_o1_a20_an_arrival_that_breaks_off_is_completed(spark, tmp_path, monkeypatch):
    put(spark, f"{tmp_path}/in", 0, [reading(1), reading(2, 0.1), ("elsewhere/3.pdf", [("total", "5", 0.9, "verified")]), ("incoming/en/invoice/4.pdf", [])], FIELDS)
    put(spark, f"{tmp_path}/in", 1, [reading(1), reading(5, None), ("incoming/en/invoice/6.pdf", None)], FIELDS)
    thresholds = spark.createDataFrame([("total", 0.5), ("date", 0.5)], "field string, threshold double")
    totals = lambda d: d.select("document", F.lit("agrees").alias("outcome"))

    def run():
        stream = spark.readStream.schema(FIELDS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        jobs.arrive(stream, thresholds, totals, "total", "r", 0, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()

    append = Table.append

    def broken(self, rows, attempts=20):
        if self.at.endswith("records"):
            raise RuntimeError("lost")
        return append(self, rows, attempts)

    monkeypatch.setattr(Table, "append", broken)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(Table, "append", append)
    assert Table(spark, f"{tmp_path}/out/queue").read().count() == 1 and Table(spark, f"{tmp_path}/out/records").version() == 0
    run()
    run()
    read = lambda name, *columns: sorted(map(tuple, Table(spark, f"{tmp_path}/out/{name}").read().select(*columns).collect()))
    assert read("records", "document_id") == [("1",), ("2",), ("5",)]
    assert read("queue", "document_id", "field", "queued_because") == [("2", "total", "below_threshold"), ("5", "total", "unscored")]
    assert read("refused", "path", "reason") == [("elsewhere/3.pdf", "path"), ("incoming/en/invoice/4.pdf", "no_fields"), ("incoming/en/invoice/6.pdf", "no_fields")]
