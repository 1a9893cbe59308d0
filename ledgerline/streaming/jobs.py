"""Arrival, landing and drift as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import drift, records
from ..operators.commits import Table
from ..sources.readings import landing_keys

#: The state store of `drift_parts`: its state does not lie in the heap.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def with_event_time(stream: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """The event time as a timestamp with zone (UTC sessions), and a watermark on it."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def drift_parts(stream: DataFrame, length: str = "1 day") -> DataFrame:
    """Closed windows of (ts, document, confidence, abstained) as counts by start, document and confidence: rows, abstained, judged.

    Exact: a repeated document is seen, and a median needs values with their numbers only. Spark's own aggregation holds the counts as state, dealt by all three, so that a day is many
    tasks' work. A window is put out once, when the watermark has passed its end; what comes later is dropped by the watermark. State goes with the window.
    """
    confidence = F.nullif(F.col("confidence").cast("double"), F.lit(float("nan")))
    rows = stream.select("ts", F.col("document").cast("string").alias("document"), confidence.alias("confidence"), "abstained")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    counts = rows.groupBy(F.window("ts", length).alias("window"), "document", "confidence").agg(F.count("*").alias("rows"), F.count_if("abstained").alias("abstained"), F.count("abstained").alias("judged"))
    return counts.select(F.col("window.start").alias("start"), "document", "confidence", "rows", "abstained", "judged")


def whole_windows(parts: DataFrame) -> DataFrame:
    """start, rows, documents, median_confidence, abstention_rate, unscored of windows whose counts are all there."""
    unscored = F.sum(F.when(F.col("confidence").isNull(), F.col("rows")).otherwise(0))
    summed = parts.groupBy("start").agg(*[F.sum(c).alias(c) for c in ("rows", "abstained", "judged")], unscored.alias("unscored"), F.countDistinct("document").alias("documents"))
    values = parts.where("confidence is not null").groupBy("start", F.col("confidence").alias("value")).agg(F.sum("rows").alias("n"))
    order = Window.partitionBy("start").orderBy("value")
    placed = values.withColumns({"to": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("start"))})
    # The two middle places, which are one where the number is odd.
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    holds = lambda at: (F.col("to") - F.col("n") < at) & (at <= F.col("to"))
    middle = placed.groupBy("start").agg(((F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2).alias("median_confidence"))
    rate = F.when(F.col("judged") > 0, F.col("abstained") / F.col("judged"))
    return summed.join(middle, "start", "left").select("start", "rows", "documents", "median_confidence", rate.alias("abstention_rate"), "unscored")


def watch(stream: DataFrame, bands: dict[str, tuple[float, float]], least: int, sink: str, checkpoint: str, parts: int = 8) -> StreamingQuery:
    """Assess each closed window and store the findings, with its exact number of documents, in the table at `sink` (day, measure are its key).

    All counts of a window close on one watermark, so they come in one batch; a batch that is run again adds nothing. `parts` has no use any more: Spark deals the state.
    """

    def write(batch: DataFrame, _: int) -> None:
        kept = batch.persist()
        try:
            days = whole_windows(kept).withColumn("day", F.col("start").cast("date"))
            Table(batch.sparkSession, sink, ["day", "measure"]).append(drift.assess(days.drop("start", "rows"), bands, least))
        finally:
            kept.unpersist()

    return drift_parts(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def land(stream: DataFrame, flatten, table: str, checkpoint: str, time: str = "extracted_on", late: str = "1 hour") -> StreamingQuery:
    """Append records' rows once: repeated deliveries within the watermark fall out of the stream, older ones by the table's keys.

    The table may have other writers, and a batch that is run again after a failure finds its own rows there and adds nothing.
    """
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["document_id", "version"])

    def write(batch: DataFrame, _: int) -> None:
        Table(batch.sparkSession, table, ["document_id", "version"]).append(flatten(batch))

    return once.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def arrive(stream: DataFrame, thresholds: DataFrame, totals: Callable[[DataFrame], DataFrame], total_field: str, reader: str, tier: int, at: str, checkpoint: str) -> StreamingQuery:
    """Readings as they arrive become records, messages to reviewers, or refusals: three tables below `at`, from one stream.

    A reading is (path, fields: array of field, value, confidence, verdict). Its path names language, document type and document; a path of another form, or
    a reading without fields, is refused with its reason. `totals` gives (document, outcome) for a batch's readings. Each table is appended by its
    own key, so a batch that broke off between two of them is completed when it is run again, and doubles nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        kept = batch.persist()
        try:
            named = kept.join(landing_keys(kept.select("path").distinct()), "path")
            reason = F.when(F.col("refused"), "path").when(F.coalesce(F.size("fields"), F.lit(0)) < 1, "no_fields")
            judged = named.withColumn("reason", reason)
            Table(spark, f"{at}/refused", ["path"]).append(judged.where("reason is not null").select("path", "reason").distinct())
            good = judged.where("reason is null").dropDuplicates(["document_id"])
            extracted = good.select(F.col("document_id").alias("document"), "fields")
            made = records.publish_documents(extracted, thresholds, totals(good.select(F.col("document_id").alias("document"))), total_field, reader, tier).persist()
            try:
                Table(spark, f"{at}/queue", ["document_id", "version", "field"]).append(records.review_queue(made))
                Table(spark, f"{at}/records", ["document_id", "version"]).append(made)
            finally:
                made.unpersist()
        finally:
            kept.unpersist()

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest(stream: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """The newest value of each key so far (update or complete mode): one row of state a key."""
    return stream.groupBy(key).agg(F.max_by(value, on).alias(value), F.max(on).alias(on))
