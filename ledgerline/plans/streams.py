"""Streams driven to completion over the events table's files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.commits import Table
from ..shared import shared_dir
from ..streaming import jobs
from .records import ROUTED, THRESHOLDS, readings
from .registry import query, table
from .warehouse import BANDS, traffic

CLOSED = "closed AS (SELECT * FROM events WHERE ts::DATE < (SELECT max(ts)::DATE FROM events))"


def _stream(spark, sf_dir, name):
    """A table's files as a stream; the folder is read with a filter on the file's name, so other tables do not match."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/{name}.parquet*")


def _events(spark, sf_dir):
    return _stream(spark, sf_dir, "events")


@query(f"""WITH {CLOSED}, w AS (SELECT ts::DATE AS day, count(DISTINCT user_id) AS documents, median(CASE WHEN event_id % 10 > 0 THEN (value % 100) / 100.0 END) AS m, avg((event_type = 'error')::INTEGER) AS a FROM closed GROUP BY 1)
SELECT day, documents, 'median_confidence' AS measure, round(m, 6) AS value, CASE WHEN m BETWEEN 0.45 AND 0.55 THEN 'inside' ELSE 'drifted' END AS state FROM w UNION ALL SELECT day, documents, 'abstention_rate', round(a, 6), CASE WHEN a BETWEEN 0.0 AND 0.2 THEN 'inside' ELSE 'drifted' END FROM w""")
def drift_stream(spark, sf_dir):
    """Drift findings of all closed days, by a stream that ends when the files do. The last day stays open."""
    at = f"{shared_dir(spark)}/drift-{uuid.uuid4().hex}"
    stream = jobs.with_event_time(traffic(_events(spark, sf_dir)), late="0 seconds")
    jobs.watch(stream, BANDS, 1, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return Table(spark, f"{at}/out").read().select("day", "documents", "measure", F.round("value", 6).alias("value"), "state")


@query("SELECT user_id AS document_id, event_id AS version, event_type AS field FROM events")
def landing_stream(spark, sf_dir):
    """Every delivery lands twice in the stream and once in the lake."""
    at = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    stream = _events(spark, sf_dir).select(F.col("user_id").alias("document_id"), F.col("event_id").alias("version"), F.col("event_type").alias("field"), F.col("ts").cast("timestamp").alias("extracted_on"))
    twice = stream.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    jobs.land(twice, lambda b: b.select("document_id", "version", "field"), f"{at}/lake", f"{at}/checkpoint", late="365 days").awaitTermination()
    return Table(spark, f"{at}/lake").read()


@query(f"""WITH {ROUTED}, y AS (SELECT *, document_id::BIGINT AS k FROM x)
SELECT 'queue' AS sink, document_id, f.field AS field, f.why AS reason FROM y WHERE k % 13 > 0 AND k % 17 > 0 AND f.why IS NOT NULL
UNION ALL SELECT DISTINCT 'records', document_id, NULL, NULL FROM y WHERE k % 13 > 0 AND k % 17 > 0
UNION ALL SELECT 'refused', CASE WHEN o_orderkey % 13 = 0 THEN 'elsewhere/' || o_orderkey || '.pdf' ELSE 'incoming/en/invoice/' || o_orderkey || '.pdf' END, NULL, CASE WHEN o_orderkey % 13 = 0 THEN 'path' ELSE 'no_fields' END FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 17 = 0""")
def arrival_stream(spark, sf_dir):
    """Orders arrive as readings; some paths are none, some readings are empty. What three sinks have got."""
    at = f"{shared_dir(spark)}/arrival-{uuid.uuid4().hex}"
    k = F.col("o_orderkey")
    path = F.concat(F.when(k % 13 == 0, "elsewhere/").otherwise("incoming/en/invoice/"), k.cast("string"), F.lit(".pdf"))
    rows = _stream(spark, sf_dir, "orders").select(path.alias("path"), F.when(k % 17 > 0, readings()).alias("fields"))
    thresholds = spark.createDataFrame(THRESHOLDS, "field string, threshold double")
    totals = lambda d: d.select("document", F.when(F.col("document").cast("long") % 3 == 0, "rows_missing").otherwise("agrees").alias("outcome"))
    jobs.arrive(rows, thresholds, totals, "total", "reader-1", 1, at, f"{at}/checkpoint").awaitTermination()
    none = F.lit(None).cast("string")
    queue = Table(spark, f"{at}/queue").read().select(F.lit("queue").alias("sink"), "document_id", "field", F.col("queued_because").alias("reason"))
    made = Table(spark, f"{at}/records").read().select(F.lit("records").alias("sink"), "document_id", none.alias("field"), none.alias("reason"))
    refused = Table(spark, f"{at}/refused").read().select(F.lit("refused").alias("sink"), F.col("path").alias("document_id"), none.alias("field"), "reason")
    return queue.unionByName(made).unionByName(refused)
