"""Publication, stored records and findings over the stand-in tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import checkdigit
from ..operators import entities, reconcile, records
from ..shared import Scratch, shared_dir
from .documents import UNIT, _unit_findings
from .registry import query, table


THRESHOLDS = [("status", 0.5), ("priority", None), ("total", 0.7)]


def readings():
    """An order as a document of three fields: its total is checked, its status was read without a place on the page for each seventh."""
    k = F.col("o_orderkey")
    field = lambda name, value, confidence, verdict: F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), confidence.alias("confidence"), verdict.alias("verdict"))
    seen = F.lit("verified")
    return F.array(
        field("status", F.col("o_orderstatus"), (k % 100) / 100.0, F.when(k % 7 == 0, "reread_differs").otherwise(seen)),
        field("priority", F.when(k % 5 > 0, F.col("o_orderpriority")), F.lit(0.9), seen),
        field("total", F.col("o_custkey"), F.when(k % 4 > 0, F.lit(0.8)), seen),
    )


def _records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    extracted = o.select(k.alias("document"), readings().alias("fields"))
    thresholds = spark.createDataFrame(THRESHOLDS, "field string, threshold double")
    totals = o.select(k.alias("document"), F.when(k % 3 == 0, "rows_missing").otherwise("agrees").alias("outcome"))
    return records.publish_documents(extracted, thresholds, totals, "total", "reader-1", 1)


ROUTED = """x AS (SELECT o_orderkey::VARCHAR AS document_id, unnest([
 {'field': 'status', 'why': CASE WHEN o_orderkey % 100 < 50 THEN 'below_threshold' WHEN o_orderkey % 7 = 0 THEN 'unverified' END, 'value': o_orderstatus},
 {'field': 'priority', 'why': CASE WHEN o_orderkey % 5 > 0 THEN 'always_review' END, 'value': CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END},
 {'field': 'total', 'why': CASE WHEN o_orderkey % 3 = 0 THEN 'rows_missing' WHEN o_orderkey % 4 = 0 THEN 'unscored' END, 'value': o_custkey::VARCHAR}]) AS f FROM orders)"""


@query(f"""WITH {ROUTED}, c AS (SELECT document_id, count(*) FILTER (f.why IS NULL AND f.value IS NOT NULL)::INTEGER AS published, count(f.why)::INTEGER AS queued, count(*) FILTER (f.value IS NULL)::INTEGER AS missing FROM x GROUP BY 1)
SELECT *, CASE WHEN queued > 0 THEN 'queued' WHEN published > 0 THEN 'published' ELSE 'empty' END AS outcome FROM c""")
def publish_flow(spark, sf_dir):
    """From extracted fields to each document's outcome."""
    return records.outcome(_records(spark, sf_dir)).drop("version")


@query(f"WITH {ROUTED} SELECT document_id, f.field AS field, f.value AS value, f.why AS queued_because, NULL::VARCHAR AS refusal FROM x WHERE f.why IS NOT NULL")
def record_round_trip(spark, sf_dir):
    """Records written as JSON, twice appended, read and checked again; what waits for a human is read off them."""
    at = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    made = Scratch(spark, "made").keep(_records(spark, sf_dir), "records")
    records.append_json(made, at)
    records.append_json(made, at)
    waiting = records.review_queue(records.read_json(spark, at), ("refusal",))
    return waiting.select("document_id", "field", "value", "queued_because", "refusal")


@query(f"""WITH {UNIT} SELECT l_orderkey::VARCHAR AS shipment_id, 'weight_' || l_linenumber::VARCHAR AS rule_id, outcome, CASE WHEN l_linenumber < 3 THEN 'blocking' ELSE 'advisory' END AS severity, 'invoice' AS left_document, 'packing_list' AS right_document, 'c' || (l_orderkey % 5)::VARCHAR AS client_id, DATE '2024-01-01' AS found_on FROM found""")
def reconciliation_finding(spark, sf_dir):
    """The findings of the unit comparison as rows of the warehouse's table."""
    k = F.col("l_orderkey")
    found = _unit_findings(spark, sf_dir).select(k.alias("shipment"), F.concat(F.lit("weight_"), F.col("l_linenumber")).alias("rule_id"), "outcome", F.when(F.col("l_linenumber") < 3, "blocking").otherwise("advisory").alias("severity"), F.lit("invoice").alias("left_document"), F.lit("packing_list").alias("right_document"), F.concat(F.lit("c"), k % 5).alias("client_id"))
    return reconcile.finding_rows(found, F.lit("2024-01-01"))


@query("""WITH c AS (SELECT o_orderkey % 7 AS source, 'CSQ' || CASE WHEN o_orderkey % 29 = 0 THEN 'X' ELSE 'U' END || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS body, o_orderkey % 10 AS stated FROM orders),
d AS (SELECT source, body[4] <> 'U' OR (list_sum(list_transform(range(1, 11), lambda i: CASE WHEN body[i] BETWEEN '0' AND '9' THEN ascii(body[i]) - 48 ELSE ascii(body[i]) - 55 + CASE WHEN body[i] = 'A' THEN 0 WHEN body[i] <= 'K' THEN 1 WHEN body[i] <= 'U' THEN 2 ELSE 3 END END * (1 << (i - 1)::INTEGER))) % 11) % 10 <> stated AS wrong FROM c)
SELECT source, count(*) FILTER (wrong) AS wrong, count(*) AS checkable, round(count(*) FILTER (wrong) / count(*), 6) AS rate FROM d GROUP BY 1""")
def container_error_bound(spark, sf_dir):
    """The share of container numbers of each source that are provably misread."""
    k = F.col("o_orderkey")
    number = F.concat(F.lit("CSQ"), F.when(k % 29 == 0, "X").otherwise("U"), F.lpad((k % 1000000).cast("string"), 6, "0"), (k % 10).cast("string"))
    rows = table(spark, sf_dir, "orders").groupBy((k % 7).alias("source")).agg(checkdigit.error_lower_bound(number).alias("b"))
    return rows.select("source", "b.wrong", "b.checkable", F.round("b.rate", 6).alias("rate"))


@query("""SELECT o_orderkey AS record, o_custkey AS mention_id, CASE WHEN o_custkey % 10 = 0 THEN o_custkey END AS alone, n.name AS canonical_name FROM orders JOIN (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name ELSE max(c_name) FILTER (c_custkey % 10 > 0) OVER (PARTITION BY c_custkey // 10) END AS name FROM customer) n ON c_custkey = o_custkey""")
def repointed_references(spark, sf_dir):
    """Each tenth customer leaves its merged entity; orders point to what is left, whose names are found anew."""
    k = F.col("c_custkey")
    members = table(spark, sf_dir, "customer").select(k.alias("mention_id"), F.col("c_name").alias("name"))
    merged = members.select("mention_id", F.floor(F.col("mention_id") / 10).cast("string").alias("entity_id"), F.col("name").alias("canonical_name"))
    groups = members.select("mention_id", F.when(F.col("mention_id") % 10 > 0, "rest").alias("keep_together"))
    split = entities.renamed(entities.unmerge(merged, groups), members)
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("mention_id"))
    sizes = split.groupBy("entity_id", "canonical_name").agg(F.min("mention_id").alias("first"), F.count("*").alias("n"))
    pointed = entities.repoint(refs, split).join(sizes, "entity_id")
    return pointed.select("record", "mention_id", F.when((F.col("n") == 1) & (F.col("first") % 10 == 0), F.col("first")).alias("alone"), "canonical_name")
