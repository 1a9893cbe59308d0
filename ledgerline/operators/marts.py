"""Gold projections and the four marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Modelled price of one read, by tier.
PRICES = ((0, "0"), (1, "0.0015"), (2, "0.010"), (3, "0.004"))


def _if(condition, value=1):
    return F.sum(F.when(condition, value).otherwise(0))


def duty_exposure(lines: DataFrame) -> DataFrame:
    """declaration lines -> one row per chapter (first two digits of the code)."""
    undecided = F.coalesce(F.col("human_decided"), F.lit(False)) == F.lit(False)
    return lines.groupBy(F.left("hs_code", F.lit(2)).alias("hs_chapter")).agg(
        F.count("*").alias("lines_declared"), F.countDistinct("shipment_id").alias("shipments"), F.sum("declared_value").alias("declared_value"), F.sum(F.coalesce("duty_amount", F.lit(0).cast("decimal(14,2)"))).alias("duty"),
        F.sum(F.when(undecided, F.col("declared_value")).otherwise(F.lit(0).cast("decimal(14,2)"))).alias("undecided_value"), _if(undecided).alias("undecided_lines"), F.min("declared_on").alias("first_declared_on"), F.max("declared_on").alias("last_declared_on"))


def page_reads(fields: DataFrame) -> DataFrame:
    """Distinct page reads of published fields, priced by tier."""
    prices = F.create_map(*[x for t, p in PRICES for x in (F.lit(t), F.lit(p).cast("decimal(12,6)"))])
    return fields.select("document_version", "page", "reader_tier", "language", "client_id", "read_on").dropDuplicates(["document_version", "page", "reader_tier", "language", "read_on"]).withColumn("modelled_cost", F.try_element_at(prices, F.col("reader_tier")))


def modelled_cost(reads: DataFrame) -> DataFrame:
    return reads.groupBy("read_on", "client_id", "reader_tier", "language").agg(
        F.count("*").alias("pages"), F.sum("modelled_cost").alias("modelled_cost"), F.avg(F.col("modelled_cost").cast("double")).alias("modelled_cost_per_page"), (1000.0 * F.sum("modelled_cost").cast("double") / F.nullif(F.count("*"), F.lit(0))).alias("modelled_cost_per_1000_pages"))


def quality_by_source(fields: DataFrame) -> DataFrame:
    """Published fields -> quality per day, channel, carrier, type, language and tier; refused provenance needs a check that failed."""
    missing = F.col("field_value").isNull()
    return fields.groupBy("extracted_on", "source_channel", "carrier", "document_type", "language", "reader_tier").agg(
        F.count("*").alias("fields"), _if(F.col("published")).alias("published"), _if(missing).alias("abstained"), _if(F.col("provenance_verified") == F.lit(False)).alias("provenance_refused"), _if(F.col("always_review")).alias("always_review"),
        F.avg("confidence").alias("mean_confidence"), (_if(missing) / F.nullif(F.count("*"), F.lit(0))).alias("abstention_rate"))


def review_economics(items: DataFrame, least_seconds: float = 4.0) -> DataFrame:
    """Review items -> load, speed and agreement per day, client, reason and reviewer; agreement is null where nothing was decided."""
    agreed = _if(F.col("agreed_with_model"))
    return items.groupBy("queued_on", "client_id", "queued_reason", "reviewer").agg(
        F.count("*").alias("items"), F.count("decision").alias("decided"), (F.count("*") - F.count("decision")).alias("still_waiting"), F.avg("seconds_on_task").alias("mean_seconds"), F.median("seconds_on_task").alias("median_seconds"),
        _if(F.col("seconds_on_task") < least_seconds).alias("unexamined"), agreed.alias("agreed"), _if(F.col("agreed_with_model") == F.lit(False)).alias("disagreed"), F.when(F.count("decision") > 0, agreed / F.count("decision")).alias("agreement_rate"))


def review_items(fields: DataFrame, decisions: DataFrame) -> DataFrame:
    """Unpublished fields as review items with their decisions, if any."""
    waiting = fields.where(~F.col("published")).select(F.concat(F.left("document_version", F.lit(32)), F.lit(":"), "field_name").alias("item_id"), "document_version", "field_name", F.coalesce("queued_because", F.when(F.col("threshold").isNull(), "always_review").otherwise("below_threshold")).alias("queued_reason"))
    return waiting.join(decisions, ["document_version", "field_name"], "left")


def declaration_lines(fields: DataFrame, decided: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Fields -> one row per decided document that has all the wanted fields, with the first value of each that is not null.

    `fields` is long (document, field, value), or has an array `fields` of (field, value) where many fields of a document come in one row: those are shuffled as one row.
    Documents that are not decided fall out before anything is grouped.
    """
    if "fields" in fields.columns:
        own = lambda w: F.get(F.filter("fields", lambda f: (f["field"] == w) & f["value"].isNotNull()), F.lit(0))["value"]
        rows = fields.select("document", *[own(w).alias(w) for w in wanted])
    else:
        rows = fields.where(F.col("field").isin(*wanted)).select("document", *[F.when(F.col("field") == w, F.col("value")).alias(w) for w in wanted])
    met = rows.join(decided.select("document"), "document", "left_semi")
    return met.groupBy("document").agg(*[F.first(w, True).alias(w) for w in wanted]).dropna(subset=list(wanted))


#: How each mart is read: its columns from first to last, falling.
ORDERS = {"duty_exposure": ("duty",), "modelled_cost": ("read_on", "modelled_cost"), "quality_by_source": ("extracted_on", "abstention_rate"), "review_economics": ("queued_on", "items")}


def ordered(mart: DataFrame, name: str) -> DataFrame:
    """A mart in its order, newest or largest first; rows that are equal there follow by their other columns, so the order is the same each time."""
    first = ORDERS[name]
    return mart.orderBy(*[F.desc_nulls_last(c) for c in first], *[F.asc_nulls_first(c) for c in mart.columns if c not in first])


def published_fields(lake: DataFrame) -> DataFrame:
    """The warehouse's table of fields from lake rows (version, document_type, field, value, confidence, threshold, reader, reader_tier, language, page, provenance_verified, published, extracted_on).

    Without a threshold a field is always reviewed; without a confidence it has zero there. Columns that no source fills are null.
    """
    none = lambda name: F.lit(None).cast("string").alias(name)
    return lake.select(
        F.col("version").alias("document_version"), none("shipment_id"), "document_type", F.col("field").alias("field_name"), F.col("value").alias("field_value"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "threshold",
        F.col("threshold").isNull().alias("always_review"), "published", F.coalesce("reader_tier", F.lit(0)).alias("reader_tier"), F.col("reader").alias("reader_identity"), "language", F.col("page").cast("int").alias("page"), "provenance_verified",
        none("source_channel"), none("carrier"), none("client_id"), "extracted_on",
    )
