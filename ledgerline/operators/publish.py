"""From extracted fields to outcomes, versions' records and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import queue_reason


def known_threshold(known: Column, field: Column, threshold: Column) -> Column:
    """The threshold of a field; an error where there is no artefact for it."""
    return F.when(~F.coalesce(known, F.lit(False)), F.raise_error(F.concat(F.lit("no threshold artefact for "), field))).otherwise(threshold)


def outcomes(extracted: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Extracted (document, field, value, confidence) with threshold, queued_because and publishable.

    `thresholds` has a row for each known field, with null where a field is always reviewed; a field it does not know is an
    error. A field that was not found has no reason, no threshold and is not publishable, which is not the same as queued.
    """
    met = extracted.join(F.broadcast(thresholds.select("field", "threshold").withColumn("known", F.lit(True))), "field", "left")
    checked = met.withColumn("threshold", known_threshold(F.col("known").isNotNull(), F.col("field"), F.when(F.col("value").isNotNull(), F.col("threshold"))))
    reason = F.when(F.col("value").isNotNull(), queue_reason(F.col("confidence"), F.col("threshold")))
    return checked.drop("known").withColumn("queued_because", reason).withColumn("publishable", F.col("queued_because").isNull() & F.col("value").isNotNull())


def refuse_totals(rows: DataFrame, totals: DataFrame, field: str) -> DataFrame:
    """A total with missing or surplus rows is not published: totals (document, outcome)."""
    bad = totals.where(F.col("outcome").isin("rows_missing", "rows_surplus")).select("document", F.col("outcome").alias("total_outcome"))
    met = rows.join(bad, "document", "left")
    hit = F.col("total_outcome").isNotNull() & (F.col("field") == field)
    return met.withColumn("queued_because", F.when(hit, F.col("total_outcome")).otherwise(F.col("queued_because"))).withColumn("publishable", F.col("publishable") & ~hit).drop("total_outcome")


def judged(value: Column, truth: Column, provably_wrong: Column) -> Column:
    """correct, wrong or missing; the truth may be a prefix of what was read."""
    return F.when(value.isNull() | (value == ""), "missing").when(provably_wrong, "wrong").when(F.startswith(value, truth), "correct").otherwise("wrong")


#: Share of ink below which a region is blank, above which it is saturated, and of filled rows below which it is not text.
BLANK, SATURATED, SPARSE = 0.02, 0.72, 0.25


def ink(coverage: Column, fill: Column) -> Column:
    return F.when(coverage < BLANK, "blank").when(coverage > SATURATED, "saturated").when(fill < SPARSE, "sparse").otherwise("ink")


def verdict(page_known: Column, box_valid: Column, ink_state: Column, value: Column, reread: Column) -> Column:
    """The first layer that speaks: page, arithmetic, ink, reread, agreement. `value` and `reread` are normalised."""
    contained = (F.length(value) > 0) & F.contains(reread, value)
    return (
        F.when(value.isNull(), "not_applicable").when(~F.coalesce(page_known, F.lit(False)), "page_unavailable").when(~F.coalesce(box_valid, F.lit(False)), "box_refused")
        .when(ink_state != "ink", F.concat(F.lit("no_ink_"), ink_state)).when(F.coalesce(reread, F.lit("")) == "", "reread_empty").when(F.coalesce(contained, F.lit(False)), "verified").otherwise("reread_differs")
    )


def documents_verified(fields: DataFrame) -> DataFrame:
    """document, verified: no verdict other than verified and not_applicable."""
    return fields.groupBy("document").agg(F.bool_and(F.col("verdict").isin("verified", "not_applicable")).alias("verified"))


FORBIDDEN = ("value", "text", "name", "address", "party")


def clean_spans(spans: DataFrame) -> DataFrame:
    """Telemetry whose attributes cannot hold content: a span with a forbidden attribute or a long string is an error."""
    bad = F.arrays_overlap(F.map_keys("attributes"), F.array(*[F.lit(x) for x in FORBIDDEN])) | F.exists(F.map_values("attributes"), lambda v: F.length(v) > 256)
    return spans.withColumn("attributes", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("span holds content"))).otherwise(F.col("attributes")))


def fingerprint(words: DataFrame) -> DataFrame:
    """document, fingerprint of a reading: its words in order, with positions to six places."""
    line = F.concat_ws("\x1f", F.col("page").cast("string"), F.col("line").cast("string"), "text", F.coalesce(F.format_string("%.6f", "confidence"), F.lit("\x00")), *[F.format_string("%.6f", c) for c in ("left", "top", "width", "height")])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "word", line.alias("l")))), lambda x: x["l"]), "\x1e")
    return words.groupBy("document").agg(F.sha2(body, 256).alias("fingerprint"))
