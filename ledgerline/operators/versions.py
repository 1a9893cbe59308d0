"""Content-addressed versions and what changes between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(rows: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """key, version: the first 32 hexadecimal digits of the SHA-256 of a document's fields in canonical order.

    Fields are joined by unit separators and rows by record separators; null is a byte that no value holds.
    """
    return rows.groupBy(key).agg(version(F.collect_list(F.struct(*order, line(*[F.col(f) for f in fields])))).alias("version"))


def line(*values: Column) -> Column:
    """A row of the digest, as the member `line` of a struct."""
    return F.concat_ws("\x1f", *[F.coalesce(v.cast("string"), F.lit("\x00")) for v in values]).alias("line")


def version(entries: Column) -> Column:
    """The digest of a document from an array of structs that end with `line`, in the order of their other members."""
    body = F.array_join(F.transform(F.array_sort(entries), lambda x: x["line"]), "\x1e")
    return F.left(F.sha2(body, 256), F.lit(32))


def diff(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, before, after, change (added, removed, changed) of the fields that differ; null equals null."""
    a = before.select(*key, F.col(value).alias("before"), F.lit(True).alias("had"))
    b = after.select(*key, F.col(value).alias("after"), F.lit(True).alias("has"))
    both = a.join(b, key, "full_outer")
    change: Column = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*key, "before", "after", "change")


def surviving(decisions: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Decisions on fields that did not change."""
    return decisions.join(changes.select(*key).distinct(), key, "left_anti")


def requeued(decisions: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Decisions on fields that changed: to be made again."""
    return decisions.join(changes.select(*key).distinct(), key, "left_semi")


def decided(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Superseding rows of (document, field, value, reader) after (document, field, decision, supplied); the reader is marked once."""
    value = F.when(F.col("decision").isin("corrected", "supplied"), F.col("supplied")).when(F.col("decision") == "rejected", F.lit(None)).otherwise(F.col("value"))
    reader = F.when(F.col("decision").isNull() | F.endswith("reader", F.lit("+review")), F.col("reader")).otherwise(F.concat("reader", F.lit("+review")))
    return rows.join(decisions, ["document", "field"], "left").select("document", "field", value.alias("value"), reader.alias("reader"))
