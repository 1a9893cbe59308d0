"""The lake: one row per field and version; appended, never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flatten(records: DataFrame) -> DataFrame:
    """Records with fields: array<struct<field, value, confidence, threshold, publishable, verdict, tier, reader_tier>> -> lake rows.

    Entries without a name are dropped. A value stays only where it is publishable and not empty. The tier is the
    entry's, else its reader's, else the record's, else 0. Verified means a verdict of exactly that.
    """
    f = F.col("f")
    rows = records.select("document_id", "version", "reader", F.col("reader_tier").alias("record_tier"), F.explode("fields").alias("f")).where(f["field"].isNotNull())
    published = F.coalesce(f["publishable"], F.lit(False)) & F.coalesce(f["value"] != "", F.lit(False))
    return rows.select("document_id", "version", "reader", f["field"].alias("field"), F.when(published, f["value"]).alias("value"), published.alias("published"), f["confidence"].alias("confidence"), f["threshold"].alias("threshold"), F.coalesce(f["tier"], f["reader_tier"], "record_tier", F.lit(0)).alias("reader_tier"), F.coalesce(f["verdict"] == "verified", F.lit(False)).alias("provenance_verified"))


def new_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """The rows of versions that the lake does not have yet."""
    return rows.join(existing.select("document_id", "version").distinct(), ["document_id", "version"], "left_anti")


def current(rows: DataFrame, key: str, on: str) -> DataFrame:
    """Each key's rows of the latest time; a tie keeps all of them. Partial maxima first, so a hot key is no hot task."""
    latest = rows.groupBy(key).agg(F.max(on).alias("latest_on"))
    return rows.join(latest, key).where(F.col(on) == F.col("latest_on")).drop("latest_on")


def with_supersedes(versions: DataFrame, key: str, version: str, on: str) -> DataFrame:
    """Each version with the one it supersedes."""
    return versions.withColumn("supersedes", F.lag(version).over(Window.partitionBy(key).orderBy(on, version)))


def missing_columns(schema: dict[str, str], have: dict[str, str], types: frozenset[str]) -> list[tuple[str, str]]:
    """Columns to add, in order; a known column of another type, or an unknown type, is refused. Nothing is ever dropped."""
    for name, kind in schema.items():
        if kind not in types:
            raise ValueError(f"unknown type {kind} of {name}")
        if name in have and have[name] != kind:
            raise ValueError(f"{name} is {have[name]}, not {kind}")
    return [(n, k) for n, k in schema.items() if n not in have]
