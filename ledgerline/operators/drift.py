"""Summaries of traffic, and whether they stay within their bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import upper_medians


def window_summary(rows: DataFrame, by: list[Column | str]) -> DataFrame:
    """documents, median_confidence, abstention_rate, unscored of rows (document, confidence, abstained) per `by`."""
    return rows.groupBy(*by).agg(F.countDistinct("document").alias("documents"), F.median("confidence").alias("median_confidence"), F.avg(F.col("abstained").cast("int")).alias("abstention_rate"), F.count_if(F.col("confidence").isNull()).alias("unscored"))


def assess(windows: DataFrame, bands: dict[str, tuple[float, float]], least: int) -> DataFrame:
    """One row per window and measure: undecided below `least` documents or without a value, else inside or drifted."""
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for m, (lo, hi) in bands.items()])).alias("m")
    keys = [c for c in windows.columns if c not in (*bands, "unscored")]
    state = F.when((F.col("documents") < least) | F.col("value").isNull(), "undecided").when(F.col("value").between(F.col("low"), F.col("high")), "inside").otherwise("drifted")
    return windows.select(*keys, measures).select(*keys, "m.*").withColumn("state", state)


def envelope(rows: DataFrame, by: str) -> DataFrame:
    """Figures overall (null group) and per group, by grouping sets; the median is the upper one."""
    # (group, value, rows): the medians come from counts per distinct value, not from the values.
    figures = rows.rollup(by).agg(F.count("*").alias("n"), F.avg((F.col("confidence") < 0.5).cast("int")).alias("below_half"), F.avg(F.col("abstained").cast("int")).alias("abstained"), F.grouping(by).alias("__all")).alias("f")
    whole = upper_medians(rows, [], "confidence", "median").select(F.lit(None).cast(dict(rows.dtypes)[by]).alias(by), "median", F.lit(1).alias("__all"))
    medians = upper_medians(rows, [by], "confidence", "median").withColumn("__all", F.lit(0)).unionByName(whole).alias("m")
    met = figures.join(medians, (F.col("f.__all") == F.col("m.__all")) & F.col(f"f.{by}").eqNullSafe(F.col(f"m.{by}")), "left")
    return met.select(f"f.{by}", "f.n", "m.median", "f.below_half", "f.abstained")


def breaches(figures: DataFrame, accepted: DataFrame, as_of: str) -> DataFrame:
    """Figures outside their band that no acceptance, still running on `as_of`, covers."""
    live = accepted.where(F.col("expires_on") > F.lit(as_of).cast("date")).select("figure").distinct()
    return figures.where(~F.col("value").between(F.col("low"), F.col("high"))).join(live, "figure", "left_anti")
