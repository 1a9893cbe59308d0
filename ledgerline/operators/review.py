"""What waits for a human, what may be published, and how reviewers work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Scratch


def queue_reason(confidence: Column, threshold: Column) -> Column:
    """In this order: unscored, always_review, below_threshold, else null."""
    return F.when(confidence.isNull(), "unscored").when(threshold.isNull(), "always_review").when(confidence < threshold, "below_threshold")


def publishable(decision: Column, verdict: Column) -> Column:
    """A decision is needed and must not reject; without provenance a value may be supplied or corrected, not approved."""
    return F.coalesce(decision.isNotNull() & (decision != "rejected") & ((verdict == "verified") | decision.isin("supplied", "corrected")), F.lit(False))


def capacity(documents: Column, rate: Column, reviewers: int, per_hour: int, hours: int, peak: float) -> Column:
    """struct(load, peak_load, capacity, fits): daily queue against what the reviewers can do; fractions are cut."""
    load = F.floor(documents * rate).cast("long")
    most = F.floor(documents * rate * peak).cast("long")
    able = F.lit(reviewers * per_hour * hours).cast("long")
    return F.struct(load.alias("load"), most.alias("peak_load"), able.alias("capacity"), (most <= able).alias("fits"))


def upper_medians(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by, name: of an even number of values the larger middle one; groups without values do not appear.

    From counts per distinct value, so no group's values are ever gathered; a group's distinct values are what one task sorts. Over the whole table the values are dealt
    by range, and only the range that holds the middle is sorted.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    if not by:
        ranged = Scratch(rows.sparkSession, "medians").keep(counts.repartitionByRange(value).withColumn("__at", F.spark_partition_id()), "counts")
        sums = sorted((r["__at"], r["n"]) for r in ranged.groupBy("__at").agg(F.sum("__n").alias("n")).collect())  # a row a partition
        half, before = sum(n for _, n in sums) // 2 + 1, 0
        for at, n in sums:
            if before + n >= half:
                upto = F.sum("__n").over(Window.partitionBy("__at").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + before
                own = ranged.where(F.col("__at") == at).withColumn("__upto", upto)
                return own.where((F.col("__upto") >= half) & (F.col("__upto") - F.col("__n") < half)).select(F.col(value).alias(name))
            before += n
        return counts.select(F.col(value).alias(name)).limit(0)
    key = [F.col(c) for c in by] or [F.lit(1)]
    total = F.sum("__n").over(Window.partitionBy(*key))
    upto = F.sum("__n").over(Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = counts.withColumns({"__upto": upto, "__half": F.floor(total / 2) + 1}).where((F.col("__upto") >= F.col("__half")) & (F.col("__upto") - F.col("__n") < F.col("__half")))
    return middle.select(*by, F.col(value).alias(name))


def reviewer_integrity(decisions: DataFrame, most_agreement: float, least_seconds: float, enough: int) -> DataFrame:
    """reviewer, decisions, agreement_rate, fast, median_seconds, findings of (reviewer, agreed, seconds)."""
    out = decisions.groupBy("reviewer").agg(F.count("*").alias("decisions"), F.avg(F.col("agreed").cast("int")).alias("agreement_rate"), F.count_if(F.col("seconds") < least_seconds).alias("fast")).alias("o")
    medians = upper_medians(decisions, ["reviewer"], "seconds", "median_seconds").alias("m")
    out = out.join(medians, F.col("o.reviewer").eqNullSafe(F.col("m.reviewer")), "left").select("o.*", "m.median_seconds")
    few = F.col("decisions") < enough
    found = F.array(F.when(few, "too_few_decisions"), F.when(~few & (F.col("agreement_rate") >= most_agreement), "rubber_stamp"), F.when(~few & (F.col("median_seconds") < least_seconds), "too_fast"))
    return out.withColumn("findings", F.array_join(F.filter(found, lambda x: x.isNotNull()), ","))
