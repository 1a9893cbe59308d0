"""What human decisions teach: harvest of observations, and how thresholds move with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import derive


def classify(decisions: DataFrame, distrusted: DataFrame, least_seconds: float) -> DataFrame:
    """Adds `category`: untrusted_reviewer, unexamined, unscored, supplied, corrected, rejected or confirmed, the first that holds."""
    bad = distrusted.select("reviewer").distinct().withColumn("bad", F.lit(True))
    d = F.col("decision")
    category = (
        F.when(F.col("bad"), "untrusted_reviewer").when(F.col("seconds") < least_seconds, "unexamined").when(F.col("confidence").isNull(), "unscored")
        .when(d == "supplied", "supplied").when(d == "corrected", "corrected").when(d == "rejected", "rejected").otherwise("confirmed")
    )
    return decisions.join(bad, "reviewer", "left").withColumn("category", category).drop("bad")


def harvest(classified: DataFrame) -> DataFrame:
    """Decisions that count as observations: confirmed ones are correct, corrected and rejected ones wrong."""
    outcome = F.when(F.col("category") == "confirmed", "correct").when(F.col("category").isin("corrected", "rejected"), "wrong")
    return classified.withColumn("outcome", outcome).where("outcome is not null").select("field", "confidence", "outcome")


def counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("field", "category").agg(F.count("*").alias("decisions"))


def profile(decisions: DataFrame) -> DataFrame:
    """reviewer, decisions, mean_seconds, agreement."""
    return decisions.groupBy("reviewer").agg(F.count("*").alias("decisions"), F.avg("seconds").alias("mean_seconds"), F.avg((F.col("decision") == "approved").cast("int")).alias("agreement"))


def movement(before: DataFrame, added: DataFrame, budgets: DataFrame) -> DataFrame:
    """field, before, after, moved: thresholds without and with the added observations; nulls (always review) compare as values."""
    a = derive(before, budgets).select("field", F.col("threshold").alias("before"))
    b = derive(before.unionByName(added), budgets).select("field", F.col("threshold").alias("after"))
    return a.join(b, "field", "full_outer").withColumn("moved", ~F.col("before").eqNullSafe(F.col("after")))
