"""Publication thresholds derived from error budgets, and how well confidences are calibrated.

Observations are rows of field, confidence (null: unscored) and outcome (correct, wrong or missing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import within_budget

#: Candidate thresholds are 1 - j / GRID for j = 0 .. GRID.
GRID = 200
#: A threshold below this separates nothing.
LEAST_USEFUL = 0.02


def candidate(confidence: Column) -> Column:
    """The least j whose threshold 1 - j / GRID the confidence reaches; thresholds are compared as floating-point numbers."""
    near = F.ceil((1 - confidence) * GRID).cast("int")
    reach = lambda j: confidence >= F.lit(1.0) - j / F.lit(float(GRID))
    return F.when(reach(near - 1), near - 1).when(reach(near), near).otherwise(near + 1)


def sweep(observations: DataFrame, budgets: DataFrame) -> DataFrame:
    """field, j, threshold, published, wrong, fits: each field's candidates from strict to lax.

    Observations collapse to at most GRID + 1 rows a field before the running sum, so no window sees them.
    """
    scored = observations.where("confidence is not null and outcome <> 'missing'")
    counts = scored.groupBy("field", candidate(F.col("confidence")).alias("j")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "wrong").alias("w"))
    running = Window.partitionBy("field").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = counts.join(F.broadcast(budgets), "field").withColumns({"published": F.sum("n").over(running), "wrong": F.sum("w").over(running), "last": F.lead("j", 1, GRID + 1).over(Window.partitionBy("field").orderBy("j"))})
    # Between two candidates with observations the counts stand still, so the last of them is as good and laxer.
    return so_far.select("field", "budget", (F.col("last") - 1).alias("j"), (F.lit(1.0) - (F.col("last") - 1) / F.lit(float(GRID))).alias("threshold"), "published", "wrong", within_budget(F.col("wrong"), F.col("published"), F.col("budget")).alias("fits"))


def derive(observations: DataFrame, budgets: DataFrame) -> DataFrame:
    """field, budget, observations, threshold (null: always review), published, wrong, useful for every budgeted field."""
    best = sweep(observations, budgets).where("fits").groupBy("field").agg(F.max_by(F.struct("threshold", "published", "wrong"), "j").alias("best"))
    n = observations.where("confidence is not null and outcome <> 'missing'").groupBy("field").agg(F.count("*").alias("observations"))
    out = budgets.join(n, "field", "left").join(best, "field", "left")
    return out.select("field", "budget", F.coalesce("observations", F.lit(0)).alias("observations"), F.col("best.threshold").alias("threshold"), F.col("best.published").alias("published"), F.col("best.wrong").alias("wrong"), F.coalesce(F.col("best.threshold") >= LEAST_USEFUL, F.lit(False)).alias("useful"))


def reliability(observations: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_confidence, accuracy of equal bins; empty bins have zeros."""
    scored = observations.where("confidence is not null and outcome <> 'missing'")
    own = scored.groupBy(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg((F.col("outcome") == "correct").cast("int")).alias("accuracy"))
    every = observations.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(own, "bin", "left").select("bin", *[F.coalesce(F.col(c), F.lit(z)).alias(c) for c, z in (("n", 0), ("mean_confidence", 0.0), ("accuracy", 0.0))])


def calibration_error(observations: DataFrame, bins: int = 10, least: int = 20) -> DataFrame:
    """ece, worst_bin (most overconfident), worst_gap over bins of at least `least`; null if there are none."""
    good = reliability(observations, bins).where(F.col("n") >= least).withColumn("gap", F.col("mean_confidence") - F.col("accuracy"))
    return good.agg((F.sum(F.abs("gap") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("ece"), F.max_by("bin", F.struct("gap", -F.col("bin"))).alias("worst_bin"), F.max("gap").alias("worst_gap"))


def compare_policies(observations: DataFrame, derived: DataFrame, chosen: float = 0.85) -> DataFrame:
    """policy, published, wrong, queued, wrong_rate, budgets_missed: publish all, above a chosen level, above the derived ones."""
    rows = observations.where("confidence is not null and outcome <> 'missing'").join(F.broadcast(derived.select("field", "budget", "threshold")), "field")
    policies = F.array(
        F.struct(F.lit("naive").alias("policy"), F.lit(True).alias("published")),
        F.struct(F.lit("chosen").alias("policy"), (F.col("confidence") >= chosen).alias("published")),
        F.struct(F.lit("derived").alias("policy"), F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False)).alias("published")))
    wrong = F.count_if(F.col("p.published") & (F.col("outcome") == "wrong"))
    by_field = rows.select("field", "budget", "outcome", F.explode(policies).alias("p")).groupBy("p.policy", "field", "budget").agg(F.count_if("p.published").alias("published"), wrong.alias("wrong"), F.count_if(~F.col("p.published")).alias("queued"))
    missed = F.count_if((F.col("published") > 0) & (F.col("wrong") > F.col("published") * F.col("budget")))
    return by_field.groupBy("policy").agg(F.sum("published").alias("published"), F.sum("wrong").alias("wrong"), F.sum("queued").alias("queued"), (F.sum("wrong") / F.nullif(F.sum("published"), F.lit(0))).alias("wrong_rate"), missed.alias("budgets_missed"))


def why_not(observations: DataFrame, budgets: DataFrame, confident: float = 0.9) -> DataFrame:
    """field, diagnosis, needed: why a field has no threshold. needed = observations without error that would do."""
    scored = observations.where("confidence is not null and outcome <> 'missing'").groupBy("field").agg(F.count_if(F.col("confidence") >= confident).alias("n"), F.count_if((F.col("confidence") >= confident) & (F.col("outcome") == "wrong")).alias("w"))
    needed = F.ceil(F.ln(F.lit(0.05)) / F.ln(1 - F.col("budget"))).cast("long")
    n, w = F.coalesce("n", F.lit(0)), F.coalesce("w", F.lit(0))
    diagnosis = F.when(n == 0, "no_confident_population").when(w > n * F.col("budget"), "quality_limited").when(n < needed, "evidence_limited").otherwise("derivable")
    return F.broadcast(budgets).join(scored, "field", "left").select("field", n.alias("n"), w.alias("wrong"), needed.alias("needed"), diagnosis.alias("diagnosis"))


def artefact(derived: DataFrame, floor: float) -> DataFrame:
    """field, threshold, floored of derived (field, threshold, always_review): what a release ships; null is always reviewed.

    An entry that is declared always-review and has a threshold, or has none and is not declared so, is an error, as is a field that is there twice. A threshold below the floor
    ships as always-review.
    """
    review = F.coalesce("always_review", F.lit(False))
    fault = F.when(review & F.col("threshold").isNotNull(), "is always reviewed and has a threshold").when(~review & F.col("threshold").isNull(), "has no threshold and is not always reviewed")
    twice = F.when(F.count("*").over(Window.partitionBy("field")) > 1, "is there twice")
    checked = derived.withColumn("__fault", F.coalesce(fault, twice))
    low = F.coalesce(F.col("threshold") < floor, F.lit(False))
    kept = F.when(F.col("__fault").isNotNull(), F.raise_error(F.concat_ws(" ", "field", "__fault")).cast("double")).when(~low, F.col("threshold"))
    return checked.select("field", kept.alias("threshold"), low.alias("floored"))
