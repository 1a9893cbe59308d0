"""Routing of fields through reader tiers, and the modelled cost of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import queue_reason


def route(confidence: Column, threshold: Column, tier: Column, eligible: Column) -> Column:
    """struct(action, to_tier): keep if the threshold is met; else escalate to the lowest eligible tier above; else abstain."""
    keep = F.coalesce(confidence >= threshold, F.lit(False))
    above = F.array_min(F.filter(F.coalesce(eligible, F.array(F.lit(0))), lambda t: t > tier))
    return F.struct(F.when(keep, "keep").when(above.isNotNull(), "escalate").otherwise("abstain").alias("action"), F.when(~keep, above).alias("to_tier"))


def distribution(routed: DataFrame) -> DataFrame:
    """tier, reads: one at the current tier, and one at the target of an escalation."""
    return routed.select(F.explode(F.array_compact(F.array("tier", "to_tier"))).alias("tier")).groupBy("tier").agg(F.count("*").alias("reads"))


def climb(fields: DataFrame, readings: DataFrame, scoring: tuple[int, ...], rounds: int = 3) -> DataFrame:
    """Escalate round by round: document, field, confidence, threshold, tier, eligible -> the same with the tier reached and a reason.

    All fields of a document that escalate in a round go to the lowest tier that any of them asks for. `readings` (document, field,
    tier, confidence, value) is what each tier reads; a tier that does not score gives a null confidence. Tiers bound the rounds.
    """
    now = fields
    for _ in range(rounds):
        asked = now.withColumn("r", route(F.col("confidence"), F.col("threshold"), F.col("tier"), F.col("eligible")))
        lowest = asked.where(F.col("r.action") == "escalate").groupBy("document").agg(F.min("r.to_tier").alias("called"))
        moved = asked.join(lowest, "document", "left").withColumn("next", F.when((F.col("r.action") == "escalate") & F.array_contains("eligible", F.col("called")), F.col("called")))
        read = readings.select("document", "field", F.col("tier").alias("next"), F.col("confidence").alias("new_confidence"))
        met = moved.join(read, ["document", "field", "next"], "left")
        scored = F.when(F.col("next").isin(*scoring), F.col("new_confidence"))
        now = met.select("document", "field", F.when(F.col("next").isNull(), F.col("confidence")).otherwise(scored).alias("confidence"), "threshold", F.coalesce("next", "tier").alias("tier"), "eligible")
    return now


def redecide(fields: DataFrame, moved: DataFrame, readings: DataFrame, scoring: tuple[int, ...]) -> DataFrame:
    """Fields (document, field, value, confidence, threshold, tier, queued_because, publishable) after what went up (`moved`: document, field, next) was read again.

    What went up gets the value and confidence that its new tier read (`readings`: document, field, tier, value, confidence), and the reason to queue it is derived from these
    and the threshold. A tier that does not score cannot publish: its fields are unscored. Without a reading the value stays and nothing vouches for it. Other fields stay as they are.
    """
    read = readings.select("document", "field", F.col("tier").alias("next"), F.col("value").alias("new_value"), F.col("confidence").alias("new_confidence"), F.lit(True).alias("seen"))
    met = fields.join(moved.select("document", "field", "next"), ["document", "field"], "left").join(read, ["document", "field", "next"], "left")
    up, scores = F.col("next").isNotNull(), F.col("next").isin(*scoring)
    value = F.when(up & F.col("seen"), F.col("new_value")).otherwise(F.col("value"))
    confidence = F.when(up, F.when(scores, F.col("new_confidence"))).otherwise(F.col("confidence"))
    why = F.when(scores, queue_reason(F.col("new_confidence"), F.col("threshold"))).otherwise("unscored")
    publish = scores & why.isNull() & (F.coalesce(value, F.lit("")) != "")
    return met.select("document", "field", value.alias("value"), confidence.alias("confidence"), "threshold", F.coalesce("next", "tier").alias("tier"), F.when(up, why).otherwise(F.col("queued_because")).alias("queued_because"), F.when(up, publish).otherwise(F.col("publishable")).alias("publishable"))


def modelled(reads: DataFrame, prices: DataFrame) -> DataFrame:
    """Per tier: reads, cost; prices (tier, price, currency) of one currency, one for every tier."""
    priced = reads.join(F.broadcast(prices), "tier", "left")
    known = F.when(F.col("price").isNull(), F.raise_error(F.lit("a tier has no price"))).otherwise(F.col("price"))
    return priced.select("tier", "reads", (F.col("reads") * known).alias("cost"), "currency")


def total(costs: DataFrame) -> DataFrame:
    """reads, cost, per_1000 (half-even, two places); refuses several currencies."""
    one = F.when(F.countDistinct("currency") > 1, F.raise_error(F.lit("several currencies"))).otherwise(F.max("currency"))
    return costs.agg(F.sum("reads").alias("reads"), F.sum("cost").alias("cost"), F.bround(1000 * F.sum("cost").cast("double") / F.nullif(F.sum("reads"), F.lit(0)), 2).alias("per_1000"), one.alias("currency"))


def sensitivity(reads: DataFrame, prices: DataFrame, shares: list[float], tier: int) -> DataFrame:
    """share, cost: what all reads cost if a share of them went to `tier` and the others to tier 0."""
    n = reads.agg(F.sum("reads").alias("reads"))
    cost = prices.agg(F.max(F.when(F.col("tier") == tier, F.col("price"))).alias("high"), F.max(F.when(F.col("tier") == 0, F.col("price"))).alias("low"))
    return n.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).withColumns({"one": F.lit(1)}).join(F.broadcast(cost.withColumn("one", F.lit(1))), "one").select("share", (F.col("reads") * (F.col("share") * F.col("high").cast("double") + (1 - F.col("share")) * F.col("low").cast("double"))).alias("cost"))
