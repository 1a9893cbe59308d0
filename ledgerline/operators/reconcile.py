"""Agreement of values across the documents of a shipment. A side that is absent or unreadable is no agreement and no disagreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantity import agrees, factor, measured


def sides(shipments: DataFrame, rules: DataFrame, values: DataFrame) -> DataFrame:
    """shipment x rule with left_value and right_value from values (shipment, document_type, field, value).

    Rules are a contract of a few rows, so each shipment is multiplied by an array of them, and each side is one equi-join.
    """
    rows = rules.collect()
    each = F.explode(F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in rules.columns]) for r in rows])).alias("r")
    base = shipments.select("shipment", each).select("shipment", "r.*")
    for side in ("left", "right"):
        own = values.select("shipment", F.col("document_type").alias(f"{side}_document"), F.col("field").alias(f"{side}_field"), F.col("value").alias(f"{side}_value"))
        base = base.join(own, ["shipment", f"{side}_document", f"{side}_field"], "left")
    return base


def outcome(left: Column, right: Column, kind: Column, amount: Column, left_unit: Column, right_unit: Column) -> Column:
    """agree, disagree or not_comparable of two printed quantities."""
    a, b = measured(left, left_unit), measured(right, right_unit)
    x, y = a["value"] * factor(a["unit"]), b["value"] * factor(b["unit"])
    return F.when(left.isNull() | right.isNull() | x.isNull() | y.isNull(), "not_comparable").when(agrees(x, y, kind, amount), "agree").otherwise("disagree")


def outcome_of_numbers(left: Column, right: Column, relative: float) -> Column:
    return F.when(left.isNull() | right.isNull(), "not_comparable").when(F.abs(left - right) <= F.lit(relative) * F.greatest(F.abs(left), F.abs(right)), "agree").otherwise("disagree")


def line_total(stated: Column, sum_: Column, unreadable: Column, relative: float) -> Column:
    """agrees, rows_missing, rows_surplus or not_comparable of a stated total and the sum of the readable rows.

    The sum is a floor. A total above it means missing rows even when some rows are unreadable; one below it means
    surplus rows only when all are readable.
    """
    near = F.abs(stated - sum_) <= F.lit(relative) * F.greatest(F.abs(stated), F.abs(sum_))
    return (F.when(stated.isNull() | sum_.isNull(), "not_comparable").when(near & (unreadable == 0), "agrees").when(~near & (stated > sum_) & (unreadable == 0), "rows_missing")
            .when((unreadable > 0) & near, "not_comparable").when((unreadable > 0) & (stated > sum_), "rows_missing").when(unreadable > 0, "not_comparable").otherwise("rows_surplus"))


def finding_rows(findings: DataFrame, found_on: Column) -> DataFrame:
    """The reconciliation_finding table of findings (shipment, rule_id, outcome, severity, left_document, right_document, client_id)."""
    text = lambda c: F.col(c).cast("string")
    return findings.select(text("shipment").alias("shipment_id"), "rule_id", "outcome", "severity", text("left_document").alias("left_document"), text("right_document").alias("right_document"), "client_id", found_on.cast("date").alias("found_on"))


def summary(findings: DataFrame) -> DataFrame:
    """rule_id, outcome counts, blocking disagreements, shipments with one."""
    bad = F.col("outcome") == "disagree"
    return findings.groupBy("rule_id").agg(F.count_if(F.col("outcome") == "agree").alias("agree"), F.count_if(bad).alias("disagree"), F.count_if(F.col("outcome") == "not_comparable").alias("not_comparable"), F.count_if(bad & (F.col("severity") == "blocking")).alias("blocking"), F.countDistinct(F.when(bad, F.col("shipment"))).alias("shipments"))


def graded(found: DataFrame, planted: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(missed, spurious): planted but not found, found but not planted."""
    return planted.select(*key).exceptAll(found.select(*key)), found.select(*key).exceptAll(planted.select(*key))
