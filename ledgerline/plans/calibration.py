"""Thresholds, calibration, routing and review over labelled documents.

Stand-ins: a labelled document is an observation, its language the field, (n_chars modulo 1000) / 1000 the confidence
and its quality whether the reading was right.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, cascade, feedback, review
from .registry import query, table

BUDGETS = (("en", 0.20), ("de", 0.30), ("es", 0.30), ("fr", 0.05))
#: Tiers that may read each language.
ELIGIBLE = {"en": [0, 1, 2, 3], "de": [0, 1, 3], "es": [0, 3], "fr": [0]}

OBSERVED = "obs AS (SELECT d.lang AS field, (d.n_chars % 1000) / 1000.0::DOUBLE AS confidence, CASE WHEN l.quality = 1 THEN 'correct' ELSE 'wrong' END AS outcome, d.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL), budgets(field, budget) AS (VALUES ('en', 0.20::DOUBLE), ('de', 0.30::DOUBLE), ('es', 0.30::DOUBLE), ('fr', 0.05::DOUBLE))"
DERIVED = OBSERVED + """, grid AS (SELECT j, 1.0::DOUBLE - j / 200.0::DOUBLE AS threshold FROM range(0, 201) t(j)),
swept AS (SELECT o.field, b.budget, g.j, g.threshold, count(*) AS published, count(*) FILTER (outcome = 'wrong') AS wrong FROM obs o JOIN budgets b USING (field) JOIN grid g ON o.confidence >= g.threshold GROUP BY ALL),
tested AS (SELECT *, CASE WHEN wrong > published * budget THEN false ELSE list_sum(list_transform(range(0, wrong + 1), lambda i: exp(lgamma(published + 1) - lgamma(i + 1) - lgamma(published - i + 1) + i * ln(budget) + (published - i) * ln(1 - budget)))) <= 0.05 END AS fits FROM swept),
best AS (SELECT field, max(j) AS j FROM tested WHERE fits GROUP BY field),
derived AS (SELECT b.field, b.budget, (SELECT count(*) FROM obs o WHERE o.field = b.field) AS observations, t.threshold, t.published, t.wrong, coalesce(t.threshold >= 0.02, false) AS useful FROM budgets b LEFT JOIN best USING (field) LEFT JOIN tested t ON t.field = best.field AND t.j = best.j)"""


def observations(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return labels.join(docs, "doc_id").select(F.col("lang").alias("field"), ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("confidence"), F.when(F.col("quality") == 1, "correct").otherwise("wrong").alias("outcome"), "doc_id")


def budgets(spark):
    return spark.createDataFrame(list(BUDGETS), "field string, budget double")


@query(f"WITH {DERIVED} SELECT * FROM derived")
def threshold_derivation(spark, sf_dir):
    """The lowest threshold of each field whose error bound keeps the budget."""
    return calibrate.derive(observations(spark, sf_dir), budgets(spark))


@query(f"""WITH {OBSERVED}, binned AS (SELECT least(floor(confidence * 10), 9)::INTEGER AS bin, count(*) AS n, avg(confidence) AS m, avg((outcome = 'correct')::INTEGER) AS a FROM obs GROUP BY 1)
SELECT r.bin::INTEGER AS bin, coalesce(n, 0) AS n, round(coalesce(m, 0), 6) AS mean_confidence, round(coalesce(a, 0), 6) AS accuracy FROM range(0, 10) r(bin) LEFT JOIN binned b ON b.bin = r.bin""")
def reliability_curve(spark, sf_dir):
    return calibrate.reliability(observations(spark, sf_dir)).select("bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH {OBSERVED}, binned AS (SELECT least(floor(confidence * 10), 9)::INTEGER AS bin, count(*) AS n, avg(confidence) AS m, avg((outcome = 'correct')::INTEGER) AS a FROM obs GROUP BY 1 HAVING count(*) >= 20)
SELECT round(sum(abs(m - a) * n) / sum(n), 6) AS ece, arg_max(bin, m - a) AS worst_bin, round(max(m - a), 6) AS worst_gap FROM binned""")
def calibration_error(spark, sf_dir):
    return calibrate.calibration_error(observations(spark, sf_dir)).select(F.round("ece", 6).alias("ece"), "worst_bin", F.round("worst_gap", 6).alias("worst_gap"))


@query(f"""WITH {DERIVED}, each AS (SELECT o.field, d.budget, o.outcome, p.policy, CASE p.policy WHEN 'naive' THEN true WHEN 'chosen' THEN o.confidence >= 0.85 ELSE coalesce(o.confidence >= d.threshold, false) END AS pub FROM obs o JOIN derived d USING (field), (VALUES ('naive'), ('chosen'), ('derived')) p(policy)),
f AS (SELECT policy, field, budget, count(*) FILTER (pub) AS published, count(*) FILTER (pub AND outcome = 'wrong') AS wrong, count(*) FILTER (NOT pub) AS queued FROM each GROUP BY ALL)
SELECT policy, sum(published)::BIGINT AS published, sum(wrong)::BIGINT AS wrong, sum(queued)::BIGINT AS queued, round(sum(wrong) / nullif(sum(published), 0), 6) AS wrong_rate, count(*) FILTER (published > 0 AND wrong > published * budget) AS budgets_missed FROM f GROUP BY policy""")
def policy_comparison(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return calibrate.compare_policies(rows, calibrate.derive(rows, budgets(spark))).withColumn("wrong_rate", F.round("wrong_rate", 6))


@query(f"""WITH {OBSERVED}, s AS (SELECT field, count(*) FILTER (confidence >= 0.9) AS n, count(*) FILTER (confidence >= 0.9 AND outcome = 'wrong') AS w FROM obs GROUP BY field)
SELECT b.field, coalesce(n, 0) AS n, coalesce(w, 0) AS wrong, ceil(ln(0.05) / ln(1 - budget))::BIGINT AS needed,
CASE WHEN coalesce(n, 0) = 0 THEN 'no_confident_population' WHEN w > n * budget THEN 'quality_limited' WHEN n < ceil(ln(0.05) / ln(1 - budget)) THEN 'evidence_limited' ELSE 'derivable' END AS diagnosis FROM budgets b LEFT JOIN s USING (field)""")
def threshold_diagnosis(spark, sf_dir):
    return calibrate.why_not(observations(spark, sf_dir), budgets(spark))


ROUTED = DERIVED + """, routed AS (SELECT o.doc_id, o.field, CASE WHEN coalesce(o.confidence >= d.threshold, false) THEN 'keep' WHEN o.field <> 'fr' THEN 'escalate' ELSE 'abstain' END AS action,
CASE WHEN coalesce(o.confidence >= d.threshold, false) OR o.field = 'fr' THEN NULL WHEN o.field IN ('en', 'de') THEN 1 ELSE 3 END AS to_tier, o.confidence, d.threshold FROM obs o JOIN derived d USING (field))"""


def routed(spark, sf_dir):
    rows = observations(spark, sf_dir)
    known = calibrate.derive(rows, budgets(spark)).select("field", "threshold")
    eligible = F.create_map(*[x for lang, tiers in ELIGIBLE.items() for x in (F.lit(lang), F.array(*[F.lit(t) for t in tiers]))])
    met = rows.join(F.broadcast(known), "field").withColumn("tier", F.lit(0))
    return met.withColumn("r", cascade.route(F.col("confidence"), F.col("threshold"), F.col("tier"), F.try_element_at(eligible, F.col("field")))).select("doc_id", "field", "confidence", "threshold", "tier", "r.action", "r.to_tier")


@query(f"""WITH {ROUTED} SELECT doc_id, field, action, to_tier, CASE WHEN threshold IS NULL THEN 'always_review' WHEN confidence < threshold THEN 'below_threshold' END AS reason FROM routed""")
def route_fields(spark, sf_dir):
    """Routing, and why a field waits for review."""
    rows = routed(spark, sf_dir)
    return rows.select("doc_id", "field", "action", "to_tier", review.queue_reason(F.col("confidence"), F.col("threshold")).alias("reason"))


@query(f"WITH {ROUTED}, t AS (SELECT 0 AS tier FROM routed UNION ALL SELECT to_tier FROM routed WHERE to_tier IS NOT NULL) SELECT tier, count(*) AS reads FROM t GROUP BY tier")
def route_distribution(spark, sf_dir):
    return cascade.distribution(routed(spark, sf_dir))


PRICE = "prices(tier, price) AS (VALUES (0, 0.0::DOUBLE), (1, 0.0015), (2, 0.010), (3, 0.004))"


def prices(spark):
    return spark.createDataFrame([(0, 0.0, "EUR"), (1, 0.0015, "EUR"), (2, 0.010, "EUR"), (3, 0.004, "EUR")], "tier int, price double, currency string")


@query(f"""WITH {ROUTED}, {PRICE}, t AS (SELECT 0 AS tier FROM routed UNION ALL SELECT to_tier FROM routed WHERE to_tier IS NOT NULL), r AS (SELECT tier, count(*) AS reads FROM t GROUP BY tier)
SELECT sum(reads)::BIGINT AS reads, round(sum(reads * price), 6) AS cost, round_even(1000 * sum(reads * price) / sum(reads), 2) AS per_1000, 'EUR' AS currency FROM r JOIN prices USING (tier)""")
def routing_cost(spark, sf_dir):
    return cascade.total(cascade.modelled(cascade.distribution(routed(spark, sf_dir)), prices(spark))).withColumn("cost", F.round("cost", 6))


@query(f"""WITH {ROUTED}, t AS (SELECT 0 AS tier FROM routed UNION ALL SELECT to_tier FROM routed WHERE to_tier IS NOT NULL), n AS (SELECT count(*) AS reads FROM t)
SELECT share, round(reads * share * 0.0015, 6) AS cost FROM n, (VALUES (0.0::DOUBLE), (0.1), (0.25), (0.5), (1.0)) s(share)""")
def cost_sensitivity(spark, sf_dir):
    return cascade.sensitivity(cascade.distribution(routed(spark, sf_dir)), prices(spark), [0.0, 0.1, 0.25, 0.5, 1.0], 1).withColumn("cost", F.round("cost", 6))


@query(f"""WITH {ROUTED}, s AS (SELECT count(DISTINCT doc_id) AS documents, avg((action <> 'keep')::INTEGER) AS rate FROM routed)
SELECT documents, floor(documents * rate)::BIGINT AS load, floor(documents * rate * 3.0)::BIGINT AS peak_load, 96::BIGINT AS capacity, floor(documents * rate * 3.0)::BIGINT <= 96 AS fits FROM s""")
def capacity_projection(spark, sf_dir):
    """What waits against what reviewers can do, on a usual and on a peak day."""
    s = routed(spark, sf_dir).agg(F.countDistinct("doc_id").alias("documents"), F.avg((F.col("action") != "keep").cast("int")).alias("rate"))
    return s.withColumn("c", review.capacity(F.col("documents"), F.col("rate"), 2, 6, 8, 3.0)).select("documents", "c.*")


EVENT_DECISIONS = "dec AS (SELECT user_id AS reviewer, event_type AS field, (value % 100) / 100.0 AS confidence, value / 10.0 AS seconds, CASE event_id % 5 WHEN 0 THEN 'corrected' WHEN 1 THEN 'rejected' WHEN 2 THEN 'supplied' ELSE 'approved' END AS decision, event_id % 5 > 2 AS agreed FROM events)"


def decisions(spark, sf_dir):
    m = F.col("event_id") % 5
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("reviewer"), F.col("event_type").alias("field"), ((F.col("value") % 100) / 100.0).alias("confidence"), (F.col("value") / 10.0).alias("seconds"), F.when(m == 0, "corrected").when(m == 1, "rejected").when(m == 2, "supplied").otherwise("approved").alias("decision"), (m > 2).alias("agreed"))


INTEGRITY = """integrity AS (SELECT reviewer, count(*) AS decisions, round(avg(agreed::INTEGER), 6) AS agreement_rate, count(*) FILTER (seconds < 4.0) AS fast, round((list_sort(list(seconds)))[(count(*) // 2 + 1)::INTEGER], 6) AS median_seconds FROM dec GROUP BY reviewer),
judged AS (SELECT *, concat_ws(',', CASE WHEN decisions < 5 THEN 'too_few_decisions' END, CASE WHEN decisions >= 5 AND agreement_rate >= 0.6 THEN 'rubber_stamp' END, CASE WHEN decisions >= 5 AND median_seconds < 4.0 THEN 'too_fast' END) AS findings FROM integrity)"""


def integrity(spark, sf_dir):
    return review.reviewer_integrity(decisions(spark, sf_dir), 0.6, 4.0, 5)


@query(f"WITH {EVENT_DECISIONS}, {INTEGRITY} SELECT * FROM judged")
def reviewer_integrity(spark, sf_dir):
    return integrity(spark, sf_dir).withColumns({"agreement_rate": F.round("agreement_rate", 6), "median_seconds": F.round("median_seconds", 6)})


HARVESTED = EVENT_DECISIONS + ", " + INTEGRITY + """, cls AS (SELECT d.*, CASE WHEN j.findings <> '' AND j.findings IS NOT NULL THEN 'untrusted_reviewer' WHEN seconds < 2.0 THEN 'unexamined' WHEN confidence IS NULL THEN 'unscored' WHEN decision = 'supplied' THEN 'supplied' WHEN decision = 'corrected' THEN 'corrected' WHEN decision = 'rejected' THEN 'rejected' ELSE 'confirmed' END AS category FROM dec d LEFT JOIN judged j USING (reviewer))"""


def harvested(spark, sf_dir):
    return feedback.classify(decisions(spark, sf_dir), integrity(spark, sf_dir).where("findings <> ''"), 2.0)


@query(f"WITH {HARVESTED} SELECT field, category, count(*) AS decisions FROM cls GROUP BY ALL")
def feedback_harvest(spark, sf_dir):
    return feedback.counts(harvested(spark, sf_dir))


@query(f"""WITH {EVENT_DECISIONS} SELECT reviewer, count(*) AS decisions, round(avg(seconds), 6) AS mean_seconds, round(avg((decision = 'approved')::INTEGER), 6) AS agreement FROM dec GROUP BY reviewer""")
def reviewer_profile(spark, sf_dir):
    return feedback.profile(decisions(spark, sf_dir)).withColumns({"mean_seconds": F.round("mean_seconds", 6), "agreement": F.round("agreement", 6)})


def _derive_sql(name: str, source: str) -> str:
    return f"""{name}_t AS (SELECT field, max(j) AS j FROM (SELECT o.field, g.j, b.budget, count(*) AS n, count(*) FILTER (outcome = 'wrong') AS w FROM {source} o JOIN budgets b USING (field) JOIN (SELECT j, 1.0::DOUBLE - j / 200.0::DOUBLE AS threshold FROM range(0, 201) t(j)) g ON o.confidence >= g.threshold GROUP BY ALL)
WHERE w <= n * budget AND list_sum(list_transform(range(0, w + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(budget) + (n - i) * ln(1 - budget)))) <= 0.05 GROUP BY field)"""


@query(f"""WITH {OBSERVED}, extra AS (SELECT d.lang AS field, 0.95::DOUBLE AS confidence, 'correct' AS outcome FROM documents d WHERE d.doc_id % 7 = 0), both_ AS (SELECT field, confidence, outcome FROM obs UNION ALL SELECT * FROM extra),
{_derive_sql('a', 'obs')}, {_derive_sql('b', 'both_')}
SELECT g.field, 1.0::DOUBLE - a_t.j / 200.0::DOUBLE AS before, 1.0::DOUBLE - b_t.j / 200.0::DOUBLE AS after, a_t.j IS DISTINCT FROM b_t.j AS moved FROM budgets g LEFT JOIN a_t USING (field) LEFT JOIN b_t USING (field)""")
def threshold_movement(spark, sf_dir):
    """How thresholds move when confirmed readings are added."""
    rows = observations(spark, sf_dir).select("field", "confidence", "outcome")
    added = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.col("lang").alias("field"), F.lit(0.95).alias("confidence"), F.lit("correct").alias("outcome"))
    return feedback.movement(rows, added, budgets(spark))
