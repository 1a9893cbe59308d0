"""Records, ledgers and the small rules, by the IDs of the survey."""

import json
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerline.functions import checkdigit
from ledgerline.operators import classify, records
from ledgerline.plans.records import _records


def test_a10_n4_a_changed_record_is_refused(spark, data, tmp_path):
    at = str(tmp_path / "r")
    records.append_json(_records(spark, data), at)
    back = records.read_json(spark, at)
    n = back.count()
    assert n == spark.read.parquet(f"{data}/orders.parquet").count() and back.where("refusal is not null").count() == 0
    line = json.loads(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.json").text(at).orderBy("value").first()[0])
    other = dict(line, reader="else")
    twice = dict(line, fields=line["fields"] * 2)
    broken = tmp_path / "b.json"
    broken.write_text("\n".join([json.dumps(line), json.dumps(other), json.dumps(twice), "{", json.dumps(dict(line, version=None))]))
    got = sorted(str(r["refusal"]) for r in records.read_json(spark, str(broken)).collect())
    assert got == ["None", "fingerprint", "no_version", "repeated_field", "unreadable"]


def test_a17_j18_reprocess_resumes_and_is_idempotent(spark, tmp_path):
    at = str(tmp_path / "ledger")
    docs = spark.range(20).select(F.col("id").cast("string").alias("document"))
    work = lambda b: b.select("document", F.concat(F.lit("v"), "document").alias("version"), F.lit(False).alias("refused"))
    assert records.scan(spark, at).count() == 0
    records.reprocess(docs.where("document < 5"), work, at, "r", 3)
    assert records.reprocess(docs, work, at, "r", 6) >= 1 and records.reprocess(docs, work, at, "r", 6) == 0
    got = records.scan(spark, at)
    assert got.count() == 20 == got.select("document").distinct().count()


def test_a15_f9_f10_load_counts_what_it_leaves_out(spark, tmp_path):
    rows = spark.createDataFrame([("d", "1", None, "x", None), ("d", "2", "1", None, 1), ("e", "3", None, "y", 2)], "document_id string, version string, supersedes string, value string, tier int")
    assert [tuple(r) for r in records.load(rows, str(tmp_path / "w"), ["tier"]).collect()] == [("tier", 1)]
    assert records.loaded(spark, str(tmp_path / "w")).count() == 2
    records.load(rows.where("document_id = 'd'"), str(tmp_path / "w"), ["tier"])
    assert records.loaded(spark, str(tmp_path / "w")).count() == 1
    assert tuple(records.lake_counts(rows).first()) == (3, 2, 3, 1)


def test_d4_lower_bound(spark):
    rows = spark.createDataFrame([("CSQU3054383",), ("CSQU3054384",), ("nonsense",), (None,)], "v string")
    assert tuple(rows.agg(checkdigit.error_lower_bound(F.col("v")).alias("b")).first()["b"]) == (2, 3, pytest.approx(2 / 3))
    assert tuple(rows.where("false").agg(checkdigit.error_lower_bound(F.col("v")).alias("b")).first()["b"]) == (0, 0, 0.0)


def test_b17_c20_m5_headings(spark):
    heads = spark.createDataFrame([("01", "live animals")], "code string, description string")
    ok = spark.createDataFrame([("g", "01", 0.5)], "goods_id string, code string, score double")
    assert classify.declared(ok, heads).first()["decided"] is False
    for code in ("99", None):
        with pytest.raises(PySparkException):
            classify.declared(spark.createDataFrame([("g", code, 0.5)], "goods_id string, code string, score double"), heads).collect()
    context = spark.createDataFrame([("h", "01")], "goods_id string, code string")
    assert classify.restricted(ok, context).count() == 0
    floor = classify.prior_floor(spark.createDataFrame([("a", 1.0), ("b", 0.0)], "class string, intercept double"))
    assert floor.first()["floor"] == pytest.approx(math.e / (math.e + 1))


def test_a16_one_decision_a_version_and_field(spark, tmp_path):
    at = str(tmp_path / "d")
    rows = spark.createDataFrame([("v", "total", "accepted"), ("v", "total", "rejected"), ("v", "date", "rejected")], "version string, field string, decision string")
    rows = rows.selectExpr("*", "'x' AS value", "'r' AS reviewer", "timestamp'2024-01-01' AS decided_on")
    assert records.decisions(spark, at).count() == 0 and records.record_decisions(rows, at) == 2
    assert records.record_decisions(rows.withColumn("decision", F.lit("changed")), at) == 0
    assert {(r["field"], r["decision"]) for r in records.decisions(spark, at).collect()} == {("total", "accepted"), ("date", "rejected")}


def test_j3_inconsistent_artefacts_are_refused(spark):
    from ledgerline.operators import calibrate

    kinds = "field string, threshold double, always_review boolean"
    good = spark.createDataFrame([("a", 0.9, False), ("b", None, True), ("c", 0.1, None)], kinds)
    assert sorted(map(tuple, calibrate.artefact(good, 0.5).collect())) == [("a", 0.9, False), ("b", None, False), ("c", None, True)]
    for bad in (("d", 0.9, True), ("d", None, False), ("a", 0.8, False)):
        with pytest.raises(PySparkException):
            calibrate.artefact(good.unionByName(spark.createDataFrame([bad], kinds)), 0.5).collect()


def test_j6_reasons_are_derived_anew(spark):
    from ledgerline.operators import cascade

    fields = spark.createDataFrame([("d", f, "old", 0.2, t, 0, "below_threshold", False) for f, t in (("up", 0.5), ("still", 0.5), ("never", None), ("model", 0.5), ("unread", 0.5), ("stays", 0.5))], "document string, field string, value string, confidence double, threshold double, tier int, queued_because string, publishable boolean")
    moved = spark.createDataFrame([("d", "up", 1), ("d", "still", 1), ("d", "never", 1), ("d", "model", 2), ("d", "unread", 1)], "document string, field string, next int")
    readings = spark.createDataFrame([("d", "up", 1, "new", 0.9), ("d", "still", 1, "new", 0.3), ("d", "never", 1, "new", 0.9), ("d", "model", 2, "new", 0.99), ("d", "stays", 1, "x", 1.0)], "document string, field string, tier int, value string, confidence double")
    got = {r["field"]: (r["value"], r["confidence"], r["tier"], r["queued_because"], r["publishable"]) for r in cascade.redecide(fields, moved, readings, (0, 1)).collect()}
    assert got == {
        "up": ("new", 0.9, 1, None, True), "still": ("new", 0.3, 1, "below_threshold", False), "never": ("new", 0.9, 1, "always_review", False), "model": ("new", None, 2, "unscored", False),
        "unread": ("old", None, 1, "unscored", False), "stays": ("old", 0.2, 0, "below_threshold", False),
    }


def test_f5_h1_published_fields_and_the_order_of_marts(spark):
    from ledgerline.operators import marts

    lake = spark.createDataFrame([("v", "invoice", "total", "5", None, None, "r", None, "en", "2", True, False, "2024-01-01"), ("v", "invoice", "date", None, 0.5, 0.7, "r", 1, "en", None, False, True, "2024-01-02")], "version string, document_type string, field string, value string, confidence double, threshold double, reader string, reader_tier int, language string, page string, provenance_verified boolean, published boolean, extracted_on string")
    made = marts.published_fields(lake)
    assert [(r["field_name"], r["confidence"], r["always_review"], r["reader_tier"], r["page"], r["carrier"]) for r in made.collect()] == [("total", 0.0, True, 0, 2, None), ("date", 0.5, False, 1, None, None)]
    mart = marts.ordered(marts.quality_by_source(made), "quality_by_source").collect()
    assert [(r["extracted_on"], r["abstention_rate"]) for r in mart] == [("2024-01-02", 1.0), ("2024-01-01", 0.0)]


def test_h2_d22_top_candidates_and_universal_terms(spark):
    rows = spark.createDataFrame([("g", c, s, p, False) for c, s, p in (("x", 0.5, 3), ("b", 0.9, 2), ("a", 0.9, 1), ("c", 0.1, 0))], "goods_id string, code string, score double, place int, contested boolean")
    assert [r["code"] for r in classify.top_candidates(rows).orderBy("rank").collect()] == ["a", "b", "x"]
    assert [r["code"] for r in classify.top_candidates(rows.withColumn("place", -F.col("place")), 2).orderBy("rank").collect()] == ["b", "a"]
    assert classify.decide(rows.drop("place")).first()["code"] == "a" and classify.decide(rows.withColumn("place", -F.col("place"))).first()["code"] == "b"
    notes = spark.createDataFrame([("1", ["pump", "water"]), ("2", ["valve", "water", "water"])], "code string, terms array<string>")
    assert [r["term"] for r in classify.universal(notes).collect()] == ["water"]


def test_k9_compare_explains(spark):
    from ledgerline.functions import text

    rows = spark.createDataFrame([("Total", "total"), ("10O", "100"), ("abc", "abd"), ("ab", "abc"), (None, "a"), ("aaaaaaa", "bcdefgh")], "a string, b string")
    got = [tuple(r["comparison"]) if r["comparison"] else None for r in text.compare(rows, "a", "b", ["case"]).collect()]
    assert got[0] == (True, False, [], []) and got[2] == (False, False, [], ["3:c>d"]) and got[3][:3] == (False, True, []) and got[4][0] is None and len(got[5][3]) == 5
    assert text.compare(rows.where("a = '10O'"), "a", "b", []).first()["comparison"]["confusions"] == ["O>0"]


def test_l7_faults_of_tolerances(spark):
    from ledgerline.functions import quantity

    rows = [("relative", 0.1, None, None), ("absolute", 1.0, "kg", None), ("relative", -0.1, None, "negative"), ("absolute", 1.0, None, "absolute_without_unit"), ("relative", 0.1, "kg", "relative_with_unit"), ("relative", 0.5, None, "implausible"), ("other", 1.0, None, "incomplete"), ("relative", None, None, "incomplete")]
    df = spark.createDataFrame(rows, "kind string, amount double, unit string, wanted string")
    assert df.where(~quantity.tolerance_fault(F.col("kind"), F.col("amount"), F.col("unit")).eqNullSafe(F.col("wanted"))).count() == 0


def test_b18_e7_a23(spark, tmp_path):
    from ledgerline.functions import geometry
    from ledgerline.operators import publish
    from ledgerline.sources import readings

    spans = lambda *maps: publish.clean_spans(spark.createDataFrame([(m,) for m in maps], "attributes map<string,string>"))
    assert spans({"tier": "1"}, {}, None).count() == 3
    for bad in ({"value": "x"}, {"note": "x" * 257}):
        with pytest.raises(PySparkException):
            spans(bad).collect()
    b = geometry.clipped(geometry.box(F.lit(-0.1), F.lit(0.5), F.lit(0.3), F.lit(0.9)))
    assert tuple(round(v, 9) for v in spark.range(1).select(b.alias("b")).first()["b"]) == (0.0, 0.5, 0.2, 0.5)
    spark.createDataFrame([(0.5, "a", "a"), (0.9, "a", "b"), (None, None, "b")], "confidence double, text string, truth string").write.parquet(str(tmp_path / "e"))
    assert sorted(map(str, (r["correct"] for r in readings.external_set(spark, str(tmp_path / "e")).collect()))) == ["False", "None", "True"]


def test_a4_page_sizes_and_lines_in_order(spark, tmp_path):
    from ledgerline.sources import readings

    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    word = "5\t{}\t{}\t1\t1\t{}\t{}\t10\t20\t10\t{}\t{}".format
    lines = [head, "1\t1\t0\t0\t0\t0\t0\t0\t100\t200\t-1\t", word(1, 2, 1, 10, 96.5, '"q'), word(1, 1, 1, 50, 120, "b"), word(1, 2, 2, 40, 50, "c"), word(1, 1, 2, 90, 50, "off"), "1\t2\t0\t0\t0\t0\t0\t0\t400\t400\t-1\t", word(2, 1, 1, 40, 50, "d"), word(2, 1, 2, 40, -1, "x")]
    (tmp_path / "o.tsv").write_text("\n".join(lines) + "\n")
    got = {r["text"]: (r["page"], r["line"], r["confidence"], r["left"], r["height"]) for r in readings.ocr_table(spark, str(tmp_path / "o.tsv")).collect()}
    assert got == {'"q': (1, 0, 0.965, 0.1, 0.05), "b": (1, 1, 1.0, 0.5, 0.05), "c": (1, 0, 0.5, 0.4, 0.05), "d": (2, 0, 0.5, 0.1, 0.025)}
    (tmp_path / "p.tsv").write_text("\n".join([head, word(1, 1, 1, 10, 50, "a")]) + "\n")
    with pytest.raises(PySparkException):
        readings.ocr_table(spark, str(tmp_path / "p.tsv")).collect()
    assert readings.ocr_table(spark, str(tmp_path / "p.tsv"), 100, 100).first()["left"] == 0.1


def test_o4_the_newest_version_of_a_stream(spark, tmp_path):
    from ledgerline.streaming import jobs

    for i, rows in enumerate(([("a", 1, "x"), ("b", 5, "y")], [("a", 3, "z"), ("b", 2, "old")])):
        spark.createDataFrame(rows, "k string, t int, v string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("k string, t int, v string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = jobs.latest(stream, "k", "t", "v").writeStream.outputMode("complete").format("memory").queryName("newest").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("newest").collect())) == [("a", "z", 3), ("b", "y", 5)]


def test_j26_a_model_is_judged_and_kept(spark, tmp_path):
    words = {"pump": ["water pump", "steel pump", "pump for oil", "a pump", "hand pump set"], "valve": ["steel valve", "valve body", "gate valve", "a valve", "valve set"]}
    rows = spark.createDataFrame([(t + extra, label) for label, own in words.items() for t in own for extra in ("", " new", " 2 pieces")], "text string, label string")
    figures = classify.judged(rows, "text", "label", 3)
    total = figures.agg(F.sum("rows"), F.sum("right")).first()
    assert total[0] == 30 and total[1] >= 28
    model = classify.fit(rows, "text", "label")
    classify.save(model, figures, str(tmp_path / "m"))
    again, known = classify.kept(spark, str(tmp_path / "m"))
    new = spark.createDataFrame([("old pump",), ("iron valve",), (None,)], "text string")
    assert [r["predicted"] for r in classify.predicted(again, new, "text").collect()][:2] == ["pump", "valve"] and sorted(map(tuple, known.collect())) == sorted(map(tuple, figures.collect()))
    with pytest.raises(ValueError):
        classify.save(model, figures.limit(0), str(tmp_path / "n"))


def test_messages_carry_their_records_refusal(spark, data):
    """F8: what waits is read off the records in one scan, without a join of the records to themselves."""
    from ledgerline import plans

    assert "Join" not in plans.QUERIES["record_round_trip"](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_f9_fields_as_an_array_make_the_same_records(spark):
    """Long rows and arrays give equal records; arrays are not grouped, and totals meet documents instead of fields."""
    rows = [("a", "status", "1", 0.9, "verified"), ("a", "total", "5", 0.9, "verified"), ("b", "total", None, None, None), ("b", "status", "2", 0.1, "verified"), ("c", "status", "3", None, "verified"), ("c", "total", "7", 0.9, "reread_differs")]
    long = spark.createDataFrame(rows, "document string, field string, value string, confidence double, verdict string")
    arrays = spark.createDataFrame([(d, [r[1:] for r in rows if r[0] == d]) for d in "abc"], "document string, fields array<struct<field: string, value: string, confidence: double, verdict: string>>")
    thresholds = spark.createDataFrame([("status", 0.5), ("total", 0.7)], "field string, threshold double")
    totals = spark.createDataFrame([("a", "rows_missing"), ("b", "rows_surplus"), ("c", "agrees")], "document string, outcome string")
    made = records.publish_documents(arrays, thresholds, totals, "total", "r", 1)
    got = sorted(map(str, made.collect()))
    assert got == sorted(map(str, records.publish_documents(long, thresholds, totals, "total", "r", 1).collect()))
    reasons = {r["document_id"]: {f["field"]: f["queued_because"] for f in r["fields"]} for r in made.collect()}
    assert reasons == {"a": {"status": None, "total": "rows_missing"}, "b": {"status": "below_threshold", "total": "rows_surplus"}, "c": {"status": "unscored", "total": "unverified"}}
    # The one aggregation is that of the thresholds.
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    with pytest.raises(Exception, match="no threshold artefact"):
        records.publish_documents(arrays, thresholds.where("field <> 'total'"), totals, "total", "r", 1).collect()
