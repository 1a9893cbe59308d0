from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import checkdigit, geometry, quantity, stats, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("printed,value,refused", [
    ("1.250,50", "1250.50", None), ("1,250.50", "1250.50", None), ("27 000,5", "27000.5", None), ("0,75", "0.75", None), ("-12.5", "-12.5", None), ("27000", "27000", None),
    ("1,250", None, "ambiguous"), ("1.250", None, "ambiguous"), ("  ", None, "missing"), (None, None, "missing"), ("12..5", None, "not_a_number"), ("1,250,500", "1250500", None), ("abc", None, "not_a_number")])
def test_number(spark, printed, value, refused):
    got = one(spark, quantity.number(F.lit(printed).cast("string")))
    assert got["refused"] == refused
    assert got["value"] == (None if value is None else Decimal(value))


@pytest.mark.parametrize("printed,value,refused", [("EUR 1.250,50", "1250.50", None), ("1,250.50 USD", "1250.50", None), ("1O5", None, "not_a_number"), ("EUR", None, "missing")])
def test_money(spark, printed, value, refused):
    got = one(spark, quantity.money(F.lit(printed)))
    assert (got["value"], got["refused"]) == (None if value is None else Decimal(value), refused)


def test_units(spark):
    assert one(spark, quantity.factor(F.lit("LBS"))) == Decimal("0.45359237")
    assert one(spark, quantity.measured(F.lit("59525 CTNS"), F.lit("kg")))["unit"] == "kg"
    assert one(spark, quantity.measured(F.lit("59525 LBS"), F.lit("kg")))["unit"] == "lbs"


@pytest.mark.parametrize("number,wrong,reason", [("CSQU3054383", False, "consistent"), ("csqu 305438-3", False, "consistent"), ("CSQU3054384", True, "check_digit"), ("CSQX3054383", False, "category"), ("CSQU30543", False, "length"), ("1SQU3054383", False, "letters"), ("CSQU30543A3", False, "digits")])
def test_check_digit(spark, number, wrong, reason):
    got = one(spark, checkdigit.check(F.lit(number)))
    assert (got["provably_wrong"], got["reason"]) == (wrong, reason)
    if reason in ("consistent", "check_digit"):
        assert got["expected"] == 3


def test_text(spark):
    assert one(spark, text.whitespace(F.lit(" a \n b "))) == "a b"
    assert one(spark, text.case(F.lit("STRAßE ΟΔΥΣΣΕΥΣ"))) == "strasse οδυσσευσ"
    assert one(spark, text.legal_form(F.lit("Shipping Co BV"))) == "Shipping Co"
    assert one(spark, text.legal_form(F.lit("BV"))) == "BV"
    assert one(spark, text.alphanumeric(F.lit("Πειραιάς 12-b"))) == "12b"
    assert one(spark, text.diacritics(F.lit("Éàü"))) == "Eau"
    assert one(spark, text.nfkc(F.lit("ﬁ"))) == "fi"
    assert one(spark, text.looks_like_confusion(F.lit("B0X"), F.lit("80X")))
    assert not one(spark, text.looks_like_confusion(F.lit("B0X"), F.lit("B0Y")))
    assert one(spark, text.slug(F.lit("a b/c@1"))) == "a-b-c@1"
    assert one(spark, text.ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75


def test_bounds(spark):
    assert stats.upper_bound(0, 394) == pytest.approx(1 - 0.05 ** (1 / 394))
    assert stats.upper_bound(7, 7) == stats.upper_bound(0, 0) == 1.0
    assert stats.upper_bound(1, 20) == pytest.approx(0.21610704, abs=1e-6)
    for k, n in ((1, 20), (3, 394), (12, 1000)):
        bound = stats.upper_bound(k, n)
        assert one(spark, stats.within_budget(F.lit(k), F.lit(n), F.lit(bound + 1e-9)))
        assert not one(spark, stats.within_budget(F.lit(k), F.lit(n), F.lit(bound - 1e-6)))
    assert one(spark, stats.clopper_pearson(F.lit(1).cast("double"), F.lit(20).cast("double"))) == pytest.approx(0.2161, abs=1e-4)


def test_boxes(spark):
    b = lambda *v: geometry.box(*[F.lit(float(x)) for x in v])
    assert one(spark, geometry.intersection_area(b(0, 0, 0.5, 0.5), b(0.25, 0.25, 0.5, 0.5))) == pytest.approx(0.0625)
    assert one(spark, geometry.intersection_area(b(0, 0, 0.5, 0.5), b(0.5, 0, 0.5, 0.5))) is None
    assert one(spark, geometry.iou(b(0, 0, 0.5, 0.5), b(0, 0, 0.5, 0.5))) == pytest.approx(1)
    assert one(spark, geometry.contains(b(0, 0, 1, 1), b(0.1, 0.1, 0.2, 0.2)))
    assert one(spark, geometry.padded(b(0, 0, 0.5, 0.5), 0.1))["width"] == pytest.approx(0.6)
    assert not one(spark, geometry.valid(b(0.9, 0, 0.5, 0.5)))
    assert tuple(one(spark, geometry.to_pixels(b(0.1, 0.1, 0.0001, 0.5), F.lit(100), F.lit(100)))) == (10, 10, 11, 60)
    assert one(spark, geometry.from_pixels(*[F.lit(x) for x in (10, 10, 60, 60, 100, 100)]))["width"] == 0.5


def test_j9_digest_of_many_ids(spark):
    """More ids than a leaf: the same digest in any order and partitioning, another for other ids; a small set's is that of its sorted ids."""
    import hashlib

    from ledgerline.operators.entities import digests

    many = spark.range(1000).selectExpr("1L AS root", "cast(id as string) AS id")
    few = spark.createDataFrame([(2, "b"), (2, "a"), (2, "a"), (3, "a")], "root long, id string")
    first = {r["root"]: r["digest"] for r in digests(many.unionByName(few), 16).collect()}
    again = {r["root"]: r["digest"] for r in digests(many.unionByName(many).orderBy("id").repartition(7), 16).collect()}
    assert first[1] == again[1] != digests(many.where("id <> '7'"), 16).first()["digest"]
    assert first[2] == hashlib.sha256(b"a\x1fb").hexdigest() and first[3] == hashlib.sha256(b"a").hexdigest()


def test_j10_best_weight_and_first_rule(spark):
    from ledgerline.operators.entities import match_score

    rows = spark.createDataFrame([("Kodak", "KODAK "), ("Kodak", "ko-dak"), ("Kodak BV", "kodak"), ("Kodak", "Agfa"), (None, "x"), ("-", ".")], "left_name string, right_name string")
    got = [(r["weight"], r["rule"]) for r in match_score(rows).collect()]
    assert got == [(1.0, "exact_after_case_and_whitespace"), (0.9, "same_after_dropping_separators"), (0.8, "same_ignoring_legal_form"), (0.0, None), (0.0, None), (0.0, None)]
    rules = (("one", ("case",), 0.5), ("two", ("whitespace", "case"), 0.5), ("three", ("case", "separators"), 0.9))
    assert match_score(rows.limit(1), rules).first()["rule"] == "three" and match_score(spark.createDataFrame([("a", "A")], rows.schema), rules[:2]).first()["rule"] == "one"


def test_upper_median_of_a_whole_table(spark):
    from ledgerline.operators.review import upper_medians

    for n in (0, 1, 2, 7, 1000):
        rows = spark.range(n).selectExpr("if(id % 5 = 4, null, (id * 37 % 101) / 10.0) AS v")
        values = sorted(r["v"] for r in rows.collect() if r["v"] is not None)
        assert [r["m"] for r in upper_medians(rows.repartition(5), [], "v", "m").collect()] == ([values[len(values) // 2]] if values else [])


def test_f10_texts_are_spelt_part_by_part(spark):
    """Parts are bounded by bytes and hold every row in order; nulls, repeats and texts longer than a part keep their places."""
    import pyarrow as pa

    from ledgerline.functions import text

    rows = [None, "É" * 50, "", "straße", None, "É" * 50, "x" * 9, "ß"] * 40
    parts = list(text._parts(pa.array(rows), 64))
    assert [x for p in parts for x in p.to_pylist()] == rows and all(len(p) == 1 or sum(len((x or "").encode()) for x in p.to_pylist()) <= 64 for p in parts) and len(parts) > 40
    assert [x for p in parts for x in text._spelt_part(p, ["case"]).to_pylist()] == [None if x is None else x.casefold() for x in rows]
    assert list(text._parts(pa.array([], pa.string()))) == [] and text._spelt_part(pa.array([None, None], pa.string()), ["case"]).to_pylist() == [None, None]
    table = spark.createDataFrame(list(enumerate(rows)), "id int, t string").coalesce(1)
    assert [r[0] for r in table.select("id", text.normalise(F.col("t"), ["case", "diacritics"]).alias("n")).orderBy("id").select("n").collect()] == [None if x is None else text.spelt(x, ["case", "diacritics"]) for x in rows]
