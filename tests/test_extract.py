"""Captions and values on pages against plain versions."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.text import spelt
from ledgerline.operators import captions, extract

WORDS = "document string, page int, line int, word int, text string, left double, top double, width double, height double, confidence double"
RULES = ("unicode", "whitespace", "case", "diacritics", "separators")


def pages(rng, documents, vocabulary, lines=6, long=9):
    """Words of two pages a document: (rows, {(document, page): lines of rows})."""
    rows = []
    for d in range(documents):
        for page in (1, 2):
            for line in range(lines):
                for word in range(rng.randint(0, long)):
                    text = rng.choice(vocabulary)
                    rows.append((f"d{d}", page, line, word, text, 0.02 + 0.08 * word, 0.05 + 0.01 * line + rng.choice([0, 0.001]), 0.07, rng.choice([0.008, 0.01]), rng.choice([None, 0.5, 0.9])))
    return rows


def plain_anchor(lines, caption, least=0.72):
    """The best run of a page, run by run."""
    wanted, best = spelt(caption, captions.FOLD), None
    for line in lines:
        for start in range(len(line)):
            for n in range(1, min(len(caption.split()) + 1, len(line) - start) + 1):
                run = line[start : start + n]
                key = spelt(" ".join(w[4] for w in run), captions.FOLD)
                score = SequenceMatcher(None, wanted, key).ratio() if key else 0.0
                if score >= least and (best is None or score > best[0]):
                    best = (score, run)
    return best


def plain_below(words, left, top, height):
    base = top + height
    band = [w for w in words if base <= w[6] + w[8] / 2 <= base + 3.2 * height and left - 0.012 <= w[5] <= left + 0.34]
    if not band:
        return None
    first = min(band, key=lambda w: w[6])
    near = sorted((w for w in band if abs(w[6] - first[6]) <= 0.6 * max(height, first[8])), key=lambda w: w[5])
    return " ".join(w[4] for w in near), (min(w[9] for w in near) if all(w[9] is not None for w in near) else None)


def by_line(rows, document, page):
    own = [r for r in rows if r[:2] == (document, page)]
    return [[r for r in own if r[2] == line] for line in sorted({r[2] for r in own})]


def test_captions_by_language_and_values_below(spark):
    rng = random.Random(9)
    vocabulary = ["Gross", "weight", "We1ght", "GROSS-", "Poids", "brut", "prut", "Größe", "total", "Tota1", "a", "kg", "27.000", "-", "É", "cafe", "café"]
    rows = pages(rng, 12, vocabulary)
    wanted = {"en": {"weight": "Gross weight", "total": "Total", "one": "a"}, "fr": {"weight": "Poids brut", "total": "Total", "cafe": "Café - kg"}}
    languages = {f"d{d}": "en" if d % 3 else "fr" for d in range(12)}
    table = spark.createDataFrame([(lang, f, c) for lang, own in wanted.items() for f, c in own.items()], "language string, field string, caption string")
    docs = spark.createDataFrame(list(languages.items()), "document string, language string")
    w = spark.createDataFrame(rows, WORDS)
    found = extract.anchors(w, table, documents=docs)
    got = {(r["document"], r["page"], r["field"]): r for r in found.collect()}
    values = {(r["document"], r["page"], r["field"]): (r["value"], r["confidence"]) for r in extract.values_below(found, w).collect()}
    seen = 0
    for d, lang in languages.items():
        for page in (1, 2):
            for field, caption in wanted[lang].items():
                best = plain_anchor(by_line(rows, d, page), caption)
                key = (d, page, field)
                assert (key in got) == (best is not None)
                if best:
                    run, r = best[1], got[key]
                    assert abs(r["similarity"] - best[0]) < 1e-12 and r["line"] == run[0][2] and r["left"] == min(x[5] for x in run)
                    assert values.get(key) == plain_below([x for x in rows if x[:2] == (d, page)], r["left"], r["top"], r["height"])
                    seen += key in values
    assert seen > 20


@pytest.mark.parametrize("least", [0.5, 0.72, 0.95])
def test_no_similar_caption_is_missed(least, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    index = captions.Captions([(str(i), t, 1) for i, t in enumerate(texts[:200])], least)
    for key in texts[200:]:
        wanted = sorted((c[0], SequenceMatcher(None, c[1], key).ratio()) for c in index.captions if SequenceMatcher(None, c[1], key).ratio() >= least)
        assert sorted((index.captions[n][0], r) for n, r in index.similar(key)) == wanted


def test_dictionary_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    rows = pages(rng, 3, ["alpha", "beta", "gamma", "delta"])
    table = spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(["alpha", "beta gamma", "delta", "omega", "", None, "gamma"])], "field string, caption string")
    w = spark.createDataFrame(rows, WORDS)
    whole = sorted(map(tuple, captions.hits(w, table, 0.72).collect()))
    monkeypatch.setattr(captions, "PART", 6)
    assert len(list(captions.parts(table, []))) > 2
    assert whole and sorted(map(tuple, captions.hits(w, table, 0.72).collect())) == whole
    assert captions.hits(w.limit(0), table, 0.72).collect() == [] == captions.hits(w, table.limit(0), 0.72).collect()
    assert "NestedLoop" not in captions.hits(w, table, 0.72)._jdf.queryExecution().toString()


def test_values_are_located_across_lines(spark):
    rng = random.Random(8)
    rows = pages(rng, 10, ["A.", "a", "b", "É", "e", "-", "ab"])
    values = {(f"d{d}", f): v for d in range(10) for f, v in (("x", "a b"), ("y", "E-ab"), ("z", "abeab a"), ("none", "qq"), ("empty", " -"))}
    w = spark.createDataFrame(rows, WORDS)
    found = extract.locate(w, spark.createDataFrame([(d, f, v) for (d, f), v in values.items()], "document string, field string, value string"))
    got = {(r["document"], r["field"]): (r["page"], r["line"], r["left"], r["top"], round(r["width"], 9), round(r["height"], 9)) for r in found.collect()}
    for (d, f), v in values.items():
        target, best = spelt(v, RULES), None
        for page in (1, 2):
            words = [x for line in by_line(rows, d, page) for x in line]
            for i in range(len(words)):
                for n in range(1, min(12, len(words) - i) + 1):
                    run = words[i : i + n]
                    if best is None and target and spelt(" ".join(x[4] for x in run), RULES) == target:
                        left, top = min(x[5] for x in run), min(x[6] for x in run)
                        best = (page, run[0][2], left, top, round(max(x[5] + x[7] for x in run) - left, 9), round(max(x[6] + x[8] for x in run) - top, 9))
        assert got.get((d, f)) == best
    assert len(got) > 10


def test_f4_words_that_no_run_can_use_do_not_leave_the_scan(spark):
    """Values in a column of the words give the rows that a table of them gives, for words in any order, and few words go further."""
    rng = random.Random(3)
    rows = pages(rng, 8, ["A.", "a", "b", "É", "e", "-", "ab", None, *"cdfghijklmnopqrstuvw"], lines=12, long=14)
    rng.shuffle(rows)
    values = [(f"d{d}", f, v) for d in range(8) for f, v in (("x", "a b"), ("y", "E"), ("z", "c d"), ("empty", "-"), ("null", None))]
    table = spark.createDataFrame(values, "document string, field string, value string")
    wanted = table.select("document", "field", extract.key(F.col("value")).alias("key")).groupBy("document").agg(F.collect_list(F.struct("field", "key")).alias("own"))
    w = spark.createDataFrame(rows, WORDS).repartition(3)
    got = sorted(map(tuple, extract.locate(w.join(wanted, "document"), "own").collect()), key=str)
    assert len(got) > 10 and got == sorted(map(tuple, extract.locate(w, table).collect()), key=str)
    long = spark.range(20_000).selectExpr("'d' AS document", "1 AS page", "0 AS line", "int(id) AS word", "concat('w', id) AS text", "0.1 AS left", "0.1 AS top", "0.1 AS width", "0.1 AS height", "array(struct('f' AS field, 'w77w78' AS key)) AS own")
    assert extract.near(long, "own").count() < 200 and extract.locate(long, "own").count() == 1


def test_a_line_of_many_words(spark):
    """One line of 100,000 words: a place at its end is found, and nothing holds the line as one row."""
    w = spark.range(100_000).selectExpr("'d' AS document", "1 AS page", "0 AS line", "int(id) AS word", "if(id = 99990, 'needle', concat('w', id % 7)) AS text", "id * 1e-5 AS left", "0.1 AS top", "0.00001 AS width", "0.01 AS height", "0.9 AS confidence")
    row = extract.locate(w, spark.createDataFrame([("d", "f", "Needle w3")], "document string, field string, value string")).first()
    assert abs(row["left"] - 0.9999) < 1e-9
    found = extract.anchors(w, spark.createDataFrame([("f", "needle")], "field string, caption string")).first()
    assert abs(found["left"] - 0.9999) < 1e-9 and found["similarity"] == 1.0


def test_a7_proposals_get_a_place(spark):
    w = spark.createDataFrame([("d", 1, 0, i, t, 0.1 * i, 0.1, 0.1, 0.01, 0.9) for i, t in enumerate(["Total", "12.50", "EUR"])], WORDS)
    made = spark.createDataFrame([("d", "total", "1250 eur", None), ("d", "name", "Nobody", None), ("e", None, None, "truncated")], "document string, field string, value string, refused string")
    got = {r["field"]: (r["page"], r["left"]) for r in extract.place_proposals(made, w).collect()}
    assert got == {"total": (1, 0.1), "name": (None, None), None: (None, None)}


def test_runs_are_looked_up_together_and_once(spark, data):
    """a batch's runs meet the captions in one product, as each run alone does; the query's later steps do not look them up again."""
    from ledgerline import plans

    index = captions.Captions([("a", "invoiceno", 2), ("b", "grossweight", 2), ("c", "x" * 70 + "y", 1), ("d", "müller", 1)], 0.72)
    keys = ["invoiceno", "lnvoicen0", "grosswe1ght", "x" * 69, "x" * 250, "müler", "weight", "\U0001f600" * 6, "z", "invoicenoinvoicenoinvoice"]
    plain = [sorted((n, r) for n, (_, text, _) in enumerate(index.captions) if (r := SequenceMatcher(None, text, key).ratio()) >= 0.72) for key in keys]
    assert list(map(sorted, index.similar_all(keys))) == plain == [sorted(index.similar(k)) for k in keys]
    assert plain[3] and not plain[-1]
    assert "MapInArrow" not in plans.QUERIES["anchor_extract"](spark, data)._jdf.queryExecution().toString()


def test_only_words_that_may_be_captions_leave_the_jvm(spark, data):
    """words without the captions' characters are not looked up, those beyond ASCII are; a table is read from words and captions that are made once."""
    from ledgerline import plans

    texts = ["P123", "1250.00", "Item", "ıtem", "Ktem", "ITEM", "i", "t-e m", "Ite", "see", "Größe"]
    w = spark.createDataFrame([(1, 1, n, 0, t, 0.1, 0.1 * n, 0.1, 0.01) for n, t in enumerate(texts)], "document long, page int, line int, word int, text string, left double, top double, width double, height double")
    table = spark.createDataFrame([("item", "Item"), ("size", "Größe")], "field string, caption string")
    found = sorted((r["line"], r["field"]) for r in captions.hits(w, table, 0.72).collect())
    assert found == sorted((n, f) for n, t in enumerate(texts) for f, c in (("item", "Item"), ("size", "Größe")) if SequenceMatcher(None, spelt(c, captions.FOLD), spelt(t, captions.FOLD)).ratio() >= 0.72)
    part = next(captions.parts(table.where("field = 'item'"), []))
    left = [r["text"] for r in w.where(captions._promising(["text"], part, 0.72)).collect()]
    assert not {"P123", "1250.00", "i"} & set(left) and {"Item", "ıtem", "ITEM", "t-e m", "Ite"} <= set(left)
    assert "MapInArrow" not in plans.QUERIES["table_rows"](spark, data)._jdf.queryExecution().toString()


def test_hulls_of_lines_gather_no_words(spark, data):
    """sums of fixed width, so nothing is sorted and a line is one row of the shuffle."""
    from ledgerline import plans

    plan = plans.QUERIES["line_hulls"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Sort" not in plan


def both(w, table, docs=None):
    """What anchors and values_below find, as pages.read gives it."""
    found = extract.anchors(w, table, documents=docs)
    return found.join(extract.values_below(found, w), ["document", "page", "field"], "left")


def test_f1_captions_and_values_are_read_page_by_page(spark, data, monkeypatch):
    """Rows are those of anchors and values_below, for words in any order and in batches that cut pages; the query joins no words with captions or values."""
    from ledgerline import plans
    from ledgerline.operators import pages as reader

    rng = random.Random(21)
    rows = [list(r) for r in pages(rng, 10, ["Gross", "weight", "We1ght", "GROSS-", "Poids", "brut", "Größe", "total", "Tota1", "a", "kg", "27.000", "-", "É", "café", None])]
    rows += [["d99", 1, 0, i, rng.choice(["total", "gross", "x" * 300, "weight", "y"]), 0.02 + 0.08 * (i % 12), 0.05 + 0.002 * (i // 12), 0.07, 0.002, None] for i in range(120)]
    rng.shuffle(rows)
    wanted = {"en": {"weight": "Gross weight", "total": "Total", "one": "a"}, "fr": {"weight": "Poids brut", "total": "Total", "cafe": "Café - kg"}, "de": {"total": "Total", "weight": "Gross weight", "one": "a"}}
    names = sorted({r[0] for r in rows})
    docs = spark.createDataFrame([(d, ["en", "fr", "de", None, "it"][i % 5]) for i, d in enumerate(names)], "document string, language string")
    table = spark.createDataFrame([(lang, f, c) for lang, own in wanted.items() for f, c in own.items()] + [("en", "total", "Sum total"), (None, "total", "Total")], "language string, field string, caption string")
    w = spark.createDataFrame(rows, WORDS).repartition(3)
    got = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    want = got(both(w, table, docs))
    assert len(want) > 30 and got(reader.read(w, table, documents=docs)) == want
    languages = dict(map(tuple, docs.collect()))
    sorted_words = spark.createDataFrame([(*r, languages[r[0]]) for r in sorted(rows, key=lambda r: r[:4])], WORDS + ", language string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        monkeypatch.setattr(reader, "TOGETHER", 50)
        ordered = reader.read(sorted_words, table, ordered=True)
        assert got(ordered) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Join" not in ordered._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    monkeypatch.setattr(captions, "PART", 60)
    assert len(list(captions.parts(table, ["language"]))) > 1 and got(reader.read(sorted_words, table, ordered=True)) == want
    assert reader.read(w, table.limit(0), documents=docs).collect() == []
    with pytest.raises(ValueError):
        reader.read(w, table)
    plan = plans.QUERIES["anchor_extract"](spark, data)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_f1_words_leave_few_runs_to_compare(monkeypatch):
    """Runs by the sums of their words are those that SequenceMatcher finds run by run, whatever is remembered, also with long words and captions."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    spell = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    for least, remembered, kept in ((0.5, 100_000, 32_000_000), (0.72, 30, 32_000_000), (0.72, 100_000, 3_000), (0.9, 100_000, 32_000_000)):
        monkeypatch.setattr(captions, "REMEMBERED", remembered)
        monkeypatch.setattr(captions, "KEPT", kept)
        texts = [" ".join(spell("abcé", 7) for _ in range(rng.randint(1, 3))) for _ in range(20)] + [spell("ab", 90) for _ in range(3)]
        index = captions.Captions([(str(i), spelt(t, captions.FOLD), len(t.split())) for i, t in enumerate(texts)], least)
        words = [rng.choice([spell("abcéZ-", 6), spell("ab", 80), rng.choice(texts).split()[0]]) for _ in range(160)] + ["a" * 5_000, "\0", ""]
        line = np.cumsum([rng.random() < 0.1 for _ in words])
        left = np.array([(line[i:] == line[i]).sum() for i in range(len(words))])
        look = captions.Lookup(index)
        for _ in range(2):
            got = sorted(zip(*(x.tolist() for x in look.runs(pa.array(words), left, 150))))
            runs = [(i, n, spelt(" ".join(words[i : i + n]), captions.FOLD)) for i in range(150) for n in range(1, min(index.most, left[i]) + 1)]
            assert got == sorted((i, n, c, r) for i, n, key in runs for c, (_, t, k) in enumerate(index.captions) if key and n <= k + 1 and (r := SequenceMatcher(None, t, key).ratio()) >= least)
