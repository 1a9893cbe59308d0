"""Nulls, empty tables, repeated rows, ties, long texts and clashing extra columns."""

import hashlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm.attribution import attribute, attribute_tokens
from ledgerline.operators.graph import connected
from ledgerline.llm.decontam import contained
from ledgerline.llm.langid import identify
from ledgerline.llm.licenses import TEXTS as LICENSES
from ledgerline.llm.licenses import scan
from ledgerline.llm.ngram_join import ngram_join
from ledgerline.llm.packing import Turns, encoder, pack
from ledgerline.llm.substrings import SubstringIndex, _keyed, dedup_substrings
from ledgerline.llm.template_text import extract, main_text, templates
from ledgerline.llm.topk import block_of, digits, possible, top_k
from ledgerline.llm.toxicity import segments, toxicity

#: Columns that clash with names the operators use themselves.
EXTRA = "n int, k1 string, spans string, score string, task string, place string, queue string"
SCHEMA = f"doc_id long, text string, lang string, source string, {EXTRA}"
LONG = " ".join(f"word{i}" for i in range(30_000))
TEXTS = [None, "", " \t\n", "one", "one two three", "café Ünïcode straße 日本 語 and more words", LONG, LONG + " tail", "aa bb cc dd ee ff gg", "AA BB cc dd ee ff gg", "\x00 odd \x1c control\x85 text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "web", *[1, *["x"] * 6]) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "one two three", None, None, *[None] * 7), (None, None, None, None, *[None] * 7)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sets_of(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_ngram_join_edges(docs, empty):
    assert ngram_join(empty).collect() == []
    rows = ngram_join(docs).collect()
    assert len(rows) == docs.count()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    for i, t in enumerate(TEXTS):
        assert found[i][0] == len(sets_of(t))
    assert found[7][1] == 6 and found[9][1] == 8 and found[0][1] == 0 and found[1][1] == 1


def test_ngram_join_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 60, int(rng.integers(3, 60)))]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 5))):
            own = list(base)
            for at in rng.integers(0, len(own), int(rng.integers(0, 3))).tolist():
                own[at] = f"x{rng.integers(0, 9)}"
            texts.append(" ".join(own))
    sets = [sets_of(t) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and up[i] != up[j]:
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    found = ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(up))


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_words_that_cancel_in_power_sums_differ(spark):
    """The Thue-Morse word and its complement, on which hashes by powers modulo 2**64 agree whatever the base."""
    one, two = thue_morse(2048)
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} {LONG[:400]}"), (4, f"{two} {LONG[:400]}")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join(docs.where("doc_id < 3")).collect()} == {1: 1, 2: 2}
    words = " ".join(f"w{i}" for i in range(34))
    pair = spark.createDataFrame([(1, f"{one} {words}"), (2, f"{two} {words}")], "doc_id long, text string")
    assert {r["n_removed"] for r in dedup_substrings(pair).collect()} == {0}
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert [r["doc_id"] for r in contained(docs.where("doc_id < 3"), items).collect()] == [1]
    runs = [" ".join(t) for t in (one, two)]  # the same among words
    assert {r["n_removed"] for r in dedup_substrings(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string"), window=1024).collect()} == {brute_dedup(runs, 1024)[0][1]}


def test_one_doc_id_on_near_texts_of_different_lengths(spark):
    """Rows that repeat a doc_id are one document: its links are those of all its rows."""
    a = [f"a{i}" for i in range(60)]
    b, c = [f"b{i}" for i in range(90)], [f"c{i}" for i in range(40)]
    rows = [(1, a), (1, a + ["x"]), (1, b), (2, b + ["y"]), (3, c), (4, c + ["z"]), (5, a[1:] + ["q"]), (6, [*c[:20], "m", *c[21:]])]
    found = ngram_join(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 1), (6, 6)}
    assert sorted(r["n_shingles"] for r in found if r["doc_id"] == 1) == [56, 57, 86]


def test_a_cluster_over_many_splits(spark, monkeypatch):
    """With tiny groups one cluster of near copies takes many splits and is still one component."""
    import ledgerline.llm.ngram_join as module

    monkeypatch.setattr(module, "GROUP", 300)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(60):
        own = list(base)
        own[int(rng.integers(0, 80))] = f"x{i}"
        texts.append(" ".join(own))
    texts += [" ".join(f"o{i}_{j}" for j in range(50)) for i in range(5)] + [" ".join([*base[:40], *[f"p{i}_{j}" for j in range(40)]]) for i in range(5)]
    sets = [sets_of(t) for t in texts]
    wanted = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and wanted[i] != wanted[j]:
                low, high = sorted((wanted[i], wanted[j]))
                wanted = [low if x == high else x for x in wanted]
    found = ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(wanted))


def test_components(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = connected(spark.createDataFrame(rows, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_dedup(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window", [4, 35])
def test_substrings_against_brute_force(spark, window):
    rng = np.random.default_rng(window)
    texts = [" ".join(map(str, rng.integers(0, 4 if window == 4 else 10_000, int(rng.integers(0, 200))))) for _ in range(30)]
    texts += [None, texts[0], texts[1][: len(texts[1]) // 2] + " " + texts[2], "a " * 80, LONG[:2000] + " z " + LONG[:2000]]
    found = dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window=window).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in found} == dict(enumerate(brute_dedup(texts, window)))


def test_substrings_edges(docs, empty):
    assert dedup_substrings(empty).collect() == []
    rows = dedup_substrings(docs, carry=("doc_id", "spans")).collect()
    assert len(rows) == docs.count() and rows[0].asDict().keys() == {"doc_id", "spans", "n_words", "n_removed", "kept_text"}
    assert {r["doc_id"]: r["n_removed"] for r in rows}[6] == 30_000


def test_substring_index_compacts(spark):
    index = SubstringIndex(spark, window=4, fan_in=2)
    every = [(i, f"{'a b c d e' if i in (0, 4) else f'v{i} w{i} x{i} y{i} z{i}'}") for i in range(5)]
    for row in every:
        index.append(spark.createDataFrame([row], "doc_id long, text string"))
    assert len(index.runs) <= 2
    assert {r["k1"] for r in index.candidates().collect()} == {0, 4}


def test_substring_index_outlives_its_session(spark, tmp_path):
    """Two sessions append, the second opens what the first wrote, meets its history, and compacts."""
    at = f"file://{tmp_path}/index"
    index = SubstringIndex.open(spark, at, window=4, fan_in=2)
    days = [[(1, "a b c d e"), (2, "v w x y z")], [(3, "q a b c d"), (4, "k l m n o")], [(5, "v w x y q"), (6, "r s t u")]]
    for day in days[:2]:
        index.append(spark.createDataFrame(day, "doc_id long, text string"))
    index.close()
    assert index.made == 2 and not any(spark.catalog.tableExists(x) for x in index.runs)
    again = SubstringIndex.open(spark.newSession(), at, window=4, fan_in=2)
    assert again.runs == index.runs
    again.append(spark.createDataFrame(days[2], "doc_id long, text string"))
    assert len(again.runs) == 1 and again.made == 4
    assert {r["k1"] for r in again.candidates().collect()} == {1, 2, 3, 5}
    every = [row for day in days for row in day]
    keyed = _keyed(spark.createDataFrame(every, "doc_id long, text string")).select("k1", "k2", "text")
    assert {r["k1"]: [(s["start"], s["n"]) for s in r["spans"]] for r in again.spans(keyed).collect()} == {1: [(0, 1)], 3: [(1, 1)], 2: [(0, 1)], 5: [(0, 1)]}
    again.close()
    with pytest.raises(ValueError):
        SubstringIndex.open(spark, at, window=5)


def test_dedup_leaves_no_tables(spark):
    before = {t.name for t in spark.catalog.listTables()}
    dedup_substrings(spark.createDataFrame([(1, LONG), (2, LONG)], "doc_id long, text string")).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_packing_edges(docs, empty):
    assert pack(empty).collect() == []
    rows = pack(docs).collect()
    tokens = Counter()
    for r in rows:
        tokens[r["sequence_id"]] += r["length"]
    size = sum(len(encoder().whole(r["text"] or "")) // 4 + 1 for r in docs.collect())
    assert sum(tokens.values()) == size
    assert all(n == 2048 for s, n in tokens.items() if s != max(tokens))


@pytest.mark.parametrize("weights", [[3, 1], [5, 5, 1], [1 << 20, 1], [2, 2, 2, 6, 1, 1, 3]])
def test_turns_follow_the_deficits(weights):
    """The closed form against serving the queues one turn at a time, earliest due first."""
    counts = [9, 7, 4, 12, 4, 4, 1][: len(weights)]
    queues = sorted(range(len(weights)), key=lambda q: (-weights[q], -counts[q], q))
    due = sorted((Fraction(2 * j + 1, 2 * weights[q]), queues.index(q), q, j) for q in queues for j in range(counts[q]))
    alike = Counter(zip(weights, counts))
    turns = Turns(*(np.array(x) for x in ([w for w, _ in alike], [c for _, c in alike], list(alike.values()))))
    rank = [sum((weights[p], counts[p]) == (weights[q], counts[q]) for p in range(q)) for q in range(len(weights))]
    found = turns.before(*(np.array(x) for x in ([weights[q] for *_, q, _ in due], [j for *_, j in due], [counts[q] for *_, q, _ in due], [rank[q] for *_, q, _ in due])))
    assert turns.total == len(due) and found.tolist() == list(range(len(due)))


@pytest.mark.parametrize("weights", [None, {"s3": 5.0, "s7": 1.0, "hot": 1.0}])
def test_every_source_keeps_its_proportion(spark, weights):
    """Some hundred sources, one with a third of all: at every edge of a sequence each is as near to its share as turns of 128 allow."""
    rng = np.random.default_rng(4)
    rows = [(i, f"s{i % 100}" if i % 3 else "hot", " ".join(["token"] * int(rng.integers(50, 400)))) for i in range(1500)] + [(9999, None, "end")]
    found = pack(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7), weights).collect()
    source = {i: x for i, x, _ in rows}
    sums = Counter()
    for r in found:
        sums[source[r["doc_id"]]] += r["length"]
    if weights is not None:
        sums = {k: v for k, v in sums.items() if k in weights}
        last = min(sum(sums.values()), *(int(v * 7 / weights[k]) for k, v in sums.items())) // 2048 // 2
    else:
        last = sum(sums.values()) // 2048 - 10
    place = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"], source[r["doc_id"]]) for r in found)
    assert all(a + n == b for (a, n, _), (b, _, _) in zip(place, place[1:]))
    share = {k: (weights[k] / 7 if weights else v / sum(sums.values())) for k, v in sums.items()}
    seen, done = Counter(), 0
    for at, n, name in place:
        seen[name] += n
        done = at + n
        if done % 2048 == 0 and done // 2048 <= last:
            assert all(abs(seen[k] - share[k] * done) <= 128 + share[k] * 64 * len(share) + 1e-3 * done for k in share), (done, seen)


def test_encoder_is_the_plain_encoding():
    for t in (*[t for t in TEXTS[1:6]], TEXTS[-1], "a  b   c \n d's it's I'll 12 3, 4. ", "<|endoftext|> x", " lead", "trail "):
        assert encoder().plain(t) == encoder().whole(t)


def test_added_tokens_have_their_own_id():
    """As `tokenizers` does by default."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  c", "<|endoftext| >", "  <|endoftext|>\n\n z", "plain"):
        assert np.frombuffer(encoder().encode(t), "<u4").tolist() == tool.encode(t, add_special_tokens=False).ids


def test_columns_of_texts_get_their_ids():
    """White space of all kinds on both sides of spaces, nulls, empty texts and added tokens, as `tokenizers` does by default."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    atoms = [*"   \n\t\r\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\u2019", "a", "the", "'s", "12", "é", "à", "漢", "😀", ".", "<|endoftext|>", "<|endof", "text|>"]
    rng = np.random.default_rng(7)
    texts = [None, "", " ", "<|endoftext|>", "text|>", *("".join(rng.choice(atoms, int(n))) for n in rng.integers(0, 30, 3000)), None, "a b <|endof"]
    for part in (texts, texts[:1], [x for x in texts if x and "<|endoftext|>" not in x]):
        ids, first = encoder().column(pa.array(["left out", *part], pa.string()).slice(1))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [tool.encode(t or "", add_special_tokens=False).ids for t in part]
        assert first[0] == 0 and first[-1] == len(ids)


def test_distinct_words_are_encoded_once(monkeypatch):
    """However many they are: more than a table of remembered words would hold, each met twice."""
    tool, given = encoder(), []

    class Counting:
        def __getattr__(self, name, plain=tool.encoding):
            return lambda text, *a, **b: given.append(len(text)) or getattr(plain, name)(text, *a, **b)

    words = " ".join(f"w{i}x" for i in range(120_000))
    want = tool.whole(f"{words} {words}")
    monkeypatch.setattr(tool, "encoding", Counting())
    assert tool.encode(f"{words} {words}") == want
    assert len(given) < 10 and sum(given) < 1.1 * len(words)


def test_attribution(docs, empty, spark):
    assert attribute(np.array([2, 3, 1]), np.array([0, 3, 6]), "most").tolist() == [1, 2]
    assert attribute(np.array([2, 2, 2]), np.array([0, 3, 6]), "most").tolist() == [2, 1]  # a tie goes to the earlier section
    assert attribute_tokens(empty).collect() == []
    rows = attribute_tokens(docs).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len(encoder().whole(r["text"] or "")) // 4 for r in docs.collect())
    given = spark.createDataFrame([(5, 1, 0, 4), (5, 2, 3, 10_000), (5, 3, None, 2), (None, 1, 0, 2)], "doc_id long, section long, start long, stop long")
    own = [r for r in attribute_tokens(docs, given).collect() if r["doc_id"] == 5]
    assert [r["section"] for r in sorted(own, key=lambda r: r["start"])][:2] == [1, 2] and sum(r["n_tokens"] for r in own) == own[0]["doc_tokens"]


def test_language_edges(docs, empty):
    assert identify(empty).collect() == []
    found = {r["doc_id"]: r for r in identify(docs, carry=("doc_id", "n")).collect() if r["doc_id"] is not None}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (0, 1, 2))
    assert {r["lang_pred"] for r in identify(docs.where("lang is null")).collect()} == {"und"}


def test_contained(docs, empty, spark):
    items = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20_000, 20_050))), (2, "one two three"), (3, None), (4, ""), (5, "cc dd ee ff gg"), (5, "cc dd ee ff gg"), (None, "absent words that no text has")], "item_id long, text string")
    assert contained(empty, items).collect() == [] and contained(docs, items.where("false")).collect() == []
    found = Counter((r["doc_id"], r["item_id"]) for r in contained(docs, items).collect())
    assert found == Counter({(6, 1): 1, (7, 1): 1, (4, 2): 2, (None, 2): 1, (8, 5): 2, (9, 5): 2})


def test_contained_at_the_threshold(spark):
    item = [f"i{x}" for x in range(44)]  # 40 shingles, 32 needed
    near, far = item[:36] + ["z"], item[:35] + ["z"]
    filler = [f"f{x}" for x in range(5000)]
    docs = spark.createDataFrame([(1, " ".join(filler + near + filler)), (2, " ".join(filler + far))], "doc_id long, text string")
    found = contained(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["n_item"], r["n_shared"]) for r in found] == [(1, 40, 32)]


def test_licenses(docs, empty, spark):
    assert scan(empty).collect() == [] and scan(docs).collect() == [] and scan(docs, []).collect() == []
    text = dict(LICENSES)["gpl-3.0"]
    rows = spark.createDataFrame([(1, LONG + " " + text.upper().replace(" ", " \n") + " " + LONG), (1, text), (2, text[: len(text) // 2]), (3, "It is released under the MIT License and more."), (4, "Released under the MIT License.")], "doc_id long, text string")
    found = Counter((r["doc_id"], r["license"]) for r in scan(rows).collect())
    assert found[1, "gpl-3.0"] == 2 and {d for d, _ in found} == {1, 3, 4}
    table = spark.createDataFrame([("own", "one two three four five six"), ("own", "one two three four five six"), (None, None)], "license string, text string")
    assert [r["license"] for r in scan(spark.createDataFrame([(9, "zero one two three four five six")], "doc_id long, text string"), table).collect()] == ["own"]


def test_license_recall_on_edited_texts(spark):
    """Full texts with some words replaced, dropped or added, in longer documents: all that contain 80 % are found, the best of a passage."""
    rng = np.random.default_rng(6)
    rows, wanted = [], set()
    sets = {text: sets_of(text.lower()) for _, text in LICENSES}
    for i in range(300):
        license, text = LICENSES[i % len(LICENSES)]
        own = [w for w in text.split() if rng.random() > 0.01]
        for at in rng.integers(0, len(own), int(rng.integers(0, 6))).tolist():
            own[at] = f"edit{at}"
        filler = [f"f{x}" for x in rng.integers(0, 500, int(rng.integers(0, 300)))]
        cut = int(rng.integers(0, len(filler) + 1))
        rows.append((i, " ".join(filler[:cut] + own + filler[cut:])))
        have = sets_of(rows[-1][1].lower())
        there = [(name, s, have & s) for (name, t), s in ((x, sets[x[1]]) for x in LICENSES) if 100 * len(have & s) >= 80 * len(s)]
        better = lambda u, t: (len(u[2]) * len(t[1]), len(u[2])) > (len(t[2]) * len(u[1]), len(t[2]))
        wanted |= {(i, t[0], len(t[1])) for t in there if not any(better(u, t) and (t[1] <= u[1] or 100 * len(t[2] - u[1]) < 80 * len(t[1] - u[1])) for u in there)}
    found = {(r["doc_id"], r["license"], r["n_template"]) for r in scan(spark.createDataFrame(rows, "doc_id long, text string"), LICENSES).collect()}
    assert len(wanted) > 170 and len(found & wanted) >= 0.995 * len(wanted) and len(found - wanted) <= 0.005 * len(wanted)


def test_segments_against_brute_force():
    """Ruzzo and Tompa's segments are those of the recursive definition."""

    def slow(x, at=0):
        best = max(((round(sum(x[i:j]), 9), i - j, i) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = best[2], best[2] - best[1]
        # Of equal sums the shortest, so that no segment starts or ends with a part that sums to zero.
        i, j = min(((a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if abs(sum(x[a:b]) - best[0]) < 1e-9), key=lambda p: (p[1] - p[0], p[0]))
        return slow(x[:i], at) + [(at + i, at + j)] + slow(x[j:], at + j)

    rng = np.random.default_rng(1)
    for _ in range(60):
        x = rng.normal(size=int(rng.integers(0, 14)))
        assert [(a, b) for _, a, b in segments(x)] == slow(x.tolist())


def test_toxicity_edges(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(empty, none).collect() == []
    assert {r["score"] for r in toxicity(docs, none).collect()} == {0.0}
    some = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity(docs, some).collect())


def test_top_k_edges(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(30)]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, []), (None, [1.0] * 8), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(a, b, "x") for a, b in vectors + odd], "vec_id long, embedding array<float>, block string")
    q = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in vectors}
    found = top_k(df, df.where("vec_id % 20 = 0"), k=5, rows=64).collect()
    for query in (i for i in q if i % 20 == 0):
        wanted = sorted(((-int(q[query] @ v), i) for i, v in q.items() if i != query))[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == query) == [(n + 1, i, -s) for n, (s, i) in enumerate(wanted)]
    assert top_k(df.where("false"), df.where("false")).collect() == []


def brute_top(rows, queries, k):
    """Plain Python: (query, rank, vec_id, score) of every query row."""
    from fractions import Fraction
    from math import floor

    v = [(i, [floor(64 * Fraction(e)) for e in x]) for i, x in rows]
    hold = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = []
    for i, x in ((i, x) for i, x in v if i in queries):
        wanted = sorted((-hold(sum(a * b for a, b in zip(x, y))), j) for j, y in v if j != i and len(y) == len(x))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(wanted)]
    return sorted(out)


def test_top_k_with_large_components_and_repeated_rows(spark, monkeypatch):
    import ledgerline.llm.topk as module

    monkeypatch.setattr(module, "ROUND", 400)
    rng = np.random.default_rng(8)
    rows = [(0, [1.0, 1.0]), (1, [2e6, 0.0]), (2, [1.0, 0.0]), (3, [1e7, -1e7]), (4, [1e200, 1e-5]), (5, [-1e308, 1.7e308]), (6, []), (7, []), (8, [-0.01, 0.01]), (8, [-0.01, 0.01])]
    rows += [(20, [3.0, -1.0]), (20, [0.5, 9.0]), (40, [4e6, 3.0])] + [(50 + i, rng.normal(size=2).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = {0, 4, 6, 20, 40, 55}
    found = top_k(df, df.where(F.col("vec_id").isin(*asked)), k=4, rows=7).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == brute_top(rows, asked, 4)


def test_few_segments_prove_the_rest_out():
    """On skewed components the bounds stop long before all segments are added, and never lose a member."""
    rng = np.random.default_rng(2)
    v = np.rint(rng.standard_t(3, size=(16, 5000)) * 20).astype(np.int64)
    block = block_of(np.arange(5000), digits(v))
    for i in range(20):
        q = v[:, i]
        here = possible(block, q, np.array([i]), 5, -np.inf)
        scores = q @ v
        scores[i] = -(1 << 40)
        assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(here.tolist()) and len(here) <= 5000 // 64


def test_html_edges(spark):
    assert main_text(None) == "" and main_text("") == "" and main_text("plain &amp; simple") == "plain & simple"
    assert main_text("<nav>menu</nav><article><h1>T</h1><p>a <b>b</b>\n c<p>d<script>x</script></article><footer>f</footer>") == "T a b c d"
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://a/b", "", "x"), (2, "http://a/b", "<p>hi</p>", "x"), (None, "", "<p>" + "w " * 50_000, "x")], "page_id long, url string, html string, host string")
    assert sorted(r["n_chars"] for r in extract(pages).collect()) == [0, 0, 2, 99_999]
    assert extract(pages.where("false")).collect() == []
    named = pages.withColumns({"main": F.lit("m"), "layout": F.lit(1), "kept": F.lit("k")})
    assert {(r["main"], r["layout"], r["kept"], r["host"]) for r in extract(named, carry=("page_id", "main", "layout", "kept", "host")).collect()} == {("m", 1, "k", "x")}


def test_html_of_great_depth(spark):
    """Memory and time in proportion to the length, however deep the markup and however many end tags match nothing."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    deep = "<div>" * 100_000 + "inner words" + "</section>" * 50_000 + "</div>" * 100_000
    assert main_text(deep) == "inner words"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
    pages = spark.createDataFrame([(i, "http://deep.example/", deep.replace("inner", f"inner{i}")) for i in range(2)], "page_id long, url string, html string")
    assert {r["text"] for r in extract(pages).collect()} == {"inner0 words", "inner1 words"}


def test_template_separates_repeated_text(spark):
    """Text that every page of a host repeats is template, although no markup says so."""
    body = "<div id=x><div>Our weekly offers for all</div><div><div class=t>{0} unique words of page {0} and some more of them</div></div></div>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", body.format(f"p{i}")) for i in range(12)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract(pages).collect()} == {i: f"p{i} unique words of page p{i} and some more of them" for i in range(12)}


def test_template_of_a_host_with_odd_pages(spark):
    """An error page, a page without the menu, and pages that share a paragraph leave the host's template as it is."""
    menu, foot = "<div><ul><li>Home page<li>All our products<li>Contact us</ul></div>", "<div>Imprint and terms of this site</div>"
    article = lambda i: f"<div><h1>Title {i}</h1><p>First words of article {i}.<p>A paragraph that all of them share.<p>Last words of {i * i}.</div>"
    rows = [(i, "http://odd.example/", f"<html><body>{menu}{article(i)}{foot}</body></html>") for i in range(12)]
    rows.append((12, "http://odd.example/", "<html><body><h1>Not found</h1></body></html>"))
    rows.append((13, "http://odd.example/", f"<html><body>{article(13)}{foot}</body></html>"))
    found = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda i: f"Title {i} First words of article {i}. A paragraph that all of them share. Last words of {i * i}."
    assert {i: found[i] for i in range(12)} == {i: text(i) for i in range(12)}
    assert found[12] == "Not found" and found[13].startswith(text(13))


def test_classes_nest(spark):
    """The template's tokens: equal vectors are one class, and each stands below its parent."""
    rows = [(i, "http://n.example/", f"<body><ul><li>one<li>two</ul><main><p>text {i}</main>") for i in range(4)]
    found = templates(spark.createDataFrame(rows, "page_id long, url string, html string")).where("layout is not null").collect()
    elements = {r["token"]: r for r in found if r["kind"] == 0}
    assert len(elements) == 6 and all(r["parent"] in elements or r["depth"] == 0 for r in elements.values())
    assert len({r["vector"] for r in elements.values()}) == 2  # once a page, and the two items
    assert len([r for r in found if r["kind"] == 1]) == 2 and {r["vector"] for r in found if r["kind"] == 1} < {r["vector"] for r in elements.values()}


def test_kept_sha_of_nothing(spark):
    row = dedup_substrings(spark.createDataFrame([(1, None)], "doc_id long, text string")).select(F.sha2("kept_text", 256)).first()[0]
    assert row == hashlib.sha256(b"").hexdigest()


def test_language_thresholds_and_prototypes_come_from_all_rows(spark):
    """F2: of 3,200 labelled texts none is left out, and the least scores are exact order statistics."""
    import numpy as np

    from ledgerline.llm import langid

    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("abcdefgh" if i % 2 else "mnopqrst"), 9)), "xy"[i % 2]) for i in range(3200)]
    langs, prototypes = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    vectors, _ = langid.profiles([t for _, t, _ in rows])
    fixed = np.rint(vectors.astype(np.float64) * (1 << 24)).astype(np.int64)
    table = np.stack([fixed[[r[2] == lang for r in rows]].sum(axis=0) for lang in langs]).astype(np.float64)
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    table -= table.mean(axis=0)
    assert langs == ["x", "y"] and np.array_equal(prototypes, (table / np.linalg.norm(table, axis=1, keepdims=True)).astype(np.float32))
    scores = [(c, float((1 + np.float64(np.float32(x))) / 2)) for c, n in ((0, 99), (1, 100), (3, 5000), (4, 2500)) for x in rng.normal(0.3, 0.1, n).clip(-1, 1)] + [(5, 0.75)] * 300
    cuts = langid.least_scores(spark.createDataFrame(scores, "length_class int, score double"))
    last = 0.0
    for c in range(32):
        own = [x for k, x in scores if k == c]
        last = 0.5 + (np.percentile(own, 0.1) - 0.5) / 2 if len(own) >= 100 else last
        assert cuts[c] == pytest.approx(last, abs=1e-12)
    assert set(langid.least_scores(spark.createDataFrame([], "length_class int, score double")).values()) == {0.0}
