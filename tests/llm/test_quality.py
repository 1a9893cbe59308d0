"""The quality classifier's features, updates and scores against plain versions, and its held-out accuracy."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa

TEXTS = ["The cat sat. THE CAT!! sat### sat### 12,5 a|b", "", None, "é è é é", "x", " \t\n", "Word " * 300, "A1b2 c--d É9!"]


def plain_ngrams(text):
    """Every n-gram of words and of forms of a text, with its count."""
    words = [w.decode("utf-8", "surrogateescape") for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    shape = []
    for i, w in enumerate(words):
        letters = [chr(b) for b in w.encode("utf-8", "surrogateescape")]
        kinds = ["" if ord(c) >= 128 else "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in letters]
        form = "".join(k for j, k in enumerate(kinds) if j == 0 or kinds[j - 1] != k)
        shape.append((form, i > 0 and low[i] == low[i - 1]))
    out = {}
    for source, sizes in ((low, (1, 2)), (shape, (1, 2, 3))):
        for n in sizes:
            for i in range(len(source) - n + 1):
                key = (source is low, tuple(source[i : i + n]))
                out[key] = out.get(key, 0) + 1
    return out


def test_features_count_every_ngram_once():
    from ledgerline.llm.quality import features

    of, bucket, value = features(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        counts = plain_ngrams(text)
        size = math.sqrt(sum(counts.values()))
        assert np.allclose(sorted(value[of == i]), sorted(math.sqrt(c) / size for c in counts.values()), atol=1e-6), text
        alone = features(pa.array([text], pa.string()))
        assert np.array_equal(alone[1], bucket[of == i])


def test_updates_are_the_textbooks():
    """Scalar follow-the-regularised-leader, coordinate by coordinate."""
    from ledgerline.llm.quality import ALPHA, BETA, L1, L2, follow, weights_of

    rng = np.random.default_rng(2)
    examples = [(np.sort(rng.choice(30, 5, replace=False)), rng.random(5), float(rng.integers(0, 2)), float(rng.random() + 0.5)) for _ in range(200)]
    z, n = np.zeros(31), np.zeros(31)
    follow(z, n, iter(examples))
    zz, nn = [0.0] * 31, [0.0] * 31
    weight = lambda i: 0.0 if abs(zz[i]) <= L1 else -(zz[i] - math.copysign(L1, zz[i])) / ((BETA + math.sqrt(nn[i])) / ALPHA + L2)
    for at, x, y, c in examples:
        pairs = [*zip(at.tolist(), x.tolist()), (30, 1.0)]
        w = {i: weight(i) for i, _ in pairs}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
        for i, v in pairs:
            g = c * (p - y) * v
            zz[i] += g - (math.sqrt(nn[i] + g * g) - math.sqrt(nn[i])) / ALPHA * w[i]
            nn[i] += g * g
    assert np.allclose(z, zz) and np.allclose(n, nn) and np.allclose(weights_of(z, n), [weight(i) for i in range(31)])


def test_scores_are_dot_products(spark):
    from ledgerline.llm.quality import BITS, features, score

    weights = np.random.default_rng(4).normal(size=(1 << BITS) + 1)
    rows = [(i, t, "list") for i, t in enumerate(TEXTS)] + [(None, "again again", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = score(docs.repartition(5), weights, carry=("doc_id", "text")).collect()
    assert len(found) == len(rows)
    for r in found:
        _, bucket, value = features(pa.array([r["text"]], pa.string()))
        total = float(np.float32(weights[-1])) + sum(float(v) * float(np.float32(weights[b])) for b, v in zip(bucket, value))
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-6


def test_without_labels_and_rows(spark):
    from ledgerline.llm.quality import quality

    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality(docs, none).collect()] == [0.5] * 3
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    assert [r["score"] for r in quality(docs, odd).collect()] == [0.5] * 3
    assert quality(docs.limit(0), none).collect() == []


def test_held_out_accuracy(spark):
    from ledgerline.llm import queries

    data = "/root/testdata/sf0.01"
    found = queries.op12_quality(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    judged = [(r["score"], r["quality"]) for r in found if r["held_out"] and r["quality"] is not None]
    pairs = [(a > b) + (a == b) / 2 for a, t in judged for b, u in judged if t == 1 and u == 0]
    assert sum(pairs) / len(pairs) >= 0.97 and sum((a >= 0.5) == (t == 1) for a, t in judged) >= 0.9 * len(judged)
