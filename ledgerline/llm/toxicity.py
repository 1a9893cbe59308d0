"""Toxic passages by maximum-scoring segment search over token log-odds.

Tokens are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. A token's score is the log-odds of toxic against clean text
under Dirichlet priors, less a constant `drift` that makes ordinary text score below zero. The prior of a token is centred on the
log-odds of its first six bytes, that on those of its first four, and that on even odds, so unseen forms of a known stem count
as the stem does.

All maximal scoring segments of a text (Ruzzo and Tompa's linear scan, over the tokens with positive scores and the sums between them)
are held against the extreme-value law of the best segment of clean text: the expected number of segments of score s in n tokens of clean
text is E = K n exp(-lambda s). Segments with E < 1 are significant. A document's evidence is the sum of -ln E over them, or
-ln E of its best segment where none is; a logistic curve fitted on labelled documents turns it into a score within 0 and 1.

Training: at most about `sample` labelled documents of each class, those with the lowest hash of doc_id: seven tenths give
the log-odds, the others lambda, K and the curve. Only tokens that occur twice or more are kept. So the model that every
task gets is bounded by `sample`; everything else reads all rows.

Rows: null and empty texts have no tokens and get the score of no evidence. Labels: null labels do not count; of several for one
doc_id the largest does. Without labelled documents of both classes every score is 0. Repeated rows are scored alike. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import fold_of
from ledgerline.shared import small
from .words import U, pieces, prefix_hashes, words

STEMS = (6, 4)
_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Model(NamedTuple):
    """Sorted token hashes and their scores for whole tokens and for each stem length; then the calibration."""

    tables: tuple[tuple[np.ndarray, np.ndarray], ...]
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    bias: float = 0.0
    fitted: bool = False


def _tokens(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """first[d] and, for whole tokens and each stem length, their hashes."""
    w = words(column, lower=True, apart=_APART)
    return w.first, [w.hashes[0], *(prefix_hashes(w, n) for n in STEMS)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> per task: level, hash, hash of the next shorter stem, occurrences in clean and in toxic documents."""
    held: list[tuple[list[np.ndarray], np.ndarray]] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        toxic = np.concatenate([t for _, t in held]) if held else np.zeros(0, np.int64)
        for level in range(1 + len(STEMS) if len(toxic) else 0):
            h = np.concatenate([x[level] for x, _ in held])
            parent = np.concatenate([x[level + 1] for x, _ in held]) if level < len(STEMS) else np.zeros(len(h), U)
            order = np.argsort(h)
            h = h[order]
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            n, n1 = np.diff(np.append(edge, len(h))), np.add.reduceat(toxic[order], edge)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), level, np.int32)), pa.array(h[edge].view(np.int64)), pa.array(parent[order][edge].view(np.int64)), pa.array(n - n1), pa.array(n1)], names=["level", "h", "parent", "n0", "n1"])

    for batch in batches:
        for part in pieces(batch):
            first, hashes = _tokens(part.column("text"))
            held.append((hashes, np.repeat(part.column("toxic").to_numpy().astype(np.int64), np.diff(first))))
            size += len(hashes[0])
            if size > 1_000_000:
                yield from out()
                held, size = [], 0
    yield from out()


def _posterior(a, b, parent, prior, n0, n1):
    """Log-odds after a clean and b toxic occurrences, with `prior` pseudo-occurrences at the parent's odds."""
    p = 1 / (1 + np.exp(-np.asarray(parent)))
    s1 = n1 / (n0 + n1)
    return np.log((b + prior * p * s1) / n1) - np.log((a + prior * (1 - p) * (1 - s1)) / n0)


def token_scores(model: Model, hashes: list[np.ndarray]) -> np.ndarray:
    """Each token's log-odds: its own if known, else its longest known stem's, else zero."""
    score = np.zeros(len(hashes[0]))
    open_ = np.ones(len(score), dtype=bool)
    for (known, value), h in zip(model.tables, hashes):
        if not len(known):
            continue
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = open_ & (known[at] == h)
        score[hit] = value[at[hit]]
        open_ &= ~hit
    return score


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, from, to), left to right. Ruzzo and Tompa (1999)."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, from, to, the last entry before with a smaller left sum
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, start = total[i], total[i + 1], i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                found.append((left, right, start, i + 1, j))
                break
            left, start = found[j][0], found[j][2]
            del found[j:]
    return [(float(r - a), int(s), int(e)) for a, r, s, e, _ in found]


def passages(model: Model, scores: np.ndarray) -> tuple[float, list[tuple[float, int, int]]]:
    """A document's evidence and its significant segments."""
    found = segments(scores)
    base = model.log_k + math.log(max(len(scores), 1))
    good = [(model.rate * s - base, a, b) for s, a, b in found]
    strong = [x for x in good if x[0] > 0]
    return (sum(x[0] for x in strong) if strong else max([x[0] for x in good], default=-base)), strong


def _documents(model: Model, drift: float, column: pa.Array) -> Iterator[np.ndarray]:
    first, hashes = _tokens(column)
    scores = token_scores(model, hashes) - drift
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield scores[a:b]


def _best(model: Model, drift: float):
    """(text, toxic) -> tokens and best segment's score, for the calibration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = [(len(s), [x[0] for x in segments(s)]) for s in _documents(model, drift, part.column("text"))]
                yield pa.RecordBatch.from_pydict({"toxic": part.column("toxic"), "n": pa.array([n for n, _ in rows], pa.int64()), "found": pa.array([f for _, f in rows], pa.list_(pa.float64()))})

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of the logistic curve, with a slight ridge, by Newton's method; x is scaled."""
    spread = max(float(np.std(x)), 1e-9)
    z = np.stack([x / spread, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, prior: float = 10.0, drift: float = 1.0) -> Model:
    """Fit on `labels` (doc_id, toxic), which are all for training, and their texts in `docs`."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    if len(sizes) < 2:
        return Model(())
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    keep = F.when(F.col("toxic") == 1, part < sample / sizes[1]).otherwise(part < sample / sizes[0])
    picked = marked.where(F.col("toxic").isin(0, 1) & keep)
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(small(picked, min(2 * sample, sum(sizes.values())), 32), "doc_id")
    learn = F.pmod(F.hash("doc_id"), F.lit(10)) < 7
    counts = texts.where(learn).select("text", "toxic").mapInArrow(_count, "level int, h long, parent long, n0 long, n1 long").groupBy("level", "h").agg(F.max("parent").alias("parent"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rows = counts.where("n0 + n1 > 1").toPandas()
    whole = rows[rows["level"] == 0]
    n0, n1 = max(float(whole["n0"].sum()), 1.0), max(float(whole["n1"].sum()), 1.0)
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(len(STEMS), -1, -1):
        own = rows[rows["level"] == level]
        h = own["h"].to_numpy().view(U)
        order = np.argsort(h)
        above = token_scores(Model(tuple(tables[:1])), [own["parent"].to_numpy().view(U)[order]]) if tables else 0.0
        tables.insert(0, (h[order], _posterior(own["n0"].to_numpy()[order], own["n1"].to_numpy()[order], above, prior, n0, n1)))
    model = Model(tuple(tables))
    calls = texts.where(~learn).select("text", "toxic").mapInArrow(_best(model, drift), "toxic int, n long, found array<double>").toPandas()
    clean = calls[calls["toxic"] == 0]
    if not len(clean) or len(clean) == len(calls):
        return Model(())
    best = np.array([max(f, default=0.0) for f in clean["found"]])
    size = np.log(np.maximum(clean["n"].to_numpy(), 1))
    rate = math.pi / (math.sqrt(6) * max(float(np.std(best)), 0.05))
    model = model._replace(rate=rate, log_k=float(rate * best.mean() - np.euler_gamma - size.mean()), fitted=True)
    base = model.log_k + np.log(np.maximum(calls["n"].to_numpy(), 1))
    x = []
    for f, b in zip(calls["found"], base):
        e = [model.rate * s - b for s in f]
        x.append(sum(v for v in e if v > 0) if any(v > 0 for v in e) else max(e, default=-b))
    slope, bias = _logistic(_squash(np.array(x)), (calls["toxic"] == 1).to_numpy().astype(float))
    return model._replace(slope=slope, bias=bias)


def _squash(x: np.ndarray) -> np.ndarray:
    """Evidence on a scale that one very toxic document cannot rule: linear near zero, logarithmic far away."""
    return np.sign(x) * np.log1p(np.abs(x))


def score(docs: DataFrame, model: Model, drift: float = 1.0, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in `carry` with score and the significant passages (evidence, first token, token after the last)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys(carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in pieces(batch):
                if not model.fitted:
                    evidence, found = np.zeros(part.num_rows), [[] for _ in range(part.num_rows)]
                    value = np.zeros(part.num_rows)
                else:
                    both = [passages(model, s) for s in _documents(model, drift, part.column("text"))]
                    evidence, found = np.array([e for e, _ in both]), [f for _, f in both]
                    value = 1 / (1 + np.exp(-np.clip(model.slope * _squash(evidence) + model.bias, -30, 30)))
                spans = [[{"evidence": e, "start": a, "stop": b} for e, a, b in f] for f in found]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(value, pa.float64()), pa.array(spans, pa.list_(pa.struct([("evidence", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())])))], names=[*columns, "score", "passages"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*[F.col(c) for c in dict.fromkeys([*columns, "text"])]).mapInArrow(run, f"{out}, score double, passages array<struct<evidence: double, start: int, stop: int>>")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = 6000, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the labels outside the held-out fold, and score every row."""
    learn = labels.where(F.coalesce(fold_of(F.col("doc_id"), folds) != held, F.lit(False)))
    return score(docs, train(docs, learn, sample), carry=carry)
