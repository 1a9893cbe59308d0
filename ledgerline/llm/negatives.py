"""Hard-negative mining with k-means inverted lists that store their radii.

Components are quantised to floor(`SCALE` x), and a score is the integer inner product of two rows. An anchor's positives are its `k` best other rows of its
label; for each positive of score p the hard negatives are the `k` best rows of another label with a score from `low` hundredths of p up to p.

Index. Every row lies in the list of its nearest centroid; a long list is cut into blocks of at most about `BLOCK` bytes, and each block stores its own radius, the
largest distance of a row from the centroid. By Cauchy and Schwarz all scores of anchor a in a list with centroid c and radius r lie within a.c - |a| r and a.c + |a| r.

Search. Lists whose bounds lie outside an anchor's windows are skipped. The others are visited in order of falling upper bound, in two waves: the `first`
of them tell each anchor's k-th best score so far, and of the rest those are visited whose upper bound is not strictly below it, since a list of a
lower bound cannot hold one of the k best (an equal one may, with a smaller vec_id). A wave reads the index once for a round of anchors of at most `ROUND` bytes, which go to
all tasks; a task takes its blocks one after another and returns k rows an anchor and window.

Centroids are fitted (Lloyd's iterations) on at most about `sample` rows, those with the lowest hash, and are at most `LISTS`; every row is indexed, and the result is
exact whatever the centroids are.

Rows: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths do not meet; empty ones
meet with score 0. Rows with the anchor's own vec_id are not its positives; other repeated rows count each, and an anchor of several rows asks with each. Ties go to
the smaller vec_id. Scores of any size are exact; those that a long cannot hold are held at its ends. Without positives an anchor has no row, and without a
row within the window a positive has none. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.shared import Scratch

SCALE = 256
#: Bytes of components in a block of the index, and of anchors that go to all tasks at once.
BLOCK, ROUND = 1 << 20, 8 << 20
#: Lists at most, and lists of the first wave.
LISTS, FIRST = 1024, 4
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_EXACT = float(1 << 53)


def whole_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim and x (as doubles) of the rows that take part."""
    good = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    some = vectors.where("vec_id is not null and label is not null and embedding is not null")
    rows = some.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    return rows.where(F.coalesce(good, F.lit(False))).select("vec_id", "label", F.size("x").alias("dim"), "x")


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x) as doubles; beyond their range infinite, which any bound lets pass."""
    with np.errstate(over="ignore"):
        return np.floor(x * SCALE)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the quantised rows of a and b as longs: in doubles where those are exact, else in integers of any size."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    p, q = quantised(a), quantised(b)
    if float(np.abs(p).max()) * float(np.abs(q).max()) * a.shape[1] < _EXACT:
        return (p @ q.T).astype(np.int64)
    whole = lambda x: np.array([math.floor(e * SCALE) if abs(e) < 2.0**1000 else int(e) * SCALE for e in x.ravel().tolist()], dtype=object).reshape(x.shape)
    exact = whole(a) @ whole(b).T
    return np.array([min(max(s, LEAST), MOST) for s in exact.ravel().tolist()], dtype=np.int64).reshape(exact.shape)


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's iterations from evenly spaced rows of the sample; a list that loses its rows keeps its place."""
    sample = sample[np.isfinite(sample).all(axis=1)]
    lists = min(lists, len(sample))
    if not lists or not sample.shape[1]:
        return np.zeros((1, sample.shape[1]))
    at = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, at)
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=lists)
        at[n > 0] = sums[n > 0] / n[n > 0, None]
    return at


def nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        return np.concatenate([np.argmin((at * at).sum(axis=1) - 2 * (x[i : i + 1024] @ at.T), axis=1) for i in range(0, len(x), 1024)] or [np.zeros(0, np.int64)])


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), dim)


def _assign(shared):
    """Rows -> rows with the number of their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                if dim in shared.value:
                    own = dims == dim
                    out[own] = nearest(quantised(_matrix(batch.filter(pa.array(own)).column("x"), dim)), shared.value[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "list"])

    return run


def _block(shared):
    """The rows of a block -> its row of the index, with its radius."""

    def run(rows: pa.Table) -> pa.Table:
        dim, number = rows["dim"][0].as_py(), rows["list"][0].as_py()
        rows = rows.sort_by("vec_id")
        x = _matrix(rows["x"], dim)
        with np.errstate(invalid="ignore", over="ignore"):
            away = quantised(x) - (shared.value[dim][number] if dim in shared.value else 0.0)
            radius = float(np.sqrt((away * away).sum(axis=1)).max(initial=0.0))
        binary = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
        return pa.table({"dim": pa.array([dim], pa.int32()), "list": pa.array([number], pa.int32()), "radius": [radius if math.isfinite(radius) else math.inf], "ids": binary(rows["vec_id"].to_numpy()), "labels": binary(rows["label"].to_numpy()), "x": binary(x)})

    return run


class Asked(NamedTuple):
    """Anchors of one length: ask numbers, ids, labels, vectors; of each window the least score still of use and the largest that counts."""

    ask: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    bar: np.ndarray
    top: np.ndarray


def bounds(x: np.ndarray, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of each row of x (quantised) with what lies within a radius of each centroid."""
    with np.errstate(invalid="ignore", over="ignore"):
        size, far = np.sqrt((x * x).sum(axis=1))[:, None], np.sqrt((at * at).sum(axis=1))[None]
        reach = size * radius + 1e-9 * size * (far + radius) + 1
        middle = x @ at.T
        low, high = middle - reach, middle + reach
    # Scores are held within a long, and so are their bounds.
    return np.where(np.isnan(low), LEAST, np.clip(low, LEAST, MOST)), np.where(np.isnan(high), MOST, np.clip(high, LEAST, MOST))


def visits(asked: Asked, at: np.ndarray, radius: np.ndarray, wave: int) -> np.ndarray:
    """Which lists each anchor visits in a wave: the FIRST by upper bound of those that its windows leave, or the others."""
    low, high = bounds(quantised(asked.x), at, radius)
    useful = (high >= asked.bar.min(axis=1).astype(float)[:, None]) & (low <= asked.top.max(axis=1).astype(float)[:, None])
    # The first wave's lists are those of its own bars, so the second wave must not judge them by better ones.
    place = np.argsort(np.argsort(-high, axis=1, kind="stable"), axis=1)
    return useful & ((place < FIRST) if wave == 0 else (place >= FIRST))


def best(found: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best entries above LEAST; columns are in order of id, so of ties the first stay."""
    if found.shape[1] > k:
        limit = np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k]
        row, column = np.nonzero((found >= limit[:, None]) & (found > LEAST))
    else:
        row, column = np.nonzero(found > LEAST)
    return _first(row, found[row, column], ids[column], k, row, column)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each group the entries with the k best scores, ties by id."""
    order = np.lexsort((ids, ~score, group))
    group = group[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(group)), bool), group[1:] != group[:-1])))
    place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    keep = order[place < k]
    return tuple(c[keep] for c in columns)


def _visit(shared, wave: int, same: bool, k: int):
    """Blocks of the index, one after another -> (ask, slot, vec_id, score) of each anchor's and window's k best here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_by, lists = shared.value
        chosen = {dim: visits(asked, *lists[dim], wave) for dim, asked in asked_by.items() if dim in lists}
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def shrink() -> list[tuple[np.ndarray, ...]]:
            if not held:
                return []
            ask, slot, ids, score = (np.concatenate([h[i] for h in held]) for i in range(4))
            return [_first(ask * 64 + slot, score, ids, k, ask, slot, ids, score)]

        for batch in batches:
            for dim, number, radius, ids, labels, x in zip(*(batch.column(c) for c in ("dim", "list", "radius", "ids", "labels", "x"))):
                dim, number = dim.as_py(), number.as_py()
                if dim not in chosen:
                    continue
                asked, at = asked_by[dim], lists[dim][0][number : number + 1]
                ids, labels = np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(labels.as_py(), "<i8")
                x = np.frombuffer(x.as_py(), "<f8").reshape(len(ids), dim)
                here = np.flatnonzero(chosen[dim][:, number])
                if len(here):  # the block's own radius may be smaller than its list's
                    low, high = bounds(quantised(asked.x[here]), at, np.array([radius.as_py()]))
                    here = here[(high[:, 0] >= asked.bar[here].min(axis=1).astype(float)) & (low[:, 0] <= asked.top[here].max(axis=1).astype(float))]
                step = max(1, (1 << 20) // max(len(ids), 1))
                for part in (here[i : i + step] for i in range(0, len(here), step)):
                    all_ = scores(asked.x[part], x)
                    alike = labels[None] == asked.labels[part][:, None]
                    fit = alike & (ids[None] != asked.ids[part][:, None]) if same else ~alike
                    for slot in range(asked.bar.shape[1]):
                        inside = fit & (all_ >= asked.bar[part, slot][:, None]) & (all_ <= asked.top[part, slot][:, None])
                        row, column = best(np.where(inside, np.maximum(all_, LEAST + 1), LEAST), ids, k)
                        held.append((asked.ask[part][row], np.full(len(row), slot, np.int64), ids[column], all_[row, column]))
                        size += len(row)
                if size > 1 << 20:
                    held = shrink()
                    size = sum(len(h[0]) for h in held)
        for ask, slot, ids, score in shrink():
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ask, slot.astype(np.int32), ids, score)], names=["ask", "slot", "vec_id", "score"])

    return run


FOUND = "ask long, slot int, vec_id long, score long"


class Lists:
    """The written index and its lists' centroids and radii."""

    def __init__(self, vectors: DataFrame, sample: int = 8192):
        self.spark = vectors.sparkSession
        self.scratch = Scratch(self.spark, "negatives")
        base = whole_rows(vectors)
        sizes = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count("*").alias("n")).collect()}
        share = min(1.0, sample / max(1, sum(sizes.values())))
        drawn = base.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 40)) < int(share * (1 << 40))).select("dim", "vec_id", "x").toArrow().sort_by([("dim", "ascending"), ("vec_id", "ascending")])
        at = {}
        for dim in np.unique(drawn["dim"].to_numpy()).tolist():
            own = drawn.filter(pa.array(drawn["dim"].to_numpy() == dim))
            rows = max(1, BLOCK // (8 * max(dim, 1)))
            at[dim] = centroids(quantised(_matrix(own["x"], dim)), min(LISTS, max(1, sizes[dim] // max(256, rows // 4)), max(1, own.num_rows // 8)))
        shared = self.spark.sparkContext.broadcast(at)
        kinds = "vec_id long, label long, dim int, x array<double>, list int"
        dealt = self.scratch.keep(base.mapInArrow(_assign(shared), kinds), "dealt")
        rows = F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / (8 * F.greatest(F.col("dim"), F.lit(1)))))
        # One row a list: few, as lists are at most LISTS (for each length of vectors).
        blocks = dealt.groupBy("dim", "list").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / rows)).drop("n")
        # Numbers of rows in written files split lists evenly, whatever repeats in them.
        numbered = dealt.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(blocks), ["dim", "list"])
        cut = numbered.withColumn("block", F.pmod(F.xxhash64("__row"), F.col("blocks"))).drop("__row", "blocks")
        self.index = self.scratch.keep(cut.groupBy("dim", "list", "block").applyInArrow(_block(shared), "dim int, list int, radius double, ids binary, labels binary, x binary"), "index")
        self.lists = {}
        radii = {(r["dim"], r["list"]): r["radius"] for r in self.index.groupBy("dim", "list").agg(F.max("radius").alias("radius")).collect()}
        for dim in sizes:
            own = at.get(dim, np.zeros((1, dim)))
            self.lists[dim] = own, np.array([radii.get((dim, i), 0.0) for i in range(len(own))])

    def search(self, asked: dict[int, Asked], same: bool, k: int, name: str) -> DataFrame:
        """ask, slot, rank, vec_id, score: the k best of each anchor and window."""
        waves = []
        for wave in range(2):
            shared = self.spark.sparkContext.broadcast((asked, self.lists))
            waves.append(self.scratch.keep(self.index.mapInArrow(_visit(shared, wave, same, k), FOUND), f"{name}-{wave}"))
            shared.unpersist()
            if wave == 0:  # a second wave has to beat the k-th best so far
                last = ranked(waves[0], k).where(F.col("rank") == k).toArrow()
                asked = {dim: raised(a, last) for dim, a in asked.items()}
        return ranked(waves[0].unionByName(waves[1]), k)


def raised(asked: Asked, last: pa.Table) -> Asked:
    """The anchors with their bars at the k-th best scores so far, which still count."""
    bar = asked.bar.copy()
    order = np.argsort(asked.ask)
    ask = last["ask"].to_numpy()
    at = np.minimum(np.searchsorted(asked.ask[order], ask), max(len(order) - 1, 0))
    own = asked.ask[order][at] == ask if len(order) else np.zeros(len(ask), bool)
    rows, slots, score = order[at[own]] if len(order) else at[own], last["slot"].to_numpy()[own], last["score"].to_numpy()[own]
    bar[rows, slots] = np.maximum(bar[rows, slots], score)
    return asked._replace(bar=bar)


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("ask", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, k: int = 5, low: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row of `anchors`, against all rows of `vectors` (vec_id, label, embedding both)."""
    lists = Lists(vectors)
    scratch = lists.scratch
    ask = scratch.keep(whole_rows(anchors).withColumn("ask", F.monotonically_increasing_id()), "ask")
    size = ask.agg(F.coalesce(F.sum(8 * F.col("dim") + 160), F.lit(0))).first()[0]
    rounds = max(1, -(-size // ROUND))
    out = []
    for number in range(rounds):
        part = ask.where(F.pmod(F.xxhash64("ask"), F.lit(rounds)) == number).toArrow()
        dims, asked = part["dim"].to_numpy(), {}
        for dim in np.unique(dims).tolist():
            own = part.filter(pa.array(dims == dim))
            n = own.num_rows
            asked[dim] = Asked(own["ask"].to_numpy(), own["vec_id"].to_numpy(), own["label"].to_numpy(), _matrix(own["x"], dim), np.full((n, 1), LEAST), np.full((n, 1), MOST))
        positives = scratch.keep(lists.search(asked, True, k, f"positives{number}").select("ask", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), f"best{number}")
        got = positives.toArrow()
        negatives = lists.search({dim: windows(a, got, k, low) for dim, a in asked.items()}, False, k, f"negatives{number}")
        met = negatives.withColumn("slot", F.col("slot") + 1).join(positives, ["ask", "slot"])
        out.append(met.join(ask.select("ask", F.col("vec_id").alias("anchor_id")), "ask").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def windows(asked: Asked, positives: pa.Table, k: int, low: int) -> Asked:
    """A window for each positive: from `low` hundredths of its score, rounded up, to the score. Slots without a positive are windows of nothing."""
    bar, top = np.full((len(asked.ask), k), MOST), np.full((len(asked.ask), k), LEAST)
    where = {a: i for i, a in enumerate(asked.ask.tolist())}
    for a, slot, p in zip(*(positives[c].to_pylist() for c in ("ask", "slot", "positive_score"))):
        if a in where:
            bar[where[a], slot - 1], top[where[a], slot - 1] = max(-(-low * p // 100), LEAST), p
    return asked._replace(bar=bar, top=top)
