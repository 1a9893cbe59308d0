"""Exact top-k inner products by an impact-ordered score-at-a-time index.

Components are quantised to integers v = floor(64 x), and each v is written in digits of falling weight: v = 8 a + 2 b + c (a signed,
b in 0..3, c in 0..1). The postings of one dimension and one weight, the digits of all vectors of a block, are a segment. For a query
component q a segment's impact is |q| x weight x half the range of its digits: the most by which it can move a score from the middle.

A query adds segments to its scores in order of falling impact, its own order for each query. What the segments that are left can still do
is the sum of their impacts, which bounds every score from both sides. Vectors whose upper bound is below the k-th best lower bound, or below the
k-th best score of the blocks before, are proven out. Processing stops when few enough vectors are not proven out; those are scored exactly
from their digits, so the result is exact whatever the data.

Distribution: vectors are dealt once into blocks of at most about `rows` by a hash of vec_id and components, and a block never moves again.
Queries go to all tasks in rounds of at most `ROUND` bytes; each task takes its blocks one after another, keeps the k best of every query
and emits them once at the end. So what is shuffled is k rows a query and task, whatever the number of blocks of queries.

Rows: vectors that are null or hold a null or non-finite component take no part, nor do null vec_ids. Vectors with a component of
2**14 or more have blocks of their own, in which all pairs are scored in integers without a bound on their size; scores that a
long cannot hold are held at its ends and rank there by vec_id. Vectors of different lengths do not meet; empty ones meet with score 0. Rows with
the query's own vec_id are no candidates; other repeated rows are candidates each. A query id with several rows asks
with each. Ties go to the smaller vec_id. Fewer candidates than k give fewer rows; an empty table gives an empty result.
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

#: Weights of the digits, by falling impact.
WEIGHTS = (8, 2, 1)
#: Bytes of query components that go to all tasks at once.
ROUND = 8 << 20
#: Components (before quantisation) from which on vectors are scored without segments.
WIDE = float(1 << 14)
SCALE = 64


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, wide, x (as doubles) of the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), x.alias("x"))
    return rows.where(F.coalesce(whole, F.lit(False))).select("vec_id", F.size("x").alias("dim"), F.exists("x", lambda e: F.abs(e) >= WIDE).alias("wide"), "x")


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(64 x) without rounding or overflow, as integers of any size."""
    one = lambda e: math.floor(e * SCALE) if abs(e) < 2.0**1000 else int(e) * SCALE
    return np.array([one(e) for e in x.ravel().tolist()], dtype=object).reshape(x.shape)


def digits(v: np.ndarray) -> list[np.ndarray]:
    """The digits a, b, c of v = 8 a + 2 b + c."""
    return [v >> 3, (v >> 1) & 3, v & 1]


def _narrow(x: np.ndarray) -> bytes:
    """Numbers below 2**31 with a leading byte that tells their width."""
    kind = next(t for t in ("i1", "i2", "i4") if np.array_equal(x.astype(t), x))
    return kind[1].encode() + x.astype("<" + kind).tobytes()


def _components(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(rows, -1)


def _index(table: pa.Table) -> pa.Table:
    """One block of vectors -> its row of the index: ids, and its segments by weight and dimension (or the components of wide vectors)."""
    ids, x = table["vec_id"].to_numpy(), _components(table["x"], table.num_rows)
    wide = table["wide"][0].as_py()
    planes = [x.astype("<f8").tobytes()] if wide else [_narrow(np.ascontiguousarray(p.T)) for p in digits(np.floor(SCALE * x).astype(np.int64))]
    return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "wide": pa.array([wide]), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "segments": pa.array([planes], pa.list_(pa.binary()))})


class Block(NamedTuple):
    """Segments as rows of numbers, each with the middle and half the range of its digits; v has a column for each vector."""

    ids: np.ndarray
    v: np.ndarray
    segments: np.ndarray
    middle: np.ndarray
    reach: np.ndarray


def block_of(ids: np.ndarray, planes: list[np.ndarray]) -> Block:
    """A block from its digits (dimensions x vectors) by falling weight."""
    v = sum(w * p.astype(np.int64) for w, p in zip(WEIGHTS, planes))
    # Partial scores are whole numbers, exact in single precision below 2**24.
    most = float(np.abs(v).max(initial=0))
    kind = np.float32 if most * most * max(len(v), 1) < 1 << 22 else np.float64
    segments = np.concatenate(planes).astype(kind)
    low, high = segments.min(axis=1, initial=np.inf), segments.max(axis=1, initial=-np.inf)
    return Block(ids, v, segments, (low.astype(float) + high) / 2, (high.astype(float) - low) / 2)


def possible(block: Block, q: np.ndarray, own: np.ndarray, k: int, bar: float) -> np.ndarray:
    """The places in the block that are not proven to be outside the query's k best (less `own`), given the k-th best score `bar` so far."""
    n = len(block.ids)
    coefficients = np.concatenate([w * q for w in WEIGHTS]).astype(float)
    impact = np.abs(coefficients) * block.reach
    order = np.argsort(-impact, kind="stable")
    left = np.append(np.cumsum(impact[order][::-1])[::-1], 0.0)
    middle = np.append(np.cumsum((coefficients * block.middle)[order][::-1])[::-1], 0.0)
    exact_kind = block.segments.dtype if np.abs(coefficients).sum() * float(np.abs(block.v).max(initial=0)) < 1 << 22 else np.float64
    scores = np.zeros(n, dtype=exact_kind)
    scores[own] = -np.inf
    done, few = 0, max(4 * k, n // 64)
    # Bounds are looked at whenever what is left has halved, from a quarter on.
    level = left[0] / 4
    while True:
        to = int(np.searchsorted(-left, -level)) if level > 0.5 else len(order)
        to = max(min(to, len(order)), done)
        step = order[done:to]
        if len(step):
            scores += coefficients[step].astype(exact_kind) @ block.segments[step].astype(exact_kind, copy=False)
            done = to
        slack = left[done] + 1e-6 * (abs(middle[done]) + left[0]) + 0.5 * (done < len(order))
        low = bar
        if n > k:
            low = max(low, float(np.partition(scores, n - k)[n - k]) + middle[done] - slack)
        open_ = np.flatnonzero(scores >= low - middle[done] - slack) if low > -np.inf else np.arange(n)
        if len(open_) <= few or done == len(order):
            return np.setdiff1d(open_, own, assume_unique=True)
        level /= 2


class Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def bar(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, ~scores))[: self.k]  # ~s falls as s rises, without overflow
        self.scores, self.ids = scores[order], ids[order]


def _any_size(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size, held within a long."""
    if not v.size:
        return np.zeros(len(v), np.int64)
    if max(map(abs, q)) * max(map(abs, v.ravel())) * len(q) < 1 << 62:
        return v.astype(np.int64) @ q.astype(np.int64)
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in (v @ q).tolist()], dtype=np.int64)


def meet(x: np.ndarray, query_ids: np.ndarray, wide: np.ndarray, best: list[Best], dim: int, is_wide: bool, ids: np.ndarray, segments: list[bytes], k: int) -> None:
    """All queries (of one length) against one block."""
    order = np.argsort(ids, kind="stable")
    left, right = (np.searchsorted(ids[order], query_ids, side) for side in ("left", "right"))
    block = whole = None
    if not is_wide:
        planes = [np.frombuffer(p, f"<i{p[:1].decode()}", offset=1).reshape(dim, len(ids)) for p in segments]
        block = block_of(ids, planes)
    for i in range(len(x)):
        own = order[left[i] : right[i]]
        if block is not None and not wide[i] and dim:
            q = np.floor(SCALE * x[i]).astype(np.int64)
            here = possible(block, q, own, k, best[i].bar)
            best[i].add(q @ block.v[:, here], ids[here])
        else:
            if whole is None:
                whole = whole_numbers(np.frombuffer(segments[0], "<f8").reshape(len(ids), dim)) if is_wide else block.v.T.astype(object)
            here = np.setdiff1d(np.arange(len(ids)), own, assume_unique=True)
            best[i].add(_any_size(whole_numbers(x[i]), whole[here]), ids[here])


def _search(asked, k: int):
    """Blocks of the index, one after another, against one round of queries: (ask, vec_id, score) of each query's k best here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: [Best(k) for _ in rows[0]] for dim, rows in asked.value.items()}
        for batch in batches:
            for dim, wide, ids, segments in zip(*(batch.column(c) for c in ("dim", "wide", "ids", "segments"))):
                dim = dim.as_py()
                if dim in best:
                    asks, query_ids, wides, x = asked.value[dim]
                    meet(x, query_ids, wides, best[dim], dim, wide.as_py(), np.frombuffer(ids.as_py(), "<i8"), segments.as_py(), k)
        for dim, found in best.items():
            asks = np.repeat(asked.value[dim][0], [len(b.ids) for b in found])
            if len(asks):
                yield pa.RecordBatch.from_arrays([pa.array(asks), pa.array(np.concatenate([b.ids for b in found])), pa.array(np.concatenate([b.scores for b in found]))], names=["ask", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, rows: int = 65536) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `vectors` for each row of `queries` (vec_id, embedding both)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    base = _rows(vectors)
    many = base.count()
    # At most about `rows` vectors a block, and enough blocks to keep the cores busy where there are few vectors.
    blocks = max(1, -(-many // rows), min(2 * spark.sparkContext.defaultParallelism, many // 2048))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int")).repartition(blocks, "dim", "wide", "block")
    index = scratch.keep(dealt.groupBy("dim", "wide", "block").applyInArrow(_index, "dim int, wide boolean, ids binary, segments array<binary>"), "index")
    ask = scratch.keep(_rows(queries).withColumn("ask", F.monotonically_increasing_id()), "ask")
    size = ask.agg(F.coalesce(F.sum(8 * F.col("dim") + 32), F.lit(0))).first()[0]
    rounds = max(1, -(-size // ROUND))
    found = []
    for number in range(rounds):
        part = ask.where(F.pmod(F.xxhash64("ask"), F.lit(rounds)) == number).toArrow()
        asked = {}
        dims = part["dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            own = part.filter(pa.array(dims == dim))
            asked[dim] = (own["ask"].to_numpy(), own["vec_id"].to_numpy(), own["wide"].to_numpy(zero_copy_only=False), _components(own["x"], own.num_rows))
        shared = spark.sparkContext.broadcast(asked)
        found.append(scratch.keep(index.mapInArrow(_search(shared, k), "ask long, vec_id long, score long"), f"found{number}"))
        shared.unpersist()
    each = found[0]
    for more in found[1:]:
        each = each.unionByName(more)
    place = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.join(ask.select("ask", F.col("vec_id").alias("query_id")), "ask").select("query_id", "rank", "vec_id", "score")
