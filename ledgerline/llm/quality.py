"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features. Words are runs of bytes other than white space, and each has two readings: itself with A-Z lower-cased, and its form, in which a run of
small letters is one a, of capitals one A, of digits one 0, of a mark one such mark, non-ASCII letters vanish, and a word that repeats the one
before says so. One and two neighbouring words, and one to three neighbouring forms, are hashed to `BITS` bits. A text is the sparse vector of the square
roots of its n-grams' counts, scaled to unit length, so its length does not matter; its score is the logistic function of a sparse dot product.

Training. At most about `sample` labelled documents of each class are taken, those with the lowest hash of doc_id (weights restore the classes'
shares), so the same ones whatever the partitions. They are dealt to `SHARDS` shards; in each of `rounds` rounds every shard runs the updates (McMahan
and others, 2013) over its documents, one after another, from the common state, and the states' changes are averaged. The state is two numbers a bucket, so what
goes through the driver is bounded by `BITS`, and what a shard holds by `sample`. Scoring reads all rows, whole texts, with the weights broadcast.

Rows: a null or empty text has no n-grams and gets the score of the bias alone. Labels: null labels and other values than 0 and 1 do not count; of several for one doc_id
the largest does. Without labelled documents of both classes every score is the share of label 1 (one half without any). Repeated rows are scored alike.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.shared import Scratch, small

from .langid import fold_of
from .words import _LOWER, U, Words, _spell, gram_starts, grams, mix, pieces, thrifty, words

BITS = 18
SHARDS = 8
#: Learning rate, its smoothing, and the two penalties of the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.2, 0.2
_MARK = U(0x5851F42D4C957F2D)
#: Classes of bytes: letters and digits by kind, non-ASCII bytes none, every mark itself.
_FORM = np.arange(256, dtype=np.uint8)
_FORM[ord("a") : ord("z") + 1] = ord("a")
_FORM[ord("A") : ord("Z") + 1] = ord("A")
_FORM[ord("0") : ord("9") + 1] = ord("0")
_FORM[128:] = 0


def forms(w: Words) -> np.ndarray:
    """The hash of each word's form."""
    kind = _FORM[w.data]
    keep = kind != 0
    keep[1:] &= kind[1:] != kind[:-1]
    keep[w.start] = kind[w.start] != 0
    at = np.concatenate(([0], np.cumsum(keep)))
    out = _spell(kind[keep], at[w.start], at[w.end], 1)
    own = w.hashes[0]
    same = np.concatenate(([False], own[1:] == own[:-1])) if len(own) else np.zeros(0, bool)
    first = w.first[:-1]
    same[first[(first < len(own)) & (np.diff(w.first) > 0)]] = False
    return np.where(same, out ^ _MARK, out)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: text, bucket and value of each entry, in order of text."""
    w = words(column)
    w = w._replace(hashes=(_spell(_LOWER[w.data], w.start, w.end, 0),))
    doc = w.doc_of().astype(np.int64)
    keys, counts = [], []
    for family, (source, sizes) in enumerate(((w, (1, 2)), (w._replace(hashes=(forms(w),)), (1, 2, 3)))):
        for n in sizes:
            at = gram_starts(w, n)
            if len(at):
                hashed = mix(grams(source, n)[at] + U(8 * family + n)) >> U(64 - BITS)
                found, times = np.unique((doc[at] << BITS) | hashed.astype(np.int64), return_counts=True)
                keys.append(found)
                counts.append(times)
    if not keys:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    key, times = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    key, value = key[order][edge], np.sqrt(np.add.reduceat(times[order], edge).astype(float))
    of = key >> BITS
    length = np.sqrt(np.bincount(of, value * value))
    return of, key & ((1 << BITS) - 1), value / length[of]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, quality, weight, place) -> its sparse vector."""
    for batch in batches:
        for part in pieces(batch):
            of, bucket, value = features(part.column("text"))
            at = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=part.num_rows)))).astype(np.int32))
            vectors = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column("place"), part.column("quality"), part.column("weight"), *vectors], names=["place", "quality", "weight", "bucket", "value"])


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that the leader has after gradients summed to z (less what keeps it near) and squares summed to n."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def follow(z: np.ndarray, n: np.ndarray, examples: Iterator[tuple[np.ndarray, np.ndarray, float, float]]) -> None:
    """One pass of the updates over (buckets, values, label, weight); z and n change in place, the bias is their last entry."""
    for bucket, value, label, weight in examples:
        at = np.append(bucket, len(z) - 1)
        x = np.append(value, 1.0)
        w = weights_of(z[at], n[at])
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g


def _learn(state):
    """One shard's pass from the common state: what it changes there."""

    def run(rows: pa.Table) -> pa.Table:
        z, n = (x.copy() for x in state.value)
        rows = rows.sort_by([("place", "ascending"), ("quality", "ascending")])
        vectors = [[x.values.to_numpy() for x in rows[c].combine_chunks()] for c in ("bucket", "value")]
        follow(z, n, zip(*vectors, rows["quality"].to_pylist(), rows["weight"].to_pylist()))
        touched = np.flatnonzero(n != state.value[1])
        return pa.table({"bucket": touched, "z": (z - state.value[0])[touched], "n": (n - state.value[1])[touched]})

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, rounds: int = 8) -> np.ndarray:
    """Weights of all buckets and the bias, fitted on `labels` (doc_id, quality), all of which are for training, and their texts in `docs`."""
    spark = docs.sparkSession
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    if len(sizes) < 2:
        share = 1e-9 + sizes.get(1, 0)
        return np.append(np.zeros(1 << BITS), np.log(share / (1e-9 + sizes.get(0, 0))) if sizes else 0.0)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    taken = {c: min(1.0, sample / m) for c, m in sizes.items()}
    keep = F.when(F.col("quality") == 1, place < taken[1] * (1 << 40)).otherwise(place < taken[0] * (1 << 40))
    whole = sum(sizes.values()) / sum(sizes[c] * taken[c] for c in (0, 1))
    weight = F.when(F.col("quality") == 1, 1 / taken[1] / whole).otherwise(1 / taken[0] / whole)
    picked = marked.where(keep).select("doc_id", "quality", place.alias("place"), weight.alias("weight"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small(picked, min(3 * sample, sum(sizes.values())), 40), "doc_id")
    made = texts.select("text", "quality", "weight", "place").mapInArrow(thrifty(_examples), "place long, quality int, weight double, bucket array<int>, value array<float>")
    shard = F.pmod(F.col("place"), F.lit(SHARDS)).cast("int").alias("shard")
    examples = Scratch(spark, "quality").keep(made.select(shard, "*").repartition(SHARDS, "shard"), "examples")
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        moved = examples.groupBy("shard").applyInArrow(_learn(state), "bucket long, z double, n double").groupBy("bucket").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
        at = moved["bucket"].to_numpy()
        z[at] += moved["z"].to_numpy() / SHARDS
        n[at] += moved["n"].to_numpy() / SHARDS
        state.unpersist()
    return weights_of(z, n)


def score(docs: DataFrame, weights: np.ndarray, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in `carry`, with score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    columns = list(dict.fromkeys(carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in pieces(batch):
                of, bucket, value = features(part.column("text"))
                total = np.bincount(of, value * w[bucket], minlength=part.num_rows) + float(w[-1])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=[*columns, "score"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*[F.col(c) for c in dict.fromkeys([*columns, "text"])]).mapInArrow(thrifty(run), f"{out}, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = 4000, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the labels outside the held-out fold, and score every row."""
    learn = labels.where(F.coalesce(fold_of(F.col("doc_id"), folds) != held, F.lit(False)))
    return score(docs, train(docs, learn, sample), carry=carry)
