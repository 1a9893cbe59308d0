"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is contained in a document if the document has at least `percent` of the item's distinct 5-word shingles (A-Z
lower-cased; an item below five words is one shingle of its own length).

Search. Items are partitioned by size: class c holds those of up to 2**c shingles and more than half of that. For each class a
document is covered by windows of 2 x 2**c shingles that start every 2**c, so a passage as long as an item lies whole in one window, and the
window is at most four times the item. That turns containment 0.8 into a Jaccard similarity of at least 0.19 for any document length,
and `hashes` = 48 single MinHash bands miss such a pair with probability 0.81**48 = 4e-5 (an exact copy: 1e-6). Minima of
windows come from the minima of their halves, so the work is linear in the text. Every band match is verified against the whole document:
by hashes first, and what they leave word by word, so n_item and n_shared count shingles of words and not of hashes.

Size. The items' index goes to all tasks in blocks of bounded size (`BLOCK` bytes of shingles); one pass over the documents for each block.
For a benchmark of some thousand items that is one pass, and no shuffle of documents at all. Each block costs one more read of the
documents, so with B blocks this reads B x their size, where a shuffle of band values would move about 2 x 48 values of 8 bytes for each
shingle: reading is cheaper up to some hundred blocks (about 2 GB of item shingles).

Rows: null or empty texts (items or documents) match nothing. Repeated items and repeated documents are reported as often as they
occur. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, Words, gram_counts, gram_starts, grams, mix, pieces, shingles_of, thrifty, words

#: Bytes of shingles of one block of items.
BLOCK = 16 << 20


class Part(NamedTuple):
    """The items of one size class and shingle length."""

    k: int
    size: int
    ids: np.ndarray
    sets: list[np.ndarray]
    texts: list[str]
    minima: np.ndarray  # hashes x items


def multipliers(hashes: int) -> np.ndarray:
    """Odd multipliers; the order of h * m is the m-th random order of shingles."""
    return mix(np.arange(1, hashes + 1, dtype=U) * U(0x2545F4914F6CDD1D)) | U(1)


def item_sets(w: Words, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shingle length, sorted distinct shingles) of every text."""
    by = {}
    for d, n in enumerate(np.diff(w.first).tolist()):
        own = min(n, k)
        if own and own not in by:
            by[own] = grams(w, own)
        yield own, np.unique(by[own][w.first[d] : w.first[d + 1] - own + 1]) if own else np.zeros(0, U)


def _items(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = list(item_sets(words(part.column("text"), lower=True), k))
                yield pa.RecordBatch.from_pydict({"item_id": part.column("item_id"), "text": part.column("text"), "k": pa.array([a for a, _ in rows], pa.int32()), "grams": pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64()))})

    return run


def partition(rows: list[tuple[int, int, np.ndarray, str]], hashes: int) -> list[Part]:
    """(item, k, set, text) by shingle length and size class."""
    found: dict[tuple[int, int], list[tuple[int, np.ndarray, str]]] = {}
    for item, k, s, text in rows:
        found.setdefault((k, 1 << max(int(len(s) - 1).bit_length(), 0)), []).append((item, s, text))
    out = []
    for (k, size), own in sorted(found.items(), key=lambda x: x[0]):
        minima = np.array([[(s * m).min() for _, s, _ in own] for m in multipliers(hashes)], dtype=U)
        out.append(Part(k, size, np.array([i for i, _, _ in own]), [s for _, s, _ in own], [t for _, _, t in own], minima))
    return out


def _window_minima(x: np.ndarray, blocks: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima of each block of shingles and the next block of the same document."""
    low = np.minimum.reduceat(x, blocks)
    both = np.minimum(low, np.append(low[1:], low[-1:]))
    return np.where(last, low, both)


def _confirmed(w: Words, places: np.ndarray, k: int, text: str) -> tuple[int, int]:
    """The item's distinct shingles, and how many of them the document has at one of `places`, by their words."""
    wanted = shingles_of(text, k)
    spans = [(w.start[i : i + k].tolist(), w.end[i : i + k].tolist()) for i in places.tolist()]
    return len(wanted), len(wanted & {tuple(w.data[a:b].tobytes() for a, b in zip(*span)) for span in spans})


def search(w: Words, parts: list[Part], percent: int, hashes: int) -> list[tuple[int, int, int, int]]:
    """(document, item, the item's shingles, those the document has) of every verified pair, in order."""
    out = []
    for k in sorted({p.k for p in parts}):
        n = gram_counts(w, k)
        starts = gram_starts(w, k)
        if not len(starts):
            continue
        g = grams(w, k)[starts]
        first = np.concatenate(([0], np.cumsum(n)))
        mine = [p for p in parts if p.k == k]
        layout = []
        for p in mine:
            per = -(-n // p.size)
            doc = np.repeat(np.arange(len(n)), per)
            number = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
            layout.append((doc, first[doc] + number * p.size, number == per[doc] - 1))
        pairs: list[set[tuple[int, int]]] = [set() for _ in mine]
        for i, m in enumerate(multipliers(hashes)):
            x = g * m
            for p, (doc, blocks, last), found in zip(mine, layout, pairs):
                low = _window_minima(x, blocks, last)
                known = p.minima[i]
                table = np.zeros(1 << 16, dtype=bool)
                table[((known >> U(24)) & U(0xFFFF)).astype(np.int64)] = True
                at = np.flatnonzero(table[((low >> U(24)) & U(0xFFFF)).astype(np.int64)])
                if not len(at):
                    continue
                order = np.argsort(known, kind="stable")
                left, right = np.searchsorted(known[order], low[at], "left"), np.searchsorted(known[order], low[at], "right")
                for d, a, b in zip(doc[at].tolist(), left.tolist(), right.tolist()):
                    found.update((d, int(j)) for j in order[a:b])
        sets: dict[int, np.ndarray] = {}
        for p, found in zip(mine, pairs):
            for d, j in sorted(found):
                if d not in sets:
                    sets[d] = np.unique(g[first[d] : first[d + 1]])
                own, item = sets[d], p.sets[j]
                shared = int((own[np.minimum(np.searchsorted(own, item), len(own) - 1)] == item).sum())
                if 100 * shared >= percent * len(item):
                    here = g[first[d] : first[d + 1]]
                    places = starts[first[d] : first[d + 1]][item[np.minimum(np.searchsorted(item, here), len(item) - 1)] == here]
                    size, shared = _confirmed(w, places, k, p.texts[j])
                    if 100 * shared >= percent * size:
                        out.append((d, int(p.ids[j]), size, shared))
    return sorted(out)


def contained(docs: DataFrame, items: DataFrame, percent: int = 80, k: int = 5, hashes: int = 48) -> DataFrame:
    """doc_id, item_id, n_item (the item's shingles), n_shared for each item (item_id, text) that a document (doc_id, text) contains."""
    spark = docs.sparkSession
    sets = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_items(k), "item_id long, text string, k int, grams array<long>").where("k > 0")
    size = sets.agg(F.coalesce(F.sum(F.size("grams") * 8 + F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for block in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("item_id", "grams"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([(r["item_id"], r["k"], np.array(r["grams"], dtype=np.int64).view(U), r["text"]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            parts = partition(shared.value, hashes)
            for batch in batches:
                for part in pieces(batch):
                    hits = search(words(part.column("text"), lower=True), parts, percent, hashes) if parts else []
                    ids = part.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([h[c] for h in hits], pa.int64()) for c in (1, 2, 3))], names=["doc_id", "item_id", "n_item", "n_shared"])

        one = texts.mapInArrow(thrifty(run), "doc_id long, item_id long, n_item long, n_shared long")
        found = one if found is None else found.unionByName(one)
    return found
