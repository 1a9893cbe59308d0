"""Captions and the values below them, read page by page as words come: nothing is joined, and a task holds a page at a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .captions import CELLS, KEPT, Captions, Lookup, parts
from .extract import BELOW, LEAST_SIMILARITY, LEFT, RIGHT, SAME_LINE

#: Words that are read together (whole pages, so more where a page has more), and the columns of words that this needs.
TOGETHER = 20_000
WORDS = ("document", "page", "line", "word", "text", "left", "top", "width", "height", "confidence")


def _fresh(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row differs from the one before it; nulls are alike."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        at = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= at[1:] != at[:-1]
    return out


def _firsts(group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """The first row of each group in the order of the keys."""
    rows = np.lexsort((*reversed(order), group))
    return rows[np.append(True, np.diff(group[rows]) != 0)[: len(rows)]]


def _best(look: Lookup, fields: np.ndarray, texts: pa.Array, page: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
    """The best run of each page for each field: first word, number of words, field and similarity; of equally similar ones the first, of those the shortest."""
    found, step = [], max(1000, min(TOGETHER, KEPT // look.wide))
    for begin in range(0, len(texts), step):
        end = min(len(texts), begin + step + look.index.most - 1)
        row, n, number, ratio = look.runs(texts.slice(begin, end - begin), np.minimum(left[begin:end], end - np.arange(begin, end)), step, page[begin:end], fields)
        made = (row + begin, n, fields[number], ratio)
        keep = _firsts(page[made[0]] * len(fields) + made[2], -ratio, made[0], n)
        found.append([x[keep] for x in made])
    row, n, field, ratio = (np.concatenate(x) for x in zip(*found))
    keep = _firsts(page[row] * len(fields) + field, -ratio, row, n)
    return row[keep], n[keep], field[keep], ratio[keep]


def _below(page: np.ndarray, box: dict[str, np.ndarray], anchor_page: np.ndarray, anchor: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of anchors, and of the words of the line below each, left to right; see extract.values_below."""
    middle, base = box["top"] + box["height"] / 2, anchor["top"] + anchor["height"]
    limit = base + BELOW * anchor["height"]
    words, anchors = np.flatnonzero(~np.isnan(middle)), np.flatnonzero(~np.isnan(limit))
    # Words by page and middle, and the first and the last of each anchor's band among them.
    a, w = len(anchors), len(words)
    pages, heights = np.concatenate([anchor_page[anchors], page[words], anchor_page[anchors]]), np.concatenate([base[anchors], middle[words], limit[anchors]])
    order = np.lexsort((np.repeat([0, 1, 2], [a, w, a]), heights, pages))
    is_word = (order >= a) & (order < a + w)
    before = np.empty(len(order), dtype=np.int64)
    before[order] = np.cumsum(is_word)
    words, first, many = words[order[is_word] - a], before[:a], np.maximum(before[a + w :] - before[:a], 0)
    ends = np.cumsum(many)
    begin = 0
    while begin < a:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CELLS, side="right")))
        n, some = many[begin:end], anchors[begin:end]
        own = np.repeat(some, n)
        each = words[np.repeat(first[begin:end] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        begin = end
        near = (box["left"][each] >= anchor["left"][own] + LEFT) & (box["left"][each] <= anchor["left"][own] + RIGHT)
        own, each = own[near], each[near]
        if not len(own):
            continue
        # The topmost word, of those at one height the first.
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        back = np.cumsum(np.append(False, own[1:] != own[:-1]))
        top = np.minimum.reduceat(box["top"][each], starts)[back]
        topmost = np.minimum.reduceat(np.where(box["top"][each] == top, each, len(page)), starts)[back]
        near = np.abs(box["top"][each] - top) <= SAME_LINE * np.fmax(anchor["height"][own], box["height"][topmost])
        own, each = own[near], each[near]
        if len(own):
            order = np.lexsort((each, box["left"][each], own))
            yield own[order], each[order]


def _values(words: pa.Table, pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[pa.Array, pa.Array]:
    """Of each of `size` anchors the text of its words and their weakest confidence; null where it has none."""
    text, confidence = words["text"], words["confidence"].cast(pa.float64())
    known, sure = text.is_valid().to_numpy(zero_copy_only=False), confidence.is_valid().to_numpy(zero_copy_only=False)
    score = confidence.to_numpy(zero_copy_only=False)
    has, scored, weakest, at, made = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool), np.zeros(size), [np.zeros(0, dtype=np.int64)], [text.slice(0, 0)]
    for own, each in pairs:
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        some = own[starts]
        has[some], scored[some], weakest[some] = True, np.logical_and.reduceat(sure[each], starts), np.fmin.reduceat(score[each], starts)
        offsets = np.append(0, np.cumsum(np.add.reduceat(known[each].astype(np.int64), starts)))
        at.append(some)
        made.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text.take(pa.array(each[known[each]]))), " "))
    place, values = np.full(size, -1), pa.concat_arrays(made)
    place[np.concatenate(at)] = np.arange(len(values))
    return values.take(pa.array(place, mask=~has)), pa.array(weakest, mask=~(has & scored))


def _read(dictionary, scope: list[str], least: float):
    """Words that come page by page -> the best run of each caption on each page, and the value below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        # Scopes of the same captions share what is known of words.
        lookups: list[Lookup] = []
        number: dict[tuple, int] = {}
        same: dict[tuple, int] = {}
        for key, rows in dictionary.value.items():
            content = tuple(sorted(rows))
            if content not in same:
                same[content] = len(lookups)
                lookups.append(Lookup(Captions(rows, least)))
            number[key] = same[content]
        names = [sorted({field for field, _, _ in look.index.captions}) for look in lookups]
        fields = [np.array([own.index(field) for field, _, _ in look.index.captions]) for look, own in zip(lookups, names)]

        def read(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            fresh = _fresh([table[c].combine_chunks() for c in ("document", "page")])
            begins = np.flatnonzero(fresh)
            if not scope:
                yield from of(table, fresh, number.get((), -1))
                return
            kinds = zip(*(table[c].take(pa.array(begins)).to_pylist() for c in scope))
            which = np.array([number.get(kind, -1) for kind in kinds])
            for look in np.unique(which[which >= 0]).tolist():
                own = (which == look)[np.cumsum(fresh) - 1]
                some = table if own.all() else table.filter(pa.array(own))
                yield from of(some, fresh[own], look)

        def of(table: pa.Table, fresh: np.ndarray, look: int) -> Iterator[pa.RecordBatch]:
            if look < 0 or not len(fresh):
                return
            words = pa.RecordBatch.from_arrays([table[c].combine_chunks() for c in WORDS], names=list(WORDS))
            words = words.set_column(WORDS.index("text"), "text", words["text"].cast(pa.string()))
            page = np.cumsum(fresh) - 1
            box = {c: words[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("left", "top", "width", "height")}
            legible = np.flatnonzero(words["text"].is_valid().to_numpy(zero_copy_only=False))
            if not len(legible):
                return
            line = _fresh([pa.array(page[legible]), words["line"].take(pa.array(legible))])
            ends = np.append(np.flatnonzero(line)[1:], len(line))
            left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(line))
            row, n, field, ratio = _best(lookups[look], fields[look], words["text"].take(pa.array(legible)), page[legible], left)
            if not len(row):
                return
            at = legible[np.minimum(row[:, None] + np.arange(lookups[look].index.most), len(legible) - 1)]
            inside = np.arange(lookups[look].index.most) < n[:, None]
            edge = {c: np.where(inside, box[c][at], np.inf).min(axis=1) for c in ("left", "top")}
            edge |= {c: np.where(inside, box[a][at] + box[c][at], -np.inf).max(axis=1) - edge[a] for a, c in (("left", "width"), ("top", "height"))}
            first = legible[row]
            value, confidence = _values(words, _below(page, box, page[first], edge), len(row))
            own = words.take(pa.array(first))
            made = [pa.array(names[look], pa.string()).take(pa.array(field)), pa.array(n, pa.int32()), pa.array(ratio), *(pa.array(edge[c]) for c in ("left", "top", "width", "height")), value, confidence]
            yield pa.RecordBatch.from_arrays([*(own[c] for c in ("document", "page", "line", "word")), *made], names=["document", "page", "line", "word", "field", "n", "similarity", "left", "top", "width", "height", "value", "confidence"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in chain([first], batches):
            if not batch.num_rows:
                continue
            places = [batch.column(c) for c in ("document", "page")]
            begins = np.flatnonzero(_fresh(places))
            if held and all(held[-1].column(c)[-1].as_py() == own[0].as_py() for c, own in zip(("document", "page"), places)):
                begins = begins[1:]
            # The last page may go on in the next batch.
            if len(begins) and size + begins[-1] >= TOGETHER:
                end = int(begins[-1])
                yield from read([*held, batch.slice(0, end)])
                held, size = [], 0
                batch = batch.slice(end)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from read(held)

    return run


def read(words: DataFrame, captions: DataFrame, least: float = LEAST_SIMILARITY, documents: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """What extract.anchors and extract.values_below find together: document, page, field, line, hull and similarity of each caption's best run on each page, value and confidence of the
    words on the line below it, null where there is none.

    Captions are as in captions.hits; the scope of a document is in `documents`, or in columns of the words. `ordered` says that words of a page come one after another in the order of line
    and word, as those do that are made from one text; otherwise they are shuffled and sorted once. A task holds a page, and no word is joined with captions or values.
    """
    scope = [c for c in ("document_type", "language") if c in captions.columns]
    if documents is not None and scope:
        words = words.drop(*scope).join(documents.select("document", *scope).distinct(), "document")
        ordered = False
    elif missing := [c for c in scope if c not in words.columns]:
        raise ValueError(f"captions by {' and '.join(missing)} need documents, or words with these columns")
    own = words.where("document is not null and page is not null").select(*scope, *WORDS)
    if not ordered:
        own = own.repartition("document", "page").sortWithinPartitions(*scope, "document", "page", "line", "word")
    kinds = dict(own.dtypes)
    columns = ", ".join(f"{c} {kinds[c]}" for c in ("document", "page", "line", "word")) + ", field string, n int, similarity double, left double, top double, width double, height double, value string, confidence double"
    spark = words.sparkSession
    found = [own.mapInArrow(_read(spark.sparkContext.broadcast(dict(part)), scope, least), columns) for part in parts(captions, scope)]
    if not found:
        return spark.createDataFrame([], columns).drop("word", "n")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    if len(found) > 1:  # a field may have captions in several parts
        best = F.max_by(F.struct(*[c for c in whole.columns if c not in ("document", "page", "field")]), F.struct("similarity", -F.col("line"), -F.col("word"), -F.col("n")))
        whole = whole.groupBy("document", "page", "field").agg(best.alias("b")).select("document", "page", "field", "b.*")
    return whole.drop("word", "n")
