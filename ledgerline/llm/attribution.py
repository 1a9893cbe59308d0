"""Token counts by offset-mapped attribution.

Each document is encoded once, as a whole. Its tokens' byte spans (the vocabulary is byte-level, so a document's tokens
are its bytes end to end) are joined as intervals with the document's sections, and every token goes to exactly one section:

* ``most`` (the default): the section that holds most of its bytes, the earlier one on a tie;
* ``first``: the section that holds its first byte.

Bytes that no section covers count as a section of their own, -1, so a document's counts always add up to its tokens.

Sections are lines (each with its line end) unless a table of sections (doc_id, section, start, stop: code points, stop excluded) is
given. Where given sections overlap, the later one (by start, then by section) begins where the one before ends; parts beyond the
text do not count.

Rows: null or empty text has one line without tokens. With given sections, each document has a row for each of its sections
(also those without tokens), and one for -1 where that has tokens; a document without sections has all tokens in -1, with no
tokens a row of 0. Null doc_ids meet no given sections. Repeated rows are counted each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import encoder
from .words import pieces

#: Bytes of text that are encoded and counted at once (a longer text alone).
PART = 1 << 21


def attribute(sizes: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """How many tokens (of these byte lengths, end to end) each of the intervals bounds[i]:bounds[i + 1] gets."""
    stop = np.cumsum(sizes)
    start = stop - sizes
    first = np.searchsorted(bounds, start, side="right") - 1
    if rule == "most":
        last = np.searchsorted(bounds, stop - 1, side="right") - 1
        for i in np.flatnonzero(first != last).tolist():
            held = np.minimum(bounds[first[i] + 1 : last[i] + 2], stop[i]) - np.maximum(bounds[first[i] : last[i] + 1], start[i])
            first[i] += int(held.argmax())
    return np.bincount(first, minlength=len(bounds) - 1)[: len(bounds) - 1]


def _line_bounds(raw: bytes) -> np.ndarray:
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.unique(np.concatenate(([0], at, [len(raw)])))


def _places(raw: bytes) -> np.ndarray:
    """The byte at which each code point starts, and the end."""
    return np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))


def _given(sections: list[dict] | None, chars: int) -> tuple[list[int], list[int]]:
    """Code-point bounds of consecutive intervals that cover the text, and each one's section."""
    bounds, names = [0], []
    for s in sorted(sections or [], key=lambda s: (s["start"], s["section"])):
        start, stop = min(max(s["start"], bounds[-1]), chars), min(max(s["stop"], bounds[-1]), chars)
        if start > bounds[-1]:
            names.append(-1)
            bounds.append(start)
        names.append(s["section"])
        bounds.append(max(stop, start))
    if bounds[-1] < chars or not names:
        names.append(-1)
        bounds.append(chars)
    return bounds, names


def _count(rule: str, given: bool, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(ranks)
        for whole in batches:
            for batch in pieces(whole, most=PART):
                every, first = tool.column(batch.column("text"))
                sections = batch.column("sections").to_pylist() if given else [None] * batch.num_rows
                rows: list[list] = [[] for _ in range(6)]
                for i, (text, own) in enumerate(zip(batch.column("text").to_pylist(), sections)):
                    text = text or ""
                    raw = text.encode()
                    ids = every[first[i] : first[i + 1]]
                    places = _places(raw)
                    if given:
                        bounds, names = _given(own, len(places) - 1)
                        edge = places[np.array(bounds)]
                    else:
                        edge = _line_bounds(raw)
                        edge = edge if len(edge) > 1 else np.array([0, 0])
                        bounds, names = np.searchsorted(places, edge).tolist(), list(range(len(edge) - 1))
                    # Intervals without bytes get nothing; searchsorted needs the others strictly rising.
                    full = np.flatnonzero(np.diff(edge) > 0)
                    n = np.zeros(len(names), dtype=np.int64)
                    if len(full):
                        n[full] = attribute(tool.bytes_of[ids], np.append(edge[full], edge[-1]), rule)
                    for part, column in zip(([i] * len(names), names, bounds[:-1], bounds[1:], n.tolist(), [len(ids)] * len(names)), rows):
                        column += part
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows[0], pa.int64())), *(pa.array(c, pa.int64()) for c in rows[1:])],
                    names=["doc_id", "section", "start", "stop", "n_tokens", "doc_tokens"])

    return run


def attribute_tokens(docs: DataFrame, sections: DataFrame | None = None, rule: str = "most", ranks: str | None = None) -> DataFrame:
    """doc_id, section, start, stop (code points), n_tokens, doc_tokens for each section of each row of `docs` (doc_id, text)."""
    if rule not in ("most", "first"):
        raise ValueError(f"unknown rule {rule}")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if sections is not None:
        known = sections.where("section is not null and start is not null and stop is not null").select(F.col("doc_id").cast("long"), F.struct(*[F.col(c).cast("long").alias(c) for c in ("section", "start", "stop")]).alias("s"))
        docs = docs.join(known.groupBy("doc_id").agg(F.collect_list("s").alias("sections")), "doc_id", "left").select("doc_id", "text", "sections")
    return docs.mapInArrow(_count(rule, sections is not None, ranks), "doc_id long, section long, start long, stop long, n_tokens long, doc_tokens long")
