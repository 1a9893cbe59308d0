"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code point alone. A trigram's vector binds
(multiplies) its letters' vectors, the first permuted twice and the second once; a text's vector bundles (adds) those of all its
trigrams; a language's prototype bundles the unit vectors of its training texts. A text gets the language whose prototype has the largest
cosine with its vector.

Text is lower-cased; runs of anything but letters count as one space, and words are padded by spaces.

Training: all labelled texts outside the held-out fold, each once. Sums are in fixed point, so they are the same whatever the partitions. Prototypes
are languages x dimensions numbers, independent of the corpus.

Rejection (`reject`): random letters score near one half, since prototypes are centred, but seldom below it. So a text is
rejected, as `und`, whose distance from one half is less than half of what all but one in a thousand of the rightly labelled training texts
of its length (in powers of four letters) have, exactly and over all of them. Lengths with less than 100 such texts use the next shorter one's; short texts are
hardly ever rejected.

Rows: null text, and text without a letter, is `und` with score 0. Ties go to the first language in order. Without any
training text, every row is `und`. Repeated rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.shared import Scratch

from .words import U, mix, thrifty

DIMENSIONS = 1024
_SPACE = 32


def _letter_table(size: int = 0x110000) -> np.ndarray:
    """For every code point its lower-case letter, or a space for what is no letter."""
    out = np.full(size, _SPACE, dtype=np.int32)
    for c in range(size):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_table: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def letters(text: str) -> np.ndarray:
    """The text as lower-case letters with single spaces between and around words; empty if it has no letter."""
    global _table
    if _table is None:
        _table = _letter_table()
    codes = _table[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    codes = np.concatenate(([_SPACE], codes, [_SPACE]))
    gap = codes == _SPACE
    return codes[~(gap & np.concatenate(([False], gap[:-1])))] if not gap.all() else codes[:0]


def letter_vector(code: int) -> np.ndarray:
    if code not in _vectors:
        bits = mix(np.arange(DIMENSIONS // 64, dtype=U) + (U(code) << U(20)) + U(0x51ED270B))
        _vectors[code] = np.unpackbits(bits.view(np.uint8)).astype(np.int8) * 2 - 1
    return _vectors[code]


def _bind(grams: np.ndarray) -> np.ndarray:
    """The vectors of trigrams (three code points packed into one number each)."""
    out = None
    for place, shift in enumerate((42, 21, 0)):
        codes, back = np.unique((grams >> shift) & 0x1FFFFF, return_inverse=True)
        own = np.stack([np.roll(letter_vector(int(c)), 2 - place) for c in codes])[back]
        out = own if out is None else out * own
    return out.astype(np.float32)


def profiles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Every text's vector, scaled to unit length (zero without letters), and whether it has letters."""
    rows, grams, counts, some = [], [], [], np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        codes = letters(text).astype(np.int64) if text else np.zeros(0, np.int64)
        if len(codes) < 3:
            continue
        some[i] = True
        own = np.sort((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        grams.append(own[edge])
        counts.append(np.diff(np.append(edge, len(own))))
        rows.append(np.full(len(edge), i))
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    if grams:
        known, place = np.unique(np.concatenate(grams), return_inverse=True)
        row, count = np.concatenate(rows), np.concatenate(counts)
        for low in range(0, len(known), 8192):
            here = (place >= low) & (place < low + 8192)
            used = known[low : low + 8192]
            table = np.zeros((len(texts), len(used)), dtype=np.float32)
            table[row[here], place[here] - low] = count[here]
            out += table @ _bind(used)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)
    return out, some


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of at most 64 texts and about 200,000 characters."""
    texts, at = batch.column("text").to_pylist(), 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and to - at < 64 and (to == at or size + len(texts[to] or "") <= 200_000):
            size += len(texts[to] or "")
            to += 1
        yield at, texts[at:to]
        at = to


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> this task's sum of unit vectors per language, as 64-bit fixed point (so that any order gives the same sum)."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for at, texts in _chunks(batch):
            vectors, _ = profiles(texts)
            fixed = np.rint(vectors.astype(np.float64) * (1 << 24)).astype(np.int64)
            for i, lang in enumerate(langs[at : at + len(texts)]):
                sums[lang] = sums.get(lang, 0) + fixed[i]
    if sums:
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))})


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo `folds`; null stays null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def fold(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def _labelled(docs: DataFrame) -> DataFrame:
    """lang and text of the rows that have both."""
    return docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Prototypes (unit vectors) of the languages in `docs` (doc_id, text, lang), which are all for training."""
    parts = _labelled(docs).mapInArrow(thrifty(_bundle), "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).collect()
    sums.sort(key=lambda r: r["lang"])
    table = np.array([r["v"] for r in sums], dtype=np.float64).reshape(len(sums), DIMENSIONS)
    if len(sums) > 1:
        table = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-30)
        table = table - table.mean(axis=0)  # what all languages share does not tell them apart
    return [r["lang"] for r in sums], (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-30)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, carry: tuple[str, ...] = ("doc_id",), lengths: bool = False) -> DataFrame:
    """The columns named in `carry` with lang_pred and score: half of one plus the cosine, so within 0 and 1.

    With `lengths` also the text's length class.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes))
    columns = list(dict.fromkeys(carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches:
            found, scores, classes = [], [], []
            for _, texts in _chunks(batch):
                vectors, some = profiles(texts)
                if not names:
                    some[:] = False
                cosine = vectors @ table.T if len(names) else np.zeros((len(texts), 1))
                best = cosine.argmax(axis=1)
                own = [min(max((1 + float(cosine[i, b])) / 2, 0.0), 1.0) if some[i] else 0.0 for i, b in enumerate(best.tolist())]
                classes += map(length_class, texts) if lengths else []
                found += [names[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist())]
                scores += own
            made = [pa.array(found, pa.string()), pa.array(scores, pa.float64()), *([pa.array(classes, pa.int32())] if lengths else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], names=[*columns, "lang_pred", "score", *(["length_class"] if lengths else [])])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(thrifty(run), f"{out}, lang_pred string, score double{', length_class int' if lengths else ''}")


def length_class(text: str | None) -> int:
    """The power of four that the text's letters reach; 0 below four."""
    return (max(len(letters(text)) if text else 0, 1).bit_length() - 1) // 2


#: Bits of a score as a whole number, bits that a pass over the scores settles, texts that a length class needs, and the share of them that may lie below.
BITS, PASS, ENOUGH, SHARE = 54, 11, 100, 0.001


def least_scores(right: DataFrame) -> dict[int, float]:
    """The score below which a text of each length class is rejected, from (length_class, score) of all rightly labelled training texts.

    The order statistics on both sides of the share are found digit by digit: a pass counts the scores under the digits known so far by their next one, so the
    driver sees counts only, and they are exact.
    """
    keyed = right.select("length_class", F.round(F.col("score") * 2.0**BITS).cast("long").alias("key"))
    sizes = {r["length_class"]: r["count"] for r in keyed.groupBy("length_class").count().collect()}
    ranks = {length: SHARE * (n - 1) for length, n in sizes.items() if n >= ENOUGH}
    # (length class, rank) -> the digits known, and the rank among the keys that have them.
    known = {(length, k): (0, k) for length, r in ranks.items() for k in {int(r), min(int(r) + 1, sizes[length] - 1)}}
    for shift in range(BITS + 1 - PASS, -1, -PASS):
        cells = right.sparkSession.createDataFrame(sorted({(length, prefix) for (length, _), (prefix, _) in known.items()}) or [], "length_class int, prefix long")
        under = keyed.withColumns({"prefix": F.shiftright("key", shift + PASS), "cell": F.shiftright("key", shift)}).join(F.broadcast(cells), ["length_class", "prefix"])
        counts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in under.groupBy("length_class", "prefix", "cell").count().orderBy("cell").collect() if known else ():
            counts.setdefault((r["length_class"], r["prefix"]), []).append((r["cell"], r["count"]))
        for (length, k), (prefix, rank) in known.items():
            for cell, n in counts[length, prefix]:
                if rank < n:
                    known[length, k] = cell, rank
                    break
                rank -= n
    out, last = {}, 0.0
    for length in range(32):
        if length in ranks:
            k = int(ranks[length])
            low, high = (known[length, i][0] / 2.0**BITS for i in (k, min(k + 1, sizes[length] - 1)))
            last = 0.5 + (low + (high - low) * (ranks[length] - k) - 0.5) / 2
        out[length] = last
    return out


def identify(docs: DataFrame, folds: int = 5, held: int = 0, carry: tuple[str, ...] = ("doc_id",), reject: bool = False) -> DataFrame:
    """Learn from all rows outside the held-out fold, and predict every row; with `reject`, what is like no language is `und`."""
    learn = F.coalesce(fold_of(F.col("doc_id"), folds) != held, F.lit(False))
    langs, prototypes = train(docs.where(learn))
    if not reject:
        return predict(docs, langs, prototypes, carry)
    # All rows are scored once and kept; the thresholds come from those of them that are for training.
    wanted = list(dict.fromkeys(carry))
    rows = docs.withColumn("__label", F.when(learn, F.col("lang").cast("string")))
    scratch = Scratch(docs.sparkSession, "language")
    scored = scratch.keep(predict(rows, langs, prototypes, (*wanted, "__label"), lengths=True), "scored")
    cuts = least_scores(scored.where("__label = lang_pred").select("length_class", "score"))
    least = F.element_at(F.array(*[F.lit(cuts[n]) for n in range(32)]), F.col("length_class") + 1)
    return scored.select(*wanted, F.when(F.col("score") >= least, F.col("lang_pred")).otherwise("und").alias("lang_pred"), "score")
