"""Mixture-controlled packing: deficit round-robin over source queues into sequences of 2048 tokens.

Every source is a queue: its documents' token ids end to end, each document closed by one end id. A queue is served in turns of
`quantum` tokens. In each round a queue's deficit grows by its weight, and it is served when that reaches the middle of its next
turn; a deficit that is not spent is carried on, through sequences and partitions alike. Turn j of a queue with weight w therefore
falls due at round (2j + 1) / 2w. Because that is a closed form, the place of any turn in the whole stream is the number of turns of all
queues that fall due before it (ties: heavier queues first, then longer ones, then by a hash and the name). Each partition computes its own turns' places
from the queues' totals, so the carried deficits are exact across partitions although nothing runs one after another. What a queue holds beyond whole
turns (less than a turn) comes at the end of the stream, queue after queue.

Every source has a queue of its own, however many there are. Weights are whole numbers that add up to about 2**20, so at most some 1,500 of them
are distinct, and queues of one weight are alike but for their lengths: tasks get one table of (weight, turns, number of
such queues), of at most 2**21 + tokens / (2**20 turns) rows, and count turns weight by weight. A source's own weight, turns and rank reach its
documents by a join.

The stream is cut every `length` tokens: all sequences but the last are full, so nothing is padded but the last.
After any number of rounds each queue has had its weight in tokens to within one turn, plus rounding of the weights (one part in 2**20);
of the tokens so far it has its share to within one turn and its share of half a turn of every queue.

Weights: by default the queues' own token counts, the one mixture that lasts until all documents are packed; or
`weights`, after which queues that run out leave their share to the others.

Work: one pass encodes texts and writes the ids with running totals per task and source; the totals (tasks x sources) give each
row's place in its queue; a second pass cuts pieces. Ids are never shuffled unless those totals outgrow a broadcast.

Rows: null or empty text is the end id alone. A null source is a queue of its own. Repeated rows are packed as often
as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.shared import Scratch
from .words import pieces, runs, text_bytes, thrifty

#: Bytes of text that are encoded at once; bounds a task's memory (a longer text is encoded alone).
PART = 1 << 22
#: First bytes of characters of several bytes of which some are white space, and white space of one byte.
_WIDE, _NARROW = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_NARROW[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes of these texts are single spaces between two characters of one text that are surely no white space."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    at = np.flatnonzero(data == 0x20)
    at = at[~edge[at] & ~edge[at + 1]]
    after, before = data[at + 1], data[at - 1]
    # The first byte of a character of two bytes (C2) or three stands so far before its end.
    spaced = _NARROW[after] | _WIDE[after] | _NARROW[before] | (before >= 0x80) & ((data[at - 2] == 0xC2) | _WIDE[data[at - 3]])
    at = at[~spaced]
    out = np.zeros(len(data) + 1, dtype=bool)
    out[at] = True
    return out


class Encoder:
    """Ids of the byte-level BPE vocabulary.

    A text is first cut at the added tokens of the vocabulary file (such as <|endoftext|>), each of which has one id
    and joins with nothing, as `tokenizers` does by default. The vocabulary's pattern never joins text across a single space that stands between two other characters, save
    that the space goes with what follows. So a column's texts are cut there, and each distinct chunk of a column is encoded once: those
    between two such spaces all in one call, as they join with no neighbour; the first and last ones of texts each by itself.
    """

    def __init__(self, ranks: str, pattern: str, added: Mapping[str, int]):
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.added = dict(added)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        sizes = {number: len(x) for x, number in table.items()} | {number: len(text.encode()) for text, number in added.items()}
        #: The number of bytes of every id.
        self.bytes_of = np.zeros(max(sizes) + 1, dtype=np.int64)
        self.bytes_of[list(sizes)] = list(sizes.values())

    def _ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def whole(self, text: str) -> bytes:
        """One text's ids as little-endian unsigned 32-bit numbers, encoded as it stands."""
        return self._ids(text).astype("<u4").tobytes()

    def plain(self, text: str) -> bytes:
        """The same, chunk by chunk."""
        return self._chunked(pa.array([text], pa.large_string()))[0].tobytes()

    def encode(self, text: str) -> bytes:
        """The same, with the ids of added tokens."""
        return self.column(pa.array([text], pa.large_string()))[0].tobytes()

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column's texts, end to end, and where each text's begin, with the end. Null is empty."""
        if not any(pc.any(pc.match_substring(texts, x)).as_py() for x in self.added):
            return self._chunked(texts)
        cut = [self.cut.split(x or "") for x in texts.to_pylist()]  # in turns what is between added tokens, and such a token
        ids, first = self._chunked(pa.array([x for own in cut for x in own[::2]], pa.large_string()))
        tokens = np.array([len(own) // 2 for own in cut], dtype=np.int64)
        ends = np.cumsum(tokens + 1)
        followed = np.ones(len(first) - 1, dtype=bool)
        followed[ends - 1] = False
        ids = np.insert(ids, first[1:][followed], [self.added[x] for own in cut for x in own[1::2]])
        return ids, np.concatenate(([0], first[ends] + np.cumsum(tokens)))

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As `column`, without regard to added tokens."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, dtype="<u4"), np.zeros(len(offsets), dtype=np.int64)
        cuts = _cuts(data, offsets)
        starts = cuts.copy()
        starts[offsets] = True
        bounds = np.flatnonzero(starts)
        chunks = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        number, inner = chunks.indices.to_numpy(), np.ones(len(chunks.dictionary), dtype=bool)
        outer = ~cuts[bounds]
        inner[number[outer[:-1] | outer[1:]]] = False

        together, alone = chunks.dictionary.filter(pa.array(inner)), chunks.dictionary.filter(pa.array(~inner))
        spelt, ends = text_bytes(together)
        ids = self._ids(spelt.tobytes().decode())
        first = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends[1:]) + 1  # each chunk's bytes are whole ids
        singles = [self._ids(x) for x in alone.to_pylist()]
        first = np.concatenate(([0], first, len(ids) + np.cumsum([len(x) for x in singles], dtype=np.int64)))
        known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(4 * first), pa.py_buffer(np.concatenate([ids, *singles]).astype("<u4"))])

        place = np.where(inner, np.cumsum(inner) - 1, len(together) + np.cumsum(~inner) - 1)
        met = known.take(pa.array(place[number]))
        at = np.frombuffer(met.buffers()[1], dtype=np.int64)[: len(met) + 1] // 4
        return np.frombuffer(met.buffers()[2], dtype="<u4", count=at[-1]), at[np.searchsorted(bounds, offsets)]


_encoders: dict[tuple[str, str, str], Encoder] = {}


def encoder(ranks: str | None = None, pattern: str | None = None, vocabulary: str | None = None) -> Encoder:
    """This process's encoder; by default of the vocabulary byte_bpe_50k.

    `ranks` is the path of the rank file, `vocabulary` that of the `tokenizers` file of the same vocabulary, which names the added tokens.
    """
    if ranks is None or pattern is None or vocabulary is None:
        import public_tokenizers

        ranks, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    if (ranks, pattern, vocabulary) not in _encoders:
        with open(vocabulary, encoding="utf-8") as file:
            added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        _encoders[ranks, pattern, vocabulary] = Encoder(ranks, pattern, added)
    return _encoders[ranks, pattern, vocabulary]


def _encode(end: int, ranks: str | None):
    """(doc_id, source, text) -> ids, with the task and the tokens of this source before it in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, task, before = encoder(ranks), TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in pieces(batch, most=PART):
                ids, first = tool.column(part.column("text"))
                short = np.split(np.insert(ids, first[1:], end), (first + np.arange(len(first)))[1:-1])
                sources, places = part.column("source").to_pylist(), []
                for source, own in zip(sources, short):
                    places.append(before.get(source, 0))
                    before[source] = places[-1] + len(own)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "source": part.column("source"), "task": pa.array([task] * len(short), pa.int32()), "place": pa.array(places, pa.int64()), "n": pa.array([len(x) for x in short], pa.int64()),
                    "ids": pa.array([x.astype("<u2").tobytes() if int(x.max()) < 65536 else b"\0" + x.astype("<u4").tobytes() for x in short], pa.binary())})

    return run


def unpack_ids(body: bytes) -> np.ndarray:
    """The ids as unsigned 32-bit numbers: two bytes an id, or a zero byte and four bytes an id."""
    return np.frombuffer(body, dtype="<u2").astype("<u4") if len(body) % 2 == 0 else np.frombuffer(body[1:], dtype="<u4")


class Turns:
    """How many turns, of all queues, come before a given one; from (weight, turns, number of queues with both)."""

    def __init__(self, weights: np.ndarray, turns: np.ndarray, queues: np.ndarray):
        self.total = int((turns * queues).sum())
        self.by: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for weight in np.unique(weights)[::-1].tolist():
            own = weights == weight
            order = np.argsort(turns[own])
            n, many = turns[own][order], queues[own][order]
            self.by.append((weight, n, np.concatenate(([0], np.cumsum(many))), np.concatenate(([0], np.cumsum(n * many)))))

    def before(self, weight: np.ndarray, turn: np.ndarray, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """For turn `turn` of a queue of this weight and `length` turns, the rank-th (from 0) of those that share both."""
        out = np.zeros(len(turn), dtype=np.int64)
        for v, n, many, sums in self.by:
            # Turns i of a queue of weight v that are due before: (2i + 1) / v < (2j + 1) / w; heavier queues also if equal.
            reach, left = np.divmod((2 * turn + 1) * v, weight)
            x = (reach + 1) // 2 - ((v <= weight) & (left == 0) & (reach % 2 == 1))
            at = np.searchsorted(n, x, side="right")
            out += sums[at] + x * (many[-1] - many[at])
            own = v == weight  # of queues of the same weight, the longer ones take the same turn before
            out[own] += many[-1] - many[np.searchsorted(n, length[own], side="right")] + rank[own]
        return out


class Queue(NamedTuple):
    """For each document its queue's weight, whole turns, rank among queues with both, and where the queue's end comes."""

    weight: np.ndarray
    turns: np.ndarray
    rank: np.ndarray
    tail: np.ndarray


def cut_pieces(start: np.ndarray, n: np.ndarray, queue: Queue, turns: Turns, quantum: int, length: int) -> tuple[np.ndarray, ...]:
    """(document, start within it, length, place in the stream) of the pieces of documents of n tokens at `start` of their queues."""
    first = start // quantum
    m = (start + n - 1) // quantum - first + 1
    doc = np.repeat(np.arange(len(n)), m)
    turn = first[doc] + runs(m)
    low, high = np.maximum(turn * quantum, start[doc]), np.minimum((turn + 1) * quantum, (start + n)[doc])
    whole = turn < queue.turns[doc]
    place = turns.total * quantum + queue.tail[doc] + low - turn * quantum
    own = doc[whole]
    place[whole] = turns.before(queue.weight[own], turn[whole], queue.turns[own], queue.rank[own]) * quantum + (low - turn * quantum)[whole]
    size = high - low
    # Only the ends of the queues can lie across a sequence's edge, and across one at most.
    over = np.flatnonzero(place // length != (place + size - 1) // length)
    if len(over):
        kept = length - place[over] % length
        doc, low, place, size = (np.concatenate(x) for x in ((doc, doc[over]), (low, low[over] + kept), (place, place[over] + kept), (size, size[over] - kept)))
        size[over] = kept
        order = np.lexsort((low, doc))
        doc, low, place, size = doc[order], low[order], place[order], size[order]
    return doc, low - start[doc], size, place


def _pieces(turns: Turns, quantum: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                raw = [unpack_ids(x.as_py()).tobytes() for x in batch.column("ids")]
                n = np.array([len(x) // 4 for x in raw], dtype=np.int64)
                doc, start, size, place = cut_pieces(batch.column("at").to_numpy(), n, Queue(*(batch.column(c).to_numpy() for c in Queue._fields)), turns, quantum, length)
                views = [memoryview(x) for x in raw]
                sums = [zlib.crc32(views[d][4 * x : 4 * (x + y)]) for d, x, y in zip(doc.tolist(), start.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), *(pa.array(np.asarray(x, dtype=np.int64)) for x in (start, size, sums, n[doc], place // length, place % length))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, weights: Mapping[str, float] | None = None, length: int = 2048, quantum: int = 128, end: int = 1, ranks: str | None = None) -> DataFrame:
    """Pack all documents (doc_id, source, text); one row per piece.

    doc_id, start (the document's ids before the piece), length, ids_crc32 (of its ids as little-endian unsigned
    32-bit numbers), doc_tokens (the document's ids, with the end id), sequence_id, offset. `quantum` divides `length`.
    `ranks` is the path of the vocabulary's rank file.
    """
    if length % quantum:
        raise ValueError("quantum must divide length")
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    coded = scratch.keep(texts.mapInArrow(thrifty(_encode(end, ranks)), "doc_id long, source string, task int, place long, n long, ids binary"), "ids")

    totals = scratch.keep(coded.groupBy("source", "task").agg(F.sum("n").alias("n")), "totals")
    queues = scratch.keep(_queues(totals, weights, quantum), "queues")
    alike = queues.where("turns > 0").groupBy("weight", "turns").agg(F.count("*").alias("queues")).toPandas()
    turns = spark.sparkContext.broadcast(Turns(*(alike[c].to_numpy(dtype=np.int64) for c in ("weight", "turns", "queues"))))
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("source", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    places = scratch.keep(_with(base, queues, "weight", "turns", "rank", "tail"), "places")
    met = coded.join(places, coded["source"].eqNullSafe(places["source"]) & (coded["task"] == places["task"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pieces(turns.value, quantum, length)(batches)

    return met.select("doc_id", (F.col("place") + F.col("base")).alias("at"), *Queue._fields, "ids").mapInArrow(
        thrifty(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _with(rows: DataFrame, queues: DataFrame, *columns: str) -> DataFrame:
    """`rows` with columns of their source's queue; a null source is a source."""
    return rows.join(queues.select(F.col("source").alias("own"), *columns), F.col("source").eqNullSafe(F.col("own"))).drop("own")


def _queues(totals: DataFrame, weights: Mapping[str, float] | None, quantum: int) -> DataFrame:
    """source, weight, turns, rank (among queues with equal weight and turns), tail (of the ends of queues, those before its own)."""
    sums = totals.groupBy("source").agg(F.sum("n").alias("n"))
    if weights is None:
        shares = sums.withColumn("share", F.col("n").cast("double"))
    else:
        given = totals.sparkSession.createDataFrame([(k, max(float(v), 0.0)) for k, v in weights.items()] or [("", 0.0)], "name string, share double")
        shares = sums.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n", F.coalesce("share", F.lit(0.0)).alias("share"))
    every = shares.agg(F.sum("share")).first()[0] or 1.0
    weight = F.greatest(F.rint(F.col("share") / every * (1 << 20)), F.lit(1.0)).cast("long")
    own = shares.select("source", weight.alias("weight"), F.floor(F.col("n") / quantum).alias("turns"), (F.col("n") % quantum).alias("rest"), F.pmod(F.xxhash64("source"), F.lit(256)).alias("part"))
    # Ranks and sums over all queues: within a part by a window, and the parts before it by another over at most 256 rows.
    by_name = F.asc_nulls_first("source")
    each = Window.partitionBy("weight", "turns", "part").orderBy(by_name)
    parts = own.groupBy("weight", "turns", "part").agg(F.count("*").alias("many"))
    earlier = parts.select("weight", "turns", "part", F.coalesce(F.sum("many").over(Window.partitionBy("weight", "turns").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ends = own.groupBy("part").agg(F.sum("rest").alias("rest")).select("part", F.coalesce(F.sum("rest").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ends"))
    inner = F.coalesce(F.sum("rest").over(Window.partitionBy("part").orderBy(by_name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = own.withColumns({"row": F.row_number().over(each), "inner": inner})
    return ranked.join(earlier, ["weight", "turns", "part"]).join(F.broadcast(ends), "part").select("source", "weight", "turns", (F.col("row") - 1 + F.col("earlier")).cast("long").alias("rank"), (F.col("inner") + F.col("ends")).alias("tail"))
