"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

Two documents link when |A & B| / |A | B| >= the threshold, over their sets of distinct 5-word shingles
(A-Z lower-cased). A set's n-grams are ordered rarest first. Two linked sets share an n-gram within the
first n - ceil(t n) + 1 of that order, so only those prefix n-grams are joined.

1. Census. An n-gram that a single document holds comes first in every order and joins with nothing, so a
   document stays only if enough of its n-grams occur elsewhere. Any fixed order will do for that test, so it reads each
   set's lowest hashes: of the lowest n - o + l (o = ceil(t n)) a linked pair shares l. Tasks settle n-grams that they meet twice
   themselves and send each other once, in buckets of the hash space, so a common n-gram or a huge group of
   copies costs one entry a task. Counts come back as one array a task and bucket.
2. Equal sets become one class, named by the number of one of its rows.
3. The surviving classes' n-grams are counted exactly, sorted rarest first, and the prefixes kept.
4. Each class gets a hub, a document that leads one of its prefix n-grams; hubs are split by the number of n-grams that they
   gather, so a group has bounded memory. First the classes of each split meet each other and the hub's document, which connects
   a cluster of near copies however many splits it takes. Then classes that share a prefix n-gram and are not connected yet
   meet in the group of their two splits, so a large cluster meets others but not its own splits.
   In a group an inverted index over the prefixes finds the pairs, the filters drop most, and each remaining pair is verified
   once, unless it is already connected: by hashes, and what they would link word by word.
5. Links become components (see operators/graph.py).

Results: one row per input row with n_shingles and component_id. Rows without words (or null text) have
an empty set and link with nothing. A null doc_id links with nothing and has a null component_id. Rows that
repeat a doc_id are one document: its links are those of all its rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.graph import connected
from ledgerline.shared import Scratch, shuffle_parts, small
from .words import U, mix, pieces, runs, shingle_sets, shingles_of, thrifty, words

#: n-grams that a task holds before it sends them; bounds its memory.
HELD = 2_000_000
#: n-grams of the sets that meet in one group; bounds a group's memory.
GROUP = 2_000_000
BASE = "kind int, flush long, bucket int, row array<long>, doc array<long>, n array<int>, s1 array<long>, s2 array<long>, lo array<int>, body binary"


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """ceil(percent/100 n): the least overlap of a set of n with any linked set."""
    return -(-percent * n // 100)


def _extra(n: np.ndarray, percent: int) -> np.ndarray:
    """l of the census: a quarter of the overlap."""
    return np.maximum(need(n, percent) // 4, 1)


def set_marks(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + U(0x14057B7EF767814F))).view(np.int64))


def _census_rows(k: int, percent: int, buckets: int):
    """Arrow batches of (doc_id, text) -> flushes: one row on the documents, and one for each bucket of n-grams."""

    def flush(ids: list, sets: list[np.ndarray], number: int) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], dtype=np.int64)
        take = np.where(n > 0, np.minimum(n, n - need(n, percent) + _extra(n, percent)), 0)
        low = np.concatenate([s[:m] for s, m in zip(sets, take.tolist())] or [np.zeros(0, U)])
        doc = np.repeat(np.arange(len(sets)), take)
        order = np.argsort(low, kind="stable")
        low, doc = low[order], doc[order]
        edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(low) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(low)))
        alone = np.repeat(size == 1, size)
        known = np.bincount(doc[~alone], minlength=len(sets))
        one, own = low[alone], doc[alone]
        many = low[edge[size > 1]]
        one_at, many_at = (one % U(buckets)).astype(np.int64), (many % U(buckets)).astype(np.int64)
        by = np.lexsort((own, one_at))
        one, own, one_at = one[by], own[by], one_at[by]
        by = np.argsort(many_at, kind="stable")
        many, many_at = many[by], many_at[by]
        rows: dict[str, list] = {x: [] for x in ("kind", "flush", "bucket", "row", "doc", "n", "s1", "s2", "lo", "body")}

        def add(kind, bucket, body=None, **lists):
            for key in rows:
                rows[key].append({"kind": kind, "flush": number, "bucket": bucket, "body": body}.get(key, lists.get(key)))

        marks = [set_marks(s) for s in sets]
        add(0, -1, row=[(number << 16) + i for i in range(len(sets))], doc=ids, n=n.tolist(), s1=[a for a, _ in marks], s2=[b for _, b in marks], lo=known.tolist())
        here = np.unique(np.concatenate((one_at, many_at)))
        five = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()  # noqa: E731  the upper 40 bits; a chance match only keeps a document that the join then refuses
        for b, (i, j), (p, q) in zip(here.tolist(), _ranges(one_at, here), _ranges(many_at, here)):
            head = np.array([len(sets), j - i, q - p], dtype=np.uint32).tobytes()
            add(1, b, head + own[i:j].astype(np.uint16).tobytes() + five(one[i:j]) + five(many[p:q]))
        return pa.RecordBatch.from_pydict(rows, schema=_base_schema())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, sets, held = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for part in pieces(batch):
                ids += part.column("doc_id").to_pylist()
                new = shingle_sets(words(part.column("text"), lower=True), k)
                sets += new
                held += sum(map(len, new))
                if held >= HELD or len(sets) >= 50_000:
                    for at in range(0, len(sets), 60_000):
                        yield flush(ids[at : at + 60_000], sets[at : at + 60_000], number)
                        number += 1
                    ids, sets, held = [], [], 0
        for at in range(0, len(sets), 60_000):
            yield flush(ids[at : at + 60_000], sets[at : at + 60_000], number)
            number += 1

    return run


def _base_schema() -> pa.Schema:
    return pa.schema([("kind", pa.int32()), ("flush", pa.int64()), ("bucket", pa.int32()), ("row", pa.list_(pa.int64())), ("doc", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("s1", pa.list_(pa.int64())), ("s2", pa.list_(pa.int64())), ("lo", pa.list_(pa.int32())), ("body", pa.binary())])


def _ranges(sorted_keys: np.ndarray, keys: np.ndarray) -> list[tuple[int, int]]:
    return list(zip(np.searchsorted(sorted_keys, keys, "left").tolist(), np.searchsorted(sorted_keys, keys, "right").tolist()))


def _five_in(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    wide[:, 3:] = raw.reshape(-1, 5)
    return wide.view(U).ravel()


def _count_shared(table: pa.Table) -> pa.Table:
    """One bucket: for each flush, how many of each document's n-grams some other flush has too."""
    flushes, parts, others, owners = table["flush"].to_pylist(), [], [], []
    for body in table["body"]:
        raw = np.frombuffer(body.as_buffer(), dtype=np.uint8)
        docs, ones, many = np.frombuffer(raw[:12].tobytes(), dtype=np.uint32).tolist()
        at = 12 + 2 * ones
        owners.append((docs, np.frombuffer(raw[12:at].tobytes(), dtype=np.uint16)))
        parts.append(_five_in(raw[at : at + 5 * ones]))
        others.append(_five_in(raw[at + 5 * ones : at + 5 * (ones + many)]))
    every = np.sort(np.concatenate(parts + others))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    outs = []
    for (docs, owner), part in zip(owners, parts):
        hit = np.zeros(0, np.int64)
        if len(again) and len(part):
            at = np.minimum(np.searchsorted(again, part), len(again) - 1)
            hit = owner[again[at] == part].astype(np.int64)
        number, count = np.unique(hit, return_counts=True)
        outs.append(np.array([docs, len(number)], np.uint32).tobytes() + number.astype(np.uint16).tobytes() + count.astype(np.uint32).tobytes())
    return pa.table({"flush": pa.array(flushes, pa.int64()), "counts": pa.array(outs, pa.binary())})


def _add_up(table: pa.Table) -> pa.Table:
    """One task's counts from all buckets, added."""
    total = None
    for c in table["counts"]:
        raw = c.as_py()
        docs, m = np.frombuffer(raw, np.uint32, 2).tolist()
        total = np.zeros(docs, np.int64) if total is None else total
        total[np.frombuffer(raw, np.uint16, m, 8)] += np.frombuffer(raw[8 + 2 * m :], np.uint32)
    return pa.table({"flush": table["flush"].slice(0, 1).cast(pa.int64()), "total": pa.array([total.tolist()], pa.list_(pa.int64()))})


def _rows_of_sets(k: int):
    """(cls, s1, s2, text) -> the text and its n-grams, if it is one that the class stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(words(part.column("text"), lower=True), k)
                own1, own2 = (part.column(c).to_pylist() for c in ("s1", "s2"))
                good = [i for i, s in enumerate(sets) if len(s) and set_marks(s) == (own1[i], own2[i])]
                pick = pa.array(good, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("cls").take(pick), part.column("text").take(pick), pa.array([sets[i].view(np.int64) for i in good], pa.list_(pa.int64()))], names=["cls", "text", "grams"])

    return run


class _Exact:
    """Whether two of a group's texts link by their words; remembers the sets of some texts."""

    def __init__(self, texts: pa.ChunkedArray, percent: int, k: int):
        self.texts, self.percent, self.k, self.sets, self.size = texts, percent, k, {}, 0

    def of(self, i: int) -> frozenset:
        if i not in self.sets:
            if self.size > 200_000:
                self.sets, self.size = {}, 0
            self.sets[i] = shingles_of(self.texts[i].as_py(), self.k)
            self.size += len(self.sets[i])
        return self.sets[i]

    def linked(self, i: int, j: int) -> bool:
        a, b = self.of(i), self.of(j)
        shared = len(a & b)
        return 100 * shared >= self.percent * (len(a) + len(b) - shared)


def links_in_group(table: pa.Table, percent: int, k: int) -> list[tuple[int, int]]:
    """Exact links among one group's classes, less those within what is already connected.

    Columns: cls, hub, comp (equal where connected already), ga, gb, n, prefix (n-grams), at (their positions in the rare-first
    order), text. Where the group is of two hubs, only pairs across them are looked at.
    """
    order = np.lexsort((table["cls"].to_numpy(), table["n"].to_numpy()))
    first = np.unique(table["cls"].to_numpy()[order], return_index=True)[1]  # a hub's document may be there twice
    if len(first) < 2:
        return []
    table = table.take(pa.array(order[np.sort(first)]))
    cls, n, hub = table["cls"].to_numpy(), table["n"].to_numpy(), table["hub"].to_numpy()
    across = table["ga"][0].as_py() != table["gb"][0].as_py()
    texts = table["text"].cast(pa.large_string())
    exact = _Exact(texts, percent, k)
    flat = np.concatenate([s for part in pieces(pa.table({"text": texts}).combine_chunks().to_batches()[0]) for s in shingle_sets(words(part.column("text"), lower=True), k)])
    codes = np.unique(flat, return_inverse=True)[1]
    at = np.concatenate(([0], np.cumsum(n)))
    # Suffix filter: the sets' counts in 64 cells of the hash order bound their Hamming distance from below.
    cells = np.zeros((len(cls), 64), dtype=np.int32)
    np.add.at(cells, (np.repeat(np.arange(len(cls)), n), (flat >> U(58)).astype(np.int64)), 1)
    del flat
    mark = np.zeros(int(codes.max()) + 1, dtype=np.int32)
    root = np.unique(table["comp"].to_numpy(), return_inverse=True)[1]
    # Postings of the prefix n-grams, each in order of class; a class looks at what stands before it.
    lists = table["prefix"].combine_chunks()
    gram = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    place = table["at"].combine_chunks().flatten().to_numpy()
    m = np.diff(lists.offsets.to_numpy())
    begin = np.concatenate(([0], np.cumsum(m)))
    owner = np.repeat(np.arange(len(cls)), m)
    by = np.lexsort((owner, gram))
    owner_by, place_by = owner[by], place[by]
    list_start = np.searchsorted(gram[by], gram, "left")
    before = np.empty(len(by), np.int64)
    before[by] = np.arange(len(by))
    before -= list_start
    links = []
    for i in range(len(cls)):
        mine = slice(begin[i], begin[i + 1])
        size = before[mine]
        at_list = np.repeat(list_start[mine], size) + runs(size)
        # The rarest common n-gram comes first, and so do its places in both.
        found, first = np.unique(owner_by[at_list], return_index=True)
        keep = root[found] != root[i]
        if across:
            keep &= hub[found] != hub[i]
        found, first = found[keep], first[keep]
        if not len(found):
            continue
        p, q = np.repeat(place[mine], size)[first], place_by[at_list[first]]
        # Length, then position: what can still be shared after the first common prefix n-gram.
        least = -(-percent * (n[i] + n[found]) // (100 + percent))
        found = found[(100 * n[found] >= percent * n[i]) & (1 + np.minimum(p, q) + np.minimum(n[i] - p - 1, n[found] - q - 1) >= least)]
        apart = np.abs(cells[found] - cells[i]).sum(axis=1)
        found = found[100 * (n[found] + n[i] - apart) * (100 + percent) >= 200 * percent * (n[found] + n[i])]
        mark[codes[at[i] : at[i + 1]]] = 1
        for block in np.array_split(found, max(1, len(found) // 256)):
            block = block[root[block] != root[i]]
            if not len(block):
                continue
            size = n[block]
            where = np.repeat(at[block], size) + runs(size)
            shared = np.add.reduceat(mark[codes[where]], np.cumsum(size) - size)
            for j in block[100 * shared >= percent * (size + n[i] - shared)].tolist():
                if root[j] != root[i] and exact.linked(i, j):
                    root[root == root[j]] = root[i]
                    links.append((int(cls[i]), int(cls[j])))
        mark[codes[at[i] : at[i + 1]]] = 0
    return links


def _group_links(percent: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        links = links_in_group(table, percent, k)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def ngram_join(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text); see the module's text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    buckets = 8 * shuffle_parts(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    base = scratch.keep(docs.mapInArrow(thrifty(_census_rows(k, percent, buckets)), BASE), "base")

    # 1. How many of each document's lowest n-grams occur elsewhere.
    shared = base.where("kind = 1").select("flush", "bucket", "body").groupBy("bucket").applyInArrow(_count_shared, "flush long, counts binary")
    totals = shared.groupBy("flush").applyInArrow(_add_up, "flush long, total array<long>")
    per_flush = base.where("kind = 0").select("flush", "row", "doc", "n", "s1", "s2", "lo").join(totals, "flush", "left")
    total = F.coalesce("total", F.array_repeat(F.lit(0).cast("long"), F.size("doc")))
    sets = scratch.keep(
        per_flush.select(F.inline(F.arrays_zip("row", "doc", "n", "s1", "s2", "lo", total.alias("total"))))
        .select("row", F.col("doc").alias("doc_id"), "n", "s1", "s2", (F.col("lo") + F.col("total")).alias("shared")), "sets")
    scratch.drop("base")

    # 2. Classes of equal sets.
    full = sets.where("n > 0 and doc_id is not null")
    classes = scratch.keep(full.groupBy("s1", "s2").agg(F.min("row").alias("cls"), F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("shared").alias("shared")), "classes")
    o = F.ceil(F.col("n") * percent / 100)
    alive = scratch.keep(classes.where(F.col("shared") >= F.greatest(F.floor(o / 4), F.lit(1))).select(F.col("rep").alias("doc_id"), "cls", "s1", "s2"), "alive")
    texts = docs.join(small(alive, alive.count(), 32), "doc_id").select("cls", "s1", "s2", "text")
    grams = scratch.keep(texts.mapInArrow(thrifty(_rows_of_sets(k)), "cls long, text string, grams array<long>").dropDuplicates(["cls"]), "grams")

    # 3. Prefixes, rarest first. An n-gram of one class alone joins nothing, but takes its place in the order.
    flat = grams.select("cls", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    df = flat.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    known = flat.join(df, "g").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("order"))
    first = F.col("n") - F.size("order")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = known.where(length > first).select("cls", "n", F.slice("order", F.lit(1), (length - first).cast("int")).alias("order"), first.alias("first"))
    tokens = scratch.keep(prefix.select("cls", "n", F.expr("transform(order, x -> x.g)").alias("prefix"), F.expr("transform(sequence(1, size(order)), i -> int(first + i - 1))").alias("at"), F.expr("aggregate(order, 0L, (s, x) -> s + x.df)").alias("weight")), "tokens")

    # 4. Hubs, and the groups in which classes meet.
    rows = tokens.select("cls", "weight", F.explode("prefix").alias("g"))
    lead = rows.groupBy("g").agg(F.max_by("cls", F.struct("weight", "cls")).alias("lead"), F.count("*").alias("m")).where("m > 1")
    led = scratch.keep(rows.join(lead, "g").select("g", "cls", "lead"), "led")
    votes = led.groupBy("cls", "lead").agg(F.count("*").alias("votes")).groupBy("cls").agg(F.max_by("lead", F.struct("votes", "lead")).alias("lead")).join(tokens.select("cls", "n"), "cls")
    load = votes.groupBy("lead").agg(F.sum("n").alias("load"))
    hubs = scratch.keep(votes.join(load, "lead").select("cls", "lead", F.xxhash64("lead", F.pmod(F.xxhash64("cls"), F.ceil(F.col("load") / GROUP))).alias("hub")), "hubs")
    sent = tokens.select("cls", "n", "prefix", "at").join(grams.select("cls", "text"), "cls")

    def meet(groups: DataFrame) -> DataFrame:
        return groups.join(sent, "cls").groupBy("ga", "gb").applyInArrow(_group_links(percent, k), "a long, b long")

    own = hubs.select("cls", "hub").unionByName(hubs.select(F.col("lead").alias("cls"), "hub").distinct())
    near = scratch.keep(meet(own.select("cls", "hub", F.col("cls").alias("comp"), F.col("hub").alias("ga"), F.col("hub").alias("gb"))), "near")
    joined = connected(near)
    placed = scratch.keep(hubs.select("cls", "hub").join(joined, F.col("cls") == F.col("node"), "left").select("cls", "hub", F.coalesce("component", "cls").alias("comp")), "placed")
    at = led.select("g", "cls").join(placed.join(tokens.select("cls", "n"), "cls"), "cls")
    marks = [F.sum(F.xxhash64(F.lit(x), "cls").cast("decimal(20,0)")).alias(x) for x in ("s1", "s2")]
    open_ = at.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"), *marks).where("low <> high")
    # n-grams of one passage have the same classes, so one of them stands for all.
    open_ = open_.groupBy("m", "s1", "s2").agg(F.min("g").alias("g")).select("g")
    at = scratch.keep(at.join(open_, "g"), "open")
    # Splits meet as wholes: one row for two splits that share an n-gram, with those of their classes that have it and are of use to the other: not all connected
    # already, and of fitting length. A split is bounded, and so are these lists.
    member = F.struct("cls", "comp", "n")
    split = at.groupBy("g", "hub").agg(F.collect_list(member).alias("own"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    one, two = split.select("g", *[F.col(c).alias(f"a_{c}") for c in split.columns[1:]]), split.select("g", *[F.col(c).alias(f"b_{c}") for c in split.columns[1:]])
    met = one.join(two, "g").where(f"a_hub < b_hub and (a_low <> a_high or b_low <> b_high or a_low <> b_low) and 100 * a_most >= {percent} * b_least and 100 * b_most >= {percent} * a_least")
    useful = lambda x, o: ((x["comp"] != F.col(f"{o}_low")) | (x["comp"] != F.col(f"{o}_high"))) & (100 * x["n"] >= percent * F.col(f"{o}_least")) & (100 * F.col(f"{o}_most") >= percent * x["n"])
    each = lambda of, o, hub: F.transform(F.filter(f"{of}_own", lambda x: useful(x, o)), lambda x: F.struct(x["cls"].alias("cls"), F.col(hub).alias("hub"), x["comp"].alias("comp")))
    both = met.select(F.col("a_hub").alias("ga"), F.col("b_hub").alias("gb"), F.concat(each("a", "b", "a_hub"), each("b", "a", "b_hub")).alias("own"))
    pairs = both.groupBy("ga", "gb").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own")).select("ga", "gb", F.inline("own"))
    far = meet(pairs)

    # 5. Components; a document with several rows ties its classes together.
    member = full.join(classes.select("s1", "s2", "cls"), ["s1", "s2"]).select("doc_id", "cls")
    several = member.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("doc_id", "a")
    twice = member.join(several, "doc_id").where("a <> cls").select("a", F.col("cls").alias("b"))
    label = connected(scratch.keep(near.unionByName(far).unionByName(twice), "links"))
    low = label.join(classes.select(F.col("cls").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("low"))
    named = sets.join(classes.select("s1", "s2", "cls", "rep"), ["s1", "s2"], "left").join(label.join(low, "component"), F.col("cls") == F.col("node"), "left")
    scratch.drop("alive", "grams", "tokens", "led", "hubs", "near", "placed", "open", "links")
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "rep"))).otherwise(F.col("doc_id")).alias("component_id"))
