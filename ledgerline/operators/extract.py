"""Fields from words with geometry. Words have document, page, line, word (ordinal), text, confidence and a box as left, top, width, height."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area, box, intersection_area
from ..functions.text import normalise, spelt
from .captions import hits

#: How far below a caption its value may lie (in caption heights), and how far to the left and right of the caption's left edge.
BELOW, LEFT, RIGHT = 3.2, -0.012, 0.34
SAME_LINE = 0.6
LEAST_SIMILARITY = 0.72
#: Rules by which values and words are made equal when a value is located, and the columns of words that this needs.
LOCATING = ("unicode", "whitespace", "case", "diacritics", "separators")
NEAR = ("document", "page", "line", "word", "left", "top", "width", "height", "targets")


def weakest(c: str) -> Column:
    """The least value of a group; null as soon as one member is null."""
    return F.when(F.count("*") == F.count(c), F.min(c))


def lines(words: DataFrame) -> DataFrame:
    """Lines of words: text in reading order, hull, weakest confidence, number of words. A reader without need of the text gathers no words."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ")
    right, bottom = F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height"))
    return words.groupBy("document", "page", "line").agg(text.alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), (right - F.min("left")).alias("width"), (bottom - F.min("top")).alias("height"), weakest("confidence").alias("confidence"), F.count("*").alias("words"))


def anchors(words: DataFrame, captions: DataFrame, least: float = LEAST_SIMILARITY, documents: DataFrame | None = None) -> DataFrame:
    """Each caption's best run on each page, see captions.hits; of equally similar ones the first in order of line, word and length."""
    best = F.max_by(F.struct("line", "left", "top", "width", "height", "similarity"), F.struct("similarity", -F.col("line"), -F.col("word"), -F.col("n")))
    return hits(words, captions, least, documents).groupBy("document", "page", "field").agg(best.alias("b")).select("document", "page", "field", "b.*")


def values_below(anchor: DataFrame, words: DataFrame) -> DataFrame:
    """The words on the line printed below each caption, left to right.

    A word is below if its middle is within BELOW caption heights of the caption's bottom and its left edge within LEFT and RIGHT of the caption's. The line is the topmost
    such word's: what starts within SAME_LINE of the greater of the two heights.
    """
    w = words.select("document", "page", "line", "word", "text", F.col("left").alias("wl"), F.col("top").alias("wt"), F.col("height").alias("wh"), "confidence")
    base, middle = F.col("top") + F.col("height"), F.col("wt") + F.col("wh") / 2
    band = (middle >= base) & (middle <= base + BELOW * F.col("height")) & (F.col("wl") >= F.col("left") + LEFT) & (F.col("wl") <= F.col("left") + RIGHT)
    met = anchor.select("document", "page", "field", "left", "top", "height").join(w, ["document", "page"]).where(band)
    topmost = F.first(F.struct("wt", "wh")).over(Window.partitionBy("document", "page", "field").orderBy("wt", "line", "word"))
    near = F.abs(F.col("wt") - F.col("first.wt")) <= SAME_LINE * F.greatest("height", "first.wh")
    first = met.withColumn("first", topmost).where(near)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wl", "line", "word", "text"))), lambda x: x["text"]), " ")
    return first.groupBy("document", "page", "field").agg(text.alias("value"), F.when(F.count("*") == F.count("confidence"), F.min("confidence")).alias("confidence"))


def first_page(anchor: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Per document and field, the value on the first page that has one; else the best-anchored miss. Without `values` the anchors have them, as pages.read gives them."""
    met = anchor.select("document", "page", "field", "similarity", "value", "confidence") if values is None else anchor.select("document", "page", "field", "similarity").join(values, ["document", "page", "field"], "left")
    order = Window.partitionBy("document", "field").orderBy(F.col("value").isNull(), F.when(F.col("value").isNotNull(), F.col("page")), F.desc("similarity"), "page")
    return met.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def key(c: Column) -> Column:
    """What locating compares: text without case, marks on letters and separators."""
    return normalise(c, list(LOCATING))


def _may_lie_in(own: list[str], linked: list[bool], targets: str) -> list[bool]:
    """Whether each word can be part of a run that equals a target, by the word itself and its known neighbours; targets stand between null characters.

    `linked` says whether a word follows the one before it in its line without a gap. Never false for a word of such a run.
    """
    out = []
    for i, k in enumerate(own):
        may = k in targets
        if may and linked[i]:
            may = f"\0{k}" in targets or own[i - 1] + k in targets
        if may and i + 1 < len(own) and linked[i + 1]:
            may = f"{k}\0" in targets or k + own[i + 1] in targets
        out.append(may)
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `key`, and drops the words that no run can use; words of one document need not come together, but more are dropped where they do.

    A word that cannot lie in a run parts those around it, so it stays, with a null key, unless the one before it in its line came just before it and parts them as well.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        coded = batch.column("text").dictionary_encode()
        spelled = [spelt(x, LOCATING) for x in coded.dictionary.to_pylist()]
        keys = [spelled[i] for i in coded.indices.to_pylist()]
        documents = batch.column("document").dictionary_encode().indices.to_numpy()
        page, line, word = (batch.column(c).cast(pa.int64()).fill_null(-(1 << 62)).to_numpy() for c in ("page", "line", "word"))
        fresh = np.append(True, documents[1:] != documents[:-1])
        linked = ~fresh & np.append(False, (page[1:] == page[:-1]) & (line[1:] == line[:-1]) & (word[1:] == word[:-1] + 1))
        follows, may = linked.tolist(), []
        ends = [*np.flatnonzero(fresh).tolist(), n]
        for at, to in zip(ends, ends[1:]):
            targets = "\0" + "".join(t["key"] + "\0" for t in batch.column("targets")[at].as_py() or () if t["key"])
            may += _may_lie_in(keys[at:to], follows[at:to], targets)
        good = np.array(may)
        stay = pa.array(good | ~linked | np.append(False, good[:-1]))
        marked = pa.array([k if x else None for k, x in zip(keys, may)], pa.string())
        kept = pa.RecordBatch.from_arrays([*(batch.column(c) for c in NEAR), marked], names=[*NEAR, "key"])
        yield kept.filter(stay)


def near(words: DataFrame, targets: str) -> DataFrame:
    """The words that may lie in a run that equals one of their row's targets, and words with a null key that part them; see _near."""
    own = words.where("document is not null and text is not null").select(*NEAR[:-1], F.col(targets).alias("targets"), "text")
    kinds = {**dict(own.dtypes), "key": "string"}
    return own.mapInArrow(_near, ", ".join(f"{c} {kinds[c]}" for c in (*NEAR, "key"))).withColumn("targets", F.when(F.col("key").isNotNull(), F.col("targets")))


def locate(words: DataFrame, wanted: DataFrame | str, most: int = 12) -> DataFrame:
    """Where each wanted value is printed first: page, line of its first word and hull of the first run of 1 to `most` words of a page that equals it.

    `wanted` is a table (document, field, value), or the name of a column of `words` that holds the wanted values of the word's document as an array of (field, key), made
    by `key`. Values and words are compared without case, marks on letters and separators. Words are held against their document's values as they
    come, and those that can lie in no run go no further: with a column nothing else is shuffled, with a table the words are, once. Runs that begin at a word are joined from
    the words after it, so memory does not grow with a line or a page. A value that is empty then, or that is nowhere, has no row.
    """
    if isinstance(wanted, str):
        met, column = words, wanted
    else:
        keyed = wanted.select("document", "field", key(F.col("value")).alias("key")).where("key <> ''")
        met, column = words.join(keyed.groupBy("document").agg(F.collect_set(F.struct("field", "key")).alias("__wanted")), "document"), "__wanted"
    own = near(met, column).withColumn("box", F.struct("left", "top", "width", "height"))
    page = Window.partitionBy("document", "page").orderBy("line", "word")
    # Past the page's end, and at a word that parts runs, there is no key: longer runs are null.
    after = own.select("document", "page", "line", "word", "targets", *[F.lead("key", i).over(page).alias(f"k{i}") for i in range(most)], F.array(*[F.lead("box", i).over(page) for i in range(most)]).alias("boxes"))
    runs = F.array(*[F.concat(*[f"k{i}" for i in range(n)]) for n in range(1, most + 1)])
    # Of runs of equal text the shortest comes first.
    each = after.where("k0 is not null").select("document", "page", "line", "word", "boxes", runs.alias("runs"), F.explode("targets").alias("t")).where("t.key <> ''")
    hit = each.select("document", "page", "line", "word", "boxes", F.col("t.field").alias("field"), F.array_position("runs", F.col("t.key")).cast("int").alias("n")).where("n > 0")
    first = F.min_by(F.struct("page", "line", F.slice("boxes", F.lit(1), F.col("n")).alias("boxes")), F.struct("page", "line", "word", "n"))
    found = hit.groupBy("document", "field").agg(first.alias("b")).select("document", "field", "b.*")
    left, top = F.array_min(F.transform("boxes", lambda x: x["left"])), F.array_min(F.transform("boxes", lambda x: x["top"]))
    width, height = F.array_max(F.transform("boxes", lambda x: x["left"] + x["width"])) - left, F.array_max(F.transform("boxes", lambda x: x["top"] + x["height"])) - top
    return found.select("document", "field", "page", "line", left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height"))


def place_proposals(proposals: DataFrame, words: DataFrame) -> DataFrame:
    """Proposals (document, field, value, refused) with the place where their value is printed first: page, line, left, top, width, height.

    All are null where it is not printed, or the proposal is refused: such a value has no provenance and has to be queued.
    """
    wanted = proposals.where("refused is null and value is not null").select("document", "field", "value").distinct()
    return proposals.join(locate(words, wanted), ["document", "field"], "left")


def words_in(words: DataFrame, boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """document, page, name, text of the words that lie in each box by at least `share` of their area."""
    w, b = box(F.col("left"), F.col("top"), F.col("width"), F.col("height")), F.col("region")
    met = words.join(boxes, ["document", "page"]).where(F.coalesce(intersection_area(w, b) / area(w), F.lit(0.0)) >= share)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "word", "text"))), lambda x: x["text"]), " ")
    return met.groupBy("document", "page", "name").agg(text.alias("text"))


def group_rows(words: DataFrame, within: float = 0.0035) -> DataFrame:
    """Adds `row`: words in order of top, where a word more than `within` below the row's first word begins a new row; null where top is.

    Each row's limit hangs on its own first word, so rows are found by a fold, over a page's distinct tops alone; a word's row is the last that begins at or above it.
    """
    starts = F.aggregate("tops", F.array().cast("array<double>"), lambda rows, top: F.when((F.size(rows) == 0) | (top - F.element_at(rows, -1) > within), F.concat(rows, F.array(top))).otherwise(rows))
    pages = words.where("top is not null").groupBy("document", "page").agg(F.array_sort(F.collect_set(F.col("top").cast("double"))).alias("tops")).select("document", "page", starts.alias("__starts"))
    row = F.when(F.col("top").isNotNull(), F.size(F.filter("__starts", lambda s: s <= F.col("top"))) - 1)
    return words.join(pages, ["document", "page"], "left").withColumn("row", row.cast("int")).drop("__starts").select(*words.columns, "row")
