"""Readings of pages: recordings, OCR tables and service responses, as words with geometry.

Every reader has an explicit schema and fails on rows that do not fit; what a source refuses becomes rows of refusals or an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import box, valid

_WORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("box", T.ArrayType(T.DoubleType()))])
_LINE = T.StructType([T.StructField("confidence", T.DoubleType()), T.StructField("words", T.ArrayType(_WORD))])
PAGE = T.StructType([
    T.StructField("shipment", T.StringType()), T.StructField("document", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("language", T.StringType()), T.StructField("language_confidence", T.DoubleType()), T.StructField("reader", T.StringType()), T.StructField("lines", T.ArrayType(_LINE))])
PAGE_KEY = ("shipment", "document", "page")


def recording(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a (gzipped) JSON-lines recording."""
    return spark.read.schema(PAGE).option("mode", "FAILFAST").json(path)


def verified_recording(spark: SparkSession, path: str, digests: dict[str, str]) -> DataFrame:
    """A recording whose files have the stated SHA-256 digests. Files are digested where they lie, by the tasks that read them."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("digest"))
    stated = spark.createDataFrame(list(digests.items()), "file string, stated string")
    wrong = files.join(F.broadcast(stated), "file", "full_outer").where(~F.col("digest").eqNullSafe(F.col("stated"))).select("file").limit(5).collect()
    if wrong:
        raise ValueError(f"digest mismatch: {[r['file'] for r in wrong]}")
    return recording(spark, path)


def write_recording(pages: DataFrame, path: str) -> None:
    """Pages in key order within range partitions, compressed; one reader only."""
    readers = pages.select("reader").distinct().limit(2).count()
    if readers > 1:
        raise ValueError("a recording has one reader")
    pages.repartitionByRange(*PAGE_KEY).sortWithinPartitions(*PAGE_KEY).write.mode("errorifexists").option("compression", "gzip").json(path)


def merged(shards: list[DataFrame]) -> DataFrame:
    """The union of shards; several readers or a page that occurs twice are refused."""
    every = shards[0]
    for shard in shards[1:]:
        every = every.unionByName(shard)
    if every.select("reader").distinct().limit(2).count() > 1:
        raise ValueError("shards of several readers")
    if every.groupBy(*PAGE_KEY).count().where("count > 1").limit(1).count():
        raise ValueError("a page is in several shards")
    return every


def words(pages: DataFrame) -> DataFrame:
    """One row per word of recorded pages; words off the page are left out."""
    lines = pages.select(F.concat_ws("/", "shipment", "document").alias("document"), "reader", "page", "language", F.posexplode("lines").alias("line", "l"))
    w = lines.select("document", "reader", "page", "language", "line", F.posexplode("l.words").alias("word", "w"))
    b = F.col("w.box")
    out = w.select("document", "reader", "page", "language", "line", "word", F.col("w.text").alias("text"), F.col("w.confidence").alias("confidence"), *[b[i].alias(c) for i, c in enumerate(("left", "top", "width", "height"))])
    return out.where((F.col("text") != "") & valid(box(F.col("left"), F.col("top"), F.col("width"), F.col("height"))))


OCR = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def ocr_table(spark: SparkSession, path: str, width: int | None = None, height: int | None = None) -> DataFrame:
    """Words of OCR tables (tab separated, no quoting): no empty text, no negative confidence, hundredths up to one, boxes on the page only.

    A page's size is that of its level-1 row; `width` and `height` stand in where a file has none, and without either a page is an error. Lines are numbered by their first word's
    place in the file.
    """
    rows = spark.read.schema(OCR).option("sep", "\t").option("quote", "").option("header", True).option("mode", "FAILFAST").csv(path).withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()})
    sizes = rows.where("level = 1").groupBy("file", "page_num").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    good = rows.where((F.trim("text") != "") & (F.col("conf") >= 0)).join(sizes, ["file", "page_num"], "left")
    unknown = F.raise_error(F.concat(F.lit("no size of page "), F.col("page_num").cast("string"), F.lit(" of "), F.col("file"))).cast("double")
    w, h = F.coalesce("w", F.lit(width), unknown), F.coalesce("h", F.lit(height), unknown)
    b = box(F.col("left") / w, F.col("top") / h, F.col("width") / w, F.col("height") / h)
    line = ["block_num", "par_num", "line_num"]
    placed = good.select("file", "at", "page_num", *line, F.col("word_num").alias("word"), F.trim("text").alias("text"), F.least(F.col("conf") / 100, F.lit(1.0)).alias("confidence"), b.alias("b")).where(valid(F.col("b")))
    first = placed.withColumn("first", F.min("at").over(Window.partitionBy("file", "page_num", *line)))
    ordinal = (F.dense_rank().over(Window.partitionBy("file", "page_num").orderBy("first")) - 1).alias("line")
    return first.select("file", F.col("page_num").alias("page"), ordinal, "word", "text", "confidence", "b.*")


_GEOMETRY = T.StructType([T.StructField("BoundingBox", T.StructType([T.StructField(c, T.DoubleType()) for c in ("Left", "Top", "Width", "Height")]))])
BLOCKS = T.StructType([T.StructField("Blocks", T.ArrayType(T.StructType([
    T.StructField("Id", T.StringType()), T.StructField("BlockType", T.StringType()), T.StructField("Text", T.StringType()), T.StructField("Confidence", T.DoubleType()), T.StructField("Page", T.IntegerType()), T.StructField("Geometry", _GEOMETRY),
    T.StructField("Relationships", T.ArrayType(T.StructType([T.StructField("Type", T.StringType()), T.StructField("Ids", T.ArrayType(T.StringType()))])))])))])


def _blocks(responses: DataFrame) -> DataFrame:
    return responses.select("document", F.posexplode(F.from_json("response", BLOCKS, {"mode": "FAILFAST"})["Blocks"]).alias("at", "b"))


def _children(blocks: DataFrame) -> DataFrame:
    lines = blocks.where("b.BlockType = 'LINE'").select("document", F.col("at").alias("line"), F.explode(F.filter("b.Relationships", lambda r: r["Type"] == "CHILD")).alias("r"))
    return lines.select("document", "line", F.posexplode("r.Ids").alias("word", "id"))


def managed_words(responses: DataFrame) -> DataFrame:
    """(document, response JSON) of block lists -> words of lines; confidences are hundredths."""
    blocks = _blocks(responses)
    own = blocks.where("b.BlockType = 'WORD'").select("document", F.col("b.Id").alias("id"), F.col("b.Text").alias("text"), (F.col("b.Confidence") / 100).alias("confidence"), F.coalesce("b.Page", F.lit(1)).alias("page"), F.col("b.Geometry.BoundingBox").alias("g"))
    return _children(blocks).join(own, ["document", "id"]).select("document", "page", "line", "word", "text", "confidence", F.col("g.Left").alias("left"), F.col("g.Top").alias("top"), F.col("g.Width").alias("width"), F.col("g.Height").alias("height"))


def unknown_children(responses: DataFrame) -> DataFrame:
    """Children that no word of the response answers to: such responses are refused."""
    blocks = _blocks(responses)
    return _children(blocks).join(blocks.where("b.BlockType = 'WORD'").select("document", F.col("b.Id").alias("id")), ["document", "id"], "left_anti")


AUTOMATION = T.StructType([
    T.StructField("text_lines", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("reading_order", T.IntegerType())]))),
    T.StructField("text_words", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("line_id", T.StringType()), T.StructField("page_index", T.IntegerType()), T.StructField("reading_order", T.IntegerType())])))])


def automation_words(responses: DataFrame) -> DataFrame:
    """Words of document automation, in order of their lines, then of reading. It does not score, whatever it reports."""
    parsed = responses.select("document", F.from_json("response", AUTOMATION, {"mode": "FAILFAST"}).alias("r"))
    lines = parsed.select("document", F.explode("r.text_lines").alias("l")).select("document", F.col("l.id").alias("line_id"), F.col("l.reading_order").alias("line"))
    w = parsed.select("document", F.explode("r.text_words").alias("w")).select("document", "w.*")
    order = Window.partitionBy("document", "page_index", "line_id").orderBy("reading_order")
    return w.join(lines, ["document", "line_id"], "left").select("document", (F.col("page_index") + 1).alias("page"), "line", (F.row_number().over(order) - 1).alias("word"), "text", F.lit(None).cast("double").alias("confidence"))


PROPOSAL = T.StructType([T.StructField("stop_reason", T.StringType()), T.StructField("content", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("input", T.MapType(T.StringType(), T.StringType()))])))])
SCORES = ("confidence", "score", "probability", "certainty")


def proposals(responses: DataFrame) -> DataFrame:
    """document, field, value, refused of a model's forced tool call: truncation, several calls and self-reported scores are refused."""
    parsed = responses.select("document", F.from_json("response", PROPOSAL, {"mode": "FAILFAST"}).alias("r"))
    calls = F.filter("r.content", lambda c: c["type"] == "tool_use")
    inputs = F.when(F.size(calls) == 1, calls[0]["input"])
    scored = F.arrays_overlap(F.map_keys(inputs), F.array(*[F.lit(s) for s in SCORES]))
    refused = F.when(F.col("r.stop_reason") == "max_tokens", "truncated").when(F.size(calls) != 1, "calls").when(scored, "self_reported_score")
    rows = parsed.select("document", refused.alias("refused"), inputs.alias("inputs"))
    good = rows.where("refused is null").select("document", F.explode("inputs").alias("field", "value")).withColumn("refused", F.lit(None).cast("string"))
    return good.unionByName(rows.where("refused is not null").select("document", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), "refused"))


LANDING = r"incoming/([a-z]{2})/([a-z_]+)/([^/]+)\.pdf$"


def landing_keys(paths: DataFrame) -> DataFrame:
    """language, document_type, document_id of landed paths; others have refused = true."""
    part = lambda i: F.nullif(F.regexp_extract("path", LANDING, i), F.lit(""))
    return paths.select("path", part(1).alias("language"), part(2).alias("document_type"), part(3).alias("document_id"), (~F.col("path").rlike(LANDING)).alias("refused"))


def merge_readings(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Pages of `primary` (document, page, reading), replaced by those of `secondary`; a page that only the second has is refused."""
    extra = secondary.join(primary, ["document", "page"], "left_anti").limit(1).count()
    if extra:
        raise ValueError("the second reading has pages that the first has not")
    return primary.join(secondary.select("document", "page", F.col("reading").alias("better")), ["document", "page"], "left").select("document", "page", F.coalesce("better", "reading").alias("reading"))


def digest_of(path: str) -> str:
    """SHA-256 of a local file, for the lists written beside recordings in tests."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def external_set(spark: SparkSession, path: str) -> DataFrame:
    """Labelled photographed pages: confidence and whether the reading was right."""
    return spark.read.parquet(path).select(F.col("confidence").cast("double"), (F.col("text") == F.col("truth")).alias("correct"))
