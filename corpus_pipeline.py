"""A training-corpus pipeline over `documents`: five stages, each one operator of ledgerline.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's `docs`.
All but the last keep the columns of `documents`; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.decontam import contained
from ledgerline.llm.langid import identify
from ledgerline.llm.ngram_join import ngram_join
from ledgerline.llm.packing import pack
from ledgerline.shared import Scratch, small
from ledgerline.llm.substrings import dedup_substrings

#: SQL cannot express the language stage; tests hold each stage against a brute-force version on its own input.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The documents whose doc_id is not in `gone` (doc_id); a null doc_id stays."""
    gone = Scratch(docs.sparkSession, name).keep(gone.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct(), "gone")
    return docs.join(small(gone, gone.count(), 32), "doc_id", "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those that language ID rejects as like none of the languages."""
    kept = F.struct(*[F.col(c) for c in docs.columns]).alias("kept")
    found = identify(docs.select("doc_id", "text", "lang", kept), carry=("kept",), reject=True)
    return found.where("lang_pred <> 'und'").select("kept.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of linked documents.

    Of rows that repeat a doc_id those with different texts stay; of equal texts the row that comes first by all its columns.
    """
    kept = _without(docs, ngram_join(docs).where("component_id <> doc_id").select("doc_id"), "near-duplicates")
    twice = kept.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    twice = Scratch(spark, "near-duplicates").keep(twice, "twice")
    again = twice.count()
    if not again:
        return kept
    first = Window.partitionBy("doc_id", "text").orderBy(*[F.asc_nulls_first(c) for c in docs.columns])
    rows = kept.join(small(twice, again, 32), "doc_id", "left_semi").withColumn("__row", F.row_number().over(first)).where("__row = 1")
    return kept.join(small(twice, again, 32), "doc_id", "left_anti").select(*docs.columns).unionByName(rows.select(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 35 words and more that occur elsewhere; a text that loses nothing stays as it is."""
    cut = dedup_substrings(docs, carry=tuple(docs.columns))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, contained(docs, items).select("doc_id"), "benchmark-leaks")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences, sources in their proportions."""
    return pack(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; the last stage's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
