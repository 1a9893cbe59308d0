"""Idempotent reprocessing: what a run has to do, given a ledger of what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(documents: DataFrame, ledger: DataFrame, reader: str) -> DataFrame:
    """document, disposition, version: skip what this reader has done (a refusal is done), reprocess what only others have, process the rest.

    The ledger has document, reader, version, refused and seq, which orders its entries.
    """
    own = ledger.where(F.col("reader") == reader).groupBy("document").agg(F.max_by("version", "seq").alias("own_version"), F.lit(True).alias("done"))
    any_ = ledger.groupBy("document").agg(F.max_by("version", "seq").alias("last_version"), F.lit(True).alias("known"))
    joined = documents.select("document").distinct().join(own, "document", "left").join(any_, "document", "left")
    return joined.select("document", F.when(F.col("done"), "skip").when(F.col("known"), "reprocess").otherwise("process").alias("disposition"), F.when(F.col("done"), F.col("own_version")).otherwise(F.col("last_version")).alias("version"))


def summary(planned: DataFrame) -> DataFrame:
    return planned.groupBy("disposition").agg(F.count("*").alias("documents"))


def batches(planned: DataFrame, size: int) -> DataFrame:
    """Work only, in batches of about `size` by a hash of the document: a document's batch depends on nothing but itself and the number of batches."""
    work = planned.where("disposition <> 'skip'")
    n = max(1, -(-work.count() // size))
    return work.withColumn("batch", F.pmod(F.xxhash64("document"), F.lit(n)))


def record(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger with new entries; an entry that is there already is not added again."""
    return ledger.unionByName(done.join(ledger.select("document", "reader").distinct(), ["document", "reader"], "left_anti"))
