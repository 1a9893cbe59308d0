"""Search over published values: an inverted index keyed by version, and relevance by BM25.

The documents of an index are a table with a log (commits.Table), keyed by version, so a version is indexed once whoever brings it, and a correction stands beside what
it corrects. Each commit has a segment of postings of its own, (field, term, version, tf, length) in folders by bucket of the term, and the numbers and
lengths of each field's values; a segment is derived from its commit alone and made by whoever finds it missing, so an index whose writer was lost completes itself.
A search reads the buckets of its own terms only.

A value's score is BM25 over the terms asked for (k1 = 1.2, b = 0.75, document frequencies and mean lengths by field), a document's that of its best value. The newest come first, and of
one time the best. Only whitelisted fields and the document's id are in the index, so nothing else can be found or returned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Table

K1, B = 1.2, 0.75
BUCKETS = 64
#: Most documents of an answer.
MOST = 20


def searchable(fields: DataFrame, whitelist: tuple[str, ...]) -> DataFrame:
    """version, document, extracted_on, document_type, values (a map of the published values of the whitelisted fields), published_count and queued_count.

    Fields are (document, version, extracted_on, document_type, field, value, published, queued_because). A version without a published value has an empty map.
    """
    good = F.col("published") & (F.coalesce(F.col("value"), F.lit("")) != "") & F.col("field").isin(*whitelist)
    pair = F.when(good, F.struct("field", "value"))
    made = fields.where("version is not null and document is not null").groupBy("version").agg(
        F.min(F.col("document").cast("string")).alias("document"), F.max("extracted_on").alias("extracted_on"), F.min("document_type").alias("document_type"),
        F.map_from_entries(F.array_sort(F.collect_set(pair))).alias("values"), F.count(pair).alias("published_count"), F.count("queued_because").alias("queued_count"),
    )
    return made


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


class SearchIndex:
    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at, self.table = spark, at.rstrip("/"), Table(spark, f"{at}/documents", ["version"])

    def publish(self, documents: DataFrame) -> int:
        """Index what `searchable` made; how many versions were new."""
        new = self.table.append(documents)
        self.catch_up()
        return new

    def _segment(self, data: str) -> str:
        return f"{self.at}/segments/{data}"

    def catch_up(self) -> int:
        """Make the segments that commits lack; how many."""
        files, path, made = self.table._files, self.table._path, 0
        entries = [e for e in self.table.entries() if e["data"]]
        for entry in entries:
            at = self._segment(entry["data"])
            if files.exists(path(f"{at}/fields/_SUCCESS")):
                continue
            rows = self.table._rows([entry], self.table.schema(entries))
            every = F.map_concat("values", F.create_map(F.lit("document_id"), F.col("document")))
            values = rows.select("version", F.explode(every).alias("field", "value")).select("version", "field", terms(F.col("value")).alias("terms")).withColumn("length", F.size("terms").cast("long"))
            postings = values.select("version", "field", "length", F.explode("terms").alias("term")).groupBy("field", "term", "version", "length").agg(F.count("*").alias("tf"))
            bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
            postings.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings")
            values.groupBy("field").agg(F.count("*").alias("n"), F.sum("length").alias("length")).write.mode("overwrite").parquet(f"{at}/fields")
            made += 1
        return made

    def scores(self, asked: str) -> DataFrame:
        """version, field and score of every value that holds one of the terms asked for."""
        wanted = sorted(set(re.findall(r"[^\W_]+", asked.lower())))
        if not wanted:
            raise ValueError("a search needs a term")
        self.catch_up()
        segments = [self._segment(e["data"]) for e in self.table.entries() if e["data"]]
        if not segments:
            return self.spark.createDataFrame([], "version string, field string, score double")
        read = lambda schema, name: self.spark.read.schema(schema).option("basePath", f"{self.at}/segments").parquet(*[f"{s}/{name}" for s in segments])
        kind = self.table.schema()["version"].dataType.simpleString()
        own = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        buckets = sorted(r[0] for r in self.spark.createDataFrame([(w,) for w in wanted], "term string").select(own).distinct().collect())
        postings = None
        for segment in segments:
            part = self.spark.read.schema(f"field string, term string, version {kind}, length long, tf long, bucket int").parquet(f"{segment}/postings")
            part = part.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*wanted))
            postings = part if postings is None else postings.unionByName(part)
        fields = read("field string, n long, length long", "fields").groupBy("field").agg(F.sum("n").alias("n"), F.sum("length").alias("all"))
        # A row for each field and term asked for: the fields are those of a contract.
        df = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
        weight = df.join(fields, "field").select("field", "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (F.col("all") / F.col("n")).alias("mean"))
        met = postings.join(F.broadcast(weight), ["field", "term"])
        tf = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        return met.groupBy("version", "field").agg(F.sum(F.col("idf") * tf).alias("score"))

    def search(self, asked: str, hits: int = MOST, kind: str | None = None) -> DataFrame:
        """version, document, extracted_on, document_type, values, field (the best value's), score, total and truncated of the first 1 to MOST documents."""
        size = min(max(hits, 1), MOST)
        best = self.scores(asked).groupBy("version").agg(F.max_by(F.struct("score", "field"), F.struct("score", "field")).alias("b")).select("version", F.col("b.field").alias("field"), F.col("b.score").alias("score"))
        documents = self.table.read() if self.table.version() else None
        if documents is None:
            return self.spark.createDataFrame([], "version string, document string, extracted_on timestamp, document_type string, values map<string,string>, field string, score double, total long, truncated boolean")
        found = documents.select("version", "document", "extracted_on", "document_type", "values").join(best, "version")
        if kind is not None:
            found = found.where(F.col("document_type") == kind)
        total = found.agg(F.count("*").alias("total"))
        first = found.orderBy(F.desc("extracted_on"), F.desc("score"), "version").limit(size)
        return first.join(F.broadcast(total)).withColumn("truncated", F.col("total") > size)
