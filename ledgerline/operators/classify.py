"""Ranked candidates for goods: term weights, retrieval, grounding and the decision to propose or contest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def idf(notes: DataFrame, text: Column, key: str) -> DataFrame:
    """term, weight = ln((1 + N) / (1 + df)) + 1 over the notes."""
    terms = notes.select(key, F.explode(tokens(text)).alias("term"))
    n = notes.agg(F.count("*").alias("n"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n), F.lit(True)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("weight"))


def retrieve(goods: DataFrame, notes: DataFrame, weights: DataFrame, limit: int = 4) -> DataFrame:
    """goods_id, code, score, rank: goods and notes have (id, terms); the score is the shared weight over the goods' whole weight.

    Ranked by falling score, then code; zero scores never appear. The join is on terms, so a term's goods meet its notes only.
    """
    own = goods.select("goods_id", F.explode("terms").alias("term")).join(weights, "term")
    ceiling = own.groupBy("goods_id").agg(F.sum("weight").alias("ceiling"))
    shared = own.join(notes.select("code", F.explode("terms").alias("term")), "term").groupBy("goods_id", "code").agg(F.sum("weight").alias("shared"))
    scored = shared.join(ceiling, "goods_id").select("goods_id", "code", F.round(F.col("shared") / F.col("ceiling"), 4).alias("score"))
    order = Window.partitionBy("goods_id").orderBy(F.desc("score"), "code")
    return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= limit) & (F.col("score") > 0))


def distinguishing(notes: DataFrame) -> DataFrame:
    """code, term of (code, terms): the terms that not all other notes have."""
    rows = notes.select("code", F.explode("terms").alias("term"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    n = notes.agg(F.count("*").alias("n"))
    return rows.join(df, "term").join(F.broadcast(n), F.lit(True)).where(F.col("df") < F.col("n")).select("code", "term")


def grounded(proposals: DataFrame, terms: DataFrame, least: int = 2) -> DataFrame:
    """proposals (goods_id, code, text) with the number of distinguishing terms that the text contains as substrings."""
    own = terms.groupBy("code").agg(F.collect_set("term").alias("terms"))
    return proposals.join(own, "code", "left").select("goods_id", "code", F.size(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.contains(F.lower(F.col("text")), t))).alias("found")).withColumn("grounded", F.col("found") >= least)


def _ranked(candidates: DataFrame) -> Window:
    """By falling score; ties in the order of declaration where candidates have it (`place`), else by code."""
    return Window.partitionBy("goods_id").orderBy(F.desc("score"), "place" if "place" in candidates.columns else "code")


def top_candidates(candidates: DataFrame, limit: int = 3) -> DataFrame:
    """The first candidates of each of the goods, with their rank."""
    return candidates.withColumn("rank", F.row_number().over(_ranked(candidates))).where(F.col("rank") <= limit)


def universal(notes: DataFrame) -> DataFrame:
    """The terms that every note (code, terms) has."""
    rows = notes.select("code", F.explode(F.array_distinct("terms")).alias("term"))
    n = notes.agg(F.countDistinct("code").alias("n"))
    return rows.groupBy("term").agg(F.countDistinct("code").alias("df")).join(F.broadcast(n)).where("df = n").select("term")


def decide(candidates: DataFrame, least: float = 0.35, margin: float = 0.08) -> DataFrame:
    """goods_id, code, outcome of ranked (goods_id, code, score, contested): below_minimum, contested, close or proposed, in this order."""
    order = _ranked(candidates)
    top = candidates.withColumns({"__rank": F.row_number().over(order), "next": F.lead("score").over(order)}).where("__rank = 1")
    state = F.when(F.col("score") < least, "below_minimum").when(F.col("contested"), "contested").when(F.col("score") - F.coalesce("next", F.lit(0.0)) < margin, "close").otherwise("proposed")
    return top.select("goods_id", "code", "score", state.alias("outcome"))


def ngrams(text: Column) -> Column:
    """Words of two and more characters, and their neighbouring pairs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), 0)
    return F.transform(F.array(words), lambda w: F.concat(w, F.transform(F.when(F.size(w) > 1, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))))[0]


def softmax(scores: DataFrame, by: str, value: str) -> DataFrame:
    """Adds `probability` within each group, shifted by the largest value."""
    key = Window.partitionBy(by)
    e = F.exp(F.col(value) - F.max(value).over(key))
    return scores.withColumn("e", e).withColumn("probability", F.col("e") / F.sum("e").over(key)).drop("e")


def linear_scores(texts: DataFrame, weights: DataFrame, intercepts: DataFrame) -> DataFrame:
    """TF-IDF (sublinear, unit length) times linear weights: texts (goods_id, text), weights (term, idf, class, coefficient), intercepts (class, intercept)."""
    tf = texts.select("goods_id", F.explode(ngrams(F.col("text"))).alias("term")).groupBy("goods_id", "term").agg((1 + F.ln(F.count("*"))).alias("tf"))
    terms = weights.select("term", "idf").distinct()
    vector = tf.join(terms, "term").select("goods_id", "term", (F.col("tf") * F.col("idf")).alias("x"))
    length = vector.groupBy("goods_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    scored = vector.join(length, "goods_id").join(weights.select("term", "class", "coefficient"), "term").groupBy("goods_id", "class").agg(F.sum(F.col("x") / F.col("length") * F.col("coefficient")).alias("score"))
    every = texts.select("goods_id").join(F.broadcast(intercepts), F.lit(True))
    return softmax(every.join(scored, ["goods_id", "class"], "left").select("goods_id", "class", (F.coalesce("score", F.lit(0.0)) + F.col("intercept")).alias("score")), "goods_id", "score")


def fit(examples: DataFrame, text: str, label: str, most_terms: int = 1 << 18, ridge: float = 0.01):
    """Word 1-2-grams in an exact vocabulary (the `most_terms` that most examples have), IDF, unit length and logistic regression as one Spark ML pipeline; returns the fitted model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, Normalizer, StringIndexer

    rows = examples.select(F.col(label).alias("__name"), ngrams(F.col(text)).alias("__terms"))
    indexer = StringIndexer(inputCol="__name", outputCol="__label", handleInvalid="keep", stringOrderType="alphabetAsc").fit(rows)
    stages = [
        indexer, CountVectorizer(inputCol="__terms", outputCol="__tf", vocabSize=most_terms), IDF(inputCol="__tf", outputCol="__weighted"), Normalizer(inputCol="__weighted", outputCol="__features"),
        LogisticRegression(maxIter=50, regParam=ridge, labelCol="__label", featuresCol="__features", predictionCol="__prediction", rawPredictionCol="__raw", probabilityCol="__probability"), IndexToString(inputCol="__prediction", outputCol="predicted", labels=indexer.labels),
    ]
    return Pipeline(stages=stages).fit(rows)


def predicted(model, rows: DataFrame, text: str, label: str | None = None) -> DataFrame:
    """The rows with `predicted`: the label that a fitted model gives each text."""
    name = F.col(label) if label else F.lit("")
    return model.transform(rows.withColumns({"__name": name, "__terms": ngrams(F.coalesce(F.col(text), F.lit("")))})).select(*rows.columns, "predicted")


def judged(examples: DataFrame, text: str, label: str, folds: int = 5) -> DataFrame:
    """fold, rows, right: each fold of the examples, dealt by a hash of text and label, predicted by a model that was fitted to the others."""
    fold = F.pmod(F.xxhash64(text, label), F.lit(folds)).cast("int")
    dealt = examples.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, label, fold.alias("fold"))
    found = None
    for n in range(folds):
        rest, own = dealt.where(F.col("fold") != n), dealt.where(F.col("fold") == n)
        if own.isEmpty() or rest.isEmpty():
            continue
        part = predicted(fit(rest, text, label), own, text, label).groupBy("fold").agg(F.count("*").alias("rows"), F.count_if(F.col("predicted") == F.col(label)).alias("right"))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else examples.sparkSession.createDataFrame([], "fold int, rows long, right long")


def save(model, figures: DataFrame, at: str) -> None:
    """Keep a fitted model with the figures by which it was judged; one that has none is not kept."""
    if figures.isEmpty():
        raise ValueError("a model is kept with its figures")
    model.write().overwrite().save(f"{at}/model")
    figures.coalesce(1).write.mode("overwrite").json(f"{at}/figures")


def kept(spark: SparkSession, at: str):
    """A kept model and its figures (fold, rows, right)."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{at}/model"), spark.read.schema("fold int, rows long, right long").json(f"{at}/figures")


def declared(candidates: DataFrame, headings: DataFrame) -> DataFrame:
    """The candidates with their heading's description and `decided` = false, as a model only proposes.

    A code that the headings do not declare is an error, since the model was fitted to other headings; so is a goods_id without
    any candidate (a row with a null code).
    """
    known = candidates.join(headings.select("code", "description", F.lit(True).alias("known")), "code", "left")
    bad = F.when(F.col("code").isNull(), F.raise_error(F.lit("no candidates"))).when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("undeclared heading "), "code")))
    return known.withColumn("code", bad.otherwise(F.col("code"))).drop("known").withColumn("decided", F.lit(False))


def restricted(candidates: DataFrame, context: DataFrame) -> DataFrame:
    """The candidates (goods_id, code, ...) whose heading the context (goods_id, code) of the goods allows."""
    return candidates.join(context.select("goods_id", "code").distinct(), ["goods_id", "code"], "left_semi")


def prior_floor(intercepts: DataFrame) -> DataFrame:
    """One row, floor: the largest probability that the model gives a text it cannot read at all, from its intercepts (class, intercept)."""
    top = intercepts.agg(F.max("intercept").alias("top"))
    return intercepts.join(F.broadcast(top), F.lit(True)).agg((1 / F.sum(F.exp(F.col("intercept") - F.col("top")))).alias("floor"))


def above_floor(scored: DataFrame, floor: DataFrame) -> DataFrame:
    """The scores (goods_id, class, probability) that tell more than the prior does."""
    return scored.join(F.broadcast(floor), F.lit(True)).where(F.col("probability") > F.col("floor")).drop("floor")
