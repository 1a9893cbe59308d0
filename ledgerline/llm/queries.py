"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .template_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .attribution import attribute_tokens

    return attribute_tokens(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold_of, identify

    found = identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contained

    return contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold_of
    from .toxicity import toxicity

    found = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turns import damage, repair

    return repair(damage(_table(spark, sf_dir, "conversations")))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold_of
    from .quality import quality

    found = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    vectors = _table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_ngram_join": op10_ngram_join,
    "op11_turn_repair": op11_turn_repair,
    "op12_quality": op12_quality,
    "op13_hard_negatives": op13_hard_negatives,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"


def _notices() -> str:
    from .licenses import NOTICES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in NOTICES)



def _turn_repair() -> str:
    """Row by row over whole paths: each of the four states holds the least (cost, audit, text) that ends there."""
    crc = "list_reduce(flatten(list_transform(range(1, len(k) + 1), lambda i: [ascii(k[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END, 4294967295::BIGINT)"
    space = r"[\x20\x09-\x0D]"
    # state: what may follow it, with the turns put in between; 1 none, 2 s, 3 u, 4 a
    put = {"u": "'user:'", "a": "'assistant:'"}
    legal = {(1, 2): "", (1, 3): "", (1, 4): "u", (2, 3): "", (2, 4): "u", (3, 3): "a", (3, 4): "", (4, 3): "", (4, 4): "u"}

    def step(to: int) -> str:
        options = [f"CASE WHEN p[{to}] IS NOT NULL THEN {{'c': p[{to}].c + 3, 'a': p[{to}].a || 'D', 't': p[{to}].t}} END"]
        for (state, end), between in legal.items():
            if end != to:
                continue
            before = "".join(f", {put[x]}" for x in between)
            for letter, when, price, text in (("K", f"initial = '{' sua'[to - 1]}'", 0, "role || ':' || text"), ("R", f"{to} > 2 AND initial <> '{' sua'[to - 1]}'", 2, f"{'null' if to < 3 else put['ua'[to - 3]]} || text")):
                items = f"list_concat(p[{state}].t, [{(before + ', ' + text)[2:]}])"
                options.append(f"CASE WHEN p[{state}] IS NOT NULL AND stays AND {when} THEN {{'c': p[{state}].c + {2 * len(between) + price} + truncated::INTEGER, 'a': p[{state}].a || '{'I' * len(between)}{letter}', 't': {items}}} END")
        return "list_min(list_filter([" + ",\n ".join(options) + "], lambda x: x IS NOT NULL))"

    ends = {1: "", 2: "ua", 3: "a", 4: ""}
    last = ", ".join(f"CASE WHEN p[{s}] IS NOT NULL THEN {{'c': p[{s}].c + {2 * len(more)}, 'a': p[{s}].a || '{'I' * len(more)}', 't': list_concat(p[{s}].t, [{', '.join(put[x] for x in more)}]::VARCHAR[])}} END" for s, more in ends.items())
    return f"""WITH RECURSIVE k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({crc}, 4294967295) % 20 AS kind FROM k),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS place, regexp_replace(text, '{space}+$', '') AS bare, role[1] AS initial FROM a),
g AS (SELECT *, bare = '' AS blank, bare <> '' AND again > 1 AS duplicate, bare <> '' AND again = 1 AND bare[-1] NOT IN ('.', '!', '?') AS truncated, bare <> '' AND again = 1 AS stays, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (place > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS rows FROM g GROUP BY conv_id),
w(conv_id, place, p) AS (SELECT conv_id, 0::BIGINT, [{{'c': 0, 'a': '', 't': []::VARCHAR[]}}, NULL, NULL, NULL] FROM n
UNION ALL SELECT w.conv_id, g.place, [{step(1)},
{step(2)},
{step(3)},
{step(4)}] FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.place = w.place + 1),
z AS (SELECT w.conv_id, list_min(list_filter([{last}], lambda x: x IS NOT NULL)) AS b FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.rows = w.place)
SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
coalesce(z.b.c, 0)::BIGINT AS cost, coalesce(z.b.a, '') AS audit, sha256(coalesce(array_to_string(z.b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLES: dict[str, str] = {
    "op5_decontamination": f"""WITH d AS (SELECT doc_id, unnest({_SHINGLES}) AS g FROM (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents)),
i AS (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark)), e AS (SELECT item_id, len(s) AS n_item, unnest(s) AS g FROM i)
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM d JOIN e USING (g) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item""",
    "op6_license_scan": f"""WITH t(license, text) AS (VALUES {_notices()}), d AS (SELECT doc_id, unnest(s) AS g FROM (SELECT doc_id, {_SHINGLES} AS s, len(w) AS n FROM (SELECT doc_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM documents)) WHERE n >= 5),
e AS (SELECT license, text, len(s) AS n_template, unnest(s) AS g FROM (SELECT license, text, {_SHINGLES} AS s FROM (SELECT license, text, {_WORDS.format("lower(text)")} AS w FROM t) WHERE len(w) >= 5))
, o AS (SELECT license, text, list(g) AS own FROM e GROUP BY license, text),
f AS (SELECT x.*, own FROM (SELECT doc_id, license, text, n_template, count(*) AS n_shared, list(g) AS hit FROM d JOIN e USING (g) GROUP BY doc_id, license, text, n_template HAVING 100 * count(*) >= 80 * n_template) x JOIN o USING (license, text))
SELECT doc_id, license, n_template, n_shared FROM f t WHERE NOT EXISTS (SELECT 1 FROM f u WHERE u.doc_id = t.doc_id AND (u.n_shared * t.n_template > t.n_shared * u.n_template OR (u.n_shared * t.n_template = t.n_shared * u.n_template AND u.n_shared > t.n_shared))
AND (len(list_filter(t.own, lambda s: NOT list_contains(u.own, s))) = 0 OR 100 * len(list_filter(t.hit, lambda s: NOT list_contains(u.own, s))) < 80 * len(list_filter(t.own, lambda s: NOT list_contains(u.own, s)))))""",
    "op7_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), x AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS k, w FROM w WHERE len(w) >= 35), y AS (SELECT doc_id, k, array_to_string(w[k:k + 34], ' ') AS s FROM x),
hit AS (SELECT doc_id, k FROM y JOIN (SELECT s FROM y GROUP BY s HAVING count(*) > 1) USING (s)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w),
marked AS (SELECT e.doc_id, e.word, e.k, coalesce(max(h.k IS NOT NULL) OVER (PARTITION BY e.doc_id ORDER BY e.k ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone FROM each e LEFT JOIN hit h ON h.doc_id = e.doc_id AND h.k = e.k)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(m.n_removed, 0) AS n_removed, sha256(coalesce(m.kept, '')) AS kept_sha256 FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id) m USING (doc_id)""",
    "op9_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_ngram_join": f"""WITH RECURSIVE s AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents)), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.other) AS component_id FROM s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s""",
    "op11_turn_repair": _turn_repair(),
    "op13_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5""",
}
