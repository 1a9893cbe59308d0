"""Rows that repeat a document, many times over."""

import pytest

from ledgerline.llm.substrings import dedup_substrings


@pytest.mark.parametrize("doc_id", [7, None])
def test_repeated_rows_are_copies(spark, doc_id):
    """4,000 rows of one document lose all words; what it shares with another goes there too, the rest stays."""
    text = " ".join(f"w{i}" for i in range(200))
    part = " ".join(["a", *[f"w{i}" for i in range(50, 90)], "b"])
    short = " ".join(f"s{i}" for i in range(34))
    rows = spark.range(4000).selectExpr(f"cast({'null' if doc_id is None else doc_id} as bigint) AS doc_id", f"'{text}' AS text")
    others = spark.createDataFrame([(1, part), (2, "alone " * 3), (3, None), (3, None), (4, short), (4, short), (5, text + " more")], "doc_id long, text string")
    found = dedup_substrings(rows.unionByName(others)).groupBy("doc_id", "n_words", "n_removed", "kept_text").count().collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"], r["count"]) for r in found} == {
        (doc_id, 200, 200, "", 4000), (1, 42, 40, "a b", 1), (2, 3, 0, "alone alone alone", 1), (3, 0, 0, "", 2), (4, 34, 0, short, 2), (5, 201, 200, "more", 1),
    }
