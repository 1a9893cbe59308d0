"""The search index: order, filters, corrections, lost writers."""

import datetime

import pytest

from ledgerline.operators import search

FIELDS = "document string, version string, extracted_on timestamp, document_type string, field string, value string, published boolean, queued_because string"


def fields(spark, *rows):
    return spark.createDataFrame([(d, v, datetime.datetime(2024, 1, on), kind, f, value, published, None) for d, v, on, kind, f, value, published in rows], FIELDS)


ROWS = [
    ("a", "a1", 1, "invoice", "party", "Kodak Trading Ltd", True), ("a", "a1", 1, "invoice", "notes", "kodak secret", True), ("a", "a2", 5, "invoice", "party", "Kodak Lens Trading", True),
    ("b", "b1", 5, "bill", "party", "Lens, lens & more", True), ("c", "c1", 3, "bill", "party", "kodak", False), ("d", "d1", 2, "bill", "party", "other", True),
]


def test_search(spark, tmp_path):
    index = search.SearchIndex(spark, str(tmp_path / "i"))
    assert index.search("kodak").collect() == []
    docs = search.searchable(fields(spark, *ROWS), ("party",))
    assert index.publish(docs) == 5 and index.publish(docs) == 0
    found = index.search("LENS kodak").collect()
    assert [r["version"] for r in found] == ["a2", "b1", "a1"] or [r["version"] for r in found] == ["b1", "a2", "a1"]
    assert found[0]["score"] >= found[1]["score"] and {r["total"] for r in found} == {3} and not found[0]["truncated"]
    assert [r["version"] for r in index.search("kodak lens", kind="bill").collect()] == ["b1"]
    (first,) = index.search("kodak lens", hits=0).collect()
    assert first["truncated"] and first["total"] == 3
    assert [r["version"] for r in index.search("C").collect()] == ["c1"] and index.search("secret").collect() == []
    with pytest.raises(ValueError):
        index.search(" , ")


def test_a_lost_segment_is_made_again(spark, tmp_path):
    import shutil

    index = search.SearchIndex(spark, str(tmp_path / "i"))
    index.publish(search.searchable(fields(spark, *ROWS[:3]), ("party",)))
    wanted = sorted(map(tuple, index.scores("kodak trading").collect()))
    shutil.rmtree(tmp_path / "i/segments")
    assert wanted and sorted(map(tuple, search.SearchIndex(spark, str(tmp_path / "i")).scores("kodak trading").collect())) == wanted
