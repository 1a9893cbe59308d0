"""Each license header gives its own license and no other; two that are both there are both reported."""

from ledgerline.llm.licenses import TEXTS, scan


def test_each_header_gives_its_own_license(spark):
    rows = [(i, f"Some words before it. {text} And some words after.") for i, (_, text) in enumerate(TEXTS)]
    both = [t for n, t in TEXTS if n in ("gpl-3.0", "agpl-3.0")]
    rows += [(100, " -- ".join(both)), (101, None), (102, "")]
    found = {}
    for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    assert found == {**{i: {name} for i, (name, _) in enumerate(TEXTS)}, 100: {"gpl-3.0", "agpl-3.0"}}
