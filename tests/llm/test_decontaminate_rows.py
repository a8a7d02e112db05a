from collections import Counter

import pytest

from spanmill.llm.decontaminate import decontaminate

ITEM = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize("action", ["documents", "spans"])
def test_rows_are_decided_alike_on_both_sides_of_the_bound(spark, action):
    """Rows that share a doc_id, or have none, stand for themselves."""
    rows = [(1, "clean"), (1, f"a {ITEM} b"), (None, "clean too"), (None, f"c, {ITEM}."), (2, ITEM), (2, ITEM), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, spans string, __uid int, __spans int")
    bench = spark.createDataFrame([(7, ITEM), (8, "short item")], "item_id long, text string")
    want, got = (decontaminate(docs, bench, action=action, max_broadcast_bytes=bound) for bound in (1 << 20, 0))
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    texts = {r.text for r in got.collect()}
    assert texts == ({"clean", "clean too", None, ""} | ({"a  b", "c, ."} if action == "spans" else set()))
