"""Work is dealt out: no task gets what grows with the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from spanmill.functions import text as X
from spanmill.operators import evals, maintenance, traces
from spanmill.plans.catalog import QUERIES


@pytest.fixture
def plain_joins(spark):
    """Shuffled joins as they come, as over tables too large to broadcast."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k in held:
        spark.conf.unset(k)


def test_rows_without_reference_are_spread_and_whole(spark, plain_joins):
    big = "x" * 50
    rows = [(i, "small") for i in range(400)] + [(400, big), (401, big), (402, None), (403, ""), (404, "y" * 60)]
    spans, blobs = maintenance.offload(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "text", 40)
    back = maintenance.resolve(spans, blobs.where("length(value) = 50"), "text")
    assert sorted(map(tuple, back.collect())) == rows[:404] + [(404, None)]
    sizes = [r["count"] for r in back.where("text = 'small'").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 200


def test_edit_distance_is_found_once_a_row_and_exact(spark):
    rng = random.Random(3)
    text = lambda: None if rng.random() < 0.05 else "".join(rng.choice("ab é😀") for _ in range(rng.choice([0, 1, 5, 31, 64, 65, 200])))
    df = spark.createDataFrame([(text(), text()) for _ in range(400)], "output string, expected_output string")
    got = df.select(X.distance(F.col("output"), F.col("expected_output")).alias("d"), F.levenshtein("output", "expected_output").alias("want")).collect()
    assert all(r.d == r.want for r in got) and any(r.d is None for r in got) and max(r.d or 0 for r in got) > 64
    verdict = df.select(evals.levenshtein().alias("v")).select("v.value", "v.passed")
    plan = verdict._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") + plan.count("_distance(") == 1


def test_walks_up_traces_shuffle_numbers(spark, sf_dir, monkeypatch):
    """Of the tables that each step of a walk up the trees writes, none holds a row per name, or ids as text."""
    kept, save = [], traces.save
    monkeypatch.setattr(traces, "save", lambda df, name: (lambda out: kept.append((name, out)) or out)(save(df, name)))
    QUERIES["TRC-5"](spark, sf_dir)
    spans = next(out for name, out in kept if name == "forest").count()
    steps = [out for name, out in kept if name in ("forest-far", "rollup-climb")]
    assert len(steps) > 3
    for out in steps:
        assert {"trace_id", "span_id"}.isdisjoint(out.columns) and dict(out.dtypes)["node"] == "bigint" and out.count() <= spans


def test_script_shares_need_no_python_and_are_exact(spark, sf_dir):
    """SCL-9 and EVL-7: no worker holds a batch of texts, and letters are those of the plain function, for every code point."""
    for name in ("SCL-9", "EVL-7"):
        assert "Python" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    one = spark.createDataFrame([("Ünï 日本", '{"language":"de"}')], "output string, metadata string").select(evals.script().alias("v")).select("v.value", "v.passed")
    assert one._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 3 and [tuple(r) for r in one.collect()] == [(0.6, False)]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[i : i + 64])) for i in range(0, len(points), 64)]
    named = [*X.SCRIPT_BLOCKS, "ja"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", *(X.script_share(F.col("text"), F.lit(s)).alias(s) for s in named))
    assert all(r[s] == X.share(texts[r.i], s) for r in df.collect() for s in named)
    rng = random.Random(5)
    pool = [*"abc éß AB 12.\n\r\u0085×ª\0", *"я中かカ한กิअا", "😀", "\U00020000", "\U0002EBF0", "\u0301"]
    asked = ["Latin", "\t latin\u3000", "DE", "de-AT", "ja", "jawi", "Chinese", "zh-Hant", "Latin-x", "xx", "", "-", None]
    rows = [(i, None if rng.random() < 0.05 else "".join(rng.choices(pool, k=rng.choice([0, 1, 2, 40]))), rng.choice(asked)) for i in range(1500)]
    got = spark.createDataFrame(rows, "i int, text string, wanted string").select("i", X.script_share(F.col("text"), F.col("wanted")).alias("v")).collect()
    assert {r.i: r.v for r in got} == {i: None if t is None or w is None else X.share(t, w) for i, t, w in rows}
