"""Judges from tables of replies, languages, and the run comparison's inputs."""

import pytest
from pyspark.sql import functions as F

from spanmill.functions.language import canonical, canonical_code, detect
from spanmill.operators import evals, judging


@pytest.mark.parametrize("text, want", [
    ('{"score": 0.7, "reasoning": "ok"}', (0.7, "ok")), ('```json\n{"score": 2}\n```', (1.0, None)), ('<think>{"score": 0}</think> {"score": -1, "reasoning": 3}', (0.0, None)),
    ("no", None), (None, None), ('{"score": "x"}', None), ('{"score": true}', None), ('{"score": NaN}', None), ("[1]", None), ('{"score": 1, "reasoning": "' + "é" * 600 + '"}', (1.0, "é" * 500)),
])
def test_replies(text, want):
    assert judging.parse_reply(text) == want


ITEM = "id string, input string, output string, expected_output string, context array<string>, metadata string, span_id string"


def test_requests_meet_replies(spark):
    items = spark.createDataFrame([("a", "q?", "out", "exp", ["c1", "c2"], None, "s"), ("b", None, "out", None, None, None, "s"), ("c", "q?", " ", "exp", ["c"], None, "s")], ITEM)
    judges = [{"name": r, "model": "j", "rail": r, "criteria": "short"} for r in judging.RAILS]
    asked = judging.requests(items, judges)
    made = {r: {x.id for x in asked.where((F.col("name") == r) & F.col("prompt").isNotNull()).collect()} for r in judging.RAILS}
    assert made["g_eval"] == made["toxicity"] == made["bias"] == {"a", "b"} and all(made[r] == {"a"} for r in ("qa_correctness", "answer_relevancy", "faithfulness", "hallucination", "context_precision", "context_recall"))
    keys = {(r.id, r.name): r.key for r in asked.collect()}
    assert len(set(keys.values())) == 27
    replies = spark.createDataFrame([(keys["a", "bias"], '{"score": 0.9}'), (keys["b", "bias"], "what?")], "key string, reply string")
    got = {(r.id, r.name): (r.value, r.passed, r.cached) for r in judging.scored(asked, replies).collect()}
    assert got["a", "bias"] == (0.9, True, True) and got["b", "bias"] == (0.0, False, True) and got["a", "toxicity"] == (None, None, None)
    with pytest.raises(ValueError):
        judging.prompt("none")


def test_changes_and_replays(spark):
    schema = "name string, model string, base_url string, weights string, quantization string, version string"
    a = spark.createDataFrame([("x", "m", "u", None, "q8", "1"), ("y", "m", "u", None, None, "1"), ("z", "m", "u", None, None, "1")], schema)
    b = spark.createDataFrame([("x", "m", "u", "w", "q4", "1"), ("y", "m", "u", None, None, "1"), ("w", "m", "u", None, None, "1")], schema)
    assert {r.name: r.changed for r in judging.judge_changes(a, b).collect()} == {"x": ["weights", "quantization"], "z": ["gone"], "w": ["new"]}
    items = spark.createDataFrame([("a", "q", "old", "e", None, None, "s1"), ("b", "q", "old", "e", None, None, "s2")], ITEM)
    new = judging.replayed(items, spark.createDataFrame([("a", "new", "s9")], "id string, output string, span_id string"))
    assert new.columns == items.columns and [(r.id, r.output, r.span_id) for r in new.collect()] == [("a", "new", "s9")]


def test_languages(spark):
    texts = {"the cat is in the house and it was not on the mat": "en", "le chat est dans la maison et il ne veut pas sortir": "fr", "der Hund ist nicht in dem Haus und das ist gut": "de", "el perro no está en la casa de los niños y las niñas": "es",
             "こんにちは世界、これは日本語の文章です": "ja", "你好，世界。这是一个句子": "zh", "привет мир": "ru", "hi": None, "": None, "1234 !!": None}
    assert {t: detect(t) for t in texts} == texts
    codes = {"en-GB": "en", "zh-Hans": "zh", "IND": "ms", "cmn": "zh", "xx": "xx"}
    assert {c: canonical(c) for c in codes} == codes
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r.k for r in df.select(canonical_code(F.col("c")).alias("k")).collect()] == list(codes.values())
    rows = spark.createDataFrame([("the cat is in the old house", '{"language":"en-US"}'), ("der Hund ist in dem Haus und da", '{"language":"en"}'), ("hi", '{"language":"en"}'), ("the cat is in the old house", None)], "output string, metadata string")
    assert [(r.v.value, r.v.passed) for r in rows.select(evals.language_match().alias("v")).collect()] == [(1.0, True), (0.0, False), (None, None), (None, None)]
