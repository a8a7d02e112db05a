"""Log records: one outcome each, dialect events to spans, anything else by policy; agents and served requests among spans."""

import json

import pytest
from pyspark.sql import functions as F

from spanmill.functions.usage import Egress, admitted, nested_usage, usage_missing
from spanmill.schema import SPANS
from spanmill.sources import logs, otlp

T = 1_700_000_000_000_000_000


def value(v):
    return {"boolValue": v} if isinstance(v, bool) else {"intValue": str(v)} if isinstance(v, int) else {"doubleValue": v} if isinstance(v, float) else {"stringValue": v}


def attributes(d):
    return [{"key": k, "value": value(v)} for k, v in d.items()]


def record(name=None, at=T, trace="", span="", body=None, **attrs):
    out = {"timeUnixNano": str(at), "observedTimeUnixNano": str(at + 7), "attributes": attributes({k.replace("__", "."): v for k, v in attrs.items()}), "traceId": trace, "spanId": span}
    return out | ({"eventName": name} if name else {}) | ({"body": value(body)} if body else {})


@pytest.fixture(scope="module")
def requests(spark, tmp_path_factory):
    agent = [
        record("claude_code.user_prompt", T, session__id="s1", prompt__id="p1", prompt="do it"),
        record("claude_code.api_request", T + 5_000_000_000, session__id="s1", prompt__id="p1", request_id="r1", model="m-1", input_tokens=10, output_tokens=20, cache_read_tokens=5, cost_usd=0.25, duration_ms=2000),
        record("claude_code.api_request", T + 5_000_000_000, session__id="s1", prompt__id="p1", request_id="r1", model="m-1", input_tokens=10, output_tokens=20, cache_read_tokens=5, cost_usd=0.25, duration_ms=2000),
        record("claude_code.tool_result", T + 6_000_000_000, session__id="s1", tool_use_id="u1", tool_name="Bash", success="false", error_type="timeout", duration_ms=500),
        record("claude_code.tool_decision", T + 6_500_000_000, session__id="s1", tool_use_id="u2", tool_name="Edit", decision="reject", source="user"),
        record("claude_code.tool_decision", T + 6_600_000_000, session__id="s1", tool_use_id="u3", tool_name="Edit", decision="accept"),
    ]
    other = [
        record("gen_ai.evaluation.result", trace="AB" * 16, span="CD" * 8, gen_ai__evaluation__name="q", gen_ai__evaluation__score__value=0.5),
        record("gen_ai.evaluation.result", gen_ai__evaluation__score__value=0.5),
        record(None, body="plain line of text"), record(None, body="plain line of text"),
    ]
    codex = [record("codex.sse_event", T + 9, conversation__id="c1", event__kind="response.completed", model="m-2", input_token_count=100, output_token_count=7, cached_token_count=40), record("codex.sse_event", T + 8, conversation__id="c1", event__kind="response.created")]
    gemini = [record("gemini_cli.tool_call", T, session__id="g1", function_name="ls", function_args="{}", success=True), record("gemini_cli.api_response", T, session__id="g1", model="m-3", input_token_count=3, output_token_count=4, total_token_count=9, thoughts_token_count=2)]
    lines = [json.dumps({"resourceLogs": [{"resource": {"attributes": attributes({"service.name": n})}, "scopeLogs": [{"scope": {"name": "x"}, "logRecords": r}]}]}) for n, r in (("claude-code", agent), ("app", other), ("codex", codex), ("gemini-cli", gemini))]
    path = tmp_path_factory.mktemp("logs") / "requests.json"
    path.write_text("\n".join(lines))
    return logs.read_logs(spark, str(path))


@pytest.mark.parametrize("policy, want", [("off", {"off": 14}), ("genai", {"span": 8, "folded": 2, "score": 1, "malformed": 1, "unmapped": 2}), ("all", {"span": 10, "folded": 2, "score": 1, "malformed": 1})])
def test_every_record_has_one_outcome(requests, policy, want):
    assert {r.outcome: r.records for r in logs.outcomes(requests, policy).collect()} == want
    with pytest.raises(ValueError):
        logs.outcomes(requests, "some")


def test_dialect_events_become_spans(requests):
    spans = logs.log_spans(requests)
    assert spans.columns == SPANS.names
    rows = spans.collect()
    by = lambda **k: [r for r in rows if all(r[c] == v for c, v in k.items())]
    one, again = by(dialect="claude_code", oi_kind="LLM")
    assert (one.trace_id, one.span_id) == (again.trace_id, again.span_id) and (one.model, one.provider, one.cost_usd) == ("m-1", "anthropic", 0.25)
    assert (one.prompt_tokens, one.completion_tokens, one.total_tokens, one.end_unix_nano - one.start_unix_nano) == (10, 20, 35, 2_000_000_000)
    prompt, = by(dialect="claude_code", oi_kind="CHAIN")
    assert prompt.input_value == "do it" and one.parent_span_id == prompt.span_id and one.trace_id == prompt.trace_id
    failed, refused = sorted(by(dialect="claude_code", oi_kind="TOOL"), key=lambda r: r.end_unix_nano)
    assert (failed.status_message, failed.status_code, refused.status_message) == ("timeout", 2, "rejected (user)")
    assert failed.trace_id == prompt.trace_id and json.loads(failed.raw_attributes_json)["gen_ai.tool.name"] == "Bash"  # no prompt.id of its own: the session's last
    cod, = by(dialect="codex")
    assert (cod.prompt_tokens, cod.total_tokens, cod.cache_read_tokens) == (100, 107, 40)
    assert {r.total_tokens for r in by(dialect="gemini_cli", oi_kind="LLM")} == {9}


def test_other_records_become_spans_of_no_duration(requests):
    rows = [r for r in logs.log_spans(requests, "all").collect() if r.dialect == "unknown"]
    assert len(rows) == 2 and len({(r.trace_id, r.span_id) for r in rows}) == 1 and all(r.start_unix_nano == r.end_unix_nano == T for r in rows)
    assert json.loads(rows[0].raw_attributes_json) == {"log.body": "plain line of text", "spanmill.source": "log"}
    score, = logs.log_scores(requests).collect()
    assert (score.target_type, score.target_id, score.name, score.num_value) == ("span", "cd" * 8, "q", 0.5)


def spans_of(spark, *made):
    body = {"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"scope": {}, "spans": list(made)}]}]}
    from spanmill.plans.scratch import save

    return otlp.normalise(otlp.parse_traces(save(spark.createDataFrame([(json.dumps(body),)], "value string"), "requests")))


def span(i, kind=1, parent="", name="x", **attrs):
    return {"traceId": "AA", "spanId": f"S{i}", "parentSpanId": parent, "name": name, "kind": kind, "startTimeUnixNano": "1", "endTimeUnixNano": "2", "attributes": attributes({k.replace("__", "."): v for k, v in attrs.items()})}


def test_agents_tools_and_served_requests(spark):
    rows = {r.span_id: r for r in spans_of(
        spark, span(1, gen_ai__operation__name="invoke_agent", agent__name="bot", gen_ai__usage__input_tokens=5), span(2, openinference__span__kind="TOOL", tool_name="ls", tool_use_id="t1"),
        span(3, 2, "S1", "llm_request", gen_ai__latency__e2e=0.5, gen_ai__usage__input_tokens=7, gen_ai__request__model="m"), span(4, 2, "", "llm_request", gen_ai__latency__e2e=0.5, gen_ai__usage__input_tokens=7),
        span(5, gen_ai__request__model="m", models_usage="x"), span(6, gen_ai__usage__prompt_tokens="12", gen_ai__request__model="m", gen_ai__prompt__0__role="user", gen_ai__prompt__0__content="hi", gen_ai__prompt__1__content="ho")).collect()}
    held = {i: json.loads(r.raw_attributes_json) for i, r in rows.items()}
    assert rows["s1"].prompt_tokens is None and held["s1"]["spanmill.usage"] == "aggregate" and held["s1"]["gen_ai.agent.name"] == "bot"
    assert held["s2"]["gen_ai.tool.name"] == "ls" and held["s2"]["gen_ai.tool.call.id"] == "t1"
    assert (rows["s3"].oi_kind, rows["s3"].prompt_tokens, held["s3"]["spanmill.usage"], held["s3"]["spanmill.server"]) == ("CHAIN", None, "copy", "inference")
    assert (rows["s4"].oi_kind, rows["s4"].prompt_tokens) == ("LLM", 7)
    assert rows["s6"].prompt_tokens == 12 and json.loads(rows["s6"].input_value) == [{"role": "user", "content": "hi"}, {"content": "ho"}]


def test_many_messages_are_put_together(spark):
    made = span(1, **{f"gen_ai__prompt__{i}__content": f"m{i}" for i in range(200)})
    row, = spans_of(spark, made).collect()
    assert len(json.loads(row.input_value)) == 200


def test_why_usage_is_missing(spark):
    blob = {"models_usage": [{"prompt_tokens": 3}]}
    assert nested_usage(json.dumps(blob)) and not nested_usage('{"usage": 3}') and not nested_usage('{"x": {"tokens": 3}}') and not nested_usage("no")
    assert nested_usage('{"usage": [[[{"token_count": "3"}]]]}') and not nested_usage('{"usage": [[[[{"token_count": "3"}]]]]}')
    rows = [("LLM", "m", 1, "{}"), ("LLM", "m", None, json.dumps(blob)), ("LLM", "m", None, "{}"), ("TOOL", None, None, "{}")]
    df = spark.createDataFrame(rows, "oi_kind string, model string, prompt_tokens long, raw_attributes_json string").select("*", *(F.lit(None).cast("long").alias(c) for c in ("completion_tokens", "total_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")))
    assert [r.why for r in df.select(usage_missing().alias("why")).collect()] == [None, "unparsed-nesting", "no-usage-field", None]


def test_egress_list(spark):
    some = Egress(["Api.example.com", "10.0.0.0/8", "2001:db8::/32", "192.0.2.7"])
    assert some.admit("api.EXAMPLE.com", ["203.0.113.1"]) == "203.0.113.1" and some.admit("x", ["203.0.113.1", "10.1.2.3"]) == "10.1.2.3"
    assert some.admit("x", ["2001:db8::5"]) == "2001:db8::5" and some.admit("x", ["192.0.2.8"]) is None and some.admit("x", []) is None
    assert Egress(offline=True).admit("x", ["10.0.0.1"]) is None and Egress().admit("x", ["10.0.0.1"]) == "10.0.0.1"
    for bad in (lambda: Egress(["a"], offline=True), lambda: Egress(["10.0.0.0/99"])):
        with pytest.raises(ValueError):
            bad()
    df = spark.createDataFrame([("x", ["10.0.0.1"]), ("x", None), (None, ["10.0.0.1"])], "host string, ips array<string>")
    assert [r.a for r in df.select(admitted(some, F.col("host"), F.col("ips")).alias("a")).collect()] == ["10.0.0.1", None, None]
