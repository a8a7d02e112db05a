"""OTLP-JSON log exports to spans and scores, under a policy, with every record in exactly one outcome.

Coding agents report what they do as log events. A dialect is a row of tables: which event is what, and under which names
it carries its session, turn, ids, tokens and errors. A model call or tool result becomes a span that ends when the event
was logged and starts ``duration_ms`` before; a prompt becomes a marker span that a turn's spans hang from; events whose
facts another one carries are folded. Under the policy "all", any other record becomes a span of no duration.

Defined cases: an absent time is the observed one; equal records give equal ids, so a retry lands on the same span; an
event of a session without a turn of its own belongs to the session's last prompt before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.sources.otlp import ATTRS, VALUE, attribute_map, attribute_text, evaluation_rows, json_text, scored

LOGS = (f"resourceLogs array<struct<resource:struct<attributes:{ATTRS}>,scopeLogs:array<struct<scope:struct<name:string,version:string>,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,"
        f"severityNumber:int,severityText:string,eventName:string,body:{VALUE},attributes:{ATTRS},traceId:string,spanId:string>>>>>>")  # fmt: skip
POLICIES = ("off", "genai", "all")
EVALUATION = "gen_ai.evaluation.result"
# fixed values: what each dialect's events are, and the attributes that carry a fact
EVENTS = {
    "claude_code": {"api_request": "llm", "api_error": "llm", "tool_result": "tool", "tool_decision": "decision", "user_prompt": "prompt", "assistant_response": "folded", "api_refusal": "folded"},
    "codex": {"sse_event": "llm", "api_request": "folded", "websocket_request": "folded", "tool_result": "tool", "tool_decision": "decision", "user_prompt": "prompt", "conversation_starts": "folded"},
    "gemini_cli": {"api_response": "llm", "api_error": "llm", "api_request": "folded", "tool_call": "tool", "user_prompt": "prompt"},
}
FACTS = {
    "session": ["session.id", "conversation.id"], "turn": ["prompt.id", "prompt_id"], "request": ["request_id", "client_request_id"], "tool_id": ["tool_use_id", "call_id"],
    "tool": ["tool_name", "function_name"], "arguments": ["tool_input", "arguments", "function_args"], "error": ["error", "error.message", "error_type"], "model": ["model"],
}
TOKENS = {
    "prompt_tokens": ["input_tokens", "input_token_count"], "completion_tokens": ["output_tokens", "output_token_count"], "total_tokens": ["total_token_count"],
    "cache_read_tokens": ["cache_read_tokens", "cached_token_count", "cached_content_token_count"], "cache_write_tokens": ["cache_creation_tokens"], "reasoning_tokens": ["reasoning_token_count", "thoughts_token_count"],
}
PROVIDERS = {"claude_code": "anthropic", "codex": "openai", "gemini_cli": "google"}
REFUSED = ["reject", "denied", "abort"]


def read_logs(spark, path: str) -> DataFrame:
    """Export requests, one JSON object per file or line."""
    return spark.read.schema(LOGS).option("mode", "FAILFAST").json(path)


def records(requests: DataFrame) -> DataFrame:
    """One row per log record: service, scope, time, context, name, body, and attributes as values (a) and as text (t)."""
    r = requests.select(F.explode("resourceLogs").alias("r")).select(attribute_map(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeLogs").alias("s"))
    r = r.select("res", F.col("s.scope.name").alias("scope_name"), F.col("s.scope.version").alias("scope_version"), F.explode("s.logRecords").alias("x"))
    r = r.select("*", attribute_map(F.col("x.attributes")).alias("a"))
    own = F.nullif(F.col("x.timeUnixNano").try_cast("long"), F.lit(0).cast("long"))
    seen = F.coalesce(F.col("x.observedTimeUnixNano").try_cast("long"), F.lit(0).cast("long"))
    body = attribute_text(F.col("x.body"))
    t = F.transform_values("a", lambda _, v: attribute_text(v))
    empty = lambda c: F.nullif(F.lower(c), F.lit(""))
    return r.select(
        attribute_text(F.col("res")["service.name"]).alias("service_name"), F.nullif("scope_name", F.lit("")).alias("scope_name"), F.nullif("scope_version", F.lit("")).alias("scope_version"),
        F.coalesce(own, seen).alias("time"), seen.alias("observed"), empty("x.traceId").alias("trace"), empty("x.spanId").alias("span"), body.alias("body"),
        F.coalesce(F.nullif("x.eventName", F.lit("")), t["event.name"], F.when(~body.contains(" "), body)).alias("name"),
        F.nullif("x.severityText", F.lit("")).alias("severity_text"), F.coalesce("x.severityNumber", F.lit(0)).alias("severity_number"), "a", t.alias("t"))


def derived_id(hex_digits: int, *parts) -> Column:
    """An id from its parts, each ended by NUL: the same wherever and however often it is worked out."""
    text = F.concat(*(x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\0"))))
    return F.substring(F.sha2(text, 256), 1, hex_digits)


def _fact(name: str) -> Column:
    return F.coalesce(*(F.nullif(F.col("t")[k], F.lit("")) for k in FACTS[name]))


def _count(keys: list[str]) -> Column:
    return F.coalesce(*(F.when(F.col("t")[k].rlike(r"^\+?[0-9]+$"), F.col("t")[k].try_cast("long")) for k in keys))


def classified(requests: DataFrame, policy: str = "genai") -> DataFrame:
    """Records with their dialect, what they are, and their outcome: span, score, folded, unmapped, off or malformed."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}: expected off, genai or all")
    rows = records(requests)
    service, scope = (F.lower(F.translate(F.coalesce(c, F.lit("")), "-.", "__")) for c in ("service_name", "scope_name"))
    dialect, event, what = F.lit(None).cast("string"), F.col("name"), F.lit(None).cast("string")
    for d, events in EVENTS.items():
        mine = F.startswith(F.col("name"), F.lit(f"{d}.")) | service.contains(d) | scope.contains(d)
        dialect = F.when(mine & dialect.isNull(), F.lit(d)).otherwise(dialect)
        event = F.regexp_replace(event, rf"^{d}\.", "")
        kinds = F.create_map(*(F.lit(x) for kv in events.items() for x in kv))
        what = F.when(dialect == d, kinds[event]).otherwise(what)
    rows = rows.withColumn("dialect", dialect).withColumn("what", what)
    failed = _fact("error").isNotNull()
    counted = F.coalesce(*(_count(k) for k in TOKENS.values())).isNotNull()
    what = (
        F.when((F.col("dialect") == "codex") & (F.col("what") == "llm") & ~counted & ~failed, "folded")  # one of the many events of a streamed reply
        .when((F.col("dialect") == "codex") & F.coalesce(F.regexp_replace("name", "^codex\\.", "") == "api_request", F.lit(False)) & failed, "llm")
        .when((F.col("what") == "decision") & F.col("t")["decision"].isin(REFUSED), "refused").when(F.col("what") == "decision", "folded").otherwise(F.col("what")))
    rows = rows.withColumn("what", what)
    score = F.when(scored(F.col("a"), F.col("t")), "score").otherwise("malformed")
    outcome = F.when(F.lit(policy == "off"), "off").when(F.col("name") == EVALUATION, score).when(F.col("what") == "folded", "folded").when(F.col("what").isNotNull(), "span")
    return rows.withColumn("outcome", outcome.otherwise("span" if policy == "all" else "unmapped"))


def outcomes(requests: DataFrame, policy: str = "genai") -> DataFrame:
    """How many records had each outcome; together they are the records received."""
    return classified(requests, policy).groupBy("outcome").agg(F.count(F.lit(1)).alias("records"))


def log_scores(requests: DataFrame, policy: str = "genai") -> DataFrame:
    """Evaluation results among the records, as scores."""
    rows = classified(requests, policy).where("outcome = 'score'")
    return evaluation_rows(rows.select(F.coalesce("trace", F.lit("")).alias("trace"), F.coalesce("span", F.lit("")).alias("span"), F.col("time").alias("ts"), "a", "t"))


def log_spans(requests: DataFrame, policy: str = "genai") -> DataFrame:
    """The records whose outcome is a span, as spans."""
    rows = classified(requests, policy).where("outcome = 'span'").withColumns({n: _fact(n) for n in FACTS})
    sequence = F.coalesce(F.col("t")["event.sequence"].try_cast("long"), F.lit(0))
    before = Window.partitionBy("dialect", "session").orderBy("time", sequence)
    told = F.last(F.when(F.col("what") == "prompt", F.coalesce("turn", F.concat_ws("|", "session", "time"))), ignorenulls=True).over(before)
    rows = rows.withColumn("turn", F.when(F.col("session").isNotNull(), F.coalesce("turn", told)).otherwise(F.col("turn")))
    key = F.coalesce(F.when(F.col("what") == "llm", F.col("request")).when(F.col("what").isin("tool", "refused"), F.col("tool_id")).when(F.col("what") == "prompt", F.col("turn")), F.concat_ws("|", "session", F.col("t")["event.sequence"], "time"))
    kind = F.create_map(*(F.lit(x) for kv in {"llm": "LLM", "tool": "TOOL", "refused": "TOOL", "prompt": "CHAIN"}.items() for x in kv))[F.col("what")]
    agent = F.col("what").isNotNull()
    name = F.coalesce("name", F.lit("log"))
    loose = [name, F.col("time"), F.col("observed"), F.col("body")]
    trace = F.coalesce("trace", F.when(agent, derived_id(32, F.col("dialect"), F.lit("trace"), F.col("session"), F.col("turn"))).otherwise(derived_id(32, F.lit("log trace"), F.col("service_name"), *loose)))
    rows = rows.withColumns({"trace_id": trace, "key": key, "kind": kind})
    group = F.when(F.col("what").isin("tool", "refused"), "tool").otherwise(F.col("what"))
    span = F.when(agent, derived_id(16, F.col("dialect"), group, F.col("key"))).otherwise(derived_id(16, F.lit("log span"), F.col("trace_id"), *loose))
    marker = F.when(F.col("what").isin("llm", "tool", "refused") & F.col("turn").isNotNull(), derived_id(16, F.col("dialect"), F.lit("prompt"), F.col("turn")))
    ms = F.coalesce(_count(["duration_ms"]), F.lit(0).cast("long"))
    start = F.when(agent & (F.col("what") != "prompt"), F.greatest(F.col("time") - ms * 1_000_000, F.lit(0).cast("long"))).otherwise(F.col("time"))
    bad = F.when(F.col("what") == "refused", F.concat(F.lit("rejected ("), F.coalesce(F.col("t")["source"], F.lit("unknown")), F.lit(")"))).when(agent & (F.col("t")["success"] == "false"), F.coalesce("error", F.lit("tool failed")))
    bad = F.coalesce(bad, F.when(F.col("what") == "llm", F.col("error")))
    counts = {c: F.when(F.col("what") == "llm", _count(k)) for c, k in TOKENS.items()}
    held = lambda c: F.coalesce(counts[c], F.lit(0).cast("long"))
    parts = F.when(F.col("dialect") == "claude_code", held("cache_read_tokens") + held("cache_write_tokens")).otherwise(0)  # the others count cached ones among the input
    counts["total_tokens"] = F.coalesce(counts["total_tokens"], F.when(F.coalesce(counts["prompt_tokens"], counts["completion_tokens"]).isNotNull(), held("prompt_tokens") + held("completion_tokens") + parts))
    provider = F.when(F.col("what") == "llm", F.create_map(*(F.lit(x) for kv in PROVIDERS.items() for x in kv))[F.col("dialect")])
    number = F.col("t")["cost_usd"].try_cast("double")
    cost = F.when((F.col("what") == "llm") & (number >= 0) & (number < float("inf")), number)
    added = {"spanmill.source": F.lit("log"), "gen_ai.tool.name": F.when(group == "tool", F.col("tool")), "gen_ai.tool.call.id": F.when(group == "tool", F.col("tool_id")), "gen_ai.tool.call.arguments": F.when(group == "tool", F.col("arguments")),
             "log.body": F.when(~agent, F.col("body")), "log.severity_text": F.when(~agent, F.col("severity_text")), "log.severity_number": F.when(~agent & (F.col("severity_number") != 0), F.col("severity_number").cast("string"))}
    return rows.select(
        F.coalesce(F.when(agent, F.col("dialect")), F.lit("unknown")).alias("dialect"), "trace_id", span.alias("span_id"), F.coalesce("span", marker).alias("parent_span_id"),
        F.when(agent, F.concat_ws(".", "dialect", F.create_map(*(F.lit(x) for kv in {"llm": "llm_request", "tool": "tool", "refused": "tool", "prompt": "prompt"}.items() for x in kv))[F.col("what")])).otherwise(name).alias("name"),
        F.lit(0).alias("otel_kind"), F.col("kind").alias("oi_kind"), start.alias("start_unix_nano"), F.col("time").alias("end_unix_nano"), F.when(bad.isNotNull(), 2).otherwise(0).alias("status_code"), bad.alias("status_message"),
        F.when(F.col("what") == "llm", F.col("model")).alias("model"), provider.alias("provider"), *(counts[c].alias(c) for c in TOKENS), cost.alias("cost_usd"),
        F.when(F.col("what") == "prompt", F.col("t")["prompt"]).alias("input_value"), F.lit(None).cast("string").alias("output_value"), F.coalesce("session", F.col("t")["gen_ai.conversation.id"]).alias("session_id"), F.col("t")["user.id"].alias("user_id"),
        "service_name", "scope_name", "scope_version", json_text(F.col("a"), added).alias("raw_attributes_json"))
