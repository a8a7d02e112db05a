"""OTLP-JSON exports to spans and scores: flattening and normalisation in column expressions.

Integers arrive as strings and stay so in the schema; an empty value is an all-null struct and counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.attributes import AGENT_ID, AGENT_NAME, PHASES, TOOL_CALL_ID, TOOL_NAME

VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,bytesValue:string,arrayValue:string,kvlistValue:string>"
ATTRS = f"array<struct<key:string,value:{VALUE}>>"
_SPAN = (f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRS},"
         f"events:array<struct<name:string,timeUnixNano:string,attributes:{ATTRS}>>,status:struct<code:int,message:string>>")  # fmt: skip
TRACES = f"resourceSpans array<struct<resource:struct<attributes:{ATTRS}>,schemaUrl:string,scopeSpans:array<struct<scope:struct<name:string,version:string>,schemaUrl:string,spans:array<{_SPAN}>>>>>"

# fixed values: attribute names in order of preference
TOKEN_KEYS = {
    "prompt_tokens": ["llm.token_count.prompt", "gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens"],
    "completion_tokens": ["llm.token_count.completion", "gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens"],
    "total_tokens": ["llm.token_count.total", "gen_ai.usage.total_tokens"],
    "cache_read_tokens": ["llm.token_count.prompt_details.cache_read", "gen_ai.usage.cache_read.input_tokens"],
    "cache_write_tokens": ["llm.token_count.prompt_details.cache_write", "gen_ai.usage.cache_creation.input_tokens", "gen_ai.usage.cache_write.input_tokens"],
    "reasoning_tokens": ["llm.token_count.completion_details.reasoning", "gen_ai.usage.reasoning_tokens", "gen_ai.usage.reasoning.output_tokens"],
}
MODEL_KEYS = ["gen_ai.response.model", "gen_ai.request.model", "llm.model_name"]
PROVIDER_KEYS = ["gen_ai.provider.name", "gen_ai.system", "llm.provider", "llm.system"]
MESSAGES = 4096
OPERATION_KINDS = {"chat": "LLM", "text_completion": "LLM", "generate_content": "LLM", "embeddings": "EMBEDDING", "execute_tool": "TOOL", "create_agent": "AGENT", "invoke_agent": "AGENT", "invoke_workflow": "CHAIN", "retrieval": "RETRIEVER"}


def read_traces(spark, path: str) -> DataFrame:
    """Export requests, one JSON object per file or line."""
    return spark.read.schema(TRACES).option("mode", "FAILFAST").json(path)


def parse_traces(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, TRACES).alias("r")).select("r.*")


def attribute_text(v: Column) -> Column:
    """A value as attribute text: scalars as they are, lists and maps as JSON."""
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), v["bytesValue"], v["arrayValue"], v["kvlistValue"])


def _json(v: Column) -> Column:
    """A value as JSON text; non-finite doubles are null."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    double = F.when(F.isnan(v["doubleValue"]) | (F.abs(v["doubleValue"]) == float("inf")), "null").otherwise(v["doubleValue"].cast("string"))
    return F.coalesce(F.when(v["stringValue"].isNotNull(), quoted(v["stringValue"])), v["intValue"], F.when(v["doubleValue"].isNotNull(), double), v["boolValue"].cast("string"), F.when(v["bytesValue"].isNotNull(), quoted(v["bytesValue"])), v["arrayValue"], v["kvlistValue"])


def attribute_map(attributes: Column) -> Column:
    """Attributes as a map of text; the last of a repeated key wins, valueless ones are absent."""
    pairs = F.filter(F.transform(F.coalesce(attributes, F.array().cast(ATTRS)), lambda a: F.struct(a["key"].alias("key"), a["value"].alias("value"))), lambda a: a["key"].isNotNull() & attribute_text(a["value"]).isNotNull())
    return F.aggregate(pairs, F.create_map().cast(f"map<string,{VALUE}>"), lambda acc, a: F.map_concat(F.map_filter(acc, lambda k, _: k != a["key"]), F.map_from_arrays(F.array(a["key"]), F.array(a["value"]))))


def _quoted(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def json_text(attributes: Column, added: dict[str, Column] | None = None) -> Column:
    """Attributes as one JSON object, keys in order; ``added`` texts are put in where they aren't NULL and the key isn't there."""
    entries = F.transform(F.map_entries(attributes), lambda e: F.struct(e["key"].alias("k"), _json(e["value"]).alias("v")))
    more = [F.when(c.isNotNull() & ~F.map_contains_key(attributes, F.lit(k)), F.struct(F.lit(k).alias("k"), _quoted(c).alias("v"))) for k, c in (added or {}).items()]
    entries = F.array_sort(F.concat(entries, F.array_compact(F.array(*more))) if more else entries)
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))


def flatten(requests: DataFrame) -> DataFrame:
    """One row per span: its fields, service, scope and attribute map."""
    r = requests.select(F.explode("resourceSpans").alias("r")).select(attribute_map(F.col("r.resource.attributes")).alias("res"), F.col("r.schemaUrl").alias("rurl"), F.explode("r.scopeSpans").alias("s"))
    rows = r.select("res", "rurl", F.col("s.scope.name").alias("scope_name"), F.col("s.scope.version").alias("scope_version"), F.col("s.schemaUrl").alias("surl"), F.explode("s.spans").alias("x"))
    url = F.coalesce(F.nullif(F.col("surl"), F.lit("")), F.nullif(F.col("rurl"), F.lit("")))
    attrs = attribute_map(F.col("x.attributes"))
    schema = F.when(url.isNotNull() & ~F.map_contains_key(attrs, F.lit("otel.schema_url")), F.map_concat(attrs, F.map_from_arrays(F.array(F.lit("otel.schema_url")), F.array(F.struct(url.alias("stringValue"), *(F.lit(None).cast(t).alias(n) for n, t in (("intValue", "string"), ("doubleValue", "double"), ("boolValue", "boolean"), ("bytesValue", "string"), ("arrayValue", "string"), ("kvlistValue", "string")))))))).otherwise(attrs)
    return rows.select(attribute_text(F.col("res")["service.name"]).alias("service_name"), "scope_name", "scope_version", "x", schema.alias("a"))


def _texts() -> Column:
    return F.transform_values("a", lambda _, v: attribute_text(v)).alias("t")


def _first(keys: list[str]) -> Column:
    return F.coalesce(*(F.col("t")[k] for k in keys))


def _u64(keys: list[str]) -> Column:
    """The first key's value that is a whole number, not negative."""
    def one(k: str) -> Column:
        v = F.col("a")[k]
        d = v["doubleValue"]
        text = F.coalesce(v["intValue"], v["stringValue"])
        return F.coalesce(F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("long")), F.when((d >= 0) & (d == F.floor(d)), d.try_cast("long")))

    return F.coalesce(*(one(k) for k in keys))


def _double(keys: list[str]) -> Column:
    return F.coalesce(*(F.coalesce(F.col("a")[k]["doubleValue"], F.coalesce(F.col("a")[k]["intValue"], F.col("a")[k]["stringValue"]).try_cast("double")) for k in keys))


def _messages(kind: str) -> Column:
    """Indexed ``gen_ai.<kind>.<i>.role/content`` attributes put together as JSON, from 0 on without a gap."""
    own = F.filter(F.map_keys("t"), lambda k: F.startswith(k, F.lit(f"gen_ai.{kind}.")))
    slots = F.sequence(F.lit(0), F.least(F.size(own), F.lit(MESSAGES)) - F.when(F.size(own) >= MESSAGES, 1).otherwise(0))  # as many as there are keys
    at = lambda i, f: F.try_element_at("t", F.concat(F.lit(f"gen_ai.{kind}."), i.cast("string"), F.lit(f".{f}")))
    found = F.transform(slots, lambda i: F.struct(at(i, "role").alias("role"), at(i, "content").alias("content")))
    stop = F.array_position(F.transform(found, lambda m: m["role"].isNull() & m["content"].isNull()), F.lit(True))
    held = F.slice(found, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(found)).cast("int"))
    return F.when(F.size(held) > 0, F.to_json(held))


def normalise(requests: DataFrame) -> DataFrame:
    """Export requests as spans."""
    rows = flatten(requests).select("*", _texts())
    keys = F.map_keys("a")
    starts = lambda *p: F.exists(keys, lambda k: F.reduce(F.array(*(F.startswith(k, F.lit(x)) for x in p)), F.lit(False), lambda acc, x: acc | x))
    oi, gen = starts("openinference.", "llm."), starts("gen_ai.")
    dialect = F.when(oi & gen, "mixed").when(oi, "open_inference").when(gen, "gen_ai").otherwise("unknown")
    operation = F.create_map(*(F.lit(x) for kv in OPERATION_KINDS.items() for x in kv))[_first(["gen_ai.operation.name"])]
    inferred = F.coalesce(operation, F.when(starts("gen_ai.request.", "gen_ai.response.", "gen_ai.usage."), "LLM"), F.when(starts("gen_ai.tool.") | (_first(["mcp.method.name"]) == "tools/call"), "TOOL"))
    served = (F.col("x.name") == "llm_request") & (F.col("x.kind") == 2) & _first([PHASES[-1][1]]).isNotNull()  # an inference server's own span
    served = F.coalesce(served, F.lit(False))
    kind = F.when(served, "LLM").otherwise(F.coalesce(_first(["openinference.span.kind"]), inferred))
    rows = rows.select("*", served.alias("served")).select("*", dialect.alias("dialect"), kind.alias("oi_kind"), _double(["llm.cost.total", "gen_ai.usage.cost"]).alias("cost"), *(_u64(k).alias(c) for c, k in TOKEN_KEYS.items()))
    usage = F.coalesce(*(F.col(c) for c in TOKEN_KEYS)).isNotNull() | F.col("cost").isNotNull()
    copy = F.col("served") & F.coalesce(F.col("x.parentSpanId") != "", F.lit(False))  # its parent, the caller's span, reports the same call
    upper = F.upper("oi_kind")
    group = F.coalesce(upper.isin("AGENT", "CHAIN") & (F.coalesce(F.col("x.kind"), F.lit(0)) != 3) & usage, F.lit(False))
    rows = rows.select("*", F.when(copy, "copy").when(group, "aggregate").alias("why")).withColumn("aside", F.col("why").isNotNull())
    named = lambda kinds, keys: F.when(upper.isin(*kinds), F.coalesce(*(F.col("a")[k]["stringValue"] for k in keys[1:])))
    added = {
        "spanmill.usage": F.col("why"), "spanmill.server": F.when(F.col("served"), "inference"), TOOL_NAME[0]: named(["TOOL"], TOOL_NAME), TOOL_CALL_ID[0]: named(["TOOL"], TOOL_CALL_ID),
        AGENT_NAME[0]: named(["AGENT", "CHAIN"], AGENT_NAME), AGENT_ID[0]: named(["AGENT", "CHAIN"], AGENT_ID)}
    counts = {c: F.col(c) for c in TOKEN_KEYS} | {"total_tokens": F.coalesce("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))}
    text = json_text(F.col("a"), added)
    nano = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long"))
    return rows.select(
        "dialect", F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"), F.nullif(F.lower("x.parentSpanId"), F.lit("")).alias("parent_span_id"),
        F.coalesce("x.name", F.lit("")).alias("name"), F.coalesce(F.col("x.kind"), F.lit(0)).alias("otel_kind"), F.when(copy, "CHAIN").otherwise(F.col("oi_kind")).alias("oi_kind"), nano("x.startTimeUnixNano").alias("start_unix_nano"),
        nano("x.endTimeUnixNano").alias("end_unix_nano"), F.coalesce(F.col("x.status.code"), F.lit(0)).alias("status_code"), F.nullif(F.col("x.status.message"), F.lit("")).alias("status_message"),
        _first(MODEL_KEYS).alias("model"), _first(PROVIDER_KEYS).alias("provider"), *(F.when(~F.col("aside"), c).alias(n) for n, c in counts.items()),
        F.when(~F.col("aside"), F.col("cost")).alias("cost_usd"), F.coalesce(_first(["input.value", "gen_ai.input.messages", "gen_ai.prompt"]), _messages("prompt")).alias("input_value"),
        F.coalesce(_first(["output.value", "gen_ai.output.messages", "gen_ai.completion"]), _messages("completion")).alias("output_value"), _first(["session.id", "gen_ai.conversation.id"]).alias("session_id"),
        _first(["user.id"]).alias("user_id"), "service_name", F.nullif("scope_name", F.lit("")).alias("scope_name"), F.nullif("scope_version", F.lit("")).alias("scope_version"), text.alias("raw_attributes_json"))


def _evaluation(t: Column, a: Column) -> tuple[Column, Column, Column]:
    """Name, finite value and text of an evaluation's attributes."""
    held = a["gen_ai.evaluation.score.value"]
    value = F.coalesce(held["doubleValue"], F.coalesce(held["intValue"], held["stringValue"]).try_cast("double"))
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    text = F.coalesce(t["gen_ai.evaluation.score.label"], F.when(finite.isNull() & t["error.type"].isNotNull(), "error"))
    return t["gen_ai.evaluation.name"], finite, text


def scored(a: Column, t: Column) -> Column:
    """Whether an evaluation's attributes make a score."""
    name, finite, text = _evaluation(t, a)
    return name.isNotNull() & (finite.isNotNull() | text.isNotNull())


def evaluation_rows(rows: DataFrame) -> DataFrame:
    """Evaluations (trace, span, ts, a, t) as scores of their span, or of their trace where they have none."""
    name, finite, text = _evaluation(F.col("t"), F.col("a"))
    on_trace = F.coalesce(F.col("span") == "", F.lit(True)) & F.coalesce(F.col("trace") != "", F.lit(False))
    ident = F.concat(F.lit("gaie-"), F.substring(F.sha2(F.concat_ws("\0", "trace", "span", name, F.col("ts").cast("string")), 256), 1, 32))
    return rows.where(scored(F.col("a"), F.col("t"))).select(
        ident.alias("id"), F.when(on_trace, "trace").otherwise("span").alias("target_type"), F.lower(F.when(on_trace, F.col("trace")).otherwise(F.col("span"))).alias("target_id"), name.alias("name"), finite.alias("num_value"),
        F.when(finite.isNull(), text).alias("str_value"), F.when(finite.isNotNull(), "numeric").otherwise("categorical").alias("data_type"), F.lit("eval").alias("source"), F.col("t")["gen_ai.evaluation.explanation"].alias("comment"),
        F.lit(None).cast("string").alias("config_id"), F.col("ts").alias("ts_unix_nano"))


def evaluation_scores(requests: DataFrame, event: str = "gen_ai.evaluation.result") -> DataFrame:
    """Evaluation events on spans as scores: finite values are numeric, labels categorical, errors the label ``error``."""
    rows = flatten(requests).select(F.col("x.traceId").alias("trace"), F.col("x.spanId").alias("span"), F.col("x.endTimeUnixNano").alias("end"), F.explode("x.events").alias("e")).where(F.col("e.name") == event)
    rows = rows.select("trace", "span", F.coalesce(F.nullif(F.col("e.timeUnixNano"), F.lit("0")), F.col("end")).cast("long").alias("ts"), attribute_map(F.col("e.attributes")).alias("a")).select("*", _texts())
    return evaluation_rows(rows)


def to_otlp(spans: DataFrame) -> DataFrame:
    """Spans as export requests, one per row: what a collector would have sent; for fixtures and demos."""
    def attribute(key: str, c: Column, kind: str = "stringValue") -> Column:
        own = c.cast("string")
        held = F.struct((own if kind == "stringValue" else F.lit(None).cast("string")).alias("stringValue"), (own if kind == "intValue" else F.lit(None).cast("string")).alias("intValue"))
        return F.when(c.isNotNull(), F.struct(F.lit(key).alias("key"), held.alias("value")))

    names = {"gen_ai.request.model": "model", "gen_ai.system": "provider", "openinference.span.kind": "oi_kind", "session.id": "session_id", "user.id": "user_id", "input.value": "input_value", "output.value": "output_value"}
    texts = [attribute(k, F.col(c)) for k, c in names.items()]
    counts = [attribute(TOKEN_KEYS[c][k % 2], F.col(c), "intValue") for k, c in enumerate(TOKEN_KEYS)]
    span = F.struct(
        F.upper("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.coalesce("parent_span_id", F.lit("")).alias("parentSpanId"), "name", F.col("otel_kind").alias("kind"),
        F.col("start_unix_nano").cast("string").alias("startTimeUnixNano"), F.col("end_unix_nano").cast("string").alias("endTimeUnixNano"),
        F.array_compact(F.array(*texts, *counts)).alias("attributes"), F.struct(F.col("status_code").alias("code"), F.col("status_message").alias("message")).alias("status"))
    scope = F.struct(F.struct(F.col("scope_name").alias("name")).alias("scope"), F.array(span).alias("spans"))
    resource = F.struct(F.array(attribute("service.name", F.col("service_name"))).alias("attributes"))
    return spans.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))
