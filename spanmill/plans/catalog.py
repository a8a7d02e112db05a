"""Every registered query by operator id, with the SQL it is held against.

Sums of doubles are rounded on both sides, as their order of addition is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanmill.functions import attributes as A
from spanmill.functions import redact as R
from spanmill.functions import text as X
from spanmill.functions.usage import COUNTS as X_COUNTS
from spanmill.functions.usage import usage_missing as usage_why
from spanmill.operators import cost, evals, joins, judging, latency, maintenance, ordered, pricing, sessions, traces, usage
from spanmill.plans import sqlgate
from spanmill.plans.scratch import save
from spanmill.sources import otlp, testdata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PRICES = pricing.parse_prices({
    "m-plain": {"input_cost_per_token": 1e-6, "output_cost_per_token": 4e-6},
    "m-cache": {"input_cost_per_token": 1e-6, "output_cost_per_token": 4e-6, "cache_read_input_token_cost": 1e-7, "cache_creation_input_token_cost": 2e-6},
    "m-reason": {"input_cost_per_token": 2e-6, "output_cost_per_token": 8e-6, "output_cost_per_reasoning_token": 1.6e-5},
    "m-tier": {"input_cost_per_token": 1e-6, "output_cost_per_token": 5e-6, "input_cost_per_token_above_200k_tokens": 2e-6, "output_cost_per_token_above_200k_tokens": 7e-6},
})
HOUR = 3_600_000_000_000


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql.replace("{cte}", testdata.DUCK.strip()).replace("{llm}", LLM)


def spans_query(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    add(name, lambda s, d: make(testdata.spans(s, d)), sql and f"WITH RECURSIVE {{cte}} {sql}")


def both_query(name: str, make: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None = None) -> None:
    add(name, lambda s, d: make(testdata.spans(s, d), testdata.scores(s, d)), sql and f"WITH RECURSIVE {{cte}} {sql}")


def items_query(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    add(name, lambda s, d: make(testdata.items(s, d)), sql and f"WITH {testdata.ITEMS_SQL} {sql}")


def table_query(name: str, table: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    add(name, lambda s, d: make(s.read.parquet(f"{d}/{table}.parquet")), sql)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


#: Model calls, as SQL.
LLM = """(upper(oi_kind) = 'LLM' OR ((oi_kind IS NULL OR upper(oi_kind) NOT IN ('AGENT', 'CHAIN', 'TOOL')) AND (model IS NOT NULL
  OR instr(raw_attributes_json, '"gen_ai.request.') > 0 OR instr(raw_attributes_json, '"gen_ai.response.') > 0 OR instr(raw_attributes_json, '"gen_ai.usage.') > 0)))"""
DUR = "greatest(end_unix_nano - start_unix_nano, 0)"
TTFT = """coalesce(CASE WHEN TRY_CAST(json_extract_string(raw_attributes_json, '$."time_to_first_token_ms"') AS DOUBLE) >= 0 THEN TRY_CAST(json_extract_string(raw_attributes_json, '$."time_to_first_token_ms"') AS DOUBLE) * 0.001e0 END,
  CASE WHEN TRY_CAST(json_extract_string(raw_attributes_json, '$."gen_ai.latency.time_to_first_token"') AS DOUBLE) >= 0 THEN TRY_CAST(json_extract_string(raw_attributes_json, '$."gen_ai.latency.time_to_first_token"') AS DOUBLE) END)"""


def attr_sql(key: str) -> str:
    return f"""json_extract_string(raw_attributes_json, '$."{key}"')"""


# aggregation: cost
for _by, _column in cost.DIMENSIONS.items():
    spans_query(
        "AGG-1" if _by == "model" else f"AGG-1-{_by}", lambda s, by=_by: cost.attribution(s, by),
        f"SELECT coalesce({_column}, '(untagged)') AS attribution, count(*) AS spans, CAST(sum(total_tokens) AS BIGINT) AS tokens, sum(cost_usd) AS cost_usd, count(*) FILTER (cost_usd IS NULL) AS missing_cost FROM spans GROUP BY {_column}")
spans_query("AGG-2", cost.grand_total, "SELECT count(*) AS spans, CAST(sum(total_tokens) AS BIGINT) AS tokens, sum(cost_usd) AS cost_usd, count(*) FILTER (cost_usd IS NULL) AS missing_cost, count(DISTINCT model) + CAST(bool_or(model IS NULL) AS BIGINT) AS groups FROM spans")
_SHAPES = """SELECT model AS attribution, model, prompt_tokens, completion_tokens, total_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, cost_usd,
  CAST(cost_usd IS NOT NULL AND raw_attributes_json NOT LIKE '%"llm.cost.total":%' AND raw_attributes_json NOT LIKE '%"gen_ai.usage.cost":%' AS INT) AS derived,
  CAST(raw_attributes_json LIKE '%"spanmill.cost.basis":"%cache_excl%' AS INT) AS cache_excl, CAST(raw_attributes_json LIKE '%"spanmill.cost.basis":"%reasoning_add%' AS INT) AS reasoning_add, count(*) AS n
  FROM spans WHERE {where} GROUP BY ALL"""
spans_query("AGG-3", cost.usage_shapes, _SHAPES.replace("{where}", "true"))
_PRICED = """, shapes AS ({shapes}),
priced AS (SELECT *, CASE model WHEN 'm-plain' THEN 1 WHEN 'm-cache' THEN 2 WHEN 'us.vendor/m-reason-20250929' THEN 3 WHEN 'M-Tier@20250101' THEN 4 END AS k FROM shapes),
z AS (SELECT *, coalesce(prompt_tokens, 0) AS p, coalesce(completion_tokens, 0) AS c, coalesce(cache_read_tokens, 0) AS cr, coalesce(cache_write_tokens, 0) AS cw, coalesce(reasoning_tokens, 0) AS r,
  CASE WHEN total_tokens IS NOT DISTINCT FROM prompt_tokens + completion_tokens THEN NULL ELSE total_tokens END AS t FROM priced),
y AS (SELECT *, t - p - c AS extra, cr + cw AS cache FROM z),
b AS (SELECT *, CASE WHEN derived = 1 THEN cache_excl = 1 WHEN t IS NOT NULL AND extra = 0 THEN false WHEN t IS NOT NULL AND extra >= 0 AND cache <> r AND cache > 0 AND extra = cache THEN true
    WHEN t IS NOT NULL AND extra >= 0 AND cache <> r AND r > 0 AND extra = r THEN false WHEN t IS NOT NULL AND extra >= 0 AND cache > 0 AND r > 0 AND extra = cache + r THEN true ELSE cache > 0 AND p < cache END AS excl,
  CASE WHEN derived = 1 THEN reasoning_add = 1 WHEN t IS NOT NULL AND extra = 0 THEN false WHEN t IS NOT NULL AND extra >= 0 AND cache <> r AND cache > 0 AND extra = cache THEN false
    WHEN t IS NOT NULL AND extra >= 0 AND cache <> r AND r > 0 AND extra = r THEN true WHEN t IS NOT NULL AND extra >= 0 AND cache > 0 AND r > 0 AND extra = cache + r THEN true ELSE false END AS addr FROM y),
u AS (SELECT *, {k} AS kk, CASE WHEN excl THEN p ELSE greatest(p - cr - cw, 0) END AS unc, CASE WHEN excl THEN p + cr + cw ELSE p END AS tin, CASE WHEN addr THEN c ELSE greatest(c - r, 0) END AS txt FROM b),
v AS (SELECT *, CASE kk WHEN 1 THEN unc * 1e-6 + (cr + cw) * 1e-6 + (txt + r) * 4e-6 WHEN 2 THEN unc * 1e-6 + cr * 1e-7 + cw * 2e-6 + (txt + r) * 4e-6 WHEN 3 THEN unc * 2e-6 + (cr + cw) * 2e-6 + txt * 8e-6 + r * 1.6e-5
    WHEN 4 THEN CASE WHEN tin > 200000 THEN (unc + cr + cw) * 2e-6 + (txt + r) * 7e-6 ELSE (unc + cr + cw) * 1e-6 + (txt + r) * 5e-6 END END AS usd FROM u)"""
_REPRICE = _PRICED.replace("{shapes}", _SHAPES.replace("{where}", "true")).replace("{k}", "k") + """,
w AS (SELECT *, CASE WHEN cost_usd IS NOT NULL AND derived = 0 THEN cost_usd WHEN prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL THEN usd END AS cost FROM v)
SELECT coalesce(attribution, '(untagged)') AS attribution, CAST(sum(n) AS BIGINT) AS spans, CAST(sum(coalesce(total_tokens, 0) * n) AS BIGINT) AS tokens, CAST(sum(CAST(round(cost * 1e12) AS HUGEINT) * n) AS DOUBLE) / 1e12 AS cost_usd, CAST(coalesce(sum(n) FILTER (cost IS NULL), 0) AS BIGINT) AS missing_cost, CAST(NULL AS BIGINT) AS groups FROM w GROUP BY attribution
UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), CAST(sum(coalesce(total_tokens, 0) * n) AS BIGINT), CAST(sum(CAST(round(cost * 1e12) AS HUGEINT) * n) AS DOUBLE) / 1e12, CAST(coalesce(sum(n) FILTER (cost IS NULL), 0) AS BIGINT), count(DISTINCT attribution) + CAST(bool_or(attribution IS NULL) AS BIGINT) FROM w"""
spans_query("AGG-4", lambda s: cost.reprice(s, PRICES), _REPRICE)
_HOSTED = _PRICED.replace("{shapes}", _SHAPES.replace("{where}", "{llm}")).replace("{k}", "4") + """,
w AS (SELECT *, CASE WHEN prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL THEN usd END AS hosted FROM v)
SELECT coalesce(attribution, '(untagged)') AS attribution, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(coalesce(total_tokens, 0) * n) AS BIGINT) AS tokens, sum(cost_usd * n) AS cost_usd, CAST(coalesce(sum(n) FILTER (cost_usd IS NULL), 0) AS BIGINT) AS missing_cost, round(coalesce(sum(hosted * n), 0), 6) AS as_hosted_usd, CAST(coalesce(sum(n) FILTER (hosted IS NULL), 0) AS BIGINT) AS no_tokens FROM w GROUP BY attribution
UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), CAST(sum(coalesce(total_tokens, 0) * n) AS BIGINT), sum(cost_usd * n), CAST(coalesce(sum(n) FILTER (cost_usd IS NULL), 0) AS BIGINT), round(coalesce(sum(hosted * n), 0), 6), CAST(coalesce(sum(n) FILTER (hosted IS NULL), 0) AS BIGINT) FROM w"""
spans_query("AGG-5", lambda s: rounded(cost.reprice_as(s, PRICES, "eu.vendor/m-tier-v1:0"), ["as_hosted_usd"]), _HOSTED)
_NOW = 1_706_000_000_000_000_000
spans_query("AGG-6", lambda s: rounded(cost.gpu_rate(s, ["m-plain", "m-cache"], 240 * HOUR, _NOW, 2, 1.5), ["coverage", "input_per_token", "output_per_token"], 12), f"""SELECT calls, input_tokens, output_tokens, 720.0e0 AS gpu_cost_usd,
  round(CASE WHEN last > first THEN least((last - first) / {240 * HOUR}.0e0, 1.0e0) ELSE 0.0e0 END, 12) AS coverage, round(720.0e0 / (input_tokens + 4.0e0 * output_tokens), 12) AS input_per_token, round(720.0e0 / (input_tokens + 4.0e0 * output_tokens) * 4.0e0, 12) AS output_per_token
  FROM (SELECT count(*) AS calls, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS output_tokens, min(start_unix_nano) AS first, max(end_unix_nano) AS last
  FROM spans WHERE {{llm}} AND model IN ('m-plain', 'm-cache') AND start_unix_nano >= {_NOW - 240 * HOUR})""")
table_query("AGG-7", "documents", lambda d: rounded(joins.language_tax(d.select("lang", F.col("source").alias("model"), "text", F.ceil(F.char_length("text") / 4).alias("tokens"))), ["tokens_per_char", "vs_english"], 9), """
WITH a AS (SELECT lang, source AS model, count(*) AS answers, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CAST(ceil(length(text) / 4) AS BIGINT)) AS BIGINT) AS tokens FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
SELECT a.lang, a.model, a.answers, a.chars, a.tokens, round(a.tokens / a.chars, 9) AS tokens_per_char, round((a.tokens / a.chars) / (e.tokens / e.chars), 9) AS vs_english FROM a LEFT JOIN a e ON e.lang = 'en' AND e.model IS NOT DISTINCT FROM a.model""")
spans_query("AGG-8", usage.egress, f"""SELECT host, ip, jurisdiction, purpose, count(*) AS calls, count(*) FILTER (outcome = 'refused') AS refused, count(*) FILTER (outcome = 'error') AS errors, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, min(s) AS first, max(s) AS last FROM
  (SELECT coalesce({attr_sql('server.address')}, '-') AS host, coalesce({attr_sql('network.peer.address')}, '-') AS ip, coalesce({attr_sql('spanmill.egress.jurisdiction')}, '-') AS jurisdiction, coalesce({attr_sql('spanmill.egress.purpose')}, '-') AS purpose, coalesce({attr_sql('spanmill.egress.outcome')}, '-') AS outcome,
  coalesce(CAST({attr_sql('spanmill.egress.bytes_out')} AS BIGINT), 0) AS bytes_out, coalesce(CAST({attr_sql('spanmill.egress.bytes_in')} AS BIGINT), 0) AS bytes_in, start_unix_nano AS s FROM spans WHERE service_name = 'spanmill-egress') GROUP BY ALL""")
_SERIES = "coalesce(provider, 'unknown') AS provider, coalesce(model, 'unknown') AS model, coalesce(service_name, 'unknown') AS service"
spans_query("AGG-17", usage.series, f"""SELECT {_SERIES}, count(*) AS calls, count(*) FILTER (status_code = 2) AS errors, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens,
  CAST(coalesce(sum(cache_write_tokens), 0) AS BIGINT) AS cache_write_tokens, CAST(coalesce(sum(reasoning_tokens), 0) AS BIGINT) AS reasoning_tokens, coalesce(sum(cost_usd), 0.0e0) AS cost_usd, count(*) FILTER (cost_usd IS NULL) AS unpriced FROM spans WHERE {{llm}} GROUP BY ALL""")
for _what, _value in (("latency", f"{DUR} / 1e9"), ("ttft", TTFT)):
    spans_query(f"AGG-18-{_what}", lambda s, w=_what: rounded(usage.histogram(s, w), ["total"]), f"SELECT provider, model, service, {', '.join(f'count(*) FILTER (v <= {b!r}) AS le_{k:02}' for k, b in enumerate(usage.BOUNDS))}, count(*) AS n, round(sum(v), 6) AS total FROM (SELECT {_SERIES}, {_value} AS v FROM spans WHERE {{llm}}) WHERE v IS NOT NULL GROUP BY ALL")
spans_query("AGG-19", usage.tools, f"SELECT coalesce({attr_sql('gen_ai.tool.name')}, name) AS tool, coalesce(service_name, 'unknown') AS service, count(*) AS calls, count(*) FILTER (status_code = 2) AS errors FROM spans WHERE oi_kind = 'TOOL' GROUP BY ALL")
both_query("AGG-20", lambda _, c: usage.rolling_scores(c, 1024), "SELECT name, avg(num_value) AS mean, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts_unix_nano DESC, id DESC) AS rn FROM scores WHERE target_type <> 'run' AND num_value IS NOT NULL) WHERE rn <= 1024 GROUP BY name")
both_query("AGG-22", lambda s, _: s.cube("provider", "dialect").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.countDistinct("model").alias("models"), F.max("total_tokens").alias("most")), "SELECT provider, dialect, CAST(grouping(provider, dialect) AS INT) AS level, count(*) AS n, count(DISTINCT model) AS models, max(total_tokens) AS most FROM spans GROUP BY CUBE (provider, dialect)")
spans_query("STR-2-batch", lambda s: usage.bounded(s, models=2), f"""SELECT provider, CASE WHEN model IN (SELECT model FROM (SELECT coalesce(model, 'unknown') AS model, min((start_unix_nano, span_id)) AS seen FROM spans WHERE {{llm}} GROUP BY 1 ORDER BY seen LIMIT 2)) THEN model ELSE 'other' END AS model, service, count(*) AS calls, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens
  FROM (SELECT {_SERIES}, total_tokens FROM spans WHERE {{llm}}) GROUP BY ALL""")

# latency, windows
_RANKED = "SELECT *, row_number() OVER (PARTITION BY k ORDER BY ns) AS rn, count(*) OVER (PARTITION BY k) AS n FROM (SELECT {column} AS k, status_code, {dur} AS ns FROM spans WHERE {llm})"
for _by, _column in latency.DIMENSIONS.items():
    spans_query("LAT-1" if _by == "model" else f"LAT-1-{_by}", lambda s, by=_by: rounded(latency.report(s, by), ["ttft_p50_ms", "ttft_p95_ms"]), f""", r AS ({_RANKED.replace("{column}", _column).replace("{dur}", DUR)}),
  a AS (SELECT k, count(*) AS spans, count(*) FILTER (status_code = 2) AS errors, min(ns) FILTER (rn >= ceil(0.5 * n)) AS p50_ns, min(ns) FILTER (rn >= ceil(0.95 * n)) AS p95_ns, min(ns) FILTER (rn >= ceil(0.99 * n)) AS p99_ns, max(ns) AS max_ns FROM r GROUP BY k),
  t AS (SELECT {_column} AS k, count(v) AS ttft_known, quantile_disc(v, 0.5) AS q50, quantile_disc(v, 0.95) AS q95 FROM (SELECT {_column}, {TTFT} * 1e3 AS v FROM spans WHERE {{llm}}) GROUP BY 1)
  SELECT coalesce(a.k, '(untagged)') AS attribution, spans, errors, p50_ns, p95_ns, p99_ns, max_ns, coalesce(ttft_known, 0) AS ttft_known, round(q50, 6) AS ttft_p50_ms, round(q95, 6) AS ttft_p95_ms FROM a LEFT JOIN t ON a.k IS NOT DISTINCT FROM t.k""")
_PH = [f"{c}_p{q}_ms" for c in ("queue", "prefill", "decode", "server", "gap") for q in (50, 95)]
spans_query("LAT-3", lambda s: rounded(latency.server_breakdown(s), _PH), f""", v AS (SELECT trace_id, parent_span_id, model, {', '.join(f"TRY_CAST({attr_sql(key)} AS DOUBLE) * 1e3 AS {n}" for n, key in A.PHASES)} FROM spans WHERE name = 'llm_request' AND otel_kind = 2 AND {attr_sql('gen_ai.latency.e2e')} IS NOT NULL),
  j AS (SELECT coalesce(c.model, v.model, '(unknown)') AS model, queue, prefill, decode, server, c.span_id AS met, CASE WHEN c.end_unix_nano >= c.start_unix_nano THEN greatest((c.end_unix_nano - c.start_unix_nano) / 1e6 - server, 0.0e0) END AS gap FROM v LEFT JOIN spans c ON c.trace_id = v.trace_id AND c.span_id = v.parent_span_id)
  SELECT model, count(*) AS calls, count(met) AS parented, {', '.join(f"round(quantile_disc({c}, {q / 100}), 6) AS {c}_p{q}_ms" for c in ("queue", "prefill", "decode", "server", "gap") for q in (50, 95))} FROM j GROUP BY model""")
spans_query("WIN-4", lambda s: latency.rolling_p95(s, 50, 20), f"SELECT service_name, span_id, CASE WHEN len(l) >= 20 THEN list_sort(l)[CAST(ceil(len(l) * 0.95) AS INT)] END AS p95_ns FROM (SELECT service_name, span_id, list({DUR}) OVER (PARTITION BY service_name ORDER BY start_unix_nano, span_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS l FROM spans WHERE {{llm}})")
spans_query("WIN-5", lambda s: ordered.tiles(ordered.in_ranges(s.select("service_name", "start_unix_nano", "span_id", "session_id", "trace_id", "model"), "service_name", ["start_unix_nano", "span_id"]), "service_name", ["start_unix_nano", "span_id"], 4).select("span_id", F.dense_rank().over(W.partitionBy("session_id").orderBy("model")).alias("dr"), F.col("tile").alias("quarter"), F.lead("span_id").over(W.partitionBy("trace_id").orderBy("start_unix_nano", "span_id")).alias("next")), "SELECT span_id, CAST(dense_rank() OVER (PARTITION BY session_id ORDER BY model NULLS FIRST) AS INT) AS dr, CAST(ntile(4) OVER (PARTITION BY service_name ORDER BY start_unix_nano, span_id) AS INT) AS quarter, lead(span_id) OVER (PARTITION BY trace_id ORDER BY start_unix_nano, span_id) AS next FROM spans")

# sessions
spans_query("SES-1", lambda s: sessions.base(s).withColumns({"models": F.array_join("models", ","), "agents": F.array_join("agents", ",")}), f"""SELECT session_id, count(*) AS span_count, count(DISTINCT trace_id) AS trace_count, sum(cost_usd) AS cost_usd, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in sessions.TOKENS)}, min(start_unix_nano) AS start_unix_nano, max(end_unix_nano) AS end_unix_nano,
  count(*) FILTER (oi_kind = 'LLM') AS llm_calls, count(*) FILTER (oi_kind = 'LLM' AND status_code = 2) AS llm_errors, coalesce(string_agg(DISTINCT model, ',' ORDER BY model) FILTER (oi_kind = 'LLM'), '') AS models, '' AS agents FROM spans WHERE session_id IS NOT NULL GROUP BY session_id""")
_CALLS = f""", tools AS (SELECT session_id, coalesce('id:' || {attr_sql('gen_ai.tool.call.id')}, 'span:' || trace_id || ':' || span_id) AS call, trace_id, span_id, parent_span_id, start_unix_nano AS st, {attr_sql('gen_ai.tool.call.id')} IS NOT NULL AS by_id, {attr_sql('gen_ai.tool.name')} AS nm, {attr_sql('gen_ai.tool.call.arguments')} AS ar, status_code = 2 AS bad FROM spans WHERE session_id IS NOT NULL AND oi_kind = 'TOOL'),
  calls AS (SELECT session_id, call, min_by(trace_id, (st, trace_id, span_id)) AS trace_id, min_by(span_id, (st, trace_id, span_id)) AS span_id, min_by(coalesce(parent_span_id, ''), (st, trace_id, span_id)) AS parent, min_by(nm, (st, trace_id, span_id)) AS name, min(st) AS start, min_by(ar, (st, trace_id, span_id)) FILTER (ar IS NOT NULL) AS arguments, bool_or(bad) AS failed, bool_or(by_id) AS by_id FROM tools GROUP BY session_id, call),
  ups AS (SELECT c.session_id, c.call, p.call AS up FROM calls c JOIN calls p ON p.session_id = c.session_id AND p.trace_id = c.trace_id AND p.span_id = c.parent AND p.name = c.name AND p.call <> c.call),
  climb AS (SELECT session_id, call, up, 1 AS k FROM ups UNION ALL SELECT l.session_id, l.call, u.up, k + 1 FROM climb l JOIN ups u ON u.session_id = l.session_id AND u.call = l.up),
  outer_ AS (SELECT session_id, call, max_by(up, k) AS up FROM climb GROUP BY ALL),
  moved AS (SELECT o.* , c.failed FROM outer_ o JOIN calls c USING (session_id, call) WHERE NOT c.by_id),
  kept AS (SELECT c.session_id, c.call, c.trace_id, c.span_id, c.name, c.start, c.arguments, c.failed OR coalesce((SELECT bool_or(m.failed) FROM moved m WHERE m.session_id = c.session_id AND m.up = c.call), false) AS failed FROM calls c ANTI JOIN moved m USING (session_id, call))"""
spans_query("SES-4", lambda s: sessions.tool_calls(s).drop("by_id"), f"{_CALLS} SELECT session_id, call, trace_id, span_id, name, start, arguments, failed FROM kept")
_RUNS = """, seq AS (SELECT *, coalesce(lag(name) OVER o = name AND lag(arguments) OVER o = arguments, false) AS same FROM kept WINDOW o AS (PARTITION BY session_id, trace_id ORDER BY start, span_id)),
  isl AS (SELECT *, sum(CAST(NOT same AS INT)) OVER (PARTITION BY session_id, trace_id ORDER BY start, span_id) AS island FROM seq),
  run AS (SELECT session_id, count(*) AS run, count(*) FILTER (same) AS again, bool_or(arguments IS NOT NULL) AS known FROM isl GROUP BY session_id, trace_id, island),
  rep AS (SELECT session_id, CAST(sum(again) AS BIGINT) AS repeated_tool_calls, max(CASE WHEN known THEN run ELSE 0 END) AS longest_repeat_run FROM run GROUP BY session_id)"""
spans_query("WIN-2", lambda s: sessions.repeats(sessions.tool_calls(s)), f"{_CALLS}{_RUNS} SELECT * FROM rep")
spans_query("AGG-9", lambda s: sessions.rollup(s).select("session_id", "span_count", "llm_calls", "tool_calls", "tool_errors", F.array_join(F.transform(F.map_entries("tools"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("tools"), F.round("steps_per_trace", 9).alias("steps_per_trace"), F.round("tool_error_rate", 9).alias("tool_error_rate"), "repeated_tool_calls", "longest_repeat_run", "loop_suspected"), f"""{_CALLS}{_RUNS},
  h AS (SELECT session_id, name, count(*) AS k, count(*) FILTER (failed) AS bad FROM kept GROUP BY ALL), t AS (SELECT session_id, CAST(sum(k) AS BIGINT) AS tool_calls, CAST(sum(bad) AS BIGINT) AS tool_errors, string_agg(name || '=' || k, ',' ORDER BY name) AS tools FROM h GROUP BY ALL),
  b AS (SELECT session_id, count(*) AS span_count, count(*) FILTER (oi_kind = 'LLM') AS llm_calls, count(DISTINCT trace_id) AS traces FROM spans WHERE session_id IS NOT NULL GROUP BY ALL)
  SELECT session_id, span_count, llm_calls, coalesce(tool_calls, 0) AS tool_calls, coalesce(tool_errors, 0) AS tool_errors, coalesce(tools, '') AS tools, round(llm_calls / traces, 9) AS steps_per_trace, round(tool_errors / tool_calls, 9) AS tool_error_rate, coalesce(repeated_tool_calls, 0) AS repeated_tool_calls, coalesce(longest_repeat_run, 0) AS longest_repeat_run, coalesce(longest_repeat_run, 0) >= 3 AS loop_suspected FROM b LEFT JOIN t USING (session_id) LEFT JOIN rep USING (session_id)""")

# traces
both_query("TRC-5", lambda s, c: rounded(traces.rollup(s, c).drop("contributing_span_ids"), ["value"], 9), """, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_type, target_id, name ORDER BY ts_unix_nano DESC, id DESC) AS rn FROM scores WHERE num_value IS NOT NULL) WHERE rn = 1),
  names AS (SELECT DISTINCT s.trace_id, o.name FROM spans s JOIN one o ON o.target_type = 'span' AND o.target_id = s.span_id),
  hits AS (SELECT target_id AS span_id, name, num_value FROM one WHERE target_type = 'span' AND data_type NOT IN ('categorical', 'text')),
  walk AS (SELECT s.trace_id, s.span_id, n.name, h.num_value FROM spans s JOIN names n USING (trace_id) LEFT JOIN hits h ON h.span_id = s.span_id AND h.name = n.name WHERE s.parent_span_id IS NULL
    UNION ALL SELECT s.trace_id, s.span_id, w.name, h.num_value FROM walk w JOIN spans s ON s.trace_id = w.trace_id AND s.parent_span_id = w.span_id LEFT JOIN hits h ON h.span_id = s.span_id AND h.name = w.name WHERE w.num_value IS NULL)
  SELECT target_id AS trace_id, name, num_value AS value, true AS measured, CAST(NULL AS VARCHAR) AS function, CAST(1 AS BIGINT) AS n, data_type FROM one WHERE target_type = 'trace'
  UNION ALL SELECT w.trace_id, w.name, round(avg(w.num_value), 9), false, 'mean', count(*), 'numeric' FROM walk w WHERE w.num_value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM one o WHERE o.target_type = 'trace' AND o.target_id = w.trace_id AND o.name = w.name) GROUP BY w.trace_id, w.name""")
both_query("TRC-5-carriers", lambda s, c: traces.carriers(s, c).select("trace_id", "name", "span_id", "num_value"), """, held AS (SELECT target_id AS span_id, name, num_value FROM scores WHERE target_type = 'span' AND num_value IS NOT NULL AND data_type NOT IN ('categorical', 'text')
    QUALIFY row_number() OVER (PARTITION BY target_id, name ORDER BY ts_unix_nano DESC, id DESC) = 1),
  scored AS (SELECT s.trace_id, s.span_id, s.parent_span_id, h.name, h.num_value FROM spans s JOIN held h USING (span_id)),
  climb AS (SELECT trace_id, span_id, name, parent_span_id AS above FROM scored WHERE parent_span_id IS NOT NULL
    UNION ALL SELECT c.trace_id, c.span_id, c.name, s.parent_span_id FROM climb c JOIN spans s ON s.trace_id = c.trace_id AND s.span_id = c.above WHERE s.parent_span_id IS NOT NULL)
  SELECT trace_id, name, span_id, num_value FROM scored s WHERE NOT EXISTS (SELECT 1 FROM climb c JOIN held h ON h.span_id = c.above AND h.name = c.name WHERE c.trace_id = s.trace_id AND c.span_id = s.span_id AND c.name = s.name)
    AND NOT EXISTS (SELECT 1 FROM scores o WHERE o.target_type = 'trace' AND o.num_value IS NOT NULL AND o.target_id = s.trace_id AND o.name = s.name)""")
both_query("TRC-3", lambda s, c: traces.scores_of_trace(s, c).select("trace_id", "id", "name"), "SELECT target_id AS trace_id, id, name FROM scores WHERE target_type = 'trace' UNION ALL SELECT s.trace_id, c.id, c.name FROM scores c JOIN spans s ON c.target_id = s.span_id WHERE c.target_type = 'span'")
both_query("TRC-7", lambda s, c: rounded(traces.persisted(traces.rollup(s, c), _NOW), ["num_value"], 9))
spans_query("TRC-2", lambda s: traces.recent(s, 100).select("trace_id", "span_id", "start_unix_nano"), "SELECT trace_id, span_id, start_unix_nano FROM spans ORDER BY start_unix_nano DESC, trace_id, span_id LIMIT 100")
spans_query("TRC-9", lambda s: traces.dataset(s, 500, "m-plain").drop("metadata"), "SELECT span_id AS id, input_value AS input, output_value AS output, span_id, trace_id FROM (SELECT * FROM spans WHERE model = 'm-plain' ORDER BY start_unix_nano DESC, trace_id, span_id LIMIT 500) WHERE output_value <> ''")
spans_query("NRM-20", lambda s: traces.orphans(s.where(F.col("oi_kind") != "TOOL")).select("trace_id", "span_id"), "SELECT trace_id, span_id FROM spans s WHERE oi_kind <> 'TOOL' AND parent_span_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spans p WHERE p.oi_kind <> 'TOOL' AND p.trace_id = s.trace_id AND p.span_id = s.parent_span_id)")
spans_query("JOI-9", lambda s: traces.forest(s), "SELECT s.trace_id, s.span_id, p.span_id AS up FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id")

# joins, sets, sorts
both_query("JOI-1", lambda s, c: joins.mean_by_model(s, c), "SELECT model, c.name AS score, avg(num_value) AS mean, count(num_value) AS n FROM scores c JOIN spans s ON c.target_id = s.span_id WHERE c.target_type = 'span' GROUP BY ALL")
_split = lambda s: (s.where(F.pmod(F.col("start_unix_nano"), F.lit(10)) == 0).withColumn("name", F.lit("hot")), s)
spans_query("JOI-2", lambda s: sqlgate.spans_view(s.where("oi_kind = 'TOOL'").withColumn("name", F.lit("hot")), s).groupBy("name").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN oi_kind = 'TOOL' THEN 'hot' ELSE name END AS name, count(*) AS n FROM spans GROUP BY 1")
spans_query("JOI-13", joins.parent_child, "SELECT p.oi_kind AS parent, c.oi_kind AS child, count(*) AS pairs FROM spans c JOIN spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id GROUP BY ALL")
add("JOI-14", lambda s, d: s.read.parquet(f"{d}/customer.parquet").join(s.read.parquet(f"{d}/orders.parquet"), F.col("c_custkey") == F.col("o_custkey"), "full").groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("orders"), F.count_if(F.col("o_orderkey").isNull()).alias("idle")), "SELECT c_mktsegment, count(o_orderkey) AS orders, count(*) FILTER (o_orderkey IS NULL) AS idle FROM customer FULL JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
add("JOI-14-semi", lambda s, d: s.read.parquet(f"{d}/part.parquet").join(s.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), "SELECT p_brand, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) GROUP BY ALL")
add("FLT-1", lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").where("l_quantity < 24 AND l_discount BETWEEN 0.05 AND 0.07").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue")), "SELECT count(*) AS n, round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_quantity < 24 AND l_discount BETWEEN 0.05 AND 0.07")
spans_query("FLT-2", lambda s: s.where(A.is_llm()).groupBy("oi_kind", "model").agg(F.count(F.lit(1)).alias("n")), "SELECT oi_kind, model, count(*) AS n FROM spans WHERE {llm} GROUP BY ALL")
spans_query("FLT-4", lambda s: s.where(F.col("model").isin("m-plain", "it's")).select("span_id"), "SELECT span_id FROM spans WHERE model IN ('m-plain', 'it''s')")
both_query("FLT-9", lambda s, c: maintenance.validate_targets(c, s.where("oi_kind <> 'TOOL'")).groupBy("target_type", "target_state").agg(F.count(F.lit(1)).alias("n")), "SELECT target_type, CASE WHEN k THEN 'matched' ELSE 'unmatched' END AS target_state, count(*) AS n FROM (SELECT c.target_type, CASE c.target_type WHEN 'span' THEN EXISTS (SELECT 1 FROM spans s WHERE s.oi_kind <> 'TOOL' AND s.span_id = c.target_id) ELSE EXISTS (SELECT 1 FROM spans s WHERE s.oi_kind <> 'TOOL' AND s.trace_id = c.target_id) END AS k FROM scores c) GROUP BY ALL")
both_query("SRT-6", lambda _, c: c.orderBy(F.desc("ts_unix_nano"), F.desc("id")).limit(50).select("id", "ts_unix_nano"), "SELECT id, ts_unix_nano FROM scores ORDER BY ts_unix_nano DESC, id DESC LIMIT 50")
both_query("SRT-4", lambda _, c: evals.failing(c, "run1", 0.3).select("id", "num_value"), "SELECT id, num_value FROM scores WHERE config_id = 'run1' AND id NOT LIKE 'run:agg:%' AND num_value < 0.3e0")
spans_query("SRT-2", lambda s: s.select("trace_id", "span_id", F.row_number().over(W.partitionBy("trace_id").orderBy("start_unix_nano", "span_id")).alias("place")), "SELECT trace_id, span_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY start_unix_nano, span_id) AS INT) AS place FROM spans")
spans_query("SET-2", lambda s: maintenance.first_copy(s.union(s)).select("trace_id", "span_id", "name"), "SELECT trace_id, span_id, name FROM spans")
spans_query("SET-3", lambda s: s.where("oi_kind = 'LLM'").select("trace_id", "service_name").intersect(s.where("oi_kind = 'TOOL'").select("trace_id", "service_name")).exceptAll(s.where("oi_kind = 'AGENT'").select("trace_id", "service_name")), "(SELECT trace_id, service_name FROM spans WHERE oi_kind = 'LLM' INTERSECT SELECT trace_id, service_name FROM spans WHERE oi_kind = 'TOOL') EXCEPT ALL SELECT trace_id, service_name FROM spans WHERE oi_kind = 'AGENT'")

# sources, sinks, normalisation, scalars
# DuckDB's levenshtein counts bytes: in its SQL, letters beyond ASCII become control characters first
_WIDE = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüàâô"
_NARROW = "".join(map(chr, [*range(1, 9), *range(14, 14 + len(_WIDE) - 8)]))
_DISTANCE = f"levenshtein(translate(output, '{_WIDE}', '{_NARROW}'), translate(expected_output, '{_WIDE}', '{_NARROW}'))"


def received(spans: DataFrame) -> DataFrame:
    """The spans as export requests that lie in files, as a collector leaves them."""
    return otlp.parse_traces(save(otlp.to_otlp(spans), "requests"))


_CORE = ["trace_id", "span_id", "parent_span_id", "name", "otel_kind", "start_unix_nano", "end_unix_nano", "status_code", "provider", "service_name", "scope_name", "session_id", "user_id", "input_value", "output_value"]
spans_query("SRC-1", lambda s: otlp.normalise(received(s)).select(*_CORE), f"SELECT {', '.join(_CORE)} FROM spans")
spans_query("NRM-3", lambda s: otlp.normalise(received(s)).select("span_id", "model", *list(otlp.TOKEN_KEYS)), """SELECT span_id, model, CASE WHEN a THEN NULL ELSE prompt_tokens END AS prompt_tokens, CASE WHEN a THEN NULL ELSE completion_tokens END AS completion_tokens, CASE WHEN a THEN NULL ELSE coalesce(total_tokens, prompt_tokens + completion_tokens) END AS total_tokens,
  CASE WHEN a THEN NULL ELSE cache_read_tokens END AS cache_read_tokens, CASE WHEN a THEN NULL ELSE cache_write_tokens END AS cache_write_tokens, CASE WHEN a THEN NULL ELSE reasoning_tokens END AS reasoning_tokens FROM (SELECT *, coalesce(oi_kind IN ('AGENT', 'CHAIN') AND otel_kind <> 3, false) AS a FROM spans)""")
spans_query("SNK-2", lambda s: s.groupBy(maintenance.hour_of(F.col("start_unix_nano")).alias("hour")).agg(F.count(F.lit(1)).alias("n")), "SELECT strftime(make_timestamp(start_unix_nano // 1000), '%Y/%m/%d/%H') AS hour, count(*) AS n FROM spans GROUP BY 1")
both_query("SNK-5", lambda _, c: maintenance.upsert_scores(c, c.where("name = 'quality'").withColumns({"num_value": F.lit(1.0), "seq": F.lit(1).cast("long")})).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("num_value").alias("total")), "SELECT name, count(*) AS n, sum(CASE WHEN name = 'quality' THEN 1.0e0 ELSE num_value END) AS total FROM scores GROUP BY name")
both_query("SNK-9", lambda _, c: maintenance.evaluation_events(c, 200).select("id", "ts_unix_nano"), "SELECT id, ts_unix_nano FROM scores WHERE target_type IN ('span', 'trace') ORDER BY ts_unix_nano DESC, id DESC LIMIT 200")
table_query("SNK-10", "documents", lambda d: (lambda x: x[0].withColumn("ref", F.startswith("text", F.lit("blob:"))).groupBy("ref").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(x[1].agg(F.count(F.lit(1)).alias("blobs"))), F.lit(True)))(maintenance.offload(d, "text", 4096)), "SELECT strlen(text) > 4096 AS ref, count(*) AS n, (SELECT count(DISTINCT text) FROM documents WHERE strlen(text) > 4096) AS blobs FROM documents GROUP BY 1")
table_query("SRC-15", "documents", lambda d: (lambda x: maintenance.resolve(x[0], x[1], "text").select("doc_id", F.sha2("text", 256).alias("digest")))(maintenance.offload(d, "text", 4096)), "SELECT doc_id, sha256(text) AS digest FROM documents")
spans_query("SNK-13", lambda s: maintenance.expired(s, _NOW - 240 * HOUR).select(F.concat_ws("/", F.translate("date", "-", "/"), "hour").alias("hour"), "newest", "spans"), f"SELECT strftime(make_timestamp(start_unix_nano // 1000), '%Y/%m/%d/%H') AS hour, max(start_unix_nano) AS newest, count(*) AS spans FROM spans GROUP BY 1 HAVING max(start_unix_nano) < {_NOW - 240 * HOUR}")
spans_query("PRJ-2", lambda s: s.select("span_id", A.attr(A.JSON, "gen_ai.tool.call.arguments").alias("args"), A.attr(A.JSON, "llm.cost.total").alias("cost"), A.attr(A.JSON, "none").alias("none")), f"SELECT span_id, {attr_sql('gen_ai.tool.call.arguments')} AS args, {attr_sql('llm.cost.total')} AS cost, CAST(NULL AS VARCHAR) AS none FROM spans")
spans_query("SCL-4", lambda s: s.select("span_id", F.round(A.ttft_seconds(), 9).alias("ttft")), f"SELECT span_id, round({TTFT}, 9) AS ttft FROM spans")
items_query("SCL-7", lambda i: i.select("id", F.round(1 - X.distance(F.col("output"), F.col("expected_output")) / F.greatest(F.length("output"), F.length("expected_output")), 9).alias("s")), f"SELECT id, round(1 - {_DISTANCE} / greatest(length(output), length(expected_output)), 9) AS s FROM items")
table_query("SCL-9", "documents", lambda d: d.select("doc_id", X.script_share(F.col("text"), F.lit("Latin")).alias("latin")))
table_query("SCL-8", "documents", lambda d: d.select("doc_id", F.sha2(X.normalised(F.col("text")), 256).alias("digest")))
table_query("NRM-21", "documents", lambda d: d.select(F.explode(R.hit_counts(F.col("text"), R.Policy("email,ip,phone"))).alias("h")).groupBy("h.class").agg(F.sum("h.hits").alias("hits")))
table_query("NRM-21-email", "documents", lambda d: d.select("doc_id", F.sha2(R.redacted(F.col("text"), R.Policy("email")), 256).alias("digest")), f"SELECT doc_id, sha256(regexp_replace(text, '{R.CLASSES['email'].replace(chr(39), chr(39) * 2)}', '[REDACTED:email]', 'g')) AS digest FROM documents")
spans_query("PRC-1", lambda s: pricing.with_price(s.select("model").where("model IS NOT NULL").distinct(), PRICES).select("model", F.col("price.input").alias("input")), "SELECT DISTINCT model, CASE WHEN model LIKE '%reason%' THEN 2e-6 ELSE 1e-6 END AS input FROM spans WHERE model IS NOT NULL")
_USAGE = """SELECT model AS attribution, model, prompt_tokens, completion_tokens, total_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, cost_usd, 1 AS derived,
  CAST(coalesce(cache_read_tokens, 0) + coalesce(cache_write_tokens, 0) > greatest(coalesce(prompt_tokens, 0), 0) AS INT) AS cache_excl, 0 AS reasoning_add, count(*) AS n FROM spans GROUP BY ALL"""
spans_query("PRC-6", lambda s: pricing.derive_costs(s, PRICES).groupBy("model").agg(F.count("cost_usd").alias("priced"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced"), (F.sum(F.round(F.col("cost_usd") * 1e12).cast("decimal(20,0)")).cast("double") / 1e12).alias("usd")), _PRICED.replace("{shapes}", _USAGE).replace("{k}", "k") + """,
w AS (SELECT *, CASE WHEN cost_usd IS NOT NULL THEN cost_usd WHEN prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL THEN usd END AS cost FROM v)
SELECT model, CAST(coalesce(sum(n) FILTER (cost IS NOT NULL), 0) AS BIGINT) AS priced, CAST(coalesce(sum(n) FILTER (cost IS NULL), 0) AS BIGINT) AS unpriced, CAST(sum(CAST(round(cost * 1e12) AS HUGEINT) * n) AS DOUBLE) / 1e12 AS usd FROM w GROUP BY model""")
spans_query("STR-3-batch", lambda s: __import__("spanmill.streaming.live", fromlist=["sampled"]).sampled(s, 0.0, True, 10.0).groupBy("why").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN status_code = 2 THEN 'error' ELSE 'cost' END AS why, count(*) AS n FROM spans WHERE {llm} AND output_value <> '' AND (status_code = 2 OR cost_usd >= 10) GROUP BY 1")

# evaluation
_STAGED = {"EVL-1": (lambda: evals.exact_match(), "trim(output) = trim(expected_output)", "CAST(trim(output) = trim(expected_output) AS DOUBLE)"), "EVL-2": (lambda: evals.contains("the"), "contains(output, 'the')", "CAST(contains(output, 'the') AS DOUBLE)"),
           "EVL-3": (lambda: evals.regex("[0-9]|ing"), "regexp_matches(output, '[0-9]|ing')", "CAST(regexp_matches(output, '[0-9]|ing') AS DOUBLE)"), "EVL-4": (lambda: evals.json_valid(), "json_valid(output)", "CAST(json_valid(output) AS DOUBLE)"),
           "EVL-5": (lambda: evals.levenshtein(), f"1 - {_DISTANCE} / greatest(length(output), length(expected_output)) >= 0.8", f"1 - {_DISTANCE} / greatest(length(output), length(expected_output))"),
           "EVL-8": (lambda: evals.non_empty(), "length(trim(output)) > 0", "CAST(length(trim(output)) > 0 AS DOUBLE)"), "EVL-9": (lambda: evals.contains_all(["the", "in"]), "contains(output, 'the') AND contains(output, 'in')", "(contains(output, 'the')::INT + contains(output, 'in')::INT) / 2.0e0"),
           "EVL-10": (lambda: evals.contains_any(["the", "der"]), "contains(output, 'the') OR contains(output, 'der')", "CAST(contains(output, 'the') OR contains(output, 'der') AS DOUBLE)"), "EVL-11": (lambda: evals.length_bounds(50, 400), "length(output) BETWEEN 50 AND 400", "CAST(length(output) BETWEEN 50 AND 400 AS DOUBLE)")}
for _name, (_scorer, _pass, _num) in _STAGED.items():
    items_query(_name, lambda i, c=_scorer: i.select("id", c().alias("v")).select("id", F.round("v.value", 9).alias("value"), F.col("v.passed").alias("passed")), f"SELECT id, round({_num}, 9) AS value, {_pass} AS passed FROM items")
_num_items = lambda i: i.select("id", F.char_length("input").cast("string").alias("output"), F.concat(F.lit(" "), F.char_length("output")).alias("expected_output"), F.to_json(F.struct((F.char_length("output") * 1000000).alias("duration_ns"), (F.char_length("input") / 1024).alias("cost_usd"))).alias("metadata"))
for _name, _scorer, _pass in (("EVL-12", lambda: evals.numeric_tolerance(100), "abs(length(input) - length(output)) <= 100"), ("EVL-13", lambda: evals.equals_numeric(), "length(input) = length(output)"), ("EVL-15", lambda: evals.latency(300), "length(output) <= 300"), ("EVL-16", lambda: evals.cost(0.25), "length(input) / 1024 <= 0.25")):
    items_query(_name, lambda i, c=_scorer: _num_items(i).select("id", c().alias("v")).select("id", F.col("v.passed").alias("passed")), f"SELECT id, {_pass} AS passed FROM items")
items_query("EVL-14", lambda i: i.select("id", evals.json_schema({"type": "object"}).alias("v")).select("id", F.col("v.passed").alias("passed")), "SELECT id, false AS passed FROM items")
items_query("EVL-7", lambda i: i.select("id", F.lit('{"language":"de"}').alias("metadata"), "output").select("id", evals.script().alias("v")).select("id", F.col("v.value").alias("value")))
_TWO = lambda: {"exact": evals.exact_match(), "bounds": evals.length_bounds(50, 400), "both": evals.contains_all(["the", "in"])}
_RUN_SQL = ", r AS (SELECT id AS key, slice, 'exact' AS name, CAST(trim(output) = trim(expected_output) AS DOUBLE) AS value, trim(output) = trim(expected_output) AS passed FROM items UNION ALL SELECT id, slice, 'bounds', CAST(length(output) BETWEEN 50 AND 400 AS DOUBLE), length(output) BETWEEN 50 AND 400 FROM items UNION ALL SELECT id, slice, 'both', (contains(output, 'the')::INT + contains(output, 'in')::INT) / 2.0e0, contains(output, 'the') AND contains(output, 'in') FROM items)"
items_query("AGG-11", lambda i: rounded(evals.aggregate(evals.run(i, _TWO()), {"exact": 0.4, "both": 0.9}), ["mean", "variance", "pass_rate"], 9), _RUN_SQL + " SELECT name, count(value) AS scored, count(*) FILTER (value IS NULL) AS skipped, round(avg(value), 9) AS mean, round(coalesce(var_samp(value), 0), 9) AS variance, round(avg(passed::DOUBLE), 9) AS pass_rate, CASE name WHEN 'exact' THEN avg(value) >= 0.4 WHEN 'both' THEN avg(value) >= 0.9 END AS threshold_met FROM r GROUP BY name")
items_query("AGG-12", lambda i: rounded(evals.by_slice(evals.run(i, _TWO()), ["slice"]), ["mean"], 9), _RUN_SQL + " SELECT 'slice' AS slice_by, CAST(slice AS VARCHAR) AS slice, name, round(avg(value), 9) AS mean, count(value) AS n FROM r GROUP BY slice, name")
items_query("AGG-13", lambda i: evals.passed(evals.aggregate(evals.run(i, _TWO()), {"exact": 0.4})), _RUN_SQL + " SELECT avg(value) >= 0.4 AS passed FROM r WHERE name = 'exact'")
items_query("AGG-14", lambda i: evals.suite(evals.run(i, _TWO()).select(F.col("slice").alias("case"), "passed"), 0.5, 0.75), _RUN_SQL + ", c AS (SELECT slice, avg(passed::DOUBLE) AS share FROM r GROUP BY slice) SELECT count(*) AS cases, avg((share + 1e-9 >= 0.5)::DOUBLE) AS pass_rate, avg((share + 1e-9 >= 0.5)::DOUBLE) + 1e-9 >= 0.75 AS passed FROM c")
spans_query("AGG-15", lambda s: s.where(A.is_llm()).agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("input"), F.sum("completion_tokens").alias("output"), F.sum("cost_usd").alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced"), latency.nearest_rank("greatest(end_unix_nano - start_unix_nano, 0)", 0.5).cast("long").alias("p50_ns"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models")), f"SELECT count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS input, CAST(sum(completion_tokens) AS BIGINT) AS output, sum(cost_usd) AS cost_usd, count(*) FILTER (cost_usd IS NULL) AS unpriced, quantile_disc({DUR}, 0.5) AS p50_ns, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM spans WHERE {{llm}}")
items_query("AGG-16", lambda i: evals.estimate(i, 2).select("calls", "input_tokens", "output_tokens"), "SELECT count(*) * 2 AS calls, CAST(sum(CAST(ceil((length(input) + length(output) + length(expected_output)) / 4) AS BIGINT)) * 2 AS BIGINT) AS input_tokens, count(*) * 64 AS output_tokens FROM items")


def _runs(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = c.where("target_type = 'span' AND num_value IS NOT NULL AND config_id IS NOT NULL").select(F.col("target_id").alias("key"), "name", F.col("num_value").alias("value"), "config_id")
    half = lambda r: rows.where(F.col("config_id") == r).groupBy("key", "name").agg(F.avg("value").alias("value"))
    return half("run0"), half("run1")


both_query("EVL-24", lambda _, c: rounded(evals.compare(*_runs(c), tolerance=0.01).select("name", "mean_a", "mean_b", "delta", "n_a", "n_b", "gate_raw"), ["mean_a", "mean_b", "delta"], 9), """, h AS (SELECT config_id, target_id AS key, name, avg(num_value) AS v FROM scores WHERE target_type = 'span' AND num_value IS NOT NULL AND config_id IS NOT NULL GROUP BY ALL),
  m AS (SELECT config_id, name, avg(v) AS mean, count(*) AS n FROM h GROUP BY ALL)
  SELECT coalesce(a.name, b.name) AS name, round(a.mean, 9) AS mean_a, round(b.mean, 9) AS mean_b, round(b.mean - a.mean, 9) AS delta, a.n AS n_a, b.n AS n_b, coalesce(b.mean - a.mean < -0.01, false) AS gate_raw FROM (SELECT * FROM m WHERE config_id = 'run0') a FULL JOIN (SELECT * FROM m WHERE config_id = 'run1') b ON a.name = b.name""")
both_query("EVL-26", lambda _, c: evals.non_inferior(*_runs(c), 0.05).select("name", "pairs", F.round("mean", 9).alias("mean"), "test.verdict"))
both_query("EVL-27", lambda _, c: rounded(evals.calibrate(c, "quality"), ["bias", "mae", "rmse", "pearson", "slope", "intercept", "agreement"], 6).select("n", "bias", "mae", "rmse", "pearson", "slope", "intercept", "agreement"), """, p AS (SELECT j.v AS j, h.v AS h FROM (SELECT target_type, target_id, max_by(num_value, (ts_unix_nano, id)) AS v FROM scores WHERE name = 'quality' AND source = 'eval' AND num_value IS NOT NULL GROUP BY ALL) j JOIN (SELECT target_type, target_id, max_by(num_value, (ts_unix_nano, id)) AS v FROM scores WHERE name = 'quality' AND source = 'human' AND num_value IS NOT NULL GROUP BY ALL) h USING (target_type, target_id))
  SELECT count(*) AS n, round(avg(j - h), 6) AS bias, round(avg(abs(j - h)), 6) AS mae, round(sqrt(avg((j - h) * (j - h))), 6) AS rmse, round(corr(j, h), 6) AS pearson, round(regr_slope(h, j), 6) AS slope, round(avg(h) - regr_slope(h, j) * avg(j), 6) AS intercept, round(avg(((j >= 0.5) = (h >= 0.5))::DOUBLE), 6) AS agreement FROM p""")
_REPEAT = lambda c: c.where("num_value IS NOT NULL AND config_id IS NOT NULL").groupBy(F.col("config_id").alias("run"), F.col("target_id").alias("key")).agg(F.avg("num_value").alias("value"))
both_query("EVL-29", lambda _, c: rounded(evals.stability(_REPEAT(c), 0.4), ["verdict_agreement", "mean_sd", "max_range", "fleiss_kappa"], 9), """, v AS (SELECT config_id AS run, target_id AS key, avg(num_value) AS value FROM scores WHERE num_value IS NOT NULL AND config_id IS NOT NULL GROUP BY ALL),
  i AS (SELECT key, count(*)::DOUBLE AS r, (count(*) FILTER (value >= 0.4))::DOUBLE AS up, stddev_samp(value) AS sd, max(value) - min(value) AS spread FROM v GROUP BY key HAVING count(*) = 2),
  o AS (SELECT count(*) AS items, avg((up = 0 OR up = r)::DOUBLE) AS va, avg(sd) AS sd, max(spread) AS mx, avg((up * up + (r - up) * (r - up) - r) / (r * (r - 1))) AS seen, sum(up) / sum(r) AS p FROM i)
  SELECT CAST(2 AS BIGINT) AS runs, items, round(va, 9) AS verdict_agreement, round(sd, 9) AS mean_sd, round(mx, 9) AS max_range, CASE WHEN abs(1 - (p * p + (1 - p) * (1 - p))) >= 1e-12 THEN round((seen - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 9) END AS fleiss_kappa FROM o""")
both_query("SRT-5", lambda _, c: rounded(evals.least_stable(_REPEAT(c)), ["spread"], 9), ", v AS (SELECT config_id AS run, target_id AS key, avg(num_value) AS value FROM scores WHERE num_value IS NOT NULL AND config_id IS NOT NULL GROUP BY ALL) SELECT key, round(max(value) - min(value), 9) AS spread FROM v GROUP BY key HAVING max(value) > min(value) ORDER BY spread DESC, key LIMIT 5")
both_query("WIN-3", lambda _, c: evals.newest_per_target(c, "quality", F.col("source") == "human").select("target_id", "value"), "SELECT target_id, max_by(num_value, (ts_unix_nano, id)) AS value FROM scores WHERE name = 'quality' AND source = 'human' AND num_value IS NOT NULL GROUP BY target_type, target_id")


# judges: requests and replies in tables
_JUDGE = {"name": "right", "endpoint": "local", "model": "j", "rail": "qa_correctness"}
_KEYED = """, q AS (SELECT *, sha256('1:1' || '5:local' || '1:j' || '14:qa_correctness' || '0:' || strlen(input) || ':' || input || strlen(output) || ':' || output || strlen(expected_output) || ':' || expected_output || '0:') AS key FROM items)"""
_ask = lambda i: judging.requests(i.withColumn("context", F.lit(None).cast("array<string>")), [_JUDGE])
items_query("EVL-18", lambda i: _ask(i).select("id", F.sha2("prompt", 256).alias("digest")), f""" SELECT id, CASE WHEN trim(input) <> '' AND trim(output) <> '' AND trim(expected_output) <> '' THEN sha256('Rate {judging.RAILS["qa_correctness"][1]}. {judging.ANSWER}' || chr(10) || chr(10) || 'INPUT:' || chr(10) || trim(input) || chr(10) || chr(10) || 'EXPECTED_OUTPUT:' || chr(10) || trim(expected_output) || chr(10) || chr(10) || 'OUTPUT:' || chr(10) || trim(output)) END AS digest FROM items""")
items_query("EVL-20", lambda i: _ask(i).select("id", "key"), f"{_KEYED} SELECT id, key FROM q")
items_query("EVL-19", lambda i: (lambda a: rounded(judging.scored(a, a.where("slice <> 3").select("key", F.when(F.col("slice") == 2, "none").otherwise(F.concat(F.lit('so: {"score": 0.'), F.length("input").cast("string"), F.lit(', "reasoning": "r"}'))).alias("reply"))).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("judged"), F.avg("value").alias("mean"), F.count_if("passed").alias("passed")), ["mean"], 9))(_ask(i)), f"""{_KEYED},
  r AS (SELECT key, min(CASE WHEN slice = 2 THEN 0.0 ELSE CAST('0.' || length(input) AS DOUBLE) END) AS v FROM q WHERE slice <> 3 GROUP BY key)
  SELECT slice, count(*) AS n, count(v) AS judged, round(avg(v), 9) AS mean, count(*) FILTER (v >= 0.5) AS passed FROM q LEFT JOIN r USING (key) GROUP BY slice""")
spans_query("NRM-19", lambda s: s.withColumns({c: F.when(~F.col("model").eqNullSafe("m-cache"), F.col(c)) for c in X_COUNTS}).select("span_id", usage_why().alias("why")).where("why IS NOT NULL"), "SELECT span_id, 'no-usage-field' AS why FROM spans WHERE {llm} AND model = 'm-cache'")
