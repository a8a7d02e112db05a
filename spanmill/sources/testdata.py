"""Spans, scores and dataset items derived from the driver's tables, in SQL that Spark and DuckDB both run.

The same text is the CTE that every query's oracle starts from; only the epoch function differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPANS = """
tm_k AS (SELECT event_id, user_id, event_type, value, {us} AS us, {us} - {us} % 604800000000 AS wk FROM {events}),
tm_n AS (SELECT *, row_number() OVER (PARTITION BY user_id, wk ORDER BY us, event_id) AS rn FROM tm_k),
tm_p AS (SELECT user_id, wk, rn, event_id AS parent_id FROM tm_n),
tm_e AS (SELECT n.*, p.parent_id FROM tm_n n LEFT JOIN tm_p p ON n.user_id = p.user_id AND n.wk = p.wk AND CAST(floor(n.rn / 2) AS BIGINT) = p.rn),
spans AS (SELECT
  CASE WHEN event_id % 2 = 0 THEN 'gen_ai' ELSE 'open_inference' END AS dialect,
  md5(concat('t', user_id, ':', wk)) AS trace_id, substr(md5(concat('s', event_id)), 1, 16) AS span_id, CASE WHEN parent_id IS NOT NULL THEN substr(md5(concat('s', parent_id)), 1, 16) END AS parent_span_id,
  CASE WHEN event_type = 'click' THEN concat('tool-', user_id % 4) WHEN event_type = 'view' AND event_id % 6 = 0 THEN 'llm_request' ELSE event_type END AS name,
  CAST(CASE WHEN event_type = 'view' AND event_id % 6 = 0 THEN 2 ELSE 3 END AS INT) AS otel_kind,
  CASE WHEN event_type = 'click' THEN 'TOOL' WHEN event_type = 'signup' THEN 'AGENT' WHEN event_id % 17 <> 0 THEN 'LLM' END AS oi_kind,
  us * 1000 AS start_unix_nano, us * 1000 + CAST(round(value * 1000000) AS BIGINT) AS end_unix_nano,
  CAST(CASE WHEN event_type = 'error' THEN 2 WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS status_code, CASE WHEN event_type = 'error' THEN 'failed' END AS status_message,
  CASE WHEN event_type IN ('click', 'signup') THEN NULL WHEN event_id % 5 = 0 THEN 'm-plain' WHEN event_id % 5 = 1 THEN 'm-cache' WHEN event_id % 5 = 2 THEN 'us.vendor/m-reason-20250929' WHEN event_id % 5 = 3 THEN 'M-Tier@20250101' END AS model,
  CASE WHEN event_id % 3 = 0 THEN 'alpha' WHEN event_id % 3 = 1 THEN 'beta' END AS provider,
  CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 5 = 3 THEN 199000 + event_id % 2000 ELSE 100 + event_id % 900 END END AS prompt_tokens, 10 + event_id % 90 AS completion_tokens,
  CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 5 = 3 THEN 199000 + event_id % 2000 ELSE 100 + event_id % 900 END + 10 + event_id % 90 + CASE WHEN event_id % 10 = 1 THEN event_id % 50 ELSE 0 END END AS total_tokens,
  CASE WHEN event_id % 5 = 1 THEN event_id % 50 END AS cache_read_tokens, CASE WHEN event_id % 35 = 1 THEN 200 * (event_id % 3) END AS cache_write_tokens, CASE WHEN event_id % 5 = 2 THEN event_id % 20 END AS reasoning_tokens,
  CASE WHEN event_id % 4 = 0 THEN (event_id % 1000) / 64.0e0 END AS cost_usd,
  concat('question ', event_id % 40) AS input_value, CASE WHEN event_id % 9 <> 0 THEN concat('answer ', event_id % 70) END AS output_value,
  CASE WHEN event_id % 13 <> 0 THEN concat('s', user_id) END AS session_id, concat('u', user_id) AS user_id,
  CASE WHEN event_type = 'purchase' THEN 'spanmill-egress' ELSE concat('svc', user_id % 3) END AS service_name, 'scope' AS scope_name, CAST(NULL AS STRING) AS scope_version,
  concat('{{', concat_ws(',',
    CASE WHEN event_type = 'view' AND event_id % 6 = 0 THEN concat('"gen_ai.latency.e2e":0.', 100 + event_id % 800) END,
    CASE WHEN event_type = 'view' AND event_id % 6 = 0 THEN concat('"gen_ai.latency.time_in_model_decode":0.', 10 + event_id % 80) END,
    CASE WHEN event_type = 'view' AND event_id % 6 = 0 THEN concat('"gen_ai.latency.time_in_model_prefill":0.0', 10 + event_id % 80) END,
    CASE WHEN event_type = 'view' AND event_id % 12 = 0 THEN concat('"gen_ai.latency.time_in_queue":0.00', 1 + event_id % 9) END,
    CASE WHEN event_id % 6 = 0 THEN concat('"gen_ai.latency.time_to_first_token":0.', 10 + event_id % 90) END,
    CASE WHEN event_type = 'click' AND event_id % 5 <> 0 THEN concat('"gen_ai.tool.call.arguments":"a', event_id % 2, '"') END,
    CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN concat('"gen_ai.tool.call.id":"c', CAST(floor(event_id / 6) AS BIGINT), '"') END,
    CASE WHEN event_type = 'click' THEN concat('"gen_ai.tool.name":"tool-', user_id % 4, '"') END,
    CASE WHEN event_id % 4 = 0 THEN concat('"llm.cost.total":', event_id % 1000, '') END,
    CASE WHEN event_type = 'purchase' THEN concat('"network.peer.address":"10.0.0.', event_id % 4, '"') END,
    CASE WHEN event_type = 'purchase' THEN concat('"server.address":"host', event_id % 3, '"') END,
    CASE WHEN event_type = 'purchase' THEN concat('"spanmill.egress.bytes_in":', event_id % 50) END,
    CASE WHEN event_type = 'purchase' THEN concat('"spanmill.egress.bytes_out":', event_id % 700) END,
    CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN '"spanmill.egress.jurisdiction":"EU"' END,
    CASE WHEN event_type = 'purchase' THEN concat('"spanmill.egress.outcome":"', CASE WHEN event_id % 7 = 0 THEN 'refused' WHEN event_id % 7 = 1 THEN 'error' ELSE 'ok' END, '"') END,
    CASE WHEN event_type = 'purchase' THEN '"spanmill.egress.purpose":"judge"' END,
    CASE WHEN event_id % 10 = 3 THEN concat('"time_to_first_token_ms":"', event_id % 500, '"') END), '}}') AS raw_attributes_json
FROM tm_e)"""

_SCORES = """
scores AS (
SELECT concat('sc', event_id) AS id, 'span' AS target_type, substr(md5(concat('s', event_id)), 1, 16) AS target_id, CASE WHEN event_id % 4 = 0 THEN 'helpful' ELSE 'quality' END AS name,
  CASE WHEN event_id % 19 <> 0 THEN (event_id % 101) / 128.0e0 END AS num_value, CASE WHEN event_id % 19 = 0 THEN 'good' END AS str_value, CASE WHEN event_id % 19 = 0 THEN 'categorical' ELSE 'numeric' END AS data_type,
  CASE WHEN event_id % 6 = 0 THEN 'human' ELSE 'eval' END AS source, CAST(NULL AS STRING) AS comment, concat('run', event_id % 2) AS config_id, us * 1000 AS ts_unix_nano
FROM tm_e WHERE event_id % 3 <> 1
UNION ALL
SELECT concat('ot', event_id), 'span', substr(md5(concat('s', event_id)), 1, 16), CASE WHEN event_id % 4 = 0 THEN 'helpful' ELSE 'quality' END, (event_id * 7 % 103) / 128.0e0, CAST(NULL AS STRING), 'numeric', 'eval', CAST(NULL AS STRING), concat('run', (event_id + 1) % 2), us * 1000 - 5
FROM tm_e WHERE event_id % 3 <> 1
UNION ALL
SELECT concat('hu', event_id), 'span', substr(md5(concat('s', event_id)), 1, 16), CASE WHEN event_id % 4 = 0 THEN 'helpful' ELSE 'quality' END, (event_id % 97) / 128.0e0, CAST(NULL AS STRING), 'numeric', 'human', CAST(NULL AS STRING), CAST(NULL AS STRING), us * 1000 + 5
FROM tm_e WHERE event_id % 3 = 2 AND event_id % 2 = 0
UNION ALL
SELECT concat('tr', event_id), 'trace', md5(concat('t', user_id, ':', wk)), 'quality', (event_id % 11) / 16.0e0, CAST(NULL AS STRING), 'numeric', 'api', CAST(NULL AS STRING), CAST(NULL AS STRING), us * 1000
FROM tm_e WHERE rn = 1 AND event_id % 5 = 0)"""

ITEMS_SQL = """
items AS (SELECT concat(a.conv_id, ':', a.turn) AS id, a.text AS input, b.text AS output, CASE WHEN a.conv_id % 2 = 0 THEN b.text ELSE translate(b.text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS expected_output, a.conv_id % 4 AS slice
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""

#: The CTEs as DuckDB reads them: spans and scores.
DUCK = _SPANS.format(us="epoch_us(ts)", events="events").replace("AS STRING", "AS VARCHAR") + "," + _SCORES.replace("AS STRING", "AS VARCHAR")
_SPARK = _SPANS.format(us="unix_micros(CAST(ts AS TIMESTAMP))", events="{events}")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _run(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    text = sql.replace("concat('{'", "concat('{{'").replace("'}')", "'}}')")
    return spark.sql(text, **frames)


#: Folders that hold a table folder's spans and scores as Parquet, where they were written before (as the benchmark does).
WRITTEN: dict[str, str] = {}


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write spans and scores once; later queries over sf_dir read them."""
    WRITTEN.pop(sf_dir, None)
    spans(spark, sf_dir).write.parquet(f"{path}/spans")
    scores(spark, sf_dir).write.parquet(f"{path}/scores")
    WRITTEN[sf_dir] = path


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    if sf_dir in WRITTEN:
        return spark.read.parquet(f"{WRITTEN[sf_dir]}/spans")
    return _run(spark, f"WITH {_SPARK} SELECT * FROM spans", events=_events(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    if sf_dir in WRITTEN:
        return spark.read.parquet(f"{WRITTEN[sf_dir]}/scores")
    return _run(spark, f"WITH {_SPARK}, {_SCORES} SELECT * FROM scores", events=_events(spark, sf_dir))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return spark.sql(f"WITH {ITEMS_SQL} SELECT * FROM items".replace("FROM conversations a JOIN conversations b", "FROM {c} a JOIN {c} b"), c=conversations)
