"""The two relations: spans (28 columns, order fixed) and scores. A schema's ``add`` changes it in place: build new ones."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
SPANS = T.StructType([
    T.StructField(name, kind, null) for name, kind, null in (
        ("dialect", _S, False), ("trace_id", _S, False), ("span_id", _S, False), ("parent_span_id", _S, True), ("name", _S, False), ("otel_kind", _I, False), ("oi_kind", _S, True),
        ("start_unix_nano", _L, False), ("end_unix_nano", _L, False), ("status_code", _I, False), ("status_message", _S, True), ("model", _S, True), ("provider", _S, True),
        ("prompt_tokens", _L, True), ("completion_tokens", _L, True), ("total_tokens", _L, True), ("cache_read_tokens", _L, True), ("cache_write_tokens", _L, True), ("reasoning_tokens", _L, True),
        ("cost_usd", _D, True), ("input_value", _S, True), ("output_value", _S, True), ("session_id", _S, True), ("user_id", _S, True), ("service_name", _S, True), ("scope_name", _S, True),
        ("scope_version", _S, True), ("raw_attributes_json", _S, False),
    )
])
#: Spans as they are stored: with the date and hour of their folder.
STORED = T.StructType([*SPANS.fields, T.StructField("date", _S), T.StructField("hour", _S)])
SCORES = T.StructType([
    T.StructField(name, kind, null) for name, kind, null in (
        ("id", _S, False), ("target_type", _S, False), ("target_id", _S, False), ("name", _S, False), ("num_value", _D, True), ("str_value", _S, True), ("data_type", _S, False),
        ("source", _S, False), ("comment", _S, True), ("config_id", _S, True), ("ts_unix_nano", _L, False),
    )
])
SPAN_KEY = ["trace_id", "span_id"]
