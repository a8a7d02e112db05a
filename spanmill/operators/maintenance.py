"""Writing, compaction, retention and score upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.schema import SPANS, STORED


def hour_of(ns: Column) -> Column:
    """YYYY/MM/DD/HH of a time in UTC; times before the epoch and null ones go to its hour. A long of ns ends in 2262."""
    seconds = F.when(ns >= 0, (ns - F.pmod(ns, F.lit(1_000_000_000))) / 1_000_000_000).otherwise(0).cast("long")
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy/MM/dd/HH")


def partitioned(spans: DataFrame) -> DataFrame:
    """Spans with the date and hour they are stored under."""
    hour = hour_of(F.col("start_unix_nano"))
    return spans.withColumns({"date": F.translate(F.substring(hour, 1, 10), "/", "-"), "hour": F.substring(hour, 12, 2)})


def write_spans(spans: DataFrame, path: str, mode: str = "append") -> None:
    """One copy of each span, by date and hour, sorted by trace with a bloom filter on it, so a trace read skips files."""
    rows = partitioned(first_copy(spans)).repartition("date", "hour", F.pmod(F.xxhash64("trace_id"), F.lit(8))).sortWithinPartitions("trace_id", "start_unix_nano")
    rows.write.mode(mode).option("parquet.bloom.filter.enabled#trace_id", "true").option("maxRecordsPerFile", 1_000_000).partitionBy("date", "hour").parquet(path)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path).select(*SPANS.names)


def spans_between(spark: SparkSession, path: str, low_ns: int, high_ns: int) -> DataFrame:
    """Spans starting in [low, high): the time bounds and the partition bounds they imply, so partitions are pruned."""
    day = lambda ns: hour_of(F.lit(ns).cast("long"))
    table = spark.read.schema(STORED).parquet(path)
    key = F.concat_ws("/", F.translate("date", "-", "/"), "hour")
    return table.where(F.col("date").between(F.translate(F.substring(day(low_ns), 1, 10), "/", "-"), F.translate(F.substring(day(high_ns), 1, 10), "/", "-")) & (key >= day(low_ns)) & (key <= day(high_ns)) & (F.col("start_unix_nano") >= low_ns) & (F.col("start_unix_nano") < high_ns))


def first_copy(spans: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per (trace_id, span_id): the first in ``order``, else by start, end and content. Partial aggregation, no window."""
    rank = order if order is not None else F.struct("start_unix_nano", "end_unix_nano", F.xxhash64(*spans.columns))
    row = F.struct(*spans.columns)
    return spans.groupBy("trace_id", "span_id").agg(F.min_by(row, rank).alias("r")).select("r.*")


def compact(spark: SparkSession, path: str, date: str, out: str) -> None:
    """A closed day's files as few sorted ones, one copy of each span; dynamic overwrite keeps other days."""
    rows = spark.read.schema(STORED).parquet(path).where(F.col("date") == date).select(*SPANS.names)
    write_spans(rows, out, "overwrite")


def expired(spans: DataFrame, cutoff_ns: int) -> DataFrame:
    """Partitions whose newest span is older than the cutoff, with their spans' number."""
    return partitioned(spans).groupBy("date", "hour").agg(F.max("start_unix_nano").alias("newest"), F.count(F.lit(1)).alias("spans")).where(F.col("newest") < cutoff_ns)


def upsert_scores(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Scores by id, the last write winning: a batch over what is stored, its later rows (``seq``) over earlier ones."""
    rows = stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(batch)
    last = F.max_by(F.struct(*stored.columns), F.struct("seq", "ts_unix_nano", F.xxhash64(*stored.columns)))
    return rows.groupBy(F.col("id").alias("key")).agg(last.alias("r")).select("r.*")


def incoming_scores(posted: DataFrame, now_ns: int) -> DataFrame:
    """Posted scores (span_id, trace_id, session_id, run_id, name, value as text, id) as rows: target by precedence, type by value."""
    kinds = ("span", "trace", "session", "run")
    target = F.coalesce(*(F.when(F.col(f"{k}_id").isNotNull(), F.struct(F.lit(k).alias("t"), F.col(f"{k}_id").alias("i"))) for k in kinds))
    num = F.col("value").try_cast("double")
    flag = F.lower("value").isin("true", "false")
    return posted.where(target.isNotNull() & F.col("name").isNotNull()).select(
        F.coalesce("id", F.uuid()).alias("id"), target["t"].alias("target_type"), target["i"].alias("target_id"), "name", F.when(flag, (F.lower("value") == "true").cast("double")).otherwise(num).alias("num_value"),
        F.when(~flag & num.isNull(), F.col("value")).alias("str_value"), F.when(flag, "boolean").when(num.isNotNull(), "numeric").otherwise("categorical").alias("data_type"), F.lit("api").alias("source"),
        F.lit(None).cast("string").alias("comment"), F.lit(None).cast("string").alias("config_id"), F.lit(now_ns).cast("long").alias("ts_unix_nano"))


def annotation_scores(envelopes: DataFrame, now_ns: int) -> DataFrame:
    """Span annotations (data: span_id, name, annotator_kind, result, identifier) as scores with stable ids."""
    a = envelopes.select(F.explode("data").alias("a")).select("a.*")
    score, label = F.col("result.score"), F.col("result.label")
    return a.select(
        F.concat_ws(":", "span_id", "name", F.coalesce("identifier", F.lit(""))).alias("id"), F.lit("span").alias("target_type"), F.col("span_id").alias("target_id"), "name", score.alias("num_value"),
        F.when(score.isNull(), F.coalesce(label, F.col("result.explanation"))).alias("str_value"), F.when(score.isNotNull(), "numeric").when(label.isNotNull(), "categorical").otherwise("text").alias("data_type"),
        F.when(F.col("annotator_kind") == "HUMAN", "human").otherwise("eval").alias("source"), F.col("result.explanation").alias("comment"), F.lit(None).cast("string").alias("config_id"), F.lit(now_ns).cast("long").alias("ts_unix_nano"))


def validate_targets(scores: DataFrame, spans: DataFrame, strict: bool = False) -> DataFrame:
    """Scores with ``target_state``: matched, unmatched, unverified (sessions) or n-a (runs); strict drops the unmatched."""
    ids = spans.select(F.col("span_id").alias("k")).distinct().withColumn("kt", F.lit("span")).unionByName(spans.select(F.col("trace_id").alias("k")).distinct().withColumn("kt", F.lit("trace")))
    met = scores.join(ids, (F.col("target_type") == F.col("kt")) & (F.col("target_id") == F.col("k")), "left")
    state = F.when(F.col("target_type") == "run", "n-a").when(F.col("target_type") == "session", "unverified").when(F.col("k").isNotNull(), "matched").otherwise("unmatched")
    out = met.select(*scores.columns, state.alias("target_state"))
    return out.where("target_state <> 'unmatched'") if strict else out


def offload(spans: DataFrame, column: str, over: int = 256 << 10) -> tuple[DataFrame, DataFrame]:
    """Fields longer than ``over`` bytes become a reference with a preview; the other frame holds key and value."""
    big = F.octet_length(column) > over
    key = F.sha2(F.col(column), 256)
    blobs = spans.where(big).select(key.alias("key"), F.col(column).alias("value")).dropDuplicates(["key"])
    return spans.withColumn(column, F.when(big, F.concat(F.lit("blob:"), key, F.lit(" "), F.substring(column, 1, 256))).otherwise(F.col(column))), blobs


def resolve(spans: DataFrame, blobs: DataFrame, column: str) -> DataFrame:
    """References replaced by their values, NULL where a value is gone. Only references meet the blobs; other rows are not shuffled."""
    refers = F.coalesce(F.startswith(F.col(column), F.lit("blob:")), F.lit(False))
    held = blobs.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    met = spans.where(refers).withColumn("__key", F.substring(column, 6, 64)).join(held, "__key", "left")
    return spans.where(~refers).unionByName(met.withColumn(column, F.col("__value")).select(*spans.columns))


def evaluation_events(scores: DataFrame, newest: int) -> DataFrame:
    """The newest span and trace scores as event lines, oldest first."""
    rows = scores.where("target_type IN ('span', 'trace')").orderBy(F.desc("ts_unix_nano"), F.desc("id")).limit(newest)
    attributes = F.struct(F.col("name").alias("gen_ai.evaluation.name"), F.col("num_value").alias("gen_ai.evaluation.score.value"), F.col("str_value").alias("gen_ai.evaluation.score.label"), F.col("comment").alias("gen_ai.evaluation.explanation"))
    line = F.to_json(F.struct(F.lit("gen_ai.evaluation.result").alias("name"), F.col("ts_unix_nano").alias("timeUnixNano"), F.col("target_type"), F.col("target_id"), attributes.alias("attributes")))
    return rows.orderBy("ts_unix_nano", "id").select("ts_unix_nano", "id", line.alias("line"))
