"""Traces: reads, orphans, and score rollups over span trees.

Trees are walked with joins on (trace, span), never by collecting a trace, so a trace of any size is dealt over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.plans.scratch import save

FUNCTIONS = {
    "mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "all": lambda c: F.min((c != 0).cast("double")), "any": lambda c: F.max((c != 0).cast("double")),
}
ALIASES = {"avg": "mean", "average": "mean", "total": "sum", "and": "all", "or": "any"}


def parse_rules(text: str) -> dict[str, str]:
    """``name=function`` pairs, comma-separated."""
    rules = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, eq, fn = (x.strip() for x in part.partition("="))
        fn = ALIASES.get(fn.lower(), fn.lower())
        if not eq or not name or fn not in FUNCTIONS:
            raise ValueError(f"not a rollup rule: {part!r}")
        rules[name] = fn
    return rules


def get_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    """A trace's spans by start, each with whether its parent is missing."""
    own = spans.where(F.col("trace_id") == trace_id)
    ids = own.select(F.col("span_id").alias("known")).distinct()
    marked = own.join(ids, own.parent_span_id == ids.known, "left").withColumn("orphan", F.col("parent_span_id").isNotNull() & F.col("known").isNull()).drop("known")
    return marked.orderBy("start_unix_nano", "span_id")


def orphans(spans: DataFrame) -> DataFrame:
    """Spans whose parent isn't in their trace."""
    ids = spans.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"))
    return spans.where("parent_span_id IS NOT NULL").join(ids, (F.col("trace_id") == F.col("t")) & (F.col("parent_span_id") == F.col("s")), "left_anti")


def recent(spans: DataFrame, n: int = 100, trace_id: str | None = None) -> DataFrame:
    """The newest n spans; a heap per task, no full sort."""
    rows = spans if trace_id is None else spans.where(F.col("trace_id") == trace_id)
    return rows.orderBy(F.desc("start_unix_nano"), "trace_id", "span_id").limit(max(0, min(n, 10_000)))


def scores_of_trace(spans: DataFrame, scores: DataFrame) -> DataFrame:
    """trace_id with every score of the trace or of one of its spans."""
    direct = scores.where("target_type = 'trace'").withColumn("trace_id", F.col("target_id"))
    ids = spans.select("trace_id", "span_id").distinct()
    through = scores.where("target_type = 'span'").join(ids, F.col("target_id") == F.col("span_id")).drop("span_id")
    return direct.select("trace_id", *scores.columns).unionByName(through.select("trace_id", *scores.columns))


def forest(spans: DataFrame) -> DataFrame:
    """trace_id, span_id and up, the parent in the trace; NULL at roots.

    A parent that is missing or the span itself makes a root. Spans whose chain never ends (cycles) get entries: of
    each trace's such spans, smallest span_id first, those that no earlier entry reaches.
    """
    return numbered_forest(spans).select("trace_id", "span_id", "up")


def numbered_forest(spans: DataFrame) -> DataFrame:
    """The forest, written, with each span's number (node) and its parent's (above), so that walks shuffle numbers in place of ids."""
    ids = spans.groupBy("trace_id", "span_id").agg(F.min_by("parent_span_id", F.struct("start_unix_nano", "parent_span_id")).alias("p"))
    ids = save(ids.withColumn("node", F.monotonically_increasing_id()), "forest-ids")  # numbered once, as it is written
    there = ids.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("node").alias("above"))
    nodes = ids.join(there, (F.col("trace_id") == F.col("t")) & (F.col("p") == F.col("s")) & (F.col("p") != F.col("span_id")), "left")
    nodes = save(nodes.select("trace_id", "span_id", F.col("s").alias("up"), "node", "above"), "forest")
    most = nodes.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 1
    far = nodes.where("above IS NOT NULL").select("node", "above")
    for _ in range(math.ceil(math.log2(most)) + 1):  # after k rounds far leads 2**k up; what is left then is on or below a cycle
        far = save(far.join(far.select(F.col("node").alias("above"), F.col("above").alias("next")), "above").select("node", F.col("next").alias("above")), "forest-far")
        if far.isEmpty():
            return nodes
    knots = nodes.join(far.select("node"), "node", "left_semi")

    def entries(rows):
        up = dict(zip(rows.span_id, rows.up))
        seen, out = set(), []
        children: dict[str, list[str]] = {}
        for s, p in up.items():
            children.setdefault(p, []).append(s)
        for s in sorted(up):
            if s not in seen:
                out.append(s)
                walk = [s]
                while walk:
                    if (at := walk.pop()) not in seen:
                        seen.add(at)
                        walk += children.get(at, [])
        return rows[rows.span_id.isin(out)][["node"]]

    roots = knots.groupBy("trace_id").applyInPandas(entries, "node long").withColumn("cut", F.lit(True))  # malformed spans alone
    kept = lambda c: F.when(F.col("cut").isNull(), F.col(c)).alias(c)
    return save(nodes.join(roots, "node", "left").select("trace_id", "span_id", kept("up"), "node", kept("above")), "forest")


def _scored_above(nodes: DataFrame, scored: DataFrame) -> DataFrame:
    """node and hits: the names scored on a span or on one above it, of spans that have any.

    By doubling: after k rounds hits tells of the next 2**k spans up, and up leads past them.
    """
    own = scored.groupBy("node").agg(F.collect_set("name").alias("hits"))
    state = nodes.select("node", F.col("above").alias("up")).join(own, "node", "left")
    state = save(state.select("node", "up", F.coalesce("hits", F.array().cast("array<string>")).alias("hits")), "rollup-climb")
    while not (open_ := state.where("up IS NOT NULL")).isEmpty():
        above = state.where("up IS NOT NULL OR size(hits) > 0").select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("hits").alias("more"))
        met = open_.join(above, "up", "left").select("node", F.col("next").alias("up"), F.when(F.col("more").isNull(), F.col("hits")).otherwise(F.array_union("hits", "more")).alias("hits"))
        state = save(state.where("up IS NULL").unionByName(met), "rollup-climb")
    return state.where("size(hits) > 0").select("node", "hits")


def _newest(scores: DataFrame) -> DataFrame:
    """The newest score of each target and name."""
    last = F.max_by(F.struct("num_value", "data_type"), F.struct("ts_unix_nano", "id")).alias("v")
    return scores.groupBy("target_id", "name").agg(last).select("target_id", "name", "v.*")


def _measured(scores: DataFrame) -> DataFrame:
    return _newest(scores.where("target_type = 'trace' AND num_value IS NOT NULL"))


def carriers(spans: DataFrame, scores: DataFrame) -> DataFrame:
    """The evidence of derived rollups: trace_id, name and span_id of each span that speaks for its subtree, with its score.

    A row each, so a trace of any size is dealt over tasks. Names measured on the trace have none.
    """
    measured = _measured(scores).select(F.col("target_id").alias("trace_id"), "name")
    nodes = numbered_forest(spans)
    held = _newest(scores.where("target_type = 'span' AND num_value IS NOT NULL AND data_type NOT IN ('categorical', 'text')")).withColumnRenamed("target_id", "span_id")
    scored = nodes.select("trace_id", "span_id", "node", "above").join(held, "span_id").join(measured, ["trace_id", "name"], "left_anti")
    scored = save(scored, "rollup-scored")
    over = _scored_above(nodes, scored).select(F.col("node").alias("above"), "hits")
    below = scored.where("above IS NOT NULL").join(over, "above", "left").where(~F.coalesce(F.array_contains("hits", F.col("name")), F.lit(False)))
    return scored.where("above IS NULL").unionByName(below.drop("hits")).select("trace_id", "name", "span_id", "num_value", "data_type")


def rollup(spans: DataFrame, scores: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Scores by trace and name, in that order: a measured trace score as it is, else its shallowest carriers combined.

    A scored span speaks for its subtree. Categorical and text scores and those without a number are skipped; of
    several scores of one name on a span the newest of the others counts. Booleans combine with ``all``, others with
    ``mean``, unless a rule says otherwise; carriers of mixed types count as numeric. ``contributing_span_ids``, sorted,
    are the carriers (none of a measured score); they are gathered only where the column is read.
    """
    measured = _measured(scores).select(
        F.col("target_id").alias("trace_id"), "name", F.col("num_value").alias("value"), F.lit(True).alias("measured"), F.lit(None).cast("string").alias("function"), F.lit(1).cast("long").alias("n"),
        F.array().cast("array<string>").alias("contributing_span_ids"), "data_type")
    value = F.col("num_value")
    own = carriers(spans, scores).groupBy("trace_id", "name").agg(
        *(fn(value).cast("double").alias(f"f_{k}") for k, fn in FUNCTIONS.items()), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("span_id")).alias("contributing_span_ids"),
        F.when(F.min("data_type") == F.max("data_type"), F.min("data_type")).otherwise("numeric").alias("data_type"))
    named = F.create_map(*(F.lit(x) for kv in rules.items() for x in kv))[F.col("name")] if rules else F.lit(None).cast("string")
    own = own.withColumn("function", F.coalesce(named, F.when(F.col("data_type") == "boolean", "all").otherwise("mean")))
    picked = F.coalesce(*(F.when(F.col("function") == k, F.col(f"f_{k}")) for k in FUNCTIONS))
    own = own.select("trace_id", "name", picked.alias("value"), F.lit(False).alias("measured"), "function", "n", "contributing_span_ids", "data_type")
    return measured.unionByName(own).orderBy("trace_id", "name")


def persisted(rolled: DataFrame, now_ns: int) -> DataFrame:
    """Derived rollups as scores of their traces: rows like any others, which a later rollup takes as measured."""
    d = rolled.where("NOT measured")
    return d.select(
        F.concat(F.lit("rollup:"), "trace_id", F.lit(":"), "name").alias("id"), F.lit("trace").alias("target_type"), F.col("trace_id").alias("target_id"), "name", F.col("value").alias("num_value"),
        F.lit(None).cast("string").alias("str_value"), "data_type", F.lit("eval").alias("source"), F.format_string("derived by rollup (%s over %d span scores)", "function", "n").alias("comment"),
        F.lit(None).cast("string").alias("config_id"), F.lit(now_ns).cast("long").alias("ts_unix_nano"))


def dataset(spans: DataFrame, n: int, model: str | None = None) -> DataFrame:
    """Dataset items of the newest n spans (of a model) with an output."""
    rows = spans if model is None else spans.where(F.col("model") == model)
    newest = rows.orderBy(F.desc("start_unix_nano"), "trace_id", "span_id").limit(n).where("output_value IS NOT NULL AND output_value <> ''")
    meta = F.to_json(F.struct("model", "service_name", F.greatest(F.col("end_unix_nano") - F.col("start_unix_nano"), F.lit(0)).alias("duration_ns"), "cost_usd"))
    return newest.select(F.col("span_id").alias("id"), F.col("input_value").alias("input"), F.col("output_value").alias("output"), "span_id", "trace_id", meta.alias("metadata"))
