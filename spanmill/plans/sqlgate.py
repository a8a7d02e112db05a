"""Read-only SQL over spans and scores, capped, with pushdown left to Catalyst."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from spanmill.functions.attributes import register

DEFAULT_LIMIT, MAX_LIMIT = 1_000, 100_000
_READS = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "Distinct", "Deduplicate", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Sample", "SubqueryAlias", "Union", "Intersect", "Except", "Window", "Generate",
    "Expand", "Pivot", "UnresolvedPivot", "Unpivot", "UnresolvedWith", "UnresolvedRelation", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases",
    "UnresolvedTableValuedFunction", "LateralJoin", "WithWindowDefinition", "View", "ResolvedInlineTable", "UnionLoop", "UnresolvedOrdinal", "AsOfJoin", "RepartitionByExpression", "Repartition", "ResolvedHint", "UnresolvedHint", "Range", "WithCTE",
}


class NotReadOnly(ValueError):
    """The statement does more than read, or isn't one statement."""


def _check(plan) -> None:
    name = plan.getClass().getSimpleName()
    if name not in _READS:
        raise NotReadOnly(f"only SELECT, WITH or a plain EXPLAIN of them may run, not {name}")
    for kids in (plan.children(), plan.innerChildren()):
        for k in range(kids.size()):
            kid = kids.apply(k)
            if "logical" in kid.getClass().getName() or "analysis" in kid.getClass().getName():
                _check(kid)
    inner = plan.subqueries()
    for k in range(inner.size()):
        _check(inner.apply(k))


def ensure_read_only(spark: SparkSession, sql: str) -> bool:
    """Refuse anything but one read statement, by its parsed plan; whether it is an EXPLAIN."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise NotReadOnly(f"could not parse SQL: {e}") from None
    except Exception as e:
        raise NotReadOnly(f"could not parse SQL: {str(e)[:300]}") from None
    if plan.getClass().getSimpleName() == "ExplainCommand":
        if "ANALYZE" in sql.upper().split()[:2]:
            raise NotReadOnly("EXPLAIN ANALYZE runs its statement")
        _check(plan.logicalPlan())
        return True
    _check(plan)
    return False


@dataclass
class Result:
    """Column names, rows as dictionaries, and whether rows were cut off."""

    columns: list[str]
    rows: list[dict]
    truncated: bool


def register_views(spark: SparkSession, spans: DataFrame, scores: DataFrame) -> None:
    spans.createOrReplaceTempView("spans")
    scores.createOrReplaceTempView("scores")
    register(spark)


def query(spark: SparkSession, sql: str, limit: int = DEFAULT_LIMIT) -> Result:
    """Run one read statement; the limit is part of the plan, so Spark stops early."""
    limit = max(1, min(limit, MAX_LIMIT))
    explain = ensure_read_only(spark, sql)
    df = spark.sql(sql)
    rows = (df if explain else df.limit(limit + 1)).collect()
    return Result(df.columns, [r.asDict(recursive=True) for r in rows[:limit]], not explain and len(rows) > limit)


def spans_view(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Hot spans and those cold ones that no hot one replaces; filters reach both branches."""
    return hot.unionByName(cold.join(hot.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_anti").select(*hot.columns))
