"""Datasets, configurations, prices and reports as files. What is read or written on the driver here is a few rows."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id string, input string, output string, expected_output string, span_id string, trace_id string, context array<string>, metadata string"


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL dataset; blank lines are skipped, a broken line fails the read, output is required."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    items = lines.select(F.from_json("value", ITEM, {"mode": "FAILFAST"}).alias("i")).select("i.*")
    return items.withColumn("output", F.when(F.col("output").isNull(), F.raise_error(F.lit("a dataset item has no output"))).otherwise(F.col("output")))


@dataclass
class EvalConfig:
    """An evaluation: dataset, evaluators, thresholds, slices."""

    name: str
    dataset: str = ""
    evaluators: list[dict] = field(default_factory=list)
    judges: list[dict] = field(default_factory=list)
    endpoints: list[dict] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)
    slice_by: list[str] = field(default_factory=list)


def read_config(text: str, kind=EvalConfig):
    """A YAML configuration; unknown keys are refused."""
    import yaml

    given = yaml.safe_load(text)
    if not isinstance(given, dict):
        raise ValueError("a configuration is a mapping")
    if unknown := set(given) - set(kind.__dataclass_fields__):
        raise ValueError(f"unknown keys {sorted(unknown)}")
    return kind(**given)


def evaluators(config: EvalConfig) -> dict:
    """Columns by evaluator name; a name that repeats is refused."""
    from spanmill.operators import evals

    out = {}
    for spec in config.evaluators:
        args = {k: v for k, v in spec.items() if k not in ("type", "name")}
        name = spec.get("name", spec["type"])
        if name in out:
            raise ValueError(f"evaluator {name!r} is there twice")
        out[name] = getattr(evals, spec["type"])(**args)
    return out


def read_prices(text: str, own: str | None = None) -> dict:
    from spanmill.operators.pricing import overlay, parse_prices

    return overlay(parse_prices(json.loads(text)), parse_prices(json.loads(own)) if own else {})


def junit(name: str, rows: list[dict]) -> str:
    """A test suite of evaluators: name, mean, threshold_met."""
    failed = [r for r in rows if r["threshold_met"] is False]
    cases = "".join(
        f"  <testcase name={quoteattr(r['name'])}>" + (f"<failure message={quoteattr(f'mean {r["mean"]:.4f}')}/>" if r in failed else "") + "</testcase>\n" for r in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name={quoteattr(name)} tests="{len(rows)}" failures="{len(failed)}">\n{cases}</testsuite>\n'


def report(name: str, rows: list[dict]) -> str:
    return json.dumps({"version": 1, "name": name, "passed": all(r["threshold_met"] is not False for r in rows), "evaluators": rows}, sort_keys=True)


def prometheus(prefix: str, rows: list[dict], labels: list[str]) -> str:
    """Counters in text exposition, one family per column."""
    quote = lambda v: str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    out = []
    for column in (c for c in (rows[0] if rows else {}) if c not in labels):
        out.append(f"# TYPE {prefix}_{column} counter")
        out += [f"{prefix}_{column}{{{','.join(f'{k}="{quote(r[k])}"' for k in labels)}}} {r[column]}" for r in rows]
    return "\n".join([*out, ""])
