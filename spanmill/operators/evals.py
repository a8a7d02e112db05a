"""Offline evaluation: deterministic scorers, aggregates, gates and run-against-run comparison.

A scorer turns an item (id, input, output, expected_output, context, metadata) into value, passed and comment; a NULL
value is a skip. Scorers are columns, so a run is one projection and an explode.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions import stats
from spanmill.functions.language import canonical_code
from spanmill.functions.language import detected as language_of
from spanmill.functions.text import distance, json_schema_errors, normalised, script_share


def _verdict(passed: Column, value: Column | None = None, comment: Column | None = None, skip: Column | None = None) -> Column:
    value = passed.cast("double") if value is None else value
    made = F.struct(value.alias("value"), passed.alias("passed"), (F.lit(None).cast("string") if comment is None else comment).alias("comment"))
    none = F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("boolean").alias("passed"), F.lit(None).cast("string").alias("comment"))
    return made if skip is None else F.when(skip, none).otherwise(made)




def _number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def exact_match(normalize: bool = False) -> Column:
    out, want = F.col("output"), F.col("expected_output")
    same = normalised(out) == normalised(want) if normalize else F.trim(out) == F.trim(want)
    return _verdict(same, skip=want.isNull())


def contains(substring: str | None = None) -> Column:
    needle = F.col("expected_output") if substring is None else F.lit(substring)
    return _verdict(F.contains(F.col("output"), needle), skip=needle.isNull())


def regex(pattern: str) -> Column:
    return _verdict(F.col("output").rlike(pattern))


def json_valid() -> Column:
    return _verdict(F.try_parse_json("output").isNotNull())


def levenshtein(threshold: float = 0.8, normalize: bool = False) -> Column:
    a, b = ((normalised(F.col(c)) if normalize else F.col(c)) for c in ("output", "expected_output"))
    longest = F.greatest(F.length(a), F.length(b))
    value = F.when(longest == 0, 1.0).otherwise(1 - distance(a, b) / longest)
    return _verdict(value >= threshold, value, skip=F.col("expected_output").isNull())


def non_empty() -> Column:
    return _verdict(F.length(F.trim("output")) > 0)


def contains_all(needles: list[str]) -> Column:
    each = [F.contains(F.col("output"), F.lit(n)) for n in needles]
    value = sum((e.cast("double") for e in each), F.lit(0.0)) / max(1, len(needles))
    missing = F.concat_ws(", ", *(F.when(~e, F.lit(n)) for e, n in zip(each, needles)))
    return _verdict(value >= 1.0, value, F.when(value < 1.0, F.concat(F.lit("missing: "), missing)))


def contains_any(needles: list[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(F.col("output"), F.lit(n))
    return _verdict(hit)


def length_bounds(least: int | None = None, most: int | None = None) -> Column:
    n = F.char_length("output")
    return _verdict((n >= (least or 0)) & (n <= most if most is not None else F.lit(True)))


def numeric_tolerance(tolerance: float) -> Column:
    a, b = _number(F.col("output")), _number(F.col("expected_output"))
    return _verdict(F.abs(a - b) <= tolerance, skip=a.isNull() | b.isNull())


def equals_numeric() -> Column:
    a, b = _number(F.col("output")), _number(F.col("expected_output"))
    return _verdict(a == b, skip=a.isNull() | b.isNull())  # NaN equals NaN here


def json_schema(schema: dict) -> Column:
    errors = json_schema_errors(json.dumps(schema))(F.col("output"))
    return _verdict(errors.isNull(), comment=errors)


def script(name: str | None = None, least: float = 0.8) -> Column:
    wanted = F.coalesce(F.lit(name), F.get_json_object("metadata", "$.script"), F.get_json_object("metadata", "$.language"))
    value = F.array(script_share(F.col("output"), wanted))  # bound to a name, it is found once a row
    return F.transform(value, lambda v: _verdict(v >= least, v, skip=v.isNull()))[0]


def language_match(language: str | None = None, detected: Column | None = None) -> Column:
    """Whether the output is in the language asked for (or the item's own); a text whose language can't be told is skipped."""
    found = language_of(F.col("output")) if detected is None else detected
    wanted = F.coalesce(F.lit(language), F.get_json_object("metadata", "$.language"))
    return _verdict(found == canonical_code(wanted), skip=found.isNull() | wanted.isNull())


def latency(max_ms: float) -> Column:
    ms = F.coalesce(F.get_json_object("metadata", "$.latency_ms").try_cast("double"), F.get_json_object("metadata", "$.duration_ns").try_cast("double") / 1e6)
    return _verdict(ms <= max_ms, skip=ms.isNull())


def cost(max_usd: float) -> Column:
    usd = F.get_json_object("metadata", "$.cost_usd").try_cast("double")
    return _verdict(usd <= max_usd, skip=usd.isNull())


def run(items: DataFrame, evaluators: dict[str, Column]) -> DataFrame:
    """One row per item and evaluator: name, value, passed, comment; skips have a NULL value."""
    if not evaluators:
        raise ValueError("no evaluators")
    each = F.array(*(F.struct(F.lit(n).alias("name"), c.alias("v")) for n, c in evaluators.items()))
    rows = items.withColumn("__each", F.explode(each))
    return rows.select(*items.columns, F.col("__each.name").alias("name"), *(F.col(f"__each.v.{c}").alias(c) for c in ("value", "passed", "comment")))


def aggregate(results: DataFrame, thresholds: dict[str, float] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """By evaluator (and keys): scored, skipped, mean, sample variance, pass rate, and whether the threshold is met."""
    cut = F.create_map(*(F.lit(x) for kv in (thresholds or {"": 0.0}).items() for x in kv))[F.col("name")]
    out = results.groupBy(*keys, "name").agg(
        F.count("value").alias("scored"), F.count_if(F.col("value").isNull()).alias("skipped"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"), F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)).alias("pass_rate"))
    return out.withColumn("threshold_met", F.when(cut.isNotNull(), (F.col("scored") == 0) | (F.col("mean") >= cut)))


def passed(aggregates: DataFrame) -> DataFrame:
    """One row: whether all thresholds are met."""
    return aggregates.agg(F.coalesce(F.bool_and(F.coalesce("threshold_met", F.lit(True))), F.lit(True)).alias("passed"))


def by_slice(results: DataFrame, slices: list[str]) -> DataFrame:
    """Means by slice key, value and evaluator, for keys of two labels or more."""
    out = None
    for key in slices:
        rows = results.where(F.col(key).isNotNull() & F.col("value").isNotNull()).groupBy(F.col(key).cast("string").alias("slice"), "name").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
        labels = rows.agg(F.countDistinct("slice").alias("labels"))
        rows = rows.crossJoin(F.broadcast(labels)).where("labels >= 2").select(F.lit(key).alias("slice_by"), "slice", "name", "mean", "n")  # one row of counts
        out = rows if out is None else out.unionByName(rows)
    return out


def suite(results: DataFrame, min_pass: float = 1.0, min_pass_rate: float = 1.0) -> DataFrame:
    """case, passed rows: the share of passed runs by case, and whether the suite passes."""
    cases = results.groupBy("case").agg(F.avg(F.col("passed").cast("double")).alias("share"))
    ok = (F.col("share") + 1e-9 >= min_pass).cast("double")
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.avg(ok), F.lit(1.0)).alias("pass_rate")).withColumn("passed", F.col("pass_rate") + 1e-9 >= min_pass_rate)


_TEST = "struct<t:double,df:double,p:double,low:double,high:double>"


def compare(a: DataFrame, b: DataFrame, alpha: float = 0.05, tolerance: float = 0.0) -> DataFrame:
    """Runs' evaluators side by side: means, delta, and a paired t-test where both runs scored the same items, else Welch's.

    a, b: key, name, value. ``gate_raw`` is a fall beyond tolerance; ``gate`` one that isn't shown to be noise.
    """
    side = lambda df, s: df.where("value IS NOT NULL").groupBy("name").agg(F.avg("value").alias(f"mean_{s}"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias(f"var_{s}"), F.count("value").alias(f"n_{s}"), F.countDistinct("key").alias(f"keys_{s}"))
    both = side(a, "a").join(side(b, "b"), "name", "full")
    pick = lambda df, s: df.where("value IS NOT NULL").select("key", "name", F.col("value").alias(s))
    d = F.col("b") - F.col("a")
    pairs = pick(a, "a").join(pick(b, "b"), ["key", "name"]).groupBy("name").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(d).alias("d_mean"), F.var_samp(d).alias("d_var"), F.min(d).alias("d_low"), F.max(d).alias("d_high"), F.max(F.abs(d)).alias("d_most"))
    rows = both.join(pairs, "name", "left")
    same = (F.col("pairs") == F.col("n_a")) & (F.col("pairs") == F.col("n_b")) & (F.col("keys_a") == F.col("n_a")) & (F.col("keys_b") == F.col("n_b"))

    @F.udf(_TEST)
    def test(use, n, mean, var, low, high, most, ma, va, na, mb, vb, nb):
        return stats.paired(n, mean, var, low, high, most, alpha) if use else stats.welch(ma, va, na, mb, vb, nb, alpha)

    rows = rows.withColumn("paired", F.coalesce(same, F.lit(False)))
    rows = rows.withColumn("test", test("paired", "pairs", "d_mean", "d_var", "d_low", "d_high", "d_most", "mean_a", "var_a", "n_a", "mean_b", "var_b", "n_b"))
    delta = F.col("mean_b") - F.col("mean_a")
    fall = F.coalesce(delta < -tolerance, F.lit(False))
    return rows.select("name", "mean_a", "mean_b", delta.alias("delta"), "n_a", "n_b", "paired", "test", fall.alias("gate_raw"), (fall & ~F.coalesce(F.col("test.p") / 2 > alpha, F.lit(False))).alias("gate"))


def non_inferior(a: DataFrame, b: DataFrame, margin: float, alpha: float = 0.05, keys: tuple[str, ...] = ()) -> DataFrame:
    """Whether b is no worse than a by more than margin, by evaluator (and slice keys, which a carries), on common items."""
    d = F.col("b") - F.col("a")
    pairs = a.where("value IS NOT NULL").select("key", "name", *keys, F.col("value").alias("a")).join(b.where("value IS NOT NULL").select("key", "name", F.col("value").alias("b")), ["key", "name"])
    rows = pairs.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("pairs"), F.avg(d).alias("mean"), F.var_samp(d).alias("var"), F.min(d).alias("low"), F.max(d).alias("high"), F.max(F.abs(d)).alias("most"))

    @F.udf("struct<lower:double,upper:double,p:double,verdict:string>")
    def test(n, mean, var, low, high, most):
        return stats.non_inferiority(n, mean, var, low, high, most, margin, alpha)

    return rows.select(*keys, "name", "pairs", "mean", test("pairs", "mean", "var", "low", "high", "most").alias("test"))


def bootstrap(values: DataFrame, n: int, alpha: float = 0.05, resamples: int = 2000, seed: int = 42) -> tuple[float, float] | None:
    """A percentile interval of the mean of ``value`` over its ``n`` rows, numbered 0..n-1 by ``i``.

    Each task draws its share of the resamples and sends how often each row was drawn; draws meet values in a join.
    """
    if n < 2:
        return None

    def draw(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf["id"]:
                counts = pd.Series(stats.resample_indices(seed, int(r), n)).value_counts()
                yield pd.DataFrame({"r": r, "i": counts.index, "k": counts.to_numpy()})

    draws = values.sparkSession.range(resamples).mapInPandas(draw, "r long, i long, k long")
    means = draws.join(values, "i").groupBy("r").agg((F.sum(F.col("value") * F.col("k")) / n).alias("mean"))
    out = min(int(alpha / 2 * resamples), resamples - 1)
    ends = [r.mean for r in means.orderBy("mean").collect()]  # a number per resample
    return ends[out], ends[resamples - 1 - out]


def newest_per_target(scores: DataFrame, name: str, source: Column) -> DataFrame:
    """Each target's newest numeric score of a name."""
    rows = scores.where((F.col("name") == name) & source & F.col("num_value").isNotNull())
    return rows.groupBy("target_type", "target_id").agg(F.max_by("num_value", F.struct("ts_unix_nano", "id")).alias("value"))


def calibrate(scores: DataFrame, judge: str, human: str | None = None, cut: float = 0.5, alpha: float = 0.05, threshold: float = 0.1) -> DataFrame:
    """Judge against human on their common targets: bias, errors, correlation, line, verdict agreement; NULL-free only with two pairs."""
    j = newest_per_target(scores, judge, F.col("source") == "eval").withColumnRenamed("value", "j")
    h = newest_per_target(scores, human or judge, F.col("source") == "human").withColumnRenamed("value", "h")
    d = F.col("j") - F.col("h")
    flag = lambda a, b: F.count_if(((F.col("j") >= cut) == a) & ((F.col("h") >= cut) == b))
    one = j.join(h, ["target_type", "target_id"]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.coalesce(F.corr("j", "h"), F.lit(0.0)).alias("pearson"),
        F.coalesce(F.regr_slope("h", "j"), F.lit(0.0)).alias("slope"), F.avg("j").alias("mean_j"), F.avg("h").alias("mean_h"), F.var_samp(d).alias("var_d"),
        flag(True, True).alias("both"), flag(True, False).alias("only_j"), flag(False, True).alias("only_h"), flag(False, False).alias("neither"))

    @F.udf("struct<low:double,high:double>")
    def interval(n, bias, var):
        if (n or 0) < 2:
            return None
        half = stats.t_quantile(1 - alpha / 2, n - 1.0) * (var / n) ** 0.5
        return bias - half, bias + half

    kappa = F.udf(stats.kappa, "double")
    one = one.withColumn("intercept", F.col("mean_h") - F.col("slope") * F.col("mean_j")).withColumn("ci", interval("n", "bias", "var_d")).withColumn("kappa", kappa("both", "only_j", "only_h", "neither"))
    sure = (F.col("ci.low") > 0) | (F.col("ci.high") < 0)
    again = (F.col("mae") > threshold) | ((F.abs("bias") > threshold) & sure)
    return one.select("n", "bias", "mae", "rmse", "pearson", "slope", "intercept", F.col("ci.low").alias("bias_low"), F.col("ci.high").alias("bias_high"), ((F.col("both") + F.col("neither")) / F.col("n")).alias("agreement"), "kappa", again.alias("recalibrate"))


def stability(runs: DataFrame, cut: float = 0.5) -> DataFrame:
    """Repeat runs (run, key, value): verdict agreement, mean deviation, largest range and Fleiss' kappa over items in all runs."""
    total = runs.agg(F.countDistinct("run").alias("runs"))
    per = runs.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("value") >= cut).alias("up"), F.stddev_samp("value").alias("sd"), (F.max("value") - F.min("value")).alias("spread"))
    full = per.crossJoin(F.broadcast(total)).where("k = runs AND runs >= 2")  # one row of counts
    r, up = F.col("k").cast("double"), F.col("up").cast("double")
    one = full.agg(
        F.max("runs").alias("runs"), F.count(F.lit(1)).alias("items"), F.avg(((F.col("up") == 0) | (F.col("up") == F.col("k"))).cast("double")).alias("verdict_agreement"), F.avg("sd").alias("mean_sd"),
        F.max("spread").alias("max_range"), F.avg((up * up + (r - up) * (r - up) - r) / (r * (r - 1))).alias("seen"), (F.sum(up) / F.sum(r)).alias("p"))
    chance = F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p"))
    return one.withColumn("fleiss_kappa", F.when(F.abs(1 - chance) >= 1e-12, (F.col("seen") - chance) / (1 - chance))).drop("seen", "p")


def least_stable(runs: DataFrame, n: int = 5) -> DataFrame:
    spread = runs.groupBy("key").agg((F.max("value") - F.min("value")).alias("spread"))
    return spread.where("spread > 0").orderBy(F.desc("spread"), "key").limit(n)


def failing(scores: DataFrame, run_id: str, below: float = 1.0) -> DataFrame:
    """A run's item scores under a value, lowest first."""
    return scores.where((F.col("config_id") == run_id) & ~F.startswith("id", F.lit("run:agg:")) & (F.col("num_value") < below)).orderBy("num_value", "id")


def estimate(items: DataFrame, judges: int, out_tokens: int = 32, in_usd: float = 1e-6, out_usd: float = 4e-6) -> DataFrame:
    """What judging would take: calls, tokens (a quarter of the characters, rounded up) and cost."""
    tokens = F.ceil(F.char_length(F.concat_ws("", "input", "output", "expected_output")) / 4)
    one = items.agg((F.count(F.lit(1)) * judges).alias("calls"), (F.coalesce(F.sum(tokens), F.lit(0)) * judges).cast("long").alias("input_tokens"))
    return one.withColumn("output_tokens", F.col("calls") * out_tokens).withColumn("cost_usd", F.col("input_tokens") * in_usd + F.col("output_tokens") * out_usd)
