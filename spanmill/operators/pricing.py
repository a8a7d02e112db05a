"""Price tables, model lookup and the price of a call.

A price is {"input", "output", "cache_read", "cache_write", "reasoning", "tiers"}; a tier is (above, input, output,
cache_read, cache_write) and overlays the base where the total input exceeds ``above``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["prompt_tokens", "completion_tokens", "total_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]
PRICE = ("struct<input:double,output:double,cache_read:double,cache_write:double,reasoning:double,"
         "tiers:array<struct<above:bigint,input:double,output:double,cache_read:double,cache_write:double>>>")  # fmt: skip
# fixed values: region prefixes, version segments and the fields of a price entry
REGIONS = ["us-gov.", "us.", "eu.", "apac.", "global.", "au.", "jp.", "ca."]
VERSION = re.compile(r"latest|[0-9]{2,}|v[0-9]+(?::[0-9]+)?")
FIELDS = {"input_cost_per_token": "input", "output_cost_per_token": "output", "cache_read_input_token_cost": "cache_read", "cache_creation_input_token_cost": "cache_write"}


def parse_prices(entries: dict) -> dict:
    """Price entries by model; those without an input or output price are left out."""
    out = {}
    for model, entry in entries.items():
        if not isinstance(entry, dict):
            continue
        number = {k: float(v) for k, v in entry.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        if "input_cost_per_token" not in number and "output_cost_per_token" not in number:
            continue
        price = {name: number.get(key) for key, name in FIELDS.items()} | {"reasoning": number.get("output_cost_per_reasoning_token")}
        price["input"], price["output"] = price["input"] or 0.0, price["output"] or 0.0
        tiers: dict[int, dict] = {}
        for key, value in number.items():
            if (found := re.fullmatch(r"(\w+?)_above_([0-9]+)(k?)_tokens", key)) and found[1] in FIELDS:
                above = int(found[2]) * (1000 if found[3] else 1)
                tiers.setdefault(above, {})[FIELDS[found[1]]] = value
        price["tiers"] = [(above, *(tiers[above].get(f) for f in FIELDS.values())) for above in sorted(tiers)]
        out[model] = price
    return out


def overlay(base: dict, own: dict) -> dict:
    """A user's entries over the baseline's."""
    return {**base, **own}


def candidates(model: str) -> list[str]:
    """Keys a model id may be priced under, best first.

    The id as it is; then in lower case and without what follows an ``@``, with and then without a region prefix, and each
    of these with its trailing version segments taken off one by one; then the same for what follows each ``/``.
    """
    tails = model.lower().split("/")
    out = [model]
    for k in range(len(tails)):
        base = "/".join(tails[k:]).partition("@")[0]
        bare = next((base.removeprefix(r) for r in REGIONS if base.startswith(r)), base)
        for name in dict.fromkeys((base, bare)):
            segments = name.split("-")
            last = len(segments)
            while last > 1 and VERSION.fullmatch(segments[last - 1]):
                last -= 1
            out += ["-".join(segments[:n]) for n in range(len(segments), last - 1, -1)]
    return [c for c in dict.fromkeys(out) if c]


def lookup(model: str, prices: dict) -> str | None:
    """The price table's key for a model id; no guess across families."""
    return next((c for c in candidates(model) if c in prices), None)


def price_literal(price: dict) -> Column:
    import json

    tiers = [dict(zip(("above", "input", "output", "cache_read", "cache_write"), t)) for t in price["tiers"]]
    return F.from_json(F.lit(json.dumps({**price, "tiers": tiers})), PRICE)


def with_price(rows: DataFrame, prices: dict) -> DataFrame:
    """Rows with the ``price`` of their ``model``, or NULL.

    Candidate keys are worked out once per distinct model and joined with the table, lowest rank first, so neither the
    models nor the rows pass through the driver. The table itself is the caller's literal.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, {**p, "tiers": [tuple(t) for t in p["tiers"]]}) for k, p in prices.items()], f"key string, price {PRICE}")
    keys = F.udf(candidates, "array<string>")
    models = rows.select("model").where("model IS NOT NULL").distinct()
    ranked = models.select("model", F.posexplode(keys("model")).alias("rank", "key")).join(table, "key")
    chosen = ranked.groupBy("model").agg(F.min_by("price", "rank").alias("price"))
    return rows.join(chosen, "model", "left")


def detect_basis(total: Column) -> Column:
    """Whether cache tokens are on top of the prompt, and reasoning tokens on top of the completion."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    prompt, completion, reasoning = zero("prompt_tokens"), zero("completion_tokens"), zero("reasoning_tokens")
    cache = zero("cache_read_tokens") + zero("cache_write_tokens")
    extra = total - (prompt + completion)
    told = total.isNotNull() & (extra >= 0)
    only = told & (cache != reasoning)
    both = told & (cache > 0) & (reasoning > 0) & (extra == cache + reasoning)
    basis = lambda c, r: F.struct(F.lit(c).alias("cache_excl"), F.lit(r).alias("reasoning_add"))
    return (
        F.when(told & (extra == 0), basis(False, False)).when(only & (cache > 0) & (extra == cache), basis(True, False))
        .when(only & (reasoning > 0) & (extra == reasoning), basis(False, True)).when(both, basis(True, True))
        .otherwise(F.struct(((cache > 0) & (prompt < cache)).alias("cache_excl"), F.lit(False).alias("reasoning_add")))
    )


def price_tokens(basis: Column, price: Column | None = None) -> Column:
    """USD of a row's token counts at its price, each cached and reasoning token priced once; rounded to 1e-12."""
    price = F.col("price") if price is None else price
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    prompt, completion, read, write, reasoning = (zero(c) for c in ("prompt_tokens", "completion_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"))
    excl, add = basis["cache_excl"], basis["reasoning_add"]
    uncached = F.when(excl, prompt).otherwise(F.greatest(prompt - read - write, F.lit(0)))
    total_in = F.when(excl, prompt + read + write).otherwise(prompt)
    text = F.when(add, completion).otherwise(F.greatest(completion - reasoning, F.lit(0)))

    def rate(name: str) -> Column:
        base = price[name]
        over = F.filter(price["tiers"], lambda t: (total_in > t["above"]) & t[name].isNotNull())
        return F.when(F.size(over) > 0, F.element_at(over, -1)[name]).otherwise(base)

    each, out = rate("input"), rate("output")
    usd = (uncached * each + read * F.coalesce(rate("cache_read"), each) + write * F.coalesce(rate("cache_write"), each) + text * out + reasoning * F.coalesce(price["reasoning"], out))
    return F.round(usd * 1e12) / 1e12


def derive_costs(spans: DataFrame, prices: dict) -> DataFrame:
    """Spans with cost_usd filled where none was reported, the model is priced and tokens are known; unknown stays NULL."""
    from spanmill.functions.attributes import COST_KEYS, JSON, attr

    has_cost = F.lit(False)
    for key in COST_KEYS:
        has_cost = has_cost | F.contains(F.col(JSON), F.lit(f'"{key}":'))
    told = F.coalesce(attr(JSON, "llm.token_count.total"), attr(JSON, "gen_ai.usage.total_tokens")).try_cast("long")
    open_ = F.col("cost_usd").isNull() & ~has_cost & (F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull()) & F.col("price").isNotNull()
    cost = F.when(open_, price_tokens(detect_basis(told))).otherwise(F.col("cost_usd"))
    return with_price(spans, prices).withColumn("cost_usd", cost).select(*spans.columns)
