"""Preference formatting of conversations, in DataFrame functions only.

A pair holds a chosen and a rejected conversation. Their longest common turn prefix is rendered once as ``prompt``; the
turns from the first difference on are rendered as the two completions, each with the character spans a loss may be
taken on (its assistant turns). Turns render as ``<|im_start|>role\\ntext<|im_end|>\\n``.

Turns meet and are rendered by (pair, block of ``block`` turn numbers); a pair's rendered blocks are then joined in order,
so a pair is one row however long its conversations are, and only that row holds all of them.

Defined cases: turn numbers order a conversation; a null pair, side or turn takes no part; identical rows count once;
different rows with one turn number are rendered in order of role and text, and are common only if both sides hold the
same rows; null role or text render as empty; a pair with one side has an empty prompt and a null other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def paired_by_parity(conversations: DataFrame) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as pair k."""
    pair = F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id")
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").when(F.col("conv_id").isNotNull(), "rejected").alias("side")
    return conversations.select(pair, side, F.col("turn").cast("long").alias("turn"), "role", "text")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))), "")


def _spans(turns: Column) -> Column:
    """[start, end) of assistant turns' text and end mark within the rendered turns."""
    head, tail = len("<|im_start|>") + 1, len("<|im_end|>")
    empty = F.array().cast("array<struct<start:long,end:long>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(acc, t):
        first = acc["at"] + head + F.length(t["role"])
        end = first + F.length(t["text"]) + tail
        own = F.struct(first.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per pair: prompt, chosen and rejected with their loss spans, and the common and own numbers of turns.

    turns: pair_id, side ("chosen" or "rejected"), turn, role, text.
    """
    known = turns.where("pair_id IS NOT NULL AND turn IS NOT NULL AND side IN ('chosen', 'rejected')")
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, row)))
    blocks = known.groupBy("pair_id", F.floor(F.col("turn") / block).cast("long").alias("block")).agg(side("chosen").alias("c"), side("rejected").alias("r"))
    first = F.array_min(F.transform(F.concat(F.array_except("c", "r"), F.array_except("r", "c")), lambda t: t["turn"]))
    per_pair = blocks.groupBy(F.col("pair_id").alias("pair")).agg(
        F.min(first).alias("differs"), F.max(F.size("c") > 0).alias("has_c"), F.max(F.size("r") > 0).alias("has_r"))
    common = lambda t: F.col("differs").isNull() | (t["turn"] < F.col("differs"))
    cut = blocks.join(per_pair, F.col("pair_id") == F.col("pair")).select(
        "pair_id", "block", "has_c", "has_r", F.filter(F.when(F.col("has_c"), F.col("c")).otherwise(F.col("r")), common).alias("p"), F.filter("c", lambda t: ~common(t)).alias("c"), F.filter("r", lambda t: ~common(t)).alias("r"))
    done = F.struct("block", *(x for k in "pcr" for x in (_render(F.col(k)).alias(k), F.size(k).cast("long").alias(f"n{k}"), _spans(F.col(k)).alias(f"s{k}"))))
    pairs = cut.groupBy("pair_id").agg(F.first("has_c").alias("has_c"), F.first("has_r").alias("has_r"), F.array_sort(F.collect_list(done)).alias("b"))
    text = lambda k: F.array_join(F.transform("b", lambda x: x[k]), "")
    count = lambda k: F.aggregate("b", F.lit(0).cast("long"), lambda n, x: n + x[f"n{k}"])
    return pairs.select(
        "pair_id", count("p").alias("n_common"), text("p").alias("prompt"),
        *(x for s, k in (("chosen", "c"), ("rejected", "r")) for x in (
            F.when(F.col(f"has_{k}"), count(k)).alias(f"n_{s}"), F.when(F.col(f"has_{k}"), text(k)).alias(s), F.when(F.col(f"has_{k}"), _shifted(k)).alias(f"{s}_loss"))),
    )


def _shifted(k: str) -> Column:
    """The spans of all blocks in ``b``, each moved by the texts before its block."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(acc, x):
        moved = F.transform(x[f"s{k}"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + F.length(x[k])).cast("long").alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    return F.aggregate("b", start, step, lambda acc: acc["spans"])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The preference pairs of a conversations table; loss spans as "start-end" lists."""
    out = format_preferences(paired_by_parity(conversations))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({f"{s}_loss": F.when(F.col(f"{s}_loss").isNotNull(), text(F.col(f"{s}_loss"))) for s in ("chosen", "rejected")})
