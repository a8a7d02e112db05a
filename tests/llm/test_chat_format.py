import random

from spanmill.llm.chat_format import format_conversations, format_preferences


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, r, t in turns)


def brute(rows):
    pairs = {}
    for conv, turn, role, text in rows:
        if conv is not None and turn is not None:
            pairs.setdefault(conv // 2, ([], []))[conv % 2].append((turn, role or "", text or ""))
    out = {}
    for pair, sides in pairs.items():
        c, r = (sorted(set(s)) for s in sides)
        n = min((t[0] for t in set(c) ^ set(r)), default=None)
        common = [t for t in (c or r) if n is None or t[0] < n]
        own = [[t for t in s if n is not None and t[0] >= n] if s else None for s in (c, r)]
        spans = []
        for s in own:
            at, found = 0, []
            for _, role, text in s or []:
                start = at + 13 + len(role)
                at = start + len(text) + 11
                if role == "assistant":
                    found.append((start, at - 1))
            spans.append(found)
        out[pair] = (render(common), *(None if s is None else render(s) for s in own), *spans)
    return out


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(None, 0, "user", "x"), (0, None, "user", "x"), (0, 0, None, None), (1, 0, "", ""), (2, 0, "user", "only chosen"), (5, 0, "assistant", "only rejected")]
    for pair in range(5, 40):
        shared = [(rng.choice(["system", "user", "assistant"]), rng.choice(["é", "hi there", "", "日本"])) for _ in range(rng.randint(0, 6))]
        for side in (0, 1):
            own = shared + [(rng.choice(["user", "assistant"]), f"t{rng.randint(0, 1)}") for _ in range(rng.randint(0, 3))]
            rows += [(2 * pair + side, t, r, x) for t, (r, x) in enumerate(own)]
    rows += [rows[-1], rows[-2], (60, 0, "user", "tie"), (60, 0, "user", "tie2")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    want = brute(rows)
    parse = lambda s: [tuple(map(int, x.split("-"))) for x in (s or "").split(",") if x]
    got = {r.pair_id: (r.prompt, r.chosen, r.rejected, parse(r.chosen_loss), parse(r.rejected_loss)) for r in format_conversations(df).collect()}
    assert got == want
    for r in got.values():
        for text, spans in ((r[1], r[3]), (r[2], r[4])):
            assert all(text[a:b].endswith("<|im_end|>") and text[:a].endswith("<|im_start|>assistant\n") for a, b in spans)
    assert format_conversations(df.limit(0)).count() == 0


def test_long_conversations_are_one_row(spark):
    """Pairs of 20 and 1,000 turns, in one block or many, render alike; the longest differs in its last turn only."""
    rows = [(p, s, t, "user" if t % 2 else "assistant", f"{t if t < n - p else s}") for p, n in ((1, 20), (2, 1000)) for s in ("chosen", "rejected") for t in range(n)]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")
    one, many = ({r.pair_id: r for r in format_preferences(df, block=b).collect()} for b in (10_000, 4))
    assert one == many and len(one) == 2 and format_preferences(df).count() == 2
    assert one[2].n_common == 998 and one[2].n_chosen == 2 and one[1].prompt.count("<|im_start|>") == 19
    for r in one.values():
        assert all(r.chosen[s.start : s.end].endswith("<|im_end|>") and r.chosen[: s.start].endswith("<|im_start|>assistant\n") for s in r.chosen_loss)
