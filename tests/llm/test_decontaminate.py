import hashlib
import random
import re

from spanmill.llm import decontaminate as d

TEXTS = [None, "", "  ..  ", "One two THREE four five six seven eight nine ten eleven", "x one two three four five six seven eight nine ten y",
         "É1 é1", "short item", "a short, ITEM here; short item", "w " * 5000 + "one two three four five six seven eight nine ten", "é1", "École"]
ITEMS = [("7", "one two three four five six seven eight nine ten eleven"), ("10", "short item"), ("7", "é1"), (None, "a short"), ("5", None), ("6", " ,"), ("8", "one two three four five six seven eight nine ten")]


def brute(text, items, n):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, names = words(text), set(), set()
    for name, t in items:
        own = words(t)
        for gram in {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else ():
            for p in range(len(w) - len(gram) + 1):
                if tuple(w[p : p + len(gram)]) == gram:
                    hit |= set(range(p, p + len(gram)))
                    names |= {name} - {None}
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def frames(spark, texts, items):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_hit long")
    return docs, spark.createDataFrame(items, "item_id string, text string")


def test_both_ways_equal_brute_force(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    items = ITEMS + [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))) for i in range(6)]
    docs, bench = frames(spark, texts, items)
    for n in (2, 10):
        want = {i: brute(t, items, n) for i, t in enumerate(texts)}
        for bound in (1 << 20, 0):
            got = {r.doc_id: tuple(r)[1:] for r in d.contamination(docs, bench, n, bound).collect()}
            assert got == want


def test_removal_keeps_columns(spark):
    docs, bench = frames(spark, TEXTS, ITEMS)
    clean = {r.doc_id for r in d.contamination(docs, bench).where("not contaminated").collect()}
    for bound in (1 << 20, 0):
        kept = d.decontaminate(docs, bench, max_broadcast_bytes=bound)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean
    cut = {r.doc_id: r.text for r in d.decontaminate(docs, bench, action="spans").collect()}
    assert cut[4] == "x  y" and cut[7].strip(" ;,") == "here"
    assert all(cut[i] == TEXTS[i] for i in clean)


def test_empty_tables(spark):
    docs, bench = frames(spark, TEXTS, ITEMS)
    assert d.contamination(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in d.contamination(docs, bench.limit(0)).collect())
