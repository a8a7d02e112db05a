import random

import numpy as np

import corpus_pipeline as p
from spanmill.llm import near_copies


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Of each component of pairs of similarity 0.8 or more, its smallest id."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in texts:
        for j in texts:
            a, b = sets[i], sets[j]
            if i < j and (a == b or len(a & b) / len(a | b) >= 0.8):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


def test_overlaps_equal_brute_force():
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.integers(-50, 50, rng.integers(1, 60))).astype(np.int32) for _ in range(n)] for n in (9, 14))
    i, j = np.divmod(np.arange(9 * 14), 14)
    want = [len(set(left[a].tolist()) & set(right[b].tolist())) for a, b in zip(i, j)]
    assert near_copies.overlaps(left, right, i, j, columns=16).tolist() == want
    assert near_copies.overlaps(left, right, i[:5], j[:5]).tolist() == want[:5]


def test_planted_near_copies_go(spark, sf_dir, monkeypatch):
    """The stage against brute force: copies with words changed at similarities on both sides of 0.8, and a crowd of copies."""
    monkeypatch.setattr(near_copies, "STAR", 10)
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng, texts = random.Random(8), {0: None, 1: "", 2: "One two", 3: "one  TWO"}
    for i in range(4, 34):
        texts[i] = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(40, 400)))
    for i in range(34, 120):
        w = texts[rng.randint(4, 33) if i < 80 else 4].split()
        for _ in range(rng.randint(1, max(1, len(w) // 40))):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, fp string")
    kept = p.simhash_near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    got = sorted(r.doc_id for r in kept.collect())
    assert got == sorted(brute(texts)) and len(got) < 80
    assert p.simhash_near_dedup(spark, docs.limit(0), sf_dir).count() == 0


def test_rows_that_repeat_ids(spark):
    """One row of each group stays, whatever the ids; a row that only shares a doc_id with a copy stays."""
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, one), (1, one), (5, one), (5, two), (None, two), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, __uid int")
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 3 and (1, one) in got and (5, two) in got
