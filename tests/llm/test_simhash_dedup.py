import random
import re

import numpy as np
import xxhash

from spanmill.llm import simhash_dedup as s


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp):
    root = {x: x for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fp:
        for j in fp:
            if i < j and bin(fp[i] ^ fp[j]).count("1") <= 3 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {x: find(x) for x in fp}


def texts():
    rng = random.Random(5)
    out = {0: None, 1: "", 2: "one", 3: "One", 4: "a b", 5: "A  b\n", 6: "ÀB c d"}
    for i in range(7, 40):
        out[i] = " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(3, 200)))
    for i in range(40, 80):
        w = (out[rng.randint(7, 39)]).split()
        w[rng.randrange(len(w))] = "changed"
        out[i] = " ".join(w)
    return out


def test_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows.items()], "doc_id long, text string, fp int")
    fp = {i: brute_fp(t) for i, t in rows.items()}
    want = brute_components(fp)
    got = {r.doc_id: (int(r.fingerprint, 16), len(r.fingerprint), r.component_id) for r in s.near_duplicates(df).collect()}
    assert got == {i: (fp[i], 16, want[i]) for i in rows}
    kept = s.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    empty = df.limit(0)
    assert s.near_duplicates(empty).count() == 0


def test_links_through_chains_and_full_buckets(spark):
    rng, fp = np.random.default_rng(1), []
    for _ in range(2):  # balls and chains of fingerprints around random centres, so that buckets overflow
        x = int(rng.integers(0, 1 << 63))
        for _ in range(45):
            fp.append(x)
            x ^= sum(1 << int(b) for b in rng.choice(40, rng.integers(1, 6), replace=False))
    fp = sorted(set(fp))
    nodes = spark.createDataFrame([(s._signed(x),) for x in fp], "fp long")
    names = {r.node: r.root for r in s.components(s.near_pairs(nodes, bucket=24, block=8)).collect()}
    want = brute_components(dict(enumerate(fp)))
    roots = [names.get(s._signed(x), s._signed(x)) for x in fp]
    groups = {}
    for i, r in enumerate(roots):
        groups.setdefault(r, set()).add(i)
    expect = {}
    for i, r in want.items():
        expect.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_drop_decides_row_by_row(spark):
    """Rows (1, T1), (5, T1), (5, T2): T2 has no near copy and stays; null ids are dropped like any other."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    df = spark.createDataFrame([(1, one, 0), (1, one, 0), (5, one, 0), (5, two, 0), (None, two, 0)], "doc_id long, text string, __uid int")
    kept = s.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, one), (5, two)]
