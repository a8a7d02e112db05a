import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.llm.topk_search import Best, features, levels, search, top_k

ASKS = "vec_id % 50 = 0"
MOST = 2**63 - 1


def brute(rows, k):
    ok = [(i, [256 * int(x) if abs(x) >= 2**53 else math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (q, a) in enumerate(ok):
        if q % 50 == 0:
            own = [(-max(-MOST - 1, min(MOST, sum(x * y for x, y in zip(a, b)))), c, m) for m, (c, b) in enumerate(ok) if m != n and len(a) == len(b)]
            out.update((q, r + 1, c, -s) for r, (s, c, _) in enumerate(sorted(own)[:k]))
    return out


@pytest.mark.parametrize("block, group, seeds", [(2048, 8192, 4096), (3, 20, 10)])
def test_equals_brute_force(spark, block, group, seeds):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(150)] + [(i, [1.0] * 8) for i in range(200, 260)] + [(i, [0.0] * 8) for i in range(300, 310)]
    rows += [(7, None), (None, [1.0] * 8), (350, [1.0, None] * 4), (351, [float("nan")] * 8), (352, [float("inf")] * 8), (353, [1e12] * 8), (400, [1.0, 2.0]), (401, [3.0, -1.0]), (450, []), (451, []), (201, [9.0] * 8), (50, [0.5] * 8), (50, [0.5] * 8), (500, [2.0**23] * 8),
             (550, [1e300, -1.0] * 4), (551, [-1e300, 0.0] * 4), (552, [2.0**40] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = Counter(tuple(r) for r in top_k(df, ASKS, 5, block, group, seeds).collect())
    assert got == brute(rows, 5)
    assert top_k(df.limit(0), ASKS).count() == 0 and top_k(df, F.lit(None).cast("boolean")).count() == 0


def test_bounds_hold_and_tighten():
    x = np.random.default_rng(1).integers(-300, 300, (50, 64)).astype(float)
    exact, last = x @ x.T, None
    for level in (1, 2, 4, 8, 16, 32, 64):
        f = features(x, level)
        bound = f @ f.T
        assert (bound >= exact - 1e-6).all() and (last is None or (bound <= last + 1e-6).all())
        last = bound
    assert levels(64) == [8, 32] and levels(3) == [1] and levels(0) == []


@pytest.mark.parametrize("spread, least", [(None, 0.5), (0.15, 0.85)])
def test_bounds_prune(spread, least):
    """The share of pairs that never get an exact product: unit vectors in all directions, and in 20 clusters."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 64)) if spread is None else rng.normal(size=(20, 64))[rng.integers(0, 20, 6000)] + spread * rng.normal(size=(6000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    ids, asking = np.arange(6000), np.arange(0, 6000, 50)
    best = Best(asking, 5, np.full(120, -np.inf))
    search(best, x[asking], ids[:1000], ids[:1000], x[:1000])
    exact = sum(search(best, x[asking], ids[a : a + 500], ids[a : a + 500], x[a : a + 500]) for a in range(1000, 6000, 500))
    assert 1 - exact / (120 * 5000) >= least
