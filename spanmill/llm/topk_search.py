"""Exact top-k inner products with multi-resolution segment statistics.

Vectors are turned into integers, floor(256 * x). Cut into segments, an inner product is at most the sum over segments
of length * (mean * mean + deviation * deviation) (Cauchy-Schwarz); as squared distances are squared norms less twice
the inner product, this is the lower bound of the distance. Segments get finer by halves down to two components. Bounds
are taken coarse to fine, pairs that can't reach the query's k-th best score so far are dropped, and survivors alone get
exact scores. A first pass over ``seeds`` candidates gives every query such a score before any group is searched, and
within a group longer vectors come first.

Queries are packed into blocks of ``query_block`` rows and candidates into groups of ``group`` rows; each block meets
each group in one task, and the tasks' best are merged by query. Nothing passes through the driver but counts.

Defined cases: null ids, null vectors and vectors with null or non-finite components take no part; vectors meet only
those of their own length; a row is a query or candidate of its own even where another row repeats its vec_id; scores
beyond a long are its greatest or least value; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import save

SLICE = 2048
_PACK = "dim int, uids binary, ids binary, data binary"
_FOUND = "query long, query_id long, uid long, vec_id long, score long"


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as doubles that hold integers, or as Python's where doubles might not hold their products."""
    if np.abs(x).max(initial=0) < 2.0**45:
        return np.floor(256 * x)
    return np.array([[int(v) * 256 if abs(v) >= 2.0**53 else int(np.floor(256 * v)) for v in row] for row in x], object).reshape(x.shape)


def products(q: np.ndarray, c: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None, step: int = 200_000) -> np.ndarray:
    """Exact inner products of the pairs (row of q, row of c), or of all; saturated to 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        x, y = q.astype(np.float64), c.astype(np.float64)
    elif most < 2**62:
        x, y = q.astype(np.int64), c.astype(np.int64)
    else:
        x, y = (np.array([[int(v) for v in row] for row in z], object).reshape(z.shape) for z in (q, c))
    if pairs is None:
        score = x @ y.T
    else:
        own = [(x[pairs[0][a : a + step]] * y[pairs[1][a : a + step]]).sum(axis=1) for a in range(0, len(pairs[0]), step)]
        score = np.concatenate(own) if own else np.zeros(0, np.int64)
    return np.clip(score, -(2**63), 2**63 - 1).astype(np.int64) if score.dtype == object else score.astype(np.int64)


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                rows: dict[tuple[int, bool], tuple[list, list, list]] = {}
                part = batch.slice(at, size)
                for uid, i, v in zip(part.column("uid").to_pylist(), part.column("vec_id").to_pylist(), part.column("embedding").to_pylist()):
                    wide = max(map(abs, v), default=0) >= 2.0**15  # kept apart, so that they alone take slow products
                    for held, x in zip(rows.setdefault((len(v), wide), ([], [], [])), (uid, i, v)):
                        held.append(x)
                for (dim, _), (uids, ids, data) in rows.items():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), *(pa.array([np.array(x, t).tobytes()], pa.binary()) for x, t in ((uids, np.int64), (ids, np.int64), (data, np.float64)))],
                        names=["dim", "uids", "ids", "data"])

    return run


def _unpacked(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """uids, ids and vectors of every pack."""
    for uids, ids, data, dim in zip(*(table[c].to_pylist() for c in ("uids", "ids", "data", "dim"))):
        ids = np.frombuffer(ids, np.int64)
        yield np.frombuffer(uids, np.int64), ids, integers(np.frombuffer(data, np.float64).reshape(len(ids), dim))


def levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine; the finest has two components a segment."""
    out = [dim // 2]
    while out[-1] >= 16:
        out.append(out[-1] // 4)
    return [n for n in reversed(out) if n]


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that their inner product is the bound."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            part = x[:, a:b]
            out += [part.mean(axis=1) * np.sqrt(b - a), part.std(axis=1) * np.sqrt(b - a)]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


class Best:
    """The k best (score, id, uid) of each query so far, and the score a candidate must reach."""

    def __init__(self, uids: np.ndarray, k: int, least: np.ndarray):
        self.uids, self.k, self.least = uids, k, least.copy()
        self.q = self.ids = self.of = self.score = np.zeros(0, np.int64)

    def add(self, q: np.ndarray, uids: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        other = self.uids[q] != uids
        q, of, ids, score = (np.concatenate([a, b[other]]) for a, b in ((self.q, q), (self.of, uids), (self.ids, ids), (self.score, score)))
        order = np.lexsort((of, ids, ~score, q))  # ~score: downward without overflow
        q, of, ids, score = q[order], of[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last])
        self.q, self.of, self.ids, self.score = (x[rank < self.k] for x in (q, of, ids, score))


def search(best: Best, queries: np.ndarray, uids: np.ndarray, ids: np.ndarray, data: np.ndarray) -> int:
    """Hold one slice of candidates against the queries; how many pairs took an exact product."""
    if queries.dtype == object or data.dtype == object:
        q, c = (x.ravel() for x in np.indices((len(queries), len(ids))))
    else:
        alive = np.ones((len(queries), len(ids)), bool)
        need = best.least[:, None]
        for n in levels(data.shape[1]):
            bound = features(queries, n) @ features(data, n).T
            alive &= bound + np.abs(bound) * 1e-9 + 1 >= need
        q, c = np.nonzero(alive)
    score = products(queries, data, (q, c))
    near = score >= best.least[q]
    best.add(q[near], uids[c[near]], ids[c[near]], score[near])
    return len(q)


def _seeded(k: int):
    """A block's queries with the k-th best score among the seeds; -inf where there are fewer."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        least = []
        for quids, _, queries in _unpacked(left):
            best = Best(quids, k, np.full(len(quids), -np.inf))
            for uids, ids, data in _unpacked(right):
                search(best, queries, uids, ids, data)
            least.append(best.least.tobytes())
        return left.append_column("least", pa.array(least, pa.binary()))

    return run


def _search_groups(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "uid", "vec_id", "score")})]
        for (quids, qids, queries), least in zip(_unpacked(left), left["least"].to_pylist()):
            best = Best(quids, k, np.frombuffer(least))
            for uids, ids, data in _unpacked(right):
                order = np.argsort(-(data.astype(np.float64) ** 2).sum(axis=1), kind="stable")
                for at in range(0, len(order), 512):
                    some = order[at : at + 512]
                    search(best, queries, uids[some], ids[some], data[some])
            out.append(pa.table({"query": quids[best.q], "query_id": qids[best.q], "uid": best.of, "vec_id": best.ids, "score": best.score}))
        return pa.concat_tables(out)

    return run


def top_k(embeddings: DataFrame, is_query: Column | str, k: int = 5, query_block: int = 2048, group: int = 8192, seeds: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for each row where is_query holds; embeddings holds vec_id and embedding."""
    is_query = F.expr(is_query) if isinstance(is_query, str) else is_query
    known = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where(known).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = save(rows, "vectors")
    n, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, groups = max(1, -(-asking // query_block)), max(1, -(-n // group))
    vectors = rows.drop("asks")
    over = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    left = rows.where("asks").drop("asks").repartition(blocks, "uid").mapInArrow(_pack(query_block), _PACK).select(F.pmod(F.xxhash64("uids"), F.lit(blocks)).cast("int").alias("qb"), "*")
    few = vectors.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) < int(seeds / max(n, 1) * (1 << 20)) + 1).mapInArrow(_pack(SLICE), _PACK)
    first = few.select(over(blocks, "qb"), "*")
    left = left.groupBy("qb", "dim").cogroup(first.groupBy("qb", "dim")).applyInArrow(_seeded(k), f"qb int, {_PACK}, least binary").select("*", over(groups, "s"))
    right = vectors.mapInArrow(_pack(SLICE), _PACK).select(F.pmod(F.xxhash64("uids"), F.lit(groups)).cast("int").alias("s"), over(blocks, "qb"), "*")
    keys = ["qb", "s", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search_groups(k), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
