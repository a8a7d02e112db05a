"""Near copies by exact Jaccard similarity of word shingles, for the pipeline's SimHash stage.

Shingles are runs of ``width`` words, lower-cased in A-Z only. Candidate pairs come from two sources: op9's SimHash links
(fingerprints of these shingles within 3 bits, by pivot distance tables), and MinHash bands, because 64 bits can't reach
similarity 0.8: such pairs lie up to 17 bits apart, where the bands of an exact search would be 3 bits wide. With BANDS
bands of ROWS minima a pair of similarity 0.8 shares none with probability (1 - 0.8**4)**25 < 2e-6, a closer pair more
rarely still. Every candidate is verified on its shingle sets, so no link is below the similarity.

Within a bucket each member is first verified with one member drawn by hash (alike in all buckets; one per STAR members
of a large bucket). Buckets whose members are then still in different components are dealt as pairs of blocks: members
outside the bucket's largest component against all, each pair in the first bucket it shares, so a crowd of linked copies
costs no pairs and no task holds more than two blocks. Sets hold the shingles' low 32 bits there; two different shingles
of a pair agree in them with probability 2**-32.

Texts with the same words are collapsed first by a 128-bit hash. Of each component of links one row stays: the least by
(doc_id, nulls last, row), so rows that repeat a doc_id or have none are dropped like any other. A text without words is
a copy of all such texts; one of fewer words than ``width`` is one shingle. Extra columns are passed through, whatever
their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import fresh, list_array, save, slices, texts_of
from spanmill.llm.simhash_dedup import components, majority, near_pairs, shingle_hashes
from spanmill.llm.wordhash import mix

BANDS, ROWS = 25, 4
STAR, BLOCK = 4096, 256
_STEP = 4096
_SEEDS = np.random.default_rng(2025).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False)
_TIMES, _PLUS = _SEEDS[0] | np.uint64(1), _SEEDS[1]


def bands(found: np.ndarray) -> np.ndarray:
    """One hash a band over the minima of a set of shingle hashes; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), _STEP):
        np.minimum(least, (found[at : at + _STEP, None] * _TIMES + _PLUS).min(axis=0), out=least)
    value = mix(np.arange(BANDS, dtype=np.uint64))
    for k in range(ROWS):
        value = mix(value ^ least.reshape(BANDS, ROWS)[:, k])
    return value


def signatures(texts: DataFrame, width: int) -> DataFrame:
    """Per row of (uid, doc_id, text): a 128-bit key of its words, the fingerprint, the number of shingles and the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, fps, sizes, own = [], [], [], []
            for text in texts_of(batch, "text"):
                found = shingle_hashes(text, width)
                keys.append(xxhash.xxh3_128_digest(b" ".join(text.encode().lower().split()) if text else b""))
                fps.append(majority(found))
                found = np.unique(found)
                sizes.append(len(found))
                own.append(bands(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                 list_array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64), [len(x) for x in own], pa.int64())],
                names=["uid", "doc_id", "key", "fp", "size", "bands"])

    return texts.mapInArrow(run, "uid long, doc_id long, key binary, fp long, size long, bands array<long>")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """Per row of (uid, text): node, its uid, and the sorted set of its shingles' hashes' low 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = [np.unique(shingle_hashes(t, width).astype(np.uint32)).view(np.int32) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), list_array(np.concatenate([np.zeros(0, np.int32), *own]), [len(x) for x in own], pa.int32())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<int>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity."""
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("total"))
    return shared.where(F.col("n") / (F.col("total") - F.col("n")) >= similarity).select("a", "b")


def _like(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be that similar."""
    return F.least(a, b) / F.greatest(a, b) >= similarity


def _stars(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of bucket members (bucket, n, node, size) with the one drawn for their part of it, and of those drawn with each other's first."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / STAR)))
    drawn = rows.groupBy("bucket", "part").agg(F.min(F.struct(F.xxhash64(F.lit(7), "node").alias("lot"), "node", "size")).alias("star"))
    first = drawn.groupBy("bucket").agg(F.min("star").alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1")
    pair = lambda df, x, y: df.where((F.col(x["node"]) != F.col(y["node"])) & _like(F.col(x["size"]), F.col(y["size"]), similarity)).select(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"))
    own, star, head = {"node": "node", "size": "size"}, {"node": "star.node", "size": "star.size"}, {"node": "head.node", "size": "head.size"}
    return pair(rows.join(drawn, ["bucket", "part"]), own, star).union(pair(drawn.join(first, "bucket"), star, head)).distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, columns: int = 1 << 14) -> np.ndarray:
    """The number of values that left[i] and right[j], sorted sets, share."""
    if len(i) <= 8:
        return np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
    rows, i = np.unique(i, return_inverse=True)
    others, j = np.unique(j, return_inverse=True)
    x, y = ([held[k] for k in kept.tolist()] for held, kept in ((left, rows), (right, others)))
    of_x, of_y = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y))
    x, y = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(x, y)
    total = np.zeros((len(rows), len(others)), np.float32)
    for at in range(0, len(both), columns):
        some = both[at : at + columns]
        made = []
        for values, of, n in ((x, of_x, len(rows)), (y, of_y, len(others))):
            place = np.minimum(np.searchsorted(some, values), len(some) - 1)
            hit = some[place] == values
            table = np.zeros((n, len(some)), np.float32)
            table[of[hit], place[hit]] = 1
            made.append(table)
        total += made[0] @ made[1].T
    return total[i, j].astype(np.int64)


def _unit_links(unit: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the left and right members of one unit that are in different components, one per left member and component."""
    k = unit["band"][0].as_py()
    side = unit["own"].to_numpy()
    node, root = unit["node"].to_numpy(), unit["root"].to_numpy()
    bands_of = np.array(unit["marks"].to_pylist(), np.int64).reshape(len(node), -1)
    sets = [np.asarray(v.values) for v in unit["shingles"]]
    size = np.array([len(v) for v in sets], np.float64)
    a, b = np.flatnonzero(side), np.flatnonzero(~side)
    mask = root[a, None] != root[None, b]
    mask &= np.minimum(size[a, None], size[None, b]) >= similarity * np.maximum(size[a, None], size[None, b])
    for earlier in range(k):
        mask &= bands_of[a, None, earlier] != bands_of[None, b, earlier]
    i, j = np.nonzero(mask)
    if not len(i):
        return node[:0], node[:0]
    n = overlaps([sets[x] for x in a], [sets[x] for x in b], i, j)
    ok = n >= similarity * (size[a[i]] + size[b[j]] - n)
    i, j = a[i[ok]], b[j[ok]]
    first = np.unique(np.stack([i, root[j]]), axis=1, return_index=True)[1] if len(i) else np.zeros(0, np.int64)
    return node[i[first]], node[j[first]]


def _unlinked_pairs(rows: DataFrame, names: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of different components of a bucket: those outside its largest component against all."""
    named = rows.where("n > 2").join(names, "node", "left").select("bucket", "band", "node", F.coalesce("root", "node").alias("root"))
    per = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    mixed = per.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("n")).where("most.k < n")
    held = named.join(mixed, "bucket").withColumn("lefts", F.ceil((F.col("n") - F.col("most.k")) / BLOCK).cast("int")).withColumn("rights", F.ceil(F.col("n") / BLOCK).cast("int"))
    held = held.join(nodes.select("node", F.transform("bands", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("marks")), "node").join(sets, "node")
    mine = lambda parts, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    payload = ["bucket", "band", "node", "root", "marks", "shingles"]
    left = held.where("root <> most.root").select(*payload, F.lit(True).alias("own"), mine("lefts", 1).alias("i"), every("rights").alias("j"))
    right = held.select(*payload, F.lit(False).alias("own"), mine("rights", 2).alias("j"), every("lefts").alias("i"))
    keys = ["bucket", "i", "j"]

    def run(unit: pa.Table) -> pa.Table:
        a, b = _unit_links(unit, similarity)
        return pa.table({"a": a, "b": b})

    return left.unionByName(right).groupBy(*keys).applyInArrow(run, "a long, b long").distinct()


def doomed(texts: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The uid of every row of (uid, doc_id, text) but the one that stays of each component."""
    own = save(signatures(texts, width), "near-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    nodes = own.groupBy("key").agg(first, F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = save(nodes.select("key", F.col("first.uid").alias("node"), "first", "fp", "size", "bands"), "near-nodes")

    rows = nodes.select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    rows = save(rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("n > 1"), "near-buckets")
    prints = save(nodes.where("size > 0").groupBy("fp").agg(F.min("node").alias("rep")), "near-prints")
    same = nodes.join(prints, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    close = near_pairs(prints.select("fp")).join(prints.withColumnsRenamed({"fp": "a", "rep": "ra"}), "a").join(prints.withColumnsRenamed({"fp": "b", "rep": "rb"}), "b")
    close = close.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    pairs = save(_stars(rows, similarity).union(same).union(close).distinct(), "near-pairs")

    wanted = save(rows.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct(), "near-wanted")  # its size decides how Spark joins it
    sets = save(shingle_sets(texts.select("uid", "text").join(wanted, F.col("uid") == F.col("node"), "left_semi"), width), "near-sets")
    links = save(_verified(pairs, sets, similarity), "near-links")
    more = save(_unlinked_pairs(rows, components(links), nodes, sets, similarity), "near-links")
    names = components(links.union(more))

    named = nodes.join(names, "node", "left").select("key", "first", F.coalesce("root", "node").alias("root"))
    stays = named.groupBy("root").agg(F.min("first").alias("stays"))
    kept = named.join(stays, "root").where("first <=> stays").select("key", F.col("stays.uid").alias("kept"))
    return own.select("uid", "key").join(kept, "key", "left").where("kept IS NULL OR kept <> uid").select("uid")


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The documents, all columns kept, but of each component of near copies only one row."""
    uid = fresh(docs, "__uid")
    docs = save(docs.withColumn(uid, F.monotonically_increasing_id()), "near-docs")
    gone = save(doomed(docs.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), similarity, width), "near-gone")
    return docs.join(gone.select(F.col("uid").alias(uid)), uid, "left_anti").drop(uid)
