"""SimHash near-duplicates with pivot distance tables.

Fingerprints: 64 bits over the XXH64 hashes of three-word shingles. Equal fingerprints are collapsed first, so copies
cost one node. A pair within 3 bits agrees on one of four bands of the bits not yet fixed; candidates meet in buckets
of such bands, and a bucket of more than ``bucket`` fingerprints is cut again by bands of its free bits, which ends at
12 free bits at the latest. Within a bucket a table of Hamming distances to reference fingerprints (pivots) discards a
pair once any coordinate differs by more than 3 (triangle inequality), and survivors are verified. Buckets over
``block`` fingerprints are dealt as pairs of blocks, so no task holds more than two blocks of one bucket. Each task
sends a spanning forest of its links; components come from repeated contraction in a random order.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; a null doc_id belongs to a
component, but isn't its name unless all its ids are null; rows that repeat a doc_id stand for themselves; extra
columns are ignored or passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import fresh, save, slices, texts_of

BITS = 3
_STEP = 1 << 16


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of each run of ``width`` words; of the whole text if it has fewer, of none if it has none."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.fromiter(accumulate(len(w) + 1 for w in found), np.int64, len(found)) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = (starts[:1], ends[-1:]) if len(found) < width else (starts[: len(found) - width + 1], ends[width - 1 :])
    out, digest = np.empty(len(starts), np.uint64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _STEP):
        out[at : at + _STEP] = [digest(joined[s:e], 42) for s, e in zip(starts[at : at + _STEP].tolist(), ends[at : at + _STEP].tolist())]
    return out


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        counts += np.unpackbits(hashes[at : at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None) -> int:
    """The text's fingerprint as an unsigned integer."""
    return majority(shingle_hashes(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = np.array([fingerprint(t) for t in texts_of(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = 24) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random 64-bit values."""
    return np.random.default_rng(2024).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def links(fp: np.ndarray, unit: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within BITS bits among rows of equal, adjacent units."""
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], unit))
    fp, unit, table = fp[order], unit[order], table[order]
    root = np.arange(len(fp))
    alive, lag, left, right = np.arange(len(fp)), 0, [], []
    while len(alive):
        lag += 1
        alive = alive[alive + lag < len(fp)]
        alive = alive[unit[alive] == unit[alive + lag]]
        alive = alive[table[alive + lag, 0] - table[alive, 0] <= BITS]  # sorted by the first pivot: none further off comes back
        a = alive
        for k in range(1, len(refs)):
            a = a[np.abs(table[a, k] - table[a + lag, k]) <= BITS]
        a = a[np.bitwise_count(fp[a] ^ fp[a + lag]) <= BITS]
        a = a[fp[a] != fp[a + lag]]
        left.append(a)
        right.append(a + lag)
    left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    while len(left):
        low = np.minimum(root[left], root[right])
        if (root[left] == low).all() and (root[right] == low).all():
            break
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
    tied = np.flatnonzero(root != np.arange(len(fp)))
    return fp[tied], fp[root[tied]]


def split(mask: int) -> list[int]:
    """The mask with one of four bands of its free bits fixed too."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in band) for band in np.array_split(free, 4)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(nodes: DataFrame, bucket: int = 4096, block: int = 512) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` of nodes: a spanning forest of each bucket's links."""
    spark, refs, found = nodes.sparkSession, pivots(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([table[c].to_numpy() for c in ("mask", "value", "i", "j")])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            held = table.slice(int(change[-1])) if len(change) else table
            if len(change):
                yield from done(table.slice(0, int(change[-1])))
        if held is not None:
            yield from done(held)

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.stack([table[c].to_numpy() for c in ("mask", "value", "i", "j")])
        unit = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
        a, b = links(table["fp"].to_numpy().view(np.uint64), unit, refs)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    masks, rows = [0], nodes.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        step = spark.createDataFrame([(_signed(m), [_signed(x) for x in split(m)]) for m in masks], "mask long, next array<long>")  # 4 ** rounds rows
        masks = [x for m in masks for x in split(m)]
        rows = rows.join(F.broadcast(step), "mask").select("fp", F.explode("next").alias("mask"))
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "value").count().where("count > 1")
        sized = save(rows.join(sizes, ["mask", "value"]), "simhash-buckets")
        last = bin(masks[0]).count("1") >= 64 - 12
        ready = sized if last else sized.where(F.col("count") <= bucket)
        parts = F.ceil(F.col("count") / block).cast("int")
        own = F.pmod(F.xxhash64("fp"), parts).cast("int")
        units = ready.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        units = units.select("mask", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        keys = ["mask", "value", "i", "j"]
        more = units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")
        found = more if found is None else found.unionByName(more)
        rows = sized.where(F.col("count") > bucket).select("fp", "mask")
        if last or rows.isEmpty():
            return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of the edges (a, b): contraction until no edge is left, in a new random order each round."""
    edges = save(edges, "simhash-links")
    names, turn = None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("r"), F.col(c).alias("v"))
        to = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), F.min(rank("a")))["v"].alias("root"))
        to = save(to, "simhash-step")
        if names is None:
            names = to
        else:
            moved = names.join(to.withColumnsRenamed({"root": "next", "node": "root"}), "root", "left")
            names = save(moved.select("node", F.coalesce("next", "root").alias("root")), "simhash-names")
        a, b = to.withColumnsRenamed({"node": "a", "root": "ra"}), to.withColumnsRenamed({"node": "b", "root": "rb"})
        edges = edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = save(edges, "simhash-links")
    return names if names is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _components_of(own: DataFrame) -> DataFrame:
    """fp and root for every fp of own."""
    nodes = own.select("fp").distinct()
    names = components(near_pairs(nodes))
    return nodes.join(names.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint as 16 hex digits, and component_id, the smallest doc_id reachable by links."""
    own = save(fingerprints(docs), "simhash-fp")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = nodes.join(_components_of(own), "fp")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "root").select("fp", "component_id")
    return own.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, but of each component only one row: the least by (doc_id, nulls last, row)."""
    uid = fresh(docs, "__uid")
    docs = save(docs.withColumn(uid, F.monotonically_increasing_id()), "simhash-docs")
    own = save(fingerprints(docs.select(F.col(uid).alias("doc_id"), "text")).withColumnRenamed("doc_id", "uid"), "simhash-fp")
    rows = own.join(docs.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("id")), "uid")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")
    kept = rows.groupBy("fp").agg(first).join(_components_of(own), "fp").groupBy("root").agg(F.min("first").alias("first"))
    return docs.join(kept.select(F.col("first.uid").alias(uid)), uid, "left_semi").drop(uid)
