"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are runs of ASCII letters and digits (lower-cased) and of all characters from U+0080. A window is ``n``
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. The windows' hashes are
broadcast after a check of the benchmark's size; document windows are hashed with NumPy, looked up, and every hit is
verified word by word, so no hash collision can flag a document. A benchmark over the bound takes a distributed join
on the windows' text instead.

Defined cases: a null text has no words and is clean; a null or wordless item has no windows; an item_id that repeats
counts once; a null item_id marks words but isn't listed; extra columns are passed through or ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import fresh, save, slices, texts_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: of benchmark text; a window takes some 200 bytes as ids, hash and item list, so a set stays under 64 MB
MAX_BROADCAST_BYTES = 1 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: str | None) -> list[bytes]:
    """The text's words, lower-cased in A-Z only, as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def windows(item: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    return [tuple(item[i : i + n]) for i in range(max(1, len(item) - n + 1))] if item else []


class GramSet:
    """Distinct benchmark windows by length, with their items; hashes are collision-free among the windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            for gram in windows(words(text), n):
                found.setdefault(gram, set()).update([] if item_id is None else [item_id])
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for gram in found for w in gram}))}
        self.tables = []
        for length in sorted({len(gram) for gram in found}):
            grams = [gram for gram in found if len(gram) == length]
            ids = np.array([[self.vocabulary[w] for w in gram] for gram in grams], np.int64)
            multiplier = 0x9E3779B97F4A7C15
            while len(np.unique(hashes := rolling(ids.ravel(), length, multiplier)[::length])) < len(grams):
                multiplier += 2
            order = np.argsort(hashes)
            seen = np.zeros(1 << 16, bool)
            seen[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.tables.append((length, multiplier, hashes[order], ids[order], [sorted(found[grams[i]]) for i in order], seen))

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[list[str]]]]:
        """For each window length: the starts of its verified occurrences and their items."""
        for length, multiplier, hashes, grams, items, seen in self.tables:
            if len(ids) < length:
                continue
            at = rolling(ids, length, multiplier)
            near = np.flatnonzero(seen[(at >> np.uint64(48)).astype(np.int64)])
            row = np.minimum(np.searchsorted(hashes, at[near]), len(hashes) - 1)
            hit = hashes[row] == at[near]
            near, row = near[hit], row[hit]
            same = (ids[near[:, None] + np.arange(length)] == grams[row]).all(axis=1)
            yield length, near[same], [items[i] for i in row[same]]


def rolling(ids: np.ndarray, length: int, multiplier: int) -> np.ndarray:
    """Hash of each run of ``length`` ids, modulo 2**64, mixed so that the top bits are usable."""
    value = np.zeros(len(ids) - length + 1, np.uint64)
    ids = ids.astype(np.uint64)
    for j in range(length):
        value *= np.uint64(multiplier)
        value += ids[j : len(ids) - length + 1 + j]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def scan(texts: list[str | None], grams: GramSet) -> tuple[list[int], np.ndarray, np.ndarray, list[set[str]]]:
    """For each text: its number of words, the start of its words in the mask, and its items; the mask of hit words."""
    parts, counts = [], []
    for text in texts:
        found = words(text)
        counts.append(len(found))
        parts.append(np.fromiter(map(grams.vocabulary.get, found, repeat(0)), np.int32, len(found)))
        parts.append(np.zeros(1, np.int32))  # no window spans two texts
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.array(counts, np.int64) + 1, out=starts[1:])
    change, items = np.zeros(len(ids) + 1, np.int32), [set() for _ in texts]
    for length, at, names in grams.find(ids):
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
        for i, own in zip((np.searchsorted(starts, at, "right") - 1).tolist(), names):
            items[i].update(own)
    return counts, starts, np.cumsum(change[:-1]) > 0, items


def collect_grams(benchmark: DataFrame, n: int) -> GramSet:
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").collect()
    return GramSet([(r.item_id, r.text) for r in rows], n)


def benchmark_fits(benchmark: DataFrame, max_bytes: int) -> bool:
    """Whether the benchmark's text is under the bound that allows a broadcast."""
    size = benchmark.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0]
    return (size or 0) <= max_bytes


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Per document: words, hit words, items whose windows occur in it, and whether any does."""
    if not benchmark_fits(benchmark, max_broadcast_bytes):
        return _contamination_by_join(docs, benchmark, n)
    held = docs.sparkSession.sparkContext.broadcast(collect_grams(benchmark, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, starts, mask, items = scan(texts_of(batch, "text"), held.value)
            total = np.concatenate([[0], np.cumsum(mask)])
            hit = total[starts[1:]] - total[starts[:-1]]
            clean = _digest(set())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                 pa.array([_digest(x) if x else clean for x in items]), pa.array(hit > 0)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _hits_by_join(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """Per uid of (uid, text) with hits: their spans and items; windows are joined on their text."""

    def grams_of(batches):
        for batch in slices(batches, "text"):
            rows = [(i, b" ".join(g).decode(), len(g)) for i, t in zip(batch.column("item_id").to_pylist(), texts_of(batch, "text")) for g in windows(words(t), n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["item_id", "gram", "length"])

    grams = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(grams_of, "item_id string, gram string, length int").distinct()
    lengths = [r.length for r in grams.select("length").distinct().collect()]  # n values at most

    def windows_of(batches):
        for batch in slices(batches, "text", 1 << 18):
            uids, at, size, text = [], [], [], []
            for u, t in zip(batch.column("uid").to_pylist(), texts_of(batch, "text")):
                w = words(t)
                for k in lengths:
                    for i in range(len(w) - k + 1):
                        uids.append(u), at.append(i), size.append(k), text.append(b" ".join(w[i : i + k]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(text, pa.string())], names=["uid", "at", "size", "gram"])

    found = docs.select("uid", "text").mapInArrow(windows_of, "uid long, at int, size int, gram string").join(grams, "gram")
    return found.groupBy("uid").agg(
        F.collect_set(F.struct("at", "size")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))


def _contamination_by_join(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """The same result for a benchmark too large to broadcast."""
    uid = F.monotonically_increasing_id()
    docs = save(docs.select(uid.alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "decontaminate")
    hits = _hits_by_join(docs.select("uid", "text"), benchmark, n)

    def counts_of(batches):
        for batch in slices(batches, "text"):
            out = []
            for doc, t, spans, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans", "items"))):
                covered = {i for s in spans or [] for i in range(s["at"], s["at"] + s["size"])}
                out.append((doc, len(words(t)), len(covered), len(items or []), _digest(set(items or [])), bool(covered)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.join(hits, "uid", "left").select("doc_id", "text", "spans", "items").mapInArrow(counts_of, SCHEMA)


def without_spans(text: str, hit: np.ndarray) -> str:
    """The text without its hit words: each run goes from its first word's start to its last word's end."""
    raw, kept, at = text.encode(), [], 0
    spans = [m.span() for m in WORD.finditer(raw.lower())]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        kept.append(raw[at : spans[first][0]])
        at = spans[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, action: str = "documents", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The documents, all columns kept, without the contaminated ones or (action "spans") without the hit words."""
    if action not in ("documents", "spans"):
        raise ValueError("action is 'documents' or 'spans'")
    if not benchmark_fits(benchmark, max_broadcast_bytes):
        return _decontaminate_by_join(docs, benchmark, n, action)
    held = docs.sparkSession.sparkContext.broadcast(collect_grams(benchmark, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = texts_of(batch, "text")
            counts, starts, mask, _ = scan(texts, held.value)
            own = [mask[s : s + c] for s, c in zip(starts.tolist(), counts)]
            if action == "documents":
                yield batch.filter(pa.array([not m.any() for m in own], pa.bool_()))
            else:
                cleaned = [without_spans(t, m) if m.any() else t for t, m in zip(texts, own)]
                k = batch.schema.get_field_index("text")
                yield batch.set_column(k, batch.schema.field(k), pa.array(cleaned, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def _decontaminate_by_join(docs: DataFrame, benchmark: DataFrame, n: int, action: str) -> DataFrame:
    """The same rows for a benchmark too large to broadcast, decided row by row."""
    uid, own = fresh(docs, "__uid"), fresh(docs, "__spans")
    rows = save(docs.withColumn(uid, F.monotonically_increasing_id()), "decontaminate")
    hits = _hits_by_join(rows.select(F.col(uid).alias("uid"), "text"), benchmark, n).select(F.col("uid").alias(uid), F.col("spans").alias(own))
    if action == "documents":
        return rows.join(hits, uid, "left_anti").select(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            cleaned = []
            for text, spans in zip(texts_of(batch, "text"), batch.column(own).to_pylist()):
                if spans:
                    mask = np.zeros(len(words(text)), bool)
                    for x in spans:
                        mask[x["at"] : x["at"] + x["size"]] = True
                    text = without_spans(text, mask)
                cleaned.append(text)
            batch = batch.drop_columns([uid, own])
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(cleaned, batch.schema.field(k).type))

    return rows.join(hits, uid, "left").select(*docs.columns, uid, own).mapInArrow(cut, docs.schema)
