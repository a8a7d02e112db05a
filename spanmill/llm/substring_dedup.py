"""Substring dedup: recurring passages of ``window`` words, found by repeated-phrase automata.

1. Documents are dealt once into blocks of bounded text; all steps read that one exchange. Every document's anchors are
   sampled: of any ``window`` consecutive words, the ``phrase``-word run with the smallest hash is one, so two equal
   passages hold equal anchors. Anchors that occur in two different texts are recurring phrases. Whole texts that recur
   word for word are noted by a 128-bit hash: of these only rows of the smallest doc_id take part in what follows, the
   others lose all their words.
2. Each block compiles its own shard of the phrases, those that recur and occur in it, into an Aho-Corasick automaton
   and streams its documents through it: every occurrence of a phrase is located, and windows whose smallest phrase is
   one of them are the only ones that can recur.
3. Those windows, one row per block with the smallest and largest doc_id, meet by two hashes (a polynomial one and the
   XXH3 of the window's bytes, 64 bits each); a window that starts in two documents recurs and belongs to the smaller.
4. Each block gets the recurring windows it holds in a later document and marks the words they cover.

Defined cases: a null text has no words; equal windows within one document, or in rows of the same doc_id, don't
count; a null doc_id neither removes nor loses words; equal rows are dealt by the partition they are read from; extra
columns are ignored or passed through, whatever their names.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import fresh, texts_of
from spanmill.llm.wordhash import range_hashes

BLOCK_BYTES = 4 << 20
_ROWS = "h1 long, h2 long, block int, low long, high long"
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Words:
    """The words of some texts, side by side, each text's number of words, and hashes of runs of words."""

    def __init__(self, texts: list[str | None]):
        found = [t.encode().split() if t else [] for t in texts]
        self.counts = np.array([len(w) for w in found], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.joined = b" " + b" \n ".join(b" ".join(w) for w in found if w) + b" "
        self.data = np.frombuffer(self.joined, np.uint8)
        gaps = np.flatnonzero(self.data == 32)
        starts, ends = gaps[:-1] + 1, gaps[1:]
        real = (self.data[np.minimum(starts, len(self.data) - 1)] != 10) & (ends > starts)  # no word holds a newline
        self.starts, self.ends = starts[real], ends[real]
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def runs(self, n: int) -> np.ndarray:
        """Which words start a run of n words of one text."""
        size = len(self.doc)
        out = np.zeros(size, bool)
        if size >= n:
            out[: size - n + 1] = self.doc[: size - n + 1] == self.doc[n - 1 :]
        return out

    def hashes(self, n: int, which: int = 0) -> np.ndarray:
        """Hash of the run of n words from each word; meaningless where runs(n) is false."""
        out = np.zeros(len(self.doc), np.uint64)
        if len(out) >= n:
            out[: len(out) - n + 1] = range_hashes(self.data, self.starts[: len(out) - n + 1], self.ends[n - 1 :], which)
        return out

    def run_text(self, at: int, n: int) -> str:
        """The run's words with a space on either side, a character for each byte."""
        return self.joined[self.starts[at] - 1 : self.ends[at + n - 1] + 1].decode("latin-1")


def spread(mask: np.ndarray, before: int, after: int) -> np.ndarray:
    """True within ``before`` places before and ``after`` places after a true one."""
    at = np.flatnonzero(mask)
    change = np.zeros(len(mask) + 1, np.int64)
    np.add.at(change, np.maximum(at - before, 0), 1)
    np.add.at(change, np.minimum(at + after + 1, len(mask)), -1)
    return np.cumsum(change[:-1]) > 0


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over values[i:i + width], for each i with a full width."""
    size, done = values, 1
    while done * 2 <= width:
        size = best(size[: len(size) - done], size[done:])
        done *= 2
    rest = width - done
    return best(size[: len(size) - rest], size[rest:]) if rest else size


def anchors(words: Words, hashes: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """The places of runs that have the smallest hash in some window."""
    span, whole = window - phrase + 1, words.runs(window)
    out = np.zeros(len(whole), bool)
    if not whole.any():
        return out
    held = np.maximum(hashes, np.uint64(1))
    least = sliding(held, span, np.minimum)
    least[~whole[: len(least)]] = 0
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(len(held) - len(least), np.uint64)])
    out[:] = sliding(padded, span, np.maximum)[: len(held)] == held
    return out & words.runs(phrase)


def _grouped(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, and smallest and largest ``of``, of each distinct column of key."""
    if not len(of):
        return np.zeros(0, np.int64), of, of
    order = np.lexsort((of, *key[::-1]))
    new = np.concatenate([[True], (key[:, order[1:]] != key[:, order[:-1]]).any(axis=0)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(order)]]) - 1
    return order[first], of[order[first]], of[order[last]]


def _rows(block: int, *parts: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """One row per distinct (h1, h2) of each part (hashes, what they are of)."""
    found = [(key[:, place], low, high) for key, of in parts for place, low, high in [_grouped(key, of)]]
    h, low, high = (np.concatenate(x, axis=-1) for x in zip(*found))
    return pa.table({"h1": h[0], "h2": h[1], "block": pa.array(np.full(len(low), block), pa.int32()), "low": low, "high": high})


def blocked(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a block number, and its column; blocks hold about BLOCK_BYTES of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    name = fresh(docs, "__block")
    return docs.withColumn(name, F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(size // BLOCK_BYTES + 1)).cast("int")), name


def _known(batch: pa.Table) -> tuple[list[str | None], np.ndarray]:
    """Texts, emptied where doc_id is null, and doc_ids."""
    ids = batch.column("doc_id").to_pylist()
    texts = [None if i is None else t for i, t in zip(ids, texts_of(batch, "text"))]
    return texts, np.array([0 if i is None else i for i in ids], np.int64)


def text_keys(words: Words, window: int) -> np.ndarray:
    """A 128-bit hash of each text's words in two rows, the second one odd; zeros where there is no whole window."""
    out = np.zeros((2, len(words.counts)), np.uint64)
    for i in np.flatnonzero(words.counts >= window).tolist():
        first, last = words.first[i], words.first[i] + words.counts[i] - 1
        out[:, i] = np.frombuffer(xxhash.xxh3_128_digest(words.joined[words.starts[first] : words.ends[last]]), np.uint64)
    out[1, out.any(axis=0)] |= np.uint64(1)
    return out.view(np.int64)


def copies(keys: np.ndarray, ids: np.ndarray, h1: np.ndarray, h2: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of each text: the doc_id of a smaller document with the same words, or its own."""
    near = np.isin(h1, keys[0])
    held = dict(zip(zip(h1[near].tolist(), h2[near].tolist()), owner[near].tolist()))
    return np.array([min(i, held.get(k, i)) if k[1] else i for k, i in zip(zip(*keys.tolist()), ids.tolist())], np.int64)


def window_bytes_hashes(words: Words, at: np.ndarray, window: int) -> np.ndarray:
    """XXH3 of the windows' bytes."""
    digest, joined = xxhash.xxh3_64_intdigest, words.joined
    return np.array([digest(joined[s:e]) for s, e in zip(words.starts[at].tolist(), words.ends[at + window - 1].tolist())], np.uint64).view(np.int64)


def _anchor_rows(name: str, window: int, phrase: int):
    """Per block: the anchors, with the smallest and largest key of a text that holds them, and the whole texts, with doc_ids."""

    def run(docs: pa.Table) -> pa.Table:
        texts, ids = _known(docs)
        words = Words(texts)
        hashes, keys = words.hashes(phrase), text_keys(words, window)
        at = np.flatnonzero(anchors(words, hashes, window, phrase))
        whole = np.flatnonzero(keys[1])
        return _rows(docs[name][0].as_py(), (np.stack([hashes[at].view(np.int64), np.zeros(len(at), np.int64)]), keys[0, words.doc[at]]), (keys[:, whole], ids[whole]))

    return run


def _window_rows(name: str, window: int, phrase: int):
    """Per block: the windows around occurrences of recurring phrases, and the copies of whole texts, with their doc_ids."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
        if not left.num_rows or not right.num_rows:
            return _rows(0, none)
        texts, ids = _known(left)
        words = Words(texts)
        h1, h2, low = (right[c].to_numpy() for c in ("h1", "h2", "low"))
        keys = text_keys(words, window)
        owner = copies(keys, ids, h1[h2 != 0], h2[h2 != 0], low[h2 != 0])
        copy = np.flatnonzero(owner < ids)
        block, whole = left[name][0].as_py(), (np.repeat(keys[:, copy], 2, axis=1), np.stack([owner[copy], ids[copy]], axis=1).ravel())
        hashes, own = words.hashes(phrase), (owner == ids)[words.doc]
        shard = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for i in np.flatnonzero(anchors(words, hashes, window, phrase) & own & np.isin(hashes, h1[h2 == 0].view(np.uint64))).tolist():
            shard.add_word(words.run_text(i, phrase))
        if not len(shard):
            return _rows(block, whole)
        shard.make_automaton()
        found = np.array([end - size + 2 for end, size in shard.iter(words.joined.decode("latin-1"))], np.int64)
        held = np.maximum(hashes, np.uint64(1))
        least = np.zeros(len(held), np.uint64)
        smallest = sliding(held, window - phrase + 1, np.minimum)
        least[: len(smallest)] = smallest
        at = np.flatnonzero(words.runs(window) & own & np.isin(least, held[np.searchsorted(words.starts, found)]))
        key = np.stack([words.hashes(window)[at].view(np.int64), window_bytes_hashes(words, at, window)])
        return _rows(block, (key, ids[words.doc[at]]), whole)

    return run


def removed_words(texts: list[str | None], ids: np.ndarray, h1: np.ndarray, h2: np.ndarray, owner: np.ndarray, window: int) -> tuple[Words, np.ndarray]:
    """The words of texts and which of them recurring windows of smaller documents cover."""
    words = Words(texts)
    hit = np.zeros(len(words.doc), bool)
    if not len(h1):
        return words, hit
    order = np.lexsort((h2, h1))
    h1, h2, owner = h1[order], h2[order], owner[order]
    first = words.hashes(window).view(np.int64)
    near = np.flatnonzero(words.runs(window) & np.isin(first, h1))
    second = window_bytes_hashes(words, near, window)
    low, high = np.searchsorted(h1, first[near]), np.searchsorted(h1, first[near], "right")
    for step in range(int((high - low).max()) if len(near) else 0):
        at = np.minimum(low + step, len(h1) - 1)
        hit[near[(low + step < high) & (h2[at] == second) & (owner[at] < ids[words.doc[near]])]] = True
    gone = spread(hit, 0, window - 1) if hit.any() else hit
    copy = copies(text_keys(words, window), ids, h1, h2, owner) < ids
    return words, gone | copy[words.doc]


def _recurring(docs: DataFrame, name: str, window: int, phrase: int) -> DataFrame:
    """Per block: the windows (and whole texts) that a document of it shares with a smaller one, and that one's doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", name)
    same = Window.partitionBy("h1", "h2")  # a row per block at most; a window function reads one exchange and spills

    def met(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"owner": F.min("low").over(same), "last": F.max("high").over(same)}).where("owner < last")
        return rows.select(F.col("block").alias(name), "h1", "h2", "owner", "high")

    shards = met(texts.groupBy(name).applyInArrow(_anchor_rows(name, window, phrase), _ROWS)).select(name, "h1", "h2", F.col("owner").alias("low"))
    found = texts.groupBy(name).cogroup(shards.groupBy(name)).applyInArrow(_window_rows(name, window, phrase), _ROWS)
    return met(found).where("owner < high").drop("high")


def repeated_words(docs: DataFrame, window: int = 50, phrase: int = 10) -> DataFrame:
    """Per document: doc_id, words, removed words, and the SHA-256 of the kept words joined by one space."""
    docs, name = blocked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["doc_id"].to_pylist()
        texts = texts_of(left, "text")
        words, gone = removed_words(texts, np.array([-(1 << 63) if i is None else i for i in ids], np.int64), *(right[c].to_numpy() for c in ("h1", "h2", "owner")), window)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[words.first + words.counts] - total[words.first]
        digests = []
        for text, first, cut in zip(texts, words.first.tolist(), removed.tolist()):
            kept = text.encode().split() if text else []
            if cut:
                kept = [w for w, g in zip(kept, gone[first : first + len(kept)].tolist()) if not g]
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": words.counts, "n_removed": removed, "kept_sha256": pa.array(digests, pa.string())})

    return docs.groupBy(name).cogroup(_recurring(docs, name, window, phrase).groupBy(name)).applyInArrow(run, SCHEMA)


def remove_repeats(docs: DataFrame, window: int = 50, phrase: int = 10) -> DataFrame:
    """The documents, all columns kept; a text that loses words becomes its kept words joined by one space."""
    columns = docs.columns
    docs, name = blocked(docs)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = texts_of(left, "text")
        ids = np.array([-(1 << 63) if i is None else i for i in left["doc_id"].to_pylist()], np.int64)
        words, gone = removed_words(texts, ids, *(right[c].to_numpy() for c in ("h1", "h2", "owner")), window)
        for i, (first, n) in enumerate(zip(words.first.tolist(), words.counts.tolist())):
            if gone[first : first + n].any():
                texts[i] = b" ".join(w for w, g in zip(texts[i].encode().split(), gone[first : first + n].tolist()) if not g).decode()
        k = left.schema.get_field_index("text")
        return left.set_column(k, left.schema.field(k), pa.array(texts, left.schema.field(k).type)).select(columns)

    return docs.groupBy(name).cogroup(_recurring(docs, name, window, phrase).groupBy(name)).applyInArrow(run, docs.select(*columns).schema)
