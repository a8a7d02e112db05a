"""SentencePiece encoding and decoding: N-best segmentation over the piece lattice.

The vocabulary's own scores are merge ranks, whose sums mean nothing, so a unigram model is fitted first: every piece's
count in the library's encoding of the whole corpus (each distinct chunk encoded once), plus a half, as log-probability
(``piece_scores``). A segmentation's score is the sum of its pieces'; a character that is no piece is written as its
bytes, at the lowest score less 10. Scores are multiples of 1/1024, so sums are exact and ties are ties.

For each chunk that no piece crosses (see ``pieces``) a forward Viterbi pass gives the best score of every prefix; these
are exact heuristics for an A* search that runs backward from the chunk's end and pops segmentations in order. Ties go
to the segmentation whose ids, read from the end, come first. The same order holds for whole documents: only the n-1
cheapest first deviations can occur in its n best, and an A* over those chunks, again from the end, merges their lists.

The best segmentation is returned in full; each further one as its edits of the best: replace ``length`` ids from
``start`` by ``ids``.

Defined cases: a null or empty text has no ids, score 0 and no alternatives; U+2581 in a text is a space to the model
and decodes as one (round_trip is false then); without any text all pieces score alike; repeated rows each give a row;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import list_array, slices, texts_of
from spanmill.llm.pieces import SPACE, Vocabulary, vocabulary

ALTERNATIVES = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
SCHEMA = ("doc_id long, n_ids long, ids array<int>, score double, "
          "alternatives array<struct<score:double,edits:array<struct<start:int,length:int,ids:array<int>>>>>, round_trip boolean")  # fmt: skip


class Path:
    """A segmentation of a chunk's end, by its first edge and the path after it; of two, the one whose ids, read from the end, come first is less."""

    __slots__ = ("own", "rest", "depth", "jump")

    def __init__(self, own: tuple[int, ...] = (), rest: Path | None = None):
        self.own, self.rest = own, rest
        self.depth = rest.depth + 1 if rest else 0
        self.jump = (rest.jump.jump if rest.depth - rest.jump.depth == rest.jump.depth - rest.jump.jump.depth else rest) if rest else self  # skips in powers, so paths meet in few steps

    def at(self, depth: int) -> Path:
        walk = self
        while walk.depth > depth:
            walk = walk.jump if walk.jump.depth >= depth else walk.rest
        return walk

    def __lt__(self, other: Path) -> bool:
        a, b = self.at(other.depth), other.at(self.depth)
        if a is b:
            return self.depth < other.depth
        while a.rest is not b.rest:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.rest, b.rest)
        return a.own < b.own

    def ids(self) -> tuple[int, ...]:
        """The ids, read from the end."""
        parts, walk = [], self
        while walk.rest:
            parts.append(walk.own)
            walk = walk.rest
        return tuple(i for own in reversed(parts) for i in own)


class Lattice:
    """The pieces of a vocabulary as an automaton that lists a chunk's edges in order of their ends."""

    def __init__(self, vocab: Vocabulary, scores: np.ndarray):
        self.vocab, self.singles = vocab, {p for p in vocab.ids if len(p) == 1}
        self.pieces = ahocorasick.Automaton()
        for piece, i in vocab.ids.items():
            self.pieces.add_word(piece, (len(piece), float(scores[i]), (i,)))
        self.pieces.make_automaton()
        self.unknown = min((float(scores[i]) for i in vocab.ids.values()), default=0.0) - 10.0

    def edges(self, chunk: str) -> list[tuple[int, tuple[int, float, tuple[int, ...]]]]:
        """(last character, (characters, score, reversed ids)) of every edge, by last character."""
        found = list(self.pieces.iter(chunk))
        if not self.singles.issuperset(chunk):
            spell = self.vocab.bytes
            found += [(i, (1, self.unknown, tuple(spell[b] for b in reversed(c.encode())))) for i, c in enumerate(chunk) if c not in self.singles]
            found.sort(key=lambda e: e[0])
        return found

    def nbest(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, reversed ids) of one chunk, in order."""
        size = len(chunk)
        forward = [0.0] + [-inf] * size
        ending: list[list] = [[] for _ in range(size + 1)]
        for last, (length, score, own) in self.edges(chunk):
            start = last + 1 - length
            best = forward[start] + score
            if best > forward[last + 1]:
                forward[last + 1] = best
            ending[last + 1].append((start, score, best, own))
        out, heap, push = [], [(-forward[size], Path(), size, 0.0)], heapq.heappush
        while heap:
            cost, path, at, behind = heapq.heappop(heap)
            if at == 0:
                out.append((-cost, path.ids()))
                if len(out) == n:
                    break
                continue
            for start, score, best, own in ending[at]:
                push(heap, (-best - behind, Path(own, path), start, score + behind))
        return out

    def viterbi(self, chunk: str) -> tuple[float, float, list[int]]:
        """Best and second-best score of one chunk and its best ids; the A* decides only where best scores tie."""
        size = len(chunk)
        first, second, back, tie = [0.0] + [-inf] * size, [-inf] * (size + 1), [None] * (size + 1), False
        for last, edge in self.pieces.iter(chunk) if self.singles.issuperset(chunk) else self.edges(chunk):
            end = last + 1
            length, score, _ = edge
            start = end - length
            best, held = first[start] + score, first[end]
            if best > held:
                more = second[start] + score
                second[end] = more if more > held else held
                first[end], back[end] = best, edge
            else:
                if best == held:
                    tie = True
                if best > second[end]:
                    second[end] = best
        if tie:
            return first[size], second[size], list(self.nbest(chunk, 1)[0][1][::-1])
        ids, at = [], size
        while at:
            length, _, own = back[at]
            ids += own
            at -= length
        return first[size], second[size], ids[::-1]


class Trellis:
    """The forward pass of many chunks at once, by position: best and second-best scores and best ids, as ``Lattice.viterbi``."""

    LONGEST, CELLS = 40, 32_768

    def __init__(self, lattice: Lattice):
        self.lattice, pieces = lattice, lattice.pieces
        letters = sorted({c for piece in pieces.keys() for c in piece})
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        row, edges, ends = {c: k for k, c in enumerate(letters)}, {}, {}
        for piece, (_, score, ids) in pieces.items():
            node = 0
            for c in piece:
                node = edges.setdefault(node * len(letters) + row[c], len(edges) + 1)
            ends[node] = (score, ids[0])
        self.width = len(letters)
        self.keys = np.array(sorted(edges), np.int64)  # node and letter, and the node they lead to
        self.target = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.score, self.id = np.full(len(edges) + 1, -inf), np.full(len(edges) + 1, -1, np.int32)
        for node, (score, i) in ends.items():
            self.score[node], self.id[node] = score, i
        self.inner = np.zeros(len(edges) + 1, bool)
        self.inner[self.keys // max(self.width, 1)] = True

    def fits(self, chunk: str) -> bool:
        return len(chunk) <= self.LONGEST and self.lattice.singles.issuperset(chunk)

    def solve(self, chunks: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of fitting chunks: the chunks, best and second scores, whether a tie came up, and best ids with their counts."""
        chunks = sorted(chunks, key=len)
        while chunks:
            most = max(self.CELLS // len(chunks[-1]), 1)
            yield self._group(chunks[-most:])
            del chunks[-most:]

    def _edges(self, codes: np.ndarray, size: np.ndarray) -> tuple[dict, dict]:
        """By number of characters, and from every position of every chunk: the piece's score (-inf: none) and its id."""
        scores, ids = {}, {}
        at, of = np.nonzero(np.arange(len(codes))[:, None] < size)
        node, length = np.zeros(len(at), np.int64), 0
        while len(at):
            key = node * self.width + codes[at + length, of]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[place] == key
            at, of, node, length = at[known], of[known], self.target[place[known]], length + 1
            if (self.id[node] >= 0).any():
                scores[length], ids[length] = np.full(codes.shape, -inf), np.full(codes.shape, -1, np.int32)
                scores[length][at, of], ids[length][at, of] = self.score[node], self.id[node]
            more = self.inner[node] & (at + length < size[of])
            at, of, node = at[more], of[more], node[more]
        return scores, ids

    def _group(self, chunks: list[str]):
        size, every = np.fromiter(map(len, chunks), np.int64, len(chunks)), np.arange(len(chunks))
        longest = int(size.max())
        codes = np.full((longest, len(chunks)), -1, np.int32)
        codes.T[np.arange(longest) < size[:, None]] = self.letter[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        scores, ids = self._edges(codes, size)
        first, second = np.full((2, longest + 1, len(chunks)), -inf)
        first[0] = 0.0
        back, tie = np.zeros((longest + 1, len(chunks)), np.int64), np.zeros(len(chunks), bool)
        for end in range(1, longest + 1):
            for length, score in scores.items():
                if length > end:
                    break
                best = first[end - length] + score[end - length]
                better = best > first[end]
                tie |= (best == first[end]) & (best > -inf)
                second[end] = np.where(better, np.maximum(second[end - length] + score[end - length], first[end]), np.maximum(second[end], best))
                first[end] = np.maximum(first[end], best)
                back[end][better] = length
        path, at = np.full((longest, len(chunks)), -1, np.int32), size.copy()
        for step in range(longest):
            going = np.flatnonzero(at)
            if not len(going):
                break
            length = back[at[going], going]
            at[going] -= length
            for n in np.unique(length).tolist():
                own = going[length == n]
                path[longest - 1 - step, own] = ids[n][at[own], own]
        used = path.T >= 0
        return chunks, first[size, every], second[size, every], tie, path.T[used], used.sum(axis=1)


class Segmenter:
    """Chunks' best segmentations, held up to a bound, and documents' n best from them."""

    def __init__(self, vocab: Vocabulary, scores: np.ndarray, held: int = 200_000):
        self.vocab, self.lattice, self.held = vocab, Lattice(vocab, scores), held
        self.trellis = Trellis(self.lattice)
        self.bytes = np.fromiter(map(len, vocab.raw), np.int64, len(vocab.raw))
        self.reset()

    def reset(self) -> None:
        self.kinds: dict[str, int] = {}  # chunk to its row in the tables below
        self.chunk, self.flat, self.lists = [], array("i"), {}
        self.score, self.delta, self.start, self.size = array("d"), array("d"), array("q"), array("q")
        self.lossy: set[int] = set()  # rows whose ids don't decode to their chunk

    def learn(self, chunks: list[str]) -> None:
        """Add chunks that are not yet held: most by the trellis, others and those whose best scores tie one by one."""
        fit, alone = [], []
        for chunk in chunks:
            (fit if self.trellis.fits(chunk) else alone).append(chunk)
        for some, best, second, tie, ids, sizes in self.trellis.solve(fit):
            sure = ~tie
            self._append(list(compress(some, sure.tolist())), best[sure], second[sure], ids[np.repeat(sure, sizes)], sizes[sure])
            alone += compress(some, tie.tolist())
        for chunk in alone:
            best, second, ids = self.lattice.viterbi(chunk)
            self._append([chunk], np.array([best]), np.array([second]), np.array(ids, np.int32), np.array([len(ids)], np.int64))

    def _append(self, chunks: list[str], best: np.ndarray, second: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        raw, ends = b"".join(map(self.vocab.raw.__getitem__, ids.tolist())), np.cumsum(self.bytes[ids])[np.cumsum(sizes) - 1]
        if raw != "".join(chunks).encode() or (ends != np.cumsum(pc.binary_length(pa.array(chunks, pa.string())))).any():
            starts = [0, *ends.tolist()]
            self.lossy.update(len(self.chunk) + k for k, chunk in enumerate(chunks) if raw[starts[k] : starts[k + 1]] != chunk.encode())
        self.kinds.update(zip(chunks, range(len(self.chunk), len(self.chunk) + len(chunks))))
        self.start.frombytes((len(self.flat) + np.cumsum(sizes) - sizes).tobytes())
        self.chunk += chunks
        self.flat.frombytes(ids.tobytes())
        self.size.frombytes(sizes.tobytes())
        self.score.frombytes(best.tobytes())
        self.delta.frombytes((best - second).tobytes())

    def list_of(self, k: int, n: int) -> list[tuple[float, tuple[int, ...]]]:
        if (k, n) not in self.lists:
            best = self.lattice.nbest(self.chunk[k], n)
            self.lists[k, n] = [(best[0][0] - score, ids) for score, ids in best]
        return self.lists[k, n]

    def segment(self, text: str, n: int) -> tuple[np.ndarray, float, list[dict]]:
        """Best ids, their score, and the further n-1 segmentations as edits."""
        return next(self.segments([text], n))

    def segments(self, texts: list[str], n: int) -> Iterator[tuple[np.ndarray, float, list[dict]]]:
        """Those of each text; their new chunks are learnt together."""
        return (found[:3] for found in self.checked(texts, n))

    def checked(self, texts: list[str], n: int) -> Iterator[tuple[np.ndarray, float, list[dict], bool]]:
        """Those of each text, and whether the best ids decode to it: they do if they decode to its chunks, which is known of each."""
        if len(self.chunk) > self.held:
            self.reset()
        cut = [self.vocab.chunks(text) for text in texts]
        self.learn(list(set().union(*cut).difference(self.kinds)))
        for text, chunks in zip(texts, cut):
            at = list(map(self.kinds.__getitem__, chunks))
            found = self._segment(np.array(at, np.int64), n)
            sure = SPACE not in text and sum(map(len, chunks)) == len(text) + 1 and (not self.lossy or self.lossy.isdisjoint(at))
            yield *found, sure or self.vocab.decode(found[0].tolist()) == text

    def _segment(self, at: np.ndarray, n: int) -> tuple[np.ndarray, float, list[dict]]:
        if not len(at):
            return np.zeros(0, np.int32), 0.0, []
        sizes = np.frombuffer(self.size, np.int64)[at]
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(self.flat, np.int32)[np.repeat(np.frombuffer(self.start, np.int64)[at] - starts, sizes) + np.arange(sizes.sum())]
        score = float(np.frombuffer(self.score)[at].sum())
        if n < 2:
            return ids, score, []
        delta = np.frombuffer(self.delta)[at]
        most = np.partition(delta, n - 2)[n - 2] if len(delta) >= n else inf
        near = np.flatnonzero((delta <= most) & np.isfinite(delta)).tolist()
        # of equal cost, a deviation that comes before the best is better nearer the end, another nearer the start
        lists = {p: self.list_of(int(at[p]), n) for p in near}
        near.sort(key=lambda p: (delta[p], 0, -p) if lists[p][1][1] < lists[p][0][1] else (delta[p], 1, p))
        places = sorted(near[: n - 1], reverse=True)
        heap, found = [(0.0, (), ())], []
        while heap and len(found) < n:
            cost, order, taken = heapq.heappop(heap)
            if len(taken) == len(places):
                found.append((cost, taken))
                continue
            for rank, (more, own) in enumerate(lists[places[len(taken)]]):
                heapq.heappush(heap, (cost + more, order + (own,), taken + (rank,)))
        alternatives = []
        for cost, taken in found[1:]:
            edits = [{"start": int(starts[p]), "length": int(sizes[p]), "ids": lists[p][r][1][::-1]} for p, r in zip(reversed(places), reversed(taken)) if r]
            alternatives.append({"score": score - cost, "edits": edits})
        return ids, score, alternatives


def apply_edits(ids: list[int], edits: list) -> list[int]:
    """A further segmentation in full."""
    out, at = [], 0
    for e in edits:
        out += [*ids[at : e["start"]], *e["ids"]]
        at = e["start"] + e["length"]
    return out + list(ids[at:])


@lru_cache(maxsize=1)
def segmenter(path: str, scores: bytes) -> Segmenter:
    """A segmenter of the model at path with scores as doubles by id."""
    return Segmenter(vocabulary(path), np.frombuffer(scores))


def log_probabilities(vocab: Vocabulary, counts: dict[int, int]) -> np.ndarray:
    """By id: the log of (count + 1/2) over their sum, to the next 1/1024; pieces alone have one."""
    seen = np.zeros(len(vocab.raw))
    own = np.array(sorted(vocab.ids.values()), np.int64)
    seen[own] = [counts.get(i, 0) + 0.5 for i in own.tolist()]
    out = np.zeros(len(seen))
    out[own] = np.round(np.log(seen[own] / seen[own].sum()) * 1024) / 1024
    return out


def piece_scores(docs: DataFrame, model_path: str, held: int = 200_000) -> np.ndarray:
    """The unigram model of all texts of docs: a row per piece reaches the driver.

    Tasks count words, at most ``held`` distinct ones at a time, and cut those into chunks, as no chunk goes on past a
    space; texts with other than single spaces between words are cut whole. Each distinct chunk is then encoded once by
    the library.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, words, seen = vocabulary(model_path), [], Counter()  # tables of words and counts, and chunks

        def merged() -> pa.Table:
            return pa.concat_tables(words).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def rows() -> Iterator[pa.RecordBatch]:
            if words:
                word, n = (c.combine_chunks() for c in merged().columns)
                whole = pc.match_substring_regex(word, "^[A-Za-z]+$")  # one chunk under any pattern that cuts words
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(SPACE, word.filter(whole), ""), n.filter(whole)], names=["chunk", "n"])
                rest = pc.invert(whole)
                for text, k in zip(word.filter(rest).to_pylist(), n.filter(rest).to_pylist()):
                    for chunk in vocab.chunks(text):
                        seen[chunk] += k
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["chunk", "n"])
            words.clear()
            seen.clear()

        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column("text").drop_null()
            odd = pc.match_substring_regex(texts, "  |^ | $|▁") if vocab.words_cut else pa.array([True] * len(texts), pa.bool_())
            for text in texts.filter(odd).to_pylist():
                seen.update(vocab.chunks(text))
            plain = pc.value_counts(pc.list_flatten(pc.split_pattern(texts.filter(pc.invert(odd)), " ")))
            words.append(pa.table([plain.field("values"), plain.field("counts")], names=["word", "n"]))
            if sum(map(len, words)) + len(seen) > 2 * held:
                words[:] = [merged()]
                if len(words[0]) + len(seen) > held:
                    yield from rows()
        yield from rows()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = vocabulary(model_path).encode_chunk, Counter()
        for batch in slices(batches, "chunk"):
            for chunk, n in zip(batch.column("chunk").to_pylist(), batch.column("n").to_pylist()):
                for i in encode(chunk):
                    seen[i] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["id", "n"])

    distinct = docs.select("text").mapInArrow(chunks, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counts = distinct.mapInArrow(pieces, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return log_probabilities(vocabulary(model_path), {r.id: r.n for r in counts})


def encode_nbest(docs: DataFrame, model_path: str, n: int = 4, scores: np.ndarray | None = None) -> DataFrame:
    """Per document: the best segmentation's ids and score, n-1 alternatives, and whether decoding gives the text.

    scores: by piece id, multiples of 1/1024; those of docs' own unigram model unless given.
    """
    scores = piece_scores(docs, model_path) if scores is None else scores
    model = docs.sparkSession.sparkContext.broadcast(np.asarray(scores, np.float64).tobytes())  # 8 bytes a piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(model_path, model.value)
        for batch in slices(batches, "text", 2 << 20):
            done, same, flat = [], [], []
            texts = [text or "" for text in texts_of(batch, "text")]
            for ids, score, more, decodes in own.checked(texts, n):
                same.append(decodes)
                flat.append(ids)
                done.append((len(ids), score, more))
            sizes = [d[0] for d in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), list_array(np.concatenate(flat), sizes, pa.int32()), pa.array([d[1] for d in done], pa.float64()),
                 pa.array([d[2] for d in done], ALTERNATIVES), pa.array(same, pa.bool_())],
                names=["doc_id", "n_ids", "ids", "score", "alternatives", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """Per row: doc_id and the text of its ids (null ids: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary(model_path).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
