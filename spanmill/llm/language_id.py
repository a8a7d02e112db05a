"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter serves all languages: each slot holds a bit per language, and the AND of an n-gram's slots is the set of
languages that contain it. A text's n-grams are counted per language, the counts are corrected by each language's
false-positive rate, and the largest decides.

Learning takes a bounded sample of labelled texts (``docs_per_language``, chosen by a hash of the row; a parameter of
the fit). An n-gram belongs to a language if it occurs often enough and not much more often elsewhere.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; letters but no known n-gram give the
most frequent learned language with score 0; ties go to the alphabetically first language; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import slices, texts_of
from spanmill.llm.wordhash import mix

ORDERS = (2, 3, 4)
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' n-grams, the text of each, and which texts hold a letter.

    Letters are lower-cased, anything else is a space; an n-gram holds a letter and has no space inside it.
    """
    points = [np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points])
    code = np.concatenate(points) if points else np.zeros(0, np.uint32)
    letter = _letters()[code]
    owner = np.repeat(np.arange(len(texts)), sizes)
    code = np.where(letter, code, 32).astype(np.uint64)
    hashes, owners = [], []
    for n in ORDERS:
        size = len(code) - n + 1
        if size <= 0:
            continue
        ok = letter[:size] | letter[n - 1 :] if n == 2 else np.ones(size, bool)
        for j in range(1, n - 1):
            ok &= letter[j : size + j]
        at = np.flatnonzero(ok & (owner[:size] == owner[n - 1 :]))
        value = np.full(len(at), n, np.uint64)
        for j in range(n):
            value = value * np.uint64(0x110001) + code[at + j]
        hashes.append(mix(value))
        owners.append(owner[at])
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    return np.concatenate(hashes), np.concatenate(owners), has


@dataclass
class BitSlicedBloom:
    """Slots of 64 language bits, as many words as the languages need."""

    languages: list[str]
    default: str
    bits: int = 20
    hashes: int = 3
    words: list[np.ndarray] = field(default_factory=list)
    rates: np.ndarray | None = None

    def __post_init__(self):
        self.words = [np.zeros(1 << self.bits, np.uint64) for _ in range((len(self.languages) + 63) // 64)]

    def slots(self, values: np.ndarray) -> list[np.ndarray]:
        step = (values >> np.uint64(32)) | np.uint64(1)
        return [((values + np.uint64(k) * step) & np.uint64((1 << self.bits) - 1)).astype(np.int64) for k in range(self.hashes)]

    def add(self, language: int, values: np.ndarray) -> None:
        for at in self.slots(values):
            np.bitwise_or.at(self.words[language // 64], at, np.uint64(1 << (language % 64)))

    def seal(self) -> None:
        """Work out each language's false-positive rate from the share of slots that hold its bit."""
        fill = [np.count_nonzero(self.words[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / (1 << self.bits) for k in range(len(self.languages))]
        self.rates = np.array(fill) ** self.hashes

    def counts(self, values: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text: n-grams, and per language those whose slots all hold its bit."""
        total = np.bincount(owner, minlength=texts)
        out = np.zeros((texts, len(self.languages)))
        places = self.slots(values)
        for w, word in enumerate(self.words):
            held = word[places[0]]
            for at in places[1:]:
                held &= word[at]
            for k in range(w * 64, min(len(self.languages), w * 64 + 64)):
                out[:, k] = np.bincount(owner[(held >> np.uint64(k % 64) & np.uint64(1)).astype(bool)], minlength=texts)
        return total, out

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        values, owner, has = grams(texts)
        total, found = self.counts(values, owner, len(texts))
        corrected = np.maximum(0, (found - total[:, None] * self.rates) / np.maximum(1e-9, 1 - self.rates))
        best, mass = corrected.argmax(axis=1), corrected.sum(axis=1)
        score = np.where(has & (mass > 0), corrected.max(axis=1) / np.maximum(mass, 1e-300), 0.0)
        names = [("und" if not h else self.default if m <= 0 else self.languages[b]) for h, m, b in zip(has, mass, best)]
        return names, score


def held_out() -> Column:
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, docs_per_language: int = 3000, grams_per_language: int = 60_000, least: int = 4, share: float = 0.15) -> BitSlicedBloom | None:
    """Filters from rows of text and lang; None if no row has a text and a language.

    docs_per_language bounds the sample, grams_per_language the model; an n-gram is in a language that holds it
    ``least`` times or more, at ``share`` of its rate in any other language or more.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    part = labelled.sparkSession.createDataFrame([(k, min(1.0, docs_per_language / n)) for k, n in sizes.items()], "lang string, part double")
    lot = F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_000)) / 1_000_000
    sample = rows.join(F.broadcast(part), "lang").where(lot < F.col("part")).select("text", "lang")  # a row per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                values, count = np.unique(grams([t for t, k in zip(texts_of(batch, "text"), langs) if k == lang])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(count)], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total")).withColumn("most", F.max("rate").over(Window.partitionBy("gram")))
    kept = rated.where((F.col("n") >= least) & (F.col("rate") >= share * F.col("most")))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # cut off in every task before rows meet
    chosen = kept.withColumn("order", order).where(F.col("order") <= grams_per_language).select("lang", "gram").toPandas()
    languages = sorted(sizes)
    model = BitSlicedBloom(languages, min(sizes, key=lambda k: (-sizes[k], k)))
    for k, lang in enumerate(languages):
        model.add(k, chosen.gram[chosen.lang == lang].to_numpy(np.int64).view(np.uint64))
    model.seal()
    return model


def identify(docs: DataFrame, model: BitSlicedBloom | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score of the whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts = texts_of(batch, "text")
            names, score = held.value.decide(texts) if held.value else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)
