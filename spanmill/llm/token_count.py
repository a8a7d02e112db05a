"""Exact token counts with a whole-token shortcut.

``prove_whole_tokens`` runs the library once over its own vocabulary and keeps the strings that encode alone as one
token. Texts are cut into pre-tokens where no piece can cross (see ``pieces``); a pre-token among the proven strings
counts one without any merge, and only the rest is merged by the library, each distinct one once per worker.

Defined cases: a null or empty text has zero tokens and bytes; special strings in texts are ordinary text, as in the
library; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import slices, texts_of
from spanmill.llm.pieces import Vocabulary, vocabulary

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def prove_whole_tokens(vocab: Vocabulary) -> dict[str, int]:
    """The vocabulary's strings that encode alone as exactly one token."""
    return {piece: 1 for piece, i in vocab.ids.items() if vocab.encode_chunk(piece) == [i]}


class PreTokenCounts(dict):
    """Tokens by pre-token: the proven strings for good, others merged once and held up to a bound."""

    def __init__(self, vocab: Vocabulary, held: int = 400_000):
        self.vocab, self.proven, self.held = vocab, prove_whole_tokens(vocab), held
        super().__init__(self.proven)

    def __missing__(self, chunk: str) -> int:
        n = len(self.vocab.encode_chunk(chunk))
        if len(chunk) <= 64:
            if len(self) - len(self.proven) >= self.held:
                self.clear()
                self.update(self.proven)
            self[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.vocab.chunks(text))) if text else 0


@lru_cache(maxsize=4)
def counter(path: str) -> PreTokenCounts:
    return PreTokenCounts(vocabulary(path))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Per document: UTF-8 bytes, tokens of the whole text, and whether they exceed ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in slices(batches, "text"):
            n = list(map(own.count, texts_of(batch, "text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", size).mapInArrow(run, SCHEMA)
