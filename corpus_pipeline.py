"""The corpus pipeline: stages over documents, each written and read again by the next.

Defined cases, alike in all stages: an empty table stays empty; extra columns are passed through by all but the last;
rows that repeat a doc_id or have none are decided one by one. Stage by stage, a null or empty text: has weight 0 and no
toxicity in the first; is a copy of all other texts without words in the second; stays as it is in the third; is clean
in the fourth; has no ids in the last. Ties: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanmill.llm.common import save
from spanmill.llm.decontaminate import decontaminate
from spanmill.llm.nbest import encode_nbest
from spanmill.llm.near_copies import drop_near_copies
from spanmill.llm.quality import keep_good
from spanmill.llm.queries import PIECES
from spanmill.llm.substring_dedup import remove_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against the good labelled ones selects, toxic ones rejected.

    Without good labels all stay; ties at the last place go to smaller doc_ids, null first, and equal rows share their fate.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8 or more), one document.

    That with the smallest doc_id stays, null last; of rows that repeat it, one.
    """
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words that a smaller document's 50-word window covers.

    Rows of one doc_id take no words from each other; those without a doc_id neither take nor lose words.
    """
    return remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold 10 consecutive words of a benchmark item (all of a shorter item).

    Null items and items without words contaminate nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' 4 best segmentations by a unigram model of their own pieces; equal scores in order of ids from the end."""
    return encode_nbest(docs, PIECES, n=4)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", sentencepiece),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what lies between them is written to the shared scratch folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"pipeline-{k}")
    return docs
