"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanmill.llm import language_id
from spanmill.llm.chat_format import format_conversations
from spanmill.llm.decontaminate import contamination
from spanmill.llm.html_extract import extract_pages
from spanmill.llm.nbest import encode_nbest
from spanmill.llm.quality import resample
from spanmill.llm.simhash_dedup import near_duplicates
from spanmill.llm.substring_dedup import repeated_words
from spanmill.llm.token_count import count_tokens
from spanmill.llm.topk_search import top_k

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_nbest(_table(spark, sf_dir, "documents"), PIECES, n=4)


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(_table(spark, sf_dir, "conversations"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs.where(~language_id.held_out()).select("text", "lang")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op7_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), PIECES)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sentencepiece_nbest": op2_sentencepiece_nbest,
    "op3_preference_formatting": op3_preference_formatting,
    "op4_language_id": op4_language_id,
    "op5_html_extraction": op5_html_extraction,
    "op6_topk_search": op6_topk_search,
    "op7_quality_resampling": op7_quality_resampling,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_token_counts": op10_token_counts,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op1_decontamination": rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, w[p:p + least(len(w), 10) - 1] AS gram FROM i, unnest(range(1, greatest(len(w) - 8, 2))) AS u(p) WHERE len(w) > 0),
k AS (SELECT DISTINCT len(gram) AS size FROM g),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS w FROM documents),
x AS (SELECT rid, p, size, w[p:p + size - 1] AS gram FROM d, k, unnest(range(1, len(w) - size + 2)) AS u(p)),
h AS (SELECT rid, p, size, item_id FROM x JOIN g USING (gram)),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM h) GROUP BY rid),
m AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT rid, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS u(p)),
m AS (SELECT h, min(doc_id) AS owner FROM x GROUP BY h),
c AS (SELECT DISTINCT rid, unnest(range(p, p + 50)) AS q FROM x JOIN m USING (h) WHERE owner < doc_id),
l AS (SELECT rid, list(q) AS gone FROM c GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(v, ' ' ORDER BY i) FROM (SELECT unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i) WHERE NOT list_contains(gone, i)), '') END) AS kept_sha256
FROM d LEFT JOIN l USING (rid)""",
    "op3_preference_formatting": r"""
WITH t AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT pair_id, min(turn) AS differs FROM (SELECT pair_id, turn, role, text FROM t GROUP BY ALL HAVING count(*) = 1) GROUP BY pair_id),
r AS (SELECT t.*, differs IS NULL OR turn < differs AS common, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece, length(role) + 13 AS head FROM t LEFT JOIN o USING (pair_id)),
s AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, side, common ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r)
SELECT pair_id, CAST(count(*) FILTER (common AND side = low) AS BIGINT) AS n_common, coalesce(string_agg(piece, '' ORDER BY turn, role, text) FILTER (common AND side = low), '') AS prompt,
  CASE WHEN max(h0) > 0 THEN CAST(count(*) FILTER (NOT common AND side = 0) AS BIGINT) END AS n_chosen, CASE WHEN max(h0) > 0 THEN coalesce(string_agg(piece, '' ORDER BY turn, role, text) FILTER (NOT common AND side = 0), '') END AS chosen,
  CASE WHEN max(h0) > 0 THEN coalesce(string_agg((pos + head)::BIGINT || '-' || (pos + length(piece) - 1)::BIGINT, ',' ORDER BY turn, role, text) FILTER (NOT common AND side = 0 AND role = 'assistant'), '') END AS chosen_loss,
  CASE WHEN max(h1) > 0 THEN CAST(count(*) FILTER (NOT common AND side = 1) AS BIGINT) END AS n_rejected, CASE WHEN max(h1) > 0 THEN coalesce(string_agg(piece, '' ORDER BY turn, role, text) FILTER (NOT common AND side = 1), '') END AS rejected,
  CASE WHEN max(h1) > 0 THEN coalesce(string_agg((pos + head)::BIGINT || '-' || (pos + length(piece) - 1)::BIGINT, ',' ORDER BY turn, role, text) FILTER (NOT common AND side = 1 AND role = 'assistant'), '') END AS rejected_loss
FROM s JOIN (SELECT pair_id, min(side) AS low, count(*) FILTER (side = 0) AS h0, count(*) FILTER (side = 1) AS h1 FROM t GROUP BY pair_id) USING (pair_id)
GROUP BY pair_id""",
    "op6_topk_search": r"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid AS qrid, q.vec_id AS query_id, c.rid, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id, rid) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
}
