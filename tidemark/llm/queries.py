"""The registered query of each operator, with production parameters over whole tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_automaton, embedding_dedup, exact_dedup, langid, packing, records, simhash, suffix_dedup, token_count, window_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): tokens of the text as op3_token_records writes them, its end mark counted."""
    return records.lengths(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_files(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_repeats(_documents(spark, sf_dir)).drop("intervals")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(word_lengths(_documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_token_counts, op3_token_records, op4_bpe_automaton, op5_language_id, op6_suffix_dedup, op7_embedding_dedup, op8_window_dedup, op9_exact_dedup, op10_best_fit_packing)
}

ORACLE_SQL: dict[str, str] = {
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d),
        w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 400) AS s FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 199)) AS i FROM n)),
        hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(s)) AS c FROM w) WHERE c > 1),
        edge AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM hit),
        island AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edge),
        span AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS b FROM island GROUP BY doc_id, k),
        gap AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (
            SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, -1, 0 FROM n)),
        kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * g.a + 1, 2 * (coalesce(g.b, n_bytes) - g.a)), '' ORDER BY g.a) AS h FROM gap g JOIN n USING (doc_id) GROUP BY g.doc_id),
        cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
        SELECT n.doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
        FROM n JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)""",
    "op8_window_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
        hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM s) WHERE least < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hit),
        word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS t FROM d),
        kept AS (SELECT word.doc_id, string_agg(t, ' ' ORDER BY word.k) AS t, count(*) AS n FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.k = gone.k GROUP BY word.doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d""",
}
