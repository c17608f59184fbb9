"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from . import bpe, lm, mtree, multiset_hash, ngram_join, packing, quality, secrets, toxicity, url_filter
from .common import read_table, small_batches


def table(spark, sf_dir, name):
    small_batches(spark)
    return read_table(spark, sf_dir, name)


def op1_byte_bpe(spark, sf_dir):
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_mtree_search(spark, sf_dir):
    return mtree.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op4_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")), top=2))


def op6_secret_scans(spark, sf_dir):
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op7_multiset_hash(spark, sf_dir):
    return multiset_hash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark, sf_dir):
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_lm_scoring(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_mtree_search": op3_mtree_search,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_secret_scans": op6_secret_scans,
    "op7_multiset_hash": op7_multiset_hash,
    "op8_ngram_join": op8_ngram_join,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_lm_scoring": op10_lm_scoring,
}

ORACLES: dict[str, str] = {
    "op3_mtree_search": """
        WITH e AS (SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, 1 + greatest(len(q.v), len(c.v))), lambda i: coalesce(q.v[i], 0) * coalesce(c.v[i], 0)))::BIGINT AS score
              FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op4_url_filter": url_filter.oracle(),
    "op6_secret_scans": secrets.oracle(),
    "op7_multiset_hash": multiset_hash.oracle(),
    "op8_ngram_join": ngram_join.oracle(),
}
