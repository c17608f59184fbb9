"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.

1. toxicity: documents that the classifier scores 0.5 or more go.
2. quality: documents whose probability of a grade above the lowest is under 0.5 go.
3. ngram_join: of documents linked by 0.75 of their five-word shingles one stays.
4. secrets: spans that the scan finds are replaced by a mark.
5. packing: what is left is tokenized and packed into sequences of 2048 tokens.

The classifiers are fitted on labelled documents among those that reach their stage.
"""

from __future__ import annotations

import public_tokenizers

from tallyspark.llm import ngram_join, packing, quality, secrets, toxicity
from tallyspark.llm.common import discard, materialize, read_table, release, small_batches


def begin(spark):
    """Before each stage: small Arrow batches, and a driver without the remains of the stage before."""
    small_batches(spark)
    release(spark)


def drop_toxic(spark, docs, sf_dir):
    begin(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_poor(spark, docs, sf_dir):
    begin(spark)
    return quality.keep_good(docs, quality.fit(docs, quality.graded(read_table(spark, sf_dir, "labels")), top=2))


def drop_near_copies(spark, docs, sf_dir):
    begin(spark)
    return ngram_join.keep_one(docs)


def redact_secrets(spark, docs, sf_dir):
    begin(spark)
    return secrets.redact(docs)


def pack(spark, docs, sf_dir):
    begin(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("ngram_join", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The classifiers and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed pieces of the documents of sf_dir."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
