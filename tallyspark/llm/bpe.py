"""Byte-level BPE encoding and decoding with the tiktoken library.

The ranks come from a local file and every text is encoded whole, as ordinary
text.  Texts above ``LONG_TEXT`` characters are cut before the library sees
them, but only at safe boundaries: before a single space between two
non-spaces.  No match of the splitting pattern crosses such a place (a match
holds a space at its start only, or consists of white space alone), so the ids
of the parts, joined, are the ids of the whole.

Nulls count as empty texts; an empty text has no ids, and its digests are those
of no bytes.  Rows are independent: repeated rows, ties and further columns of
any name change nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

#: Characters above which a text is cut at safe boundaries first.
LONG_TEXT = 1 << 16
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def load_ranks(rank_file: str) -> dict[bytes, int]:
    """Token bytes and their ranks."""
    ranks = {}
    with open(rank_file, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file, built once in each worker."""
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(rank_file), special_tokens={})


def safe_parts(text: str, size: int = LONG_TEXT) -> list[str]:
    """text in parts of about size characters, cut at safe boundaries only."""
    if len(text) <= size:
        return [text]
    parts, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


def encode(text: str, rank_file: str, pattern: str) -> np.ndarray:
    enc = encoding(rank_file, pattern)
    ids: list[int] = []
    for part in safe_parts(text):
        ids += enc.encode_ordinary(part)
    return np.array(ids, dtype="<u4")


def decode(ids: np.ndarray, rank_file: str, pattern: str) -> bytes:
    """The raw bytes; they need not be valid UTF-8 where ids end inside a character."""
    return encoding(rank_file, pattern).decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<long>: the encoding of every text."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "ids": [encode(t or "", rank_file, pattern).astype("i8") for t in batch.column(1).to_pylist()]}

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]), run, "doc_id long, ids array<long>")


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, bytes binary from doc_id, ids."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "bytes": [decode(np.array(x or [], dtype="<u4"), rank_file, pattern) for x in batch.column(1).to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def digest_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encode, then decode the ids again; per document only digests leave the worker."""

    def run(batch: pa.RecordBatch) -> dict:
        n, ids_sha, decoded_sha = [], [], []
        for text in batch.column(1).to_pylist():
            ids = encode(text or "", rank_file, pattern)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
            decoded_sha.append(hashlib.sha256(decode(ids, rank_file, pattern)).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

    cols = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return map_batches(cols, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
