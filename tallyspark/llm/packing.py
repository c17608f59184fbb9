"""Best-fit packing: bulk-synchronous best-fit on range-sorted documents and gaps.

Documents are tokenized whole, end with one separator id and are cut only above
the capacity, into pieces of that length and a shorter rest.

Rounds place the pieces.  Before each, as many sequences are opened as the rest needs at least.  Then
pieces and gaps, sorted by size, meet: the largest piece first, each takes the smallest gap
that holds it (``match``).  Conflicts are settled by ranks, the gaps are updated, and the next
round follows until all pieces are placed.  A gap takes one piece in a round, so one with room for several of
the longest piece left is offered as that many gaps, if there are more pieces than gaps (``offer``).

All rows of a round stay distributed, and its result is a table in the shared folder.  Ranks
are counted in salted blocks, so that a length that a third of all pieces share is no
hot key.  The driver sees counts by size only, at most two for each size up to the capacity.

Null texts count as empty: such a document is one piece, the separator alone.
Repeated rows are packed as often as they occur, ties of length are placed in any
order, further columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, slices

CAPACITY = 2048
SEPARATOR = 0
#: Words whose ids a worker remembers, at most.
CACHE_WORDS = 1_000_000
#: ASCII marks but the apostrophe, and what may stand before them where they are cut off an ASCII part.
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'")
_PLAIN_END = re.compile(rb"[a-z0-9]\Z")
#: Blocks that the rows of one size are ranked in, at least, and rows in such a block, about.
BLOCKS, BLOCK_ROWS = 64, 1_000_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


_BYTE = _byte_letters()


def _letters(word: bytes) -> str | None:
    """What the steps before the model make of a word of Latin letters only, None for any other word.

    Such a word is in normal form and one word to the splitting pattern, so only lower
    case and the letters of its bytes are left to do.
    """
    if word.isalpha():
        return word.decode().lower()
    if word.isascii():
        return None
    text = word.decode("utf-8", "replace")
    if not text.isalpha() or max(text) > "\u024f" or "\u0130" in text:  # the lower case of U+0130 holds a mark
        return None
    return "".join(_BYTE[b] for b in text.lower().encode())


class WordIds(dict):
    """Ids of texts, word by word: a mapping of blank-free parts to little-endian unsigned 32-bit ids.

    The tokenizer drops white space and none of its steps looks across it, so the
    ids of a text are those of its blank-separated parts, joined.  A part that ends in
    ASCII marks (apostrophes excepted) behind an ASCII letter or digit, or behind Latin letters
    only, is two words to the tokenizer, and an ASCII part has the ids of its lower case, so that fewer
    different words reach the tokenizer.  This holds for parts without ``<|``, which
    may begin a special token; all other parts go to the tokenizer as they are.
    """

    def __init__(self, path: str, bound: int = CACHE_WORDS):
        super().__init__()
        self.path, self.bound = path, bound
        self.words: dict[bytes, bytes] = {}

    def __missing__(self, part: bytes) -> bytes:
        if b"<|" in part:
            found = self.of_word(part)
        else:
            low = part.lower() if part.isascii() else part
            head = low.rstrip(_MARKS)
            if len(head) < len(low) and (_PLAIN_END.search(head) if low.isascii() else _letters(head) is not None):
                found = self.of_word(head) + self.of_word(low[len(head) :])
            else:
                found = self.of_word(low)
        self[part] = found
        return found

    def of_word(self, word: bytes) -> bytes:
        found = self.words.get(word)
        if found is None:
            t, plain = _tokenizer(self.path), _letters(word)
            if plain is None:
                ids = t.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            else:
                ids = [x.id for x in t.model.tokenize(plain)]
            found = self.words[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text."""
        for text in texts:
            if len(self) > self.bound:
                self.clear()
                self.words.clear()
            yield b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""
    end = np.array([SEPARATOR], dtype="<u4").tobytes()
    ids = WordIds(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, data in zip(batch.column(0).to_pylist(), ids.encode(batch.column(1).to_pylist()), strict=True):
                data += end
                total = len(data) // 4
                for k, start in enumerate(range(0, total, capacity)):
                    part = data[4 * start : 4 * min(start + capacity, total)]
                    for column, value in zip(out, (doc, k, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def offer(gaps: DataFrame, longest: int, each: int) -> DataFrame:
    """kind, id, size: every gap of a sequence as at most ``each`` gaps that hold the longest piece left, or as one."""
    cut = gaps.selectExpr("id", "size", f"greatest(1, least({each}, size DIV {longest})) AS n").selectExpr("id", "size", "n", "explode(sequence(1L, n)) AS j")
    return cut.selectExpr("0 AS kind", "id", f"IF(j = n, size - (n - 1) * {longest}, {longest}L) AS size")


def match(state: DataFrame, blocks: int) -> DataFrame:
    """One bulk-synchronous round: kind, id, size, item.

    ``state`` has kind, id, size: gaps (kind 0, the sequence and what is free in it) and
    pieces (kind 1, the item and its length).  Sorted by size, largest first, the pieces meet the gaps as
    in best fit decreasing, where every gap takes one piece: a piece takes the smallest gap
    that holds it and that no larger piece has taken.  Read as brackets, a gap opens and a piece closes
    the latest gap still open.  The depth before each run of equal rows comes from
    counts; a row's rank in its run then gives the level that it opens or closes, which
    settles all conflicts, and of the rows of a level each piece follows its gap.

    The result holds what is free in each sequence (kind 0), the pieces that found no gap (kind 1), and as kind 2
    the placed pieces: sequence, length and item.
    """
    salted = state.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    order = "OVER (ORDER BY size DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    blocked = salted.groupBy("size", "kind", "block").agg(F.count("*").alias("n"))
    classes = (  # two rows for each size at most
        blocked.groupBy("size", "kind").agg(F.sum("n").alias("n"))
        .selectExpr("size", "kind", f"sum(IF(kind = 0, n, -n)) {order} AS total")
        .selectExpr("size", "kind", f"total - least(0, min(total) {order}) AS after")
        .selectExpr("size", "kind", "lag(after, 1, 0L) OVER (ORDER BY size DESC, kind) AS depth")
    )
    runs = blocked.selectExpr("size", "kind", "block", "sum(n) OVER (PARTITION BY size, kind ORDER BY block) - n AS before").join(F.broadcast(classes), ["size", "kind"])
    ranked = salted.selectExpr("*", "row_number() OVER (PARTITION BY size, kind, block ORDER BY id) - 1 AS r").join(runs, ["size", "kind", "block"])
    ranked = ranked.selectExpr("size", "kind", "id", "depth", "before + r AS r")
    # pieces without a gap get negative keys of their own, so that they are no hot key
    keyed = ranked.selectExpr("size", "kind", "id", "CASE WHEN kind = 0 THEN depth + r WHEN r < depth THEN depth - 1 - r ELSE -1 - abs(xxhash64(id) DIV 2) END AS key")
    within = "OVER (PARTITION BY key ORDER BY size DESC, kind, id)"
    met = keyed.selectExpr("size", "kind", "id", "key", f"lead(kind) {within} AS next", f"lead(id) {within} AS item", f"lead(size) {within} AS taken")
    row = "named_struct('kind', {}, 'id', id, 'size', {}, 'item', {})"
    same = row.format("kind", "size", "CAST(NULL AS LONG)")
    left = row.format("0", "size - taken", "CAST(NULL AS LONG)")
    placed = row.format("2", "taken", "item")
    rows = met.where("kind = 0 OR key < 0").selectExpr(f"inline(CASE WHEN kind = 0 AND next = 1 THEN array({left}, {placed}) ELSE array({same}) END)")
    return rows.groupBy("kind", "id", "item").agg(F.sum("size").alias("size")).select("kind", "id", "size", "item")


def sequences_needed(pieces: dict[int, int], gaps: dict[int, int], capacity: int) -> int:
    """How many sequences to open before a round: no packing of these pieces into these gaps opens fewer.

    Both are counts by size, at most ``capacity`` numbers.  What is longer than every gap
    needs new sequences, alone if longer than half of one, and so does what exceeds all gaps together.
    """
    most = max(gaps, default=0)
    stuck = {size: n for size, n in pieces.items() if size > most}
    over = sum(size * n for size, n in pieces.items()) - sum(size * n for size, n in gaps.items())
    return max(-(-sum(size * n for size, n in stuck.items()) // capacity), sum(n for size, n in stuck.items() if 2 * size > capacity), -(-over // capacity), 0)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with length and a unique item) and sequence_id, offset."""
    spark = pieces.sparkSession
    names = pieces.columns
    blocks = max(BLOCKS, pieces.count() // BLOCK_ROWS)
    state, placed, opened = pieces.selectExpr("1 AS kind", "item AS id", "length AS size"), [], 0
    while True:
        counts: dict[int, dict[int, int]] = {0: {}, 1: {}}
        for r in state.where("kind < 2").groupBy("kind", "size").agg(F.count("*").alias("n")).collect():  # two for each size at most
            counts[r["kind"]][r["size"]] = r["n"]
        if not counts[1]:
            break
        release(spark)
        least, longest = min(counts[1]), max(counts[1])
        gaps = {size: n for size, n in counts[0].items() if size >= least}
        more = sequences_needed(counts[1], gaps, capacity)
        each = -(-sum(counts[1].values()) // (sum(gaps.values()) + more))
        free = state.where(f"kind = 0 AND size >= {least}").select("id", "size").unionByName(spark.range(opened, opened + more).selectExpr("id", f"{capacity}L AS size"))
        opened += more
        state = materialize(match(state.where("kind = 1").select("kind", "id", "size").unionByName(offer(free, longest, each)), blocks), "round")
        placed.append(state.where("kind = 2").selectExpr("item", "id AS sequence_id"))
    if not placed:
        return pieces.selectExpr(*names, "0L AS sequence_id", "0L AS offset")
    before = "OVER (PARTITION BY sequence_id ORDER BY length DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"  # a sequence has at most capacity pieces
    return pieces.join(reduce(DataFrame.unionByName, placed), "item").selectExpr(*names, "sequence_id", f"coalesce(sum(length) {before}, 0L) AS offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    cut = cut_documents(docs, tokenizer, capacity).withColumn("item", F.monotonically_increasing_id())
    return pack_pieces(materialize(cut, "pieces"), capacity).drop("item")  # tokenized once, items fixed
