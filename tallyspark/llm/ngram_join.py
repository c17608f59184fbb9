"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is the set of its distinct shingles of five words; two documents
link when their Jaccard similarity is 0.75 or more, and the result is one row per
document with the smallest id that its links reach.

Sets of n and m link when they share T(n, m) = ceil(0.75 (n + m) / 1.75) shingles.
The inverted lists of all shingles are brought together by exchanges and put into one
order, rare before frequent.  A set's first floor(n / 4) + 1 lists in that order are
its head.  If the first list that two sets share is at place i of one and j of the
other, they share min(n - i, m - j) shingles at most; so a pair is looked at in a
list only where both numbers reach T(n, m), and every linked pair is, in the first
list that it shares.  Steps:

1. Texts with equal sets form one class and count as one from here on, so copies
   are never expanded into pairs.
2. A rough order comes from a table of fixed size that knows about lengths of long
   lists.  Classes that pass the test of places in that order with another class, and
   whose heads have enough lists with other classes, remain; the others link to nothing.
3. The whole sets of those classes are written once, and all their lists are counted.
   The order is now exact; lists of one class take the first places, and a class
   with fewer than 0.75 n shingles in other lists is out.
4. In each list of the heads every class is held against one of them (its hub): the
   classes that pass the test of places become members of the hub's cells.  In a cell
   ``divide_skip`` searches the members for the hub: of the hub's lists in the cell the
   L = T / (MU log2 M + 1) longest (M: the length of the longest) are set aside, the
   others are merged, members that occur T - L times are looked up in the long ones by
   binary search, and those with T occurrences link.  Components of the links are
   found, and lists whose classes are all connected are done.
5. In the lists that are left, components that pass the test of places are held
   against each other, then some of their classes, in growing numbers, until all are;
   these pairs are searched in the same way, and components are found after each turn.
   So large groups of near copies join in a number of searches that is about linear in
   their size, and few are left for the last turn.

So every linked pair is either searched or already connected: nothing is capped,
sampled or approximated, apart from shingles being 64-bit hashes.  Lists of very
many classes are dealt in parts, other ones in each turn.

Texts are lower-cased in A-Z only; words end at ASCII white space.  With fewer
than five words the whole sequence is one shingle.  Null texts count as empty; texts
without words have no shingle, link to nothing and keep their own id.  Repeated
rows and ties of doc_id give one result row each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release, slices
from .components import connected_components

WORDS = 5
#: Similarity as a fraction: 75 / 100.
NUM, DEN = 75, 100
#: Slots of the table of list levels, and of the bitmap of wanted documents: fixed sizes.
LEVEL_SLOTS, BITMAP_BITS = 1 << 22, 1 << 27
#: Shingles counted at once in a task; least count there, and in all, that gets a level.
COUNT_CHUNK, COUNT_LEAST, LEVEL_LEAST = 8_000_000, 2, 2
#: Members that one probe task holds beside a hub, about.
CELL = 256
#: Pairs that one search task holds, about.
BLOCK_PAIRS = 1024
#: Members that stand for a component in a list, in the turns before all do; rounds of components after a turn.
STANDING, LABEL_ROUNDS = (16, 128), 3
#: Lists of 2 ** HOT_LEVEL documents or more are dealt in parts of about that many.
HOT_LEVEL = 13
#: Cost of a place in a merge against a step of a binary search.
MU = 0.01
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_KNOWN = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles, as signed integers."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64).view(np.int64)
    w = np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(w) - WORDS + 1
    h = w[:n] * _MULT[0]
    for k in range(1, WORDS):
        h += w[k : n + k] * _MULT[k]
        h ^= h >> np.uint64(29)
        h *= _MULT[0]
    h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def class_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found))).view(np.int64)) if len(found) else 0


def _needed(n):
    """Least overlap with any partner: ceil(0.75 n)."""
    return -(-NUM * n // DEN)


def classes_and_counts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, cls, n) of documents and rows (shingle, count) of shingles that a task met often."""
    names = ["row", "doc_id", "cls", "n"]
    types = [pa.int8(), pa.int64(), pa.int64(), pa.int64()]

    def often(parts: list[np.ndarray]) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(parts), return_counts=True)
        keep = count >= COUNT_LEAST
        value, count = value[keep], count[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(value), dtype="i1")), pa.nulls(len(value), pa.int64()), pa.array(value), pa.array(count.astype("i8"))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            columns = ([0] * len(sets), batch.column(0), [class_of(s) for s in sets], [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            for s in sets:
                parts.append(s)
                size += len(s)
                if size >= COUNT_CHUNK:
                    yield often(parts)
                    parts, size = [], 0
        if size:
            yield often(parts)

    return docs.mapInArrow(run, "row tinyint, doc_id long, cls long, n long")


def list_levels(counted: DataFrame) -> np.ndarray:
    """A level for each slot of shingles; 0 for lists that are not known to be long.

    At most LEVEL_SLOTS small rows reach the driver.
    """
    lists = counted.where("row = 1").groupBy(F.col("cls").alias("shingle")).agg(F.sum("n").alias("n")).where(F.col("n") >= LEVEL_LEAST)
    slots = lists.groupBy(F.pmod("shingle", F.lit(LEVEL_SLOTS)).cast("int").alias("slot")).agg(F.max(F.floor(F.log2("n"))).cast("tinyint").alias("level"))
    levels = np.zeros(LEVEL_SLOTS, dtype=np.int8)
    got = slots.toArrow()
    levels[got.column("slot").to_numpy()] = got.column("level").to_numpy()
    return levels


def _parts(level: np.ndarray) -> np.ndarray:
    """Parts that lists of these levels are dealt in: 1 for all but very long ones."""
    return np.where(level >= HOT_LEVEL, np.int64(1) << np.maximum(level.astype(np.int64) - HOT_LEVEL + 1, 0), 1)


def _part(level: np.ndarray, cls) -> np.ndarray:
    """The part of a list of this level that a class is in; -1 for all but very long ones."""
    parts = _parts(level)
    return np.where(parts > 1, cls % parts, -1)


def _largest(rest):
    """The largest set that a set may link to if rest is a bound of their overlap."""
    return (rest * (NUM + DEN)) // NUM


def short_lists(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """part, shingle, cls, size for the head of every class in the rough order; a class met again in the same task is skipped.

    part is -1, or that of a very long list; size is n * 2^32 + hi, in one column as these rows are moved.
    """
    sent = docs.sparkSession.sparkContext.broadcast(levels)  # LEVEL_SLOTS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            out, part, cls, size = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                c = class_of(found)
                if not len(found) or c in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(c)
                n = len(found)
                level = sent.value[found % LEVEL_SLOTS]
                order = np.argsort(level, kind="stable")[: n - _needed(n) + 1]
                out.append(found[order])
                part.append(_part(level[order], c))
                cls.append(np.full(len(order), c))
                size.append((n << 32) + _largest(n - np.arange(len(order))) - n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (part, out, cls, size)], ["part", "shingle", "cls", "size"])

    return docs.mapInArrow(run, "part long, shingle long, cls long, size long")


def _shared(keys: str, tie: str) -> str:
    """SQL: some other row with the same keys passes the test of places with this one, n <= its hi and its n <= hi.

    In order of n: a smaller row must have a hi of n at least, a larger one fits if the
    next in order does.
    """
    over = f"OVER (PARTITION BY {keys} ORDER BY n, {tie}"
    return f"(coalesce(max(hi) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= n, false) OR coalesce(lead(n) {over}) <= hi, false))"


def sharing_classes(heads: DataFrame) -> DataFrame:
    """cls of the classes that may link to another one as far as the heads tell; those of very long lists are all taken.

    Two classes must pass the test of places in a list, and as they share at most the
    lists that both heads share and the others of one of them, both heads must have
    enough lists with other classes.
    """
    dealt = heads.repartition("shingle", "part").selectExpr("*", "shiftright(size, 32) AS n", "size & 4294967295L AS hi")
    over = "OVER (PARTITION BY shingle, part)"
    met = dealt.selectExpr("part", "shingle", "cls", "size", f"min(cls) {over} < max(cls) {over} AS two", f"{_shared('shingle, part', 'cls')} AS shared")
    met = met.where("part >= 0 OR two").select("part", "shared", "shingle", "cls", "size").repartition("cls")
    met = met.selectExpr("part", "shared", "shingle", "cls", "shiftright(size, 32) AS n", "size & 4294967295L AS hi", "count(*) OVER (PARTITION BY cls) AS met")
    met = materialize(met, "met")
    pair = f"""x.shingle = y.shingle AND x.cls <> y.cls AND x.n <= y.hi AND y.n <= x.hi
        AND least(x.met, y.met) + greatest({_long('x.n')}, {_long('y.n')}) >= ({NUM} * (x.n + y.n) + {NUM + DEN - 1}) div {NUM + DEN}"""
    some = met.where("part < 0 AND shared")
    found = some.alias("x").join(some.alias("y"), F.expr(pair), "left_semi").select("cls")
    out = materialize(found.unionAll(met.where("part >= 0").select("cls")).distinct(), "sharing")
    discard(met)
    return out


def _long(n: str) -> str:
    """SQL for the number of lists beyond the head of a set of n."""
    return f"(({NUM} * {n} + {DEN - 1}) div {DEN} - 1)"


def _sets(docs: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """cls, shingles of the wanted classes (cls, rep: a document of the class).

    A bitmap of bounded size drops most other texts before anything is moved; the
    join after it is exact.
    """
    n_bits = min(BITMAP_BITS, 1 << max(10, (128 * n_wanted).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(n_bits))
    bits = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(n_bits)).alias("at"))
    bits = bits.groupBy(F.expr("at div 32").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 AS int))")).alias("bits")).toArrow()
    bitmap = np.zeros(n_bits // 32, dtype=np.uint32)
    bitmap[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)  # BITMAP_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            where = batch.column(2).to_numpy()
            some = batch.filter(pa.array((sent.value[where // 32] >> (where % 32).astype(np.uint32)) & 1 == 1))
            if some.num_rows:
                sets = [shingles(t) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([class_of(s) for s in sets]), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "cls", "shingles"])

    found = docs.where("doc_id IS NOT NULL").withColumn("at", at).mapInArrow(run, "doc_id long, cls long, shingles array<long>")
    # dealt by cls alone, and so that a join that turns into a broadcast while running keeps it: the sets move once.
    # An equality of the ids would become a second key of the join, and the grouping would move the sets again.
    found = found.repartition("cls").join(wanted, "cls").where("doc_id BETWEEN rep AND rep")
    return found.groupBy("cls").agg(F.first("shingles").alias("shingles"))  # ids may be repeated


def head_lists(sets: DataFrame, levels: np.ndarray) -> DataFrame:
    """shingle, parts, cls, n, hi, alone for the heads in the exact order.

    hi is the largest set that the class may link to from that list, alone the share (in
    twentieths) of its lists that no other class is in.

    Lists of very many classes keep the length that their level gives, so that the order
    is the same for all and nothing counts such a list in one task.
    """
    sent = sets.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            size = np.diff(batch.column(1).offsets.to_numpy())
            every = batch.column(1).flatten().to_numpy()
            level = sent.value[every % LEVEL_SLOTS]
            cls, n = np.repeat(batch.column(0).to_numpy(), size), np.repeat(size.astype(np.int64), size)
            columns = (_part(level, cls), every, cls, n * 64 + level)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "shingle", "cls", "size"])

    entries = sets.select("cls", "shingles").mapInArrow(run, "part long, shingle long, cls long, size long")
    length = "if(part >= 0, shiftleft(1L, cast(size & 63 AS int)), count(*) OVER (PARTITION BY shingle, part))"
    counted = entries.repartition("shingle", "part").selectExpr("shingle", "cls", "if(part < 0, size & ~63L, size) AS size", f"{length} AS length").where("length > 1").repartition("cls")
    parts = f"if(size & 63 = 0, 1L, shiftleft(1L, cast((size & 63) - {HOT_LEVEL - 1} AS int))) AS parts"
    placed = counted.selectExpr("shingle", parts, "cls", "cast(shiftright(size, 6) AS int) AS n", "count(*) OVER (PARTITION BY cls) AS m", "row_number() OVER (PARTITION BY cls ORDER BY length, shingle) AS r")
    # n - m lists of the class alone come first; what is left from this place on bounds the overlap
    rest = "(m - r + 1)"
    heads = placed.where(f"{DEN} * {rest} >= {NUM} * n")
    return heads.selectExpr("shingle", "parts", "cls", "n", f"cast({rest} * {NUM + DEN} div {NUM} - n AS int) AS hi", "cast(20 * (n - m) div n AS int) AS alone")


def divide_skip(query: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
    """Whether each member (a sorted set) links to the query (a sorted set)."""
    size = np.array([len(m) for m in members])
    needed = -(-NUM * (size + len(query)) // (NUM + DEN))
    # the inverted lists of the members: shingles in order, of each its members in order
    every = np.concatenate(members)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(members)), size)[order]
    begin, end = np.searchsorted(every, query, "left"), np.searchsorted(every, query, "right")
    length = end - begin
    least = int(needed.min())
    long_lists = min(least - 1, int(least / (MU * np.log2(max(2, length.max(initial=0))) + 1)))
    by_length = np.argsort(length, kind="stable")
    short, far = by_length[: len(query) - long_lists], by_length[len(query) - long_lists :]
    # merge: the postings of the short lists, counted by member
    postings = np.concatenate([owner[begin[k] : end[k]] for k in short if length[k]] or [owner[:0]])
    found = np.bincount(postings, minlength=len(members))
    left = np.flatnonzero(found >= needed - long_lists)
    # probe: binary search of what is left in each long list
    for k in far:
        if not len(left):
            break
        if length[k]:
            own = owner[begin[k] : end[k]]
            found[left] += own[np.minimum(np.searchsorted(own, left), len(own) - 1)] == left
    return found >= needed


def _search_pairs(pairs: DataFrame, sets: DataFrame, n_pairs: int) -> DataFrame:
    """pairs (hub, member) that link, as edges (a, b).  Members of a hub are dealt to cells of about CELL, cells to blocks of about BLOCK_PAIRS."""
    block = F.pmod(F.xxhash64("hub", "cell"), F.lit(max(1, n_pairs // BLOCK_PAIRS)))
    sizes = pairs.groupBy("hub").agg(F.expr(f"cast(ceil(count(*) / {CELL}) AS int)").alias("cells"))
    cells = pairs.join(sizes, "hub").withColumn("cell", F.pmod(F.xxhash64("member"), F.col("cells")).cast("int"))
    members = cells.join(sets, cells["member"] == sets["cls"]).select(block.alias("block"), "hub", "cell", "member", "shingles")
    spread = sizes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    hubs = spread.join(sets, spread["hub"] == sets["cls"]).select(block.alias("at"), F.col("hub").alias("h"), F.col("cell").alias("c"), F.col("shingles").alias("of_hub"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        queries = dict(zip(zip(left["h"], left["c"], strict=True), left["of_hub"], strict=True))
        member, found = right["member"].to_numpy(), [pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})]
        for key, at in right.groupby(["hub", "cell"]).indices.items():
            ok = divide_skip(np.asarray(queries[key]), [np.asarray(x) for x in right["shingles"].iloc[at]])
            if ok.any():
                found.append(pd.DataFrame({"a": key[0], "b": member[at][ok]}))
        return pd.concat(found)

    return hubs.groupBy("at").cogroup(members.groupBy("block")).applyInPandas(run, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """The pairs (hub, member) that link, as edges (a, b)."""
    named = materialize(pairs.select(F.col("hub").alias("cls")).unionAll(pairs.select(F.col("member").alias("cls"))).distinct(), f"{label}-named")
    own = materialize(sets.join(named, "cls"), f"{label}-sets")
    links = materialize(_search_pairs(pairs, own, pairs.count()), label)
    discard(own)
    discard(named)
    return links


def _hub_pairs(lists: DataFrame) -> DataFrame:
    """hub, member: in each list the classes that pass the test of places with its hub, one of those with the least alone.

    These link to most, and lists of the same members have the same hub.
    """
    hub = "min(struct(alone, xxhash64(cls) AS o, cls, n, hi)) OVER (PARTITION BY shingle, pmod(xxhash64(cls), parts)) AS h"
    found = lists.selectExpr("cls", "n", "hi", hub).where("cls <> h.cls AND n <= h.hi AND h.n <= hi")
    return found.select(F.col("h.cls").alias("hub"), F.col("cls").alias("member")).distinct()


def _named(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """lists with the components of labels, of those (or parts of very long ones) that hold several."""
    named = lists.drop("comp").join(labels, lists["cls"] == labels["node"], "left").select("shingle", "parts", "cls", "n", "hi", F.coalesce("component", "cls").alias("comp"))
    over = "OVER (PARTITION BY shingle, pmod(xxhash64(cls), parts))"
    return named.selectExpr("*", f"min(comp) {over} AS lo", f"max(comp) {over} AS top").where("parts > 1 OR lo < top").drop("lo", "top")


def _cross_pairs(lists: DataFrame, some: int | None) -> DataFrame:
    """hub, member: classes of different components of a list that pass the test of places.

    With ``some``, about that many members stand for each component in a list, the same in
    all lists; with None all do.
    """
    groups = lists.groupBy("shingle", "comp").agg(F.min("n").alias("n"), F.max("hi").alias("hi"), F.count("*").alias("m"))
    groups = groups.selectExpr("*", f"{_shared('shingle', 'comp')} AS shared").where("shared")
    fits = "x.n <= y.hi AND y.n <= x.hi"
    across = groups.alias("x").join(groups.alias("y"), F.expr(f"x.shingle = y.shingle AND x.comp < y.comp AND {fits}"))
    across = across.selectExpr("x.shingle AS shingle", "x.comp AS comp", "x.m AS m", "y.comp AS comp2", "y.m AS m2", "y.n AS n2", "y.hi AS hi2")
    stands = lambda m: "true" if some is None else f"pmod(xxhash64(y.cls), shiftleft(1L, cast(greatest(0, floor(log2({m} / {some}))) AS int))) = 0"
    side = across.alias("x").join(lists.alias("y"), F.expr(f"x.shingle = y.shingle AND x.comp = y.comp AND y.n <= x.hi2 AND x.n2 <= y.hi AND {stands('x.m')}"))
    side = side.selectExpr("x.shingle AS shingle", "x.comp2 AS comp", "x.m2 AS m", "y.cls AS hub", "y.n AS n", "y.hi AS hi")
    found = side.alias("x").join(lists.alias("y"), F.expr(f"x.shingle = y.shingle AND x.comp = y.comp AND {fits} AND {stands('x.m')}"))
    return found.selectExpr("x.hub AS hub", "y.cls AS member").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("hub", "member").alias("least"), F.greatest("hub", "member").alias("most"))


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    """hub, member of pairs, without those probed before, either way round."""
    named = pairs.select("hub", "member", F.least("hub", "member").alias("least"), F.greatest("hub", "member").alias("most"))
    return (named if tried is None else named.join(tried, ["least", "most"], "left_anti")).select("hub", "member")


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    first = materialize(classes_and_counts(texts), "classes")
    rows = first.where("row = 0").select("doc_id", "cls", "n")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL")
    levels = list_levels(first)
    sharing = sharing_classes(short_lists(texts, levels))
    wanted = materialize(sharing.join(classes, "cls"), "wanted")
    discard(sharing)
    release(spark)
    sets = materialize(_sets(texts, wanted, wanted.count()), "sets")
    discard(wanted)
    # at first a class is alone in its component
    lists = materialize(head_lists(sets, levels).withColumn("comp", F.col("cls")), "lists-0")
    every, tried, used = None, None, []
    for turn, some in enumerate((0, *STANDING, None)):
        release(spark)
        pairs = _cross_pairs(lists, some) if turn else _hub_pairs(lists)
        pairs = materialize(_untried(pairs, tried), f"pairs-{turn}")
        links = _links(pairs, sets, f"links-{turn}")
        used += [pairs, links]
        tried = _ends(pairs) if tried is None else tried.unionAll(_ends(pairs))
        every = links if every is None else every.unionAll(links)
        if some is not None:
            # some rounds are enough here: equal labels are connected, and what they leave apart costs searches only
            labels = connected_components(every, f"near-{turn}", max_rounds=LABEL_ROUNDS)
            before, lists = lists, materialize(_named(lists, labels), f"lists-{turn + 1}")
            discard(before)
            discard(labels)
    release(spark)
    final = connected_components(every, "joined")
    for df in (lists, sets, *used):
        discard(df)
    # the smallest id of each component, and of each class without links
    both = classes.join(final, classes["cls"] == final["node"], "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    least = both.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = both.join(least, "component").select("cls", "component_id")
    out = rows.join(ids, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all its columns, with one document of each group: the one whose id names the component.

    Rows that share a doc_id stay or go together; of those that also share the text
    one stays, with the least of the other columns.  Rows with a null doc_id all stay.
    """
    joined = join_documents(docs.where("doc_id IS NOT NULL").select("doc_id", "text"))
    fate = joined.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("_kept"), F.count("*").alias("_rows"))
    # all columns travel in one struct, whatever their names; only ids to be dropped or looked at are joined
    fate = materialize(fate.where("_kept = 0 OR _rows > 1"), "fate")
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"))
    at = F.col("_row.doc_id").cast("long")
    single = whole.join(fate.select("_id"), at == fate["_id"], "left_anti")
    again = whole.join(fate.where("_kept = 1").select("_id"), at == fate["_id"], "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # equal ids and texts become one on the map side already
    again = again.groupBy(F.col("_row.doc_id").alias("_i"), F.col("_row.text").alias("_t")).agg(F.min(F.struct(F.lit(0).alias("_0"), *(F.col(f"_row.`{c}`") for c in rest))).alias("_rest"))
    again = again.select(F.struct(*((F.col("_i") if c == "doc_id" else F.col("_t") if c == "text" else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns)).alias("_row"))
    out = single.unionAll(again)
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def oracle() -> str:
    """DuckDB SQL: pairs of different texts by shared shingles, all lists joined whole."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id::BIGINT AS doc_id, {words} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS g FROM d),
t AS (SELECT doc_id, len(g)::BIGINT AS n, CASE WHEN len(g) > 0 THEN md5(array_to_string(list_sort(g), chr(10))) END AS c, g FROM s),
k AS (SELECT c, min(doc_id) AS rep, any_value(n) AS n, any_value(g) AS g FROM t WHERE c IS NOT NULL GROUP BY c HAVING min(doc_id) IS NOT NULL),
e AS (SELECT rep, n, unnest(g) AS x FROM k),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM p WHERE {DEN} * o >= {NUM} * (n + m - o)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT rep, rep FROM k UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a),
m AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT t.doc_id, t.n AS n_shingles, CASE WHEN t.c IS NULL THEN t.doc_id ELSE m.least END AS component_id
FROM t LEFT JOIN k ON t.c = k.c LEFT JOIN m ON m.a = k.rep"""
