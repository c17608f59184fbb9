"""Exact top-k search by inner product: M-trees searched best-first.

Inner products are no metric, so vectors get one more coordinate: with M the
largest norm, x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0).  Then
d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the nearest objects have the largest products,
and Euclidean distance obeys the triangle inequality.

Index: rows go to the nearest of at most ``PIVOTS`` pivots; each cell is cut into
shards of about ``SHARD`` rows, and each shard is bulk-loaded as an M-tree whose
pages (rows of a table) hold, per entry, the distance to the parent's routing object
and, for inner pages, the covering radius.  Search: a page is opened in the order of
its smallest possible distance; an entry whose stored parent distance differs too
much from the query's is skipped without computing a distance.  Distances only
prune, with a margin for rounding; scores are exact integers.

Each query first searches one shard of its own cell, which gives a bound that most
other cells are then held against; the shards that remain are searched in blocks of
queries, and the results are merged by rank.

Of equal vectors only those with the k + 1 smallest ids are indexed, k rows of each:
ties go to the smaller id, so the others can never be among the k results of any query.

Vectors that are null, or hold null or non-finite components, take no part.  Scores are
exact as long as they fit a long, which is their type; scaled components are taken up to
+-2^62, beyond which no score of the vector with itself would.  Vectors of
unequal length are compared as if zeros followed the shorter one.  Repeated vec_ids
are different candidates for others but not for a query of the same id, and such a
query runs once for each different vector.  A null vec_id takes no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SCALE = 1024
#: Scaled components beyond this do not fit a score.
REACH = float(1 << 62)
#: Pivots at most, rows of a cell for each pivot, rows of a shard.
PIVOTS, CELL_ROWS, SHARD = 2048, 2048, 2048
LEAF, FANOUT = 64, 24
#: Queries searched in one shard at once.
BLOCK = 4096
PAGE = "page int, leaf boolean, ids array<long>, radius array<double>, parent array<double>, vectors array<double>, whole array<long>"


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, v array<long>, norm2: the vectors that take part, as integers."""
    cols = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    finite = "forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    whole = f"transform(x, c -> cast(floor(greatest({-REACH}D, least({REACH}D, c * {scale}D))) AS bigint))"
    return cols.where(finite).select("vec_id", F.expr(whole).alias("v")).withColumn("norm2", F.expr("aggregate(v, 0D, (a, c) -> a + cast(c AS double) * c)"))


def _matrix(column, dim: int, kind=np.float64) -> np.ndarray:
    out = np.zeros((len(column), dim), dtype=kind)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def lift(x: np.ndarray, top2: float) -> np.ndarray:
    """The further coordinate that makes all norms sqrt(top2)."""
    return np.concatenate([x, np.sqrt(np.maximum(0.0, top2 - (x * x).sum(1)))[:, None]], 1)


def build(ids: np.ndarray, objects: np.ndarray, whole: np.ndarray, seed: int = 3) -> list[tuple]:
    """Pages of an M-tree over lifted objects: (page, leaf, ids or child pages, radii, parent distances, objects, integer vectors of leaves)."""
    rng = np.random.default_rng(seed)
    pages: list[tuple] = []

    def load(rows: np.ndarray, centre: np.ndarray | None) -> int:
        page = len(pages)
        pages.append(())
        dist = np.linalg.norm(objects[rows] - centre, axis=1) if centre is not None else np.zeros(len(rows))
        if len(rows) <= LEAF:
            pages[page] = (page, True, ids[rows], np.zeros(len(rows)), dist, objects[rows], whole[rows])
            return page
        chosen = rng.choice(len(rows), min(FANOUT, -(-len(rows) // LEAF) + 1), replace=False)
        routing = objects[rows[chosen]]
        to = np.stack([np.linalg.norm(objects[rows] - r, axis=1) for r in routing], 1)
        near = to.argmin(1)
        if np.bincount(near).max() > 0.9 * len(rows):  # hardly any structure: cut evenly
            near = np.arange(len(rows)) * len(routing) // len(rows)
        children, radius, parent, kept = [], [], [], []
        for k in range(len(routing)):
            own = near == k
            if own.any():
                children.append(load(rows[own], routing[k]))
                radius.append(to[own, k].max())
                parent.append(np.linalg.norm(routing[k] - centre) if centre is not None else 0.0)
                kept.append(routing[k])
        pages[page] = (page, False, np.array(children), np.array(radius), np.array(parent), np.array(kept), whole[:0])
        return page

    if len(ids):
        load(np.arange(len(ids)), None)
    return pages


def search(pages: dict[int, tuple], v: np.ndarray, own: int, k: int, top2: float, floor_score: int | None) -> list[tuple[int, int]]:
    """Up to k (score, vec_id), best first, of at least floor_score; v and own are the query's integers and id.

    pages: page -> (leaf, ids, radius, parent distance, objects, integer vectors).
    """
    q = v.astype(np.float64)
    lifted = np.append(q, 0.0)
    qq = float(q @ q)
    lowest = np.iinfo(np.int64).min if floor_score is None else floor_score
    best: list[tuple[int, int]] = []  # a heap whose first is the worst: (score, -id)
    slack = 1e-6 * (np.sqrt(qq + top2) + 1)

    def reach() -> float:
        """Objects beyond this distance score less than what is asked for."""
        least = max(lowest, best[0][0]) if len(best) == k else floor_score
        return np.inf if least is None else float(np.sqrt(max(0.0, qq + top2 - 2 * least))) + slack

    queue: list[tuple[float, int, float]] = [(0.0, 0, np.nan)]
    while queue:
        bound, page, to_parent = heapq.heappop(queue)
        limit = reach()
        if bound > limit:
            break
        leaf, ids, radius, parent, objects, whole = pages[page]
        some = np.arange(len(ids))
        if to_parent == to_parent:
            some = some[np.abs(to_parent - parent) - radius <= limit]
        if not len(some):
            continue
        if leaf:
            score = whole[some] @ v  # modulo 2^64, so exact if the sum fits
            at = np.flatnonzero(score >= (max(lowest, best[0][0]) if len(best) == k else lowest))
            for s, i in zip(score[at].tolist(), ids[some[at]].tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        else:
            dist = np.linalg.norm(objects[some] - lifted, axis=1)
            low = np.maximum(0.0, dist - radius[some])
            for j in np.flatnonzero(low <= limit):
                heapq.heappush(queue, (float(low[j]), int(ids[some[j]]), float(dist[j])))
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _pages(frame: pd.DataFrame, dim: int) -> dict[int, tuple]:
    return {
        int(p): (bool(leaf), np.asarray(ids, dtype=np.int64), np.asarray(r), np.asarray(d), np.asarray(v).reshape(-1, dim), np.asarray(w, dtype=np.int64).reshape(-1, dim - 1))
        for p, leaf, ids, r, d, v, w in zip(*(frame[c] for c in ("page", "leaf", "ids", "radius", "parent", "vectors", "whole")), strict=True)
    }


def top_k(vectors: DataFrame, queries: str, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row that the SQL condition queries selects."""
    spark = vectors.sparkSession
    rows = materialize(scaled(vectors, id_col, vec_col, scale), "vectors")
    got = rows.agg(F.count("*").alias("n"), F.max("norm2").alias("top2"), F.max(F.size("v")).alias("dim")).first()
    n, top2, dim = got["n"], float(got["top2"] or 0.0), int(got["dim"] or 0)
    wide = dim + 1
    # equal vectors: k rows of each id and the k + 1 smallest ids, first within salted parts
    objects = rows.selectExpr("vec_id", "v", "row_number() OVER (PARTITION BY v, vec_id ORDER BY vec_id) AS r").where(f"r <= {k}")
    objects = objects.selectExpr("vec_id", "v", "dense_rank() OVER (PARTITION BY v, pmod(xxhash64(vec_id), 64) ORDER BY vec_id) AS r").where(f"r <= {k + 1}")
    objects = objects.selectExpr("vec_id", "v", "dense_rank() OVER (PARTITION BY v ORDER BY vec_id) AS r").where(f"r <= {k + 1}").select("vec_id", "v")
    pivots = objects.orderBy(F.xxhash64(F.lit(13), "vec_id"), "vec_id").limit(max(1, min(PIVOTS, n // CELL_ROWS))).select("v").toArrow().column("v").to_pylist()
    centre = spark.sparkContext.broadcast(lift(_matrix(pivots, dim), top2))  # PIVOTS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = lift(_matrix(batch.column(1).to_pylist(), dim), top2)
                near, least = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
                for j, c in enumerate(centre.value):
                    d = np.linalg.norm(x - c, axis=1)
                    near[d < least] = j
                    least = np.minimum(least, d)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype("i4")), pa.array(least)], ["vec_id", "v", "cell", "dist"])

    dealt = materialize(objects.mapInArrow(assign, "vec_id long, v array<long>, cell int, dist double"), "cells")
    cells = {r["cell"]: (r["n"], r["radius"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()}  # PIVOTS rows at most
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = {c: -(-m // SHARD) for c, (m, _) in cells.items()}
    first = dict(zip(sorted(shards), np.cumsum([0, *(shards[c] for c in sorted(shards))]).tolist(), strict=False))
    numbers = F.broadcast(spark.createDataFrame([(int(c), int(first[c]), int(shards[c])) for c in shards], "cell int, first int, shards int"))  # PIVOTS rows at most
    numbered = dealt.join(numbers, "cell").withColumn("shard", F.expr("first + cast(pmod(xxhash64(vec_id), shards) AS int)"))

    def load(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        pages = build(frame["vec_id"].to_numpy(), lift(_matrix(frame["v"], dim), top2), _matrix(frame["v"], dim, np.int64))
        shard = int(frame["shard"].iloc[0])
        return pd.DataFrame([(shard, p, leaf, i.tolist(), r.tolist(), d.tolist(), v.ravel().tolist(), w.ravel().tolist()) for p, leaf, i, r, d, v, w in pages], columns=["shard", "page", "leaf", "ids", "radius", "parent", "vectors", "whole"])

    index = materialize(numbered.select("shard", "vec_id", "v").groupBy("shard").applyInPandas(load, f"shard int, {PAGE}"), "mtree")

    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "v").distinct()

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            pages = _pages(left, wide)
            for q, v, least in zip(right["query_id"], right["v"], right["least"], strict=True):
                vec = np.zeros(dim, dtype=np.int64)
                vec[: len(v)] = v
                out += [(q, v, i, s) for s, i in search(pages, vec, int(q), k, top2, None if least == none else int(least))]
        return pd.DataFrame(out, columns=["query_id", "v", "vec_id", "score"])

    result = "query_id long, v array<long>, vec_id long, score long"
    none = -(1 << 63)  # stands for no bound yet

    def route(batches: Iterator[pa.RecordBatch], home: bool) -> Iterator[pa.RecordBatch]:
        """One row for each query and shard to be searched: the home shard, or all others that may still matter."""
        order = np.array(sorted(cells))
        radius = np.array([cells[c][1] for c in order])
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _matrix(batch.column(1).to_pylist(), dim)
            q = np.concatenate([raw, np.zeros((len(raw), 1))], 1)
            dist = np.stack([np.linalg.norm(q - centre.value[c], axis=1) for c in order], 1)
            start = np.array([first[order[j]] for j in dist.argmin(1)])
            least = np.full(len(raw), none) if home else batch.column(2).to_numpy()
            row, shard = [], []
            for i in range(len(raw)):
                if home:
                    row.append(i)
                    shard.append(start[i])
                    continue
                bound = (raw[i] @ raw[i] + top2 - np.maximum(0.0, dist[i] - radius) ** 2) / 2
                for j in np.flatnonzero((least[i] == none) | (bound + 1e-6 * (top2 + 1) >= float(least[i]))):
                    for s in range(first[order[j]], first[order[j]] + shards[order[j]]):
                        if s != start[i]:
                            row.append(i)
                            shard.append(s)
            at = pa.array(np.array(row, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(least[row] if row else least[:0]), pa.array(np.array(shard, dtype=np.int32))], ["query_id", "v", "least", "shard"])

    def visits(routed: DataFrame) -> DataFrame:
        blocks = routed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
        # pages of a shard go to the blocks that have a query for it
        needed = blocks.select("shard", F.col("block").alias("b")).distinct()
        spread = index.join(needed, "shard")
        return spread.groupBy("shard", "b").cogroup(blocks.withColumnRenamed("shard", "at_shard").groupBy("at_shard", "block")).applyInPandas(visit, result)

    n_blocks = max(1, -(-asked.count() // BLOCK))
    routed_schema = "query_id long, v array<long>, least long, shard int"
    near = materialize(visits(asked.mapInArrow(lambda b: route(b, True), routed_schema)), "home")
    bounds = near.groupBy("query_id", "v").agg(F.count("*").alias("found"), F.min("score").alias("least")).where(f"found = {k}")
    rest = asked.join(bounds, ["query_id", "v"], "left").select("query_id", "v", F.coalesce("least", F.lit(none)).alias("least"))
    far = visits(rest.mapInArrow(lambda b: route(b, False), routed_schema))
    merged = near.unionByName(far).selectExpr("query_id", "vec_id", "score", "row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank").where(f"rank <= {k}")
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
