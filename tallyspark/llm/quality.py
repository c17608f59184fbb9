"""Quality classifier: ordinal cumulative-link regression on hashed text.

P(grade > k) = sigmoid(w.x - theta_k) with one weight vector w for all grades and
ordered thresholds theta_0 <= theta_1 ...  x is the whole text as hashed counts:
words, word shapes (capitals, marks, digits) and repeats of the preceding word,
each block of unit length.  The result is an expected grade and the tail
probabilities, which selection compares with a cut.

Grades come from ``labels``: 0 for quality 0; quality 1 is graded 1 if it is
marked toxic and 2 if not.  Training uses at most ``max_train`` labelled rows (the
first by a hash of the id) outside the held-out fold; every row is scored.  Their
features are a table; the likelihood is maximized by L-BFGS, whose every step sums
the gradients of the tasks, so the driver holds vectors of fixed size only.

Null texts count as empty; an empty text has no features and gets the grade of
the thresholds alone.  Labels that are null or without a document are left out;
without two different grades all rows get the smoothed mean.  Repeated rows give
repeated results, further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, map_batches, materialize, slices, text_filter
from .toxicity import MAX_TRAIN, training_rows

#: Hashed dimensions of each block: words, shapes.
WORD_DIMS, SHAPE_DIMS = 1 << 15, 1 << 10
EXTRA = 4
DIMS = WORD_DIMS + SHAPE_DIMS + EXTRA
#: Tasks of a gradient, most gradients of a fit, remembered steps, penalty of the weights.
TASKS, EVALUATIONS, MEMORY, L2 = 8, 40, 8, 1e-4
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def shape(chunk: str) -> str:
    """A chunk with runs of letters and digits folded; other characters stay."""
    chunk = _LETTERS.sub(lambda m: "U" if len(m[0]) > 1 and m[0].isupper() else "a", chunk)
    return _DIGITS.sub("0", chunk)[:12]


class Hasher:
    """Sparse features of texts; remembers the chunks it has met, up to a bound."""

    def __init__(self, bound: int = 300_000):
        self.bound, self.known = bound, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        known, words, shapes, repeats, last = self.known, [], [], 0, None
        for c in text.split():
            got = known.get(c)
            if got is None:
                if len(known) >= self.bound:
                    known.clear()
                got = known[c] = (xxhash.xxh3_64_intdigest(c.lower()) % WORD_DIMS, WORD_DIMS + xxhash.xxh3_64_intdigest(shape(c)) % SHAPE_DIMS)
            words.append(got[0])
            shapes.append(got[1])
            repeats += c == last
            last = c
        if not words:
            return np.zeros(0, dtype=int), np.zeros(0)
        w, wn = np.unique(np.array(words), return_counts=True)
        s, sn = np.unique(np.array(shapes), return_counts=True)
        wv, sv = np.sqrt(wn), np.sqrt(sn)
        n = len(words)
        extra = np.array([repeats / n, len(w) / n, np.log1p(n) / 10, (text.count("\n") + 1) / n])
        return np.concatenate([w, s, np.arange(DIMS - EXTRA, DIMS)]), np.concatenate([wv / np.linalg.norm(wv), sv / np.linalg.norm(sv), extra])


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - float(self.weights[at] @ value), -40, 40)))


def loss_and_gradient(weights: np.ndarray, theta: np.ndarray, at: np.ndarray, value: np.ndarray, row: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log likelihood of the rows, and its gradient by weights and thresholds; entry i of the rows belongs to row[i]."""
    top = len(theta)
    z = np.bincount(row, value * weights[at], len(grades))
    # likelihood of grade g: s(z - theta_{g-1}) - s(z - theta_g), with s = 1 below the first and 0 above the last
    low = np.concatenate([[-np.inf], theta])[grades]
    high = np.concatenate([theta, [np.inf]])[grades]
    a = 1 / (1 + np.exp(np.clip(low - z, -40, 40)))
    b = 1 / (1 + np.exp(np.clip(high - z, -40, 40)))
    b[grades == top] = 0
    a[grades == 0] = 1
    p = np.maximum(a - b, 1e-12)
    da, db = a * (1 - a) / p, b * (1 - b) / p
    by_weight = np.bincount(at, value * (db - da)[row], len(weights))
    by_theta = [da[grades == k + 1].sum() - db[grades == k].sum() for k in range(top)]
    return float(-np.log(p).sum()), np.concatenate([by_weight, by_theta])


def minimize(evaluate, start: np.ndarray, most: int = EVALUATIONS, tolerance: float = 1e-5) -> np.ndarray:
    """L-BFGS with halved steps; evaluate(x) gives (value, gradient) and is called ``most`` times at most."""
    x, (f, g) = start, evaluate(start)
    calls, steps = 1, []
    while calls < most and np.abs(g).max() > 1e-7:
        d, kept = g.copy(), []
        for s, y in reversed(steps):
            kept.append(s @ d / (s @ y))
            d -= kept[-1] * y
        if steps:
            d *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, y), k in zip(steps, reversed(kept), strict=True):
            d += (k - y @ d / (s @ y)) * s
        size = 1.0 if steps else 1 / max(1e-12, np.linalg.norm(g))
        slope = g @ d
        while calls < most:
            new = x - size * d
            f2, g2 = evaluate(new)
            calls += 1
            if f2 <= f - 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
        done = f - f2 < tolerance * max(1e-3, abs(f))
        x, f, g = new, f2, g2
        if done and len(steps) > 1:
            return x
    return x


def fit_ordinal(features: DataFrame, top: int) -> Model:
    """Maximum likelihood over the rows (at, value, grade) of features."""
    counts = {r["grade"]: r["n"] for r in features.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # top + 1 rows
    n = sum(counts.values())
    above = np.array([sum(c for g, c in counts.items() if g > k) for k in range(top)])
    shares = (above + 0.5) / (n + 1)
    theta = np.maximum.accumulate(-np.log(shares / (1 - shares)))
    if len(counts) < 2:
        return Model(np.zeros(DIMS), theta)
    table = features.coalesce(TASKS)

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        if (np.diff(x[DIMS:]) < 0).any():  # thresholds out of order are no model
            return np.inf, np.zeros(len(x))
        sent = features.sparkSession.sparkContext.broadcast(x)

        def run(batches):
            loss, total = 0.0, np.zeros(DIMS + top)
            for batch in slices(batches):
                size = np.diff(batch.column(0).offsets.to_numpy())
                part, g = loss_and_gradient(sent.value[:DIMS], sent.value[DIMS:], batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), np.repeat(np.arange(len(size)), size), batch.column(2).to_numpy())
                loss, total = loss + part, total + g
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["part", "loss", "gradient"])

        got = sorted(table.mapInArrow(run, "part int, loss double, gradient binary").collect(), key=lambda r: r["part"])  # TASKS rows at most
        sent.destroy()
        w = x[:DIMS]
        total = sum(np.frombuffer(r["gradient"]) for r in got) / n
        return sum(r["loss"] for r in got) / n + L2 / 2 * float(w @ w), total + np.concatenate([L2 * w, np.zeros(top)])

    best = minimize(evaluate, np.concatenate([np.zeros(DIMS), theta]))
    return Model(best[:DIMS], best[DIMS:])


def fit(docs: DataFrame, ratings: DataFrame, top: int, fold: int = 5, max_train: int = MAX_TRAIN) -> Model:
    """ratings: doc_id, grade (0 .. top)."""
    rows = training_rows(docs, ratings, "grade", fold, max_train)
    hasher = Hasher()

    def run(batch: pa.RecordBatch) -> dict:
        got = [hasher(t) for t in batch.column(0).to_pylist()]
        return {"at": [x[0].astype("i4") for x in got], "value": [x[1].astype("f4") for x in got], "grade": np.clip(batch.column(1).to_numpy(), 0, top)}

    features = materialize(map_batches(rows.select("text", "label"), run, "at array<int>, value array<float>, grade int"), "quality")
    model = fit_ordinal(features, top)
    discard(features)
    return model


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade 0..2 from quality and toxic."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") > 0, F.when(F.col("toxic") == 1, 1).otherwise(2)).alias("grade"))


def score_documents(docs: DataFrame, model: Model, cut: float = 0.5, fold: int = 5) -> DataFrame:
    """doc_id, held_out, expected_grade, p_above (array), keep: P(grade > 0) >= cut."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights: a fixed size
    hasher = Hasher()

    def run(batch: pa.RecordBatch) -> dict:
        p = [sent.value.tails(*hasher(t or "")) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "expected_grade": [float(x.sum()) for x in p], "p_above": p, "keep": [bool(x[0] >= cut) for x in p]}

    cols = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).withColumn("held_out", F.coalesce(crc_mod("doc_id", fold) == 0, F.lit(False)))
    return map_batches(cols, run, "doc_id long, held_out boolean, expected_grade double, p_above array<double>, keep boolean")


def keep_good(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """docs, all its columns, with the rows whose P(grade > 0) reaches cut."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    hasher = Hasher()
    return text_filter(docs, lambda texts: [bool(sent.value.tails(*hasher(t or ""))[0] >= cut) for t in texts])
