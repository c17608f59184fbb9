"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a text (``FEATURES``): densities of a lexicon, closeness of lexicon
hits to second-person words, capitals, punctuation and obfuscation rates.  The
lexicon holds a few fixed seed words, and words and word beginnings that the
training rows show to be typical of toxic texts.  Labels, language, source and
id are never features.

Fitting uses at most ``max_train`` labelled rows (the first ones by a hash of
the id); four fifths of them fit lexicon and trees, the rest the calibration.
Scoring reads every row and whole texts.

Null and empty texts get the score that the features of an empty text have.
Labels that are null or whose document is missing are left out; with fewer than
``MIN_ROWS`` usable labels, or labels of one kind only, the score is the smoothed
share of toxic labels.  Rows are scored one by one: repeated rows give repeated
results, and further columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, text_filter

#: Labelled rows that the classifier is fitted on, at most.
MAX_TRAIN = 20_000
MIN_ROWS = 20
#: Entries of the learned lexicon, at most.
MAX_LEXICON = 600
#: Insults that open the lexicon.
SEED_WORDS = frozenset("idiot moron stupid scum trash loser worthless pathetic disgusting clown bastard bitch asshole dumbass retard filth vermin".split())
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton vous votre tú ti usted ustedes vosotros".split())
#: Characters that stand for letters in obfuscated words.
LEET = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"\w+")
_OBFUSCATED = re.compile(r"[A-Za-z][0-9@$!*#.\-]+[A-Za-z]")
_RUN = re.compile(r"(\w)\1\1")
PREFIX = range(4, 9)

FEATURES = (
    "lexicon_density", "lexicon_hits", "lexicon_distinct", "lexicon_weight", "lexicon_window", "second_person", "proximity",
    "capitals", "capital_words", "punctuation", "exclamation", "symbols", "digits", "obfuscated", "runs", "word_length", "words",
)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_PUNCT = np.isin(_BYTES, list(b".,;:!?'\"()-"))
_SYMBOL = np.isin(_BYTES, list(b"*#$%&@^~|<>{}[]=+_/\\"))


def lexicon_features(text: str) -> set[str]:
    """What may enter the lexicon: words, and word beginnings marked by a star."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w)
        for k in PREFIX:
            if len(w) > k:
                out.add(w[:k] + "*")
    return out


def _hit(word: str, lexicon: dict[str, float]) -> float:
    best = lexicon.get(word, 0.0)
    for k in PREFIX:
        if len(word) > k:
            best = max(best, lexicon.get(word[:k] + "*", 0.0))
    return best


class Scorer:
    """Features of texts under one lexicon; remembers the words it has met, up to a bound."""

    def __init__(self, lexicon: dict[str, float], bound: int = 300_000):
        self.lexicon, self.bound, self.known = lexicon, bound, {}

    def weight(self, raw: str) -> tuple[float, bool, bool, bool]:
        """(lexicon weight, second person, capitals, obfuscated) of a blank-free chunk."""
        got = self.known.get(raw)
        if got is None:
            low = raw.lower()
            words = _WORD.findall(low)
            weight = max((_hit(w, self.lexicon) for w in words), default=0.0)
            odd = bool(_OBFUSCATED.search(raw))
            if odd and not weight:
                plain = re.sub(r"[^a-z]", "", low.translate(LEET))
                weight = _hit(plain, self.lexicon)
            got = (weight, any(w in SECOND_PERSON for w in words), len(raw) > 2 and raw.isupper(), odd)
            if len(self.known) >= self.bound:
                self.known.clear()
            self.known[raw] = got
        return got

    def features(self, text: str) -> list[float]:
        chunks = text.split()
        n = len(chunks)
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype="u1")
        counts = np.bincount(raw, minlength=256)
        size = max(1, len(raw))
        hits, you, caps, odd = [], [], 0, 0
        weight = 0.0
        distinct = set()
        for i, c in enumerate(chunks):
            w, second, upper, strange = self.weight(c)
            if w:
                hits.append(i)
                weight += w
                distinct.add(c)
            if second:
                you.append(i)
            caps += upper
            odd += strange
        window = near = 0.0
        if hits:
            at = np.array(hits)
            window = float(np.max(np.searchsorted(at, at + 50) - np.arange(len(at))))
            if you:
                pos = np.array(you)
                right = np.searchsorted(pos, at)
                gap = np.minimum(np.abs(pos[np.minimum(right, len(pos) - 1)] - at), np.abs(pos[np.maximum(right - 1, 0)] - at))
                near = float(np.exp(-gap / 8.0).max())
        per = max(1, n)
        return [
            len(hits) / per, math.log1p(len(hits)), float(len(distinct)), weight / per, window, len(you) / per, near,
            counts[_UPPER].sum() / size, caps / per, counts[_PUNCT].sum() / size, counts[33] / size, counts[_SYMBOL].sum() / size,
            counts[_DIGIT].sum() / size, odd / per, len(_RUN.findall(text)) / per, size / per, math.log1p(n),
        ]


@dataclass
class Trees:
    """Boosted regression trees of a fixed depth on quantile bins, logistic loss."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    l2: float = 2.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = math.log(share / (1 - share))
        raw = np.full(len(y), self.base)
        n_feat, inner = x.shape[1], 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=int)
            feat, cut = np.zeros(inner, dtype=int), np.full(inner, np.inf)
            cut_bin = np.full(inner, self.bins + 1)
            for level in range(self.depth):
                first = 2**level - 1
                width = 2**level
                best = np.zeros(width)
                for f in range(n_feat):
                    slot = (node - first) * (self.bins + 1) + binned[:, f]
                    gs = np.bincount(slot, g, width * (self.bins + 1)).reshape(width, -1)
                    hs = np.bincount(slot, h, width * (self.bins + 1)).reshape(width, -1)
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl < 1) | (ht - hl < 1)] = 0
                    at = gain.argmax(1)
                    for k in range(width):
                        if gain[k, at[k]] > best[k] + 1e-9 and at[k] < len(edges[f]):
                            best[k] = gain[k, at[k]]
                            feat[first + k], cut[first + k], cut_bin[first + k] = f, edges[f][at[k]], at[k]
                node = 2 * node + 1 + (binned[np.arange(len(y)), feat[node]] > cut_bin[node])
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            value = self.rate * gs / (hs + self.l2)
            raw += value[leaf]
            self.trees.append((feat, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feat, cut, value in self.trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feat[node]] > cut[node])
            out += value[node - len(feat)]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the middle of every block and its share of labels 1, between 0 and 1.  Between them values are interpolated."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for x, v in zip(raw[order], y[order], strict=True):
        blocks.append([v, 1.0, x, x])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    xs = [(lo + hi) / 2 for _, _, lo, hi in blocks]
    ys = [(s + 0.05) / (n + 0.1) for s, n, _, _ in blocks]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        return np.interp(self.trees.raw(x), *self.knots)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold: int, max_train: int) -> DataFrame:
    """doc_id, text, label, part (0..9) of at most max_train labelled documents outside the held-out fold.

    The documents are chosen before the join, so what is broadcast is bounded by
    max_train; labels without a document do not count.  A document labelled twice has
    its larger label, and of repeated ids the least text.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (crc_mod("doc_id", fold) != 0))
        .groupBy("doc_id").agg(F.max("label").alias("label")).join(ids, "doc_id", "left_semi")
        .orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(max_train)
    )
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows.withColumn("part", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(10)).cast("int"))


def learn_lexicon(rows: DataFrame, max_entries: int = MAX_LEXICON) -> dict[str, float]:
    """Seed words, and features whose share among toxic rows is far above that among others."""

    def count(batch: pa.RecordBatch) -> dict:
        found: dict[str, list[int]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for f in lexicon_features(text):
                found.setdefault(f, [0, 0])[int(label > 0)] += 1
        return {"feature": list(found), "clean": [v[0] for v in found.values()], "toxic": [v[1] for v in found.values()]}

    totals = rows.agg(F.sum((F.col("label") > 0).cast("long")).alias("t"), F.count("*").alias("n")).first()
    toxic, clean = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)
    out = {w: 3.0 for w in SEED_WORDS}
    if not toxic or not clean:
        return out
    least = max(6, toxic // 150)  # rarer ones are too often typical by chance
    counted = (
        map_batches(rows.select("text", "label"), count, "feature string, clean long, toxic long")
        .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= least)
        .withColumn("odds", F.log(((F.col("toxic")) / toxic) / ((F.col("clean") + 0.5) / clean)))
        .where("odds > 2.5").orderBy(F.col("odds").desc(), "feature").limit(max_entries)
    )
    out.update({r["feature"]: float(r["odds"]) for r in counted.collect()})
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 5, max_train: int = MAX_TRAIN) -> Model:
    rows = training_rows(docs, labels, label, fold, max_train)
    lexicon = learn_lexicon(rows.where("part < 8"))
    scorer = Scorer(lexicon)

    def run(batch: pa.RecordBatch) -> dict:
        return {"x": [scorer.features(t) for t in batch.column(0).to_pylist()], "label": batch.column(1), "part": batch.column(2), "doc_id": batch.column(3)}

    got = map_batches(rows.select("text", "label", "part", "doc_id"), run, "x array<double>, label int, part int, doc_id long").toPandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")  # the same model whatever order the tasks end in
    y = (got["label"].to_numpy() > 0).astype(float)
    share = float((y.sum() + 0.5) / (len(y) + 1))
    if len(y) < MIN_ROWS or y.min() == y.max():
        return Model(lexicon, None, None, share)
    x, part = np.array(got["x"].tolist()), got["part"].to_numpy()
    if len(set(y[part < 8])) < 2:
        return Model(lexicon, None, None, share)
    trees = Trees().fit(x[part < 8], y[part < 8])
    held = part >= 8
    if len(set(y[held])) < 2:  # hardly any labels: the rows of the trees calibrate as well
        held[:] = True
    return Model(lexicon, trees, isotonic(trees.raw(x[held]), y[held]), share)


def score_documents(docs: DataFrame, model: Model, fold: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # trees and lexicon: bounded by the parameters above

    cache: dict = {}

    def run(batch: pa.RecordBatch) -> dict:
        if "scorer" not in cache:
            cache["scorer"] = Scorer(sent.value.lexicon)
        score = sent.value.score(np.array([cache["scorer"].features(t or "") for t in batch.column(1).to_pylist()]))
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": score, "predicted": (score >= 0.5).astype("i4")}

    cols = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).withColumn("held_out", F.coalesce(crc_mod("doc_id", fold) == 0, F.lit(False)))
    return map_batches(cols, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all its columns, without the rows that score 0.5 or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict = {}

    def clean(texts: list[str | None]) -> list[bool]:
        if "scorer" not in cache:
            cache["scorer"] = Scorer(sent.value.lexicon)
        return (sent.value.score(np.array([cache["scorer"].features(t or "") for t in texts])) < 0.5).tolist()

    return text_filter(docs, clean)
