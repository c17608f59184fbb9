"""Language-model scoring with a causal self-attention model trained in numpy.

Tokens are words (lower case, between white space) and one end for each text.  The
model reads each word as a subword id, the longest entry of a public byte-level
vocabulary that begins it, and
predicts p(class of the next word's subword id | context) * p(word | class).  The most
frequent subword ids are classes of their own, the others are clustered by what
precedes them.  The class distribution is a softmax over bigram logits of the
preceding class plus the output of causal self-attention over ``WINDOW`` preceding
subword ids, taken in two levels, ``GROUPS`` of classes and the classes of a group;
p(word | class) comes from word counts, with one more added to each word of the class
and to one unknown word.

Windows overlap: each token is scored once, and after the first window it has at
least ``WINDOW - STRIDE`` tokens before it.  Windows of many texts go through masked
attention as one batch.

Texts are read once, into a table that counts, pages and scores come from.
Everything is learned from all training documents.  Their subword ids are written
once as pages of about ``PAGE_TOKENS`` tokens, dealt by a hash of id and text.  Classes
come from counts over all pages; attention is trained in ``EPOCHS`` distributed passes
over all windows: each page starts from the same weights, goes over its own windows
with Adam, and weights and moments are averaged by the number of targets.  A task takes
``LANES`` pages side by side.

The base is a word unigram with add-one smoothing.  The word counts are a
distributed table.  The ``HOT_WORDS`` most frequent words are broadcast; every other
word of a document is joined with the table, so hot words are no hot keys and no
word is left out.

Null texts count as empty and consist of the end alone.  Rows are scored one by
one, so repeated rows and ids give repeated results; rows with a null id are
training rows.  Without training documents all counts are zero and the model is
uniform.  Further columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import crc_mod, discard, materialize, slices

FOLD, HELD = 7, 2
#: Training passes, tokens of a page (documents are not split), and training documents of a partition of pages.
EPOCHS, PAGE_TOKENS, PART_DOCS = 4, 400_000, 3000
#: Pages of an Arrow batch; a page has about 2 bytes for a token.
PAGE_BATCH = 16
#: Words with counts that a task adds up at once, and words of the corpus for each range of hashes.
MERGED, RANGE_WORDS = 1 << 20, 4_000_000
#: Most frequent words that are broadcast with their counts.
HOT_WORDS = 1 << 18
SINGLES, CLUSTERS = 144, 47
CLASSES = SINGLES + CLUSTERS + 1
#: Classes of a group of the two-level softmax.
GROUP = 24
GROUPS = CLASSES // GROUP
#: Symbols that are no class of a word: the end, the start, and what fills a window in front of the start, which no place sees.
END, START, PAD = 0, CLASSES, CLASSES + 1
HEADS, DIM = 2, 8
WIDTH = HEADS * DIM
WINDOW, STRIDE = 32, 24
#: Pages that a task trains side by side, each with weights of its own, and places of a block with targets of one group.
LANES, BLOCK = 2, 64
#: Ids of the subword vocabulary, and the longest entry that is looked up, in bytes.
VOCAB, LONGEST = 50_257, 16
LN10 = np.log(10.0)


class Attention:
    """One layer of causal self-attention over class symbols, with relative positions.

    The softmax over classes has two levels, GROUPS of classes and the classes of a group; both
    start from the same bigram logits, so that without attention it is the bigram softmax.
    """

    def __init__(self, bigram: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bigram = bigram.astype(np.float32)  # (CLASSES + 1, CLASSES) logits
        draw = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.w = {
            "q": draw(HEADS, CLASSES + 1, DIM), "k": draw(HEADS, CLASSES + 1, DIM), "v": draw(HEADS, CLASSES + 1, DIM),
            "pos": np.zeros((HEADS, WINDOW), dtype=np.float32), "out": draw(HEADS * DIM, CLASSES) * 0.1, "bias": np.zeros(CLASSES, dtype=np.float32),
        }
        self.w["pos"][0] = -0.5 * np.arange(WINDOW)  # one head starts out local, the other global
        self.w["group"], self.w["group_bias"] = draw(HEADS * DIM, GROUPS) * 0.1, np.zeros(GROUPS, dtype=np.float32)

    def _starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Logits of classes and of groups by the symbol before, without what is learned."""
        if getattr(self, "_of", None) is not self.bigram:
            top = self.bigram.max(1, keepdims=True)
            groups = np.exp((self.bigram - top).astype(np.float64)).reshape(-1, GROUPS, GROUP).sum(2)
            self._of, self._groups = self.bigram, (np.log(np.maximum(groups, 1e-300)) + top).astype(self.bigram.dtype)
        return self.bigram, self._groups

    def log_probabilities(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Natural log of p(y | x up to its place) where scored, in row order."""
        lead = int(scored.any(0).argmax())
        w, x, y = {k: v[None] for k, v in self.w.items()}, x[None], y[None, :, lead:]
        a, _ = _attend(w, x, lead)
        upper, lower, (group, target, into, *_), _ = _predict(w, *self._starts(), a, x[:, :, lead:], y)
        out = np.zeros(len(group))
        for logits, at in ((upper, np.arange(len(group)) * GROUPS + group), (lower, into * GROUP + target)):
            total = _exp(logits)
            out += np.log(logits.ravel().take(at).astype(np.float64) / total.take(at // logits.shape[1]))
        return out[scored[:, lead:].ravel()]

    def start(self) -> None:
        """Adam's moments and number of steps, before the first pass."""
        self.m = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.u = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.step = 0.0

    def state(self) -> np.ndarray:
        """Weights, moments and number of steps as one vector, which can be averaged."""
        return np.concatenate([*(v.ravel() for part in (self.w, self.m, self.u) for v in part.values()), [self.step]]).astype(np.float64)

    def restore(self, state: np.ndarray) -> None:
        at = 0
        for part in (self.w, self.m, self.u):
            for k, v in part.items():
                part[k] = state[at : at + v.size].reshape(v.shape).astype(v.dtype)
                at += v.size
        self.step = float(state[at])

    def train(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray, epoch: int = 0) -> None:
        """One of EPOCHS passes of Adam over mini-batches of windows; the bigram logits stay as they are."""
        train_lanes([self], [(x, y, scored)], epoch)

    def _gradients(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray, gap: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Gradients of the mean loss of the places that count."""
        w = {k: v[None] for k, v in self.w.items()}
        g = {k: np.empty_like(v) for k, v in w.items()}
        _gradients(w, g, *self._starts(), x[None], y[None], scored[None])
        return {k: v[0] for k, v in g.items()}


def train_lanes(lanes: list[Attention], data: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epoch: int, batch: int = 64, rate: float = 0.02) -> None:
    """The pass of each lane over windows of its own: inputs, targets, places that count.

    Lanes have the same bigram logits, and learn nothing from each other; side by side they only share
    the calls.  A lane's last batch is filled up with windows where no place counts.
    """
    by_size = sorted(range(len(lanes)), key=lambda k: -len(data[k][0]))
    lanes, data = [lanes[k] for k in by_size], [data[k] for k in by_size]
    sizes = [len(x) for x, _, _ in data]
    data = [tuple(part[order] for part in own) for own in data for order in [np.random.default_rng((11, epoch)).permutation(len(own[0]))]]
    w, m, u = (np.stack([np.concatenate([v.ravel() for v in getattr(own, part).values()]) for own in lanes]) for part in ("w", "m", "u"))
    for k, own in enumerate(lanes):
        own.w, own.m, own.u = _views(w[k], own.w), _views(m[k], own.m), _views(u[k], own.u)
    grown = np.empty_like(w)
    bigram, groups = lanes[0]._starts()
    for at in range(0, max(sizes, default=0), batch):
        live = sum(n > at for n in sizes)
        x = np.full((live, min(batch, sizes[0] - at), WINDOW), START, dtype=np.int16)
        y, scored = np.zeros_like(x), np.zeros(x.shape, dtype=bool)
        for k in range(live):
            for whole, part in zip((x, y, scored), data[k], strict=True):
                whole[k, : sizes[k] - at] = part[at : at + batch]
        now = np.empty((live, 1), dtype=w.dtype)
        for k, own in enumerate(lanes[:live]):
            fix = (1 - 0.99 ** (own.step + 1)) ** 0.5 / (1 - 0.9 ** (own.step + 1))
            now[k] = rate * (1 - (epoch + at / sizes[k]) / EPOCHS) * fix
            own.step += 1
        g, mean, square = grown[:live], m[:live], u[:live]
        like = lanes[0].w
        _gradients(_views(w[:live], like), _views(g, like), bigram, groups, x, y, scored)
        mean += np.float32(0.1) * (g - mean)
        g *= g
        g -= square
        g *= np.float32(0.01)
        square += g
        np.sqrt(square, out=g)
        g += np.float32(1e-7)
        np.divide(mean, g, out=g)
        g *= now
        w[:live] -= g


@lru_cache(8)
def _distances(lead: int, places: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of a place from lead on and any place: how far it looks back, WINDOW for later places, and that as 0 and 1 by column."""
    gap = (np.arange(lead, places)[:, None] - np.arange(places)[None, :]).ravel()
    back = np.where(gap < 0, WINDOW, gap)
    return back, (back[:, None] == np.arange(WINDOW)).astype(dtype)


def _attend(w: dict[str, np.ndarray], x: np.ndarray, lead: int) -> tuple[np.ndarray, tuple]:
    """What the places from lead on see, (lanes * windows * places, WIDTH), and what the gradients need of it.

    PAD has neither value nor weight: its values and the one that sums the weights are zero.
    Where exp could overflow, the largest score of a place is taken off before.
    """
    n_lanes, n, t = x.shape
    dtype = w["v"].dtype
    queries = np.zeros((n_lanes, CLASSES + 2, HEADS, DIM), dtype=dtype)
    np.multiply(w["q"].transpose(0, 2, 1, 3), dtype.type(DIM**-0.5), out=queries[:, :-1])
    keys = np.zeros_like(queries)
    keys[:, :-1] = w["k"].transpose(0, 2, 1, 3)
    values = np.zeros((n_lanes, CLASSES + 2, HEADS, DIM + 1), dtype=dtype)
    values[:, :-1, :, :DIM] = w["v"].transpose(0, 2, 1, 3)
    values[:, :-1, :, DIM] = 1
    rows = (x + (np.arange(n_lanes) * (CLASSES + 2))[:, None, None]).reshape(-1, t)
    q, k, v = (part.reshape(-1, HEADS, part.shape[3]).take(at, 0) for part, at in ((queries, rows[:, lead:]), (keys, rows), (values, rows)))
    e = np.empty((n_lanes * n, HEADS, t - lead, t), dtype=dtype)
    for h in range(HEADS):
        np.matmul(q[:, :, h], k[:, :, h].transpose(0, 2, 1), out=e[:, h])
    back, _ = _distances(lead, t, dtype.char)
    by_lane = e.reshape(n_lanes, n, -1)
    if e.size and max(float(e.max()), -float(e.min())) + np.abs(w["pos"]).max() < 40:
        np.exp(e, out=e)
        by_lane *= np.concatenate([np.exp(w["pos"]), np.zeros((n_lanes, HEADS, 1), dtype=dtype)], 2).take(back, 2).reshape(n_lanes, 1, -1)
    else:
        by_lane += np.concatenate([w["pos"], np.full((n_lanes, HEADS, 1), -1e9, dtype=dtype)], 2).take(back, 2).reshape(n_lanes, 1, -1)
        np.copyto(e, dtype.type(-1e9), where=(x == PAD).reshape(-1, 1, 1, t))
        e -= e.max(3, keepdims=True, initial=-1e9)
        np.exp(e, out=e)
    o = np.empty((n_lanes * n, t - lead, HEADS, DIM + 1), dtype=dtype)
    for h in range(HEADS):
        np.matmul(e[:, h], v[:, :, h], out=o[:, :, h])
    share = (1 / np.maximum(o[..., DIM], np.finfo(dtype).tiny)).reshape(-1, HEADS) @ np.repeat(np.eye(HEADS, dtype=dtype), DIM, 1)
    return o[..., :DIM].reshape(-1, WIDTH) * share, (rows, q, k, v, e, share)


def _predict(w: dict[str, np.ndarray], bigram: np.ndarray, groups: np.ndarray, a: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
    """Logits of groups by place, and of the classes of the target's group by row: places of a lane and group lie in blocks, filled up with others.

    Also of each place its group, the target in it and its row, the place of each row, and a group of a lane for each block; and what the blocks see with its weights.
    """
    n_lanes = len(x)
    lane = np.arange(n_lanes)[:, None, None]
    before = (np.minimum(x, START) + lane * (CLASSES + 1)).ravel()
    group, target = (part.ravel() for part in np.divmod(y, GROUP))
    upper = (groups + w["group_bias"][:, None]).reshape(-1, GROUPS).take(before, 0)
    by_lane = upper.reshape(n_lanes, -1, GROUPS)
    by_lane += a.reshape(n_lanes, -1, WIDTH) @ w["group"]
    key = (y // GROUP + lane * GROUPS).ravel()
    order = np.argsort(key.astype(np.int16), kind="stable")
    counts = np.bincount(key, minlength=n_lanes * GROUPS)
    blocks = -(-counts // BLOCK)
    row = np.arange(len(key)) + ((np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(counts) - counts)).take(key.take(order))
    into, place = np.empty(len(key), dtype=np.intp), np.zeros(int(blocks.sum()) * BLOCK, dtype=np.intp)
    into[order], place[row] = row, order
    of = np.repeat(np.arange(len(blocks)), blocks)
    out = w["out"].reshape(n_lanes, WIDTH, GROUPS, GROUP).transpose(0, 2, 1, 3).reshape(-1, WIDTH, GROUP).take(of, 0)
    lower = (bigram + w["bias"][:, None]).reshape(-1, GROUP).take((before * GROUPS + group).take(place), 0)
    seen = a.take(place, 0).reshape(-1, BLOCK, WIDTH)
    by_block = lower.reshape(-1, BLOCK, GROUP)
    by_block += seen @ out
    return upper, lower, (group, target, into, place, of), (seen, out)


def _gradients(w: dict[str, np.ndarray], g: dict[str, np.ndarray], bigram: np.ndarray, groups: np.ndarray, x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> None:
    """Fills g with the gradients of each lane's mean loss."""
    n_lanes, n, t = x.shape
    lead = int(scored.any((0, 1)).argmax())
    a, (rows, q, k, v, e, share) = _attend(w, x, lead)
    upper, lower, (group, target, into, _, of), (seen, out) = _predict(w, bigram, groups, a, x[:, :, lead:], y[:, :, lead:])
    dtype = a.dtype
    weight = (scored[:, :, lead:] / np.maximum(1, scored.sum((1, 2)))[:, None, None]).astype(dtype).ravel()
    of_rows = np.zeros(len(lower), dtype=dtype)
    of_rows[into] = weight
    for logits, share_of, at in ((upper, weight, np.arange(len(group)) * GROUPS + group), (lower, of_rows, into * GROUP + target)):
        logits *= (share_of / _exp(logits))[:, None]
        logits.ravel()[at] -= weight
    upper, lower = upper.reshape(n_lanes, -1, GROUPS), lower.reshape(-1, BLOCK, GROUP)
    np.matmul(a.reshape(n_lanes, -1, WIDTH).transpose(0, 2, 1), upper, out=g["group"])
    g["group_bias"][:] = np.ones(upper.shape[1], dtype=dtype) @ upper
    blocks = np.empty((len(of), WIDTH + 1, GROUP), dtype=dtype)
    np.matmul(seen.transpose(0, 2, 1), lower, out=blocks[:, :WIDTH])
    np.matmul(np.ones((1, BLOCK), dtype=dtype), lower, out=blocks[:, WIDTH:])
    own = (of == np.arange(n_lanes * GROUPS)[:, None]).astype(dtype)
    by_group = (own @ blocks.reshape(len(of), -1)).reshape(n_lanes, GROUPS, WIDTH + 1, GROUP).transpose(0, 2, 1, 3)
    g["out"].reshape(n_lanes, WIDTH, GROUPS, GROUP)[:] = by_group[:, :WIDTH]
    g["bias"].reshape(n_lanes, GROUPS, GROUP)[:] = by_group[:, WIDTH]
    da = (lower @ out.transpose(0, 2, 1)).reshape(-1, WIDTH).take(into, 0)
    by_lane = da.reshape(n_lanes, -1, WIDTH)
    by_lane += upper @ w["group"].transpose(0, 2, 1)
    da *= share
    ds = np.empty((n_lanes * n, t - lead, HEADS, DIM + 1), dtype=dtype)
    ds[..., :DIM] = da.reshape(*ds.shape[:3], DIM)
    a *= da
    ds[..., DIM] = (a @ np.repeat(-np.eye(HEADS, dtype=dtype), DIM, 0)).reshape(ds.shape[:3])
    d = np.empty((n_lanes * n, t, 3, HEADS, DIM), dtype=dtype)  # of each place's query, key and value
    d[:, :lead, 0] = 0
    turn = np.empty_like(e)
    for h in range(HEADS):
        np.matmul(e[:, h].transpose(0, 2, 1), ds[:, :, h, :DIM], out=d[:, :, 2, h])
        np.matmul(ds[:, :, h], v[:, :, h].transpose(0, 2, 1), out=turn[:, h])
    e *= turn
    for h in range(HEADS):
        np.matmul(e[:, h], k[:, :, h], out=d[:, lead:, 0, h])
        np.matmul(e[:, h].transpose(0, 2, 1), q[:, :, h], out=d[:, :, 1, h])
    g["pos"][:] = (e.reshape(n_lanes, n, -1).sum(1).reshape(n_lanes * HEADS, -1) @ _distances(lead, t, dtype.char)[1]).reshape(g["pos"].shape)
    found = np.zeros((n_lanes * (CLASSES + 2), 3 * WIDTH), dtype=dtype)
    _add_rows(found, rows.ravel(), d.reshape(-1, 3 * WIDTH))
    found = found.reshape(n_lanes, CLASSES + 2, 3, HEADS, DIM)[:, :-1].transpose(2, 0, 3, 1, 4)
    np.multiply(found[0], dtype.type(DIM**-0.5), out=g["q"])
    g["k"][:], g["v"][:] = found[1], found[2]


def _add_rows(sums: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
    """Puts the sum of the rows of each key into the row of sums of that number; two columns are added as one complex number."""
    order = np.argsort(keys.astype(np.int16), kind="stable")
    counts = np.bincount(keys)
    present = np.flatnonzero(counts)
    pairs = rows.take(order, 0).view(np.result_type(rows.dtype, np.complex64))
    sums[present] = np.add.reduceat(pairs, (np.cumsum(counts) - counts)[present], axis=0).view(rows.dtype)


def _exp(logits: np.ndarray) -> np.ndarray:
    """Turns logits into their exp in place, less the largest of a row where that could matter; returns sums of rows."""
    if logits.size and (float(logits.max()) > 60 or float(logits.min()) < -60):
        logits -= logits.max(1)[:, None]
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], dtype=logits.dtype)


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parts of one vector, or of each row, in the shapes of like."""
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[..., at : at + v.size].reshape(*flat.shape[:-1], *v.shape)
        at += v.size
    return out


def windows(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets, which places count, and each window's text, for the class sequences of texts.

    A text of n ids has n + 1 targets, the last one END; every target counts in exactly one window.
    The last STRIDE places of a window count; the others are those before, PAD in front of a text.
    """
    lead = WINDOW - STRIDE
    lengths = np.array([len(c) + 1 for c in classes], dtype=np.int64)
    each = -(-lengths // STRIDE)
    text = np.repeat(np.arange(len(classes)), each)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    spans = each * STRIDE + lead + 1
    begin = np.cumsum(spans) - spans
    stream = np.full(int(spans.sum()) + WINDOW, END, dtype=np.int16)  # of a text: PAD, START, its ids, END up to the last window's end
    for at, c in zip(begin.tolist(), classes, strict=True):
        stream[at : at + lead] = PAD
        stream[at + lead] = START
        stream[at + lead + 1 : at + lead + 1 + len(c)] = c
    from_ = begin[text] + nth * STRIDE
    rows = np.lib.stride_tricks.sliding_window_view(stream, WINDOW)
    place = np.arange(-lead, STRIDE)
    scored = (place >= 0) & (place < (lengths[text] - nth * STRIDE)[:, None])
    return rows[from_], rows[from_ + 1], scored, text


def singles_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts of all ids: classes where the most frequent ids have their own, and the other ids that occur."""
    class_of = np.full(VOCAB, CLASSES - 1, dtype=np.int16)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    singles = order[:SINGLES]
    class_of[singles] = 1 + np.arange(len(singles))
    return class_of, order[SINGLES:]


def cluster(counts: np.ndarray, pages: DataFrame) -> np.ndarray:
    """The class of every id: frequent ones alone, the rest by k-means on the frequent ids before them."""
    class_of, rest = singles_of(counts)
    if len(rest) <= CLUSTERS - 1:
        class_of[rest] = 1 + SINGLES + np.arange(len(rest))
        return class_of
    slot = np.full(VOCAB, -1)
    slot[rest] = np.arange(len(rest))
    width = SINGLES + 1
    found = count_pages(pages, _neighbours, (class_of, slot, width))  # at most VOCAB * width numbers
    before = np.zeros(len(rest) * width)
    before[found.column("key").to_numpy()] = found.column("n").to_numpy()
    v = np.sqrt(before.reshape(len(rest), width) + 0.02)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centre = v[np.linspace(0, len(v) - 1, CLUSTERS - 1).astype(int)]
    for _ in range(12):
        near = (v @ centre.T).argmax(1)
        centre = np.stack([v[near == k].sum(0) if (near == k).any() else centre[k] for k in range(CLUSTERS - 1)])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    class_of[rest] = 1 + SINGLES + near
    return class_of


def _neighbours(texts: list[np.ndarray], class_of: np.ndarray, slot: np.ndarray, width: int) -> np.ndarray:
    """Keys slot * width + class before, of ids without a class of their own; a class of many ids counts as none."""
    keys = []
    for x in texts:
        to = slot[x[1:]]
        ok = to >= 0
        c = class_of[x[:-1]][ok].astype(np.int64)
        keys.append(to[ok] * width + np.where(c < width, c, 0))
    return np.concatenate(keys)


def _class_pairs(texts: list[np.ndarray], class_of: np.ndarray) -> np.ndarray:
    """Keys class before * CLASSES + class, with start and end."""
    cls = [class_of[x].astype(np.int64) for x in texts]
    return np.concatenate([np.concatenate(([START], c)) * CLASSES + np.concatenate((c, [END])) for c in cls])


def read_corpus(rows: DataFrame, tokenizer: str) -> DataFrame:
    """A table of what is read of the texts, each of them once, with a row for up to 512 texts.

    Of each text id, fold, key, and number of words; the words of all texts as numbers (uint16, or uint32 if there are
    more) of different words; of each different word hash (int64), subword id (uint16), and how often training texts have it (int64).
    """
    names = ["doc_id", "held_out", "key", "lengths", "words", "hashes", "pieces", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(tokenizer)
        for batch in slices(batches):
            texts = reader(batch.column(3))
            lengths = np.array([len(x) for x in texts])
            words = np.concatenate(texts)
            learned = words[np.repeat(~batch.column(1).to_numpy(zero_copy_only=False), lengths)]
            counts = np.bincount(learned, minlength=len(reader.first))
            parts = [words.astype(np.uint16 if len(reader.first) <= 1 << 16 else np.uint32), reader.hashes, reader.first.astype(np.uint16), counts]
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), c) for c in (*batch.columns[:3], pa.array(lengths, pa.int64()))]
            yield pa.RecordBatch.from_arrays(lists + [pa.array([x.tobytes()], pa.binary()) for x in parts], names)

    schema = "doc_id array<long>, held_out array<boolean>, key array<long>, lengths array<long>, words binary, hashes binary, pieces binary, counts binary"
    keyed = rows.select("doc_id", "held_out", F.xxhash64(F.lit(41), "doc_id", "text").alias("key"), "text")
    return materialize(keyed.mapInArrow(run, schema), "read", maxRecordsPerFile=PAGE_BATCH)


def word_numbers(words: pa.BinaryScalar, n: int) -> np.ndarray:
    """The n numbers of words in a row of read_corpus."""
    data = words.as_buffer()
    return np.frombuffer(data, dtype=np.uint16 if data.size == 2 * n else np.uint32)


def write_pages(read: DataFrame, n_docs: int) -> DataFrame:
    """A table of pages: lengths (int32 each) and subword ids (uint16 each) of training documents dealt by a hash of id and text."""
    page_tokens = PAGE_TOKENS

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held_out, key, lengths, words, pieces in zip(*batch.columns, strict=True):
                ends = np.cumsum(lengths.values.to_numpy()).tolist()
                data = np.frombuffer(pieces.as_buffer(), dtype=np.uint16)[word_numbers(words, ends[-1])].tobytes()
                ids = [data[2 * lo : 2 * hi] for lo, hi in zip([0, *ends], ends, strict=False)]
                kept = pc.invert(held_out.values)
                yield pa.RecordBatch.from_arrays([key.values.filter(kept), pa.array(ids, pa.binary()).filter(kept)], ["key", "ids"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def page() -> pa.RecordBatch:
            lengths = np.array([len(x) // 2 for x in held], dtype=np.int32).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([lengths], pa.binary()), pa.array([b"".join(held)], pa.binary())], ["lengths", "ids"])

        for batch in batches:
            for x in batch.column(1).to_pylist():
                held.append(x)
                size += len(x) // 2 + 1
                if size >= page_tokens:
                    yield page()
                    held, size = [], 0
        if held:
            yield page()

    unfolded = read.select("held_out", "key", "lengths", "words", "pieces").mapInArrow(unfold, "key long, ids binary")
    dealt = unfolded.repartition(max(1, -(-n_docs // PART_DOCS)), "key").sortWithinPartitions("key", "ids")
    with page_batches(read.sparkSession, maxBytesPerBatch=8 << 20):
        return materialize(dealt.mapInArrow(fill, "lengths binary, ids binary"), "pages")


def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The id sequences of every page."""
    for batch in batches:
        for lengths, ids in zip(batch.column(0), batch.column(1), strict=True):
            ends = np.cumsum(np.frombuffer(lengths.as_buffer(), dtype=np.int32))
            yield np.split(np.frombuffer(ids.as_buffer(), dtype=np.uint16), ends[:-1])


@contextmanager
def page_batches(spark, **limits):
    """While pages are read, or what else has long rows: few of them in an Arrow batch, or what else limits it."""
    limits = {f"spark.sql.execution.arrow.{name}": value for name, value in (limits or {"maxRecordsPerBatch": PAGE_BATCH}).items()}
    before = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def count_pages(pages: DataFrame, keys_of: Callable[..., np.ndarray], known: tuple) -> pa.Table:
    """key, n: how often each key of keys_of(texts, *known) occurs over all pages."""
    sent = pages.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in read_pages(batches):
            key, n = np.unique(keys_of(texts, *sent.value).astype(np.int32), return_counts=True)  # below VOCAB * CLASSES
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    with page_batches(pages.sparkSession):
        return pages.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()


def train_pass(pages: DataFrame, class_of: np.ndarray, attention: Attention, epoch: int) -> int:
    """One pass over all windows of all pages; attention gets the average of what the pages learned.  Returns the number of targets."""
    sent = pages.sparkSession.sparkContext.broadcast((class_of, attention))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, begin = sent.value
        start, targets, sums = begin.state(), 0, np.zeros(len(begin.state()))
        lanes = [copy.deepcopy(begin) for _ in range(LANES)]
        texts = read_pages(batches)
        while data := [windows([class_of[t] for t in page])[:3] for page in islice(texts, LANES)]:
            for own in lanes[: len(data)]:
                own.restore(start)
            train_lanes(lanes[: len(data)], data, epoch)
            for own, (_, _, scored) in zip(lanes, data, strict=False):
                n = int(scored.sum())
                targets += n
                sums += n * own.state()
        if targets:  # one row for each task
            yield pa.RecordBatch.from_arrays([pa.array([targets], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["targets", "sums"])

    with page_batches(pages.sparkSession):
        got = pages.mapInArrow(run, "targets long, sums binary").toArrow()
    targets = sum(got.column("targets").to_pylist())
    if targets:
        attention.restore(sum(np.frombuffer(x, dtype=np.float64) for x in got.column("sums").to_pylist()) / targets)
    sent.unpersist()
    return targets


class Reader:
    """Texts as arrays of numbers of words; for each word of the last call its first subword id and its hash."""

    def __init__(self, tokenizer: str):
        self.ranks = load_ranks(tokenizer)
        spaced: dict[int, list[bytes]] = {}
        for entry in self.ranks:
            if entry.startswith(b" ") and 1 < len(entry) <= LONGEST:
                spaced.setdefault(len(entry) - 1, []).append(entry[1:])
        #: By length, longest first: entries without the space before them, and their ids.
        self.entries = [(n, pa.array(found, pa.binary()), np.array([self.ranks[b" " + x] for x in found])) for n, found in sorted(spaced.items(), reverse=True)]
        self.first = self.hashes = np.zeros(0, dtype=np.int64)

    def subword(self, word: bytes) -> int:
        """The id of the longest entry that begins the word behind a space."""
        return int(self.subwords(pa.array([word], pa.binary()))[0])

    def subwords(self, words: pa.Array) -> np.ndarray:
        """For all words at once: what is not yet found is looked up by its first 15 bytes, 14 and so on."""
        out = np.full(len(words), self.ranks.get(b" ", VOCAB - 1), dtype=np.int64)
        lengths, left = pc.binary_length(words).to_numpy(), np.arange(len(words))
        for n, entries, ids in self.entries:
            long = lengths[left] >= n
            at = left[long]
            if len(at):
                hit = pc.fill_null(pc.index_in(pc.binary_slice(words.take(pa.array(at)), 0, n), entries), -1).to_numpy()
                out[at[hit >= 0]] = ids[hit[hit >= 0]]
                left = np.concatenate([left[~long], at[hit < 0]])
        return out

    def __call__(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
        flat, at = split.flatten(), split.offsets.to_numpy()
        kept = pc.binary_length(flat).to_numpy() > 0  # white space at an end leaves an empty word there
        coded = flat.filter(pa.array(kept)).dictionary_encode()
        words = coded.dictionary.cast(pa.binary())
        self.first = self.subwords(words)
        data, bounds = words.buffers()[2], np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset :][: len(words) + 1].tolist()
        data = data.to_pybytes() if data else b""
        self.hashes = np.array([xxhash.xxh3_64_intdigest(data[lo:hi]) for lo, hi in zip(bounds, bounds[1:], strict=False)], dtype=np.uint64).view(np.int64)
        found = coded.indices.to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(kept)])[at - at[0]].tolist()
        return [found[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)]


@dataclass
class Model:
    class_of: np.ndarray
    #: log10 of what (count + 1) is divided by, for each class.
    class_log: np.ndarray
    attention: Attention
    #: Targets of each training pass.
    trained: list[int]

    def score(self, ids: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text's classes, its end included, less the divisors of its words."""
        classes = [self.class_of[i] for i in ids]
        x, y, scored, text = windows(classes)
        out = np.zeros(len(ids))
        for at in range(0, len(x), 256):
            part = slice(at, at + 256)
            logp = self.attention.log_probabilities(x[part], y[part], scored[part])
            out += np.bincount(np.repeat(text[part], scored[part].sum(1)), logp, len(ids))
        return out / LN10 - np.array([self.class_log[c].sum() for c in classes])


def count_corpus(read: DataFrame, n_words: int) -> DataFrame:
    """key, piece, n: hash, subword id and count of every word of all training documents, once each.

    Tasks add up MERGED entries at once and send them on as binary rows, one for each range of hashes.
    """
    ranges = max(1, -(-n_words // RANGE_WORDS))
    bounds = np.array([k * 2**64 // ranges - 2**63 for k in range(1, ranges)], dtype=np.int64)
    kinds = (np.int64, np.uint16, np.int64)

    def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        key, piece, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        key, first, at = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(at, n, len(key)).astype(np.int64)
        return key[n > 0], piece[first][n > 0], n[n > 0]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def rows() -> pa.RecordBatch:
            parts = merged(held)
            ends = [0, *np.searchsorted(parts[0], bounds).tolist(), len(parts[0])]
            full = [k for k in range(ranges) if ends[k + 1] > ends[k]]
            blobs = [pa.array([x[ends[k] : ends[k + 1]].tobytes() for k in full], pa.binary()) for x in parts]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *blobs], ["range", "keys", "pieces", "counts"])

        for batch in batches:
            for parts in zip(*batch.columns, strict=True):
                held.append(tuple(np.frombuffer(x.as_buffer(), dtype=t) for x, t in zip(parts, kinds, strict=True)))
                if sum(len(x) for x, _, _ in held) >= MERGED:
                    yield rows()
        if held:
            yield rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        now = None

        def words() -> pa.RecordBatch:
            key, piece, n = merged(held)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(piece, pa.int32()), pa.array(n)], ["key", "piece", "n"])

        for batch in batches:
            for k, *parts in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                if k != now and held:
                    yield words()
                now = k
                held.append(tuple(np.frombuffer(x.as_buffer(), dtype=t) for x, t in zip(parts, kinds, strict=True)))
        if held:
            yield words()

    sent = read.select("hashes", "pieces", "counts").mapInArrow(split, "range int, keys binary, pieces binary, counts binary")
    return sent.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(merge, "key long, piece int, n long")


def fit(train: DataFrame, tokenizer: str) -> tuple[Model, DataFrame, int, int, int]:
    """The model, the table of word counts, and of all training documents: words, different words, texts."""
    read = read_corpus(train.withColumn("held_out", F.lit(False)), tokenizer)
    try:
        return fit_read(read)
    finally:
        discard(read)


def fit_read(read: DataFrame) -> tuple[Model, DataFrame, int, int, int]:
    """The same from a table of read_corpus."""
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    ends, n_words = (x or 0 for x in read.select(F.sum(F.size(F.filter("held_out", lambda x: ~x))), F.sum(total)).first())
    with page_batches(read.sparkSession, maxBytesPerBatch=8 << 20):
        counts = materialize(count_corpus(read, n_words), "counts")
    pages = write_pages(read, ends)
    by_piece = counts.groupBy("piece").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()  # VOCAB rows at most
    piece, n, v = (by_piece.column(c).to_numpy() for c in ("piece", "n", "v"))
    pieces = np.zeros(VOCAB, dtype=np.int64)
    pieces[piece] = n
    class_of = cluster(pieces, pages)
    divisor = np.ones(CLASSES)
    np.add.at(divisor, class_of[piece], n + v)
    found = count_pages(pages, _class_pairs, (class_of,))
    pairs = np.zeros((CLASSES + 1) * CLASSES)
    pairs[found.column("key").to_numpy()] = found.column("n").to_numpy()
    pairs = pairs.reshape(CLASSES + 1, CLASSES)
    share = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * CLASSES)
    bigram = np.log((pairs + 20 * share) / (pairs.sum(1, keepdims=True) + 20))
    attention = Attention(bigram)
    attention.start()
    trained = [train_pass(pages, class_of, attention, epoch) for epoch in range(EPOCHS)]
    discard(pages)
    return Model(class_of, np.log10(divisor), attention, trained), counts, int(n.sum()), int(v.sum()), ends


def score_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).withColumn("held_out", F.coalesce(crc_mod("doc_id", FOLD) == HELD, F.lit(False)))
    read = read_corpus(rows, tokenizer)
    model, counts, n_words, distinct, ends = fit_read(read)
    words = counts.select(F.col("key").alias("word"), F.col("n").alias("c"))
    hot = words.orderBy(F.col("c").desc(), "word").limit(HOT_WORDS).toArrow()
    hot_word, hot_count = hot.column("word").to_numpy(), hot.column("c").to_numpy()
    by_word = np.argsort(hot_word)
    sent = spark.sparkContext.broadcast((model, hot_word[by_word], hot_count[by_word]))  # HOT_WORDS entries at most
    names = ["row", "doc_id", "held_out", "n_words", "known", "logs", "score", "word", "tf"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hot_word, hot_count = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, held_out, lengths, words, hashes, pieces in zip(*batch.columns, strict=True):
                lengths = lengths.values.to_numpy()
                words = word_numbers(words, int(lengths.sum())).astype(np.int64)
                h, pieces = np.frombuffer(hashes.as_buffer(), dtype=np.int64), np.frombuffer(pieces.as_buffer(), dtype=np.uint16)
                at = np.minimum(np.searchsorted(hot_word, h), max(0, len(hot_word) - 1))
                log_count = np.where(hot_word[at] == h, np.log10(hot_count[at] + 1.0), np.nan) if len(hot_word) else np.full(len(h), np.nan)
                n, found = len(lengths), log_count[words]  # of each word: log10 of count + 1 if hot, else NaN
                owner, cold = np.repeat(np.arange(n), lengths), np.isnan(found)
                known = np.bincount(owner[~cold], minlength=n)
                logs = np.bincount(owner[~cold], found[~cold], n)
                score = model.score(np.split(pieces[words], np.cumsum(lengths)[:-1]))
                columns = [np.arange(row, row + n), doc_id.values, held_out.values, lengths, known, logs, score]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=False)] + [pa.nulls(n, pa.int64())] * 2, names)
                pairs, tf = np.unique(owner[cold] * len(h) + words[cold], return_counts=True)
                if len(pairs):
                    empty = [pa.nulls(len(pairs), t) for t in types[1:7]]
                    yield pa.RecordBatch.from_arrays([pa.array(row + pairs // len(h)), *empty, pa.array(h[pairs % len(h)]), pa.array(tf.astype("i8"))], names)
                row += n

    schema = "row long, doc_id long, held_out boolean, n_words long, known long, logs double, score double, word long, tf long"
    with page_batches(spark):
        found = materialize(read.select("doc_id", "held_out", "lengths", "words", "hashes", "pieces").mapInArrow(run, schema), "scored")
    discard(read)
    # words beyond the broadcast ones: joined with the counts of all training documents
    rare = found.where("word IS NOT NULL").select("row", "word", "tf").join(words, "word")
    rare = rare.groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    out = found.where("word IS NULL").drop("word", "tf").join(rare, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    divisor = float(np.log10(n_words + ends + distinct + (ends > 0) + 1.0))
    return out.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n_words + ends).cast("long").alias("train_tokens"),
        (logs + F.lit(float(np.log10(ends + 1.0))) - (F.col("n_words") + 1) * F.lit(divisor)).alias("base_score"), (logs + F.col("score")).alias("score"),
    )
