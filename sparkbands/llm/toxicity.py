"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Each class has a model of order five over the bytes of a word, which starts with
four start marks and closes with an end mark.  A class's counts are the labelled
documents of the class that hold the word, so a line that one text repeats
counts once.  ``discount`` is taken from every count of a class, and what it
takes is given to a lower model that both classes share: interpolated
Kneser-Ney over continuation counts (in how many different contexts a byte
stands) of orders four to one, with a uniform share at the bottom.  So what a
class saw in few documents is judged by the shared backoff counts alone, and
the two models differ only where counts of a class do.

The evidence of a word is the log ratio of its two likelihoods.  A document's
is what its words have above ``margin`` nats, added up and divided by the root
of the number of its words.  A logistic curve of its logarithm, fitted on
labelled rows that the counts have not seen, gives the score.

Learning uses at most ``sample`` labelled rows per class, those with the
smallest hash of the id; every fourth of them fits the curve.  Whole texts are
read, however long, a batch of texts at a time.  Texts that are null, empty or
without words have no evidence and get the curve's value there.  Repeated rows
give repeated rows, equal texts equal scores; an empty table of documents gives
no rows, and without labels of both classes all scores are the same.  Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_texts
from .text import Tokens, batches, tokens

_ORDER = 5
_START, _END = 1, 2
_LOWER_DISCOUNT = 0.75


def word_grams(t: Tokens, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Five-byte windows of the words of a batch (or of those with the indices ``some``), as numbers, and each word's first window."""
    starts, ends = (t.starts, t.ends) if some is None else (t.starts[some], t.ends[some])
    size = ends - starts + 1  # a window for each byte and one for the end mark
    first = np.cumsum(size) - size
    if not len(size):
        return np.empty(0, np.uint64), first
    # every word between its marks, one after another
    width = size + _ORDER - 1
    at = np.cumsum(width) - width
    flat = np.full(int(width.sum()), _START, np.uint8)
    body = np.arange(int((size - 1).sum()))
    word = np.repeat(np.arange(len(size)), size - 1)
    inside = body - (first - np.arange(len(size)))[word]  # bytes into the word
    flat[at[word] + _ORDER - 1 + inside] = t.buf[starts[word] + inside]
    flat[at + width - 1] = _END
    key = np.zeros(len(flat) - _ORDER + 1, np.uint64)
    for k in range(_ORDER):
        key = key << np.uint64(8) | flat[k : len(key) + k]
    keep = np.ones(len(key), bool)
    inner = (at + width)[:-1]
    for k in range(1, _ORDER):
        keep[inner - k] = False
    return key[keep], first


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of values over each."""
    found, back = np.unique(key, return_inverse=True)
    return found, *(np.bincount(back, v, len(found)) for v in values)


def _find(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(keys, at), max(len(keys) - 1, 0))
    return i, (keys[i] == at if len(keys) else np.zeros(len(at), bool))


@dataclass
class Counts:
    """The two models as counts: sorted windows and the documents of either class that hold them."""

    grams: np.ndarray
    n: np.ndarray  # (grams, 2)
    discount: float
    lower: list = field(default_factory=list)  # per order below, from the highest: (keys, own share), (contexts, share left)

    def __post_init__(self) -> None:
        keys, of = self.grams, self.n.sum(1)
        for order in range(_ORDER - 1, 0, -1):
            keys, of = _sums(keys & np.uint64((1 << 8 * order) - 1), np.ones(len(keys)))  # continuation counts
            context, total, kinds = _sums(keys >> np.uint64(8), of, np.ones(len(keys)))
            at = np.searchsorted(context, keys >> np.uint64(8))
            self.lower.append(((keys, np.maximum(of - _LOWER_DISCOUNT, 0) / total[at]), (context, np.minimum(_LOWER_DISCOUNT * kinds, total) / total)))
        context, *total = _sums(self.grams >> np.uint64(8), *self.n.T)
        _, *taken = _sums(self.grams >> np.uint64(8), *np.minimum(self.n, self.discount).T)
        total, taken = np.stack(total, 1), np.stack(taken, 1)
        self.contexts = context
        self.left = np.where(total > 0, taken / np.maximum(total, 1), 1.0)
        at = np.searchsorted(context, self.grams >> np.uint64(8))
        self.own = np.maximum(self.n - self.discount, 0) / np.maximum(total[at], 1) if len(at) else np.zeros((0, 2))

    def shared(self, key: np.ndarray) -> np.ndarray:
        """The shared lower model's probability of each window's last byte."""
        p = np.full(len(key), 1 / 256)
        for order, ((keys, share), (context, left)) in zip(range(1, _ORDER), reversed(self.lower)):
            k = key & np.uint64((1 << 8 * order) - 1)
            i, hit = _find(context, k >> np.uint64(8))
            j, met = _find(keys, k)
            if len(keys):
                p = np.where(hit, np.where(met, share[j], 0.0) + left[i] * p, p)
        return p

    def probability(self, key: np.ndarray) -> np.ndarray:
        """(windows, 2): each class's probability of the last byte of a window after its first four."""
        i, hit = _find(self.contexts, key >> np.uint64(8))
        j, met = _find(self.grams, key)
        p = self.shared(key)[:, None]
        if not len(self.grams):
            return np.repeat(p, 2, 1)
        return np.where(met[:, None], self.own[j], 0.0) + np.where(hit[:, None], self.left[i], 1.0) * p


class Table:
    """Numbers by key: a slot for most keys, a sorted rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float32)
        slot = self.slot(keys)
        self.keys[slot], self.values[slot] = keys, values
        lost = self.keys[slot] != keys
        self.rest, self.rest_values = keys[lost], values[lost].astype(np.float32)  # keys come sorted

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 without one), and whether there is one; no key is 0."""
        slot = self.slot(key)
        hit = self.keys[slot] == key
        out = np.where(hit, self.values[slot], np.float32(0))
        if len(self.rest):
            miss = np.flatnonzero(~hit)
            i, met = _find(self.rest, key[miss])
            out[miss[met]] = self.rest_values[i[met]]
            hit[miss[met]] = True
        return out, hit


@dataclass
class Model:
    grams: Table  # log ratio of a window that either class has seen
    contexts: Table  # log ratio of what the classes leave to the shared model after a context
    margin: float
    slope: float = 1.0
    bias: float = 0.0

    def evidence(self, texts: list) -> np.ndarray:
        t = tokens(texts, hashed=False)
        if not len(t.starts):
            return np.zeros(len(t.first) - 1)
        key, first = word_grams(t)
        ratio, seen = self.grams.get(key)
        unseen = np.flatnonzero(~seen)
        # a window that neither has seen: the shared probability stands on both sides
        ratio[unseen] = self.contexts.get(key[unseen] >> np.uint64(8))[0]
        over = np.maximum(np.add.reduceat(ratio.astype(np.float64), first) - self.margin, 0)
        total = np.concatenate([[0], np.cumsum(over)])
        return (total[t.first[1:]] - total[t.first[:-1]]) / np.sqrt(np.maximum(t.counts, 1))

    def score(self, texts: list) -> np.ndarray:
        z = np.log(self.evidence(texts) + 0.01)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.bias, -500, 500)))


def count_grams(rows: DataFrame) -> DataFrame:
    """(gram, n0, n1): for each window, over all words, the documents of either class that hold the word; of rows (text, y)."""

    def run(frames):
        for frame in batches(frames, "text", 1 << 20):
            t, y = tokens(frame["text"].tolist()), frame["y"].to_numpy(np.int64)
            if not len(t.hashes):
                continue
            doc = t.doc()
            order = np.lexsort((t.hashes, doc))
            d, h = doc[order], t.hashes[order]
            some = order[np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))]  # each word once a document
            key, first = word_grams(t, some)
            toxic = np.repeat(y[doc[some]], np.diff(np.append(first, len(key))))
            gram, n1, n = _sums(key, toxic, np.ones(len(key)))
            yield pd.DataFrame({"gram": gram.view(np.int64), "n0": (n - n1).astype(np.int64), "n1": n1.astype(np.int64)})

    made = rows.select("text", "y").mapInPandas(run, "gram long, n0 long, n1 long")
    return made.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def ratios(counts: Counts, margin: float) -> Model:
    p = counts.probability(counts.grams)
    return Model(Table(counts.grams, np.log(p[:, 1] / p[:, 0])), Table(counts.contexts, np.log(counts.left[:, 1] / counts.left[:, 0])), margin)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = 4000, discount: float = 3.0, margin: float = 3.0) -> Model:
    """The models of at most ``sample`` rows of each class, every one that is labelled up to that bound."""
    chosen, part = labelled_sample(docs, labels, label, folds, held_out, sample)
    # windows of five bytes of at most 2 * sample texts
    seen = count_grams(chosen.where("pmod(at, 4) <> 0")).toPandas().sort_values("gram")
    model = ratios(Counts(seen["gram"].to_numpy(np.int64).view(np.uint64), seen[["n0", "n1"]].to_numpy(np.float64), discount), margin)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(frames):
        for frame in batches(frames, "text", 1 << 20):
            yield pd.DataFrame({"x": sent.value.evidence(frame["text"].tolist()), "y": frame["y"].to_numpy(float)})

    held = chosen.where("pmod(at, 4) = 0").select("text", "y").mapInPandas(judge, "x double, y double").toPandas().sort_values(["x", "y"])
    many = {y: max(1, (held["y"] == y).sum()) for y in (0, 1)}
    weight = np.where(held["y"] == 1, part.get(1, 0) / many[1], part.get(0, 0) / many[0])
    model.slope, model.bias = logistic(np.log(held["x"].to_numpy() + 0.01), held["y"].to_numpy(), weight)
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and bias by Newton steps; the slope is held to at least 0, and both targets a little off 0 and 1."""
    if not len(x) or y.min() == y.max():
        rate = np.clip(np.average(y, weights=weight) if len(x) else 0.0, 1e-3, 1 - 1e-3)
        return 1.0, float(np.log(rate / (1 - rate)))
    weight = weight / weight.mean()
    scale = max(float(np.abs(x).max()), 1e-12)
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.stack([x / scale, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (weight * (p - goal)) + ridge * b * [1, 0]
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-9])
        step = np.linalg.solve(h, g)
        b = b - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(b[0] / scale), 0.0), float(b[1])


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for frame in batches(frames, "text", 1 << 20):
            p = shared.value.score(frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": p, "predicted": (p >= threshold).astype(np.int32)})

    return map_texts(docs, run, "score double, predicted int")
