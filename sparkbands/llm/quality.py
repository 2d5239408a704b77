"""Quality by supervised subword embeddings.

Words, word pairs and character n-grams of several lengths are hashed to
buckets, each with a learned vector; a document is the mean of its features'
vectors, and a softmax layer gives the class.  Character n-grams stay inside a
word, which they see with a space on either side.  numpy stochastic gradient
descent trains both layers on at most ``sample`` labelled rows per class, those
with the smallest hash of the id.  Every fourth row of the sample is kept from
the training and sets the scale of the scores.

With two classes the softmax of a mean is a logistic curve of the mean of one
number per bucket, which is what the tasks look up.  Whole texts are read,
however long, a batch of texts at a time.  Texts that are null, empty or without
words get the curve's value at 0.  Repeated rows give repeated rows, equal texts
equal scores; an empty table of documents gives no rows, and without labels of
both classes all scores are the same.  Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import labelled_sample, map_texts
from .text import batches, joined, tokens
from .toxicity import logistic

#: Lengths of the character n-grams.
_GRAMS = (3, 5)


def char_grams(texts: list, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each run of n characters that holds no white space but at its ends."""
    raw = [f" {t} " if t else " " for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    c = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    size = len(c) - n + 1
    if size <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.where(space, np.uint32(32), c)
    inside = np.ones(size, bool)
    for k in range(1, n - 1):
        inside &= ~space[k : size + k]
    at = np.flatnonzero(inside)
    h = np.full(len(at), n, np.uint32)
    for k in range(n):
        h = (h ^ c[at + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return np.searchsorted(ends, at, "right"), (h >> np.uint32(32 - bits)).astype(np.int64)


def features(texts: list, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (text number per feature, bucket per feature): words, word pairs, character n-grams."""
    t, shift = tokens(texts), np.uint64(64 - bits)
    doc = t.doc()
    out = [(doc, (t.hashes >> shift).astype(np.int64))]
    if len(doc) > 1:
        inside = doc[1:] == doc[:-1]
        out.append((doc[1:][inside], (joined(t.hashes, 2)[inside] >> shift).astype(np.int64)))
    return out + [char_grams(texts, n, bits) for n in _GRAMS]


@dataclass
class Model:
    worth: np.ndarray  # per bucket: difference of the two logits
    bits: int
    slope: float = 1.0
    bias: float = 0.0

    def evidence(self, texts: list) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for doc, bucket in features(texts, self.bits):
            total += np.bincount(doc, self.worth[bucket], minlength=len(texts))
            n += np.bincount(doc, minlength=len(texts))
        return total / np.maximum(n, 1)

    def score(self, texts: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(texts) + self.bias, -500, 500)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, width: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 5) -> np.ndarray:
    """Stochastic gradient descent over (buckets, shares, class); returns each bucket's difference of logits."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << bits, width)).astype(np.float32)
    output = rng.normal(0, 0.1, (2, width)).astype(np.float32)
    steps, done = epochs * max(len(rows), 1), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            bucket, share, y = rows[k]
            now = rate * (1 - done / steps)
            done += 1
            if not len(bucket):
                continue
            mean = share @ vectors[bucket]
            logits = output @ mean
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            # shares are near 1 / features; their root keeps the steps of long and short texts comparable
            vectors[bucket] -= now * np.sqrt(share)[:, None] * (p @ output)
            output -= now * np.outer(p, mean)
    return (vectors @ (output[1] - output[0])).astype(np.float32)


def packed(bucket: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending buckets and how often each occurs, as compressed bytes: what the driver gets of a row."""
    numbers = np.concatenate([np.diff(bucket, prepend=0), n]).astype("<i4")
    return zlib.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, and the share of each in the row's features."""
    numbers = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int64)
    gaps, n = np.split(numbers, 2)
    return np.cumsum(gaps).astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, sample: int = 1500, bits: int = 18) -> Model:
    chosen, part = labelled_sample(docs, labels, label, folds, held_out, sample)

    def extract(frames):
        for frame in batches(frames, "text", 1 << 20):
            found = features(frame["text"].tolist(), bits)
            doc, bucket = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            key, n = np.unique(doc * (1 << bits) + bucket, return_counts=True)
            cut = np.searchsorted(key >> bits, np.arange(len(frame) + 1))
            key &= (1 << bits) - 1
            yield pd.DataFrame({"y": frame["y"], "at": frame["at"], "packed": [packed(key[a:b], n[a:b]) for a, b in zip(cut, cut[1:])]})

    got = chosen.select("text", "y", "at").mapInPandas(extract, "y int, at long, packed binary").collect()
    rows = sorted(((r["at"], *unpacked(r.packed), r.y) for r in got), key=lambda r: (r[0], r[3]))
    worth = train([(b, s, y) for at, b, s, y in rows if at % 4], bits)
    model = Model(worth, bits)
    kept = [r for r in rows if r[0] % 4 == 0]
    x, y = np.array([s @ worth[b] for _, b, s, _ in kept], float), np.array([r[3] for r in kept], float)
    many = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, part.get(1, 0) / many[1], part.get(0, 0) / many[0])
    model.slope, model.bias = logistic(x, y, weight)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for frame in batches(frames, "text", 1 << 20):
            p = shared.value.score(frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": p, "predicted": (p >= threshold).astype(np.int32)})

    return map_texts(docs, run, "score double, predicted int")
