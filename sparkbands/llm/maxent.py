"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

The most frequent training tokens are the model's words, ``12 * distinct tokens
** 0.4`` of them, in classes made from the words they stand next to, 0.7 times
the root of that number; all other tokens form one class more, in which a token
has its smoothed share.  The class of a token depends on the token before (words
by name, others by a hash) and, as a skip feature, on the class of the one
before that.  A word in its class depends on the class of the token before and
on that token itself: each pair of a token and a word has a weight in a hashed
table of ``64 * words`` buckets or more.  Words, classes and buckets so grow
with the corpus, as do the counts of all tokens.

Counts of features and histories are taken over all training texts.  Gradient
updates run as Spark jobs over the histories: each task adds up what the model
expects, and the difference to what was seen moves the weights.  The normaliser
of every history is a cell of a small table, so a batch is scored by sparse
lookups.  Counts of the ``head`` most frequent tokens are broadcast (a bound of
16 bytes each), those of all other tokens are joined by hash.

Tokens are words, A-Z lower-cased, and one end for each text; a null text is
empty and a very long one is read whole.  Repeated rows are scored, and learnt
from, each for itself; tokens of one frequency rank by hash.  Without training
texts every count is 0, and without documents there are no rows.  Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, written
from .text import batches, mix, tokens

_END = np.uint64(0x0E4D0E4D0E4D0E4D)


def with_ends(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each closed by the end token, and the first token of each text."""
    t = tokens(texts)
    first = t.first + np.arange(len(t.first))
    out = np.full(int(first[-1]), _END)
    body = np.ones(len(out), bool)
    body[first[1:] - 1] = False
    out[body] = t.hashes
    return out, first


def count_tokens(train: DataFrame) -> DataFrame:
    """(hash, c) of every token of the training texts."""

    def run(frames):
        held, size = [], 0

        def merged():
            h = np.concatenate([x[0] for x in held])
            n = np.concatenate([x[1] for x in held])
            order = np.argsort(h)
            at = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            return h[order][at], np.add.reduceat(n[order], at)

        for frame in batches(frames, "text"):
            h, n = np.unique(with_ends(frame["text"].tolist())[0], return_counts=True)
            held.append((h, n))
            size += len(h)
            if size > 3_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_500_000:
                    yield pd.DataFrame({"hash": held[0][0].view(np.int64), "c": held[0][1]})
                    held = []
                size = sum(len(x[0]) for x in held)
        if held:
            h, n = merged()
            for a in range(0, len(h), 500_000):
                yield pd.DataFrame({"hash": h[a : a + 500_000].view(np.int64), "c": n[a : a + 500_000]})

    return train.select("text").mapInPandas(run, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each h in sorted keys, -1 where it is not there."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


@dataclass
class Vocabulary:
    keys: np.ndarray  # sorted hashes of the model's words
    of_class: np.ndarray  # class of each
    classes: int
    hashed: int
    bits: int  # of the table of pair weights

    @property
    def features(self) -> int:
        return len(self.keys) + self.hashed + 1

    @property
    def class_of_feature(self) -> np.ndarray:
        """Class of the token before by its feature; the last feature is the start of a text."""
        return np.concatenate([self.of_class, np.full(self.hashed, self.classes), [self.classes + 1]]).astype(np.int64)

    def bucket(self, f1: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of a token before and a word among the pair weights."""
        pair = f1.astype(np.uint64) * np.uint64(max(len(self.keys), 1)) + word.astype(np.uint64)
        return (mix(pair + np.uint64(1)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def read(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Word (-1: other), class, feature of the token before, class of the one before that."""
        word = _find(self.keys, h)
        cls = np.where(word >= 0, self.of_class[word], self.classes) if len(self.keys) else np.full(len(h), self.classes)
        name = np.where(word >= 0, word, len(self.keys) + (h % np.uint64(self.hashed)).astype(np.int64))
        start = self.classes + 1
        f1, c2 = np.empty_like(name), np.empty_like(cls)
        f1[1:] = name[:-1]
        c2[2:] = cls[:-2]
        begin = first[:-1]
        f1[begin], c2[begin] = self.features - 1, start
        second = begin[np.diff(first) > 1] + 1
        c2[second] = start
        return word, cls, f1, c2


@dataclass
class Model:
    vocabulary: Vocabulary
    a: np.ndarray  # (features, classes + 1) class weights of the token before
    s: np.ndarray  # (classes + 2, classes + 1) of the skipped token's class; holds the bias
    b: np.ndarray  # (classes + 2, words) of the class of the token before
    u: np.ndarray  # (buckets,) of pairs of the token before and a word
    z: np.ndarray | None = None
    zw: np.ndarray | None = None

    def logits(self, f1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features f1, words): weights of all words after each, and their buckets."""
        v = self.vocabulary
        bucket = v.bucket(np.repeat(f1, len(v.keys)), np.tile(np.arange(len(v.keys)), len(f1))).reshape(len(f1), -1)
        return self.b[v.class_of_feature[f1]] + self.u[bucket], bucket

    def shares(self, f1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(f1, words): each word's share of its class after f1, the buckets, and (f1, classes) log normalisers."""
        v = self.vocabulary
        x, bucket = self.logits(f1)
        order = np.argsort(v.of_class, kind="stable")
        first = np.searchsorted(v.of_class[order], np.arange(v.classes))
        full = np.diff(np.append(first, len(order))) > 0
        z = np.full((len(f1), v.classes), -np.inf)
        top = x.max(1, keepdims=True) if x.shape[1] else np.zeros((len(f1), 1))
        e = np.exp(x - top)
        if full.any():
            z[:, full] = np.log(np.add.reduceat(e[:, order], first[full], axis=1)) + top
        return np.exp(x - z[:, v.of_class]) if len(order) else x, bucket, z

    def normalise(self) -> Model:
        """Tables of log normalisers of all histories."""
        v = self.vocabulary
        self.z = np.stack([_logsum(self.a + row) for row in self.s], 1)
        step = max(1, (1 << 19) // max(1, len(v.keys)))
        parts = [self.shares(np.arange(i, min(i + step, v.features)))[2] for i in range(0, v.features, step)]
        self.zw = np.concatenate(parts)
        return self

    def log_probability(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of each token's class and word shares, and whether the token is no word of the model."""
        v = self.vocabulary
        word, cls, f1, c2 = v.read(h, first)
        out = self.a[f1, cls] + self.s[c2, cls] - self.z[f1, c2]
        own = np.flatnonzero(word >= 0)
        w, f = word[own], f1[own]
        out[own] += self.b[v.class_of_feature[f], w] + self.u[v.bucket(f, w)] - self.zw[f, cls[own]]
        return out, word < 0


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(-1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(-1, keepdims=True)))[..., 0]


def _cells(train: DataFrame, run) -> DataFrame:
    """(kind, cell, n) added up over all training texts; run gives arrays of cells by kind for a batch."""

    def collect(frames):
        held: dict = {}

        def merged(parts):
            key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            found, back = np.unique(key, return_inverse=True)
            return found, np.bincount(back, n, len(found)).astype(np.int64)

        def out(kind, cell, n):
            for i in range(0, len(cell), 500_000):
                yield pd.DataFrame({"kind": np.int32(kind), "cell": cell[i : i + 500_000], "n": n[i : i + 500_000]})

        for frame in batches(frames, "text"):
            for kind, cells in run(*with_ends(frame["text"].tolist())):
                parts = held.setdefault(kind, [])
                parts.append(np.unique(cells, return_counts=True))
                if sum(len(p[0]) for p in parts) > 2_000_000:
                    held[kind] = [merged(parts)]
                    if len(held[kind][0][0]) > 1_000_000:
                        yield from out(kind, *held.pop(kind)[0])
        for kind, parts in held.items():
            yield from out(kind, *merged(parts))

    return train.select("text").mapInPandas(collect, "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n"))


def word_classes(train: DataFrame, keys: np.ndarray, counts: np.ndarray, classes: int, context: int = 96, seed: int = 3) -> np.ndarray:
    """Classes of words by the frequent words before and after them: k-means on roots of shares."""
    spark, top = train.sparkSession, np.argsort(-counts, kind="stable")[:context]
    place = np.full(len(keys) + 1, context)
    place[top] = np.arange(len(top))
    sent = spark.sparkContext.broadcast((keys, place))

    def run(h, first):
        k, p = sent.value
        word = _find(k, h)
        inside = np.ones(len(h), bool)
        inside[first[1:] - 1] = False
        left = np.flatnonzero(inside[:-1])
        width = 2 * (context + 1)
        x, y = word[left], word[left + 1]
        a, b = x >= 0, y >= 0
        cells = np.concatenate([x[a] * width + p[y[a]], y[b] * width + context + 1 + p[x[b]]])
        return [(0, cells)]

    table = np.zeros(len(keys) * 2 * (context + 1))
    cells = _cells(train, run).select("cell", "n").toPandas()  # at most words * 194 rows
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    x = table.reshape(len(keys), -1)[:, np.r_[0:context, context + 1 : 2 * context + 1]]
    x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:classes]]
    for _ in range(15):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return near


def fit(train: DataFrame, counts: DataFrame, distinct: int, words: int | None = None, classes: int | None = None, hashed: int | None = None, rounds: int = 10) -> Model:
    """The model of all training texts; sizes that are not given follow the number of distinct tokens."""
    spark = train.sparkSession
    words = words or max(64, int(12 * distinct**0.4))
    classes, hashed = classes or max(4, int(0.7 * np.sqrt(words))), hashed or max(16, words // 2)
    bits = max(12, int(64 * words - 1).bit_length())
    top = counts.orderBy(F.desc("c"), "hash").limit(words).toPandas()
    order = np.argsort(top["hash"].to_numpy(np.int64).view(np.uint64))
    keys, c = top["hash"].to_numpy(np.int64).view(np.uint64)[order], top["c"].to_numpy(np.int64)[order]
    if not len(keys):
        v = Vocabulary(keys, np.empty(0, np.int64), classes, hashed, bits)
        return Model(v, np.zeros((v.features, classes + 1)), np.zeros((classes + 2, classes + 1)), np.zeros((classes + 2, 0)), np.zeros(1 << bits)).normalise()
    v = Vocabulary(keys, word_classes(train, keys, c, min(classes, len(keys))), classes, hashed, bits)
    sent = spark.sparkContext.broadcast(v)
    k, h, w = classes + 2, classes + 1, len(keys)

    def run(hash_, first):
        word, cls, f1, c2 = sent.value.read(hash_, first)
        own = word >= 0
        return [
            (0, f1 * h + cls),  # seen: token before and class
            (1, c2 * h + cls),  # seen: skipped token's class and class
            (2, f1[own] * w + word[own]),  # seen: token before and word
            (3, f1 * k + c2),  # histories of classes
        ]

    cells = written(_cells(train, run), "maxent-cells")
    shape = {"a": (v.features, h), "s": (k, h), "b": (k, w), "u": (1 << bits,)}
    seen = _seen(cells, v, shape)
    histories = cells.where("kind = 3 or kind = 0").withColumn("f1", F.floor(F.col("cell") / F.when(F.col("kind") == 3, k).otherwise(h)))
    histories = written(histories.repartition(8, F.floor(F.col("f1") / 16)).sortWithinPartitions("kind", "cell"), "maxent-histories")
    # start: shares of classes after a feature, drawn to those of all tokens, and shares of words in their classes
    all_of = (seen["s"].sum(0) + 0.5) / (seen["s"].sum() + 0.5 * h)
    a = np.log((seen["a"] + 20 * all_of) / (seen["a"].sum(1, keepdims=True) + 20) / all_of)
    model = Model(v, a, np.tile(np.log(all_of), (k, 1)), np.tile(np.log(c + 0.5), (k, 1)), np.zeros(1 << bits))
    for _ in range(rounds):
        want = _expected(histories, model, shape)
        for name in shape:
            # a step of at most a half along the gradient, scaled by what is expected; the constant holds rare features near their start
            weights = getattr(model, name)
            weights += 0.5 * np.clip((seen[name] - want[name]) / (want[name] + 5.0), -1, 1)
    return model.normalise()


def _total(rows: DataFrame, run, shape: dict) -> dict:
    """Sums of the arrays of the model's size that the tasks give."""
    out = {name: np.zeros(s) for name, s in shape.items()}

    def packed(frames):
        total = {name: np.zeros(s) for name, s in shape.items()}
        run(frames, total)
        yield pd.DataFrame({"name": list(total), "sums": [x.astype(np.float32).tobytes() for x in total.values()]})

    for r in rows.mapInPandas(packed, "name string, sums binary").toLocalIterator():  # one task's arrays at a time
        out[r.name] += np.frombuffer(r.sums, np.float32).reshape(shape[r.name])
    return out


def _seen(cells: DataFrame, v: Vocabulary, shape: dict) -> dict:
    """How often each feature was seen."""
    sent, k, h, w = cells.sparkSession.sparkContext.broadcast(v), v.classes + 2, v.classes + 1, len(v.keys)

    def run(frames, total):
        for f in frames:
            for kind, part in f.groupby("kind"):
                cell, n = part["cell"].to_numpy(), part["n"].to_numpy(float)
                if kind in (0, 1):
                    np.add.at(total["as"[kind]], np.divmod(cell, h), n)
                elif kind == 2:
                    f1, word = np.divmod(cell, w)
                    np.add.at(total["b"], (sent.value.class_of_feature[f1], word), n)
                    total["u"] += np.bincount(sent.value.bucket(f1, word), n, len(total["u"]))

    return _total(cells.where("kind < 3").coalesce(8), run, shape)


def _expected(histories: DataFrame, model: Model, shape: dict) -> dict:
    """What the model expects of each feature over all histories, added up by the tasks."""
    sent = histories.sparkSession.sparkContext.broadcast(model)

    def run(frames, total):
        m = sent.value
        v = m.vocabulary
        k, h, before = v.classes + 2, v.classes + 1, v.class_of_feature
        for f in frames:
            g = f[f["kind"] == 3]
            cell, n = g["cell"].to_numpy(), g["n"].to_numpy(float)
            for i in range(0, len(cell), 8192):
                f1, c2 = np.divmod(cell[i : i + 8192], k)
                x = m.a[f1] + m.s[c2]
                p = np.exp(x - _logsum(x)[:, None]) * n[i : i + 8192, None]
                _add(total["a"], f1, p)
                _add(total["s"], c2, p)
            g = f[(f["kind"] == 0) & (f["cell"] % h < v.classes)]
            f1, cls = np.divmod(g["cell"].to_numpy(), h)
            n = g["n"].to_numpy(float)
            some = np.unique(f1)
            step = max(1, (1 << 20) // max(1, len(v.keys)))
            for i in range(0, len(some), step):
                part = some[i : i + step]
                here = (f1 >= part[0]) & (f1 <= part[-1])
                times = np.zeros((len(part), v.classes))
                np.add.at(times, (np.searchsorted(part, f1[here]), cls[here]), n[here])
                p, bucket, _ = m.shares(part)
                p *= times[:, v.of_class]
                _add(total["b"], before[part], p)
                total["u"] += np.bincount(bucket.ravel(), p.ravel(), len(total["u"]))

    out = _total(histories, run, shape)
    sent.unpersist()
    return out


def _add(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
    total[at[order][first]] += np.add.reduceat(rows[order], first)


def score(docs: DataFrame, folds: int = 5, held_out: int = 1, head: int = 1 << 18, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs(doc_id, text).

    base_score adds log10 of each token's smoothed share in the training tokens; score is the model's log10 probability.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)))
    train = docs.where("not held_out")
    counts = written(count_tokens(train), "token-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = fit(train, counts, v, **options)
    head = max(head, len(model.vocabulary.keys))
    top = counts.orderBy(F.desc("c"), "hash").limit(head).toPandas()
    hk = top["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hk)
    hk, hc = hk[order], top["c"].to_numpy(np.int64)[order].astype(np.int32)
    own = _find(hk, model.vocabulary.keys)
    n_other, v_other = n - int(hc[own].sum()), v - len(own)
    tail = written(counts.join(spark.createDataFrame(pd.DataFrame({"hash": hk.view(np.int64)})), "hash", "left_anti"), "tail-counts") if v > head else None
    whole = tail is None
    sent = spark.sparkContext.broadcast((model, hk, hc))
    base_all, base_other = np.log10(n + 0.5 * (v + 1)), np.log10(n_other + 0.5 * (v_other + 1))

    def run(frames):
        model, hk, hc = sent.value
        for frame in batches(frames, "text"):
            h, first = with_ends(frame["text"].tolist())
            size = np.diff(first)
            logs, other = model.log_probability(h, first)
            at = _find(hk, h)
            c = np.where(at >= 0, hc[at], 0) if len(hk) else np.zeros(len(h))
            share = np.log10(c + 0.5)
            here = (at >= 0) | whole
            sums = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has its end token
            out = pd.DataFrame({"row": frame["row"], "doc_id": frame["doc_id"], "n_tokens": size})
            out["n_known"] = sums((c > 0).astype(np.int64))
            out["base"] = sums(np.where(here, share, 0.0)) - size * base_all
            out["model"] = sums(logs / np.log(10) + np.where(other, np.where(here, share, 0.0) - base_other, 0.0))
            out["hash"], out["times"] = -1 - frame["row"], 0
            yield out
            rest = np.flatnonzero(~here)
            if len(rest):
                doc = np.repeat(np.arange(len(frame)), size)[rest]
                o = np.lexsort((h[rest], doc))
                d, x = doc[o], h[rest][o]
                lead = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])))
                times = np.diff(np.append(lead, len(d)))
                for i in range(0, len(lead), 200_000):
                    k = lead[i : i + 200_000]
                    yield pd.DataFrame({"row": frame["row"].to_numpy()[d[k]], "doc_id": None, "n_tokens": 0, "n_known": 0, "base": 0.0, "model": 0.0, "hash": x[k].view(np.int64), "times": times[i : i + 200_000]})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    rows = rows.mapInPandas(run, "row long, doc_id string, n_tokens long, n_known long, base double, model double, hash long, times int")
    if tail is not None:
        rows = rows.join(tail, "hash", "left")
        share = F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).otherwise(0.0)
        rows = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when((F.col("times") > 0) & F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("base") + share).alias("base"), F.sum(F.col("model") + share).alias("model"))
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.select("doc_id", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))
