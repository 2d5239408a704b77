"""Approximate nearest neighbours by a forest of hash prefixes.

A row's hash string in a tree is made of ``_DIGITS`` digits: each is the axis,
with its sign, that is nearest to the vector in a random projection to
``_AXES`` axes.  Rows are read as they lie, in shards of ``shard`` rows, and a
shard sorts its strings once for each of ``trees`` trees.  A query descends in
each tree to the longest prefix that some row shares with it, and all trees
ascend together, a bit at a time, until the distinct rows under the prefixes are
as many as wanted; in the last step tree after tree goes up.  Those candidates
alone are compared by cosine in double precision.

What is wanted is ``effort * rows ** 0.75`` of all rows and ``least`` at the
least, a shard's part of it in each shard, so the share that is compared falls as
the table grows; a table of at most ``least`` rows is climbed to the roots, which
is exact.  Queries
are met in blocks that are broadcast, of at most ``block`` numbers, and the best
``k`` of every shard are merged per query; rows are neither copied nor shuffled,
so a hot vector or label makes no hot task.

Null vectors, zero vectors and those with null or non-finite components take no
part, neither do rows without an id; vectors of other lengths than the query's
are no candidates.  Copies inside a shard are one candidate with its smallest
ids; ties go to the smaller id.  A row that repeats an id is one neighbour, with
the best of its scores; of queries that repeat an id all vectors ask, and the
best scores stay.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .embedding_dedup import _matrix, usable

_AXES, _DIGITS = 16, 4
_DIGIT_BITS = 5
_BITS = _DIGITS * _DIGIT_BITS


def hashes(x: np.ndarray, trees: int, seed: int = 11) -> np.ndarray:
    """(trees, rows) hash strings, the first digit in the highest bits; a digit is its sign and then its axis."""
    x = (x / np.abs(x).max(1, keepdims=True)).astype(np.float32)
    rng, rows = np.random.default_rng(seed + x.shape[1]), np.arange(len(x))
    out = np.zeros((trees, len(x)), np.uint32)
    for t in range(trees):
        turned = (x @ rng.normal(size=(x.shape[1], _DIGITS * _AXES)).astype(np.float32)).reshape(len(x), _DIGITS, _AXES)
        axis = np.abs(turned).argmax(2)
        sign = np.take_along_axis(turned, axis[:, :, None], 2)[:, :, 0] > 0
        for d in range(_DIGITS):
            out[t] = out[t] << np.uint32(_DIGIT_BITS) | (sign[:, d] * _AXES + axis[:, d]).astype(np.uint32)
    return out


class Forest:
    """Sorted hash strings of one shard."""

    def __init__(self, strings: np.ndarray):
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def ranges(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query, the rows that share the first ``depth`` bits."""
        low = np.uint32((1 << (_BITS - depth)) - 1)
        a, b = q & ~low, q | low
        lo = np.stack([np.searchsorted(s, x, "left") for s, x in zip(self.sorted, a)])
        hi = np.stack([np.searchsorted(s, x, "right") for s, x in zip(self.sorted, b)])
        return lo, hi

    def met(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which rows the ranges hold."""
        out = np.zeros(self.order.shape[1], bool)
        for rows, a, b in zip(self.order, lo.tolist(), hi.tolist()):
            if b > a:
                out[rows[a:b]] = True
        return out

    def candidates(self, q: np.ndarray, wanted: int) -> list[np.ndarray]:
        """Rows under the longest prefixes that together hold ``wanted`` distinct rows."""
        n, rows = q.shape[1], self.order.shape[1]
        out: list = [np.empty(0, np.int64)] * n
        held = [np.zeros(rows, bool)] * n  # what the prefixes one bit longer hold
        open_ = np.arange(n)
        for depth in range(_BITS, -1, -1):  # up in all trees at once
            lo, hi = self.ranges(q[:, open_], depth)
            left = []
            for k, i in enumerate(open_.tolist()):
                if depth and (hi[:, k] - lo[:, k]).sum() < wanted:
                    held[i] = None
                    left.append(i)
                    continue
                below = held[i]
                if below is None:
                    below = self.met(*(x[:, 0] for x in self.ranges(q[:, [i]], depth + 1)))
                found, size = below.copy(), int(below.sum())
                for t in range(len(self.order)):  # the last step: one tree after another
                    part = self.order[t, lo[t, k] : hi[t, k]]
                    fresh = part[~found[part]]
                    found[fresh] = True
                    size += len(fresh)
                    if size >= wanted:
                        break
                if size >= wanted or not depth:
                    out[i] = np.flatnonzero(found)
                else:
                    held[i] = found
                    left.append(i)
            open_ = np.array(left, np.int64)
            if not len(open_):
                break
        return out


def search(vectors: DataFrame, every: int = 50, k: int = 5, trees: int = 256, effort: float = 1.45, least: int = 1024, shard: int = 8192, block: int = 1 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score, n_compared): the k nearest found of each row whose id is divisible by ``every``, and how many rows the query was compared with."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = rows.where(F.col("vec_id") % every == 0)
    n = rows.count()
    q, longest = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    share = min(1.0, max(effort * max(n, 1) ** -0.25, least / max(n, 1)))
    blocks = max(1, -(-q * longest // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(blocks)))

    def hashed(frames):
        for f in frames:
            size = f["embedding"].map(len)
            for _, part in f.groupby(size):
                h = hashes(_matrix(part["embedding"]), trees)
                yield part.assign(strings=[x.tobytes() for x in h.T])

    asked = written(asked.mapInPandas(hashed, "vec_id long, embedding array<double>, block long, strings binary"), "queries")
    near = None
    for b in range(blocks):
        ask = {}
        for size, part in (f := asked.where(F.col("block") == b).toPandas()).groupby(f["embedding"].map(len)):
            ask[int(size)] = (part["vec_id"].to_numpy(np.int64), _matrix(part["embedding"]), np.stack([np.frombuffer(s, np.uint32) for s in part["strings"]], 1))
        if ask:
            found = rows.mapInPandas(_met(spark.sparkContext.broadcast(ask), k, trees, share, shard), "query_id long, vec_id long, score double, n_compared long")
            found = written(found, "near")
            near = found if near is None else near.unionByName(found)
    if near is None:
        near = spark.createDataFrame([], "query_id long, vec_id long, score double, n_compared long")
    compared = near.where("vec_id is null").groupBy("query_id").agg(F.sum("n_compared").alias("n_compared"))
    best = near.where("vec_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.join(compared, "query_id").select("query_id", "rank", "vec_id", "score", "n_compared")


def _met(sent, k: int, trees: int, share: float, shard: int):
    """What a task does: cut its rows into shards, and let all queries of the block search each."""

    def one(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, y: np.ndarray, strings: np.ndarray) -> pd.DataFrame:
        x, ids, more = _copies(x, ids, k)
        found = Forest(hashes(x, trees)).candidates(strings, max(k + 1, int(np.ceil(share * len(x)))))
        out = []
        # cosine() in two halves: what belongs to a row is worked out once
        (xs, xn), (ys, yn) = _scaled(x), _scaled(y)
        for i, c in enumerate(found):
            s = (xs[c] * ys[i]).sum(1) / (yn[i] * xn[c])
            at = np.argpartition(-s, min(2 * k, len(s) - 1))[: 2 * k] if len(s) else np.empty(0, np.int64)
            if len(at):  # all that tie with the last of them too
                at = np.flatnonzero(s >= s[at].min())
            best = sorted((-s[j], v) for j in at.tolist() for v in (ids[c[j]], *more.get(int(c[j]), ())) if v != qid[i])[:k]
            out += [(qid[i], v, -d, 0) for d, v in best] + [(qid[i], None, None, len(c))]
        made = pd.DataFrame(out, columns=["query_id", "vec_id", "score", "n_compared"])
        return made.astype({"vec_id": "Int64", "score": float})

    def run(frames):
        held: dict = {}
        for f in frames:
            for size, part in f.groupby(f["embedding"].map(len)):
                if size not in sent.value:
                    continue
                ids, x = part["vec_id"].to_numpy(np.int64), _matrix(part["embedding"])
                if size in held:
                    ids, x = np.concatenate([held[size][0], ids]), np.concatenate([held[size][1], x])
                while len(ids) >= shard:
                    yield one(ids[:shard], x[:shard], *sent.value[size])
                    ids, x = ids[shard:], x[shard:]
                held[size] = ids, x
        for size, (ids, x) in held.items():
            if len(ids):
                yield one(ids, x, *sent.value[size])

    return run


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled so that no square overflows, and their lengths."""
    x = x / np.abs(x).max(1)[:, None]
    return x, np.sqrt((x * x).sum(1))


def _copies(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """One row per different vector with its smallest id, and the next k ids of each that has more."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    groups: dict = {}
    for i, raw in enumerate(x):
        groups.setdefault(raw.tobytes(), []).append(i)
    first = [g[0] for g in groups.values()]
    more = {p: sorted(set(ids[g].tolist()))[1 : k + 1] for p, g in enumerate(groups.values()) if len(g) > 1}
    return x[first], ids[first], more
