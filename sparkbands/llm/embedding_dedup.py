"""Embedding near-duplicates by dual traversal of cover trees, exact at a cosine threshold.

On unit vectors cosine >= c means distance <= sqrt(2 - 2c).  Equal vectors of a
label are one class.  A bounded sample of classes (``cells``, fewer where there
is less to divide) makes the top of a tree for each label: nested nets with
halving radii.  Every class goes to its nearest leaf; a node's covering radius
is the largest distance of its members from its centre.  Pairs of nodes whose
centres are further apart than the threshold and both radii are pruned, level by
level, and what is left are pairs of leaves.  Leaves are cut into blocks of
about ``block`` classes; a block is one row with its vectors and the tree below, which
is built once, and each pair of blocks that is left traverses two such trees in
the same way.  A pair is linked if the cosine
of the original vectors in double precision reaches the threshold.

Only vectors with the same label (not null) and the same length are compared.
Null vectors, zero vectors and those with null or non-finite components link
with nothing; neither do rows without a label.  Rows that repeat an id count as
vectors of their own, whatever their vectors.  Labels may be of any type that
has a text form.  An empty table gives no rows.  Extra columns are ignored.

Random vectors of many dimensions lie about 1.4 apart, so no bound on a radius
over 0.6 prunes them: levels where most pairs are left are compared by one
matrix product, and the work inside a label grows with its square.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components


def usable(vector: Column) -> Column:
    """Not null, and of finite components that are not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nets(points: np.ndarray, first: float = 1.0, last: float = 0.125) -> list[tuple[float, np.ndarray]]:
    """Nested nets of unit vectors: (radius, indices of centres), each point within the radius of a centre."""
    out, centres, radius = [], [], first
    while True:
        near = np.full(len(points), np.inf)
        for c in centres:
            near = np.minimum(near, 2 - 2 * (points @ points[c]))
        open_ = np.flatnonzero(near > radius * radius + 1e-12)
        while len(open_):
            # a run of open points at once: those of it that no earlier one of the run covers become centres
            run = open_[:256]
            apart = 2 - 2 * (points[run] @ points[run].T) > radius * radius + 1e-12
            new: list = []
            for i in range(len(run)):
                if not new or apart[i, new].all():
                    new.append(i)
            centres += run[new].tolist()
            d = 2 - 2 * (points[open_] @ points[run[new]].T)
            open_ = open_[(d > radius * radius + 1e-12).all(1)]
        out.append((radius, np.array(centres)))
        if radius <= last or len(centres) == len(points):
            return out
        radius /= 2


def tree(points: np.ndarray, first: float = 1.0, last: float = 0.125) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level from the coarsest: (centres, parent of each centre, covering radius over all points below it)."""
    levels, member, out = nets(points, first, last), np.arange(len(points)), []
    up = None
    for k in range(len(levels) - 1, -1, -1):
        centres = levels[k][1]
        fine = points if up is None else points[up]
        at = np.concatenate([(fine[i : i + 1024] @ points[centres].T).argmax(1) for i in range(0, len(fine), 1024)])
        member = at[member]
        d = np.sqrt(np.maximum(2 - 2 * (points * points[centres][member]).sum(1), 0))
        radius = np.zeros(len(centres))
        np.maximum.at(radius, member, d)
        out.append([centres, at, radius])
        up = centres
    return out[::-1]


def traverse(a: np.ndarray, b: np.ndarray | None, reach: float, ta: list | None = None, tb: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors within ``reach``; of one set with itself if b is None (each pair once)."""
    ta = ta or tree(a)
    tb, other = (ta, a) if b is None else (tb or tree(b), b)
    depth = max(len(ta), len(tb))
    ia, ib = np.divmod(np.arange(len(ta[0][0]) * len(tb[0][0])), len(tb[0][0]))
    for level in range(depth + 1):
        la, lb = min(level, len(ta)), min(level, len(tb))
        ca, ra = (ta[la][0], ta[la][2]) if la < len(ta) else (np.arange(len(a)), np.zeros(len(a)))
        cb, rb = (tb[lb][0], tb[lb][2]) if lb < len(tb) else (np.arange(len(other)), np.zeros(len(other)))
        keep = _near(a[ca], other[cb], ia, ib, lambda x, y: (reach + ra[x] + rb[y]) ** 2 + 1e-9)
        ia, ib = ia[keep], ib[keep]
        if level == depth:
            break
        ia, ib = _below(ta, la, ia, ib)
        ib, ia = _below(tb, lb, ib, ia)
    if b is None:
        half = ia < ib
        ia, ib = ia[half], ib[half]
    return ia, ib


def _near(x: np.ndarray, y: np.ndarray, ia: np.ndarray, ib: np.ndarray, bound) -> np.ndarray:
    """Which pairs of unit vectors have a squared distance of at most bound(ia, ib)."""
    if len(ia) * 8 > len(x) * len(y):  # most pairs are left: one matrix product
        d = 2 - 2 * (x @ y.T)
        return d[ia, ib] <= bound(ia, ib)
    keep = np.empty(len(ia), bool)
    for s in range(0, len(ia), 1 << 15):
        p, q = ia[s : s + (1 << 15)], ib[s : s + (1 << 15)]
        keep[s : s + (1 << 15)] = 2 - 2 * np.einsum("ij,ij->i", x[p], y[q]) <= bound(p, q)
    return keep


def _packed(levels: list) -> bytes:
    """A tree as bytes."""
    parts = [np.array([len(levels)], "<i8")]
    for centres, parent, radius in levels:
        parts += [np.array([len(centres), len(parent)], "<i8"), centres.astype("<i8"), parent.astype("<i8"), radius.astype("<f8").view("<i8")]
    return np.concatenate(parts).tobytes()


def _unpacked(raw: bytes) -> list:
    x, at, out = np.frombuffer(raw, "<i8"), 1, []
    for _ in range(x[0]):
        n, m = x[at : at + 2]
        at += 2
        out.append((x[at : at + n], x[at + n : at + n + m], x[at + n + m : at + 2 * n + m].view("<f8")))
        at += 2 * n + m
    return out


def _below(levels: list, k: int, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace nodes of level k by their children (points under the last level), with the partners repeated."""
    if k >= len(levels):
        return own, other
    parent = levels[k][1]  # of each centre of the level below, or of each point
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(len(levels[k][0]) + 1))
    n = first[own + 1] - first[own]
    total = np.cumsum(n) - n
    child = order[np.repeat(first[own] - total, n) + np.arange(n.sum())]
    return child, np.repeat(other, n)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; scaled first, so that no square overflows."""
    sx, sy = np.abs(x).max(1), np.abs(y).max(1)
    x, y = x / sx[:, None], y / sy[:, None]
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _roots(n: int, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Smallest index connected with each index."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[ia], root[ib])
        new = root.copy()
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        np.minimum.at(new, root[ia], low)
        np.minimum.at(new, root[ib], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link(vectors: DataFrame, threshold: float = 0.98, cells: int = 2048, block: int = 2000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label)."""
    spark, reach = vectors.sparkSession, math.sqrt(2 - 2 * threshold)
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("ok", usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(7), "embedding", "label")})
    classes = rows.where("ok").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    # a class has a number of its own: ids may stand in more than one
    classes = written(classes.withColumns({"dim": F.size("embedding"), "node": F.monotonically_increasing_id()}), "classes")

    count = classes.count()
    leaf = classes.orderBy("h1", "h2").limit(min(cells, -(-count // block)))
    tops = {}
    for key, part in leaf.select("label", "dim", "embedding").toPandas().groupby(["label", "dim"]):
        points = _unit(_matrix(part["embedding"]))
        tops[str(key[0]), int(key[1])] = points[nets(points, 2.0)[-1][1]]
    sent = spark.sparkContext.broadcast(tops)

    def assign(frames):
        for frame in frames:
            cell, far = np.full(len(frame), -1), np.zeros(len(frame))
            for key, at in frame.groupby(["label", "dim"]).indices.items():
                if (centres := sent.value.get((str(key[0]), int(key[1])))) is not None:
                    points = _unit(_matrix(frame["embedding"].iloc[at]))
                    near = points @ centres.T
                    cell[at] = near.argmax(1)
                    far[at] = np.sqrt(np.maximum(2 - 2 * near.max(1), 0))
            yield frame.assign(cell=cell, far=far)

    placed = classes.select("label", "dim", "node", "n", "embedding").mapInPandas(assign, "label string, dim int, node long, n long, embedding array<double>, cell int, far double")
    placed = written(placed, "cells")
    sizes = written(placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("m"), F.max("far").alias("radius")), "cell-sizes")
    pairs = []
    covering = {(r.label, r.dim, r.cell): r.radius for r in sizes.where("cell >= 0").collect()}  # at most ``cells``
    for (label, dim), centres in tops.items():
        there = [c for c in range(len(centres)) if (label, dim, c) in covering]
        radius = np.array([covering[label, dim, c] for c in there])
        pairs += [(label, dim, there[i], there[j]) for i, j in _leaf_pairs(centres[there], radius, reach)]
    known = spark.createDataFrame(pairs, "label string, dim int, a int, b int")
    known = known.unionByName(sizes.where("cell < 0").select("label", "dim", F.col("cell").alias("a"), F.col("cell").alias("b")))
    blocks = sizes.select("label", "dim", F.col("cell"), F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    known = known.join(blocks.withColumnsRenamed({"cell": "a", "blocks": "na"}), ["label", "dim", "a"]).join(blocks.withColumnsRenamed({"cell": "b", "blocks": "nb"}), ["label", "dim", "b"])
    known = known.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    known = written(known.where("a <> b or x <= y").select("label", "dim", "a", "b", "x", "y"), "block-pairs")

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        """A block as one row: its vectors and the tree over them, which is built once."""
        x, first = _matrix(frame["embedding"]), frame.iloc[0]
        made = {"label": first["label"], "dim": first["dim"], "cell": first["cell"], "part": first["part"]}
        made |= {"nodes": frame["node"].to_numpy("<i8").tobytes(), "n": frame["n"].to_numpy("<i8").tobytes(), "points": x.astype("<f8").tobytes(), "tree": _packed(tree(_unit(x)))}
        return pd.DataFrame([made])

    dealt = placed.join(blocks, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    grown = dealt.groupBy("label", "dim", "cell", "part").applyInPandas(grow, "label string, dim int, cell int, part int, nodes binary, n binary, points binary, tree binary")
    grown = written(grown, "blocks")
    side = lambda c, p, s: grown.select("label", "dim", F.col("cell").alias(c), F.col("part").alias(p), *(F.col(k).alias(k + s) for k in ("nodes", "n", "points", "tree")))
    tasks = known.join(side("a", "x", "_a"), ["label", "dim", "a", "x"]).join(side("b", "y", "_b"), ["label", "dim", "b", "y"])

    def compare(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                alone = r.a == r.b and r.x == r.y
                node, n, x = (np.frombuffer(raw, kind) for raw, kind in ((r.nodes_a, "<i8"), (r.n_a, "<i8"), (r.points_a, "<f8")))
                x = y = x.reshape(len(node), r.dim)
                up, more, other, other_tree = node, n, None, None
                if not alone:
                    up, more = np.frombuffer(r.nodes_b, "<i8"), np.frombuffer(r.n_b, "<i8")
                    y = np.frombuffer(r.points_b, "<f8").reshape(len(up), r.dim)
                    other, other_tree = _unit(y), _unpacked(r.tree_b)
                ia, ib = traverse(_unit(x), other, reach + 1e-6, _unpacked(r.tree_a), other_tree)
                sure = np.concatenate([np.empty(0, bool), *(cosine(x[ia[s : s + 65536]], y[ib[s : s + 65536]]) >= threshold for s in range(0, len(ia), 65536))])
                ia, ib = ia[sure], ib[sure]
                if not alone:
                    ib, node, n = ib + len(node), np.concatenate([node, up]), np.concatenate([n, more])
                links = np.bincount(ia, n[ib], len(node)) + np.bincount(ib, n[ia], len(node))
                got = np.flatnonzero(links)
                yield pd.DataFrame({"node": node[got], "other": node[_roots(len(node), ia, ib)[got]], "links": links[got].astype(np.int64)})

    # few rows hold much: a task reads a few block pairs at a time
    tasks = tasks.repartition(F.col("label"), "dim", "a", "b", "x", "y")
    found = written(tasks.mapInPandas(compare, "node long, other long, links long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    result = classes.select("label", "h1", "h2", "node", "least", "n").join(links, "node", "left").join(joined, "node", "left")
    result = written(result.select("label", "h1", "h2", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "classes-linked")
    smallest = result.groupBy("component").agg(F.min("least").alias("component_id"))
    result = result.join(smallest, "component").select("label", "h1", "h2", "n_links", "component_id")
    good = rows.where("ok").select("vec_id", "label", "h1", "h2").join(result, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _leaf_pairs(centres: np.ndarray, radius: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Pairs of leaves (each with itself too) that the covering radii do not rule out, from the top of the nets down."""
    if not len(centres):
        return []
    levels = tree(centres, 2.0)
    # covering radii of the leaves' members, carried up
    for k in range(len(levels) - 1, -1, -1):
        ids, parent, _ = levels[k]
        below = centres if k == len(levels) - 1 else centres[levels[k + 1][0]]
        low = radius if k == len(levels) - 1 else levels[k + 1][2]
        d = np.sqrt(np.maximum(2 - 2 * (below * centres[ids][parent]).sum(1), 0)) + low
        up = np.zeros(len(ids))
        np.maximum.at(up, parent, d)
        levels[k] = (ids, parent, up)
    ia, ib = np.divmod(np.arange(len(levels[0][0]) ** 2), len(levels[0][0]))
    for k in range(len(levels) + 1):
        ids, r = (levels[k][0], levels[k][2]) if k < len(levels) else (np.arange(len(centres)), radius)
        d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", centres[ids[ia]], centres[ids[ib]]), 0))
        keep = d <= reach + r[ia] + r[ib] + 1e-6
        ia, ib = ia[keep], ib[keep]
        if k < len(levels):
            ia, ib = _below(levels, k, ia, ib)
            ib, ia = _below(levels, k, ib, ia)
    half = ia <= ib
    return list(zip(ia[half].tolist(), ib[half].tolist()))
