"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds the 64-bit hashes of its distinct word shingles.  Sets
that agree in size and in two 64-bit sums of their hashes are one class.  Each of ``trees`` independent trees starts from two chosen
minwise tokens of every class; classes with the same choice share a node.  Nodes
whose classes are already connected need no more comparisons.  In the others

* every class is compared with the node's smallest class (its leader);
* small nodes, or those with few classes outside their largest component, are
  compared exhaustively across components: only such pairs can still join two.
  The node is cut into blocks, and each pair of blocks is one group, so that
  neither a task nor a row holds a node;
* larger nodes branch: each class goes on in three ways, by three more minwise
  tokens each, chosen by the node, until its nodes are small.  These tokens are
  the smallest hashes in bins of the set that the node draws afresh, so trees
  and levels stay independent.

Every comparison first holds sketches (the smallest hash in each of 512 bins)
against each other.  Pairs whose sketches cannot belong to the threshold (4.5
standard deviations) are left out, all others are confirmed on their full sets.  A pair at the
threshold shares a starting node in no tree with probability
``(1 - threshold**2) ** trees``, about 1e-9 for 0.8 and 20 trees; where nodes
branch without end, a pair at 0.8 goes on in at least one way with probability
0.78 and so is missed by all trees with probability ``(1 - 0.64 * 0.78) ** 20``,
about 1e-6.

Texts that are null or without words have an empty set and link with nothing;
with fewer words than a shingle the whole sequence is the one shingle.  Repeated
rows link like copies.  Rows without an id link like others and take the
smallest id of their component, null if it has none.  An empty table gives no
rows.  Whole texts are read, however long, a batch at a time.  Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, written
from .graph import components
from .text import batches, joined, mix, tokens

#: Bins of a sketch, and classes in a block of a node.
_BINS, _BLOCK = 512, 512


def shingle_sets(texts: list, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    t = tokens(texts)
    run = joined(t.hashes, width)
    out = []
    for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        else:
            out.append(joined(t.hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], k: int, seed: int = 77) -> np.ndarray:
    """(sets, k) minwise values of non-empty sets."""
    rng = np.random.default_rng(seed)
    mul, add = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 2**63, k, dtype=np.uint64)
    every = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((len(sets), k), np.uint32)
    for i in range(k):
        out[:, i] = np.minimum.reduceat(((every * mul[i] + add[i]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums of differently mixed hashes: 128 bits that name the set."""
    sums = [mix(shingles ^ np.uint64(c)).sum(dtype=np.uint64) + np.uint64(len(shingles)) for c in (0, 0x5555555555555555)]
    return tuple(mix(np.array(sums, np.uint64)).view(np.int64).tolist())


def sketch(shingles: np.ndarray) -> bytes:
    """A byte from 1 to 254 of the smallest hash in each bin of sorted shingles, 0 for an empty bin."""
    edges = np.arange(_BINS, dtype=np.uint64) << np.uint64(55)
    at = np.searchsorted(shingles, edges)
    held = np.diff(at, append=len(shingles)) > 0
    out = np.zeros(_BINS, np.uint8)
    out[held] = shingles[at[held]] % np.uint64(254) + np.uint64(1)
    return out.tobytes()


def alike(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Shares of equal bins of sketches, of sets of n_a and n_b; -1 where they cannot reach the similarity.

    The smallest hashes of the filled bins are drawn without replacement from
    the union, so equal ones follow a hypergeometric distribution.
    """
    bins = np.maximum(((a | b) > 0).sum(-1), 1)
    p = percent / 100
    union = np.maximum((n_a + n_b) / (1 + p), bins)
    share = ((a == b) & (a > 0)).sum(-1) / bins
    least = p - 4.5 * np.sqrt(p * (1 - p) / bins * (union - bins) / np.maximum(union - 1, 1)) - 1 / bins
    return np.where(share >= least, share, -1.0)


def described(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, h1, h2, sketch, paths) of each row of docs(doc_id, text); h1 is null for empty sets."""

    def run(frames):
        for frame in batches(frames, "text", 2 << 20):
            sets = shingle_sets(frame["text"].tolist(), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            out = frame.drop(columns="text").assign(n_shingles=[len(s) for s in sets])
            one, two, short, paths = ([None] * len(sets) for _ in range(4))
            if full:
                found = signatures([sets[i] for i in full], 2 * trees).astype(np.uint64)
                start = mix((found[:, 0::2] << np.uint64(32) | found[:, 1::2]) + np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                for k, i in enumerate(full):
                    (one[i], two[i]), short[i], paths[i] = set_id(sets[i]), sketch(sets[i]), start[k].tolist()
            yield out.assign(h1=pd.array(one, "Int64"), h2=pd.array(two, "Int64"), sketch=short, paths=paths)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    out = rows.mapInPandas(run, "doc_id string, text_hash long, n_shingles long, h1 long, h2 long, sketch binary, paths array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def star(live: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a node's leader and its other classes that may reach the similarity."""
    pairs = live.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    named = lambda c: classes.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("n_shingles").alias(f"n_{c}"))

    def close(frames):
        for f in frames:
            if len(f):
                a, b = (np.frombuffer(b"".join(f[c]), np.uint8).reshape(len(f), _BINS) for c in ("sketch_a", "sketch_b"))
                yield f.loc[alike(a, b, f["n_a"].to_numpy(), f["n_b"].to_numpy(), percent) >= 0, ["a", "b"]]

    near = pairs.join(named("a"), "a").join(named("b"), "b").where("100 * least(n_a, n_b) >= %d * greatest(n_a, n_b)" % percent)
    return near.mapInPandas(close, "a long, b long")


def cross(near: DataFrame, classes: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b) of classes of one node and two components that may reach the similarity.

    near(path, node, label, most, n, m): ``most`` is the label of the largest
    component with ``m`` of the ``n`` classes.  Those outside it come first in
    the numbering of blocks; blocks within it are not compared with each other.
    A pair is given by the smallest of the paths that its classes share.
    ``best`` gives only the likeliest partner of a class in each group: links of
    these join most components, and few pairs are left for the full comparison.
    """
    ways = near.groupBy("node").agg(F.collect_list("path").alias("ways"))
    rows = near.join(ways.join(classes.select("node", "n_shingles", "sketch"), "node"), "node")
    one, out = F.col("n") <= _BLOCK, F.col("label") != F.col("most")
    first = F.ceil((F.col("n") - F.col("m")) / _BLOCK)
    rest = F.ceil(F.col("m") / _BLOCK)
    at = lambda k: F.pmod(F.xxhash64("node"), k).cast("int")
    rows = rows.withColumn("x", F.when(one, 0).when(out, at(first)).otherwise(first + at(rest)).cast("int"))
    last = F.when(one, 0).when(out, first + rest - 1).otherwise(first - 1).cast("int")
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), last)))
    held = F.collect_list(F.struct("node", "label", "n_shingles", "x", "sketch", "ways")).alias("g")
    groups = rows.groupBy("path", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(held)
    groups = groups.where(F.size("g") > 1).select("path", "lo", "hi", *(F.col("g")[c].alias(c) for c in ("node", "label", "n_shingles", "x", "sketch", "ways")))

    def compare(frames):
        for f in frames:
            found = [np.empty((0, 2), np.int64)]
            for g in f.itertuples(index=False):
                node, label, n, x = (np.asarray(v, np.int64) for v in (g.node, g.label, g.n_shingles, g.x))
                short = np.frombuffer(b"".join(g.sketch), np.uint8).reshape(len(node), _BINS)
                ways = [set(w.tolist()) for w in g.ways]
                for i in np.flatnonzero(x == g.lo):
                    ok = (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
                    ok &= node > node[i] if g.lo == g.hi else x == g.hi
                    ok = np.flatnonzero(ok)
                    share = alike(short[ok], short[i], n[ok], n[i], percent)
                    here = [k for k in np.flatnonzero(share >= 0).tolist() if min(ways[i] & ways[ok[k]]) == g.path]
                    ok = ok[[max(here, key=share.__getitem__)] if best and here else here]
                    found.append(np.column_stack([np.full(len(ok), node[i]), node[ok]]))
            found = np.sort(np.concatenate(found), axis=1)
            yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return groups.mapInPandas(compare, "a long, b long")


def confirmed(near: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the similarity."""
    needed = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    owners = classes.select("node", "h1", "h2", F.col("owner").alias("own"), "text_hash").join(needed, "node")

    def full(frames):
        met: set = set()  # rows without an id may hold a text many times
        for frame in frames:
            frame = frame[~(frame["node"].isin(met) | frame["node"].duplicated())]
            met.update(frame["node"].tolist())
            for part in batches([frame], "text", 2 << 20):
                sets = shingle_sets(part["text"].tolist(), width)
                ok = [i for i, s in enumerate(sets) if len(s) and set_id(s) == (part["h1"].iat[i], part["h2"].iat[i])]
                yield pd.DataFrame({"node": [part["node"].iat[i] for i in ok], "shingles": [sets[i].tobytes() for i in ok]})

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    owners = written(owners, "owners")
    wanted = owners.select(F.col("own").alias("doc_id"), "text_hash")
    texts = maybe_in(texts, wanted, ["doc_id", "text_hash"]).where("maybe").alias("d")
    same = (F.col("d.text_hash") == F.col("o.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("o.own"))
    texts = texts.join(owners.alias("o"), same).select("node", "h1", "h2", "text")
    sets = written(texts.mapInPandas(full, "node long, shingles binary").dropDuplicates(["node"]), "sets")

    def exact(frames):
        for f in frames:
            keep = []
            for x, y in zip(f["x"], f["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield f.loc[np.array(keep, bool), ["a", "b"]]

    pairs = near.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    return pairs.mapInPandas(exact, "a long, b long")


def link(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = 20, small: int = 2048, levels: int = 12) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = written(described(docs, width, trees), "described")
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("owner")
    classes = rows.where("h1 is not null").groupBy("h1", "h2", "n_shingles").agg(owner, F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n_shingles", F.col("owner.doc_id").alias("owner"), F.col("owner.text_hash").alias("text_hash"), "sketch", "paths")
    classes = written(classes, "classes")
    nodes = classes.select("node", F.explode("paths").alias("path"))
    seen = labels = None
    for level in range(levels):
        size = nodes.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
        live = written(nodes.join(size, "path"), "live")
        if live.isEmpty():
            break
        seen, new = _compared(star(live, classes, percent), seen, classes, docs, width, percent)
        labels = _merged(labels, new)
        live = live.drop("leader")
        for best in (True, False):
            live = written(_mixed(live, labels), "mixed")
            few = F.lit(True) if level == levels - 1 else (F.col("n") <= small) | (F.col("n") - F.col("m") <= small)
            seen, new = _compared(cross(live.where(few), classes, percent, best), seen, classes, docs, width, percent)
            labels = _merged(labels, new)
        big = live.where(~few).select("node", "path")
        if big.isEmpty():
            break
        nodes = written(branched(big.join(classes.select("node", "sketch"), "node")), "nodes")
    result = classes.select("node", "h1", "h2", "n_shingles", "owner")
    if labels is not None:
        result = _labelled(result, labels)
        result = result.join(result.groupBy("label").agg(F.min("owner").alias("component_id")), "label").select("h1", "h2", "n_shingles", "component_id")
    else:
        result = result.withColumnRenamed("owner", "component_id").drop("node")
    result = written(result, "components")
    with_set = rows.where("h1 is not null").select("doc_id", "n_shingles", "h1", "h2").join(result, ["h1", "h2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    without = rows.where("h1 is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_set.unionByName(without).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _compared(pairs: DataFrame, seen: DataFrame | None, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """All pairs held against each other so far, and those of ``pairs`` that are new and confirmed (None: none)."""
    pairs = pairs.distinct()
    pairs = written(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
    if pairs.isEmpty():
        return pairs if seen is None else seen, None
    new = written(confirmed(pairs, classes, docs, width, percent), "confirmed")
    return pairs if seen is None else seen.unionByName(pairs), None if new.isEmpty() else new


def _mixed(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(path, node, n, label, most, m) of the nodes of trees that still hold more than one component."""
    live = _labelled(live.select("path", "node", "n"), labels)
    parts = live.groupBy("path", "label").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("path").agg(F.count("*").alias("k"), F.max(F.struct("m", "label")).alias("top")).where("k > 1")
    return live.join(mixed.select("path", F.col("top.label").alias("most"), F.col("top.m").alias("m")), "path")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds the component of each node, itself where it has no links."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _merged(labels: DataFrame | None, new: DataFrame | None) -> DataFrame | None:
    """The labels after new links: components of components."""
    if new is None:
        return labels
    if labels is None:
        return written(components(new).withColumnRenamed("component", "label"), "labels")
    for c in ("a", "b"):
        named = labels.select(F.col("node").alias(c), F.col("label").alias("up"))
        new = new.join(named, c, "left").withColumn(c, F.coalesce("up", c)).drop("up")
    joined_ = written(components(new), "components-joined")
    old = labels.join(joined_.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("component", "label").alias("label"))
    fresh = joined_.join(labels, "node", "left_anti").select("node", F.col("component").alias("label"))
    return written(old.unionByName(fresh), "labels")


def branched(nodes: DataFrame) -> DataFrame:
    """(node, path) one level on: three ways of three minwise tokens, of bins chosen by the path.

    An empty bin takes the next one that is filled, with the distance to it.
    """

    def run(frames):
        for f in frames:
            for a in range(0, len(f), 4096):
                part = f.iloc[a : a + 4096]
                path = part["path"].to_numpy(np.int64).view(np.uint64)
                bins = np.frombuffer(b"".join(part["sketch"]), np.uint8).reshape(len(part), _BINS)
                far = np.where(np.tile(bins, 2) > 0, np.arange(2 * _BINS, dtype=np.int32), np.int32(3 * _BINS))
                filled = np.minimum.accumulate(far[:, ::-1], 1)[:, ::-1]
                rows = np.arange(len(part))
                for way in range(3):
                    onward = mix(path + np.uint64(way + 1))
                    for k in range(3):
                        at = (mix(path + np.uint64(3 * way + k + 4)) % np.uint64(_BINS)).astype(np.int64)
                        to = filled[rows, at]
                        token = bins[rows, to % _BINS].astype(np.uint64) + ((to - at).astype(np.uint64) << np.uint64(8))
                        onward = mix(onward ^ token)
                    yield pd.DataFrame({"node": part["node"], "path": onward.view(np.int64)})

    return nodes.mapInPandas(run, "node long, path long")
