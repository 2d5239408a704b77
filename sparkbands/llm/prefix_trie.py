"""Trie of conversation prefixes by whole-sequence collapse.

Conversations are rebuilt: the first turns of the hundred's first conversation,
then a conversation's own turns after as many.  A sequence of turns is named by
the exclusive or of 128-bit hashes of (position, turn), so a whole conversation
is named by one aggregate without being put in order, and the name of a prefix
comes from that of the prefix one turn shorter.  Equal conversations collapse
into one weighted sequence, with the sorted list of those that end there and the
smallest of them for all; only its turns are worked on.  A sequence is a leaf if
it isn't among the proper prefixes of others (anti-join).  Prefixes are nodes,
with weights summed over the sequences that begin with them.

A node's own value goes to the sequence with its smallest member alone.  Sums
from a depth to a sequence's end, added over the sequences through a node, are
then the sums over its subtree, and no node is joined to all of its ancestors.

Nodes that many sequences or children meet in are at most a fixed number and are
broadcast; others meet in shuffles.  Order within a conversation comes from one
sort by ranges, running sums go over runs of 1,024 turns and then over runs, so a
conversation of any length is spread.  All of it but the hashing of long end
lists is DataFrame functions.

Null role and text are empty.  Rows without conv_id belong to no conversation and
are left out.  Rows of one turn are in the order of role, then of their text's
hash; repeated rows are turns of their own.  Texts are hashed whole where they
are read.  An empty table has no members and gives no rows, not even a root.
Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

_RUN = 1024
_KEY = ["depth", "k1", "k2"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, digest, chars): a conversation's turns numbered from 0, with a hash of role and text and the text's length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(text, 256).alias("body"), F.char_length(text).cast("long").alias("chars"))
    rows = written(rows.withColumn("digest", F.sha2(F.concat("role", F.lit("\n"), "body"), 256)), "turns")
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("body"), F.rand(12)]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order[:-1])
    rows = written(rows.select("conv_id", "digest", "chars", F.monotonically_increasing_id().alias("at")), "sorted").withColumn("part", F.shiftright("at", 33))
    held = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    by = W.partitionBy("conv_id").orderBy("part")
    held = held.select("conv_id", "part", "first", (F.sum("n").over(by) - F.col("n")).alias("before"))
    return written(rows.join(held, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("n"), "digest", "chars"), "numbered")


def _in_runs(rows: DataFrame, length: str) -> DataFrame:
    """One row for each run of turns of a conversation of that length, so that a long one is met by many keys."""
    return rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(length) / _RUN).cast("long"))))


def rebuilt(rows: DataFrame, shared: int = 6, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, digest, chars) of the rebuilt conversations, and (conv_id, length) of all of them."""
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared})
    there = convs.where("conv_id = base").select("base", F.least("own", F.lit(shared)).alias("has"))
    convs = convs.join(there, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).drop("has"), "conversations")
    heads = rows.where((F.col("conv_id") % every == 0) & (F.col("n") < shared)).withColumnRenamed("conv_id", "base")
    begin = convs.join(heads, "base").where("n < taken").select("conv_id", F.col("n").alias("pos"), "digest", "chars")
    own = rows.withColumn("run", F.floor(F.col("n") / _RUN)).join(_in_runs(convs, "own").select("conv_id", "run", "h", "taken"), ["conv_id", "run"])
    own = own.where("n >= h").select("conv_id", (F.col("taken") + F.col("n") - F.col("h")).alias("pos"), "digest", "chars")
    both = begin.unionByName(own).withColumns({"z1": F.xxhash64("pos", "digest"), "z2": F.xxhash64("digest", "pos", F.lit(12))})
    return written(both.drop("digest"), "rebuilt"), convs.select("conv_id", "length")


def sequences(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the name of their sequence (depth, k1, k2), and the distinct sequences with weight and smallest member."""
    named = rows.groupBy("conv_id").agg(F.bit_xor("z1").alias("k1"), F.bit_xor("z2").alias("k2"))
    zero = F.lit(0).cast("long")
    named = written(convs.join(named, "conv_id", "left").select("conv_id", F.col("length").alias("depth"), F.coalesce("k1", zero).alias("k1"), F.coalesce("k2", zero).alias("k2")), "named")
    return named, written(named.groupBy(*_KEY).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")), "sequences")


def _carried(rows: DataFrame, columns: list, back: bool = False) -> DataFrame:
    """Running totals of columns along a sequence (from its end if ``back``), by runs and then over runs.

    ``columns``: (name, aggregate, how two totals make one).
    """
    order, runs = ("depth", "run") if not back else (F.desc("depth"), F.desc("run"))
    inner = W.partitionBy("rep", "run").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = rows.groupBy("rep", "run").agg(*(f(F.col(c)).alias(f"t_{c}") for c, f, _ in columns))
    before = W.partitionBy("rep").orderBy(runs).rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select("rep", "run", *(f(F.col(f"t_{c}")).over(before).alias(f"t_{c}") for c, f, _ in columns)).where(F.col(f"t_{columns[0][0]}").isNotNull())
    rows = rows.withColumns({c: f(F.col(c)).over(inner) for c, f, _ in columns}).join(whole, ["rep", "run"], "left")
    return rows.withColumns({c: how(F.col(c), F.coalesce(f"t_{c}", F.lit(0).cast("long"))) for c, _, how in columns}).drop(*(f"t_{c}" for c, _, _ in columns))


def prefixes(rows: DataFrame, seqs: DataFrame) -> DataFrame:
    """Each prefix of each distinct sequence: its name, its parent's name, the sequence's weight and the last turn's length."""
    reps = _in_runs(seqs.select(F.col("rep").alias("conv_id"), "weight", F.col("depth").alias("length")), "length")
    own = rows.withColumn("run", F.floor(F.col("pos") / _RUN)).join(reps, ["conv_id", "run"])
    own = own.select(F.col("conv_id").alias("rep"), "run", (F.col("pos") + 1).alias("depth"), "length", "weight", "chars", "z1", "z2", F.col("z1").alias("k1"), F.col("z2").alias("k2"))
    xor = lambda a, b: a.bitwiseXOR(b)
    own = _carried(own, [("k1", F.bit_xor, xor), ("k2", F.bit_xor, xor)])
    own = own.select("rep", "run", "depth", "k1", "k2", "length", "weight", "chars", xor(F.col("k1"), F.col("z1")).alias("p1"), xor(F.col("k2"), F.col("z2")).alias("p2"))
    root = {c: F.lit(0).cast("long") for c in ("run", "depth", "k1", "k2", "chars", "p1", "p2")}
    return written(own.unionByName(seqs.select("rep", F.col("depth").alias("length"), "weight").withColumns(root)), "prefixes")


def _with(rows: DataFrame, nodes: DataFrame, meets: str, total: int) -> DataFrame:
    """Joins rows to their nodes on ``depth, k1, k2``.

    Nodes that more than a ten-thousandth of all rows meet in are at most ten
    thousand, whatever the size: these are broadcast, so no task holds the rows
    of one node.
    """
    limit = max(1000, total // 10_000)
    few = nodes.where(F.col(meets) > limit).drop(meets)
    found = rows.join(F.broadcast(few.withColumn("hot", F.lit(True))), _KEY, "left")
    carried = [c for c in few.columns if c not in _KEY]
    rest = found.where("hot is null").drop("hot", *carried).join(nodes.where(F.col(meets) <= limit).drop(meets), _KEY)
    return found.where("hot").drop("hot").unionByName(rest)


def _digests(named: DataFrame) -> DataFrame:
    """SHA-256 of the sorted, comma-joined ids of the conversations that end at each sequence, in chunks of at most 4,096."""
    ids = named.groupBy(*_KEY, F.shiftright("conv_id", 12).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    ids = written(ids, "ends")
    sizes = ids.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    one = sizes.where("n = 1").select(*_KEY, F.sha2("ids", 256).alias("ends_sha256"))

    def run(frames):
        """Chunks of a sequence follow one another: only the state of one hash is held."""
        key, sha = None, None
        for frame in frames:
            done = []
            for *k, text in frame.itertuples(index=False):
                if k != key:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield pd.DataFrame(done, columns=[*_KEY, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=[*_KEY, "ends_sha256"])

    many = ids.join(sizes.where("n > 1").select(*_KEY), _KEY, "left_semi").repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk")
    return one.unionByName(many.select(*_KEY, "ids").mapInPandas(run, "depth long, k1 long, k2 long, ends_sha256 string"))


def trie(conversations: DataFrame, shared: int = 6, every: int = 100) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations."""
    rows, convs = rebuilt(turns(conversations), shared, every)
    named, seqs = sequences(rows, convs)
    paths = prefixes(rows, seqs)
    proper = paths.where("depth < length").select(*_KEY).distinct()
    leaves = seqs.join(proper, _KEY, "left_anti").select(*_KEY, F.lit(1).cast("long").alias("leaf"))
    nodes = paths.groupBy(*_KEY).agg(F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.count("*").alias("n_paths"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    nodes = nodes.join(leaves, _KEY, "left").join(children, _KEY, "left")
    nodes = written(nodes.withColumns({"leaf": F.coalesce("leaf", zero), "n_children": F.coalesce("n_children", zero), "value": (F.col("n_convs") - 1) * F.col("chars")}), "nodes")
    total = paths.count()

    owned = _with(paths.select(*_KEY, "rep", "run"), nodes.select(*_KEY, "n_paths", "conv_id", "value", "leaf"), "n_paths", total)
    mine = F.col("conv_id") == F.col("rep")
    owned = owned.withColumns({c: F.when(mine, F.col(c)).otherwise(0) for c in ("value", "leaf")}).drop("conv_id")
    plus = lambda a, b: a + b
    sums = _carried(owned, [("value", F.sum, plus), ("leaf", F.sum, plus)], back=True)
    sums = sums.groupBy(*_KEY).agg(F.sum("value").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    parents = nodes.where("n_children > 0").select(*_KEY, F.col("conv_id").alias("parent_conv_id"), "n_children")
    up = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    up = _with(up, parents, "n_children", total).select((F.col("depth") + 1).alias("depth"), F.col("c1").alias("k1"), F.col("c2").alias("k2"), "parent_conv_id")
    out = nodes.join(sums, _KEY).join(up, _KEY, "left").join(_digests(named), _KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
