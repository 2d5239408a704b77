"""From labels along chromosomes to seeds, votes, co-association and consensus.

Labels are rows (chrom, w, sample_id, k) with bands 0 .. classes - 1; null and
negative labels are left out.  Two windows meet as bitmaps: a band of a window is
one row for each 256 samples, so a pair of windows costs a row for each pair of
bands and 256 samples, never one for each sample.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored

_WORDS = ("b0", "b1", "b2", "b3")  # 64 samples each
_FILL = 160  # samples a bucket holds on average, of the 256 that a row has room for
#: How much a pattern says: fixed weights of the vote patterns, others weigh nothing.
WEIGHTS = {"SINGLE": 1.0, "SUBSET": 1.0, "SUBSET_SPLIT": 0.7, "SPLIT_TWO": 0.5}


# -- bands as bitmaps ------------------------------------------------------


def places(labels: DataFrame) -> DataFrame:
    """(sample_id, chunk, place): a place of 0 .. 255 in a chunk for each sample.

    Samples are dealt over buckets by hash and numbered inside them; a bucket
    that is too full goes on in chunks of its own.
    """
    ids = stored(labels.select("sample_id").distinct())
    buckets = max(1, -(-ids.count() // _FILL))
    ids = ids.withColumn("bucket", F.pmod(F.xxhash64("sample_id"), F.lit(buckets)))
    n = F.row_number().over(W.partitionBy("bucket").orderBy("sample_id")) - 1
    return ids.withColumn("n", n).select("sample_id", (F.col("bucket") + buckets * F.shiftright("n", 8)).alias("chunk"), (F.col("n") % 256).alias("place"))


def band_bits(labels: DataFrame, keys: tuple = ("chrom",)) -> DataFrame:
    """(*keys, w, k, chunk, b0 .. b3): the samples of each band of each window, 256 of them a row."""
    rows = labels.where("k >= 0").join(places(labels), "sample_id")
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    word = F.floor(F.col("place") / 64)
    return stored(rows.groupBy(*keys, "w", "k", "chunk").agg(*(F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(c) for i, c in enumerate(_WORDS))))


def _common(x: tuple, y: tuple) -> Column:
    return reduce(lambda s, t: s + t, (F.bit_count(F.col(a).bitwiseAND(F.col(b))) for a, b in zip(x, y)))


def _named(bits: DataFrame, w: str, k: str, prefix: str) -> DataFrame:
    return bits.withColumnsRenamed({"w": w, "k": k, **{c: prefix + c for c in _WORDS}})


def pair_table(bits: DataFrame, pairs: DataFrame, keys: tuple = ("chrom",)) -> DataFrame:
    """(*keys, w1, w2, a, b, n): samples that two bands share, for the pairs (*keys, w1, w2) of windows; shared by none: no row."""
    x, y = _named(bits, "w1", "a", "x"), _named(bits, "w2", "b", "y")
    n = _common(tuple("x" + c for c in _WORDS), tuple("y" + c for c in _WORDS))
    t = x.join(pairs, [*keys, "w1"]).join(y, [*keys, "w2", "chunk"]).withColumn("n", n).where("n > 0")
    return t.groupBy(*keys, "w1", "w2", "a", "b").agg(F.sum("n").cast("long").alias("n"))


def band_sizes(bits: DataFrame, keys: tuple = ("chrom",)) -> DataFrame:
    return bits.groupBy(*keys, "w", "k").agg(F.sum(reduce(lambda s, t: s + t, map(F.bit_count, _WORDS))).cast("long").alias("m"))


def window_pairs(labels: DataFrame, radius: int, keys: tuple = ("chrom",)) -> DataFrame:
    """(*keys, w1, w2) of windows at most ``radius`` apart, by number: no join of all with all."""
    w = labels.select(*keys, "w").distinct()
    step = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    near = w.select(*keys, F.col("w").alias("w1"), step.alias("d")).where("d <> 0").select(*keys, "w1", (F.col("w1") + F.col("d")).alias("w2"))
    return near.join(w.withColumnRenamed("w", "w2"), [*keys, "w2"])


# -- alignment -------------------------------------------------------------


def _ways(spark: SparkSession, classes: int) -> DataFrame:
    """(perm, a, b): row a meets column b in permutation number ``perm``; classes! * classes rows."""
    return spark.createDataFrame([(i, a, b) for i, p in enumerate(permutations(range(classes))) for a, b in enumerate(p)], "perm int, a int, b int")


def best_permutation(table: DataFrame, by: list, classes: int) -> DataFrame:
    """(*by, perm, diagonal, n): the permutation with the largest diagonal of each table of cells (a, b, n), the first on ties."""
    spark = table.sparkSession
    total = table.groupBy(*by).agg(F.sum("n").alias("n"))
    d = table.join(F.broadcast(_ways(spark, classes)), ["a", "b"]).groupBy(*by, "perm").agg(F.sum("n").alias("diag"))
    best = d.groupBy(*by).agg(F.max(F.struct("diag", (-F.col("perm")).alias("minus"))).alias("m"))
    return best.join(total, by).select(*by, (-F.col("m.minus")).alias("perm"), F.col("m.diag").alias("diagonal"), "n")


def anchor_signals(table: DataFrame, classes: int, keys: tuple = ("chrom",), least: int = 5) -> DataFrame:
    """Per pair of windows: Cramer's V, and the entropy of what leaves the aligned diagonal.

    A row's entropy is that of its cells off the diagonal over the logarithm of
    their possible number, weighted by how many samples left; null where none
    left, and both null under ``least`` samples.
    """
    by = [*keys, "w1", "w2"]
    best = best_permutation(table, by, classes).join(F.broadcast(_ways(table.sparkSession, classes)), "perm").select(*by, "a", F.col("b").alias("own"))
    t = table.join(best, [*by, "a"])
    off = t.where("b <> own").groupBy(*by, "a").agg(F.sum("n").alias("left"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    # n * H of a row is left * ln(left) - sum(n * ln(n))
    off = off.groupBy(*by).agg(F.sum("left").alias("gone"), (F.sum(F.col("left") * F.log("left") - F.col("nlogn")) / F.log(F.lit(float(max(2, classes - 1))))).alias("h"))
    m = t.withColumns({"ra": F.sum("n").over(W.partitionBy(*by, "a")), "cb": F.sum("n").over(W.partitionBy(*by, "b"))})  # a few bands
    s = m.groupBy(*by).agg(F.sum("n").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"), F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("q"))
    v = F.when(F.least("r", "c") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - 1) / (F.least("r", "c") - 1)))))
    sure = F.col("n") >= least
    return s.join(off, by, "left").select(*by, "n", F.when(sure, v).alias("v"), F.when(sure, F.col("h") / F.col("gone")).alias("h_off"))


def chain_projection(labels: DataFrame, bits: DataFrame, classes: int, least: float = 0.50, run: int = 256) -> DataFrame:
    """Labels of every sample and window carried along a chromosome: each window is aligned to the one before, as that was aligned.

    A window that agrees with the one before by less than ``least`` begins a
    chain, and so does one without a window right before it.  Turning a window's
    labels into its chain's is a product of permutations; products are taken in
    runs of ``run`` windows, then over the runs, then carried into them.
    """
    w = labels.select("chrom", "w").distinct()
    table = pair_table(bits, window_pairs(labels, 1).where("w2 = w1 + 1"))
    ways = [list(p) for p in permutations(range(classes))]
    own = [sorted(range(classes), key=p.__getitem__) for p in ways]  # a window's label to that of the window before
    turn = F.element_at(F.array(*(F.array(*map(F.lit, p)) for p in own)), F.col("perm") + 1)
    step = best_permutation(table, ["chrom", "w1", "w2"], classes).select("chrom", F.col("w2").alias("w"), (F.col("diagonal") / F.col("n")).alias("concordance"), turn.alias("turn"))
    plain = F.array(*map(F.lit, range(classes)))
    rows = w.join(step, ["chrom", "w"], "left").withColumn("cut", F.coalesce(F.col("concordance") < least, F.lit(True)))
    rows = rows.withColumns({"turn": F.when(F.col("cut"), plain).otherwise(F.col("turn")), "run": F.floor(F.col("w") / run)})
    after = lambda p, q: F.transform(q, lambda i: F.get(p, i))
    unit = F.struct(plain.alias("turn"), F.lit(False).alias("cut"))
    then = lambda s, x: F.struct(F.when(x["cut"], x["turn"]).otherwise(after(s["turn"], x["turn"])).alias("turn"), (s["cut"] | x["cut"]).alias("cut"))
    item = F.struct("w", "turn", "cut", "concordance")
    runs = stored(rows.groupBy("chrom", "run").agg(F.array_sort(F.collect_list(item)).alias("xs")))  # at most ``run`` windows
    runs = runs.withColumn("whole", F.aggregate("xs", unit, lambda s, x: then(s, x)))
    before = W.partitionBy("chrom").orderBy("run").rowsBetween(W.unboundedPreceding, -1)  # a row for each run
    carried = F.aggregate(F.transform(F.collect_list(F.struct("run", "whole")).over(before), lambda x: x["whole"]), unit, lambda s, x: then(s, x))
    cuts = F.coalesce(F.sum(F.size(F.filter("xs", lambda x: x["cut"]))).over(before), F.lit(0))
    runs = runs.withColumns({"carried": carried, "cuts": cuts})
    # products inside a run, from what is carried into it
    scan = F.aggregate("xs", F.struct(F.array().cast("array<struct<w:int,turn:array<int>,chain:bigint,concordance:double>>").alias("done"), F.struct(F.col("carried.turn").alias("turn"), F.lit(False).alias("cut")).alias("s"), F.col("cuts").alias("n")), lambda a, x: _step(a, x, then))
    maps = runs.select("chrom", F.explode(scan["done"]).alias("x")).select("chrom", "x.w", "x.turn", "x.chain", "x.concordance")
    out = labels.where("k >= 0").join(maps, ["chrom", "w"])
    return out.select("chrom", "w", "sample_id", "k", F.get("turn", F.col("k")).alias("aligned"), "chain", "concordance")


def _step(a: Column, x: Column, then) -> Column:
    now, n = then(a["s"], x), a["n"] + x["cut"].cast("long")
    row = F.struct(x["w"].cast("int").alias("w"), now["turn"].alias("turn"), (n - 1).alias("chain"), x["concordance"].alias("concordance"))
    return F.struct(F.concat(a["done"], F.array(row)).alias("done"), now.alias("s"), n.alias("n"))


# -- seeds -----------------------------------------------------------------


def window_class(v: Column, h_off: Column, quality: Column, high: float = 0.70, moderate: float = 0.40, coherent: float = 0.40, sure: float = 0.40) -> Column:
    """INTERIOR, CROSSOVER, REGIME_END or UNRELIABLE of a window against an anchor."""
    return F.when(F.coalesce(quality < sure, F.lit(True)) | v.isNull(), "UNRELIABLE").when(v >= high, "INTERIOR").when(v < moderate, "REGIME_END").when(h_off.isNull() | (h_off <= coherent), "CROSSOVER").otherwise("REGIME_END")


def seed_anchors(quality: DataFrame, stride: int = 25, search: int = 10, least: float = 0.50) -> DataFrame:
    """(chrom, w, quality, s0, e0): the best window within ``search`` of every ``stride``-th of a chromosome, the first on ties."""
    ends = quality.groupBy("chrom").agg(F.min("w").alias("s0"), F.max("w").alias("e0"))
    grid = ends.withColumn("center", F.explode(F.sequence("s0", "e0", F.lit(stride))))
    near = grid.withColumn("w", F.explode(F.sequence(F.greatest("s0", F.col("center") - search), F.least("e0", F.col("center") + search))))
    best = near.join(quality, ["chrom", "w"]).groupBy("chrom", "center", "s0", "e0").agg(F.max(F.struct("quality", (-F.col("w")).alias("minus"))).alias("m"))
    return best.where(F.col("m.quality") >= least).select("chrom", (-F.col("m.minus")).alias("w"), F.col("m.quality").alias("quality"), "s0", "e0").distinct()


def seed_walks(classes_: DataFrame, anchors: DataFrame, radius: int = 200, extend: int = 200, tries: int = 3, stop: int = 2) -> DataFrame:
    """How far each anchor reaches: (chrom, anchor, s, e).

    ``classes_`` is (chrom, anchor, w, class).  A walk goes over INTERIOR and
    CROSSOVER and ends at the ``stop``-th REGIME_END since the last of these;
    UNRELIABLE windows count for nothing.  If it comes to the edge of the radius
    without an end, the radius grows, ``tries`` radii at most.
    """
    radii = [radius + extend * i for i in range(tries)]
    x = classes_.where(F.col("class") != "UNRELIABLE").withColumns({"side": F.signum(F.col("w") - F.col("anchor")).cast("int"), "d": F.abs(F.col("w") - F.col("anchor"))}).where("side <> 0")
    by = W.partitionBy("chrom", "anchor", "side").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)  # at most the largest radius
    end = (F.col("class") == "REGIME_END").cast("int")
    x = x.withColumn("ends", F.sum(end).over(by))
    x = x.withColumn("since", F.col("ends") - F.coalesce(F.max(F.when(end == 0, F.col("ends"))).over(by), F.lit(0)))
    x = x.withColumn("stopped", F.min(F.when(F.col("since") >= stop, F.col("d"))).over(W.partitionBy("chrom", "anchor", "side")))
    keep = (end == 0) & F.coalesce(F.col("d") < F.col("stopped"), F.lit(True))
    t = x.groupBy("chrom", "anchor", "side").agg(F.min("stopped").alias("stopped"), *(F.max(F.when(keep & (F.col("d") <= r), F.col("d"))).alias(f"kept{r}") for r in radii))
    sides = anchors.select("chrom", F.col("w").alias("anchor"), "s0", "e0").withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    t = sides.join(t, ["chrom", "anchor", "side"], "left")
    room = F.when(F.col("side") == 1, F.col("e0") - F.col("anchor")).otherwise(F.col("anchor") - F.col("s0"))
    kept = {r: F.coalesce(f"kept{r}", F.lit(0)) for r in radii}
    near = {r: F.least(room, F.lit(r)) - stop for r in radii}
    more = {r: F.coalesce(F.col("stopped") > r, F.lit(True)) & (kept[r] >= near[r]) & (room > r) for r in radii}
    t = t.select("chrom", "anchor", "side", *(kept[r].alias(f"k{r}") for r in radii), *(more[r].alias(f"more{r}") for r in radii))
    g = t.groupBy("chrom", "anchor").agg(*(F.bool_or(f"more{r}").alias(f"more{r}") for r in radii), *(F.max(F.when(F.col("side") == s, F.col(f"k{r}"))).alias(f"k{r}{n}") for r in radii for s, n in ((-1, "l"), (1, "r"))))
    pick = lambda n: F.coalesce(*(F.when(~F.col(f"more{r}"), F.col(f"k{r}{n}")) for r in radii), F.col(f"k{radii[-1]}{n}"))
    return g.select("chrom", "anchor", (F.col("anchor") - pick("l")).alias("s"), (F.col("anchor") + pick("r")).alias("e"))


def best_of_overlapping(seeds: DataFrame, share: float = 0.50) -> DataFrame:
    """Seeds (chrom, anchor, quality, s, e) without those that lie by ``share`` of the smaller over a better one that stays.

    Rounds: a seed that is better than all others left that it lies over stays
    (quality, then the smaller anchor), and those go.  Only seeds that meet in a
    stretch of windows are compared, and no chromosome is one task.
    """
    seeds = stored(seeds)
    width = 64
    at = seeds.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    other = at.select("chrom", "bin", *(F.col(c).alias("o_" + c) for c in ("anchor", "quality", "s", "e")))
    both = F.least("e", "o_e") - F.greatest("s", "o_s") + 1
    small = F.least(F.col("e") - F.col("s"), F.col("o_e") - F.col("o_s")) + 1
    p = at.join(other, ["chrom", "bin"]).where((F.col("anchor") != F.col("o_anchor")) & (F.col("bin") == F.floor(F.greatest("s", "o_s") / width)) & (both >= share * small))
    better = (F.col("o_quality") > F.col("quality")) | ((F.col("o_quality") == F.col("quality")) & (F.col("o_anchor") < F.col("anchor")))
    p = stored(p.select("chrom", "anchor", F.col("o_anchor").alias("other"), better.alias("loses")))
    left, kept = seeds.select("chrom", "anchor"), None
    while True:
        beaten = p.where("loses").join(left, ["chrom", "anchor"], "left_semi").join(left.withColumnRenamed("anchor", "other"), ["chrom", "other"], "left_semi").select("chrom", "anchor").distinct()
        win = stored(left.join(beaten, ["chrom", "anchor"], "left_anti"))
        kept = win if kept is None else kept.unionByName(win)
        gone = p.join(win.withColumnRenamed("anchor", "other"), ["chrom", "other"], "left_semi").select("chrom", "anchor").unionByName(win)
        left = stored(left.join(gone, ["chrom", "anchor"], "left_anti"))
        if left.isEmpty():
            return seeds.join(kept, ["chrom", "anchor"])


def seed_discovery(labels: DataFrame, bits: DataFrame, quality: DataFrame, classes: int, stride: int = 25, search: int = 10, least_quality: float = 0.50, radius: int = 200, extend: int = 200, tries: int = 3, stop: int = 2, least: int = 5, thresholds: dict | None = None) -> DataFrame:
    """Seeds of every chromosome: (chrom, anchor, quality, s, e, n_windows); quality is (chrom, w, quality)."""
    anchors = stored(seed_anchors(quality, stride, search, least_quality))
    far = radius + extend * (tries - 1)
    pairs = anchors.select("chrom", F.col("w").alias("w1"), F.explode(F.sequence(F.greatest("s0", F.col("w") - far), F.least("e0", F.col("w") + far))).alias("w2")).where("w1 <> w2")
    signals = anchor_signals(pair_table(bits, pairs), classes).select("chrom", F.col("w1").alias("anchor"), F.col("w2").alias("w"), "v", "h_off")
    signals = signals.join(quality, ["chrom", "w"])
    kinds = signals.select("chrom", "anchor", "w", window_class(F.col("v"), F.col("h_off"), F.col("quality"), **(thresholds or {})).alias("class"))
    walks = seed_walks(kinds, anchors, radius, extend, tries, stop).join(anchors.select("chrom", F.col("w").alias("anchor"), "quality"), ["chrom", "anchor"])
    many = labels.where("k >= 0").groupBy("chrom", F.col("w").alias("anchor")).agg(F.count_distinct("k").alias("bands"), F.count("*").alias("n"))
    walks = walks.join(many, ["chrom", "anchor"]).where((F.col("bands") >= 2) & (F.col("n") >= 5))
    found = walks.where(F.col("e") - F.col("s") + 1 >= least).select("chrom", "anchor", "quality", "s", "e")
    return best_of_overlapping(found).withColumn("n_windows", F.col("e") - F.col("s") + 1)


# -- votes -----------------------------------------------------------------


def projections(table: DataFrame, sizes: DataFrame, purity: float = 0.80, nothing: float = 0.10, second: float = 0.20, held: float = 0.80, least: int = 5, count: int = 3, scatter: float = 0.20) -> DataFrame:
    """Where each band (w1, a) goes among all bands of w2, by shares of the whole band.

    One band of ``purity`` is a SINGLE.  Else bands are taken by share, each of
    ``second`` and ``count`` samples, until they hold ``held``: two are a
    SPLIT_TWO, more a SUBSET_SPLIT, too little a RANDOM_FAN, or SCATTER where no
    band has ``scatter``.  Bands not visited that hold at most ``nothing`` are
    excluded.  A band of fewer than ``least`` samples, or none of them there, is EMPTY.
    """
    keys = ["chrom", "w1", "a"]
    focal = sizes.select("chrom", F.col("w").alias("w1"), F.col("k").alias("a"), F.col("m").alias("n_focal"))
    goal = sizes.select("chrom", F.col("w").alias("w2"), F.col("k").alias("b"))
    pairs = table.select("chrom", "w1", "w2").distinct()
    every = pairs.join(focal, ["chrom", "w1"]).join(goal, ["chrom", "w2"]).join(table, [*keys, "w2", "b"], "left").fillna(0, ["n"])
    by = W.partitionBy(*keys, "w2")  # a few bands
    t = every.withColumn("share", F.col("n") / F.col("n_focal")).withColumn("top", F.max("share").over(by))
    single = F.col("top") >= purity
    first = F.row_number().over(by.orderBy(F.desc("share"), "b")) == 1
    ok = (F.col("share") >= second) & (F.col("n") >= count)
    order = by.orderBy(F.desc("share"), "b").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumns({"cum": F.coalesce(F.sum(F.when(ok, F.col("share"))).over(order), F.lit(0.0)), "first": first})
    taken = F.when(single, F.col("first") & (F.col("n") >= count)).otherwise(ok & (F.round(F.col("cum") - F.col("share"), 9) < held))
    t = t.withColumn("taken", taken).withColumn("sum", F.sum(F.when(F.col("taken"), F.col("share"))).over(by))
    t = t.withColumn("taken", F.col("taken") & (single | (F.round("sum", 9) >= held)))
    g = t.groupBy(*keys, "w2").agg(
        F.max("n_focal").alias("n_focal"),
        F.sum("n").alias("n_there"),
        F.max("top").alias("max_purity"),
        F.array_sort(F.collect_list(F.when(F.col("taken"), F.col("b")))).alias("visited"),
        F.array_sort(F.collect_list(F.when(~F.col("taken") & (F.col("share") <= nothing), F.col("b")))).alias("excluded"),
    )
    empty, n = (F.col("n_focal") < least) | (F.col("n_there") == 0), F.size("visited")
    kind = F.when(empty, "EMPTY").when(n == 1, "SINGLE").when(n == 2, "SPLIT_TWO").when(n > 2, "SUBSET_SPLIT").when(F.col("max_purity") < scatter, "SCATTER").otherwise("RANDOM_FAN")
    none = F.array().cast("array<int>")
    lists = {c: F.when(empty, none).otherwise(F.col(c).cast("array<int>")) for c in ("visited", "excluded")}
    return g.withColumns({"pattern": kind, **lists}).select(*keys, "w2", "n_focal", "max_purity", "pattern", "visited", "excluded")


def projection_stability(votes: DataFrame, bits: DataFrame, classes: int, radius: int = 3, stable: float = 0.70, least: int = 5, valid: float = 0.5) -> DataFrame:
    """Splits into three or more upgraded to COHERENT_SPLIT, or read as RANDOM_FAN, by what their daughters do nearby.

    A daughter is what a band sends to one visited band of w2.  At each of the
    windows within ``radius`` of w2 the daughters are aligned to the bands, and
    each gives the Jaccard of its samples and its band's among all daughters.
    The median decides if at least ``valid`` of the windows have ``least``
    samples and two bands; else the pattern stays.  Adds ``static`` and ``stability``.
    """
    key = ["chrom", "w1", "a", "w2"]
    split = votes.where((F.col("pattern") == "SUBSET_SPLIT") & (F.size("visited") >= 2))
    d = split.select(*key, F.posexplode("visited").alias("d", "b"))
    x, y, z = _named(bits, "w1", "a", "x"), _named(bits, "w2", "b", "y"), _named(bits, "w", "c", "z")
    held = d.join(x, ["chrom", "w1", "a"]).join(y, ["chrom", "w2", "b", "chunk"])
    held = held.select(*key, "d", "chunk", *(F.col("x" + c).bitwiseAND(F.col("y" + c)).alias("d" + c) for c in _WORDS))
    near = held.withColumn("w", F.explode(F.array(*(F.col("w2") + i for i in range(-radius, radius + 1) if i))))
    n = _common(tuple("d" + c for c in _WORDS), tuple("z" + c for c in _WORDS))
    cells = near.join(z, ["chrom", "w", "chunk"]).withColumn("n", n).where("n > 0").groupBy(*key, "w", "d", "c").agg(F.sum("n").alias("n"))
    bands = bits.groupBy("chrom", "w").agg(F.count_distinct("k").alias("bands")).where("bands >= 2")
    cells = stored(cells.join(bands, ["chrom", "w"]).select(*key, "w", F.col("d").alias("a_"), F.col("c").alias("b_"), "n"))
    by = [*key, "w"]
    table = cells.select(*by, "a_", "b_", "n").withColumnsRenamed({"a": "voter", "a_": "a", "b_": "b"})
    by_ = ["chrom", "w1", "voter", "w2", "w"]
    best = best_permutation(table, by_, classes).where(F.col("n") >= least).select(*by_, "perm").join(F.broadcast(_ways(table.sparkSession, classes)), "perm")
    rows = table.groupBy(*by_, "a").agg(F.sum("n").alias("row"))
    cols = table.groupBy(*by_, "b").agg(F.sum("n").alias("col"))
    size = split.select("chrom", "w1", F.col("a").alias("voter"), "w2", F.size("visited").alias("size"))
    j = best.join(size, ["chrom", "w1", "voter", "w2"]).where("a < size").join(table, [*by_, "a", "b"], "left").join(rows, [*by_, "a"], "left").join(cols, [*by_, "b"], "left")
    got, union = F.coalesce("n", F.lit(0)), F.coalesce("row", F.lit(0)) + F.coalesce("col", F.lit(0)) - F.coalesce("n", F.lit(0))
    s = j.groupBy("chrom", "w1", "voter", "w2").agg(F.median(F.when(union > 0, got / union)).alias("stability"), F.count_distinct("w").alias("n_near"))
    s = s.where(F.col("n_near") >= F.ceil(F.lit(valid * 2 * radius))).withColumnRenamed("voter", "a")
    known = F.col("stability").isNotNull()
    out = votes.withColumnRenamed("pattern", "static").join(s.select(*key, "stability"), key, "left")
    return out.withColumn("pattern", F.when(known & (F.col("stability") >= stable), "COHERENT_SPLIT").when(known, "RANDOM_FAN").otherwise(F.col("static")))


def coassociation(votes: DataFrame, grouped: bool = False, weights: dict | None = None) -> DataFrame:
    """(locus, i, j, together, weight, affinity, n_votes) of pairs of a locus's bands that votes mention together.

    ``votes`` is (locus, pattern, visited, excluded).  Bands on one side of a
    vote are together with its weight, bands on two sides apart.  Bands that are
    excluded both count as together, unless ``grouped``: then the bands of a
    locus are outcomes of one window, and to be none of two says that they differ.
    Patterns without weight don't vote.
    """
    weight = F.coalesce(*(F.when(F.col("pattern") == p, w) for p, w in (weights or WEIGHTS).items()), F.lit(0.0))
    v = votes.withColumn("weight", weight).where("weight > 0")
    side = lambda c, s: F.transform(c, lambda b: F.struct(b.alias("b"), F.lit(s).alias("in")))
    m = F.array_sort(F.concat(side("visited", True), side("excluded", False)))
    pairs = F.flatten(F.transform(m, lambda x: F.transform(F.filter(m, lambda y: y["b"] > x["b"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    p = v.select("locus", "weight", F.explode(pairs).alias("p"))
    same = (F.col("p.x.in") == F.col("p.y.in")) & (F.col("p.x.in") if grouped else F.lit(True))
    g = p.groupBy("locus", F.col("p.x.b").alias("i"), F.col("p.y.b").alias("j")).agg(F.sum(F.when(same, F.col("weight")).otherwise(0.0)).alias("together"), F.sum("weight").alias("weight"), F.count("*").alias("n_votes"))
    return g.withColumn("affinity", F.col("together") / F.col("weight"))


def band_partners(pairs: DataFrame, primary: float = 0.7, apart: float = 0.3, secondary: float = 0.4, evidence: float = 1.0, gap: float = 0.15) -> DataFrame:
    """Per band of a locus: its partners by affinity, and how far its voters agree.

    Partners of at least ``evidence`` weight are primary, secondary, excluded or
    uncertain; secondary ones are separable where the highest lies ``gap`` under
    the lowest primary one, or there is none.  ``agreement`` is the mean of
    max(affinity, 1 - affinity) by weight, ``residual`` 2 * (1 - agreement), and
    ``conflict`` the share of the other bands that are secondary.
    """
    one = pairs.select("locus", F.col("i").alias("band"), F.col("j").alias("other"), "affinity", "weight")
    rows = one.unionByName(pairs.select("locus", F.col("j").alias("band"), F.col("i").alias("other"), "affinity", "weight"))
    size = pairs.groupBy("locus").agg((F.max("j") + 1).alias("size"))
    a = F.col("affinity")
    kind = F.when(F.col("weight") < evidence, "none").when(a >= primary, "primary").when(a < apart, "excluded").when(a >= secondary, "secondary").otherwise("uncertain")
    rows = rows.withColumn("kind", kind)
    listed = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("other")))), ",").alias(k)
    g = rows.groupBy("locus", "band").agg(
        *(listed(k) for k in ("primary", "secondary", "excluded", "uncertain")),
        F.min(F.when(F.col("kind") == "primary", a)).alias("low"),
        F.max(F.when(F.col("kind") == "secondary", a)).alias("high"),
        F.count_if(F.col("kind") == "secondary").alias("n_secondary"),
        (F.sum(F.greatest(a, 1 - a) * F.col("weight")) / F.sum("weight")).alias("agreement"),
        F.sum("weight").alias("evidence"),
    )
    g = g.join(size, "locus")
    return g.select(
        "locus",
        "band",
        "primary",
        "secondary",
        "excluded",
        "uncertain",
        ((F.col("n_secondary") > 0) & F.coalesce(F.round(F.col("low") - F.col("high"), 9) >= gap, F.lit(True))).alias("separable"),
        "agreement",
        F.greatest(F.lit(0.0), 2 * (1 - F.col("agreement"))).alias("residual"),
        "evidence",
        F.when(F.col("size") > 1, F.col("n_secondary") / (F.col("size") - 1)).otherwise(0.0).alias("conflict"),
    )


def refines(a: Column, b: Column) -> Column:
    """Whether every block of partition a lies in one block of b; both as growth strings of one digit a band."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.concat(F.substring(a, i, F.lit(1)), F.substring(b, i, F.lit(1))))
    return F.size(F.array_distinct(pairs)) == F.size(F.array_distinct(F.split(a, "")))


def consensus_class(kept: DataFrame, partners: DataFrame, pairs: DataFrame, clean: float = 0.85, soft: float = 0.65, strong: float = 0.50, ambiguous: float = 0.5, layer: float = 0.55, fragmented: float = 0.3, evidence: float = 1.0) -> DataFrame:
    """Per locus, of its kept partitions (place 1 is the best), its bands and its pairs.

    NO_CLEAN_CONSENSUS under ``strong`` or ``evidence``.  A partition of at least
    ``layer`` that neither refines the best one nor is refined by it makes a
    MULTI_LAYER_STRUCTURE, unless fewer than a third of the bands (at least one)
    have a residual of ``ambiguous`` and the best reaches ``soft``: then, and where
    bands have it without such a partition, AMBIGUOUS_BAND.  From ``clean`` on
    CLEAN_PARTITION; below, OVERLAPPING_VOTES if ``fragmented`` of the pairs lie
    in 0.3 .. 0.7, else SOFT_PARTITION.
    """
    best = kept.where("place = 1").select("locus", F.col("partition").alias("p"), F.col("score").alias("top"), F.col("total_weight").alias("weight"))
    other = kept.where("place > 1").join(best.select("locus", "p"), "locus").where(F.round("score", 9) >= layer)
    apart = ~refines(F.col("partition"), F.col("p")) & ~refines(F.col("p"), F.col("partition"))
    other = other.groupBy("locus").agg(F.bool_or(apart).alias("apart"))
    bands = partners.groupBy("locus").agg(F.count_if(F.round("residual", 9) >= ambiguous).alias("n_ambiguous"))
    a = F.round("affinity", 9)
    grey = pairs.groupBy("locus").agg(F.avg(a.between(0.3, 0.7).cast("double")).alias("grey"), (F.max("j") + 1).alias("size"))
    t = best.join(other, "locus", "left").join(bands, "locus", "left").join(grey, "locus", "left").fillna(0, ["n_ambiguous"])
    top, n = F.round("top", 9), F.col("n_ambiguous")
    few = (n > 0) & (n < F.greatest(F.lit(1), F.ceil(F.col("size") * 0.34))) & (top >= soft)
    kind = (
        F.when((top < strong) | (F.col("weight") < evidence), "NO_CLEAN_CONSENSUS")
        .when(F.col("apart"), F.when(few, "AMBIGUOUS_BAND").otherwise("MULTI_LAYER_STRUCTURE"))
        .when((n > 0) & (top >= soft), "AMBIGUOUS_BAND")
        .when(top >= clean, "CLEAN_PARTITION")
        .when(F.col("grey") >= fragmented, "OVERLAPPING_VOTES")
        .otherwise("SOFT_PARTITION")
    )
    return t.select("locus", F.col("p").alias("partition"), F.col("top").alias("score"), n.alias("n_ambiguous"), F.col("grey"), kind.alias("consensus"))


def consensus_summary(kept: DataFrame, partners: DataFrame) -> DataFrame:
    """Per locus: best score, residual max(1 - score, mean of its bands' residuals), entropy of the kept scores over ln n, mean conflict, and the class at 0.2, 0.4, 0.6."""
    good = F.when(F.col("score") > 0, F.col("score"))
    t = kept.groupBy("locus").agg(F.max("score").alias("score"), F.sum(good).alias("s"), F.sum(good * F.log(good)).alias("slog"), F.count("*").alias("n"))
    entropy = F.when((F.col("n") > 1) & (F.col("s") > 0), (F.log("s") - F.col("slog") / F.col("s")) / F.log("n")).otherwise(0.0)
    r = partners.where("evidence > 0").groupBy("locus").agg(F.avg("residual").alias("band"), F.avg("conflict").alias("conflict"))
    t = t.join(r, "locus", "left").withColumn("residual", F.greatest(1 - F.col("score"), F.coalesce("band", F.lit(0.0))))
    at = F.round("residual", 9)
    kind = F.when(at < 0.20, "CLEAN_RESOLUTION").when(at < 0.40, "COMPLEX_BUT_RESOLVABLE").when(at < 0.60, "LOW_RESOLUTION_REVIEW").otherwise("INVALID_HIDDEN_REGIME_CONFLICT")
    return t.select("locus", "score", "residual", entropy.alias("entropy"), F.coalesce("conflict", F.lit(0.0)).alias("conflict"), kind.alias("resolving"))
