"""Bitmaps, chains, seeds, votes and association on small rows, against loops."""

import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sparkbands.operators import association, votes

SCHEMA = "chrom string, w int, sample_id long, k int"


@pytest.fixture(scope="module")
def labels():
    """Two chromosomes; bands drift slowly, one window is missing, and some labels are unknown."""
    rnd, rows = random.Random(2), []
    for chrom, windows in (("x", range(9)), ("y", [0, 1, 2, 4, 5])):
        k = {s: rnd.randrange(3) for s in range(700)}
        for w in windows:
            turn = rnd.sample(range(3), 3)
            for s in k:
                if rnd.random() < 0.1:
                    k[s] = rnd.randrange(3)
                rows.append((chrom, w, s * 7919, rnd.choice([None, -1]) if rnd.random() < 0.02 else turn[k[s]]))
    return rows


def by_window(rows):
    out = defaultdict(dict)
    for c, w, s, k in rows:
        if k is not None and k >= 0:
            out[c, w][s] = k
    return out


def best(table, n=3):
    return max(permutations(range(n)), key=lambda p: (sum(table[a, p[a]] for a in range(n)), [-x for x in p]))


def test_pairs_of_windows_meet_as_bitmaps(spark, labels):
    df = spark.createDataFrame(labels, SCHEMA)
    bits = votes.band_bits(df)
    assert bits.count() < len(labels) / 5
    got = {(r.chrom, r.w1, r.w2, r.a, r.b): r.n for r in votes.pair_table(bits, votes.window_pairs(df, 2)).collect()}
    at, want = by_window(labels), Counter()
    for (c, w1), x in at.items():
        for (d, w2), y in at.items():
            if c == d and 0 < abs(w1 - w2) <= 2:
                for s in x.keys() & y.keys():
                    want[c, w1, w2, x[s], y[s]] += 1
    assert got == dict(want)
    assert {(r.chrom, r.w, r.k): r.m for r in votes.band_sizes(bits).collect()} == Counter((c, w, k) for (c, w), x in at.items() for k in x.values())


def test_entropy_off_the_aligned_diagonal(spark):
    cells = [("c", 1, 2, 0, 1, 40), ("c", 1, 2, 0, 0, 5), ("c", 1, 2, 0, 2, 5), ("c", 1, 2, 1, 0, 30), ("c", 1, 2, 1, 2, 4), ("c", 1, 2, 2, 2, 20), ("c", 1, 3, 0, 0, 9), ("c", 1, 3, 1, 1, 9), ("c", 1, 4, 0, 0, 4)]
    got = {(r.w1, r.w2): r for r in votes.anchor_signals(spark.createDataFrame(cells, "chrom string, w1 int, w2 int, a int, b int, n long"), 3).collect()}
    assert got[1, 2].h_off == pytest.approx((10 * 1.0 + 4 * 0.0) / 14)  # row 0 leaves evenly to two bands, row 1 to one
    assert got[1, 3].h_off is None and got[1, 3].v == 1.0
    assert got[1, 4].v is None and got[1, 4].n == 4


@pytest.mark.parametrize("run", [256, 2])
def test_chain_projection_carries_permutations(spark, labels, run):
    df = spark.createDataFrame(labels, SCHEMA)
    got = {(r.chrom, r.w, r.sample_id): (r.aligned, r.chain) for r in votes.chain_projection(df, votes.band_bits(df), 3, run=run).collect()}
    at, want = by_window(labels), {}
    for c in "xy":
        chain, turn = -1, None
        for w in sorted(v for d, v in at if d == c):
            now = at[c, w]
            before = at.get((c, w - 1))
            if before is not None:
                table = Counter((before[s], now[s]) for s in before.keys() & now.keys())
                p = best(table)
                ok = sum(table[a, p[a]] for a in range(3)) >= 0.5 * sum(table.values())
            if before is None or not ok:
                chain, turn = chain + 1, [0, 1, 2]
            else:
                turn = [turn[p.index(k)] for k in range(3)]
            want |= {(c, w, s): (turn[k], chain) for s, k in now.items()}
    assert got == want


def test_walks_end_at_two_regime_ends(spark):
    I, C, R, U = "INTERIOR", "CROSSOVER", "REGIME_END", "UNRELIABLE"
    right = [I, R, C, U, R, U, R, I]  # ends at the second end in a row: the crossover at distance 3 is the last kept
    left = [R, I, I]
    rows = [("c", 10, 11 + i, x) for i, x in enumerate(right)] + [("c", 10, 9 - i, x) for i, x in enumerate(left)]
    rows += [("d", 3, w, I) for w in range(20) if w != 3]
    anchors = spark.createDataFrame([("c", 10, 0.9, 0, 30), ("d", 3, 0.8, 0, 19)], "chrom string, w int, quality double, s0 int, e0 int")
    found = votes.seed_walks(spark.createDataFrame(rows, "chrom string, anchor int, w int, class string"), anchors, radius=8, extend=4, tries=2)
    got = {r.chrom: (r.s, r.e) for r in found.collect()}
    # the second walk of d comes to its edge at 12 windows and has no more tries
    assert got == {"c": (7, 13), "d": (0, 15)}


def test_best_of_overlapping_is_greedy_by_quality(spark):
    rnd = random.Random(4)
    rows = []
    for c in "ab":
        for i in range(40):
            s = rnd.randrange(300)
            rows.append((c, i, rnd.randrange(12) / 10, s, s + rnd.randrange(4, 90)))
    got = {(r.chrom, r.anchor) for r in votes.best_of_overlapping(spark.createDataFrame(rows, "chrom string, anchor int, quality double, s int, e int")).collect()}
    kept: list = []
    for c, i, q, s, e in sorted(rows, key=lambda r: (-r[2], r[1])):
        if not any(c == k[0] and min(e, k[4]) - max(s, k[3]) + 1 >= 0.5 * (min(e - s, k[4] - k[3]) + 1) for k in kept):
            kept.append((c, i, q, s, e))
    assert got == {(k[0], k[1]) for k in kept}


def test_projections_visit_and_exclude(spark):
    table = [("c", 1, 2, 0, 0, 9), ("c", 1, 2, 0, 1, 1), ("c", 1, 2, 1, 0, 5), ("c", 1, 2, 1, 1, 5), ("c", 1, 2, 2, 0, 4), ("c", 1, 2, 2, 1, 3), ("c", 1, 2, 2, 2, 3), ("c", 1, 2, 3, 0, 1)]
    sizes = [("c", 1, 0, 10), ("c", 1, 1, 10), ("c", 1, 2, 10), ("c", 1, 3, 6), ("c", 1, 4, 3), ("c", 2, 0, 20), ("c", 2, 1, 9), ("c", 2, 2, 3), ("c", 2, 3, 8)]
    got = votes.projections(spark.createDataFrame(table, "chrom string, w1 int, w2 int, a int, b int, n long"), spark.createDataFrame(sizes, "chrom string, w int, k int, m long"))
    assert {r.a: (r.pattern, r.visited, r.excluded) for r in got.collect()} == {
        0: ("SINGLE", [0], [1, 2, 3]),
        1: ("SPLIT_TWO", [0, 1], [2, 3]),
        2: ("SUBSET_SPLIT", [0, 1, 2], [3]),
        3: ("SCATTER", [], [1, 2, 3]),
        4: ("EMPTY", [], []),
    }


def test_splits_are_coherent_where_daughters_stay(spark):
    rnd = random.Random(9)
    rows = [(c, w, s, s % 3 if c == "a" or w == 4 else rnd.randrange(3)) for c in "ab" for w in range(1, 8) for s in range(60)]
    rows += [(c, 0, s, 0) for c in "ab" for s in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    bits = votes.band_bits(df)
    table = votes.pair_table(bits, spark.createDataFrame([("a", 0, 4), ("b", 0, 4)], "chrom string, w1 int, w2 int"))
    v = votes.projections(table, votes.band_sizes(bits), nothing=0.1)
    got = {r.chrom: r for r in votes.projection_stability(v, bits, 3).collect()}
    assert got["a"].static == got["b"].static == "SUBSET_SPLIT"
    assert (got["a"].pattern, got["a"].stability) == ("COHERENT_SPLIT", 1.0)
    assert got["b"].pattern == "RANDOM_FAN" and got["b"].stability < 0.7


def test_coassociation_and_partners(spark):
    rows = [("l", "SINGLE", [0], [1, 2]), ("l", "SPLIT_TWO", [0, 1], [2]), ("l", "SUBSET_SPLIT", [0, 1, 2], []), ("l", "RANDOM_FAN", [0, 2], [1]), ("l", "SINGLE", [2], [])]
    df = spark.createDataFrame(rows, "locus string, pattern string, visited array<int>, excluded array<int>")
    free = {(r.i, r.j): (r.together, r.weight, r.n_votes) for r in votes.coassociation(df).collect()}
    assert free == {(0, 1): (pytest.approx(1.2), pytest.approx(2.2), 3), (0, 2): (pytest.approx(0.7), pytest.approx(2.2), 3), (1, 2): (pytest.approx(1.7), pytest.approx(2.2), 3)}
    grouped = {(r.i, r.j): r.together for r in votes.coassociation(df, grouped=True).collect()}
    assert grouped[1, 2] == pytest.approx(0.7)  # both excluded by the single: apart, as outcomes of one window
    pairs = spark.createDataFrame([("l", 0, 1, 0.9, 2.0), ("l", 0, 2, 0.5, 2.0), ("l", 1, 2, 0.1, 0.5)], "locus string, i int, j int, affinity double, weight double")
    got = {r.band: r for r in votes.band_partners(pairs).collect()}
    assert (got[0].primary, got[0].secondary, got[0].separable, got[0].conflict) == ("1", "2", True, 0.5)
    assert got[0].residual == pytest.approx(2 * (1 - (0.9 * 2 + 0.5 * 2) / 4))
    assert (got[2].primary, got[2].secondary, got[2].excluded) == ("", "0", "")


def test_consensus_classes(spark):
    kept = [("clean", "0011", 0.95, 9.0, 1), ("layers", "0011", 0.80, 9.0, 1), ("layers", "0101", 0.78, 9.0, 2), ("one", "0011", 0.80, 9.0, 1), ("one", "0101", 0.78, 9.0, 2), ("soft", "0011", 0.80, 9.0, 1), ("soft", "0012", 0.79, 9.0, 2), ("grey", "0011", 0.70, 9.0, 1), ("none", "0011", 0.45, 9.0, 1), ("thin", "0011", 0.9, 0.5, 1)]
    residual = {"layers": [0.6, 0.6, 0.1, 0.1], "one": [0.6, 0.1, 0.1, 0.1]}
    bands = [(x[0], b, residual.get(x[0], [0.1] * 4)[b], 1.0, 0.0) for x in kept if x[4] == 1 for b in range(4)]
    pairs = [(x[0], i, 3, 0.5 if x[0] == "grey" else 0.9) for x in kept if x[4] == 1 for i in range(3)]
    got = votes.consensus_class(spark.createDataFrame(kept, "locus string, partition string, score double, total_weight double, place int"), spark.createDataFrame(bands, "locus string, band int, residual double, evidence double, conflict double"), spark.createDataFrame(pairs, "locus string, i int, j int, affinity double"))
    assert {r.locus: r.consensus for r in got.collect()} == {"clean": "CLEAN_PARTITION", "layers": "MULTI_LAYER_STRUCTURE", "one": "AMBIGUOUS_BAND", "soft": "SOFT_PARTITION", "grey": "OVERLAPPING_VOTES", "none": "NO_CLEAN_CONSENSUS", "thin": "NO_CLEAN_CONSENSUS"}


def test_adjusted_mutual_information(spark):
    rnd = random.Random(1)
    tables = {t: [[rnd.choice([0, rnd.randrange(40)]) for _ in range(3)] for _ in range(4)] for t in range(6)}
    tables[6] = [[5, 0], [0, 7]]
    tables[7] = [[9]]
    rows = [(t, a, b, n) for t, x in tables.items() for a, r in enumerate(x) for b, n in enumerate(r) if n]
    got = {r.t: r for r in association.mutual_information(spark.createDataFrame(rows, "t int, a int, b int, n long"), ["t"]).collect()}
    lf = lambda v: math.lgamma(v + 1)
    for t, x in tables.items():
        n = sum(map(sum, x))
        ra, cb = [sum(r) for r in x], [sum(c) for c in zip(*x)]
        mi = sum(v / n * math.log(n * v / (ra[i] * cb[j])) for i, r in enumerate(x) for j, v in enumerate(r) if v)
        h = [-sum(v / n * math.log(v / n) for v in side if v) for side in (ra, cb)]
        emi = sum(k / n * math.log(n * k / (a * b)) * math.exp(lf(a) - lf(k) - lf(a - k) + lf(n - a) - lf(b - k) - lf(n - a - b + k) - lf(n) + lf(b) + lf(n - b)) for a in ra for b in cb if a and b for k in range(max(1, a + b - n), min(a, b) + 1))
        assert got[t].mi == pytest.approx(mi, abs=1e-9) and got[t].emi == pytest.approx(emi, abs=1e-9)
        room = max(h) - emi
        assert got[t].ami == pytest.approx(0.0 if abs(room) < 1e-12 else max(-1.0, min(1.0, (mi - emi) / room)), abs=1e-9)


def test_log_factorial(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2, 31, 32, 33, 100, 10**6, 10**9)], "n long").select("n", association.log_factorial(F.col("n")).alias("x")).collect()
    assert all(abs(r.x - math.lgamma(r.n + 1)) <= 1e-12 * max(1, math.lgamma(r.n + 1)) for r in rows)
