"""Pairs of samples by blocks, FDR in bins, names of bands, and the fall of shards, against loops."""

import math
import random

import numpy as np
import pytest

from sparkbands.operators import aggregates, bands, matrix


@pytest.mark.parametrize("block,shard", [(200, 512), (4, 8)])
def test_sample_pairs_equal_loops(spark, block, shard):
    rnd = random.Random(5)
    rows = []
    for g in range(2):
        for s in range(23):
            for m in range(40):
                x = None if rnd.random() < 0.2 else float("nan") if rnd.random() < 0.05 else 1.0 if s == 3 else rnd.random() * 2
                rows.append((g, m, s * 31 + g, x))
    df = spark.createDataFrame(rows, "grp int, marker int, sample_id long, dosage double")
    got = {(r.grp, r.s1, r.s2): r for r in matrix.sample_pairs(df, ("grp",), 20, block, shard).collect()}
    values = {}
    for g, m, s, x in rows:
        if x is not None and not math.isnan(x):
            values.setdefault((g, s), {})[m] = x
    want = {}
    for (g, s), a in values.items():
        for (h, t), b in values.items():
            if g == h and s < t and len(both := sorted(a.keys() & b.keys())) >= 20:
                x, y = np.array([a[m] for m in both]), np.array([b[m] for m in both])
                r = 0.0 if x.std() < 1e-6 or y.std() < 1e-6 else np.corrcoef(x, y)[0, 1]
                want[g, s, t] = (len(both), r, np.abs(x - y).mean(), np.sqrt(((x - y) ** 2).sum()), 1 - np.abs(x - y).mean() / 2)
    assert got.keys() == want.keys()
    for k, w in want.items():
        r = got[k]
        assert (r.n, r.r, r.mean_abs, r.euclid, r.l1) == pytest.approx(w, abs=1e-9)
    assert max(r.l2 for r in got.values()) <= 1 and min(r.l2 for r in got.values()) == pytest.approx(0)


def test_fdr_in_bins_equals_one_order(spark):
    rnd = random.Random(6)
    p = [rnd.choice([1.0, 0.0, round(rnd.random() ** 3, 3)]) for _ in range(400)]
    rows = [(i, x) for i, x in enumerate(p)] + [(999, None)]
    got = {r.test_id: r.fdr for r in aggregates.benjamini_hochberg(spark.createDataFrame(rows, "test_id int, p double"), bins=16).collect()}
    order, low, want = sorted(range(len(p)), key=lambda i: p[i]), 1.0, {}
    for rank in range(len(p), 0, -1):
        i = order[rank - 1]
        low = min(low, p[i] * len(p) / rank)
        want[i] = low
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_names_of_bands(spark):
    rnd = random.Random(1)

    def candidate(name, bands_):
        labels, track, s = [], [], 0
        for k, (n, centre, spread) in enumerate(bands_):
            for _ in range(n):
                labels.append((name, s, k))
                track += [(name, w, s, centre + spread * rnd.choice([-1, 1])) for w in range(6)]
                s += 1
        return labels, track

    cases = {
        "three": [(10, 0.0, 0.1), (10, 2.0, 0.9), (10, 4.0, 0.1)],
        "weak": [(10, 4.0, 0.1), (10, 2.0, 0.1), (10, 0.0, 0.1)],
        "four": [(10, 0.0, 0.1), (10, 1.0, 0.1), (3, 2.0, 0.1), (10, 3.0, 0.1)],
        "six": [(6, float(i), 0.1) for i in range(6)],
        "seven": [(6, float(i), 0.1) for i in range(7)],
    }
    made = [candidate(n, b) for n, b in cases.items()]
    got = {}
    found = bands.band_labels_auto(spark.createDataFrame(sum((m[0] for m in made), []), "id string, sample_id long, k int"), spark.createDataFrame(sum((m[1] for m in made), []), "id string, w int, sample_id long, value double"))
    for r in found.collect():
        got.setdefault(r.id, {})[r.k] = (r.vocab, r.label, r.confidence)
    label = {n: [got[n][k][1] for k in sorted(got[n])] for n in cases}
    assert label["three"] == ["HOM_REF", "HET", "HOM_INV"] and {x[2] for x in got["three"].values()} == {"high"}
    assert label["weak"] == ["HOM_INV", "HET", "HOM_REF"] and got["weak"][1][2] == "low" and got["weak"][0][2] == "medium"
    assert label["four"] == ["H1/H1", "H1/H1", "RECOMBINANT", "H2/H2"]
    assert label["six"] == ["H1/H1", "H1/H2", "H1/H3", "H2/H2", "H2/H3", "H3/H3"]
    assert set(label["seven"]) == {""} and {x[0] for x in got["seven"].values()} == {"free"}
