"""Document sources and sinks, and awkward rows in engine operators."""

import json

import pytest
from pyspark.sql import functions as F

from sparkbands.operators import aggregates, bands, clusters, loci, ordered, planes
from sparkbands.sources import documents


def test_chrom_json(spark, tmp_path):
    doc = {"chrom": "c1", "samples": ["a", "b"], "windows": [{"idx": 0, "start_bp": 1, "end_bp": 9, "n_snps": 3, "lam1": 2.0, "lam2": 1.0, "z": None, "pc1": [0.5, None], "pc2": [1, 2]}], "l2_envelopes": [{"id": "e", "parent_l1_id": None, "start_w": 1, "end_w": 4}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    t = documents.read_chrom_json(spark, str(tmp_path / "d.json"))
    assert [(r.w, r.sample_id, r.sample_idx, r.pc1) for r in t["scores"].orderBy("sample_idx").collect()] == [(0, "a", 0, 0.5), (0, "b", 1, None)]
    assert tuple(t["envelopes"].select("env_id", "s0", "e0").first()) == ("e", 0, 3)
    assert t["windows"].first().z is None and t["samples"].count() == 2


def test_ancestry_q(spark, tmp_path):
    (tmp_path / "q").write_text("0.25 0.75\n1 0\n\n")
    (tmp_path / "s").write_text("# list\nx\n\ny extra\n")
    got = documents.read_ancestry_q(spark, str(tmp_path / "q"), str(tmp_path / "s"))
    assert {(r.sample_id, r.k): r.q for r in got.collect()} == {("x", 0): 0.25, ("x", 1): 0.75, ("y", 0): 1.0, ("y", 1): 0.0}
    for bad in ("0.5 0.5\n", "1 0\n1\n", "1 nan\n1 0\n", "1\n1\n"):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(Exception):
            documents.read_ancestry_q(spark, str(tmp_path / "bad"), str(tmp_path / "s")).collect()


def test_annotated_tsv_and_density(spark, tmp_path):
    (tmp_path / "t").write_text("# a = 1\n# name = x y\nid\tv\n1\t2.5\n2\t\n")
    params, rows = documents.read_annotated_tsv(spark, str(tmp_path / "t"), "id int, v double")
    assert params == {"a": "1", "name": "x y"} and [tuple(r) for r in rows.orderBy("id").collect()] == [(1, 2.5), (2, None)]
    (tmp_path / "j").write_text(json.dumps({"chrom": "c", "n_windows": 2, "by_class": {"te": {"densities": [0.1, 0.2]}, "bad": {"densities": [1]}}}))
    good, bad = documents.density_track_ingest(spark, str(tmp_path / "j"))
    assert [tuple(r) for r in good.orderBy("w").collect()] == [("c", 0, "te", 0.1), ("c", 1, "te", 0.2)]
    assert [tuple(r) for r in bad.collect()] == [("c", "bad", 1)]


def test_layers_and_catalogue(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "w int, fst double")
    documents.layer_publish(df, f"{tmp_path}/layers", "fst", "d1", "staging", "v1", ["a"], "fst double, w int")
    documents.layer_publish(df, f"{tmp_path}/layers", "fst", "d2", "final", "v1", [])
    got = {r.dataset_id: r.provenance.status for r in spark.read.parquet(f"{tmp_path}/layers").collect()}
    assert got == {"d1": "review", "d2": "active"}
    with pytest.raises(ValueError):
        documents.layer_publish(df, f"{tmp_path}/layers", "fst", "d3", "final", "v1", [], "w int")
    loci_ = spark.createDataFrame([(7, 1, 50, 60), (8, 0, 90, 95), (9, 0, 10, 12)], "locus int, chrom_idx int, s_bp long, e_bp long")
    members = spark.createDataFrame([(7, 0, "b"), (7, 0, "a"), (7, 1, "c")], "locus int, band int, sample_id string")
    out, manifest = documents.regime_catalogue(loci_, members, "{}")
    assert [(r["index"], r.locus) for r in out.orderBy("index").collect()] == [(0, 9), (1, 8), (2, 7)]
    assert out.where("locus = 7").first().bands[0].samples == ["a", "b"]
    assert tuple(manifest.first()) == (3, 2, "bf21a9e8fbc5")
    with pytest.raises(Exception):
        documents.regime_catalogue(loci_.withColumn("e_bp", F.lit(0).cast("long")), members, "{}")[0].collect()


def test_two_chromosomes_do_not_mix(spark):
    rows = [(c, w, s, (w + s + (c == "b")) % 3 if s < 5 else w % 2, float(s * (1 if w % 2 else -1))) for c in "ab" for w in range(4) for s in range(8)]
    t = spark.createDataFrame(rows, "chrom string, w int, sample_id int, k int, value double")
    for c in "ab":
        one = t.where(F.col("chrom") == c)
        want = {(r.w, r.sign) for r in bands.sign_align(one.drop("chrom")).collect()}
        assert {(r.w, r.sign) for r in bands.sign_align(t, keys=("chrom",)).where(F.col("chrom") == c).collect()} == want
    verdicts = spark.createDataFrame([("a", 0, "MERGE"), ("a", 1, "MERGE"), ("b", 0, "SEPARATE"), ("b", 2, "MERGE")], "chrom string, w int, verdict string")
    assert sorted(tuple(r) for r in ordered.merge_runs(verdicts, ("chrom",)).collect()) == [("a", 0, 2, 3), ("b", 2, 3, 2)]


def test_awkward_rows(spark):
    track = spark.createDataFrame([(0, 1, 5.0), (0, 2, None), (0, 3, 5.0), (1, 1, 1.0)], "w int, sample_id int, value double")
    got = sorted((r.w, r.sample_id, r.k) for r in clusters.kmeans_1d(track).collect())
    assert [g[:2] for g in got] == [(0, 1), (0, 3), (1, 1)] and got[0][2] == got[1][2]
    assert clusters.kmeans_1d(track.limit(0)).count() == 0
    calls = spark.createDataFrame([(1, 1, 0), (2, 1, 2), (1, 2, None), (2, 2, 1)], "candidate_id int, sample_id int, k int")
    assert [(r.c1, r.c2, r.n) for r in aggregates.candidate_scores(calls).collect()] == [(1, 2, 1)]
    kin = spark.createDataFrame([(1, 2, 0.3)], "a int, b int, kinship double")
    assert loci.genotype_compat_dyads(kin, calls).collect()[0].n_informative == 1
    assert loci.genotype_compat_dyads(kin.limit(0), calls).count() == 0
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 9)], "a int, b int")
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "node int")
    assert {(r.node, r.component) for r in bands.components(edges, nodes).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (9, 9)}
    signed = spark.createDataFrame([(1, 2, -0.9), (2, 3, -0.8), (3, 4, 0.1)], "a int, b int, r double")
    assert {(r.node, r.grp, r.sign) for r in bands.signed_groups(signed, nodes).collect()} == {(1, 1, 1), (2, 1, -1), (3, 1, 1), (4, 4, 1), (9, 9, 1)}
    parts = bands.partitions_of(spark, 4)
    assert parts.select("partition").distinct().count() == 15


def test_paths_and_stretches(spark):
    j = spark.createDataFrame([("c", 0, 1, 2, 1, 0.9), ("c", 1, 2, 1, 0, 0.8), ("c", 2, 3, 0, 0, 0.3), ("c", 1, 0, 1, 2, 0.9)], "chrom string, w1 int, w2 int, a int, b int, jaccard double")
    seeds = spark.createDataFrame([("c", 1, 1), ("d", 0, 0)], "chrom string, w int, k int")
    got = sorted((r.chrom, r.w, r.k) for r in planes.single_band_track(planes.best_partners(j), seeds).collect())
    assert got == [("c", 0, 2), ("c", 1, 1), ("c", 2, 0), ("d", 0, 0)]
    bit = {"a": 1, "b": 2, "x": 1 << 62, "q": -(1 << 63)}  # the highest bit is the sign
    rows = [("c", 1, 0, 10, ["a", "b"]), ("c", 2, 15, 20, ["a", "b", "x"]), ("c", 3, 25, 60, ["q"]), ("c", 4, 500, 600, ["q"])]
    rows = [(*r[:4], [(0, sum(bit[x] for x in r[4]), 0, 0, 0)]) for r in rows]
    iv = spark.createDataFrame(rows, "chrom string, id int, start_bp long, end_bp long, core array<struct<chunk:long,b0:long,b1:long,b2:long,b3:long>>")
    got = sorted(tuple(r)[1:] for r in planes.merge_het_intervals(iv, gap=100).collect())
    assert got == [(0, 20, 2, 3), (25, 60, 1, 1), (500, 600, 1, 1)]
    w = spark.createDataFrame([("c", i, n) for i, n in enumerate([5, 5, 1, 5, 5])], "chrom string, w int, n int")
    focal = spark.createDataFrame([("c", 2), ("c", 0), ("e", 0)], "chrom string, w int")
    assert sorted(tuple(r) for r in planes.grow_span(w, focal, 10, "n").collect()) == [("c", 0, 0, 1, 10.0, True, True), ("c", 2, 1, 3, 11.0, True, False)]
    het = spark.createDataFrame([(1, i, 0.1 + 0.001 * i) for i in range(6)] + [(1, 10 + i, 0.6 + 0.001 * i) for i in range(6)] + [(2, i, 0.3 + 0.01 * i) for i in range(6)], "key int, sample_id int, value double")
    assert {r.key: r.two_modes for r in planes.band_modes(het).collect()} == {1: True, 2: False}
    pool = spark.createDataFrame([("a", float(i)) for i in range(100)], "id string, value double")
    low = planes.subsample_control(pool, spark.createDataFrame([("a", 20, 20.0)], "id string, n long, mean double"), 200).first()
    assert low.verdict == "real_reduction" and abs(low["mean"] - 49.5) < 3
    assert planes.slabs(12, 2) == [(0, 0, 4), (1, 5, 9), (2, 10, 11)]
    two = spark.createDataFrame([(1, i, 0.1 * (i % 5)) for i in range(20)] + [(1, 50 + i, 5 + 0.1 * (i % 5)) for i in range(20)] + [(2, i, float(i)) for i in range(5)], "key int, sample_id int, value double")
    got = planes.detect_groups(two).orderBy("key", "grp").collect()
    assert [(r.key, r.grp, r.n, r.groups) for r in got] == [(1, 0, 20, 2), (1, 1, 20, 2)] and abs(got[0].separation - 5) < 1e-9


def test_tracks_merges_and_spans_equal_walks(spark):
    import random

    rnd = random.Random(3)
    # tracks: partners may meet in one band
    edges = [(c, w, w + d, a, rnd.randrange(3), rnd.random()) for c in "xy" for w in range(40) for d in (-1, 1) for a in range(3) if 0 <= w + d < 40]
    best = {(c, w, v, a): (b, j) for c, w, v, a, b, j in edges if j >= 0.2}
    seeds = [(c, w, k) for c in "xy" for w in range(0, 40, 7) for k in range(3)]
    want = set()
    for c, w, k in seeds:
        want.add((c, w, k, w, k, 1.0))
        for d in (-1, 1):
            at, band = w, k
            while (c, at, at + d, band) in best:
                band, j = best[c, at, at + d, band]
                at += d
                want.add((c, w, k, at, band, j))
    partners = planes.best_partners(spark.createDataFrame(edges, "chrom string, w1 int, w2 int, a int, b int, jaccard double"), 0.2)
    got = [tuple(r) for r in planes.single_band_track(partners, spark.createDataFrame(seeds, "chrom string, w int, k int")).collect()]
    assert set(got) == want and len(got) == len(want)

    # merged intervals
    rows = []
    for c in "xy":
        for i in range(60):
            s = rnd.randrange(3000)
            rows.append((c, i, s, s + rnd.randrange(80), rnd.sample(range(200), rnd.randrange(1, 4)) + [1, 2, 3][: rnd.randrange(4)]))
    word = lambda core, k: sum(1 << x % 64 for x in set(core) if x // 64 == k)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    bits = [(*r[:4], [(0, *(signed(word(r[4], k)) for k in range(4)))]) for r in rows]
    iv = spark.createDataFrame(bits, "chrom string, id int, start_bp long, end_bp long, core array<struct<chunk:long,b0:long,b1:long,b2:long,b3:long>>")
    want = []
    for c in "xy":
        last = None
        for _, i, s, e, core in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[3], r[1])):
            core = set(core)
            if last and s - last[2] <= 20 and len(core & last[4]) >= 0.3 * len(core | last[4]):
                last[2], last[3] = max(last[2], e), last[3] + 1
                last[4] |= core
            else:
                last = [c, s, e, 1, core]
                want.append(last)
    assert sorted(tuple(r) for r in planes.merge_het_intervals(iv, gap=20, least=0.3).collect()) == sorted((c, s, e, n, len(u)) for c, s, e, n, u in want)

    # spans from every window, with windows of no size
    sizes = {c: [rnd.choice([0, 0, 1, 3, 7]) for _ in range(n)] for c, n in (("x", 50), ("y", 1), ("z", 9))}
    w = spark.createDataFrame([(c, i * 2, n) for c, v in sizes.items() for i, n in enumerate(v)], "chrom string, w int, n int")
    for target in (0.0, 5.0, 40.0, 1000.0):
        want = set()
        for c, v in sizes.items():
            for f in range(len(v)):
                a = b = f
                left = right = 0
                forced = False
                while v[f] + left + right < target and (a > 0 or b < len(v) - 1):
                    forced = forced or a == 0 or b == len(v) - 1
                    if a > 0 and (b == len(v) - 1 or left <= right):
                        a -= 1
                        left += v[a]
                    else:
                        b += 1
                        right += v[b]
                total = v[f] + left + right
                want.add((c, f * 2, a * 2, b * 2, float(total), total >= target, forced))
        got = {tuple(r) for r in planes.grow_span(w, w.select("chrom", "w"), target, "n").collect()}
        assert {g[:6] for g in got} == {x[:6] for x in want}
        assert {g[:2] for g in got if g[6]} == {x[:2] for x in want if x[6]}
