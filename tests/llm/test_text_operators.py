"""Operators on documents against brute force, on awkward rows and on an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkbands.llm import bpe_reuse, common, graph, maxent, mixing, near_dup, quality, rans, toxicity
from sparkbands.llm.queries import word_bpe_path
from sparkbands.llm.text import tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def library(rows):
    t = Tokenizer.from_file(word_bpe_path())
    return [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids) for r in rows], t


def test_tokens_are_the_words():
    texts = ["Ab c\tÉ \x0b x", "", None, " a", "b "]
    t = tokens(texts)
    got = [[t.word(i).decode() for i in range(a, b)] for a, b in zip(t.first, t.first[1:])]
    assert got == [words(x) for x in texts]


@pytest.mark.parametrize("chunk", [16, 512])
def test_bpe_equals_the_library(awkward, chunk):
    want, t = library(awkward.collect())
    out = bpe_reuse.decode(bpe_reuse.encode(awkward, word_bpe_path(), chunk_bytes=chunk, reuse_cores=5), word_bpe_path()).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in out), key=repr)
    assert got == sorted(((d is None, d or 0, ids, t.decode(ids, skip_special_tokens=False)) for d, ids in want), key=repr)
    again = bpe_reuse.encode(awkward, word_bpe_path(), chunk_bytes=chunk, decoded=True).collect()
    assert sorted((repr((r.doc_id, r.ids, r.decoded)) for r in again)) == sorted(repr((r.doc_id, r.ids, r.decoded)) for r in out)


def test_joins_widen_until_they_agree():
    """An encoder that merges across words forces joins to take in their neighbours."""
    rnd = random.Random(6)
    say = lambda words_, n: " ".join(rnd.choices(words_, k=n))
    texts = [say(["aa", "bb", "cc", "dd", "ee", "ff"], 300), "", None, say(["ii", "jj", "kk"], 300)]

    def encode(parts):
        # one id for a part's every run of whole text after "dd": what follows it cannot be encoded alone
        ids = []
        for p in parts:
            raw = p if isinstance(p, bytes) else (p or "").encode()
            words_ = raw.split()
            cut = words_.index(b"dd") if b"dd" in words_ else len(words_)
            ids.append([hash(w) % 1000 for w in words_[:cut]] + ([hash(tuple(words_[cut:])) % 1000] if cut < len(words_) else []))
        return np.array([i for x in ids for i in x], np.int64), np.cumsum([0, *map(len, ids)])

    raw, bounds, core, first = bpe_reuse.pieces(texts, 15)
    bounds, core, first = bpe_reuse.repaired(raw, bounds, core, first, encode)
    got = [raw[bounds[a] : bounds[b]].rstrip() for a, b in zip(first, first[1:])]
    assert got == [(t or "").encode().rstrip() for t in texts]
    per_text = [[raw[x:y] for x, y in zip(bounds[a:b], bounds[a + 1 : b + 1])] for a, b in zip(first, first[1:])]
    assert len(per_text[3]) > 1  # joins that agree stay where they are
    raw2, b2, c2, f2 = bpe_reuse.pieces(texts, 15)
    again = bpe_reuse.repaired(raw2, b2, c2, f2, lambda p: encode([x.replace(b"dd", b"xx") for x in p]))
    assert np.array_equal(again[0], b2) and np.array_equal(again[1], c2) and len(b2) > len(bounds)


def test_bpe_and_files_of_nothing(spark, nothing):
    assert bpe_reuse.encode(nothing, word_bpe_path()).count() == 0
    folder = rans.new_folder(spark)
    rans.write_files(nothing, word_bpe_path(), folder)
    assert rans.read_files(spark, folder).count() == 0


def test_files_round_trip_in_order(spark, awkward):
    want, _ = library(awkward.collect())
    folder = rans.new_folder(spark)
    rans.write_files(awkward, word_bpe_path(), folder, block=500, partitions=3)
    got = sorted(rans.read_files(spark, folder).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((d is None, d or 0, [*ids, 1]) for d, ids in want)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in got)
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    for first, last in ((0, 10), (700, 90_001), (len(every) - 3, len(every) + 50)):
        part = sorted(rans.read_range(spark, folder, first, last).collect(), key=lambda r: r.start)
        assert part[0].start == first and (np.concatenate([np.frombuffer(r.ids, "<u4") for r in part]) == every[first:last]).all()


def test_block_decodes_from_checkpoints_and_sees_damage():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 400_000) % 3000).astype(np.uint16)
    table = rans.Table(rans.frequencies(np.bincount(ids, minlength=49408)))
    raw = rans.pack([1, None], np.array([10, 399_990]), ids, table)
    docs, lengths, back = rans.unpack(raw, table)
    assert docs == [1, None] and lengths.tolist() == [10, 399_990] and (back == ids).all()
    edges = rans.run_edges(raw)
    for k in range(len(edges) - 1):
        assert (rans.unpack(raw, table, slice(k, k + 1))[2] == ids[edges[k] : edges[k + 1]]).all()
    small = rans.pack([7], np.array([len(ids)]), ids, table)
    assert len(edges) == len(rans.run_edges(small)) and edges[-1] == len(ids)
    with pytest.raises(ValueError):
        rans.unpack(raw[:-9] + b"x" + raw[-8:], table)


def brute_components(rows, width, percent):
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    ids = [r.doc_id for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return Counter((ids[i], len(sets[i]), least.get(find(i)) if sets[i] else ids[i]) for i in range(len(rows)))


@pytest.mark.parametrize(("small", "block"), [(3, 512), (2048, 2)])
def test_near_duplicates_equal_brute_force(spark, awkward, monkeypatch, small, block):
    monkeypatch.setattr(near_dup, "_BLOCK", block)
    rows = awkward.collect()
    chain = " ".join(f"c{i}" for i in range(100))
    more = spark.createDataFrame([(100 + k, chain.replace(f"c{10 * k} ", f"d{k} ") if k else chain) for k in range(9)], "doc_id long, text string")
    # rows without an id: near copies of one with an id and of one another
    none = spark.createDataFrame([(None, chain + " end"), (None, " ".join(f"e{i}" for i in range(60))), (None, " ".join(f"e{i}" for i in range(61)))], "doc_id long, text string")
    both = awkward.select("doc_id", "text").unionByName(more).unionByName(none)
    got = near_dup.link(both, width=4, percent=80, small=small).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(both.collect(), 4, 80)
    assert len(got) == len(rows) + 12


def test_components_write_two_tables_a_round(spark, monkeypatch):
    rnd, names, write = random.Random(8), [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or write(df, name))
    way = rnd.sample(range(300), 120)
    edges = [*zip(way, way[1:]), *((500 + rnd.randrange(90), 500 + rnd.randrange(90)) for _ in range(60)), (7, 7)]
    top = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in top:
        for a, b in edges:
            if a != b:
                top[a] = top[b] = min(top[a], top[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert Counter((r.node, r.component) for r in got) == Counter(top.items())
    assert names.count("parents") > 1 and len(names) == 1 + 2 * names.count("parents")


def test_maybe_in_misses_no_key(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(500)] + [(None, "t")], "doc_id long, text string")
    wanted = rows.where("doc_id % 7 = 0 or doc_id is null")
    for words_, most in ((1, 501), (1 << 20, 80)):
        got = {r.doc_id for r in common.maybe_in(rows, wanted, ["doc_id", "text"], words_).where("maybe").collect()}
        assert got >= {None, *range(0, 500, 7)} and len(got) <= most
    assert common.maybe_in(rows, wanted.limit(0), ["doc_id"]).where("maybe").count() == 0


def test_near_duplicates_of_nothing(nothing):
    assert near_dup.link(nothing).count() == 0


def brute_mix(rows, block, step):
    """The mix by hand: a loop over slots, and over the words that each takes."""
    size = [len(words(r.text)) for r in rows]
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(n for n, r in zip(size, rows) if r.source == s) for s in names}
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, sum(size)
    target, left, open_ = dict.fromkeys(names, 0.0), float(total), set(names)
    while left > 1e-9 and open_:
        each = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=names.index):
            target[s] += each * weight[s]
            if target[s] >= 3 * own[s]:
                left += target[s] - 3 * own[s]
                target[s] = float(3 * own[s])
                open_.discard(s)
    edges, run = [], 0.0
    for s in names:
        run += target[s]
        edges.append(int(run / max(sum(target.values()), 1e-300) * 2**31))
    order = lambda i: (hashlib.md5(f"mix{rows[i].doc_id if rows[i].doc_id is not None else ''}".encode()).hexdigest(), rows[i].doc_id or -1, size[i])
    stream = {s: [(i, w) for i in sorted((i for i, r in enumerate(rows) if r.source == s), key=order) for w in range(size[i])] for s in names}
    taken, slots, rank = [0] * len(rows), [[] for _ in rows], dict.fromkeys(names, 0)
    for slot in range(total // block + 1):
        x = slot % 2**31 * step % 2**31
        s = next(n for n, e in zip(names, edges) if x < e)
        for w in range(rank[s] * block, (rank[s] + 1) * block):
            if w < 3 * own[s]:
                i = stream[s][w % own[s]][0]
                taken[i] += 1
                if not slots[i] or slots[i][-1] != slot:
                    slots[i].append(slot)
        rank[s] += 1
    return Counter((r.doc_id, size[i], own[r.source], round(target[r.source], 6), taken[i], min(slots[i], default=None)) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [16, 5])
def test_mix_equals_the_schedule_run_by_hand(awkward, nothing, block):
    got = mixing.mix(awkward, block=block).collect()
    want = brute_mix(awkward.collect(), block, mixing._STEP)
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken, r.first_slot) for r in got) == want
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 4 * block
    assert mixing.mix(nothing).count() == 0


def test_the_points_decide_the_mix(awkward, monkeypatch):
    before = Counter(map(repr, mixing.mix(awkward).collect()))
    assert before == Counter(map(repr, mixing.mix(awkward).collect()))
    monkeypatch.setattr(mixing, "_STEP", 3)
    assert before != Counter(map(repr, mixing.mix(awkward).collect()))


def test_maxent_base_is_exact_and_tail_is_joined(awkward, nothing):
    rows = awkward.collect()
    train = [r for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    c = Counter(w for r in train for w in [*words(r.text), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        t = [*words(r.text), None]
        want[(r.doc_id, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4))] += 1
    for head in (1 << 18, 100):
        got = maxent.score(awkward, head=head, words=64, classes=4, rounds=2).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert maxent.score(nothing).count() == 0


def total_share(model, history):
    """Sum of the shares of all words and of the class of other tokens after a history."""
    total = 0.0
    for h in [*model.vocabulary.keys.tolist(), 2**63 + 99]:
        tokens_ = np.array([*history, h], np.uint64)
        total += math.exp(model.log_probability(tokens_, np.array([0, len(tokens_)]))[0][-1])
    return total


def test_maxent_shares_add_up_to_one(spark, awkward):
    rng = np.random.default_rng(2)
    v = maxent.Vocabulary(np.arange(1, 11, dtype=np.uint64), np.array([0, 1, 2, 0, 1, 2, 0, 1, 2, 0]), 3, 4, 5)
    m = maxent.Model(v, *(rng.normal(size=s) for s in ((v.features, 4), (5, 4), (5, 10), (32,)))).normalise()
    for history in ([3, 50], [50, 3], [], [7]):
        assert abs(total_share(m, history) - 1) < 1e-9
    counts = maxent.count_tokens(awkward)
    fitted = maxent.fit(awkward, counts, counts.count(), words=40, classes=5, rounds=3)
    some = fitted.vocabulary.keys
    for history in ([], [some[3]], [some[1], some[2]], [2**62 + 1, some[0]]):
        assert abs(total_share(fitted, history) - 1) < 1e-9


def test_maxent_learns_which_word_follows_which(spark):
    # b always follows a, c follows others: only a feature of the word before can tell
    rows = spark.createDataFrame([(i, " ".join(["a b x c y c"] * 5) + " " + "z c " * (i % 3)) for i in range(60)], "doc_id long, text string")
    got = {n: np.mean([r.score / r.n_tokens for r in maxent.score(rows, words=8, classes=1, hashed=4, rounds=n).collect() if r.held_out]) for n in (0, 12)}
    assert got[12] > got[0] + 0.1
    ab, cb = (maxent.score(rows.unionByName(spark.createDataFrame([(1000, t)], "doc_id long, text string")), words=8, classes=1, hashed=4, rounds=12).where("doc_id = 1000").first().score for t in ("a b", "c b"))
    assert ab > cb + 0.5


def labelled(spark):
    docs = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(60)) + (" vile awful" * 3 if i % 4 == 0 else "")) for i in range(400)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(400)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_classifiers_on_held_out_rows(spark, awkward, nothing):
    docs, labels = labelled(spark)
    for kind, label in ((toxicity, "toxic"), (quality, "quality")):
        model = kind.fit(docs, labels)
        truth = {r.doc_id: r[label] for r in labels.collect()}
        got = [r for r in kind.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
        assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.9 * len(got)
        odd = kind.score(awkward, model).collect()
        assert len(odd) == awkward.count() and all(0 <= r.score <= 1 for r in odd)
        assert kind.score(nothing, model).count() == 0
        blank = kind.fit(nothing, labels.limit(0))
        assert all(0 <= r.score <= 1 for r in kind.score(awkward, blank).collect())



def test_character_grams_stay_inside_words():
    doc, bucket = quality.char_grams(["ab É", None, "x"], 3, 18)
    # " ab", "ab ", " É ", " x "
    assert doc.tolist() == [0, 0, 0, 2]
    same = quality.char_grams(["zz ab", "É"], 3, 18)[1]
    assert bucket[0] in same and bucket[2] == same[-1]


def test_quality_score_is_the_softmax_of_the_mean_vector(spark):
    rows = [(np.array([1, 2]), np.array([0.5, 0.5], np.float32), 1), (np.array([3]), np.array([1.0], np.float32), 0)] * 20
    worth = quality.train(rows, 4)
    assert worth[1] + worth[2] > 0 > worth[3]
    model = quality.Model(np.random.default_rng(1).normal(size=1 << 18).astype(np.float32), 18, 2.0, 0.5)
    texts = ["Some words here", "", None, "words words"]
    for text, got in zip(texts, model.score(texts)):
        found = [model.worth[b] for _, part in quality.features([text], 18) for b in part]
        assert abs(got - 1 / (1 + math.exp(-(2 * (sum(found) / max(1, len(found))) + 0.5)))) < 1e-6


def test_the_driver_gets_few_bytes_of_a_quality_feature(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{rnd.randrange(3000)}" for _ in range(150))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)], "doc_id long, quality int")
    sent, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: (got := collect(df)) and sent.extend(len(v) for r in got for v in r if isinstance(v, (bytes, bytearray))) or got)
    model = quality.fit(docs, labels)
    parts, learnt = [], [t for i, t in rows if zlib.crc32(b"%d" % i) % 4 != 2]
    for text in learnt:
        bucket, n = np.unique(np.concatenate([b for _, b in quality.features([text], 18)]), return_counts=True)
        parts.append(len(bucket))
    assert len(model.worth) == 1 << 18 and 0 < sum(sent) < 3 * sum(parts)
    bucket, n = np.array([0, 5, (1 << 18) - 1]), np.array([70_000, 1, 3])
    for b, m in ((bucket, n), (bucket[:0], n[:0])):
        got = quality.unpacked(quality.packed(b, m))
        assert got[0].dtype == np.int32 and got[0].tolist() == b.tolist() and got[1].tobytes() == (m / max(1, m.sum())).astype(np.float32).tobytes()


def test_toxicity_shares_add_up_to_one_and_equal_brute_force(spark):
    docs = [("bad badly", 1), ("bad bat\nbad", 1), ("bat cat", 0), ("", 0), (None, 1), ("cat bad", 0), ("bad", 1), ("bad x", 1)]
    got = toxicity.count_grams(spark.createDataFrame(docs, "text string, y int")).toPandas().sort_values("gram")
    brute = Counter()
    for text, y in docs:
        for w in set(words(text)):
            p = b"\x01" * 4 + w.encode() + b"\x02"
            for i in range(4, len(p)):
                brute[int.from_bytes(p[i - 4 : i + 1], "big"), y] += 1
    assert {(g, y): n for g, n0, n1 in got.itertuples(index=False) for y, n in ((0, n0), (1, n1)) if n} == dict(brute)
    counts = toxicity.Counts(got["gram"].to_numpy(np.int64).view(np.uint64), got[["n0", "n1"]].to_numpy(float), 3.0)
    for context in (b"\x01\x01\x01\x01", b"\x01bad", b"\x01\x01ba", b"none"):
        every = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.allclose(counts.probability(every).sum(0), 1)
    model = toxicity.ratios(counts, 0.1)
    for text in ("bad cat", "bat", "unseen bad"):
        total = 0.0
        for w in words(text):
            p = b"\x01" * 4 + w.encode() + b"\x02"
            keys = np.array([int.from_bytes(p[i - 4 : i + 1], "big") for i in range(4, len(p))], np.uint64)
            q = counts.probability(keys)
            total += max(np.log(q[:, 1] / q[:, 0]).sum() - 0.1, 0)
        assert abs(model.evidence([text])[0] - total / math.sqrt(len(words(text)))) < 1e-5
