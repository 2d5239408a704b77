"""Embedding operators against brute force, and quotation links on planted quotes."""

import itertools
import random
import re

import numpy as np
import pytest

from sparkbands.llm import ann, embedding_dedup, quotes

VECTORS = "vec_id long, embedding array<float>, label int, n long"


def rows(rng, n=300):
    out = []
    for i in range(n):
        v = rng.normal(size=8)
        out.append((i, v.tolist(), i % 3, 1))
    for i in range(n, n + 60):
        v = np.array(out[i % 20][1]) * rng.uniform(0.5, 2) + rng.normal(size=8) * rng.choice([0, 0.05, 0.2])
        out.append((i, v.tolist(), i % 20 % 3, 1))
    out += [(1000 + i, out[5][1], 2, None) for i in range(50)]
    out += [(2000, None, 1, 1), (2050, [0.0] * 8, 1, 1), (2100, [float("nan")] + [1.0] * 7, 1, 1), (2150, [None] + [1.0] * 7, 1, 1), (2200, out[5][1], None, 1), (2250, [1.0, 2.0], 1, 1)]
    return out


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cos(a, b):
    a, b = np.float32(a).astype(float), np.float32(b).astype(float)
    return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)


@pytest.mark.parametrize("block", [40, 2000])
def test_links_equal_brute_force(spark, block):
    data = rows(np.random.default_rng(3))
    links = {r[0]: set() for r in data}
    for i, a in enumerate(data):
        for b in data[:i]:
            if good(a[1]) and good(b[1]) and a[2] is not None and a[2] == b[2] and len(a[1]) == len(b[1]) and cos(a[1], b[1]) >= 0.98:
                links[a[0]].add(b[0])
                links[b[0]].add(a[0])
    comp = {}
    for start in sorted(links):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = start
                todo += links[x]
    got = embedding_dedup.link(spark.createDataFrame(data, VECTORS), block=block).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, len(s), comp[i], comp[i] == i) for i, s in links.items()}
    assert len(got) == len(data)


@pytest.mark.parametrize("least", [0, 1 << 20])
def test_nearest_with_recall(spark, least):
    data = rows(np.random.default_rng(4), 900 if least else 1000)  # 1000: some ids are repeated
    got = ann.search(spark.createDataFrame(data, VECTORS).repartition(2), least=least, shard=400, block=64).collect()
    found, hit, total = {}, 0, 0
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    usable = [d for d in data if good(d[1])]
    for q in usable:
        if q[0] % 50 == 0:
            best = sorted(((-round(cos(q[1], d[1]), 12), d[0]) for d in usable if d[0] != q[0] and len(d[1]) == len(q[1])))[:5]
            mine = found.get(q[0], {})
            assert sorted(mine) == list(range(1, len(mine) + 1)) and len(mine) == min(5, len(best))
            hit += len({v for v, _ in mine.values()} & {v for _, v in best})
            total += len(best)
            if least:  # climbed to the roots: exact but for the order of scores that differ in their last digits
                assert [mine[k + 1][1] for k in range(len(best))] == pytest.approx([-b[0] for b in best], abs=1e-9)
    if not least:
        assert hit >= 0.9 * total
        assert max(r.n_compared for r in got) < 0.7 * len(usable)


def test_forest_descends_to_the_longest_prefix_and_ascends():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 24))
    strings = ann.hashes(x, 40)
    found = ann.Forest(strings).candidates(strings[:, :20], 60)
    for i, c in enumerate(found):
        # brute force: the longest common prefix of each row with the query, over all trees
        lcp = [max(ann._BITS - int(a ^ b).bit_length() for a, b in zip(strings[:, i].tolist(), strings[:, r].tolist())) for r in range(300)]
        assert 60 <= len(c) and i in c
        assert min(lcp[r] for r in c) >= sorted(lcp)[-60] and all(r in c for r in range(300) if lcp[r] > min(lcp[r] for r in c))


def test_repeated_ids_with_different_vectors(spark):
    data = [(5, [1.0, 0.0, 0.0], 1, 1), (5, [0.0, 1.0, 0.0], 1, 1), (6, [1.0, 0.001, 0.0], 1, 1), (7, [0.0, 1.0, 0.001], 1, 1), (50, [0.0, 1.0, 0.0], 1, 1), (9, [1.0, 0.0, 0.0], 1, 1)]
    got = embedding_dedup.link(spark.createDataFrame(data, VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 2, 5), (9, 2, 5), (50, 2, 5)]
    near = [(r.rank, r.vec_id) for r in ann.search(spark.createDataFrame(data, VECTORS)).collect()]
    assert sorted(near) == [(1, 5), (2, 7), (3, 6), (4, 9)]


def test_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert embedding_dedup.link(empty).count() == 0
    assert ann.search(empty).count() == 0


def test_quotes_are_linked_and_removed(spark):
    data = [
        (1, 0, "user", "First  line here\nsecond line"),
        (1, 1, "assistant", "An answer"),
        (1, 2, "user", "> first line HERE\n>> deep unknown\nMy reply"),
        (1, 3, "assistant", "> An answer\n> > First line here\nboth"),
        (2, 0, "user", "> An answer\nfrom elsewhere"),
        (2, 1, "user", None),
        (None, 0, "user", "> An answer"),
        (3, None, "user", "x"),
        (3, None, "user", "y"),
        (None, 0, "user", "beta"),
        (1, 1, "assistant", "An answer"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in data], "conv_id long, turn long, role string, text string, h int")
    every = quotes.threads(quotes.linked(df)).collect()
    # rows without a conversation or a turn are all kept, equal keys or not
    lost = [(c, t, x) for c, t, _, x in data if c is None or t is None]
    assert sorted(((r.conv_id, r.turn, r.plain) for r in every if r.position is None), key=repr) == sorted(((c, t, "" if x.startswith(">") else x) for c, t, x in lost), key=repr)
    out = {(r.conv_id, r.turn): r for r in every}
    assert len(out) == 8
    assert out[1, 2].reply_turn == 0 and out[1, 2].plain == "My reply" and out[1, 2].depth == 2 and out[1, 2].n_linked == 1
    assert out[1, 3].reply_turn == 1 and out[1, 3].n_linked == 2
    assert (out[2, 0].reply_conv, out[2, 0].reply_turn) == (1, 1)
    assert out[2, 1].reply_turn == 0 and out[2, 1].plain == ""
    assert [out[1, t].position for t in range(4)] == [0, 1, 3, 2]
    assert out[3, None].position is None and out[None, 0].position is None
    assert quotes.threads(quotes.linked(df.limit(0))).count() == 0


def test_order_of_deep_conversations(spark):
    # a chain of 150 turns, a late answer to turn 3 that is itself answered by 130 more
    data = [(1, t, "user", "The root" if t == 0 else f"turn {t}") for t in range(150)]
    data += [(1, 150, "user", "> turn 3\nbranch")] + [(1, t, "user", f"turn {t}") for t in range(151, 280)]
    out = quotes.threads(quotes.linked(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))).collect()
    assert [(r.turn, r.position) for r in out] == [(t, t) for t in range(280)]


def brute_threads(data):
    """Parents and reply order by loops over messages and a walk down the tree."""
    norm = lambda s: " ".join(re.split(r"[ \t\n\r\x0b\f]+", s.strip(" \t"))).lower()  # noqa: E731  the tests' letters are ASCII
    msgs = {}
    for c, t, text in data:
        if (c, t) not in msgs or text < msgs[c, t]:
            msgs[c, t] = text
    own, quoted = {}, {}
    for key, text in msgs.items():
        lines = []
        for x in text.split("\n"):
            m = re.match(r"((?:[ \t]*>)*)(.*)", x)
            if norm(m[2]):
                lines.append((m[1].count(">"), norm(m[2])))
        own[key] = [b for lv, b in lines if lv == 0]
        groups = [(lv, [b for _, b in g]) for lv, g in itertools.groupby(lines, key=lambda x: x[0])]
        quoted[key] = [g for g in groups if g[0] > 0]
    wrote = lambda key, p: any(own[key][i : i + len(p)] == p for i in range(len(own[key])))

    def find(key, p, elsewhere):
        here = [k for k in sorted(own) if k[0] == key[0] and k[1] < key[1] and wrote(k, p)]
        there = [k for k in sorted(own) if k[0] != key[0] and wrote(k, p)] if elsewhere else []
        return (here + there + [None])[0]

    up, counts = {}, {}
    for key in msgs:
        hits, n = [], 0
        for level, p in quoted[key]:
            to = find(key, p, True)
            n += len(p) if to else 0
            hits += [(level, to)] if to else []
            if not to and len(p) > 1:
                single = [(level, find(key, [x], False)) for x in p]
                hits += [s for s in single if s[1]]
                n += sum(s[1] is not None for s in single)
        before = [k for k in sorted(msgs) if k[0] == key[0] and k[1] < key[1]]
        best = max(((-lv, to[0] == key[0], to[1], to[0]) for lv, to in hits), default=None)
        up[key] = (best[3], best[2]) if best else (before[-1] if before else None)
        counts[key] = n
    order = {}
    for conv in {k[0] for k in msgs}:
        mine, seen = sorted(k for k in msgs if k[0] == conv), []

        def walk(k):
            seen.append(k)
            for c in mine:
                if up[c] == k:
                    walk(c)

        for k in mine:
            if up[k] is None or up[k][0] != conv:
                walk(k)
        order |= {k: i for i, k in enumerate(seen)}
    return {k: (up[k], counts[k], order[k]) for k in msgs}


def test_threads_equal_brute_force(spark):
    rnd = random.Random(5)
    data, said = [], []
    for conv in range(12):
        mine = []
        for turn in range(rnd.randint(1, 25)):
            lines = [rnd.choice(["Thanks", "ok  then", f"word{rnd.randint(0, 60)} x", f"Line {conv} {turn} {rnd.randint(0, 3)}"]) for _ in range(rnd.randint(0, 4))]
            parts = []
            for _ in range(rnd.choice([0, 0, 1, 2])):
                src = rnd.choice(mine or said or [["nothing known"]])
                if rnd.random() < 0.2 and said:
                    src = rnd.choice(said)
                if src:
                    a = rnd.randrange(len(src))
                    mark = rnd.choice(["> ", "> > ", ">"])
                    parts += [mark + x.upper() for x in src[a : a + rnd.randint(1, 3)]] + rnd.choice([[], ["> never written"], [""]])
            mine.append(lines)
            said.append(lines)
            data.append((conv, turn * 2, "\n".join(parts + lines)))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in data], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): ((r.reply_conv, r.reply_turn) if r.reply_turn is not None else None, r.n_linked, r.position) for r in quotes.threads(quotes.linked(df)).collect()}
    want = brute_threads(data)
    assert {k: v for k, v in got.items() if v != want[k]} == {} and len(got) == len(want)


def test_quote_of_a_line_that_the_quoting_conversation_repeats(spark):
    data = [(3, 0, "user", "> same line\nsame line"), (3, 1, "user", "no"), (9, 0, "user", "other"), (9, 4, "user", "same line"), (12, 0, "user", "same line"), (15, 0, "user", "> no\n> only mine\nonly mine")]
    out = {(r.conv_id, r.turn): r for r in quotes.linked(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    assert (out[3, 0].reply_conv, out[3, 0].reply_turn, out[3, 0].n_linked) == (9, 4, 1)
    # line by line, a passage reaches its own conversation only
    assert (out[15, 0].n_quoted, out[15, 0].n_linked, out[15, 0].reply_turn) == (2, 0, None)
