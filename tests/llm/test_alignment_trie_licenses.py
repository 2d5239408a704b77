"""Token alignment, prefix trie and licence scan against brute force, on awkward rows and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tokenizers")
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from sparkbands.llm import alignment, license_scan, prefix_trie
from sparkbands.llm.license_texts import TEMPLATES

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# -- alignment ---------------------------------------------------------------


def token_ends(texts):
    """Of each text: A and B ids with the bytes of each token, by the libraries on whole texts."""
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    tables = alignment.pair(BYTE, PIECE)
    for t in texts:
        ids = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        raw = [[tab[i] for i in x] for tab, x in zip((tables.a_bytes, tables.b_bytes), ids)]
        whole = (" " + (t or "")).encode()
        yield (ids, raw) if t and b"".join(raw[0]) == whole == b"".join(raw[1]) else (([], []), ([], []))


def aligned_by_loops(rows):
    linked, counts, best = [], Counter(), defaultdict(int)
    for (ids, raw), doc in zip(token_ends([t for _, t in rows]), [d for d, _ in rows]):
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        links = [(i, j) for i, x in enumerate(ids[0]) for j in range(max(0, np.searchsorted(ends[1], ends[0][i] - len(raw[0][i]), "right")), len(ids[1])) if ends[1][j] - len(raw[1][j]) < ends[0][i]]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, p, q = [], 0, 0
        for e in shared:
            p2, q2 = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, ids[0][p:p2])) + "|" + ",".join(map(str, ids[1][q:q2])))
            p, q = p2, q2
        linked.append((doc, ids, [(ids[0][i], ids[1][j]) for i, j in links], groups))
        counts.update(linked[-1][2])
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for doc, ids, links, groups in linked:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield doc, len(ids[0]), len(ids[1]), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha


@pytest.mark.parametrize("head,part", [(1 << 17, 1 << 20), (7, 300), (0, 1 << 20)])
def test_alignment_equals_loops(spark, head, part, monkeypatch):
    rnd = random.Random(3)
    words = ["the", "naïve", "word", "12,5", "日本語", "foo_bar", "É", "don't", "\n", "\t x", "", "<|endoftext|>", "<s>", "\U0001f600", "a b", "　", "ABC", "ing", "_ "]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "  "), (104, "a▁b is not given back"), (None, "no id"), (105, "x" * 3000), (106, rows[3][1]), (106, rows[3][1]), (107, "ends in spaces  "), (108, "\0 zero"), (109, " leads"), (110, "é ")]
    df = spark.createDataFrame([(d, t, 5, 1) for d, t in rows], "doc_id long, text string, row long, pairs long")
    monkeypatch.setattr(alignment, "_PART", part)
    got = [tuple(r) for r in alignment.link_counts(df, BYTE, PIECE, head).collect()]
    assert sorted(got, key=repr) == sorted(aligned_by_loops(rows), key=repr)


def test_alignment_of_a_text_in_parts(monkeypatch):
    """A text longer than a part is worked on in runs of units, with the same result."""
    both = alignment.pair(BYTE, PIECE)
    texts = pa.array(["one two, three " * 50, "x", None, "été " * 400])
    whole = alignment._rows(texts.fill_null(""), both)
    monkeypatch.setattr(alignment, "_PART", 64)
    cut = alignment._rows(texts.fill_null(""), both)
    for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
        assert cut[c].to_pylist() == whole[c].to_pylist()
    for p, t, q, u in zip(*(x[c].to_pylist() for x in (whole, cut) for c in ("pairs", "times"))):
        both_ = [Counter(), Counter()]
        for k, n in zip(p, t):
            both_[0][k] += n
        for k, n in zip(q, u):
            both_[1][k] += n
        assert both_[0] == both_[1]


def test_alignment_of_an_empty_table(nothing):
    assert alignment.link_counts(nothing, BYTE, PIECE).count() == 0


# -- prefix trie -------------------------------------------------------------


def trie_by_loops(rows, shared=6, every=100):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    seq = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        seq[c] = tuple(own.get(c - c % every, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c in sorted(seq):
        for d in range(len(seq[c]) + 1):
            members[seq[c][:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def subtree(p):
        yield p
        for c in children[p]:
            yield from subtree(c)

    for p, m in members.items():
        below = list(subtree(p))
        ends = ",".join(str(c) for c in m if len(seq[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        yield m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()


def chats():
    rnd = random.Random(8)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 230), 9_000_000_123]:
        for t in range(rnd.randint(0, 9)):
            rows.append((c, t, rnd.choice(["user", "bot"]), rnd.choice(["hi", "héllo", "", "yes"])))
    rows += [(300 + k, t, "user", f"copy {t}") for k in range(8) for t in range(7)]
    rows += [(500, None, None, None), (500, None, "a", "x"), (500, 1, "b", "y"), (500, 1, "b", "y"), (500, 1, None, "z"), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("run", [1024, 3])
def test_trie_equals_loops(spark, run, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_RUN", run)
    rows = chats()
    if run == 3:  # one long conversation and its copy
        rows += [(c, t, "user", f"{t % 2}") for c in (700, 701) for t in range(40)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 int")
    got = [tuple(r) for r in prefix_trie.trie(df).collect()]
    assert sorted(got, key=repr) == sorted(trie_by_loops(rows), key=repr)


def test_long_end_lists_are_hashed_in_chunks(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 30_000, 5)]
    got = {r.depth: r for r in prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {r[1]: r for r in trie_by_loops(rows)}
    assert {d: tuple(r) for d, r in got.items()} == want


def test_nodes_met_by_many_are_broadcast_with_the_same_result(spark):
    nodes = spark.createDataFrame([(1, k, 0, 5000 if k < 2 else 1, k * 10) for k in range(9)], "depth long, k1 long, k2 long, n long, v long")
    rows = spark.createDataFrame([(1, k % 9, 0, k) for k in range(50)], "depth long, k1 long, k2 long, i long")
    got = sorted((r.i, r.v) for r in prefix_trie._with(rows, nodes, "n", 50).collect())
    assert got == [(k, k % 9 * 10) for k in range(50)]


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# -- licence scan ------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def phrases_by_loops(text):
    w, found = words(text), []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(found)


def test_matching_statistics_equal_search():
    auto = license_scan.Automaton()
    texts = [words(t) for _, t in TEMPLATES]
    vocabulary = sorted({w for t in texts for w in t})
    rnd = random.Random(5)
    doc = []
    for _ in range(40):
        t = rnd.choice(texts)
        a = rnd.randrange(len(t))
        doc += t[a : a + rnd.randint(1, 30)] + rnd.choices(vocabulary, k=rnd.randint(0, 2))
    held = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    ids = auto.known(license_scan.tokens([" ".join(doc)], gaps=license_scan._GAPS).hashes)
    assert (ids >= 0).all()
    states, lengths = auto.stream(ids.tolist())
    for i, (v, n) in enumerate(zip(states, lengths)):
        longest = max(m for m in range(1, i + 2) if tuple(doc[i + 1 - m : i + 1]) in held)
        assert n == longest
        places = {(t, e) for t, x in enumerate(texts) for e in range(n, len(x) + 1) if x[e - n : e] == doc[i + 1 - n : i + 1]}
        assert places == set(auto.ends[v])


def test_scan_finds_phrases_and_covered_templates(spark, awkward):
    mit, gpl3 = (next(t for label, t in TEMPLATES if label == x and len(t) > 100) for x in ("mit", "gpl"))
    cut = mit.split()
    rows = [
        (1, "Some prose. " + mit + " More prose."),
        (2, "x " + " ".join(cut[:30] + ["changed", "here"] + cut[32:])),
        (3, " ".join(cut[:12])),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "licensed UNDER cc by 4.0"),
        (6, "Released under the MIT License.\nAll rights reserved. All rights reserved"),
        (7, "The general public licenses; general public.license GENERAL Public License"),
        (8, gpl3),
        (9, "Licensed under the Apache License, Version 2.0."),
        (10, "the general of the and by cc is all rights"),
        (11, ("zz " * 9 + mit) * 300),
        (12, "cc\x7fby ccéby cc by"),
    ]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, n_words int, spans string")
    found = license_scan.scan(df).collect()
    got = {r.doc_id: r for r in license_scan.summary(license_scan.scan(df)).collect()}
    for d, t in rows:
        n, places = phrases_by_loops(t)
        r = got[d]
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(p[0] for p in places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        assert 0 <= r.score <= 1
    assert [got[d].labels for d in range(1, 13)] == ["mit", "mit", "", "cc-by,cc-by-nc", "cc-by", "mit,reserved", "gpl", "gpl", "apache", "", "mit", "cc-by"]
    assert got[1].score == 1.0 and 0.9 < got[2].score < 1.0 and got[10].score == 0.0
    spans = {r.doc_id: r.spans for r in found}
    assert (spans[1][0].first_word, spans[1][0].end_word) == (2, 2 + len(words(mit)))
    assert len(spans[11]) == 300
    out = license_scan.summary(license_scan.scan(awkward)).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_base) for r in out) == sorted((repr(r.doc_id), phrases_by_loops(r.text)[0], 0) for r in awkward.collect())


def test_scan_of_an_empty_table(nothing):
    assert license_scan.summary(license_scan.scan(nothing)).count() == 0
