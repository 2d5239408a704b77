"""The corpus pipeline against brute force, on rows without an id and with repeated ids."""

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from tokenizers import Tokenizer

import corpus_pipeline
from sparkbands.llm import quality, toxicity
from sparkbands.llm.queries import word_bpe_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def say(k, bad=False):
    return " ".join(f"w{(k * 7919 + j * j * (k % 13 + 1) + 31 * j * k) % 997}" for j in range(60)) + " vile awful" * 3 * bad


def corpus():
    rows = [(i, say(i, i % 4 == 0)) for i in range(240)]
    rows += [(None, say(500)), (None, say(501, True)), (None, say(502)), (None, say(500))]
    rows += [(1, say(503, True)), (2, say(504)), (3, say(3)), (3, say(3)), (600, say(5)), (601, None)]
    return [(d, t, "en", "s0", 9) for d, t in rows]


def groups(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((r[1] or "").split() for r in rows)]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]):
                top = [top[j] if t == top[i] else t for t in top]
    return top


def test_run_equals_brute_force(spark, tmp_path):
    rows = corpus()
    labels = [(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(240) if i not in (1, 2, 3)]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, known)
    want = [r for r in rows if model.score([r[1]])[0] < 0.5]
    assert {r[1] for r in rows if r[0] is None} - {r[1] for r in want} == {say(501, True)} and (1, say(503, True)) not in {r[:2] for r in want}
    model = quality.fit(spark.createDataFrame(want, SCHEMA), known)
    want = [r for r in want if model.score([r[1]])[0] >= 0.7]
    top = groups(want)
    first = {}
    for g, r in sorted(zip(top, want), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        first.setdefault(g, r)
    # one source: every document with words is taken once
    t = Tokenizer.from_file(word_bpe_path())
    ids = [(r[0], t.encode(r[1], add_special_tokens=False).ids) for r in first.values() if r[1]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == Counter((d, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for d, x in ids)


def test_run_of_nothing_and_of_extra_columns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids_sha256"]
    docs = spark.createDataFrame([(1, "some words", None, None, None, 0.5, 1)], SCHEMA + ", score double, row long")
    assert corpus_pipeline.mixed(spark, docs, "").columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.one_of_each_group(spark, docs, "").count() == 1
