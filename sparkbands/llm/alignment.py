"""Cross-tokenizer alignment as an Arrow-native pipeline.

Two tokenizers cut the same bytes, a byte-level one (A) and a piece model (B).
Texts become lists of token ids; the lists are flattened, with the document of
each token as its parent index, and sums of the tokens' bytes within a document
give each token's end.  A full Acero hash join on (document, end) finds the ends
that both share, which close groups, and the ends of only one.  In the order of
ends, the next A token and the next B token at or after an end are those that lie
over the bytes before it: that is one link for each distinct end.  Links are
counted for each document with ``Table.group_by``; stored counts of all documents
are counted again for each task and merged by Spark.

Neither tokenizer joins what comes before a space to what comes after, so texts
are cut there into units, a unit is encoded once while a worker remembers it, and
a very long text is worked on in parts of whole units.

The corpus-wide counts of the ``head`` most frequent pairs are broadcast (a fixed
number of rows); links of rarer pairs are joined to their counts by Spark, so no
link is left out.

Texts that are null, empty, or that a tokenizer does not give back byte for byte
have no tokens: zeros and an empty string.  Equal rows give equal rows, and a
missing doc_id stays missing: rows are told apart by a key of their own.  Counts
tie where they are equal: all pairs at a B id's highest count are best.  An empty
table gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .wordcodec import _byte_symbols

_PART = 1 << 20  # bytes of text worked on at once
_REMEMBERED = 500_000  # units; the memory is emptied when they are reached
_WIDTH = 1 << 20  # a pair of ids is a * _WIDTH + b


class _Pool:
    """Lists of numbers, one after the other."""

    def __init__(self):
        self.values, self.used, self.at = np.zeros(1 << 16, np.int32), 0, [np.zeros(1, np.int64)]

    def add(self, lists: list) -> np.ndarray:
        """Appends lists; returns all their numbers."""
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        new = np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))
        if self.used + len(new) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(max(len(new), len(self.values)), np.int32)])
        self.values[self.used : self.used + len(new)] = new
        self.at.append(self.used + np.cumsum(size))
        self.used += len(new)
        return new

    def lists(self) -> pa.ListArray:
        self.at = [np.concatenate(self.at)]
        return pa.ListArray.from_arrays(pa.array(self.at[0].astype(np.int32)), pa.array(self.values[: self.used]))


class Pair:
    """The two tokenizers, the bytes of their tokens, and the units that were met."""

    def __init__(self, byte_path: str, piece_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: i for i, s in enumerate(_byte_symbols())}
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece model whose pieces do not run across spaces is needed")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [pa.array(np.array([len(x) for x in table], np.int64)) for table in (self.a_bytes, self.b_bytes)]
        self.names = [pa.array([str(i) for i in range(len(table))]) for table in (self.a_bytes, self.b_bytes)]
        self._forget()

    def _forget(self) -> None:
        self.place, self.pools, self.good = {}, (_Pool(), _Pool()), [np.zeros(0, bool)]

    def units(self, raw: list) -> tuple[pa.Array, pa.ListArray, pa.ListArray, np.ndarray]:
        """Of distinct units: their places among what is remembered, all remembered lists of A and B ids, and which give back their bytes."""
        if len(self.place) + len(raw) > _REMEMBERED:
            self._forget()
        new = [u for u in raw if u not in self.place]
        for x in range(0, len(new), 4096):
            part = new[x : x + 4096]
            texts = [u.decode("utf-8", "replace") for u in part]
            ids = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)  # B adds the space again
            self.place.update(zip(part, range(len(self.place), len(self.place) + len(part))))
            raw_ = b"".join(part)
            good = np.ones(len(part), bool)
            for pool, names, lists in zip(self.pools, (self.a_bytes, self.b_bytes), ids):
                back = [names[i] for i in pool.add(lists).tolist()]
                if b"".join(back) != raw_:
                    good &= [b"".join([names[i] for i in x]) == u for x, u in zip(lists, part)]
            self.good.append(good)
        at = pa.array(np.fromiter((self.place[u] for u in raw), np.int64, len(raw)))
        return at, self.pools[0].lists(), self.pools[1].lists(), np.concatenate(self.good)


@lru_cache(maxsize=2)
def pair(byte_path: str, piece_path: str) -> Pair:
    """One pair of tokenizers for each worker process."""
    return Pair(byte_path, piece_path)


def unit_bounds(buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Offsets of the units of texts at ``edges``: cuts before a space that follows a printable ASCII or a Latin-1 letter and doesn't end its text."""
    safe = (buf > 0x20) & (buf < 0x7F)
    safe[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] < 0xC0)
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:-1] = (buf[1:] == 0x20) & safe[:-1]
    cut[edges[edges > 0] - 1] = False
    cut[edges] = True
    return np.flatnonzero(cut)


def _ends(lists: pa.ListArray, sizes: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Ids of all tokens, and (document, end) of each as one number: sums of bytes within a document."""
    ids, doc = lists.flatten(), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(sizes.take(ids))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(lists.offsets.slice(0, len(lists)))
    end = pc.subtract(total, before.take(doc))
    return ids, pc.add(pc.shift_left(doc.cast(pa.int64()), 32), end)


def align(a: pa.ListArray, b: pa.ListArray, sizes: list, names: list) -> dict:
    """Of documents' token lists over the same bytes: counts, the groups as text, and pairs of linked ids with how often each document links them."""
    n = len(a)
    ids_a, key_a = _ends(a, sizes[0])
    ids_b, key_b = _ends(b, sizes[1])
    left = pa.table({"key": key_a, "a": pa.array(np.arange(len(ids_a)))})
    right = pa.table({"key_b": key_b, "b": pa.array(np.arange(len(ids_b)))})
    ends = left.join(right, keys="key", right_keys="key_b", join_type="full outer", use_threads=False, coalesce_keys=True).combine_chunks()
    ends = ends.take(pc.sort_indices(ends["key"])).combine_chunks()
    doc = pc.shift_right(ends["key"], 32)
    both = pc.and_(pc.is_valid(ends["a"]), pc.is_valid(ends["b"]))
    at_a, at_b = (pc.fill_null_backward(ends[c]) for c in "ab")
    linked = pc.add(pc.multiply(ids_a.take(at_a.combine_chunks()).cast(pa.int64()), _WIDTH), ids_b.take(at_b.combine_chunks()).cast(pa.int64()))
    found = pa.table({"doc": doc, "pair": linked}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    shared = ends.filter(both)
    per_doc = lambda column: np.bincount(np.asarray(column), minlength=n)
    groups = per_doc(pc.shift_right(shared["key"], 32))

    def joined(at: pa.ChunkedArray, names_: pa.Array, ids: pa.Array) -> pa.Array:
        """The ids of each group, with commas."""
        offsets = np.concatenate([[0], np.asarray(at) + 1]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), names_.take(ids)), ",")

    text = pc.binary_join_element_wise(joined(shared["a"], names[0], ids_a), joined(shared["b"], names[1], ids_b), "|")
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(groups)]).astype(np.int32)), text)
    return {
        "n_a": np.diff(np.asarray(a.offsets)),
        "n_b": np.diff(np.asarray(b.offsets)),
        "n_groups": groups,
        "n_links": per_doc(doc),
        "groups": pc.binary_join(listed, ";"),
        "doc": np.asarray(found["doc"]),
        "pair": found["pair"].combine_chunks(),
        "times": found["count_all"].combine_chunks().cast(pa.int32()),
    }


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """Runs of rows (first, one after the last) of about _PART bytes, with their texts; null is empty."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    run = np.cumsum(size) // _PART
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for x, y in zip(cuts[:-1], cuts[1:]):
        if y > x:
            yield x, y, pc.fill_null(texts.slice(x, y - x), "")


def _rows(texts: pa.Array, both: Pair) -> dict:
    """Alignment of some texts, those of one part."""
    n = len(texts)
    parts = [b" " + t if t else b"" for t in texts.cast(pa.binary()).to_pylist()]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    raw = b"".join(parts)
    bounds = unit_bounds(np.frombuffer(raw, np.uint8), edges)
    units = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])
    coded = units.dictionary_encode()
    place, lists_a, lists_b, good = both.units(coded.dictionary.to_pylist())
    index = np.asarray(place)[np.asarray(coded.indices)]
    row = np.searchsorted(edges, bounds[:-1], "right") - 1  # the text of each unit
    fits = np.bincount(row, weights=~good[index], minlength=n) == 0
    keep = fits[row]
    index, row = index[keep], row[keep]
    first = np.searchsorted(row, np.arange(n + 1))
    out: dict = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    sha = [hashlib.sha256() for _ in range(n)]
    pairs, times, kinds = [], [], []
    # runs of units of at most about _PART bytes: more than one only where a text is longer than that
    at = np.asarray(bounds[:-1])[keep]
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(at // _PART)) + 1, [len(at)]]))
    for x, y in zip(cuts[:-1], cuts[1:]):
        some = np.clip(first, x, y) - x
        lists = []
        for every in (lists_a, lists_b):
            taken = every.take(pa.array(index[x:y]))
            lists.append(pa.ListArray.from_arrays(taken.offsets.take(pa.array(some)), taken.flatten()))
        got = align(*lists, both.sizes, both.names)
        for c in ("n_a", "n_b", "n_links"):
            out[c] += got[c]
        for k in np.flatnonzero(got["n_groups"]).tolist():
            sha[k].update(b";" * bool(out["n_groups"][k]) + got["groups"][k].as_py().encode())
        out["n_groups"] += got["n_groups"]
        kinds.append(got["doc"])
        pairs.append(np.asarray(got["pair"]))
        times.append(np.asarray(got["times"]))
    kind = np.concatenate(kinds) if kinds else np.empty(0, np.int64)
    order = np.argsort(kind, kind="stable")
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=n))]).astype(np.int32))
    listed = lambda found, t: pa.ListArray.from_arrays(offsets, pa.array((np.concatenate(found) if found else np.empty(0))[order], t))
    digests = pa.array([s.hexdigest() if k else "" for s, k in zip(sha, out["n_groups"].tolist())], pa.string())
    return {c: pa.array(v) for c, v in out.items()} | {"groups_sha256": digests, "pairs": listed(pairs, pa.int64()), "times": listed(times, pa.int32())}


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One stored row for each document, with its linked pairs (a * 2**20 + b) and how often it links them."""

    def run(batches):
        for batch in batches:
            for x, y, texts in _parts(batch.column("text")):
                found = _rows(texts, pair(byte_path, piece_path))
                yield pa.RecordBatch.from_pydict({c: batch.column(c).slice(x, y - x) for c in ("row", "doc_id")} | found)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return written(rows.mapInArrow(run, schema), "aligned")


def pair_counts(rows: DataFrame, flush: int = 1 << 21) -> DataFrame:
    """(pair, n, best): links of each pair of ids in the whole corpus, and whether no pair of its B id has more."""

    def run(batches):
        held = []
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                part = batch.slice(x, 256)
                held.append(pa.table({"pair": part.column("pairs").flatten(), "n": part.column("times").flatten().cast(pa.int64())}))
                if sum(t.num_rows for t in held) >= flush:
                    held = [_summed(held)]
                    if held[0].num_rows >= flush // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from _summed(held).to_batches()

    n = rows.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = written(n, "pair-counts").withColumn("b", F.col("pair") % _WIDTH)
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return written(n.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counted")


def _summed(tables: list) -> pa.Table:
    out = pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"pair": out["pair"], "n": out["n_sum"]})


def link_counts(docs: DataFrame, byte_path: str, piece_path: str, head: int = 1 << 17) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    spark, rows = docs.sparkSession, aligned(docs, byte_path, piece_path)
    counts = pair_counts(rows)
    top = counts.orderBy(F.desc("n"), "pair").limit(head).toArrow()
    sent = spark.sparkContext.broadcast(tuple(top[c].to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))

    def run(batches):
        """Of each document: sums over the links of frequent pairs, and its other pairs."""
        pairs, n, best = sent.value
        known = pa.array(pairs, pa.int64())
        n, best = np.append(n, 0), np.append(best, False)
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                part = batch.slice(x, 256)
                listed, times = part.column("pairs"), np.asarray(part.column("times").flatten(), dtype=np.int64)
                row, kind = np.asarray(pc.list_parent_indices(listed)), listed.flatten()
                at = np.asarray(pc.fill_null(pc.index_in(kind, value_set=known), len(n) - 1))
                rest = at == len(n) - 1
                total = lambda v: _sums(v, row, part.num_rows)
                cut = np.concatenate([[0], np.cumsum(np.bincount(row[rest], minlength=part.num_rows))]).astype(np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(cut), pa.array(v[rest], t)) for v, t in ((np.asarray(kind), pa.int64()), (times, pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(total(times * best[at])), pa.array(total(times * n[at])), *lists], ["row", "n_best", "count_sum", "pairs", "times"])

    parts = written(rows.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, pairs array<long>, times array<int>"), "parts")
    rare = parts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = parts.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by row; rows ascend."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[np.searchsorted(row, np.arange(n), "right")] - total[np.searchsorted(row, np.arange(n), "left")]
