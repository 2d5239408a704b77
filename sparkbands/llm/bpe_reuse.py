"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of 16 bytes cuts texts where its low bits are zero, so a
passage that documents share is cut alike in all of them.  A chunk's core runs
from the first to the last white-space start inside it; no merge crosses white
space, so a core has the same ids wherever it stands.  Cores that occur more
than once in the corpus are counted over all documents, and each is encoded
once, in a job of its own; the table of their ids is broadcast under a stated
bound (``reuse_cores`` cores of at most ``_CORE_MOST`` bytes).  Cores beyond
the bound are encoded where they stand, with the same ids.  The join of two
cores, a word that the cut divides, is encoded anew, and again with one more
word on either side: if the wider ids are not the narrower ones between those of
the two words, the join is widened to both cores, and so on until they agree.

Null and empty texts have no ids and decode to the empty string.  Very long
texts are read whole, one at a time.  Repeated rows give repeated rows, equal
texts equal ids; an empty table gives no rows.  Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .text import _BASE, _BASE_INV, _SLICE, _SPACE, _VALUES, _powers_of, batches, mix
from .wordcodec import codec

_WINDOW = 16
_CORE_MOST = 1 << 13


def _cuts(buf: np.ndarray, mask: int) -> np.ndarray:
    """Ends of the 16-byte windows whose rolling hash has zero low bits."""
    found = []
    for a in range(0, len(buf), _SLICE):
        part = buf[max(0, a - _WINDOW + 1) : a + _SLICE]
        if len(part) < _WINDOW:
            continue
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * _powers_of(_BASE, len(part))[: len(part)], out=total[1:])
        h = mix((total[_WINDOW:] - total[:-_WINDOW]) * _powers_of(_BASE_INV, len(part))[: len(part) - _WINDOW + 1])
        found.append(np.flatnonzero((h & np.uint64(mask)) == 0) + max(0, a - _WINDOW + 1) + _WINDOW)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def pieces(texts: list, mask: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, the bounds of the pieces, which are cores, and the index of each text's first piece."""
    parts = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    edges = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=edges[1:])
    raw = b" ".join(parts) + b" "
    buf = np.frombuffer(raw, np.uint8)
    space = _SPACE[buf]
    safe = np.union1d(np.flatnonzero(space[1:] & ~space[:-1]) + 1, edges)  # a text's end is the space after it, at the latest
    cut = _cuts(buf, mask)
    left = safe[np.maximum(np.searchsorted(safe, cut, "right") - 1, 0)]
    right = safe[np.minimum(np.searchsorted(safe, cut, "right"), len(safe) - 1)]
    seam = np.unique(left)
    bounds = np.union1d(np.union1d(left, right), edges)
    core = ~np.isin(bounds[:-1], seam)
    return raw, bounds, core, np.searchsorted(bounds, edges)


def repaired(raw: bytes, bounds: np.ndarray, core: np.ndarray, first: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces whose joins agree: a join that reads otherwise with a word more on either side takes in the pieces beside it."""
    safe = None
    checked = np.zeros(0, np.int64)
    while True:
        seam = np.flatnonzero(~core)
        seam = seam[(bounds[seam + 1] > bounds[seam]) & ~np.isin(bounds[seam], checked)]
        if not len(seam):
            return bounds, core, first
        if safe is None:
            space = _SPACE[np.frombuffer(raw, np.uint8)]
            safe = np.union1d(np.flatnonzero(space[1:] & ~space[:-1]) + 1, bounds)
        edges = bounds[first]  # a join does not look into another text
        text = np.searchsorted(edges, bounds[seam], "right") - 1
        a, b = bounds[seam], bounds[seam + 1]
        before = np.maximum(safe[np.maximum(np.searchsorted(safe, a) - 1, 0)], edges[text])
        after = np.minimum(safe[np.minimum(np.searchsorted(safe, b, "right"), len(safe) - 1)], edges[text + 1])
        spans = [raw[x:y] for group in ((before, after), (before, a), (a, b), (b, after)) for x, y in zip(group[0].tolist(), group[1].tolist())]
        ids, at = encode(spans)
        n = len(seam)
        wide, narrow = at[n] - at[0], at[4 * n] - at[n]
        size = np.diff(at).reshape(4, n)
        bad = size[0] != size[1:].sum(0)
        if not bad.any() and wide == narrow:
            # ids of the three parts, join by join, against those of the wider text
            order = np.argsort(np.concatenate([np.repeat(np.arange(n) * 3 + k, size[k + 1]) for k in range(3)]), kind="stable")
            differs = ids[at[n] : at[4 * n]][order] != ids[at[0] : at[n]]
            bad[np.repeat(np.arange(n), size[0])[differs]] = True
        checked = np.union1d(checked, bounds[seam[~bad]])
        if not bad.any():
            return bounds, core, first
        drop = np.unique(np.concatenate([bounds[seam[bad]], bounds[seam[bad] + 1]]))
        drop = drop[~np.isin(drop, edges)]
        if not len(drop):
            checked = np.union1d(checked, bounds[seam[bad]])  # the join is its whole text
            continue
        keep = ~np.isin(bounds, drop)
        joined_ = np.add.reduceat((~core).astype(int), np.flatnonzero(keep[:-1])) > 0
        bounds, core = bounds[keep], ~joined_
        first = np.searchsorted(bounds, edges)


def core_key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _keys(raw: bytes, bounds: np.ndarray, core: np.ndarray) -> list:
    return [core_key(raw[a:b]) if c and 64 <= b - a <= _CORE_MOST else None for a, b, c in zip(bounds[:-1].tolist(), bounds[1:].tolist(), core.tolist())]


def shared_cores(docs: DataFrame, mask: int, reuse_cores: int) -> DataFrame:
    """(key, n) of the cores that occur more than once, the most frequent first, up to the bound of the table."""

    def count(frames):
        for frame in batches(frames, "text"):
            raw, bounds, core, _ = pieces(frame["text"].tolist(), mask)
            keys, n = np.unique(np.array([k for k in _keys(raw, bounds, core) if k is not None] or [b"\0" * 16], "V16"), return_counts=True)
            yield pd.DataFrame({"key": [k.tobytes() for k in keys], "n": n.astype(np.int64)})

    counted = docs.select("text").mapInPandas(count, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.where("n > 1").orderBy(F.desc("n"), "key").limit(reuse_cores)


def encode(docs: DataFrame, path: str, chunk_bytes: int = 512, reuse_cores: int = 20_000, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids), and the ids decoded again if asked for in the same pass: ids as little-endian unsigned 32-bit numbers, as the library gives them without special tokens."""
    spark, mask = docs.sparkSession, chunk_bytes - 1
    docs = docs.select("doc_id", "text")
    wanted = spark.sparkContext.broadcast({bytes(r.key) for r in shared_cores(docs, mask, reuse_cores).collect()})

    def find(frames):
        met: set = set()
        for frame in batches(frames, "text"):
            raw, bounds, core, _ = pieces(frame["text"].tolist(), mask)
            rows = []
            for k, a, b in zip(_keys(raw, bounds, core), bounds[:-1].tolist(), bounds[1:].tolist()):
                if k in wanted.value and k not in met:
                    met.add(k)
                    rows.append((k, raw[a:b]))
            yield pd.DataFrame(rows, columns=["key", "core"])

    def encode_cores(frames):
        for frame in frames:
            ids, at = codec(path).encode(frame["core"].tolist())
            yield pd.DataFrame({"key": frame["key"], "ids": [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]})

    once = docs.select("text").mapInPandas(find, "key binary, core binary").groupBy("key").agg(F.min("core").alias("core"))
    table = spark.sparkContext.broadcast({bytes(r.key): bytes(r.ids) for r in once.mapInPandas(encode_cores, "key binary, ids binary").collect()})

    def run(frames):
        ready = {k: np.frombuffer(v, np.uint16) for k, v in table.value.items()}
        for frame in batches(frames, "text", 2 << 20):
            raw, bounds, core, first = pieces(frame["text"].tolist(), mask)
            bounds, core, first = repaired(raw, bounds, core, first, codec(path).encode)
            known = [ready.get(k) if k else None for k in _keys(raw, bounds, core)]
            rest = [raw[a:b] for a, b, x in zip(bounds[:-1].tolist(), bounds[1:].tolist(), known) if x is None]
            ids, at = codec(path).encode(rest)
            got = iter(zip(at[:-1].tolist(), at[1:].tolist()))
            parts = [x if x is not None else ids[slice(*next(got))] for x in known]
            size = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            whole = (np.concatenate(parts) if parts else np.empty(0, np.uint16)).astype("<u4")
            cut = size[first]
            out = pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": np.diff(cut), "ids": [whole[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]})
            if decoded:
                out["decoded"] = [codec(path).decode(whole[a:b]).decode() for a, b in zip(cut[:-1], cut[1:])]
            yield out

    return map_texts(docs, run, "n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds the decoded text to rows of encode()."""

    def run(frames):
        for frame in frames:
            for a in range(0, len(frame), 500):
                part = frame.iloc[a : a + 500]
                yield part.assign(decoded=[codec(path).decode(np.frombuffer(x or b"", "<u4")).decode() for x in part["ids"]])

    rows = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "n_tokens", "ids")
    return rows.mapInPandas(run, "doc_id string, n_tokens long, ids binary, decoded string").withColumn("doc_id", F.col("doc_id").cast("long"))
