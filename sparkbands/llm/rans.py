"""Token-id files by a static range asymmetric numeral system.

One frequency table of the whole corpus (every id at least 1 of 2**20) is
shared by all blocks.  A block holds whole documents in ascending order of
doc_id and is coded by itself, in interleaved lanes of 64-bit states that give
out 32-bit words.  It carries the document ids and lengths, the states and word
offset at every checkpoint, from which decoding can begin, a checksum of its
bytes and one of the table.  A file is a row of (part, block, payload) in a
Parquet folder, so Spark's writers place it, and a lost task is written again;
the table is a row beside them, so a folder is read without anything else.
Blocks are decoded side by side, and a stretch of ids from the checkpoints
before it.

Null and empty texts give the end id alone; a document longer than a block is
one block.  Null ids come first; rows that share an id follow by length and
checksum, so ties that are left are equal rows.  An empty table gives files of
no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_texts, shared_folder, written
from .text import batches
from .wordcodec import codec

_PROB = 20
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIIII")  # magic, table checksum, documents, ids, lanes, words, checkpoints
_MAGIC = b"RANB"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Shares of 2**20 that follow the counts; every id has at least 1."""
    total, size = int(counts.sum()), 1 << _PROB
    f = 1 + (counts.astype(np.float64) * ((size - len(counts)) / max(total, 1))).astype(np.int64)
    f[int(counts.argmax())] += size - int(f.sum())
    return f


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.int32)
        self.check = zlib.crc32(freq.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, table: Table, lanes: int = 1024, every: int = 128) -> tuple[bytes, int, int, int]:
    """(checkpoints and words, lanes, words, checkpoints); id i goes to lane i mod lanes."""
    lanes = max(1, min(lanes, len(ids) // 16))
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, _LOW)
    words: list = [None] * steps
    marks, shift, half = [], np.uint64(_PROB), np.uint64(32)
    limit = table.freq << np.uint64(31 - _PROB + 32)
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        x, f = state[: len(s)], table.freq[s]
        over = x >= limit[s]
        words[t] = x[over].astype(np.uint32)
        x[over] >>= half
        q = x // f
        state[: len(s)] = (q << shift) + (x - q * f) + table.start[s]
        if t % every == 0:
            marks.append((t, state.copy()))
    offset = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    out = [struct.pack("<II", t, int(offset[t])) + m.astype("<u8").tobytes() for t, m in reversed(marks)]
    return b"".join(out) + b"".join(w.astype("<u4").tobytes() for w in words), lanes, int(offset[-1]), len(marks)


def decode_steps(n: int, lanes: int, state: np.ndarray, words: np.ndarray, at: int, first: int, last: int, table: Table) -> np.ndarray:
    """Ids of the steps first .. last - 1, from a checkpoint's state and word offset."""
    state, mask, out = state.copy(), np.uint64((1 << _PROB) - 1), []
    for t in range(first, last):
        x = state[: min(lanes, n - t * lanes)]
        slot = x & mask
        s = table.symbol[slot.astype(np.int64)]
        x = table.freq[s] * (x >> np.uint64(_PROB)) + slot - table.start[s]
        need = np.flatnonzero(x < _LOW)
        x[need] = (x[need] << np.uint64(32)) | words[at : at + len(need)]
        at += len(need)
        state[: len(x)] = x
        out.append(s)
    return np.concatenate(out) if out else np.empty(0, np.int32)


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    body, lanes, words, marks = encode_block(ids, table)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = _HEAD.pack(_MAGIC, table.check, len(doc_ids), len(ids), lanes, words, marks)
    raw = head + np.array([int(d or 0) for d in doc_ids], "<i8").tobytes() + known.tobytes() + lengths.astype("<u4").tobytes() + body
    return raw + struct.pack("<I", zlib.crc32(raw))


def unpack(raw: bytes, table: Table, parts: slice | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a block; ``parts`` picks the runs between checkpoints to decode."""
    if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("a block's checksum does not match")
    magic, check, docs, n, lanes, n_words, marks = _HEAD.unpack_from(raw)
    if magic != _MAGIC or check != table.check:
        raise ValueError("not a block of this table")
    at = _HEAD.size
    doc_ids, known = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(raw, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    points = []
    for _ in range(marks):
        t, offset = struct.unpack_from("<II", raw, at)
        points.append((t, offset, np.frombuffer(raw, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    words = np.frombuffer(raw, "<u4", n_words, at).astype(np.uint64)
    ends = [*(p[0] for p in points[1:]), -(-n // lanes)]
    runs = list(zip(points, ends))[parts or slice(None)]
    ids = [decode_steps(n, lanes, state, words, offset, t, end, table) for (t, offset, state), end in runs]
    return [int(d) if k else None for d, k in zip(doc_ids, known)], lengths, np.concatenate(ids) if ids else np.empty(0, np.int32)


def run_edges(raw: bytes) -> np.ndarray:
    """Position in a block of the first id of each run between checkpoints, and the end."""
    _, _, docs, n, lanes, _, marks = _HEAD.unpack_from(raw)
    at = _HEAD.size + 13 * docs
    steps = [struct.unpack_from("<I", raw, at + k * (8 + 8 * lanes))[0] for k in range(marks)]
    return np.array([*(t * lanes for t in steps), n])


def token_ids(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """(doc_id, n, ids, crc): 16-bit ids of each whole text with the end id after them."""

    def run(frames):
        for frame in batches(frames, "text"):
            ids, at = codec(path).encode(frame["text"].tolist())
            parts = [np.append(ids[a:b], np.uint16(end_id)) for a, b in zip(at[:-1], at[1:])]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n": [len(p) for p in parts], "ids": [p.tobytes() for p in parts], "crc": [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]})

    return map_texts(docs, run, "n long, ids binary, crc long")


def write_files(docs: DataFrame, path: str, folder: str, block: int = 1 << 18, partitions: int | None = None) -> None:
    """Encode documents and write their ids and the shared table to ``folder``, ids in ascending order of doc_id.

    Without ``partitions`` there are as many as hold about eight blocks each.
    """
    spark = docs.sparkSession
    size = codec(path).name_at.size - 1
    rows = written(token_ids(docs, path), "token-ids")

    def count(frames):
        total = np.zeros(size, np.int64)
        for f in frames:
            for x in f["ids"]:
                total += np.bincount(np.frombuffer(x, np.uint16), minlength=size) if len(x) > 1 << 16 else 0
            small = [x for x in f["ids"] if len(x) <= 1 << 16]
            total += np.bincount(np.frombuffer(b"".join(small), np.uint16), minlength=size)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen.astype(np.int32), "n": total[seen]})

    counts = np.zeros(size, np.int64)  # as many numbers as the vocabulary has ids
    for r in rows.select("ids").mapInPandas(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    table = Table(frequencies(counts))
    row = [(bytearray(table.freq.astype("<u4").tobytes()),)]
    spark.createDataFrame(row, "frequencies binary").coalesce(1).write.parquet(f"{folder}/table")  # four bytes an id of the vocabulary
    sent = spark.sparkContext.broadcast(table)

    def pack_all(frames):
        part, number, docs_, parts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def out():
            raw = pack(docs_, np.array([len(p) for p in parts]), np.concatenate(parts), sent.value)
            return pd.DataFrame({"part": [part], "block": [number], "n": [held], "payload": [raw]})

        for f in frames:
            for d, x in zip(f["doc_id"], f["ids"]):
                ids = np.frombuffer(x, np.uint16)
                if held and held + len(ids) > block:
                    yield out()
                    number, docs_, parts, held = number + 1, [], [], 0
                docs_.append(d)
                parts.append(ids)
                held += len(ids)
        if docs_:
            yield out()

    n = partitions or max(1, -(-int(counts.sum()) // (8 * block)))
    dealt = rows.repartitionByRange(n, "doc_id", "n", "crc").sortWithinPartitions("doc_id", "n", "crc")
    dealt = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "ids")
    dealt.mapInPandas(pack_all, "part int, block int, n long, payload binary").write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_table(spark, folder: str) -> Table:
    return Table(np.frombuffer(bytes(spark.read.parquet(f"{folder}/table").first()[0]), "<u4").astype(np.int64))


def placed_blocks(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """The blocks (part, block, n, payload), and (part, block, base): the ids before each."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    sizes = written(blocks.select("part", "block", "n"), "block-sizes")
    # sums over blocks inside a part, then over parts: a few numbers for each
    parts = sizes.groupBy("part").agg(F.sum("n").alias("m"))
    parts = parts.select("part", (F.sum("m").over(W.orderBy("part")) - F.col("m")).alias("base"))
    sizes = sizes.withColumn("inside", F.sum("n").over(W.partitionBy("part").orderBy("block")) - F.col("n")).join(parts, "part")
    return blocks, sizes.select("part", "block", (F.col("base") + F.col("inside")).alias("base"))


def read_files(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files."""
    blocks, sizes = placed_blocks(spark, folder)
    sent = spark.sparkContext.broadcast(read_table(spark, folder))

    def run(frames):
        for f in frames:
            for part, block, raw in zip(f["part"], f["block"], f["payload"]):
                docs, lengths, ids = unpack(raw, sent.value)
                ends = np.cumsum(lengths.astype(np.int64))
                raws = ids.astype("<u4")
                found = [raws[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pd.DataFrame({"part": part, "block": block, "doc_id": [None if d is None else str(d) for d in docs], "inside": ends - lengths, "n_tokens": lengths.astype(np.int64), "ids_crc32": [zlib.crc32(x) for x in found], "ids": found})

    rows = blocks.select("part", "block", "payload").mapInPandas(run, "part int, block int, doc_id string, inside long, n_tokens long, ids_crc32 long, ids binary")
    rows = rows.join(sizes, ["part", "block"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids")


def read_range(spark, folder: str, first: int, last: int) -> DataFrame:
    """(start, ids): the ids at positions ``first`` up to ``last``, a row for each block that holds some; only runs between checkpoints that reach them are decoded."""
    blocks, sizes = placed_blocks(spark, folder)
    sent = spark.sparkContext.broadcast(read_table(spark, folder))

    def run(frames):
        for f in frames:
            for base, n, raw in zip(f["base"], f["n"], f["payload"]):
                a, b = max(first - base, 0), min(last - base, n)
                edges = run_edges(raw)
                i, j = np.searchsorted(edges, a, "right") - 1, np.searchsorted(edges, b)
                ids = unpack(raw, sent.value, slice(i, j))[2][a - edges[i] : b - edges[i]]
                yield pd.DataFrame({"start": [base + a], "ids": [ids.astype("<u4").tobytes()]})

    rows = blocks.join(sizes, ["part", "block"]).where((F.col("base") < last) & (F.col("base") + F.col("n") > first))
    return rows.select("base", "n", "payload").mapInPandas(run, "start long, ids binary")


def new_folder(spark) -> str:
    import uuid

    return f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
