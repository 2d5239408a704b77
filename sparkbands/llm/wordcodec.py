"""Whole-text encoding with a word-level BPE file, with each distinct piece merged once per worker.

The vocabulary drops white space and never merges across it, so a text may be
cut before any white-space run without changing its ids.  Runs of plain
letters, single digits and runs of punctuation are merged together in arrays;
a word that holds anything else (other scripts, apostrophes, special tokens)
goes to the tokenizers library itself.  Results are remembered by a 64-bit
hash in a table of fixed size.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from .text import _SPACE, word_hashes

_SLOT_BITS = 21
_POOL = 12_000_000  # remembered ids; the memory is emptied when they are reached

_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 punctuation, 4 left to the library
_KIND[_SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[:9] = 4
_KIND[14:32] = 4
_KIND[[0x27, 0x3C, 0x7F]] = 4  # apostrophes start contractions, < may start a special token
_KIND[0x80:] = 4
_KIND[0x80:0xC0] = 1  # second byte of a letter; other lead bytes are left to the library
_KIND[0xC3] = 1


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies define it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordCodec:
    """encode() equals the library's encode with add_special_tokens=False; decode() its decode without a decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model.get("end_of_word_suffix") != "</w>" or spec.get("decoder") is not None:
            raise ValueError("a word-level BPE file with </w> and no decoder is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + "</w>"] for s in symbols], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair, self.rank = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        names = [b""] * size
        for token, i in vocab.items():
            names[i] = token.encode() + b" "
        for t in spec["added_tokens"]:
            names[t["id"]] = t["content"].encode() + b" "
        self.name_at = np.zeros(size + 1, np.int64)
        np.cumsum([len(x) for x in names], out=self.name_at[1:])
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.at = np.zeros(1 << _SLOT_BITS, np.int32)
        self.length = np.zeros(1 << _SLOT_BITS, np.int32)
        self.pool = np.zeros(1 << 16, np.uint16)
        self.used = 0

    # -- merging -----------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), self.rank[at], np.int32(2**31 - 1))

    def _merge(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the plain pieces buf[s:e], all of about one length, and how many each has."""
        none, n, size = np.int32(2**31 - 1), len(starts), int((ends - starts).max())
        col = np.arange(size)
        there = col < (ends - starts)[:, None]
        raw = buf[np.minimum(starts[:, None] + col, len(buf) - 1)]
        sym = np.where(there, self.inner[raw], -1)
        rows = np.arange(n)
        end = ends - starts - 1
        sym[rows, end] = self.last[raw[rows, end]]
        after = np.where(col + 1 < (ends - starts)[:, None], col + 1, size)
        before = np.broadcast_to(col - 1, (n, size)).copy()
        rank = np.full((n, size), none, np.int32)
        if size > 1:
            rank[:, :-1] = self._ranks(sym[:, :-1], sym[:, 1:])
        live = rows
        while len(live):
            i = rank[live].argmin(1)
            best = rank[live, i]
            keep = best != none
            live, i, best = live[keep], i[keep], best[keep]
            if not len(live):
                break
            j = after[live, i]
            sym[live, i] = self.merged[best]
            sym[live, j] = -1
            rank[live, j] = none
            k = after[live, j]
            after[live, i] = k
            has = k < size
            before[live[has], k[has]] = i[has]
            right = np.where(has, sym[live, np.minimum(k, size - 1)], -1)
            rank[live, i] = self._ranks(sym[live, i], right)
            p = before[live, i]
            has = p >= 0
            rank[live[has], p[has]] = self._ranks(sym[live[has], p[has]], sym[live[has], i[has]])
        kept = sym >= 0
        return sym[kept].astype(np.uint16), kept.sum(1)

    def _fresh(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, in order, and how many each has."""
        ids: list = [None] * len(starts)
        size = ends - starts
        plain = np.flatnonzero(~odd & (size <= 64))
        plain = plain[np.argsort(size[plain], kind="stable")]
        for a in range(0, len(plain), 4096):
            some = plain[a : a + 4096]
            got, n = self._merge(buf, starts[some], ends[some])
            for k, x in zip(some.tolist(), np.split(got, np.cumsum(n)[:-1])):
                ids[k] = x
        rest = np.flatnonzero(odd | (size > 64))
        if len(rest):
            words = [buf[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") for k in rest]
            for k, e in zip(rest.tolist(), self.library.encode_batch(words, add_special_tokens=False)):
                ids[k] = np.array(e.ids, np.uint16)
        n = np.array([len(x) for x in ids], np.int64)
        return (np.concatenate(ids) if ids else np.empty(0, np.uint16)), n

    # -- pieces ------------------------------------------------------------

    def _pieces(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans of the pieces and whether the library has to encode them."""
        kind = _KIND[buf]
        lead = buf == 0xC3
        kind[1:][lead[:-1] & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))] = 4
        space = kind == 0
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        ws, we = edge[0::2], edge[1::2]
        if not len(ws):
            return ws, we, np.empty(0, bool)
        bad = np.concatenate([[0], np.cumsum(kind == 4)])
        strange = bad[we] > bad[ws]
        for s, e in zip(ws[strange].tolist(), we[strange].tolist()):
            kind[s:e] = 4
        cut = np.empty(len(buf), bool)
        cut[0] = True
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        what = kind[starts]
        keep = what != 0
        return starts[keep], ends[keep], what[keep] == 4

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array of 16-bit numbers, and the offset of each text's ids."""
        parts = [t.encode("utf-8", "replace") if isinstance(t, str) else (t or b"") for t in texts]
        edges = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=edges[1:])
        buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8).copy()
        starts, ends, odd = self._pieces(buf)
        upper = (buf >= 65) & (buf <= 90)
        after = np.zeros(len(buf), bool)
        after[1:] = buf[:-1] == 0xC3
        upper |= after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)
        kept = buf.copy()
        buf[upper] += 32
        if odd.any():  # those words are left as they were
            for s, e in zip(starts[odd].tolist(), ends[odd].tolist()):
                buf[s:e] = kept[s:e]
        if self.used > _POOL:
            self._forget()
        h = word_hashes(buf, starts, ends) | np.uint64(1)
        h[odd] ^= np.uint64(0xA5A5A5A5A5A5A5A4)
        slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        known = self.keys[slot] == h
        other = ((h >> np.uint64(20)) & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)
        second = ~known & (self.keys[other] == h)
        slot[second] = other[second]
        new = np.flatnonzero(~known & ~second)
        at, n = self.at[slot], self.length[slot]
        if len(new):
            _, one, back = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[one]
            got, many = self._fresh(buf, starts[one], ends[one], odd[one])
            first = self.used + np.cumsum(many) - many
            self._store(got)
            at[new], n[new] = first[back], many[back]
            free = self.keys[slot[one]] == 0
            put = np.where(free, slot[one], other[one])
            self.keys[put], self.at[put], self.length[put] = h[one], first, many
            # one slot may have been written twice: the last pair stays whole
            wrong = self.keys[put] != h[one]
            self.keys[put[wrong]] = 0
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        ids = self.pool[np.repeat(at.astype(np.int64) - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, edges)]

    def _store(self, ids: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(need, 2 * len(self.pool)) - self.used, np.uint16)])
        self.pool[self.used : need] = ids
        self.used = need

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the tokens' strings with one space between them."""
        if not len(ids):
            return b""
        ids = ids.astype(np.int64)
        n = self.name_at[ids + 1] - self.name_at[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.names[np.repeat(self.name_at[ids] - total[:-1], n) + np.arange(total[-1])][:-1].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    """One codec for each worker process and file."""
    return WordCodec(path)
