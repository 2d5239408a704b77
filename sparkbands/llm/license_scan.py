"""Licence scan with a generalised suffix automaton of licence words.

All templates go into one suffix automaton over words, each from its first
state, so no match runs across two.  A text is streamed through it once: at
every word the automaton is in the state of the longest run of words ending there
that some template holds (matching statistics); a word of no template leads back
to the start, so only runs of words that templates hold are walked.

A match that cannot be made longer and has at least ``least`` words, or is its
whole template, is placed where the template holds it.  Matches are chained along
a template in order of the text, while the words left out on either side are at
most ``gap``; a chain that covers ``share`` of the template's words, and at least
``least`` of them or all, is a covered span.  A phrase is a template that counts wherever
it stands, even inside a longer match: the states whose run ends with it are known.

The automaton is built from the templates, a parameter (a few thousand words),
and broadcast; texts are read where they lie, so nothing is shuffled.

Null and empty texts have no words and no spans.  Very long texts are streamed
whole.  Repeated rows give repeated rows, a missing doc_id stays missing.  Of
spans that tie, both stay; of equal labels one is listed.  An
empty table gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .license_texts import PHRASES, TEMPLATES
from .text import batches, tokens

#: Bytes between words: all below 0x80 that are no digit and no small letter.
_GAPS = np.zeros(256, bool)
_GAPS[:0x80] = True
_GAPS[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False


class Automaton:
    """Suffix automaton of several sequences of words, each state with its places in the templates."""

    def __init__(self, templates: list = TEMPLATES, phrases: set = PHRASES):
        templates = list(dict.fromkeys(templates))
        found = tokens([text for _, text in templates], gaps=_GAPS)
        self.labels = [label for label, _ in templates]
        self.size = found.counts.tolist()
        self.words, ids = np.unique(found.hashes, return_inverse=True)
        self.go: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list] = [[]]
        self.phrase: list[list] = [[]]  # (phrase, its number of words) that end a state's runs
        for t, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist())):
            last = 0
            for i, w in enumerate(ids[a:b].tolist()):
                last = self._add(last, w, ends)
                ends[last].append((t, i + 1))
        # places of a state are those of all states that it is the longest shared end of
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                ends[self.link[v]].extend(ends[v])
        self.ends = [sorted(set(e)) for e in ends]
        self.phrase = [[] for _ in self.link]
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.phrase[v] = list(self.phrase[self.link[v]])
            for t in sorted({t for t, i in self.ends[v] if i == self.size[t] and templates[t][1] in phrases}):
                if self.length[self.link[v]] < self.size[t] <= self.length[v]:
                    self.phrase[v].append((t, self.size[t]))

    def _state(self, length: int, link: int, go: dict, ends: list) -> int:
        self.length.append(length)
        self.link.append(link)
        self.go.append(go)
        ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int, ends: list) -> int:
        """The state of q's runs that are at most one word longer than p's longest, taken out of q."""
        new = self._state(self.length[p] + 1, self.link[q], dict(self.go[q]), ends)
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _add(self, last: int, w: int, ends: list) -> int:
        q = self.go[last].get(w)
        if q is not None:  # an earlier template holds the same words
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q, ends)
        new, p = self._state(self.length[last] + 1, 0, {}, ends), last
        while p >= 0 and w not in self.go[p]:
            self.go[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q, ends)
        return new

    def stream(self, ids: list) -> tuple[list, list]:
        """Matching statistics of words that are all known: the state and the length of the longest match at each."""
        v, n, states, lengths = 0, 0, [], []
        go, link, length = self.go, self.link, self.length
        for w in ids:
            to = go[v].get(w)
            while to is None:
                v = link[v]
                n = length[v]
                to = go[v].get(w)
            v, n = to, n + 1
            states.append(v)
            lengths.append(n)
        return states, lengths

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word among the templates', -1 where none holds it."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def scan(self, ids: list, begin: int, least: int) -> tuple[list, list]:
        """Of a run of known words that begins at word ``begin``: places (first word, phrase), and matches (first, last + 1, state)."""
        states, lengths = self.stream(ids)
        places, matches = [], []
        for i, (v, n) in enumerate(zip(states, lengths)):
            for t, size in self.phrase[v]:
                if n >= size:
                    places.append((begin + i + 1 - size, t))
            if i + 1 == len(ids) or lengths[i + 1] <= n:  # can't be made longer
                if n >= least or any(e == n == self.size[t] for t, e in self.ends[v]):
                    matches.append((begin + i + 1 - n, begin + i + 1, v))
        return places, matches

    def chains(self, matches: list, gap: int, share: float, least: int) -> list:
        """Spans (template, first word, last word + 1, covered words) of matches in order of the text."""
        done: list = []
        live: dict[int, list] = {}  # template: [first, end, end in the template, covered]

        def close(t: int) -> None:
            first, end, _, covered = live.pop(t)
            if covered >= share * self.size[t] and covered >= min(least, self.size[t]):
                done.append((t, first, end, covered))

        for a, b, v in matches:
            places: dict[int, list] = {}
            for t, e in self.ends[v]:
                if b - a >= least or e == b - a == self.size[t]:
                    places.setdefault(t, []).append(e)
            for t, ends in places.items():
                have = live.get(t)
                if have is not None:
                    # the nearest place after what is covered; a match that begins inside it counts from its end
                    cut = max(0, have[1] - a)
                    ahead = [e for e in ends if 0 <= e - (b - a) + cut - have[2] <= gap] if b - a > cut and a - have[1] <= gap else []
                    if ahead:
                        have[1], have[2], have[3] = b, ahead[0], have[3] + b - a - cut
                        continue
                    if b <= have[1]:
                        continue  # lies inside the chain
                    if have[3] > b - a and have[1] > a:
                        continue  # the longer of two that overlap stays
                    close(t)
                live[t] = [a, b, ends[0], b - a]
        for t in list(live):
            close(t)
        return self.best(sorted(done, key=lambda s: (s[1], s[2], s[0])))

    def best(self, spans: list) -> list:
        """Spans, in order of their first word, without those that lie in better ones by more than half."""
        out: set = set()
        open_: list = []
        rank = lambda s: (s[3], s[3] / self.size[s[0]])
        for k, s in enumerate(spans):
            open_ = [j for j in open_ if spans[j][2] > s[1]]
            for j in open_:
                o = spans[j]
                both = 2 * (min(o[2], s[2]) - s[1])
                if both > s[2] - s[1] and rank(o) > rank(s):
                    out.add(k)
                if both > o[2] - o[1] and rank(s) > rank(o):
                    out.add(j)
            open_.append(k)
        return [s for k, s in enumerate(spans) if k not in out]


def found_in(texts: list, auto: Automaton, least: int = 4, gap: int = 12, share: float = 0.6) -> tuple[np.ndarray, list, list]:
    """Of each text: its number of words, places of phrases, and covered spans."""
    words = tokens(texts, gaps=_GAPS)
    ids = auto.known(words.hashes)
    places: list = [[] for _ in texts]
    spans: list = [[] for _ in texts]
    matches: list = [[] for _ in texts]
    # runs of known words of one text, of two words at least
    inside = ids >= 0
    doc = words.doc()
    joins = inside[1:] & inside[:-1] & (doc[1:] == doc[:-1]) if len(ids) else inside
    begins = np.flatnonzero(joins & ~np.concatenate([[False], joins[:-1]])) if len(ids) else []
    stops = np.flatnonzero(joins & ~np.concatenate([joins[1:], [False]])) + 2 if len(ids) else []
    for a, b in zip(np.asarray(begins).tolist(), np.asarray(stops).tolist()):
        d = int(doc[a])
        p, m = auto.scan(ids[a:b].tolist(), a - int(words.first[d]), least)
        places[d] += p
        matches[d] += m
    for d, m in enumerate(matches):
        if m:
            spans[d] = auto.chains(m, gap, share, least)
    return words.counts, places, spans


def scan(docs: DataFrame, templates: list = TEMPLATES, phrases: set = PHRASES, least: int = 4, gap: int = 12, share: float = 0.6) -> DataFrame:
    """One row for each document: n_words, ``places`` of phrases (word, label) and ``spans`` of templates (label, template, first_word, end_word, covered, coverage)."""
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(templates, phrases))

    def run(frames):
        auto = sent.value
        for frame in batches(frames, "text"):
            n, places, spans = found_in(frame["text"].tolist(), auto, least, gap, share)
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "n_words": n,
                    "places": [[{"word": w, "label": auto.labels[t]} for w, t in p] for p in places],
                    "spans": [[{"label": auto.labels[t], "template": t, "first_word": a, "end_word": b, "covered": c, "coverage": c / auto.size[t]} for t, a, b, c in s] for s in spans],
                }
            )

    return map_texts(docs, run, "n_words long, places array<struct<word: long, label: string>>, spans array<struct<label: string, template: int, first_word: long, end_word: long, covered: int, coverage: double>>")


def summary(found: DataFrame) -> DataFrame:
    """Digest of scan(): counts, labels, and as score the largest coverage of a template (a phrase that is there covers its own)."""
    base, more = F.col("places.label"), F.col("spans.label")
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.least(F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
