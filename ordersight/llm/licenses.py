"""License scans by patience alignment of texts with license templates.

A stretch of text and a template are aligned on the words that occur once in both: the longest
increasing subsequence of their places gives the anchors, and the gaps between anchors are aligned
the same way. Equal words at a gap's borders are matched first. Coverage is the share of the template's
words that are matched; a find needs at least ``COVERAGE``.

Whole texts are scanned. A template is tried only where it can succeed: the text must hold enough of
its words, and a stretch starts at a word of the template and holds enough of them within its width.
Both are necessary conditions of coverage, so nothing is missed by them. Every such stretch is aligned,
and of finds that overlap the one with the highest coverage stays, then the shortest and the first, so
that a template word ahead of a notice does not cut its end. Behind an exact copy the scan goes on, and
repeated notices are all found. The work is one narrow pass; templates travel with it.

A null, empty or wordless text has no finds; repeated rows and null ids are scanned alike; an empty
table gives no rows; templates without words are never found.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ordersight.llm import tokens
from ordersight.llm.license_texts import TEMPLATES

COVERAGE = 0.8
SLACK = 4  # a stretch is a fourth longer than its template, for words put in between
KIND = "array<struct<license:string,coverage:double,start:int,end:int>>"


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence."""
    tails, places, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            places.append(i)
        else:
            tails[k], places[k] = v, i
        before[i] = places[k - 1] if k else -1
    out, at = [], places[-1] if places else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two word sequences by patience alignment, in order."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        low_a, high_a, low_b, high_b = open_.pop()
        while low_a < high_a and low_b < high_b and a[low_a] == b[low_b]:
            found.append((low_a, low_b))
            low_a, low_b = low_a + 1, low_b + 1
        while low_a < high_a and low_b < high_b and a[high_a - 1] == b[high_b - 1]:
            high_a, high_b = high_a - 1, high_b - 1
            found.append((high_a, high_b))
        if low_a >= high_a or low_b >= high_b:
            continue
        in_a, in_b = Counter(a[low_a:high_a]), Counter(b[low_b:high_b])
        place = {w: j for j, w in enumerate(b[low_b:high_b], low_b) if in_b[w] == 1}
        both = [(i, place[w]) for i, w in enumerate(a[low_a:high_a], low_a) if in_a[w] == 1 and w in place]
        anchors = [both[k] for k in increasing([j for _, j in both])]
        if not anchors:
            continue
        last_a, last_b = low_a, low_b
        for i, j in [*anchors, (high_a, high_b)]:
            open_.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
        found += anchors
    return sorted(found)


class Scanner:
    """Templates as word hashes, ready to scan texts."""

    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.powers = tokens.powers()
        self.names, self.words = [], []
        for name, text in sorted(templates.items()):
            block = next(tokens.words(pa.array([text]), tokens.NOT_ALPHANUMERIC))
            if len(block.start):
                self.names.append(name)
                self.words.append(block.hashes(self.powers))
        self.need = np.array([int(np.ceil(coverage * len(w))) for w in self.words])
        self.width = [len(w) + len(w) // SLACK + 1 for w in self.words]
        self.known = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.uses = np.stack([np.bincount(np.searchsorted(self.known, w), minlength=len(self.known)) for w in self.words], 1) if self.words else None

    def scan(self, texts: pa.Array) -> list[list[dict]]:
        out = []
        for block in tokens.words(texts, tokens.NOT_ALPHANUMERIC):
            h = block.hashes(self.powers)
            if not len(self.known):
                out += [[] for _ in range(len(block))]
                continue
            place = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = self.known[place] == h
            for low, high in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True):
                there = np.flatnonzero(hit[low:high])
                out.append(self._text(place[low:high], there, high - low))
        return out

    def _text(self, place: np.ndarray, there: np.ndarray, size: int) -> list[dict]:
        if not len(there):
            return []
        present = self.uses[np.unique(place[there])].sum(0)  # template words that the text holds at all
        own = np.full(size, -1, np.int64)
        own[there] = place[there]
        return [found for t in np.flatnonzero(present >= self.need).tolist() for found in self._template(t, own, there)]

    def _template(self, t: int, own: np.ndarray, there: np.ndarray) -> list[dict]:
        template = np.searchsorted(self.known, self.words[t]).tolist()
        at = there[self.uses[own[there], t] > 0]
        within = np.searchsorted(at, at + self.width[t]) - np.arange(len(at))  # template words in the stretch
        accepted, after = set(), 0
        for start in at[within >= self.need[t]].tolist():
            if start < after:
                continue
            stretch = own[start : start + self.width[t]].tolist()
            pairs = align(template, stretch)
            if len(pairs) >= self.need[t]:
                low, high = min(j for _, j in pairs), max(j for _, j in pairs) + 1
                accepted.add((-len(pairs), high - low, start + low, start + high))
                if len(pairs) == len(template) == high - low:  # nothing that overlaps it is better
                    after = start + high
        chosen: list[tuple[int, int, int]] = []
        for matched, _, low, high in sorted(accepted):
            k = bisect_left(chosen, (low, high, 0))
            if (k == 0 or chosen[k - 1][1] <= low) and (k == len(chosen) or high <= chosen[k][0]):
                chosen.insert(k, (low, high, -matched))
        return [
            {"license": self.names[t], "coverage": n / len(template), "start": low, "end": high} for low, high, n in chosen
        ]


def find(text: Column, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> Column:
    """Array of finds of a text: license, coverage, and start and end in words, by name and place."""

    @F.arrow_udf(KIND)
    def found(texts: pa.Array) -> pa.Array:
        row = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array(Scanner(templates, coverage).scan(texts), pa.list_(row))

    return found(text.cast("string"))
