"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The word n-grams of the test items are counted over all documents.  The rarer part of each
item's own n-grams are its seeds (rarity is a rank within the item, so an item that leaked into
every third document still has seeds).  Where a document shares seeds with an item around one
diagonal, the passage there is aligned to the item word by word; the local alignment's score
over that of a perfect copy tells edited and paraphrased copies from chance.

The test items are the stated query set: they go to the tasks in blocks of bounded size, all
documents meet every block, and no text is shuffled.

Defined cases: words are runs of letters, digits and underscores in lower case; an item with
fewer than ``MIN_WORDS`` words (or a null one) matches nothing; a null or empty text matches
nothing; of several passages for one item the best counts, of equal ones the first; repeated
item rows count once; a null item_id stays null; repeated documents match alike; empty tables give an empty result; other
columns are kept by ``keep_clean`` and not read elsewhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, saved, text_rows

NGRAM, MIN_WORDS = 3, 4
RARE_SHARE = 0.75            # the rarest three quarters of an item's n-grams are its seeds
LEAST_SEEDS = 2              # seeds that a passage shares with an item before it is aligned
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5              # least score as a share of a perfect copy's
BLOCK_CHARS = 4_000_000      # characters of test items that go to the tasks at once
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text or "")]


class Items:
    """A block of test items with the codes of their n-grams (and of their seeds, once known)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, w in ((i, words(t)) for i, t in items) if len(w) >= MIN_WORDS]
        self.number = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        places: dict[int, list[tuple[int, int]]] = {}
        for k, (_, ws) in enumerate(self.items):
            for at, c in zip(*self.codes(ws)):
                places.setdefault(int(c), []).append((k, int(at)))
        self.places = places
        self.table = np.array(sorted(places), np.uint64)

    def codes(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and codes of the n-grams of known words."""
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        n = len(ids) - NGRAM + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok, code = np.ones(n, bool), np.zeros(n, np.uint64)
        for j in range(NGRAM):
            part = ids[j:j + n]
            ok &= part >= 0
            code = (code + part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        at = np.flatnonzero(ok)
        return at, code[at]

    def hits(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and codes of the n-grams that the table holds."""
        at, code = self.codes(ws)
        if not len(at) or not len(self.table):
            return at[:0], code[:0]
        k = np.minimum(np.searchsorted(self.table, code), len(self.table) - 1)
        found = self.table[k] == code
        return at[found], code[found]

    def keep_rare(self, frequency: dict[int, int]) -> None:
        """Leave each item's rarest n-grams (ties at the cut included) as its seeds."""
        by_item: dict[int, list[tuple[int, int]]] = {}
        for c, where in self.places.items():
            for k, _ in where:
                by_item.setdefault(k, []).append((frequency.get(c, 0), c))
        seeds: dict[int, list[tuple[int, int]]] = {}
        for k, grams in by_item.items():
            grams = sorted(set(grams))
            limit = grams[math.ceil(RARE_SHARE * len(grams)) - 1][0]
            for f, c in grams:
                if f <= limit:
                    seeds.setdefault(c, []).extend(p for p in self.places[c] if p[0] == k)
        self.places = seeds
        self.table = np.array(sorted(seeds), np.uint64)

    def matches(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, float, int, int]]:
        """(item_id, score, first word, one past the last word) of the best passage of each item found."""
        ws = words(text)
        at, code = self.hits(ws)
        if not len(at):
            return []
        shared: dict[int, list[tuple[int, int]]] = {}
        for p, c in zip(at.tolist(), code.tolist()):
            for k, q in self.places[c]:
                shared.setdefault(k, []).append((p - q, q))
        out = []
        for k, diagonals in sorted(shared.items()):
            item_id, item = self.items[k]
            need = min(LEAST_SEEDS, len(item) - NGRAM + 1)
            if len({q for _, q in diagonals}) < need:
                continue
            diagonals.sort()
            slack = len(item) // 2 + 4
            best, begin = None, 0
            for e in range(1, len(diagonals) + 1):
                if e < len(diagonals) and diagonals[e][0] - diagonals[e - 1][0] <= slack:
                    continue
                group, begin = diagonals[begin:e], e
                if len({q for _, q in group}) >= need:
                    for lo, hi in _stretches(group, len(item), slack):
                        lo, hi = max(0, lo), min(len(ws), hi)
                        score, a, b = align(item, ws[lo:hi])
                        if score >= threshold and (best is None or score > best[1]):
                            best = (item_id, score, lo + a, lo + b)
            if best:
                out.append(best)
        return out


def _stretches(group: list[tuple[int, int]], length: int, slack: int) -> list[tuple[int, int]]:
    """Word ranges that cover all seeds of a run of diagonals, each of bounded length: a long run
    (an item repeated over and over) is cut into overlapping ranges of a few item lengths."""
    lo, hi = group[0][0] - slack, group[-1][0] + length + slack
    step = 4 * (length + slack)
    return [(a, min(hi, a + 2 * step)) for a in range(lo, max(lo + 1, hi - step), step)]


def _rows(item: list[str], passage: list[str]) -> tuple[int, int]:
    """Smith-Waterman: the best local score and one past the passage word where it ends.  A row of the
    matrix is a few array operations; the gap along the row is a running maximum."""
    number = {w: i for i, w in enumerate(set(item))}
    words_ = np.fromiter((number.get(w, -1) for w in passage), np.int64, len(passage))
    ramp = -GAP * np.arange(len(passage) + 1)
    above = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(words_ == number[w], MATCH, MISMATCH))
        row = np.maximum.accumulate(row + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def align(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """Score as a share of a perfect copy's, and the aligned passage words [first, end)."""
    best, end = _rows(item, passage)
    _, back = _rows(item[::-1], passage[:end][::-1])
    return best / (MATCH * len(item)), end - back, end


def each_block(docs: DataFrame, benchmark: DataFrame, key: str = "item_id") -> Iterator[Items]:
    """The test items in blocks of about ``BLOCK_CHARS`` characters, one after another, their seeds found by
    counting each n-gram's documents over the whole of ``docs`` (task by task, then over tasks)."""
    items = benchmark.where("text is not null").select(F.col(key).alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_CHARS))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        block = Items(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        if block.items:
            block.keep_rare(_frequencies(docs, block))
            yield block


def blocks(docs: DataFrame, benchmark: DataFrame, key: str = "item_id") -> list[Items]:
    """All blocks at once, for test items that fit in the driver; see ``each_block``."""
    return list(each_block(docs, benchmark, key))


def _frequencies(docs: DataFrame, block: Items) -> dict[int, int]:
    """Documents that hold each n-gram of the block (bounded by the block's own n-grams)."""
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(np.unique(block.hits(words(text))[1]).astype(np.int64).tolist())
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["code", "n"])

    got = docs.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {r.code % (1 << 64): r.n for r in got}


def contaminated(docs: DataFrame, found: Iterable[Items], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, first_char, end_char): the best passage for each pair of a document and
    a test item found in it; code points, end exclusive.  A block's hits are written before the next block
    is made, so one block is held at a time."""
    schema = "doc_id bigint, item_id bigint, score double, first_char bigint, end_char bigint"

    def of(block):
        def make():
            def run(rows):
                for doc_id, text in rows:
                    got = block.matches(text, threshold)
                    if got:
                        spans = [m.span() for m in _WORD.finditer(text)]
                        for item_id, score, a, b in got:
                            yield (doc_id, item_id, score, spans[a][0], spans[b - 1][1])
            return run
        return map_rows(text_rows(docs), schema, make)

    out = docs.sparkSession.createDataFrame([], schema)
    for block in found:
        out = out.union(saved(of(block), "decontamination-hits"))
    return out


def keep_clean(docs: DataFrame, found: Iterable[Items], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no test item is found."""
    def of(block):
        def run(batches):
            for batch in batches:
                mask = [not block.matches(t, threshold) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(mask, pa.bool_()))
        return run
    last = None
    for block in found:
        if last is not None:            # more than one block: what is left is written, and the block dropped
            docs = saved(docs.mapInArrow(of(last), docs.schema), "decontamination-kept")
        last = block
    return docs if last is None else docs.mapInArrow(of(last), docs.schema)
