"""Best-fit packing of token pieces by hierarchical residual packing.

Documents are tokenised and cut into pieces of at most one sequence.  Each partition packs its
pieces best-fit, longest first; its nearly full bins are final.  The underfull bins of all
partitions become items of the next level, which has fewer partitions, and so on up the tree:
a bin is placed into a larger one as a whole, so a piece's place is the sum of the offsets on
its way up.  Every level is written to the shared folder; only counts reach the driver, and no
task holds more than ``ITEMS_PER_TASK`` items.

Defined cases: a null text is empty (one piece of the end id alone); equal lengths keep their
order within a partition; repeated rows are packed like any other rows; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, saved, text_rows

CAPACITY, END_ID = 4096, 1
ITEMS_PER_TASK = 100_000     # a task's items, and with them its memory
FAN_IN = 8                   # partitions of one level whose underfull bins meet at the next
NEARLY_FULL = 0.995          # such a share of a sequence's tokens makes a bin final
CACHED_WORDS = 250_000       # encoded words in each of the two generations that a Python worker remembers
# The tokenizer's own splitting rule (lower case, contractions, letters, single digits, other signs),
# for texts of these characters only; they are stable under its normalisation.
LETTERS, SIGNS = "a-zß-öø-ÿ", "!-/:-@\\[-`{-~«»–—‘’“”…"
PLAIN = re.compile(f"[A-ZÀ-ÖØ-Þ{LETTERS}0-9{SIGNS}\\x20\\x09-\\x0D]*")
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[{SIGNS}]+")
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit integers.

    The tokenizer joins nothing across the words of its splitting rule, so the ids of a text are
    those of its words one after another; a word seen before is looked up.  Texts with other
    characters, or with the look of a special token, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode new words in one call; each ends with a token that ends a word."""
        new = []
        for w in words:
            if w in self._older:
                self._known[w] = self._older[w]
            else:
                new.append(w)
        if not new:
            return
        flat = self.whole(" ".join(new))
        ends = np.flatnonzero(self._ends[np.frombuffer(flat, "<u4")]) + 1
        if len(ends) == len(new) and ends[-1] * 4 == len(flat):
            at = 0
            for w, end in zip(new, (4 * ends).tolist()):
                self._known[w] = flat[at:end]
                at = end
        else:
            for w in new:
                self._known[w] = self.whole(w)

    def ids(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or "<|" in text:
            return self.whole(text)
        out: list[bytes] = []
        words = SPLIT.findall(text.lower())
        for at in range(0, len(words), 50_000):
            part = words[at:at + 50_000]
            distinct = set(part)
            unknown = distinct.difference(self._known)
            if len(self._known) + len(unknown) > CACHED_WORDS:      # the younger generation becomes the older one
                self._older, self._known, unknown = self._known, {}, distinct
            if unknown:
                self._learn(sorted(unknown))
            out += map(self._known.__getitem__, part)
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}      # lives as long as the Python worker


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the
    ids themselves (little-endian unsigned 32-bit integers, the end id included)."""
    path = path or tokenizer_path()

    def make():
        enc, end, step = encoder(path), END_ID.to_bytes(4, "little"), 4 * capacity

        def run(rows):
            for doc_id, text in rows:
                ids = enc.ids(text or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    yield (*row, part) if with_ids else row
        return run
    return map_rows(text_rows(docs), PIECE + (", ids binary" if with_ids else ""), make, chunk_bytes=4 << 20)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: the bin and offset of each item, and the fill of each bin.

    Bit r of ``mask`` tells that some open bin has room r, so that the tightest one is found
    by a shift and the lowest set bit.
    """
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, fill, mask = [0] * len(lengths), [0] * len(lengths), [], 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        above = mask >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            b = len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        r = capacity - fill[b]
        if r:
            room[r].append(b)
            mask |= 1 << r
    return bins, offsets, fill


def _pack_partitions(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """Pack each partition of ``items`` (a column length, others kept): adds bin, offset and fill."""
    fields = "bin bigint, offset bigint, fill bigint"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields) + ", " + fields

    def run(batches):
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        whole = pa.Table.from_batches(table)
        bins, offsets, fill = best_fit(whole.column("length").to_pylist(), capacity)
        first = (level << 56) + (TaskContext.get().partitionId() << 32)
        for name, col in (("bin", [first + b for b in bins]), ("offset", offsets), ("fill", [fill[b] for b in bins])):
            whole = whole.append_column(name, pa.array(col, pa.int64()))
        yield from whole.to_batches(max_chunksize=10_000)

    return items.mapInArrow(run, schema)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Assign every row of ``rows`` (columns length <= capacity, others kept) to a sequence: adds
    sequence_id and offset; the rows of a sequence lie gapless from 0."""
    rows = saved(rows, "pack-pieces")
    full = math.floor(NEARLY_FULL * capacity)
    parts = max(1, math.ceil(rows.count() / ITEMS_PER_TASK))
    placed = saved(_pack_partitions(rows.repartition(parts), 0, capacity), "pack-level")
    level, moved = 0, None
    open_ = placed.where(f"offset = 0 and fill < {full}").select(F.col("bin").alias("item"), F.col("fill").alias("length"))
    n_open = open_.count()
    while n_open > 1 and level < 60:
        level += 1
        parts = max(math.ceil(parts / FAN_IN), math.ceil(n_open / ITEMS_PER_TASK))
        merged = saved(_pack_partitions(open_.repartition(parts), level, capacity), "pack-level")
        step = merged.select("item", F.col("bin").alias("up"), F.col("offset").alias("shift"))
        if moved is None:
            moved = step.select(F.col("item").alias("bin"), "up", "shift")
        else:           # bins placed before move along with the bin that holds them
            moved = saved(moved.join(step.select(F.col("item").alias("up"), F.col("up").alias("new"), F.col("shift").alias("more")).hint("merge"),
                                     "up", "left")
                          .select("bin", F.coalesce("new", "up").alias("up"),
                                  (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "pack-moved")
        open_ = merged.where(f"offset = 0 and fill < {full}").select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        before, n_open = n_open, open_.count()
        if parts == 1 or n_open > 0.99 * before:      # nothing is left to merge, or no more fits together
            break
    keep = [c for c in rows.columns]
    done = placed.where(f"fill >= {full}") if moved is not None else placed
    out = done.select(*keep, F.col("bin").alias("sequence_id"), "offset")
    if moved is not None:
        out = out.union(placed.where(f"fill < {full}").join(moved.hint("merge"), "bin").select(
            *keep, F.col("up").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset")))
    return out


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document with its sequence and place."""
    return pack(pieces(docs, path, capacity), capacity)
