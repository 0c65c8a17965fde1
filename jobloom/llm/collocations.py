"""Phrase collocations mined from FM-indexes of word ids.

Texts are cut into pieces and words; the words of a task's texts become shards of one language of
about ``SHARD_WORDS`` word ids, written once; a task holds at most ``OPEN_SHARDS`` times that open.  A shard's index is the Burrows-Wheeler transform
of its ids and that of the reversed ids, both in the order of the next four symbols, as no
phrase is longer.  An interval of rows stands for all occurrences of a phrase; one step extends
all intervals by every word to the left (in the one transform) or to the right (in the other) and
keeps both intervals in step, so their sizes are the counts.

Counts are summed over the shards in three rounds: words; pairs of words, by a hash alone,
as most pairs are rare and need not be spelled out; phrases of two to four words.  A phrase can be
frequent only if its parts are, so a round passes over what the round before found rare: a shard
drops rare words from its text before it is indexed and extends no interval of rare pairs.  The frequent parts reach the shards as a Bloom filter of at most ``BLOOM_BITS`` bits.  It
never misses a frequent part; wrongly passed parts cost time, and their phrases are dropped when
the sums are known.  So counts are exact at any size.

Defined cases: a null text is empty; a null lang is ``und``; texts of signs alone have no words;
repeated rows count each time; pieces of any length are read whole; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.topk import top_k_per
from .common import saved

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE = 2_000_000
INSIDE, WHOLE = 80, 100              # a phrase goes if a longer one has 80 of 100 of its occurrences
SHARD_WORDS = 1 << 20
OPEN_SHARDS = 3              # a task's open shards hold this many times SHARD_WORDS at most
SHARDS_A_FILE = 4            # so that a task is handed some MB at once
PAIRS_AT_ONCE = 3 << 20      # pairs of words that a task sums before they are shuffled
SEGMENT = 4 << 20                    # bytes of a text that are split at once, cut where a piece ends
BLOOM_BITS = 1 << 26
PROBES = 3
PAIR_BITS = 40               # of a pair's hash; chance meetings only let a rare pair pass to the next round
UNKNOWN = "und"

# A-Z to lower case, signs between pieces to line feeds, the tab to a blank
LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


class WordIds:
    """Word ids of one language's texts, from 1 in order of appearance; 0 stands between pieces."""

    def __init__(self):
        self._known: defaultdict[bytes, int] = defaultdict()
        self._known.default_factory = self._known.__len__
        self._known[b"\n"], self._known[b""]          # 0 and 1
        self._parts: list[np.ndarray] = []

    def add(self, text: str) -> int:
        data, at, n = text.encode("utf-8", "surrogatepass").translate(LETTERS), 0, 0
        while at < len(data):
            end = len(data)
            if end - at > SEGMENT:
                end = data.rfind(b"\n", at, at + SEGMENT)
                end = end if end > at else data.find(b"\n", at + SEGMENT)
                end = end if end > at else len(data)
            found = data[at:end].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self._known.__getitem__, found), np.int32, len(found))
            ids = ids[ids != 1]
            self._parts += [ids - (ids > 1), np.zeros(1, np.int32)]
            n, at = n + len(ids), end
        return n

    def row(self, lang: str) -> tuple[str, bytes, bytes]:
        return lang, b"\n".join(list(self._known)[2:]), np.concatenate(self._parts).tobytes()


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, words, ids): the words of a shard, joined by line feeds, and its word ids (32 bits each)."""
    def run(batches):
        open_: dict[str, WordIds] = {}
        held: dict[str, int] = {}

        def closed(lang):
            del held[lang]
            yield from _batches([open_.pop(lang).row(lang)])

        # a shard is full by its own words, so that few short ones repeat the same phrases
        for batch in batches:
            for at in range(batch.num_rows):
                lang, text = (c[at].as_py() for c in batch.columns)
                held[lang] = held.get(lang, 0) + open_.setdefault(lang, WordIds()).add(text)
                if held[lang] >= shard_words:
                    yield from closed(lang)
                elif sum(held.values()) >= OPEN_SHARDS * shard_words:
                    yield from closed(max(held, key=held.get))
        for lang in list(open_):
            yield from closed(lang)

    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").where("text <> ''")
    return texts.mapInArrow(run, "lang string, words binary, ids binary")


def _batches(rows) -> Iterator[pa.RecordBatch]:
    for lang, words, ids in rows:
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([words], pa.binary()), pa.array([ids], pa.binary())],
                                             names=["lang", "words", "ids"])


class Transform:
    """The Burrows-Wheeler transform of a cyclic sequence, rows in the order of their next LONGEST symbols."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        # one stable pass a symbol, the last one first; symbols of 16 bits are sorted by counting
        symbols = text.astype(np.uint16 if int(text.max()) < 1 << 16 else np.int64)
        rows = np.arange(n)
        for d in reversed(range(LONGEST)):
            rows = rows[np.argsort(np.roll(symbols, -d)[rows], kind="stable")]
        self.last = text[rows - 1].astype(np.int32)
        # (symbol, row) in order: the place of a symbol's first occurrence at or after a row
        order = np.argsort(symbols[rows - 1], kind="stable")
        self._n, self._places = n, self.last[order].astype(np.int64) * n + order

    def extend(self, symbol: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The first row of each symbol followed by the phrase whose first row is ``low``."""
        return np.searchsorted(self._places, symbol * self._n + low)


class Phrases:
    """Phrases of one length and their intervals in the transforms of the text and of its reverse."""

    def __init__(self, symbols: np.ndarray, low: np.ndarray, low_back: np.ndarray, count: np.ndarray):
        self.symbols, self.low, self.low_back, self.count = symbols, low, low_back, count

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.symbols[keep], self.low[keep], self.low_back[keep], self.count[keep])


class Index:
    """A bidirectional FM-index of a sequence of word ids; 0 stands between pieces."""

    def __init__(self, text: np.ndarray):
        text = np.concatenate([[0], text, [0]])
        self.n_symbols = int(text.max()) + 1
        self._text, self._forward, self._backward = text, Transform(text), Transform(text[::-1])

    def words(self) -> Phrases:
        count = np.bincount(self._text, minlength=self.n_symbols)
        low = np.cumsum(count) - count
        symbols = np.flatnonzero(count)
        symbols = symbols[symbols > 0]
        return Phrases(symbols[:, None], low[symbols], low[symbols], count[symbols])

    def left(self, p: Phrases) -> Phrases:
        """All phrases of one more word to the left."""
        of, symbol, low, low_back, count = self._step(self._forward, p.low, p.low_back, p.count)
        return Phrases(np.column_stack([symbol, p.symbols[of]]), low, low_back, count)

    def right(self, p: Phrases) -> Phrases:
        """All phrases of one more word to the right."""
        of, symbol, low_back, low, count = self._step(self._backward, p.low_back, p.low, p.count)
        return Phrases(np.column_stack([p.symbols[of], symbol]), low, low_back, count)

    def _step(self, way: Transform, low: np.ndarray, other: np.ndarray, count: np.ndarray):
        of = np.repeat(np.arange(len(low)), count)
        rows = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]
        found, n = np.unique(of * self.n_symbols + way.last[rows], return_counts=True)
        of, symbol = np.divmod(found, self.n_symbols)
        # in the other transform a phrase's rows lie in the order of the new symbol
        before = np.cumsum(n) - n
        first = np.searchsorted(of, of)
        other = other[of] + before - before[first]
        keep = symbol > 0
        of, symbol, n = of[keep], symbol[keep], n[keep]
        return of, symbol, way.extend(symbol, low[of]), other[keep], n


class Bloom:
    """A set of 64-bit hashes of bounded size: it may hold more than was put in, never less.  Words are hashed with
    their language; a pair's hash is made of its words' hashes, so that a shard hashes each of its words once."""

    def __init__(self, hashes: DataFrame, max_bits: int = BLOOM_BITS):
        """``hashes``: a column h, as ``hashes`` and ``pair`` give it."""
        n, bits = hashes.count(), 1 << 10
        while bits < min(16 * n, max_bits):
            bits *= 2
        low, high = F.col("h").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("h", 32)
        at = F.explode(F.array(*[(low + i * high).bitwiseAND(bits - 1) for i in range(PROBES)])).alias("at")
        words = (hashes.select(at).groupBy(F.shiftright("at", 6).alias("word"))
                 .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow())
        self._bits = np.zeros(bits // 64, np.uint64)
        self._bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    @staticmethod
    def hashes(lang: str, words: pa.Array) -> np.ndarray:
        head = lang.encode() + b"\n"
        return np.fromiter((xxhash.xxh64_intdigest(head + w, 42) for w in words.to_pylist()), np.uint64, len(words))

    @staticmethod
    def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The hashes of pairs of words out of the words' own, PAIR_BITS of them."""
        return (first ^ ((second << np.uint64(21)) | (second >> np.uint64(43)))) & np.uint64((1 << PAIR_BITS) - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
        out = np.ones(len(h), bool)
        for i in range(PROBES):
            at = (low + np.uint64(i) * high) & np.uint64(64 * len(self._bits) - 1)
            out &= (self._bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out


class Shard:
    """One row of ``shards``."""

    def __init__(self, lang: str, words: bytes, ids: bytes):
        self.lang, self.words, self.ids = lang, pa.array(words.split(b"\n"), pa.binary()), np.frombuffer(ids, np.int32)

    def spell(self, symbols: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*(self.words.take(pa.array(c - 1)) for c in symbols.T), pa.scalar(b" ", pa.binary()))

    def index(self, frequent: Bloom) -> Index:
        """The index of the frequent words: a rare one ends a piece, as no frequent phrase holds it."""
        hashes = Bloom.hashes(self.lang, self.words)
        keep = np.concatenate([[False], frequent.holds(hashes)])
        text = np.where(keep[self.ids], self.ids, 0)
        known = np.flatnonzero(keep)
        ids = np.zeros(len(keep), np.int64)
        ids[known] = np.arange(1, len(known) + 1)
        text = ids[text[(text > 0) | (np.roll(text, 1) > 0)]]
        self.words, self.hashes = self.words.take(pa.array(known - 1)), hashes[known - 1]
        return Index(text)

    def word_counts(self) -> Iterator[tuple[pa.Array, np.ndarray]]:
        count = np.bincount(self.ids, minlength=len(self.words) + 1)[1:]
        yield self.words, count
        yield pa.array([None], pa.binary()), np.array([count.sum()])

    def pair_hashes(self, frequent: Bloom) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        index = self.index(frequent)
        if index.n_symbols > 1:
            pairs = index.left(index.words())
            yield Bloom.pair(*self.hashes[pairs.symbols.T - 1]).view(np.int64), pairs.count

    def long_counts(self, frequent: Bloom, frequent_pairs: Bloom) -> Iterator[tuple[pa.Array, np.ndarray]]:
        index = self.index(frequent)
        if index.n_symbols < 2:
            return
        pairs = index.left(index.words())
        pairs = pairs.where(frequent_pairs.holds(Bloom.pair(*self.hashes[pairs.symbols.T - 1])))
        yield self.spell(pairs.symbols), pairs.count
        known = np.sort(pairs.symbols[:, 0] * index.n_symbols + pairs.symbols[:, 1])
        triples = index.right(pairs)
        triples = triples.where(np.isin(triples.symbols[:, 1] * index.n_symbols + triples.symbols[:, 2], known))
        yield self.spell(triples.symbols), triples.count
        fours = index.left(triples)
        fours = fours.where(np.isin(fours.symbols[:, 0] * index.n_symbols + fours.symbols[:, 1], known))
        yield self.spell(fours.symbols), fours.count


def _counts(rows: DataFrame, counts: Callable[[Shard], Iterator[tuple[pa.Array, np.ndarray]]]) -> DataFrame:
    """(lang, phrase, f) summed over the shards."""
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard(*(c[at].as_py() for c in batch.columns))
                for phrases, f in counts(shard):
                    for b in range(0, len(phrases), 10_000):
                        part = phrases[b:b + 10_000].cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(part), pa.string()), part, pa.array(f[b:b + 10_000].astype(np.int64))],
                                                         names=["lang", "phrase", "f"])

    # a shard has one row for a phrase: there is nothing to combine before the shuffle, and no phrase is hot
    counted = rows.mapInArrow(run, "lang string, phrase string, f bigint").repartition("lang", "phrase")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _pair_rows(rows: DataFrame, known: Bloom) -> DataFrame:
    """(h, f): the counts of pairs of words by a hash, summed over shards of a task."""
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for at in range(batch.num_rows):
                held += Shard(*(c[at].as_py() for c in batch.columns)).pair_hashes(known)
                if sum(len(h) for h, _ in held) >= PAIRS_AT_ONCE:
                    yield from summed(held)
                    held = []
        yield from summed(held)

    def summed(held):
        """Pairs of several shards leave the task as one, in the order of their hashes."""
        if not any(len(h) for h, _ in held):
            return
        h, f = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h)
        h, f = h[order], f[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, f = h[first], np.add.reduceat(f, first)
        for b in range(0, len(h), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[b:b + 50_000]), pa.array(f[b:b + 50_000])], names=["h", "f"])

    return rows.mapInArrow(run, "h bigint, f bigint")


def _pair_hashes(rows: DataFrame, known: Bloom) -> DataFrame:
    """(h, f): the counts of pairs of words by a hash, summed over the shards.  Pairs that share a hash are
    counted together, so a frequent pair is never below its own count."""
    return _pair_rows(rows, known).repartition("h").groupBy("h").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """(lang, phrase, m, f): all phrases of 1 to LONGEST words with at least ``least`` occurrences, and for
    each language one row of a null phrase with the number of all its words (m = 0)."""
    rows = saved(shards(docs, shard_words), "collocation-shards", maxRecordsPerFile=SHARDS_A_FILE)
    words = saved(_counts(rows, Shard.word_counts).where(f"f >= {least} or phrase is null"), "collocation-words")
    known = Bloom(words.where("phrase is not null").select(F.xxhash64(F.concat_ws("\n", "lang", "phrase")).alias("h")), bloom_bits)
    pairs = saved(_pair_hashes(rows, known).where(f"f >= {least}").select("h"), "collocation-pairs")
    known_pairs = Bloom(pairs, bloom_bits)
    longer = _counts(rows, lambda s: s.long_counts(known, known_pairs)).where(f"f >= {least}")
    m = F.when(F.col("phrase").isNull(), 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1)
    return saved(words.union(longer).withColumn("m", m.cast("int")), "collocation-counts")


def _part(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, l, r, score, kept) of the phrases of two words or more in ``frequent_phrases``."""
    cand = counts.where("m >= 2").select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    known = counts.where("m >= 1").select("lang", F.col("phrase").alias("part"), "f")
    cuts = cand.select("lang", "phrase", "a", "m", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).select(
        "lang", "phrase", "m", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("head"),
        _part(F.col("w"), F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    cuts = (cuts.join(known.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    # 128-bit products, and a division that drops the fraction
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "m", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # (start, words) of the shorter phrases inside one of three words or more
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1),
                                  lambda n: F.transform(F.sequence(F.lit(1), F.col("m") - n + 1), lambda i: F.struct(i.alias("i"), n.alias("n")))))
    inside = (cand.where("m >= 3").select("lang", "a", "w", F.explode(spans).alias("s"))
              .select("lang", "a", _part(F.col("w"), F.col("s.i"), F.col("s.n")).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    big = lambda c, n: F.col(c).cast("decimal(19,0)") * F.lit(n)
    covered = F.coalesce(big("longer", WHOLE) >= big("a", INSIDE), F.lit(False))
    return best.join(inside, ["lang", "phrase"], "left").select("lang", "phrase", "m", "a", "cut.l", "cut.r", "cut.score", (~covered).alias("kept"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard_words: int = SHARD_WORDS, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score and count."""
    counts = frequent_phrases(docs, least, shard_words, bloom_bits)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language may hold most phrases: the first of each share of its phrases, then the first of these
    rows = scored(counts).where("kept").withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = top_k_per(top_k_per(rows, ["lang", "share"], order, top).drop("rank"), ["lang"], order, top)
    n = counts.where("m = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    return rows.join(n, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, top: int = TOP) -> str:
    """The same question in DuckDB SQL over the table documents."""
    return rf"""
with piece as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
word as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') as w from piece),
gram as (select lang, m, unnest(list_transform(generate_series(1, len(w) - m + 1), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase
    from word, (values (1), (2), (3), (4)) t(m)),
total as (select lang, sum(len(w))::bigint as n from word group by lang),
f as (select lang, m, phrase, count(*)::hugeint as f from gram group by all having count(*) >= {least}),
part as (select lang, phrase, m, f, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as head,
    array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') as rest from (select *, unnest(generate_series(1, m - 1)) as k from f)),
cut as (select p.lang, p.phrase, p.m, p.f as a, k, l.f as l, r.f as r, (({SCALE} * p.f) // (l.f + r.f)) as score
    from part p join f l on l.lang = p.lang and l.phrase = p.head join f r on r.lang = p.lang and r.phrase = p.rest),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' ') as phrase, max(f) as longer
    from f, (values (2), (3)) t(s), (values (1), (2), (3)) u(i) where s < m and i + s - 1 <= m group by all),
kept as (select best.* from best left join inside using (lang, phrase) where longer is null or {WHOLE} * longer < {INSIDE} * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
    a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from kept join total using (lang) qualify rank <= {top}"""
