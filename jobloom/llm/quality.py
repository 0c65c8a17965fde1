"""Quality rules judged by an isolation forest.

Every document gets rule statistics over its whole text.  Two base rules reject outright;
for the rest an isolation forest over the statistics gives the mean path length over random
splits: documents that few splits set apart have short paths, hence a high anomaly score.
Scales, forest and threshold come from all labelled rows: the quantiles that scale the features
are found by counting every accepted row, each tree draws its own 256 rows (an isolation tree's
size) out of all labelled ones, mostly accepted ones, so that rejected kinds are rare in it, and
the threshold is calibrated on the scores of every labelled row.

Defined cases: a null or empty text has no word and fails the base rules; ties and repeated
rows get the same verdict; an empty table gives an empty result; without labelled rows of
both kinds the method rejects nothing beyond the base rules; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, emptied, map_rows, saved, text_rows

TREES, LEAF_SAMPLE = 100, 256
REJECTED_SHARE = 0.05       # share of rejected rows in the trees
BINS, ROUNDS = 1024, 3      # a quantile is narrowed down to one of so many bins, so many times
SCORE_BINS = 1 << 14        # scores that the threshold may lie between
FALSE_REJECT_COST = 20.0    # a wrongly rejected document weighs as much as so many missed ones
SPREAD, FAR = 0.99, 10.0    # a feature's spread reaches to this quantile; beyond FAR spreads all is alike
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 20, 30, 8
# fixed value: the characters counted as symbols
SYMBOLS = "#*$%&|<>"
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _mix(ids: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit value for each small integer (splitmix64 finaliser)."""
    z = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def repeated_window_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found at least twice in the text."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    mixed, h = _mix(ids), np.zeros(n, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x100000001B3) + mixed[j:j + n]
    _, back, counts = np.unique(h, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[back] > 1)
    if not len(starts):
        return 0
    cover = np.zeros(len(ids) + 1, np.int64)
    cover[starts] += 1
    np.subtract.at(cover, starts + width, 1)
    return int((np.cumsum(cover) > 0).sum())


def rule_stats(text: str | None) -> tuple[tuple[int, int, int, int, int], tuple[float, ...]]:
    """The five counts of a whole text, and the features that the forest splits on."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0), (0.0, 5.0, 0.0, 0.0)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    rep = repeated_window_words(ids)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = int(((points >= 65) & (points <= 90) | (points >= 0xC0) & (points <= 0xDE)).sum())
    top = int(np.bincount(ids).max())
    # the constants pull the ratios of short texts towards those of ordinary prose
    return (n, chars, symbols, dup, rep), (
        symbols / (n + 10), (chars + 100) / (n + 20), upper / (chars + 100), max(0, top - 5) / (n + 50))


@dataclass
class Forest:
    """Random-split trees as flat arrays, with the score threshold calibrated from labels."""

    feature: np.ndarray      # tree x node; -1 in a leaf
    cut: np.ndarray
    child: np.ndarray        # left child; the right one follows
    path: np.ndarray         # in a leaf: depth plus the expected rest
    norm: float
    middle: np.ndarray       # of each feature among accepted rows, and its spread to either side
    spread: np.ndarray
    threshold: float = 2.0   # scores are at most 1, so nothing is rejected unless calibrated

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score 2 ** (-mean path / expected path), between 0 and 1."""
        x = scaled(x, self.middle, self.spread)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t][at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] >= self.cut[t][at]
                at = np.where(inner, self.child[t][at] + go, at)
            total += self.path[t][at]
        return 2.0 ** (-total / max(1, len(self.feature)) / self.norm)


def scaled(x: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Features in spreads from the middle of accepted rows, at most FAR to either side: ordinary
    variation stays within one spread, so that a uniformly random cut mostly falls beyond it."""
    d = x - middle
    return np.clip(np.where(d > 0, d / spread[1], d / spread[0]), -FAR, FAR)


def _rest(n: int) -> float:
    """Expected path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_forest(accepted: np.ndarray, rejected: np.ndarray, seed: int = 7) -> Forest:
    """Isolation forest over the rows given, scaled by the accepted ones; each tree splits a sub-sample."""
    x = np.concatenate([accepted, rejected])
    rng = np.random.default_rng(seed)
    size = min(LEAF_SAMPLE, len(x))
    middle = np.median(accepted, 0)
    low, high = np.quantile(accepted, [1 - SPREAD, SPREAD], axis=0)
    return grow_trees([x[rng.choice(len(x), size, replace=False)] for _ in range(TREES)], middle, low, high, rng)


def grow_trees(samples: list[np.ndarray], middle: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> Forest:
    """A tree for each sample, split at uniformly random features and cuts of the scaled rows."""
    spread = np.maximum([middle - low, high - middle], 0.02)
    size = max(map(len, samples))
    limit = int(np.ceil(np.log2(max(2, size))))
    nodes = 2 ** (limit + 1) + 1
    feature = np.full((len(samples), nodes), -1)
    cut, path = np.zeros((len(samples), nodes)), np.zeros((len(samples), nodes))
    child = np.zeros((len(samples), nodes), np.int64)
    for t, sample in enumerate(samples):
        todo, free = [(0, scaled(sample, middle, spread), 0)], 1
        while todo:
            at, rows, depth = todo.pop()
            lo, hi = rows.min(0), rows.max(0)
            open_ = np.flatnonzero(hi > lo)
            if depth >= limit or len(rows) < 2 or not len(open_):
                path[t, at] = depth + _rest(len(rows))
                continue
            f = rng.choice(open_)
            c = lo[f] + (hi[f] - lo[f]) * (1 - rng.random())
            c = c if c > lo[f] else hi[f]                         # in (lo, hi]: both sides have rows
            right = rows[:, f] >= c
            feature[t, at], cut[t, at], child[t, at] = f, c, free
            todo += [(free, rows[~right], depth + 1), (free + 1, rows[right], depth + 1)]
            free += 2
    return Forest(feature, cut, child, path, max(_rest(size), 1e-9), middle, spread)


def calibrate(scores: np.ndarray, rejected: np.ndarray, accepted: np.ndarray | None = None, cost: float = FALSE_REJECT_COST) -> float:
    """The threshold with the least rate of missed rows plus ``cost`` times that of wrongly
    rejected rows: the middle of the gap between two neighbouring scores.  ``rejected`` and ``accepted``
    count the rows of each score; without ``accepted``, a score is one row, rejected or not."""
    if accepted is None:
        accepted = ~rejected
    order = np.argsort(-scores, kind="stable")
    s, bad, good = scores[order], rejected[order].astype(np.int64), accepted[order].astype(np.int64)
    missed = 1 - np.concatenate([[0], np.cumsum(bad)]) / max(1, bad.sum())
    wrong = np.concatenate([[0], np.cumsum(good)]) / max(1, good.sum())
    loss = missed + cost * wrong
    loss[1:-1][s[1:] == s[:-1]] = np.inf       # equal scores stay on one side
    k = int(np.argmin(loss))
    if k == 0:
        return 2.0
    return float((s[k - 1] + s[k]) / 2) if k < len(s) else float(s[-1])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(f, bad, same) of every labelled row that passes the base rules, ``same`` being a hash of the row; texts are not
    shuffled, only their features."""
    def make():
        def run(rows):
            for doc_id, text in rows:
                counts, feats = rule_stats(text)
                if not base_failed(counts[0], counts[4]):
                    yield (doc_id, list(feats))
        return run

    marks = labels.where("quality is not null and doc_id is not null").select("doc_id", (F.col("quality") == 0).alias("bad"))
    return map_rows(text_rows(docs).where("doc_id is not null"), "doc_id bigint, f array<double>", make).join(marks, "doc_id").select(
        "f", "bad", F.xxhash64("doc_id", "f").alias("same"))


def quantiles(rows: DataFrame, shares: list[float]) -> np.ndarray:
    """share x feature: of every feature the value below or at which so large a share of all rows lies, found by
    counting the rows in bins and again inside the bin that holds the quantile (BINS ** ROUNDS bins in all)."""
    n_features = len(rows.first().f)
    n = rows.count()
    ends = rows.agg(*[g(F.col("f")[i]) for g in (F.min, F.max) for i in range(n_features)]).first()
    lo = np.tile(np.array(ends[:n_features], float), (len(shares), 1))
    hi = np.tile(np.array(ends[n_features:], float), (len(shares), 1))
    rank = np.array([max(1, int(np.ceil(q * n))) for q in shares])[:, None] * np.ones((1, n_features), np.int64)
    schema = "q int, feature int, bin int, n bigint"
    for _ in range(ROUNDS):
        width = np.where(hi > lo, (hi - lo) / BINS, 1.0)

        def run(batches, lo=lo, hi=hi, width=width):
            total = np.zeros((len(shares), n_features, BINS + 1), np.int64)       # the first bin: below lo
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(-1, n_features)
                for q in range(len(shares)):
                    at = np.clip(np.floor((x - lo[q]) / width[q]), 0, BINS - 1).astype(np.int64) + 1
                    at[x < lo[q]] = 0
                    for f in range(n_features):
                        inside = x[:, f] <= hi[q, f]
                        total[q, f] += np.bincount(at[inside, f], minlength=BINS + 1)
            where = np.nonzero(total)
            if len(where[0]):
                yield pa.RecordBatch.from_arrays([*(pa.array(w.astype(np.int32)) for w in where), pa.array(total[where])], names=["q", "feature", "bin", "n"])

        counted = np.zeros((len(shares), n_features, BINS + 1), np.int64)
        for r in rows.select("f").mapInArrow(run, schema).groupBy("q", "feature", "bin").agg(F.sum("n").alias("n")).collect():
            counted[r.q, r.feature, r.bin] = r.n
        at = (np.cumsum(counted, axis=2) < rank[:, :, None]).sum(axis=2)          # the bin that holds the rank
        at = np.clip(at - 1, 0, BINS - 1)
        lo, hi = lo + at * width * (hi > lo), np.where(hi > lo, np.minimum(hi, lo + (at + 1) * width), hi)
    return (lo + hi) / 2


def tree_rows(rows: DataFrame, rejected_weight: float, n: int, size: int) -> list[np.ndarray]:
    """For each tree ``size`` of all rows, drawn by a hash of the row and the tree; a rejected row is drawn
    with a weight.  Rows beyond a bound that ``size`` rows stay below all but surely are left out at once."""
    bound = min(1.0, (size + 12 * np.sqrt(size)) / max(n, 1))

    def run(batches):
        for batch in batches:
            f = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            bad = batch.column(1).to_numpy(zero_copy_only=False)
            same = batch.column(2).to_numpy().view(np.uint64)
            for t in range(TREES):
                u = (_mix(same ^ _mix(np.full(1, t, np.int64)))) / np.float64(2 ** 64)
                u[bad] /= max(rejected_weight, 1e-9)
                at = np.flatnonzero(u <= bound)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(u[at]), batch.column(0).take(pa.array(at))],
                                                     names=["tree", "u", "f"])

    got = rows.select("f", "bad", "same").mapInArrow(run, "tree int, u double, f array<double>").collect()
    out = []
    for t in range(TREES):
        own = sorted((r.u, tuple(r.f)) for r in got if r.tree == t)[:size]
        out.append(np.array([f for _, f in own]))
    return [x for x in out if len(x)]


def fit(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """Grow and calibrate the forest on all labelled rows.  What reaches the driver is bounded: counts by bin,
    and the rows that the trees drew."""
    rows = saved(labelled(docs, labels), "quality-labelled")
    sizes = {r.bad: r["count"] for r in rows.groupBy("bad").count().collect()}
    n_good, n_bad = sizes.get(False, 0), sizes.get(True, 0)
    if n_good + n_bad < 8 or not n_good or not n_bad:
        return None
    low, middle, high = quantiles(rows.where("not bad"), [1 - SPREAD, 0.5, SPREAD])
    weight = min(1.0, max(1.0, n_good * REJECTED_SHARE) / n_bad)
    n = n_good + weight * n_bad
    samples = tree_rows(rows, weight, int(n), min(LEAF_SAMPLE, max(8, int(n))))
    forest = grow_trees(samples, middle, low, high, np.random.default_rng(7))
    forest.threshold = threshold(rows, forest)
    emptied(rows)
    return forest


def threshold(rows: DataFrame, forest: Forest) -> float:
    """``calibrate`` over every row of (f, bad), by their counts in SCORE_BINS bins of the score."""
    def run(batches):
        total = np.zeros((2, SCORE_BINS), np.int64)
        for batch in batches:
            f = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            bad = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(total, (bad, np.minimum((forest.score(f) * SCORE_BINS).astype(np.int64), SCORE_BINS - 1)), 1)
        at = np.flatnonzero(total.any(axis=0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], names=["bin", "good", "bad"])

    got = rows.select("f", "bad").mapInArrow(run, "bin int, good bigint, bad bigint").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    got.sort(key=lambda r: -r.bin)
    s = (np.array([r.bin for r in got]) + 0.5) / SCORE_BINS
    return calibrate(s, np.array([r.bad for r in got]), np.array([r.good for r in got]))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PCT * n_words


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed, kept and the anomaly score.
    Needs no shuffle: the forest (TREES x at most 2 * LEAF_SAMPLE nodes) travels with the tasks."""
    def make():
        def run(rows):
            stats = [rule_stats(text) for _, text in rows]
            score = forest.score(np.array([f for _, f in stats])) if forest and rows else np.zeros(len(rows))
            limit = forest.threshold if forest else 2.0
            for (doc_id, _), (c, _), s in zip(rows, stats, score):
                failed = base_failed(c[0], c[4])
                yield (doc_id, *c, failed, not failed and bool(s < limit), float(s))
        return run
    return map_rows(text_rows(docs), f"doc_id bigint, {STATS}, base_failed boolean, kept boolean, anomaly double", make)


def keep(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in one pass without a shuffle."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            stats = [rule_stats(t) for t in texts]
            score = forest.score(np.array([f for _, f in stats])) if forest and texts else np.zeros(len(texts))
            limit = forest.threshold if forest else 2.0
            mask = [not base_failed(c[0], c[4]) and bool(s < limit) for (c, _), s in zip(stats, score)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
