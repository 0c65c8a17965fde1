"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text, each followed by
the same base of ordinary text, so that ordinary windows compress alike with both.  A window is
a word between boundary marks.  The bytes that the toxic dictionary saves on a window are its
evidence; how often a text's windows reach each of several savings, per window and in all, goes
through a logistic calibration to a score between 0 and 1.

Training text is selected, not taken whole: toxic documents consist mostly of ordinary prose.
A word enters the toxic dictionary's training set if it stands in many different contexts
(neighbouring words) in toxic documents and in few in ordinary ones; contexts, not counts,
since copies of a document repeat its words but not their contexts.

Defined cases: a null or empty text has no window and scores like ordinary text; words compare
in lower case without signs at their ends; ties and repeated rows score alike; a null doc_id is
not held out; without training rows of both kinds every score is 0; an empty table gives an
empty result; other columns are not read, labels only by the sampled training rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, sample_ids, text_rows

SAMPLE_ROWS = 20_000        # labelled rows to learn from at most
TOXIC_WORDS = 20_000        # words whose contexts in ordinary text are counted at most
ORDINARY_WORDS = 30_000     # frequent ordinary words in the dictionaries' training set at most
LEAST_CONTEXTS, CONTEXT_SHARE, LEAST_ODDS = 4, 0.005, 10.0
TOXIC_BYTES, BASE_BYTES, LEVEL = 16_384, 32_768, 19
BEFORE, AFTER = b"\x01\x02\x03\x04", b"\x04\x03\x02\x01"       # the marks around a window
SAVINGS = (1, 2, 3, 4, 5, 6, 8)                                # bytes saved that are counted
CACHED_WORDS = 400_000
_WORD = re.compile(r"\w(?:[^\x20\x09-\x0D]*\w)?")


def words(text: str | None) -> list[str]:
    """Words in lower case, without signs at their ends."""
    return _WORD.findall((text or "").lower())


def _context(a: str, b: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(f"{a} {b}") - (1 << 63)


class Scorer:
    """The two dictionaries and the calibration; small, sent with the tasks."""

    def __init__(self, toxic: bytes, ordinary: bytes, base: bytes):
        self.dictionaries = (toxic + base, ordinary + base)
        self.weights = self.scale = None
        self._start()

    def _start(self):
        self._saved: dict[str, int] = {}
        made = []
        for content in self.dictionaries:
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zs.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False,
                                          write_content_size=False, write_dict_id=False))
        self._toxic, self._ordinary = made

    def __getstate__(self):
        return self.dictionaries, self.weights, self.scale

    def __setstate__(self, state):
        self.dictionaries, self.weights, self.scale = state
        self._start()

    def saved(self, word: str) -> int:
        """Bytes that the toxic dictionary saves on the word's window against the ordinary one."""
        v = self._saved.get(word)
        if v is None:
            window = BEFORE + word.encode("utf-8", "surrogatepass") + AFTER
            v = len(self._ordinary.compress(window)) - len(self._toxic.compress(window))
            if len(self._saved) >= CACHED_WORDS:
                self._saved.clear()
            self._saved[word] = v
        return v

    def features(self, text: str | None) -> list[float]:
        counts, n = Counter(words(text)), 0
        reached = [0] * len(SAVINGS)
        for w, k in counts.items():
            n += k
            v = self.saved(w)
            for i, s in enumerate(SAVINGS):
                if v < s:
                    break
                reached[i] += k
        return [*(np.log1p(min(c, 50)) for c in reached), *(np.log1p(100 * c / (n + 30)) for c in reached), 1.0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip((x / self.scale) @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and feature scales of a logistic fit (Newton steps, ridge penalty)."""
    scale = np.maximum(x.std(0), 1e-3)
    scale[-1] = 1.0
    z, w = x / scale, np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w = w + step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w, scale


def train_dictionary(counted: list[tuple[str, int]], size: int) -> bytes:
    """A zstandard dictionary for windows of these words, each as often as its count (50 at most);
    of too little text, the windows themselves, the most frequent last."""
    windows = [BEFORE + w.encode() + AFTER for w, n in counted for _ in range(min(n, 50))]
    rng = np.random.default_rng(11)
    windows = [windows[i] for i in rng.permutation(len(windows))]
    samples = [b"".join(windows[i:i + 20]) for i in range(0, len(windows), 20)]
    if sum(map(len, samples)) >= 8 * size:
        try:
            return zs.train_dictionary(size, samples, k=24, d=8, level=3).as_bytes()
        except zs.ZstdError:
            pass
    return b"".join(BEFORE + w.encode() + AFTER for w, _ in sorted(counted, key=lambda c: (c[1], c[0])))[-size:]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer | None:
    """Learn from at most ``sample_rows`` labelled rows (documented bound) outside the held-out fold:
    those whose crc32 of the id's text is not divisible by 5."""
    ids = sample_ids(labels.where("toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
                     .select("doc_id", F.col("toxic").cast("int").alias("toxic")), sample_rows).persist()
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")

    def contexts(known: set[str] | None):
        def make():
            def run(rows):
                for (text,) in rows:
                    w = ["", *words(text), ""]
                    yield from {(b, _context(a, c)) for a, b, c in zip(w, w[1:], w[2:]) if known is None or b in known}
            return run
        return make

    def spread(part, known=None):
        return (map_rows(part.select("text"), "word string, context bigint", contexts(known)).distinct()
                .groupBy("word").agg(F.count("*").alias("n")))

    toxic, ordinary = rows.where("toxic = 1"), rows.where("toxic = 0")
    kinds = {r.toxic: r.n for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not kinds.get(1) or not kinds.get(0):
        ids.unpersist()
        return None
    least = max(LEAST_CONTEXTS, CONTEXT_SHARE * kinds[1])
    seen = {r.word: r.n for r in spread(toxic).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(TOXIC_WORDS).collect()}
    elsewhere = {r.word: r.n for r in spread(ordinary, set(seen)).collect()}      # of these words only
    ratio = kinds[0] / kinds[1]
    chosen = [(w, n) for w, n in seen.items() if n * ratio >= LEAST_ODDS * (elsewhere.get(w, 0) + 0.5)]

    def counted():
        def run(rows):
            for (text,) in rows:
                yield from Counter(words(text)).items()
        return run
    common = [(r.word, r.n) for r in
              map_rows(ordinary.select("text"), "word string, k bigint", lambda: counted()).groupBy("word").agg(F.sum("k").alias("n"))
              .orderBy(F.desc("n"), "word").limit(ORDINARY_WORDS).collect()]
    base = [c for i, c in enumerate(common) if i % 4]
    scorer = Scorer(train_dictionary(chosen, TOXIC_BYTES), train_dictionary(common[::4], TOXIC_BYTES), train_dictionary(base, BASE_BYTES))

    def measured():
        return lambda rows: ((scorer.features(t), y) for t, y in rows)
    # an id may stand for many rows: which of them fit is decided by a hash of their features
    got = map_rows(rows, "f array<double>, y int", measured).orderBy(F.xxhash64("f"), "f", "y").limit(4 * sample_rows).collect()
    ids.unpersist()
    x, y = np.array([r.f for r in got]), np.array([r.y for r in got], float)
    order = np.lexsort((*x.T, y))
    scorer.weights, scorer.scale = logistic(x[order], y[order])
    return scorer


def score(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of a half)."""
    def make():
        def run(rows):
            if not rows:
                return
            p = scorer.probability(np.array([scorer.features(t) for _, t in rows])) if scorer else np.zeros(len(rows))
            for (doc_id, _), v in zip(rows, p):
                yield (doc_id, float(v), int(v >= 0.5))
        return run
    return (map_rows(text_rows(docs), "doc_id bigint, score double, predicted int", make)
            .select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False)).alias("held_out"),
                    "score", "predicted"))
