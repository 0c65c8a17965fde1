"""Personal data: candidate spans selected by gradient-boosted trees.

The base patterns (e-mail, IP address, payment card, phone) always count.  Beside them
high-recall generators propose overlapping spans: every run of neighbouring digit groups that
could be a card, a phone number or an address, and written-out e-mail addresses.  Boosted trees
score format and context features of each candidate; a threshold for each kind, calibrated on
rows the trees have not seen, selects spans, best score first, that overlap nothing selected.

The trees learn from all documents: base spans there, also rewritten into
other notations and run together with a neighbour, are positive; candidates that cut across
them or stand for nothing are negative; look-alikes that pass a validator are left out.  Equal
learning rows are one with a weight; the sums that a level of a tree is split by, and the counts
that the bins and thresholds come from, are taken over all of them by Spark.

Defined cases: a null or empty text has no span; ties between candidates go to the earlier,
then the longer one; repeated rows get the same spans; without documents that hold both
outcomes only base spans are returned; an empty table gives an empty result; other columns
are kept by ``redact`` and not read elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emptied, map_rows, saved, text_rows

# fixed values: the kinds in their order, and the base patterns of the contract
KINDS = ("email", "ip", "card", "phone")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]+")
# words before a span that speak for, and against, personal data
CUES = ("call", "tel", "phone", "mobile", "fax", "contact", "mail", "card", "visa", "pay", "ip", "address", "from", "host")
DECOYS = ("order", "invoice", "version", "release", "isbn", "ref", "ticket", "page", "id", "no.", "token", "password")

ROWS_A_TASK, MOST_TASKS = 50_000, 256      # of the learning rows; a task sends one array of sums a level
LARGEST = 1000            # a feature's cuts lie up to here
SCORE_BINS = 1 << 14      # scores that a threshold may lie between
ROUNDS, DEPTH, BINS, RATE, LEAST_ROWS = 40, 3, 32, 0.3, 8
PRECISION = 0.98          # a threshold must reach this on unseen rows
RUN = re.compile(r"[+(]?[0-9][0-9().\x20/-]*")
GROUP = re.compile(r"[0-9]+")
WRITTEN_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}(?:"
    r"\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}"
    r"|\x20at\x20[A-Za-z0-9-]{1,63}(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]{1,63}){0,3}\x20dot\x20[A-Za-z]{2,24})(?![A-Za-z0-9-])")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, leftmost and non-overlapping for each kind, in order of kind and start."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:                  # from the sign outwards: linear also in long runs of name characters
        host = EMAIL_HOST.match(text, at + 1)
        if host:
            start = at
            while start > end and EMAIL_NAME.match(text, start - 1, start):
                start -= 1
            if start < at:
                out.append(("email", start, host.end()))
                end = host.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p) <= 40 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
        at = text.find("+", m.end() if m else at + 1)
    return out


def candidates(text: str) -> list[Span]:
    """High-recall proposals, which may overlap each other."""
    out: list[Span] = []
    if any(x in text for x in ("at]", "at)", "at}", " dot ")):
        out += [("email", *m.span()) for m in WRITTEN_EMAIL.finditer(text)]
    for run in RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [m.span() for m in GROUP.finditer(text, *run.span())]
        for i, (start, _) in enumerate(groups):
            n = 0
            head = start
            while head > run.start() and text[head - 1] in "+(":
                head -= 1
            if i and head < groups[i - 1][1]:
                head = start
            for j in range(i, len(groups)):            # 19 digits are the end
                end = groups[j][1]
                n += end - groups[j][0]
                if n > 19:
                    break
                if 13 <= n:
                    out.append(("card", start, end))
                if 9 <= n <= 15:
                    out.append(("phone", head, end))
                if j == i + 3 and n <= 12:
                    out.append(("ip", start, end))
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, a, b = span
    s = text[a:b]
    d = _digits(s)
    groups = GROUP.findall(s)
    gaps = re.findall(r"[^0-9]+", s)
    before, after = text[max(0, a - 24):a].lower(), text[b:b + 8]
    octets = [int(g) <= 255 if len(g) < 4 else False for g in groups]
    sizes = [len(g) for g in groups] or [0]
    touch_left = bool(before) and (before[-1].isalnum() or before[-1] in "@_.-+(")
    touch_right = bool(after) and (after[0].isalnum() or after[0] in "@_" or after[0] in ".-" and after[1:2].isdigit())
    near_left = bool(re.search(r"[0-9][ .()/-]{1,2}$", before))
    near_right = bool(re.match(r"[ .()/-]{1,2}[0-9]", after))
    return [
        float(KINDS.index(kind)), len(d), len(s), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        len(set(gaps)), max(map(len, gaps), default=0), s.count(" "), s.count("-"), s.count("."), s.count("("),
        s.startswith("+"), s.startswith("("), float(len(d) >= 13 and luhn(d)), float(len(groups) == 4 and all(octets)),
        float(d[:1] or 0), s.count(")") - s.count("("), touch_left, touch_right, near_left, near_right,
        sum(c in before for c in CUES), sum(c in before for c in DECOYS),
        sum(c.isalpha() for c in s) / len(s), float("@" in s), s.lower().count("at"), s.lower().count("dot"),
        float(bool(re.search(r"\.[A-Za-z]{2,6}$", s))), len(set(sizes))]


# ---------------------------------------------------------------- boosted trees

@dataclass
class Boosted:
    """Depth-limited regression trees on binned features; scores are probabilities."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]      # feature, cut, value of a complete binary tree
    bias: float
    thresholds: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = 2 * at + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[at]))
            z += value[at]
        return 1 / (1 + np.exp(-z))


def _walk(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row reaches; a node without a split hands all rows to the left."""
    at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
    for _ in range(depth):
        f = feature[at]
        at = 2 * at + 1 + ((f >= 0) & (binned[rows, np.maximum(f, 0)] > cut[at]))
    return at


def level_sums(binned: np.ndarray, y: np.ndarray, weight: np.ndarray, bias: float, trees: list, feature: np.ndarray, cut: np.ndarray,
               level: int) -> np.ndarray:
    """node x feature x bin x (gradient, second derivative, rows): sums over rows that have come to a level of a tree."""
    z = np.full(len(binned), bias)
    for f, c, value in trees:
        z += value[_walk(binned, f, c, DEPTH)]
    p = 1 / (1 + np.exp(-z))
    g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-9)
    node = _walk(binned, feature, cut, level) - (2 ** level - 1)
    n, cells = binned.shape[1], 2 ** level * binned.shape[1] * BINS
    cell = ((node[:, None] * n + np.arange(n)) * BINS + binned).ravel()
    return np.stack([np.bincount(cell, np.repeat(v, n), cells) for v in (g, h, weight)], 1).reshape(2 ** level, n, BINS, 3)


def grow(cuts: list[np.ndarray], share: float, sums) -> Boosted:
    """Gradient boosting for the logistic loss; splits are sought over the bins between ``cuts``.
    ``sums(bias, trees, feature, cut, level)`` are ``level_sums`` over all rows, ``share`` is that of outcome 1."""
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    trees, nodes = [], 2 ** (DEPTH + 1) - 1
    for _ in range(ROUNDS):
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
        for level in range(DEPTH):
            total = sums(bias, trees, feature, cut, level)
            for j, own in enumerate(total):
                node = 2 ** level - 1 + j
                gs, hs, n = own[0].sum(0)
                left, best = own[0].sum(0), 1e-6
                for f, c in enumerate(cuts):
                    if n < 2 * LEAST_ROWS or not len(c):
                        continue
                    gl, hl, nl = np.cumsum(own[f], 0)[:len(c)].T
                    gain = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
                    gain[(nl < LEAST_ROWS) | (n - nl < LEAST_ROWS)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], f, k
                        left = np.array([gl[k], hl[k], nl[k]])
                if level == DEPTH - 1:
                    right = np.array([gs, hs, n]) - left
                    value[2 * node + 1], value[2 * node + 2] = RATE * left[0] / (left[1] + 1), RATE * right[0] / (right[1] + 1)
        trees.append((feature, cut, value))
    real = [(f, np.array([cuts[i][k] if i >= 0 else 0.0 for i, k in zip(f, c)]), v) for f, c, v in trees]
    return Boosted(real, bias, {})


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """``grow`` over rows in memory, with quantiles as cuts."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1)
    return grow(cuts, float(y.mean()), lambda *tree: level_sums(binned, y, np.ones(len(y)), *tree))


# ---------------------------------------------------------------- learning rows

def _rewritten(text: str, span: Span) -> tuple[str, Span] | None:
    """The same span in another notation, in its place in the text; which one depends on the span."""
    kind, a, b = span
    s, turn = text[a:b], (a * 31 + b) % 3
    if kind == "email":
        name, _, host = s.partition("@")
        s = name + (" at ", " [at] ", "(at)")[turn] + host.replace(".", (" dot ", ".", "[dot]")[turn])
    elif kind == "card":
        d = _digits(s)
        s = (" ", "-", ".")[turn].join(d[i:i + 4] for i in range(0, len(d), 4))
    elif kind == "phone":
        d = _digits(s)
        s = (f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"+{d[:-10]}.{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}")[turn]
        if len(d) < 11:
            return None
    else:
        s = s.replace(".", (" . ", "-", " ")[turn]) if turn else s
    return text[:a] + s + text[b:], (kind, a, a + len(s))


def learning_rows(text: str) -> list[tuple[list[float], int, int]]:
    """(features, outcome, kind) of the candidates around a text's base spans and their variants."""
    base = base_spans(text)
    known = {s for s in base}
    out = []

    def add(t: str, positive: set[Span], offset_only: tuple[int, int] | None = None):
        for c in [*candidates(t), *positive]:
            if offset_only and not (c[1] < offset_only[1] and offset_only[0] < c[2]):
                continue
            if c in positive:
                out.append((features(t, c), 1, KINDS.index(c[0])))
            elif any(c[1] < e and s < c[2] for _, s, e in positive):
                out.append((features(t, c), 0, KINDS.index(c[0])))
            elif not _plausible(t, c):
                out.append((features(t, c), 0, KINDS.index(c[0])))

    near = lambda a, b: (max(0, a - 60), b + 60)
    if base:
        add(text, known)
    else:
        add(text, set())
    for kind, a, b in base:
        lo, hi = near(a, b)
        if any(s != (kind, a, b) and s[1] < hi and lo < s[2] for s in base):
            continue
        part, moved = text[lo:hi], (kind, a - lo, b - lo)
        other = _rewritten(part, moved)
        if other:
            add(other[0], {other[1]}, other[1][1:])
        if kind in ("phone", "card"):       # run together with a number of the other kind
            s = part[moved[1]:moved[2]]
            start = "4539" + "".join(str((a + 7 * i) % 10) for i in range(11))
            card = s if kind == "card" else next(start + c for c in "0123456789" if luhn(start + c))
            phone = s if kind == "phone" else f"+1 ({200 + a % 700}) 555-{1000 + a % 9000}"
            joined = part[:moved[1]] + phone + " " + card + part[moved[2]:]
            at = moved[1]
            add(joined, {("phone", at, at + len(phone)), ("card", at + len(phone) + 1, at + len(phone) + 1 + len(card))},
                (at, at + len(phone) + 1 + len(card)))
    return out


def _plausible(text: str, span: Span) -> bool:
    """Passes a validator without being a base span: says nothing about the outcome."""
    kind, a, b = span
    s = text[a:b]
    return kind == "card" and luhn(_digits(s)) or kind == "phone" and s[0] in "+(" or kind == "email"


def _arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns of a batch of learning rows; the features as a matrix."""
    out = []
    for name in names:
        c = batch.column(batch.schema.get_field_index(name))
        out.append(c.flatten().to_numpy().reshape(batch.num_rows, -1) if name == "f" else c.to_numpy(zero_copy_only=False))
    return out


def learning_table(docs: DataFrame) -> DataFrame:
    """(f, y, kind, unseen, weight): the learning rows of all documents, equal ones as one with their number."""
    def make():
        def run(rows):
            for doc_id, text in rows:
                for f, y, kind in learning_rows(text or ""):
                    yield ([float(v) for v in f], y, kind, doc_id % 3 == 0)
        return run

    rows = map_rows(text_rows(docs).where("doc_id is not null and text rlike '[0-9@]'"), "f array<double>, y int, kind int, unseen boolean", make)
    return saved(rows.groupBy("f", "y", "kind", "unseen").agg(F.count("*").cast("double").alias("weight")), "pii-learning")


def quantile_cuts(rows: DataFrame) -> list[np.ndarray]:
    """For each feature the BINS - 1 quantiles over all rows by weight.  Values count up to LARGEST and in
    thousandths (shares), so that what reaches the driver is bounded: counts of at most LARGEST values a feature."""
    counted = (rows.select("weight", F.posexplode("f").alias("feature", "v"))
               .groupBy("feature", F.least(F.round("v", 3), F.lit(float(LARGEST))).alias("v")).agg(F.sum("weight").alias("n")).collect())
    cuts = []
    for f in range(1 + max(r.feature for r in counted)):
        v, n = np.array(sorted((r.v, r.n) for r in counted if r.feature == f)).T
        at = np.searchsorted(np.cumsum(n), np.linspace(0, 1, BINS + 1)[1:-1] * n.sum())
        cuts.append(np.unique(v[np.minimum(at, len(v) - 1)]))
    return cuts


def fit(docs: DataFrame) -> Boosted | None:
    """Boosted trees and thresholds from all documents that hold a digit or an at sign."""
    rows = learning_table(docs)
    n = {(r.unseen, r.y): (r.n, r.rows) for r in rows.groupBy("unseen", "y").agg(F.sum("weight").alias("n"), F.count("*").alias("rows")).collect()}
    if len([k for k in n if not k[0]]) < 2 or not any(unseen for unseen, _ in n):
        return None
    learn = rows.where("not unseen")
    cuts = quantile_cuts(learn)

    def bins(batches):
        for batch in batches:
            x, y, weight = _arrays(batch, "f", "y", "weight")
            b = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(b.astype(np.int8).ravel()), b.shape[1]).cast(pa.list_(pa.int8())),
                                              pa.array(y.astype(np.int32)), pa.array(weight)], names=["f", "y", "weight"])

    # rows that fall into the same bins are one; in order, so that sums round alike in every run
    tasks = max(1, min(MOST_TASKS, sum(r for (unseen, _), (_, r) in n.items() if not unseen) // ROWS_A_TASK))
    binned = saved(learn.select("f", "y", "weight").mapInArrow(bins, "f array<tinyint>, y int, weight double")
                   .groupBy("f", "y").agg(F.sum("weight").alias("weight")).repartition(tasks, "f").sortWithinPartitions("f", "y"), "pii-binned")

    def sums(bias, trees, feature, cut, level):
        def run(batches):
            total = 0
            for batch in batches:
                x, y, weight = _arrays(batch, "f", "y", "weight")
                total = total + level_sums(x.astype(np.int64), y, weight, bias, trees, feature, cut, level)
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])
        got = binned.mapInArrow(run, "sums binary").collect()
        return sum(np.frombuffer(r.sums) for r in got).reshape(2 ** level, len(cuts), BINS, 3)

    model = grow(cuts, n[False, 1][0] / (n[False, 0][0] + n[False, 1][0]), sums)

    def scores(batches):
        for batch in batches:
            x, y, kind, weight = _arrays(batch, "f", "y", "kind", "weight")
            at = np.minimum((model.score(x) * SCORE_BINS).astype(np.int32), SCORE_BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(weight * y), pa.array(weight)], names=["kind", "bin", "right", "n"])

    counted = (rows.where("unseen").mapInArrow(scores, "kind int, bin int, right double, n double")
               .groupBy("kind", "bin").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).collect())
    for k, name in enumerate(KINDS):
        own = [r for r in counted if r.kind == k]
        model.thresholds[name] = calibrate(*(np.array(c, float) for c in ([(r.bin + 0.5) / SCORE_BINS for r in own], [r.right for r in own], [r.n for r in own])))
    for done in (rows, binned):
        emptied(done)
    return model


def calibrate(score: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The lowest threshold of at least a half whose precision on these rows reaches PRECISION; with ``n``, a score
    stands for so many rows, ``y`` of which are right."""
    if not len(y) or not y.any():
        return 2.0
    order = np.argsort(-score, kind="stable")
    s, right = score[order], np.cumsum(y[order]) / np.cumsum(np.ones(len(y)) if n is None else n[order])
    last = np.append(s[1:] < s[:-1], True)          # equal scores are taken together
    ok = np.flatnonzero(last & (right >= PRECISION))
    if not len(ok):
        return 2.0
    k = ok[-1]
    return max(0.5, float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k]))


# ---------------------------------------------------------------- use

def all_spans(texts: list[str | None], model: Boosted | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text, both by kind and start."""
    base = [base_spans(t or "") for t in texts]
    if model is None:
        return [(b, b) for b in base]
    rows, feats = [], []
    for i, t in enumerate(texts):
        for c in candidates(t or ""):
            if not any(c[1] < e and s < c[2] for _, s, e in base[i]):
                rows.append((i, c))
                feats.append(features(t, c))
    picked: dict[int, list[Span]] = {}
    if rows:
        score = model.score(np.array(feats, float))
        for k in sorted(range(len(rows)), key=lambda k: (rows[k][0], -score[k], rows[k][1][1], -rows[k][1][2])):
            i, c = rows[k]
            if score[k] >= model.thresholds[c[0]] and not any(c[1] < e and s < c[2] for _, s, e in picked.get(i, ())):
                picked.setdefault(i, []).append(c)
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return [(b, sorted([*b, *picked.get(i, ())], key=order)) for i, b in enumerate(base)]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Boosted | None) -> DataFrame:
    """One row per document: doc_id, the count of base spans of each kind, the digest of their list
    and the list of all spans.  Needs no shuffle: the trees (ROUNDS of depth DEPTH) go with the tasks."""
    def make():
        def run(rows):
            for (doc_id, _), (base, spans) in zip(rows, all_spans([t for _, t in rows], model)):
                n = [sum(s[0] == k for s in base) for k in KINDS]
                yield (doc_id, *n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans))
        return run
    return map_rows(text_rows(docs), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                    "base_sha256 string, spans string", make)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span (overlapping ones together) replaced by its kind in brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: Boosted | None) -> DataFrame:
    """``docs`` with all its columns, personal data in the texts replaced (n_chars follows, if there)."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            new = [t if t is None else redacted(t, spans) for t, (_, spans) in zip(texts, all_spans(texts, model))]
            put = {"text": pa.array(new, batch.schema.field("text").type)}
            if "n_chars" in batch.schema.names and pa.types.is_integer(batch.schema.field("n_chars").type):
                old = batch.column("n_chars").to_pylist()
                put["n_chars"] = pa.array([n if a == b or b is None else len(b) for n, a, b in zip(old, texts, new)],
                                          batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([put.get(f.name, c) for f, c in zip(batch.schema, batch.columns)], schema=batch.schema)
    return docs.mapInArrow(run, docs.schema)
