import hashlib
import random
import re

import numpy as np

from jobloom.llm import pii
from tests.llm.helpers import docs, edge_rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def naive(t):
    n = lambda s: re.sub(r"[^0-9]", "", s)
    return ([("email", *m.span()) for m in EMAIL.finditer(t)]
            + [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
            + [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(n(m[0])) <= 19 and pii.luhn(n(m[0]))]
            + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(n(m[0])) <= 15])


def test_base_spans_against_the_patterns():
    rng = random.Random(5)
    for alphabet in ("a.@-+1 2(9)b", "0123456789 -", "1.25", "+1 (2)-", "a@b.c"):
        for _ in range(6000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 26)))
            assert pii.base_spans(t) == naive(t), t
    assert pii.base_spans("a" * 200_000 + "@x.y") == [("email", 0, 200_004)]


def sample(spark, n=400):
    rng = random.Random(9)
    prose = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(200)]

    def card():
        d = [4] + [rng.randrange(10) for _ in range(14)]
        return next("".join(map(str, d)) + str(k) for k in range(10) if pii.luhn("".join(map(str, d)) + str(k)))
    rows = []
    for i in range(n):
        w = [rng.choice(prose) for _ in range(30)]
        extra = [f"{rng.choice('abc')}{i}.{rng.randrange(99)}@mail{i % 9}.example.com", card(), f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
                 f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", f"order {rng.randint(10 ** 9, 10 ** 10)}"][i % 5]
        w.insert(rng.randrange(30), extra)
        rows.append((i, " ".join(w)))
    return docs(spark, rows)


def test_method_adds_what_the_patterns_miss_and_leaves_the_rest(spark):
    model = pii.fit(sample(spark))
    text = "ab cd +1 (578) 555-6437 4815819516090933 ef gh"
    assert pii.luhn("4815819516090933")
    (base, spans), (none, quiet) = pii.all_spans([text, "was in 2019 page 12 of 300 and at it. The end"], model)
    assert base == [] and ("phone", 6, 23) in spans and ("card", 24, 40) in spans
    assert none == quiet == []
    assert pii.redacted(text, spans) == "ab cd [PHONE] [CARD] ef gh"


def test_trees_learn_and_thresholds_hold():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > .5) & (x[:, 2] < .3)).astype(float)
    m = pii.boost(x[:2000], y[:2000])
    s = m.score(x[2000:])
    assert ((s > .5) == (y[2000:] > 0)).mean() > .97
    t = pii.calibrate(s, y[2000:])
    assert y[2000:][s >= t].mean() >= pii.PRECISION
    assert pii.calibrate(np.array([.9, .8]), np.array([0., 0.])) > 1


def test_edge_rows(spark):
    extra = [(20, "mail a.b@c.de or 1.2.3.4"), (21, "+49 (89) 12345678"), (22, "x" * 50_000 + " a@b.co " + "9" * 5000)]
    d = docs(spark, edge_rows() + extra)
    out = {r.doc_id: r for r in pii.find(d, None).collect()}
    assert out[20].spans == "email:5:13,ip:17:24" and (out[20].n_email, out[20].n_ip) == (1, 1)
    assert out[20].base_sha256 == hashlib.sha256(out[20].spans.encode()).hexdigest()
    assert out[1].spans == "" and out[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(d, None).count() == len(edge_rows()) + 3 and pii.find(d.limit(0), None).count() == 0
    assert pii.fit(d.limit(0)) is None
    new = pii.redact(d, None)
    assert new.columns == d.columns
    rows = {r.doc_id: r for r in new.collect()}
    assert rows[20].text == "mail [EMAIL] or [IP]" and rows[20].n_chars == len(rows[20].text) and rows[1].text is None


def test_whole_table_against_the_patterns(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    for r in pii.find(d, pii.fit(d)).collect():
        base = naive(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))| {""}


def test_numbers_written_digit_by_digit_are_proposed():
    phone, card = "2 0 2 5 5 5 0 1 7 3", "4.1.1.1.1.1.1.1.1.1.1.1.1.1.1.1"
    text = f"call {phone} or pay {card} now"
    spans = set(pii.candidates(text))
    assert ("phone", 5, 5 + len(phone)) in spans and ("card", text.index(card), text.index(card) + len(card)) in spans
    assert len(pii.candidates("1 " * 5000)) <= 5000 * 15          # 19 digits bound a candidate


def test_trees_learn_from_all_documents(spark):
    """More documents than the former bound of 4000: every learning row is counted, and sums taken by tasks
    grow the trees that plain numpy grows."""
    d = sample(spark, 4500)
    want = [(tuple(map(float, f)), y, kind, r.doc_id % 3 == 0) for r in d.collect() for f, y, kind in pii.learning_rows(r.text)]
    rows = pii.learning_table(d.repartition(3)).collect()
    assert sum(r.weight for r in rows) == len(want) and {(tuple(r.f), r.y, r.kind, r.unseen) for r in rows} == set(want)
    x, y = np.array([w[0] for w in want if not w[3]]), np.array([w[1] for w in want if not w[3]], float)
    got, plain = pii.fit(d.repartition(3)), pii.boost(x, y)
    assert abs(got.bias - plain.bias) < 1e-9
    assert ((got.score(x) > .5) == (plain.score(x) > .5)).mean() > .995
    assert all((a[2] == b[2]).all() for a, b in zip(got.trees, pii.fit(d.repartition(5)).trees))
