import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import collocations as co
from tests.llm.helpers import docs, edge_rows


def sentences(seed: int, n: int, vocabulary: int = 6) -> list[str]:
    """Texts of few words, so that many phrases repeat; some phrases are planted."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rnd.choice("abcdefgh"[:vocabulary]) + rnd.choice(["", "x"]) for _ in range(rnd.randint(0, 25))]
        if rnd.random() < 0.5:
            words[3:3] = ["New", "York", "city", "Hall"][:rnd.randint(2, 4)]
        out.append("".join(w + rnd.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", " ; "]) for w in words))
    return out


def brute(rows: list[tuple], least: int, top: int) -> set[tuple]:
    """The contract read word by word: (lang, text) rows to result rows."""
    import re
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    out = set()
    for lang in n:
        kept = []
        for (g, p), a in cand.items():
            if g != lang or any(h == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                                for (h, q), b in cand.items()):
                continue
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 0) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, f long")


@pytest.mark.parametrize("shard_words,bloom_bits", [(1 << 20, 1 << 26), (50, 1 << 26), (300, 1 << 10)])
def test_against_brute_force(spark, shard_words, bloom_bits):
    rows = [(random.Random(i).choice(["en", "en", "de", None, "und"]), t) for i, t in enumerate(sentences(1, 400))]
    got = co.collocations(frame(spark, rows).repartition(5), 4, 60, shard_words, bloom_bits)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, 60) and got.count() > 100


def test_sql_agrees(spark, tmp_path):
    rows = [("en", t) for t in sentences(5, 300)] + [(None, t) for t in sentences(6, 50)] + [("en", None), ("xx", "..."), ("yy", "")]
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    want = {tuple(r) for r in con.execute(co.oracle(5, 40)).fetchall()}
    assert want == {tuple(r) for r in co.collocations(frame(spark, rows), 5, 40).collect()} and len(want) > 40


def test_intervals_of_both_transforms():
    rnd = np.random.default_rng(3)
    text = rnd.integers(0, 5, 400)
    index = co.Index(text)
    whole = text.tolist()

    def check(p):
        want = Counter(tuple(whole[i:i + p.symbols.shape[1]]) for i in range(len(whole) - p.symbols.shape[1] + 1))
        want = {k: v for k, v in want.items() if 0 not in k}
        assert {tuple(s): c for s, c in zip(p.symbols.tolist(), p.count.tolist())} == want

    words = index.words()
    for ways in ("LRL", "RRR", "LLL", "RLR", "LRR"):
        p = words
        for way in ways:
            p = index.left(p) if way == "L" else index.right(p)
            check(p)


def test_bloom_never_misses(spark):
    import pyarrow as pa
    w, e = (co.Bloom.hashes("en", pa.array([f"{c}{i}".encode() for i in range(2000)], pa.binary())) for c in "wé")
    pairs = co.Bloom.pair(w[:1000], e[:1000])
    rows = spark.createDataFrame([("en", f"w{i}") for i in range(2000)], "lang string, phrase string")
    rows = rows.select(F.xxhash64(F.concat_ws("\n", "lang", "phrase")).alias("h")).union(
        spark.createDataFrame([(int(x),) for x in pairs.view("int64")], "h long"))
    for bits in (1 << 10, 1 << 26):
        b = co.Bloom(rows, bits)
        assert b.holds(w).all() and b.holds(pairs).all()
    assert b.holds(e).mean() < 0.02 and b.holds(co.Bloom.pair(e[:1000], w[:1000])).mean() < 0.02


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(co, "SEGMENT", 40)
    texts = sentences(9, 60) + ["y " * 200, "z" * 500 + ". a b c"]
    ids = co.WordIds()
    n = [ids.add(t) for t in texts]
    lang, words, data = ids.row("en")
    names = [b""] + words.split(b"\n")
    got = b" ".join(names[i] or b"|" for i in np.frombuffer(data, np.int32)).split(b"|")
    import re
    want = [" ".join(re.findall(r"[^\x20\x09]+", p)) for t in texts for p in re.split(r"[.,;:!?\x0A-\x0D]", t.lower())]
    assert [x.strip().decode() for x in got if x.strip()] == [w for w in want if w]
    assert sum(n) >= sum(len(w.split(" ")) for w in want if w)


def test_edge_rows(spark):
    d = docs(spark, edge_rows())
    rows = [(None, t) for _, t in edge_rows()]
    assert {tuple(r) for r in co.collocations(d, 3, 50).collect()} == brute(rows, 3, 50)
    assert co.collocations(d.limit(0)).collect() == []
    assert co.collocations(docs(spark, [(1, "..."), (2, None)]), 1).collect() == []


def test_pairs_of_a_tasks_shards_leave_it_summed(spark):
    """Many shards in one task: a pair is shuffled once for the task, not once for every shard."""
    rows = [(i, "alpha beta gamma. beta gamma delta") for i in range(200)]
    shards = co.saved(co.shards(docs(spark, rows).withColumn("lang", F.lit("en")).coalesce(1), 60), "test-shards").coalesce(1)
    assert shards.count() > 10
    words = spark.createDataFrame([("en", w) for w in ("alpha", "beta", "gamma", "delta")], "lang string, phrase string")
    known = co.Bloom(words.select(F.xxhash64(F.concat_ws("\n", "lang", "phrase")).alias("h")))
    counted = co._pair_hashes(shards, known)
    assert sorted(r.f for r in counted.collect()) == [200, 200, 400]
    assert co._pair_rows(shards, known).count() == 3


def test_shards_are_full_by_their_own_words(spark):
    rows = [(("en", "de")[i % 2], "a b c d e f g h i j") for i in range(400)]
    sizes = {}
    for lang, _, ids in co.shards(frame(spark, rows).coalesce(1), 100).collect():
        sizes.setdefault(lang, []).append(int(np.count_nonzero(np.frombuffer(ids, np.int32))))
    assert {lang: sum(n) for lang, n in sizes.items()} == {"en": 2000, "de": 2000}
    assert all(x >= 100 for n in sizes.values() for x in n)
