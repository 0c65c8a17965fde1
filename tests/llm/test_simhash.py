import random

import xxhash

from jobloom.llm import simhash as sh
from jobloom.llm.components import connected_components
from tests.llm.helpers import PROSE, docs, edge_rows


def naive(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids_fps, bits=4):
    parent = list(range(len(ids_fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, (_, a) in enumerate(ids_fps):
        for j in range(i):
            if bin(a ^ ids_fps[j][1]).count("1") <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(ids_fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids_fps))]


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 150, 400]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            if rng.random() < .7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    return rows + edge_rows()[:3]


def test_fingerprint_is_the_plain_one():
    for _, text in corpus():
        assert sh.fingerprint(text) % (1 << 64) == naive(text)
    assert sh.fingerprint("Ä B É") == sh.fingerprint("Ä b É") != sh.fingerprint("ä b é")


def test_segments_satisfy_the_pigeonhole():
    for bits in range(0, 9):
        plan = sh.segment_plan(bits)
        assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for _, _, r in plan) == bits + 1


def test_components_against_brute_force(spark):
    rows = corpus()
    got = sh.near_duplicates(docs(spark, rows)).collect()
    want = components([(d, naive(t)) for d, t in rows])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(
        (d, f"{naive(t):016x}", c) for (d, t), c in zip(rows, want))


def test_links_at_every_distance(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = []
    for i, b in enumerate(base):
        v = b
        for bit in rng.sample(range(64), i % 7):
            v ^= 1 << bit
        values += [b, v]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in set(signed)], "fp bigint")
    comp = {r.node: r.component for r in connected_components(sh.links(fps)).collect()}
    for i in range(40):
        a, b = signed[2 * i], signed[2 * i + 1]
        assert (comp.get(a, a) == comp.get(b, b)) == (i % 7 <= 4)


def test_edge_rows_and_one_of_each_group(spark):
    rows = edge_rows()
    d = docs(spark, rows)
    out = sh.near_duplicates(d).collect()
    want = components([(i, naive(t)) for i, t in rows])
    assert sorted(map(repr, ((r.doc_id, r.component_id) for r in out))) == sorted(map(repr, ((i, c) for (i, _), c in zip(rows, want))))
    kept = sh.keep_one(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({c for c in want if c is not None})
    only = docs(spark, [(None, PROSE), (None, PROSE), (3, "a b c d e")])
    assert sorted(map(repr, (r.doc_id for r in sh.keep_one(only).collect()))) == ["3", "None"]
    two = docs(spark, [(1, PROSE), (1, "quite another text than that"), (2, PROSE), (0, "quite another text than that")])
    assert sorted(r.doc_id for r in sh.keep_one(two).collect()) == [0, 1]
    assert sh.near_duplicates(d.limit(0)).count() == 0 and sh.keep_one(d.limit(0)).count() == 0


def test_no_table_that_grows_with_the_documents_is_broadcast(spark):
    # Spark sizes exploded rows like those before the explode, and sent three rows of each fingerprint through the driver
    fps = spark.range(0, 500).selectExpr("xxhash64(id) as fp")
    found = sh.links(fps)
    groups = sh.near_duplicates(docs(spark, corpus()))
    for df in (found, groups):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
