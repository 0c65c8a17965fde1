import random

from jobloom.llm import decontaminate as dc
from tests.llm.helpers import docs, edge_rows


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if x == y else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
    return max(max(r) for r in h) / (dc.MATCH * len(a))


def test_alignment_against_the_plain_recurrence():
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.choice("abcdef") for _ in range(rng.randint(1, 14))]
        b = [rng.choice("abcdef") for _ in range(rng.randint(1, 25))]
        score, s, e = dc.align(a, b)
        assert abs(score - smith_waterman(a, b)) < 1e-12
        assert score == 0 or abs(smith_waterman(a, b[s:e]) - score) < 1e-12


def corpus():
    rng = random.Random(7)
    words = [f"v{i}" for i in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(15, 50)))) for k in range(12)]
    rows, planted = [], {}
    for i in range(80):
        w = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        if i % 4 == 0:
            k = rng.randrange(12)
            copy = [x if rng.random() > .15 else rng.choice(words) for x in items[k][1].split()]
            at = rng.randrange(len(w))
            w[at:at] = copy
            planted[i] = k
        rows.append((i, " ".join(w)))
    return items, rows, planted


def test_finds_edited_copies_and_nothing_else(spark):
    items, rows, planted = corpus()
    d = docs(spark, rows)
    bench = spark.createDataFrame([*items, items[0], (98, None), (99, "too short")], "item_id bigint, text string")
    found = dc.blocks(d, bench)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, found).collect()}
    assert got == set(planted.items())
    texts = dict(rows)
    for i, k in planted.items():        # brute force: the whole document aligned to the item
        assert smith_waterman(items[k][1].split(), texts[i].split()) >= dc.THRESHOLD
    for r in dc.contaminated(d, found).collect():
        assert smith_waterman(dict(items)[r.item_id].split(), texts[r.doc_id][r.first_char:r.end_char].split()) == r.score
    kept = dc.keep_clean(d, found)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(texts) - set(planted)


def test_an_item_in_every_document_still_has_seeds(spark):
    items, rows, _ = corpus()
    d = docs(spark, [(i, t + " " + items[3][1]) for i, t in rows])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {r.doc_id for r in dc.contaminated(d, dc.blocks(d, bench)).where("item_id = 3").collect()} == {i for i, _ in rows}


def test_blocks_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 500)
    items, rows, planted = corpus()
    d = docs(spark, [*rows, (1000, " ".join([items[0][1]] * 300))])
    found = dc.blocks(d, spark.createDataFrame(items, "item_id bigint, text string"))
    assert len(found) > 1
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(d, found).collect()} == {*planted.items(), (1000, 0)}
    assert {r.doc_id for r in dc.keep_clean(d, found).collect()} == {i for i, _ in rows} - set(planted)


def test_edge_rows(spark):
    d = docs(spark, edge_rows())
    bench = spark.createDataFrame([(1, "the river runs past the old mill where children used to gather"), (None, None)], "item_id bigint, text string")
    found = dc.blocks(d, bench)
    assert sorted(map(repr, (r.doc_id for r in dc.contaminated(d, found).collect()))) == ["4", "4", "5", "None"]
    assert dc.blocks(d, bench.limit(0)) == [] and dc.contaminated(d, []).count() == 0 and dc.keep_clean(d, []).count() == d.count()
    assert dc.contaminated(d.limit(0), dc.blocks(d.limit(0), bench)).count() == 0


def test_one_block_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 500)
    items, rows, planted = corpus()
    d = docs(spark, rows)
    bench = spark.createDataFrame([*items, (None, items[0][1])], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, dc.each_block(d, bench)).collect()}
    assert got == set(planted.items()) | {(i, None) for i, k in planted.items() if k == items[0][0]}
    kept = dc.keep_clean(d, dc.each_block(d, bench))
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - set(planted)
