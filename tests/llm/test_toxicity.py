import random
import zlib

import numpy as np

from jobloom.llm import toxicity as tx
from tests.llm.helpers import docs, edge_rows


def corpus(n=600):
    rng = random.Random(3)
    prose = ["".join(rng.choice(["ba", "ko", "li", "mu", "te", "ra"]) for _ in range(rng.randint(2, 4))) for _ in range(800)]
    stems = ["grumptrash", "vilestupid", "zorkloser"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(prose) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(stems) + rng.choice(["", "", "s", "ing"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    d = docs(spark, rows + [(7000 + i, t) for i, t in edge_rows()[:3]] + edge_rows()[6:9])
    out = tx.score(d, tx.fit(d, lab)).collect()
    assert len(out) == len(rows) + 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in out)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= .97
    assert all(r.predicted == 0 for r in out if r.doc_id in (7001, 7002, 7003))
    # labels of the held-out rows change nothing
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels],
                                    "doc_id bigint, quality int, toxic int")
    again = {r.doc_id: r.score for r in tx.score(d, tx.fit(d, flipped)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out if r.doc_id in truth)


def test_no_labels_and_empty_table(spark):
    d = docs(spark, edge_rows())
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert tx.fit(d, none) is None
    out = tx.score(d, None).collect()
    assert len(out) == len(edge_rows()) and {r.score for r in out} == {0.0} and not any(r.held_out for r in out if r.doc_id is None)
    assert tx.score(d.limit(0), None).count() == 0


def test_dictionary_saves_on_its_own_words():
    toxic = tx.train_dictionary([("disgusting", 40), ("worthless", 30)], 4096)
    plain = tx.train_dictionary([("morning", 40), ("evening", 30)], 4096)
    s = tx.Scorer(toxic, plain, plain)
    assert s.saved("disgusting") > 2 and s.saved("worthless") > 2 and s.saved("morning") <= 0


def test_scores_recomputed_from_the_dictionaries(spark):
    """Each word's window compressed anew under both dictionaries, counted and weighed by hand."""
    import math

    import zstandard as zs
    rows, labels = corpus(200)
    scorer = tx.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    toxic, ordinary = scorer.dictionaries

    def size(content, window):
        d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        return len(zs.ZstdCompressor(level=tx.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(window))

    got = {r.doc_id: r.score for r in tx.score(docs(spark, rows[:40]), scorer).collect()}
    for i, text in rows[:40]:
        ws = tx.words(text)
        saved = [size(ordinary, w) - size(toxic, w) for w in (tx.BEFORE + x.encode() + tx.AFTER for x in ws)]
        reached = [sum(v >= s for v in saved) for s in tx.SAVINGS]
        x = [math.log1p(min(c, 50)) for c in reached] + [math.log1p(100 * c / (len(ws) + 30)) for c in reached] + [1.0]
        z = sum(a / s * w for a, s, w in zip(x, scorer.scale, scorer.weights))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
