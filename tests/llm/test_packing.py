import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from jobloom.llm import packing as pk
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs, edge_rows

ODD = ["a\x85b", "a\xa0b", "x y　z", "a\x1cb", "é é ́x", "İstanbul ΣΑΣ", "<|endoftext|> a<|startoftext|>b",
       "it's I'LL we’ve", "a​b", "日本語 テキスト", "'s 't'd", "1234 ٣٤", "", "  ", "a\x0b\x0cb", "x' s ½ ² ª º", "a-b_c--—d"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(pk.tokenizer_path())


def test_ids_are_the_tokenizers(tokenizer, monkeypatch):
    monkeypatch.setattr(pk, "CACHED_WORDS", 5)          # the remembered words are given up again and again
    enc = pk.Encoder(pk.tokenizer_path())
    for t in ODD + ["The quick brown fox, the QUICK Fox! " * 30]:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fill = pk.best_fit([6, 5, 4, 3, 2], 10)
    assert fill == [10, 10] and bins[0] == bins[2] and bins[1] == bins[3] == bins[4]


def placed_right(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_round_trip_on_documents(spark, tokenizer):
    docs_ = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = pk.pack_documents(docs_).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for d in docs_.collect():
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]
        got = sorted(pieces[d.doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [
            (k, a, len(ids[a:a + 4096]), zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    n = placed_right(rows, 4096)
    assert n <= 1.03 * sum(r.length for r in rows) / 4096 + 1


def test_tree_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(pk, "ITEMS_PER_TASK", 40)
    items = spark.createDataFrame([(i, 1 + i * 37 % 90) for i in range(1000)], "name bigint, length bigint")
    rows = pk.pack(items, 100).collect()
    assert sorted(r.name for r in rows) == list(range(1000))
    assert placed_right(rows, 100) <= 1.1 * sum(r.length for r in rows) / 100
    one = pk.pack(spark.createDataFrame([(i, 60) for i in range(300)], "name bigint, length bigint"), 100).collect()
    assert placed_right(one, 100) == 300


def test_edge_rows(spark):
    d = docs(spark, edge_rows())
    rows = pk.pack_documents(d, capacity=128).collect()
    placed_right(rows, 128)
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 4 for r in rows) == 2
    assert {r.length for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert pk.pack_documents(d.limit(0)).count() == 0
    with_ids = pk.pieces(d, with_ids=True).where("doc_id = 9").first()
    assert len(with_ids.ids) == 4 * with_ids.length


def test_against_a_plain_best_fit():
    rng = np.random.default_rng(4)
    for capacity, n in ((10, 30), (100, 200), (4096, 400)):
        for _ in range(6):
            lengths = rng.integers(1, capacity + 1, n).tolist()
            bins, offsets, fill = pk.best_fit(lengths, capacity)
            plain: list[int] = []
            for x in sorted(lengths, reverse=True):                  # every bin is looked at
                fits = [b for b, f in enumerate(plain) if f + x <= capacity]
                if fits:
                    plain[max(fits, key=plain.__getitem__)] += x
                else:
                    plain.append(x)
            assert sorted(fill) == sorted(plain)
            placed = {}
            for b, o, x in zip(bins, offsets, lengths):
                placed.setdefault(b, []).append((o, x))
            for b, parts in placed.items():
                at = 0
                for o, x in sorted(parts):
                    assert o == at
                    at += x
                assert at == fill[b] <= capacity


def test_places_of_bins_are_not_broadcast(spark):
    # their files are small beside the rows, so Spark would send more of them through the driver than it reckons
    rows = spark.range(0, 300).selectExpr("id as doc_id", "2100 + id % 500 as length")
    out = pk.pack(rows)
    out.collect()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
