import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from merchlens.llm import packing


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


TEXTS = ["", None, "a", "Hello world", "x" * 9000, "wörter und ümläute " * 700, "<|endoftext|> 12 \n\n  'll", "日本語 🙂" * 50, "a b\tc\r\n" * 1500]


def test_ids_are_those_of_the_tokenizer(reference):
    vocabulary = packing.default_vocabulary()
    for text in TEXTS:
        assert packing.token_ids(text, vocabulary).tolist() == reference(text)


def check(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_pieces_and_places(docs, reference):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "Hello world"), (None, "Hello world")]
    got = packing.pack_documents(docs(rows)).collect()
    check(got, 2048)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert len(by_doc[3]) == 2 and len(by_doc[None]) == 1
    for i, text in enumerate(TEXTS):
        ids = np.array(reference(text), "<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        if i == 3:
            parts = parts[:1]
        assert [r.piece for r in parts] == list(range(len(parts)))
        at = 0
        for r in parts:
            assert r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            assert r.length == 2048 or r.piece == 0
            at += r.length
        assert at == len(ids)


def brute_best_fit(lengths, size):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + x <= size]
        max(fits, key=sum).append(x) if fits else bins.append([x])
    return len(bins)


def least_bins(lengths, size):
    best = len(lengths)

    def go(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        x = rest[0]
        for i, r in enumerate(rooms):
            if r >= x and r not in rooms[:i]:
                go(rest[1:], [*rooms[:i], r - x, *rooms[i + 1 :]])
        go(rest[1:], [*rooms, size - x])

    go(sorted(lengths, reverse=True), [])
    return best


def test_best_fit_and_bound():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.choice([10, 30, 64])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 9))]
        bins, offsets = packing.best_fit_decreasing(np.array(lengths), size)
        assert bins.max() + 1 == brute_best_fit(lengths, size)
        for b in set(bins.tolist()):
            spans = sorted((o, n) for o, n, c in zip(offsets.tolist(), lengths, bins.tolist()) if c == b)
            assert all(o == sum(n for _, n in spans[:k]) for k, (o, _) in enumerate(spans))
        assert packing.lower_bound(np.array(lengths), size) <= least_bins(lengths, size) <= bins.max() + 1
    # Three of 5 do not fit 14: rounding functions see it, the sum of lengths does not.
    assert packing.lower_bound(np.array([5] * 6), 14) == 3 > -(-30 // 14) - 1


def test_exchange_never_needs_more_sequences(spark):
    rng = random.Random(5)
    lengths = [rng.choice([7, 11, 13, 17, 29, 31, 40, 51]) for _ in range(600)]
    rows = [(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")
    alone = check(packing.pack(df, size=100, per_group=25, rounds=0).collect(), 100)
    after = packing.pack(df, size=100, per_group=25, rounds=4).collect()
    assert len(after) == 600
    assert -(-sum(lengths) // 100) <= check(after, 100) < alone


def test_token_sequences_round_trip(docs, reference):
    cut = packing.pieces(docs([(1, "Hello world"), (2, "x " * 3000), (3, None)]), with_ids=True)
    rows = packing.sequences(packing.pack(cut)).collect()
    assert all(len(r.ids) <= 2048 for r in rows)
    assert sorted(x for r in rows for x in r.ids) == sorted(x for t in ("Hello world", "x " * 3000, None) for x in reference(t))


def test_empty_table_and_clashing_names(docs):
    assert packing.pack_documents(docs([])).count() == 0
    clash = docs([(1, "x")]).withColumnRenamed("lang", "row").withColumnRenamed("source", "piece")
    assert packing.pack_documents(clash).first().length == 2


def test_query_and_stage_give_the_ids_of_the_unchanged_tokenizer(spark, docs, tmp_path):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "<|endoftext|", "no <|ENDOFTEXT|>", *TEXTS]
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    vocabulary = packing.default_vocabulary()
    assert [packing.token_ids(t, vocabulary, special=True).tolist() for t in texts] == want
    assert want[0] == [31373, 220, 50256, 995, 0]
    made = docs(list(enumerate(texts[:5])))
    made.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["pack"]
    for got in (packing.op6_best_fit_packing(spark, str(tmp_path)), stage(spark, made, str(tmp_path))):
        found = {r.doc_id: (r.length, r.ids_crc32) for r in got.collect()}
        assert found == {i: (len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in enumerate(want[:5])}
