import math
import zlib
from collections import Counter

import xxhash

from merchlens.llm import sharding


def brute(key, weights):
    def score(i):
        u = ((xxhash.xxh64_intdigest(f"{key}:{i}", 42) >> 11) + 0.5) / 2**53
        return -weights[i] / math.log(u)

    return max(range(len(weights)), key=lambda i: (score(i), -i))


def test_same_as_brute_force_and_few_records_move(docs):
    rows = [(i * 7 - 50, str(i)) for i in range(400)]
    weights = [1.0, 2.0, 0.5, 1.5]
    got = {r.doc_id: r for r in sharding.assign_shards(docs(rows), "doc_id", weights, 3.0).collect()}
    for key, r in got.items():
        assert r.shard == brute(key, weights)
        assert r.grown_shard == brute(key, [*weights, 3.0])
        assert r.grown_shard in (r.shard, 4)
    sizes = Counter(r.shard for r in got.values())
    assert sizes[1] > sizes[0] > sizes[2]


def test_query_columns(spark, docs, tmp_path):
    rows = [(i % 90 if i else None, None if i % 9 == 1 else "ä" * i) for i in range(100)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op4_rendezvous_shards(spark, str(tmp_path)).collect()
    assert len(got) == 100
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    want = Counter((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert len({r.shard for r in got if r.doc_id == 3}) == 1


def test_edges(docs):
    assert sharding.with_slots(sharding.assign_shards(docs([]), "doc_id", [1.0]), "doc_id").count() == 0
    clash = docs([(1, "x")]).withColumnRenamed("lang", "shard").withColumnRenamed("source", "slot")
    out = sharding.with_slots(sharding.assign_shards(clash, "doc_id", [1.0, 1.0]), "doc_id")
    assert sorted(out.columns) == sorted(["doc_id", "text", "n_chars", "shard", "grown_shard", "slot"])
    assert out.first().slot == 0 and out.first().grown_shard is None
