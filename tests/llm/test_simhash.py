import itertools
import random

import numpy as np
import pytest

from merchlens.llm import simhash
from merchlens.operators.components import connected_components


def bits_apart(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_every_word_is_near_one_codeword():
    _, patterns, count = simhash.golay()
    sizes = [bin(int(p)).count("1") for p in patterns[:, 0]]
    assert sorted(set(sizes)) == [0, 1, 2, 3]
    assert all(c == (6 if s == 3 else 1) for c, s in zip(count, sizes))


def test_neighbours_always_share_a_key():
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    near, count = simhash.near_codewords(words)
    for bit in range(23):
        other, _ = simhash.near_codewords(words ^ (1 << bit))
        assert all(other[i, 0] in near[i, : count[i]] for i in range(len(words)))


def test_fingerprint_is_the_majority_of_shingle_hashes():
    import xxhash

    text = "A b\x0bc  D e\tf a B c"
    words = ["a", "b", "c", "d", "e", "f", "a", "b", "c"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(7)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 3.5)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("Ä b") == xxhash.xxh64_intdigest("Ä b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \n ") == 0


def test_long_texts_count_every_shingle():
    rng = random.Random(3)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(3000)]
    import xxhash

    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(" ".join(words)) == want


@pytest.mark.parametrize("max_bits", [3, 1, 0])
def test_links_connect_exactly_what_all_pairs_do(spark, max_bits):
    rng = random.Random(max_bits)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randint(0, 12)):
            near = base
            for b in rng.sample(range(64), rng.randint(1, 4)):
                near ^= 1 << b
            fps.add(near)
    dense = rng.getrandbits(64)  # a large group of near copies
    fps |= {dense ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(20), 2)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = {r.node: r.component for r in connected_components(simhash.links(df, max_bits)).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(signed, 2) if bits_apart(a, b) <= max_bits]
    want = brute_components(signed, pairs)
    assert {f: got.get(f, f) for f in signed} == want


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(7)
    edges = {
        "path": [(i, i + 1) for i in range(300)],
        "star": [(500, i) for i in range(499)] + [(500, 900)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
    }[shape]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(7)
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = brute_components({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got}
    assert all(want[n] == n for n in want if n not in got)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_groups_of_edge_rows(docs):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, "same words here again"), (2, "same  WORDS here\nagain"), (9, None), (7, ""), (8, " \t"),
            (1, long), (3, long + " tail"), (4, "quite another text"), (4, "quite another text"), (None, "quite another text")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicate_groups(docs(rows)).collect()), key=str)
    want = [(5, 2), (2, 2), (9, 7), (7, 7), (8, 7), (1, 1), (3, 1), (4, 4), (4, 4), (None, 4)]
    assert got == sorted(want, key=str)
    kept = simhash.keep_one_per_group(docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 7]
    assert kept.columns == docs(rows).columns


def test_ids_that_are_all_null_and_empty_table(docs):
    rows = [(None, "one text of words"), (None, "one text of words"), (None, "no relation at all to it")]
    assert {r.component_id for r in simhash.near_duplicate_groups(docs(rows)).collect()} == {None}
    assert simhash.keep_one_per_group(docs(rows)).count() == 2
    assert simhash.near_duplicate_groups(docs([])).count() == 0
    assert simhash.keep_one_per_group(docs([])).count() == 0


def test_sought_keys_are_never_broadcast(spark):
    # 84 keys a fingerprint: their size is not that of the stored fingerprints.
    distinct = spark.range(200).selectExpr("xxhash64(id) AS fp")
    plan = simhash.links(distinct)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan
