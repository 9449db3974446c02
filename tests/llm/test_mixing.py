import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlens.llm import mixing

SCHEMA = "doc_id long, source string, size long"


def brute_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """{source: target}: stop what is above its ceiling, share the rest again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target = share * sum(sizes.values()), {}
    while free := [s for s in names if s not in target]:
        left = total - sum(target.values())
        given = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if given[s] > most * sizes[s]]
        if not above:
            return target | given
        target |= {s: most * sizes[s] for s in above}
    return target


def rows_of(rng, sources, n, longest=400):
    return [(i, rng.choice(sources), rng.choice([0, 1, rng.randint(2, longest)])) for i in range(n)]


def check(rows, got, most=2):
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n or 0
    want = brute_targets(sizes)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, n or 0) for i, s, n in rows)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), abs=1e-6)
        rate = Fraction(want[r.source]) / sizes[r.source] if sizes[r.source] else 0
        assert int(rate) <= r.copies <= min(most, -int(-rate // 1))
        taken[r.source] += r.copies * r["size"]
        longest[r.source] = max(longest[r.source], r["size"])
    for s, n in taken.items():
        assert abs(n - want[s]) < max(1, longest[s]), s
    return taken


@pytest.mark.parametrize("group", [mixing.GROUP, 7, 2])
def test_sources_meet_their_targets(spark, group):
    rng = random.Random(group)
    rows = rows_of(rng, ["a", "b", "é", "z", "", "", "😀", None], 900) + [(5000 + i, "small", 2) for i in range(3)]
    rows += [(None, "a", 40)] * 30 + [(77, "b", None)] * 5
    check(rows, mixing.copies(spark.createDataFrame(rows, SCHEMA), group=group).collect())


def test_one_hot_source_and_one_hot_id(spark):
    rows = [(1, "hot", 50)] * 600 + [(2 + i, "hot", 10) for i in range(600)] + [(9000 + i, f"s{i % 9}", 30) for i in range(600)]
    got = mixing.copies(spark.createDataFrame(rows, SCHEMA), group=50).collect()
    check(rows, got)


def test_reruns_and_partitionings_agree(spark):
    rows = rows_of(random.Random(4), ["a", "b", "c", "d"], 500) + [(3, "a", 9)] * 20
    seen = []
    for n in (1, 3, 16):
        table = spark.createDataFrame(random.Random(n).sample(rows, len(rows)), SCHEMA).repartition(n)
        seen.append(Counter(map(tuple, mixing.copies(table, group=64).collect())))
    assert seen[0] == seen[1] == seen[2]
    other = Counter(map(tuple, mixing.copies(spark.createDataFrame(rows, SCHEMA), seed=7, group=64).collect()))
    assert other != seen[0]


def test_rounding_is_unbiased_and_keeps_the_sum():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 60, 40).astype(float)
    start = rng.random(40)
    mean = np.zeros(40)
    for _ in range(4000):
        part = start.copy()
        left = mixing._pivotal(part, size, rng.random(40))
        assert (part * size).sum() == pytest.approx((start * size).sum())
        assert all(p in (0, 1) for i, p in enumerate(part) if i != left)
        mean += part
    assert np.abs(mean / 4000 - start).max() < 0.04  # five standard errors


def test_targets_of_edge_tables(spark):
    def made(rows):
        return {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}

    assert made([]) == {} and made([("a", 0), (None, 0)]) == {"a": 0, None: 0}
    assert made([("a", 10)]) == {"a": 15}
    assert made([("a", 1), ("b", 1000)]) == {"a": 2, "b": pytest.approx(1499.5)}
    for seed in range(6):
        rng = random.Random(seed)
        sizes = {f"s{i:02}": int(10 ** (rng.random() * 5)) for i in range(40)}
        want = brute_targets(sizes)
        got = made(list(sizes.items()))
        assert got == {s: pytest.approx(float(t)) for s, t in want.items()}


def test_query_mixture_and_clashing_columns(spark, docs, tmp_path):
    rows = [(i, "word \x0b\x85x " * (i % 9), "en", f"s{i % 4}") for i in range(80)] + [(900, None, None, None), (901, "", "en", "s1")]
    table = docs(rows).withColumnRenamed("n_chars", "place").withColumnRenamed("lang", "target")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op13_source_mixing(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r["size"], r.source) for r in got} == {(i, 2 * (i % 9), s) if i < 900 else (i, 0, s) for i, _, _, s in rows}
    check([(r.doc_id, r.source, r["size"]) for r in got], got)
    assert all(r.taken == r.copies * r["size"] <= 2 * r["size"] for r in got)
    sized = table.withColumn("size", mixing.words(F.col("text")))
    mixed = mixing.mixture(table, mixing.copies(sized))
    copies = defaultdict(list)
    for r in mixed.collect():
        copies[r.doc_id].append(r.copy)
    assert {i: sorted(c) for i, c in copies.items()} == {r.doc_id: list(range(r.copies)) for r in got if r.copies}


def test_empty_table(spark):
    assert mixing.copies(spark.createDataFrame([], SCHEMA)).count() == 0
