import itertools
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from merchlens.llm import decontam


def brute_windows(item, doc, share, least):
    """All (doc start, size, equal) of the best window over every way to lay item over doc."""
    best = None
    n = len(item)
    for shift in range(-n + 1, len(doc)):
        low, high = max(0, shift), min(len(doc), shift + n)
        equal = [doc[i] == item[i - shift] for i in range(low, high)]
        sizes = [
            (b - a, -a, sum(equal[a:b]))
            for a in range(len(equal))
            for b in range(a + least, len(equal) + 1)
            if sum(equal[a:b]) >= share * (b - a) - 1e-9
        ]
        if sizes:
            size, minus_a, count = max(sizes)
            found = (count, -(low - minus_a), size)
            best = max(best or found, found)
    return best and (-best[1], best[2], best[0])


def sentences(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    items = [(i, sentences(rng, rng.choice([3, 5, 8, 12, 20, 40]))) for i in range(30)]
    docs = []
    for d in range(150):
        words = sentences(rng, rng.choice([0, 4, 60, 200]))
        if d % 2:
            _, item = rng.choice(items)
            a = rng.randrange(max(1, len(item) - 14))
            part = list(item[a:]) if d % 4 == 1 else list(item)
            for p in rng.sample(range(len(part)), int(len(part) * rng.choice([0, 0.1, 0.2, 0.35]))):
                part[p] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, words))
    return items, docs


def test_same_as_brute_force(spark, docs, planted):
    items, texts = planted
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    table = docs([(d, " ".join(w)) for d, w in texts])
    got = {(r.doc_id, r.item_id): (r.start, r.n_tokens, r.n_equal) for r in decontam.find_leaks(table, bench).collect()}
    want = {}
    for (i, item), (d, words) in itertools.product(items, texts):
        share = 0.8 if len(item) >= decontam.EXACT_BELOW else 1.0
        if found := brute_windows(item, words, share, min(13, len(item))):
            want[d, i] = found
    assert set(got) == set(want) and len(want) > 40
    assert {k: v[2] for k, v in got.items()} == {k: v[2] for k, v in want.items()}
    kept = decontam.drop_leaks(table, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in want}
    assert kept.columns == table.columns
    # Blocks of the benchmark and parts of a task's rows change nothing.
    blocks = decontam.find_leaks(table, bench, block_tokens=60)
    assert {(r.doc_id, r.item_id): (r.start, r.n_tokens, r.n_equal) for r in blocks.collect()} == got
    assert decontam.drop_leaks(table, bench, block_tokens=60).count() == kept.count()


def test_parts_of_a_batch(planted):
    import pyarrow as pa

    items, texts = planted
    index = decontam.build_index(pa.array([i for i, _ in items]), [" ".join(w) for _, w in items])
    column = pa.array([" ".join(w) for _, w in texts])
    whole = sorted(decontam.leaks_in(index, column, 0.8, 13))
    decontam.CHUNK_TOKENS, old = 50, decontam.CHUNK_TOKENS
    try:
        assert sorted(decontam.leaks_in(index, column, 0.8, 13)) == whole
    finally:
        decontam.CHUNK_TOKENS = old


@pytest.mark.parametrize("n", range(8, 16))
def test_masks_find_every_window_with_a_fifth_substituted(n):
    for gone in itertools.combinations(range(n), n // 5):
        assert any(
            not {at + m for m in mask} & set(gone)
            for mask in decontam.MASKS
            for at in range(n - mask[-1])
        ), gone


def test_best_window():
    rng = np.random.default_rng(0)
    for _ in range(200):
        equal = rng.random(rng.integers(1, 25)) < 0.7
        sizes = [
            b - a
            for a in range(len(equal))
            for b in range(a + 1, len(equal) + 1)
            if equal[a:b].sum() >= 0.8 * (b - a) - 1e-9
        ]
        got = decontam.best_window(equal, 0.8, 1)
        assert (got[1] - got[0] if got else 0) == max(sizes, default=0)


def test_edges(spark, docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (3, "one"), (None, "two words")], "item_id long, text string")
    table = docs([(1, None), (2, ""), (3, "ONE, more"), (None, "two words"), (5, "words two")])
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontam.find_leaks(table, bench).collect())
    assert got == [("3", "3"), ("3", "3"), ("None", "None")]
    assert sorted(r.doc_id for r in decontam.drop_leaks(table, bench).collect()) == [1, 2, 5]
    assert decontam.find_leaks(docs([]), bench).count() == 0
    assert decontam.find_leaks(table, bench.limit(0)).count() == 0
    assert decontam.drop_leaks(table, bench.limit(0)).count() == 5
    item = " ".join(f"t{i}" for i in range(20))
    copies = docs([(i, "lead " + item) for i in range(40)] + [(99, "x " * 50_000 + item)])
    bench = spark.createDataFrame([("a", item, 7)], "item_id string, text string, start int")
    got = decontam.find_leaks(copies, bench).collect()
    assert len(got) == 41 and {r.item_id for r in got} == {"a"}
    assert [r.start for r in got if r.doc_id == 99] == [50_000]


@pytest.mark.parametrize("text, item", [
    (["x"] * 400_000, ["x"] * 50),
    ((["x"] * 37 + ["y"]) * 2_000, ["x"] * 50),
    (["a", "b"] * 20_000, ["a", "b", "c"] * 20),
    (["x"] * 30 + ["q"] + ["x"] * 400, ["x"] * 60 + ["z"] * 3),
])
def test_text_that_repeats_itself(text, item):
    index = decontam.build_index(pa.array([1]), [" ".join(item)])
    tracemalloc.start()
    begun = time.time()
    got = list(decontam.leaks_in(index, pa.array([" ".join(text)]), 0.8, 13))
    assert time.time() - begun < 60 and tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    # Brute force: every shift; the most equal tokens, then the first start, then the longest window.
    best, last = None, min(len(text), 3_000)
    for shift in range(1 - len(item), last):
        low, high = max(shift, 0), min(shift + len(item), len(text))
        same = np.array([text[i] == item[i - shift] for i in range(low, high)])
        window = decontam.best_window(same, 0.8, 13)
        if window:
            found = (int(same[window[0] : window[1]].sum()), -(low + window[0]), window[1] - window[0])
            best = found if best is None else max(best, found)
    assert got == ([] if best is None else [(0, 0, -best[1], best[2], best[0])])
