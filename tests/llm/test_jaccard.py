import itertools
import random

import pytest

import corpus_pipeline
from merchlens.llm import jaccard, simhash

near_dedup = dict(corpus_pipeline.STAGES)["near_dedup"]


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """Ids that stay: the least of each component of pairs with a Jaccard similarity of 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i for i in root if find(i) == i}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("rounds", [(1, 8), ()])
def test_stage_keeps_what_brute_force_jaccard_keeps(spark, docs, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rng = random.Random(3)
    texts = ["", None, " ", "two words", "TWO  words", "two words more"]
    for g in range(12):
        base = " ".join(f"g{g}w{rng.randrange(500)}" for _ in range(rng.choice([30, 150, 400])))
        texts += [base, base] + [edited(rng, base, rng.randint(1, 9)) for _ in range(12)]
    large = " ".join(f"large{i}" for i in range(200))
    texts += [edited(rng, large, rng.randint(1, 6)) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    kept = near_dedup(spark, docs(rows), "")
    assert {r.doc_id for r in kept.collect()} == brute(rows)
    assert kept.columns == docs(rows).columns


def test_edges_of_the_limit(spark, docs):
    words = [f"w{i}" for i in range(49)]  # 45 shingles; one word changed in the middle: 40 of 50 are shared
    rows = [(1, " ".join(words)), (2, " ".join([*words[:20], "x", *words[21:]]))]
    assert brute(rows) == {1}  # exactly 0.8
    assert {r.doc_id for r in near_dedup(spark, docs(rows), "").collect()} == {1}
    rows[1] = (2, " ".join([*words[:20], "x", *words[21:48]]))
    assert {r.doc_id for r in near_dedup(spark, docs(rows), "").collect()} == brute(rows) == {1, 2}


def test_empty_table_and_null_ids(spark, docs):
    assert near_dedup(spark, docs([]), "").count() == 0
    rows = [(None, "one text of words"), (None, "one text of words"), (None, "no relation at all to it")]
    assert near_dedup(spark, docs(rows), "").count() == 2


def groups_of(rows):
    """{id: least id of its component} over all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in root}


@pytest.mark.parametrize("witnesses, per_task", [(jaccard.WITNESSES, jaccard.MEMBERS_PER_TASK), (0, 7), (3, 50)])
def test_one_template_just_under_the_limit_links_exactly_and_meets_rarely(spark, docs, monkeypatch, witnesses, per_task):
    monkeypatch.setattr(jaccard, "WITNESSES", witnesses)
    monkeypatch.setattr(jaccard, "MEMBERS_PER_TASK", per_task)
    monkeypatch.setattr(jaccard, "ROWS_PER_TASK", per_task)
    met = []
    verified = jaccard._verified

    def counting(pairs, sets):
        met.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(jaccard, "_verified", counting)
    rng = random.Random(8)
    base = " ".join(f"t{i}" for i in range(300))
    # 3 to 5 scattered edits take 15 to 25 of 296 shingles: most pairs are a little below 0.8 to 0.9.
    texts = [edited(rng, base, rng.choice([5, 6, 7, 8])) for _ in range(150)]
    texts += [edited(rng, t, 1) for t in texts[::10]]  # near copies of some of them
    other = edited(rng, base, 60)  # a second template within the keys of the first
    texts += [edited(rng, other, rng.randint(1, 8)) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in jaccard.near_copy_groups(docs(rows)).collect()}
    assert got == groups_of(rows)
    if witnesses > 10:
        assert met[-1] < len(rows) ** 2 / 20


def test_rounds_without_pairs_and_very_long_texts(spark, docs):
    long = [f"long{i}" for i in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["other", *long])), (3, " ".join(long[:30_000]))]
    table = docs(rows).withColumnRenamed("lang", "fp").withColumnRenamed("source", "keys").withColumnRenamed("n_chars", "pivot")
    assert {r.doc_id: r.component_id for r in jaccard.near_copy_groups(table).collect()} == {1: 1, 2: 1, 3: 3}
    kept = near_dedup(spark, table, "")
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {1, 3}


def test_fingerprint_links_are_near_copies_too(spark, docs):
    # Repeated shingles decide the fingerprint, different ones the Jaccard similarity.
    base = "one two three four five " * 100
    rows = [(i, base + " ".join(f"{c}{k}" for k in range(4))) for i, c in ((3, "u"), (7, "v"))]
    assert bin(simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).count("1") <= 3
    got = jaccard.near_copy_groups(docs([*rows, (9, "some other text of other words")]))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(3, 3), (7, 3), (9, 9)}


def test_texts_go_through_one_python_function_on_their_way_to_names_prints_and_keys(spark, docs, monkeypatch):
    rows = [(1, "Some text of some words, ÄÖ"), (2, "some  TEXT of some words, ÄÖ"), (3, None), (4, "two words"), (5, " ".join(map(str, range(3_000))))]
    got = {r.doc_id: r for r in jaccard._named(docs(rows), "doc_id", "text", True).collect()}
    assert {i: got[i].print & (1 << 64) - 1 for i in got} == {i: simhash.fingerprint(t) for i, t in rows}
    plans, cut = [], jaccard.cut_lineage

    def recorded(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, *args)

    monkeypatch.setattr(jaccard, "cut_lineage", recorded)
    monkeypatch.setattr(simhash, "cut_lineage", recorded)
    jaccard.near_copy_groups(docs(rows)).collect()
    # A shuffle parts two functions of one plan, else each task runs two Python processes at once.
    assert all("Exchange" in p for p in plans if p.count("MapInArrow") > 1)
