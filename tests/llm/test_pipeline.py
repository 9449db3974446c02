import itertools
import os
from collections import defaultdict

import pytest

import corpus_pipeline
from merchlens.llm import decontam, langid, linededup, packing
from merchlens.session import release

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables are absent")


def brute(rows, model, bench):
    """rows: {doc_id: (text, source)} -> {doc_id: text} that reach the packing stage."""
    rows = {i: r for i, r in rows.items() if (m := langid.infer(model, r[0])) and m[0][1] >= 0.5}
    pages, on = defaultdict(int), defaultdict(int)
    blank = " \t\r\x0b\x0c"
    for text, source in set(rows.values()):  # copies of a text count once
        pages[source] += 1
        for line in {x.strip(blank) for x in text.split("\n")} - {""}:
            on[source, line] += 1
    bad = {k for k, n in on.items() if n >= linededup.MIN_PAGES and n > linededup.RATIO * pages[k[0]]}
    texts = {i: "\n".join(x for x in t.split("\n") if (s, x.strip(blank)) not in bad) for i, (t, s) in rows.items()}
    sets = {}
    for i, t in texts.items():
        words = t.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and find(a) != find(b):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    texts = {i: t for i, t in texts.items() if find(i) == i}

    def leaks(text):
        words = decontam.tokens(text)
        for item in bench:
            n = len(item)
            for shift in range(-n + 1, len(words)):
                low, high = max(0, shift), min(len(words), shift + n)
                equal = [words[i] == item[i - shift] for i in range(low, high)]
                if sum(equal) >= 0.8 * min(13, n) and any(
                    sum(equal[a:b]) >= 0.8 * (b - a) for a in range(len(equal)) for b in range(a + min(13, n), len(equal) + 1)
                ):
                    return True
        return False

    return {i: t for i, t in texts.items() if not leaks(t)}


@needs_data
def test_same_as_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit_open(docs)
    bench = [decontam.tokens(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = brute({r.doc_id: (r.text, r.source) for r in docs.collect()}, model, bench)
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == set(want)
    vocabulary, lengths, fill = packing.default_vocabulary(), defaultdict(int), defaultdict(list)
    for r in got:
        lengths[r.doc_id] += r.length
        fill[r.sequence_id].append((r.offset, r.length))
    assert lengths == {i: len(packing.token_ids(t, vocabulary)) for i, t in want.items()}
    for parts in fill.values():
        stops = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == stops[:-1] and stops[-1] <= 2048


def test_each_stage_takes_effect(spark, docs, tmp_path):
    english = "the words of this text are plain and there are many of them here"
    item = " ".join(f"secret{i}" for i in range(20))
    rows = [(i, f"menu of the site\n{english} {' '.join(f'word{i}x{k}' for k in range(40))}", "en", "s") for i in range(60)]
    rows += [(100, rows[7][1], "en", "s"), (101, f"{english} {item} and more words", "en", "s"), (102, "12 34", "en", "s"), (103, None, None, None)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table, d = docs(rows), str(tmp_path)
    step = STAGES["language_id"](spark, table, d)
    assert {r.doc_id for r in step.collect()} == {r[0] for r in rows} - {102, 103}
    step = STAGES["line_dedup"](spark, step, d)
    out = {r.doc_id: r for r in step.collect()}
    assert len(out) == 62 and all("menu" not in r.text and r.n_chars == len(r.text) for r in out.values())
    step = STAGES["near_dedup"](spark, step, d)
    assert {r.doc_id for r in step.collect()} == set(range(60)) | {101}
    assert step.columns == COLUMNS
    step = STAGES["decontaminate"](spark, step, d)
    assert {r.doc_id for r in step.collect()} == set(range(60))
    packed = STAGES["pack"](spark, step, d)
    assert {r.doc_id for r in packed.collect()} == set(range(60))


def test_empty_and_odd_tables(spark, docs, tmp_path):
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = [(None, None), (None, ""), (3, "repeated row of words"), (3, "repeated row of words"), (4, "x " * 20_000)]
    for rows, n in (([], 0), (odd, 2)):
        made = docs(rows)
        made.write.parquet(f"{tmp_path}/in{n}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/in{n}/benchmark.parquet")
        # Without labels no language is known: every document is rejected.
        assert corpus_pipeline.run(spark, f"{tmp_path}/in{n}").count() == 0
        for name, stage in corpus_pipeline.STAGES[1:]:
            made = stage(spark, made, f"{tmp_path}/in{n}")
            assert name == "pack" or made.columns == COLUMNS
        assert made.select("doc_id").distinct().count() == (3 if rows else 0)


def test_intermediate_tables_can_be_released(spark, docs):
    linededup.drop_boilerplate(docs([(1, "x")])).collect()
    assert release(spark) >= 1 and release(spark) == 0
