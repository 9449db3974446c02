import random

import pytest

import corpus_pipeline
from merchlens.llm import linededup


def brute(rows, ratio, least):
    pages, on = {}, {}
    blank = " \t\r\x0b\x0c"
    for _, text, _, host in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip(blank) for x in (text or "").split("\n")} - {""}:
            on[host, line] = on.get((host, line), 0) + 1
    bad = {k for k, n in on.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, text, _, host in rows:
        lines = None if text is None else text.split("\n")
        kept = lines and [x for x in lines if (host, x.strip(blank)) not in bad]
        out.append((i, None if text is None else "\n".join(kept), len(lines or []) - len(kept or [])))
    return sorted(out, key=str)


def rows_of(n):
    rng = random.Random(n)
    out = []
    for i in range(n):
        host = rng.choice(["a", "a", "a", "b", None])
        lines = [rng.choice(["  menu ", "menu", "top\t", "", f"line {i}", f"pair {i // 2}"]) for _ in range(rng.randint(0, 6))]
        out.append((i, None if i % 11 == 3 else "\n".join(lines), None, host))
    return out


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_same_as_brute_force(docs, monkeypatch, broadcast):
    monkeypatch.setattr(linededup, "BROADCAST_HASHES", broadcast)
    monkeypatch.setattr(linededup, "ROWS_PER_SPLIT", 10)
    rows = rows_of(120)
    got = linededup.drop_boilerplate(docs(rows), ratio=0.1, min_pages=4, dropped="n_lost")
    assert sorted(((r.doc_id, r.text, r.n_lost) for r in got.collect()), key=str) == brute(rows, 0.1, 4)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lost"]


def test_ratio_is_of_the_site(docs):
    rows = [(i, "shared\nown %d" % i, None, "small") for i in range(10)]
    rows += [(100 + i, ("shared\n" if i < 10 else "") + f"text {i}", None, "large") for i in range(600)]
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(docs(rows)).collect()}
    assert got[3] == "own 3"  # on all pages of the small site
    assert got[103] == "shared\ntext 3"  # on 10 of 600 pages of the large one


def test_edges(docs):
    assert linededup.drop_boilerplate(docs([])).count() == 0
    copies = [(1, "only line", None, "s")] * 5  # repeated rows are pages of their own, unless copies count once
    assert [r.text for r in linededup.drop_boilerplate(docs(copies)).collect()] == [""] * 5
    assert [r.text for r in linededup.drop_boilerplate(docs(copies), copies_once=True).collect()] == ["only line"] * 5
    blank = [(i, "\n \n", None, None) for i in range(6)]
    assert {r.text for r in linededup.drop_boilerplate(docs(blank)).collect()} == {"\n \n"}
    clash = docs([(1, "x", None, "s")]).withColumnRenamed("lang", "lines").withColumnRenamed("n_chars", "hashes")
    assert linededup.drop_boilerplate(clash).columns == ["doc_id", "text", "lines", "source", "hashes"]


def test_a_large_group_of_copies_keeps_one_in_the_pipeline(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    text = lambda name: "menu\n" + "\n".join(f"{name} line {k} of the page" for k in range(8))
    rows = [(i, text("copied"), None, "s") for i in range(40)] + [(40 + i, text("other"), None, "s") for i in range(40)]
    rows += [(100 + i, text(f"own{i}"), None, "s") for i in range(20)]
    cleaned = stages["line_dedup"](spark, docs(rows), "")
    assert {r.text for r in cleaned.collect()} == {t.removeprefix("menu\n") for _, t, _, _ in rows}
    kept = stages["near_dedup"](spark, cleaned, "")
    assert {r.doc_id: r.text for r in kept.collect()} == {
        i: t.removeprefix("menu\n") for i, t, _, _ in rows if i in (0, 40) or i >= 100
    }


def test_query_leaves_no_copies_empty(spark, docs, tmp_path):
    rows = [(i, "same text\nin two lines", "en", "s") for i in range(50)] + [(100 + i, f"menu\nown {i}", "en", "s") for i in range(20)]
    rows += [(200 + i, None, "en", "s") for i in range(30)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.op10_line_dedup(spark, str(tmp_path)).collect()}
    want = {i: (t and t.removeprefix("menu\n"), int(bool(t) and t.startswith("menu"))) for i, t, _, _ in rows}
    assert got == want
