import hashlib

import pytest

from merchlens.llm import fim


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) straight from the definition."""
    text = text or ""
    x = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


ROWS = [(i, ("a<b" * (i % 5) + "é😀\n" * (i % 7) + "<" * (i % 3) + f"text {i} S> P> M> " * (i % 11))) for i in range(300)]
ROWS += [(None, "no id"), (None, None), (7, "repeated"), (7, "repeated"), (400, ""), (401, "has <S> in it"), (402, "x" * 50_000)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 2, 3, 8192])
def test_same_as_brute_force_at_any_chunk(docs, size):
    rows = ROWS if size == 8192 else [(i, t and t[:200]) for i, t in ROWS]
    key = str
    got = sorted((tuple(r) for r in fim.digests(docs(rows), size=size).collect()), key=key)
    want = sorted(((i, *brute(i, t)[:4], sha(brute(i, t)[4]), sha(t or "")) for i, t in rows), key=key)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_and_exact_round_trip(docs):
    made = fim.fill_in_middle(docs(ROWS), size=5)
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(str((i, *brute(i, t))) for i, t in ROWS)
    back = fim.restore(made.select("doc_id", "form", "output"), size=3)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((i, t or "")) for i, t in ROWS)


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_markers_across_piece_edges(form):
    texts = {fim.PREFIX: "<<P", fim.MIDDLE: "", fim.SUFFIX: ">M><"}
    output = "".join(fim.MARKERS[p] + texts[p] for p in fim.ORDERS[form])
    for size in range(1, len(output) + 1):
        found = dict.fromkeys(texts, "")
        for part, at, piece in fim.parts_of(form, [output[i : i + size] for i in range(0, len(output), size)]):
            assert at == len(found[part])
            found[part] += piece
        assert found == texts


def test_empty_table_and_clashing_columns(docs):
    assert fim.digests(docs([])).count() == 0 and fim.restore(fim.fill_in_middle(docs([]))).count() == 0
    clash = docs([(1, "some text")]).withColumnRenamed("lang", "row").withColumnRenamed("source", "output")
    assert fim.fill_in_middle(clash).first().output == brute(1, "some text")[4]


def test_query(spark, docs, tmp_path):
    docs(ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    got = fim.op11_fill_in_middle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert got.count() == len(ROWS)
