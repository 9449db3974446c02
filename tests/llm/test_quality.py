import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from merchlens.llm import quality


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


COLUMNS = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()


def test_counts_same_as_brute_force(docs):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "é ä\x0bü\x0c# |\n#\n#\r\n#\r", "  b c"]
    for _ in range(60):
        words = rng.choices("the of and a b c d e f g h i j k ü".split(), k=rng.randint(1, 300))
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t", "# ", "!\n"]) for w in words))
    texts.append("long " * 30_000)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in quality.features(docs(rows)).collect()}
    for i, t in rows:
        assert got[i] == brute_counts(t), (i, t)


def exact_cdf(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 7, 100, 900) for k in {0, 1, n // 300, n // 200, n // 10, n} if k <= n]
    df = spark.createDataFrame(rows, "k long, n long")
    for r in df.withColumn("p", quality.binomial_cdf(F.col("k"), F.col("n"), 0.005)).collect():
        want = exact_cdf(r.k, r.n, 0.005) if r.k < r.n * 0.005 else 1.0
        assert abs(r.p - want) < 1e-9
    large = spark.createDataFrame([(4_900_000, 10**9), (5_001_000, 10**9), (4_999_000, 10**9)], "k long, n long")
    low, high, near = [r.p for r in large.select(quality.binomial_cdf(F.col("k"), F.col("n"), 0.005).alias("p")).collect()]
    assert low < 1e-12 and high == 1.0 and 0.3 < near < 0.5


def counts_table(spark, rows):
    """rows: (doc_id, stratum, n_symbols); all else is a clean text of 1000 words."""
    full = [(i, s, 1000, 5000, n, 0, 0, 0, 10, 40, False) for i, s, n in rows]
    names = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_exclamations long, n_capitals long, n_lines long, base_failed boolean"
    return spark.createDataFrame(full, names)


def test_cutoffs_keep_the_promise(spark):
    rng = random.Random(2)
    rows = [(i, "big", 0 if rng.random() < 0.94 else rng.randint(21, 300)) for i in range(6000)]
    rows += [(10_000 + i, "small", 0) for i in range(100)] + [(11_000 + i, "fair", 0) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows] + [(20_000, 1, 0)], "doc_id long, quality int, toxic int")
    counts = counts_table(spark, rows)
    got = {r.stratum: r.asDict() for r in quality.select_cutoffs(counts, labels).collect()}
    values = [n for _, s, n in rows if s == "big"]
    # All but the symbols are clean: the path ends where the symbols' share is no longer proven.
    want = {}
    for name, cutoff in quality.PATH:
        lost = sum(n > (cutoff if name == "symbols" else want.get("symbols", 10**9)) for n in values)  # of 1000 words: per mille
        if lost >= len(values) * 0.03 or exact_cdf(lost, len(values), 0.03) > quality.DELTA / 3:
            break
        want[name] = cutoff
    assert {r[0]: got["big"][r[0]] for r in quality.RULES} == {r[0]: want.get(r[0]) for r in quality.RULES}
    assert want["symbols"] in (200, 300)
    assert all(got["small"][rule[0]] is None for rule in quality.RULES)  # 100 rows prove nothing
    assert all(got["fair"][rule[0]] == rule[3][-1] for rule in quality.RULES)  # 200 rows without a loss do


def test_toxic_documents_are_not_protected(spark):
    rows = [(i, "a", 300 if i < 40 else 0) for i in range(400)]
    marks = [(i, 1, int(i < 40)) for i, _, _ in rows]
    counts = counts_table(spark, rows)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert quality.select_cutoffs(counts, labels).first().symbols == 20
    kept = quality.judge(counts, quality.select_cutoffs(counts, labels)).filter("kept").count()
    assert kept == 360
    assert quality.select_cutoffs(counts, labels.drop("toxic")).first().symbols == 300


def test_verdicts(spark):
    counts = counts_table(spark, [(1, "a", 400), (2, "a", 100), (3, "b", 999), (4, "none", 0), (4, "none", 0)])
    bounds = ", ".join(f"{r[0]} int" for r in quality.RULES)
    cutoffs = spark.createDataFrame([("a", 300, None, None, None, None, None)], f"stratum string, {bounds}")
    got = sorted((r.doc_id, r.kept, r.failed_rules) for r in quality.judge(counts, cutoffs).collect())
    assert got == [(1, False, ["symbols"]), (2, True, []), (3, True, []), (4, True, []), (4, True, [])]


def test_no_rows_no_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for rows in ([], [(1, "few words", "en"), (None, None, None), (2, "w " * 20 + " ".join(map(str, range(60))), None)]):
        counts = quality.features(docs(rows))
        judged = quality.judge(counts, quality.select_cutoffs(counts, labels)).collect()
        assert len(judged) == len(rows)
        assert all(r.kept == (r.doc_id == 2) for r in judged)


@pytest.mark.parametrize("marks", [[(1, 1), (1, 0)], [(1, None)]])
def test_doubtful_labels_are_not_good(spark, marks):
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    assert quality.select_cutoffs(counts_table(spark, [(1, "a", 0)]), labels).count() == 0
