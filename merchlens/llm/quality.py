"""Quality rules with risk-controlled thresholds.

Each rule compares a ratio of a text with a cutoff from a ladder that runs from lenient
to strict.  All rules together are a vector of cutoffs, and PATH leads from no rule at all
to the strictest of each, one ladder step of one rule at a time.  Labelled documents of
good quality are the holdout: per stratum the path is walked as long as an exact binomial
test shows that at most FALSE_REJECTIONS of the good documents fail any rule.  Walking a
fixed path and stopping at the first failure needs no correction for its length; the
level is divided by the number of strata.  So with probability 1 - DELTA no stratum loses
more than that share of its good documents, all rules taken together.  About 140 to 200 good labels
are needed to prove a first step; a stratum with fewer gets no cutoff.

Ratios are compared in whole numbers (per mille), so results do not depend on
rounding or on how rows are split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm.registry import query, read
from merchlens.session import cut_lineage

WORDS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
FALSE_REJECTIONS = 0.03
DELTA = 0.05
MIN_WORDS = 50

# Rule, numerator, denominator, cutoffs in per mille from lenient to strict.
RULES = [
    ("symbols", "n_symbols", "n_words", [1000, 500, 300, 200, 100, 50, 20]),
    ("exclamations", "n_exclamations", "n_words", [1000, 500, 300, 200, 100, 50, 20]),
    ("capitals", "n_capitals", "word_chars", [500, 400, 300, 200, 150, 100, 60]),
    ("repeated_words", "n_repeat_words", "n_words", [400, 300, 200, 150, 100, 50]),
    ("repeated_lines", "n_dup_lines", "n_lines", [500, 400, 300, 200, 100, 50]),
    ("long_words", "word_chars", "n_words", [12000, 10000, 9000, 8000, 7500, 7000, 6500, 6000]),
]
# (rule, cutoff) that each step of the path tightens: every rule in turn, ladder step by ladder step.
PATH = [
    (rule[0], rule[3][i]) for i in range(max(len(r[3]) for r in RULES)) for rule in RULES if i < len(rule[3])
]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, counts ...), one row per row of ``docs``, over whole texts.

    Null text counts as empty, a null stratum as ``none``.  Windows of three words are
    compared by a 64-bit hash of the words; repeated ones are found by sorting them
    within the row, so nothing is shuffled.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("none")).alias("stratum"),
        body.alias("body"),
        F.array_remove(F.split(body, WORDS), "").alias("words"),
    )
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("words")
    window = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    counted = base.select(
        "doc_id",
        "stratum",
        n.cast("bigint").alias("n_words"),
        F.length(_without(F.col("body"), " \t\n\x0b\x0c\r")).cast("bigint").alias("word_chars"),
        (F.length("body") - F.length(_without(F.col("body"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.length("body") - F.length(F.replace("body", F.lit("!"), F.lit("")))).cast("bigint").alias("n_exclamations"),
        F.length(F.regexp_replace("body", r"[^\p{Lu}]+", "")).cast("bigint").alias("n_capitals"),
        lines.alias("lines"),
        F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    distinct = F.size(F.array_distinct("windows"))
    # Only texts that repeat a window need its places.
    placed = F.when(
        distinct < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    sorted_ = counted.withColumn("placed", placed)
    again = F.filter(
        "placed",
        lambda x, k: (x.h == F.get("placed", k - 1).h) | (x.h == F.get("placed", k + 1).h),
    )
    found = sorted_.withColumn("at", F.array_sort(F.transform(again, lambda x: x.i)))
    # A window covers three words, or as many as there are to the next repeated one.
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    return found.select(
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).alias("n_repeat_words"),
        "n_exclamations",
        "n_capitals",
        F.size("lines").cast("bigint").alias("n_lines"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    )


def _log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series at x + 9, accurate to 12 digits."""
    z = x.cast("double") + 9.0
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    log = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series
    for k in range(1, 9):
        log = log - F.ln(x + float(k))
    return log


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n draws with probability p.

    The sum starts 20 standard deviations and 50 below k: where the tests here decide (k below
    n p) what lies under that is under 1e-30, and the sum stays short for any n.
    """
    low = F.greatest(F.lit(0), F.floor(k - 20 * F.sqrt(n * p) - 50).cast("bigint"))

    def term(j):
        log = _log_factorial(n) - _log_factorial(j) - _log_factorial(n - j)
        return F.exp(log + j * math.log(p) + (n - j) * math.log1p(-p))

    total = F.aggregate(F.sequence(low, k), F.lit(0.0), lambda a, j: a + term(j))
    # Above the mean the sum is over a half: no level is that large.
    return F.when(k < n * p, total).otherwise(F.lit(1.0))


def _rejects(rule: tuple, cutoff: Column) -> Column:
    _, top, bottom, _ = rule
    return F.coalesce(1000 * F.col(top) > cutoff * F.col(bottom), F.lit(False))


def first_failure() -> Column:
    """The step of PATH at which a document starts to fail; null if it never does.

    Ladders fall, so whoever fails at a step fails at all later ones.
    """
    rule = {r[0]: r for r in RULES}
    return F.least(*[F.when(_rejects(rule[name], F.lit(cutoff)), F.lit(t)) for t, (name, cutoff) in enumerate(PATH)])


def select_cutoffs(
    counts: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    good: str = "quality",
    bad: str = "toxic",
    allowed: float = FALSE_REJECTIONS,
    delta: float = DELTA,
) -> DataFrame:
    """(stratum, one column per rule): the cutoffs in per mille at the end of the proven path, null if none.

    ``counts`` are `features`.  Good documents are those whose ``good`` labels are all 1,
    whose ``bad`` labels are all 0 or null (where there is such a column) and that pass the
    base rules.  Rows are counted, with partial sums, before anything moves; what
    follows has one row per stratum and step.
    """
    harmful = F.max(F.coalesce(F.col(f"`{bad}`"), F.lit(0))) if bad in labels.columns else F.lit(0)
    marks = labels.groupBy(F.col(f"`{doc_id}`").alias("doc_id")).agg(
        F.min(F.col(f"`{good}`")).alias("good"), harmful.alias("harmful")
    )
    clean = counts.filter(~F.col("base_failed")).join(marks.filter("good = 1 and harmful = 0"), "doc_id")
    lost = [F.count_if(F.col("first") <= t).alias(f"lost_{t}") for t in range(len(PATH))]
    failing = clean.select("stratum", first_failure().alias("first"))
    seen = cut_lineage(failing.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *lost))
    level = delta / max(seen.count(), 1)
    steps = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"lost_{t}").alias("k")) for t in range(len(PATH))])
    tests = seen.select("stratum", "n", F.inline(steps))
    proven = tests.select("stratum", "t", (binomial_cdf(F.col("k"), F.col("n"), allowed) <= level).alias("proven"))
    stops = proven.groupBy("stratum").agg(
        F.coalesce(F.min(F.when(~F.col("proven"), F.col("t"))), F.lit(len(PATH))).alias("stop")
    )
    # A rule stands at the last cutoff that the path set before the stop.
    standing = {
        name: F.least(*[F.when(F.lit(t) < F.col("stop"), F.lit(c)) for t, (n, c) in enumerate(PATH) if n == name])
        for name, *_ in RULES
    }
    return stops.select("stratum", *[c.alias(name) for name, c in standing.items()])


def judge(counts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``counts`` with ``kept`` and ``failed_rules`` (array of names): base rules, then the proven cutoffs.

    A row of a stratum without cutoffs is kept if it passes the base rules.  Cutoffs are
    one row per stratum and joined by their size.
    """
    known = cutoffs.select("stratum", *[F.col(rule[0]).alias(f"__{rule[0]}") for rule in RULES])
    failed = F.filter(
        F.array(*[F.when(_rejects(r, F.col(f"__{r[0]}")), F.lit(r[0])) for r in RULES]),
        lambda x: x.isNotNull(),
    )
    return (
        counts.join(known, "stratum", "left")
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .select(*counts.columns, "kept", "failed_rules")
    )


def _sql() -> str:
    ratio = {name: (top, bottom) for name, top, bottom, _ in RULES}
    first = ", ".join(
        f"CASE WHEN 1000 * {ratio[name][0]} > {c} * {ratio[name][1]} THEN {t} END" for t, (name, c) in enumerate(PATH)
    )
    path = ", ".join(f"('{name}', {c}, {t})" for t, (name, c) in enumerate(PATH))
    fails = " OR ".join(
        f"coalesce(1000 * {top} > (SELECT cutoff FROM chosen c WHERE c.stratum = f.stratum AND rule = '{name}') * {bottom}, false)"
        for name, top, bottom, _ in RULES
    )
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'none') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3),
dup AS (SELECT doc_id, i FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, i AS p FROM dup UNION ALL SELECT doc_id, i + 1 FROM dup UNION ALL SELECT doc_id, i + 2 FROM dup) GROUP BY doc_id),
f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
    SELECT d.doc_id, stratum, len(w) AS n_words, length(regexp_replace(t, '{WORDS}', '', 'g')) AS word_chars,
           length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
           coalesce(rep.n, 0) AS n_repeat_words, length(t) - length(replace(t, '!', '')) AS n_exclamations,
           length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals, len(l) AS n_lines
    FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id)),
good AS (SELECT f.* FROM f JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(coalesce(toxic, 0)) = 0) g
  ON f.doc_id = g.doc_id WHERE NOT base_failed),
fp AS (SELECT stratum, least({first}) AS first FROM good),
path(rule, cutoff, t) AS (VALUES {path}),
loss AS (SELECT stratum, t, count(*) FILTER (WHERE first <= t) AS k, count(*) AS n FROM fp, (SELECT t FROM path) GROUP BY stratum, t),
cdf AS (
  SELECT stratum, t,
         CASE WHEN k < n * {FALSE_REJECTIONS!r} THEN list_sum(list_transform(generate_series(0, k), lambda j: exp(
           lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({FALSE_REJECTIONS!r}) + (n - j) * ln(1 - {FALSE_REJECTIONS!r})))) ELSE 1.0 END AS p
  FROM loss),
stops AS (
  SELECT stratum, coalesce(min(t) FILTER (WHERE p > {DELTA!r} / (SELECT count(DISTINCT stratum) FROM fp)), {len(PATH)}) AS stop
  FROM cdf GROUP BY stratum),
chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM stops JOIN path ON t < stop GROUP BY stratum, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT ({fails}) AS kept
FROM f
"""


@query("op7_quality_rules", _sql())
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; cutoffs come from all labelled documents."""
    counts = cut_lineage(features(read(spark, sf_dir, "documents")))
    judged = judge(counts, select_cutoffs(counts, read(spark, sf_dir, "labels")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
