"""Extraction scoring, consistency, taxonomy, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.functions.stats import f1, precision, recall, wilson
from merchlens.functions.text import collapse_space
from merchlens.operators.quantiles import exact_quantiles, wide

# ---------------------------------------------------------------------------
# Fixed values of the scoring policy.
HARD_FIELDS = ("category", "brand", "min_price", "max_price", "min_rating", "currency")
EQUIVALENCES = {
    "with lumbar support": "lumbar support",
    "good battery endurance": "long battery life",
    "good battery life": "long battery life",
    "with safety harness": "safety harness",
}
PRODUCT_NOUNS = (
    "running", "running shoes", "shoes", "sneakers", "boots", "sandals", "dslr lens", "lens", "camera",
    "tablet", "induction cooktop", "shower head", "water softener filter", "fountain pen", "dashboard mount",
    "football studs", "smartwatch", "20kg", "platinum", "pack of 50", "cordless drill", "hanging lights",
)
NOUN_PARTS = ("lens", "tablet", "cooktop", "filter", "mount", "pen", "shoes")
NEGATIONS = ("not ", "no ", "without ", "except ")
GATES = {"validity": 0.80, "hard_f1": 0.85, "brand_accuracy": 0.80}
WEIGHTS = {"soft_f1": 0.40, "strict_exact": 0.30, "hard_f1": 0.20, "brand_accuracy": 0.10}
# ---------------------------------------------------------------------------


def _text(c: Column) -> Column:
    return collapse_space(F.lower(c))


def _atoms(side: str) -> Column:
    """Constraint atoms ``field=value`` of one side; currency defaults to INR."""
    parts = []
    for f in HARD_FIELDS:
        c = F.col(f"{side}.{f}").cast("string")
        v = F.coalesce(c, F.lit("INR")) if f == "currency" else c
        parts.append(F.when(v.isNotNull(), F.concat(F.lit(f"{f}="), _text(v))))
    return F.array_compact(F.array(*parts))


def phrases(c: Column, semantic: bool = False) -> Column:
    """Distinct normalized phrases; ``semantic`` folds the listed equivalences."""
    out = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), _text), lambda p: p != "")
    if semantic:
        table = F.create_map(*[F.lit(x) for kv in EQUIVALENCES.items() for x in kv])
        out = F.transform(out, lambda p: F.coalesce(F.try_element_at(table, p), p))
    return F.array_distinct(out)


def score_cases(df: DataFrame) -> DataFrame:
    """E28. Per case: TP/FP/FN of constraints and preferences, field and exact matches.

    ``df``: case_id, valid, and structs ``actual`` and ``expected`` with the hard
    fields and ``soft_preferences``.  An invalid call earns no empty-set credit.
    """
    none = F.array().cast("array<string>")
    ok = F.col("valid") & F.col("actual").isNotNull()
    sets = df.withColumns(
        {
            "ok": ok,
            "_ah": F.when(ok, _atoms("actual")).otherwise(none),
            "_eh": _atoms("expected"),
            "_as": F.when(ok, phrases(F.col("actual.soft_preferences"))).otherwise(none),
            "_es": phrases(F.col("expected.soft_preferences")),
            "_am": F.when(ok, phrases(F.col("actual.soft_preferences"), True)).otherwise(none),
            "_em": phrases(F.col("expected.soft_preferences"), True),
        }
    )
    out = sets
    for name, a, e in (("hard", "_ah", "_eh"), ("soft", "_as", "_es"), ("semantic", "_am", "_em")):
        out = out.withColumns(
            {
                f"{name}_tp": F.size(F.array_intersect(a, e)),
                f"{name}_fp": F.size(F.array_except(a, e)),
                f"{name}_fn": F.size(F.array_except(e, a)),
            }
        )
    for name in ("hard", "soft", "semantic"):
        tp, fp, fn = (F.col(f"{name}_{x}") for x in ("tp", "fp", "fn"))
        credit = (lambda c: c) if name == "hard" else (lambda c: F.when(F.col("ok"), c).otherwise(0.0))
        out = out.withColumns(
            {
                f"{name}_precision": credit(precision(tp, fp, fn)),
                f"{name}_recall": credit(recall(tp, fp, fn)),
                f"{name}_f1": credit(f1(tp, fp, fn)),
            }
        )
    matches = {}
    for f in HARD_FIELDS:
        a, e = (F.col(f"{s}.{f}").cast("string") for s in ("actual", "expected"))
        if f == "currency":
            a, e = F.coalesce(a, F.lit("INR")), F.coalesce(e, F.lit("INR"))
        matches[f"match_{f}"] = F.col("ok") & _text(a).eqNullSafe(_text(e))
    out = out.withColumns(matches)
    hard_exact = F.col("ok")
    for f in HARD_FIELDS:
        hard_exact = hard_exact & F.col(f"match_{f}")
    soft_exact = F.col("ok") & (F.col("soft_fp") == 0) & (F.col("soft_fn") == 0)
    out = out.withColumns(
        {
            "hard_exact": hard_exact,
            "soft_exact": soft_exact,
            "common_exact": hard_exact & soft_exact,
            "soft_extra": F.array_except("_as", "_es"),
            "soft_missing": F.array_except("_es", "_as"),
        }
    )
    return out.drop("_ah", "_eh", "_as", "_es", "_am", "_em")


def _counts() -> dict[str, Column]:
    """TP/FP/FN over the hard fields; an unexpected INR is the default, not a find."""
    tp = fp = fn = F.lit(0)
    for f in HARD_FIELDS:
        e, a = F.col(f"expected.{f}").cast("string"), F.col(f"actual.{f}").cast("string")
        same = F.coalesce(F.lower(e) == F.lower(a), F.lit(False))
        extra = a.isNotNull() & ~(e.isNull() & (a == "INR") if f == "currency" else F.lit(False))
        tp = tp + F.when(same, 1).otherwise(0)
        fp = fp + F.when(extra & ~same, 1).otherwise(0)
        fn = fn + F.when(e.isNotNull() & ~same, 1).otherwise(0)
    return {"true_positives": tp, "false_positives": fp, "false_negatives": fn}


def _set(c: Column, trim: bool) -> Column:
    lower = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.trim(F.lower(p)) if trim else F.lower(p))
    return F.array_distinct(lower)


def _set_f1(a: Column, e: Column) -> Column:
    """F1 of two sets: both empty is 1, one empty is 0."""
    both = F.size(F.array_intersect(a, e))
    return F.when((F.size(a) == 0) & (F.size(e) == 0), 1.0).otherwise(2.0 * both / (F.size(a) + F.size(e)))


def _field_matches(trim_brand: bool, default_actual: bool) -> dict[str, Column]:
    act, exp = (lambda f: F.col(f"actual.{f}")), (lambda f: F.col(f"expected.{f}"))
    clean = (lambda c: F.trim(F.lower(c))) if trim_brand else F.lower
    currency = F.coalesce(act("currency"), F.lit("INR")) if default_actual else act("currency")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return {
        "category_match": act("category").eqNullSafe(exp("category")),
        "brand_match": clean(act("brand")).eqNullSafe(clean(exp("brand"))),
        "price_match": act("min_price").eqNullSafe(exp("min_price")) & act("max_price").eqNullSafe(exp("max_price")),
        "rating_match": act("min_rating").eqNullSafe(exp("min_rating")),
        "currency_match": currency.eqNullSafe(F.coalesce(exp("currency"), F.lit("INR"))),
        "clarification_match": flag(act("needs_clarification")) == flag(exp("needs_clarification")),
    }


def _all(names) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n)
    return out


def score_fields(df: DataFrame) -> DataFrame:
    """E28, first policy: field matches, field counts and the exact match of all of them.

    ``df``: case_id, valid and structs ``actual`` and ``expected`` with the hard fields,
    needs_clarification and soft_preferences.  Preferences are compared in lower case.
    """
    fields = _field_matches(trim_brand=False, default_actual=False)
    soft = _set_f1(_set(F.col("actual.soft_preferences"), False), _set(F.col("expected.soft_preferences"), False))
    out = df.withColumns({**fields, **_counts(), "soft_f1": F.round(soft, 4)})
    return out.withColumn("exact_match", F.col("valid") & _all(fields))


def score_complete(df: DataFrame) -> DataFrame:
    """E28, second policy: the first one's fields plus everything else an answer holds.

    Adds product type, inclusivity flags (compared where both sides have them), typed
    exclusions and the preference sets; ``strict_exact`` wants all of it, ``legacy_exact``
    the fields alone.
    """
    fields = _field_matches(trim_brand=True, default_actual=True)
    act, exp = (lambda f: F.col(f"actual.{f}")), (lambda f: F.col(f"expected.{f}"))

    def flag_match(f: str) -> Column:
        return act(f).isNull() | exp(f).isNull() | (act(f) == exp(f))

    def typed(side: Column) -> Column:
        entries = F.coalesce(side, F.array().cast("array<struct<target_type:string,value:string>>"))
        return F.array_distinct(
            F.transform(
                entries,
                lambda e: F.concat(F.coalesce(e["target_type"], F.lit("attribute")), F.lit(":"), F.lower(F.coalesce(e["value"], F.lit("")))),
            )
        )

    wanted, given = _set(exp("soft_preferences"), True), _set(act("soft_preferences"), True)
    both = F.size(F.array_intersect(given, wanted))
    kind = exp("product_type").isNull() | F.coalesce(
        F.trim(F.lower(act("product_type"))) == F.trim(F.lower(exp("product_type"))), F.lit(False)
    )
    out = df.withColumns(
        {
            **fields,
            **_counts(),
            "boundary_match": flag_match("min_inclusive") & flag_match("max_inclusive"),
            "product_type_match": kind,
            "soft_precision": F.round(F.coalesce(F.try_divide(both, F.size(given)), F.lit(1.0)), 4),
            "soft_recall": F.round(F.coalesce(F.try_divide(both, F.size(wanted)), F.lit(1.0)), 4),
            "soft_f1": F.round(_set_f1(given, wanted), 4),
            "soft_exact": (F.size(F.array_except(given, wanted)) == 0) & (F.size(F.array_except(wanted, given)) == 0),
            "exclusions_f1": F.round(_set_f1(typed(act("exclusions")), typed(exp("exclusions"))), 4),
        }
    )
    return out.withColumns(
        {"exclusions_match": F.col("exclusions_f1") == 1.0, "legacy_exact": _all(fields)}
    ).withColumn(
        "strict_exact",
        _all(["legacy_exact", "soft_exact", "exclusions_match", "product_type_match", "boundary_match"]),
    )


def summarize(scored: DataFrame, by: list[str]) -> DataFrame:
    """A21 / E29. Micro counts, macro F1, rates with Wilson bounds, field accuracies."""

    def total(c: str) -> Column:
        return F.sum(c)

    n = F.count(F.lit(1))
    aggs = [n.alias("cases")]
    for flag in ("ok", "hard_exact", "soft_exact", "common_exact"):
        aggs.append(F.count_if(F.col(flag)).alias(f"{flag}_count"))
    for g in ("hard", "soft"):
        aggs += [total(f"{g}_{x}").alias(f"{g}_{x}") for x in ("tp", "fp", "fn")]
        aggs.append(F.round(F.avg(f"{g}_f1"), 6).alias(f"{g}_macro_f1"))
    aggs.append(F.round(F.avg("semantic_f1"), 6).alias("semantic_macro_f1"))
    aggs += [F.round(F.avg(F.col(f"match_{f}").cast("double")), 6).alias(f"{f}_accuracy") for f in HARD_FIELDS]
    aggs.append(F.round(F.avg((F.col("hard_fp") > 0).cast("double")), 6).alias("hallucinated_rate"))
    out = scored.groupBy(*by).agg(*aggs)
    low, high = wilson(F.col("common_exact_count"), F.col("cases"))
    return out.withColumns(
        {
            "hard_micro_f1": F.round(f1(F.col("hard_tp"), F.col("hard_fp"), F.col("hard_fn"), None), 6),
            "soft_micro_f1": F.round(f1(F.col("soft_tp"), F.col("soft_fp"), F.col("soft_fn"), None), 6),
            "common_exact_low": F.round(low, 6),
            "common_exact_high": F.round(high, 6),
        }
    )


def consistency(df: DataFrame, key: str, valid: Column, answer: Column) -> DataFrame:
    """E30. Pairwise agreement of repeated answers, from group counts: no pair is formed."""
    counts = df.groupBy(key, F.when(valid, F.sha2(answer, 256)).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(key).agg(
        F.sum("n").alias("samples"),
        F.sum(F.when(F.col("a").isNotNull(), F.col("n") * (F.col("n") - 1) / 2).otherwise(0)).cast("bigint").alias("agreements"),
    )
    pairs = (F.col("samples") * (F.col("samples") - 1) / 2).cast("bigint")
    return out.withColumn("pairs", pairs).withColumn(
        "rate", F.round(F.col("agreements") / F.nullif(F.col("pairs"), F.lit(0)), 6)
    )


def unmatched_cases(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """E31. (key, side) of cases that only one of two systems has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only = lambda x, y, side: x.join(y, key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def paired_outcomes(left: DataFrame, right: DataFrame, key: str, metric: str) -> DataFrame:
    """E31. Per case difference right - left; systems that do not share all cases are refused."""
    wrong = unmatched_cases(left, right, key).groupBy("side").count().collect()
    if wrong:
        raise ValueError(f"unmatched cases: {[(r['side'], r['count']) for r in wrong]}")
    return left.select(key, F.col(metric).cast("double").alias("l")).join(
        right.select(key, F.col(metric).cast("double").alias("r")), key
    ).select(key, (F.col("r") - F.col("l")).alias("delta"))


def win_loss(deltas: DataFrame) -> DataFrame:
    """E31 counts."""
    d = F.col("delta")
    return deltas.agg(
        F.round(F.avg(d), 6).alias("effect"),
        F.count_if(d > 0).alias("wins"),
        F.count_if(d < 0).alias("losses"),
        F.count_if(d == 0).alias("ties"),
    )


def preference_errors(df: DataFrame, inconsistent: Column) -> DataFrame:
    """E32. Classified preference errors, one row each.

    ``df``: case_id, soft_extra (false positives), soft_missing (false negatives),
    arrays of normalized phrases.  A term may fall in several classes, as in the
    reference: missing and extra take what no earlier class attributed.
    """

    def noun(p: Column) -> Column:
        cond = p.isin(*PRODUCT_NOUNS)
        for part in NOUN_PARTS:
            cond = cond | p.contains(part)
        return cond

    def negated(p: Column) -> Column:
        cond = F.lit(False)
        for n in NEGATIONS:
            cond = cond | p.contains(n)
        return cond

    def bare(p: Column) -> Column:
        return F.replace(F.replace(p, F.lit("with "), F.lit("")), F.lit("for "), F.lit(""))

    fps, fns = F.col("soft_extra"), F.col("soft_missing")
    para = lambda p, others: F.exists(others, lambda o: bare(o) == bare(p))
    # The reference takes the first extra phrase for a missing one; order is by text here.
    used = F.transform(
        F.filter(fns, lambda m: para(m, fps)),
        lambda m: F.array_min(F.filter(fps, lambda o: bare(o) == bare(m))),
    )
    union = F.array_union(fps, fns)

    def rows(values: Column, kind: str, severity: str) -> Column:
        return F.transform(
            values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("term"), F.lit(severity).alias("severity"))
        )

    every = F.flatten(
        F.array(
            rows(F.when(inconsistent, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")), "Inconsistent ground truth", "HIGH"),
            rows(F.filter(fns, noun), "Product-type confusion", "HIGH"),
            rows(F.filter(union, negated), "Incorrect negation", "HIGH"),
            rows(F.filter(fns, lambda m: para(m, fps)), "Incorrect paraphrase", "LOW"),
            rows(
                F.filter(fns, lambda m: ~noun(m) & ~negated(m) & ~para(m, fps)), "Missing preference", "MEDIUM"
            ),
            rows(F.filter(fps, lambda p: ~F.array_contains(used, p)), "Extra preference", "MEDIUM"),
        )
    )
    wrong = (F.size(fps) > 0) | (F.size(fns) > 0)
    return (
        df.filter(wrong)
        .select("case_id", F.explode_outer(every).alias("e"))
        .filter(F.col("e").isNotNull())
        .select("case_id", "e.*")
    )


def rank_systems(summary: DataFrame, system: str) -> DataFrame:
    """E33. Eligibility gates and the weighted composite, best first."""
    eligible = F.lit(True)
    for c, floor in GATES.items():
        eligible = eligible & (F.col(c) >= floor)
    composite = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return summary.select(
        system, eligible.alias("eligible"), F.round(composite, 4).alias("composite"), *WEIGHTS
    ).orderBy(F.desc("eligible"), F.desc("composite"), system)


def metric_deltas(recomputed: DataFrame, reported: DataFrame, by: list[str], metrics: list[str], tolerance: float = 1e-6) -> DataFrame:
    """E36. Recomputed against reported values, one row per metric."""
    long = lambda df, name: df.select(
        *by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics]))
    )
    both = long(recomputed, "recomputed").join(long(reported, "reported"), [*by, "metric"], "full_outer")
    delta = F.col("recomputed") - F.col("reported")
    return both.withColumns(
        {"delta": F.round(delta, 6), "matches": F.coalesce(F.abs(delta) <= tolerance, F.lit(False))}
    )


def latency_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """A22. Mean, interpolated p50/p95, nearest-rank p95, extremes; quantiles without one task per group."""
    stats = df.groupBy(by).agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), 4).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    names = {(0.5, "interpolated"): "p50", (0.95, "interpolated"): "p95", (0.95, "nearest"): "p95_nearest"}
    found = wide(exact_quantiles(df, by, value, [0.5, 0.95], [0.95]), by, names).withColumnRenamed(by, "_by")
    return stats.join(found, F.col(by).eqNullSafe(F.col("_by")), "left").select(
        by, "n", "mean", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "p95_nearest", "min", "max"
    )


def usage_rollup(df: DataFrame, request: str, stage: str, tokens: str, price_per_million: float) -> DataFrame:
    """A23. Tokens and cost per request, and their split by stage."""
    return df.groupBy(request).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_distinct(stage).alias("stages"),
        F.sum(tokens).alias("total_tokens"),
        F.round(F.sum(tokens) * price_per_million / 1e6, 8).alias("cost"),
    )
