"""Catalog profiling (A01, A04-A17, A26, A27): one aggregate pass per report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from merchlens.functions import text as tx
from merchlens.functions.stats import pct
from merchlens.operators.quantiles import distinct_counts, exact_quantiles, wide

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _per_column(df: DataFrame, metrics: dict[str, callable]) -> DataFrame:
    """One wide aggregate, then one output row per column."""
    cols = df.columns
    aggs = [
        fn(F.col(f"`{c}`")).alias(f"{i}|{m}") for i, c in enumerate(cols) for m, fn in metrics.items()
    ]
    wide = df.agg(F.count(F.lit(1)).alias("total_rows"), *aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("total_rows"),
                *[F.col(f"`{i}|{m}`").alias(m) for m in metrics],
            )
            for i, c in enumerate(cols)
        ]
    )
    return wide.select(F.inline(rows))


def overview(df: DataFrame, approximate: bool = False) -> DataFrame:
    """A04. Non-null, distinct, smallest and largest value per column; long values are cut when shown.

    Samples are the three smallest distinct values (the reference takes the first
    three, which has no meaning in a distributed table).
    """
    metrics = {
        "non_null": F.count,
        "min_value": lambda c: F.left(F.min(c.cast("string")), F.lit(60)),
        "max_value": lambda c: F.left(F.max(c.cast("string")), F.lit(60)),
    }
    if approximate:
        out = _per_column(df, {**metrics, "distinct_count": F.approx_count_distinct})
    else:
        counts = distinct_counts(df, {c: F.col(f"`{c}`") for c in df.columns})
        out = _per_column(df, metrics).join(counts, "column_name")
    return out.withColumns(
        {
            "null_count": F.col("total_rows") - F.col("non_null"),
            "null_pct": pct(F.col("total_rows") - F.col("non_null"), F.col("total_rows")),
            "distinct_pct": pct(F.col("distinct_count"), F.col("total_rows")),
        }
    )


def column_samples(df: DataFrame, n: int = 3) -> DataFrame:
    """A04 samples. The n smallest distinct values of each column, long strings cut."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v"))
            for c in df.columns
        ]
    )
    shown = F.when(F.length("v") > 60, F.concat(F.left("v", F.lit(57)), F.lit("..."))).otherwise(F.col("v"))
    distinct = df.select(F.inline(pairs)).filter(F.col("v").isNotNull()).distinct()
    ranked = distinct.withColumn("rk", F.row_number().over(W.partitionBy("column_name").orderBy("v")))
    return ranked.filter(F.col("rk") <= n).select("column_name", "rk", shown.alias("sample"))


def missing_values(df: DataFrame) -> DataFrame:
    """A05. NULL, empty, blank and semantic-token counts per column."""
    out = _per_column(
        df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]),
        {
            "null_count": lambda c: F.count_if(c.isNull()),
            "empty_count": lambda c: F.count_if(c == ""),
            "blank_count": lambda c: F.count_if((c != "") & (tx.collapse_space(c) == "")),
            "semantic_count": lambda c: F.count_if(F.lower(tx.collapse_space(c)).isin(*tx.PROFILE_MISSING)),
        },
    )
    total = F.col("null_count") + F.col("empty_count") + F.col("blank_count") + F.col("semantic_count")
    return out.withColumns(
        {"effective_missing": total, "effective_missing_pct": pct(total, F.col("total_rows"))}
    )


def identifier_quality(df: DataFrame, ids: list[str]) -> DataFrame:
    """A06. Uniqueness of each identifier."""
    out = _per_column(
        df.select(*ids),
        {"unique_count": F.count_distinct, "null_count": lambda c: F.count_if(c.isNull())},
    )
    dup = F.col("total_rows") - F.col("unique_count")
    return out.withColumns(
        {
            "duplicate_count": dup,
            "duplicate_pct": pct(dup, F.col("total_rows")),
            "is_key": (F.col("unique_count") == F.col("total_rows")) & (F.col("null_count") == 0),
        }
    )


def mapping_conflicts(df: DataFrame, key: str, other: str) -> DataFrame:
    """A06. Keys that map to more than one value of the other column."""
    pairs = df.select(key, other).dropna().distinct()
    return (
        pairs.groupBy(key)
        .agg(F.count(F.lit(1)).alias("mapped"), F.min(other).alias("first_mapped"))
        .filter(F.col("mapped") > 1)
    )


def duplicates(df: DataFrame, id_col: str, pid: str, name: str, brand: str, price: str) -> DataFrame:
    """A07. Exact, per-key and normalized-product duplicate counts."""
    norm = F.struct(
        F.lower(F.trim(F.coalesce(name, F.lit("")))).alias("n"),
        F.lower(F.trim(F.coalesce(brand, F.lit("")))).alias("b"),
        F.coalesce(F.col(price).cast("string"), F.lit("-1")).alias("p"),
    )
    # A row is there even if all its columns are NULL: only its hash is compared.
    counts = distinct_counts(
        df,
        {
            "exact_duplicate_rows": F.struct(*[F.col(f"`{c}`") for c in df.columns]),
            "duplicate_id": F.col(id_col),
            "duplicate_pid": F.col(pid),
            "duplicate_name": F.col(name),
            "potential_duplicate_products": norm,
        },
    )
    total = df.agg(F.count(F.lit(1)).alias("n"))
    names = ("exact_duplicate_rows", "duplicate_id", "duplicate_pid", "duplicate_name", "potential_duplicate_products")
    return counts.join(F.broadcast(total)).agg(  # one row: the number of rows
        *[F.max(F.when(F.col("column_name") == c, F.col("n") - F.col("distinct_count"))).alias(c) for c in names]
    )


def numeric_stats(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """A08. Count, spread and interpolated percentiles of numeric (or numeric text) columns."""
    nums = df.select([F.col(c).try_cast("double").alias(c) for c in columns])
    stats = _per_column(
        nums,
        {
            "valid_count": F.count,
            "missing_count": lambda c: F.count_if(c.isNull()),
            "min": F.min,
            "max": F.max,
            "mean": lambda c: F.round(F.avg(c), digits),
            "std": lambda c: F.round(F.when(F.count(c) > 1, F.stddev_samp(c)).otherwise(F.lit(0.0)), digits),
        },
    )
    found = wide(_melted_quantiles(nums, list(QUANTILES)), "column_name", {(q, "interpolated"): f"p{int(q * 100)}" for q in QUANTILES})
    rounded = found.select("column_name", *[F.round(c, digits).alias(c) for c in found.columns[1:]])
    return stats.join(rounded, "column_name", "left")


def _melted_quantiles(nums: DataFrame, q: list[float]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in nums.columns])
    return exact_quantiles(nums.select(F.inline(cells)), "column_name", "v", q)


def price_anomalies(df: DataFrame, retail: str, discounted: str) -> DataFrame:
    """A08. Retail against discounted price."""
    r, d = F.col(retail).try_cast("double"), F.col(discounted).try_cast("double")
    amount = F.when((r > 0) & d.isNotNull(), r - d)
    share = amount / r * 100
    stats = [
        F.round(fn(c), 2).alias(f"{name}_{label}")
        for name, c in (("amount", amount), ("pct", share))
        for label, fn in (("mean", F.avg), ("max", F.max), ("min", F.min))
    ]
    medians = wide(
        _melted_quantiles(df.select(amount.alias("amount"), share.alias("pct")), [0.5]), "column_name", {(0.5, "interpolated"): "m"}
    ).agg(*[F.round(F.max(F.when(F.col("column_name") == c, F.col("m"))), 2).alias(f"{c}_median") for c in ("amount", "pct")])
    counts = df.agg(
        F.count_if(d > r).alias("discount_exceeds_retail"),
        F.count_if(r <= 0).alias("non_positive_retail"),
        F.count_if(d <= 0).alias("non_positive_discounted"),
        F.count_if(r.isNull() & d.isNull()).alias("both_missing"),
        F.count_if(r.isNull() & d.isNotNull()).alias("retail_missing_only"),
        F.count_if(d.isNull() & r.isNotNull()).alias("discounted_missing_only"),
        *stats,
    )
    return counts.join(F.broadcast(medians))  # one row each


def rating_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A09. Formats and half-even star histogram of rating columns."""
    num = lambda c: c.try_cast("double")
    stars = {
        f"star_{s}": (lambda s: lambda c: F.count_if(F.bround(num(c), 0) == s))(s) for s in range(1, 6)
    }
    out = _per_column(
        df.select([F.col(c).cast("string").alias(c) for c in columns]),
        {
            "null_count": lambda c: F.count_if(c.isNull()),
            "no_rating_count": lambda c: F.count_if(F.lower(F.trim(c)) == "no rating available"),
            "numeric_count": lambda c: F.count(num(c)),
            "min": lambda c: F.min(num(c)),
            "max": lambda c: F.max(num(c)),
            "mean": lambda c: F.round(F.avg(num(c)), 2),
            "median": lambda c: F.round(F.median(num(c)), 2),
            "below_range": lambda c: F.count_if(num(c) < 0),
            "above_range": lambda c: F.count_if(num(c) > 5),
            **stars,
        },
    )
    return out.withColumn(
        "invalid_format_count",
        F.col("total_rows") - F.col("null_count") - F.col("no_rating_count") - F.col("numeric_count"),
    )


def rating_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """A09. How the two rating columns relate."""
    na, nb = F.col(a).try_cast("double"), F.col(b).try_cast("double")
    sa = F.trim(F.coalesce(F.col(a).cast("string"), F.lit("NULL")))
    sb = F.trim(F.coalesce(F.col(b).cast("string"), F.lit("NULL")))
    return df.agg(
        F.count_if(sa == sb).alias("exact_match"),
        F.count_if(sa != sb).alias("mismatch"),
        F.count_if(na.isNotNull() & nb.isNotNull()).alias("both_numeric"),
        F.count_if(na.isNotNull() & nb.isNull()).alias("only_first"),
        F.count_if(na.isNull() & nb.isNotNull()).alias("only_second"),
        F.count_if(na.isNull() & nb.isNull()).alias("neither"),
    )


def brand_profile(df: DataFrame, brand: str = "brand") -> DataFrame:
    """A10. Coverage, cardinality and case redundancy of the brand column."""
    b = F.col(brand)
    key = F.when(~_blank(b), F.lower(F.trim(b)))
    out = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(b.isNull()).alias("missing_count"),
        F.count_distinct(b).alias("unique_raw"),
        F.count_distinct(key).alias("unique_normalized"),
        F.count_if(b != F.trim(b)).alias("edge_whitespace"),
    )
    return out.withColumns(
        {
            "missing_pct": pct(F.col("missing_count"), F.col("total_rows")),
            "case_redundancy": F.col("unique_raw") - F.col("unique_normalized"),
        }
    )


def top_values(df: DataFrame, column: Column, n: int, name: str = "value") -> DataFrame:
    """K03. The n most frequent non-null values with their share of all rows."""
    counts = df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("total"))
    top = counts.filter(F.col(name).isNotNull()).orderBy(F.desc("cnt"), name).limit(n)
    return top.join(F.broadcast(total)).select(name, "cnt", pct(F.col("cnt"), F.col("total")).alias("pct"))


def description_profile(df: DataFrame, text: str) -> DataFrame:
    """A11. Length and word statistics, short buckets, markup and URL presence."""
    t = F.col(text)
    chars, words = F.length(t), F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    stats = [
        F.round(fn(c), 2).alias(f"{name}_{label}")
        for name, c in (("char", chars), ("word", F.when(t.isNotNull(), words)))
        for label, fn in (
            ("min", F.min),
            ("max", F.max),
            ("mean", F.avg),
            ("p25", lambda c: F.percentile(c, F.lit(0.25))),
            ("p50", lambda c: F.percentile(c, F.lit(0.5))),
            ("p75", lambda c: F.percentile(c, F.lit(0.75))),
            ("p95", lambda c: F.percentile(c, F.lit(0.95))),
        )
    ]
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(t.isNull()).alias("missing_count"),
        F.count_if(t.isNotNull() & (F.trim(t) == "")).alias("empty_count"),
        F.count_if(chars < 20).alias("under_20"),
        F.count_if(chars < 50).alias("under_50"),
        F.count_if(chars < 100).alias("under_100"),
        F.count_if(t.rlike(r"<[a-zA-Z\/][^>]*>")).alias("html_count"),
        F.count_if(t.rlike(r"https?://")).alias("url_count"),
        *stats,
    )


def specification_profile(df: DataFrame, specs: str) -> DataFrame:
    """A12. Coverage, syntax style and parseable share over every row."""
    s = F.col(specs)
    keys = F.regexp_extract_all(s, F.lit(tx.SPEC_KEY_PROBE), F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(s.isNull()).alias("missing_count"),
        F.count_if(F.trim(s) == "").alias("empty_count"),
        F.count_if(s.contains("=>")).alias("arrow_syntax"),
        F.count_if(s.contains('":') & ~s.contains("=>")).alias("colon_syntax"),
        F.count_if(F.size(keys) > 0).alias("parseable"),
        F.sum(F.when(s.isNotNull(), F.size(keys))).alias("keys_total"),
    )


def specification_keys(df: DataFrame, specs: str, n: int = 15) -> DataFrame:
    """A12. Most frequent specification keys."""
    keys = df.select(
        F.explode(F.regexp_extract_all(F.col(specs), F.lit(tx.SPEC_KEY_PROBE), F.lit(1))).alias("k")
    )
    return (
        keys.groupBy(F.trim("k").alias("key"))
        .agg(F.count(F.lit(1)).alias("frequency"))
        .orderBy(F.desc("frequency"), "key")
        .limit(n)
    )


def category_profile(df: DataFrame, tree: str) -> DataFrame:
    """A13. Depth statistics and cardinalities of the breadcrumb column."""
    levels = df.select(F.col(tree).alias("tree"), tx.category_levels(F.col(tree)).alias("lv"))
    depth = F.size("lv")
    return levels.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("tree").isNull()).alias("missing_count"),
        F.count_if((depth == 0) & ~_blank(F.col("tree"))).alias("malformed_count"),
        F.min(depth).alias("min_depth"),
        F.max(depth).alias("max_depth"),
        F.round(F.avg(depth), 2).alias("mean_depth"),
        F.median(depth).alias("median_depth"),
        F.count_distinct(F.try_element_at("lv", F.lit(1))).alias("unique_level_1"),
        F.count_distinct(
            F.when(depth > 0, F.coalesce(F.try_element_at("lv", F.lit(2)), F.lit("(single-level)")))
        ).alias("unique_level_2"),
        F.count_distinct(F.when(depth > 0, F.array_join("lv", " >> "))).alias("unique_paths"),
    )


def category_suitability(df: DataFrame, min_products: int = 50) -> DataFrame:
    """A14. Coverage per level-1 category having enough products."""
    cat = tx.category_level(F.col("product_category_tree"), 1)
    rows = df.withColumn("category", cat)

    def filled(c: str) -> Column:
        return ~_blank(F.col(c))

    def share(cond: Column, name: str) -> Column:
        return pct(F.count_if(cond), F.count(F.lit(1))).alias(name)

    def numeric(c: str) -> Column:
        return F.col(c).try_cast("double").isNotNull()

    out = rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("product_count"),
        share(filled("description"), "description_coverage_pct"),
        F.median(F.length(F.trim("description"))).alias("description_median_length"),
        share(numeric("retail_price"), "retail_price_coverage_pct"),
        share(numeric("discounted_price"), "discounted_price_coverage_pct"),
        share(numeric("product_rating"), "rating_numeric_coverage_pct"),
        share(filled("brand"), "brand_coverage_pct"),
        F.count_distinct(F.trim("brand")).alias("unique_brand_count"),
        share(filled("product_specifications"), "specification_coverage_pct"),
        F.median(F.length(F.trim("product_specifications"))).alias("specification_median_length"),
    )
    return out.filter(F.col("category").isNotNull() & (F.col("product_count") >= min_products))


def category_evaluation(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """A01. Quantitative evidence per category next to its select/reject decision.

    ``decisions`` holds (category, selection_status, selection_reason).
    """
    rows = df.withColumn("category", tx.category_level(F.col("product_category_tree"), 1))
    n = F.count(F.lit(1))

    def share(cond: Column, name: str) -> Column:
        return F.round(F.count_if(cond) * 100.0 / n, 1).alias(name)

    specs = F.col("product_specifications")
    stats = rows.groupBy("category").agg(
        n.alias("product_count"),
        share(F.col("discounted_price").isNotNull(), "price_coverage_pct"),
        share(F.col("brand").isNotNull(), "brand_coverage_pct"),
        share(F.col("description").isNotNull(), "description_coverage_pct"),
        F.median(F.length("description")).alias("description_median_length"),
        F.round(F.count_if(F.trim(specs) != "") * 100.0 / F.nullif(F.count(specs), F.lit(0)), 1).alias(
            "specification_coverage_pct"
        ),
        share(F.col("product_rating").try_cast("double").isNotNull(), "rating_numeric_coverage_pct"),
        F.round((1 - F.count_distinct("product_name") / n) * 100, 1).alias("duplicate_name_rate_pct"),
    )
    total = stats.agg(F.sum("product_count").alias("total"))
    return (
        decisions.join(stats, "category", "left")
        .fillna(0)
        .join(F.broadcast(total))
        .withColumn("dataset_pct", pct(F.col("product_count"), F.col("total")))
        .drop("total")
    )


def selection_summary(evaluation: DataFrame, low: int = 5000, high: int = 15000) -> DataFrame:
    """A01. Selected and rejected totals with the target-range flag."""
    chosen = F.col("selection_status") == "SELECT"
    picked = F.sum(F.when(chosen, F.col("product_count")).otherwise(0))
    return evaluation.agg(
        F.count_if(chosen).alias("selected_categories"),
        F.count_if(~chosen).alias("rejected_categories"),
        picked.alias("selected_products"),
        picked.between(low, high).alias("target_range_met"),
    )


def readiness(df: DataFrame, name: str, description: str, specs: str) -> DataFrame:
    """A15. Availability of the text fields and their combined length."""
    t, d, s = (~_blank(F.col(c)) for c in (name, description, specs))
    length = sum((F.length(F.trim(F.coalesce(c, F.lit("")))) for c in (description, specs)), F.length(F.trim(F.coalesce(name, F.lit("")))))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(t).alias("with_name"),
        F.count_if(d).alias("with_description"),
        F.count_if(s).alias("with_specs"),
        F.count_if(t & d).alias("with_name_description"),
        F.count_if(t & d & s).alias("with_all"),
        F.min(length).alias("len_min"),
        F.max(length).alias("len_max"),
        F.round(F.avg(length), 2).alias("len_mean"),
        *[
            F.round(F.percentile(length, F.lit(q)), 2).alias(f"len_p{int(q * 100)}")
            for q in (0.25, 0.5, 0.75, 0.95)
        ],
    )


def search_text_audit(df: DataFrame, max_chars: int = tx.MAX_DESCRIPTION_CHARS) -> DataFrame:
    """A17. Validity, length and missing-part counts of built search texts."""
    problem = tx.search_text_problem(F.col("retrieval_text"))
    length = F.when(problem.isNull(), F.length("retrieval_text"))
    specs = tx.format_specifications(F.from_json("product_specifications", tx.SPECS_TYPE))
    out = df.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(problem.isNull()).alias("valid_rows"),
        F.count_if(problem.isNotNull()).alias("invalid_rows"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.round(F.avg(length), 2).alias("mean_length"),
        *[
            F.round(F.percentile(length, F.lit(q)), 2).alias(f"p{int(q * 100)}")
            for q in (0.5, 0.9, 0.95, 0.99)
        ],
        F.count_if(F.length(tx.collapse_space(F.col("description"))) > max_chars).alias("truncated_count"),
        F.count_if(tx.is_placeholder(F.col("brand"))).alias("missing_brand"),
        F.count_if(tx.is_placeholder(F.col("description"))).alias("missing_description"),
        F.count_if(specs.isNull()).alias("empty_specs"),
    )
    ok = (F.col("invalid_rows") == 0) & (F.col("valid_rows") == F.col("input_rows"))
    return out.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def token_lengths(df: DataFrame, text: str, limit: int = 512) -> DataFrame:
    """A27. Word-count percentiles and the share of over-long texts."""
    n = F.size(tx.tokens(F.col(text)))
    return df.agg(
        F.count(F.lit(1)).alias("texts"),
        F.min(n).alias("min_tokens"),
        F.max(n).alias("max_tokens"),
        F.round(F.avg(n), 2).alias("mean_tokens"),
        F.percentile(n, F.lit(0.5)).alias("p50"),
        F.round(F.percentile(n, F.lit(0.95)), 2).alias("p95"),
        F.count_if(n > limit).alias("over_limit"),
    )


def readiness_checks(df: DataFrame) -> DataFrame:
    """A26. Cleaned-catalog readiness, one row per check."""
    n = F.count(F.lit(1))
    price = F.col("discounted_price")
    checks = {
        "product_id_present": F.count_if(_blank(F.col("product_id"))),
        "product_id_unique": n - F.count_distinct("product_id"),
        "product_name_present": F.count_if(_blank(F.col("product_name"))),
        "category_present": F.count_if(_blank(F.col("category"))),
        "discounted_price_positive": F.count_if(price.isNull() | (price <= 0)),
        "retail_price_positive": F.count_if(F.col("retail_price") <= 0),
        "rating_in_range": F.count_if(~F.col("rating").between(1, 5)),
        "specs_are_json": F.count_if(
            F.col("product_specifications").isNotNull()
            & F.from_json("product_specifications", tx.SPECS_TYPE).isNull()
        ),
    }
    wide = df.agg(n.alias("checked_rows"), *[c.alias(k) for k, c in checks.items()])
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("check"), F.col("checked_rows"), F.col(k).alias("violations"))
            for k in checks
        ]
    )
    out = wide.select(F.inline(rows))
    return out.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))
