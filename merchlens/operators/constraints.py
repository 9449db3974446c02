"""Hard-constraint predicates and batch gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from merchlens.functions.text import match_key


class UnresolvedBound(ValueError):
    """A price bound was given without saying whether it is inclusive."""


def literal_filter(
    *,
    category: str | None = None,
    brand: str | None = None,
    min_rating: float | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    min_inclusive: bool | None = None,
    max_inclusive: bool | None = None,
    price: str = "discounted_price",
) -> Column:
    """F01 for one constraint set: literals only, so Catalyst can push it down."""
    cond = F.lit(True)
    for name, value in (("category", category), ("brand", brand)):
        if value is not None:
            if not value.strip():
                raise ValueError(f"{name} filter is blank")
            cond = cond & (F.lower(name) == value.strip().lower())
    if min_rating is not None:
        if not 1 <= min_rating <= 5:
            raise ValueError("minimum rating must be between 1 and 5")
        cond = cond & (F.col("rating") >= min_rating)
    for value, inclusive, lower in ((min_price, min_inclusive, True), (max_price, max_inclusive, False)):
        if value is None:
            if inclusive is not None:
                raise ValueError("inclusivity given without a price bound")
            continue
        if not 0 <= value < float("inf"):
            raise ValueError("price bound must be finite and not negative")
        if inclusive is None:
            raise UnresolvedBound("price bound needs explicit inclusivity")
        p = F.col(price)
        if lower:
            cond = cond & ((p >= value) if inclusive else (p > value))
        else:
            cond = cond & ((p <= value) if inclusive else (p < value))
    return cond


def matches(
    *,
    category: Column,
    brand: Column,
    price: Column,
    rating: Column,
    f_category: Column,
    f_brand: Column,
    f_min_price: Column,
    f_max_price: Column,
    f_min_inclusive: Column,
    f_max_inclusive: Column,
    f_min_rating: Column,
) -> Column:
    """F01 with a constraint set per row: an absent bound passes, a NULL attribute fails.

    A price bound that does not say whether it is inclusive matches nothing; such
    queries belong to the gate (F07).
    """

    def same(a: Column, b: Column) -> Column:
        return b.isNull() | F.coalesce(F.lower(a) == F.lower(b), F.lit(False))

    low = F.when(f_min_inclusive, price >= f_min_price).when(~f_min_inclusive, price > f_min_price)
    high = F.when(f_max_inclusive, price <= f_max_price).when(~f_max_inclusive, price < f_max_price)
    return (
        same(category, f_category)
        & same(brand, f_brand)
        & (f_min_rating.isNull() | F.coalesce(rating >= f_min_rating, F.lit(False)))
        & (f_min_price.isNull() | F.coalesce(low, F.lit(False)))
        & (f_max_price.isNull() | F.coalesce(high, F.lit(False)))
    )


def matches_columns(prefix: str = "") -> Column:
    """``matches`` on the standard column names."""
    names = ("category", "brand", "price", "rating")
    filters = ("category", "brand", "min_price", "max_price", "min_inclusive", "max_inclusive", "min_rating")
    return matches(
        **{n: F.col(f"{prefix}{n}") for n in names}, **{f"f_{n}": F.col(f"f_{n}") for n in filters}
    )


def satisfies_loosely(
    *,
    category: Column,
    brand: Column,
    price: Column,
    rating: Column,
    f_category: Column,
    f_brand: Column,
    f_min_price: Column,
    f_max_price: Column,
    f_min_rating: Column,
) -> Column:
    """F03. Category contained, price skipped when NULL, bounds inclusive."""
    ok_cat = F.coalesce(F.trim(f_category), F.lit("")) == ""
    ok_brand = F.coalesce(F.trim(f_brand), F.lit("")) == ""
    return (
        (ok_cat | F.contains(F.lower(F.coalesce(category, F.lit(""))), F.lower(f_category)))
        & (ok_brand | (F.lower(F.coalesce(brand, F.lit(""))) == F.lower(f_brand)))
        & F.coalesce(price >= f_min_price, F.lit(True))
        & F.coalesce(price <= f_max_price, F.lit(True))
        & (f_min_rating.isNull() | F.coalesce(rating >= f_min_rating, F.lit(False)))
    )


def violation_flags(
    *,
    category: Column,
    brand: Column,
    price: Column,
    rating: Column,
    f_category: Column,
    f_brand: Column,
    f_min_price: Column,
    f_max_price: Column,
    f_min_operator: Column,
    f_max_operator: Column,
    f_min_rating: Column,
    currency: Column,
) -> dict[str, Column]:
    """E14. Violation flags; a missing attribute is reported, never a violation."""

    def differs(a: Column, b: Column) -> Column:
        return F.coalesce(match_key(a) != match_key(b), F.lit(False))

    below = F.when(f_min_operator == ">", price <= f_min_price).otherwise(price < f_min_price)
    above = F.when(f_max_operator == "<", price >= f_max_price).otherwise(price > f_max_price)
    bounded = f_min_price.isNotNull() | f_max_price.isNotNull()
    return {
        "category_violation": differs(category, f_category),
        "brand_violation": differs(brand, f_brand),
        "price_violation": F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False)),
        "rating_violation": F.coalesce(rating < f_min_rating, F.lit(False)),
        "other_violation": F.upper(F.coalesce(currency, F.lit("INR"))) != "INR",
        "missing_evidence": F.array_compact(
            F.array(
                F.when(f_category.isNotNull() & category.isNull(), F.lit("category")),
                F.when(f_brand.isNotNull() & brand.isNull(), F.lit("brand")),
                F.when(bounded & price.isNull(), F.lit("discounted_price")),
                F.when(f_min_rating.isNotNull() & rating.isNull(), F.lit("rating")),
            )
        ),
    }


def gate_status(
    *, needs_clarification: Column, currency: Column, n_exclusions: Column, price_resolved: Column
) -> Column:
    """F07. Terminal status of a query; only SUCCESS rows go on to retrieval."""
    return (
        F.when(needs_clarification, F.lit("CLARIFICATION_REQUIRED"))
        .when(F.upper(F.coalesce(currency, F.lit("INR"))) != "INR", F.lit("UNSUPPORTED_INTENT"))
        .when(n_exclusions > 0, F.lit("UNSUPPORTED_INTENT"))
        .when(~price_resolved, F.lit("CLARIFICATION_REQUIRED"))
        .otherwise(F.lit("SUCCESS"))
    )


def unresolved_bounds(
    *, f_min_price: Column, f_max_price: Column, f_min_inclusive: Column, f_max_inclusive: Column
) -> Column:
    """F07. A price bound without its inclusivity."""
    return (f_min_price.isNotNull() & f_min_inclusive.isNull()) | (f_max_price.isNotNull() & f_max_inclusive.isNull())


def matches_text(
    *,
    category: Column,
    brand: Column,
    price: Column,
    rating: Column,
    f_category: Column,
    f_brand: Column,
    f_min_price: Column,
    f_max_price: Column,
    f_min_operator: Column,
    f_max_operator: Column,
    f_min_rating: Column,
) -> Column:
    """F02 with operator symbols: ``>`` and ``<`` exclude the bound, anything else includes it.

    Names are compared as match keys (repaired, NFC, lower case); a blank filter is none.
    """

    def same(a: Column, b: Column) -> Column:
        key = match_key(b)
        return (F.coalesce(F.trim(key), F.lit("")) == "") | F.coalesce(
            match_key(F.coalesce(a, F.lit(""))) == key, F.lit(False)
        )

    exclusive_low, exclusive_high = f_min_operator.eqNullSafe(F.lit(">")), f_max_operator.eqNullSafe(F.lit("<"))
    low = F.when(exclusive_low, price > f_min_price).otherwise(price >= f_min_price)
    high = F.when(exclusive_high, price < f_max_price).otherwise(price <= f_max_price)
    return (
        same(category, f_category)
        & same(brand, f_brand)
        & (f_min_rating.isNull() | F.coalesce(rating >= f_min_rating, F.lit(False)))
        & (f_min_price.isNull() | F.coalesce(low, F.lit(False)))
        & (f_max_price.isNull() | F.coalesce(high, F.lit(False)))
    )


def eligible_counts(queries: DataFrame, products: DataFrame, width: float = 100.0) -> DataFrame:
    """J15 / E34. Products that satisfy each query's category and price range.

    ``queries``: query_id, f_category, f_min_price, f_max_price (inclusive bounds);
    ``products``: category, price.  A range count is a difference of two running
    counts, so no query meets a product: prices become one cell per (category,
    price), bounds become points between the cells, and the running count is made
    inside price buckets of ``width`` plus one offset per bucket.
    """
    every = F.lit("*")
    cells = (
        products.filter(F.col("price").isNotNull())
        .select(F.explode(F.array(F.lower("category"), every)).alias("category"), "price")
        .groupBy("category", "price")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    q = queries.select(
        "query_id",
        F.coalesce(F.lower("f_category"), every).alias("category"),
        F.col("f_min_price").cast("double").alias("lo"),
        F.coalesce(F.col("f_max_price").cast("double"), F.lit(float("inf"))).alias("hi"),
    )
    # side: 0 before the cells of the same price, 1 the cells, 2 after them.
    bounds = q.select(
        "category",
        F.inline(
            F.array(
                F.struct(F.col("lo").alias("price"), F.lit(0).alias("side")),
                F.struct(F.col("hi").alias("price"), F.lit(2).alias("side")),
            )
        ),
    ).filter(F.col("price").isNotNull() & (F.col("price") < float("inf"))).distinct()
    points = cells.select("category", "price", F.lit(1).alias("side"), "n").unionByName(
        bounds.select("category", "price", "side", F.lit(0).cast("bigint").alias("n"))
    ).withColumn("bucket", F.floor(F.col("price") / width))
    inside = W.partitionBy("category", "bucket").orderBy("price", "side").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    before = W.partitionBy("category").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        points.groupBy("category", "bucket")
        .agg(F.sum("n").alias("in_bucket"))
        .withColumn("offset", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    )
    running = (
        points.withColumn("run", F.sum("n").over(inside))
        .filter(F.col("side") != 1)
        .join(offsets, ["category", "bucket"])
        .select("category", "price", "side", (F.col("run") + F.col("offset")).alias("upto"))
    )
    low = running.filter("side = 0").select("category", F.col("price").alias("lo"), F.col("upto").alias("below"))
    high = running.filter("side = 2").select("category", F.col("price").alias("hi"), F.col("upto").alias("within"))
    totals = cells.groupBy("category").agg(F.sum("n").alias("total"))
    none = F.lit(0)
    return (
        q.join(low, ["category", "lo"], "left")
        .join(high, ["category", "hi"], "left")
        .join(totals, "category", "left")
        .select(
            "query_id",
            F.greatest(
                none,
                F.coalesce("within", "total", none) - F.coalesce("below", none),
            ).alias("eligible"),
        )
    )


def verify_candidates(candidates: DataFrame, violates: Column, finite: Column) -> DataFrame:
    """F08. A query fails as a whole when any of its candidates is unusable."""
    return candidates.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(violates).alias("violations"),
        F.count_if(~finite).alias("not_finite"),
        (~F.bool_or(violates | ~finite)).alias("usable"),
    )
