"""Catalog cleaning and profiling queries over the derived raw catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlens.functions import text as tx
from merchlens.operators import catalog as cat
from merchlens.operators import constraints as cs
from merchlens.operators import profile as pf
from merchlens.plans.derived import load
from merchlens.plans.registry import query
from merchlens.session import shared_folder
from merchlens.sources import readers, sinks

# The cleaning steps as SQL, shared by the twins below.
_WS = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_NUM = "CASE WHEN TRY_CAST({0} AS DOUBLE) > 0 AND isfinite(TRY_CAST({0} AS DOUBLE)) THEN round(TRY_CAST({0} AS DOUBLE), 2) END"
_BRAND = f"CASE WHEN lower({_WS.format('brand')}) NOT IN ('none','nan','null','') THEN {_WS.format('brand')} END"
_LEVELS = """list_filter(list_transform(string_split(regexp_extract(product_category_tree, '^\\["(.*)"\\]$', 1), '>>'), lambda x: trim(x)), lambda x: x <> '')"""
_TEXT = "CASE WHEN lower({0}) NOT IN ('none','nan','null','') THEN {0} END"
_CLEAN_TEXT = "trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_RATING1 = "CASE WHEN TRY_CAST({0} AS DOUBLE) BETWEEN 1 AND 5 THEN round(TRY_CAST({0} AS DOUBLE),2) END"

_CANON = f"""
SELECT brand_key, variant AS canonical, variants, uses FROM (
  SELECT *, row_number() OVER (PARTITION BY brand_key ORDER BY cnt DESC, mixed DESC, variant) AS rn,
         count(*) OVER (PARTITION BY brand_key) AS variants, sum(cnt) OVER (PARTITION BY brand_key) AS uses
  FROM (SELECT lower(b) AS brand_key, b AS variant, count(*) AS cnt,
               (regexp_matches(b, '[A-Z]') AND regexp_matches(b, '[a-z]')) AS mixed
        FROM (SELECT {_BRAND} AS b FROM {{src}}) WHERE b IS NOT NULL GROUP BY b)) WHERE rn = 1
"""

_VALID = f"""
SELECT r.*, {_LEVELS}[1] AS cat1 FROM {{raw_catalog}} r
"""

_PREPARED = f"""
SELECT v.*, trim(cat1) AS category, coalesce(c.canonical, v.b) AS brand_norm, {_NUM.format('discounted_price')} AS dp,
       {_NUM.format('retail_price')} AS rp, coalesce({_RATING1.format('product_rating')}, {_RATING1.format('overall_rating')}) AS rating,
       {_TEXT.format(_CLEAN_TEXT.format('product_name'))} AS name_clean,
       {_TEXT.format(_CLEAN_TEXT.format('description'))} AS desc_clean,
       regexp_extract(product_specifications, '"key"=>"Size", "value"=>"([^"]*)"', 1) AS s_size,
       lower(regexp_extract(product_specifications, '"key"=>"Finish", "value"=>"([^"]*)"', 1)) AS s_finish,
       regexp_extract(product_specifications, '"key"=>"Batch", "value"=>([0-9]+)', 1) AS s_batch
FROM (SELECT *, {_BRAND} AS b FROM ({_VALID}) WHERE uniq_id IS NOT NULL AND product_name IS NOT NULL AND cat1 IS NOT NULL
      AND {_NUM.format('discounted_price')} IS NOT NULL) v
LEFT JOIN ({_CANON.replace('{src}', f"(SELECT brand FROM ({_VALID}) WHERE uniq_id IS NOT NULL AND product_name IS NOT NULL AND cat1 IS NOT NULL AND {_NUM.format('discounted_price')} IS NOT NULL)")}) c
ON lower(v.b) = c.brand_key
"""

# Every listing either has all three spec keys or none, so two spec maps conflict
# exactly when they differ and both are filled.
_KEPT = f"""
SELECT uniq_id FROM (
  SELECT *, first_value(spec) OVER (PARTITION BY k1,k2,k3,dp ORDER BY ln DESC, ns DESC, uniq_id) AS head,
         row_number() OVER (PARTITION BY k1,k2,k3,dp ORDER BY ln DESC, ns DESC, uniq_id) AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY k1,k2,k3,dp,spec ORDER BY ln DESC, ns DESC, uniq_id) AS dup
        FROM (SELECT uniq_id, lower(name_clean) AS k1, lower(coalesce(brand_norm,'')) AS k2, category AS k3, dp,
                     length(coalesce(desc_clean,'')) AS ln,
                     CASE WHEN coalesce(s_size,'') <> '' THEN s_size || '|' || s_finish || '|' || s_batch ELSE '' END AS spec,
                     CASE WHEN coalesce(s_size,'') <> '' THEN 3 ELSE 0 END AS ns FROM ({_PREPARED})))
  WHERE dup = 1)
WHERE pos = 1 OR (spec <> '' AND head <> '')
"""


def _raw(spark, d):
    return load(spark, d, "raw_catalog").withColumn(
        "_level1_category", tx.category_level(F.col("product_category_tree"), 1)
    )


@query("clean_prices", f"SELECT uniq_id, {_NUM.format('discounted_price')} AS discounted, {_NUM.format('retail_price')} AS retail FROM {{raw_catalog}}")
def clean_prices(spark, d):
    """P02."""
    return load(spark, d, "raw_catalog").select(
        "uniq_id",
        tx.clean_price(F.col("discounted_price")).alias("discounted"),
        tx.clean_price(F.col("retail_price")).alias("retail"),
    )


@query("normalize_ratings", f"SELECT uniq_id, coalesce({_RATING1.format('product_rating')}, {_RATING1.format('overall_rating')}) AS rating FROM {{raw_catalog}}")
def normalize_ratings(spark, d):
    """P03."""
    return load(spark, d, "raw_catalog").select(
        "uniq_id", tx.normalize_rating(F.col("product_rating"), F.col("overall_rating")).alias("rating")
    )


@query("brand_canonical", f"SELECT brand_key, canonical, cast(variants AS BIGINT) AS variants, cast(uses AS BIGINT) AS uses FROM ({_CANON.replace('{src}', '{raw_catalog}')})")
def brand_canonical(spark, d):
    """A02."""
    return cat.brand_canonical(load(spark, d, "raw_catalog"))


@query(
    "parse_specifications",
    """SELECT uniq_id, cast(CASE WHEN product_specifications LIKE '%"key"%' THEN 3 ELSE 0 END AS INT) AS n_specs,
       CASE WHEN product_specifications LIKE '%"key"%' THEN regexp_extract(product_specifications, '"Size", "value"=>"([^"]*)"', 1) END AS size,
       CASE WHEN product_specifications LIKE '%"key"%' THEN lower(regexp_extract(product_specifications, '"Finish", "value"=>"([^"]*)"', 1)) END AS finish,
       CASE WHEN product_specifications LIKE '%"key"%' THEN 'Size: ' || regexp_extract(product_specifications, '"Size", "value"=>"([^"]*)"', 1)
         || '; Finish: ' || regexp_extract(product_specifications, '"Finish", "value"=>"([^"]*)"', 1)
         || '; Batch: ' || regexp_extract(product_specifications, '"Batch", "value"=>([0-9]+)', 1) END AS flat
       FROM {raw_catalog}""",
)
def parse_specifications(spark, d):
    """P05, P06, P08."""
    specs = load(spark, d, "raw_catalog").select(
        "uniq_id", tx.parse_specifications(F.col("product_specifications")).alias("s")
    )
    m = specs.withColumn("m", tx.specs_map(F.col("s")))
    return m.select(
        "uniq_id",
        F.size("s").alias("n_specs"),
        F.try_element_at("m", F.lit("size")).alias("size"),
        F.try_element_at("m", F.lit("finish")).alias("finish"),
        tx.format_specifications(F.col("s")).alias("flat"),
    )


@query(
    "category_levels",
    f"""SELECT uniq_id, cast(coalesce(len({_LEVELS}),0) AS INT) AS depth, {_LEVELS}[1] AS level_1, {_LEVELS}[2] AS level_2 FROM {{raw_catalog}}""",
)
def category_levels(spark, d):
    """P07."""
    lv = load(spark, d, "raw_catalog").select(
        "uniq_id", tx.category_levels(F.col("product_category_tree")).alias("lv")
    )
    return lv.select(
        "uniq_id",
        F.size("lv").alias("depth"),
        F.try_element_at("lv", F.lit(1)).alias("level_1"),
        F.try_element_at("lv", F.lit(2)).alias("level_2"),
    )


_UNESC = "replace(replace(replace(replace(html,'&middot;','·'),'&copy;','©'),'&quot;','\"'),'&amp;','&')"


@query(
    "clean_html",
    f"""SELECT page_id, CASE WHEN lower(t) NOT IN ('none','nan','null','') THEN t END AS text FROM (
        SELECT page_id, trim(regexp_replace(regexp_replace({_UNESC}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)""",
)
def clean_html(spark, d):
    """P01 over whole raw pages."""
    return load(spark, d, "pages").select("page_id", tx.clean_text(F.col("html")).alias("text"))


@query(
    "url_sanitize",
    """SELECT page_id AS id, CASE WHEN regexp_matches(trim(url), '^(?i:https?)://[^/?#\\s]+') THEN trim(url) END AS url FROM pages
       UNION ALL SELECT l_partkey AS id, CASE WHEN l_linestatus = 'F' THEN 'http://img.example.com/' || cast(l_partkey AS string) || '.jpg' END AS url FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
)
def url_sanitize(spark, d):
    """P13, on page URLs and on JSON lists of image URLs."""
    pages = load(spark, d, "pages").select(F.col("page_id").alias("id"), tx.sanitize_url(F.col("url")).alias("url"))
    images = load(spark, d, "raw_catalog").select(
        F.split("pid", "/")[0].cast("bigint").alias("id"),
        tx.first_url(F.to_json(F.array(F.lit("ftp://x"), F.col("image")))).alias("url"),
    )
    return pages.unionByName(images)


@query(
    "boilerplate_free",
    """SELECT uniq_id, CASE WHEN description LIKE '%Free Shipping%' THEN trim(replace(replace(description, 'Free Shipping.', ''), '  ', ' '))
         ELSE trim(regexp_replace(description, '\\s+', ' ', 'g')) END AS text FROM {raw_catalog}""",
)
def boilerplate_free(spark, d):
    """P14."""
    return load(spark, d, "raw_catalog").select(
        "uniq_id", tx.strip_boilerplate(F.col("description")).alias("text")
    )


@query("catalog_kept_ids", _KEPT)
def catalog_kept_ids(spark, d):
    """A03 inside P17: ids that survive conservative deduplication."""
    return cat.dedup_keys(cat.prepare(_raw(spark, d))).withColumnRenamed("id", "uniq_id")


@query(
    "clean_catalog",
    f"""SELECT p.uniq_id AS product_id, name_clean AS product_name, category, brand_norm AS brand, rp AS retail_price, dp AS discounted_price, rating, desc_clean AS description,
        CASE WHEN coalesce(s_size,'') = '' THEN '[]' ELSE '[{{"key":"Size","value":"' || s_size || '"}},{{"key":"Finish","value":"' || upper(s_finish)
          || '"}},{{"key":"Batch","value":"' || s_batch || '"}}]' END AS product_specifications
        FROM ({_PREPARED}) p JOIN ({_KEPT}) k ON p.uniq_id = k.uniq_id""",
)
def clean_catalog(spark, d):
    """P17, F04, P04."""
    return cat.clean_catalog(_raw(spark, d)).select(
        "product_id", "product_name", "category", "brand", "retail_price", "discounted_price",
        "rating", "description", "product_specifications",
    )


@query(
    "cleaning_counts",
    f"""SELECT count(*) AS input_rows, count(*) FILTER (uniq_id IS NULL) AS missing_id, count(*) FILTER (product_name IS NULL) AS missing_title,
        count(*) FILTER (cat1 IS NULL) AS missing_category, count(*) FILTER (dp IS NULL) AS invalid_price,
        count(*) FILTER (ok AND cat1 NOT IN ('ECONOMY','LARGE','PROMO')) AS unexpected_categories,
        count(*) FILTER (ok AND cat1 IN ('ECONOMY','LARGE','PROMO')) AS valid_rows
        FROM (SELECT *, uniq_id IS NOT NULL AND product_name IS NOT NULL AND cat1 IS NOT NULL AND dp IS NOT NULL AS ok
              FROM (SELECT *, {_NUM.format('discounted_price')} AS dp FROM ({_VALID})))""",
)
def cleaning_counts(spark, d):
    """P17 step counts, F04, F05."""
    return cat.removal_counts(_raw(spark, d), ["ECONOMY", "LARGE", "PROMO"])


@query(
    "category_loss",
    f"""SELECT category, rows_before, coalesce(rows_after,0) AS rows_after, round((rows_before-coalesce(rows_after,0))*100.0/rows_before,2) AS loss_pct,
        round((rows_before-coalesce(rows_after,0))*100.0/rows_before,2) > 20 AS warning FROM
        (SELECT trim(cat1) AS category, count(*) AS rows_before FROM ({_VALID}) GROUP BY 1) b
        LEFT JOIN (SELECT category, count(*) AS rows_after FROM ({_PREPARED}) WHERE uniq_id IN ({_KEPT}) GROUP BY 1) a USING (category)""",
)
def category_loss(spark, d):
    """A16."""
    raw = _raw(spark, d)
    return cat.before_after(raw, cat.clean_catalog(raw), "_level1_category")


_SEARCH = f"""
SELECT uniq_id, CASE WHEN coalesce(trim(lower(name_ws)),'') NOT IN ('na','n/a','none','null','nan','nil','undefined','') AND cat1 IS NOT NULL THEN
   'Product: ' || name_ws || ' | Category: ' || cat1
   || CASE WHEN brand_ws IS NULL OR lower(brand_ws) IN ('na','n/a','none','null','nan','nil','undefined','') THEN '' ELSE ' | Brand: ' || brand_ws END
   || CASE WHEN product_specifications LIKE '%"key"%' THEN ' | Specifications: Size: ' || regexp_extract(product_specifications, '"Size", "value"=>"([^"]*)"', 1)
         || '; Finish: ' || regexp_extract(product_specifications, '"Finish", "value"=>"([^"]*)"', 1)
         || '; Batch: ' || regexp_extract(product_specifications, '"Batch", "value"=>([0-9]+)', 1) ELSE '' END
   || CASE WHEN desc_ws IS NULL OR desc_ws = '' THEN '' ELSE ' | Description: ' || desc_ws END END AS retrieval_text, description, brand, product_specifications, desc_ws
FROM (SELECT *, {_WS.format('product_name')} AS name_ws, {_WS.format('brand')} AS brand_ws, {_WS.format('description')} AS desc_ws FROM ({_VALID}))
"""


def _with_search_text(spark, d):
    raw = _raw(spark, d).withColumn("category", F.col("_level1_category")).withColumn(
        "product_specifications",
        F.to_json(tx.parse_specifications(F.col("product_specifications")), {"ignoreNullFields": "false"}),
    )
    return cat.with_search_text(raw)


@query("search_text", f"SELECT uniq_id, retrieval_text FROM ({_SEARCH})")
def search_text(spark, d):
    """Accepted rows carry a text, rejected rows a NULL."""
    return _with_search_text(spark, d).select("uniq_id", "retrieval_text")


@query(
    "search_text_audit",
    f"""SELECT count(*) AS input_rows, count(t) AS valid_rows, count(*) - count(t) AS invalid_rows, min(length(t)) AS min_length, max(length(t)) AS max_length,
        round(avg(length(t)),2) AS mean_length, round(quantile_cont(length(t),0.5),2) AS p50, round(quantile_cont(length(t),0.9),2) AS p90,
        round(quantile_cont(length(t),0.95),2) AS p95, round(quantile_cont(length(t),0.99),2) AS p99,
        count(*) FILTER (length(desc_ws) > 1200) AS truncated_count,
        count(*) FILTER (brand IS NULL OR lower(trim(brand)) IN ('none')) AS missing_brand,
        count(*) FILTER (coalesce(desc_ws,'') = '') AS missing_description,
        count(*) FILTER (NOT coalesce(product_specifications LIKE '%"key"%', false)) AS empty_specs,
        CASE WHEN count(*) = count(t) THEN 'PASS' ELSE 'FAIL' END AS status
        FROM (SELECT *, retrieval_text AS t FROM ({_SEARCH}))""",
)
def search_text_audit(spark, d):
    """A17, P12."""
    return pf.search_text_audit(_with_search_text(spark, d))


@query(
    "truncated_descriptions",
    """SELECT doc_id, CASE WHEN lower(t) IN ('na','n/a','none','null','nan','nil','undefined','') THEN NULL WHEN length(t) <= 300 THEN t
        WHEN substr(t,301,1) = ' ' THEN rtrim(substr(t,1,300)) ELSE rtrim(regexp_replace(substr(t,1,300), '^(.+) \\S*$', '\\1')) END AS text
        FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""",
)
def truncated_descriptions(spark, d):
    """P09 with a 300-character limit, over whole documents."""
    return load(spark, d, "documents").select(
        "doc_id", tx.truncate_description(F.col("text"), 300).alias("text")
    )


@query(
    "row_fingerprints",
    """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || cast(p_size AS string) || '}') AS fp FROM part""",
)
def row_fingerprints(spark, d):
    """P15."""
    return load(spark, d, "part").select(
        "p_partkey",
        tx.fingerprint(name=F.col("p_name"), brand=F.col("p_brand"), size=F.col("p_size")).alias("fp"),
    )


@query(
    "match_keys",
    "SELECT query_id, lower(nfc_normalize(raw_query)) AS k FROM {query_texts}",
)
def match_keys(spark, d):
    """P16 on texts that hold no mojibake."""
    return load(spark, d, "query_texts").select("query_id", tx.match_key(F.col("raw_query")).alias("k"))


# --------------------------------------------------------------------------- profiling
_RAWCOLS = [
    "uniq_id", "pid", "product_name", "product_category_tree", "retail_price", "discounted_price", "brand", "product_rating",
    "overall_rating", "description", "product_specifications", "image",
]


def _union_cols(cols, body):
    return " UNION ALL ".join(body.replace("$c", c) for c in cols)


@query(
    "profile_overview",
    "SELECT *, total_rows - non_null AS null_count, round((total_rows-non_null)*100.0/total_rows,2) AS null_pct, round(distinct_count*100.0/total_rows,2) AS distinct_pct FROM ("
    + _union_cols(
        _RAWCOLS,
        "SELECT '$c' AS column_name, count(*) AS total_rows, count($c) AS non_null, count(DISTINCT $c) AS distinct_count, left(min($c),60) AS min_value, left(max($c),60) AS max_value FROM {raw_catalog}",
    )
    + ")",
)
def profile_overview(spark, d):
    """A04."""
    return pf.overview(load(spark, d, "raw_catalog").select(*_RAWCOLS))


@query(
    "profile_samples",
    "SELECT column_name, cast(rk AS INT) AS rk, CASE WHEN length(v) > 60 THEN left(v,57) || '...' ELSE v END AS sample FROM ("
    + "SELECT column_name, v, row_number() OVER (PARTITION BY column_name ORDER BY v) AS rk FROM (SELECT DISTINCT column_name, v FROM ("
    + _union_cols(_RAWCOLS, "SELECT '$c' AS column_name, $c AS v FROM {raw_catalog}")
    + ") WHERE v IS NOT NULL)) WHERE rk <= 3",
)
def profile_samples(spark, d):
    """A04 samples, U04."""
    return pf.column_samples(load(spark, d, "raw_catalog").select(*_RAWCOLS))


@query(
    "profile_missing",
    "SELECT *, null_count+empty_count+blank_count+semantic_count AS effective_missing, round((null_count+empty_count+blank_count+semantic_count)*100.0/total_rows,2) AS effective_missing_pct FROM ("
    + _union_cols(
        _RAWCOLS,
        "SELECT '$c' AS column_name, count(*) AS total_rows, count(*) FILTER ($c IS NULL) AS null_count, count(*) FILTER ($c = '') AS empty_count, "
        "count(*) FILTER ($c <> '' AND trim($c) = '') AS blank_count, count(*) FILTER (lower(trim($c)) IN ('no rating available','none','null','n/a','na','-','--','nan')) AS semantic_count FROM {raw_catalog}",
    )
    + ")",
)
def profile_missing(spark, d):
    """A05."""
    return pf.missing_values(load(spark, d, "raw_catalog").select(*_RAWCOLS))


@query(
    "profile_identifiers",
    "SELECT *, total_rows-unique_count AS duplicate_count, round((total_rows-unique_count)*100.0/total_rows,2) AS duplicate_pct, (unique_count = total_rows AND null_count = 0) AS is_key FROM ("
    + _union_cols(["uniq_id", "pid"], "SELECT '$c' AS column_name, count(*) AS total_rows, count(DISTINCT $c) AS unique_count, count(*) FILTER ($c IS NULL) AS null_count FROM {raw_catalog}")
    + ")",
)
def profile_identifiers(spark, d):
    """A06."""
    return pf.identifier_quality(load(spark, d, "raw_catalog"), ["uniq_id", "pid"])


@query(
    "mapping_conflicts",
    "SELECT pid, count(DISTINCT uniq_id) AS mapped, min(uniq_id) AS first_mapped FROM {raw_catalog} GROUP BY pid HAVING count(DISTINCT uniq_id) > 1",
)
def mapping_conflicts(spark, d):
    """A06 one-to-many conflicts."""
    return pf.mapping_conflicts(load(spark, d, "raw_catalog"), "pid", "uniq_id")


@query(
    "profile_duplicates",
    """SELECT (SELECT count(*) FROM {raw_catalog}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {raw_catalog})) AS exact_duplicate_rows,
       count(*) - count(DISTINCT uniq_id) AS duplicate_id, count(*) - count(DISTINCT pid) AS duplicate_pid, count(*) - count(DISTINCT product_name) AS duplicate_name,
       count(*) - count(DISTINCT (lower(trim(coalesce(product_name,''))) || '||' || lower(trim(coalesce(brand,''))) || '||' || coalesce(discounted_price,'-1'))) AS potential_duplicate_products
       FROM {raw_catalog}""",
)
def profile_duplicates(spark, d):
    """A07."""
    return pf.duplicates(load(spark, d, "raw_catalog"), "uniq_id", "pid", "product_name", "brand", "discounted_price")


_QS = ", ".join(f"round(quantile_cont(x,{q}),2) AS p{int(q * 100)}" for q in pf.QUANTILES)


@query(
    "profile_prices",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(x) AS valid_count, count(*) FILTER (x IS NULL) AS missing_count, min(x) AS min, max(x) AS max, round(avg(x),2) AS mean, round(stddev_samp(x),2) AS std, {_QS} FROM (SELECT TRY_CAST({c} AS DOUBLE) AS x FROM {{raw_catalog}})"
        for c in ("retail_price", "discounted_price")
    ),
)
def profile_prices(spark, d):
    """A08."""
    return pf.numeric_stats(load(spark, d, "raw_catalog"), ["retail_price", "discounted_price"])


@query(
    "price_anomalies",
    """SELECT count(*) FILTER (dd > r) AS discount_exceeds_retail, count(*) FILTER (r <= 0) AS non_positive_retail, count(*) FILTER (dd <= 0) AS non_positive_discounted,
       count(*) FILTER (r IS NULL AND dd IS NULL) AS both_missing, count(*) FILTER (r IS NULL AND dd IS NOT NULL) AS retail_missing_only, count(*) FILTER (dd IS NULL AND r IS NOT NULL) AS discounted_missing_only,
       round(avg(a),2) AS amount_mean, round(median(a),2) AS amount_median, round(max(a),2) AS amount_max, round(min(a),2) AS amount_min,
       round(avg(a/r*100),2) AS pct_mean, round(median(a/r*100),2) AS pct_median, round(max(a/r*100),2) AS pct_max, round(min(a/r*100),2) AS pct_min
       FROM (SELECT r, dd, CASE WHEN r > 0 AND dd IS NOT NULL THEN r - dd END AS a FROM (SELECT TRY_CAST(retail_price AS DOUBLE) AS r, TRY_CAST(discounted_price AS DOUBLE) AS dd FROM {raw_catalog}))""",
)
def price_anomalies(spark, d):
    """A08 comparisons."""
    return pf.price_anomalies(load(spark, d, "raw_catalog"), "retail_price", "discounted_price")


@query(
    "profile_ratings",
    "SELECT *, total_rows - null_count - no_rating_count - numeric_count AS invalid_format_count FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) FILTER (c IS NULL) AS null_count, count(*) FILTER (lower(trim(c)) = 'no rating available') AS no_rating_count, count(x) AS numeric_count, min(x) AS min, max(x) AS max, round(avg(x),2) AS mean, round(median(x),2) AS median, count(*) FILTER (x < 0) AS below_range, count(*) FILTER (x > 5) AS above_range, "
        + ", ".join(f"count(*) FILTER (round_even(x,0) = {s}) AS star_{s}" for s in range(1, 6))
        + f" FROM (SELECT {c} AS c, TRY_CAST({c} AS DOUBLE) AS x FROM {{raw_catalog}})"
        for c in ("product_rating", "overall_rating")
    )
    + ")",
)
def profile_ratings(spark, d):
    """A09."""
    return pf.rating_profile(load(spark, d, "raw_catalog"), ["product_rating", "overall_rating"])


@query(
    "rating_agreement",
    """SELECT count(*) FILTER (a = b) AS exact_match, count(*) FILTER (a <> b) AS mismatch, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS both_numeric,
       count(*) FILTER (x IS NOT NULL AND y IS NULL) AS only_first, count(*) FILTER (x IS NULL AND y IS NOT NULL) AS only_second, count(*) FILTER (x IS NULL AND y IS NULL) AS neither
       FROM (SELECT trim(coalesce(product_rating,'NULL')) AS a, trim(coalesce(overall_rating,'NULL')) AS b, TRY_CAST(product_rating AS DOUBLE) AS x, TRY_CAST(overall_rating AS DOUBLE) AS y FROM {raw_catalog})""",
)
def rating_agreement(spark, d):
    """A09 relationship."""
    return pf.rating_agreement(load(spark, d, "raw_catalog"), "product_rating", "overall_rating")


@query(
    "profile_brands",
    """SELECT *, round(missing_count*100.0/total_rows,2) AS missing_pct, unique_raw - unique_normalized AS case_redundancy FROM (SELECT count(*) AS total_rows, count(*) FILTER (brand IS NULL) AS missing_count,
       count(DISTINCT brand) AS unique_raw, count(DISTINCT nullif(lower(trim(brand)),'')) AS unique_normalized, count(*) FILTER (brand <> trim(brand)) AS edge_whitespace FROM {raw_catalog})""",
)
def profile_brands(spark, d):
    """A10."""
    return pf.brand_profile(load(spark, d, "raw_catalog"))


@query(
    "top_brands",
    "SELECT brand, count(*) AS cnt, round(count(*)*100.0/(SELECT count(*) FROM {raw_catalog}),2) AS pct FROM {raw_catalog} WHERE brand IS NOT NULL GROUP BY brand ORDER BY cnt DESC, brand LIMIT 20",
)
def top_brands(spark, d):
    """A top-20 report."""
    return pf.top_values(load(spark, d, "raw_catalog"), F.col("brand"), 20, "brand")


@query(
    "profile_text",
    """SELECT count(*) AS total_rows, count(*) FILTER (text IS NULL) AS missing_count, count(*) FILTER (trim(text) = '') AS empty_count, count(*) FILTER (length(text) < 20) AS under_20,
       count(*) FILTER (length(text) < 50) AS under_50, count(*) FILTER (length(text) < 100) AS under_100, count(*) FILTER (regexp_matches(text, '<[a-zA-Z/][^>]*>')) AS html_count,
       count(*) FILTER (regexp_matches(text, 'https?://')) AS url_count, """
    + ", ".join(
        f"round({fn.format(c)},2) AS {n}_{lab}"
        for n, c in (("char", "length(text)"), ("word", "w"))
        for lab, fn in (("min", "min({})"), ("max", "max({})"), ("mean", "avg({})"), ("p25", "quantile_cont({},0.25)"), ("p50", "quantile_cont({},0.5)"), ("p75", "quantile_cont({},0.75)"), ("p95", "quantile_cont({},0.95)"))
    )
    + " FROM (SELECT text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents)",
)
def profile_text(spark, d):
    """A11."""
    return pf.description_profile(load(spark, d, "documents"), "text")


@query(
    "profile_specs",
    """SELECT count(*) AS total_rows, count(*) FILTER (s IS NULL) AS missing_count, count(*) FILTER (trim(s) = '') AS empty_count, count(*) FILTER (contains(s,'=>')) AS arrow_syntax,
       count(*) FILTER (contains(s,'":') AND NOT contains(s,'=>')) AS colon_syntax, count(*) FILTER (contains(s,'"key"=>')) AS parseable,
       cast(sum(CASE WHEN contains(s,'"key"=>') THEN 3 ELSE 0 END) AS BIGINT) AS keys_total FROM (SELECT product_specifications AS s FROM {raw_catalog})""",
)
def profile_specs(spark, d):
    """A12 coverage and syntax, over all rows."""
    return pf.specification_profile(load(spark, d, "raw_catalog"), "product_specifications")


@query(
    "spec_key_frequency",
    """SELECT trim(k) AS key, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(product_specifications, '"key"=>"([^"]+)"', 1)) AS k FROM {raw_catalog}) GROUP BY 1 ORDER BY frequency DESC, key LIMIT 15""",
)
def spec_key_frequency(spark, d):
    """A12 key frequencies: a top-15 report."""
    return pf.specification_keys(load(spark, d, "raw_catalog"), "product_specifications")


@query(
    "profile_categories",
    f"""SELECT count(*) AS total_rows, count(*) FILTER (t IS NULL) AS missing_count, count(*) FILTER (dp = 0 AND coalesce(trim(t),'') <> '') AS malformed_count, min(dp) AS min_depth, max(dp) AS max_depth,
        round(avg(dp),2) AS mean_depth, median(dp) AS median_depth, count(DISTINCT lv[1]) AS unique_level_1, count(DISTINCT CASE WHEN dp > 0 THEN coalesce(lv[2],'(single-level)') END) AS unique_level_2,
        count(DISTINCT CASE WHEN dp > 0 THEN array_to_string(lv,' >> ') END) AS unique_paths
        FROM (SELECT product_category_tree AS t, {_LEVELS} AS lv, coalesce(len({_LEVELS}),0) AS dp FROM {{raw_catalog}})""",
)
def profile_categories(spark, d):
    """A13."""
    return pf.category_profile(load(spark, d, "raw_catalog"), "product_category_tree")


def _cov(cond, name, digits=2):
    return f"round(count(*) FILTER ({cond})*100.0/count(*),{digits}) AS {name}"


@query(
    "category_suitability",
    f"""SELECT cat1 AS category, count(*) AS product_count, {_cov("coalesce(trim(description),'')<>''", "description_coverage_pct")}, median(length(trim(description))) AS description_median_length,
        {_cov("TRY_CAST(retail_price AS DOUBLE) IS NOT NULL", "retail_price_coverage_pct")}, {_cov("TRY_CAST(discounted_price AS DOUBLE) IS NOT NULL", "discounted_price_coverage_pct")},
        {_cov("TRY_CAST(product_rating AS DOUBLE) IS NOT NULL", "rating_numeric_coverage_pct")}, {_cov("coalesce(trim(brand),'')<>''", "brand_coverage_pct")}, count(DISTINCT trim(brand)) AS unique_brand_count,
        {_cov("coalesce(trim(product_specifications),'')<>''", "specification_coverage_pct")}, median(length(trim(product_specifications))) AS specification_median_length
        FROM ({_VALID}) WHERE cat1 IS NOT NULL GROUP BY cat1 HAVING count(*) >= 50""",
)
def category_suitability(spark, d):
    """A14."""
    return pf.category_suitability(load(spark, d, "raw_catalog"))


_DECISIONS = "SELECT DISTINCT p_type AS category, CASE WHEN p_type IN ('ECONOMY','PROMO') THEN 'REJECT' ELSE 'SELECT' END AS selection_status FROM part"
_EVAL = f"""
SELECT category, selection_status, coalesce(product_count,0) AS product_count, price_coverage_pct, brand_coverage_pct, description_coverage_pct, description_median_length, specification_coverage_pct,
       rating_numeric_coverage_pct, duplicate_name_rate_pct, round(product_count*100.0/(SELECT count(*) FROM {{raw_catalog}}),2) AS dataset_pct
FROM ({_DECISIONS}) LEFT JOIN (SELECT cat1 AS category, count(*) AS product_count, {_cov("discounted_price IS NOT NULL", "price_coverage_pct", 1)}, {_cov("brand IS NOT NULL", "brand_coverage_pct", 1)},
   {_cov("description IS NOT NULL", "description_coverage_pct", 1)}, median(length(description)) AS description_median_length,
   round(count(*) FILTER (trim(product_specifications)<>'')*100.0/count(product_specifications),1) AS specification_coverage_pct,
   {_cov("TRY_CAST(product_rating AS DOUBLE) IS NOT NULL", "rating_numeric_coverage_pct", 1)}, round((1-count(DISTINCT product_name)*1.0/count(*))*100,1) AS duplicate_name_rate_pct FROM ({_VALID}) GROUP BY cat1) USING (category)
"""


def _evaluation(spark, d):
    decisions = load(spark, d, "part").select(
        F.col("p_type").alias("category"),
        F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "REJECT").otherwise("SELECT").alias("selection_status"),
    ).distinct()
    return pf.category_evaluation(load(spark, d, "raw_catalog"), decisions)


@query("category_evaluation", _EVAL)
def category_evaluation(spark, d):
    """A01."""
    return _evaluation(spark, d)


@query(
    "selection_summary",
    f"""SELECT count(*) FILTER (selection_status='SELECT') AS selected_categories, count(*) FILTER (selection_status<>'SELECT') AS rejected_categories,
        cast(sum(CASE WHEN selection_status='SELECT' THEN product_count ELSE 0 END) AS BIGINT) AS selected_products,
        sum(CASE WHEN selection_status='SELECT' THEN product_count ELSE 0 END) BETWEEN 5000 AND 15000 AS target_range_met FROM ({_EVAL})""",
)
def selection_summary(spark, d):
    """A01 summary."""
    return pf.selection_summary(_evaluation(spark, d))


@query(
    "selected_candidates",
    f"SELECT uniq_id, cat1 AS category FROM ({_VALID}) WHERE cat1 IN ('LARGE','MEDIUM','SMALL')",
)
def selected_candidates(spark, d):
    """F05."""
    rows = cat.select_candidates(load(spark, d, "raw_catalog"), ["LARGE", "MEDIUM", "SMALL"])
    return rows.select("uniq_id", F.col("_level1_category").alias("category"))


@query(
    "text_readiness",
    """SELECT count(*) AS total_rows, count(*) FILTER (t<>'') AS with_name, count(*) FILTER (e<>'') AS with_description, count(*) FILTER (s<>'') AS with_specs,
       count(*) FILTER (t<>'' AND e<>'') AS with_name_description, count(*) FILTER (t<>'' AND e<>'' AND s<>'') AS with_all, min(n) AS len_min, max(n) AS len_max, round(avg(n),2) AS len_mean,
       round(quantile_cont(n,0.25),2) AS len_p25, round(quantile_cont(n,0.5),2) AS len_p50, round(quantile_cont(n,0.75),2) AS len_p75, round(quantile_cont(n,0.95),2) AS len_p95
       FROM (SELECT *, length(t)+length(e)+length(s) AS n FROM (SELECT trim(coalesce(product_name,'')) AS t, trim(coalesce(description,'')) AS e, trim(coalesce(product_specifications,'')) AS s FROM {raw_catalog}))""",
)
def text_readiness(spark, d):
    """A15."""
    return pf.readiness(load(spark, d, "raw_catalog"), "product_name", "description", "product_specifications")


@query(
    "token_lengths",
    """SELECT count(*) AS texts, min(n) AS min_tokens, max(n) AS max_tokens, round(avg(n),2) AS mean_tokens, quantile_cont(n,0.5) AS p50, round(quantile_cont(n,0.95),2) AS p95, count(*) FILTER (n > 512) AS over_limit
       FROM (SELECT len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n FROM documents)""",
)
def token_lengths(spark, d):
    """A27, on word counts."""
    return pf.token_lengths(load(spark, d, "documents"), "text")


@query(
    "readiness_checks",
    f"""SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
        SELECT unnest(['product_id_present','product_id_unique','product_name_present','category_present','discounted_price_positive','retail_price_positive','rating_in_range','specs_are_json']) AS check, n AS checked_rows,
               unnest([0, n - u, a, b, 0, 0, 0, 0]) AS violations
        FROM (SELECT count(*) AS n, count(DISTINCT p.uniq_id) AS u, count(*) FILTER (name_clean IS NULL) AS a, count(*) FILTER (category IS NULL) AS b FROM ({_PREPARED}) p JOIN ({_KEPT}) k ON p.uniq_id = k.uniq_id))""",
)
def readiness_checks(spark, d):
    """A26 over the cleaned catalog."""
    return pf.readiness_checks(cat.clean_catalog(_raw(spark, d)))


@query(
    "schema_report",
    "SELECT * FROM (VALUES ('p_partkey','bigint',true,true,false),('p_name','string',true,true,false),('p_brand','string',true,true,false),('rating',NULL,false,true,false),('p_type','string',true,false,false),('p_size','int',true,false,false),('p_retailprice','double',true,false,false)) v(field,dtype,present,expected,duplicated), LATERAL (SELECT CASE WHEN present THEN count(*) END AS non_null, count(*) AS row_count FROM part)",
)
def schema_report(spark, d):
    """S02."""
    return readers.schema_report(load(spark, d, "part"), ["p_partkey", "p_name", "p_brand", "rating"])


@query(
    "catalog_contract",
    "SELECT count(*) AS row_count, count(DISTINCT doc_id) AS distinct_ids, count(*) FILTER (doc_id IS NULL) AS null_ids, count(*) FILTER (coalesce(trim(text),'')='') AS blank_texts, (count(*)>0 AND count(DISTINCT doc_id)=count(*) AND count(*) FILTER (coalesce(trim(text),'')='')=0) AS ok FROM documents",
)
def catalog_contract(spark, d):
    """S03."""
    return readers.catalog_contract(load(spark, d, "documents"), "doc_id", "text")


# A vector for every part: the given ones, repeated.
_PART_VECTORS = "(SELECT p_partkey, embedding FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"


def part_vectors(spark, d):
    vectors = load(spark, d, "embeddings")
    turn = F.pmod(F.col("p_partkey"), F.lit(vectors.count()))
    return load(spark, d, "part").join(vectors, turn == F.col("vec_id")).select(
        F.col("p_partkey").cast("string").alias("product_id"), "embedding"
    )


KB_COLUMNS = (
    "product_id", "product_name", "category", "brand", "retail_price", "discounted_price", "rating", "retrieval_text",
    "embedding", "embedding_model",
)


def knowledge_base_rows(spark, d):
    """S10, S11 over all products: shaped for load, vectors attached by key."""
    text = load(spark, d, "products").select("product_id", "rating", "retrieval_text")
    products = load(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.concat(F.lit(" "), "p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        (F.col("p_retailprice") * 2).alias("retail_price"),
        F.col("p_retailprice").alias("discounted_price"),
    )
    shaped = sinks.shape_for_load(products.join(text, "product_id"))
    return sinks.assemble_knowledge_base(shaped, part_vectors(spark, d), "given-64", KB_COLUMNS)


@query(
    "knowledge_base",
    f"""SELECT product_id, p_name AS product_name, p_type AS category, p_brand AS brand, cast(p_retailprice * 2 AS decimal(10,2)) AS retail_price, cast(p_retailprice AS decimal(10,2)) AS discounted_price,
        cast(rating AS decimal(3,2)) AS rating, len(v.embedding) AS dim, v.embedding[1] AS first, 'given-64' AS embedding_model FROM part JOIN {{products}} t ON product_id = cast(p_partkey AS string) JOIN {_PART_VECTORS} v USING (p_partkey)""",
)
def knowledge_base(spark, d):
    """Every product, vectors attached by key, never by position."""
    kb = knowledge_base_rows(spark, d).drop("retrieval_text")
    return kb.withColumns({"dim": F.size("embedding"), "first": F.get("embedding", F.lit(0))}).drop("embedding")


@query(
    "unmatched_vectors",
    "SELECT coalesce(cast(p_partkey AS string), cast(vec_id AS string)) AS product_id, CASE WHEN p_partkey IS NULL THEN 'NO_PRODUCT' ELSE 'NO_VECTOR' END AS problem FROM part FULL OUTER JOIN embeddings ON p_partkey = vec_id WHERE p_partkey IS NULL OR vec_id IS NULL",
)
def unmatched_vectors(spark, d):
    """What an assembly of the parts with the bare vectors refuses."""
    products = load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("product_id"))
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("product_id"), "embedding")
    return sinks.unmatched_vectors(products, vectors)


# ------------------------------------------------------------------- sources and sinks
def _fresh(spark, name):
    return f"{shared_folder(spark)}/sources/{name}-{uuid.uuid4().hex}"


_RAW12 = "uniq_id, pid, product_name, product_category_tree, retail_price, discounted_price, brand, product_rating, overall_rating, description, product_specifications, image"


@query("csv_round_trip", f"SELECT {_RAW12} FROM {{raw_catalog}}")
def csv_round_trip(spark, d):
    """The raw catalog as CSV, read back by header name in another column order."""
    raw, path = load(spark, d, "raw_catalog").select(*_RAW12.split(", ")), _fresh(spark, "csv")
    sinks.write_new(raw, path, "csv")
    shuffled = T.StructType(sorted(raw.schema.fields, key=lambda f: f.name))
    return readers.read_csv(spark, path, shuffled)


@query("jsonl_round_trip", "SELECT query_id, raw_query, min_price, category, stored_clarification FROM {shopper_log}")
def jsonl_round_trip(spark, d):
    """The shopper log as JSON lines."""
    log = load(spark, d, "shopper_log").select("query_id", "raw_query", "min_price", "category", "stored_clarification")
    path = _fresh(spark, "jsonl")
    sinks.write_new(log, path)
    return readers.read_jsonl(spark, path, log.schema)


@query("published_catalog", "SELECT product_id, category, retrieval_text FROM {products}")
def published_catalog(spark, d):
    """Products staged, checked, promoted and read back pruned, with the row count agreed."""
    products, path = load(spark, d, "products"), _fresh(spark, "catalog")
    sinks.publish(products, path)
    n = load(spark, d, "part").count()
    return readers.read_catalog(spark, path, ["product_id", "category", "retrieval_text"], expected_rows=n)


@query("loaded_parts_table", "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def loaded_parts_table(spark, d):
    """Parts loaded into an empty table."""
    path = _fresh(spark, "load")
    load(spark, d, "part").limit(0).write.parquet(path)
    return sinks.load_empty(load(spark, d, "part"), path, "p_partkey").select("p_partkey", "p_name", "p_brand", "p_retailprice")


# -------------------------------------------------------------- constraints as text
_OWN = """(SELECT p_partkey, p_type AS category, CASE WHEN p_size % 9 = 2 THEN NULL ELSE p_brand END AS brand, cast(p_retailprice AS double) AS price, CASE WHEN p_size % 10 = 3 THEN NULL ELSE cast(p_size % 5 AS double) END AS rating,
   CASE p_size % 6 WHEN 0 THEN lower(p_type) WHEN 1 THEN '  ' WHEN 2 THEN 'Z' || p_type ELSE p_type END AS f_category, CASE p_size % 5 WHEN 0 THEN upper(p_brand) WHEN 1 THEN '' WHEN 2 THEN 'other' END AS f_brand,
   cast(CASE p_size % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice - 1 WHEN 2 THEN p_retailprice + 1 END AS double) AS f_min_price, cast(CASE p_size % 7 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice - 1 END AS double) AS f_max_price,
   CASE p_size % 3 WHEN 0 THEN '>' WHEN 1 THEN '>=' END AS f_min_operator, CASE p_size % 2 WHEN 0 THEN '<' ELSE '<=' END AS f_max_operator, cast(CASE WHEN p_size % 8 = 5 THEN 3 END AS double) AS f_min_rating FROM {part})"""


@query(
    "constraint_text_matches",
    f"""SELECT p_partkey, (trim(f_category) = '' OR lower(category) = lower(f_category)) AND (coalesce(trim(f_brand), '') = '' OR coalesce(lower(brand) = lower(f_brand), false)) AND (f_min_rating IS NULL OR coalesce(rating >= f_min_rating, false))
        AND (f_min_price IS NULL OR CASE WHEN f_min_operator = '>' THEN price > f_min_price ELSE price >= f_min_price END) AND (f_max_price IS NULL OR CASE WHEN f_max_operator = '<' THEN price < f_max_price ELSE price <= f_max_price END) AS matches
        FROM {_OWN}""",
)
def constraint_text_matches(spark, d):
    """every part against a constraint of its own, with operator symbols."""
    part = load(spark, d, "part")
    rows = spark.sql(_OWN.strip()[1:-1], part=part)
    names = ("category", "brand", "price", "rating", "f_category", "f_brand", "f_min_price", "f_max_price", "f_min_operator", "f_max_operator", "f_min_rating")
    return rows.select("p_partkey", cs.matches_text(**{n: F.col(n) for n in names}).alias("matches"))
