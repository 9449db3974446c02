"""Evidence, grounding, integrity and session queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from merchlens.operators import constraints as cs
from merchlens.operators import evidence as vd
from merchlens.operators import integrity as ig
from merchlens.operators import labels as lb
from merchlens.operators.catalog import build_search_texts, clean_catalog
from merchlens.functions.vectors import norm
from merchlens.plans.catalog_queries import _KEPT, _PREPARED, _raw, part_vectors
from merchlens.plans.derived import load
from merchlens.plans.evaluation_queries import _ADJ, _adjudicated, _judged, _side, split_problems
from merchlens.plans.registry import ORACLES, query
from merchlens.plans.search_queries import frozen_runs
from merchlens.session import cut_lineage, shared_folder
from merchlens.sources import sinks, upserts
from merchlens.streaming import sessions as ss
from merchlens.streaming import state as sst

_EV = """SELECT product_id || '-E' || cast(row_number() OVER (PARTITION BY product_id ORDER BY n) AS string) AS evidence_id, product_id, source_field, text FROM (
  SELECT product_id, 1 AS n, 'product_name' AS source_field, product_name AS text FROM {products}
  UNION ALL SELECT product_id, 2, 'brand', brand FROM {products} WHERE brand IS NOT NULL
  UNION ALL SELECT product_id, 3, 'category', category FROM {products}
  UNION ALL SELECT product_id, 4, 'discounted_price', printf('%.2f INR', discounted_price) FROM {products}
  UNION ALL SELECT product_id, 5, 'rating', printf('%.1f / 5.0', rating) FROM {products} WHERE rating IS NOT NULL
  UNION ALL SELECT product_id, 6, 'specifications', regexp_extract(retrieval_text, '(Size: [0-9]+)', 1) FROM {products}
  UNION ALL SELECT product_id, 7, 'specifications', regexp_extract(retrieval_text, '(Finish: [a-z]+)', 1) FROM {products}
  UNION ALL SELECT product_id, 8, 'description', product_name || ' for daily use.' FROM {products}
  UNION ALL SELECT product_id, 9, 'description', regexp_extract(retrieval_text, '(Made by [^.]+\\.)', 1) FROM {products})"""


def _evidence(spark, d):
    return vd.evidence_rows(load(spark, d, "products"))


@query("evidence_rows", _EV)
def evidence_rows(spark, d):
    """V01, W11, P14."""
    return _evidence(spark, d)


@query(
    "context_blocks",
    f"""WITH ev AS ({_EV}), l AS (SELECT product_id, string_agg('  [' || evidence_id || '] (' || source_field || '): ' || text, chr(10) ORDER BY cast(string_split(evidence_id,'-E')[2] AS INT)) AS lines FROM ev GROUP BY 1)
        SELECT query_id, '### USER REQUIREMENTS' || chr(10) || '- Original query: order ' || query_id || chr(10) || '- Hard constraints: ' || concat_ws(', ', CASE WHEN query_id::BIGINT % 2 = 0 THEN 'Category=''STANDARD''' END, CASE WHEN query_id::BIGINT % 3 = 0 THEN 'Brand=''Brand#1''' END,
            CASE WHEN query_id::BIGINT % 5 = 0 THEN 'MinPrice=100.0 ' || CASE WHEN query_id::BIGINT % 4 = 0 THEN 'USD' ELSE 'INR' END END, 'MaxPrice=990.0 ' || CASE WHEN query_id::BIGINT % 4 = 0 THEN 'USD' ELSE 'INR' END, CASE WHEN query_id::BIGINT % 7 = 0 THEN 'MinRating=3.5' END) || chr(10) || chr(10) || '### CANDIDATE PRODUCTS (ORDERED BY RELEVANCE RANK)' || chr(10)
          || string_agg('[CANDIDATE #' || rank || ']' || chr(10) || 'Product ID: ' || product_id || chr(10) || '<product_evidence product_id="' || product_id || '">' || chr(10) || lines || chr(10) || '</product_evidence>', chr(10) || chr(10) ORDER BY rank) AS context
        FROM {{order_candidates}} JOIN l USING (product_id) GROUP BY query_id""",
)
def context_blocks(spark, d):
    """V02."""
    # Read twice: stored, so that the candidates are made once.
    cands = cut_lineage(load(spark, d, "order_candidates").select("query_id", "product_id", "rank"))
    every = lambda n, value: F.when(F.col("query_id").cast("bigint") % n == 0, F.lit(value))
    queries = cands.select("query_id").distinct().select(
        "query_id", F.concat(F.lit("order "), "query_id").alias("raw_query"), every(2, "STANDARD").alias("category"),
        every(3, "Brand#1").alias("brand"), every(5, 100.0).alias("min_price"), F.lit(990.0).alias("max_price"),
        every(7, 3.5).alias("min_rating"), every(4, "USD").alias("currency"),
    )
    return vd.context_blocks(queries, cands, _evidence(spark, d))


def _payloads(spark, d):
    """Generator output as JSON per query; every third overview is blank."""
    rows = load(spark, d, "generated")
    cites = F.array_compact(F.array("cite_1", "cite_2", "cite_3"))
    none = F.array().cast(vd.CLAIMS)
    limits = F.array(F.struct(F.concat(F.lit("limit of "), "reason").alias("claim"), F.array("cite_2").alias("evidence_ids")))
    item = F.struct(
        "product_id", F.col("reason").alias("summary_reason"), F.concat(F.lit("note on "), "reason").alias("comparison_note"),
        F.array(F.struct(F.col("reason").alias("claim"), cites.alias("evidence_ids"))).alias("strengths"),
        F.when(F.col("cite_2").isNotNull(), limits.cast(vd.CLAIMS)).otherwise(none).alias("limitations"),
    )
    payloads = rows.groupBy("query_id").agg(
        F.to_json(
            F.struct(
                F.when(F.col("query_id").cast("bigint") % 3 == 0, F.lit("  ")).otherwise(F.lit(" fine ")).alias("overview"),
                F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("i")))), lambda x: x["i"]).alias("products"),
            )
        ).alias("payload")
    )
    return payloads


def _payload_items(spark, d):
    return vd.parse_payloads(_payloads(spark, d))


def _merged(spark, d):
    cands = cut_lineage(load(spark, d, "order_candidates").drop("retrieval_text", "max_price"))  # read twice
    return vd.merge_generated(cands, _payload_items(spark, d), _evidence(spark, d))


_OKG = f"""ev AS MATERIALIZED ({_EV}), cand AS MATERIALIZED (SELECT * FROM {{order_candidates}}), gen AS MATERIALIZED (SELECT *, (query_id, product_id) IN (SELECT (query_id, product_id) FROM cand) AS known, row_number() OVER (PARTITION BY query_id, product_id ORDER BY pos) AS nth FROM {{generated}}),
 ok AS MATERIALIZED (SELECT * FROM gen WHERE known AND nth = 1),
 cites AS MATERIALIZED (SELECT x.query_id, x.product_id, kind, i, c, CASE WHEN e.product_id IS NULL THEN 'NO_SUCH_EVIDENCE' WHEN e.product_id <> x.product_id THEN 'OTHER_PRODUCT' ELSE 'VALID' END AS status
   FROM (SELECT query_id, product_id, 's' AS kind, unnest([1, 2, 3]) AS i, unnest([cite_1, cite_2, cite_3]) AS c FROM ok UNION ALL SELECT query_id, product_id, 'l', 1, cite_2 FROM ok) x LEFT JOIN ev e ON e.evidence_id = c WHERE c IS NOT NULL),
 clean AS (SELECT query_id, product_id, coalesce(string_agg(c, ',' ORDER BY i) FILTER (kind = 's' AND status = 'VALID'), '') AS s_ids, coalesce(string_agg(c, ',' ORDER BY i) FILTER (kind = 'l' AND status = 'VALID'), '') AS l_ids FROM cites GROUP BY 1, 2)"""
_MERGED = f"""{_OKG}, merged AS MATERIALIZED (SELECT c.*, ok.reason, ok.cite_2, s_ids, l_ids, CASE WHEN c.query_id NOT IN (SELECT query_id FROM ok) THEN 'FALLBACK' WHEN ok.reason IS NULL THEN 'OMITTED' ELSE 'GENERATED' END AS source
   FROM cand c LEFT JOIN ok USING (query_id, product_id) LEFT JOIN clean USING (query_id, product_id))"""


@query(
    "merged_recommendations",
    f"""WITH {_MERGED} SELECT query_id, product_id, rank, source,
        CASE source WHEN 'GENERATED' THEN reason WHEN 'OMITTED' THEN product_name || ' matches the requested ' || category || ' category.'
          ELSE product_name || coalesce(' by ' || brand, '') || ' in ' || category || ' at ' || printf('%.2f INR', discounted_price) || CASE WHEN rating IS NULL THEN '' ELSE printf(' with rating %.1f/5.0', rating) END || '.' END AS summary_reason,
        CASE source WHEN 'GENERATED' THEN reason || '[' || s_ids || ']' WHEN 'OMITTED' THEN 'Authentic ' || coalesce(brand, category) || ' product priced at ' || printf('%.2f INR', discounted_price) || '[' || product_id || '-E1]'
          ELSE 'Verified ' || category || ' candidate meeting query retrieval criteria.[' || product_id || '-E1]' END AS strengths,
        CASE source WHEN 'GENERATED' THEN CASE WHEN cite_2 IS NULL THEN '' ELSE 'limit of ' || reason || '[' || l_ids || ']' END WHEN 'OMITTED' THEN 'Full detailed explanation was omitted by model generation.[]'
          ELSE 'Generated via deterministic fallback; natural language explanation unavailable.[]' END AS limitations,
        CASE source WHEN 'GENERATED' THEN 'note on ' || reason WHEN 'OMITTED' THEN 'Alternative option in the retrieved set.' ELSE 'Rank #' || rank || ' candidate in retrieval results.' END AS comparison_note
        FROM merged""",
)
def merged_recommendations(spark, d):
    """Texts, claims with cleaned citations and notes."""
    rows, _ = _merged(spark, d)
    told = lambda c: F.array_join(
        F.transform(c, lambda x: F.concat(x["claim"], F.lit("["), F.array_join(x["evidence_ids"], ","), F.lit("]"))), "|"
    )
    return rows.select(
        "query_id", "product_id", "rank", "source", "summary_reason", told("strengths").alias("strengths"),
        told("limitations").alias("limitations"), "comparison_note",
    )


@query(
    "merge_warnings",
    f"""WITH {_MERGED} SELECT query_id, product_id, CASE WHEN known THEN 'DUPLICATE_PRODUCT' ELSE 'UNKNOWN_PRODUCT' END AS warning, NULL AS evidence_id FROM gen WHERE (NOT known OR nth > 1) AND query_id IN (SELECT query_id FROM ok)
        UNION ALL SELECT query_id, product_id, status, c FROM cites WHERE status <> 'VALID' UNION ALL SELECT query_id, product_id, 'OMITTED_PRODUCT', NULL FROM merged WHERE source = 'OMITTED'
        UNION ALL SELECT DISTINCT query_id, NULL, 'NO_KNOWN_PRODUCT', NULL FROM merged WHERE source = 'FALLBACK'""",
)
def merge_warnings(spark, d):
    """V03 warnings of every kind."""
    _, warnings = _merged(spark, d)
    return warnings


@query(
    "recommendation_overviews",
    f"""WITH {_MERGED}, g AS (SELECT DISTINCT query_id FROM {{generated}}) SELECT query_id, CASE WHEN lost THEN 'DETERMINISTIC_FALLBACK' ELSE 'SUCCESS' END AS status,
        CASE WHEN lost THEN 'Here are the top products matching your query (generated via verified metadata fallback):' WHEN cast(query_id AS BIGINT) % 3 = 0 THEN 'Here are the top recommended products matching your criteria:' ELSE 'fine' END AS overview
        FROM (SELECT query_id, bool_or(source = 'FALLBACK') AS lost FROM merged GROUP BY 1)""",
)
def recommendation_overviews(spark, d):
    """The text above the products."""
    rows, _ = _merged(spark, d)
    return vd.overviews(_payloads(spark, d), rows)


@query(
    "citation_check",
    f"""WITH ev AS MATERIALIZED ({_EV}) SELECT status, count(*) AS citations FROM (SELECT CASE WHEN e.product_id IS NULL THEN 'NO_SUCH_EVIDENCE' WHEN e.product_id <> g.product_id THEN 'OTHER_PRODUCT' ELSE 'VALID' END AS status
        FROM (SELECT product_id, unnest(list_filter([cite_1, cite_2, cite_3, cite_2], lambda x: x IS NOT NULL)) AS c FROM {{generated}}) g LEFT JOIN ev e ON e.evidence_id = g.c) GROUP BY 1""",
)
def citation_check(spark, d):
    """V03 citations."""
    rows = vd.citation_check(vd.claims(_payload_items(spark, d)), _evidence(spark, d))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("citations"))


@query(
    "claim_rows",
    """SELECT *, sha256('{"c":"' || claim || '","k":"' || kind || '","p":"' || product_id || '","q":"' || query_id || '"}') AS claim_hash FROM (
       SELECT query_id, product_id, pos, 'strengths' AS kind, reason AS claim, len(list_filter([cite_1, cite_2, cite_3], lambda x: x IS NOT NULL)) AS citations FROM {generated}
       UNION ALL SELECT query_id, product_id, pos, 'limitations', 'limit of ' || reason, 1 FROM {generated} WHERE cite_2 IS NOT NULL)""",
)
def claim_rows(spark, d):
    """V06."""
    rows = vd.claims(_payload_items(spark, d))
    return rows.select("query_id", "product_id", "pos", "kind", "claim", F.size("evidence_ids").alias("citations"), "claim_hash")


@query(
    "grounding_check",
    """WITH pool AS (SELECT query_id, product_id, discounted_price <= max_price AS satisfied FROM {order_candidates}), g AS (SELECT g.*, p.satisfied FROM {generated} g LEFT JOIN pool p USING (query_id, product_id)),
       pr AS (SELECT query_id, count(*) AS listed, count(satisfied) AS checked_products, count(*) FILTER (satisfied IS NULL) AS unknown_products, count(*) FILTER (NOT satisfied) AS constraint_violations,
         sum(CASE WHEN satisfied IS NULL THEN 0 ELSE (CASE WHEN cite_1 LIKE product_id || '-E%' THEN 1 ELSE 0 END) + (CASE WHEN cite_2 LIKE product_id || '-E%' THEN 2 ELSE 0 END) + (CASE WHEN cite_3 LIKE product_id || '-E%' THEN 1 ELSE 0 END) END) AS vc,
         sum(CASE WHEN satisfied IS NULL THEN 0 ELSE (CASE WHEN cite_1 NOT LIKE product_id || '-E%' THEN 1 ELSE 0 END) + (CASE WHEN cite_2 NOT LIKE product_id || '-E%' THEN 2 ELSE 0 END) + (CASE WHEN cite_3 NOT LIKE product_id || '-E%' THEN 1 ELSE 0 END) END) AS bc FROM g GROUP BY 1)
       SELECT query_id, coalesce(listed,0) AS listed, coalesce(checked_products,0) AS checked_products, coalesce(unknown_products,0) AS unknown_products, coalesce(constraint_violations,0) AS constraint_violations, cast(coalesce(vc,0) AS BIGINT) AS valid_citations, cast(coalesce(bc,0) AS BIGINT) AS bad_citations,
         CASE WHEN coalesce(listed,0) > 0 AND unknown_products = 0 AND constraint_violations = 0 AND bc = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT DISTINCT query_id FROM pool) LEFT JOIN pr USING (query_id)""",
)
def grounding_check(spark, d):
    """V05, F03."""
    cands = load(spark, d, "order_candidates")
    none = F.lit(None).cast("string")
    num = F.lit(None).cast("double")
    ok = cs.satisfies_loosely(
        category=F.col("category"), brand=F.col("brand"), price=F.col("discounted_price"), rating=F.col("rating"),
        f_category=none, f_brand=none, f_min_price=num, f_max_price=F.col("max_price"), f_min_rating=num,
    )
    pool = cands.select("query_id", "product_id", ok.alias("satisfied"))
    return vd.grounding_check(_payload_items(spark, d), pool, cands.select("query_id").distinct())


@query(
    "judge_json",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE s END AS groundedness, CASE WHEN event_type = 'error' THEN 'NOT_JSON' WHEN s NOT BETWEEN 1 AND 5 THEN 'SCORE_RANGE' WHEN event_type = 'view' THEN 'DECISION' END AS problem
       FROM (SELECT event_id, event_type, cast(json_extract_string(props,'$.k') AS INT) % 7 AS s FROM events)""",
)
def judge_json(spark, d):
    """Judge answers wrapped in fences, one per event."""
    ev = load(spark, d, "events")
    s = (F.get_json_object("props", "$.k").cast("int") % 7).alias("s")
    body = F.to_json(
        F.struct(
            *[s.alias(c) for c in vd.JUDGE_SCORES],
            F.when(F.col("event_type") == "view", "MAYBE").otherwise("PASS").alias("overall_decision"),
            F.lit(True).alias("evidence_supported"), F.lit("ok").alias("critique"),
        )
    )
    text = F.when(F.col("event_type") == "error", F.lit("no answer")).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    out = ev.select("event_id", vd.parse_judge(text).alias("j"))
    return out.select("event_id", F.col("j.parsed.groundedness_score").alias("groundedness"), F.col("j.problem").alias("problem"))


_CL = """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_quantity AS BIGINT) AS claim_id, l_returnflag AS rf, l_linestatus AS ls, l_tax AS tax FROM lineitem"""


@query(
    "claim_adjudication",
    f"""SELECT claim_id, CASE WHEN agree OR tax < 0.04 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution, agree AS exact_agreement, CASE WHEN agree THEN a WHEN tax < 0.04 THEN 'NOT_ENOUGH_INFORMATION' END AS support_label
        FROM (SELECT claim_id, tax, CASE WHEN rf = 'A' THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS a, (rf = 'A') = (ls = 'F') AS agree FROM ({_CL}))""",
)
def claim_adjudication(spark, d):
    """Two claim judges and a decision table over line items."""
    key = F.concat_ws(
        "-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("bigint").cast("string"),
    )
    rows = load(spark, d, "lineitem").select(key.alias("claim_id"), "l_returnflag", "l_linestatus", "l_tax")
    rest = {"factual_correctness": "CORRECT", "recommendation_relevance": "RELEVANT", "missing_information_handling": "NOT_APPLICABLE"}

    def side(cond):
        return rows.select(
            "claim_id", F.when(cond, "SUPPORTED").otherwise("UNSUPPORTED").alias("support_label"),
            *[F.lit(v).alias(k) for k, v in rest.items()],
        )

    decisions = rows.filter("l_tax < 0.04").select(
        "claim_id", F.lit("NOT_ENOUGH_INFORMATION").alias("support_label"), *[F.lit(v).alias(k) for k, v in rest.items()]
    )
    out = lb.adjudicate_claims(side(F.col("l_returnflag") == "A"), side(F.col("l_linestatus") == "F"), decisions)
    return out.select("claim_id", "resolution", "exact_agreement", "support_label")


@query(
    "claim_review_errors",
    f"SELECT claim_id, array_to_string(list_filter([CASE WHEN rf = 'R' THEN 'support_label' END, CASE WHEN tax * 20 > 1 THEN 'confidence' END], lambda x: x IS NOT NULL), '|') AS errors FROM ({_CL})",
)
def claim_review_errors(spark, d):
    """V07 validation."""
    key = F.concat_ws(
        "-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("bigint").cast("string"),
    )
    labels = {
        "support_label": F.when(F.col("l_returnflag") == "R", "perhaps").otherwise("supported"),
        "factual_correctness": F.lit("Correct"),
        "recommendation_relevance": F.lit("RELEVANT"),
        "missing_information_handling": F.lit("NOT_APPLICABLE"),
    }
    errors = lb.claim_review_errors(labels, F.col("l_tax") * 20)
    return load(spark, d, "lineitem").select(key.alias("claim_id"), F.array_join(errors, "|").alias("errors"))


@query(
    "presentation_links",
    "SELECT query_id, product_id, 'https://shop.example.com/' || product_id AS product_url, CASE WHEN cast(product_id AS BIGINT) % 2 = 0 THEN 'http://img.example.com/' || product_id END AS image_url FROM {order_candidates}",
)
def presentation_links(spark, d):
    """J14, P13."""
    even = F.col("p_partkey") % 2 == 0
    img = F.to_json(F.array(F.lit("bad"), F.concat(F.lit("http://img.example.com/"), F.col("p_partkey").cast("string"))))
    catalog = load(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.concat(F.lit(" https://shop.example.com/"), F.col("p_partkey").cast("string")).alias("product_url"),
        F.when(even, img).otherwise(F.lit("ftp://none")).alias("image"),
    )
    return vd.enrich(load(spark, d, "order_candidates").select("query_id", "product_id"), catalog)


# ----------------------------------------------------------------------- integrity
_FIELDS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(
    "source_target_diff",
    """SELECT count(s) AS source_ids, count(t) AS target_ids, count(*) FILTER (s AND t) AS matching, count(*) FILTER (t IS NULL) AS missing, count(*) FILTER (s IS NULL) AS unexpected
       FROM (SELECT p_partkey, true AS s FROM part) FULL OUTER JOIN (SELECT p_partkey, true AS t FROM {loaded_parts}) USING (p_partkey)""",
)
def source_target_diff(spark, d):
    """J12, U03."""
    return ig.key_diff(load(spark, d, "part"), load(spark, d, "loaded_parts"), "p_partkey")


@query(
    "content_diff",
    "SELECT 'content_' || f AS test_id, n AS actual, 0 AS expected, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS f, count(*) FILTER (s.{f} IS DISTINCT FROM t.{f}) AS n FROM part s JOIN {{loaded_parts}} t USING (p_partkey)" for f in _FIELDS
    )
    + ")",
)
def content_diff(spark, d):
    """Every shared row, every field."""
    return ig.content_diff(load(spark, d, "part"), load(spark, d, "loaded_parts"), "p_partkey", _FIELDS)


@query(
    "target_states",
    """SELECT 'copy' AS target, 'ALREADY_POPULATED' AS state FROM (SELECT count(*) AS n FROM part) WHERE n > 0 UNION ALL SELECT 'empty', 'EMPTY_TABLE' FROM (SELECT count(*) AS n FROM part) WHERE n > 0
       UNION ALL SELECT 'loaded', 'PARTIALLY_POPULATED' FROM (SELECT count(*) AS n FROM {loaded_parts}) WHERE n > 0 UNION ALL SELECT 'changed', 'CONFLICTING_DATA' FROM (SELECT count(*) AS n FROM part WHERE p_size = 21) WHERE n > 0""",
)
def target_states(spark, d):
    """Four targets, four states."""
    part, loaded = load(spark, d, "part"), load(spark, d, "loaded_parts")
    price = F.when(F.col("p_size") == 21, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    targets = {"copy": part, "empty": part.filter("p_partkey < 0"), "loaded": loaded, "changed": part.withColumn("p_retailprice", price)}
    out = None
    for name, target in targets.items():
        one = ig.target_state(part, target, "p_partkey", _FIELDS).select(F.lit(name).alias("target"), "state")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "declared_constraints",
    """SELECT test_id, actual, 0 AS expected, CASE WHEN actual = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT unnest(['pk','not_null_p_name','not_null_p_brand','check_price_positive','check_size_small']) AS test_id,
       unnest([count(*) - count(DISTINCT p_partkey), count(*) FILTER (p_name IS NULL), count(*) FILTER (p_brand IS NULL), count(*) FILTER (NOT p_retailprice > 0), count(*) FILTER (NOT p_size < 50)]) AS actual FROM {loaded_parts})""",
)
def declared_constraints(spark, d):
    """I06."""
    return ig.declared_constraints(
        load(spark, d, "loaded_parts"), "p_partkey", ["p_name", "p_brand"],
        {"price_positive": F.col("p_retailprice") > 0, "size_small": F.col("p_size") < 50},
    )


@query(
    "group_distribution",
    "SELECT p_type, coalesce(s,0) AS source_rows, coalesce(t,0) AS target_rows, CASE WHEN coalesce(s,0)=coalesce(t,0) THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT p_type, count(*) AS s FROM part GROUP BY 1) FULL OUTER JOIN (SELECT p_type, count(*) AS t FROM {loaded_parts} GROUP BY 1) USING (p_type)",
)
def group_distribution(spark, d):
    """I05 category distribution."""
    return ig.group_distribution(load(spark, d, "part"), load(spark, d, "loaded_parts"), "p_type")


@query(
    "upserted_parts",
    """SELECT p_partkey, p_brand, p_retailprice, action, CASE WHEN action IN ('INSERTED','UPDATED') THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at FROM (
        SELECT coalesce(c.p_partkey, i.p_partkey) AS p_partkey, CASE WHEN i.p_partkey IS NULL THEN c.p_brand ELSE i.p_brand END AS p_brand, CASE WHEN i.p_partkey IS NULL THEN c.p_retailprice ELSE i.p_retailprice END AS p_retailprice,
          CASE WHEN c.p_partkey IS NULL THEN 'INSERTED' WHEN i.p_partkey IS NULL THEN 'KEPT' WHEN c.p_brand IS DISTINCT FROM i.p_brand OR c.p_retailprice IS DISTINCT FROM i.p_retailprice THEN 'UPDATED' ELSE 'UNCHANGED' END AS action
        FROM part c FULL OUTER JOIN {loaded_parts} i ON c.p_partkey = i.p_partkey)""",
)
def upserted_parts(spark, d):
    """I08."""
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    current = load(spark, d, "part").withColumns({"created_at": t0, "updated_at": t0})
    out = ig.upsert(
        current, load(spark, d, "loaded_parts"), "p_partkey", ["p_brand", "p_retailprice"],
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"),
    )
    return out.drop("created_at")


_CHANGED = "SELECT p_partkey, p_name, CASE WHEN p_partkey % 100 = 3 THEN p_brand || ' new' ELSE p_brand END AS p_brand, p_retailprice FROM part WHERE p_partkey % 50 < 49"


@query(
    "parts_table_after_changes",
    f"""WITH i AS ({_CHANGED} UNION ALL SELECT p_partkey + 100000000, p_name, p_brand, p_retailprice FROM part WHERE p_partkey % 100 = 5)
        SELECT p_partkey, i.p_brand, CASE WHEN p_partkey % 100 = 3 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM i WHERE p_partkey < 100000000
        UNION ALL SELECT p_partkey, p_brand, TIMESTAMP '2024-02-01 00:00:00', TIMESTAMP '2024-02-01 00:00:00' FROM i WHERE p_partkey >= 100000000
        UNION ALL SELECT p_partkey, p_brand, TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 00:00:00' FROM part WHERE p_partkey % 50 = 49""",
)
def parts_table_after_changes(spark, d):
    """I08 on a stored table: changed, new, repeated and missing rows; only touched folders are rewritten."""
    part, fields = load(spark, d, "part"), ["p_name", "p_brand", "p_retailprice"]
    path = f"{shared_folder(spark)}/sources/parts-{uuid.uuid4().hex}"
    first, later = (F.lit(f"2024-0{m}-01 00:00:00").cast("timestamp_ntz") for m in (1, 2))
    upserts.create_table(part, path, "p_partkey", fields, first, buckets=16)
    some = part.filter("p_partkey % 50 < 49").withColumn(
        "p_brand", F.when(F.col("p_partkey") % 100 == 3, F.concat("p_brand", F.lit(" new"))).otherwise(F.col("p_brand"))
    )
    new = part.filter("p_partkey % 100 = 5").withColumn("p_partkey", F.col("p_partkey") + 100_000_000)
    names = ["p_partkey", *fields]
    upserts.apply_changes(spark, path, some.select(*names).unionByName(new.select(*names)), fields, later)
    return upserts.read_table(spark, path).select("p_partkey", "p_brand", "updated_at", "created_at")


@query(
    "snapshot_consistency",
    "SELECT (SELECT count(*) FROM part) AS source_rows, (SELECT count(*) FROM {loaded_parts}) AS target_rows, true AS same_after_shuffle, false AS same_as_loaded FROM (SELECT count(*) AS n FROM part WHERE p_size IN (7,9,13,21)) WHERE n > 0",
)
def snapshot_consistency(spark, d):
    """The content hash ignores row order and sees every change."""
    part, loaded = load(spark, d, "part"), load(spark, d, "loaded_parts")
    a = sinks.content_hash(part).withColumnsRenamed({"row_count": "source_rows", "content_hash": "a"})
    b = sinks.content_hash(part.repartition(7)).select(F.col("content_hash").alias("b"))
    c = sinks.content_hash(loaded).withColumnsRenamed({"row_count": "target_rows", "content_hash": "c"})
    joined = a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each
    return joined.select(
        "source_rows", "target_rows", (F.col("a") == F.col("b")).alias("same_after_shuffle"),
        (F.col("a") == F.col("c")).alias("same_as_loaded"),
    )


@query(
    "input_contract",
    f"""SELECT test_id, actual, 0 AS expected, CASE WHEN actual = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
        SELECT unnest(['id_blank','id_too_long','id_duplicate','name_blank','category_blank','price_not_positive','rating_range','specs_not_json','text_problem']) AS test_id,
          unnest([count(*) FILTER (trim(uniq_id) = ''), count(*) FILTER (length(uniq_id) > 64), count(*) - count(DISTINCT uniq_id), count(*) FILTER (coalesce(trim(name_clean),'') = ''), count(*) FILTER (coalesce(trim(category),'') = ''),
            count(*) FILTER (NOT coalesce(dp > 0, false)), count(*) FILTER (rating NOT BETWEEN 1 AND 5), 0, count(*) FILTER (regexp_matches(name_clean || ' ' || coalesce(desc_clean,''), '(Product|Category|Brand|Specifications|Description):'))]) AS actual
        FROM ({_PREPARED}) WHERE uniq_id IN ({_KEPT}))""",
)
def input_contract(spark, d):
    """I01 over the cleaned catalog with its search texts."""
    built, _ = build_search_texts(clean_catalog(_raw(spark, d)))
    return ig.input_contract(built)


# Each fault of the derived products, as SQL over the columns it sits in.
_ROW_FAULTS = {
    **{f"null_{c}": f"{c} IS NULL" for c in ig.MANDATORY if c != "embedding"},
    **{f"blank_{c}": f"trim({c}) = ''" for c in ("product_name", "category", "retrieval_text", "embedding_model")},
    "price_not_positive": "discounted_price <= 0", "retail_not_positive": "retail_price <= 0",
    "rating_range": "rating < 1 OR rating > 5",
    "specs_not_array": "product_specifications NOT LIKE '[%'",
    **{f"vector_{n}": f"v_fault = '{f}'" for n, f in
       (("missing", "missing"), ("dimension", "dimension"), ("nan", "nan"), ("inf", "inf"), ("zero", "zero"), ("not_unit", "long"))},
    "timestamps_missing": "created_at IS NULL OR updated_at IS NULL", "updated_before_created": "updated_at < created_at",
}


def _faults_sql(table, checks):
    return " UNION ALL ".join(f"SELECT '{n}' AS test_id, count(*) FILTER ({c}) AS actual FROM {table}" for n, c in checks.items())


def _status_sql(rows):
    return f"SELECT test_id, cast(actual AS BIGINT) AS actual, 0 AS expected, CASE WHEN actual = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({rows})"


_DUPLICATES = "SELECT 'id_duplicate' AS test_id, count(product_id) - count(DISTINCT product_id) AS actual FROM {0}"


def _faulty(spark, d, name):
    """Derived products with their vectors, damaged as ``v_fault`` says."""
    vectors = part_vectors(spark, d).select(F.col("product_id").cast("bigint").alias("p_partkey"), "embedding")
    unit = F.transform("embedding", lambda x: x / norm(F.col("embedding")))
    first = lambda value: F.transform("e", lambda x, i: F.when(i == 0, F.lit(value)).otherwise(x))
    fault = F.col("v_fault")
    moved = F.transform("e", lambda x: -x) if name == "faulty_load" else F.col("e")
    damaged = (
        F.when(fault == "missing", F.lit(None))
        .when(fault == "dimension", F.slice("e", 1, 63))
        .when(fault == "nan", first(float("nan")))
        .when(fault == "inf", first(float("inf")))
        .when(fault == "zero", F.transform("e", lambda x: x * 0))
        .when(fault == "long", F.transform("e", lambda x: x * 3))
        .when(fault == "drift", moved)
        .otherwise(F.col("e"))
    )
    rows = load(spark, d, name).join(vectors, "p_partkey").withColumn("e", unit)
    return rows.withColumn("embedding", damaged).drop("e", "v_fault", "p_partkey")


@query(
    "processed_contract",
    _status_sql(
        "SELECT 'column_order' AS test_id, 1 AS actual UNION ALL SELECT 'columns_missing', 1 UNION ALL "
        + _DUPLICATES.format("{faulty_products}") + " UNION ALL " + _faults_sql("{faulty_products}", _ROW_FAULTS)
    ),
)
def processed_contract(spark, d):
    """I02 over products with one kind of fault per part size, a missing and a misplaced column."""
    wanted = ["product_id", "category", "product_name", "description", "embedding", "embedding_model"]
    return ig.processed_contract(_faulty(spark, d, "faulty_products"), wanted, 64, timestamps=True)


_PAIRED = """(SELECT s.product_id AS sid, t.product_id AS tid, s.v_fault AS v_fault, {0} FROM (SELECT * FROM {{faulty_products}} WHERE product_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY p_partkey) = 1) s
   FULL OUTER JOIN (SELECT * FROM {{faulty_load}} WHERE product_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY p_partkey) = 1) t ON s.product_id = t.product_id)""".format(
    ", ".join(f"s.{c} IS DISTINCT FROM t.{c} AS d_{c}" for c in ig.COMPARED)
)
_BOTH = "sid IS NOT NULL AND tid IS NOT NULL"


@query(
    "loaded_contract",
    _status_sql(
        _faults_sql(
            _PAIRED,
            {
                "missing_rows": "tid IS NULL", "unexpected_rows": "sid IS NULL", **{f"content_{c}": f"{_BOTH} AND d_{c}" for c in ig.COMPARED},
                "vector_drift": f"{_BOTH} AND v_fault IN ('drift', 'nan', 'inf')", "self_distance": f"{_BOTH} AND v_fault IN ('drift', 'nan', 'inf', 'zero')",
            },
        )
        + " UNION ALL " + _DUPLICATES.format("{faulty_load}") + " UNION ALL " + _faults_sql("{faulty_load}", _ROW_FAULTS)
    ),
)
def loaded_contract(spark, d):
    """A load that lost, renamed, changed and moved rows."""
    return ig.loaded_contract(_faulty(spark, d, "faulty_products"), _faulty(spark, d, "faulty_load"), 64)


def _any(*prefixes):
    return " OR ".join(f"coalesce({c}, false)" for n, c in _ROW_FAULTS.items() if n.startswith(prefixes))


@query(
    "integrity_battery",
    f"""SELECT test_id, name, cast(expected AS BIGINT) AS expected, cast(actual AS BIGINT) AS actual, CASE WHEN expected = actual THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT 'A01' AS test_id, 'row count' AS name, (SELECT count(*) FROM {{faulty_products}}) AS expected, (SELECT count(*) FROM {{faulty_load}}) AS actual
      UNION ALL SELECT 'A02', 'distinct ids', (SELECT count(DISTINCT product_id) FROM {{faulty_products}}), (SELECT count(DISTINCT product_id) FROM {{faulty_load}})
      UNION ALL SELECT 'A03', 'category distribution', 0, (SELECT count(*) FROM (SELECT category, count(*) AS n FROM {{faulty_products}} GROUP BY 1) s FULL OUTER JOIN (SELECT category, count(*) AS n FROM {{faulty_load}} GROUP BY 1) t ON s.category IS NOT DISTINCT FROM t.category WHERE s.n IS DISTINCT FROM t.n)
      UNION ALL SELECT 'A04', 'mandatory columns', 0, (SELECT count(*) FROM {{faulty_load}} WHERE {_any('null_', 'blank_')})
      UNION ALL SELECT 'A05', 'prices', 0, (SELECT count(*) FROM {{faulty_load}} WHERE {_any('price_', 'retail_')})
      UNION ALL SELECT 'A06', 'ratings', 0, (SELECT count(*) FROM {{faulty_load}} WHERE {_any('rating_')})
      UNION ALL SELECT 'A07', 'specifications', 0, (SELECT count(*) FROM {{faulty_load}} WHERE {_any('specs_', 'null_product_specifications')})
      UNION ALL SELECT 'A08', 'vectors', 0, (SELECT count(*) FROM {{faulty_load}} WHERE {_any('vector_')})
      UNION ALL SELECT 'A09', 'timestamps', 0, (SELECT count(*) FROM {{faulty_load}} WHERE {_any('timestamps_', 'updated_')})
      UNION ALL SELECT 'A10', 'source consistency', 0, (SELECT count(*) FROM {_PAIRED} WHERE sid IS NULL OR tid IS NULL OR {' OR '.join(f'd_{c}' for c in ig.COMPARED)}))""",
)
def integrity_battery(spark, d):
    """All ten tests, all of which this load fails."""
    return ig.integrity_battery(_faulty(spark, d, "faulty_products"), _faulty(spark, d, "faulty_load"), 64)


_ISSUES = f"""{_ADJ}, iss AS MATERIALIZED (SELECT unnest(['ERROR','ERROR','ERROR','ERROR','ERROR','ERROR','WARNING','WARNING','ERROR','ERROR','ERROR','WARNING','WARNING']) AS severity,
   unnest(['duplicate_query','pool_unknown_query','pool_duplicate_pair','candidate_not_in_catalog','review_a_outside_pool','review_b_outside_pool','pair_without_review_a','pair_without_review_b','qrel_outside_pool','qrel_without_resolution','qrel_differs_from_adjudication','unresolved_pair','query_without_pool']) AS "check",
   unnest([0,0,0,(SELECT count(*) FROM pool WHERE doc_id % 10 = 9),0,0,(SELECT count(*) FROM pool WHERE doc_id % 10 = 0),0,0,(SELECT count(*) FROM ad WHERE resolution <> 'RESOLVED'),(SELECT count(*) FROM ad WHERE resolution = 'RESOLVED' AND grade_a <> final_grade),
     (SELECT count(*) FROM ad WHERE resolution <> 'RESOLVED'),(SELECT count(*) FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM pool))]) AS "rows")"""


def _issues(spark, d):
    pool = lb.candidate_pool(frozen_runs(spark, d), 20).select("query_id", "doc_id")
    judged = _judged(spark, d)
    adjudicated = _adjudicated(spark, d)
    return ig.benchmark_issues(
        load(spark, d, "benchmark").select(F.col("item_id").alias("query_id")),
        pool,
        load(spark, d, "doc_products").filter("doc_id % 10 <> 9").select("doc_id"),
        _side(judged, "a").filter("doc_id % 10 <> 0"),
        _side(judged, "b"),
        adjudicated,
        adjudicated.select("query_id", "doc_id", F.col("grade_a").alias("grade")),
    )


@query("benchmark_issues", f"{_ISSUES} SELECT severity, \"check\", \"rows\" FROM iss")
def benchmark_issues(spark, d):
    """A benchmark with known gaps (reviews missing for ids ending in 0)."""
    return _issues(spark, d)


def _faulty_benchmark(spark, d):
    """Runs, pool, adjudications and claims of the captured benchmark with one kind of fault per id."""
    runs = frozen_runs(spark, d).select("query_id", "method", "doc_id", "rank")
    torn = runs.unionByName(runs.filter("method = 'hybrid' AND rank = 1")).unionByName(
        runs.filter("rank = 2").selectExpr("query_id + 1000000 AS query_id", "method", "doc_id + 1000000 AS doc_id", "rank")
    )
    products = load(spark, d, "doc_products").select("doc_id", "category", "brand", "price")
    pooled = lb.candidate_pool(frozen_runs(spark, d), 20).join(products, "doc_id")
    single = F.col("query_id") % 10 == 6
    pool = pooled.select(
        "query_id", "doc_id",
        F.when(single, F.array(F.lit("tfidf"))).otherwise(F.transform("membership", lambda m: m["method"])).alias("methods"),
        (F.count(F.lit(1)).over(Window.partitionBy("query_id")) + F.when(F.col("query_id") % 10 == 8, 1).otherwise(0)).alias("candidate_count"),
        "category", F.when(F.col("doc_id") % 10 == 4, F.lit("changed")).otherwise(F.col("brand")).alias("brand"), "price", "fingerprint",
        F.when(F.col("doc_id") % 10 == 5, F.lit("old")).otherwise(F.col("fingerprint")).alias("stored_fingerprint"),
    )
    turn = F.col("doc_id") % 10
    grade = F.when(turn == 7, F.lit(5)).when((turn == 6) & (F.col("resolution") == "RESOLVED"), F.lit(3)).otherwise(F.col("final_grade"))
    adjudicated = _adjudicated(spark, d).filter(turn != 3).select(
        "query_id", "doc_id", "resolution", grade.alias("final_grade"), *[F.col(f) for f in lb.FLAGS]
    )
    claims = claim_adjudication(spark, d).join(claim_review_errors(spark, d), "claim_id").select(
        "claim_id", "resolution", F.filter(F.split("errors", r"\|"), lambda e: e != "").alias("problems")
    )
    return torn, pool, adjudicated, claims, products


_CONTENT = f"""{_ADJ}, fr AS MATERIALIZED (SELECT query_id, method, doc_id, rank FROM runs UNION ALL SELECT query_id, method, doc_id, rank FROM runs WHERE method = 'hybrid' AND rank = 1 UNION ALL SELECT query_id + 1000000, method, doc_id + 1000000, rank FROM runs WHERE rank = 2),
  fa AS MATERIALIZED (SELECT *, CASE WHEN doc_id % 10 = 7 THEN 5 WHEN doc_id % 10 = 6 AND resolution = 'RESOLVED' THEN 3 ELSE final_grade END AS fg FROM ad WHERE doc_id % 10 <> 3),
  cl AS MATERIALIZED (SELECT claim_id, resolution, errors <> '' AS bad FROM ({ORACLES['claim_adjudication']}) JOIN ({ORACLES['claim_review_errors']}) USING (claim_id)),
  con AS MATERIALIZED (SELECT unnest(['ERROR','ERROR','ERROR','ERROR','ERROR','ERROR','ERROR','ERROR','ERROR','ERROR','ERROR','WARNING','WARNING']) AS severity,
   unnest(['duplicate_run_product','duplicate_run_rank','run_unknown_query','run_product_not_in_catalog','candidate_differs_from_catalog','candidate_count_mismatch','stale_fingerprint','invalid_grade','high_grade_with_violation','pair_without_adjudication','invalid_claim','unresolved_claim','single_method_pool']) AS "check",
   unnest([(SELECT count(*) FROM (SELECT 1 FROM fr GROUP BY query_id, method, doc_id HAVING count(*) > 1)), (SELECT count(*) FROM (SELECT 1 FROM fr GROUP BY query_id, method, rank HAVING count(*) > 1)),
     (SELECT count(*) FROM fr WHERE query_id NOT IN (SELECT item_id FROM benchmark)), (SELECT count(*) FROM fr WHERE doc_id NOT IN (SELECT doc_id FROM prods)), (SELECT count(*) FROM pool WHERE doc_id % 10 = 4),
     (SELECT count(DISTINCT query_id) FROM pool WHERE query_id % 10 = 8), (SELECT count(*) FROM pool WHERE doc_id % 10 = 5), (SELECT count(*) FROM fa WHERE resolution = 'RESOLVED' AND fg NOT IN (0,1,2,3)),
     (SELECT count(*) FROM fa WHERE resolution = 'RESOLVED' AND fg >= 2 AND (category_violation OR brand_violation OR price_violation OR rating_violation)), (SELECT count(*) FROM pool WHERE doc_id % 10 = 3),
     (SELECT count(*) FROM cl WHERE bad), (SELECT count(*) FROM cl WHERE resolution <> 'RESOLVED'), (SELECT count(*) FROM (SELECT query_id FROM runs GROUP BY query_id HAVING count(DISTINCT method) = 1 OR query_id % 10 = 6))]) AS "rows")"""


def _content_issues(spark, d):
    runs, pool, adjudicated, claims, products = _faulty_benchmark(spark, d)
    queries = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return ig.benchmark_content_issues(queries, runs, pool, products, adjudicated, claims, ["category", "brand", "price"], lb.FLAGS)


@query("benchmark_content_issues", f"{_CONTENT} SELECT severity, \"check\", \"rows\" FROM con")
def benchmark_content_issues(spark, d):
    """Copied fields, counts, fingerprints, grades, adjudications and claims of a benchmark with every fault."""
    return _content_issues(spark, d)


@query(
    "readiness_gates",
    f"""{_ISSUES}, cl AS (SELECT count(*) FILTER (resolution <> 'RESOLVED') AS n FROM ({ORACLES['claim_adjudication']})), sp AS (SELECT count(*) AS n FROM ({ORACLES['split_problems']})), ul AS (SELECT count(*) AS n FROM ad WHERE resolution <> 'RESOLVED')
        SELECT queries, pairs, cast(errors AS BIGINT) AS errors, cast(warnings AS BIGINT) AS warnings, errors = 0 AS structurally_valid, queries >= 20 AS enough_queries, pairs >= 500 AS enough_pairs, warnings = 0 AS fully_resolved,
          ul.n AS open_labels, cl.n AS open_claims, sp.n AS open_splits, ul.n = 0 AS labels_done, cl.n = 0 AS claims_done, sp.n = 0 AS splits_done, errors = 0 AND queries >= 20 AND pairs >= 500 AND warnings = 0 AND ul.n + cl.n + sp.n = 0 AS ready
        FROM (SELECT count(DISTINCT query_id) AS queries, count(*) AS pairs FROM pool), (SELECT sum(CASE WHEN severity='ERROR' THEN "rows" ELSE 0 END) AS errors, sum(CASE WHEN severity='WARNING' THEN "rows" ELSE 0 END) AS warnings FROM iss), cl, sp, ul""",
)
def readiness_gates(spark, d):
    """Structure, size, labels, claims and splits."""
    pool = lb.candidate_pool(frozen_runs(spark, d), 20)
    totals = pool.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("pairs"))
    todo = {
        "labels": _adjudicated(spark, d).filter("resolution <> 'RESOLVED'"),
        "claims": claim_adjudication(spark, d).filter("resolution <> 'RESOLVED'"),
        "splits": split_problems(spark, d),
    }
    return ig.readiness_gates(_issues(spark, d), totals, 20, 500, todo)


@query(
    "benchmark_coverage",
    f"""{_ADJ} SELECT lang, source, count(DISTINCT query_id) AS queries, count(*) AS pairs, {', '.join(f'count(*) FILTER (final_grade = {g}) AS grade_{g}' for g in range(4))}, count(*) FILTER (final_grade IS NULL) AS unjudged
        FROM ad JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))""",
)
def benchmark_coverage(spark, d):
    """A24."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "source")
    rows = _adjudicated(spark, d).join(docs, "doc_id")
    return ig.coverage(rows, ["lang", "source"], "final_grade")


@query(
    "audited_pairs",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_tax >= 0.06)",
)
def audited_pairs(spark, d):
    """Orders that have an audited line item."""
    audited = load(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_tax >= 0.06")
    orders = load(spark, d, "orders")
    return orders.join(audited, orders["o_orderkey"] == audited["l_orderkey"], "left_semi").select("o_orderkey", "o_orderpriority")


# ------------------------------------------------------------------------ sessions
_SESS = """SELECT user_id, event_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session, ts FROM (
  SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600 THEN 1 ELSE 0 END AS n FROM events)"""


@query("session_ids", f"SELECT event_id, user_id, cast(session AS BIGINT) AS session FROM ({_SESS})")
def session_ids(spark, d):
    """ST01 batch twin."""
    return ss.sessionize(load(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "session")


@query(
    "session_turns",
    f"SELECT user_id, cast(session AS BIGINT) AS session, event_id, cast(r AS INT) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts DESC, event_id DESC) AS r FROM ({_SESS})) WHERE r <= 10",
)
def session_turns(spark, d):
    """W12 over sessions: the last ten turns of each."""
    rows = ss.sessionize(load(spark, d, "events"), "user_id", "ts", "event_id")
    last = ss.last_turns(rows, ["user_id", "session"], [F.desc("ts"), F.desc("event_id")])
    return last.select("user_id", "session", "event_id", "recency")


@query(
    "conversation_tail",
    "SELECT conv_id, turn, role, text, cast(r AS INT) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10",
)
def conversation_tail(spark, d):
    """W12 over conversations."""
    rows = load(spark, d, "conversations")
    return ss.last_turns(rows, ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role", "text", "recency")


# Turns arrive after a delay of up to five minutes, some of them far too late, in three parts.
_DELAY = "CASE WHEN (event_id * 7919) % 100 < 85 THEN event_id % 300 ELSE 600 + event_id % 3000 END"
_PARTS = 3


@query(
    "stream_sessions",
    f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, epoch_us(ts) + 1000000 * ({_DELAY}) AS arr FROM events),
        s AS (SELECT *, least({_PARTS - 1}, (arr - min(arr) OVER ()) * {_PARTS} // (max(arr) OVER () - min(arr) OVER () + 1)) AS part FROM e),
        mx AS (SELECT part, max(us) AS m FROM s GROUP BY part),
        wm AS (SELECT a.part, max(b.m) // 1000 - {1000 * sst.LATENESS_SECONDS} AS w FROM mx a JOIN mx b ON b.part < a.part GROUP BY 1),
        kept AS (SELECT s.* FROM s LEFT JOIN wm USING (part) WHERE w IS NULL OR us > w * 1000),
        n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= {1000000 * ss.TTL_SECONDS} THEN 0 ELSE 1 END AS starts FROM kept),
        g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM n)
        SELECT user_id, min(us) AS started, max(us) AS ended, count(*) AS turns, array_to_string(list(event_id ORDER BY us, event_id)[-{ss.MAX_TURNS}:], ',') AS recent
        FROM g GROUP BY user_id, session
        HAVING (max(us) + {1000000 * ss.TTL_SECONDS}) // 1000 + 1 <= (SELECT max(us) // 1000 - {1000 * sst.LATENESS_SECONDS} FROM e)""",
)
def stream_sessions(spark, d):
    """ST01 as a stream: sessions closed by timers, restarted after every part, late turns dropped."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    at = F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz"))
    events = load(spark, d, "events").select("event_id", F.col("user_id").alias("user_key"), at.alias("at"))
    timed = cut_lineage(events.withColumn("arr", F.col("at") + 1_000_000 * F.expr(_DELAY)))
    lo, hi = timed.agg(F.min("arr"), F.max("arr")).first()
    part = F.least(F.lit(_PARTS - 1), F.call_function("div", (F.col("arr") - F.lit(lo)) * _PARTS, F.lit((hi or 0) - (lo or 0) + 1)))
    turns = timed.select("user_key", F.timestamp_micros("at").alias("ts"), F.col("event_id").alias("turn"), part.alias("part"))
    out = sst.replay([turns.filter(F.col("part") == k).drop("part") for k in range(_PARTS)])
    recent = F.array_join(F.transform("recent", lambda i: i.cast("string")), ",")
    return out.select(F.col("user_key").alias("user_id"), "started", "ended", "turns", recent.alias("recent"))
