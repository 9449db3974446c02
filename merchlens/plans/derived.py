"""Tables derived row by row from the given ones.

The given tables hold no product catalog and no shopper log, so both are derived
here, from whole tables, with SQL that Spark and the checking engine both run.
A derived table names its inputs as {name}.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from merchlens.sources.readers import table

SQL: dict[str, str] = {}

# One listing per line item: dirty names, brands, prices, ratings and specs.
SQL["raw_catalog"] = """
SELECT cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-' || cast(l_partkey AS string)
         || '-' || cast(l_suppkey AS string) || '-' || cast(cast(l_quantity AS bigint) AS string) AS uniq_id,
       cast(l_partkey AS string) || '/' || cast(l_suppkey AS string) AS pid,
       CASE WHEN l_returnflag = 'A' THEN '  ' || upper(p_name) || ' ' WHEN l_tax = 0.05 THEN NULL ELSE p_name END AS product_name,
       CASE WHEN l_tax = 0.06 THEN NULL WHEN l_returnflag = 'R' THEN '["' || p_type || ' >> ' || p_name || '"]'
            ELSE '["' || p_type || '"]' END AS product_category_tree,
       CASE WHEN l_tax = 0.04 THEN NULL ELSE cast(cast(p_retailprice AS decimal(12,2)) AS string) END AS retail_price,
       CASE WHEN l_tax = 0.01 THEN '0' WHEN l_tax = 0.02 THEN 'not available' WHEN l_tax = 0.03 THEN '2000.5'
            ELSE cast(cast(p_retailprice - l_quantity AS decimal(12,2)) AS string) END AS discounted_price,
       CASE WHEN l_tax = 0.08 THEN NULL WHEN l_tax = 0.07 THEN 'None' WHEN l_returnflag = 'A' THEN upper(p_brand)
            WHEN l_returnflag = 'N' THEN lower(p_brand) ELSE p_brand || '  ' END AS brand,
       CASE WHEN l_discount = 0.0 THEN 'No rating available' WHEN l_discount = 0.01 THEN NULL
            ELSE cast(cast(l_discount * 50 AS decimal(4,1)) AS string) END AS product_rating,
       CASE WHEN l_tax >= 0.04 THEN cast(cast(l_tax * 50 AS decimal(4,1)) AS string) ELSE 'No rating available' END AS overall_rating,
       CASE WHEN l_discount = 0.02 THEN NULL WHEN l_discount = 0.03 THEN '   ' WHEN l_linestatus = 'F'
            THEN p_name || ' made by ' || p_brand || '. Free Shipping. Size ' || cast(p_size AS string) || ' fits most rooms well.'
            ELSE 'Buy ' || p_name || ' at https://shop.example.com/' || cast(p_partkey AS string) || ' <b>today</b>' END AS description,
       CASE WHEN l_tax = 0.0 THEN '{"product_specification"=>nil}' WHEN l_discount = 0.1 THEN NULL
            ELSE '{"product_specification"=>[{"key"=>"Size", "value"=>"' || cast(p_size AS string) || '"}, {"key"=>"Finish", "value"=>"'
                 || l_returnflag || l_linestatus || '"}, {"key"=>"Batch", "value"=>' || cast(l_suppkey AS string) || '}]}' END AS product_specifications,
       CASE WHEN l_linestatus = 'F' THEN 'http://img.example.com/' || cast(l_partkey AS string) || '.jpg' ELSE 'ftp://img' END AS image
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
"""

# One shopper query per order, with an existing (stored) interpretation.
SQL["shopper_log"] = """
SELECT cast(o_orderkey AS string) AS query_id, o_orderpriority AS query_type, c_mktsegment AS planning_category,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'vi' ELSE 'en' END AS language,
       c_mktsegment || ':' || cast(c_nationkey AS string) AS intent_group,
       CASE o_orderpriority
         WHEN '1-URGENT' THEN 'I need lightweight running shoes under Rs ' || amt || ' rating at least 4, without leather, not for kids'
         WHEN '2-HIGH' THEN 'show me a compact nike laptop bag up to ' || amt || ' usd for travel'
         WHEN '3-MEDIUM' THEN 'between 100 and ' || amt || ' durable ' || lower(c_mktsegment) || ' watch, no frills, non-slip'
         WHEN '4-NOT SPECIFIED' THEN 'giày nhẹ bền dưới ' || amt || ' nghìn, trừ da, đánh giá từ 4.5'
         ELSE 'around ' || amt || ' something breathable for the sofa, but not too heavy and shockproof' END
       || CASE o_orderstatus WHEN 'F' THEN ' actually make it blue' WHEN 'O' THEN ' at least 50' ELSE '' END AS raw_query,
       CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN cast(amt AS double) END AS max_price,
       CASE WHEN o_orderstatus = 'O' THEN 50.0 WHEN o_orderpriority = '3-MEDIUM' THEN 100.0 END AS min_price,
       CASE WHEN o_orderpriority = '1-URGENT' THEN '<' END AS max_operator,
       CASE WHEN o_orderstatus = 'O' THEN '>' END AS min_operator,
       CASE WHEN o_orderstatus = 'F' THEN 4.0 END AS min_rating,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 'dollars' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'INR' END AS currency,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'running shoes' WHEN '2-HIGH' THEN 'FURNITURE' WHEN '3-MEDIUM' THEN 'a nice watch strap'
         WHEN '4-NOT SPECIFIED' THEN 'Footwear' ELSE lower(c_mktsegment) END AS category,
       CASE o_orderpriority WHEN '2-HIGH' THEN 'nike' WHEN '3-MEDIUM' THEN 'any' ELSE NULL END AS brand,
       CASE o_orderstatus WHEN 'F' THEN 'lightweight|Shoes|not leather' WHEN 'O' THEN 'compact|without zip|durable' ELSE 'leather| Soft  grip |soft grip' END AS prefs,
       CASE WHEN o_orderstatus = 'P' THEN 'UNSUPPORTED_INTENT' ELSE 'SUCCESS' END AS expected_status,
       CASE WHEN o_custkey % 4 = 0 THEN 'leather' WHEN o_custkey % 4 = 1 THEN 'leather strap' END AS stored_exclusion, o_custkey % 5 = 0 AS stored_clarification
FROM (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, cast(cast(floor(o_totalprice) AS bigint) AS string) AS amt FROM {orders}) o
JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

# Every text a person wrote: the shopper log plus the user turns.
SQL["query_texts"] = """
SELECT 'o' || query_id AS query_id, language, query_type, raw_query FROM {shopper_log}
UNION ALL
SELECT 'c' || cast(conv_id AS string) || '-' || cast(turn AS string) AS query_id, 'xx' AS language, 'TURN' AS query_type, text AS raw_query
FROM {conversations} WHERE role = 'user'
"""

# Structured products: one per part, rating from the part size.
SQL["products"] = """
SELECT cast(p_partkey AS string) AS product_id, p_name AS product_name, p_type AS category,
       CASE WHEN p_size = 7 THEN NULL ELSE p_brand END AS brand, p_retailprice AS discounted_price,
       CASE WHEN p_size <= 40 THEN 1.0 + cast(p_size % 5 AS double) END AS rating,
       'Product: ' || p_name || ' | Category: ' || p_type || ' | Brand: ' || p_brand || ' | Specifications: Size: ' || cast(p_size AS string)
         || '; Finish: ' || split_part(p_name, ' ', 1) || ' | Description: ' || p_name || ' for daily use. Free Shipping. Made by ' || p_brand
         || '. Short one. Works in any room of the house.' AS retrieval_text
FROM {part}
"""

# Catalog texts: documents as products with category, brand, price and rating.
SQL["doc_products"] = """
SELECT d.doc_id, d.text, d.lang AS category, d.source AS brand, cast(d.n_chars AS double) AS price,
       cast(CASE WHEN l.quality IS NULL THEN NULL ELSE 2 + 2 * l.quality + (1 - l.toxic) END AS double) AS rating
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

# Batch of text queries with hard constraints and, by id, a query vector.  Some bounds do
# not say whether they are inclusive, some queries stop before retrieval or were not audited.
SQL["search_queries"] = """
SELECT b.item_id AS query_id, b.text, e.embedding,
       CASE WHEN b.item_id % 5 = 1 THEN 'EN' WHEN b.item_id % 5 = 2 THEN 'fr' END AS f_category,
       CASE WHEN b.item_id % 7 = 3 THEN 'src1' END AS f_brand,
       cast(CASE WHEN b.item_id % 3 = 1 THEN 200 END AS double) AS f_min_price,
       cast(CASE WHEN b.item_id % 3 = 2 THEN 6000 END AS double) AS f_max_price,
       CASE WHEN b.item_id % 19 = 4 THEN NULL ELSE b.item_id % 2 = 0 END AS f_min_inclusive,
       CASE WHEN b.item_id % 19 = 4 THEN NULL ELSE b.item_id % 2 = 1 END AS f_max_inclusive,
       cast(CASE WHEN b.item_id % 11 = 4 THEN 4 END AS double) AS f_min_rating,
       b.item_id % 17 <> 3 AS audited,
       CASE WHEN b.item_id % 13 = 5 THEN 'UNSUPPORTED_INTENT' WHEN b.item_id % 13 = 7 THEN 'NO_RESULTS' ELSE 'SUCCESS' END AS expected_status
FROM {benchmark} b LEFT JOIN {embeddings} e ON b.item_id = e.vec_id
"""

# What a generator listed for the candidates of each order: some unknown ids, some
# omissions, some citations of other products or of evidence that does not exist.
SQL["generated"] = """
SELECT cast(l_orderkey AS string) AS query_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos,
       cast(CASE WHEN l_tax = 0.08 THEN l_partkey + 100000000 ELSE l_partkey END AS string) AS product_id,
       'pick ' || cast(l_linenumber AS string) AS reason,
       cast(l_partkey AS string) || '-E1' AS cite_1,
       CASE WHEN l_linestatus = 'F' THEN cast(l_suppkey AS string) || '-E1' END AS cite_2,
       CASE WHEN l_discount = 0.1 THEN cast(l_partkey AS string) || '-E99' END AS cite_3
FROM {lineitem} WHERE l_returnflag <> 'R'
"""

# The candidates of each order, ranked, with catalog fields and a price limit.
SQL["order_candidates"] = """
SELECT c.query_id, c.product_id, row_number() OVER (PARTITION BY c.query_id ORDER BY cast(c.product_id AS bigint)) AS rank,
       p.product_name, p.category, p.brand, p.discounted_price, p.rating, p.retrieval_text, 990.0 AS max_price
FROM (SELECT DISTINCT cast(l_orderkey AS string) AS query_id, cast(l_partkey AS string) AS product_id FROM {lineitem}) c
JOIN {products} p ON c.product_id = p.product_id
"""

# A loaded copy of the parts with missing, changed and unexpected rows.
SQL["loaded_parts"] = """
SELECT CASE WHEN p_size = 9 THEN p_partkey + 100000000 ELSE p_partkey END AS p_partkey, p_name,
       CASE WHEN p_size = 7 THEN NULL ELSE p_brand END AS p_brand, p_type, p_size,
       CASE WHEN p_size = 21 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice
FROM {part} WHERE p_size <> 13
"""

# Extraction answers next to what was expected; each order errs in its own way.
SQL["extraction_cases"] = """
SELECT cast(o_orderkey AS string) AS case_id, o_orderkey % 11 <> 3 AS valid,
       'Footwear' AS e_category, CASE WHEN o_orderkey % 7 = 1 THEN 'footwear' WHEN o_orderkey % 7 = 2 THEN NULL ELSE 'Footwear' END AS a_category,
       CASE WHEN o_custkey % 3 > 0 THEN 'Nike' END AS e_brand, CASE o_custkey % 4 WHEN 0 THEN ' nike ' WHEN 1 THEN 'NIKE' WHEN 2 THEN 'Puma' END AS a_brand,
       CASE WHEN o_custkey % 2 = 0 THEN '100.0' END AS e_min_price, CASE WHEN o_custkey % 4 = 0 THEN '100.0' WHEN o_custkey % 4 = 1 THEN '5.0' END AS a_min_price,
       '990.0' AS e_max_price, CASE WHEN o_orderkey % 9 = 4 THEN '99.0' ELSE '990.0' END AS a_max_price,
       CASE WHEN o_orderkey % 5 = 0 THEN '4.0' END AS e_min_rating, CASE WHEN o_orderkey % 10 = 0 THEN '4.0' END AS a_min_rating,
       CASE WHEN o_orderkey % 6 = 0 THEN 'USD' END AS e_currency, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'INR' WHEN 2 THEN 'INR' END AS a_currency,
       o_orderkey % 8 = 5 AS e_clarify, CASE WHEN o_orderkey % 16 = 5 THEN true WHEN o_orderkey % 16 = 6 THEN NULL ELSE false END AS a_clarify,
       CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'light|Soft Grip' ELSE 'durable' END AS e_soft, CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Light' WHEN 2 THEN 'light| soft grip ' WHEN 3 THEN 'durable|durable' ELSE 'light|soft grip|blue' END AS a_soft,
       CASE WHEN o_orderkey % 2 = 0 THEN 'running shoes' END AS e_type, CASE o_custkey % 3 WHEN 0 THEN ' Running Shoes' WHEN 1 THEN 'boots' END AS a_type,
       CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey % 5 = 0 END AS e_incl, CASE WHEN o_custkey % 5 < 4 THEN o_custkey % 2 = 0 END AS a_incl,
       CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'attribute:leather' ELSE 'brand:nike|attribute:leather' END AS e_excl, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'attribute:Leather' WHEN 2 THEN 'attribute:leather|brand:nike' ELSE 'brand:leather' END AS a_excl
FROM {orders}
"""

# An assembled knowledge base with one kind of fault per part size; ``v_fault`` says what
# is wrong with the row's vector.
SQL["faulty_products"] = """
SELECT CASE WHEN p_size = 3 THEN '1' WHEN p_size = 4 THEN NULL ELSE cast(p_partkey AS string) END AS product_id, p_partkey,
       CASE WHEN p_size = 5 THEN '  ' ELSE p_name END AS product_name, CASE WHEN p_size = 6 THEN NULL ELSE p_type END AS category, p_brand AS brand,
       cast(CASE WHEN p_size = 9 THEN -1 WHEN p_size = 10 THEN NULL ELSE p_retailprice * 2 END AS double) AS retail_price,
       cast(CASE WHEN p_size = 7 THEN 0 WHEN p_size = 8 THEN NULL ELSE p_retailprice END AS double) AS discounted_price,
       cast(CASE WHEN p_size = 11 THEN 5.5 WHEN p_size = 12 THEN 0.5 WHEN p_size = 13 THEN NULL ELSE 4 END AS double) AS rating,
       CASE WHEN p_size = 14 THEN '{"a":1}' WHEN p_size = 15 THEN 'none' WHEN p_size = 16 THEN NULL ELSE '[{"key":"Size","value":"1"}]' END AS product_specifications,
       CASE WHEN p_size = 17 THEN '' ELSE 'Product: ' || p_name END AS retrieval_text,
       CASE p_size WHEN 18 THEN 'missing' WHEN 19 THEN 'dimension' WHEN 20 THEN 'nan' WHEN 21 THEN 'inf' WHEN 22 THEN 'zero' WHEN 23 THEN 'long' WHEN 32 THEN 'drift' END AS v_fault,
       CASE WHEN p_size = 24 THEN ' ' ELSE 'given-64' END AS embedding_model,
       CASE WHEN p_size = 25 THEN NULL ELSE cast('2024-01-02 00:00:00' AS timestamp) END AS created_at,
       CASE WHEN p_size = 26 THEN NULL WHEN p_size = 27 THEN cast('2024-01-01 00:00:00' AS timestamp) ELSE cast('2024-01-03 00:00:00' AS timestamp) END AS updated_at
FROM {part}
"""

# The same after a load that lost, renamed and moved some rows.
SQL["faulty_load"] = """
SELECT CASE WHEN p_partkey % 40 = 29 THEN 'x' || product_id ELSE product_id END AS product_id, p_partkey,
       CASE WHEN p_partkey % 40 = 31 THEN product_name || '!' ELSE product_name END AS product_name,
       CASE WHEN p_partkey % 40 = 33 THEN 'ELSEWHERE' ELSE category END AS category, brand, retail_price, discounted_price, rating, product_specifications,
       retrieval_text, v_fault, embedding_model, created_at, updated_at
FROM {faulty_products} WHERE p_partkey % 40 <> 30
"""

# Tables under heavy per-row work.
SPREAD = ("lineitem", "orders", "documents", "conversations", "pages")

_NAME = re.compile(r"\{([a-z_]+)\}")


def expand(sql: str, seen: tuple[str, ...] = ()) -> str:
    """Inline derived tables as subqueries; given tables stay plain names."""

    def sub(m: re.Match) -> str:
        name = m.group(1)
        return f"({expand(SQL[name])})" if name in SQL else name

    return _NAME.sub(sub, sql)


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A given or derived table as a DataFrame."""
    if name not in SQL:
        return table(spark, directory, name, name in SPREAD)
    sql = SQL[name]
    # Derived columns are wider than the stored sizes say: a derived input is merged, never broadcast.
    inputs = {n: load(spark, directory, n).hint("merge") if n in SQL else load(spark, directory, n) for n in set(_NAME.findall(sql))}
    # spark.sql formats its text: braces that are not table names are doubled.
    text = _NAME.sub(lambda m: f"\0{m.group(1)}\1", sql).replace("{", "{{").replace("}", "}}")
    return spark.sql(text.replace("\0", "{").replace("\1", "}"), **inputs)
