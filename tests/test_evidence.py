"""Evidence rows in joins."""

from merchlens.operators import evidence as vd
from merchlens.plans import derived, evidence_queries

PRODUCT = (
    "product_id string, product_name string, category string, brand string, discounted_price double, rating double, retrieval_text string"
)


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def _evidence(spark):
    rows = [(str(i), f"p{i}", "c", None, 1.0, 2.0, f"Specifications: a: {i}; b: 2 | Description: Long enough sentence.") for i in range(20)]
    return vd.evidence_rows(spark.createDataFrame(rows, PRODUCT))


def test_evidence_is_never_broadcast(spark):
    claims = spark.createDataFrame(
        [("q", "1", "strengths", 0, ["1-E1", "2-E1", "1-E99"])],
        "query_id string, product_id string, kind string, no int, evidence_ids array<string>",
    )
    out = vd.citation_check(claims, _evidence(spark))
    assert _broadcasts(out) == 0
    assert {(r.evidence_id, r.status) for r in out.collect()} == {("1-E1", "VALID"), ("2-E1", "OTHER_PRODUCT"), ("1-E99", "NO_SUCH_EVIDENCE")}


def test_derived_products_are_never_broadcast(spark, tmp_path):
    spark.range(5).selectExpr(
        "id AS p_partkey", "'n m' AS p_name", "'t' AS p_type", "'b' AS p_brand", "cast(7 AS int) AS p_size", "1.0D AS p_retailprice"
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(10).selectExpr("id AS l_orderkey", "id % 5 AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = derived.load(spark, str(tmp_path), "order_candidates")
    assert _broadcasts(out) == 0 and out.count() == 10


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_warnings_need_no_cleaned_claims(spark):
    cands = spark.createDataFrame(
        [("q1", "p1", 1), ("q1", "p2", 2), ("q2", "p1", 1)], "query_id string, product_id string, rank int"
    ).selectExpr("*", "product_id AS product_name", "'c' AS category", "'b' AS brand", "1.0D AS discounted_price", "4.0D AS rating")
    claim = "array(named_struct('claim', 'x', 'evidence_ids', array({})))"
    items = spark.createDataFrame([("q1", 0, "p1"), ("q1", 1, "p9"), ("q2", 0, "p9")], "query_id string, pos int, product_id string").selectExpr(
        "query_id", "pos",
        f"named_struct('product_id', product_id, 'summary_reason', 's', 'comparison_note', 'n', 'strengths', "
        f"{claim.format(chr(39) + 'p1-E1' + chr(39) + ', ' + chr(39) + 'p2-E1' + chr(39))}, 'limitations', {claim.format(chr(39) + 'p1-E7' + chr(39))}) AS item",
    )
    evidence = spark.createDataFrame([("p1-E1", "p1"), ("p2-E1", "p2")], "evidence_id string, product_id string")
    merged, warnings = vd.merge_generated(cands, items, evidence)
    assert "_strengths" in _plan(merged) and "_strengths" not in _plan(warnings)
    got = {(r.query_id, r.product_id): (r.source, [(c.claim, c.evidence_ids) for c in r.strengths]) for r in merged.collect()}
    assert got["q1", "p1"] == ("GENERATED", [("x", ["p1-E1"])])
    assert got["q1", "p2"][0] == "OMITTED" and got["q1", "p2"][1][0][1] == ["p2-E1"]
    assert got["q2", "p1"][0] == "FALLBACK" and len(got) == 3
    assert sorted((r.query_id, r.product_id or "", r.warning, r.evidence_id or "") for r in warnings.collect()) == [
        ("q1", "p1", "NO_SUCH_EVIDENCE", "p1-E7"), ("q1", "p1", "OTHER_PRODUCT", "p2-E1"), ("q1", "p2", "OMITTED_PRODUCT", ""),
        ("q1", "p9", "UNKNOWN_PRODUCT", ""), ("q2", "", "NO_KNOWN_PRODUCT", ""),
    ]


def test_context_blocks_make_candidates_once(spark, monkeypatch):
    cands = spark.createDataFrame([("1", "1"), ("1", "2"), ("2", "2")], "query_id string, product_id string").selectExpr(
        "*", "row_number() OVER (PARTITION BY query_id ORDER BY product_id) AS rank"
    )
    products = spark.createDataFrame([("1", "lamp"), ("2", "sofa")], "product_id string, product_name string").selectExpr(
        "*", "'c' AS category", "'b' AS brand", "1.0D AS discounted_price", "4.0D AS rating", "'' AS retrieval_text"
    )
    monkeypatch.setattr(evidence_queries, "load", lambda _, __, name: {"order_candidates": cands, "products": products}[name])
    out = evidence_queries.context_blocks(spark, "")
    assert "row_number" not in _plan(out)
    got = {r.query_id: r.context for r in out.collect()}
    assert set(got) == {"1", "2"} and got["1"].index("lamp") < got["1"].index("sofa") and "lamp" not in got["2"]
