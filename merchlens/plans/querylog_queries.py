"""Query-log queries over the shopper log and over every user text."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchlens.operators import catalog as cat
from merchlens.operators import constraints as cs
from merchlens.operators import querylog as ql
from merchlens.plans.derived import load
from merchlens.plans.registry import query
from merchlens.session import cut_lineage


def _re(patterns) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def _has(patterns, col="q") -> str:
    return f"regexp_matches({col}, '{_re(patterns)}')"


# RE2 word boundaries are ASCII: letters outside ASCII become 'q' first where a
# pattern is plain ASCII, so both engines see the same boundaries.
_ASCII = "regexp_replace({}, '[^\\x00-\\x7F]', 'q', 'g')"
_PREFS = "string_split(prefs, '|')"


def _log(spark, d):
    return load(spark, d, "shopper_log").withColumn("prefs", F.split("prefs", r"\|"))


_LO, _HI = "min_price IS NOT NULL", "max_price IS NOT NULL"
_ISRANGE = f"({_LO} AND {_HI} AND {_has(ql.RANGE_WORDING)})"
_REASON = f"""CASE WHEN NOT ({_LO}) AND NOT ({_HI}) THEN NULL WHEN {_has(ql.AMBIGUOUS_BUDGET)} THEN 'AMBIGUOUS_BUDGET' WHEN {_ISRANGE} THEN NULL
  WHEN {_HI} AND {_has(ql.MAX_STRICT)} AND {_has(ql.MAX_INCLUSIVE)} THEN 'CONFLICTING_UPPER'
  WHEN {_HI} AND NOT {_has(ql.MAX_STRICT)} AND NOT {_has(ql.MAX_INCLUSIVE)} THEN 'UPPER_WITHOUT_OPERATOR'
  WHEN {_LO} AND {_has(ql.MIN_STRICT)} AND {_has(ql.MIN_INCLUSIVE)} THEN 'CONFLICTING_LOWER'
  WHEN {_LO} AND NOT {_has(ql.MIN_STRICT)} AND NOT {_has(ql.MIN_INCLUSIVE)} THEN 'LOWER_WITHOUT_OPERATOR' END"""
_BOUNDARY = f"""
SELECT query_id, reason IS NULL AS resolved, CASE WHEN reason IS NULL AND {_LO} THEN isr OR lo_i END AS min_inclusive,
       CASE WHEN reason IS NULL AND {_HI} THEN isr OR hi_i END AS max_inclusive, reason
FROM (SELECT *, {_REASON} AS reason, {_ISRANGE} AS isr, {_has(ql.MIN_INCLUSIVE)} AS lo_i, {_has(ql.MAX_INCLUSIVE)} AS hi_i
      FROM (SELECT *, trim(raw_query) AS q FROM {{shopper_log}}))
"""


@query("price_boundary", _BOUNDARY)
def price_boundary(spark, d):
    """Q01."""
    log = _log(spark, d)
    b = ql.price_boundary(F.col("raw_query"), F.col("min_price"), F.col("max_price"))
    return log.select("query_id", b.alias("b")).select("query_id", "b.*")


@query(
    "simple_boundary",
    f"""SELECT query_id, NOT regexp_matches(q, '(?i){ql.STRICT_LOWER}') AS min_inclusive, NOT regexp_matches(q, '(?i){ql.STRICT_UPPER}') AS max_inclusive, regexp_matches(q, '(?i){ql.CORRECTION}') AS corrected
        FROM (SELECT query_id, {_ASCII.format('raw_query')} AS q FROM {{query_texts}})""",
)
def simple_boundary(spark, d):
    """Q02 over every user text."""
    rows = load(spark, d, "query_texts").select("query_id", ql.simple_boundary(F.col("raw_query")).alias("b"))
    return rows.select("query_id", "b.*")


_EVP = rf"(?i)(\b(?:not|no|without|never)\s+)??\b({ql.BOUND_WORDS})\s+{ql.BOUND_NUMBER}({ql.BOUND_UNITS})?".replace("'", "''")
_EVIDENCE = f"""
SELECT query_id, list_filter(ev, lambda e: e.lower)[-1].value AS min_value, list_filter(ev, lambda e: e.lower)[-1].inclusive AS min_inclusive,
       list_filter(ev, lambda e: NOT e.lower)[-1].value AS max_value, list_filter(ev, lambda e: NOT e.lower)[-1].inclusive AS max_inclusive
FROM (SELECT query_id, list_transform(list_filter(list_zip(regexp_extract_all(q,'{_EVP}',1), regexp_extract_all(q,'{_EVP}',2), regexp_extract_all(q,'{_EVP}',3), regexp_extract_all(q,'{_EVP}',4)),
        lambda p: coalesce(p[1],'') = '' AND coalesce(p[4],'') = ''),
        lambda p: {{'lower': list_contains(['above','more than','greater than','at least','min','minimum','no less than','not less than','not under','not below'], lower(regexp_replace(p[2],'\\s+',' ','g'))),
         'value': cast(replace(p[3], ',', '') AS DOUBLE), 'inclusive': NOT list_contains(['above','more than','greater than','under','below','less than'], lower(regexp_replace(p[2],'\\s+',' ','g')))}}) AS ev
      FROM (SELECT query_id, {_ASCII.format('raw_query')} AS q FROM {{query_texts}}))
"""


@query("boundary_evidence", _EVIDENCE)
def boundary_evidence(spark, d):
    """Q03 over every user text."""
    rows = load(spark, d, "query_texts").select("query_id", ql.boundary_evidence(F.col("raw_query")).alias("e"))
    return rows.select(
        "query_id",
        F.col("e.min.value").alias("min_value"),
        F.col("e.min.inclusive").alias("min_inclusive"),
        F.col("e.max.value").alias("max_value"),
        F.col("e.max.inclusive").alias("max_inclusive"),
    )


def _amount(i: int) -> str:
    words = ql.PRICE_OPERATORS[i][0]
    n = f"nullif(regexp_extract(q, '(?i){words}{ql.AMOUNT}', 1), '')"
    s = f"lower(regexp_extract(q, '(?i){words}{ql.AMOUNT}', 2))"
    return (
        f"(cast(replace({n}, ',', '') AS DOUBLE) * CASE WHEN {s} IN ('k','thousand','nghìn','ngan') THEN 1000 "
        f"WHEN {s} IN ('m','million','triệu','trieu') THEN 1000000 ELSE 1 END)"
    )


_EXTRACT = f"""
SELECT query_id, coalesce(a3, a2) AS min_price, coalesce(a1, a0) AS max_price,
       CASE WHEN a3 IS NOT NULL THEN '>=' WHEN a2 IS NOT NULL THEN '>' END AS min_operator,
       CASE WHEN a1 IS NOT NULL THEN '<=' WHEN a0 IS NOT NULL THEN '<' END AS max_operator, currency,
       CASE WHEN r BETWEEN 1 AND 5 THEN r END AS min_rating
FROM (SELECT query_id, {', '.join(f'{_amount(i)} AS a{i}' for i in range(4))},
        CASE WHEN regexp_matches(z, '\\b(?:usd|dollars?)\\b|\\$') THEN 'USD' WHEN regexp_matches(q, '€') OR regexp_matches(z, '\\b(?:eur|euros?)\\b') THEN 'EUR' ELSE 'INR' END AS currency,
        TRY_CAST(regexp_extract(q, '{ql.RATING}', 1) AS DOUBLE) AS r
      FROM (SELECT query_id, lower(nfc_normalize(raw_query)) AS q, {_ASCII.format('lower(raw_query)')} AS z FROM {{query_texts}}))
"""


@query("price_rating_extraction", _EXTRACT)
def price_rating_extraction(spark, d):
    """Q04, Q05 over every user text."""
    rows = load(spark, d, "query_texts").select(
        "query_id",
        ql.price_constraints(F.col("raw_query")).alias("p"),
        ql.rating_constraint(F.col("raw_query")).alias("min_rating"),
    )
    return rows.select("query_id", "p.*", "min_rating")


def _count_all(patterns, col) -> str:
    return " + ".join(f"len(regexp_extract_all({col}, '{p}'))" for p in patterns)


_NEG_COUNT = f"({_count_all(ql.EXCLUSION_PHRASES[:5], 'z')} + {_count_all(ql.EXCLUSION_PHRASES[5:], 'q')})"
_POS = {n: f"(regexp_matches(z, '{ps[0]}') OR {' OR '.join(f'contains(q, {chr(39)}{w}{chr(39)})' for w in ps[1:])})" for n, ps in ql.POSITIVE_LOOKALIKES.items()}
_SOFT = {n: "(" + " OR ".join(f"contains(q, '{w}')" for w in ws) + ")" for n, ws in ql.SOFT_LEXICON.items()}
_SOFTLIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in {**_SOFT, **_POS}.items()) + "], lambda x: x IS NOT NULL)"
_TEXTS = f"(SELECT *, lower(nfc_normalize(raw_query)) AS q, {_ASCII.format('lower(raw_query)')} AS z FROM {{query_texts}})"


@query(
    "intent_signals",
    f"""SELECT query_id, cast({_NEG_COUNT} AS INT) AS n_exclusions, array_to_string({_SOFTLIST}, '|') AS soft_preferences,
        CASE WHEN {_NEG_COUNT} > 0 OR regexp_matches(z, '\\b(?:usd|dollars?|eur|euros?)\\b|\\$') OR contains(q, '€') THEN 'UNSUPPORTED_INTENT' ELSE 'SUCCESS' END AS status,
        ({' OR '.join(f"contains(lower(raw_query), '{w}')" for w in ql.UNSUPPORTED_DOMAINS)}) AS off_domain
        FROM {_TEXTS}""",
)
def intent_signals(spark, d):
    """Q06, Q07, Q08, Q10 over every user text."""
    x = ql.extract(load(spark, d, "query_texts"))
    return x.select(
        "query_id",
        F.size("x_negative.exclusions").alias("n_exclusions"),
        F.array_join("x_soft", "|").alias("soft_preferences"),
        F.col("x_status").alias("status"),
        ql.out_of_domain(F.col("raw_query")).alias("off_domain"),
    )


@query(
    "exclusion_phrases",
    """SELECT query_id, CASE query_type WHEN '1-URGENT' THEN 'without leather|not for kids' WHEN '3-MEDIUM' THEN 'no frills'
         WHEN '4-NOT SPECIFIED' THEN 'trừ da' ELSE '' END || CASE WHEN raw_query LIKE '%not for kids%' AND raw_query LIKE '%kids at least%' THEN ' at least 50'
         WHEN raw_query LIKE '%kids actually%' THEN ' actually make it blue' ELSE '' END AS exclusions FROM {shopper_log}""",
)
def exclusion_phrases(spark, d):
    """Q06 phrases of the shopper log."""
    neg = ql.negative_intent(F.col("raw_query"))
    return _log(spark, d).select("query_id", F.array_join(neg["exclusions"], "|").alias("exclusions"))


@query(
    "unsafe_preferences",
    f"""SELECT query_id, array_to_string(list_filter({_PREFS}, lambda p: regexp_matches(p, '(?i)\\b(without|avoid|except)\\s+\\S|\\bno\\s+less\\s+than\\b')
          OR len(list_filter(regexp_extract_all(lower(p), '\\bno\\s+(\\w+)', 1), lambda w: w NOT IN ('fuss','frills','problem'))) > 0
          OR len(list_filter(regexp_extract_all(lower(p), '\\bnot\\s+(\\w+)', 1), lambda w: w NOT IN ('only','too','necessarily'))) > 0), '|') AS unsafe FROM {{shopper_log}}""",
)
def unsafe_preferences(spark, d):
    """Q09."""
    return _log(spark, d).select("query_id", F.array_join(ql.unsafe_preferences(F.col("prefs")), "|").alias("unsafe"))


_V1 = r"(?i)\b(?:not|without|no|except)\s+([a-zA-Z0-9\s]{2,30}?)(?:[,.;]|\band\b|\bwith\b|\bunder\b|\bfor\b|$)"
_V2 = r"(?i)(\b(?:not|never|without)\s+)?\b(?:not|without|no|except)\s+([^,.;!?]+?)(?:\s+(?:and|but|with|under|below|above|for)\b|[,.;!?]|$)"


@query(
    "typed_exclusions",
    f"""SELECT query_id, array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(raw_query, '{_V1}', 1), lambda v: lower(trim(v))),
          lambda v: v NOT IN ('only','just','a','an','the','have','need')), lambda v: CASE WHEN regexp_matches(v,'shoes|laptop|watch|phone') THEN 'product_type'
          WHEN v IN ('nike','puma','samsung','apple','dell','sony','casio') THEN 'brand' ELSE 'attribute' END || '=' || v), '|') AS first_rules,
        array_to_string(list_transform(list_filter(list_transform(list_filter(list_zip(regexp_extract_all(raw_query, '{_V2}', 1), regexp_extract_all(raw_query, '{_V2}', 2)), lambda p: coalesce(p[1],'') = ''),
          lambda p: trim(regexp_replace(lower(p[2]), '\\s+', ' ', 'g'))), lambda v: NOT regexp_matches(v, '{ql.NEGATION_V2_GUARD}') AND length(v) <= 60),
          lambda v: CASE WHEN v IN ('nike','adidas','puma','samsung','sony','apple','dell','casio') THEN 'brand' WHEN regexp_matches(v, '{ql.NEGATION_V2_TYPES}') THEN 'product_type' ELSE 'attribute' END || '=' || v), '|') AS second_rules
        FROM {{shopper_log}}""",
)
def typed_exclusions(spark, d):
    """Q11, both rule sets."""

    def show(c):
        return F.array_join(F.transform(c, lambda e: F.concat(e["target_type"], F.lit("="), e["value"])), "|")

    q = F.col("raw_query")
    return _log(spark, d).select(
        "query_id",
        show(ql.exclusions_from_text(q)).alias("first_rules"),
        show(ql.direct_exclusions(q)).alias("second_rules"),
    )


@query(
    "negation_conflicts",
    """SELECT query_id, CASE WHEN prefs LIKE 'lightweight%' THEN 'lightweight|Shoes' WHEN prefs LIKE 'compact%' THEN 'compact|durable' ELSE 'leather| Soft  grip |soft grip' END AS prefs,
         CASE WHEN prefs LIKE 'lightweight%' THEN 'leather' WHEN prefs LIKE 'compact%' THEN 'zip' ELSE '' END AS excluded,
         CASE WHEN prefs LIKE 'lightweight%' THEN 'lightweight' WHEN prefs LIKE 'compact%' THEN 'compact|durable' ELSE 'leather| Soft  grip |soft grip' END AS without_nouns FROM {shopper_log}""",
)
def negation_conflicts(spark, d):
    """Q12, Q13 on stored preferences."""
    res = _log(spark, d).select(
        "query_id", ql.resolve_negation(F.col("prefs"), F.array().cast(ql.EXCLUSIONS)).alias("r")
    )
    return res.select(
        "query_id",
        F.array_join("r.prefs", "|").alias("prefs"),
        F.array_join(F.transform("r.excl", lambda e: e["value"]), "|").alias("excluded"),
        F.array_join(ql.without_product_nouns(F.col("r.prefs")), "|").alias("without_nouns"),
    )


_SYN = "(VALUES " + ", ".join(
    f"('{w}','{c}',{i})" for i, (w, c) in enumerate(ql.CATEGORY_SYNONYMS.items())
) + ") s(w,c,p)"
_CATS = "(VALUES " + ", ".join(f"('{c}',{i})" for i, c in enumerate(ql.CANONICAL_CATEGORIES)) + ") k(c,p)"
_NORMCAT = f"""
SELECT query_id, coalesce((SELECT c FROM {_CATS} WHERE lower(c) = lower(trim(category))), (SELECT c FROM {_SYN} WHERE w = lower(trim(category)) ORDER BY p LIMIT 1),
   (SELECT c FROM {_SYN} WHERE contains(lower(trim(category)), w) ORDER BY p LIMIT 1), (SELECT c FROM {_CATS} WHERE contains(lower(trim(category)), lower(c)) ORDER BY p LIMIT 1)) AS category
FROM {{shopper_log}}
"""
_NORMCUR = "CASE WHEN coalesce(trim(currency),'') = '' THEN 'INR' WHEN upper(trim(currency)) IN ('DOLLARS','DOLLAR','USD','$') THEN 'USD' ELSE upper(trim(currency)) END"


@query(
    "normalized_intent",
    f"""SELECT l.query_id, n.category, CASE WHEN lower(brand) IN ('any') THEN NULL ELSE CASE WHEN brand = 'nike' THEN 'Nike' ELSE brand END END AS brand, {_NORMCUR} AS currency,
        CASE WHEN min_price > max_price THEN NULL ELSE min_price END AS min_price, (n.category IS NULL OR {_NORMCUR} <> 'INR') AS needs_clarification,
        array_to_string(list_filter([CASE WHEN n.category IS NULL THEN 'UNKNOWN_CATEGORY' END, CASE WHEN min_price > max_price THEN 'INVERTED_PRICE_RANGE' END, CASE WHEN {_NORMCUR} <> 'INR' THEN 'FOREIGN_CURRENCY' END], lambda x: x IS NOT NULL), '|') AS warnings
        FROM {{shopper_log}} l JOIN ({_NORMCAT}) n USING (query_id)""",
)
def normalized_intent(spark, d):
    """Q14-Q17; brand spellings come from the catalog brands."""
    catalog = cat.brand_canonical(load(spark, d, "raw_catalog"))
    log = ql.normalize_brands(_log(spark, d), catalog).withColumns(
        {
            "raw_category": F.col("category"),
            "category": ql.normalize_category(F.col("category")),
            "currency": ql.normalize_currency(F.col("currency")),
        }
    )
    rules = ql.business_rules(
        F.col("raw_category"), F.col("category"), F.col("currency"), F.col("min_price"), F.col("max_price")
    )
    out = log.withColumn("r", rules)
    return out.select(
        "query_id", "category", "brand", "currency",
        F.col("r.min_price").alias("min_price"),
        F.col("r.needs_clarification").alias("needs_clarification"),
        F.array_join("r.warnings", "|").alias("warnings"),
    )


_NP = "list_filter(list_transform(string_split(prefs,'|'), lambda p: lower(trim(regexp_replace(p,'\\s+',' ','g')))), lambda p: p <> '')"
_SEM = "trim(regexp_replace(nfc_normalize(raw_query),'\\s+',' ','g'))"
_DEDUP = f"list_filter({_NP}, lambda p, i: list_position({_NP}, p) = i)"


@query(
    "preference_queries",
    f"""SELECT query_id, array_to_string({_DEDUP}, '|') AS prefs, {_SEM} AS semantic, array_to_string({_DEDUP}, '; ') || ' — ' || {_SEM} AS composed FROM {{shopper_log}}""",
)
def preference_queries(spark, d):
    """Q18-Q20."""
    rows = _log(spark, d).select(
        "query_id",
        ql.normalize_preferences(F.col("prefs"))["values"].alias("p"),
        ql.normalize_semantic(F.col("raw_query"))["text"].alias("semantic"),
    )
    return rows.select(
        "query_id",
        F.array_join("p", "|").alias("prefs"),
        "semantic",
        ql.preference_query(F.col("semantic"), F.col("p")).alias("composed"),
    )


@query(
    "representation_status",
    f"""SELECT query_id, CASE WHEN length({_SEM}) > 500 THEN 'INVALID_INPUT' WHEN min_price > max_price THEN 'CLARIFICATION_REQUIRED' WHEN {_NORMCUR} <> 'INR' THEN 'UNSUPPORTED_INTENT'
        WHEN regexp_matches(prefs, '(?i)\\b(without|avoid|except)\\s+\\S|\\bnot\\s+leather') THEN 'UNSUPPORTED_INTENT' ELSE 'SUCCESS' END AS status FROM {{shopper_log}}""",
)
def representation_status(spark, d):
    """Q26."""
    log = _log(spark, d)
    status = ql.representation_status(
        F.lit(True),
        F.coalesce(F.col("min_price") > F.col("max_price"), F.lit(False)),
        ql.normalize_currency(F.col("currency")),
        ql.normalize_semantic(F.col("raw_query")),
        ql.normalize_preferences(F.col("prefs")),
    )
    return log.select("query_id", status.alias("status"))


@query(
    "batch_gate",
    f"""SELECT status, count(*) AS queries FROM (SELECT CASE WHEN min_price > max_price THEN 'CLARIFICATION_REQUIRED' WHEN {_NORMCUR} <> 'INR' THEN 'UNSUPPORTED_INTENT'
        WHEN query_type IN ('1-URGENT','3-MEDIUM','4-NOT SPECIFIED') THEN 'UNSUPPORTED_INTENT' WHEN NOT resolved THEN 'CLARIFICATION_REQUIRED' ELSE 'SUCCESS' END AS status
        FROM {{shopper_log}} JOIN ({_BOUNDARY}) USING (query_id)) GROUP BY 1""",
)
def batch_gate(spark, d):
    """statuses of the whole batch."""
    log = _log(spark, d)
    status = cs.gate_status(
        needs_clarification=F.coalesce(F.col("min_price") > F.col("max_price"), F.lit(False)),
        currency=ql.normalize_currency(F.col("currency")),
        n_exclusions=F.size(ql.negative_intent(F.col("raw_query"))["exclusions"]),
        price_resolved=ql.price_boundary(F.col("raw_query"), F.col("min_price"), F.col("max_price"))["resolved"],
    )
    return log.select(status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("queries"))


# The audit twin: extraction columns joined with the stored interpretation.
_LOGX = _EXTRACT.replace("{query_texts}", "(SELECT query_id, raw_query FROM {shopper_log})")
_SOFTX = f"SELECT query_id, {_SOFTLIST} AS soft, {_NEG_COUNT} > 0 AS has_excl FROM (SELECT *, lower(nfc_normalize(raw_query)) AS q, {_ASCII.format('lower(raw_query)')} AS z FROM {{shopper_log}})"
_FINDINGS = f"""
SELECT query_id, language, query_type, unnest(list_filter([
   CASE WHEN x.min_price IS NOT NULL AND l.min_price IS NULL THEN 'MISSING_PRICE_CONSTRAINT/min_price' END,
   CASE WHEN x.min_price IS NOT NULL AND l.min_operator IS DISTINCT FROM x.min_operator THEN 'INCORRECT_PRICE_BOUNDARY_OPERATOR/min_operator' END,
   CASE WHEN x.max_price IS NOT NULL AND l.max_price IS NULL THEN 'MISSING_PRICE_CONSTRAINT/max_price' END,
   CASE WHEN x.max_price IS NOT NULL AND l.max_operator IS DISTINCT FROM x.max_operator THEN 'INCORRECT_PRICE_BOUNDARY_OPERATOR/max_operator' END,
   CASE WHEN x.min_rating IS NOT NULL AND l.min_rating IS NULL THEN 'MISSING_RATING_CONSTRAINT/min_rating' END,
   CASE WHEN len(list_filter(s.soft, lambda p: NOT list_contains(list_transform(string_split(l.prefs,'|'), lambda y: lower(y)), p))) > 0 THEN 'MISSING_POSITIVE_PREFERENCE/soft_preferences' END,
   CASE WHEN s.has_excl THEN 'EXCLUSION_UNREPRESENTABLE/exclusions' END,
   CASE WHEN expected_status <> CASE WHEN s.has_excl OR x.currency <> 'INR' THEN 'UNSUPPORTED_INTENT' ELSE 'SUCCESS' END THEN 'EXPECTED_STATUS_DIFFERENCE/expected_status' END,
   CASE WHEN l.category NOT IN ('Footwear','FURNITURE','building') THEN 'INVALID_CATEGORY/category' END,
   CASE WHEN l.min_price > l.max_price THEN 'CONFLICTING_PRICE_RANGE/price' END], lambda v: v IS NOT NULL)) AS f
FROM {{shopper_log}} l JOIN ({_LOGX}) x USING (query_id) JOIN ({_SOFTX}) s USING (query_id)
"""


def _audited(spark, d):
    return ql.audit(_log(spark, d), ["Footwear", "FURNITURE", "building"])


@query("query_audit", f"SELECT query_id, string_split(f,'/')[1] AS code, string_split(f,'/')[2] AS field FROM ({_FINDINGS})")
def query_audit(spark, d):
    """Q21."""
    rows = ql.findings(_audited(spark, d))
    return rows.select("query_id", F.col("f.code").alias("code"), F.col("f.field").alias("field"))


@query(
    "audit_by_group",
    f"SELECT code, language, query_type, count(*) AS findings FROM (SELECT *, string_split(f,'/')[1] AS code FROM ({_FINDINGS})) GROUP BY GROUPING SETS ((code),(language,code),(query_type,code))",
)
def audit_by_group(spark, d):
    """A18."""
    return ql.finding_counts(_audited(spark, d))


_DIFFS = [
    ("category", "l.category", "n.category"), ("brand", "l.brand", "CASE WHEN l.brand = 'any' THEN NULL WHEN l.brand = 'nike' THEN 'Nike' END"),
    ("currency", "l.currency", _NORMCUR), ("min_price", "cast(l.min_price AS string)", "cast(CASE WHEN min_price > max_price THEN NULL ELSE min_price END AS string)"),
]


@query(
    "interpretation_diffs",
    " UNION ALL ".join(
        f"SELECT l.query_id, '{f}' AS field, {a} AS original, {b} AS proposed FROM {{shopper_log}} l JOIN ({_NORMCAT}) n USING (query_id) WHERE ({a}) IS DISTINCT FROM ({b})"
        for f, a, b in _DIFFS
    ),
)
def interpretation_diffs(spark, d):
    """Q22: stored against normalized interpretation."""
    log = _log(spark, d)
    inverted = F.coalesce(F.col("min_price") > F.col("max_price"), F.lit(False))
    rows = log.select(
        "query_id",
        F.struct("category", "brand", "currency", "min_price").alias("old"),
        F.struct(
            ql.normalize_category(F.col("category")).alias("category"),
            ql.brand_spelling(F.col("brand")).alias("brand"),
            ql.normalize_currency(F.col("currency")).alias("currency"),
            F.when(~inverted, F.col("min_price")).alias("min_price"),
        ).alias("new"),
    )
    return ql.interpretation_diffs(rows)


@query(
    "interpretation_errors",
    """SELECT query_id, array_to_string(list_filter([CASE WHEN expected_status NOT IN ('SUCCESS','NO_RESULTS','CLARIFICATION_REQUIRED','UNSUPPORTED_INTENT') THEN 'STATUS' END, CASE WHEN min_price > max_price THEN 'PRICE_RANGE' END,
         CASE WHEN max_operator NOT IN ('>','>=') THEN 'MIN_OPERATOR' END, CASE WHEN max_operator NOT IN ('<','<=') THEN 'MAX_OPERATOR' END], lambda x: x IS NOT NULL), '|') AS errors FROM {shopper_log}""",
)
def interpretation_errors(spark, d):
    """Q23; the upper operator is fed to both sides so that both checks fire."""
    log = _log(spark, d)
    errors = ql.interpretation_errors(
        F.col("expected_status"), F.col("min_price"), F.col("max_price"), F.col("max_operator"), F.col("max_operator")
    )
    return log.select("query_id", F.array_join(errors, "|").alias("errors"))


@query(
    "schema_round_trip",
    """SELECT query_id, CASE WHEN prefs LIKE 'lightweight%' THEN 'lightweight|Shoes|not leather' WHEN prefs LIKE 'compact%' THEN 'compact|durable|not zip' ELSE prefs END AS v1,
         CASE WHEN prefs LIKE 'lightweight%' THEN 'leather' WHEN prefs LIKE 'compact%' THEN 'zip' ELSE '' END AS v2_exclusions FROM {shopper_log}""",
)
def schema_round_trip(spark, d):
    """Q24: v1 to v2 and back."""
    v2 = ql.from_v1(_log(spark, d).select("query_id", F.col("prefs").alias("soft_preferences"))).withColumn(
        "v2_exclusions", F.array_join(F.transform("exclusions", lambda e: e["value"]), "|")
    )
    v1 = ql.to_v1(v2)
    return v1.select("query_id", F.array_join("soft_preferences", "|").alias("v1"), "v2_exclusions")


def _refine_sql(price: bool, negation: bool, brand: bool, currency: bool) -> str:
    ev = f"({_EVIDENCE.replace('{query_texts}', '(SELECT query_id, raw_query FROM {shopper_log})')})"
    flag = lambda s: f"CASE WHEN e.{s}_value = l.{s}_price THEN e.{s}_inclusive ELSE true END" if price else "true"
    return f"""SELECT l.query_id, {"n.category" if brand else "l.category"} AS category, {"CASE WHEN l.brand = 'any' THEN NULL WHEN l.brand = 'nike' THEN 'NIKE' END" if brand else "l.brand"} AS brand,
        {_NORMCUR if currency else "l.currency"} AS currency, {flag("min")} AS min_inclusive, {flag("max")} AS max_inclusive,
        {"x.second_rules" if negation else "coalesce(l.stored_exclusion, '')"} AS exclusions, l.stored_clarification{f" OR {_NORMCUR} <> 'INR'" if currency else ""} AS needs_clarification
        FROM {{shopper_log}} l JOIN ({_NORMCAT}) n USING (query_id) JOIN {ev} e USING (query_id) JOIN ({_TYPED}) x USING (query_id)"""


_FOUND = f"""list_filter(list_transform(list_filter(list_zip(regexp_extract_all(raw_query, '{_V2}', 1), regexp_extract_all(raw_query, '{_V2}', 2)), lambda p: coalesce(p[1],'') = ''),
          lambda p: trim(regexp_replace(lower(p[2]), '\\s+', ' ', 'g'))), lambda v: NOT regexp_matches(v, '{ql.NEGATION_V2_GUARD}') AND length(v) <= 60)"""
# Stored exclusion first, then each found phrase that neither repeats nor overlaps an earlier one.
_TYPED = f"""SELECT query_id, coalesce(array_to_string(CASE WHEN len(v) = 0 THEN [] ELSE list_reduce(list_transform(v, lambda x: [x]), lambda acc, x:
     CASE WHEN len(list_filter(acc, lambda e: contains(x[1] || ' ', e || ' ') OR contains(e || ' ', x[1] || ' '))) > 0 THEN acc ELSE list_concat(acc, x) END) END, '|'), '') AS second_rules
   FROM (SELECT query_id, list_concat(CASE WHEN stored_exclusion IS NULL THEN [] ELSE [stored_exclusion] END, {_FOUND}) AS v FROM {{shopper_log}})"""


def _stored_log(spark, d):
    """The log with what its stored interpretations already exclude and ask to clarify."""
    stored = F.filter(F.array(F.struct(F.lit("attribute").alias("target_type"), F.col("stored_exclusion").alias("value"))), lambda e: e["value"].isNotNull())
    return _log(spark, d).withColumns({"exclusions": stored, "needs_clarification": F.col("stored_clarification")})


def _brands(spark, d):
    """A catalog that spells the one brand of the log its own way."""
    rows = load(spark, d, "shopper_log").select(F.lower("brand").alias("brand_key")).filter("brand_key <> 'any'")
    return rows.distinct().withColumn("canonical", F.upper("brand_key"))


@query(
    "rule_ablation",
    " UNION ALL ".join(
        f"SELECT '{name}' AS variant, * FROM ({_refine_sql(*flags)})"
        for name, flags in (("all", (1, 1, 1, 1)), ("price", (1, 0, 0, 0)), ("negation", (0, 1, 0, 0)), ("brand", (0, 0, 1, 0)), ("currency", (0, 0, 0, 1)))
    ),
)
def rule_ablation(spark, d):
    """Every rule group alone and all together."""
    log, brands = _stored_log(spark, d).withColumn("product_type", F.lit("running shoes")), cut_lineage(_brands(spark, d))
    log = cut_lineage(ql.rule_evidence(log))  # read five times
    out = None
    for name, groups in (("all", ql.RULE_GROUPS), *[(g, (g,)) for g in ("price", "negation", "brand", "currency")]):
        rows = ql.refine(log, groups, brands).select(
            F.lit(name).alias("variant"), "query_id", "category", "brand", "currency", "min_inclusive", "max_inclusive",
            F.array_join(F.transform("exclusions", lambda e: e["value"]), "|").alias("exclusions"), "needs_clarification",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "refined_intent",
    f"""SELECT l.query_id, n.category, CASE WHEN stored_clarification AND n.category IS NULL THEN NULL WHEN l.brand = 'any' THEN NULL WHEN l.brand = 'nike' THEN 'NIKE' END AS brand, CASE WHEN min_price > max_price THEN NULL ELSE min_price END AS min_price,
        NOT regexp_matches(raw_query, '(?i){ql.STRICT_UPPER}') AS max_inclusive, CASE WHEN prefs LIKE 'lightweight%' THEN 'lightweight' WHEN prefs LIKE 'compact%' THEN 'compact|durable'
          ELSE CASE WHEN query_type = '1-URGENT' OR stored_exclusion IS NOT NULL THEN ' Soft  grip |soft grip' ELSE 'leather| Soft  grip |soft grip' END END AS prefs,
        stored_clarification AS needs_clarification, coalesce(stored_exclusion, '') AS first_exclusion
        FROM {{shopper_log}} l JOIN ({_NORMCAT}) n USING (query_id)""",
)
def refined_intent(spark, d):
    """Q25, second pass: what was stored comes first and stays."""
    log = _stored_log(spark, d).withColumn("product_type", F.lit(None).cast("string"))
    out = ql.refine_v2(log, _brands(spark, d))
    first = F.when(F.col("stored_exclusion").isNotNull(), F.get("exclusions", F.lit(0))["value"])
    return out.select(
        "query_id", "category", "brand", "min_price", "max_inclusive", F.array_join("prefs", "|").alias("prefs"),
        "needs_clarification", F.coalesce(first, F.lit("")).alias("first_exclusion"),
    )


@query(
    "judge_interpretation",
    f"""SELECT x.query_id, x.min_price, x.max_price, x.currency, x.min_rating, CASE WHEN query_type = '2-HIGH' THEN 'Nike' END AS brand, CASE WHEN s.has_excl OR contains(lower(raw_query),'100 usd') THEN 'UNSUPPORTED_INTENT' ELSE 'SUCCESS' END AS expected_status,
        array_to_string(list_filter([CASE WHEN x.min_price IS NOT NULL OR x.max_price IS NOT NULL THEN 'PRICE_OPERATOR_SIDECAR_REQUIRED' END, CASE WHEN s.has_excl THEN 'EXCLUSION_UNREPRESENTABLE_BY_PHASE8_V1' END,
          CASE WHEN s.has_excl OR contains(lower(raw_query),'100 usd') THEN 'NON_CATALOG_SERVICE_UNSUPPORTED' END], lambda v: v IS NOT NULL), '|') AS limitations
        FROM {{shopper_log}} l JOIN ({_LOGX}) x USING (query_id) JOIN ({_SOFTX}) s USING (query_id)""",
)
def judge_interpretation(spark, d):
    """Q27 first judge."""
    out = ql.interpret(load(spark, d, "shopper_log"))
    return out.select(
        "query_id", "min_price", "max_price", "currency", "min_rating", "brand", "expected_status",
        F.array_join("limitations", "|").alias("limitations"),
    )


@query(
    "draft_annotations",
    f"""SELECT query_id, trim(regexp_replace(raw_query, '(?i){ql.DRAFT_FILLER}', '')) AS semantic_query, TRY_CAST(regexp_extract(raw_query, 'rating at least (\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS min_rating,
        CASE WHEN regexp_matches(raw_query, '(?i)\\busd\\b') THEN 'USD' ELSE 'INR' END AS currency, CASE WHEN regexp_matches(raw_query, '(?i)\\busd\\b') THEN 'UNSUPPORTED_INTENT' ELSE 'SUCCESS' END AS expected_status, sha256(raw_query) AS source_sha256 FROM {{shopper_log}}""",
)
def draft_annotations(spark, d):
    """Q27 draft."""
    return ql.draft(load(spark, d, "shopper_log")).select(
        "query_id", "semantic_query", "min_rating", "currency", "expected_status", "source_sha256"
    )


@query(
    "input_problems",
    "SELECT query_id, CASE WHEN raw_query IS NULL OR trim(regexp_replace(raw_query,'\\s+',' ','g')) = '' THEN 'BLANK' WHEN length(trim(raw_query)) > 500 THEN 'TOO_LONG' END AS problem FROM {query_texts}",
)
def input_problems(spark, d):
    """Q28."""
    return load(spark, d, "query_texts").select("query_id", ql.input_problem(F.col("raw_query")).alias("problem"))


# ------------------------------------------------------------------ constraints
@query(
    "constraint_filter",
    "SELECT product_id, category, brand, discounted_price FROM {products} WHERE lower(category)='promo' AND rating >= 2 AND discounted_price > 905.0 AND discounted_price <= 960.5",
)
def constraint_filter(spark, d):
    """F01 with literals: a filter Catalyst pushes to the scan."""
    cond = cs.literal_filter(
        category="Promo", min_rating=2.0, min_price=905.0, min_inclusive=False, max_price=960.5, max_inclusive=True
    )
    return load(spark, d, "products").filter(cond).select("product_id", "category", "brand", "discounted_price")


_BATTERY = {
    "category": ("lower(category)='large'", dict(category="LARGE")),
    "max_price": ("discounted_price <= 950.0", dict(max_price=950.0, max_inclusive=True)),
    "min_price": ("discounted_price >= 950.0", dict(min_price=950.0, min_inclusive=True)),
    "range": ("discounted_price BETWEEN 920.0 AND 930.0", dict(min_price=920.0, min_inclusive=True, max_price=930.0, max_inclusive=True)),
    "brand": ("lower(brand)='brand#7'", dict(brand="brand#7")),
    "category_brand": ("lower(category)='small' AND lower(brand)='brand#2'", dict(category="small", brand="BRAND#2")),
    "category_price": ("lower(category)='small' AND discounted_price < 910.0", dict(category="small", max_price=910.0, max_inclusive=False)),
    "rating": ("rating >= 4", dict(min_rating=4.0)),
    "empty": ("lower(brand)='no such brand'", dict(brand="no such brand")),
    "boundary_strict": ("discounted_price < 900.0", dict(max_price=900.0, max_inclusive=False)),
    "boundary_inclusive": ("discounted_price <= 900.0", dict(max_price=900.0, max_inclusive=True)),
}


@query(
    "filter_battery",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS test_id, count(*) FILTER ({sql}) AS matched, min(discounted_price) FILTER ({sql}) AS low, max(discounted_price) FILTER ({sql}) AS high FROM {{products}}"
        for n, (sql, _) in _BATTERY.items()
    ) + ")",
)
def filter_battery(spark, d):
    """all filter tests in one scan."""
    products = load(spark, d, "products")
    conds = {n: cs.literal_filter(**kw) for n, (_, kw) in _BATTERY.items()}
    price = F.col("discounted_price")
    wide = products.agg(
        *[
            F.struct(
                F.lit(n).alias("test_id"),
                F.count_if(c).alias("matched"),
                F.min(F.when(c, price)).alias("low"),
                F.max(F.when(c, price)).alias("high"),
            ).alias(n)
            for n, c in conds.items()
        ]
    )
    return wide.select(F.inline(F.array(*conds)))


@query(
    "eligible_counts",
    """SELECT query_id, (SELECT count(*) FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE (b.f IS NULL OR lower(p.p_type) = lower(b.f)) AND l.l_extendedprice >= b.lo AND (b.hi IS NULL OR l.l_extendedprice <= b.hi)) AS eligible
       FROM (SELECT p_partkey AS query_id, CASE WHEN p_size <= 25 THEN p_type END AS f, p_retailprice * 10 AS lo, CASE WHEN p_size % 3 > 0 THEN p_retailprice * 30 END AS hi FROM part) b""",
)
def eligible_counts(spark, d):
    """One price-range query per part against every listing."""
    part = load(spark, d, "part")
    listings = load(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("category"), F.col("l_extendedprice").alias("price")
    )
    queries = part.select(
        F.col("p_partkey").alias("query_id"),
        F.when(F.col("p_size") <= 25, F.col("p_type")).alias("f_category"),
        (F.col("p_retailprice") * 10).alias("f_min_price"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice") * 30).alias("f_max_price"),
    )
    return cs.eligible_counts(queries, listings, width=1000.0)


@query(
    "catalog_feasibility",
    """SELECT query_id, (SELECT count(*) FROM part p WHERE (lower(p.p_type) = lower(b.f)) AND p.p_retailprice <= b.hi) AS eligible, (SELECT count(*) FROM part p WHERE (lower(p.p_type) = lower(b.f)) AND p.p_retailprice <= b.hi) > 0 AS feasible
       FROM (SELECT o_orderkey AS query_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'ECONOMY' WHEN '2-HIGH' THEN 'LARGE' WHEN '3-MEDIUM' THEN 'PROMO' ELSE 'OTHER' END AS f, o_totalprice / 400 AS hi FROM orders) b""",
)
def catalog_feasibility(spark, d):
    """Is any product eligible for each planned query."""
    kinds = F.create_map(*[F.lit(x) for x in ("1-URGENT", "ECONOMY", "2-HIGH", "LARGE", "3-MEDIUM", "PROMO")])
    queries = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("query_id"),
        F.coalesce(F.try_element_at(kinds, F.col("o_orderpriority")), F.lit("OTHER")).alias("f_category"),
        F.lit(None).cast("double").alias("f_min_price"),
        (F.col("o_totalprice") / 400).alias("f_max_price"),
    )
    products = load(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"))
    return cs.eligible_counts(queries, products).withColumn("feasible", F.col("eligible") > 0)
