"""Pools, blind tasks, judges, adjudication and qrels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from merchlens.functions.text import fingerprint, let
from merchlens.operators.splits import hash_position

# ---------------------------------------------------------------------------
# Fixed values of the relevance rubric.
VALID_GRADES = (0, 1, 2, 3)
FLAGS = ("category_violation", "brand_violation", "price_violation", "rating_violation", "other_violation")
FORBIDDEN_BLIND = (
    "rank", "score", "tfidf_score", "semantic_score", "rrf_score", "sources", "retrieval_method",
    "retrieval_methods", "pool_position", "method_results", "method", "membership",
)
FORM_FACTORS = (
    (
        ("phone case", "phone cover", "protective case", "ốp lưng", "bao da", "vỏ điện thoại"),
        (
            "screen guard", "screen protector", "tempered glass", "kính cường lực", "dán màn hình", "car holder",
            "car mount", "dock", "cable", "charger", "adapter", "tablet", "ipad", "laptop sleeve", "tab cover",
        ),
    ),
    (("curtain", "rèm", "màn cửa"), ("bracket", "curtain rod", "rod", "carpet", "rug", "doormat", "thảm")),
    (
        ("shoe", "shoes", "sneaker", "giày"),
        ("sock", "socks", "insole", "shoe shiner", "shoe polish", "shoe cleaner"),
    ),
    (("table", "desk", "bàn"), ("tablecloth", "table cloth", "table cover", "runner", "placemat")),
)
WALLET = ("wallet", "ví", "bóp")
WALLET_OTHER = ("belt", "keychain")
MEN = ("men's", "mens", "for men", "nam")
WOMEN = ("women's", "womens", "for women", "nữ")
NOT_FOR_MEN = ("women", "ideal for: women", "girls")
NOT_FOR_WOMEN = ("ideal for: men", "boys")
RELATED_FAMILIES = ("phone", "shoe", "curtain", "table", "wallet")
PREFERENCE_STOP = ("for", "and", "the", "with")
CORE_STOP = ("under", "above", "rating", "with", "from", "black", "white")
JUDGE_A = {"weak": 0.3, "strong": 0.7}
JUDGE_B = {"weak": 0.35, "strong": 0.65}
CLAIM_LABELS = {
    "support_label": ("SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED", "NOT_ENOUGH_INFORMATION"),
    "factual_correctness": ("CORRECT", "PARTIALLY_CORRECT", "INCORRECT", "NOT_ENOUGH_INFORMATION"),
    "recommendation_relevance": ("RELEVANT", "PARTIALLY_RELEVANT", "IRRELEVANT"),
    "missing_information_handling": ("CORRECTLY_DISTINGUISHED", "MISSTATED_ABSENCE", "NOT_APPLICABLE"),
}
# ---------------------------------------------------------------------------


def candidate_pool(runs: DataFrame, depth: int) -> DataFrame:
    """E11 / U01 / W10. Union of the methods per (query, document) with provenance.

    The membership array holds one entry per method.
    """
    member = F.struct("method", "rank", F.round("score", 6).alias("score"))
    pooled = (
        runs.filter(F.col("rank") <= depth)
        .groupBy("query_id", "doc_id")
        .agg(F.sort_array(F.collect_list(member)).alias("membership"), F.min("rank").alias("best_rank"))
    )
    order = W.partitionBy("query_id").orderBy("best_rank", "doc_id")
    return pooled.withColumns(
        {
            "pool_position": F.row_number().over(order),
            "fingerprint": fingerprint(q=F.col("query_id"), d=F.col("doc_id"), m=F.col("membership")),
        }
    )


def cap_pool(pool: DataFrame, max_pairs: int) -> DataFrame:
    """E12 / K04. Method-balanced cap: rounds over queries and methods.

    A query's picks do not depend on other queries, so each query lists its own
    picks with their round inside its row (a pool holds at most methods x depth rows);
    only the final order and limit are global, and keep ``max_pairs`` rows a task.
    """
    doc = pool.schema["doc_id"].dataType.simpleString()
    members = pool.select("query_id", "doc_id", F.explode("membership").alias("m"))
    # One queue per method, the best documents first; the queues in the order of their methods.
    queue = members.groupBy("query_id", F.col("m.method").alias("method")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("m.rank").alias("rank"), "doc_id"))).alias("q")
    )
    queues = queue.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("method", F.col("q.doc_id").alias("docs")))).alias("queues"),
        F.max(F.size("q")).alias("longest"),
    )
    picks = f"array<struct<doc_id:{doc},round:int,method:string>>"

    def pick(taken, turn, queue):
        left = F.get(F.filter(queue["docs"], lambda x: ~F.exists(taken, lambda t: t["doc_id"] == x)), F.lit(0))
        one = F.array(F.struct(left.alias("doc_id"), turn.alias("round"), queue["method"].alias("method")))
        return F.when(left.isNull(), taken).otherwise(F.concat(taken, one.cast(picks)))

    picked = F.aggregate(
        F.sequence(F.lit(0), F.col("longest") - 1),
        F.array().cast(picks),
        lambda taken, turn: F.aggregate("queues", taken, lambda so_far, queue: pick(so_far, turn, queue)),
    )
    ordered = queues.select("query_id", F.inline(picked)).select("query_id", "doc_id", "round", "method")
    return ordered.orderBy("round", F.col("query_id").cast("string"), "method").limit(max_pairs)


def blind_tasks(pool: DataFrame, columns: list[str], batch_size: int) -> DataFrame:
    """E13 / K05. Allowed columns only, in hash order, cut in batches."""
    leaked = [c for c in columns if c in FORBIDDEN_BLIND]
    if leaked:
        raise ValueError(f"blind task may not carry {leaked}")
    keyed = pool.select(
        *columns,
        F.sha2(F.concat_ws(":", F.col("query_id").cast("string"), F.col("doc_id").cast("string")), 256).alias("_h"),
    )
    placed = hash_position(keyed, "_h")
    return placed.withColumns(
        {"task_no": F.col("position"), "batch_no": F.floor((F.col("position") - 1) / batch_size)}
    ).drop("_h", "position")


def review_errors(grade: Column, flags: dict[str, Column], confidence: Column, stale: Column) -> Column:
    """E15. Reasons a review is rejected; an empty array is accepted."""
    asserted = F.lit(False)
    absent = F.lit(False)
    for c in flags.values():
        asserted = asserted | F.coalesce(c, F.lit(False))
        absent = absent | c.isNull()
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(grade, F.lit(-1)).isin(*VALID_GRADES), F.lit("GRADE")),
            F.when(absent, F.lit("FLAG_NOT_BOOLEAN")),
            F.when((grade >= 2) & asserted, F.lit("GRADE_CONFLICTS_WITH_VIOLATION")),
            F.when(~confidence.between(0, 1), F.lit("CONFIDENCE")),
            F.when(stale, F.lit("STALE_FINGERPRINT")),
        )
    )


REVIEW_SCHEMA = "relevance_grade int, " + ", ".join(f"{f} boolean" for f in FLAGS) + ", confidence double, task_fingerprint string"


def import_reviews(tasks: DataFrame, raw: DataFrame) -> DataFrame:
    """E15. Parse review JSON, match it to its task, list the errors.

    ``tasks``: query_id, doc_id, fingerprint; ``raw``: query_id, doc_id, payload.
    """
    copies = raw.groupBy("query_id", "doc_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min("payload").alias("payload")
    )
    parsed = copies.withColumn("r", F.from_json("payload", REVIEW_SCHEMA))
    joined = parsed.join(tasks.select("query_id", "doc_id", "fingerprint"), ["query_id", "doc_id"], "left")
    errors = review_errors(
        F.col("r.relevance_grade"), {f: F.col(f"r.{f}") for f in FLAGS}, F.col("r.confidence"),
        ~F.col("r.task_fingerprint").eqNullSafe(F.col("fingerprint")),
    )
    extra = F.array_compact(
        F.array(
            F.when(F.col("copies") > 1, F.lit("DUPLICATE")), F.when(F.col("fingerprint").isNull(), F.lit("UNKNOWN_TASK"))
        )
    )
    return joined.select("query_id", "doc_id", "r.*", F.concat(extra, errors).alias("errors"))


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def form_factor_mismatch(query: Column, product: Column) -> Column:
    """Accessory or different form factor; both texts lower-case."""
    cond = F.lit(False)
    for asked, other in FORM_FACTORS:
        cond = cond | (_any_in(query, asked) & _any_in(product, other))
    return cond | (_any_in(query, WALLET) & _any_in(product, WALLET_OTHER) & ~product.contains("wallet"))


def demographic_mismatch(query: Column, product: Column) -> Column:
    """Explicit contradiction of the audience.

    "women" contains "men", so the first branch can only fire through "girls".
    """
    men = _any_in(query, MEN) & _any_in(product, NOT_FOR_MEN) & ~product.contains("men")
    women = _any_in(query, WOMEN) & _any_in(product, NOT_FOR_WOMEN) & ~_any_in(product, ("women", "unisex"))
    return men | women


def _words(text: Column, longer_than: int, stop: tuple[str, ...]) -> Column:
    parts = F.split(F.lower(text), r"(?U)\W+")
    return F.filter(parts, lambda w: (F.length(w) > longer_than) & ~w.isin(*stop))


def judge(
    *,
    query: Column,
    semantic: Column,
    preferences: Column,
    name: Column,
    specs: Column,
    text: Column,
    flags: dict[str, Column],
    weak: float,
    strong: float,
    need_every_keyword: bool,
) -> Column:
    """E16. struct(grade, other_violation) of one rule judge.

    Judge A wants every keyword of a preference, judge B any of them.
    """
    head = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(specs, F.lit(""))))
    body = F.lower(
        F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(specs, F.lit("")), F.coalesce(text, F.lit("")))
    )
    q = F.lower(F.coalesce(query, F.lit("")))
    other = flags["other_violation"] | form_factor_mismatch(q, head) | demographic_mismatch(q, head)
    combine = F.forall if need_every_keyword else F.exists
    quantify = lambda words, b: (F.size(words) == 0) | combine(words, lambda w: F.contains(b, w))
    related = _any_in(F.lower(F.concat(F.coalesce(name, F.lit("")), F.coalesce(specs, F.lit("")))), RELATED_FAMILIES)

    def graded(v: Column) -> Column:
        covered = F.size(F.filter(v["core"], lambda w: F.contains(v["body"], w)))
        ratio = covered / F.greatest(F.lit(1), F.size(v["core"]))
        evidenced = F.forall(
            preferences, lambda p: quantify(_words(F.trim(p), 2, PREFERENCE_STOP), v["body"])
        )
        soft = F.when(ratio < weak, 1).when(evidenced & (ratio >= strong), 3).otherwise(2)
        grade = (
            F.when(flags["category_violation"], 0)
            .when(v["other"], F.when(related, 1).otherwise(0))
            .when(flags["price_violation"] | flags["brand_violation"] | flags["rating_violation"], 1)
            .otherwise(soft)
        )
        return F.struct(grade.cast("int").alias("grade"), v["other"].alias("other_violation"))

    inputs = F.struct(
        body.alias("body"), _words(F.coalesce(semantic, query), 3, CORE_STOP).alias("core"), other.alias("other")
    )
    return let(inputs, graded)


def adjudicate(a: DataFrame, b: DataFrame, flags: DataFrame, decisions: DataFrame) -> DataFrame:
    """E17 / J16. Agreement resolves; disagreement needs a decision; a violation caps at 1.

    ``a``/``b``: query_id, doc_id, grade and the violation flags the review asserts;
    ``flags``: deterministic violation flags; ``decisions``: query_id, doc_id, decision
    (NULL = unresolved) and the flags the decision asserts.  A flag holds if anyone who
    took part in the resolution asserts it; a missing flag asserts nothing.  Without two
    reviews a pair keeps the deterministic flags.
    """
    key = ["query_id", "doc_id"]

    def part(df: DataFrame, value: str, name: str) -> DataFrame:
        given = F.struct(*[(F.col(f) if f in df.columns else F.lit(None)).cast("boolean").alias(f) for f in FLAGS])
        return df.select(*key, F.col(value).alias(name), given.alias(f"_{name}"))

    rows = (
        flags.select(*key, *FLAGS)
        .join(part(a, "grade", "grade_a"), key, "left")
        .join(part(b, "grade", "grade_b"), key, "left")
        .join(part(decisions, "decision", "decision"), key, "left")
    )
    both = F.col("grade_a").isNotNull() & F.col("grade_b").isNotNull()
    agree = both & F.col("grade_a").eqNullSafe(F.col("grade_b"))
    decided = F.coalesce(both & ~agree & F.col("decision").isin(*VALID_GRADES), F.lit(False))

    def says(side: str, f: str, taking_part: Column) -> Column:
        return taking_part & F.coalesce(F.col(f"_{side}.{f}"), F.lit(False))

    merged = {
        f: F.coalesce(f, F.lit(False)) | says("grade_a", f, both) | says("grade_b", f, both) | says("decision", f, decided)
        for f in FLAGS
    }
    violated = F.lit(False)
    for f in FLAGS:
        violated = violated | F.col(f)
    raw = F.when(agree, F.col("grade_a")).when(decided, F.col("decision"))
    return (
        rows.withColumns({**merged, "_raw": raw, "_agree": agree, "_decided": decided, "_both": both})
        .withColumns(
            {
                "final_grade": F.when(violated & (F.col("_raw") >= 2), 1).otherwise(F.col("_raw")).cast("int"),
                "constraint_override": F.coalesce(violated & (F.col("_raw") >= 2), F.lit(False)),
                "resolution": F.when(F.col("_raw").isNotNull(), "RESOLVED").otherwise("UNRESOLVED"),
                "label_source": F.when(F.col("_agree"), "AGREEMENT").when(F.col("_decided"), "ADJUDICATION"),
                "reason": F.when(~F.col("_both"), "MISSING_REVIEW").when(
                    ~F.col("_agree") & ~F.col("_decided"), "DISAGREEMENT_WITHOUT_DECISION"
                ),
            }
        )
        .drop("_raw", "_agree", "_decided", "_both", "_grade_a", "_grade_b", "_decision", "decision")
    )


def disagreement_tasks(a: DataFrame, b: DataFrame) -> DataFrame:
    """E18."""
    key = ["query_id", "doc_id"]
    return (
        a.select(*key, F.col("grade").alias("grade_a"))
        .join(b.select(*key, F.col("grade").alias("grade_b")), key)
        .filter(F.col("grade_a") != F.col("grade_b"))
    )


def qrels(adjudicated: DataFrame) -> DataFrame:
    """E19."""
    rows = adjudicated.filter((F.col("resolution") == "RESOLVED") & F.col("final_grade").isin(*VALID_GRADES))
    return rows.select(
        "query_id", "doc_id", F.col("final_grade").alias("grade"), *FLAGS, "label_source",
        fingerprint(q=F.col("query_id"), d=F.col("doc_id"), g=F.col("final_grade"), s=F.col("label_source")).alias(
            "fingerprint"
        ),
    )


def reviewer_pairs(reviews: DataFrame, key: list[str], reviewer: str, value: str) -> DataFrame:
    """J11. Exactly two distinct reviewers per key, in reviewer order; else not ``paired``.

    Counts come from a partial aggregate; only the two extreme reviewers are kept,
    so a key with many submissions is never collected.
    """
    entry = F.struct(F.col(reviewer).alias("r"), F.col(value).alias("v"))
    grouped = reviews.groupBy(*key).agg(
        F.count(F.lit(1)).alias("submissions"),
        F.count_distinct(reviewer).alias("reviewers"),
        F.count_if(F.coalesce(F.col(reviewer), F.lit("")) == "").alias("anonymous"),
        F.min(entry).alias("_lo"),
        F.max(entry).alias("_hi"),
    )
    paired = (F.col("submissions") == 2) & (F.col("reviewers") == 2) & (F.col("anonymous") == 0)
    return grouped.select(
        *key, "submissions", "reviewers", paired.alias("paired"),
        F.when(paired, F.col("_lo.v")).alias("first"), F.when(paired, F.col("_hi.v")).alias("second"),
    )


def assemble(expected: DataFrame, pairs: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """E20. Ground truth per expected key, with the reason where it is incomplete."""
    decided = decisions.groupBy(*key).agg(
        F.count(F.lit(1)).alias("decisions"), F.first("value", ignorenulls=True).alias("value"),
        F.count_if(F.coalesce("adjudicator", F.lit("")) == "").alias("unsigned"),
    )
    rows = expected.select(*key).join(pairs, key, "left").join(decided, key, "left")
    problem = (
        F.when(~F.coalesce("paired", F.lit(False)), "NEEDS_TWO_REVIEWERS")
        .when(F.col("decisions").isNull(), "NEEDS_DECISION")
        .when((F.col("decisions") > 1) | (F.col("unsigned") > 0), "BAD_DECISION")
    )
    return rows.select(
        *key, "first", "second", F.when(problem.isNull(), F.col("value")).alias("value"), problem.alias("problem")
    )


def audit_snapshot(queries: DataFrame, a: DataFrame, b: DataFrame, decisions: DataFrame, fields: list[str]) -> DataFrame:
    """E35. Query-level adjudication: exact agreement, else a decision, else unresolved."""
    x = a.select("query_id", F.struct(*fields).alias("a"))
    y = b.select("query_id", F.struct(*fields).alias("b"))
    z = decisions.select("query_id", F.struct(*fields).alias("d"))
    rows = queries.select("query_id").join(x, "query_id", "left").join(y, "query_id", "left").join(z, "query_id", "left")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    agree = both
    for f in fields:
        agree = agree & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    agree = F.coalesce(agree, F.lit(False))
    chosen = F.when(agree, F.col("a")).when(both, F.col("d"))
    return rows.withColumn("_c", chosen).select(
        "query_id",
        F.when(~both, "UNRESOLVED").when(agree | F.col("d").isNotNull(), "RESOLVED").otherwise("UNRESOLVED").alias("resolution"),
        agree.alias("exact_agreement"),
        *[F.col(f"_c.{f}").alias(f) for f in fields],
    )


def claim_review_errors(labels: dict[str, Column], confidence: Column) -> Column:
    """V07. Claim review fields with a value outside their vocabulary."""
    return F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(F.upper(labels[f]), F.lit("")).isin(*allowed), F.lit(f))
                for f, allowed in CLAIM_LABELS.items()
            ],
            F.when(~confidence.between(0, 1), F.lit("confidence")),
        )
    )


def adjudicate_claims(a: DataFrame, b: DataFrame, decisions: DataFrame) -> DataFrame:
    """V07. All four labels equal resolves; otherwise the decision does."""
    return audit_snapshot(
        a.select(F.col("claim_id").alias("query_id")).union(b.select("claim_id")).distinct(),
        a.withColumnRenamed("claim_id", "query_id"),
        b.withColumnRenamed("claim_id", "query_id"),
        decisions.withColumnRenamed("claim_id", "query_id"),
        list(CLAIM_LABELS),
    ).withColumnRenamed("query_id", "claim_id")
