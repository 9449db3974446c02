"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words; its documents would be taken target / size times on
average.  The whole part of that rate is taken by each document; the fraction is a copy
probability, rounded to 0 or 1 by the pivotal method: two documents with fractional
probabilities meet, and words move from one to the other, in a random direction, until
one of them is integral.  The direction is drawn so that every probability keeps its
expected value, and words taken keep their sum exactly.  What is left of a group of documents
is one fractional document, its residual.  Residuals meet in groups again, up a tree, until
one a source is left, which a last draw rounds: a source misses its target by less than
one document, and by a short one, since long documents meet first.

Documents are numbered within their source in an order that only hashes and values decide,
and groups are ranges of these numbers.  So a source or an id of any size is cut evenly,
and the same table gives the same result under any partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm.ordinals import numbered
from merchlens.llm.registry import query, read
from merchlens.session import cut_lineage

# Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
# All targets together, as a share of all sizes, and the most copies of a document.
SHARE, MOST = 1.5, 2.0
SEED = 42
# Documents (then residuals) that one task rounds together.
GROUP = 10_000


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size, target) from (source, size), one row per source, stored.

    Sources by code point, null last, take ``weights`` in turn.  They share ``share`` of all
    sizes in proportion; a target stops at ``most`` times its source's size, and what is
    over is shared by the others by weight until none is above.  Each round is one
    aggregate of the sources; at least one more source stops in each but the last.
    """
    if share > most or min(weights) <= 0:
        raise ValueError("share must not exceed most, and weights must be positive")
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(total, [], [F.col("source").asc_nulls_last()], "rank")
    turn = F.pmod("rank", F.lit(len(weights))).cast("int") + 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)
    known = cut_lineage(ranked.select("source", "source_size", weight.alias("weight")))
    every = known.agg(F.sum("source_size")).first()[0] or 0
    ceiling = F.lit(float(most)) * F.col("source_size")
    level = None  # words per unit of weight
    while True:
        stopped = F.lit(False) if level is None else F.lit(level) * F.col("weight") >= ceiling
        full, free = known.agg(
            F.sum(F.when(stopped, F.col("source_size"))), F.sum(F.when(~stopped, F.col("weight")))
        ).first()
        if not free:  # every source is full
            level = float("inf")
            break
        now = (share * every - most * (full or 0)) / free
        if level is not None and now <= level:
            break
        level = now
    reached = F.when(F.lit(level) * F.col("weight") >= ceiling, ceiling).otherwise(F.lit(level) * F.col("weight"))
    return known.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(reached).alias("target"))


def _pivotal(part: np.ndarray, size: np.ndarray, draw: np.ndarray) -> int:
    """Round the probabilities ``part`` in place; returns the place of the residual, -1 without.

    A meeting of i and j moves words: p_i grows by d / size_i while p_j falls by d / size_j, or
    the other way round.  Each way ends at the first bound; it is taken with the
    probability that leaves both expectations as they were.
    """
    left = -1
    for j in np.flatnonzero((part > 0) & (part < 1)).tolist():
        if left < 0:
            left = j
            continue
        i, a, b, x, y = left, part[left], part[j], size[left], size[j]
        to_i, room_i = b * y, (1 - a) * x
        to_j, room_j = a * x, (1 - b) * y
        up, down = min(to_i, room_i), min(to_j, room_j)
        if draw[j] * (up + down) < down:  # words go from j to i
            if room_i <= to_i:
                part[i], part[j] = 1.0, b - up / y
                left = j
            else:
                part[i], part[j] = a + up / x, 0.0
        elif room_j <= to_j:
            part[i], part[j] = a - down / x, 1.0
        else:
            part[i], part[j] = 0.0, b + down / y
            left = j
        # Both may end integral at once, up to the precision of the sums.
        if not 1e-12 < part[left] < 1 - 1e-12:
            part[left] = round(part[left])
            left = -1
    return left


def _round_group(rows: pd.DataFrame) -> pd.DataFrame:
    # Long documents meet first and settle against one another, so the residual is a short one.  The
    # order is complete: a task that runs again, over rows in any order, decides the same.
    rows = rows.sort_values(["size", "place"], ascending=[False, True])
    part, draw = rows["part"].to_numpy(np.float64).copy(), rows["draw"].to_numpy(np.float64)
    left = _pivotal(part, rows["size"].to_numpy(np.float64), draw)
    settled = np.ones(len(rows), bool)
    if left >= 0:
        settled[left] = False
    return rows.assign(part=part, settled=settled)


def _draw(place: Column, level: int, seed: int) -> Column:
    """A uniform number in [0, 1) of each place of a source and level of the tree."""
    hashed = F.xxhash64("source", place, F.lit(level), F.lit(seed))
    return F.shiftrightunsigned(hashed, 11).cast("double") / float(1 << 53)


def copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
    group: int = GROUP,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row per row of ``docs``.

    The copies of a source's documents hold its target in words up to less than one document;
    no document has more than ``most`` copies, rounded up.  A null size counts as 0; documents of size 0 are
    taken by a draw of their own, since no words depend on them.  Equal rows are
    documents of their own, null sources a source, null ids allowed.  Other columns are
    ignored; no rows give no rows.
    """
    slim = cut_lineage(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            F.col(f"`{source}`").alias("source"),
            F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)).alias("size"),
        )
    )
    # Only values and their hash order the documents: whichever of equal rows comes first, the result is the same.
    order = [F.xxhash64("doc_id", "size", F.lit(seed)), F.col("doc_id"), F.col("size")]
    placed = numbered(slim, ["source"], order, "place")
    known = targets(slim, weights, share, most).withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = placed.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    level = 0
    draw = _draw(F.col("place"), 0, seed)
    part = F.col("rate") - F.floor("rate")
    start = rated.select(
        "doc_id", "source", "size", "source_size", "target", "place",
        F.floor("rate").cast("bigint").alias("whole"),
        F.when((F.col("size") == 0) & (part > 0), (draw < part).cast("double")).otherwise(part).alias("part"),
    )
    done, now = [], start
    kinds = now.select("*", F.lit(0.0).alias("draw"), F.lit(0).cast("bigint").alias("cell"), F.lit(True).alias("settled"))
    schema = kinds.schema
    while True:
        cell = F.floor(F.col("place") / float(group) ** (level + 1)).cast("bigint")
        dealt = now.select(*start.columns, _draw(F.col("place"), level + 1, seed).alias("draw"), cell.alias("cell"))
        rounded = cut_lineage(dealt.groupBy("source", "cell").applyInPandas(_round_group, _nullable(schema)))
        done.append(rounded.filter("settled"))
        now = rounded.filter("not settled")
        if (now.agg(F.max("cell")).first()[0] or 0) == 0:
            break
        level += 1
    last = _draw(F.col("place"), -1, seed) < F.col("part")
    done.append(now.withColumn("part", last.cast("double")))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    taken = F.col("whole") + F.round("part").cast("bigint")
    return every.select("doc_id", "source", "size", "source_size", "target", taken.alias("copies"))


def _nullable(schema):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def mixture(docs: DataFrame, chosen: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as ``copies`` says, with ``copy`` from 0.

    ``chosen`` is a result of `copies`; its ids must be unique and not null.
    """
    counts = chosen.filter("copies > 0").select(F.col("doc_id").alias(doc_id), F.col("copies").alias("__copies"))
    rows = docs.drop("copy").join(counts, doc_id)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__copies") - 1))).drop("__copies")


@query("op13_source_mixing")
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, and the target of its source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    chosen = copies(docs)
    return chosen.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )
