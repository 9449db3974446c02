"""Line dedup by site-relative frequency.

A line is boilerplate of a host when the share of the host's pages that contain it
exceeds a ratio.  Such lines are dropped from every page of that host, everything
else stays as it was, in order.

Plan: each page is reduced to the distinct hashes of its lines; (host, hash) counts
are pre-aggregated before their shuffle, so a host with a third of all pages and a
line on every page cost what others cost.  The lines to drop are few by
construction: a host's shares add up to its mean number of lines per page, so at most
``mean lines / ratio`` lines can exceed the ratio.  They travel to the pages as one
short array per host: broadcast if the measured total is small, else joined with hot
hosts cut in pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm.registry import query, read
from merchlens.operators.skew import salted_join
from merchlens.session import cut_lineage

RATIO = 0.02
MIN_PAGES = 4
# Hashes that one broadcast may hold (8 bytes each).
BROADCAST_HASHES = 500_000
ROWS_PER_SPLIT = 200_000

_BLANK = " \t\r\x0b\x0c"


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def _site(host: Column) -> Column:
    """Join key of a host; pages without a host form one site of their own."""
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("n"))


def boilerplate_lines(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """(site, lines, pages): hashes of the lines each site repeats too often.

    A line counts once per page, without surrounding blanks; blank lines never count.
    It is boilerplate if it is on at least ``min_pages`` pages and on more than
    ``ratio`` of the site's pages.  Rows with null text are pages without lines.  With
    ``copies_once`` equal texts of a site are one page, so that the copies of a page do not
    make its lines boilerplate.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), _stripped), lambda x: x != "")
    hashes = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))
    slim = pages.select(_site(F.col(host)).alias("site"), hashes.alias("hashes"), F.col(text).alias("page"))
    if copies_once:
        slim = slim.groupBy("site", F.xxhash64("page").alias("page")).agg(F.any_value("hashes").alias("hashes"))
    totals = slim.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages"))
    counts = (
        slim.select("site", F.explode("hashes").alias("line"))
        .groupBy("site", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_pages)
    )
    return (
        counts.join(totals, "site")
        .filter(F.col("n") > F.lit(ratio) * F.col("site_pages"))
        .groupBy("site")
        .agg(F.collect_set("line").alias("lines"), F.max("site_pages").alias("pages"))
    )


def drop_boilerplate(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    dropped: str | None = None,
    copies_once: bool = False,
) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``, all other columns kept.

    Null text stays null; a text all of whose lines go becomes empty; repeated rows are
    separate pages unless ``copies_once`` (null texts are one page too then); an empty table gives an empty table.  ``dropped`` names an optional
    column for the number of lines taken out (0 for null text); a column of that name
    is replaced.
    """
    bad = cut_lineage(boilerplate_lines(pages, host, text, ratio, min_pages, copies_once))
    size = bad.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    keep = [c for c in pages.columns if c != dropped]
    keyed = pages.withColumn("__site", _site(F.col(f"`{host}`")))
    bad_lines = bad.select(F.col("site").alias("__site"), F.col("lines").alias("__lines"))
    if size <= BROADCAST_HASHES:
        joined = keyed.join(F.broadcast(bad_lines), "__site", "left")
    else:
        hot = bad.filter(F.col("pages") > ROWS_PER_SPLIT).select(
            F.col("site").alias("__site"),
            F.ceil(F.col("pages") / ROWS_PER_SPLIT).cast("bigint").alias("_fan"),
        )
        joined = salted_join(keyed, bad_lines, "__site", hot, text, "left")
    parts = F.split(F.col(f"`{text}`"), "\n")
    kept = F.filter(
        parts, lambda x: (_stripped(x) == "") | ~F.array_contains("__lines", F.xxhash64(_stripped(x)))
    )
    joined = joined.withColumn("__kept", F.when(F.col("__lines").isNotNull(), kept))
    out = [
        F.coalesce(F.array_join("__kept", "\n"), F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`")
        for c in keep
    ]
    if dropped is not None:
        lost = F.when(F.col("__kept").isNotNull(), F.size(parts) - F.size("__kept"))
        out.append(F.coalesce(lost, F.lit(0)).cast("bigint").alias(dropped))
    return joined.select(*out)


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, source, text, i, string_split(text, chr(10))[i] AS line,
         trim(string_split(text, chr(10))[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s
  FROM (SELECT doc_id, source, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i
        FROM documents WHERE text IS NOT NULL)),
tot AS (SELECT source, count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS pages FROM documents GROUP BY source),
bad AS (
  SELECT c.source, c.s FROM (SELECT source, s, count(DISTINCT text) AS n FROM l WHERE s <> '' GROUP BY source, s) c
  JOIN tot ON c.source IS NOT DISTINCT FROM tot.source
  WHERE n >= 4 AND n > 0.02 * pages),
kept AS (
  SELECT l.doc_id, string_agg(CASE WHEN bad.s IS NULL THEN line END, chr(10) ORDER BY i) AS text,
         sum(CASE WHEN bad.s IS NULL THEN 0 ELSE 1 END) AS n_dropped
  FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.s = bad.s GROUP BY l.doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query("op10_line_dedup", OP10_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines its source repeats on over 2 % of its documents.

    Equal texts of a source are one document here, so that no group of copies loses all its
    lines; which of the copies stays is for near-dedup to say.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, dropped="n_dropped", copies_once=True)
