"""Fill-in-the-middle transformation by secondary-sort assembly.

A document is cut at two places into prefix, middle and suffix, and written in another
order with a marker before each part.  Texts are emitted as pieces of at most CHUNK code
points (units), keyed by document and position in the output.  One
``repartitionAndSortWithinPartitions`` brings the pieces of a document into one partition
in output order, where they stream into the output or into an incremental digest.
Restoration reads that output, finds the markers in it, keys every piece by its part and
sorts anew; the partitioner is the same, so nothing is shuffled again.

No task holds a partition's texts beyond what Spark's external sorter allows, partitions are
sized by the bytes of the texts, and a lost executor costs its partitions only: row numbers
come from the scan, cuts from a hash of the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlens.llm.registry import query, read

# Markers of the parts, in the order of the text.
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
MARKERS = ("<P>", "<M>", "<S>")
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
SEED = "1"
# Of 100 documents so many stay plain, and so many of the others start with the suffix.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
CHUNK = 8192
PARTITION_BYTES = 32 << 20


def cuts(doc_id, text: str, seed: str = SEED, plain: int = PLAIN_PERCENT, spm: int = SPM_PERCENT):
    """(form, end of prefix, end of middle) of a text, by a hash of seed and id; a null id is ``null``."""
    name = f"{seed}:{'null' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= 100 - plain:
        return "plain", 0, len(text)
    first, last = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return ("spm" if h4 % 100 < spm else "psm"), first, last


def _of_document(key) -> int:
    """Partition of a piece: every key starts with the number of its row."""
    return key[0]


def _chunks(text: str, size: int) -> Iterator[tuple[int, str]]:
    for at in range(0, max(1, len(text)), size):
        yield at, text[at : at + size]


def pieces(seed: str, plain: int, spm: int, size: int):
    """Rows (row, doc_id, text) to ((row, output position), piece); position -1 holds the facts of the document."""

    def emit(rows: Iterable) -> Iterator:
        for row, doc_id, text in rows:
            text = text or ""
            form, first, last = cuts(doc_id, text, seed, plain, spm)
            if form == "plain":
                yield (row, -1), (doc_id, len(text), form, None, None)
                for at, piece in _chunks(text, size):
                    yield (row, at), piece
                continue
            yield (row, -1), (doc_id, len(text), form, first, last - first)
            bounds = ((0, first), (first, last), (last, len(text)))
            start = dict.fromkeys(ORDERS[form], 0)
            at = 0
            for part in ORDERS[form]:
                start[part] = at
                at += len(MARKERS[part]) + bounds[part][1] - bounds[part][0]
            for part, (low, high) in enumerate(bounds):
                # The marker travels with the first piece of its part.
                for off, piece in _chunks(MARKERS[part] + text[low:high], size):
                    yield (row, start[part] + off), piece

    return emit


def parts_of(form: str, stream: Iterable[str]) -> Iterator[tuple[int, int, str]]:
    """(part, offset, piece) of an output that arrives in pieces; markers may lie across their edges."""
    if form == "plain":
        at = 0
        for piece in stream:
            yield PREFIX, at, piece
            at += len(piece)
        return
    ahead = list(ORDERS[form])
    part, at, held = None, 0, ""
    for piece in stream:
        held += piece
        while ahead:
            marker = MARKERS[ahead[0]]
            found = held.find(marker)
            stop = found if found >= 0 else max(0, len(held) - len(marker) + 1)
            if part is not None and stop:
                yield part, at, held[:stop]
                at += stop
            if found < 0:
                held = held[stop:] if part is not None else held
                break
            held, part, at = held[found + len(marker) :], ahead.pop(0), 0
        else:
            if held:
                yield part, at, held
                at, held = at + len(held), ""
    if held:
        yield part, at, held


def _documents(sorted_pieces: Iterable) -> Iterator[tuple[int, tuple, Iterator[str]]]:
    """(row, facts, its pieces) of each document of a sorted partition; pieces left over are skipped."""
    stream = iter(sorted_pieces)
    pending = next(stream, None)
    while pending is not None:
        (row, *_), facts = pending
        pending = None

        def own(row=row):
            nonlocal pending
            for key, piece in stream:
                if key[0] != row:
                    pending = key, piece
                    return
                yield piece

        body = own()
        yield row, facts, body
        for _ in body:
            pass


def _keyed_rows(docs: DataFrame, columns: list) -> tuple[RDD, int]:
    """The rows as an RDD and the number of partitions that their bytes call for."""
    slim = docs.select(F.monotonically_increasing_id().alias("row"), *columns)
    total = slim.agg(F.sum(F.octet_length(slim.columns[-1]))).first()[0] or 0
    least = docs.sparkSession.sparkContext.defaultParallelism
    return slim.rdd, max(least, -(-total // PARTITION_BYTES))


def _sorted_outputs(docs: DataFrame, doc_id: str, text: str, seed, plain, spm, size) -> tuple[RDD, int]:
    named = [F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")]
    rows, n = _keyed_rows(docs, named)
    return rows.mapPartitions(pieces(seed, plain, spm, size)).repartitionAndSortWithinPartitions(n, _of_document), n


def _facts_schema(docs: DataFrame, doc_id: str, *more: tuple[str, T.DataType]) -> T.StructType:
    fields = [("doc_id", docs.schema[doc_id].dataType), ("n", T.LongType()), ("form", T.StringType())]
    fields += [("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), *more]
    return T.StructType([T.StructField(*f) for f in fields])


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: str = SEED,
    plain: int = PLAIN_PERCENT,
    spm: int = SPM_PERCENT,
    size: int = CHUNK,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``.

    ``form`` is plain (output is the text), psm or spm; a text that is empty or holds a
    marker stays plain.  Lengths are code points, null for plain.  A null text counts as
    empty, a null id as ``null``; repeated rows are documents of their own, equal ids are cut
    at the same fractions.  Other columns are ignored; no rows give no rows.
    """
    ordered, _ = _sorted_outputs(docs, doc_id, text, seed, plain, spm, size)

    def assemble(part):
        for _, facts, body in _documents(part):
            yield (*facts, "".join(body))

    schema = _facts_schema(docs, doc_id, ("output", T.StringType()))
    return docs.sparkSession.createDataFrame(ordered.mapPartitions(assemble), schema, verifySchema=False)


def _resorted(keyed: RDD, n: int) -> RDD:
    """((row, part, offset), piece) in the order of the text; -1 as a part holds the facts."""
    return keyed.repartitionAndSortWithinPartitions(n, _of_document)


def restore(transformed: DataFrame, size: int = CHUNK) -> DataFrame:
    """(doc_id, text) from ``doc_id``, ``form`` and ``output`` alone, one row per row.

    The markers are looked up in the output, so a row whose markers are missing gives what
    stands after those that are there.
    """
    rows, n = _keyed_rows(transformed, ["doc_id", "form", "output"])

    def emit(part):
        for row, doc_id, form, output in rows_of(part):
            yield (row, -1, 0), (doc_id,)
            for where, at, piece in parts_of(form, (p for _, p in _chunks(output, size))):
                yield (row, where, at), piece

    def rows_of(part):
        for row, doc_id, form, output in part:
            yield row, doc_id, form or "plain", output or ""

    def assemble(part):
        for _, facts, body in _documents(part):
            yield (*facts, "".join(body))

    schema = T.StructType([transformed.schema["doc_id"], T.StructField("text", T.StringType())])
    ordered = _resorted(rows.mapPartitions(emit), n)
    return transformed.sparkSession.createDataFrame(ordered.mapPartitions(assemble), schema, verifySchema=False)


def digests(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: str = SEED,
    plain: int = PLAIN_PERCENT,
    spm: int = SPM_PERCENT,
    size: int = CHUNK,
) -> DataFrame:
    """`fill_in_middle` with ``output_sha256`` and ``restored_sha256`` in place of the output.

    No output or restored text is ever whole in memory: both digests are fed piece by piece,
    the second from the parts that the output's own markers bound.
    """
    ordered, n = _sorted_outputs(docs, doc_id, text, seed, plain, spm, size)

    def taken_apart(part):
        for row, facts, body in _documents(part):
            digest = hashlib.sha256()

            def hashed(body=body, digest=digest):
                for piece in body:
                    digest.update(piece.encode("utf-8", "surrogatepass"))
                    yield piece

            for where, at, piece in parts_of(facts[2], hashed()):
                yield (row, where, at), piece
            yield (row, -1, 0), (*facts, digest.hexdigest())

    def restored(part):
        for _, facts, body in _documents(part):
            digest = hashlib.sha256()
            for piece in body:
                digest.update(piece.encode("utf-8", "surrogatepass"))
            yield (*facts, digest.hexdigest())

    again = _resorted(ordered.mapPartitions(taken_apart, preservesPartitioning=True), n)
    more = [("output_sha256", T.StringType()), ("restored_sha256", T.StringType())]
    schema = _facts_schema(docs, doc_id, *more)
    return docs.sparkSession.createDataFrame(again.mapPartitions(restored), schema, verifySchema=False)


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x
  FROM documents),
h AS (
  SELECT doc_id, t, n, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS p1, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS p2,
         CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS h4
  FROM d),
f AS (
  SELECT *, least(p1, p2) AS a, greatest(p1, p2) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
c AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document's fill-in-the-middle output and of the text restored from it."""
    return digests(read(spark, sf_dir, "documents"))
