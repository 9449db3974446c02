"""TF-IDF retrieval as an inverted index.

Semantics: lower-cased word runs, 1- and 2-grams, ``min_df`` 2, ``max_df`` 0.8,
``1 + ln(tf)``, ``ln((1+N)/(1+df)) + 1``, L2 norm over kept terms.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from merchlens.functions.text import tokens
from merchlens.operators.skew import ROWS_PER_SPLIT
from merchlens.session import cut_lineage

MIN_DF = 2
MAX_DF = 0.8


# Words whose terms a task counts at once; postings or pairs it deals at once; rows of one Arrow batch; documents for
# each bucket of terms; documents and queries of one block of scores.
WORDS_AT_ONCE = 500_000
DEALT_AT_ONCE = 1_000_000
ROWS_PER_BATCH = 100_000
DOCS_PER_BUCKET = 4_096
DOCS_PER_BLOCK = 8_192
QUERIES_PER_BLOCK = 512


@dataclass(frozen=True)
class LexicalIndex:
    """``vocab`` (term, df, idf), ``postings`` (doc, term, weight of unit-length documents), corpus size.

    An index made by `fit` also has what its postings are computed from: ``lists`` (term, df,
    idf, first, docs, tfs), the documents of a term in pieces, and ``norms`` (doc_id, norm).
    """

    vocab: DataFrame
    postings: DataFrame
    corpus_size: DataFrame
    lists: DataFrame | None = None
    norms: DataFrame | None = None


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), tokens(F.col(text_col)).alias("w"))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, lists of words), about WORDS_AT_ONCE words at once; batches are joined or cut, documents never."""
    held, n = [], 0

    def joined():
        return tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype("int64"))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + WORDS_AT_ONCE - n, "right")))
            held.append(batch.slice(start, stop - start))
            n, start = n + int(ends[stop - 1]) - before, stop
            if n >= WORDS_AT_ONCE or start < len(ends):
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def _hashed(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value, the same in every task."""
    plain = values if pa.types.is_integer(values.type) else values.cast(pa.string())
    return pd.util.hash_array(pc.fill_null(plain, pa.scalar(0 if plain is values else "", plain.type)).to_numpy(zero_copy_only=False), categorize=False)


def _hashed_runs(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term number, row, tf) of the 1- and 2-grams of every list, by term and row, and a hash of each term.

    Words are looked up as texts, their pairs as numbers; only the text of a distinct pair is made.
    """
    flat, row = words.flatten(), pc.list_parent_indices(words).to_numpy()
    same = row[1:] == row[:-1]
    coded = flat.dictionary_encode()
    single, word = coded.dictionary, coded.indices.to_numpy().astype("int64")
    pairs = pa.array((word[:-1] * len(single) + word[1:])[same]).dictionary_encode()
    first, second = np.divmod(pairs.dictionary.to_numpy(), max(1, len(single)))
    double = pc.binary_join_element_wise(single.take(pa.array(first)), single.take(pa.array(second)), " ")
    term = np.concatenate([word, pairs.indices.to_numpy().astype("int64") + len(single)])
    keys, tf = np.unique(term * len(words) + np.concatenate([row, row[:-1][same]]), return_counts=True)
    one = _hashed(single)
    two = one[first] * np.uint64(0x9E3779B97F4A7C15) + one[second]
    terms = pa.concat_arrays([single, double.cast(single.type)])
    return terms, keys // len(words), keys % len(words), tf.astype("int32"), np.concatenate([one, two ^ (two >> np.uint64(29))])


def _runs(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term number, row, tf) of the 1- and 2-grams of every list, by term and row."""
    return _hashed_runs(words)[:4]


def term_counts(docs: DataFrame, id_col: str, text_col: str, name: str = "doc_id") -> DataFrame:
    """(doc, term, tf).

    A document is one row, so its counts are made where it is read.  Nothing is
    shuffled to count terms.
    """

    def run(batches):
        for ids, words in _portions(batches):
            terms, term, row, tf = _runs(words)
            for i in range(0, len(tf), ROWS_PER_BATCH):
                at = slice(i, i + ROWS_PER_BATCH)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[at])), terms.take(pa.array(term[at])), pa.array(tf[at])], [name, "term", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _words(docs, id_col, text_col).mapInArrow(run, f"`{name}` {kind}, term string, tf int")


def _packed(terms: pa.Array, term: np.ndarray, docs: pa.Array, tf: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> bytes:
    """The postings of the chosen runs, as a compressed Arrow stream (term, n) and (doc, tf)."""
    lengths = np.diff(starts)[chosen]
    each = np.repeat(starts[:-1][chosen] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), terms.take(pa.array(term[starts[:-1][chosen]]))),
            pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.array(lengths.astype("int32"))),
            pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), docs.take(pa.array(each))),
            pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), pa.array(tf[each])),
        ],
        ["term", "n", "docs", "tfs"],
    )
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _merged(packs: pa.Array, n_docs: int, min_df: int, max_df: float) -> Iterator[pa.RecordBatch]:
    """(term, df, idf, first, docs, tfs) of the kept terms of some packs; long lists are several rows."""
    parts = [pa.ipc.open_stream(p.as_buffer()).read_next_batch() for p in packs]
    terms, lengths, docs, tfs = (pa.concat_arrays([p.column(i).flatten() for p in parts]) for i in range(4))
    coded = terms.dictionary_encode()
    lengths = lengths.to_numpy().astype("int64")
    code = coded.indices.to_numpy()
    df = np.bincount(code, weights=lengths, minlength=len(coded.dictionary)).astype("int64")
    kept = (df >= min_df) & (df <= max_df * n_docs)
    order = np.argsort(code, kind="stable")
    order = order[kept[code[order]]]
    begins, sizes = np.cumsum(lengths) - lengths, lengths[order]
    each = np.repeat(begins[order] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    found = np.flatnonzero(kept)
    ends = np.cumsum(df[found])
    # Rows: the terms in turn, cut where a list is longer than a batch.
    pieces = -(-df[found] // ROWS_PER_BATCH)
    which = np.repeat(np.arange(len(found)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.append((ends - df[found])[which] + nth * ROWS_PER_BATCH, len(each))
    i = 0
    while i < len(which):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + ROWS_PER_BATCH, "right")) - 1)
        at, cuts, own = pa.array(each[starts[i] : starts[j]]), pa.array((starts[i : j + 1] - starts[i]).astype("int32")), found[which[i:j]]
        yield pa.RecordBatch.from_arrays(
            [
                coded.dictionary.take(pa.array(own)),
                pa.array(df[own]),
                pa.array(np.log((1 + n_docs) / (1 + df[own])) + 1),
                pa.array(nth[i:j] == 0),
                pa.ListArray.from_arrays(cuts, docs.take(at)),
                pa.ListArray.from_arrays(cuts, tfs.take(at)),
            ],
            ["term", "df", "idf", "first", "docs", "tfs"],
        )
        i = j


def posting_lists(
    docs: DataFrame, size: DataFrame, id_col: str, text_col: str, min_df: int = MIN_DF, max_df: float = MAX_DF
) -> DataFrame:
    """(term, df, idf, first, docs, tfs) of the kept terms; one row a term is its ``first``.

    Terms are dealt into buckets by a hash, more of them the more documents there are. A task
    sends one packed row per bucket and portion of its documents; this shuffle is the only one that
    moves postings. Document frequencies, the choice of terms and their idf are made where it ends.
    """
    n_docs = size.first()["n_docs"]
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(n_docs / DOCS_PER_BUCKET))

    def pack(batches):
        for ids, words in _portions(batches):
            terms, term, row, tf, hashed = _hashed_runs(words)
            starts = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
            # Every term of the dictionary is one run, in its order.
            bucket = (hashed % np.uint64(buckets)).astype("int32")
            order = np.argsort(bucket, kind="stable")
            found, cuts = np.unique(bucket[order], return_index=True)
            docs_of = ids.take(pa.array(row))
            for b, chosen in zip(found.tolist(), np.split(order, cuts[1:])):
                sent = _packed(terms, term, docs_of, tf, starts, chosen)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sent], pa.binary())], ["bucket", "pack"])
            # What a portion took goes back before the next one is read.
            del terms, term, row, tf, hashed, starts, bucket, order, docs_of
            pa.default_memory_pool().release_unused()

    def merge(table: pa.Table) -> pa.Table:
        made = [*_merged(table["pack"].combine_chunks(), n_docs, min_df, max_df)]
        return pa.Table.from_batches(made) if made else empty

    kind = docs.schema[id_col].dataType
    out = T.StructType.fromDDL(f"term string, df bigint, idf double, first boolean, docs array<{kind.simpleString()}>, tfs array<int>")
    empty = to_arrow_schema(out).empty_table()
    packed = _words(docs, id_col, text_col).mapInArrow(pack, "bucket int, pack binary")
    return packed.groupBy("bucket").applyInArrow(merge, out)


def _listed(lists: DataFrame, *names: str) -> DataFrame:
    """(doc_id, names, w): the postings of lists, weights of documents as long as they are."""
    each = lists.select(*names, "idf", F.inline(F.arrays_zip(F.col("docs").alias("d"), F.col("tfs").alias("f"))).alias("d", "f"))
    return each.select(F.col("d").alias("doc_id"), *names, ((1 + F.log("f")) * F.col("idf")).alias("w"))


def vocabulary_of(lists: DataFrame) -> DataFrame:
    return lists.filter("first").select("term", "df", "idf")


def norms_of(lists: DataFrame) -> DataFrame:
    """(doc_id, norm).  Few tasks read the lists, so that each adds up many postings of a document before the shuffle."""
    few = lists.coalesce(4 * lists.sparkSession.sparkContext.defaultParallelism)
    return _listed(few).groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def index_of(lists: DataFrame, vocab: DataFrame, norms: DataFrame, size: DataFrame) -> LexicalIndex:
    """The index of stored lists; its postings are computed when they are read."""
    unit = _listed(lists, "term").withColumnRenamed("doc_id", "_d").join(norms, F.col("_d").eqNullSafe(F.col("doc_id")))
    return LexicalIndex(vocab, unit.select("doc_id", "term", (F.col("w") / F.col("norm")).alias("weight")), size, lists, norms)


def _hot_terms(vocab: DataFrame) -> DataFrame:
    """Terms whose postings should be cut; df is already known, so no extra count."""
    return vocab.filter(F.col("df") > ROWS_PER_SPLIT).select(
        "term", F.ceil(F.col("df") / ROWS_PER_SPLIT).cast("bigint").alias("_fan")
    )


def fit(docs: DataFrame, id_col: str, text_col: str, min_df: int = MIN_DF, max_df: float = MAX_DF) -> LexicalIndex:
    """R01. Vocabulary and unit-length postings, with nothing held on the driver.

    Texts are tokenized once: the lists are written and the vocabulary, the norms and the
    postings read them.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    lists = cut_lineage(posting_lists(docs, size, id_col, text_col, min_df, max_df))
    return index_of(lists, cut_lineage(vocabulary_of(lists)), cut_lineage(norms_of(lists)), size)


def query_vectors(queries: DataFrame, id_col: str, text_col: str, vocab: DataFrame) -> DataFrame:
    """R02. (query_id, term, q_weight); a query without known terms has no rows."""
    counts = term_counts(queries, id_col, text_col, "query_id")
    weighted = counts.join(vocab, "term").select(
        "query_id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w")
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("query_id")))
    return weighted.select("query_id", "term", (F.col("w") / norm).alias("q_weight"))


def _dealt(rows: DataFrame, read, blocks: int, names: list[str], out: str) -> DataFrame:
    """Rows of documents as one row of arrays per block (and ``_c``) and portion, made where they are read.

    ``read`` turns a batch into parts, each of them arrays by name: ``docs``, ``values`` and what else is in ``names``.
    """

    def deal(parts):
        held = {n: pa.concat_arrays([p[n] for p in parts]) for n in parts[0]}
        r = (_hashed(held["docs"]) % np.uint64(blocks)).astype("int64")
        c = held["_c"].to_numpy().astype("int64") if "_c" in held else np.zeros(len(r), "int64")
        place = r * (int(c.max()) + 1) + c
        order = np.argsort(place, kind="stable")
        starts = np.flatnonzero(np.diff(place[order], prepend=-1))
        cuts, at = pa.array(np.append(starts, len(order)).astype("int32")), pa.array(order)
        made = {"_r": pa.array(r[order][starts].astype("int32"))}
        for n in names:
            made[n] = pa.array(c[order][starts].astype("int32")) if n == "_c" else pa.ListArray.from_arrays(cuts, held[n].take(at))
        return pa.RecordBatch.from_pydict(made)

    def run(batches):
        parts, n = [], 0
        for part in itertools.chain.from_iterable(map(read, batches)):
            if len(part["docs"]):
                parts.append(part)
                n += len(part["docs"])
            if n >= DEALT_AT_ONCE:
                yield deal(parts)
                parts, n = [], 0
        if parts:
            yield deal(parts)

    return rows.mapInArrow(run, out)


def _rounded(score: np.ndarray, digits: int = 8) -> np.ndarray:
    """Spark's ``round(score, digits)``: what lies next to the middle of two steps is rounded as the decimal it prints."""
    out = np.round(score, digits)
    scaled = np.abs(score) * 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        out[i] = float(Decimal(repr(float(score[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _places(docs: pa.Array) -> np.ndarray:
    """The place of every distinct value in their order, null first."""
    place = np.empty(len(docs), "int64")
    place[pc.array_sort_indices(docs).to_numpy()] = np.arange(len(docs))
    place[~docs.is_valid().to_numpy(zero_copy_only=False)] = -1
    return place


def _lists(queries: pa.Array, docs: pa.Array, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(query_id, docs, scores) of (query, documents, scores), all numbers of values; without empty lists."""
    found = [f for f in found if len(f[1])]
    cuts = pa.array(np.cumsum([0, *(len(d) for _, d, _ in found)]).astype("int32"))
    which = np.concatenate([d for _, d, _ in found]) if found else np.empty(0, "int64")
    score = np.concatenate([s for _, _, s in found]) if found else np.empty(0)
    asked = queries.take(pa.array([w for w, _, _ in found], pa.int64()))
    return pa.RecordBatch.from_arrays([asked, pa.ListArray.from_arrays(cuts, docs.take(pa.array(which))), pa.ListArray.from_arrays(cuts, pa.array(score))], ["query_id", "docs", "scores"])


def _block_scores(rows: pa.Table, asks: pa.Table, k: int | None, normed: bool, chosen: bool) -> pa.Table:
    """Score lists of one block of documents for one block of queries; see `score_lists`."""
    kind = rows["kind"].to_numpy()

    def parts(name):
        return [rows.filter(pa.array(kind == x))[name].combine_chunks().flatten() for x in range(3)]

    held, numbers = parts("docs"), [v.to_numpy() for v in parts("values")]
    docs = pa.concat_arrays(held).dictionary_encode("encode")
    queries = asks["query_id"].combine_chunks().dictionary_encode("encode")
    n, q = len(docs.dictionary), len(queries.dictionary)
    posted, measured, paired = np.split(docs.indices.to_numpy(), np.cumsum([len(h) for h in held])[:2])

    def summed(term, place, weight, places):
        """(term, place, weight) in this order, rows of one term and place added up."""
        key = term * places + place
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        return key[starts] // places, key[starts] % places, np.add.reduceat(weight[order], starts) if len(starts) else weight[:0]

    term, doc, weight = summed(parts("ts")[0].to_numpy(), posted, numbers[0], n)
    asked, who, q_weight = summed(asks["term"].to_numpy(), queries.indices.to_numpy().astype("int64"), asks["q_weight"].to_numpy(), q)
    scored = np.zeros((q, n))
    low, high = np.searchsorted(term, asked), np.searchsorted(term, asked, "right")
    for i, j, w, x in zip(low, high, who, q_weight):
        if i < j:
            scored[w, doc[i:j]] += x * weight[i:j]
    if normed:
        norm = np.ones(n)
        norm[measured] = numbers[1]
        scored /= norm
    if chosen:
        allowed = np.zeros(q * n)
        wanted = pc.index_in(parts("queries")[2], value_set=queries.dictionary)
        known = wanted.is_valid().to_numpy(zero_copy_only=False)
        # A pair may come several times, as its document or its filters do.
        np.add.at(allowed, wanted.drop_null().to_numpy().astype("int64") * n + paired[known], numbers[2][known])
        scored *= allowed.reshape(q, n)
    place = _places(docs.dictionary)
    found = []
    for w in range(q):
        d = np.flatnonzero(scored[w] > 0)
        found.append((w, d := d[np.lexsort((place[d], -_rounded(scored[w, d])))[:k]], scored[w, d]))
    return pa.Table.from_batches([_lists(queries.dictionary, docs.dictionary, found)])


def score_lists(
    index: LexicalIndex,
    qvec: DataFrame,
    attributes: DataFrame | None = None,
    eligible: Column | None = None,
    filters: DataFrame | None = None,
    k: int | None = None,
) -> DataFrame:
    """R03 / J09. Positive cosines: (query_id, docs, scores), a row per query and block of documents, best first.

    Postings meet the query terms only.  Those of a block of documents go to one place,
    where the queries that ask for them, in blocks too, are added up as arrays; with ``k`` the list of a block
    ends after its k best.  Postings, norms and pairs travel as arrays, one row per block and portion of a task.
    With ``attributes`` (doc_id and columns), only pairs that satisfy ``eligible``
    are scored, which leaves the scores of the others unchanged; ``eligible`` may also
    read the columns of ``filters`` (query_id and columns), if not given those that ``qvec`` carries.
    """
    qvec = cut_lineage(qvec)
    spark = qvec.sparkSession
    terms = cut_lineage(qvec.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    asks = qvec.join(terms, "term").select("query_id", "t", "q_weight")
    n, q = index.corpus_size.first()["n_docs"], qvec.select("query_id").distinct().count()
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / DOCS_PER_BLOCK), min(cores, math.ceil(n / 500)))
    cols = max(1, math.ceil(q / QUERIES_PER_BLOCK))
    doc_kind, query_kind = (t.simpleString() for t in (index.postings.schema["doc_id"].dataType, qvec.schema["query_id"].dataType))
    column = F.pmod(F.xxhash64("query_id"), F.lit(cols)).cast("int").alias("_c")

    # kind 0: postings, 1: norms of documents, 2: how often pairs are eligible.
    arrays = {"docs": f"array<{doc_kind}>", "ts": "array<bigint>", "queries": f"array<{query_kind}>", "values": "array<double>"}

    def sent(kind: int, rows: DataFrame, read, *names: str) -> DataFrame:
        fields = ", ".join(f"{c} {'int' if c == '_c' else arrays[c]}" for c in names)
        packs = _dealt(rows, read, blocks, [*names], f"_r int, {fields}")
        everywhere = F.col("_c") if "_c" in names else F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("_c")
        missing = [(F.col(c) if c in names else F.array().cast(kind_of)).alias(c) for c, kind_of in arrays.items()]
        return packs.select("_r", everywhere, F.lit(kind).alias("kind"), *missing)

    def of_lists(batch):
        # A batch may hold more postings than are dealt at once, its rows are long lists.
        ends, start = np.cumsum(pc.list_value_length(batch.column("docs")).to_numpy()), 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + DEALT_AT_ONCE, "right")))
            part, start = batch.slice(start, stop - start), stop
            own = pc.list_parent_indices(part.column("docs")).to_numpy()
            w = (1 + np.log(part.column("tfs").flatten().to_numpy())) * part.column("idf").to_numpy()[own]
            yield {"docs": part.column("docs").flatten(), "ts": part.column("t").take(pa.array(own)), "values": pa.array(w)}

    def of_rows(*names):
        return lambda batch: [dict(zip(names, batch.columns))]

    if index.lists is None:
        asked = index.postings.join(terms, "term").select("doc_id", "t", F.col("weight").cast("double"))
        rows = sent(0, asked, of_rows("docs", "ts", "values"), "docs", "ts", "values")
    else:
        rows = sent(0, index.lists.join(terms, "term").select("t", "idf", "docs", "tfs"), of_lists, "docs", "ts", "values")
        rows = rows.unionByName(sent(1, index.norms.select("doc_id", "norm"), of_rows("docs", "values"), "docs", "values"))
    if attributes is not None:
        filters = cut_lineage(qvec.drop("term", "q_weight").distinct() if filters is None else filters)
        # Equal rows of a document collapse before they meet the queries; the pairs, far more, are packed where they are made.
        # Few bytes become many pairs, so the number of tasks follows the documents, not their size.
        spread = attributes.filter("doc_id is not null").repartition(max(cores, blocks), "doc_id")
        often = spread.groupBy(*attributes.columns).agg(F.count(F.lit(1)).cast("double").alias("value"))
        met = often.crossJoin(filters.filter("query_id is not null")).filter(eligible)
        pairs = met.select(F.col("doc_id").cast(doc_kind), F.col("query_id").cast(query_kind).alias("query_id"), "value", column)
        rows = rows.unionByName(sent(2, pairs, of_rows("docs", "queries", "values", "_c"), "_c", "docs", "queries", "values"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_r")
    asks = asks.select(column, "query_id", F.col("t").alias("term"), "q_weight", everywhere)
    normed, chosen = index.lists is not None, attributes is not None

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_scores(left, right, k, normed, chosen)

    out = f"query_id {query_kind}, docs array<{doc_kind}>, scores array<double>"
    return rows.groupBy("_r", "_c").cogroup(asks.groupBy("_r", "_c")).applyInArrow(cell, out)


def first_of(lists: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of score lists, of each its k best."""
    docs, found = (F.col(c) if k is None else F.slice(c, 1, k) for c in ("docs", "scores"))
    return lists.select("query_id", F.inline(F.arrays_zip(docs.alias("d"), found.alias("s"))).alias("doc_id", "score"))


def scores(
    index: LexicalIndex,
    qvec: DataFrame,
    attributes: DataFrame | None = None,
    eligible: Column | None = None,
    filters: DataFrame | None = None,
    k: int | None = None,
) -> DataFrame:
    """R03 / J09. Positive cosine per (query_id, doc_id), as `score_lists` has them; with ``k`` at least the k best of every query."""
    return first_of(score_lists(index, qvec, attributes, eligible, filters, k))


def listed_scores(scored: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) as score lists, made where the rows are read."""

    def run(batches):
        for batch in batches:
            queries, docs = (batch.column(c).dictionary_encode("encode") for c in ("query_id", "doc_id"))
            score = batch.column("score").cast(pa.float64()).to_numpy(zero_copy_only=False)
            who, at = queries.indices.to_numpy(), docs.indices.to_numpy()
            order = np.lexsort((_places(docs.dictionary)[at], -_rounded(score), who))
            starts = np.flatnonzero(np.diff(who[order], prepend=-1))
            yield _lists(queries.dictionary, docs.dictionary, [(who[o[0]], at[o], score[o]) for o in np.split(order, starts[1:]) if len(o)])

    kinds = {c: scored.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")}
    rows = scored.select("query_id", "doc_id", "score")
    return rows.mapInArrow(run, f"query_id {kinds['query_id']}, docs array<{kinds['doc_id']}>, scores array<double>")


def rank(scored: DataFrame, by: str = "query_id", score: str = "score", tie: str = "doc_id", digits: int = 8) -> DataFrame:
    """W01. 1-based rank by (rounded score desc, id asc)."""
    order = W.partitionBy(by).orderBy(F.desc(F.round(score, digits)), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order))


def top_k(scored: DataFrame, k: int, **how) -> DataFrame:
    """W02 / K02. Spark prunes to k rows per query before the shuffle."""
    return rank(scored, **how).filter(F.col("rank") <= k)


def _picked(docs: pa.Array, wanted: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.is_in(docs, value_set=wanted.drop_null()).to_numpy(zero_copy_only=False))


def _counted(docs: pa.Array, score: np.ndarray, steps: np.ndarray, mark_docs: pa.Array, raw: np.ndarray, digits: int = 8) -> np.ndarray:
    """How many of a list lie at each place between the marks, in the order (-round(score), document, score)."""
    step = np.where(np.isnan(score), -np.inf, -_rounded(score, digits))
    place, last = np.searchsorted(steps, step), np.searchsorted(steps, step, "right")
    tied = np.flatnonzero(place < last)
    if len(tied):
        those, after = docs.take(pa.array(tied)), np.zeros(len(tied), "int64")
        for i in np.unique(np.concatenate([np.arange(a, b) for a, b in set(zip(place[tied].tolist(), last[tied].tolist()))])):
            later = pc.fill_null(pc.greater(those, mark_docs[i]), False).to_numpy(zero_copy_only=False)
            equal = pc.fill_null(pc.equal(those, mark_docs[i]), False).to_numpy(zero_copy_only=False)
            after += (step[tied] == steps[i]) & (later | (equal & (score[tied] > raw[i])))
        place[tied] += after
    return np.bincount(place, minlength=len(steps) + 1)


def ranks_of(scored: DataFrame, wanted: DataFrame, digits: int = 8) -> DataFrame:
    """Exact ranks of a few documents per query, without ranking the whole list.

    ``wanted`` (query_id, doc_id) is small per query; ``scored`` are rows or `score_lists`, whose arrays
    meet the wanted ones twice: once to find their scores, once to count, by
    array, how many lie at each place between them.  The running count is the rank.
    Neither a row nor a group grows with the number of matches.
    """
    lists = scored if "docs" in scored.columns else listed_scores(scored.withColumn("score", F.col("score").cast("double")))
    query_kind, doc_kind = (lists.schema["query_id"].dataType.simpleString(), lists.schema["docs"].dataType.elementType.simpleString())
    asked = wanted.select("query_id", F.col("doc_id").cast(doc_kind).alias("doc_id")).groupBy("query_id").agg(F.collect_list("doc_id").alias("_wanted"))

    def find(batches):
        for batch in batches:
            for i in range(len(batch)):
                docs, found, want = (batch.column(c)[i].values for c in ("docs", "scores", "_wanted"))
                at = pa.array(_picked(docs, want))
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("query_id")[i], len(at)), docs.take(at), found.take(at)], ["query_id", "d", "raw"])

    picked = lists.join(asked, "query_id").select("query_id", "docs", "scores", "_wanted").mapInArrow(find, f"query_id {query_kind}, d {doc_kind}, raw double")
    key = F.struct((-F.round("raw", digits)).alias("s"), "d", "raw")
    # Written first, so that their true size decides how they meet all lists.
    marks = cut_lineage(picked.groupBy("query_id").agg(F.sort_array(F.collect_set(key)).alias("_marks")))
    split = marks.select("query_id", *[F.col(f"_marks.{n}").alias(f"_{n}") for n in ("s", "d", "raw")])

    def count(batches):
        for batch in batches:
            out = []
            for i in range(len(batch)):
                docs, found, s, d, raw = (batch.column(c)[i].values for c in ("docs", "scores", "_s", "_d", "_raw"))
                n = _counted(docs, found.to_numpy(zero_copy_only=False), s.to_numpy(zero_copy_only=False), d, raw.to_numpy(zero_copy_only=False), digits)
                at = np.flatnonzero(n)
                out.append(pa.RecordBatch.from_arrays([pa.repeat(batch.column("query_id")[i], len(at)), pa.array(at.astype("int32")), pa.array(n[at])], ["query_id", "place", "n"]))
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else []

    placed = lists.join(split, "query_id").select("query_id", "docs", "scores", "_s", "_d", "_raw").mapInArrow(count, f"query_id {query_kind}, place int, n bigint")
    counts = placed.groupBy("query_id", "place").agg(F.sum("n").alias("n"))
    upto = W.partitionBy("query_id").orderBy("place")
    ranks = counts.withColumn("rank", F.sum("n").over(upto))
    found = marks.select("query_id", F.posexplode("_marks").alias("place", "m"))
    return found.join(ranks, ["query_id", "place"]).select(
        "query_id", F.col("m.d").alias("doc_id"), "rank", F.col("m.raw").alias("score")
    )


def search(docs: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str, k: int = 5) -> DataFrame:
    """R03. Lexical top-K of every query."""
    index = fit(docs, doc_id, doc_text)
    qvec = query_vectors(queries, query_id, query_text, index.vocab)
    return top_k(scores(index, qvec, k=k), k)


def statistics(index: LexicalIndex) -> DataFrame:
    """A25. Documents, vocabulary, non-zeros and sparsity, from the vocabulary alone."""
    sizes = index.vocab.agg(
        F.count(F.lit(1)).alias("vocabulary"), F.coalesce(F.sum("df"), F.lit(0)).alias("non_zeros")
    )
    out = index.corpus_size.join(F.broadcast(sizes))
    cells = F.col("n_docs") * F.col("vocabulary")
    return out.withColumn(
        "sparsity", F.round(1 - F.col("non_zeros") / F.nullif(cells, F.lit(0)), 6)
    )


def scenario_report(index: LexicalIndex, queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """R04. Hits and best match per query on a stored index, queries without a hit included."""
    top = top_k(scores(index, query_vectors(queries, query_id, query_text, index.vocab), k=5), 5)
    agg = top.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.max("score").alias("best_score"),
        F.min_by("doc_id", "rank").alias("best_doc"),
    )
    ids = queries.select(F.col(query_id).alias("query_id"))
    return ids.join(agg, "query_id", "left").fillna(0, ["hits"])
