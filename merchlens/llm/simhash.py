"""SimHash near-dedup with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to the
23 bits of the perfect Golay code.  Every 23-bit word is within 3 bits of exactly one
codeword.  If it is within 2 bits, all its one-bit neighbours decode to that codeword;
if it is 3 bits away, a neighbour may decode to one of the five codewords 4 bits away.
So the codeword of a segment is always among the (one or six) codewords near any
segment that differs in at most one bit.

Two fingerprints within 3 bits differ by at most one bit in two of the three segments
(two segments with two or more would be four).  Each fingerprint is therefore
stored under the codeword pairs of its segment pairs, and looks up the pairs of
nearby codewords: no link is missed, and each candidate is verified by its bits.

A key has 24 bits and each fingerprint looks up about 84, so with n different fingerprints it
meets about 84 n / 2^24 others by chance: 5 at a million, 500 at a hundred million.
Keys of three of four segments would have 36 bits but 600 lookups each: more rows to shuffle
below some 10^10 fingerprints.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchlens.operators.components import connected_components
from merchlens.llm.registry import query, read
from merchlens.session import cut_lineage

SHINGLE = 3
SEED = 42
MAX_BITS = 3
# (lowest bit, width) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
# Generator of the perfect binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reduced, patterns, count) of the code.

    ``reduced[i]`` is the syndrome of bit i.  For a syndrome s, ``patterns[s]`` are the error
    words that lead to codewords nearby: first the nearest, then, if that is 3 bits
    away, the five words of 4 bits; ``count[s]`` is how many there are.
    """
    reduced = np.zeros(23, np.int64)
    for i in range(23):
        word = 1 << i
        for top in range(i, 10, -1):
            if word >> top & 1:
                word ^= GENERATOR << (top - 11)
        reduced[i] = word
    patterns = np.zeros((2048, 6), np.int64)
    count = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            s = int(np.bitwise_xor.reduce(reduced[list(bits)])) if bits else 0
            if weight < 4 or count[s] and bin(int(patterns[s, 0])).count("1") == 3:
                patterns[s, count[s]] = sum(1 << b for b in bits)
                count[s] += 1
    return reduced, patterns, count


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (n, 6) of the codewords near each 23-bit word, nearest first, and their count."""
    reduced, patterns, count = golay()
    syndrome = np.zeros(len(words), np.int64)
    for i in range(23):
        syndrome ^= (words >> i & 1) * reduced[i]
    return (words[:, None] ^ patterns[syndrome]) >> 11, count[syndrome]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the hashes of all word shingles; no words: 0."""
    return fingerprint_of_words((text or "").encode("utf-8", "surrogatepass").lower().split(), shingle)


def fingerprint_of_words(words: list[bytes], shingle: int = SHINGLE) -> int:
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(sizes) - 1
    starts = (stops - sizes + 1)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops[shingle - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # Sums of 255 rows fit a byte.
    sums = [np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8) for i in range(0, len(bits), 255)]
    total = np.sum(sums, axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row; null text counts as empty."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"]
            )

    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, fp bigint")


PAIRS = tuple(itertools.combinations(range(len(SEGMENTS)), 2))


def _segments(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    unsigned = fps.view(np.uint64)
    out = []
    for low, width in SEGMENTS:
        word = (unsigned >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
        # Padding stands in parity places, so all 12 bits of a codeword index vary.
        out.append(near_codewords(word << (23 - width)))
    return out


def _stored(batches):
    """The key of the nearest codewords for each pair of segments."""
    for batch in batches:
        fps = batch.column(0).to_numpy()
        near = _segments(fps)
        keys = [(k << 24) | (near[i][0][:, 0] << 12) | near[j][0][:, 0] for k, (i, j) in enumerate(PAIRS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys)), pa.array(np.tile(fps, len(PAIRS)))], names=["key", "fp"]
        )


def _sought(batches):
    """Every pair of near codewords: up to 36 keys a pair of segments, 28 on average."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            fps, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
            near = _segments(fps)
            for k, (i, j) in enumerate(PAIRS):
                (a, na), (b, nb) = near[i], near[j]
                keys = (k << 24) | (a[:, :, None] << 12) | b[:, None, :]
                six = np.arange(6)
                real = (six < na[:, None])[:, :, None] & (six < nb[:, None])[:, None, :]
                row, _, _ = np.nonzero(real)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[real]), pa.array(fps[row]), pa.array(labels[row])],
                    names=["key", "fp", "label"],
                )


def _differing(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) that connect the fingerprints ``fp`` exactly as all links within ``max_bits`` do.

    First each stored key links its fingerprints to the least one, where that is
    close enough.  Whatever then shares such a neighbour is connected already, so a
    large group of near copies leaves the lookup few pairs to report; all other pairs
    within the distance are reported.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find pairs within {MAX_BITS} bits, not {max_bits}")
    stored = cut_lineage(distinct.select("fp").mapInArrow(_stored, "key bigint, fp bigint"))
    first = stored.groupBy("key").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").drop("n")
    stars = cut_lineage(
        stored.join(first, "key")
        .filter((F.col("fp") != F.col("first")) & (_differing("fp", "first") <= max_bits))
        .select(F.col("fp").alias("u"), F.col("first").alias("v"))
        .distinct()
    )
    label = stars.groupBy("u").agg(F.min("v").alias("label"))
    # A first one keeps its own name, which is what its neighbours carry.
    labelled = cut_lineage(
        distinct.select("fp")
        .join(label.withColumnRenamed("u", "fp"), "fp", "left")
        .select("fp", F.coalesce("label", "fp").alias("label"))
    )
    named = stored.join(labelled, "fp").select(
        "key", F.col("fp").alias("other"), F.col("label").alias("other_label")
    )
    # Each row becomes about 84, which Spark's estimate from the stored size does not see: never broadcast.
    sought = labelled.mapInArrow(_sought, "key bigint, fp bigint, label bigint").hint("merge")
    met = sought.join(
        named,
        (sought.key == named.key)
        & (F.col("fp") < F.col("other"))
        & (F.col("label") != F.col("other_label"))
        & (_differing("fp", "other") <= max_bits),
    ).select(F.col("fp").alias("u"), F.col("other").alias("v"))
    return stars.unionByName(met)


def near_duplicate_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``.

    ``component_id`` is the least doc_id that links of at most ``max_bits`` differing bits
    reach.  Equal texts, and texts without words (fingerprint 0), are linked like any
    others; copies are collapsed to one fingerprint before anything is compared.  A
    null id stays null and joins its group, whose component is null if all its ids are.
    """
    return linked_groups(cut_lineage(fingerprints(docs, doc_id, text)), max_bits)


def linked_groups(printed: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """`near_duplicate_groups` of stored fingerprints (doc_id, fp)."""
    distinct = cut_lineage(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = cut_lineage(connected_components(links(distinct, max_bits)))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("component", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return printed.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one_per_group(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", groups_of=near_duplicate_groups, prints_of=fingerprints
) -> DataFrame:
    """``docs`` with one row per group of near copies: that of the least id.

    ``groups_of`` and ``prints_of`` say what a near copy is, by default as in op3.  Where rows repeat an id, the one with the least text stays; groups without any id
    keep one row per different text.
    """
    groups = groups_of(docs, doc_id, text)
    key, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(doc_id)).distinct()
    # The window sits on the partitioning of the join: texts are shuffled once.
    stays = docs.filter(key.isNotNull()).join(kept, doc_id, "left_semi")
    first = stays.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(body)))
    # Rows without an id go by their fingerprint: kept where no row of the group has one.
    bare = docs.filter(key.isNull()).dropDuplicates([text])
    if bare.isEmpty():
        return first.filter("__n = 1").drop("__n")
    alone = groups.filter(F.col("component_id").isNull()).select("fp").distinct()
    own = prints_of(bare.select(body.alias("doc_id"), body.alias("text"))).join(alone, "fp", "left_semi")
    same = body.eqNullSafe(F.col("__text"))
    nameless = bare.join(own.select(F.col("doc_id").alias("__text")), same, "left_semi")
    return first.filter("__n = 1").drop("__n").unionByName(nameless)


@query("op3_simhash_groups")
def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = near_duplicate_groups(read(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
