"""Best-fit packing with certified repacking.

Documents are tokenized in place and cut into pieces of at most one sequence.  Pieces
are dealt over partitions of bounded size, and each runs best-fit decreasing.  A
lower bound from dual-feasible functions certifies the partition: if its number of
sequences equals the bound, no packing of these pieces is better and it is final.
Partitions with a gap keep their full sequences and exchange the pieces of the others:
these are dealt anew and packed again, as long as that saves sequences.

Only lengths, places and checksums are shuffled; token ids are never moved.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm.registry import query, read
from merchlens.session import cut_lineage

SEQUENCE = 2048
END_ID = 0
# Added tokens of byte_bpe_50k.json, which `tokenizers` finds inside texts.
SPECIAL = {"<|endoftext|>": 50256}
# Pieces that one task packs together.
PIECES_PER_GROUP = 20_000
ROUNDS = 4


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(vocabulary: str, special: bool = False):
    """Byte-level BPE of a rank file; strings of special tokens in a text are ordinary text unless ``special``."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
        special_tokens=SPECIAL if special else {},
    )


def token_ids(text: str | None, vocabulary: str, special: bool = False) -> np.ndarray:
    allowed = set(SPECIAL) if special else set()
    ids = encoder(vocabulary, special).encode_to_numpy(text or "", allowed_special=allowed, disallowed_special=())
    return np.append(ids, np.uint32(END_ID)).astype("<u4")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but for the first."""
    first = n % size or size
    return [(0, first), *((start, size) for start in range(first, n, size))]


def pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SEQUENCE,
    vocabulary: str | None = None,
    with_ids: bool = False,
    special: bool = False,
) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]), one row per piece.

    Null text counts as empty: one piece holding the end id.  ``row`` numbers the rows
    of the scan, so repeated rows and null ids are separate documents.
    With ``special`` the strings of special tokens become those tokens, as in `tokenizers`.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def tokenize(batches):
        for batch in batches:
            keys, rows = batch.column(0), batch.column(1)
            out: list[list] = [[] for _ in names]
            taken = []
            for i, value in enumerate(batch.column(2)):
                ids = token_ids(value.as_py(), vocabulary, special)
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    part = ids[start : start + length]
                    taken.append(i)
                    for column, x in zip(out[2:], (k, start, length, zlib.crc32(part.tobytes()))):
                        column.append(x)
                    if with_ids:
                        out[6].append(part.astype(np.int32))
            take = pa.array(taken, pa.int64())
            columns = [keys.take(take), rows.take(take), pa.array(out[2], pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in out[3:6]]
            if with_ids:
                columns.append(pa.array(out[6], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    slim = docs.select(F.col(f"`{doc_id}`"), F.monotonically_increasing_id(), F.col(f"`{text}`"))
    schema = f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long"
    return slim.mapInArrow(tokenize, schema + ", ids array<int>" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; every piece goes where it leaves the least room."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]  # open bins by free places
    mask, made = 0, 0  # bit r of the mask: some open bin has r free places
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            free, b = size, made
            made += 1
        bins[i], offsets[i] = b, size - free
        if left := free - length:
            if not room[left]:
                mask |= 1 << left
            room[left].append(b)
    return bins, offsets


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Least number of bins that any packing needs, by dual-feasible functions.

    f is dual feasible if f over any set of lengths that fits one bin sums to at most 1;
    then the sum of f over all lengths bounds the number of bins.  Three families are
    tried, on the histogram of lengths and in integers: the length itself, the
    threshold functions (long pieces count whole, short ones nothing), and the rounding
    functions with k steps.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    total = int((count * x).sum())
    best = -(-total // size)
    # Threshold e: lengths over size - e count as size, from e to size - e as they are.
    n_from = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])  # n_from[v]: lengths >= v
    s_from = np.concatenate([np.cumsum((count * x)[::-1])[::-1], [0]])
    e = np.arange(1, size // 2 + 1)
    whole = n_from[size - e + 1]
    middle = s_from[e] - s_from[size - e + 1]
    best = max(best, int((whole + -(-middle // size)).max()))
    for k in range(1, 33):
        steps = (k + 1) * x
        # In units of 1 / (size * k): x k where (k + 1) x / size is whole, else floor * size.
        value = np.where(steps % size == 0, x * k, (steps // size) * size)
        best = max(best, -(-int((count * value).sum()) // (size * k)))
    return best


PLACED = (
    "row long, piece int, length long, part long, bin long, offset long, fill long, "
    "group_bins long, group_bound long"
)


def _packer(size: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        # An order of its own, so that a task that runs again gives the same sequences.
        rows = rows.sort_values(["length", "row", "piece"], ascending=[False, True, True])
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, size)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        return rows.assign(
            bin=bins,
            offset=offsets,
            fill=fill[bins],
            group_bins=len(fill),
            group_bound=lower_bound(lengths, size),
        )

    return pack


def pack(
    cut_pieces: DataFrame,
    size: int = SEQUENCE,
    per_group: int = PIECES_PER_GROUP,
    rounds: int = ROUNDS,
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: places without gap or overlap.

    ``cut_pieces`` (see `pieces`) is read several times: give it as a stored table.  At most
    ``rounds`` exchanges follow the first packing; they end earlier once every
    partition is certified or an exchange saves nothing.  No pieces give no rows.
    """

    def deal(rows: DataFrame, r: int) -> DataFrame:
        n = rows.count()
        parts = max(1, -(-n // per_group))
        dealt = rows.select("row", "piece", "length").withColumn(
            "part", F.pmod(F.xxhash64("row", "piece", F.lit(r)), F.lit(parts))
        )
        packed = dealt.groupBy("part").applyInPandas(_packer(size), PLACED)
        return cut_lineage(packed.withColumn("round", F.lit(r)))

    now, done = deal(cut_pieces, 0), []
    loose = (F.col("group_bins") > F.col("group_bound")) & (F.col("fill") < size)
    for r in range(1, rounds + 1):
        pool = now.filter(loose)
        before = pool.filter("offset = 0").count()
        if not before:
            break
        again = deal(pool, r)
        if again.filter("offset = 0").count() >= before:
            break
        done.append(now.filter(~loose))
        now = again
    placed = now
    for part in done:
        placed = placed.unionByName(part)
    # 3 bits of round, 29 of partition, 24 of bin: unique over all rounds.
    number = F.expr("shiftleft(cast(round as bigint), 53) + shiftleft(part, 24) + bin")
    places = placed.select("row", "piece", number.alias("sequence_id"), "offset")
    return cut_pieces.join(places, ["row", "piece"])


def certificate(packed: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """One row (sequences, bound, fill): what was used and what length alone requires."""
    return packed.agg(
        F.count_if(F.col("offset") == 0).alias("sequences"),
        F.ceil(F.sum("length") / size).alias("bound"),
        (F.sum("length") / (F.count_if(F.col("offset") == 0) * size)).alias("fill"),
    )


def sequences(packed_with_ids: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): the token sequences themselves, at most ``size`` ids each."""
    part = F.struct("offset", "doc_id", "ids")
    rows = packed_with_ids.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select(
        "sequence_id",
        F.flatten(F.col("parts.ids")).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("starts"),
    )


def pack_documents(docs: DataFrame, special: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every document's pieces."""
    return pack(cut_lineage(pieces(docs, special=special))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"), special=True)
