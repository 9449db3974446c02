"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask of five cared token positions; the positions between are
ignored.  The three masks below were checked over all choices of substituted
positions: any 8 to 19 consecutive tokens of which at most a fifth are substituted
hold one mask without a substitution.  Longer windows split into such blocks, one of
which has at most its share of substitutions, so no window of 8 or more tokens with
0.8 of its tokens in place is missed.

Seed hashes of benchmark and training tokens are matched; around each hit the texts
are laid over each other and the longest window with enough equal tokens decides.

The benchmark side is cut into blocks of a bounded number of tokens.  Each block is
broadcast and meets every document where it lies: no text is shuffled, a passage that
a third of all documents share costs what others cost.  More benchmarks mean more
blocks, each with its own pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm.registry import query, read

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
SHARE = 0.8
# Window that counts as a leak; shorter items must be there as a whole.
MIN_TOKENS = 13
# Below this many tokens an item has to match without any substitution.
EXACT_BELOW = 8
# Benchmark tokens in one broadcast block.
BLOCK_TOKENS = 2_000_000
# Training tokens hashed at once in a task.
CHUNK_TOKENS = 400_000
# Seed hits held before they are collapsed to alignments.
HITS = 500_000

_WORD = re.compile(r"\w+")
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, 8, dtype=np.uint64) * 2 + 1


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def masks_for(n: int) -> list[tuple[int, ...]]:
    """Masks that fit n tokens; fewer than five tokens are one seed of their own."""
    return [m for m in MASKS if m[-1] < n] or [tuple(range(n))]


GAP = max(m[-1] for m in MASKS) + 1


@dataclass
class SeedIndex:
    """Seeds of a block of benchmark items, as arrays that travel to the tasks."""

    vocabulary: dict[str, int]
    keys: pa.Array  # benchmark ids
    starts: np.ndarray  # where each item's tokens start in ``words``
    words: np.ndarray
    seeds: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray, np.ndarray]]  # hashes, item, place
    filters: dict[tuple[int, ...], np.ndarray]


def seed_hash(words: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    h = np.full(len(at), np.uint64(len(mask)))
    for i, off in enumerate(mask):
        h = (h ^ words[at + off].astype(np.uint64)) * _MULTIPLIERS[i]
        h ^= h >> np.uint64(29)
    return h


def build_index(keys: pa.Array, texts: list[str | None]) -> SeedIndex:
    vocabulary: dict[str, int] = {}
    lists = [[vocabulary.setdefault(t, len(vocabulary) + 1) for t in tokens(text)] for text in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = np.array([w for x in lists for w in x], np.int64)
    found: dict[tuple[int, ...], list[tuple[np.ndarray, np.ndarray]]] = {}
    for i, n in enumerate(sizes.tolist()):
        for mask in masks_for(n) if n else ():
            places = np.arange(n - mask[-1])
            found.setdefault(mask, []).append((np.full(len(places), i), places))
    seeds, filters = {}, {}
    for mask, parts in found.items():
        item = np.concatenate([p[0] for p in parts])
        place = np.concatenate([p[1] for p in parts])
        h = seed_hash(words, starts[item] + place, mask)
        order = np.argsort(h, kind="stable")
        seeds[mask] = (h[order], item[order], place[order])
        bits = max(16, int(8 * len(h)).bit_length())
        table = np.zeros(1 << bits, bool)
        table[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
        filters[mask] = table
    return SeedIndex(vocabulary, keys, starts, words, seeds, filters)


def best_window(equal: np.ndarray, share: float, least: int) -> tuple[int, int] | None:
    """Longest [start, stop) with at least ``share`` equal and ``least`` tokens; first of ties."""
    run = np.concatenate([[0.0], np.cumsum(equal - share)])
    floor = np.minimum.accumulate(run)  # falls: the first place at or below a level is found by bisection
    first = np.searchsorted(-floor, -(run + 1e-9))
    size = np.arange(len(run)) - first
    stop = int(size.argmax())
    return (int(first[stop]), stop) if size[stop] >= least else None


def _alignments(index: SeedIndex, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sorted numbers of all different (document, item, shift) with a seed in common.

    Text that repeats itself meets an item at every pair of places, but on few shifts: hits
    are collapsed to shifts whenever HITS of them are there, so they never take more.
    """
    known = words > 0
    items, span = len(index.starts) - 1, len(words) + int(np.diff(index.starts).max(initial=0)) + 1
    distinct, waiting, held = np.empty(0, np.int64), [], 0
    for mask, (hashes, item, place) in index.seeds.items():
        n = len(words) - mask[-1]
        if n <= 0:
            continue
        ok = known[:n].copy()
        for off in mask[1:]:
            ok &= known[off : off + n]
        places = np.flatnonzero(ok)
        h = seed_hash(words, places, mask)
        table = index.filters[mask]
        bits = len(table).bit_length() - 1
        maybe = table[(h >> np.uint64(64 - bits)).astype(np.int64)]
        places, h = places[maybe], h[maybe]
        lows = np.searchsorted(hashes, h, "left")
        counts = np.searchsorted(hashes, h, "right") - lows
        # Parts of places with about HITS hits; a place has no more hits than the seed has in the items.
        cuts = np.flatnonzero(np.diff((np.cumsum(counts) // HITS), prepend=0))
        for at, low, many in zip(*(np.split(x, cuts) for x in (places, lows, counts))):
            total = int(many.sum())
            if not total:
                continue
            slot = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            at = np.repeat(at, many)
            doc = np.searchsorted(bounds, at, "right") - 1
            number = (doc * items + item[slot]) * (2 * span) + (at - place[slot] + span)
            waiting.append(np.unique(number))
            held += len(waiting[-1])
            if held > HITS:
                distinct = np.unique(np.concatenate([distinct, *waiting]))
                waiting, held = [], 0
    return np.unique(np.concatenate([distinct, *waiting]))


def _leaks(index: SeedIndex, words: np.ndarray, bounds: np.ndarray, share: float, min_tokens: int):
    """Yield (document, item, start, size, equal) of the documents in ``words``[bounds[i]:bounds[i + 1]].

    The alignments of a document and an item are compared in order of their equal tokens.
    A window has no more of these than its alignment, so once a window is found, only
    alignments that may hold more, or as many and earlier, are looked at.
    """
    numbers = _alignments(index, words, bounds)
    items, span = len(index.starts) - 1, len(words) + int(np.diff(index.starts).max(initial=0)) + 1
    pair, shift = numbers // (2 * span), numbers % (2 * span) - span
    for stop, start in zip(*_runs(pair)):
        doc, i = divmod(int(pair[start]), items)
        shifts = shift[start:stop]
        a, b = int(index.starts[i]), int(index.starts[i + 1])
        first, last = int(bounds[doc]), int(bounds[doc + 1])
        low, high = np.maximum(shifts, first), np.minimum(shifts + b - a, last)
        least = min(min_tokens, b - a)
        equal = _equal_tokens(words, index.words[a:b], shifts, first, last)
        needed = equal >= (share if b - a >= EXACT_BELOW else 1.0) * least - 1e-9
        order = np.lexsort((shifts, -equal))
        order = order[needed[order]]
        best = None
        while len(order):
            k, order = int(order[0]), order[1:]
            same = words[low[k] : high[k]] == index.words[a + low[k] - shifts[k] : a + high[k] - shifts[k]]
            window = best_window(same, share if b - a >= EXACT_BELOW else 1.0, least)
            if window is None:
                continue
            found = (int(same[window[0] : window[1]].sum()), first - int(low[k]) - window[0], window[1] - window[0])
            if best is None or found > best:
                best = found
                order = order[(equal[order] > best[0]) | (equal[order] == best[0]) & (first - low[order] >= best[1])]
        if best is not None:
            yield doc, i, -best[1], best[2], best[0]


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Stops and starts of the runs of equal values."""
    edges = np.flatnonzero(np.diff(values)) + 1
    return [*edges.tolist(), len(values)][: len(values)], [0, *edges.tolist()][: len(values)]


def _equal_tokens(words: np.ndarray, item: np.ndarray, shifts: np.ndarray, first: int, last: int) -> np.ndarray:
    """Equal tokens of an item laid over words[first:last] at each shift."""
    out = np.zeros(len(shifts), np.int64)
    if len(shifts) <= len(item):
        for k, at in enumerate(shifts.tolist()):
            low, high = max(at, first), min(at + len(item), last)
            out[k] = np.count_nonzero(words[low:high] == item[low - at : high - at])
        return out
    for j, token in enumerate(item.tolist()):
        at = shifts + j
        inside = (at >= first) & (at < last)
        out += inside & (words[np.where(inside, at, first)] == token)
    return out


def leaks_in(index: SeedIndex, texts: pa.Array, share: float, min_tokens: int):
    """Yield (row, item, start, size, equal) over a column of texts, a bounded part at a time."""
    number = index.vocabulary.get
    first, lists, n = 0, [], 0
    for i, value in enumerate(texts):
        lists.append([number(t, 0) for t in tokens(value.as_py())])
        n += len(lists[-1])
        if n < CHUNK_TOKENS and i + 1 < len(texts):
            continue
        bounds = np.cumsum([0] + [len(x) + GAP for x in lists])
        words = np.zeros(bounds[-1], np.int64)
        for at, x in zip(bounds, lists):
            words[at : at + len(x)] = x
        for doc, *leak in _leaks(index, words, bounds, share, min_tokens):
            yield first + doc, *leak
        first, lists, n = i + 1, [], 0


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    share: float = SHARE,
    min_tokens: int = MIN_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(doc_id, item_id, start, n_tokens, n_equal, overlap), one row per document row and item found in it.

    Tokens are runs of word characters in lower case.  An item is found where some window of
    at least ``min_tokens`` tokens (or the whole item, if shorter) lies over the
    document with ``share`` of its tokens equal; items of fewer than 8 tokens must match
    exactly.  The row gives the window with most equal tokens: its first token in the
    document, its length and its equal tokens.  Null and empty texts hold no tokens and
    never match; repeated items and repeated documents are each reported.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, start long, n_tokens long, n_equal long, overlap double"

    def report(shared):
        def run(batches):
            for batch in batches:
                keys, index = batch.column(0), shared.value
                found = list(leaks_in(index, batch.column(1), share, min_tokens))
                rows, items, starts, sizes, equal = zip(*found) if found else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(rows, pa.int64())),
                        index.keys.take(pa.array(items, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(equal, pa.int64()),
                        pa.array([e / n for e, n in zip(equal, sizes)], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "start", "n_tokens", "n_equal", "overlap"],
                )

        return run

    found = None
    for shared in _blocks(benchmark, item_id, item_text, block_tokens):
        part = slim.mapInArrow(report(shared), schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    share: float = SHARE,
    min_tokens: int = MIN_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """``docs`` without the rows in which `find_leaks` finds an item, all columns kept.

    Each row is judged where it lies, by its own text: nulls in other columns, repeated ids
    and repeated rows make no difference.
    """
    place = docs.columns.index(text)

    def clean(shared):
        def run(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in leaks_in(shared.value, batch.column(place), share, min_tokens):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        return run

    for shared in _blocks(benchmark, item_id, item_text, block_tokens):
        docs = docs.mapInArrow(clean(shared), docs.schema)
    return docs


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_tokens: int):
    """Broadcast seed indexes of about ``block_tokens`` tokens each, however large the benchmark is."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("item_text"))
    size = items.agg(
        F.coalesce(F.sum(F.length("item_text")), F.lit(0)).alias("chars"), F.count(F.lit(1)).alias("n")
    ).first()
    # A token and the gap after it take two characters at least.
    blocks = max(1, -(-max(size["chars"] // 2, size["n"]) // block_tokens))
    spread = items.withColumn("block", F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)))
    for block in range(blocks):
        rows = spread.filter(F.col("block") == block).select("item_id", "item_text").toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(
            build_index(rows.column(0).combine_chunks(), rows.column(1).to_pylist())
        )


@query("op9_benchmark_leaks")
def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds a passage."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
