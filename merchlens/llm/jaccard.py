"""Near copies by fingerprints, then by exact Jaccard similarity of word shingles.

Texts whose fingerprints link (`simhash`) are near copies; the rest of this file finds those
that fingerprints miss.
Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of
at least 0.8.  Fingerprints of 64 bits differ by about 10 bits there, and by up to 18,
beyond what Golay keys of three segments can reach.  So candidates meet under MinHash keys
instead: BANDS keys of ROWS minima each.  A pair of similarity s shares no key with
probability (1 - s^ROWS)^BANDS, which is 3.2e-6 at 0.8 and less above.  Every candidate is
verified on its whole shingle sets.

A key that many texts share is not compared in all pairs.  Members first meet one, then a
few members of the key's largest group, which joins most near copies.  For those still apart
only differences count: with a pivot P of the key, each member x is its delta, the shingles
in which it differs from P.  Two deltas differ exactly where their texts do, so similar
texts either share rare elements of their deltas or are both similar to P (`_meetings`).
Texts on one template that are just not similar enough share none and never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchlens.llm import simhash
from merchlens.operators.components import connected_components
from merchlens.operators.skew import hot_keys, salted_join
from merchlens.session import cut_lineage

SHINGLE = 5
# Least similarity, as a numerator and a denominator.
SIMILARITY = (4, 5)
SEED = 42
BANDS, ROWS = 24, 4
# Members of a key's largest group that each of its strays meets, round by round; whatever
# is still apart then meets by rare elements of its deltas.
ROUNDS = (1, 8)
# Members of a key whose deltas say which elements are rare there.  This orders the elements
# and thereby decides how many texts meet, not which links are found.
WITNESSES = 48
# Rows of a key, and members of a pivot, that one task handles.
ROWS_PER_TASK = 20_000
MEMBERS_PER_TASK = 2_000

_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _name(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of all runs of ``size`` words; a shorter text is one run."""
    digest = xxhash.xxh64_intdigest
    runs = range(max(1, len(words) - size + 1))
    return np.unique(np.array([digest(b" ".join(words[i : i + size]), SEED) for i in runs], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """Keys under which a set of shingles meets others."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 1000):
        part = hashes[start : start + 1000]
        least = np.minimum(least, (FACTORS[:, None] * part + TERMS[:, None]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)]


def names(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row: a hash of its lower-cased words; null text counts as empty."""
    return _named(docs, doc_id, text, False).select("doc_id", "fp")


def _named(docs: DataFrame, doc_id: str, text: str, keyed: bool) -> DataFrame:
    """(doc_id, fp, print, keys) of every row, read once; without ``keyed`` no prints (null) nor keys."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def one(value):
        words = _words(value.as_py())
        if not keyed:
            return _name(words), 0, []
        return _name(words), simhash.fingerprint_of_words(words), band_keys(shingles(words))

    def run(batches):
        for batch in batches:
            # Text by text: the words of a whole batch would take ten times its size.
            fps, prints, keys = np.empty(batch.num_rows, np.uint64), np.empty(batch.num_rows, np.uint64), []
            for i, value in enumerate(batch.column(1)):
                fps[i], prints[i], own = one(value)
                keys.append(np.array(own, np.uint64).view(np.int64))
            print_of = pa.array(prints.view(np.int64)) if keyed else pa.nulls(len(prints), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps.view(np.int64)), print_of, pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "fp", "print", "keys"],
            )

    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, fp bigint, print bigint, keys array<bigint>")


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """(fp, text) of every row."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((_name(_words(x.as_py())) for x in batch.column(0)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), batch.column(0)], names=["fp", "text"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "fp bigint, text string")


# Bytes of shingle sets that leave a task at once.
SET_BYTES = 4 << 20


def _sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(fp, hashes binary): the shingle sets of the texts in ``wanted`` (fp)."""

    def hashed(batches):
        for batch in batches:
            sets, start, held = [], 0, 0
            for i, value in enumerate(batch.column(1), 1):
                sets.append(shingles(_words(value.as_py())).tobytes())
                held += len(sets[-1])
                if held > SET_BYTES or i == batch.num_rows:
                    columns = [batch.column(0).slice(start, len(sets)), pa.array(sets, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["fp", "hashes"])
                    sets, start, held = [], i, 0

    return _texts(docs, text).join(wanted, "fp", "left_semi").dropDuplicates(["fp"]).mapInArrow(hashed, "fp bigint, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    top, bottom = SIMILARITY

    def similar(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                # Sizes alone rule out most pairs of different lengths.
                if bottom * min(len(x), len(y)) < top * max(len(x), len(y)):
                    keep.append(False)
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bottom * shared >= top * (len(x) + len(y) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    u, v = (sets.select(F.col("fp").alias(c), F.col("hashes").alias(f"h{c}")) for c in "uv")
    return pairs.join(u, "u").join(v, "v").select("u", "v", "hu", "hv").mapInArrow(similar, "u bigint, v bigint")


def _hot(rows: DataFrame) -> DataFrame:
    """Keys with more rows than one task should hold; stored, for there are few."""
    return cut_lineage(hot_keys(rows, "key", ROWS_PER_TASK))


def _labelled(keyed: DataFrame, links: DataFrame | None, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, fp, label) of the keys that join different groups; of these, the rows outside the largest group."""
    if links is None:
        tagged = keyed.withColumn("label", F.col("fp"))
    else:
        found = cut_lineage(connected_components(links)).select(F.col("node").alias("fp"), "component")
        tagged = keyed.join(found, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("label"))
    tagged = cut_lineage(tagged)
    sizes = tagged.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("label").alias("label")))["label"].alias("main"),
        F.count(F.lit(1)).alias("groups"),
    )
    mixed = cut_lineage(salted_join(tagged, main.filter("groups > 1").drop("groups"), "key", hot, "fp"))
    return mixed, mixed.filter("label <> main")


def _as_pairs(met: DataFrame) -> DataFrame:
    return cut_lineage(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def _to_largest(mixed: DataFrame, strays: DataFrame, most: int, hot: DataFrame) -> DataFrame:
    """Pairs (u, v) of each stray with at most ``most`` members of its key's largest group."""
    nearest = F.row_number().over(Window.partitionBy("key").orderBy("fp"))
    largest = mixed.filter("label = main").withColumn("n", nearest).filter(F.col("n") <= most)
    others = largest.select("key", F.col("fp").alias("v"), "label")
    own = strays.select("key", F.col("fp").alias("u"), F.col("label").alias("own"))
    return _as_pairs(salted_join(own, others, "key", hot, "u").filter("own <> label"))


POSTING = "pivot bigint, element bigint, fp bigint, label bigint, size bigint, delta bigint, pos bigint, short boolean"


def _members(batches) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    for batch in batches:
        plain = [batch.column(i).to_pylist() for i in range(4)]
        for row, hashes in zip(zip(*plain), batch.column(4)):
            yield *row, np.frombuffer(hashes.as_py(), np.uint64)


def _rare_elements(batches):
    """Postings of the members of each pivot, which arrive behind the pivot and its witnesses.

    A member that is similar to the pivot gives one posting without an element.
    """
    top, bottom = SIMILARITY
    pivot, base, seen = None, np.empty(0, np.uint64), []
    known, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    out, held = [], 0
    for of, turn, fp, label, own in _members(batches):
        if turn >= 0:  # the pivot, then its witnesses, in order
            if turn == 0:
                pivot, base, seen = of, own, []
            else:
                seen.append(np.setxor1d(base, own, assume_unique=True))
            continue
        if of != pivot:
            raise ValueError("members must follow their pivot")
        if seen:
            known, counts = np.unique(np.concatenate(seen), return_counts=True)
            seen = []
        delta = np.setxor1d(base, own, assume_unique=True)
        if not len(delta):
            continue
        frequency = np.zeros(len(delta), np.int64)
        _, here, there = np.intersect1d(delta, known, assume_unique=True, return_indices=True)
        frequency[here] = counts[there]
        size = len(own)
        longest = size * (bottom - top) // top  # most shingles in which a similar text differs
        rare = delta[np.lexsort((delta, frequency))[: longest + 1]].view(np.int64)
        if (bottom + top) * len(delta) <= (bottom - top) * (size + len(base)):
            out.append((np.array([0]), of, fp, label, size, len(delta), True))
        out.append((rare, of, fp, label, size, len(delta), False))
        held += len(rare) + 1
        if held > 100_000:
            yield _posted(out, top, bottom)
            out, held = [], 0
    if out:
        yield _posted(out, top, bottom)


def _posted(out: list[tuple], top: int, bottom: int) -> pa.RecordBatch:
    counts = [len(r[0]) for r in out]
    linked = np.repeat([r[6] for r in out], counts)
    element = pa.array(np.concatenate([r[0] for r in out]), pa.int64(), mask=linked)
    plain = [np.repeat(np.array([r[i] for r in out], np.int64), counts) for i in range(1, 6)]
    pos = np.concatenate([np.arange(n) for n in counts])
    short = pos <= plain[3] * (bottom - top) // top // 2
    columns = [pa.array(plain[0]), element, *map(pa.array, plain[1:]), pa.array(pos), pa.array(short)]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in POSTING.split(", ")])


def _meetings(mixed: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, candidates), both (u, v), that join what the similar pairs of each key join.

    Let P be the least member of a key and D(x) the shingles that exactly one of x and P has.
    x and y differ in |D(x) ^ D(y)| shingles, and are similar if that is at most a ninth of
    their sizes together.  If D(x) and D(y) share nothing, both are similar to P: these are
    the links.  Else let D(x) be the smaller: at most an eighth of x's shingles is in D(x)
    only, at most a quarter of y's in D(y) only.  So in any common order of the elements one
    of the first |x| / 8 + 1 of D(x) is among the first |y| / 4 + 1 of D(y); the first shared
    place also bounds how much they share.  Elements that witnesses lack come first.
    """
    top, bottom = SIMILARITY
    least = mixed.groupBy("key").agg(F.min("fp").alias("pivot"))
    named = salted_join(mixed.select("key", "fp", "label"), least, "key", _hot(mixed), "fp")
    members = cut_lineage(named.select("pivot", "fp", "label").distinct())
    turn = F.row_number().over(Window.partitionBy("pivot").orderBy("fp")) - 1
    heads = members.withColumn("turn", turn).filter(F.col("turn") <= WITNESSES)
    tasks = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK).cast("int").alias("tasks"))
    every = F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task")
    heads = heads.join(tasks, "pivot").select("pivot", every, "turn", "fp", "label")
    body = members.filter("fp <> pivot").join(tasks, "pivot").select(
        "pivot", F.pmod(F.xxhash64("fp"), F.col("tasks")).cast("int").alias("task"), F.lit(-1).alias("turn"), "fp", "label"
    )
    # Heads come first: the members' turn of -1 sorts behind them.
    after = F.when(F.col("turn") < 0, WITNESSES + 1).otherwise(F.col("turn"))
    dealt = heads.unionByName(body).join(sets, "fp").repartition("pivot", "task")
    dealt = dealt.sortWithinPartitions("pivot", "task", after).select("pivot", "turn", "fp", "label", "hashes")
    postings = cut_lineage(dealt.mapInArrow(_rare_elements, POSTING))
    linked = postings.filter("element is null").select(F.col("fp").alias("u"), F.col("pivot").alias("v"))
    rows = postings.filter("element is not null")
    met = rows.groupBy("pivot", "element").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n"))
    rows = cut_lineage(rows.join(met.filter("n > 1 and a <> b").select("pivot", "element"), ["pivot", "element"]))
    names = ("fp", "label", "size", "delta", "pos")
    x, y = (rows.select("pivot", "element", "short", *[F.col(c).alias(f"{c}_{s}") for c in names]) for s in "xy")
    shared = 1 + F.least(F.col("delta_x") - F.col("pos_x"), F.col("delta_y") - F.col("pos_y")) - 1
    both = F.col("size_x") + F.col("size_y")
    enough = (bottom + top) * (F.col("delta_x") + F.col("delta_y") - 2 * shared) <= (bottom - top) * both
    near = bottom * F.least("size_x", "size_y") >= top * F.greatest("size_x", "size_y")
    smaller = F.struct("delta_x", "fp_x") < F.struct("delta_y", "fp_y")
    pairs = x.filter("short").drop("short").join(y.drop("short"), ["pivot", "element"])
    pairs = pairs.filter((F.col("label_x") != F.col("label_y")) & smaller & near & enough)
    return linked, _as_pairs(pairs.select(F.col("fp_x").alias("u"), F.col("fp_y").alias("v")))


def links(keyed: DataFrame, sets: DataFrame, known: DataFrame | None = None) -> DataFrame | None:
    """Edges (u, v) that connect texts exactly as all similar pairs with a common key do; None without any.

    ``keyed``: (key, fp) of the keys that several texts share; ``known``: edges found before, which
    count as given and are part of the result.  Pairs of one group are
    never looked at again, and any pair of different groups has a member outside the largest
    group of its key.
    """
    found = known

    def add(more: DataFrame) -> None:
        nonlocal found
        more = cut_lineage(more)
        found = more if found is None else found.unionByName(more)

    hot = _hot(keyed)
    for most in ROUNDS:
        mixed, strays = _labelled(keyed, found, hot)
        pairs = _to_largest(mixed, strays, most, hot)
        if pairs.isEmpty():
            return found
        add(_verified(pairs, sets))
    mixed, _ = _labelled(keyed, found, hot)
    if not mixed.isEmpty():
        linked, pairs = _meetings(mixed, sets)
        add(linked)
        add(_verified(pairs, sets))
    return found


def near_copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``.

    Near copies are first those that fingerprints link (`simhash.linked_groups`), then
    those that are similar by their shingles, among texts that are still apart.
    ``component_id`` is the least doc_id that near copies reach.  Texts of equal words are
    one node ``fp``, texts without words too.  A null id stays null and joins its group,
    whose component is null if all its ids are.
    """
    printed = cut_lineage(_named(docs, doc_id, text, True))
    # Texts of equal words have equal prints and keys.
    one_of = [F.any_value(c).alias(c) for c in ("print", "keys")]
    distinct = cut_lineage(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), *one_of))
    every = cut_lineage(distinct.select("fp", F.explode("keys").alias("key")))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    keyed = cut_lineage(salted_join(every, shared, "key", _hot(every), "fp"))
    printed_groups = simhash.linked_groups(distinct.select(F.col("fp").alias("doc_id"), F.col("print").alias("fp")))
    alike = printed_groups.select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")).filter("u <> v")
    edges = cut_lineage(alike.distinct())
    if not keyed.isEmpty():
        edges = links(keyed, cut_lineage(_sets(docs, text, cut_lineage(keyed.select("fp").distinct()))), edges)
    found = cut_lineage(connected_components(edges))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return printed.join(of_fp, "fp").select("doc_id", "fp", "component_id")
