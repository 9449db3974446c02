"""Approximate vector search over an inverted file of cells.

Cells are the neighbourhoods of pivots: a bounded sample of the vectors, chosen by a hash of
the id.  Every vector is stored with the cell of its nearest pivot, and every cell with
its radius.  A query reads its nearest cells only, found by an equi-join of (query,
cell) with the stored vectors; no grid of queries and vectors exists.

How many cells to read is measured, not guessed: the true neighbours of a sample of the
vectors are looked up once, and ``probes`` is the number of cells that hold the wanted
share of them.  Clustered vectors need a few cells, vectors without structure many.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from merchlens.operators.dense import _unit, exact_scores
from merchlens.operators.lexical import top_k
from merchlens.session import cut_lineage

# Cells for n vectors: CELLS_PER_ROOT sqrt(n), at most MAX_CELLS, which bounds what tasks hold.
CELLS_PER_ROOT, MAX_CELLS = 4, 65_536
# The sample that measures recall: vectors, neighbours of each, share of these to be found.
SAMPLE, NEIGHBOURS, RECALL = 64, 20, 0.97
# Vectors and queries that one task compares at once.
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 20_000, 512


@dataclass(frozen=True)
class VectorIndex:
    """``cells``: cell, pivot, size, reach (cosine of the farthest member), shelf, parts;
    ``vectors``: doc_id, embedding, cell, shelf, part; ``size``: one row (vectors, probes)."""

    cells: DataFrame
    vectors: DataFrame
    size: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"cells": self.cells, "vectors": self.vectors, "size": self.size}


def cells_for(n: int) -> int:
    return min(MAX_CELLS, math.ceil(CELLS_PER_ROOT * math.sqrt(n)))


def _closeness(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Cosines in 8 digits, as ranks are everywhere; ties go to the lower cell."""
    return np.round(vectors @ pivots.T, 8)


def _pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """The pivots, at most MAX_CELLS, in the order of md5("pivot:id")."""
    first = vectors.orderBy(F.md5(F.concat(F.lit("pivot:"), F.col("doc_id").cast("string"))), "doc_id").limit(n)
    rows = [r["embedding"] for r in first.select("embedding").collect()]
    return _unit(pd.Series(rows)) if rows else np.empty((0, 0))


def _assigned(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(doc_id, embedding, cell, near): every vector with its nearest pivot and the cosine to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def assign(batches):
        for rows in batches:
            if rows.empty:
                continue
            unit, cells, near = _unit(rows["embedding"]), [], []
            for at in range(0, len(unit), 1000):
                close = _closeness(unit[at : at + 1000], shared.value)
                cells.append(close.argmax(axis=1))
                near.append(close.max(axis=1))
            yield rows.assign(cell=np.concatenate(cells), near=np.concatenate(near))

    return vectors.mapInPandas(assign, f"doc_id {kind['doc_id']}, embedding {kind['embedding']}, cell int, near double")


def _cell_order(queries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(query_id, cell, cell_rank) of every query and cell, for a bounded sample of queries."""
    shared = queries.sparkSession.sparkContext.broadcast(pivots)
    kind = queries.schema["query_id"].dataType.simpleString()

    def order(batches):
        for rows in batches:
            if rows.empty:
                continue
            close = _closeness(_unit(rows["embedding"]), shared.value)
            best = np.argsort(-close, axis=1, kind="stable")
            yield pd.DataFrame({
                "query_id": np.repeat(rows["query_id"].to_numpy(), best.shape[1]),
                "cell": best.ravel(),
                "cell_rank": np.tile(np.arange(1, best.shape[1] + 1), len(best)),
            })

    return queries.select("query_id", "embedding").mapInPandas(order, f"query_id {kind}, cell int, cell_rank int")


def probes_needed(assigned: DataFrame, pivots: np.ndarray, sample: int = SAMPLE, recall: float = RECALL) -> int:
    """Cells to read so that ``recall`` of the true neighbours of sampled vectors lie in them.

    The vectors with the least md5("probe:id") are searched exactly, one pass over the vectors.
    """
    mark = F.md5(F.concat(F.lit("probe:"), F.col("doc_id").cast("string")))
    chosen = cut_lineage(assigned.orderBy(mark, "doc_id").limit(sample).select(F.col("doc_id").alias("query_id"), "embedding"))
    scored = exact_scores(assigned.select("doc_id", "embedding"), chosen, NEIGHBOURS + 1)
    near = top_k(scored.filter("doc_id <> query_id"), NEIGHBOURS).select("query_id", "doc_id")
    hits = near.join(assigned.select("doc_id", "cell"), "doc_id").join(_cell_order(chosen, pivots), ["query_id", "cell"])
    # At most sample * NEIGHBOURS rows.
    ranks = sorted(r["cell_rank"] for r in hits.select("cell_rank").collect())
    return ranks[math.ceil(recall * len(ranks)) - 1] if ranks else 1


def fit(catalog: DataFrame, cells: int | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> VectorIndex:
    """An index of every vector of ``catalog`` (doc_id, embedding); rows without a vector are left out.

    Cells are put on shelves, which one task reads; a shelf of more than
    ``rows_per_block`` vectors is cut into parts by a hash of the id, so equal vectors by the
    million make many parts rather than one large one.
    """
    vectors = catalog.filter(F.col("embedding").isNotNull()).select("doc_id", "embedding")
    n = vectors.count()
    spark = catalog.sparkSession
    pivots = _pivots(vectors, cells or cells_for(n))
    assigned = cut_lineage(_assigned(vectors, pivots)) if len(pivots) else vectors.selectExpr("*", "0 cell", "1D near")
    probes = probes_needed(assigned, pivots) if len(pivots) else 1
    counts = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min("near").alias("reach"))
    numbered = spark.createDataFrame(
        [(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>"
    )
    shelves = max(1, math.ceil(n / rows_per_block), min(spark.sparkContext.defaultParallelism, len(pivots)))
    shelf = F.pmod("cell", F.lit(shelves)).alias("shelf")
    known = numbered.join(counts, "cell").select("*", shelf)
    on_shelf = known.groupBy("shelf").agg(F.ceil(F.sum("size") / rows_per_block).cast("int").alias("parts"))
    known = cut_lineage(known.join(on_shelf, "shelf"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part")
    placed = assigned.join(known.select("cell", "shelf", "parts"), "cell")
    placed = placed.select("doc_id", "embedding", "cell", "shelf", part).repartition("shelf", "part").sortWithinPartitions("shelf", "part", "cell")
    size = spark.createDataFrame([(n, probes)], "vectors bigint, probes int")
    return VectorIndex(known, placed, size)


def _probed(index: VectorIndex, queries: DataFrame, wanted) -> DataFrame:
    """(query_id, q_vec, shelf, part, cells): the cells ``wanted(closeness, row)`` of each query, by shelf and part."""
    rows = index.cells.orderBy("cell").collect()  # at most MAX_CELLS
    number = np.array([r["cell"] for r in rows])
    shelf = np.array([r["shelf"] for r in rows])
    table = {
        "pivots": np.array([r["pivot"] for r in rows], np.float64),
        "reach": np.array([r["reach"] for r in rows]),
        "parts": {r["shelf"]: r["parts"] for r in rows},
    }
    shared = queries.sparkSession.sparkContext.broadcast(table)
    kind = queries.schema["query_id"].dataType.simpleString()

    names = ["query_id", "q_vec", "shelf", "part", "cells"]

    def deal(batches):
        held = []
        for batch in batches:
            if batch.empty or not len(number):
                continue
            close = _closeness(_unit(batch["embedding"]), shared.value["pivots"])
            for row, own in zip(batch.itertuples(index=False), close):
                chosen = wanted(own, shared.value["reach"], row)
                chosen = chosen[np.argsort(shelf[chosen], kind="stable")]
                on, starts = np.unique(shelf[chosen], return_index=True)
                for s, cells in zip(on.tolist(), np.split(number[chosen], starts[1:])):
                    held += [(row.query_id, row.embedding, s, part, cells) for part in range(shared.value["parts"][s])]
                if len(held) >= 5000:
                    yield pd.DataFrame(held, columns=names)
                    held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    return queries.mapInPandas(deal, f"query_id {kind}, q_vec array<double>, shelf int, part int, cells array<int>")


def _scores(index: VectorIndex, probed: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, doc_id, score) of each query in each part of a shelf."""
    kinds = probed.schema["query_id"].dataType.simpleString(), index.vectors.schema["doc_id"].dataType.simpleString()

    dtypes = ["object" if kind == "string" else "float64" if kind == "double" else "int64" for kind in (*kinds, "double")]

    def compare(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: pd.Series([], dtype=t) for c, t in zip(("query_id", "doc_id", "score"), dtypes)})
        if vectors.empty or queries.empty:
            return none
        # Rows of the cells asked for, in the order of their cells.
        cells = vectors["cell"].to_numpy()
        asked = np.unique(np.concatenate(queries["cells"].to_numpy()))
        rows = np.flatnonzero(np.isin(cells, asked))
        unit, ids = _unit(vectors["embedding"].iloc[rows]) if len(rows) else None, vectors["doc_id"].to_numpy()[rows]
        place = np.searchsorted(asked, cells[rows])
        found = [none]
        for at in range(0, len(queries) if len(rows) else 0, QUERIES_PER_BLOCK):
            some = queries.iloc[at : at + QUERIES_PER_BLOCK]
            reads = np.zeros((len(some), len(asked)), bool)
            for i, own in enumerate(some["cells"]):
                reads[i, np.searchsorted(asked, own)] = True
            score = np.where(reads[:, place], _unit(some["q_vec"]) @ unit.T, -np.inf)
            shown = np.round(score, 8)
            for i, query_id in enumerate(some["query_id"]):
                pick = np.flatnonzero(shown[i] > -np.inf)
                if len(pick) > k:
                    pick = pick[shown[i, pick] >= np.partition(shown[i, pick], -k)[-k]]
                best = pick[np.lexsort((ids[pick], -shown[i, pick]))[:k]]
                found.append(pd.DataFrame({"query_id": query_id, "doc_id": ids[best], "score": score[i, best]}))
        return pd.concat(found, ignore_index=True)

    # The shelves asked for, so that the scan can leave the others out.
    asked = index.vectors.join(probed.select("shelf", "part").distinct(), ["shelf", "part"], "left_semi")
    return asked.groupBy("shelf", "part").cogroup(probed.groupBy("shelf", "part")).applyInPandas(
        compare, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"
    )


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """R06. The ``k`` nearest vectors of each query (query_id, embedding), with rank and score.

    Reads the ``probes`` nearest cells, by default as many as the index measured.  ``exact``
    adds a second pass over the cells that could still hold something better: by the
    triangle inequality no member of a cell is closer than the angle to its pivot less
    the cell's radius, so the others cannot beat the k-th score and the result is that
    of the exact search.  Queries without a vector, or an empty index, give no rows.
    """
    most = probes or index.size.first()["probes"]
    asking = queries.filter(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def nearest(close, reach, row):
        return np.argsort(-close, kind="stable")[:most]

    first = top_k(_scores(index, _probed(index, asking, nearest), k), k)
    if not exact:
        return first
    first = cut_lineage(first)
    last = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
    floor = F.when(F.col("n") >= k, F.col("score")).otherwise(F.lit(-2.0)).alias("floor")
    marked = asking.join(last, "query_id", "left").select("query_id", "embedding", floor)

    def possible(close, reach, row):
        angle = np.arccos(np.clip(close, -1, 1)) - np.arccos(np.clip(reach, -1, 1))
        order = np.argsort(-close, kind="stable")[most:]
        return order[np.cos(np.maximum(angle[order], 0)) >= row.floor - 1e-6]

    more = _scores(index, _probed(index, marked, possible), k)
    return top_k(first.select("query_id", "doc_id", "score").unionByName(more), k)


def share_read(index: VectorIndex, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """(query_id, cells, vectors, share): what a search reads for each query."""
    most = probes or index.size.first()["probes"]
    asking = queries.filter(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    probed = _probed(index, asking, lambda close, reach, row: np.argsort(-close, kind="stable")[:most])
    cells = probed.filter("part = 0").select("query_id", F.explode("cells").alias("cell"))
    counted = cells.join(index.cells.select("cell", "size"), "cell").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("size").alias("vectors")
    )
    return counted.crossJoin(index.size.select(F.col("vectors").alias("all"))).select(
        "query_id", "cells", "vectors", F.round(F.col("vectors") / F.col("all"), 6).alias("share")
    )
