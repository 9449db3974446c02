"""Language ID by multilingual mixture inference.

A document is a mixture of languages: its letter trigrams are drawn from the trigram
distributions of the languages in proportions that expectation-maximisation
estimates.  The set of languages starts with the single most likely one and grows by
the language that the likelihood wants most, as long as the gain exceeds a penalty per
language; so a foreign quotation shows up and chance does not.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm.registry import query, read

UNDETERMINED = "und"
# Labelled documents a model is fitted on, per language (an expected number: documents
# are taken by a hash of their id, at a rate that gives as many).
FIT_ROWS = 2_000
BUCKET_BITS = 16
SMOOTHING = 0.1
# A language must gain this many times log(trigrams) in log-likelihood.  Neighbouring
# trigrams overlap in two letters, hence far above the 0.5 of independent draws.
PENALTY = 3.0
EM_STEPS = 50
# The pipeline keeps documents whose main language has at least this share.
MIN_SHARE = 0.5


LETTER, MARK = 1, 2


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """LETTER for code points of letters, MARK for the marks that scripts write letters with, else 0."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        kinds[c] = LETTER if category[0] == "L" else MARK if category in ("Mn", "Mc") else 0
    return kinds


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of every letter trigram of the whole text in lower case.

    A run of other characters is one gap; a trigram holds a letter or mark in the middle, so
    gaps mark where words start and end.  Marks without any letter are no text.
    """
    raw = (text or "").lower().encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(raw, "<u4").astype(np.uint64)
    kinds = _letters()[c.astype(np.int64)]
    if not (kinds == LETTER).any():
        return np.empty(0, np.int64)
    c = np.where(kinds, c, 0)
    c = np.concatenate([[0], c, [0]]).astype(np.uint64)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    if len(c) < 3:
        return np.empty(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (c[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xD6E8FEB86659FD93)
    return (h[c[1:-1] != 0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    probability: np.ndarray  # (languages, buckets)


def fit(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS
) -> Model:
    """Trigram distributions of the languages, from about ``rows`` documents of each.

    Rows without language, id or text are not used.  Counts are added up in the tasks;
    the driver receives one number per language and bucket.
    """
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
        F.col(f"`{lang}`").alias("lang"),
    ).filter("lang is not null and doc_id is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in slim.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1 << BUCKET_BITS)))
    units = 1_000_000
    rate = F.coalesce(
        *[
            F.when(F.col("lang") == name, F.lit(min(units, -(-rows * units // n))))
            for name, n in sizes.items()
        ]
    )
    sample = slim.filter(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(units)) < rate)
    number = {name: i for i, name in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for value, name in zip(batch.column(1), batch.column(2)):
                ids = trigrams(value.as_py())
                total[number[name.as_py()]] += np.bincount(ids, minlength=1 << BUCKET_BITS)
        language, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(language, pa.int64()), pa.array(bucket, pa.int64()), pa.array(total[language, bucket])],
            names=["language", "bucket", "n"],
        )

    counts = (
        sample.mapInArrow(count, "language long, bucket long, n long")
        .groupBy("language", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    total = np.full((len(languages), 1 << BUCKET_BITS), SMOOTHING)
    total[counts["language"], counts["bucket"]] += counts["n"]
    return Model(languages, total / total.sum(axis=1, keepdims=True))


def _em(p: np.ndarray, times: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``p`` (languages, buckets) that maximise the likelihood."""
    share, last = start, -np.inf
    for _ in range(EM_STEPS):
        mixed = share @ p
        now = float(np.log(mixed) @ times)
        if now - last < 1e-3:
            break
        last = now
        share = share * ((p / mixed) @ times) / times.sum()
    return share, float(np.log(share @ p) @ times)


def infer(model: Model, text: str | None) -> list[tuple[str, float]]:
    """(language, share), largest share first; shares add up to 1.

    Empty if the text has no letter or the model knows no language.
    """
    ids = trigrams(text)
    if not len(ids) or not model.languages:
        return []
    # Counted by bucket, work and memory are bounded for a text of any length.
    times = np.bincount(ids, minlength=1 << BUCKET_BITS)
    buckets = np.flatnonzero(times)
    times = times[buckets].astype(float)
    p = model.probability[:, buckets]
    likelihood = np.log(p) @ times
    chosen, share, best = [int(likelihood.argmax())], np.ones(1), float(likelihood.max())
    cost = PENALTY * np.log(len(ids) + 1)
    while len(chosen) < len(model.languages):
        # How fast the likelihood rises as a language gets its first share.
        gain = (p / (share @ p[chosen])) @ times / times.sum()
        gain[chosen] = 0
        new = int(gain.argmax())
        if gain[new] <= 1:
            break
        trial, value = _em(p[[*chosen, new]], times, np.append(share * 0.9, 0.1))
        if value - best <= cost:
            break
        chosen, share, best = [*chosen, new], trial, value
    order = np.argsort(-share, kind="stable")
    return [(model.languages[chosen[i]], float(share[i])) for i in order]


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, mixture map<string,double>), one row per row of ``docs``.

    ``lang_pred`` is the language with the largest share and ``score`` that share.  Null, empty
    and letterless texts are ``und`` with score 0 and an empty mixture.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    map_type = pa.map_(pa.string(), pa.float64())

    def run(batches):
        for batch in batches:
            found = [infer(shared.value, x.as_py()) for x in batch.column(1)]
            main = [m[0] if m else (UNDETERMINED, 0.0) for m in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m[0] for m in main], pa.string()),
                    pa.array([m[1] for m in main], pa.float64()),
                    pa.array(found, map_type),
                ],
                names=["doc_id", "lang_pred", "score", "mixture"],
            )

    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, mixture map<string,double>"
    )


def held_out(doc_id: Column) -> Column:
    """Documents no model may learn from; a null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_determined(
    docs: DataFrame, model: Model, text: str = "text", min_share: float = MIN_SHARE
) -> DataFrame:
    """``docs`` whose main language has at least ``min_share``: neither ``und`` nor an even jumble.

    Rows are judged where they lie, each on its own, with all their columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            best = (infer(shared.value, x.as_py())[:1] for x in batch.column(place))
            keep = pa.array([bool(b) and b[0][1] >= min_share for b in best], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)


def fit_open(docs: DataFrame) -> Model:
    """`fit` on the documents that are not held out."""
    return fit(docs.filter(~held_out(F.col("doc_id"))))


@query("op1_language_mixture")
def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language, its share and the whole mixture of every document."""
    docs = read(spark, sf_dir, "documents")
    return predict(docs, fit_open(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture"
    )
