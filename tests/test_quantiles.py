"""Exact quantiles and distinct counts against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlens.operators import quantiles as qt


@pytest.mark.parametrize("kind", ["spread", "copies", "outlier"])
def test_same_as_numpy(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "spread": rng.normal(size=700),
        "copies": rng.integers(0, 4, 700).astype(float),
        "outlier": np.append(rng.random(300), [1e18, -1e18]),
    }[kind]
    rows = [("a" if i % 3 else None, float(v)) for i, v in enumerate(values)]
    rows += [("one", 5.0), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    q = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    got = {(r.g, r.q, r.kind): r.value for r in qt.exact_quantiles(df, "g", "v", q, [0.5, 0.95]).collect()}
    for g in ("a", None, "one"):
        own = np.array([v for name, v in rows if name == g])
        for p in q:
            assert got[g, p, "interpolated"] == pytest.approx(np.quantile(own, p), rel=1e-12, abs=1e-12)
        for p in (0.5, 0.95):
            assert got[g, p, "nearest"] == np.sort(own)[max(int(np.ceil(p * len(own) - 1e-12)) - 1, 0)]
    assert not any(g == "none" for g, _, _ in got)
    assert qt.exact_quantiles(df.limit(0), "g", "v", q).count() == 0


def test_distinct_counts(spark):
    rows = [(1, "x"), (1, None), (2, "x" * 5000), (2, "x" * 5000), (None, "")]
    df = spark.createDataFrame(rows, "a int, b string")
    got = qt.distinct_counts(df, {"a": F.col("a"), "b": F.col("b"), "row": F.struct("a", "b"), "no": F.lit(None).cast("string")})
    assert {r.column_name: r.distinct_count for r in got.collect()} == {"a": 2, "b": 3, "row": 4, "no": 0}
    assert {r.distinct_count for r in qt.distinct_counts(df.limit(0), {"a": F.col("a")}).collect()} == {0}


@pytest.mark.parametrize("accuracy", [qt.ACCURACY, 20])
def test_brackets_hold_every_rank_of_groups_of_any_size(spark, monkeypatch, accuracy):
    monkeypatch.setattr(qt, "ACCURACY", accuracy)
    rng = np.random.default_rng(accuracy)
    own = {n: np.round(rng.lognormal(size=n), 2 if n % 2 else 6) for n in [*range(1, 40), 101, 997, 5000]}
    df = spark.createDataFrame([(n, float(v)) for n, vs in own.items() for v in vs], "g int, v double").repartition(4)
    q = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
    got = {(r.g, r.q, r.kind): r.value for r in qt.exact_quantiles(df, "g", "v", q, [0.5, 0.9, 0.95]).collect()}
    for n, vs in own.items():
        for p in q:
            assert got[n, p, "interpolated"] == pytest.approx(np.quantile(vs, p), rel=1e-12)
        for p in (0.5, 0.9, 0.95):
            assert got[n, p, "nearest"] == np.sort(vs)[max(int(np.ceil(p * n - 1e-12)) - 1, 0)]
