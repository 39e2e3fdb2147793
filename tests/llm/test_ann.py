"""op7 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann


def brute(ids, x, k=5, every=50):
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = (x @ x[q]) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[q] * x[q]).sum()))
        others = np.flatnonzero(ids != ids[q])
        best = others[np.lexsort((ids[others], -np.round(score[others], 12)))][:k]
        out[int(ids[q])] = [(int(ids[b]), float(score[b])) for b in best]
    assert len(unit) == len(x)
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<double>")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    n, d = 12_000, 24
    x = rng.normal(size=(n, d))
    if kind == "clusters":
        x = rng.normal(size=(40, d))[rng.integers(0, 40, n) * (rng.random(n) > 0.35)] + 0.25 * x
    ids = np.arange(n)
    got, want = found(ann.nearest(frame(spark, ids, x), F.col("id") % 50 == 0)), brute(ids, x)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for q, rows in got.items():
        assert len(rows) == 5 and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        for i, s in rows:
            assert abs(s - x[i] @ x[q] / (np.linalg.norm(x[i]) * np.linalg.norm(x[q]))) < 1e-12


def test_recall_of_queries_unlike_the_rows(spark):
    """The rows are dense groups, whose neighbours share a cell; the queries lie between the groups."""
    rng = np.random.default_rng(11)
    n, d = 12_000, 24
    ids = np.arange(n)
    x = rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.1 * rng.normal(size=(n, d))
    x[ids % 50 == 0] = rng.normal(size=(n // 50, d))
    got, want = found(ann.nearest(frame(spark, ids, x), F.col("id") % 50 == 0)), brute(ids, x)
    assert set(got) == set(want) and recall(got, want) >= 0.9


@pytest.mark.parametrize("drawn", [ann.TRAIN_ROWS, 600])
@pytest.mark.parametrize("noise", [0.001, 0.01])
def test_recall_among_near_copies(spark, monkeypatch, drawn, noise):
    """A third of the rows are near copies in groups larger than the least cut, which a small sample hardly shows."""
    monkeypatch.setattr(ann, "TRAIN_ROWS", drawn)
    rng = np.random.default_rng(5)
    n, d = 12_000, 24
    x = rng.normal(size=(n, d))
    third = np.arange(0, n, 3)
    x[third] = rng.normal(size=(8, d))[rng.integers(0, 8, len(third))] + noise * x[third]
    ids = rng.permutation(n)
    assert recall(found(ann.nearest(frame(spark, ids, x), F.col("id") % 50 == 0)), brute(ids, x)) >= 0.9


def test_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    assert recall(found(ann.nearest(table, F.col("id") % 50 == 0)), brute(ids, x)) >= 0.9


def test_copies_and_ties(spark):
    """A vector that thousands of rows share: ties go to the smaller ids, the query's own row is left out."""
    rng = np.random.default_rng(4)
    x = np.vstack([np.tile(rng.normal(size=8), (9_000, 1)), rng.normal(size=(1_000, 8))])
    got = found(ann.nearest(frame(spark, np.arange(10_000), x), F.col("id") % 50 == 0))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4]


def test_vectors_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [inf, 1.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as cell", "4 as block")
    got = found(ann.nearest(df, F.col("id") % 50 == 0))
    assert {q: [i for i, _ in r] for q, r in got.items()} == {0: [1, 50], 50: [1, 0]}
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(alone, F.col("id") % 50 == 0).count() == 0
