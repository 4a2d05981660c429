import math

import numpy as np

from lexforge.llm import queries
from lexforge.llm.search import best, products, top_k
from pyspark.sql import functions as F
from tests.llm.fixtures import SF


def brute(rows, k=20):
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(good):
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), i) for b, (i, w) in enumerate(good) if b != a and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, score int")
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0).collect())


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-2, 3, 4) / 4]) for i in range(60)]  # many ties
    rows += [(100, None), (101, []), (120, [1.0, None, 1.0, 1.0]), (140, [float("nan")] * 4), (160, [float("inf")] * 4), (180, [1.0, -1.0]), (181, [-0.001, 0.5])]
    rows += [rows[20], rows[20], rows[40], (40, [0.5, 0.5, 0.25, 1.0])]  # repeated rows; an id with another vector
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == [] and run(spark, rows[:0]) == []


def test_huge_components(spark):
    df = spark.createDataFrame([(0, [1e308, 1.0]), (1, [1e307, 0.0]), (2, [-1e308, 5.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2**63 - 1), (3, 64 * 128), (2, -(2**63))]


def test_products_are_exact():
    for scale in (10, 10**6, 10**8, 2**60):
        a = np.array([[scale, -scale + 1], [3, scale - 1]], np.float64)
        want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in a] for r in a]
        assert products(a, a).tolist() == want


def test_best_breaks_ties_by_place():
    s = np.array([[1, 5, 5, 0, 5], [7, 7, 7, 7, 7]])
    assert best(s, 2).tolist() == [[1, 2], [0, 1]]
    assert best(s * 2**59, 2).tolist() == [[1, 2], [0, 1]]
    assert best(s, 9).tolist() == [[1, 2, 4, 0, 3], [0, 1, 2, 3, 4]]


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op8_exact_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect()) == brute(rows)
