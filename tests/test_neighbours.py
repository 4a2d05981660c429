"""The index of nearest neighbours: recall against the exact scan, segments, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.operators import neighbours as N


def vectors(n: int, dim: int = 24, groups: int = 30, seed: int = 1) -> list[tuple]:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    return [(i, (centres[i % groups] + 0.6 * r.normal(size=dim)).tolist()) for i in range(n)]


def recall(index, table, queries, **a):
    got = N.recalled(index.search(queries, "id", "v", **a), N.exact_neighbours(table, queries, "id", "id", "v"), "id").agg(F.sum("wanted").alias("w"), F.sum("found").alias("f")).first()
    return got.f / got.w


def test_recall_and_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    rows = vectors(3000)
    table = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    queries = table.where("id % 20 = 0")
    index = N.Neighbours.build(table.where("id < 2000"), f"file://{tmp_path}/i", "id", "v")
    assert len(index.centres) == 45 and index.probes < 30
    assert recall(index, table.where("id < 2000"), queries.where("id < 2000")) >= 0.9
    # New rows are found without a rebuild, by an index that is opened again.
    index.append(table.where("id >= 2000"), "id", "v")
    again = N.Neighbours(spark, f"file://{tmp_path}/i")
    assert (again.centres == index.centres).all() and again._read("vectors").count() == 3000
    assert recall(again, table, queries) >= 0.9
    # All lists: only the bytes' rounding is left, and the exact cosine decides in the end.
    assert recall(again, table, queries, probes=45) > 0.99
    best = again.search(queries, "id", "v", k=1).collect()
    assert all(r.key == r.id and abs(r.similarity - 1) < 1e-6 and r.rank == 1 for r in best) and len(best) == 150


def test_a_list_that_has_most_rows(spark, tmp_path, monkeypatch):
    """Near copies fill one list; its blocks stay bounded."""
    monkeypatch.setattr(N, "BLOCK", 50)
    r = np.random.default_rng(2)
    base = r.normal(size=8)
    rows = [(f"k{i:04}", (base + 1e-3 * r.normal(size=8)).tolist()) for i in range(600)] + [(f"x{i:04}", r.normal(size=8).tolist()) for i in range(200)]
    table = spark.createDataFrame(rows, "id string, v array<double>")
    index = N.Neighbours.build(table, f"file://{tmp_path}/i", "id", "v", lists=12)
    sizes = [x.n for x in index._read("blocks").select(F.size("keys").alias("n")).collect()]
    assert max(sizes) == 50 and sum(sizes) == 800
    assert recall(index, table, table.where("id LIKE 'x%' AND id < 'x0050'")) >= 0.9


def test_odd_vectors(spark, tmp_path):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0]), (7, [1.0, None]), (8, [3.0, 0.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    index = N.Neighbours.build(table.where("id <> 6 OR id IS NULL"), f"file://{tmp_path}/i", "id", "v", lists=2)
    got = [(r.id, r["rank"], r.key) for r in index.search(table, "id", "v", k=2, probes=2).orderBy("id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 8), (2, 1, 2), (2, 2, 1), (8, 1, 1), (8, 2, 8)]
    with pytest.raises(ValueError, match="no vectors"):
        N.Neighbours.build(table.where("id = 3"), f"file://{tmp_path}/j", "id", "v")


def test_the_scan_gives_equal_vectors_by_key(spark, monkeypatch):
    """Tiles of a scan: the k best by the cosine summed in order, ties to the smaller key, whatever the tiles."""
    monkeypatch.setattr(N, "TILE", 64)
    rows = vectors(300, dim=7) + [(1000 + i, v) for i, v in vectors(40, dim=7)] * 1 + [(2000 + i, v) for i, v in vectors(40, dim=7)] + [(5000, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "id long, v array<double>").repartition(3).cache()
    queries = table.where("id < 40 OR id = 5000")
    unit = {r.key: np.array(r.vector, np.float32).astype(float) for r in N._valid(table, "id", "v").collect()}
    cosine = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), 0.0)
    for k in (1, 5):
        got = {}
        for r in N.exact_neighbours(table, queries, "id", "id", "v", k).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append((r["rank"], r.key))
        want = {q: [(i + 1, x) for i, x in enumerate(sorted((x for x in unit if len(unit[x]) == len(unit[q])), key=lambda x: (-cosine(unit[x], unit[q]), x))[:k])] for q in [*range(40), 5000]}
        assert got == want


def test_a_search_gives_on_only_rows_that_can_be_among_the_best(spark, tmp_path):
    rows = vectors(2000, dim=8, groups=10)
    table = spark.createDataFrame(rows, "id long, v array<double>").cache()
    index = N.Neighbours.build(table, f"file://{tmp_path}/i", "id", "v", lists=20)
    code = np.ones((100, 8), np.int8)
    import pyarrow as pa

    asked = [{"query": 1, "v": np.ones(8, np.float32).tobytes(), "base": 0.0, "least": least} for least in (float("-inf"), 1e9)]
    block = pa.RecordBatch.from_arrays([pa.array([asked]), pa.array([list(range(100))]), pa.array([np.linspace(0, 1, 100, dtype="<f4").tobytes()]), pa.array([code.tobytes()])], ["asked", "keys", "scales", "codes"])
    out = pa.Table.from_batches(list(N._scored(8, 10, pa.int64(), pa.int64())(iter([block]))))
    assert out["key"].to_pylist() == list(range(90, 100))
    assert recall(index, table, table.where("id % 20 = 0"), probes=20) > 0.99
