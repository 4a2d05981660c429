"""Exact top-k inner-product search: tiled matrix products, a partial selection per tile, and tree merging of the lists.

Vectors become integers floor(scale * x). Candidates and queries are packed into blocks; every query block meets every
candidate block once, by an equijoin on the number of the shard that it was copied to. A task keeps one running list per
query and gives it on once, so what is shuffled is lists, not scores. The lists are merged in two levels.

Products are made in floating point only where the largest possible sum is exact; else in 64-bit integers or, beyond
those, in Python integers. Scores are longs, so one that no long can hold, which takes components above 10^8, is the
nearest long.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; vectors of another
length than the query's are no candidates; ties go to the smaller id; a repeated row is a candidate for its equals, and
repeated query rows each give their list; null ids take no part; no rows: no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS, QUERY_ROWS = 4096, 512
LONG = (1 << 63) - 1
#: The largest double: a component beyond it after scaling counts as it.
MOST = sys.float_info.max


def _pack(rows: int):
    """Packs (id, vector of doubles that are whole numbers, times) into blocks of at most `rows` of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def give(dim: int) -> pa.RecordBatch:
            part = held.pop(dim)
            part.sort(key=lambda r: r[0])
            ids = np.array([r[0] for r in part], "<i8")
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.array([r[2] for r in part], "<i8").tobytes()], pa.binary()), pa.array([np.stack([r[1] for r in part]).astype("<f8").tobytes()], pa.binary())], ["dim", "ids", "times", "m"])

        for b in batches:
            for i, v, times in zip(b.column("id").to_pylist(), b.column("v"), b.column("times").to_pylist(), strict=True):
                x = v.values.to_numpy(zero_copy_only=False)
                part = held.setdefault(len(x), [])
                part.append((i, x, times))
                if len(part) >= rows:
                    yield give(len(x))
        for dim in list(held):
            yield give(dim)

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b (doubles that hold whole numbers), as int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.array([[max(-LONG - 1, min(LONG, x)) for x in r] for r in exact], np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best in each row, in order: highest score, then first place (the smallest id, as ids ascend)."""
    n = scores.shape[1]
    width = n.bit_length()
    if n > k and max(-int(scores.min()), int(scores.max())) < 1 << (62 - width):
        keys = (scores << width) + (n - 1 - np.arange(n))  # all different, so a partial selection is exact
        part = np.argpartition(keys, n - k, axis=1)[:, n - k :]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(keys, part, 1), axis=1), 1)
    return np.argsort(~scores, axis=1, kind="stable")[:, :k]


def _tiles(k: int):
    """Over joined tiles: one running list of k + 1 (a query may meet itself) per query, given on when many are held or at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for block, (q_ids, times, score, ids, own) in held.items():
                some = ids != np.iinfo(np.int64).min
                n = some.sum(1)
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                tops = pa.StructArray.from_arrays([pa.array(-1 - score[some]), pa.array(ids[some]), pa.array(own[some])], ["neg", "id", "own"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q_ids), block)), pa.array(np.arange(len(q_ids), dtype=np.int32)), pa.array(q_ids), pa.array(times), pa.ListArray.from_arrays(pa.array(at), tops)], ["block", "row", "query_id", "times", "tops"])
            held.clear()

        for b in batches:
            for dim, block, q_ids, times, q, c_ids, c in zip(*(b.column(n).to_pylist() for n in ("dim", "block", "q_ids", "q_times", "q", "ids", "m")), strict=True):
                q_ids, times, c_ids = (np.frombuffer(x, "<i8") for x in (q_ids, times, c_ids))
                q, c = np.frombuffer(q, "<f8").reshape(-1, dim), np.frombuffer(c, "<f8").reshape(-1, dim)
                s = products(q, c)
                top = best(s, k + 1)
                score, ids = np.take_along_axis(s, top, 1), c_ids[top]
                own = ids == q_ids[:, None]
                for i, j in zip(*np.nonzero(own), strict=True):
                    own[i, j] = np.array_equal(q[i], c[top[i, j]])
                if block in held:
                    _, _, s0, i0, o0 = held[block]
                    score, ids, own = np.concatenate([s0, score], 1), np.concatenate([i0, ids], 1), np.concatenate([o0, own], 1)
                    order = np.lexsort((ids, ~score), axis=1)[:, : k + 1]
                    score, ids, own = (np.take_along_axis(x, order, 1) for x in (score, ids, own))
                held[block] = [q_ids, times, score, ids, own]
            if len(held) > 64:
                yield from give()
        yield from give()

    return run


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as doubles; null unless all components are finite and there is one."""
    x = F.transform(vector.cast("array<double>"), lambda v: F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.when(F.abs(v * scale) < F.lit(float(1 << 52)), F.floor(v * scale).cast("double")).otherwise(F.greatest(F.least(v * scale, F.lit(MOST)), F.lit(-MOST)))))
    return F.when((F.size(vector) > 0) & ~F.exists(x, lambda v: v.isNull()), x)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row against all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), integers(F.col(embedding), scale).alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    # As many shards as candidates fill blocks, so that few candidates don't have the queries copied everywhere.
    shards = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // BLOCK_ROWS)))
    block = "dim int, ids binary, times binary, m binary"
    # Blocks are built where the rows are read; a shard is a set of candidate blocks.
    cands = rows.select("id", "v", F.lit(1).cast("long").alias("times")).mapInArrow(_pack(BLOCK_ROWS), block).select("dim", "ids", "m").withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)))
    # Equal query rows are packed once and counted; a block's number is the hash of what it holds, so it's the same when a task runs again.
    asked = rows.where("q").groupBy("id", "v").agg(F.count(F.lit(1)).alias("times"))
    packed = asked.mapInArrow(_pack(QUERY_ROWS), block)
    queries = packed.select("dim", F.col("ids").alias("q_ids"), F.col("times").alias("q_times"), F.col("m").alias("q"), F.xxhash64("ids", "m").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    tiles = queries.join(cands, ["dim", "shard"]).mapInArrow(_tiles(k), "block long, row int, query_id long, times long, tops array<struct<neg:bigint,id:bigint,own:boolean>>")
    merge = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k + 1)
    level1 = tiles.withColumn("side", F.spark_partition_id() % 8).groupBy("block", "row", "query_id", "times", "side").agg(merge("tops").alias("tops"))
    level2 = level1.groupBy("block", "row", "query_id", "times").agg(merge("tops").alias("tops"))
    # Its own row goes from each list: one entry that equals the query, if there is one.
    own = F.array_position(F.transform("tops", lambda t: t["own"]), True)
    cut = level2.withColumn("_own", own).select("query_id", "times", F.slice(F.when(F.col("_own") > 0, F.filter("tops", lambda t, i: i != (F.col("_own") - 1).cast("int"))).otherwise(F.col("tops")), 1, k).alias("tops"))
    repeated = cut.select("query_id", F.explode(F.array_repeat("tops", F.col("times").cast("int"))).alias("tops"))
    return repeated.select("query_id", F.posexplode("tops").alias("i", "t")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("t.id").alias("vec_id"), (-1 - F.col("t.neg")).alias("score"))
