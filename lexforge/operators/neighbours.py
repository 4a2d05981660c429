"""Approximate nearest neighbours by cosine: an inverted-file index of quantised residuals.

Vectors are brought to length one and put into the list of their nearest centre; the centres come from k-means over a
sample of at most SAMPLE rows. What a vector differs from its centre is kept as a byte a component, times a scale of its
own, in blocks of at most BLOCK rows of one list; a list of any length is cut into such blocks, so none is one task's work.
Each row also keeps its vector, in a table that only the last step reads, for the few rows that it names.

A search compares each query with the centres, reads the blocks of the `probes` nearest lists, takes the best REFINE * k of
each query by their approximate cosine (in partial lists, merged by query) and orders these by the exact one. How many
lists have to be looked at for the wanted recall is measured when the index is made, on queries from the sample.

New vectors come as further segments with the same centres, without a rebuild; a commit log says which there are.
Vectors that are null, zero, of another length or not finite take no part. Keys are unique; ties go to the smaller key.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions.vectors import norm
from lexforge.sources.store import Snapshot, Store, Table

SAMPLE, BLOCK, QUERIES, REFINE = 20_000, 2048, 256, 4
#: Rows of the sample that are asked, and those they are compared with, to find the number of probes.
ASKED, AGAINST = 200, 4000
#: Rows that a scan compares with queries at once, and how far a matrix product may be from a sum in order.
TILE, SLACK = 8192, 1e-9
SEGMENTS = {"segments": Table("name string, rows long", ("name",))}


def nearest_lists(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    far = (centres * centres).sum(1) - 2 * vectors @ centres.T
    if n == 1:
        return far.argmin(1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists in which this part of the true neighbours of sample rows lies."""
    asked, against = sample[:ASKED], sample[:AGAINST]
    scores = asked @ against.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -2
    true = np.argsort(-scores, axis=1)[:, : min(k, len(against) - 1)]
    if not true.size:
        return len(centres)
    place = np.empty((len(asked), len(centres)), np.int64)
    order = nearest_lists(asked, centres, len(centres))
    np.put_along_axis(place, order, np.arange(len(centres))[None].repeat(len(asked), 0), 1)
    needed = np.sort(np.take_along_axis(place, nearest_lists(against, centres, 1)[:, 0][true], 1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), dim)


def _assigned(centres: np.ndarray):
    """Rows (key, vector) into (list, key, vector, scale, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("vector"), centres.shape[1])
            own = nearest_lists(v, centres, 1)[:, 0]
            rest = v - centres[own]
            scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column("key"), b.column("vector"), pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in code], pa.binary())], ["list", "key", "vector", "scale", "code"])

    return run


def _packed(most: int):
    """Rows (list, key, scale, code) by list into blocks of at most `most` rows of one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def give() -> pa.RecordBatch:
            lists, keys, scales, codes = zip(*held, strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(lists[:1], pa.int32()), pa.array([keys]), pa.array([np.array(scales, "<f4").tobytes()], pa.binary()), pa.array([b"".join(codes)], pa.binary())], ["list", "keys", "scales", "codes"])

        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in ("list", "key", "scale", "code")), strict=True):
                if held and (held[0][0] != row[0] or len(held) == most):
                    yield give()
                held.append(row)
        if held:
            yield give()

    return run


def _probed(centres: np.ndarray, probes: int):
    """Rows (query, vector) into one for each list that is looked at, with its place among them and the query's product with its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("vector"), centres.shape[1])
            lists = nearest_lists(v, centres, probes)
            base = np.take_along_axis(v @ centres.T, lists, 1)
            at = np.repeat(np.arange(len(v)), lists.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), b.column("query").take(pa.array(at)), pa.array([r.tobytes() for r in v[at]], pa.binary()), pa.array(base.ravel().astype(np.float32)), pa.array(np.tile(np.arange(lists.shape[1], dtype=np.int32), len(v)))], ["list", "query", "v", "base", "place"])

    return run


def _scored(dim: int, most: int, key: pa.DataType, query: pa.DataType):
    """Over pairs of some queries and a block: the best `most` of each query in it, by approximate cosine, that reach its `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asked, keys, scales, codes in zip(*(b.column(n) for n in ("asked", "keys", "scales", "codes")), strict=True):
                asked, names = asked.as_py(), keys.values
                q = np.stack([np.frombuffer(a["v"], np.float32) for a in asked])
                code = np.frombuffer(codes.as_buffer(), np.int8).reshape(-1, dim).astype(np.float32)
                score = np.array([a["base"] for a in asked], np.float32)[:, None] + (q @ code.T) * np.frombuffer(scales.as_buffer(), "<f4")
                reach = score >= np.array([a["least"] for a in asked])[:, None]
                for i in np.nonzero(reach.sum(1) > most)[0]:
                    reach[i] = False
                    reach[i, np.argsort(-score[i], kind="stable")[:most]] = True
                i, j = np.nonzero(reach)
                yield pa.RecordBatch.from_arrays([pa.array([a["query"] for a in asked], query).take(pa.array(i)), names.take(pa.array(j)).cast(key), pa.array(score[i, j].astype(np.float64))], ["query", "key", "near"])

    return run


class Neighbours:
    """An index in a folder that driver and executors share; `Neighbours.build` makes one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, f"{self.path}/commits", SEGMENTS, buckets=1)
        made = spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()  # one row a list
        self.centres = np.array([r.centre for r in made], np.float32)
        self.probes, self.k = made[0].probes, made[0].k

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str, vector: str, lists: int | None = None, k: int = 10, recall: float = 0.97, seed: int = 7) -> Neighbours:
        """Makes the index over all rows. lists: as many as the square root of the rows, 4096 at most, if not given.

        Centres, and the lists to look at for k neighbours with this recall, come from at most SAMPLE rows.
        """
        spark, rows = vectors.sparkSession, _valid(vectors, key, vector)
        total = rows.count()
        if not total:
            raise ValueError("there are no vectors to index")
        # The rows with the least hashes: the same sample whenever it is taken, of at most SAMPLE rows.
        sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < math.ceil(2_000_000 * SAMPLE / total)).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").collect()
        held = np.array([r.vector for r in sample], np.float32)
        lists = lists or max(1, min(4096, round(math.sqrt(total))))
        given = spark.createDataFrame([(r.tolist(),) for r in held], "vector array<double>").select(array_to_vector("vector").alias("features"))
        centres = np.array(KMeans(k=lists, seed=seed, maxIter=12, initSteps=1).fit(given).clusterCenters(), np.float32)
        probes = probes_for(held, centres, k, recall)
        spark.createDataFrame([(i, c.tolist(), probes, k) for i, c in enumerate(centres)], "list int, centre array<float>, probes int, k int").write.parquet(f"{path.rstrip('/')}/centres")
        made = cls(spark, path)
        made.append(vectors, key, vector)
        return made

    def append(self, vectors: DataFrame, key: str, vector: str) -> None:
        """Adds rows as a segment."""
        name, rows = f"segment-{uuid.uuid4().hex}", _valid(vectors, key, vector).where(F.size("vector") == self.centres.shape[1])
        kind = rows.schema["key"].dataType
        schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("key", kind), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("scale", T.FloatType()), T.StructField("code", T.BinaryType())])
        self._write(rows.mapInArrow(_assigned(self.centres), schema), f"{name}/assigned")
        assigned = self.spark.read.schema(schema).parquet(f"{self.path}/{name}/assigned")
        blocks = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("scales", T.BinaryType()), T.StructField("codes", T.BinaryType())])
        sorted_ = assigned.select("list", "key", "scale", "code").repartitionByRange("list", "key").sortWithinPartitions("list", "key")
        self._write(sorted_.mapInArrow(_packed(BLOCK), blocks), f"{name}/blocks")
        self._write(assigned.select("key", "vector").repartitionByRange("key").sortWithinPartitions("key"), f"{name}/vectors")
        self.store._fs.delete(self.store._hadoop(f"{self.path}/{name}/assigned"), True)
        count = self.spark.read.parquet(f"{self.path}/{name}/vectors").count()

        def decide(at: Snapshot) -> dict[str, DataFrame]:
            return {"segments": self.spark.createDataFrame([(name, count)], SEGMENTS["segments"].schema)}

        self.store.change(decide)

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")

    def _read(self, kind: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{r['name']}/{kind}") for r in self.store.read("segments").orderBy("name").collect()])

    def search(self, queries: DataFrame, query: str, vector: str, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query, rank, key, similarity): the k nearest rows of each query, by exact cosine among those that were found near."""
        dim, blocks, vectors = self.centres.shape[1], self._read("blocks"), self._read("vectors")
        asked = _valid(queries, query, vector).where(F.size("vector") == dim).withColumnRenamed("key", "query")
        kinds = {"query": asked.schema["query"].dataType, "key": vectors.schema["key"].dataType}
        schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("query", kinds["query"]), T.StructField("v", T.BinaryType()), T.StructField("base", T.FloatType()), T.StructField("place", T.IntegerType())])
        probed = asked.mapInArrow(_probed(self.centres, min(len(self.centres), probes or self.probes)), schema)
        groups, most = self._groups(asked), REFINE * k
        arrow = [_arrow_type(kinds[n]) for n in ("key", "query")]

        def near(some: DataFrame) -> DataFrame:
            # Queries of a list go to its blocks some at a time.
            parts = some.groupBy("list", F.floor(F.pmod(F.xxhash64("query"), F.lit(1 << 20)) / ((1 << 20) // groups)).alias("part")).agg(F.collect_list(F.struct("query", "v", "base", "least")).alias("asked"))
            return parts.join(blocks, "list").mapInArrow(_scored(dim, most, *arrow), T.StructType([T.StructField("query", kinds["query"]), T.StructField("key", kinds["key"]), T.StructField("near", T.DoubleType())]))

        best = lambda df, by: df.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("near")).alias("far"), "key"))), 1, most).alias("top"))
        rows = lambda df: df.select("query", F.inline("top")).select("query", "key", (-F.col("far")).alias("near"))
        merged = lambda df: best(rows(best(df.withColumn("side", F.pmod(F.xxhash64("key"), F.lit(8))), ["query", "side"])), ["query"])
        # The nearest list alone gives each query a score that its best reach in any case; of the other lists only rows that reach it are given on.
        first = merged(near(probed.where("place = 0").withColumn("least", F.lit(float("-inf")))))
        least = first.where(F.size("top") == most).select("query", (-F.element_at("top", -1)["far"]).alias("least"))
        others = probed.where("place > 0").join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        top = rows(merged(rows(first).unionByName(near(others))))
        exact = top.select("query", "key").join(vectors, "key").join(asked.select("query", F.col("vector").alias("_q")), "query")
        scored = exact.select("query", "key", F.aggregate(F.zip_with("vector", "_q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x).alias("similarity"))
        order = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")  # REFINE * k rows of a query
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query").alias(query), "rank", "key", "similarity")

    def _groups(self, asked: DataFrame) -> int:
        """Parts of a list's queries, so that about QUERIES go together: a power of two."""
        return 1 << max(0, min(20, math.ceil(math.log2(max(1, asked.count() * self.probes / len(self.centres) / QUERIES)))))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector at length one) of rows with a vector that has a direction."""
    n = norm(F.col(vector))
    fine = ~F.exists(F.col(vector), lambda x: x.isNull()) & (n > 0) & ~F.isnan(n) & (n < F.lit(float("inf")))
    return vectors.where(F.col(key).isNotNull() & fine).select(F.col(key).alias("key"), F.transform(vector, lambda x: (x / n).cast("float")).alias("vector"))


def _compared(asked: np.ndarray, k: int, query: pa.Array):
    """Rows (key, vector) into (query, key, similarity): of each TILE rows the k best of each query, ties to the smaller key.

    Matrix products find all that may be among the k best; their cosines are then summed up one component after another, so
    that equal vectors have equal ones.
    """

    def of_tile(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pc.sort_indices(rows["key"]))
        v, n = _matrix(rows["vector"].combine_chunks(), asked.shape[1]).astype(np.float64), min(k, rows.num_rows)
        for start in range(0, len(asked), QUERIES):
            q = asked[start : start + QUERIES].astype(np.float64)
            score = q @ v.T
            i, j = np.nonzero(score >= np.partition(score, -n, axis=1)[:, -n, None] - SLACK)
            exact = np.zeros(len(i))
            for d in range(v.shape[1]):
                exact += v[j, d] * q[i, d]
            order = np.lexsort((j, -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield pa.RecordBatch.from_arrays([query.take(pa.array(start + i[kept])), rows["key"].combine_chunks().take(pa.array(j[kept])), pa.array(exact[kept])], ["query", "key", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= TILE:
                yield from of_tile(pa.Table.from_batches(held))
                held = []
        if sum(x.num_rows for x in held):
            yield from of_tile(pa.Table.from_batches(held))

    return run


def exact_neighbours(vectors: DataFrame, queries: DataFrame, key: str, query: str, vector: str, k: int = 10) -> DataFrame:
    """As `search`, by a scan that compares every query with every row: for measuring recall. queries are few enough to be broadcast: 4096 at most."""
    asked = _valid(queries, query, vector).select(F.col("key").alias("query"), F.col("vector").alias("_q")).limit(4097).collect()
    if len(asked) > 4096:
        raise ValueError("too many queries for the scan")
    rows = _valid(vectors, key, vector)
    kinds = T.StructType([T.StructField("query", queries.schema[query].dataType), T.StructField("key", rows.schema["key"].dataType), T.StructField("similarity", T.DoubleType())])
    found = [vectors.sparkSession.createDataFrame([], kinds)]
    for dim in sorted({len(r["_q"]) for r in asked}):
        some = [r for r in asked if len(r["_q"]) == dim]
        names = pa.array([r["query"] for r in some], _arrow_type(kinds["query"].dataType))
        found.append(rows.where(F.size("vector") == dim).mapInArrow(_compared(np.array([r["_q"] for r in some], np.float32), k, names), kinds))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")  # k rows of a query and tile
    top = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select(F.col("query").alias(query), "rank", "key", "similarity")


def recalled(found: DataFrame, wanted: DataFrame, query: str) -> DataFrame:
    """(query, wanted, found): how many of the wanted neighbours were found."""
    have = found.select(query, "key", F.lit(1).alias("_has"))
    return wanted.join(have, [query, "key"], "left").groupBy(query).agg(F.count(F.lit(1)).alias("wanted"), F.count("_has").alias("found"))
