"""Shared helpers of the training-data operators: work tables, row keys, words."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only word separators: space and \x09 to \x0D.
WHITE = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local_dir()
    return found.rstrip("/")


@cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lexforge-")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lowers the bytes of an Arrow batch to `most`, so that long texts don't fill executors and their Python workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.sub(r"[^0-9-]", "", spark.conf.get(name)) or "-1"
    if not 0 < int(now) <= most:
        spark.conf.set(name, f"{most}b")


class Workspace:
    """Written tables in the shared folder. They cut lineage, survive lost executors, and are deleted when no longer needed.

    What an operator returns may read some of them, so those stay until `released` or `release_all` deletes them.
    """

    opened: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/lexforge/{name}-{uuid.uuid4().hex}"
        Workspace.opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))

    def free(self) -> None:
        """Lets Spark remove the shuffle files of finished steps now, not when the driver happens to collect garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


@contextmanager
def released() -> Iterator[None]:
    """Deletes, at its end, the work tables of operators called inside: for results that are written inside."""
    mark = len(Workspace.opened)
    try:
        yield
    finally:
        while len(Workspace.opened) > mark:
            space = Workspace.opened.pop()
            delete(space.spark, space.root)


def release_all() -> None:
    """Deletes all work tables of this process; results not yet written can't be read any more."""
    while Workspace.opened:
        space = Workspace.opened.pop()
        delete(space.spark, space.root)


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, lengthened until docs have no such column, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []


def words(text: Column) -> Column:
    """The words of a text between ASCII white space, unchanged; null or blank: no words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def keyed(docs: DataFrame, key: str, space: Workspace, name: str = "keyed") -> DataFrame:
    """docs with a long column `key` that is unique by row.

    Where doc_id is a whole number, unique and never null it is the key itself. Otherwise (repeated rows, null ids, ids
    of another type, no such column) the rows are written once with a number each, since numbers given on the fly may
    change when a lost task is run again.
    """
    if dict(docs.dtypes).get("doc_id") not in ("bigint", "int", "smallint", "tinyint"):
        return space.write(docs.withColumn(key, F.monotonically_increasing_id()), name)
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if not ids.where((F.col("n") > 1) | F.col("doc_id").isNull()).take(1):
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    return space.write(docs.withColumn(key, F.monotonically_increasing_id()), name)
