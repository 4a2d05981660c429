"""Relations between documents: key resolution, transitive walks and families."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def resolve(edges: DataFrame, documents: DataFrame, key: str, rank: list) -> DataFrame:
    """edges with target_id: of the documents that have the key, the preferred one; null where none has it."""
    best = documents.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*rank))).where("_n = 1").select(F.col(key), F.col("document_id").alias("target_id"))
    return edges.join(best, key, "left")


def preferred(documents: DataFrame, key: str, in_force: str, date: str) -> DataFrame:
    """(key, target_id): of the documents of a key the one in force, the newest, the one with the highest id; kept by a partial aggregate."""
    return documents.groupBy(key).agg(F.max_by("document_id", F.struct(F.coalesce(in_force, F.lit(False)), F.coalesce(F.col(date).cast("date"), F.lit("0001-01-01").cast("date")), "document_id")).alias("target_id"))


def relinked(edges: DataFrame, documents: DataFrame, key: str, in_force: str, date: str) -> DataFrame:
    """edges (key, target_id, ...) with every target resolved anew, so that open or weaker ones follow a document that has come; what no document has keeps its old target."""
    best = preferred(documents, key, in_force, date).withColumnRenamed("target_id", "_best")
    return edges.join(best, key, "left").withColumn("target_id", F.coalesce("_best", "target_id")).drop("_best")


def synchronised(edges: DataFrame, extracted: DataFrame, renewed: DataFrame, source: str, relation: str, kinds: Sequence[str]) -> DataFrame:
    """edges after the relations of some documents (`renewed`: source) were extracted anew: their extracted kinds are replaced, others stay."""
    mine = renewed.select(source).distinct().withColumn("_renewed", F.lit(True))
    replaced = F.col("_renewed").isNotNull() & F.coalesce(F.col(relation).isin(list(kinds)), F.lit(False))
    return edges.join(mine, source, "left").where(~replaced).select(*edges.columns).unionByName(extracted, allowMissingColumns=True)


def delegated(family: DataFrame, titles: DataFrame, bases: DataFrame) -> DataFrame:
    """(start, document_id, via): regulations issued under any member of a law's family, or under its title.

    family: (start, node) with every earlier and later version of a law and the law itself; titles: (document_id,
    title_key); bases: (document_id, target_id, target_key) legal bases, resolved or only named.
    """
    by_id = bases.join(family.select("start", F.col("node").alias("target_id")), "target_id").select("start", "document_id", F.lit("document").alias("via"))
    named = family.join(titles.withColumnRenamed("document_id", "node"), "node").where("title_key IS NOT NULL").select("start", F.col("title_key").alias("target_key")).distinct()
    by_title = bases.join(named, "target_key").select("start", "document_id", F.lit("title").alias("via"))
    return by_id.unionByName(by_title).groupBy("start", "document_id").agg(F.min("via").alias("via"))


def relation_counts(edges: DataFrame, relation: str = "relation") -> DataFrame:
    return edges.groupBy(relation).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target_id").isNotNull()).alias("resolved"))


def walk(edges: DataFrame, starts: DataFrame, max_depth: int = 50) -> DataFrame:
    """(start, node, depth, cut): all nodes reachable over edges (source, target), each at its least depth; cycles end, dangling targets count.

    Paths are doubled: round i knows, of the nodes that the starts can reach, all pairs up to 2**i steps apart, so there are
    as many rounds as the logarithm of the depth, each a join and a checkpoint. cut: the walk ended here for its depth,
    though the node may lead on.
    """
    checkpoint_folder(edges.sparkSession)
    least = lambda df, *by: df.groupBy(*by).agg(F.min("depth").alias("depth"))
    steps = edges.where("target IS NOT NULL AND source <> target").select("source", "target", F.lit(1).alias("depth")).distinct().checkpoint()
    found = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct().checkpoint()
    known, reach = found.count(), 1
    while True:
        on = found.alias("f").join(steps.alias("s"), F.col("f.node") == F.col("s.source")).select("f.start", F.col("s.target").alias("node"), (F.col("f.depth") + F.col("s.depth")).alias("depth"))
        found = least(found.unionByName(on.where(F.col("depth") <= max_depth)), "start", "node").checkpoint()
        now, reach = found.count(), 2 * reach
        # Walks of less than `reach` steps are all known: none longer than the last round's, or all within the depth.
        if now == known or reach > max_depth:
            break
        known = now
        twice = steps.alias("a").join(steps.alias("b"), F.col("a.target") == F.col("b.source")).where("a.source <> b.target").select("a.source", F.col("b.target").alias("target"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        steps = least(steps.unionByName(twice), "source", "target").checkpoint()
    return found.where("depth > 0").withColumn("cut", F.col("depth") == max_depth)


def checkpoint_folder(spark: SparkSession) -> None:
    """Checkpoints need a folder that all executors see; a temporary one will do in local mode only."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="lexforge-"))


def both_directions(links: DataFrame) -> DataFrame:
    """(document_id, other_id) of symmetric links, without repeats."""
    return links.select(F.col("source").alias("document_id"), F.col("target").alias("other_id")).union(links.select("target", "source")).distinct()


def grouped_sections(edges: DataFrame, source: str, target: str, section: str) -> DataFrame:
    return edges.groupBy(source, target).agg(F.array_join(F.array_sort(F.collect_set(section)), ", ").alias("sections"))


def merged_length(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, covered): the length that a key's spans cover together."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(end).over(w), F.col(start))
    return spans.withColumn("_new", F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), reach))).groupBy(key).agg(F.sum("_new").cast("long").alias("covered"))
