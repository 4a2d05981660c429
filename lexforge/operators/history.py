"""Versions, change detection, event folds, the work queue and rights, all as set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import percent


def hash_of(*columns: str) -> Column:
    """SHA-256 over columns, null as empty."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def detect_changes(current: DataFrame, incoming: DataFrame, key: Sequence[str], content: str, metadata: str, status: str) -> DataFrame:
    """incoming with change: created, content_updated, status_changed, metadata_updated or unchanged; content first, status before metadata."""
    old = current.select(*key, F.col(content).alias("_content"), F.col(metadata).alias("_metadata"), F.col(status).alias("_status"), F.lit(True).alias("_known"))
    joined = incoming.join(old, list(key), "left")
    change = (
        F.when(F.col("_known").isNull(), "created")
        .when(~F.col(content).eqNullSafe(F.col("_content")), "content_updated")
        .when(~F.col(status).eqNullSafe(F.col("_status")), "status_changed")
        .when(~F.col(metadata).eqNullSafe(F.col("_metadata")), "metadata_updated")
        .otherwise("unchanged")
    )
    return joined.withColumn("change", change).drop("_content", "_metadata", "_status", "_known")


def append_versions(versions: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """(key, version_number, content_hash): versions with one more for every changed row, numbered on from the last."""
    last = versions.groupBy(key).agg(F.max("version_number").alias("_last"))
    new = changed.join(last, key, "left").select(key, (F.coalesce("_last", F.lit(0)) + 1).alias("version_number"), "content_hash")
    return versions.select(key, "version_number", "content_hash").unionByName(new)


def latest(events: DataFrame, key: Sequence[str], by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last row of each key; kept by a partial aggregate, so nothing is sorted or gathered by key."""
    return events.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*by)).alias("_r")).select(*key, "_r.*")


def previous(events: DataFrame, key: Sequence[str], by: Sequence[str], column: str) -> DataFrame:
    return events.withColumn("previous", F.lag(column).over(Window.partitionBy(*key).orderBy(*by)))


def effective(docs: DataFrame, overrides: DataFrame, key: str, engine: str) -> DataFrame:
    """docs with effective: the override's decision (`include`, `exclude`) before the engine's."""
    return docs.join(overrides.select(key, "decision"), key, "left").withColumn("effective", F.coalesce(F.col("decision") == "include", F.col(engine)))


def claimable(queue: DataFrame, now: Column) -> DataFrame:
    """Pending items, retries that are due, and items whose lease ran out."""
    return queue.where((F.col("status") == "PENDING") | (F.col("status") == "RETRY") & (F.col("next_attempt_at") <= now) | (F.col("status") == "PROCESSING") & (F.col("lease_expires_at") <= now))


def backoff_minutes(attempt: Column) -> Column:
    return F.least(5 * F.pow(F.lit(3), attempt - 1), F.lit(360.0))


def fold_queries(log: DataFrame, query: str, at: str, results: str) -> DataFrame:
    """One row per normalised query: occurrences, last and best number of results."""
    normal = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(query), F.lit("")), r"\s+", " ")))
    return log.withColumn("query_hash", F.sha2(normal, 256)).groupBy("query_hash").agg(F.count(F.lit(1)).alias("occurrences"), F.max_by(results, F.struct(at, results)).alias("last_result_count"), F.max(results).alias("best_result_count"))


def zero_filled(counts: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by a column's listed values, in that order, zero where there are none."""
    listed = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(v).alias(column)) for i, v in enumerate(values)])
    every = counts.sparkSession.range(1).select(F.inline(listed))
    return every.join(counts.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select("position", column, F.coalesce("n", F.lit(0)).alias("n"))


def with_total(counts: DataFrame, column: str) -> DataFrame:
    """zero_filled() counts and a last row TOTAL."""
    total = counts.agg((F.max("position") + 1).alias("position"), F.lit("TOTAL").alias(column), F.sum("n").alias("n"))
    return counts.unionByName(total)


def log_totals(log: DataFrame) -> DataFrame:
    """Totals of a folded query log: queries, searches, those never answered, those asked again."""
    return log.agg(F.count(F.lit(1)).alias("queries"), F.sum("occurrences").alias("searches"), F.count_if(F.col("best_result_count") == 0).alias("without_results"), F.count_if(F.col("occurrences") > 1).alias("repeated"))


def popular(log: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The queries asked most, of those that find something."""
    return log.where("last_result_count > 0").orderBy(F.desc("occurrences"), key).limit(limit)


def unanswered(log: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The queries asked most, of those that find nothing now."""
    return log.where("last_result_count = 0").orderBy(F.desc("occurrences"), key).limit(limit)


def index_coverage(docs: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """(documents, indexed, percent): how much of the corpus has chunks."""
    have = indexed.select(key).distinct().withColumn("_has", F.lit(True))
    both = docs.select(key).join(have, key, "left").agg(F.count(F.lit(1)).alias("documents"), F.count("_has").alias("indexed"))
    return both.withColumn("percent", percent(F.col("indexed"), F.col("documents")))


def permitted(evidence: DataFrame, action: str, at: Column) -> Column:
    """Whether the latest evidence of a source allows an action now."""
    return (F.col("state") == "approved") & F.col("reviewer").isNotNull() & F.col("evidence_url").startswith("https://") & (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)) & F.array_contains("actions", action) & (F.size(F.coalesce("conditions", F.array().cast("array<string>"))) == 0)
