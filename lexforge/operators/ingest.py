"""Ingest and queue steps as set operations: what is stored, how it is found, and how queued work moves on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import content_hash, fold
from lexforge.operators.history import backoff_minutes, hash_of

STORE_AT = 30
STATES = ("PENDING", "PROCESSING", "RETRY", "DONE", "FAILED", "SKIPPED")


def storable(scored: DataFrame, overrides: DataFrame, key: str, score: str, at: int = STORE_AT) -> DataFrame:
    """scored rows that are stored: those that reach `at`, and every row with a curated decision; with the decision."""
    joined = scored.join(overrides.select(key, "decision"), key, "left")
    return joined.where((F.col(score) >= at) | F.col("decision").isNotNull())


def search_text(columns: Sequence[str], body: str) -> Column:
    """One folded text of the short fields and the body, for lexical search."""
    return fold(F.concat_ws(" ", *[F.col(c) for c in (*columns, body)]))


def hashed(docs: DataFrame, content: str, metadata: Sequence[str]) -> DataFrame:
    return docs.withColumns({"content_hash": content_hash(F.col(content)), "metadata_hash": hash_of(*metadata)})


def reconcile_links(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, action): what happens to each link: add, update, keep or remove."""
    both = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_was")).join(new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_is")), list(keys), "full_outer")
    return both.select(*keys, F.when(F.col("_was").isNull(), "add").when(F.col("_is").isNull(), "remove").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update").alias("action"))


def enqueue(queue: DataFrame, wanted: DataFrame, key: str, again: Sequence[str] = ()) -> DataFrame:
    """The queue with the wanted keys: new ones are pending, known ones stay unless their state is in `again`."""
    marked = queue.join(wanted.select(key).distinct().withColumn("_wanted", F.lit(True)), key, "full_outer")
    restart = F.col("status").isNull() | F.col("_wanted") & F.col("status").isin(list(again))
    return marked.withColumn("attempt_count", F.when(restart, 0).otherwise(F.col("attempt_count"))).withColumn("status", F.when(restart, "PENDING").otherwise(F.col("status"))).drop("_wanted")


def finished(claimed: DataFrame, results: DataFrame, key: str, now: Column, most: int = 5) -> DataFrame:
    """claimed items after their results (key, claim_token, ok): a token that no longer fits changes nothing; failures wait longer each time, and end after `most`."""
    joined = claimed.join(results.select(key, F.col("claim_token").alias("_token"), "ok"), key, "left")
    mine = F.coalesce(F.col("_token") == F.col("claim_token"), F.lit(False)) & (F.col("status") == "PROCESSING")
    tries = F.col("attempt_count") + 1
    status = F.when(~mine, F.col("status")).when(F.col("ok"), "DONE").when(tries >= most, "FAILED").otherwise("RETRY")
    wait = F.when(mine & ~F.col("ok") & (tries < most), now + F.make_interval(mins=backoff_minutes(tries).cast("int")))
    return joined.select(key, status.alias("status"), F.when(mine, tries).otherwise(F.col("attempt_count")).alias("attempt_count"), F.when(~mine, F.col("claim_token")).alias("claim_token"), wait.alias("next_attempt_at"))
