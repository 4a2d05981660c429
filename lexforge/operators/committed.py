"""Documents with versions, and a work queue with leases, in a store with commits (`sources.store`).

Nothing here trusts that it is alone: what is decided on a snapshot is committed only if that still holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.history import backoff_minutes, claimable, detect_changes
from lexforge.sources.store import Snapshot, Store, Table

#: Tables of documents: the current row, which points to its version, and all versions.
DOCUMENTS = {
    "documents": Table("source string, source_id string, title string, status string, content_hash string, metadata_hash string, current_version int, run string", ("source", "source_id")),
    "versions": Table("source string, source_id string, version_number int, content_hash string, content string, run string", ("source", "source_id", "version_number")),
    "failures": Table("source string, source_id string, run string, position long, problem string, retryable boolean", ("run", "position")),
}
QUEUE = {"queue": Table("id string, priority int, status string, claim_token string, worker string, attempt_count int, next_attempt_at timestamp, lease_expires_at timestamp, problem string", ("id",))}
MOST_ATTEMPTS = 5


def document_store(spark: SparkSession, path: str, buckets: int = 16) -> Store:
    return Store(spark, path, DOCUMENTS, buckets)


def queue_store(spark: SparkSession, path: str, buckets: int = 16) -> Store:
    return Store(spark, path, QUEUE, buckets)


def store_documents(store: Store, incoming: DataFrame, run: str, failures: DataFrame | None = None, info: Mapping | None = None) -> int:
    """Stores incoming documents (source, source_id, title, status, content, content_hash, metadata_hash), unique by key, as one commit.

    New and changed ones get a row in documents; where the content is new a version is appended, and the document points
    to it: no reader sees one without the other. Unchanged ones are not written. A run that is in the log already is not
    stored again, so a batch that is repeated after a lost driver does nothing. failures: rows of the table of failures.
    info: what else the log is to say of the run.
    """
    key = ["source", "source_id"]

    def decide(at: Snapshot) -> dict[str, DataFrame]:
        current = store.read("documents", at)
        found = detect_changes(current, incoming, key, "content_hash", "metadata_hash", "status").where("change <> 'unchanged'")
        numbered = found.join(current.select(*key, "current_version"), key, "left")
        fresh = F.col("change").isin("created", "content_updated")
        rows = numbered.withColumn("current_version", F.coalesce("current_version", F.lit(0)) + fresh.cast("int")).withColumn("run", F.lit(run))
        out = {"documents": rows, "versions": rows.where(fresh).withColumn("version_number", F.col("current_version"))}
        return out | ({"failures": failures.withColumn("run", F.lit(run))} if failures is not None else {})

    if any(i.get("run") == run for i in store.infos()):
        return store.snapshot().version
    # Versions of documents that nobody else has changed can't clash, so only documents are read.
    return store.change(decide, {"documents": None}, append=("versions", "failures"), info={"run": run} | dict(info or {}))


def enqueue(store: Store, wanted: DataFrame) -> int:
    """Adds ids (id, priority) that the queue doesn't have; known ones stay as they are."""

    def decide(at: Snapshot) -> dict[str, DataFrame]:
        new = wanted.dropDuplicates(["id"]).join(store.read("queue", at), "id", "left_anti")
        blank = {"status": F.lit("PENDING"), "claim_token": F.lit(None), "worker": F.lit(None), "attempt_count": F.lit(0), "next_attempt_at": F.lit(None), "lease_expires_at": F.lit(None), "problem": F.lit(None)}
        return {"queue": new.select("id", "priority").withColumns(blank)}

    return store.change(decide)


def claim(store: Store, worker: str, now: datetime, size: int = 25, lease_minutes: int = 30) -> str:
    """Takes the next claimable items (lowest priority number first, then what is due longest, then the id) for a worker; returns the token that they carry.

    Of two workers that choose the same items one commits; the other chooses again on what is then left.
    """
    if size < 1 or lease_minutes < 1:
        raise ValueError("a claim takes one item and one minute at least")
    token, at = f"{uuid.uuid4().hex}", F.lit(now)

    def decide(snapshot: Snapshot) -> dict[str, DataFrame]:
        order = [F.asc("priority"), F.asc_nulls_first("next_attempt_at"), F.asc("id")]
        due = claimable(store.read("queue", snapshot), at).orderBy(*order).limit(size)
        taken = {"status": F.lit("PROCESSING"), "claim_token": F.lit(token), "worker": F.lit(worker[:64]), "attempt_count": F.col("attempt_count") + 1}
        return {"queue": due.withColumns(taken | {"next_attempt_at": F.lit(None).cast("timestamp"), "lease_expires_at": at + F.make_interval(mins=F.lit(lease_minutes))})}

    store.change(decide, info={"claim": token})
    return token


def claimed(store: Store, token: str) -> DataFrame:
    """The items that a token holds."""
    return store.read("queue").where((F.col("claim_token") == token) & (F.col("status") == "PROCESSING"))


def finish(store: Store, token: str, results: DataFrame, now: datetime) -> DataFrame:
    """Ends claimed items by results (id, ok, retryable, problem); returns (id, refused).

    An item whose token is another by now is refused and not changed: its lease ran out and somebody else has it. Failures
    are tried again after a wait that grows threefold, until MOST_ATTEMPTS, and at once given up if not retryable.
    """
    results = results.select("id", F.col("ok").alias("_ok"), F.coalesce("retryable", F.lit(True)).alias("_again"), F.col("problem").alias("_problem"))

    seen = []

    def held(at: Snapshot) -> DataFrame:
        return store.read("queue", at).where((F.col("claim_token") == token) & (F.col("status") == "PROCESSING"))

    def decide(at: Snapshot) -> dict[str, DataFrame]:
        seen.append(at)
        mine = held(at).join(results, "id")
        again = ~F.col("_ok") & F.col("_again") & (F.col("attempt_count") < MOST_ATTEMPTS)
        wait = F.lit(now) + F.make_interval(mins=backoff_minutes(F.col("attempt_count")).cast("int"))
        changed = {"status": F.when(F.col("_ok"), "DONE").when(again, "RETRY").otherwise("FAILED"), "next_attempt_at": F.when(again, wait), "lease_expires_at": F.lit(None).cast("timestamp"), "problem": F.when(~F.col("_ok"), F.col("_problem"))}
        return {"queue": mine.withColumns(changed)}

    store.change(decide, info={"finish": token})
    return results.select("id").join(held(seen[-1]).select("id", F.lit(True).alias("_mine")), "id", "left").select("id", F.col("_mine").isNull().alias("refused"))
