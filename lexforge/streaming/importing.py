"""Import of documents by batches: each is one commit, documents that fail go aside, and a run of failures stops the import.

A batch's documents have positions. Those with a problem become rows of `failures`, with all others stored in the same
commit, so that one bad document neither stops the rest nor gets lost. A batch that is repeated, as after a lost driver, is
found in the log by its number and does nothing. If so many documents fail one after the other, over batches too, the
source is probably down: what came before the last of them is stored, the rest is not, and the import stops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import content_hash
from lexforge.operators.committed import store_documents
from lexforge.operators.history import hash_of
from lexforge.sources.store import Store

MOST_IN_A_ROW = 25
METADATA = ("title", "status")


class TooManyFailures(Exception):
    """So many documents in a row failed that the import was stopped."""


def problem_of() -> Column:
    """What is wrong with a document (source_id, title, content), or null."""
    return (
        F.when(F.coalesce(F.trim("source_id"), F.lit("")) == "", "no_id")
        .when(F.coalesce(F.trim("title"), F.lit("")) == "", "no_title")
        .when(F.col("content").isNull(), "no_content")
    )


def stop_at(rows: DataFrame, position: str, failed: str, most: int = MOST_IN_A_ROW, carried: int = 0) -> tuple[int | None, int]:
    """(the position of the failure that is the `most`-th in a row, or null; the failures in a row at the end).

    carried: failures in a row just before these rows. Rows are dealt by ranges of positions; each range says where its
    failures begin and end, in one row of at most `most` positions, and these rows are put together in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, lead, tail, inside, clean = None, [], 0, None, False
        for b in batches:
            for p, f in zip(b["p"].tolist(), b["f"].tolist(), strict=True):
                first = p if first is None else first
                tail = tail + 1 if f else 0
                clean |= not f
                if f and not clean and len(lead) < most:
                    lead.append(p)
                if f and clean and tail == most and inside is None:
                    inside = p
        if first is not None:
            yield pd.DataFrame({"first": [first], "lead": [lead], "tail": [tail], "inside": pd.array([inside], "Int64"), "clean": [clean]})

    ordered = rows.select(F.col(position).cast("long").alias("p"), F.col(failed).alias("f")).repartitionByRange("p").sortWithinPartitions("p")
    for r in sorted(ordered.mapInPandas(run, "first long, lead array<long>, tail long, inside long, clean boolean").collect(), key=lambda r: r.first):
        if carried + len(r.lead) >= most:
            return r.lead[max(0, most - carried - 1)], most
        if r.inside is not None:
            return r.inside, most
        carried = r.tail if r.clean else carried + r.tail
    return None, carried


def import_batch(store: Store, batch: DataFrame, run: str, problem: Column, position: str = "position", most: int = MOST_IN_A_ROW) -> int:
    """Stores a batch (source, source_id, title, status, content, position) as one commit under the name `run`; returns the store's version.

    Raises TooManyFailures, after the commit, where the import is to stop.
    """
    done = store.infos()
    if any(i.get("run") == run for i in done):
        return store.snapshot().version
    judged = batch.withColumn("problem", problem)
    carried = next((i["failing"] for i in reversed(done) if "failing" in i), 0)
    stop, failing = stop_at(judged.select(F.col(position).alias("_p"), F.col("problem").isNotNull().alias("_f")), "_p", "_f", most, carried)
    if stop is not None:
        judged = judged.where(F.col(position) <= stop)
    good = judged.where("problem IS NULL").withColumns({"content_hash": content_hash(F.col("content")), "metadata_hash": hash_of(*METADATA)})
    # Of a document that comes twice in a batch the last one counts.
    newest = good.groupBy("source", "source_id").agg(F.max_by(F.struct("title", "status", "content", "content_hash", "metadata_hash"), position).alias("_r")).select("source", "source_id", "_r.*")
    bad = judged.where("problem IS NOT NULL").select("source", "source_id", F.col(position).cast("long").alias("position"), "problem", (F.col("problem") == "no_content").alias("retryable"))
    version = store_documents(store, newest, run, bad, {"failing": 0 if stop is not None else failing})
    if stop is not None:
        raise TooManyFailures(f"{most} documents in a row failed, the last at position {stop}; the source is probably down")
    return version


def import_stream(stream: DataFrame, store: Store, name: str, checkpoint: str, problem: Callable[[], Column] = problem_of):
    """Imports what a stream has (source, source_id, title, status, content, position) batch by batch, then ends."""

    def write(batch: DataFrame, number: int) -> None:
        import_batch(store, batch, f"{name}-{number}", problem())

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
