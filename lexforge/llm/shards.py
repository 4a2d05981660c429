"""Balanced shards by global prefix sums of bytes, with DataFrame operations only.

Law `bytes`: shard sizes are near equal. Documents are laid in one global order, whose prefix sums of bytes come from the
totals of hash partitions and the sums inside each, and the order is cut at equal targets, so that each shard is a
contiguous piece of it. Documents with equal texts stay in one shard: a group is a unit of the order, of three kinds.

- Large groups, above 1/`FINE` of all bytes or rows but at most half a shard (fewer than 2 * `FINE` exist), could lie
  across a cut and unbalance it. So the order gives them the heads of the shards' pieces, in a serpentine, largest first.
- All others follow in hash order: a unit goes where its middle falls between the cuts, which are the targets less what
  the heads take.
- Groups above half a shard (fewer than 2 * `shards`) can't stay whole under this law: one of a third of all bytes would
  make its shard 5.3 times as large as the mean of 16. Their documents are units each.

Slots are gapless from 0 in each shard and come from counts by (shard, slice) in the same way. No window spans more than a
hash partition, and the tables of totals have a bounded or slice-sized number of rows.

Defined cases: null text: as empty, size 1; repeated rows: each placed, with a slot of its own; null doc_id: allowed; ties
in a slot's order: by the number of the row; fewer documents than shards: some shards stay empty; no rows: no rows; texts
are read whole; other columns, whatever their names, pass through, but those named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import Workspace

FINE = 3200
#: Hash partitions of units, and rows meant for a slice when slots are counted.
PARTITIONS, SLICE_ROWS = 4096, 50_000


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without `text`, with size (UTF-8 bytes + 1) and text_crc32."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"size": F.octet_length(t).cast("long") + 1, "text_crc32": F.crc32(t.cast("binary"))}).drop(text)


def balanced(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without `text`, with size, text_crc32, shard (0 to shards - 1) and slot."""
    space = Workspace(docs.sparkSession, "shards")
    kept = [c for c in docs.columns if c not in (text, "size", "text_crc32", "shard", "slot")]
    # The caller's columns wait in a struct, so that no name can clash.
    base = docs.select(F.struct(*kept).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("t"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("number"))
    base = space.write(sized(base, "t"), "base")
    total = base.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    target = total["bytes"] / shards
    same = ["h", "text_crc32", "size"]
    groups = space.write(base.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).withColumn("bytes", F.col("n") * F.col("size")), "groups")
    heavy = (F.col("bytes") * FINE > total["bytes"]) | (F.col("n") * FINE > total["n"])
    giant = F.col("bytes") * 2 > F.lit(target)
    # Large groups: fewer than 2 * FINE by the bounds above, so one window and a broadcast are safe.
    rank = F.row_number().over(Window.orderBy(F.desc("bytes"), *same)) - 1
    turn = F.pmod(rank, F.lit(2 * shards))
    large = space.write(groups.where(heavy & ~giant & (F.col("n") > 1)).withColumn("shard", F.when(turn < shards, turn).otherwise(2 * shards - 1 - turn).cast("int")).select(*same, "bytes", "shard"), "large")
    giants = space.write(groups.where(giant & (F.col("n") > 1)).select(*same, F.lit(True).alias("giant")), "giants")
    space.drop("groups")
    # What large groups leave of each target; a shard above its target takes nothing more and the others share the rest.
    used = {r["shard"]: r["b"] for r in large.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    room = [max(0.0, target - used.get(s, 0)) for s in range(shards)]
    left = total["bytes"] - sum(used.values())
    scale = left / sum(room) if sum(room) else 0.0
    ends, at = [], 0.0
    for r in room:
        at += r * scale
        ends.append(at)

    marked = base.join(F.broadcast(large.select(*same, F.col("shard").alias("fixed"))), same, "left").join(F.broadcast(giants), same, "left")
    # A unit: a group, or a document of a giant group.
    marked = marked.withColumn("unit", F.when(F.col("giant"), F.xxhash64(*same, "number")).otherwise(F.xxhash64(*same)))
    columns = ["row", "id", "number", "size", "text_crc32"]
    fixed = marked.where(F.col("fixed").isNotNull()).select(*columns, F.col("fixed").alias("shard"))
    free = marked.where(F.col("fixed").isNull())
    part = F.shiftrightunsigned(F.col("unit"), 52).cast("int")
    units = space.write(free.groupBy("unit").agg(F.sum("size").alias("bytes")).withColumn("part", part), "units")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = units.groupBy("part").agg(F.sum("bytes").alias("b"))  # at most PARTITIONS rows
    starts = totals.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("start"))
    inside = F.sum("bytes").over(Window.partitionBy("part").orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = F.col("start") + F.col("inside") - F.col("bytes") / 2
    shard = sum([F.when(middle >= F.lit(e), 1).otherwise(0) for e in ends[:-1]], F.lit(0))
    placed = space.write(units.withColumn("inside", inside).join(F.broadcast(starts), "part").select("unit", F.least(shard, F.lit(shards - 1)).cast("int").alias("shard")), "placed")
    dealt = free.select(*columns, "unit").join(placed.hint("merge"), "unit")
    numbered = slotted(fixed.unionByName(dealt.select(*fixed.columns)), max(1, -(-total["n"] // (shards * SLICE_ROWS))), space)
    space.drop("base", "large", "giants", "units", "placed")
    return numbered.select(*[F.col("row")[c].alias(c) for c in kept], "size", "text_crc32", "shard", "slot")


def slotted(rows: DataFrame, slices: int, space: Workspace) -> DataFrame:
    """rows with `slot`, gapless from 0 in each shard."""
    keys = ["id", "text_crc32", "size", "number"]
    rows = space.write(rows.withColumn("slice", F.pmod(F.xxhash64("id", "number"), F.lit(max(slices, 64))).cast("int")), "rows")
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "slice", first.alias("first"))
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy("shard", "slice").orderBy(*keys)) - 1)
    return numbered.join(offsets.hint("merge"), ["shard", "slice"]).withColumn("slot", (F.col("first") + F.col("place")).cast("long"))
