"""Points in spans: a sweep over positions instead of a join of every point with every span of its document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a cell: documents are swept cell by cell, so a long one is work for many tasks.
CELL = 10_000


def containing(points: DataFrame, spans: DataFrame, key: str, position: str, start: str, end: str, carried: Sequence[str], name: str = "span") -> DataFrame:
    """points with `name`: a struct of the carried columns of the span (start to end, the end excluded) of the same key that holds the position, or null.

    Spans of a key don't overlap. They are cut at the borders of cells; in each cell starts of spans and points are put
    in one order, in which the last span that began before a point is the only one that can hold it.
    """
    held = F.struct(F.col(end).cast("long").alias("_end"), *[F.col(c) for c in carried])
    first, last = F.floor(F.col(start) / CELL), F.floor((F.col(end) - 1) / CELL)
    begun = spans.where(F.col(end) > F.col(start)).select(F.col(key).alias("_key"), F.explode(F.sequence(first, last)).alias("_cell"), F.col(start).cast("long").alias("_start"), held.alias("_span"))
    begun = begun.select("_key", "_cell", F.greatest("_start", F.col("_cell") * CELL).alias("_at"), F.lit(0).alias("_kind"), "_span", F.lit(None).alias("_row"))
    asked = points.select(F.col(key).alias("_key"), F.floor(F.col(position) / CELL).alias("_cell"), F.col(position).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).alias("_span"), F.struct(*[F.col(c) for c in points.columns]).alias("_row"))
    both = begun.select(*[F.col(c) if c != "_row" else F.col(c).cast(asked.schema["_row"].dataType).alias(c) for c in begun.columns]).unionByName(asked.withColumn("_span", F.col("_span").cast(begun.schema["_span"].dataType)))
    sweep = Window.partitionBy("_key", "_cell").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_last", F.last("_span", ignorenulls=True).over(sweep)).where("_kind = 1")
    inside = F.when(F.col("_at") < F.col("_last._end"), F.struct(*[F.col(f"_last.{c}").alias(c) for c in carried]))
    return seen.select("_row.*", inside.alias(name))
