"""Readers and writers around the engine: revision overlays, manifests, tolerant JSON records, JSON results."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def with_revisions(base: DataFrame, overlays: Sequence[DataFrame], key: str) -> DataFrame:
    """The latest row of each key; later overlays replace earlier rows. `revision` tells where a row comes from."""
    rows = base.withColumn("revision", F.lit(0))
    for n, o in enumerate(overlays, 1):
        rows = rows.unionByName(o.withColumn("revision", F.lit(n)), allowMissingColumns=True)
    others = [c for c in rows.columns if c not in (key, "revision")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "revision").alias("_r"), F.max("revision").alias("revision")).select(key, "_r.*", "revision")


def read_manifest(spark: SparkSession, path: str, columns: Sequence[str], key: str) -> DataFrame:
    """A CSV manifest: a byte order mark and `#` lines are skipped; of repeated keys the first line stays."""
    rows = spark.read.csv(path, header=True, comment="#", schema=", ".join(f"{c} STRING" for c in columns), enforceSchema=True)
    rows = rows.withColumn(columns[0], F.regexp_replace(columns[0], "^﻿", "")).withColumn("_line", F.monotonically_increasing_id())
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in columns if c != key]), "_line").alias("_r")).select(key, "_r.*").select(*columns)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def pick(record: str, names: Sequence[str]) -> Column:
    """The first of some keys of a JSON map column: by normalised key (letters and digits in lower case), else by a key that holds one.

    A value that is an object or a list gives its first plain value; empty values count as missing.
    """
    normal = F.map_from_entries(F.transform(F.map_entries(F.from_json(record, "map<string,string>")), lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "").alias("key"), _plain(e["value"]).alias("value"))))
    filled = F.map_filter(normal, lambda k, v: F.coalesce(v, F.lit("")) != "")
    wanted = ["".join(c for c in n.lower() if c.isalnum()) for n in names]
    exact = [F.try_element_at(filled, F.lit(n)) for n in wanted]
    inside = [_holding(filled, n) for n in wanted]
    return F.coalesce(*exact, *inside)


def _holding(values: Column, name: str) -> Column:
    return F.try_element_at(F.map_values(F.map_filter(values, lambda k, v: F.contains(k, F.lit(name)))), F.lit(1))


def _plain(value: Column) -> Column:
    """A nested value's first plain one: of {"name": "x"} it is x."""
    first = F.regexp_extract(value, r'[:\[,]\s*"?((?<=")[^"]*|[^"{}\[\],\s]+)"?', 1)
    return F.when(value.rlike(r"^\s*[{\[]"), first).otherwise(value)


# Names under which sources report a total, best first.
TOTALS = ("totalcount", "totalresults", "totalhits", "total", "count", "hits", "numberofresults", "resultcount")


def reported_total(payload: str) -> Column:
    """The total that a response reports under one of the known names, best name first, at most three levels deep; null without one."""
    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(_total).astype("Int64")

    return run(F.col(payload))


def _total(text: str | None) -> int | None:
    try:
        level = [json.loads(text or "")]
    except ValueError:
        return None
    found: dict[int, int] = {}
    for _ in range(3):
        below = []
        for node in level:
            for k, v in node.items() if isinstance(node, dict) else ():
                name = "".join(c for c in k.lower() if c.isalnum())
                number = v if isinstance(v, int) and not isinstance(v, bool) else int(v) if isinstance(v, str) and v.isdigit() else None
                if name in TOTALS and number is not None:
                    found.setdefault(TOTALS.index(name), number)
                elif isinstance(v, (dict, list)):
                    below.append(v)
            below += node if isinstance(node, list) else []
        level = below
    return found[min(found)] if found else None


def rendered(template: Mapping[str, str], values: Mapping[str, object]) -> dict[str, str]:
    """A request's parameters from a template with {placeholders}; what turns out empty is left out."""
    fill = lambda t: re.sub(r"\{(\w+)\}", lambda m: "" if values.get(m[1]) is None else str(values[m[1]]), t)
    return {k: v for k, t in template.items() if (v := fill(t).strip())}


def harvested(pages: DataFrame, most_pages: int) -> DataFrame:
    """(pages, records, truncated, problem) of a paged search: pages (page, n, size, total, digest) in order.

    It ends at an empty or short page, or when the reported total is reached; a page that repeats an earlier one is a
    fault; the page limit makes it truncated.
    """
    rows = pages.agg(F.sort_array(F.collect_list(F.struct("page", "n", "size", "total", "digest"))).alias("p"))  # one row a page of one search
    start = F.struct(F.lit(0).alias("pages"), F.lit(0).cast("long").alias("records"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("seen"), F.lit(None).cast("string").alias("problem"))

    def step(a: Column, p: Column) -> Column:
        on = ~a["done"] & a["problem"].isNull()
        again = on & F.array_contains(a["seen"], p["digest"]) & (p["n"] > 0)
        take = on & ~again
        records = a["records"] + F.when(take, p["n"]).otherwise(0)
        done = a["done"] | take & ((p["n"] < p["size"]) | F.coalesce(records >= p["total"], F.lit(False)))
        return F.struct((a["pages"] + F.when(take, 1).otherwise(0)).alias("pages"), records.cast("long").alias("records"), done.alias("done"), F.when(take, F.array_append(a["seen"], p["digest"])).otherwise(a["seen"]).alias("seen"), F.when(again, "repeated_page").otherwise(a["problem"]).alias("problem"))

    out = rows.select(F.aggregate(F.slice("p", 1, most_pages), start, step).alias("a"), F.size("p").alias("_n"))
    return out.select("a.pages", "a.records", (~F.col("a.done") & F.col("a.problem").isNull() & (F.col("a.pages") >= most_pages)).alias("truncated"), "a.problem")


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
