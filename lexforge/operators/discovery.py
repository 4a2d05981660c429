"""Discovery of acts by grouped searches: what was found, what is wrong with it, and a manifest that is written only if nothing is."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.catalogue import discovery_decision
from lexforge.operators.terms import Relevance, score_relevance
from lexforge.sources import feeds


class CountsDiffer(Exception):
    """The searches did not find what they should have; no manifest was written."""


def problems_of(searches: DataFrame, records: DataFrame, expected: Mapping[str, int | None], expected_total: int | None = None) -> DataFrame:
    """(search, problem, found, wanted) of grouped searches, one row a problem; search is null for what concerns all.

    truncated: the page limit was reached; repeated_page: paging had no effect; count_mismatch: another number than
    expected; reported_mismatch: another than the source reported; overlap: ids that another search has too;
    total_mismatch: another number of different ids than expected.
    """
    spark = searches.sparkSession
    want = spark.createDataFrame([(s, n) for s, n in expected.items()], "search string, expected long")
    each = want.join(searches, "search", "full_outer").withColumn("records", F.coalesce("records", F.lit(0)).cast("long"))
    of = lambda test, name, wanted: F.when(test, F.struct(F.lit(name).alias("problem"), F.col("records").alias("found"), wanted.cast("long").alias("wanted")))
    found = F.array_compact(
        F.array(
            of(F.col("truncated"), "truncated", F.col("total")),
            of(F.col("problem").isNotNull(), "repeated_page", F.col("total")),
            of(F.col("expected") != F.col("records"), "count_mismatch", F.col("expected")),
            of(F.col("total") != F.col("records"), "reported_mismatch", F.col("total")),
        )
    )
    single = each.select("search", F.inline(found))
    # Ids that several searches have; of these the first search keeps them.
    doubled = records.select("id", "search").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("more"), F.count(F.lit(1)).alias("ids"))
    everywhere = F.array_compact(
        F.array(
            F.when(F.col("more") > 0, F.struct(F.lit("overlap").alias("problem"), F.col("more").alias("found"), F.lit(0).cast("long").alias("wanted"))),
            F.when(F.col("ids") != F.lit(expected_total), F.struct(F.lit("total_mismatch").alias("problem"), F.col("ids").alias("found"), F.lit(expected_total).cast("long").alias("wanted"))),
        )
    )
    return single.unionByName(doubled.select(F.lit(None).cast("string").alias("search"), F.inline(everywhere)))


def discover(spark: SparkSession, path: str, expected: Mapping[str, int | None], manifest: str | None = None, expected_total: int | None = None, allow: bool = False, most_pages: int = feeds.MOST_PAGES, page_size: int = feeds.PAGE_SIZE) -> DataFrame:
    """(id, search, record): the acts of recorded searches, each once, in the first search by name that has it.

    Raises CountsDiffer where counts differ, and writes no manifest then, unless that is allowed. expected: the number of
    acts of each search, None where it isn't known.
    """
    feeds.register(spark)
    read = lambda what: spark.read.format("paged_search").options(path=path, what=what, most_pages=most_pages, page_size=page_size).load()
    records = read("records")
    wrong = problems_of(read("searches"), records, expected, expected_total).collect()  # one row a problem of a search
    if wrong and not allow:
        raise CountsDiffer("; ".join(sorted(f"{r.search or 'all'}: {r.problem} ({r.found} found, {r.wanted} expected)" for r in wrong)))
    acts = records.groupBy("id").agg(F.min_by(F.struct("search", "record"), F.struct("search", "page", "position")).alias("r")).select("id", "r.*")
    if manifest is not None:
        acts.select("id", "search").write.mode("overwrite").csv(manifest, header=True)
    return acts


def decided(found: DataFrame, known: DataFrame, config: Relevance, key: str = "id", denied: str | None = None) -> DataFrame:
    """found (key, title, authority) with score, by title and authority alone, and decision; known: the keys that are stored or queued; denied: a pattern of titles that are left out."""
    scored = score_relevance(found, config)
    mine = known.select(key).distinct().withColumn("_known", F.lit(True))
    no = F.col("title").rlike(denied) if denied else F.lit(False)
    return scored.join(mine, key, "left").withColumn("decision", discovery_decision(F.col("_known").isNotNull(), F.coalesce(no, F.lit(False)), F.col("score"), config.relevant_at, config.possible_at)).drop("_known")
