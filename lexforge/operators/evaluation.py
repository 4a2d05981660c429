"""Retrieval quality: recall, precision, reciprocal rank and nDCG of ranked lists against graded queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, n_relevant, hits, recall, precision, reciprocal_rank, ndcg) for every query with relevant documents. ranked: (query, doc, position from 1)."""
    found = relevant.select(query, doc).distinct()
    hits = found.join(ranked.where(F.col("position") <= k), [query, doc], "left")
    gain = F.when(F.col("position").isNotNull(), 1 / F.log2(F.col("position") + 1.0))
    per = hits.groupBy(query).agg(F.count(F.lit(1)).alias("n_relevant"), F.count("position").alias("hits"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"), F.coalesce(1.0 / F.min("position"), F.lit(0.0)).alias("reciprocal_rank"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.select(query, "n_relevant", "hits", (F.col("hits") / F.col("n_relevant")).alias("recall"), (F.col("hits") / F.lit(float(k))).alias("precision"), "reciprocal_rank", (F.col("dcg") / ideal).alias("ndcg"))


def averages(per_query: DataFrame, mode: str) -> DataFrame:
    return per_query.groupBy(mode).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg("ndcg").alias("ndcg"),
        F.count_if(F.col("recall") == 1).alias("fully_covered"),
        F.count_if(F.col("hits") > 0).alias("any_hit"),
    )


def controls(queries: DataFrame, relevant: DataFrame, ranked: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, passed) of the queries without relevant documents: they pass if nothing is found."""
    graded = relevant.select(query).distinct()
    found = ranked.select(query).distinct().withColumn("_found", F.lit(True))
    return queries.select(query).join(graded, query, "left_anti").join(found, query, "left").select(query, F.col("_found").isNull().alias("passed"))


def missed(ranked: DataFrame, relevant: DataFrame, k: int = 10, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, missed): relevant documents that aren't among the first k, sorted; queries that miss none have an empty list."""
    got = ranked.where(F.col("position") <= k).select(query, doc).withColumn("_hit", F.lit(True))
    both = relevant.select(query, doc).distinct().join(got, [query, doc], "left")
    return both.groupBy(query).agg(F.array_sort(F.collect_list(F.when(F.col("_hit").isNull(), F.col(doc)))).alias("missed"))


def missing_from_corpus(relevant: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc) of graded documents that the corpus lacks."""
    return relevant.select(doc).distinct().join(docs.select(doc), doc, "left_anti")


def pooled(runs: DataFrame, depth: int = 10, query: str = "query_id", doc: str = "doc_id", mode: str = "mode") -> DataFrame:
    """(query, doc, modes, best_position): what any mode found among its first `depth`, for people to grade."""
    return runs.where(F.col("position") <= depth).groupBy(query, doc).agg(F.array_sort(F.collect_set(mode)).alias("modes"), F.min("position").alias("best_position"))


def read_eval_set(path: str) -> dict:
    """A set of graded queries in YAML: corpus, description, queries of (query, intent, relevant, tags, notes); a query given twice is refused."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    queries = data.get("queries") or []
    normal = [" ".join(str(q.get("query", "")).lower().split()) for q in queries]
    if not all(normal) or len(set(normal)) < len(normal):
        raise ValueError("every query needs a text, and each only once")
    return data


def eval_frames(spark: SparkSession, data: dict) -> tuple[DataFrame, DataFrame]:
    """(queries, relevant) of an evaluation set."""
    queries = [(i, q["query"], q.get("intent"), list(q.get("tags") or []), q.get("notes")) for i, q in enumerate(data["queries"])]
    graded = [(i, str(r)) for i, q in enumerate(data["queries"]) for r in q.get("relevant") or []]
    return spark.createDataFrame(queries, "query_id int, query string, intent string, tags array<string>, notes string"), spark.createDataFrame(graded, "query_id int, doc_id string")


def write_scaffold(pool: DataFrame, path: str, query: str = "query_id", doc: str = "doc_id") -> None:
    """Pooled candidates as CSV with an empty column for the reviewer's mark."""
    rows = pool.withColumn("modes", F.array_join("modes", " ")).withColumn("relevant", F.lit(""))
    rows.orderBy(query, "best_position", doc).coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_scaffold(spark: SparkSession, path: str, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, relevant): the marked documents of each query, in order; a mark is anything that says yes."""
    rows = spark.read.csv(path, header=True)
    yes = F.lower(F.trim(F.coalesce("relevant", F.lit("")))).isin("1", "x", "y", "yes", "ja", "j", "true")
    return rows.groupBy(query).agg(F.array_sort(F.collect_set(F.when(yes, F.col(doc)))).alias("relevant"))
