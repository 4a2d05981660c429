"""Queries of the listings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import listing as L


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def catalogue_search(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").where(L.contains_text("R#00000001", "c_name", "c_mktsegment")).select("c_custkey", "c_name")


def pending_embedding(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _t(spark, sf, "part").select("p_partkey", (k % 5).alias("version"), F.when(k % 3 > 0, k % 4).alias("embedded"), F.when(k % 7 > 0, "m1").alias("model"))
    return rows.where(L.pending_vectors(F.col("version"), F.col("embedded"), F.col("model"), "m1")).select("p_partkey")


def best_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return L.best_paragraphs(lines, "doc_id", "line", "text", ["the", "nicht", "que"]).select("doc_id", "line", "score", "n")


BEST_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
s AS (SELECT doc_id, line::INT AS line, (CASE WHEN contains(lower(t), 'the') THEN 10 ELSE 0 END + (length(lower(t)) - length(replace(lower(t), 'the', ''))) // 3
  + CASE WHEN contains(lower(t), 'nicht') THEN 10 ELSE 0 END + (length(lower(t)) - length(replace(lower(t), 'nicht', ''))) // 5
  + CASE WHEN contains(lower(t), 'que') THEN 10 ELSE 0 END + (length(lower(t)) - length(replace(lower(t), 'que', ''))) // 3)::INT AS score FROM l)
SELECT doc_id, line, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line)::INT AS n FROM s WHERE score > 0 QUALIFY n <= 3
"""


def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of one customer with one priority, the dearest first."""
    return L.first_of_duplicates(_t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), ["o_custkey", "o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "duplicate")


def type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    ev = _t(spark, sf, "events")
    return L.histogram_difference(ev.where("event_type <> 'view'"), ev.where("value > 50 AND event_type <> 'click'"), "event_type")


def core_orders(spark: SparkSession, sf: str) -> DataFrame:
    """First hundred orders by status, priority, price (a listing's limit)."""
    listed = L.core_listing(_t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", (["P", "O"], ["1-URGENT", "5-LOW"]), "o_totalprice", "o_orderkey", 100)
    return listed.select("o_orderkey", "o_orderstatus")


QUERIES = (catalogue_search, pending_embedding, best_lines, duplicates, type_histogram, core_orders)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "catalogue_search": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#00000001') OR contains(lower(c_mktsegment), 'r#00000001')",
        "pending_embedding": "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 <> p_partkey % 5 OR p_partkey % 7 = 0",
        "best_lines": BEST_SQL,
        "duplicates": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) > 1 AS duplicate FROM orders",
        "type_histogram": "SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0) AS stored, coalesce(b.n, 0) AS expected FROM (SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1) a FULL JOIN (SELECT event_type, count(*) AS n FROM events WHERE value > 50 AND event_type <> 'click' GROUP BY 1) b ON a.event_type = b.event_type",
        "core_orders": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100",
    }
