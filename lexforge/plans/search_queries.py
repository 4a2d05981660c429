"""Queries of the search, rule, history and relation operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.operators import applicability as A
from lexforge.operators import evaluation as E
from lexforge.operators import history as H
from lexforge.operators import hybrid as Y
from lexforge.operators import relations as G
from lexforge.operators import search as S


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").withColumn("title", F.substring_index("text", "\n", 1))


def search_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """Top 200 documents for a two-word query (a top-k report)."""
    return S.lexical_candidates(_titled(spark, sf), "the and", "doc_id", "title", "text")


LEXICAL = """
lex AS (
  SELECT doc_id, lexical_score, row_number() OVER (ORDER BY lexical_score DESC, doc_id)::INT AS lexical_position FROM (
    SELECT doc_id, (CASE WHEN contains(t, 'the') THEN 10 ELSE 0 END + CASE WHEN contains(b, 'the') THEN 1 ELSE 0 END
         + CASE WHEN contains(t, 'and') THEN 10 ELSE 0 END + CASE WHEN contains(b, 'and') THEN 1 ELSE 0 END)::INT AS lexical_score
    FROM (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS t, lower(text) AS b FROM documents)
    WHERE (contains(t, 'the') OR contains(b, 'the')) AND (contains(t, 'and') OR contains(b, 'and')))
  QUALIFY lexical_position <= 200)
"""


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return [float(x) for x in _t(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]]


def search_semantic(spark: SparkSession, sf: str) -> DataFrame:
    """Best chunk per document and top 200 documents for one vector; five chunks make a document here."""
    chunks = _t(spark, sf, "embeddings").withColumn("doc_id", F.col("vec_id") - F.col("vec_id") % 5)
    return S.semantic_candidates(chunks, _query_vector(spark, sf), "doc_id", "vec_id", "embedding").withColumn("similarity", F.bround("similarity", 5))


SEMANTIC = """
sem AS (
  SELECT doc_id, similarity, best_chunk, row_number() OVER (ORDER BY similarity DESC, doc_id)::INT AS semantic_position FROM (
    SELECT doc_id, max(s) AS similarity, arg_max(vec_id, s) AS best_chunk FROM (
      SELECT e.vec_id - e.vec_id % 5 AS doc_id, e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS s
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
    WHERE s >= 0 GROUP BY doc_id) QUALIFY semantic_position <= 200)
"""


def search_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Both legs merged, ranked by the weighted score with rule factors, first page of 20 (a page is the feature)."""
    chunks = _t(spark, sf, "embeddings").withColumn("doc_id", F.col("vec_id") - F.col("vec_id") % 5)
    both = S.merge_candidates(search_lexical(spark, sf), S.semantic_candidates(chunks, _query_vector(spark, sf), "doc_id", "vec_id", "embedding"), "doc_id")
    known = both.join(_t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    scored = known.withColumns({"authority": F.when(F.col("lang") == "en", 0.9).otherwise(0.6), "scope": F.lit(0.55), "relevance": F.lit(40.0), "status": F.lit(1.0)})
    ranked = S.final_rank(scored, "doc_id", F.array(F.when(F.col("lang") == "en", 1.35).otherwise(1.0), F.when(F.col("lang") == "fr", 0.1).otherwise(1.0)))
    return S.page(ranked.select("doc_id", "rank", F.bround("base", 6).alias("base"), F.bround("final", 6).alias("final")), [F.asc("rank")], 1, 20)


HYBRID_SQL = f"""
WITH {LEXICAL}, {SEMANTIC}, b AS (
  SELECT coalesce(lex.doc_id, sem.doc_id) AS doc_id, lexical_position AS lp, semantic_position AS sp FROM lex FULL OUTER JOIN sem ON lex.doc_id = sem.doc_id
), s AS (
  SELECT doc_id, 0.40 * CASE WHEN lp >= 1 THEN 12 / (12 + lp - 1.0::DOUBLE) ELSE 0.0 END + 0.25 * CASE WHEN sp >= 1 THEN 12 / (12 + sp - 1.0::DOUBLE) ELSE 0.0 END
       + 0.15 * CASE WHEN lang = 'en' THEN 0.9 ELSE 0.6 END + 0.10 * 0.55 + 0.05 * 0.4 + 0.05 AS base,
       greatest(0.2, CASE WHEN lang = 'en' THEN 1.35 ELSE 1.0 END * CASE WHEN lang = 'fr' THEN 0.1 ELSE 1.0 END) AS m
  FROM b JOIN documents USING (doc_id))
SELECT doc_id, row_number() OVER (ORDER BY base * m DESC, doc_id)::INT AS rank, round_even(base::DOUBLE, 6) AS base, round_even((base * m)::DOUBLE, 6) AS final FROM s QUALIFY rank <= 20
"""


PINNING = Y.Config(groups={"none": ["zzzz"]}, broad_words=["the"], key="doc_id", body="text")


def _acts_of(docs: DataFrame) -> DataFrame:
    """Documents as acts: numbers repeat, every fourth is historic, every tenth repeals."""
    k, lang = F.col("doc_id"), F.col("lang")
    return docs.withColumns(
        {
            "document_number": (k % 50).cast("string"), "document_type": F.lit("BEK"), "published_date": F.date_add(F.lit("2000-01-01").cast("date"), (k % 900).cast("int")),
            "status": F.when(k % 4 == 0, "Historisk").otherwise("Gældende"), "source_id": F.lit(None).cast("string"), "law_class": F.when(lang == "de", "special").when(lang == "fr", "support").otherwise("core"),
            "niches": F.array().cast("array<string>"), "repeal": k % 10 == 0, "authority": F.when(lang == "en", 0.9).otherwise(0.6), "scope": F.lit(0.55), "relevance": F.lit(40.0),
        }
    )


def search_with_references(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search: the acts with number 7 first, then both legs for the other words under the rules of a broad query (first 30: a page)."""
    chunks = _t(spark, sf, "embeddings").select((F.col("vec_id") - F.col("vec_id") % 5).alias("doc_id"), F.col("vec_id").alias("chunk"), "embedding")
    answer = Y.hybrid(_acts_of(_titled(spark, sf)), chunks, "nr. 7 the and", _query_vector(spark, sf), PINNING)
    rows = answer.rows.select("doc_id", "rank", "exact", F.bround("final", 6).alias("final"), F.array_join("rules", ",").alias("rules"), F.lit(answer.intent).alias("intent"))
    return S.page(rows, [F.asc("rank")], 1, 30)


REFERENCED_SQL = f"""
WITH {LEXICAL}, {SEMANTIC}, b AS (SELECT coalesce(lex.doc_id, sem.doc_id) AS doc_id, lexical_position AS lp, semantic_position AS sp FROM lex FULL OUTER JOIN sem ON lex.doc_id = sem.doc_id),
x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 4 = 0, doc_id % 900 DESC, doc_id DESC) AS p FROM documents WHERE doc_id % 50 = 7 QUALIFY p <= 10),
c AS (SELECT coalesce(b.doc_id, x.doc_id) AS doc_id, lp, sp, p FROM b FULL OUTER JOIN x ON b.doc_id = x.doc_id),
s AS (SELECT doc_id, p, 0.40 * CASE WHEN lp >= 1 THEN 12 / (12 + lp - 1.0::DOUBLE) ELSE 0.0 END + 0.25 * CASE WHEN sp >= 1 THEN 12 / (12 + sp - 1.0::DOUBLE) ELSE 0.0 END
    + 0.15 * CASE WHEN lang = 'en' THEN 0.9 ELSE 0.6 END + 0.10 * 0.55 + 0.05 * CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 0.4 END + 0.05 * CASE WHEN doc_id % 4 = 0 THEN 0.25 ELSE 1.0 END AS base,
  greatest(0.2::DOUBLE, CASE lang WHEN 'de' THEN 0.7 WHEN 'fr' THEN 0.75 ELSE 1.35 END * CASE WHEN doc_id % 10 = 0 THEN 0.5 ELSE 1.0 END * CASE WHEN doc_id % 4 = 0 THEN 0.65 ELSE 1.0 END) AS m,
  concat_ws(',', CASE lang WHEN 'de' THEN 'special_penalty' WHEN 'fr' THEN 'support_penalty' ELSE 'core_boost' END, CASE WHEN doc_id % 10 = 0 THEN 'repeal_penalty' END, CASE WHEN doc_id % 4 = 0 THEN 'historic_penalty' END) AS rules
  FROM c JOIN documents USING (doc_id))
SELECT doc_id, row_number() OVER (ORDER BY p NULLS LAST, base * m DESC, doc_id)::INT AS rank, p IS NOT NULL AS exact, round_even((base * m)::DOUBLE, 6) AS final, rules, 'broad' AS intent FROM s QUALIFY rank <= 30
"""


def facet_filtering(spark: SparkSession, sf: str) -> DataFrame:
    return S.facet_filter(_t(spark, sf, "orders"), {"o_orderstatus": ["F", "P"], "o_orderpriority": []}, {"o_custkey": None}, {"o_totalprice": (1000, 200000)}).select("o_orderkey", "o_orderstatus")


def facets(spark: SparkSession, sf: str) -> DataFrame:
    return S.facet_counts(_t(spark, sf, "documents"), "source")


def browse_sorts(spark: SparkSession, sf: str) -> DataFrame:
    """Third page of orders by date, newest first."""
    return S.page(_t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), S.SORTS["date_desc"]("o_orderdate", "o_orderkey"), 3, 25)


def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("lang") == "en").alias("english"), F.bround(F.avg("n_chars"), 1).alias("mean_chars"), F.count_distinct("source").alias("sources"))


RULES = (
    {"rule_id": "rich", "inclusion": {"all": [{"field": "c_acctbal", "operator": "gte", "value": 5000}, {"field": "c_mktsegment", "operator": "in", "value": ["BUILDING", "MACHINERY"]}]}, "exclusion": {"any": [{"field": "c_nationkey", "operator": "eq", "value": 3}]}, "valid_from": "1990-01-01"},
    {"rule_id": "unknown", "inclusion": {"any": [{"field": "rating", "operator": "gt", "value": 3}, {"not": {"field": "c_acctbal", "operator": "between", "value": [-1000, 0]}}]}},
    {"rule_id": "past", "inclusion": {"always": True}, "valid_from": "1990-01-01", "valid_to": "1995-12-31"},
)
KINDS = {"c_acctbal": "number", "c_mktsegment": "text", "c_nationkey": "number", "rating": "number"}


def applicability(spark: SparkSession, sf: str) -> DataFrame:
    """Three rules over all customers; `rating` is known for every other one."""
    profiles = _t(spark, sf, "customer").withColumn("rating", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 7))
    return A.evaluate_rules(profiles, RULES, KINDS, "c_custkey", "2020-06-30")


APPLICABILITY_SQL = """
WITH p AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 END AS rating FROM customer),
r AS (
  SELECT c_custkey, 'rich' AS rule_id, c_acctbal >= 5000 AND lower(c_mktsegment) IN ('building', 'machinery') AS included, c_nationkey = 3 AS excluded, true AS in_force,
         (CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END + CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END) AS u FROM p
  UNION ALL SELECT c_custkey, 'unknown', rating > 3 OR NOT (c_acctbal BETWEEN -1000 AND 0), false, true, CASE WHEN rating IS NULL THEN 1 ELSE 0 END + CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END FROM p
  UNION ALL SELECT c_custkey, 'past', true, false, false, 0 FROM p)
SELECT c_custkey, rule_id, included, excluded, in_force,
       CASE WHEN NOT in_force THEN 'not_in_force' WHEN excluded THEN 'excluded' WHEN NOT included THEN 'does_not_apply' WHEN included AND NOT excluded THEN 'applies' ELSE 'unclear' END AS verdict,
       greatest(0, 100 - 15 * u)::INT AS confidence FROM r
"""


def applicability_report(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = applicability(spark, sf)
    out = A.verdict_report(verdicts, "rule_id", ["applies", "does_not_apply", "excluded", "not_in_force", "unclear"])
    return out


REPORT_SQL = "SELECT rule_id, count(*) FILTER (verdict = 'applies') AS applies, count(*) FILTER (verdict = 'does_not_apply') AS does_not_apply, count(*) FILTER (verdict = 'excluded') AS excluded, count(*) FILTER (verdict = 'not_in_force') AS not_in_force, count(*) FILTER (verdict = 'unclear') AS unclear FROM (" + APPLICABILITY_SQL + ") GROUP BY rule_id"


def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Orders against an altered copy of themselves."""
    old = _t(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("content_hash"), F.col("o_orderpriority").alias("metadata_hash"), F.col("o_orderstatus").alias("status"))
    k = F.col("o_orderkey")
    new = old.select((k + F.when(k % 11 == 0, 100_000_000).otherwise(0)).alias("o_orderkey"), F.when(k % 7 == 0, "new").otherwise(F.col("content_hash")).alias("content_hash"), F.when(k % 5 == 0, "new").otherwise(F.col("metadata_hash")).alias("metadata_hash"), F.when(k % 3 == 0, "X").otherwise(F.col("status")).alias("status"))
    return H.detect_changes(old, new, ["o_orderkey"], "content_hash", "metadata_hash", "status").select("o_orderkey", "change")


CHANGE_SQL = """
SELECT o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 100000000 ELSE 0 END AS o_orderkey,
       CASE WHEN o_orderkey % 11 = 0 THEN 'created' WHEN o_orderkey % 7 = 0 THEN 'content_updated' WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'X' THEN 'status_changed' WHEN o_orderkey % 5 = 0 THEN 'metadata_updated' ELSE 'unchanged' END AS change
FROM orders
"""


def latest_event(spark: SparkSession, sf: str) -> DataFrame:
    return H.latest(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


def previous_state(spark: SparkSession, sf: str) -> DataFrame:
    return H.previous(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "previous")


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    log = _t(spark, sf, "events").select(F.col("event_type").alias("query"), F.struct("ts", "event_id").alias("at"), F.col("user_id").alias("results"))
    return H.fold_queries(log, "query", "at", "results")


def queue_claimable(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "PENDING").when(F.col("event_type") == "view", "RETRY").when(F.col("event_type") == "error", "PROCESSING").otherwise("DONE")
    queue = _t(spark, sf, "events").select("event_id", status.alias("status"), F.col("ts").alias("next_attempt_at"), F.col("ts").alias("lease_expires_at"), (F.col("event_id") % 6 + 1).alias("attempt"))
    return H.claimable(queue, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id", "status", H.backoff_minutes(F.col("attempt")).alias("backoff"))


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return H.zero_filled(_t(spark, sf, "events"), "event_type", ["view", "click", "refund", "error"])


def overrides(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 1000).alias("engine"))
    decided = _t(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"))
    return H.effective(docs, decided, "doc_id", "engine").select("doc_id", "effective")


def relation_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's edge to its preferred customer: highest balance, then newest key."""
    edges = _t(spark, sf, "nation").select(F.col("n_nationkey"), F.col("n_nationkey").alias("c_nationkey"))
    docs = _t(spark, sf, "customer").select("c_nationkey", F.col("c_custkey").alias("document_id"), "c_acctbal")
    return G.resolve(edges, docs, "c_nationkey", [F.desc("c_acctbal"), F.desc("document_id")]).select("n_nationkey", "target_id")


def relation_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of parts: each points to the part of a third of its number."""
    parts = _t(spark, sf, "part")
    edges = parts.select(F.col("p_partkey").alias("source"), F.when(F.col("p_partkey") > 2, F.floor(F.col("p_partkey") / 3)).alias("target"))
    return G.walk(edges, parts.where("p_size = 1").select(F.col("p_partkey").alias("node"))).drop("cut")


WALK_SQL = """
WITH RECURSIVE w AS (
  SELECT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part WHERE p_size = 1
  UNION ALL SELECT w.start, w.node // 3, depth + 1 FROM w JOIN part ON p_partkey = w.node WHERE w.node > 2 AND depth < 50)
SELECT start, node, min(depth)::INT AS depth FROM w WHERE depth > 0 GROUP BY start, node
"""


def span_cover(spark: SparkSession, sf: str) -> DataFrame:
    spans = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("a"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4).cast("long").alias("b"))
    return G.merged_length(spans, "l_orderkey", "a", "b")


SPAN_SQL = """
WITH s AS (SELECT l_orderkey, l_linenumber::BIGINT AS a, l_linenumber + l_quantity::INT % 4 AS b FROM lineitem)
SELECT l_orderkey, count(DISTINCT i) AS covered FROM (SELECT l_orderkey, unnest(CASE WHEN b > a THEN generate_series(a, b - 1) ELSE [NULL]::BIGINT[] END) AS i FROM s) GROUP BY l_orderkey
"""


def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Users as queries: their products by value against those of their purchases."""
    ev = _t(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), "event_type", "value")
    ranked = ev.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("value"), "doc_id"))).select("query_id", "doc_id", "position")
    out = E.metrics(ranked, ev.where("event_type = 'purchase'"))
    return out.select("query_id", "n_relevant", "hits", *[F.bround(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank", "ndcg")])


METRIC_SQL = """
WITH r AS (SELECT user_id AS query_id, event_id AS doc_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS position FROM events),
p AS (SELECT query_id, count(*) AS n_relevant, count(*) FILTER (position <= 10) AS hits, coalesce(sum(1 / log2(position + 1)) FILTER (position <= 10), 0) AS dcg, coalesce(1.0::DOUBLE / min(position) FILTER (position <= 10), 0) AS rr FROM r WHERE event_type = 'purchase' GROUP BY query_id)
SELECT query_id, n_relevant, hits, round_even(hits::DOUBLE / n_relevant, 6) AS recall, round_even(hits / 10.0::DOUBLE, 6) AS precision, round_even(rr, 6) AS reciprocal_rank,
       round_even(dcg / list_sum(list_transform(generate_series(1, least(n_relevant, 10)), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM p
"""

QUERIES = (search_lexical, search_semantic, search_hybrid, search_with_references, facet_filtering, facets, browse_sorts, corpus_totals, applicability, applicability_report, change_detection, latest_event, previous_state, query_log, queue_claimable, status_counts, overrides, relation_resolution, relation_walk, span_cover, retrieval_metrics)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "search_lexical": f"WITH {LEXICAL} SELECT * FROM lex",
        "search_semantic": f"WITH {SEMANTIC} SELECT doc_id, round_even(similarity, 5) AS similarity, best_chunk, semantic_position FROM sem",
        "search_hybrid": HYBRID_SQL,
        "search_with_references": REFERENCED_SQL,
        "facet_filtering": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 200000",
        "facets": "SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source",
        "browse_sorts": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 25 OFFSET 50",
        "corpus_totals": "SELECT count(*) AS documents, count(*) FILTER (lang = 'en') AS english, round_even(avg(n_chars), 1) AS mean_chars, count(DISTINCT source) AS sources FROM documents",
        "applicability": APPLICABILITY_SQL,
        "applicability_report": REPORT_SQL,
        "change_detection": CHANGE_SQL,
        "latest_event": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
        "previous_state": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events",
        "query_log": "SELECT sha256(lower(trim(event_type))) AS query_hash, count(*) AS occurrences, arg_max(user_id, (ts, event_id)) AS last_result_count, max(user_id) AS best_result_count FROM events GROUP BY 1",
        "queue_claimable": "SELECT event_id, CASE event_type WHEN 'click' THEN 'PENDING' WHEN 'view' THEN 'RETRY' ELSE 'PROCESSING' END AS status, least(5 * pow(3, event_id % 6), 360)::DOUBLE AS backoff FROM events WHERE event_type = 'click' OR event_type IN ('view', 'error') AND ts <= TIMESTAMP '2024-01-15'",
        "status_counts": "SELECT position::INT AS position, v AS event_type, count(event_id) AS n FROM (VALUES (0, 'view'), (1, 'click'), (2, 'refund'), (3, 'error')) d(position, v) LEFT JOIN events ON event_type = v GROUP BY position, v",
        "overrides": "SELECT doc_id, coalesce(quality = 1, n_chars > 1000) AS effective FROM documents LEFT JOIN labels USING (doc_id)",
        "relation_resolution": "SELECT n_nationkey, arg_max(c_custkey, (c_acctbal, c_custkey)) AS target_id FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey",
        "relation_walk": WALK_SQL,
        "span_cover": SPAN_SQL,
        "retrieval_metrics": METRIC_SQL,
    }
