"""Queries of the catalogue, relation, evaluation, paging and queue operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge import sources as S
from lexforge.operators import catalogue as C
from lexforge.operators import evaluation as E
from lexforge.operators import history as H
from lexforge.operators import references as N
from lexforge.operators import relations as G
from lexforge.operators import search as Q
from lexforge.operators import titles as T


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def public_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of sources without managed rights: here those of which a document is labelled toxic."""
    docs = _t(spark, sf, "documents")
    managed = docs.join(_t(spark, sf, "labels").where("toxic = 1"), "doc_id").select("source").distinct()
    return C.public_documents(docs, managed).select("doc_id", "source")


PUBLIC_SQL = "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)"


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "labels").select("doc_id", F.concat_ws("-", F.lit("q"), "quality").alias("slug"))


def category_documents(spark: SparkSession, sf: str) -> DataFrame:
    return Q.in_category(_t(spark, sf, "documents"), _links(spark, sf), ["q-1", "none"], "doc_id").select("doc_id")


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("q-0",), ("q-1",), ("q-2",)], "slug string")
    return C.with_counts(names, _links(spark, sf))


def current_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents, turns as versions; every fifth document points nowhere."""
    turns = _t(spark, sf, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("version_id"), "text")
    docs = turns.groupBy("conv_id").agg(F.max("version_id").alias("current_version_id")).withColumn("current_version_id", F.when(F.col("conv_id") % 5 != 0, F.col("current_version_id")))
    return C.current_versions(docs, turns, "conv_id").select("conv_id", "current_version_id", F.length("text").cast("long").alias("n_chars"))


def catalogue_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, their customers as sources, and their last line as provenance."""
    orders = _t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    proof = _t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    proof = proof.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("string").alias("evidence_url"), F.col("l_linenumber").alias("retrieved_at"))
    return C.catalogue(orders, _t(spark, sf, "customer").select("c_custkey", "c_name"), proof, "c_custkey", "o_orderkey").select("o_orderkey", "c_name", "evidence_url", "retrieved_at")


CATALOGUE_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS n FROM l)
SELECT o_orderkey, c_name, p::VARCHAR AS evidence_url, l_linenumber AS retrieved_at FROM orders JOIN customer ON o_custkey = c_custkey JOIN p ON l_orderkey = o_orderkey AND n = 1
"""


def known_ids(spark: SparkSession, sf: str) -> DataFrame:
    return C.known_ids(_t(spark, sf, "orders").select(F.col("o_custkey").alias("id")), _t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id")


def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return C.ordered_distinct(_t(spark, sf, "events"), "event_type", "event_id")


def group_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by the status of their orders: a customer with orders of two states is in two groups."""
    found = _t(spark, sf, "orders").select("o_orderstatus", "o_custkey")
    return C.group_problems(found, {"F": 7, "O": 8, "X": 0}, "o_orderstatus", "o_custkey")


GROUPS_SQL = """
WITH w(o_orderstatus, expected) AS (VALUES ('F', 7), ('O', 8), ('X', 0)),
c AS (SELECT o_orderstatus, count(DISTINCT o_custkey) AS found FROM orders GROUP BY 1),
d AS (SELECT DISTINCT a.o_orderstatus FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus <> b.o_orderstatus)
SELECT w.o_orderstatus, coalesce(found, 0) AS found, expected::BIGINT AS expected, CASE WHEN coalesce(found, 0) <> expected THEN 'count_mismatch' WHEN d.o_orderstatus IS NOT NULL THEN 'overlap' END AS problem
FROM w LEFT JOIN c USING (o_orderstatus) LEFT JOIN d USING (o_orderstatus)
"""


def discovery_decisions(spark: SparkSession, sf: str) -> DataFrame:
    part = _t(spark, sf, "part")
    known, denied = F.col("p_partkey") % 7 == 0, F.col("p_type").startswith("PROMO")
    tier = T.leading_type(F.concat(F.when(F.col("p_size") % 2 == 0, "Lov om ").otherwise("Nyt om "), F.lower("p_type")))
    return part.select("p_partkey", C.discovery_decision(known, denied, F.col("p_size") * 2).alias("decision"), C.triage(F.lower("p_type"), [("metal", ["steel$", "tin$"]), ("plated", ["plated"])], "other").alias("tier"), tier["kind"].alias("kind"), tier["rest"].alias("rest"))


DISCOVERY_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'known' WHEN starts_with(p_type, 'PROMO') THEN 'denied' WHEN p_size * 2 >= 60 THEN 'queue' WHEN p_size * 2 >= 30 THEN 'review' ELSE 'skip' END AS decision,
  CASE WHEN regexp_matches(lower(p_type), '(steel|tin)$') THEN 'metal' WHEN contains(lower(p_type), 'plated') THEN 'plated' ELSE 'other' END AS tier,
  CASE WHEN p_size % 2 = 0 THEN 'Lov om' END AS kind, CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE 'Nyt om ' || lower(p_type) END AS rest FROM part
"""


def authorities(spark: SparkSession, sf: str) -> DataFrame:
    """The source's own name where it has one, else the first hint that a text holds."""
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "source"))
    return _t(spark, sf, "documents").select("doc_id", T.authority(given, F.lit(None).cast("string"), F.col("text"), {"nicht": "Amt", "avec": "Bureau"}).alias("authority"))


AUTHORITIES_SQL = """
WITH d AS (SELECT doc_id, lower(nfc_normalize(substr(coalesce(text, ''), 1, 4000))) AS t, CASE WHEN doc_id % 3 = 0 THEN trim(source) END AS g FROM documents)
SELECT doc_id, coalesce(g, CASE WHEN contains(t, 'nicht') THEN 'Amt' WHEN contains(t, 'avec') THEN 'Bureau' END) AS authority FROM d
"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two rankings of parts for suppliers as queries."""
    rows = _t(spark, sf, "supplier").select((F.col("s_suppkey") % 20).alias("query_id")).distinct()
    every = rows.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("position"))
    word, sense = (every.select("query_id", F.lit(m).alias("mode"), "position", ((F.col("query_id") * a + F.col("position") * b) % 50).cast("long").alias("doc_id")) for m, a, b in (("lexical", 3, 1), ("semantic", 7, 3)))
    return word.union(sense)


RUNS = """
q AS (SELECT DISTINCT s_suppkey % 20 AS query_id FROM supplier), p AS (SELECT unnest(generate_series(1, 15))::INT AS position),
runs AS (SELECT query_id, 'lexical' AS mode, position, (query_id * 3 + position) % 50 AS doc_id FROM q, p UNION ALL SELECT query_id, 'semantic', position, (query_id * 7 + position * 3) % 50 FROM q, p),
rel AS (SELECT DISTINCT s_suppkey % 20 AS query_id, s_suppkey % 60 AS doc_id FROM supplier WHERE s_suppkey % 20 <> 4)
"""


def _relevant(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "supplier").where("s_suppkey % 20 <> 4").select((F.col("s_suppkey") % 20).alias("query_id"), (F.col("s_suppkey") % 60).alias("doc_id")).distinct()


def pooled_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return E.pooled(_runs(spark, sf), 10).withColumn("modes", F.array_join("modes", ","))


def missed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return E.missed(_runs(spark, sf).where("mode = 'lexical'"), _relevant(spark, sf), 10).withColumn("missed", F.array_join("missed", ","))


def evaluation_summary(spark: SparkSession, sf: str) -> DataFrame:
    runs, modes = _runs(spark, sf), ("lexical", "semantic")
    per = [E.metrics(runs.where(F.col("mode") == m), _relevant(spark, sf)).withColumn("mode", F.lit(m)) for m in modes]
    out = E.averages(per[0].union(per[1]), "mode")
    return out.select("mode", "queries", "fully_covered", "any_hit", *[F.bround(c, 6).alias(c) for c in ("recall", "precision", "mrr")])


SUMMARY_SQL = f"""
WITH {RUNS}, h AS (SELECT m.mode, rel.query_id, count(*) AS n, count(r.position) AS hits, coalesce(1.0 / min(r.position), 0) AS rr
  FROM rel CROSS JOIN (SELECT DISTINCT mode FROM runs) m LEFT JOIN runs r ON r.mode = m.mode AND r.query_id = rel.query_id AND r.doc_id = rel.doc_id AND r.position <= 10 GROUP BY 1, 2)
SELECT mode, count(*) AS queries, count(*) FILTER (WHERE hits = n) AS fully_covered, count(*) FILTER (WHERE hits > 0) AS any_hit, round_even(avg(hits::DOUBLE / n), 6) AS recall, round_even(avg(hits / 10.0::DOUBLE), 6) AS precision, round_even(avg(rr::DOUBLE), 6) AS mrr FROM h GROUP BY mode
"""


def negative_controls(spark: SparkSession, sf: str) -> DataFrame:
    queries = _t(spark, sf, "supplier").select((F.col("s_suppkey") % 23).alias("query_id")).distinct()
    return E.controls(queries, _relevant(spark, sf), _runs(spark, sf))


def missing_graded(spark: SparkSession, sf: str) -> DataFrame:
    return E.missing_from_corpus(_relevant(spark, sf), _t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id")).where("doc_id % 7 <> 0"))


def sorted_by_all_modes(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten orders in each sort mode; every fourth price is missing."""
    orders = _t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("score"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("date"), "o_orderpriority")
    columns = {"score_desc": "score", "title": "o_orderpriority", "date_desc": "date", "date_asc": "date"}
    out = [Q.page(orders, Q.SORTS[m](c, "o_orderkey"), 1, 10).select(F.lit(m).alias("mode"), "o_orderkey") for m, c in columns.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


SORTS_SQL = """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS score, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS date, o_orderpriority FROM orders)
SELECT 'score_desc' AS mode, o_orderkey FROM (SELECT * FROM o ORDER BY score DESC NULLS LAST, o_orderkey DESC LIMIT 10)
UNION ALL SELECT 'title', o_orderkey FROM (SELECT * FROM o ORDER BY o_orderpriority, o_orderkey LIMIT 10)
UNION ALL SELECT 'date_desc', o_orderkey FROM (SELECT * FROM o ORDER BY date DESC NULLS LAST, o_orderkey DESC LIMIT 10)
UNION ALL SELECT 'date_asc', o_orderkey FROM (SELECT * FROM o ORDER BY date NULLS FIRST, o_orderkey LIMIT 10)
"""


def page_totals(spark: SparkSession, sf: str) -> DataFrame:
    """How many orders and pages a filtered listing has."""
    return Q.paged(_t(spark, sf, "orders").where("o_orderstatus = 'F'"), [F.asc("o_orderkey")], 1, 25)[1]


def truncated_legs(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").withColumn("title", F.lit(""))
    legs = {w: Q.truncated(Q.lexical_candidates(docs, w, "doc_id", "title", "text", 50), 50).withColumn("query", F.lit(w)) for w in ("the", "zzzz")}
    return legs["the"].union(legs["zzzz"])


def semantic_in_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """The best chunks of allowed documents only, from as many chunks as an index would give."""
    chunks = _t(spark, sf, "embeddings").withColumn("doc_id", F.col("vec_id") % 40)
    query = [float(x) for x in _t(spark, sf, "embeddings").where("vec_id = 3").first()["embedding"]]
    allowed = spark.range(40).where("id % 3 = 0").select(F.col("id").alias("doc_id"))
    found = Q.semantic_candidates(chunks, query, "doc_id", "vec_id", "embedding", -1.0, 5, allowed, Q.over_fetch(5))
    return found.select("doc_id", F.bround("similarity", 5).alias("similarity"), "best_chunk", "semantic_position")


ALLOWED_SQL = """
WITH s AS (SELECT e.vec_id % 40 AS doc_id, e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS s
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE (e.vec_id % 40) % 3 = 0 ORDER BY s DESC, doc_id, vec_id LIMIT 100),
b AS (SELECT doc_id, max(s) AS similarity, arg_max(vec_id, s) AS best_chunk FROM s GROUP BY doc_id)
SELECT doc_id, round_even(similarity, 5) AS similarity, best_chunk, row_number() OVER (ORDER BY similarity DESC, doc_id)::INT AS semantic_position FROM b QUALIFY semantic_position <= 5
"""


def _acts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("BEK", "Lov", "Bekendtgørelse")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 400).cast("string").alias("document_number"), kind.alias("document_type"), F.col("o_orderdate").cast("date").alias("published_date"), F.when(F.col("o_orderstatus") == "F", "Gældende").otherwise("Historisk").alias("status"), F.concat(F.lit("A"), "o_orderkey").alias("source_id"))


def exact_references(spark: SparkSession, sf: str) -> DataFrame:
    """The acts that three queries name, first ten of each (the feature's own limit)."""
    out = None
    for query in ("BEK nr. 12 olie", "lov 0025 af 1995", "77"):
        ref = N.read_reference(query)
        found = N.referred(_acts(spark, sf), ref, query).select(F.lit(query).alias("query"), F.lit(ref.search).alias("search"), "id")
        out = found if out is None else out.union(found)
    return out


EXACT_SQL = """
WITH a AS (SELECT o_orderkey AS id, o_orderkey % 400 AS n, CASE WHEN o_orderkey % 3 = 1 THEN 'LOV' ELSE 'BEK' END AS k, o_orderdate::DATE AS d, o_orderstatus = 'F' AS f FROM orders)
SELECT 'BEK nr. 12 olie' AS query, 'olie' AS search, id FROM (SELECT * FROM a WHERE n = 12 AND k = 'BEK' ORDER BY f DESC, d DESC, id DESC LIMIT 10)
UNION ALL SELECT 'lov 0025 af 1995', '25', id FROM (SELECT * FROM a WHERE n = 25 AND k = 'LOV' AND year(d) = 1995 ORDER BY f DESC, d DESC, id DESC LIMIT 10)
UNION ALL SELECT '77', '77', id FROM (SELECT * FROM a WHERE n = 77 ORDER BY f DESC, d DESC, id DESC LIMIT 10)
"""


def pinned_results(spark: SparkSession, sf: str) -> DataFrame:
    """A ranked page with the exactly named acts before it."""
    ranked = _acts(spark, sf).orderBy("id").limit(30).select("id", F.col("id").cast("int").alias("rank"))
    exact = N.referred(_acts(spark, sf), N.read_reference("nr. 5")).select("id")
    numbered = exact.withColumn("exact_position", F.row_number().over(_by_id())).select("id", "exact_position")
    return Q.pinned(ranked, numbered, "id").select("id", "rank")


def _by_id():
    from pyspark.sql import Window

    return Window.orderBy("id")


PINNED_SQL = """
WITH a AS (SELECT o_orderkey AS id, o_orderkey % 400 AS n, o_orderdate::DATE AS d, o_orderstatus = 'F' AS f FROM orders),
r AS (SELECT id, id AS rank FROM a ORDER BY id LIMIT 30), e AS (SELECT id, row_number() OVER (ORDER BY id) AS p FROM (SELECT * FROM a WHERE n = 5 ORDER BY f DESC, d DESC, id DESC LIMIT 10))
SELECT id, row_number() OVER (ORDER BY p NULLS LAST, rank NULLS LAST, id)::INT AS rank FROM r FULL OUTER JOIN e USING (id)
"""


def relinked_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers refer to nations by region key; every third reference still has an old target."""
    nations = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("document_id"), F.col("n_regionkey").alias("key"), (F.col("n_nationkey") % 2 == 0).alias("in_force"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("n_nationkey") % 7).alias("date")).where("key <> 3")
    edges = _t(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("key"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(99).cast("long")).alias("target_id"))
    return G.relinked(edges, nations, "key", "in_force", "date").select("s_suppkey", "key", F.coalesce("target_id", F.lit(-1)).alias("target_id"))


RELINKED_SQL = """
WITH b AS (SELECT n_regionkey AS key, n_nationkey AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 2, n_nationkey % 7 DESC, n_nationkey DESC) AS n FROM nation WHERE n_regionkey <> 3)
SELECT s_suppkey, s_nationkey % 5 AS key, coalesce(b.id, CASE WHEN s_suppkey % 3 = 0 THEN 99 END, -1)::BIGINT AS target_id FROM supplier LEFT JOIN b ON b.key = s_nationkey % 5 AND n = 1
"""


def synchronised_edges(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target_id"), F.when(F.col("l_linenumber") % 2 == 0, "repeals").otherwise("manual").alias("relation"))
    renewed = lines.select("source").where("source % 4 = 0").distinct()
    new = renewed.select("source", F.lit(-1).cast("long").alias("target_id"), F.lit("repeals").alias("relation"))
    return G.relation_counts(G.synchronised(lines, new, renewed, "source", "relation", ["repeals"]))


SYNC_SQL = """
WITH e AS (SELECT l_orderkey AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'repeals' ELSE 'manual' END AS relation FROM lineitem),
r AS (SELECT s, relation FROM e WHERE NOT (s % 4 = 0 AND relation = 'repeals') UNION ALL SELECT DISTINCT s, 'repeals' FROM e WHERE s % 4 = 0)
SELECT relation, count(*) AS n, count(*) AS resolved FROM r GROUP BY relation
"""


def delegated_regulations(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of a region as a law's family; suppliers issue under a nation or under a region's name."""
    nation = _t(spark, sf, "nation")
    family = nation.select(F.col("n_regionkey").cast("long").alias("start"), F.col("n_nationkey").cast("long").alias("node"))
    titles = nation.select(F.col("n_nationkey").cast("long").alias("document_id"), F.concat(F.lit("lov om "), F.col("n_regionkey").cast("string")).alias("title_key"))
    even = F.col("s_suppkey") % 2 == 0
    bases = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("document_id"), F.when(even, F.col("s_nationkey").cast("long")).alias("target_id"), F.when(~even, F.concat(F.lit("lov om "), (F.col("s_suppkey") % 5).cast("string"))).alias("target_key"))
    return G.delegated(family, titles, bases)


DELEGATED_SQL = """
SELECT n_regionkey::BIGINT AS start, s_suppkey AS document_id, 'document' AS via FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey % 5, s_suppkey, 'title' FROM supplier WHERE s_suppkey % 2 <> 0
"""


def metadata_links(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose metadata name acts, resolved to the customers that have these numbers as acts of 2001."""
    meta = F.create_map(F.lit("Erstattet-af"), F.concat(F.lit("see /eli/lta/2001/000"), "o_custkey", F.lit(" and /ELI/ft/2002/7, not /eli/other/2003/8")), F.lit("note"), F.lit("/eli/lta/1999/1"), F.lit("OPHÆVER"), F.concat(F.lit("B"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")))
    links = N.metadata_links(_t(spark, sf, "orders").select("o_orderkey", meta.alias("m")), "o_orderkey", "m", {"erstattetaf": "replaced_by", "ophaever": "repeals"})
    acts = _t(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), N.number_key(F.lit(None).cast("string"), F.col("c_custkey").cast("string"), F.lit("2001")).alias("target"))
    return links.join(acts, "target", "left").select("o_orderkey", "relation", "target", F.coalesce("document_id", F.lit(-1)).alias("document_id"))


LINKS_SQL = """
SELECT o_orderkey, 'replaced_by' AS relation, o_custkey || '/2001' AS target, coalesce(c_custkey, -1) AS document_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT o_orderkey, 'replaced_by', '7/2002', -1 FROM orders
UNION ALL SELECT o_orderkey, 'repeals', 'accn:B' || lpad(o_orderkey::VARCHAR, 9, '0'), -1 FROM orders
"""


def relations_without_own(spark: SparkSession, sf: str) -> DataFrame:
    edges = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("repeals").alias("relation"), (F.col("l_partkey") % 3).alias("target"), (F.col("l_linenumber") % 2).alias("section"))
    own = edges.select("id", (F.col("id") % 3).alias("own_key")).distinct()
    return N.distinct_relations(edges, own, "id").groupBy("relation", "target", "section").agg(F.count(F.lit(1)).alias("n"))


def query_log_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Event types as queries: the most asked with and without results, and the totals."""
    log = _t(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("occurrences"), (F.max("event_id") % 4).alias("last_result_count"), F.max("value").alias("best_result_count"))
    rows = H.popular(log, "user_id", 5).withColumn("list", F.lit("popular")).union(H.unanswered(log, "user_id", 5).withColumn("list", F.lit("unanswered")))
    return rows.select("list", "user_id", "occurrences")


LOG_SQL = """
WITH l AS (SELECT user_id, count(*) AS occurrences, max(event_id) % 4 AS last FROM events GROUP BY 1)
SELECT 'popular' AS list, user_id, occurrences FROM (SELECT * FROM l WHERE last > 0 ORDER BY occurrences DESC, user_id LIMIT 5)
UNION ALL SELECT 'unanswered', user_id, occurrences FROM (SELECT * FROM l WHERE last = 0 ORDER BY occurrences DESC, user_id LIMIT 5)
"""


def query_log_totals(spark: SparkSession, sf: str) -> DataFrame:
    log = _t(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("occurrences"), (F.max("event_id") % 4).alias("best_result_count"))
    return H.log_totals(log)


def queue_totals(spark: SparkSession, sf: str) -> DataFrame:
    states = _t(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"))
    return H.with_total(H.zero_filled(states, "status", ["F", "O", "P", "X"]), "status")


QUEUE_SQL = """
WITH v(position, status) AS (VALUES (0, 'F'), (1, 'O'), (2, 'P'), (3, 'X')), c AS (SELECT position, v.status, count(o_orderkey) AS n FROM v LEFT JOIN orders ON o_orderstatus = v.status GROUP BY 1, 2)
SELECT position, status, n FROM c UNION ALL SELECT 4, 'TOTAL', sum(n)::BIGINT FROM c
"""


def index_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return H.index_coverage(_t(spark, sf, "documents"), _t(spark, sf, "labels"), "doc_id")


def reported_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals read from responses of four shapes."""
    n = F.col("event_id").cast("string")
    shapes = (F.concat(F.lit('{"meta":{"Total":'), n, F.lit('},"hits":3}')), F.concat(F.lit('{"count":"'), n, F.lit('"}')), F.lit('{"items":[]}'), F.concat(F.lit('{"a":[{"b":{"total":'), n, F.lit("}}]}")))
    payload = F.element_at(F.array(*shapes), (F.col("event_id") % 4 + 1).cast("int"))
    return _t(spark, sf, "events").select("event_id", payload.alias("p")).select("event_id", F.coalesce(S.reported_total("p"), F.lit(-1)).alias("total"))


TOTALS_SQL = "SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN event_id ELSE -1 END AS total FROM events"


QUERIES = (
    *(public_documents, category_documents, category_counts, current_versions, catalogue_entries, known_ids, ordered_distinct, group_problems, discovery_decisions),
    *(authorities, pooled_candidates, missed_documents, evaluation_summary, negative_controls, missing_graded, sorted_by_all_modes, page_totals, truncated_legs),
    *(semantic_in_allowed, exact_references, pinned_results, relinked_edges, synchronised_edges, delegated_regulations, metadata_links, relations_without_own),
    *(query_log_lists, query_log_totals, queue_totals, index_coverage, reported_totals),
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "public_documents": PUBLIC_SQL,
        "category_documents": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "category_counts": "SELECT slug, count(l.doc_id) AS n FROM (VALUES ('q-0', 0), ('q-1', 1), ('q-2', 2)) v(slug, q) LEFT JOIN labels l ON l.quality = q GROUP BY slug",
        "current_versions": "SELECT conv_id, (conv_id * 1000 + turn)::BIGINT AS current_version_id, length(text) AS n_chars FROM conversations WHERE conv_id % 5 <> 0 QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)",
        "catalogue_entries": CATALOGUE_SQL,
        "known_ids": "SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer",
        "ordered_distinct": "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1",
        "group_problems": GROUPS_SQL,
        "discovery_decisions": DISCOVERY_SQL,
        "authorities": AUTHORITIES_SQL,
        "pooled_candidates": f"WITH {RUNS} SELECT query_id, doc_id, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes, min(position) AS best_position FROM runs WHERE position <= 10 GROUP BY 1, 2",
        "missed_documents": f"WITH {RUNS} SELECT rel.query_id, coalesce(string_agg(rel.doc_id::VARCHAR, ',' ORDER BY rel.doc_id) FILTER (WHERE r.position IS NULL), '') AS missed FROM rel LEFT JOIN runs r ON r.mode = 'lexical' AND r.query_id = rel.query_id AND r.doc_id = rel.doc_id AND r.position <= 10 GROUP BY 1",
        "evaluation_summary": SUMMARY_SQL,
        "negative_controls": f"WITH {RUNS} SELECT DISTINCT s_suppkey % 23 AS query_id, s_suppkey % 23 NOT IN (SELECT query_id FROM runs) AS passed FROM supplier WHERE s_suppkey % 23 NOT IN (SELECT query_id FROM rel)",
        "missing_graded": f"WITH {RUNS} SELECT DISTINCT doc_id FROM rel WHERE doc_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)",
        "sorted_by_all_modes": SORTS_SQL,
        "page_totals": "SELECT count(*) AS total, ceil(count(*) / 25)::INT AS total_pages FROM orders WHERE o_orderstatus = 'F'",
        "truncated_legs": "SELECT least(count(*), 50)::BIGINT AS candidates, count(*) >= 50 AS truncated, q AS query FROM (VALUES ('the'), ('zzzz')) v(q) LEFT JOIN documents ON contains(lower(text), q) WHERE text IS NOT NULL GROUP BY q UNION ALL SELECT 0, false, 'zzzz' WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), 'zzzz'))",
        "semantic_in_allowed": ALLOWED_SQL,
        "exact_references": EXACT_SQL,
        "pinned_results": PINNED_SQL,
        "relinked_edges": RELINKED_SQL,
        "synchronised_edges": SYNC_SQL,
        "delegated_regulations": DELEGATED_SQL,
        "metadata_links": LINKS_SQL,
        "relations_without_own": "WITH e AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 3 AS target, l_linenumber % 2 AS section FROM lineitem) SELECT 'repeals' AS relation, target, section, count(*) AS n FROM e WHERE target <> id % 3 GROUP BY 2, 3",
        "query_log_lists": LOG_SQL,
        "query_log_totals": "WITH l AS (SELECT count(*) AS o, max(event_id) % 4 AS b FROM events GROUP BY user_id) SELECT count(*) AS queries, sum(o)::BIGINT AS searches, count(*) FILTER (WHERE b = 0) AS without_results, count(*) FILTER (WHERE o > 1) AS repeated FROM l",
        "queue_totals": QUEUE_SQL,
        "index_coverage": "SELECT count(*) AS documents, count(l.d) AS indexed, round_even(100.0::DOUBLE * count(l.d) / count(*), 1) AS percent FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS d FROM labels) l ON d = doc_id",
        "reported_totals": TOTALS_SQL,
    }
