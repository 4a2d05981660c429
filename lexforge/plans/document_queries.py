"""Queries of the structure, ranking, source and stream operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge import sources as S
from lexforge import streaming as X
from lexforge.operators import geography as P
from lexforge.operators import ranking as R
from lexforge.operators import references as N
from lexforge.operators import structure as D


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _legal(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as acts: each line with a word becomes a paragraph."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[A-Za-z]"))
    return _t(spark, sf, "documents").select("doc_id", F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("§ "), i + 1, F.lit(". "), x)), "\n").alias("text"))


def structure_units(spark: SparkSession, sf: str) -> DataFrame:
    return D.units(_legal(spark, sf), "doc_id", "text").where("kind = 'paragraph'").select("doc_id", F.col("number").cast("int").alias("number"), "sort_key")


UNITS_SQL = r"""
SELECT doc_id, i::INT AS number, CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS sort_key
FROM (SELECT doc_id, unnest(generate_series(1, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[A-Za-z]'))))) AS i FROM documents)
"""


def structure_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return D.chunked(_legal(spark, sf), "doc_id", "text").select("doc_id", "chunk_index", "citation", F.length("text").alias("n_chars"))


GROUPS = {"steel": ["steel", "tin"], "plated": ["plated"]}


def law_classes(spark: SparkSession, sf: str) -> DataFrame:
    part = _t(spark, sf, "part")
    niches = R.niche_groups(F.col("p_type"), GROUPS)
    klass = R.law_class(F.col("p_type"), F.col("p_brand"), F.lit("gaeldende"), niches, [], ["^standard"], ["Brand#11"], ["^promo"], ["small"])
    return part.select("p_partkey", klass.alias("law_class"), F.array_join(niches, ",").alias("niches"), R.authority_score(F.col("p_brand"), F.col("p_type"), {"Brand#11": 1.0, "brand#22": 0.2}, {}).alias("authority"))


LAW_SQL = """
WITH p AS (SELECT *, lower(p_type) AS t FROM part)
SELECT p_partkey,
  CASE WHEN starts_with(t, 'small') THEN 'support' WHEN p_brand = 'Brand#11' OR starts_with(t, 'promo') THEN 'support' WHEN starts_with(t, 'standard') THEN 'core'
       WHEN contains(t, 'plated') OR contains(t, 'steel') OR regexp_matches(t, '(^|[^0-9a-z_])tin') THEN 'special' ELSE 'core' END AS law_class,
  array_to_string(list_filter([CASE WHEN contains(t, 'plated') THEN 'plated' END, CASE WHEN contains(t, 'steel') OR regexp_matches(t, '(^|[^0-9a-z_])tin') THEN 'steel' END], lambda x: x IS NOT NULL), ',') AS niches,
  round_even(0.6 * CASE lower(p_brand) WHEN 'brand#11' THEN 1.0 WHEN 'brand#22' THEN 0.2 ELSE 0.5 END + 0.4 * 0.5, 3)::DOUBLE AS authority
FROM p
"""


def rank_factors(spark: SparkSession, sf: str) -> DataFrame:
    part = _t(spark, sf, "part")
    niches = R.niche_groups(F.col("p_type"), GROUPS)
    intent = F.element_at(F.array(F.lit("broad"), F.lit("semi"), F.lit("niche")), (F.col("p_partkey") % 3 + 1).cast("int"))
    klass = F.element_at(F.array(F.lit("core"), F.lit("special"), F.lit("support")), (F.col("p_size") % 3 + 1).cast("int"))
    rules = R.factors(intent, klass, niches, F.array(F.lit("steel")), F.col("p_size") > 40, F.when(F.col("p_size") < 5, "Historisk").otherwise("Gældende"))
    return part.select("p_partkey", F.array_join(F.transform(rules, lambda r: r["rule"]), ",").alias("rules"), F.bround(F.aggregate(F.transform(rules, lambda r: r["factor"]), F.lit(1.0), lambda a, b: a * b), 6).alias("factor"))


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with two overlays."""
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    changed = lambda m: s.where(F.col("s_suppkey") % m == 0).withColumn("s_acctbal", F.lit(float(m)))
    return S.with_revisions(s, [changed(3), changed(5)], "s_suppkey")


def json_pick(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", S.pick("props", ["Key", "K"]).cast("int").alias("k"))


def limiter(spark: SparkSession, sf: str) -> DataFrame:
    """At most 3 accepted events of a user in any 6 hours."""
    return X.limited_batch(_t(spark, sf, "events"), "user_id", "ts", "event_id", 3, 6 * 3600.0)


def hourly_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's own plan over the whole table; a watermark drops nothing from a table that is read at once."""
    return X.windowed_counts(_t(spark, sf, "events"), "ts", "event_type").withColumn("start", F.unix_micros(F.col("start").cast("timestamp")))


AREAS = {"hinter": ["than", "the and"], "vorder": ["den", "und"], "lontano": ["avec", "dans les"]}


def places(spark: SparkSession, sf: str) -> DataFrame:
    """All places of a small gazetteer in all documents, the surest five of each kind."""
    return P.capped(P.detect(_t(spark, sf, "documents"), AREAS, "doc_id", "text"), "doc_id").select("doc_id", "slug", "start", "end", "applicability", "confidence")


def reference_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as acts that repeal their customer's and their own number."""
    act = F.concat(F.lit("Bekendtgørelse nr. "), "o_custkey", F.lit(" af 1. maj 1999 ophæves.\nLov nr. "), "o_orderkey", F.lit(" af 2/3/2001 ophæves"))
    return N.repealed(_t(spark, sf, "orders").select("o_orderkey", act.alias("text")), "o_orderkey", "text")


# The limiter's state is the list of accepted times; each event of a user follows the one before.
LIMITER_SQL = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (
  SELECT user_id, event_id, n, [t] AS kept, true AS allowed FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, CASE WHEN len(k) < 3 THEN list_append(k, t) ELSE k END, len(k) < 3
  FROM (SELECT e.user_id, e.event_id, e.n, e.t, list_filter(w.kept, lambda x: x > e.t - 21600000000) AS k FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT user_id, event_id, allowed FROM w
"""

FACTORS_SQL = """
WITH p AS (SELECT p_partkey, p_partkey % 3 AS i, p_size % 3 AS c, p_size > 40 AS repeal, p_size < 5 AS old, contains(lower(p_type), 'steel') OR regexp_matches(lower(p_type), '(^|[^0-9a-z_])tin') AS shared FROM part),
r AS (SELECT p_partkey, list_filter([
  CASE WHEN c = 0 AND i < 2 THEN {'n': 'core_boost', 'f': CASE i WHEN 0 THEN 1.35 ELSE 1.15 END} END, CASE WHEN c = 1 AND i = 2 AND shared THEN {'n': 'matching_boost', 'f': 1.5} END,
  CASE WHEN c = 1 AND i = 2 AND NOT shared THEN {'n': 'unmatched_penalty', 'f': 0.8} END, CASE WHEN c = 1 AND i < 2 THEN {'n': 'special_penalty', 'f': CASE i WHEN 0 THEN 0.7 ELSE 0.88 END} END,
  CASE WHEN c = 2 THEN {'n': 'support_penalty', 'f': CASE i WHEN 0 THEN 0.75 WHEN 1 THEN 0.8 ELSE 0.9 END} END, CASE WHEN repeal THEN {'n': 'repeal_penalty', 'f': 0.5} END, CASE WHEN old THEN {'n': 'historic_penalty', 'f': 0.65} END], lambda x: x IS NOT NULL) AS l FROM p)
SELECT p_partkey, array_to_string(list_transform(l, lambda x: x.n), ',') AS rules, round_even(coalesce(list_product(list_transform(l, lambda x: x.f::DOUBLE)), 1.0)::DOUBLE, 6) AS factor FROM r
"""

QUERIES = (places, reference_targets, structure_units, structure_chunks, law_classes, rank_factors, revisions, json_pick, limiter, hourly_counts)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "reference_targets": "SELECT o_orderkey, 'BEK ' || o_custkey || '/1999' AS target FROM orders UNION SELECT o_orderkey, 'LOV ' || o_orderkey || '/2001' FROM orders",
        "structure_units": UNITS_SQL,
        "limiter": LIMITER_SQL,
        "rank_factors": FACTORS_SQL,
        "law_classes": LAW_SQL,
        "revisions": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 5.0 WHEN s_suppkey % 3 = 0 THEN 3.0 ELSE s_acctbal END::DOUBLE AS s_acctbal, CASE WHEN s_suppkey % 5 = 0 THEN 2 WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS revision FROM supplier",
        "json_pick": "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events",
        "hourly_counts": "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    }
