"""Queries of the rule, profile, place and structure operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import applicability as A
from lexforge.operators import drafting as R
from lexforge.operators import flat_rules as K
from lexforge.operators import geography as P
from lexforge.operators import profiles as D
from lexforge.operators import structure as S
from lexforge.sources import acts as T


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


VESSEL_RULES = (
    {
        "rule_id": "R1", "citation": "§ 1", "topic_category": "safety", "valid_from": "2000-01-01", "keel_laid_after": "1994-01-01",
        "inclusion_conditions": [{"field": "gross_tonnage", "operator": "gte", "target_value": 1000}, {"field": "primary_type", "operator": "in", "target_value": ["cargo", "tanker"]}],
        "exclusion_conditions": [{"field": "propulsion_type", "operator": "neq", "target_value": "mechanical"}],
    },
    {"rule_id": "R2", "citation": "§ 2", "topic_category": "crew", "inclusion_conditions": [{"field": "actual_crew_count", "operator": "gt", "target_value": 10}], "exclusion_conditions": [{"field": "flag_state", "operator": "eq", "target_value": "N7"}]},
    {"rule_id": "R3", "citation": "§ 3", "topic_category": "crew", "valid_to": "2010-12-31", "inclusion_conditions": [{"field": "gross_tonnage", "operator": "gt", "target_value": 0}], "exclusion_conditions": []},
    {"rule_id": "R4", "citation": "§ 4", "topic_category": "safety", "inclusion_conditions": [{"field": "flag_state", "operator": "gt", "target_value": "DK"}], "exclusion_conditions": []},
)


def _vessels(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as vessels: every third was converted, every fourth gives its crew, every tenth its propulsion."""
    part = _t(spark, sf, "part")
    k = F.col("p_partkey")
    given = F.array_compact(F.array(F.when(k % 4 == 0, F.lit("actual_crew_count")), F.when(k % 10 == 0, F.lit("propulsion_type"))))
    return part.select(
        k.alias("vessel"), F.col("p_name").alias("vessel_name"), F.concat(F.lit("N"), F.col("p_size").cast("string")).alias("flag_state"),
        F.when(k % 3 == 0, "Cargo ").otherwise("fishing").alias("primary_type"), F.col("p_retailprice").alias("gross_tonnage"), F.lit("domestic").alias("operating_area"),
        F.date_add(F.lit("1990-01-01").cast("date"), (k % 3000).cast("int")).alias("keel_laid_date"),
        F.when(k % 3 == 0, F.lit("1995-06-01").cast("date")).alias("major_conversion_date"),
        F.lit("2020-06-30").cast("date").alias("assessment_date"), (k % 30).alias("actual_crew_count"), F.when(k % 20 == 0, "sail_auxiliary").otherwise("mechanical").alias("propulsion_type"), given.alias("supplied"),
    )


def vessel_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    out = K.evaluate(_vessels(spark, sf), VESSEL_RULES, "vessel")
    return out.select("vessel", "rule_id", "topic_category", "verdict", "step", F.array_join("missing_fields", ",").alias("missing"), "via_conversion")


VESSELS = """
v AS (SELECT p_partkey AS k, p_size AS s, p_retailprice AS gt, p_partkey % 3 = 0 AS cargo, DATE '1990-01-01' + (p_partkey % 3000)::INT AS keel, p_partkey % 30 AS crew, p_partkey % 4 = 0 AS crew_given, p_partkey % 20 = 0 AS sails FROM part),
w AS (SELECT *, keel >= DATE '1994-01-01' AS inside, cargo AND keel < DATE '1994-01-01' AS converted FROM v),
verdicts AS (
  SELECT k AS vessel, 'R1' AS rule_id, 'safety' AS topic_category, CASE WHEN NOT inside AND NOT converted THEN 'DOES_NOT_APPLY' WHEN sails THEN 'DOES_NOT_APPLY' WHEN NOT (gt >= 1000 AND cargo) THEN 'DOES_NOT_APPLY' WHEN converted THEN 'POSSIBLY_APPLIES' ELSE 'APPLIES' END AS verdict,
    CASE WHEN NOT inside AND NOT converted THEN 'keel_laid' WHEN sails THEN 'exclusions' ELSE 'inclusions' END AS step, '' AS missing, converted AS via_conversion FROM w
  UNION ALL SELECT k, 'R2', 'crew', CASE WHEN s = 7 THEN 'DOES_NOT_APPLY' WHEN NOT crew_given THEN 'NEEDS_MANUAL_REVIEW' WHEN crew > 10 THEN 'APPLIES' ELSE 'DOES_NOT_APPLY' END,
    CASE WHEN s = 7 THEN 'exclusions' WHEN NOT crew_given THEN 'missing_data' ELSE 'inclusions' END, CASE WHEN s <> 7 AND NOT crew_given THEN 'actual_crew_count' ELSE '' END, false FROM w
  UNION ALL SELECT k, 'R3', 'crew', 'DOES_NOT_APPLY', 'temporal_validity', '', false FROM w
  UNION ALL SELECT k, 'R4', 'safety', 'NEEDS_MANUAL_REVIEW', 'invalid', '', false FROM w)
"""


def vessel_report(spark: SparkSession, sf: str) -> DataFrame:
    return K.report(K.evaluate(_vessels(spark, sf), VESSEL_RULES, "vessel"))


REPORT_SQL = f"WITH {VESSELS} SELECT topic_category, {', '.join(f'''count(*) FILTER (WHERE verdict = '{v}') AS {v}''' for v in K.VERDICTS)}, count(*) AS total FROM verdicts GROUP BY 1"


def _rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as rules, their comments as source texts; some rows were changed after they were approved."""
    k = F.col("n_nationkey")
    text = F.concat(F.lit("The rule of the nation called "), "n_name", F.lit(" applies to all of its ships."))
    return _t(spark, sf, "nation").select(
        F.concat(F.lit("N"), F.lpad(k.cast("string"), 2, "0")).alias("rule_id"), F.when(k % 6 == 0, F.concat(text, F.lit("!"))).otherwise(text).alias("source_text"), F.sha2(text, 256).alias("source_text_hash"),
        F.sha2(F.col("n_name"), 256).alias("content_hash"), F.when(k % 4 == 0, "old").otherwise(F.sha2(F.col("n_name"), 256)).alias("approved_content_hash"), F.when(k % 5 != 0, k % 3).alias("version_key"),
        F.when(k % 2 == 0, "APPROVED").otherwise("DRAFT").alias("status"), F.lit("ann").alias("author"), F.lit(None).cast("string").alias("approved_by"),
    )


def rule_integrity(spark: SparkSession, sf: str) -> DataFrame:
    versions = _t(spark, sf, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("version_key"), F.lit("The rule  of the nation called CHINA applies\nto all of its ships.").alias("content"))
    return K.integrity(_rule_table(spark, sf), versions, deep=True).select("rule_id", "problem")


INTEGRITY_SQL = """
SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS rule_id, CASE WHEN n_nationkey % 6 = 0 THEN 'source_text_changed' WHEN n_nationkey % 5 = 0 THEN 'no_source_version' WHEN n_nationkey % 4 = 0 THEN 'content_changed' WHEN n_name <> 'CHINA' THEN 'not_found' END AS problem FROM nation
"""


def ruleset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return K.ruleset_fingerprint(_rule_table(spark, sf))


FINGERPRINT_SQL = f"""
SELECT sha256('{{"engine":"{K.ENGINE_VERSION}","rules":[' || string_agg('["N' || lpad(n_nationkey::VARCHAR, 2, '0') || '","' || sha256(n_name) || '"]', ',' ORDER BY n_nationkey) || ']}}') AS fingerprint FROM nation WHERE n_nationkey % 2 = 0
"""


def rule_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Approvals by the author, a generator and others, deprecations, and steps that aren't allowed."""
    rules = _rule_table(spark, sf)
    k = F.substring("rule_id", 2, 2).cast("int")
    to = F.when(k % 3 == 0, "DEPRECATED").otherwise("APPROVED")
    actor = F.element_at(F.array(F.lit("ann"), F.lit("bo"), F.lit("generator:x")), (k % 3 + 1).cast("int"))
    requests = rules.where(k < 20).select("rule_id", to.alias("to"), actor.alias("actor"), F.when(k == 7, "other").otherwise(F.col("content_hash")).alias("expected_hash"))
    return K.moved(rules, requests).select("rule_id", "status", "approved_by", "refusal")


MOVES_SQL = """
WITH r AS (SELECT n_nationkey AS k, 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS rule_id, CASE WHEN n_nationkey % 2 = 0 THEN 'APPROVED' ELSE 'DRAFT' END AS s FROM nation),
q AS (SELECT *, CASE WHEN k >= 20 THEN NULL WHEN k % 3 = 0 THEN 'DEPRECATED' ELSE 'APPROVED' END AS t, ['ann', 'bo', 'generator:x'][k % 3 + 1] AS actor FROM r),
d AS (SELECT *, CASE WHEN t IS NULL THEN NULL WHEN t = 'APPROVED' AND s = 'DRAFT' AND actor = 'ann' THEN 'separation_of_duties' WHEN t = 'APPROVED' AND s = 'DRAFT' AND actor = 'generator:x' THEN 'generator_may_not_approve'
  WHEN t = 'APPROVED' AND s = 'DRAFT' AND k = 7 THEN 'changed_since_review' WHEN t = 'APPROVED' AND s = 'DRAFT' OR t = 'DEPRECATED' AND s = 'APPROVED' THEN NULL ELSE 'not_allowed' END AS refusal FROM q)
SELECT rule_id, CASE WHEN t IS NOT NULL AND refusal IS NULL THEN t ELSE s END AS status, CASE WHEN t = 'APPROVED' AND refusal IS NULL THEN actor END AS approved_by, refusal FROM d
"""


def draft_actions(spark: SparkSession, sf: str) -> DataFrame:
    rules = _rule_table(spark, sf)
    k = F.substring("rule_id", 2, 2).cast("int")
    drafts = rules.select(F.when(k % 5 == 0, F.concat(F.lit("X"), "rule_id")).otherwise(F.col("rule_id")).alias("rule_id"), F.when(k % 3 == 0, F.col("content_hash")).otherwise(F.lit("new")).alias("content_hash"))
    return K.drafted(rules, drafts)


DRAFTS_SQL = """
SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'X' ELSE '' END || 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS rule_id,
  CASE WHEN n_nationkey % 5 = 0 THEN 'create' WHEN n_nationkey % 3 = 0 THEN 'unchanged' WHEN n_nationkey % 2 = 1 THEN 'replace' ELSE 'conflict' END AS action FROM nation
"""

GROUPS = {"passenger": ["PROMO"], "tanker": ["SMALL"], "fishing": ["MEDIUM"], "offshore": ["LARGE"], "cargo": ["ECONOMY"]}


def derived_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as profiles: the first word of a type is the ship's type."""
    k, size = F.col("p_partkey"), F.col("p_size")
    profiles = _t(spark, sf, "part").select(
        "p_partkey", F.array(F.substring_index("p_type", " ", 1)).alias("types"), F.when(k % 3 == 0, F.array(F.lit("towing"))).when(k % 3 == 1, F.array(F.lit("drilling"))).alias("operations"),
        F.when(k % 2 == 0, size).alias("passengers"), F.when(k % 5 == 0, False).alias("carries_passengers"), F.when(k % 7 != 0, size * 1.0).alias("length_rule"), (size * 2.0).alias("length_overall"),
        F.lit(2.0).alias("breadth"), F.lit(3.0).alias("depth"), F.when(k % 4 == 0, size * 6.5).when(k % 4 == 1, size * 9.0).alias("declared_dimension"),
    )
    out = D.derive_facts(profiles, GROUPS, ["drilling"])
    return out.select("p_partkey", "category", "is_passenger_ship", "is_cargo_ship", "is_fishing_vessel", "is_offshore_unit", "rule_length", "dimension_number", F.array_join("conflicts", ",").alias("conflicts"))


FACTS_SQL = """
WITH p AS (SELECT p_partkey AS k, p_size AS s, string_split(p_type, ' ')[1] AS t, p_partkey % 2 = 0 AS has FROM part), q AS (SELECT *, CASE WHEN k % 7 <> 0 THEN s * 1.0::DOUBLE ELSE s * 2.0::DOUBLE END AS l, CASE WHEN k % 4 = 0 THEN s * 6.5::DOUBLE WHEN k % 4 = 1 THEN s * 9.0::DOUBLE END AS d FROM p)
SELECT k AS p_partkey, CASE t WHEN 'PROMO' THEN 'passenger' WHEN 'SMALL' THEN 'tanker' WHEN 'MEDIUM' THEN 'fishing' WHEN 'LARGE' THEN 'offshore' WHEN 'ECONOMY' THEN 'cargo' ELSE 'other' END AS category,
  CASE WHEN t = 'PROMO' THEN true WHEN has THEN s > 12 WHEN k % 5 = 0 THEN false END AS is_passenger_ship, t IN ('ECONOMY', 'SMALL') AS is_cargo_ship, t = 'MEDIUM' AS is_fishing_vessel,
  CASE WHEN t = 'LARGE' OR k % 3 = 1 THEN true WHEN k % 3 = 0 THEN false END AS is_offshore_unit, l AS rule_length, coalesce(d, round_even(l * 6, 2)) AS dimension_number,
  array_to_string(list_filter([CASE WHEN t = 'PROMO' AND has AND s <= 12 THEN 'passenger_count_inconsistent' END, CASE WHEN t = 'MEDIUM' AND k % 3 <> 2 THEN 'fishing_operation_missing' END, CASE WHEN abs(d - l * 6) > l * 6 * 0.1 THEN 'dimension_mismatch' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM q
"""

GATED = {
    "rule_id": "G", "inclusion": {"all": [{"field": "c_acctbal", "operator": "gte", "value": 5000}, {"field": "rating", "operator": "gt", "value": 3}]}, "exclusion": {"field": "c_mktsegment", "operator": "eq", "value": "BUILDING"},
    "valid_from": "1990-01-01", "valid_to": "2019-12-31", "flag_states": ["1", "2"], "port_state_applies": True, "coverage": "partial", "discretion": ["may_exempt"], "gaps": 1,
}


def six_gates(spark: SparkSession, sf: str) -> DataFrame:
    """A past rule over all customers, as the law stood: flags by nation, ports of every third, `rating` of every other one."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    customers = _t(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.when(k % 2 == 0, k % 7).alias("rating"), F.when(nation > 0, (nation % 4).cast("string")).alias("flag"), F.when(k % 3 == 0, F.array(F.lit("2"))).alias("ports"))
    kinds = {"c_acctbal": "number", "rating": "number", "c_mktsegment": "text"}
    past = A.assess(customers, GATED, kinds, "c_custkey", "2020-06-30", "historical").withColumn("mode", F.lit("historical"))
    return past.union(A.assess(customers, GATED, kinds, "c_custkey", "2020-06-30").withColumn("mode", F.lit("current")))


GATES_SQL = """
WITH c AS (SELECT c_custkey, c_acctbal AS b, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 END AS r, c_mktsegment = 'BUILDING' AS excluded, CASE WHEN c_nationkey > 0 THEN c_nationkey % 4 END AS f, c_custkey % 3 = 0 AS port FROM customer),
g AS (SELECT *, CASE WHEN f IS NOT NULL THEN f IN (1, 2) OR port END AS here, b >= 5000 AND r > 3 AS inside, b >= 5000 AS i1, r > 3 AS i2, coalesce(b <> 5000 AND abs(b - 5000) <= 100, false) AS n1 FROM c),
h AS (SELECT *, here AND inside AS whole, (CASE WHEN NOT i1 THEN 1 ELSE 0 END) + (CASE WHEN NOT i2 THEN 1 ELSE 0 END) AS failed, CASE WHEN NOT i1 AND n1 THEN 1 ELSE 0 END AS narrow, (CASE WHEN i2 IS NULL THEN 1 ELSE 0 END) AS unknown FROM g),
v AS (SELECT *, CASE WHEN NOT here THEN 'DOES_NOT_APPLY' WHEN NOT whole AND failed > 0 AND failed = narrow THEN CASE WHEN unknown > 0 THEN 'NEEDS_MANUAL_REVIEW' ELSE 'POSSIBLY_APPLIES' END
  WHEN NOT whole OR excluded THEN 'DOES_NOT_APPLY' WHEN whole IS NULL THEN 'NEEDS_MANUAL_REVIEW' ELSE 'POSSIBLY_APPLIES' END AS verdict,
  CASE WHEN NOT here THEN 'jurisdiction' WHEN NOT whole THEN 'conditions' WHEN excluded THEN 'exclusions' ELSE 'decision' END AS gate FROM h)
SELECT c_custkey, 'G' AS rule_id, m AS mode, CASE WHEN m = 'current' THEN 'temporal' ELSE gate END AS gate, CASE WHEN m = 'current' THEN 'DOES_NOT_APPLY' ELSE verdict END AS verdict,
  (100 - 25 - least(15 * unknown, 45) - CASE WHEN n1 THEN 10 ELSE 0 END - 5 - 10 - 2)::INT AS confidence, n1 AS near, unknown::INT AS unknown FROM v, (VALUES ('historical'), ('current')) x(m)
"""

#: Sentences about a nation, and what each says about it.
SENTENCES = (
    ("Reglerne gælder for skibe i {}.", "APPLIES", 0.85),
    ("Reglerne gælder dog ikke for skibe i {}.", "EXEMPTS", 0.75),
    ("Det er nævnt i {} i går.", "MENTIONS", 0.4),
    ("Skibe i {} er ikke omfattet.", "EXEMPTS", 0.7),
    ("Ved havet {} forstås farvandet.", "DEFINES", 0.85),
    ("Reglen er ophævet for {}.", "HISTORICAL", 0.6),
    ("Loven gælder ikke for os, men gælder i {}.", "APPLIES", 0.85),
)


def _claimed(spark: SparkSession, sf: str) -> DataFrame:
    named = F.element_at(F.array(*[F.concat(F.lit(a), "n_name", F.lit(b)) for a, b in (s[0].split("{}") for s in SENTENCES)]), (F.col("s_suppkey") % len(SENTENCES) + 1).cast("int"))
    return _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", named.alias("text"), F.when(F.col("s_suppkey") % 9 == 0, "Historisk").alias("status"))


def _nations(spark: SparkSession, sf: str) -> list[P.Area]:
    """A gazetteer of the nations, those of one region only as mentions: a bounded table."""
    return [P.Area(r.n_name.lower().replace(" ", "-"), [r.n_name], r.n_regionkey == 4, 0.9 if r.n_regionkey == 1 else 1.0) for r in _t(spark, sf, "nation").collect()]


def place_claims(spark: SparkSession, sf: str) -> DataFrame:
    """What sentences say about the nations in them; UNITED STATES and UNITED KINGDOM overlap with no other name."""
    found = P.detect(_claimed(spark, sf), _nations(spark, sf), "s_suppkey", "text", "status")
    return found.select("s_suppkey", "slug", F.col("start").cast("int").alias("start"), "applicability", "confidence", "match_text", "evidence_hash")


def _claims() -> str:
    case = lambda f: "CASE s_suppkey % 7 " + " ".join(f"WHEN {i} THEN {f(s)}" for i, s in enumerate(SENTENCES)) + " END"
    return f"""
WITH n AS (SELECT s_suppkey, n_name, n_regionkey, {case(lambda s: f"'{s[0].split('{}')[0]}'")} AS a, {case(lambda s: f"'{s[0].split('{}')[1]}'")} AS b, {case(lambda s: f"'{s[1]}'")} AS k, {case(lambda s: f"{s[2]}::DOUBLE")} AS c, s_suppkey % 9 = 0 AS old FROM supplier JOIN nation ON n_nationkey = s_nationkey),
m AS (SELECT *, n_regionkey = 4 AND k <> 'MENTIONS' AS mentioned FROM n)
SELECT s_suppkey, lower(replace(n_name, ' ', '-')) AS slug, length(a)::INT AS start, CASE WHEN old THEN 'HISTORICAL' WHEN mentioned THEN 'MENTIONS' ELSE k END AS applicability,
  round_even((CASE WHEN mentioned THEN least(c, 0.4) ELSE c END * CASE WHEN n_regionkey = 1 THEN 0.9 ELSE 1.0 END)::DOUBLE, 3) AS confidence, n_name AS match_text,
  sha256('content' || chr(0) || n_name || chr(0) || a || n_name || b || chr(0) || CASE WHEN old THEN 'Historisk' ELSE '' END || chr(0)) AS evidence_hash FROM m
"""


def area_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = P.detect(_claimed(spark, sf), _nations(spark, sf), "s_suppkey", "text")
    areas = _t(spark, sf, "nation").select(F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("-"))).alias("slug"))
    out = P.area_counts(found, areas, "s_suppkey")
    return out.select("slug", "documents", F.coalesce(F.element_at("by_class", "EXEMPTS"), F.lit(0)).alias("exempts"))


AREA_SQL = """
SELECT lower(replace(n_name, ' ', '-')) AS slug, count(s_suppkey) AS documents, count(*) FILTER (WHERE s_suppkey % 7 IN (1, 3) AND n_regionkey <> 4) AS exempts FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, n_regionkey
"""


def publication_states(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as findings in all states of evidence, class, review and context."""
    k = F.col("o_orderkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % n + 1).cast("int"))
    state = P.publication(pick(4, "current", "current", "superseded", "current"), pick(3, "APPLIES", "MENTIONS", "EXEMPTS"), pick(5, "confirmed", "unreviewed", "corrected", "needs_rereview", "rejected"), k % 2, F.lit(0), k % 7, F.lit(0))
    return _t(spark, sf, "orders").select("o_orderkey", state.alias("state"), F.substring(P.label(state), 1, 8).alias("label"))


PUBLICATION_SQL = """
WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 2 THEN 'superseded' WHEN o_orderkey % 5 IN (0, 2) AND o_orderkey % 2 = 0 AND o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 3 = 1 THEN 'reviewed_mention' ELSE 'reviewed' END
  WHEN o_orderkey % 5 IN (0, 2, 3) THEN 'needs_rereview' WHEN o_orderkey % 3 = 1 THEN 'detected_mention_unreviewed' ELSE 'detected_unreviewed' END AS state FROM orders)
SELECT k AS o_orderkey, state, CASE WHEN starts_with(state, 'reviewed') THEN 'Reviewed' WHEN state = 'superseded' THEN 'Historic' ELSE 'Detected' END AS label FROM s
"""


def unchanged_analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to analyse anew: their input or the detector changed since their last run."""
    docs = _t(spark, sf, "documents").select("doc_id", P.input_hash(F.lit(None), F.col("text"), F.col("lang"), "g1").alias("digest"))
    runs = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("digest")).alias("digest"), F.when(F.col("doc_id") % 4 == 0, "1").otherwise("2").alias("detector_version"), F.lit(1).alias("finished")).where("doc_id % 5 <> 0")
    return P.to_analyse(docs, runs, "doc_id", "digest", "2").select("doc_id", "digest")


ANALYSES_SQL = "SELECT doc_id, sha256(chr(0) || coalesce(text, '') || chr(0) || coalesce(lang, '') || chr(0) || 'g1' || chr(0)) AS digest FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 5 = 0"


def review_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as findings that supersede the order five before, with its review."""
    k = F.col("o_orderkey")
    rows = _t(spark, sf, "orders").select(k.alias("id"), (k - 5).alias("supersedes_id"), F.when(k % 2 == 0, "confirmed").otherwise("unreviewed").alias("review_status"), F.col("o_orderstatus").alias("evidence_hash"))
    return P.previous_reviews(rows).select("id", F.coalesce("previous.id", F.lit(-1)).alias("previous_id"), F.col("previous.review_status").alias("previous_status"), "excerpt_unchanged")


REVIEWS_SQL = "SELECT a.o_orderkey AS id, coalesce(b.o_orderkey, -1) AS previous_id, CASE WHEN b.o_orderkey IS NULL THEN NULL WHEN b.o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'unreviewed' END AS previous_status, a.o_orderstatus = b.o_orderstatus AS excerpt_unchanged FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey - 5"


def _flat_acts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as acts on one line, with references that are no paragraphs; every third is an act with lines."""
    n, s = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    flat = F.concat(F.lit("Kapitel 1 Om "), s, F.lit(" § 1. Kunde "), n, F.lit(" er omfattet, jf. § 2. Stk. 2. Det gælder også efter § 7. § 2. Kravet er nævnt i § 1. Kapitel 2 Slut § 3. Loven træder i kraft."))
    lines = F.concat(F.lit("Afsnit I\nDel "), s, F.lit("\nKapitel 1\nOm "), s, F.lit("\n§ 1. Kunde "), n, F.lit(".\nStk. 2. Mere.\n§ 1 a. Ende."))
    return _t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, lines).otherwise(flat).alias("text"))


def act_units(spark: SparkSession, sf: str) -> DataFrame:
    return S.units(_flat_acts(spark, sf), "c_custkey", "text").where("kind IN ('paragraph', 'subsection')").select("c_custkey", "kind", "part", "part_title", "chapter", "chapter_title", "number", "letter", F.coalesce("subsection", F.lit(0)).alias("subsection"), "sort_key", "text")


UNITS_SQL = """
WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS n, c_mktsegment AS s, c_custkey % 3 = 0 AS lined FROM customer)
SELECT c_custkey, u.kind AS kind, CASE WHEN lined THEN 'I' END AS part, CASE WHEN lined THEN 'Del ' || s END AS part_title, u.ch AS chapter, CASE WHEN u.ch = '1' THEN 'Om ' || s ELSE 'Slut' END AS chapter_title, u.num AS number, u.letter AS letter, coalesce(u.sub, 0)::INT AS subsection, lpad(u.num, 4, '0') || coalesce(u.letter, '') AS sort_key, u.t AS text
FROM (SELECT *, unnest(CASE WHEN lined THEN [
  {'kind': 'paragraph', 'ch': '1', 'num': '1', 'letter': NULL, 'sub': NULL, 't': '§ 1. Kunde ' || n || '.' || chr(10) || 'Stk. 2. Mere.'}, {'kind': 'subsection', 'ch': '1', 'num': '1', 'letter': NULL, 'sub': 2, 't': 'Stk. 2. Mere.'}, {'kind': 'paragraph', 'ch': '1', 'num': '1', 'letter': 'a', 'sub': NULL, 't': '§ 1 a. Ende.'}]
ELSE [
  {'kind': 'paragraph', 'ch': '1', 'num': '1', 'letter': NULL, 'sub': NULL, 't': '§ 1. Kunde ' || n || ' er omfattet, jf. § 2. Stk. 2. Det gælder også efter § 7.'}, {'kind': 'subsection', 'ch': '1', 'num': '1', 'letter': NULL, 'sub': 2, 't': 'Stk. 2. Det gælder også efter § 7.'},
  {'kind': 'paragraph', 'ch': '1', 'num': '2', 'letter': NULL, 'sub': NULL, 't': '§ 2. Kravet er nævnt i § 1.'}, {'kind': 'paragraph', 'ch': '2', 'num': '3', 'letter': NULL, 'sub': NULL, 't': '§ 3. Loven træder i kraft.'}] END) AS u FROM c)
"""


def act_chunks(spark: SparkSession, sf: str) -> DataFrame:
    acts = _flat_acts(spark, sf).where("c_custkey % 3 <> 0").withColumn("title", F.lit("Loven"))
    return S.chunked(acts, "c_custkey", "text", title="title").select("c_custkey", "chunk_index", "kind", "citation", "legal_path", "heading", "embedding_text")


CHUNKS_SQL = """
WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS n, c_mktsegment AS s FROM customer WHERE c_custkey % 3 <> 0),
u AS (SELECT c_custkey, unnest([
  {'i': 0, 'p': '§ 1', 'ch': '1', 'h': 'Om ' || s, 't': 'Kapitel 1 Om ' || s || ' § 1. Kunde ' || n || ' er omfattet, jf. § 2. Stk. 2. Det gælder også efter § 7.'}, {'i': 1, 'p': '§ 2', 'ch': '1', 'h': 'Om ' || s, 't': '§ 2. Kravet er nævnt i § 1.'}, {'i': 2, 'p': '§ 3', 'ch': '2', 'h': 'Slut', 't': 'Kapitel 2 Slut § 3. Loven træder i kraft.'}]) AS u FROM c)
SELECT c_custkey, u.i::INT AS chunk_index, 'paragraph' AS kind, 'Loven ' || u.p || ', kapitel ' || u.ch AS citation, 'Kapitel ' || u.ch || ' · ' || u.p AS legal_path, u.p AS heading, 'Loven — Kapitel ' || u.ch || ' — ' || u.h || ' · ' || u.p || chr(10) || u.t AS embedding_text FROM u
"""


def paragraph_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """The anchors of the places where acts name the customer and where they end."""
    acts = _flat_acts(spark, sf)
    found = S.units(acts, "c_custkey", "text")
    end = F.length("text") - 2
    places = acts.select("c_custkey", F.explode(F.array(F.instr("text", "Kunde "), F.instr("text", "Stk. 2."), end)).alias("at"))
    return S.anchors(places, found, "c_custkey", "at")


ANCHORS_SQL = """
WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS n, c_mktsegment AS s, c_custkey % 3 = 0 AS lined FROM customer),
t AS (SELECT *, CASE WHEN lined THEN 'Afsnit I' || chr(10) || 'Del ' || s || chr(10) || 'Kapitel 1' || chr(10) || 'Om ' || s || chr(10) || '§ 1. Kunde ' || n || '.' || chr(10) || 'Stk. 2. Mere.' || chr(10) || '§ 1 a. Ende.'
  ELSE 'Kapitel 1 Om ' || s || ' § 1. Kunde ' || n || ' er omfattet, jf. § 2. Stk. 2. Det gælder også efter § 7. § 2. Kravet er nævnt i § 1. Kapitel 2 Slut § 3. Loven træder i kraft.' END AS text FROM c),
p AS (SELECT c_custkey, unnest([strpos(text, 'Kunde '), strpos(text, 'Stk. 2.'), length(text) - 2])::INT AS at, unnest(['p-1-1', 'p-1-1-stk2', CASE WHEN lined THEN 'p-1-1a' ELSE 'p-2-3' END]) AS anchor FROM t)
SELECT * FROM p
"""


def contents_tables(spark: SparkSession, sf: str) -> DataFrame:
    out = S.contents(S.units(_flat_acts(spark, sf), "c_custkey", "text"), "c_custkey")
    chapters = F.transform("contents", lambda c: F.concat(c["chapter"], F.lit(":"), F.array_join(F.transform(c["paragraphs"], lambda p: p["label"]), "|")))
    return out.select("c_custkey", F.array_join(chapters, ";").alias("contents"))


def _scoped_acts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as acts with a paragraph of scope: an application with a bound, an exemption, discretion and a definition."""
    n = F.col("p_size").cast("string")
    text = F.concat(
        F.lit("§ 1. Bekendtgørelsen gælder for passagerskibe i international fart med en bruttotonnage på "), n, F.lit(" eller derover.\nStk. 2. Den gælder ikke for fiskeskibe under 15,5 meter.\nStk. 3. Søfartsstyrelsen kan fravige kravene.\n"),
        F.lit("§ 2. Ved et skib forstås ved denne lov alt.\n§ 3. Den omfatter anlæg.\n§ 4. Noget andet."),
    )
    return _t(spark, sf, "part").select("p_partkey", text.alias("text"))


def rule_provisions(spark: SparkSession, sf: str) -> DataFrame:
    found = R.provisions(_scoped_acts(spark, sf), "p_partkey", "text")
    shown = F.transform("atoms", lambda a: F.concat_ws(" ", a["field"], a["operator"], F.coalesce(F.array_join(a["types"], "+"), a["number"].cast("string")), a["confidence"]))
    return found.select("p_partkey", "ref", "citation_key", "kind", "text_hash", F.array_join(shown, "; ").alias("atoms"), F.coalesce("gap", F.lit("")).alias("gap"))


PROVISIONS_SQL = """
WITH p AS (SELECT p_partkey, p_size::VARCHAR AS n FROM part),
u AS (SELECT p_partkey, unnest([
  {'ref': '§ 1, stk. 1', 'k': 'p1s1', 'kind': 'inclusion', 't': '§ 1. Bekendtgørelsen gælder for passagerskibe i international fart med en bruttotonnage på ' || n || ' eller derover.', 'a': 'vessel.all_types intersects high_speed_passenger_craft+passenger_ship+ro_ro_passenger_ship high; operation.types intersects international_voyage high; dim.gross_tonnage gte ' || n || '.0 high', 'g': ''},
  {'ref': '§ 1, stk. 2', 'k': 'p1s2', 'kind': 'exclusion', 't': 'Stk. 2. Den gælder ikke for fiskeskibe under 15,5 meter.', 'a': 'vessel.all_types intersects fishing_vessel high; dim.length_rule_m lt 15.5 high', 'g': ''},
  {'ref': '§ 1, stk. 3', 'k': 'p1s3', 'kind': 'discretion', 't': 'Stk. 3. Søfartsstyrelsen kan fravige kravene.', 'a': '', 'g': 'discretion_to_model'},
  {'ref': '§ 2, stk. 1', 'k': 'p2s1', 'kind': 'definition', 't': '§ 2. Ved et skib forstås ved denne lov alt.', 'a': '', 'g': ''},
  {'ref': '§ 3, stk. 1', 'k': 'p3s1', 'kind': 'inclusion', 't': '§ 3. Den omfatter anlæg.', 'a': '', 'g': 'inclusion_unread'}]) AS u FROM p)
SELECT p_partkey, u.ref AS ref, u.k AS citation_key, u.kind AS kind, sha256(u.t) AS text_hash, u.a AS atoms, u.g AS gap FROM u
"""


def rule_drafts(spark: SparkSession, sf: str) -> DataFrame:
    return R.drafts(R.provisions(_scoped_acts(spark, sf), "p_partkey", "text"), "p_partkey")


DRAFTED_SQL = "SELECT p_partkey, u.r AS rule_ref, u.i::BIGINT AS inclusions, u.e::BIGINT AS exclusions, u.g::BIGINT AS gaps, u.c AS coverage FROM (SELECT p_partkey, unnest([{'r': '§ 1', 'i': 3, 'e': 2, 'g': 1, 'c': 'partial'}, {'r': '§ 3', 'i': 0, 'e': 0, 'g': 1, 'c': 'unparsed'}]) AS u FROM part)"


def xhtml_acts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as XHTML acts with an article, a table and an annex; every seventh page is no act."""
    k = F.col("s_suppkey")
    page = F.concat(
        F.lit('<html lang="eng"><body><div id="art_1"><p>Article 1</p><p>Supplier '), k.cast("string"), F.lit(" "), F.repeat(F.lit("is covered "), F.lit(20)),
        F.lit('</p><table><tr><td>A</td><td>B</td></tr></table></div><div id="anx_I"><p>ANNEX I</p></div>'), F.when(k % 7 == 0, "<img/>").otherwise(""), F.lit("</body></html>"),
    )
    found = T.read_acts(_t(spark, sf, "supplier").select("s_suppkey", page.alias("page")), "page")
    piece = lambda u: F.substr("content", u["start"] + 1, u["end"] - u["start"])
    return found.select("s_suppkey", F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce(F.array_join(F.transform("units", lambda u: F.concat_ws(":", u["kind"], u["heading"], F.length(piece(u)).cast("string"))), ";"), F.lit("")).alias("units"), F.coalesce(F.array_join(F.transform("cells", piece), "|"), F.lit("")).alias("cells"))


XHTML_SQL = """
SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'pictures' ELSE '' END AS problem, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'en' END AS language,
  CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'article:Article 1:' || (length('Article 1' || chr(10) || 'Supplier ' || s_suppkey || ' ' || trim(repeat('is covered ', 20)) || chr(10) || 'A | B' || chr(10)))::VARCHAR || ';annex:ANNEX I:8' END AS units,
  CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'A|B' END AS cells FROM supplier
"""


QUERIES = (
    *(rule_provisions, rule_drafts, xhtml_acts),
    *(vessel_verdicts, vessel_report, rule_integrity, ruleset_fingerprint, rule_moves, draft_actions, derived_facts, six_gates, place_claims, area_counts),
    *(publication_states, unchanged_analyses, review_chain, act_units, act_chunks, paragraph_anchors, contents_tables),
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "rule_provisions": PROVISIONS_SQL,
        "rule_drafts": DRAFTED_SQL,
        "xhtml_acts": XHTML_SQL,
        "vessel_verdicts": f"WITH {VESSELS} SELECT * FROM verdicts",
        "vessel_report": REPORT_SQL,
        "rule_integrity": INTEGRITY_SQL,
        "ruleset_fingerprint": FINGERPRINT_SQL,
        "rule_moves": MOVES_SQL,
        "draft_actions": DRAFTS_SQL,
        "derived_facts": FACTS_SQL,
        "six_gates": GATES_SQL,
        "place_claims": _claims(),
        "area_counts": AREA_SQL,
        "publication_states": PUBLICATION_SQL,
        "unchanged_analyses": ANALYSES_SQL,
        "review_chain": REVIEWS_SQL,
        "act_units": UNITS_SQL,
        "act_chunks": CHUNKS_SQL,
        "paragraph_anchors": ANCHORS_SQL,
        "contents_tables": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '1:§ 1|§ 1 a' ELSE '1:§ 1|§ 2;2:§ 3' END AS contents FROM customer",
    }
