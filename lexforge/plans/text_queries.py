"""Queries of the text, vector and configuration functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as X
from lexforge.functions import vectors as V
from lexforge.operators import terms as R

EN_WORDS = ("the", "of", "and", "to", "in", "that")
DE_WORDS = ("der", "die", "und", "ist", "von", "den")

# A small configuration in the words of the corpus.
TERMS = (R.Term("the", 2.0, "word", concept="article"), R.Term("th", 1.0, "prefix", concept="th"), R.Term("of the", 6.0, "substring", concept="genitive"), R.Term("und", 12.0, "word", concept="german"))
NEGATIVE = (R.Term("que", 4.0, "word"),)
CATEGORIES = (R.Category("english", TERMS[:3]), R.Category("german", (R.Term("der", 5.0), R.Term("die", 5.0), R.Term("und", 4.0))), R.Category("romance", (R.Term("de", 5.0), R.Term("la", 4.0), R.Term("en", 3.0))))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def text_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.sha2(X.fold(F.col("text")), 256).alias("folded_sha256"), F.size(X.tokenize(F.col("text"))).cast("long").alias("n_tokens"))


_FOLDED = "lower(" + "replace(" * 12 + "translate(nfc_normalize(coalesce({0},'')), 'éÉèÈô’‘“”–— ­', 'eEeEo''''\"\"-- ')" + "".join(f", '{a}', '{b}')" for a, b in X.FOLDED_TO_TWO.items()) + ")"
TEXT_FOLD_SQL = f"SELECT doc_id, sha256({_FOLDED.format('text')}) AS folded_sha256, len(regexp_extract_all({_FOLDED.format('text')}, '{X.TOKEN}'))::BIGINT AS n_tokens FROM documents"


def text_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


CONTENT_HASH_SQL = r"SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(coalesce(text,'')), '\s+', ' ', 'g'))) AS content_hash FROM documents"


def text_strip_html(spark: SparkSession, sf: str) -> DataFrame:
    out = X.strip_html(F.col("html"))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.sha2(out, 256).alias("stripped_sha256"), F.size(F.split(out, "\n")).cast("long").alias("n_lines"))


STRIP_SQL = r"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html,''), '</?(p|div|br|tr|li|h[1-6]|table|section|article)\b[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g') AS t FROM pages),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t,'&nbsp;',' '),'&amp;','&'),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;','''') AS t FROM s),
l AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM e)
SELECT page_id, sha256(t) AS stripped_sha256, len(string_split(t, chr(10)))::BIGINT AS n_lines FROM l
"""


def text_language_score(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.bround(X.language_score(F.col("text"), EN_WORDS, DE_WORDS), 6).alias("score"))


LANGUAGE_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all({_FOLDED.format('text')}, '{X.TOKEN}') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN {EN_WORDS})) AS a, len(list_filter(w, lambda x: x IN {DE_WORDS})) AS b FROM t)
SELECT doc_id, CASE WHEN n >= 12 AND a + b > 0 THEN round_even((a - b)::DOUBLE / (a + b), 6) ELSE 0.0 END AS score FROM c
"""


def text_contains_any(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", X.contains_any(F.col("text"), ["Étre", "ung", "zzz"]).alias("found"))


CONTAINS_SQL = f"SELECT doc_id, contains({_FOLDED.format('text')}, 'etre') OR contains({_FOLDED.format('text')}, 'ung') OR contains({_FOLDED.format('text')}, 'zzz') AS found FROM documents"


def relevance(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))
    out = R.score_relevance(docs, R.Relevance(TERMS, NEGATIVE))
    return out.select("doc_id", "raw", "score", "classification", "title_floor", F.array_join("concepts", ",").alias("concepts"))




def _hits(column: str, where: str) -> str:
    return f"least(len(list_filter({column}, lambda x: {where})), 3)"


_PARTS = (
    ("the", 2.0, "article", lambda c: _hits(f"{c}w", "x = 'the'")),
    ("th", 1.0, "th", lambda c: _hits(f"{c}w", "starts_with(x, 'th')")),
    ("of the", 6.0, "genitive", lambda c: f"least(len(regexp_extract_all({c}, 'of\\s+the')), 3)"),
    ("und", 12.0, "german", lambda c: _hits(f"{c}w", "x = 'und'")),
)
_RAW = " + ".join(f"{w} * ({f('c')} + 3 * {f('t')})" for _, w, _, f in _PARTS)
_FOUND = {c: f"({f('c')} + {f('t')} > 0)" for _, _, c, f in _PARTS}
RELEVANCE_SQL = f"""
WITH d AS (SELECT doc_id, {_FOLDED.format("text")} AS c, {_FOLDED.format("string_split(text, chr(10))[1]")} AS t FROM documents),
w AS (SELECT *, regexp_extract_all(c, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS cw, regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS tw FROM d),
p AS (SELECT doc_id, ({_RAW})::DOUBLE AS good, (4.0 * ({_hits("cw", "x = 'que'")} + 3 * {_hits("tw", "x = 'que'")}))::DOUBLE AS bad, {_hits("tw", "x = 'und'")} > 0 AS title_hit, {_hits("tw", "x = 'que'")} > 0 AS title_bad,
      list_filter([{", ".join(f"CASE WHEN {_FOUND[c]} THEN '{c}' END" for c in sorted(_FOUND))}], lambda x: x IS NOT NULL) AS concepts FROM w),
r AS (SELECT *, greatest(0.0::DOUBLE, good + least(greatest(len(concepts) - 1, 0) * 4.0, 20.0) - bad) AS raw FROM p),
s AS (SELECT *, CASE WHEN raw > 0 THEN round_even(100.0::DOUBLE * (raw / (raw + 45.0)), 0)::INT ELSE 0 END AS s FROM r),
f AS (SELECT *, title_hit AND NOT title_bad AND s < 70 AS title_floor FROM s)
SELECT doc_id, raw, CASE WHEN title_floor THEN 70 ELSE s END AS score, CASE WHEN title_floor OR s >= 60 THEN 'relevant' WHEN s >= 30 THEN 'possible' ELSE 'not_relevant' END AS classification, title_floor, array_to_string(concepts, ',') AS concepts FROM f
"""


def categories(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))
    return R.categorize(docs, CATEGORIES, "other").select("doc_id", F.posexplode("categories").alias("position", "c")).select("doc_id", "position", "c.slug", "c.confidence", "c.raw")


def vector_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    v = V.normalize(F.transform("embedding", lambda x: x * 3))
    return e.select("vec_id", F.posexplode(v).alias("i", "x")).withColumn("x", F.bround("x", 6))


NORMALIZE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM v)
SELECT vec_id, (i - 1)::INT AS i, round_even(v[i] / s, 6) AS x FROM n, generate_series(1, 64) g(i)
"""


def vector_centroids(spark: SparkSession, sf: str) -> DataFrame:
    c = V.centroids(spark.read.parquet(f"{sf}/embeddings.parquet"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.bround("x", 6))


CENTROID_SQL = """
WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, generate_series(1, 64) g(i) GROUP BY label, i),
n AS (SELECT label, sqrt(sum(x * x)) AS s FROM m GROUP BY label)
SELECT label, (i - 1)::INT AS i, round_even(x / s, 6) AS x FROM m JOIN n USING (label)
"""


def vector_hashing_embedding(spark: SparkSession, sf: str) -> DataFrame:
    e = V.hashing_embedding(F.col("text"), 64)
    return _docs(spark, sf).select("doc_id", F.posexplode(e).alias("i", "x")).withColumn("x", F.bround("x", 4))


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", X.snippet(F.col("text"), ["nicht", "avec"], 120).alias("snippet"))


# The first hit by every spelling that folds to a term; the window and its word ends as in the function.
SNIPPETS_SQL = r"""
WITH p AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\s+', ' ', 'g')) AS t FROM documents),
h AS (SELECT *, length(t) AS n, CASE WHEN regexp_matches(lower(t), 'nicht|av[eéè]c') THEN length(regexp_extract(lower(t), '(?s)^(.*?)(nicht|av[eéè]c)', 1)) ELSE -1 END AS hit FROM p),
s AS (SELECT *, greatest(0, hit - 60) AS a, least(n, greatest(0, hit - 60) + 120) AS z FROM h),
g AS (SELECT *, CASE WHEN strpos(substr(t, a + 1), ' ') > 0 THEN a + strpos(substr(t, a + 1), ' ') ELSE 0 END AS sp FROM s),
b AS (SELECT *, CASE WHEN a > 0 AND sp > 0 AND sp - 1 < hit THEN sp ELSE a END AS b FROM g),
c AS (SELECT *, substr(t, b + 1, z - b) AS cut, length(regexp_extract(substr(t, b + 1, z - b), '(\s\S*)$', 1)) AS back FROM b)
SELECT doc_id, CASE WHEN hit < 0 THEN substr(t, 1, 120) || CASE WHEN n > 120 THEN '…' ELSE '' END
  ELSE CASE WHEN b > 0 THEN '…' ELSE '' END || trim(CASE WHEN z < n AND back > 0 AND z - back > hit THEN substr(cut, 1, length(cut) - back) ELSE cut END) || CASE WHEN z < n THEN '…' ELSE '' END END AS snippet FROM c
"""

# Raw points of each category over title and text, from the same terms.
_CATEGORY_PARTS = (
    ("english", 0, "2.0 * (least(len(list_filter({w}, lambda x: x = 'the')), 3)) + 1.0 * least(len(list_filter({w}, lambda x: starts_with(x, 'th'))), 3) + 6.0 * least(len(regexp_extract_all({c}, 'of\\s+the')), 3)"),
    ("german", 1, "5.0 * least(len(list_filter({w}, lambda x: x = 'der')), 3) + 5.0 * least(len(list_filter({w}, lambda x: x = 'die')), 3) + 4.0 * least(len(list_filter({w}, lambda x: x = 'und')), 3)"),
    ("romance", 2, "5.0 * least(len(list_filter({w}, lambda x: x = 'de')), 3) + 4.0 * least(len(list_filter({w}, lambda x: x = 'la')), 3) + 3.0 * least(len(list_filter({w}, lambda x: x = 'en')), 3)"),
)
CATEGORIES_SQL = f"""
WITH d AS (SELECT doc_id, {_FOLDED.format("text")} AS c, {_FOLDED.format("string_split(text, chr(10))[1]")} AS t FROM documents),
w AS (SELECT *, regexp_extract_all(c, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS cw, regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS tw FROM d),
r AS ({" UNION ALL ".join(f"SELECT doc_id, '{slug}' AS slug, {n} AS n, (({parts.format(w='cw', c='c')}) + 3 * ({parts.format(w='tw', c='t')}))::DOUBLE AS raw FROM w" for slug, n, parts in _CATEGORY_PARTS)}),
k AS (SELECT doc_id, slug, row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, n) AS p, round_even(raw / (raw + 12), 4) AS confidence, round_even(raw, 2) AS raw FROM r WHERE raw > 0 AND raw / (raw + 12) >= 0.55),
f AS (SELECT doc_id FROM w WHERE doc_id NOT IN (SELECT doc_id FROM k))
SELECT doc_id, (p - 1)::INT AS position, slug, confidence, raw FROM k UNION ALL SELECT doc_id, 0, 'other', 0.55::DOUBLE, 0.0::DOUBLE FROM f
"""


def queries() -> dict:
    return {f.__name__: f for f in (text_fold, text_content_hash, text_strip_html, text_language_score, text_contains_any, relevance, categories, vector_normalize, vector_centroids, vector_hashing_embedding, snippets)}


def oracle_sql() -> dict[str, str]:
    return {"text_fold": TEXT_FOLD_SQL, "text_content_hash": CONTENT_HASH_SQL, "text_strip_html": STRIP_SQL, "text_language_score": LANGUAGE_SQL, "text_contains_any": CONTAINS_SQL, "relevance": RELEVANCE_SQL, "vector_normalize": NORMALIZE_SQL, "vector_centroids": CENTROID_SQL, "snippets": SNIPPETS_SQL, "categories": CATEGORIES_SQL}
