"""The thin queries op1_ to op13_ and their SQL; the operators keep their own general interfaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexforge.llm.chat import format_chats, read_back

    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = read_back(format_chats(turns))
    digest = lambda texts: F.sha2(F.array_join(texts, "").cast("binary"), 256)
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns_sha256"),
        F.length(F.array_join("loss_texts", "")).cast("long").alias("loss_chars"),
        digest(F.col("loss_texts")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?(?:INST\]|s>))', '\1\\\2\3', 'g')) AS n,
         length(regexp_replace(role, '([\[<])(\\*)(/?(?:INST\]|s>))', '\1\\\2\3', 'g')) AS nr,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE WHEN before IS NULL OR before <> role THEN 6 + 7 + 4 + nr ELSE 3 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexforge.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), repetition=2.0).select("doc_id", "source", "n_tokens", "copy", "block", "block_order")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexforge.llm.substring import remove

    return remove(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexforge.llm.simhash import classes

    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexforge.llm.shards import balanced

    placed = balanced(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexforge.llm.html import extracted

    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexforge.llm.pieces import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(spark, docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexforge.llm.search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexforge.llm.quality import judged

    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op9_sql() -> str:
    from lexforge.llm.quality import RULES, STOP_WORDS

    ratio = {"mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "stop_word_ratio": ("n_stop", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_word_ratio": ("n_repeat_words", "n_words")}
    value = {"n_words": "n_words"} | {k: f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END)" for k, (a, b) in ratio.items()}
    rules = " AND ".join(f"{value[m]} {sign} {bound}" for m, least, most in RULES for sign, bound in ((">=", least), ("<=", most)) if bound is not None)
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)
), r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w.w, lambda x: x IN ({stop}))) AS n_stop
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM b
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexforge.llm.language import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(spark, docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model, keep_text=False)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexforge.llm.minhash import classes

    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexforge.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents").select("lang", "text"), longest=5, least=100, top=2000)


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM w, unnest([1, 2, 3, 4, 5]) AS s(size) WHERE len(w) >= size),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(c.w[i:i + m - 1], ' ') AS phrase, a FROM c, unnest([2, 3, 4]) AS s(m), unnest([1, 2, 3, 4]) AS t(i) WHERE m < size AND i + m - 1 <= size
), kept AS (SELECT c.* FROM c ANTI JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase AND i.a >= c.a),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM kept c, unnest([1, 2, 3, 4]) AS s(k), f l, f r, n
  WHERE k < c.size AND l.lang = c.lang AND r.lang = c.lang AND n.lang = c.lang
    AND l.phrase = array_to_string(c.w[1:k], ' ') AND r.phrase = array_to_string(c.w[k + 1:c.size], ' ') AND l.size = k AND r.size = c.size - k
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS b FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE b = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexforge.llm.codes import compress, with_group_error

    coded, books = compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return with_group_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _op13_sql() -> str:
    """Plain Lloyd: every round's assignment and entries as relations of their own."""
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        "x AS MATERIALIZED (SELECT vec_id, p, w[p * len(w) // 4 + 1:(p + 1) * len(w) // 4] AS w FROM v, range(4) AS t(p))",
        "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, w FROM x QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256)",
    ]
    for i in range(5):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT x.vec_id, x.p, b.e, list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{i} b ON b.p = x.p) GROUP BY vec_id, p
)""")
        if i < 4:
            steps.append(f"""m{i} AS (
  SELECT p, e, j, sum(c) AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(x.w) AS c, generate_subscripts(x.w, 1) AS j FROM a{i} a JOIN x ON x.vec_id = a.vec_id AND x.p = a.p) GROUP BY p, e, j
)""")
            steps.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM b{i} b LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS w FROM m{i} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e
)""")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)")
    steps.append("r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id)")
    return "WITH " + ",\n".join(steps) + "\nSELECT v.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v ON v.vec_id = r.vec_id, h"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op8_exact_top_k": OP8_SQL, "op9_quality_rules": _op9_sql(), "op12_phrases": OP12_SQL, "op13_vector_codes": _op13_sql()}
