"""Search plans: filters, lexical and semantic candidates, their merge, the final rank, paging and facets."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import fold, fold_text, quote
from lexforge.functions.vectors import cosine

#: Weights of the parts of the final score, and the decay of positions.
WEIGHTS = {"lexical": 0.40, "semantic": 0.25, "authority": 0.15, "scope": 0.10, "relevance": 0.05, "status": 0.05}
DECAY, LEAST_FACTOR, CANDIDATES = 12, 0.2, 200


def facet_filter(docs: DataFrame, isin: Mapping[str, Sequence] | None = None, equal: Mapping | None = None, between: Mapping[str, tuple] | None = None) -> DataFrame:
    """All conditions at once. An empty list is no condition; null never matches. The filters reach the scan."""
    tests = [F.col(c).isin(list(v)) for c, v in (isin or {}).items() if v]
    tests += [F.col(c) == F.lit(v) for c, v in (equal or {}).items() if v is not None]
    for c, (low, high) in (between or {}).items():
        tests += [F.col(c) >= F.lit(low)] * (low is not None) + [F.col(c) <= F.lit(high)] * (high is not None)
    return docs.where(reduce(lambda a, b: a & b, tests)) if tests else docs


def in_category(docs: DataFrame, links: DataFrame, slugs: Sequence[str], key: str) -> DataFrame:
    """Documents with any of the chosen categories; no category chosen is no condition. links: (key, slug)."""
    return docs.join(links.where(F.col("slug").isin(list(slugs))).select(key), key, "left_semi") if slugs else docs


def lexical_candidates(docs: DataFrame, query: str, key: str, title: str, body: str, limit: int = CANDIDATES, number: str | None = None, normalised: bool = False) -> DataFrame:
    """(key, lexical_score, lexical_position) of documents that hold every token: 10 for a token in the title, 1 in the body.

    number: a column of which the whole query may be the value, which then is enough. Only the key and the score are
    sorted; bodies are not carried along.
    """
    tokens = fold_text(query).split()
    exact = F.coalesce(F.col(number).cast("string") == query.strip(), F.lit(False)) if number else F.lit(False)
    # Through a generator, below which the filters aren't pushed: there they would fold every text once more.
    both = docs.select(key, F.inline(F.array(F.struct(fold(F.col(title), normalised).alias("_t"), fold(F.col(body), normalised).alias("_b"), exact.alias("_n")))))
    both = both.where(reduce(lambda a, b: a & b, [F.col("_t").contains(t) | F.col("_b").contains(t) for t in tokens], F.lit(True)) | F.col("_n"))
    score = reduce(lambda a, b: a + b, [F.when(F.col("_t").contains(t), 10).otherwise(0) + F.when(F.col("_b").contains(t), 1).otherwise(0) for t in tokens], F.lit(0))
    top = both.select(key, score.alias("lexical_score")).orderBy(F.desc("lexical_score"), key).limit(limit)
    return top.withColumn("lexical_position", F.row_number().over(Window.orderBy(F.desc("lexical_score"), key)))  # at most `limit` rows


#: Similarity floors of embedding models whose cosines don't reach down to zero.
FLOORS = {"e5": 0.75}


def floor_of(model: str) -> float:
    return next((f for name, f in FLOORS.items() if name in model.lower()), 0.0)


def semantic_candidates(chunks: DataFrame, query: Sequence[float], key: str, chunk: str, vector: str, floor: float = 0.0, limit: int = CANDIDATES, allowed: DataFrame | None = None, fetch: int | None = None) -> DataFrame:
    """(key, similarity, best_chunk, semantic_position): the best chunk of each document, then the best documents.

    allowed: the documents (key) that may be found. fetch: only so many of the best chunks are looked at, as an index of
    nearest neighbours would give them (`over_fetch`); without it every chunk counts.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    if allowed is not None:
        chunks = chunks.join(allowed.select(key), key, "left_semi")
    scored = chunks.select(key, chunk, cosine(F.col(vector), q).alias("s")).where(F.col("s") >= floor)
    if fetch is not None:
        scored = scored.orderBy(F.desc("s"), key, chunk).limit(fetch)
    best = scored.groupBy(key).agg(F.max("s").alias("similarity"), F.max_by(chunk, F.struct("s", -F.col(chunk))).alias("best_chunk"))
    top = best.orderBy(F.desc("similarity"), key).limit(limit)
    return top.withColumn("semantic_position", F.row_number().over(Window.orderBy(F.desc("similarity"), key)))


def position_score(position: Column, k: int = DECAY) -> Column:
    return F.when(position >= 1, k / (k + position - 1.0)).otherwise(F.lit(0.0))


def merge_candidates(lexical: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    return lexical.join(semantic, key, "full_outer")


def final_rank(candidates: DataFrame, key: str, factors: Column | None = None, exact: Column | None = None) -> DataFrame:
    """candidates with base, multiplier, final and rank. Expects the two positions and authority, scope, relevance (0 to 100) and status scores.

    factors: array of the rules' factors; their product doesn't fall below LEAST_FACTOR. exact: rows that come first.
    """
    part = {
        "lexical": position_score(F.col("lexical_position")),
        "semantic": position_score(F.col("semantic_position")),
        "authority": F.coalesce("authority", F.lit(0.5)),
        "scope": F.coalesce("scope", F.lit(0.55)),
        "relevance": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("relevance", F.lit(0.0)) / 100.0)),
        "status": F.coalesce("status", F.lit(0.5)),
    }
    base = reduce(lambda a, b: a + b, [WEIGHTS[n] * c for n, c in part.items()])
    product = F.lit(1.0) if factors is None else F.aggregate(factors, F.lit(1.0), lambda a, b: a * b)
    out = candidates.withColumns({"base": base, "multiplier": F.greatest(F.lit(LEAST_FACTOR), product)}).withColumn("final", F.col("base") * F.col("multiplier"))
    first = F.lit(0) if exact is None else F.when(exact, 0).otherwise(1)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(first, F.desc("final"), key)))


def over_fetch(limit: int) -> int:
    return max(5 * limit, 100)


def truncated(candidates: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(candidates, truncated): whether a leg reached its limit, so that more documents may match."""
    return candidates.agg(F.count(F.lit(1)).alias("candidates")).withColumn("truncated", F.col("candidates") >= limit)


#: Search modes; the parts of a text and their weights in the weighted rank.
MODES = ("lexical", "semantic", "hybrid")
PART_WEIGHTS = {"title": 1.0, "kind": 0.4, "categories": 0.2, "body": 0.1}


def resolved_mode(requested: str | None, embeddings_on: bool, has_vectors: bool, model_ready: bool = True, default: str = "lexical") -> tuple[str, str | None]:
    """(mode, notice): what can be delivered, and why it isn't what was asked for. A downgrade is never silent."""
    mode = (requested or default).strip().lower()
    if mode not in MODES or mode == "lexical":
        return "lexical", None
    if not embeddings_on:
        return "lexical", "Search by meaning is switched off."
    if not has_vectors:
        return "lexical", "There are no vectors yet; only words were looked up."
    if not model_ready:
        return "lexical", "The embedding model is not available; only words were looked up."
    return mode, None


def read_query(query: str) -> tuple[list[str], list[list[str]], list[str]]:
    """(required, any_of, excluded) folded phrases of a web search: words and "phrases", `or` between two, `-` before one."""
    groups: list[list[str]] = []
    excluded: list[str] = []
    joined = False
    for m in re.finditer(r'(-?)(?:"([^"]*)"|(\S+))', query):
        word = " ".join(fold_text(m[2] or m[3] or "").split())
        if word == "or" and not m[1] and m[2] is None:
            joined = bool(groups)
        elif word and m[1]:
            excluded.append(word)
        elif word and joined:
            groups[-1].append(word)
            joined = False
        elif word:
            groups.append([word])
    required, groups = [g[0] for g in groups if len(g) == 1], [g for g in groups if len(g) > 1]
    return required, groups, excluded


def weighted_rank(docs: DataFrame, query: str, key: str, parts: Mapping[str, str], weights: Mapping[str, float] = PART_WEIGHTS, saturation: float = 1.2) -> DataFrame:
    """(key, rank_score) of the documents that match a web search, by the weighted frequencies of its phrases in the parts of a document.

    parts: part to column. Each phrase counts f / (f + saturation) with f its frequency over the parts, weighted. It is an
    extension: the order of a database's own full-text rank, with its dictionary, can't be had here.
    """
    required, groups, excluded = read_query(query)
    folded = docs.select(key, *[fold(F.col(c)).alias(f"_p_{n}") for n, c in parts.items()])
    pattern = lambda w: r"(?<![\p{L}\p{N}])" + quote(w) + r"(?![\p{L}\p{N}])"
    frequency = lambda w: reduce(lambda a, b: a + b, [weights.get(n, 0.1) * F.regexp_count(F.col(f"_p_{n}"), F.lit(pattern(w))) for n in parts])
    wanted = [*required, *[w for g in groups for w in g]]
    counted = folded.select(key, F.inline(F.array(F.struct(*[frequency(w).alias(f"_f{i}") for i, w in enumerate([*wanted, *excluded])], F.lit(0).alias("_none")))))
    at = {w: F.col(f"_f{i}") for i, w in enumerate(wanted)}
    both = lambda tests: reduce(lambda a, b: a & b, tests, F.lit(True))
    match = both([at[w] > 0 for w in required]) & both([reduce(lambda a, b: a | b, [at[w] > 0 for w in g]) for g in groups]) & both([F.col(f"_f{len(wanted) + i}") == 0 for i in range(len(excluded))])
    score = reduce(lambda a, b: a + b, [c / (c + saturation) for c in at.values()], F.lit(0.0))
    return counted.where(match).select(key, score.alias("rank_score")) if wanted or excluded else counted.where(F.lit(False)).select(key, score.alias("rank_score"))


def pinned(ranked: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """ranked with the exactly referred documents (key, exact_position) first, also those that no leg found; ranks anew."""
    both = ranked.join(exact, key, "full_outer")
    order = [F.asc_nulls_last("exact_position"), F.asc_nulls_last("rank"), F.col(key)]
    return both.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most the candidates of both legs and `exact`


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def facet_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def total_pages(total: Column, size: int) -> Column:
    return F.ceil(total / size).cast("int")


def paged(df: DataFrame, order: Sequence[Column], number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(a page, (total, total_pages)); the total is a count of its own, not of the page."""
    return page(df, order, number, size), df.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", total_pages(F.col("total"), size))


#: Orders chosen by the user, each with the key as its last word.
SORTS = {
    "score_desc": lambda score, key: [F.desc_nulls_last(score), F.desc(key)],
    "title": lambda title, key: [F.asc(title), F.asc(key)],
    "relevance": lambda rank, key: [F.asc_nulls_last(rank), F.asc(key)],
    "date_desc": lambda date, key: [F.desc_nulls_last(date), F.desc(key)],
    "date_asc": lambda date, key: [F.asc_nulls_first(date), F.asc(key)],
}
