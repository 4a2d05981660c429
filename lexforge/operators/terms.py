"""Term configurations compiled into Columns: field scores, relevance and categories, each one projection."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import fold, fold_text, saturate, term_pattern


@dataclass(frozen=True)
class Term:
    term: str
    weight: float = 1.0
    match: str = "word"
    pattern: str | None = None
    concept: str | None = None

    @property
    def java(self) -> str:
        return term_pattern(self.term, self.match, self.pattern)


# Weights, caps, saturation and thresholds of the relevance score.
@dataclass(frozen=True)
class Relevance:
    terms: Sequence[Term]
    negative: Sequence[Term] = ()
    field_weights: Mapping[str, float] = field(default_factory=lambda: {"title": 3.0, "authority": 2.5, "metadata": 1.5, "content": 1.0})
    max_occurrences: int = 3
    bonus_per_concept: float = 4.0
    max_bonus: float = 20.0
    saturation: float = 45.0
    decisive_weight: float = 8.0
    floor: int = 70
    relevant_at: int = 60
    possible_at: int = 30


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def _occurrences(column: str, term: Term) -> Column:
    """How often a term stands in a folded column. Single words and their beginnings are compared with the field's words, cut once; only phrases and patterns are searched for."""
    words, folded = F.col(f"{column}_words"), fold_text(term.term)
    if re.fullmatch(r"\w+", folded) and term.match == "word":
        return F.size(F.filter(words, lambda w: w == folded))
    if re.fullmatch(r"\w+", folded) and term.match == "prefix":
        return F.size(F.filter(words, lambda w: w.startswith(folded)))
    return F.regexp_count(F.col(column), F.lit(term.java))


def _points(fields: Mapping[str, str], terms: Sequence[Term], weights: Mapping[str, float], most: int) -> dict[tuple[str, Term], Column]:
    """min(occurrences, most) * term weight * field weight, by field and term. fields: name to folded column."""
    return {(f, t): F.least(_occurrences(c, t), F.lit(most)) * (t.weight * weights.get(f, 1.0)) for f, c in fields.items() for t in terms}


def _once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """df with columns that go through a generator, so that the optimizer doesn't copy them into each place of their use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _folded(df: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with the folded fields and their words, and the names of the folded columns by field."""
    names = {f: f"_fold_{f}" for f in fields}
    out = _once(df, {c: fold(F.col(f)) for f, c in names.items()})
    return _once(out, {f"{c}_words": F.regexp_extract_all(F.col(c), F.lit(r"(?U)\w+"), F.lit(0)) for c in names.values()}), names


def _struct_of(points: Mapping[tuple[str, Term], Column]) -> Column:
    """Counts that are needed more than once, worked out once."""
    return F.array(*points.values()) if points else F.array().cast("array<double>")


def score_relevance(df: DataFrame, config: Relevance) -> DataFrame:
    """df with raw, score (0 to 100), classification, matched_terms, concepts and title_floor."""
    fields = [f for f in config.field_weights if f in df.columns]
    out, names = _folded(df, fields)
    good, bad = _points(names, config.terms, config.field_weights, config.max_occurrences), _points(names, config.negative, config.field_weights, config.max_occurrences)
    out = _once(out, {"_good": _struct_of(good), "_bad": _struct_of(bad)})
    at = {k: F.get("_good", F.lit(i)) for i, k in enumerate(good)}
    bad_at = {k: F.get("_bad", F.lit(i)) for i, k in enumerate(bad)}
    concepts = sorted({t.concept for t in config.terms if t.concept})
    found = F.array_compact(F.array(*[F.when(_sum([at[k] for k in at if k[1].concept == c]) > 0, F.lit(c)) for c in concepts])) if concepts else F.array().cast("array<string>")
    bonus = F.least(F.greatest(F.size(found) - 1, F.lit(0)) * config.bonus_per_concept, F.lit(config.max_bonus))
    raw = F.greatest(F.lit(0.0), _sum(list(at.values())) + bonus - _sum(list(bad_at.values())))
    decisive = [at[k] > 0 for k in at if k[0] == "title" and k[1].weight >= config.decisive_weight]
    title_bad = [bad_at[k] > 0 for k in bad_at if k[0] == "title"]
    either = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    score = F.bround(100.0 * saturate(raw, config.saturation)).cast("int")
    lifted = either(decisive) & ~either(title_bad) & (score < config.floor)
    # Terms by their strongest field, strongest first.
    hits = F.array(*[F.struct((-at[k]).alias("p"), F.lit(i).alias("i"), F.lit(k[1].term).alias("t")) for i, k in enumerate(at)]) if at else F.array().cast("array<struct<p:double,i:int,t:string>>")
    matched = F.array_distinct(F.transform(F.filter(F.array_sort(hits), lambda h: h["p"] < 0), lambda h: h["t"]))
    out = out.withColumns({"raw": raw, "title_floor": lifted, "concepts": found, "matched_terms": matched})
    out = out.withColumn("score", F.when(F.col("title_floor"), config.floor).otherwise(score))
    label = F.when(F.col("score") >= config.relevant_at, "relevant").when(F.col("score") >= config.possible_at, "possible").otherwise("not_relevant")
    return out.withColumn("classification", label).drop("_good", "_bad", *names.values(), *[f"{c}_words" for c in names.values()])


@dataclass(frozen=True)
class Category:
    slug: str
    terms: Sequence[Term]


def categorize(df: DataFrame, categories: Sequence[Category], fallback: str, field_weights: Mapping[str, float] | None = None, most: int = 3, saturation: float = 12.0, least: float = 0.55, top: int = 4) -> DataFrame:
    """df with `categories`: array of (slug, confidence, raw, matched), strongest first; the fallback where none reaches `least`."""
    weights = field_weights or {"title": 3.0, "authority": 1.2, "metadata": 1.5, "content": 1.0}
    out, names = _folded(df, [f for f in weights if f in df.columns])
    rows = []
    every = [_points(names, c.terms, weights, most) for c in categories]
    out = _once(out, {f"_cat_{n}": _struct_of(points) for n, points in enumerate(every)})
    for n, (c, points) in enumerate(zip(categories, every, strict=True)):
        column = f"_cat_{n}"
        raw = F.aggregate(column, F.lit(0.0), lambda a, b: a + b)
        matched = F.slice(F.array_distinct(F.array_compact(F.array(*[F.when(F.get(column, F.lit(i)) > 0, F.lit(k[1].term)) for i, k in enumerate(points)]))), 1, 12)
        rows.append(F.struct(raw.alias("raw"), F.lit(-n).alias("n"), F.lit(c.slug).alias("slug"), saturate(raw, saturation).alias("confidence"), matched.alias("matched")))
    good = F.slice(F.reverse(F.array_sort(F.filter(F.array(*rows), lambda r: r["confidence"] >= least))), 1, top)
    shown = F.transform(good, lambda r: F.struct(r["slug"].alias("slug"), F.bround(r["confidence"], 4).alias("confidence"), F.bround(r["raw"], 2).alias("raw"), r["matched"].alias("matched")))
    none = F.array(F.struct(F.lit(fallback).alias("slug"), F.lit(least).alias("confidence"), F.lit(0.0).alias("raw"), F.array().cast("array<string>").alias("matched")))
    out = _once(out.drop("categories"), {"categories": shown})
    return out.withColumn("categories", F.when(F.size("categories") > 0, F.col("categories")).otherwise(none)).drop(*names.values(), *[f"{c}_words" for c in names.values()], *[f"_cat_{n}" for n in range(len(categories))])
