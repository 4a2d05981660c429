"""Listings that combine the other operators: pending work, related rows, best paragraphs, duplicates, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import fold, fold_text
from lexforge.functions.vectors import cosine


def contains_text(query: str, *columns: str) -> Column:
    """Whether a column holds the query, whatever the case; `%` and `_` mean themselves."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(query.lower())) for c in columns])


def pending_vectors(version: Column, embedded: Column, model: Column, wanted: str) -> Column:
    """Never embedded, embedded from another version, or by another model."""
    return embedded.isNull() | (embedded != version) | (F.coalesce(model, F.lit("")) != wanted)


def denied(title: Column, patterns: Sequence[str]) -> Column:
    return fold(title).rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def related(vectors: DataFrame, key: str, vector: str, to: Sequence[float], itself, floor: float = 0.55, limit: int = 5) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in to])
    return vectors.where(F.col(key) != F.lit(itself)).select(key, cosine(F.col(vector), q).alias("similarity")).where(F.col("similarity") >= floor).orderBy(F.desc("similarity"), key).limit(limit)


def paragraph_score(text: Column, terms: Sequence[str], context: Column | None = None) -> Column:
    """10 for each different term, 1 for each occurrence, 5 for each term in the context."""
    low = fold(text)
    count = lambda c, t: ((F.length(c) - F.length(F.replace(c, F.lit(t), F.lit("")))) / len(t)).cast("int")
    folded = [fold_text(t) for t in terms]
    total = reduce(lambda a, b: a + b, [F.when(low.contains(t), 10).otherwise(0) + count(low, t) for t in folded], F.lit(0))
    if context is not None:
        total = total + reduce(lambda a, b: a + b, [F.when(fold(context).contains(t), 5).otherwise(0) for t in folded], F.lit(0))
    return total


def best_paragraphs(paragraphs: DataFrame, key: str, order: str, text: str, terms: Sequence[str], most: int = 3) -> DataFrame:
    """The `most` best paragraphs of each document by score, then place; without terms its first ones."""
    scored = paragraphs.withColumn("score", paragraph_score(F.col(text), terms)) if terms else paragraphs.withColumn("score", F.lit(1))
    w = Window.partitionBy(key).orderBy(F.desc("score"), order)
    return scored.where("score > 0").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def first_of_duplicates(rows: DataFrame, key: Sequence[str], preference: Sequence[Column]) -> DataFrame:
    """rows with `duplicate`: false for the preferred row of each key."""
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(*key).orderBy(*preference)) > 1)


def histogram_difference(stored: DataFrame, expected: DataFrame, column: str) -> DataFrame:
    """(column, stored, expected): counts on both sides, zero where a value is missing."""
    count = lambda df, name: df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return count(stored, "stored").join(count(expected, "expected"), column, "full_outer").select(column, F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("expected", F.lit(0)).alias("expected"))


def priority(column: Column, order: Sequence[str]) -> Column:
    """Place of a value in a list, values that aren't listed last."""
    at = F.array_position(F.array(*[F.lit(v) for v in order]), column)
    return F.when(at > 0, at).otherwise(len(order) + 1).cast("int")


def core_listing(docs: DataFrame, klass: str, status: str, orders: tuple[Sequence[str], Sequence[str]], score: str, key: str, limit: int) -> DataFrame:
    return docs.orderBy(priority(F.col(klass), orders[0]), priority(F.col(status), orders[1]), F.desc_nulls_last(score), key).limit(limit)
