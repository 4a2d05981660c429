"""The catalogue around documents: rights, categories, versions, known ids, and discovery of new ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def public_documents(docs: DataFrame, managed: DataFrame, source: str = "source") -> DataFrame:
    """Documents whose source isn't under managed rights. An anti join: unlike NOT IN it keeps rows where a list has nulls."""
    return docs.join(managed.select(source), source, "left_anti")


def whitelisted(metadata: Column, allowed: Sequence[str], restricted: Column) -> Column:
    """The metadata that may be shown: all of it, or of a restricted source only the allowed keys."""
    return F.when(restricted, F.map_filter(metadata, lambda k, v: k.isin(list(allowed)))).otherwise(metadata)


def with_counts(categories: DataFrame, links: DataFrame, slug: str = "slug") -> DataFrame:
    """categories with the number of documents linked to each, zero included."""
    n = links.groupBy(slug).agg(F.count(F.lit(1)).alias("n"))
    return categories.join(n, slug, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def current_versions(docs: DataFrame, versions: DataFrame, key: str, pointer: str = "current_version_id", version: str = "version_id") -> DataFrame:
    """docs with the version that their pointer names; documents without one go."""
    return docs.join(versions.drop(key).withColumnRenamed(version, pointer), pointer)


def catalogue(docs: DataFrame, sources: DataFrame, provenance: DataFrame, source: str, key: str) -> DataFrame:
    """docs with their source and their latest provenance (key, retrieved_at, evidence_url)."""
    last = provenance.groupBy(key).agg(F.max_by(F.struct("evidence_url", "retrieved_at"), "retrieved_at").alias("_p"))
    return docs.join(sources, source).join(last, key).select("*", "_p.*").drop("_p")


def availability(permitted: Column, has_text: Column, metadata_only: Column) -> Column:
    """What a reader can have of a document."""
    return F.when(permitted & has_text, "full_text").when(permitted | metadata_only, "metadata_only").otherwise("unavailable")


def revoked(docs: DataFrame, source: str, value: str, columns: Sequence[str]) -> DataFrame:
    """docs after the permission of a source was revoked: its protected columns are emptied."""
    gone = F.col(source) == value
    return docs.withColumns({c: F.when(~gone, F.col(c)) for c in columns})


def known_ids(queue: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Ids that are queued or stored."""
    return queue.select(key).union(docs.select(key)).where(F.col(key).isNotNull()).distinct()


def ordered_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    """(key, position): each key once, at its first place."""
    return rows.groupBy(key).agg(F.min(position).alias(position))


def waiting(queue: DataFrame, states: Sequence[str], key: str, limit: int) -> DataFrame:
    """The next items in some states: highest priority, then oldest, then key."""
    return queue.where(F.col("status").isin(list(states))).orderBy(F.desc("priority"), F.asc_nulls_first("next_attempt_at"), key).limit(limit)


def group_problems(found: DataFrame, expected: Mapping[str, int], group: str, key: str) -> DataFrame:
    """(group, found, expected, problem) of discovery groups: a count that differs, or ids that another group has too; null where all is well."""
    shared = found.select(group, key).distinct().groupBy(key).agg(F.collect_set(group).alias("g")).where(F.size("g") > 1).select(F.explode("g").alias(group), key)
    doubled = shared.groupBy(group).agg(F.count(F.lit(1)).alias("doubled"))
    counts = found.groupBy(group).agg(F.count_distinct(key).alias("found"))
    want = found.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(g).alias(group), F.lit(n).cast("long").alias("expected")) for g, n in expected.items()])))
    both = want.join(counts, group, "left").join(doubled, group, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.select(group, "found", "expected", F.when(F.col("found") != F.col("expected"), "count_mismatch").when(F.col("doubled") > 0, "overlap").alias("problem"))


def discovery_decision(known: Column, denied: Column, score: Column, relevant_at: int = 60, possible_at: int = 30) -> Column:
    """What happens to a discovered act by its pre-score on title and authority."""
    return F.when(known, "known").when(denied, "denied").when(score >= relevant_at, "queue").when(score >= possible_at, "review").otherwise("skip")


def triage(title: Column, tiers: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The first tier of which a pattern fits a folded title."""
    out = F
    for name, patterns in tiers:
        out = out.when(title.rlike("|".join(f"(?:{p})" for p in patterns)), name)
    return out.otherwise(otherwise)
