"""Review states of rules, overrides and reviews as folds over append-only events, and explanations as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed steps of a rule's review.
STEPS = {"draft": ("in_review", "rejected"), "in_review": ("approved", "rejected", "draft"), "approved": ("deprecated",), "rejected": ("draft",), "deprecated": ()}


def allowed(before: Column, after: Column, steps: Mapping[str, Sequence[str]] = STEPS) -> Column:
    pairs = [f"{a}>{b}" for a, bs in steps.items() for b in bs]
    return F.concat_ws(">", F.coalesce(before, F.lit("draft")), after).isin(pairs)


def review_states(events: DataFrame, key: str, at: Sequence[str], steps: Mapping[str, Sequence[str]] = STEPS) -> DataFrame:
    """(key, status, reviewer, refused): events (status, actor) applied in order; a step that isn't allowed, or an approval by the author, is refused and counted."""
    order = F.sort_array(F.collect_list(F.struct(*at, "status", "actor")))
    pairs = [F.lit(f"{a}>{b}") for a, bs in steps.items() for b in bs]
    table = F.array(*pairs)
    start = F.struct(F.lit("draft").alias("status"), F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("author"), F.lit(0).alias("refused"))

    def step(s, e):
        first = s["author"].isNull()
        fine = F.array_contains(table, F.concat_ws(">", s["status"], e["status"])) & ~((e["status"] == "approved") & (e["actor"] == s["author"]))
        fine = fine | first & (e["status"] == "draft")
        return F.struct(
            F.when(fine, e["status"]).otherwise(s["status"]).alias("status"),
            F.when(fine & (e["status"] == "approved"), e["actor"]).otherwise(s["reviewer"]).alias("reviewer"),
            F.coalesce(s["author"], e["actor"]).alias("author"),
            (s["refused"] + F.when(fine, 0).otherwise(1)).alias("refused"),
        )

    return events.groupBy(key).agg(F.aggregate(order, start, step).alias("s")).select(key, "s.status", "s.reviewer", "s.refused")


def override_events(events: DataFrame, key: Sequence[str], at: Sequence[str], decision: str) -> DataFrame:
    """events with kind: created, changed, repeated or cleared, by the decision before."""
    before = F.lag(decision).over(Window.partitionBy(*key).orderBy(*at))
    kind = F.when(F.col(decision).isNull(), F.when(before.isNull(), "repeated").otherwise("cleared")).when(before.isNull(), "created").when(before == F.col(decision), "repeated").otherwise("changed")
    return events.withColumn("kind", kind)


def claim(queue: DataFrame, now: Column, size: int, token: str, minutes: int, key: str = "id") -> DataFrame:
    """The next `size` claimable items by priority (the lowest number first), due time and key, with token and lease; taking them exclusively is up to the store."""
    from lexforge.operators.history import claimable

    due = claimable(queue, now).orderBy("priority", F.asc_nulls_first("next_attempt_at"), key).limit(size)
    return due.withColumns({"status": F.lit("PROCESSING"), "claim_token": F.lit(token), "lease_expires_at": now + F.make_interval(mins=F.lit(minutes))})


def explained(verdicts: DataFrame) -> DataFrame:
    """verdicts with `explanation`: the verdict in words, then each reason on a line."""
    words = {"applies": "The rule applies.", "does_not_apply": "A condition of the rule is not met.", "excluded": "The rule excludes this profile.", "not_in_force": "The rule is not in force on the date.", "other_jurisdiction": "The rule belongs to another jurisdiction.", "unclear": "The rule can't be decided on the facts given.", "discretionary": "The rule applies if the authority decides so.", "not_reviewed": "The rule has not been approved."}
    said = F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), F.col("verdict"))
    return verdicts.withColumn("explanation", F.concat_ws("\n", F.concat(said, F.lit(" Confidence "), F.col("confidence").cast("string"), F.lit(".")), F.array_join(F.transform("reasons", lambda r: F.concat(F.lit("- "), r)), "\n")))
