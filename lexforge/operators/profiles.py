"""Facts derived from profiles: unknown stays unknown, measures are filled up, contradictions are listed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSENGER_LIMIT, MISMATCH = 12, 0.10


def _any_of(values: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted]).cast("array<string>")), F.lit(False))


def derive_facts(profiles: DataFrame, groups: Mapping[str, Sequence[str]], offshore_operations: Sequence[str] = (), limit: int = PASSENGER_LIMIT) -> DataFrame:
    """profiles with category, is_passenger_ship, is_tanker, is_cargo_ship, is_fishing_vessel, is_offshore_unit, rule_length, dimension_number and conflicts.

    Expects types and operations (arrays), passengers, carries_passengers, length_rule, length_overall, breadth, depth and
    declared_dimension. groups: types by category, in order of precedence. That a type alone says nothing is kept: without
    a number of passengers or a plain denial, a ship of another type may still be a passenger ship; without operations it
    may still work offshore. Types are always given, so what they define is true or false.
    """
    types, operations = F.col("types"), F.coalesce("operations", F.array().cast("array<string>"))
    of = lambda name: _any_of(types, groups.get(name, ()))
    category = F.coalesce(*[F.when(of(name), F.lit(name)) for name in groups], F.lit("other"))
    passenger = F.when(of("passenger"), True).when(F.col("passengers").isNotNull(), F.col("passengers") > limit).when(~F.col("carries_passengers"), False)
    offshore = F.when(of("offshore") | _any_of(operations, offshore_operations), True).when(F.size(operations) > 0, False)
    length = F.coalesce("length_rule", "length_overall")
    product = F.bround(length * F.col("breadth") * F.col("depth"), 2)
    conflict = lambda when, name: F.when(when, F.lit(name))
    conflicts = F.array_compact(
        F.array(
            conflict(of("passenger") & (F.col("passengers") <= limit), "passenger_count_inconsistent"),
            conflict(of("fishing") & (F.size(operations) > 0) & ~F.array_contains(operations, "fishing_operation"), "fishing_operation_missing"),
            conflict(F.abs(F.col("declared_dimension") - product) > product * MISMATCH, "dimension_mismatch"),
        )
    )
    return profiles.withColumns(
        {
            "category": category,
            "is_passenger_ship": passenger,
            "is_tanker": of("tanker"),
            "is_cargo_ship": of("cargo") | of("tanker"),
            "is_fishing_vessel": of("fishing"),
            "is_offshore_unit": offshore,
            "rule_length": length,
            "dimension_number": F.coalesce("declared_dimension", product),
            "conflicts": conflicts,
        }
    )
