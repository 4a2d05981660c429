"""Many rules through the index against a Column for each rule."""

import datetime
import random

from lexforge.operators import flat_rules as K
from lexforge.operators.rule_index import RuleIndex, evaluate_many

SCHEMA = "id int, flag_state string, primary_type string, gross_tonnage double, operating_area string, keel_laid_date date, assessment_date date, major_conversion_date date, max_passengers int, sub_types array<string>, is_primitive_wooden_build boolean, propulsion_type string, carries_dangerous_goods boolean, supplied array<string>"


def condition(r, kind):
    field = r.choice(["flag_state", "primary_type", "gross_tonnage", "max_passengers", "sub_types", "carries_dangerous_goods", "delivery_date", "keel_laid_date", "nonsense"] + ["propulsion_type", "is_primitive_wooden_build"] * (kind == "exclusion"))
    if field == "nonsense":
        return {"field": field, "operator": "eq", "target_value": 1} if r.random() < 0.1 else condition(r, kind)
    type_ = K.FIELDS[field]
    operator = r.choice(K.OPERATORS[type_])
    value = {
        "text": lambda: r.choice(["DK", " dk", "NO", "SE"]), "enum": lambda: r.choice(K.ENUMS.get(field, ("x",))), "number": lambda: r.choice([0, 12, 12.5, 500, 3000]), "text_list": lambda: r.choice(["RO-RO", "ferry", "tug"]),
        "boolean": lambda: r.random() < 0.5, "date": lambda: f"{r.choice((1990, 2000, 2010))}-01-01",
    }[type_]
    return {"field": field, "operator": operator, "target_value": [value() for _ in range(r.randint(1, 3))] if operator == "in" else value()}


def rules(n, seed=1):
    r, out = random.Random(seed), []
    for i in range(n):
        rule = {"rule_id": f"r{i:05}", "topic_category": r.choice("abc"), "citation": "c", "inclusion_conditions": [condition(r, "inclusion") for _ in range(r.randint(1, 3))], "exclusion_conditions": [condition(r, "exclusion") for _ in range(r.choice((0, 0, 1, 2)))]}
        for name in ("valid_from", "keel_laid_after"):
            rule |= {name: "1995-06-01"} if r.random() < 0.25 else {}
        for name in ("valid_to", "keel_laid_before"):
            rule |= {name: "2015-06-01"} if r.random() < 0.25 else {}
        out.append(rule)
    return out


def profiles(spark, n, seed=2):
    r = random.Random(seed)
    day = lambda *years: r.choice([None, *[datetime.date(y, 6, 1) for y in years]])
    rows = []
    for i in range(n):
        supplied = [f for f in ("max_passengers", "sub_types", "is_primitive_wooden_build", "propulsion_type", "carries_dangerous_goods", "major_conversion_date") if r.random() < 0.6]
        kinds = r.choice([None, [], ["ro-ro "], ["Ferry", "x"], ["tug", None]])
        rows.append((i, r.choice(["DK", "dk ", "SE", None]), r.choice(["cargo", "Tanker", None]), r.choice([0.0, 12.0, 500.0, 9999.0, None]), "domestic", day(1990, 1995, 2005, 2015), day(1994, 2005, 2016), day(1996, 2006), r.choice([None, 0, 12, 13]), kinds, r.choice([None, True, False]), r.choice([None, "mechanical", "non_mechanical"]), r.choice([None, True, False]), r.choice([None, supplied, supplied])))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_like_a_column_a_rule(spark):
    some, table = rules(60), profiles(spark, 120)
    columns = ["rule_id", "topic_category", "verdict", "step", "missing_fields", "via_conversion"]
    tell = lambda df: sorted((r.id, *[repr(r[c]) for c in columns]) for r in df.select("id", *columns).collect())
    want, got = tell(K.evaluate(table, some, "id")), tell(evaluate_many(table, some, "id"))
    assert len(got) == 60 * 120 and [(a, b) for a, b in zip(got, want, strict=True) if a != b][:5] == []
    assert {v for *_, v in {(r[3],) for r in got}} == {repr(v) for v in K.VERDICTS}
    applies = tell(evaluate_many(table, some, "id", only=["APPLIES"]))
    assert applies == [r for r in want if r[3] == "'APPLIES'"]


def test_ten_thousand_rules(spark):
    many = rules(10_000, 5)
    index = RuleIndex(many)
    assert index.size < 2500  # equal conditions are one
    got = evaluate_many(profiles(spark, 30), many, "id").groupBy("verdict").count().collect()
    assert sum(r["count"] for r in got) == 300_000 and len(got) == 4


def test_no_rules_and_no_profiles(spark):
    assert evaluate_many(profiles(spark, 3), [], "id").count() == 0
    assert evaluate_many(profiles(spark, 0), rules(3), "id").count() == 0
