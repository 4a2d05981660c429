"""Flat rules over vessel profiles: lists of conditions, decided in a fixed order, each compiled into one Column.

A profile row has a column a field and an array `supplied` of the fields that were given: a field that wasn't given is
missing even where its column has a default. Two fields have defaults that are assumed, only in exclusions. Rules are
bounded configuration; their review, hashes and integrity are Columns over a table of rules.
"""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import canonical, quoted_in

ENGINE_VERSION = "2.1.0"
# Fields of a profile with their kinds, the values of enumerations, and the operators of each kind.
FIELDS = {
    **dict.fromkeys(("imo_number", "vessel_name", "flag_state", "ship_register", "voyage_type"), "text"),
    **dict.fromkeys(("primary_type", "operating_area", "propulsion_type"), "enum"),
    **dict.fromkeys(("sub_types", "special_operations"), "text_list"),
    **dict.fromkeys(("gross_tonnage", "length_overall_m", "length_rule_m", "deadweight_tonnage"), "number"),
    **dict.fromkeys(("max_passengers", "crew_capacity", "actual_crew_count", "prescribed_crew_count"), "number"),
    **dict.fromkeys(("keel_laid_date", "delivery_date", "major_conversion_date", "assessment_date"), "date"),
    **dict.fromkeys(("is_primitive_wooden_build", "carries_dangerous_goods"), "boolean"),
}
ENUMS = {
    "primary_type": ("passenger", "cargo", "tanker", "fishing", "warship", "pleasure_yacht", "special_purpose", "offshore_support", "tug_workboat"),
    "operating_area": ("domestic", "international", "port_internal", "restricted"),
    "propulsion_type": ("mechanical", "non_mechanical", "sail_auxiliary"),
}
OPERATORS = {
    "number": ("eq", "neq", "gt", "gte", "lt", "lte", "in"),
    "date": ("eq", "neq", "gt", "gte", "lt", "lte"),
    "text": ("eq", "neq", "in"),
    "boolean": ("eq", "neq"),
    "text_list": ("contains", "in"),
    "enum": ("eq", "neq", "in"),
}
ASSUMED = {"propulsion_type": "mechanical", "is_primitive_wooden_build": False}
REQUIRED = ("vessel_name", "flag_state", "primary_type", "gross_tonnage", "operating_area", "keel_laid_date", "assessment_date")
VERDICTS = ("APPLIES", "POSSIBLY_APPLIES", "NEEDS_MANUAL_REVIEW", "DOES_NOT_APPLY")
RULE_FIELDS = frozenset(
    "rule_id legal_source_id citation topic_category inclusion_conditions exclusion_conditions valid_from valid_to keel_laid_after keel_laid_before source_url status".split()
)
MOST_RULES = 500


def problem(condition: Mapping, kind: str = "inclusion") -> str | None:
    """Why a condition can't be evaluated; None if it can."""
    name, operator, target = condition.get("field"), condition.get("operator"), condition.get("target_value")
    if name not in FIELDS:
        return f"unknown field {name!r}"
    type_ = FIELDS[name]
    if operator not in OPERATORS[type_]:
        return f"{operator!r} makes no sense for {name!r} ({type_})"
    many = operator == "in"
    if many != isinstance(target, (list, tuple)) or many and not target:
        return f"{operator!r} needs {'a list' if many else 'one value'}"
    values = list(target) if many else [target]
    if type_ == "number" and not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return f"{name!r} is compared with numbers"
    if type_ == "boolean" and not all(isinstance(v, bool) for v in values):
        return f"{name!r} is compared with true or false"
    if type_ in ("text", "text_list", "enum") and not all(isinstance(v, str) and v.strip() for v in values):
        return f"{name!r} is compared with texts"
    if type_ == "date":
        try:
            datetime.date.fromisoformat(str(values[0]))
        except ValueError:
            return f"{name!r} is compared with dates"
    if type_ == "enum" and not {v.strip().lower() for v in values} <= set(ENUMS[name]):
        return f"values of {name!r} are {', '.join(ENUMS[name])}"
    if kind == "inclusion" and name in ASSUMED:
        return f"{name!r} has an assumed default, so it may only exclude"
    return None


def rule_problems(rule: Mapping) -> list[str]:
    """All faults of a rule, its unknown keys and empty inclusions included."""
    out = [f"unknown key {k!r}" for k in sorted(set(rule) - RULE_FIELDS)]
    out += [f"missing {k}" for k in ("rule_id", "citation", "topic_category") if not rule.get(k)]
    if not rule.get("inclusion_conditions"):
        out.append("a rule needs an inclusion")
    for kind in ("inclusion", "exclusion"):
        out += [p for c in rule.get(f"{kind}_conditions") or () if (p := problem(c, kind))]
    for a, b in (("valid_from", "valid_to"), ("keel_laid_after", "keel_laid_before")):
        if rule.get(a) and rule.get(b) and str(rule[a]) > str(rule[b]):
            out.append(f"{a} is after {b}")
    return out


def read_batch(payload: str) -> list[dict]:
    """Rules of a JSON or YAML batch {schema_version, drafts}: no unknown keys, at most `MOST_RULES`, every rule once, all valid."""
    try:
        data = json.loads(payload)
    except ValueError:
        import yaml

        data = yaml.safe_load(payload)
    if not isinstance(data, dict) or not isinstance(data.get("drafts"), list) or set(data) - {"schema_version", "generator", "drafts"}:
        raise ValueError("a batch has schema_version, generator and a list of drafts")
    drafts = data["drafts"]
    ids = [d.get("rule", {}).get("rule_id") for d in drafts]
    if len(drafts) > MOST_RULES or len(set(ids)) < len(ids):
        raise ValueError(f"a batch has at most {MOST_RULES} drafts, each rule once")
    faults = [f"{i}: {p}" for i, d in zip(ids, drafts, strict=True) for p in rule_problems(d["rule"])]
    if faults:
        raise ValueError("; ".join(faults))
    return drafts


def _text(c: Column) -> Column:
    return F.lower(F.trim(c))


def _met(condition: Mapping, actual: Column) -> Column:
    type_, operator, target = FIELDS[condition["field"]], condition["operator"], condition["target_value"]
    plain = lambda v: str(v).strip().lower() if type_ in ("text", "text_list", "enum") else float(v) if type_ == "number" else v
    if type_ == "text_list":
        values = F.transform(actual, _text)
        wanted = [plain(v) for v in (target if operator == "in" else [target])]
        return F.arrays_overlap(values, F.array(*[F.lit(v) for v in wanted]))
    actual = actual.cast("double") if type_ == "number" else _text(actual) if type_ in ("text", "enum") else actual.cast("date") if type_ == "date" else actual
    if operator == "in":
        return actual.isin([plain(v) for v in target])
    value = F.lit(str(target)).cast("date") if type_ == "date" else F.lit(plain(target))
    return {"eq": actual == value, "neq": actual != value, "gt": actual > value, "gte": actual >= value, "lt": actual < value, "lte": actual <= value}[operator]


def outcome(condition: Mapping, kind: str, supplied: Column) -> Column:
    """(field, kind, outcome, assumed, actual) of a condition: MET, NOT_MET, MISSING or INVALID."""
    name = condition.get("field")
    fault = problem(condition, kind)
    say = lambda o, assumed, actual: F.struct(F.lit(str(name)).alias("field"), F.lit(kind).alias("kind"), o.alias("outcome"), assumed.alias("assumed"), actual.cast("string").alias("actual"))
    if fault:
        return say(F.lit("INVALID"), F.lit(False), F.lit(fault))
    known = F.col(name).isNotNull() & (F.lit(name in REQUIRED) | F.coalesce(F.array_contains(supplied, name), F.lit(False)))
    assumed = ~F.coalesce(F.array_contains(supplied, name), F.lit(False)) if name in ASSUMED else F.lit(False)
    actual = F.when(assumed, F.lit(ASSUMED[name])).otherwise(F.col(name)) if name in ASSUMED else F.col(name)
    state = F.when(~known & ~assumed, "MISSING").when(_met(condition, actual), "MET").otherwise("NOT_MET")
    return say(state, assumed, F.when(known | assumed, actual if FIELDS[name] != "text_list" else F.to_json(actual)))


def in_window(day: Column, after: str | None, before: str | None) -> Column:
    """Keel dates: from `after` on, up to but without `before`."""
    out = F.lit(True)
    if after:
        out = out & (day >= F.lit(str(after)).cast("date"))
    if before:
        out = out & (day < F.lit(str(before)).cast("date"))
    return out


def decide(rule: Mapping, supplied: str = "supplied") -> Column:
    """(rule_id, topic_category, verdict, step, missing_fields, via_conversion, conditions) of one rule for a profile row.

    Order: validity (both ends inclusive), keel date (or a conversion within the window, which makes it only possible),
    faults of the rule, exclusions, missing facts, inclusions. All conditions are evaluated whatever decides.
    """
    day, keel, conversion = (F.col(c).cast("date") for c in ("assessment_date", "keel_laid_date", "major_conversion_date"))
    valid = F.lit(True)
    if rule.get("valid_from"):
        valid = valid & (day >= F.lit(str(rule["valid_from"])).cast("date"))
    if rule.get("valid_to"):
        valid = valid & (day <= F.lit(str(rule["valid_to"])).cast("date"))
    window = (rule.get("keel_laid_after"), rule.get("keel_laid_before"))
    inside = in_window(keel, *window)
    converted = F.coalesce((conversion <= day) & in_window(conversion, *window), F.lit(False)) & ~inside if any(window) else F.lit(False)
    parts = [outcome(c, k, F.col(supplied)) for k in ("inclusion", "exclusion") for c in rule.get(f"{k}_conditions") or ()]
    conditions = F.array(*parts) if parts else F.array().cast("array<struct<field:string,kind:string,outcome:string,assumed:boolean,actual:string>>")
    any_ = lambda of, kind=None: F.exists(conditions, lambda c: (c["outcome"] == of) & (F.lit(True) if kind is None else c["kind"] == kind))
    failed, missing = any_("NOT_MET", "inclusion"), any_("MISSING")
    steps = [
        (~valid, "temporal_validity", "DOES_NOT_APPLY"),
        (~inside & ~converted, "keel_laid", "DOES_NOT_APPLY"),
        (any_("INVALID"), "invalid", "NEEDS_MANUAL_REVIEW"),
        (any_("MET", "exclusion"), "exclusions", "DOES_NOT_APPLY"),
        (missing & ~failed, "missing_data", "NEEDS_MANUAL_REVIEW"),
        (failed, "inclusions", "DOES_NOT_APPLY"),
        (converted, "inclusions", "POSSIBLY_APPLIES"),
    ]
    chain = reduce(lambda c, s: c.when(s[0], F.struct(F.lit(s[2]).alias("v"), F.lit(s[1]).alias("s"))), steps, F).otherwise(F.struct(F.lit("APPLIES").alias("v"), F.lit("inclusions").alias("s")))
    fields = F.array_sort(F.array_distinct(F.transform(F.filter(conditions, lambda c: c["outcome"] == "MISSING"), lambda c: c["field"])))
    return F.struct(
        F.lit(rule["rule_id"]).alias("rule_id"),
        F.lit(rule["topic_category"]).alias("topic_category"),
        chain["v"].alias("verdict"),
        chain["s"].alias("step"),
        F.when(chain["s"] == "missing_data", fields).otherwise(F.array().cast("array<string>")).alias("missing_fields"),
        converted.alias("via_conversion"),
        conditions.alias("conditions"),
    )


def evaluate(profiles: DataFrame, rules: Sequence[Mapping], key: str, supplied: str = "supplied") -> DataFrame:
    """(key, decided columns): every rule for every profile, in one pass over the profiles; fields a table lacks count as null."""
    types = {"number": "double", "date": "date", "boolean": "boolean", "text_list": "array<string>"}
    lacking = {f: F.lit(None).cast(types.get(k, "string")) for f, k in FIELDS.items() if f not in profiles.columns}
    ordered = sorted(rules, key=lambda r: (r["topic_category"], r["rule_id"]))
    return profiles.withColumns(lacking).select(key, F.inline(F.array(*[decide(r, supplied) for r in ordered])))


def report(verdicts: DataFrame) -> DataFrame:
    """(topic_category, a column a verdict, total): counts, zero where there are none."""
    return verdicts.groupBy("topic_category").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], F.count(F.lit(1)).alias("total"))


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def _digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def rule_hash(rule: Mapping, source_text_hash: str | None = None, source: Mapping | None = None) -> str:
    """Over all that can change a decision or its citation; the review state is left out."""
    body = {k: v for k, v in rule.items() if k != "status"} | {"source_text_hash": source_text_hash}
    return _digest(body | ({"source_document": dict(source)} if source is not None else {}))


def ruleset_fingerprint(rules: DataFrame) -> DataFrame:
    """(fingerprint): over engine version and the approved rules' ids and hashes, in order of id. Rules are a bounded table."""
    pairs = F.sort_array(F.collect_list(F.struct("rule_id", "content_hash")))
    listed = F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('["'), p["rule_id"], F.lit('","'), p["content_hash"], F.lit('"]'))), ","), F.lit("]"))
    return rules.where("status = 'APPROVED'").agg(F.sha2(F.concat(F.lit(f'{{"engine":"{ENGINE_VERSION}","rules":'), listed, F.lit("}")), 256).alias("fingerprint"))


def profile_hash(profiles: DataFrame, key: str, supplied: str = "supplied") -> DataFrame:
    """(key, profile_hash): over the given fields only, in order of name, and the day: a default that was given is another profile than one that wasn't."""
    names = sorted(f for f in FIELDS if f in profiles.columns)
    shown = [F.when(F.lit(n == "assessment_date") | F.array_contains(supplied, n), F.concat(F.lit(f'"{n}":'), F.coalesce(F.to_json(F.struct(F.col(n).alias("v"))), F.lit("null")))) for n in names]
    return profiles.select(key, F.sha2(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*shown)), ","), F.lit("}")), 256).alias("profile_hash"))


def integrity(rules: DataFrame, versions: DataFrame, deep: bool = False) -> DataFrame:
    """rules (rule_id, source_text, source_text_hash, content_hash, approved_content_hash, version_key) with `problem`: why an approved rule can't be trusted, or null.

    deep: the text must also stand word for word in the version (version_key, content) that it names.
    """
    joined = rules.join(versions.select("version_key", F.col("content").alias("_content")), "version_key", "left")
    changed = F.sha2(canonical(F.col("source_text")), 256) != F.col("source_text_hash")
    out = F.when(F.col("source_text").isNotNull() & changed, "source_text_changed").when(F.col("_content").isNull(), "no_source_version").when(~F.col("content_hash").eqNullSafe(F.col("approved_content_hash")), "content_changed")
    if deep:
        out = out.otherwise(quoted_in(F.col("source_text"), F.col("_content")))
    return joined.withColumn("problem", out).drop("_content")


def trusted(verdicts: DataFrame, checked: DataFrame) -> DataFrame:
    """verdicts where rules with a problem need a manual review whatever they say."""
    joined = verdicts.join(checked.select("rule_id", "problem"), "rule_id", "left")
    return joined.withColumn("verdict", F.when(F.col("problem").isNotNull(), "NEEDS_MANUAL_REVIEW").otherwise(F.col("verdict")))


def drafted(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """(rule_id, action): what a batch does to each rule: create, unchanged, replace a draft, or conflict with an approved or deprecated one."""
    old = existing.select("rule_id", F.col("content_hash").alias("_hash"), F.col("status").alias("_status"))
    action = F.when(F.col("_status").isNull(), "create").when(F.col("_hash") == F.col("content_hash"), "unchanged").when(F.col("_status") == "DRAFT", "replace").otherwise("conflict")
    return drafts.join(old, "rule_id", "left").select("rule_id", action.alias("action"))


def moved(rules: DataFrame, requests: DataFrame) -> DataFrame:
    """rules after requests (rule_id, to, actor): a draft is approved by another person than its author, never by a generator, and only as it was drafted; an approved one is deprecated."""
    joined = rules.join(requests.select("rule_id", "to", F.col("actor").alias("_actor"), F.col("expected_hash").alias("_expected")), "rule_id", "left")
    approve = (F.col("to") == "APPROVED") & (F.col("status") == "DRAFT")
    refusal = (
        F.when(F.col("to").isNull(), None)
        .when(approve & (F.col("_actor") == F.col("author")), "separation_of_duties")
        .when(approve & F.col("_actor").startswith("generator:"), "generator_may_not_approve")
        .when(approve & (F.col("_expected") != F.col("content_hash")), "changed_since_review")
        .when(approve | (F.col("to") == "DEPRECATED") & (F.col("status") == "APPROVED"), None)
        .otherwise("not_allowed")
    )
    fine = F.col("to").isNotNull() & F.col("refusal").isNull()
    out = joined.withColumn("refusal", refusal)
    return out.select(
        *[c for c in rules.columns if c not in ("status", "approved_by", "approved_content_hash")],
        F.when(fine, F.col("to")).otherwise(F.col("status")).alias("status"),
        F.when(fine & (F.col("to") == "APPROVED"), F.col("_actor")).otherwise(F.col("approved_by")).alias("approved_by"),
        F.when(fine & (F.col("to") == "APPROVED"), F.col("content_hash")).otherwise(F.col("approved_content_hash")).alias("approved_content_hash"),
        "refusal",
    )
