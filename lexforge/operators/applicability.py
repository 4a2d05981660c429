"""Rules over profiles in three-valued logic: condition trees compiled into nullable boolean Columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import TOKEN, fold, fold_text
from lexforge.functions.vectors import cosine

#: Comparators by the kind of the field.
COMPARATORS = {
    "number": ("eq", "ne", "lt", "lte", "gt", "gte", "between", "in", "not_in"),
    "date": ("eq", "ne", "lt", "lte", "gt", "gte", "between", "before", "after"),
    "text": ("eq", "ne", "in", "not_in", "contains"),
    "boolean": ("eq", "ne"),
    "list": ("contains", "contains_all", "intersects", "not_in", "eq"),
}


def _unknown() -> Column:
    return F.lit(None).cast("boolean")


def compare(kind: str, operator: str, actual: Column, expected) -> Column:
    """True, false or unknown (null). Null actual values, operators that a kind doesn't have, and unreadable values are unknown."""
    if operator not in COMPARATORS.get(kind, ()):
        return _unknown()
    if kind == "list":
        values = [expected] if isinstance(expected, str) else list(expected)
        low = F.transform(actual, lambda x: F.lower(F.trim(x)))
        want = F.array(*[F.lit(str(v).strip().lower()) for v in values])
        if "*" in values:
            return F.when(actual.isNotNull(), (F.size(actual) > 0) if operator != "not_in" else F.size(actual) == 0)
        missing = F.size(F.array_except(want, low)) == 0
        shared = F.size(F.array_intersect(want, low)) > 0
        out = {"contains": missing, "contains_all": missing, "intersects": shared, "not_in": ~shared, "eq": missing & (F.size(F.array_except(low, want)) == 0)}[operator]
        return F.when(actual.isNotNull(), out)
    if kind == "date":
        actual = F.to_date(F.try_to_timestamp(F.substring(actual.cast("string"), 1, 10), F.lit("yyyy-MM-dd")))
        lit = lambda v: F.lit(str(v)[:10]).cast("date")
    elif kind == "text":
        actual, lit = F.lower(F.trim(actual)), lambda v: F.lit(str(v).strip().lower())
    elif kind == "number":
        actual, lit = actual.cast("double"), lambda v: F.lit(float(v))
    else:
        lit = F.lit
    if operator == "between":
        return actual.between(lit(expected[0]), lit(expected[1]))
    if operator in ("in", "not_in"):
        inside = actual.isin(*[lit(v) for v in expected]) if len(expected) else F.when(actual.isNotNull(), F.lit(False))
        return inside if operator == "in" else ~inside
    if operator == "contains":
        return actual.contains(lit(expected))
    return {"eq": actual == lit(expected), "ne": actual != lit(expected), "lt": actual < lit(expected), "before": actual < lit(expected), "lte": actual <= lit(expected), "gt": actual > lit(expected), "after": actual > lit(expected), "gte": actual >= lit(expected)}[operator]


def near_threshold(actual: Column, expected: float, tolerance: float | None = None) -> Column:
    """Whether a number misses or meets a bound narrowly: within 2 % of it or an absolute tolerance, but not equal."""
    off = F.abs(actual.cast("double") - expected)
    return (off > 0) & (off <= (abs(expected) * 0.02 if tolerance is None else tolerance))


def compile_tree(node: Mapping, kinds: Mapping[str, str], estimated: str | None = None) -> Column:
    """A node {"all": [...]}, {"any": [...]}, {"not": node}, {"always": true} or an atom {"field", "operator", "value", "unknown"?}.

    SQL's AND, OR and NOT over nullable booleans are Kleene's. unknown: what an unknown atom counts as (`unknown`, `true`,
    `false`). estimated: an array column that names fields whose values are estimates, which atoms marked strict don't trust.
    """
    if "all" in node:
        return reduce(lambda a, b: a & b, [compile_tree(n, kinds, estimated) for n in node["all"]], F.lit(True))
    if "any" in node:
        return reduce(lambda a, b: a | b, [compile_tree(n, kinds, estimated) for n in node["any"]], F.lit(False))
    if "not" in node:
        return ~compile_tree(node["not"], kinds, estimated)
    if "always" in node:
        return F.lit(bool(node["always"]))
    name, operator = node["field"], node["operator"]
    if operator in ("exists", "not_exists"):
        return F.col(name).isNotNull() if operator == "exists" else F.col(name).isNull()
    out = compare(kinds[name], operator, F.col(name), node["value"])
    if node.get("strict") and estimated:
        out = F.when(F.array_contains(estimated, name), _unknown()).otherwise(out)
    return F.coalesce(out, F.lit(node["unknown"] == "true")) if node.get("unknown") in ("true", "false") else out


def atoms(node: Mapping) -> list[Mapping]:
    for k in ("all", "any"):
        if k in node:
            return [a for n in node[k] for a in atoms(n)]
    return atoms(node["not"]) if "not" in node else [] if "always" in node else [node]


def trace(node: Mapping, kinds: Mapping[str, str]) -> Column:
    """Every atom with its result; nothing is short-circuited."""
    return F.array(*[F.struct(F.lit(f"{a['field']} {a['operator']}").alias("atom"), compile_tree(a, kinds).alias("result")) for a in atoms(node)])


def evaluate_rules(profiles: DataFrame, rules: Sequence[Mapping], kinds: Mapping[str, str], key: str, on_date: str | None = None) -> DataFrame:
    """(key, rule_id, included, excluded, in_force, verdict, confidence): every rule over every profile in one pass over the profiles.

    Each rule is compiled once, so no row of rules is joined to the profiles. Verdicts: not in force, excluded, applies,
    does not apply, or unclear where a needed fact is unknown.
    """
    out = []
    for r in rules:
        inside = compile_tree(r["inclusion"], kinds)
        outside = compile_tree(r["exclusion"], kinds) if r.get("exclusion") else F.lit(False)
        day = F.lit(on_date).cast("date") if on_date else F.current_date()
        force = F.lit(True)
        if r.get("valid_from"):
            force = force & (day >= F.lit(r["valid_from"]).cast("date"))
        if r.get("valid_to"):
            force = force & (day <= F.lit(r["valid_to"]).cast("date"))
        unknown = reduce(lambda a, b: a + b, [F.when(compile_tree(a, kinds).isNull(), 1).otherwise(0) for a in atoms(r["inclusion"])], F.lit(0))
        verdict = F.when(~force, "not_in_force").when(outside, "excluded").when(~inside, "does_not_apply").when(inside & ~outside, "applies").otherwise("unclear")
        out.append(F.struct(F.lit(r["rule_id"]).alias("rule_id"), inside.alias("included"), outside.alias("excluded"), force.alias("in_force"), verdict.alias("verdict"), F.greatest(F.lit(0), 100 - 15 * unknown).alias("confidence")))
    return profiles.select(key, F.inline(F.array(*out)))


def verdict_report(verdicts: DataFrame, topic: str, values: Sequence[str]) -> DataFrame:
    return verdicts.groupBy(topic).pivot("verdict", list(values)).count().fillna(0)


def decide(profiles: DataFrame, rule: Mapping, kinds: Mapping[str, str], key: str, on_date: str, flag: str = "flag", ports: str | None = None, near: Sequence[tuple[str, float]] = ()) -> DataFrame:
    """One rule through its gates, in order, with every reason kept: (key, rule_id, verdict, confidence, reasons, inputs_hash).

    Gates: review state, dates, jurisdiction (flag state or a port state), exclusions, conditions, discretion. A bound
    that is met or missed narrowly and every unknown fact ask for a manual look and cost confidence, whatever the verdict.
    """
    day = F.lit(on_date).cast("date")
    dates = F.lit(True)
    if rule.get("valid_from"):
        dates = dates & (day >= F.lit(rule["valid_from"]).cast("date"))
    if rule.get("valid_to"):
        dates = dates & (day <= F.lit(rule["valid_to"]).cast("date"))
    places = list(rule.get("jurisdictions", ()))
    here = F.lit(True)
    if places:
        here = F.col(flag).isin(places)
        if ports:
            here = here | F.arrays_overlap(F.col(ports), F.array(*[F.lit(p) for p in places]))
    inside = compile_tree(rule["inclusion"], kinds)
    outside = compile_tree(rule["exclusion"], kinds) if rule.get("exclusion") else F.lit(False)
    leaves = atoms(rule["inclusion"]) + (atoms(rule["exclusion"]) if rule.get("exclusion") else [])
    open_facts = [F.when(compile_tree(a, kinds).isNull(), F.concat(F.lit("unknown: "), F.lit(a["field"]))) for a in leaves]
    narrow = [F.when(near_threshold(F.col(f), b), F.concat(F.lit("near bound: "), F.lit(f))) for f, b in near]
    free = F.lit(bool(rule.get("discretion")))
    verdict = (
        F.when(F.lit(rule.get("state", "approved") != "approved"), "not_reviewed")
        .when(~dates, "not_in_force")
        .when(~here, "other_jurisdiction")
        .when(outside, "excluded")
        .when(~inside, "does_not_apply")
        .when(inside & ~outside & here, F.when(free, "discretionary").otherwise("applies"))
        .otherwise("unclear")
    )
    reasons = F.array_distinct(F.array_compact(F.array(*open_facts, *narrow, F.when(here.isNull(), F.lit("unknown: jurisdiction")), F.when(free, F.lit("discretion")))))
    used = sorted({a["field"] for a in leaves} | ({flag} if places else set()))
    return profiles.select(
        key,
        F.lit(rule["rule_id"]).alias("rule_id"),
        verdict.alias("verdict"),
        F.greatest(F.lit(0), 100 - 15 * F.size(reasons)).alias("confidence"),
        reasons.alias("reasons"),
        F.sha2(F.concat_ws("\x00", F.lit(rule["rule_id"]), F.lit(on_date), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in used]), 256).alias("inputs_hash"),
    )


def ranked(verdicts: DataFrame, key: str) -> DataFrame:
    """Verdicts of a profile in order: what applies first, then by confidence, fewest reasons and rule."""
    order = F.array_position(F.array(*[F.lit(v) for v in ("applies", "discretionary", "unclear", "excluded", "does_not_apply", "other_jurisdiction", "not_in_force", "not_reviewed")]), F.col("verdict"))
    return verdicts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order, F.desc("confidence"), F.size("reasons"), "rule_id")))


# Deductions of the confidence, and their ceilings.
DEDUCTIONS = {"partial": 25, "unparsed": 50, "unknown": (15, 45), "near": 10, "estimated": 10, "discretion": (5, 15), "conflict": (20, 20), "historical": 10, "gap": (2, 10)}
MODES = ("current", "historical", "all")


def temporal_gate(rule: Mapping, day: Column, mode: str = "current") -> tuple[Column, Column]:
    """(passes, is past): null where the rule's state is unknown; a past rule passes in the modes historical and all, a future one only in all."""
    if mode not in MODES:
        raise ValueError(f"modes are {', '.join(MODES)}")
    state, no = rule.get("state_in_force", "in_force"), F.lit(False)
    if state == "unknown":
        return _unknown(), no
    bound = lambda name, late: (day < F.lit(str(rule[name])).cast("date") if late else day > F.lit(str(rule[name])).cast("date")) if rule.get(name) else no
    future, past = bound("valid_from", True), bound("valid_to", False) | F.lit(state == "repealed")
    passes = F.lit(True) if mode == "all" else ~future & (F.lit(True) if mode == "historical" else ~past)
    return passes, past


def jurisdiction_gate(rule: Mapping, flag: Column, areas: Column, ports: Column) -> Column:
    """Flag and waters, each `*`, matched, missed or unknown; where the rule says so, a port state makes up for another flag."""
    flags, waters = list(rule.get("flag_states", ("*",))), list(rule.get("operating_areas", ("*",)))
    overlap = lambda have, want: F.coalesce(F.arrays_overlap(have, F.array(*[F.lit(w) for w in want])), F.lit(False))
    by_flag = F.lit(True) if "*" in flags else F.when(F.coalesce(flag, F.lit("")) != "", flag.isin(flags) | (overlap(ports, flags) if rule.get("port_state_applies") else F.lit(False)))
    by_area = F.lit(True) if "*" in waters else F.when(F.size(F.coalesce(areas, F.array().cast("array<string>"))) > 0, overlap(areas, waters))
    return by_flag & by_area


def assess(profiles: DataFrame, rule: Mapping, kinds: Mapping[str, str], key: str, on_date: str, mode: str = "current", flag: str = "flag", areas: str = "areas", ports: str = "ports", estimated: str | None = None, conflicts: str | None = None, tolerance: float | None = None) -> DataFrame:
    """(key, rule_id, gate, verdict, confidence, near, unknown): a rule through its six gates: time, jurisdiction, conditions, exclusions, coverage, discretion.

    An inclusion that fails only by bounds missed narrowly is possible (manual where other facts are open too); a
    clause that may extend the rule makes a failed one possible; open exclusions, partial coverage, narrow bounds and
    softening clauses make a met one possible. rule: inclusion, exclusion, coverage (full, partial, unparsed), gaps (a
    number), discretion (list of may_extend or others), dates, state_in_force, flag_states, operating_areas.
    """
    passes, past = temporal_gate(rule, F.lit(on_date).cast("date"), mode)
    column = lambda name: F.col(name) if name in profiles.columns else F.lit(None)
    here = jurisdiction_gate(rule, column(flag).cast("string"), column(areas).cast("array<string>"), column(ports).cast("array<string>"))
    inside = compile_tree(rule["inclusion"], kinds, estimated)
    outside = compile_tree(rule["exclusion"], kinds, estimated) if rule.get("exclusion") else F.lit(False)
    leaves = atoms(rule["inclusion"])
    results = [compile_tree(a, kinds, estimated) for a in leaves]
    bounded = [(a, kinds.get(a["field"]) == "number" and a["operator"] in ("lt", "lte", "gt", "gte")) for a in leaves]
    narrow = [F.coalesce(near_threshold(F.col(a["field"]), float(a["value"]), tolerance), F.lit(False)) if number else F.lit(False) for a, number in bounded]
    count = lambda tests: reduce(lambda a, b: a + b, [F.when(t, 1).otherwise(0) for t in tests], F.lit(0))
    failed, open_ = count([~F.coalesce(r, F.lit(True)) for r in results]), count([r.isNull() for r in results])
    failed_narrowly, near = count([~F.coalesce(r, F.lit(True)) & n for r, n in zip(results, narrow, strict=True)]), count(narrow) > 0
    coverage, clauses = rule.get("coverage", "full"), list(rule.get("discretion", ()))
    extends, softens = F.lit("may_extend" in clauses), F.lit(any(c != "may_extend" for c in clauses))
    whole = here & inside
    verdict = (
        F.when(passes.isNull(), "NEEDS_MANUAL_REVIEW")
        .when(~passes | ~here, "DOES_NOT_APPLY")
        .when(~whole & extends, "POSSIBLY_APPLIES")
        .when(~whole & (failed > 0) & (failed == failed_narrowly), F.when(open_ > 0, "NEEDS_MANUAL_REVIEW").otherwise("POSSIBLY_APPLIES"))
        .when(~whole | outside, "DOES_NOT_APPLY")
        .when(F.lit(coverage == "unparsed") | whole.isNull(), "NEEDS_MANUAL_REVIEW")
        .when(outside.isNull() | F.lit(coverage == "partial") | near | softens, "POSSIBLY_APPLIES")
        .otherwise("APPLIES")
    )
    gate = F.when(passes.isNull() | ~passes, "temporal").when(~here, "jurisdiction").when(~whole, "conditions").when(outside, "exclusions").when(F.lit(coverage == "unparsed"), "coverage").otherwise("decision")
    d = DEDUCTIONS
    guessed = F.lit(False) if estimated is None else F.coalesce(F.arrays_overlap(F.col(estimated), F.array(*[F.lit(a["field"]) for a in leaves]).cast("array<string>")), F.lit(False))
    clashes = F.lit(0) if conflicts is None else F.size(F.coalesce(F.col(conflicts), F.array().cast("array<string>")))
    limited = lambda n, name: F.least(n * d[name][0], F.lit(d[name][1]))
    loss = F.lit(d.get(coverage, 0)) + limited(open_, "unknown") + F.when(near, d["near"]).otherwise(0) + F.when(guessed, d["estimated"]).otherwise(0) + limited(F.lit(len(clauses)), "discretion") + limited(clashes, "conflict") + F.when(past, d["historical"]).otherwise(0) + limited(F.lit(int(rule.get("gaps", 0))), "gap")
    return profiles.select(key, F.lit(rule["rule_id"]).alias("rule_id"), gate.alias("gate"), verdict.alias("verdict"), F.greatest(F.lit(0), 100 - loss).cast("int").alias("confidence"), near.alias("near"), open_.alias("unknown"))


def supporting(fragments: DataFrame, rules: DataFrame, key: str, rule: str, most: int = 3) -> DataFrame:
    """(rule, key, share, n): the fragments that share most of a rule's words, at most `most` each; they never change a verdict.

    fragments: (key, tokens array); rules: (rule, tokens array), a bounded table.
    """
    wanted = rules.select(rule, F.explode(F.array_distinct("tokens")).alias("token"), F.size(F.array_distinct("tokens")).alias("_all"))
    have = fragments.select(key, F.explode(F.array_distinct("tokens")).alias("token"))
    shared = have.join(wanted, "token").groupBy(rule, key).agg((F.count(F.lit(1)) / F.max("_all")).alias("share"))
    return shared.withColumn("n", F.row_number().over(Window.partitionBy(rule).orderBy(F.desc("share"), key))).where(F.col("n") <= most)


def supporting_fragments(chunks: DataFrame, query_vector: Sequence[float] | None = None, query_text: str | None = None, document: str = "document_id", chunk: str = "chunk_id", heading: str = "heading", content: str = "content", vector: str = "embedding", most: int = 5) -> DataFrame:
    """(document, chunk, score, method, n): the chunks of each document that support a decision best, at most `most`; they never change a verdict.

    By cosine where a vector is asked and any chunk has one of its length; else by the share of the question's words of
    more than two letters that a chunk has anywhere, if any. Ties go to the smaller chunk.
    """
    scored = None
    if query_vector is not None:
        asked = F.array(*[F.lit(float(x)) for x in query_vector])
        scored = chunks.where(F.size(vector) == len(query_vector)).select(document, chunk, cosine(F.col(vector), asked).alias("score"), F.lit("vector").alias("method"))
    if scored is None or scored.isEmpty():
        terms = sorted({t for t in re.findall(TOKEN, fold_text(query_text)) if len(t) > 2})
        if not terms:
            return chunks.select(document, chunk, F.lit(0.0).alias("score"), F.lit("lexical").alias("method"), F.lit(0).alias("n")).limit(0)
        said = chunks.select(document, chunk, F.inline(F.array(F.struct(fold(F.concat_ws(" ", F.coalesce(heading, F.lit("")), content)).alias("_t")))))
        hits = reduce(lambda a, b: a + b, [F.col("_t").contains(t).cast("int") for t in terms])
        scored = said.select(document, chunk, F.bround(hits / len(terms), 4).alias("score"), F.lit("lexical").alias("method")).where("score > 0")
    order = Window.partitionBy(document).orderBy(F.desc("score"), chunk)
    return scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
