"""Thousands of flat rules: an index over their conditions instead of an expression for each rule.

`flat_rules.evaluate` makes one Column of each rule, which a plan can hold for some hundreds of them. Here the rules are
data: equal conditions are one, values that are compared for equality are looked up in a field's set of targets, and bounds
are sorted, so that one search of a profile's number gives all bounds that it reaches. A rule's verdict then follows from
counts over its conditions: inclusions not met, exclusions met, and conditions without a fact. Profiles go through in
blocks of Arrow batches; the index is bounded by the rules (RULES of them at most), never by the profiles.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.operators.flat_rules import ASSUMED, FIELDS, REQUIRED, VERDICTS, problem

RULES = 50_000
#: Rows given on at once.
ROWS = 200_000
STEPS = ("temporal_validity", "keel_laid", "invalid", "exclusions", "missing_data", "inclusions")
BOUNDS = {"gt": "left", "gte": "right", "lt": "right", "lte": "left"}
_FIRST = datetime.date(1970, 1, 1)


def _plain(field: str, value):
    kind = FIELDS[field]
    if kind == "number":
        return float(value)
    if kind == "date":
        return float((datetime.date.fromisoformat(str(value)) - _FIRST).days)
    return value if kind == "boolean" else str(value).strip().lower()


class _Field:
    """All conditions on one field: its targets for equality, and its sorted bounds."""

    def __init__(self, name: str, conditions: Sequence[tuple[str, tuple]]):
        self.name, self.kind, self.conditions = name, FIELDS[name], list(conditions)
        equal = [(i, op, t) for i, (op, t) in enumerate(self.conditions) if op not in BOUNDS]
        self.targets = sorted({v for _, _, t in equal for v in t})
        at = {v: i for i, v in enumerate(self.targets)}
        # member[c, 1 + target]: whether condition c is met by it; column 0 stands for all other values.
        self.equal = [i for i, _, _ in equal]
        self.member = np.zeros((len(equal), len(self.targets) + 1), bool)
        for row, (_, op, t) in enumerate(equal):
            self.member[row, [1 + at[v] for v in t]] = True
            if op == "neq":
                self.member[row] = ~self.member[row]
        self.bounds = sorted({t[0] for op, t in self.conditions if op in BOUNDS})
        place = {v: i for i, v in enumerate(self.bounds)}
        self.reach = [(i, op, place[t[0]]) for i, (op, t) in enumerate(self.conditions) if op in BOUNDS]

    def met(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows by conditions: whether met, rows: whether there is no fact)."""
        missing = np.asarray(column.is_null())
        out = np.zeros((len(column), len(self.conditions)), bool)
        if self.equal:
            if self.kind == "text_list":
                values = pc.index_in(column.flatten(), value_set=pa.array(self.targets, pa.string())).fill_null(-1).to_numpy()
                has = np.zeros((len(column), len(self.targets) + 1), bool)
                has[pc.list_parent_indices(column).to_numpy(), values + 1] = True
                has[:, 0] = False
                out[:, self.equal] = has.astype(np.float32) @ self.member.T.astype(np.float32) > 0
            else:
                kind = pa.float64() if self.kind in ("number", "date") else pa.bool_() if self.kind == "boolean" else pa.string()
                code = self._codes(column.cast(kind), kind)
                out[:, self.equal] = self.member[:, code + 1].T
        if self.reach:
            x = np.nan_to_num(column.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf, neginf=-np.inf)
            rank = {side: np.searchsorted(self.bounds, x, side) for side in ("left", "right")}
            for i, op, at in self.reach:
                above = rank[BOUNDS[op]] > at
                out[:, i] = above if op in ("gt", "gte") else ~above
        return out & ~missing[:, None], missing

    def _codes(self, column: pa.Array, kind: pa.DataType) -> np.ndarray:
        if self.kind == "boolean":  # no index over booleans: two values
            at = {v: i for i, v in enumerate(self.targets)}
            return np.array([at.get(v, -1) for v in column.to_pylist()], np.int64)
        return pc.index_in(column, value_set=pa.array(self.targets, kind)).fill_null(-1).to_numpy()


class RuleIndex:
    """Rules (as `flat_rules` has them) in the order of their topics and ids."""

    def __init__(self, rules: Sequence[Mapping]):
        if len(rules) > RULES:
            raise ValueError(f"an index has at most {RULES} rules")
        self.rules = sorted(rules, key=lambda r: (r["topic_category"], r["rule_id"]))
        numbers: dict[tuple, int] = {}
        self.invalid = np.zeros(len(self.rules), bool)
        uses: list[tuple[int, int, bool]] = []  # (rule, condition, inclusion)
        for r, rule in enumerate(self.rules):
            for kind in ("inclusion", "exclusion"):
                for c in rule.get(f"{kind}_conditions") or ():
                    if problem(c, kind):
                        self.invalid[r] = True
                        continue
                    target = c["target_value"]
                    many = target if isinstance(target, (list, tuple)) else [target]
                    key = (c["field"], c["operator"], tuple(sorted({_plain(c["field"], v) for v in many})))
                    uses.append((r, numbers.setdefault(key, len(numbers)), kind == "inclusion"))
        by_field: dict[str, list[tuple[str, tuple]]] = {}
        self.place: dict[int, tuple[str, int]] = {}
        for (field, op, target), n in numbers.items():
            by_field.setdefault(field, []).append((op, target))
            self.place[n] = (field, len(by_field[field]) - 1)
        self.fields = {f: _Field(f, c) for f, c in by_field.items()}
        start, self.offset = 0, {}
        for f in self.fields:
            self.offset[f], start = start, start + len(self.fields[f].conditions)
        self.size = start
        self.names = list(self.fields)
        self.include, self.exclude = (self._uses([(r, self._column(c)) for r, c, i in uses if i == wanted]) for wanted in (True, False))
        self.need = self._uses(sorted({(r, self.names.index(self.place[c][0])) for r, c, _ in uses}))
        self.windows = {n: np.array([self._day(r.get(n), nothing) for r in self.rules]) for n, nothing in (("valid_from", -np.inf), ("valid_to", np.inf), ("keel_laid_after", -np.inf), ("keel_laid_before", np.inf))}
        self.windowed = np.array([bool(r.get("keel_laid_after") or r.get("keel_laid_before")) for r in self.rules], bool)

    @staticmethod
    def _day(value, nothing: float) -> float:
        return float((datetime.date.fromisoformat(str(value)) - _FIRST).days) if value else nothing

    def _column(self, condition: int) -> int:
        field, at = self.place[condition]
        return self.offset[field] + at

    def _uses(self, pairs: Sequence[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(columns in the order of rules, where each rule's begin), for `_count`."""
        pairs = sorted(pairs)
        return np.array([c for _, c in pairs], np.int64), np.searchsorted([r for r, _ in pairs], np.arange(len(self.rules) + 1))

    @staticmethod
    def _count(flags: np.ndarray, uses: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Rows by rules: how many of a rule's columns are set."""
        columns, at = uses
        sums = np.zeros((len(flags), len(columns) + 1), np.int32)
        np.cumsum(flags[:, columns], axis=1, out=sums[:, 1:])
        return sums[:, at[1:]] - sums[:, at[:-1]]

    def decide(self, columns: Mapping[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(verdict, step, missing by field, via conversion, whether that is known) of rows by rules; verdict and step as places in VERDICTS and STEPS."""
        n = len(columns["_day"])
        met, missing = np.zeros((n, self.size), bool), np.zeros((n, max(1, len(self.names))), bool)
        for i, f in enumerate(self.names):
            at = self.offset[f]
            met[:, at : at + len(self.fields[f].conditions)], missing[:, i] = self.fields[f].met(columns[f])
        there = ~missing[:, [self.names.index(f) for f in self.names for _ in self.fields[f].conditions]] if self.names else np.zeros((n, 0), bool)
        failed = self._count(there & ~met, self.include) > 0
        excluded = self._count(met, self.exclude) > 0
        lacking = self._count(missing, self.need) > 0
        day, keel, conversion = (columns[c].cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None] for c in ("_day", "_keel", "_conversion"))
        w = self.windows
        with np.errstate(invalid="ignore"):  # what is null is nan, and no comparison with it holds
            expired = (day < w["valid_from"]) | (day > w["valid_to"])
            outside = (keel < w["keel_laid_after"]) | (keel >= w["keel_laid_before"])
            in_time = (conversion <= day) & (conversion >= w["keel_laid_after"]) & (conversion < w["keel_laid_before"]) & self.windowed
        converted = in_time & outside
        known = ~(in_time & np.isnan(keel))
        step = np.select([expired, outside & ~converted, np.broadcast_to(self.invalid, failed.shape), excluded, lacking & ~failed], [0, 1, 2, 3, 4], 5)
        verdict = np.select([step == 0, step == 1, step == 2, step == 3, step == 4, failed, converted], [3, 3, 2, 3, 2, 3, 1], 0)
        return verdict, step, missing, converted, known


def _fact(name: str, supplied: str) -> Column:
    """A field as it is compared, null where it wasn't given."""
    given = F.coalesce(F.array_contains(supplied, name), F.lit(False))
    known = F.col(name).isNotNull() & (F.lit(name in REQUIRED) | given)
    kind, raw = FIELDS[name], F.col(name)
    value = raw.cast("double") if kind == "number" else F.unix_date(raw.cast("date")).cast("double") if kind == "date" else raw if kind == "boolean" else F.transform(raw, lambda x: F.lower(F.trim(x))) if kind == "text_list" else F.lower(F.trim(raw))
    return F.when(~given, F.lit(ASSUMED[name])).when(known, value) if name in ASSUMED else F.when(known, value)


def evaluate_many(profiles: DataFrame, rules: Sequence[Mapping], key: str, supplied: str = "supplied", only: Sequence[str] | None = None) -> DataFrame:
    """(key, rule_id, topic_category, verdict, step, missing_fields, via_conversion), as `flat_rules.evaluate` without its list of conditions.

    only: verdicts that are wanted; pairs with others give no row.
    """
    index = RuleIndex(rules)
    wanted = np.array([only is None or v in only for v in VERDICTS])
    types = {"number": "double", "date": "date", "boolean": "boolean", "text_list": "array<string>"}
    lacking = {f: F.lit(None).cast(types.get(k, "string")) for f, k in FIELDS.items() if f not in profiles.columns}
    days = [F.unix_date(F.col(c).cast("date")).cast("double").alias(a) for c, a in (("assessment_date", "_day"), ("keel_laid_date", "_keel"), ("major_conversion_date", "_conversion"))]
    facts = profiles.withColumns(lacking).select(F.col(key).alias("_key"), *days, *[_fact(f, supplied).alias(f) for f in index.names])
    ids, topics = pa.array([r["rule_id"] for r in index.rules], pa.string()), pa.array([r["topic_category"] for r in index.rules], pa.string())
    verdicts, steps = pa.array(VERDICTS), pa.array(STEPS)
    need = [sorted({index.names[c] for c in index.need[0][a:b]}) for a, b in zip(index.need[1], index.need[1][1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = max(1, ROWS // max(1, len(index.rules)))
        for b in batches:
            for at in range(0, b.num_rows, some):
                part = b.slice(at, some)
                verdict, step, missing, converted, known = index.decide({n: part.column(n) for n in part.schema.names})
                row, rule = np.nonzero(wanted[verdict])
                lacks = [[n for n in need[r] if missing[i, index.names.index(n)]] if step[i, r] == 4 else [] for i, r in zip(row.tolist(), rule.tolist(), strict=True)]
                columns = [part.column("_key").take(pa.array(row)), ids.take(pa.array(rule)), topics.take(pa.array(rule)), verdicts.take(pa.array(verdict[row, rule])), steps.take(pa.array(step[row, rule])), pa.array(lacks, pa.list_(pa.string())), pa.array(converted[row, rule], mask=~known[row, rule])]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "rule_id", "topic_category", "verdict", "step", "missing_fields", "via_conversion"])

    text = T.StringType()
    schema = T.StructType([T.StructField("_key", facts.schema["_key"].dataType), *[T.StructField(c, text) for c in ("rule_id", "topic_category", "verdict", "step")], T.StructField("missing_fields", T.ArrayType(text)), T.StructField("via_conversion", T.BooleanType())])
    return facts.mapInArrow(run, schema).withColumnRenamed("_key", key)
