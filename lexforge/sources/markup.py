"""Tolerant readers of XML and JSON payloads: records by candidate names, lines of a body, the record list of a response."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections import deque
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that go on in the line that they stand in.
INLINE = frozenset("a b i em strong sub sup span u char exponentiation".split())
DEEPEST = 8


def _name(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _tree(payload: str | None) -> ET.Element | None:
    try:
        return ET.fromstring(payload or "")
    except ET.ParseError:
        return None


def xml_record(payload: str | None, fields: Mapping[str, Sequence[str]]) -> dict[str, str | None]:
    """For each field the first text found under its names, in their order; names match elements and attributes in any namespace."""
    root = _tree(payload)
    found: dict[str, str] = {}
    for element in root.iter() if root is not None else ():
        for name, value in [(_name(element.tag), " ".join("".join(element.itertext()).split())), *((_name(k), v) for k, v in element.attrib.items())]:
            if value:
                found.setdefault(name, value)
    return {f: next((found[n.lower()] for n in names if n.lower() in found), None) for f, names in fields.items()}


def xml_lines(payload: str | None) -> list[str]:
    """Lines of a body, one per element boundary; inline elements don't break a line. Malformed markup: its text without tags."""
    root = _tree(payload)
    if root is None:
        return [x for x in (" ".join(p.split()) for p in re.sub(r"<[^>]+>", "\n", payload or "").split("\n")) if x]
    lines, now = [], []

    def end() -> None:
        text = " ".join("".join(now).split())
        if text:
            lines.append(text)
        now.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        else:
            block = _name(x.tag) not in INLINE
            if block:
                end()
            rest = [x.text or ""]
            for child in x:
                rest += [child, child.tail or ""]
            stack += reversed(rest + [None] * block)
    end()
    return lines


def record_list(payload: str | None, names: Sequence[str]) -> list[dict]:
    """The longest list in a JSON payload of which at least half the objects carry one of the names, searched breadth-first to a depth of eight."""
    try:
        top = json.loads(payload or "")
    except ValueError:
        return []
    wanted = {re.sub("[^a-z0-9]", "", n.lower()) for n in names}
    best: list[dict] = []
    queue = deque([(top, 0)])
    while queue:
        node, depth = queue.popleft()
        if isinstance(node, list):
            objects = [x for x in node if isinstance(x, dict)]
            carriers = sum(any(re.sub("[^a-z0-9]", "", k.lower()) in wanted for k in x) for x in objects)
            if objects and 2 * carriers >= len(objects) and len(objects) > len(best):
                best = objects
        if depth < DEEPEST and isinstance(node, (dict, list)):
            queue.extend((x, depth + 1) for x in (node.values() if isinstance(node, dict) else node))
    return best


def _udf(of, kind: str):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(of)

    return F.pandas_udf(run, kind)


def read_xml(payloads: DataFrame, column: str, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """payloads with the fields and `lines`."""
    kind = "struct<" + ",".join(f"{f}:string" for f in fields) + ">"

    def records(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([xml_record(x, fields) for x in s], columns=list(fields))

    out = payloads.withColumn("_r", F.pandas_udf(records, kind)(F.col(column))).withColumn("lines", _udf(xml_lines, "array<string>")(F.col(column)))
    return out.select("*", "_r.*").drop("_r")


def read_responses(payloads: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """payloads with `record`, one row per object of the response's record list, as JSON."""
    as_json = lambda x: [json.dumps(r, ensure_ascii=False, sort_keys=True) for r in record_list(x, names)]
    return payloads.withColumn("record", F.explode(_udf(as_json, "array<string>")(F.col(column))))
