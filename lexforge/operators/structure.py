"""Legal structure and chunks: parts, chapters, paragraphs and subsections with character spans, and passages for embedding.

Spans are places in the normalised text (`legal_text`). Openers at the start of a line always count. Where a source gives a
whole act on one line, an opener inside a line counts under four guards: it has the canonical form (`§ 4.`), a capital
follows it, no abbreviation or referring word stands before it, and its number goes on from the one before. So a reference
such as `jf. § 4` never becomes a paragraph. The walk over openers keeps a state, so it is one Arrow function a document;
texts of units and chunks are cut there, and everything around it is Columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import or_empty, paragraph_key, strip_html
from lexforge.operators.spans import containing

# What openers look like, and what may not stand before one inside a line.
LEVEL = r"(?:\d+(?:\s*[a-zA-Z](?![a-zA-ZæøåÆØÅ]))?|[IVXLCDM]+)"
ABBREVIATIONS = ("jf", "nr", "stk", "pkt", "litra", "kap", "bek", "lbk", "lov", "art", "jfr", "bilag", "afsn", "eks", "ca", "mv", "m.v", "f.eks")
REFERRING = (
    *("i", "efter", "til", "og", "samt", "eller", "af", "ved", "se", "om", "jf", "jfr", "medfør", "henhold", "omfattet", "nævnt", "følger"),
    *("medmindre", "dog", "ikke", "end", "herunder", "fra", "under", "anvendelse", "gælder", "jf."),
)
PROMULGATION = r"(?i)\bi\s+medf(?:ø|oe)r\s+af\b"
LONGEST_TITLE, LONGEST_HEADING, SHORTEST_PREAMBLE = 512, 90, 120

CAPITAL = r"(?=\s+[A-ZÆØÅ«\"])"
OPENER = re.compile(
    rf"(?P<line>^[^\S\n]*)?(?:(?P<level>(?i:kapitel|afsnit))\s+(?P<label>{LEVEL})"
    r"|§\s*(?P<number>\d+)(?:\s*(?P<letter>[a-zA-Z])(?![a-zA-ZæøåÆØÅ]))?"
    r"|[Ss]tk\.\s*(?P<sub>\d+))",
    re.M,
)
BEFORE = re.compile(rf"(?:(?:^|[\s,;(])(?:{'|'.join(map(re.escape, ABBREVIATIONS))})\.|(?:^|\s)(?:{'|'.join(map(re.escape, REFERRING))}))\s*$", re.I)
LOOK_BACK = 80

UNITS = (
    "array<struct<kind:string,part:string,part_title:string,chapter:string,chapter_title:string,heading:string,"
    "number:string,letter:string,subsection:int,start:int,end:int,text:string>>"
)
CHUNKS = (
    "array<struct<chunk_index:int,kind:string,part:string,part_title:string,chapter:string,chapter_title:string,"
    "number:string,letter:string,piece:int,start:int,end:int,text:string>>"
)


def legal_text(text: Column) -> Column:
    """The form whose places spans name: without markup, one space in a row, no space at line ends, no empty lines."""
    return strip_html(F.regexp_replace(or_empty(text), r"\r\n?", "\n"))


def _key(m: re.Match) -> tuple[int, str]:
    return int(m["number"]), (m["letter"] or "").lower()


def openers(text: str) -> list[re.Match]:
    """The openers that count, in text order."""
    out: list[re.Match] = []
    paragraph, chapter = (0, ""), 0
    for m in OPENER.finditer(text):
        first = m["line"] is not None
        level, label = (m["level"] or "").lower(), re.sub(r"\s", "", m["label"] or "")
        if not first:
            # Inside a line: the canonical form and a capital after it, nothing that refers before it, a number that goes on.
            dotted = m["level"] is None
            rest = text[m.end() : m.end() + LOOK_BACK]
            if not re.match((r"\s*\." if dotted else "") + CAPITAL, rest) or level == "afsnit" or level and (m["level"] != "Kapitel" or not label.isdigit() or int(label) <= chapter):
                continue
            if m["number"] and _key(m) <= paragraph:
                continue
            if m["sub"] and text[m.start()] != "S":
                continue
            line = text.rfind("\n", 0, m.start()) + 1
            if BEFORE.search(text[max(line, m.start() - LOOK_BACK) : m.start()]):
                continue
        elif m["sub"] and text[m.end("line")] != "S" or m["number"] and text[m.end("line") :].startswith("§§"):
            continue
        if m["number"]:
            paragraph = _key(m)
        elif level == "kapitel" and label.isdigit():
            chapter = int(label)
        out.append(m)
    return out


def _heading(line: str) -> bool:
    return 0 < len(line) <= LONGEST_HEADING and line[-1] not in ".:;," and not re.match(r"\d+\)", line)


def _title(rest: str) -> tuple[str | None, bool]:
    """The title of a part or chapter: what stands on its line, else the next line, if it looks like one; whether it is the next."""
    lines = [x.strip() for x in rest.split("\n")]
    own = re.sub(r"^[.:]?\s*", "", lines[0])
    if own:
        return (" ".join(own.split()) if len(own) <= LONGEST_TITLE else None), False
    return (lines[1], True) if len(lines) > 1 and _heading(lines[1]) else (None, False)


def parse(text: str | None) -> list[dict]:
    """Units in text order: preamble, part, chapter, paragraph and its subsections; of a text without paragraphs also `text`."""
    text = text or ""
    found = openers(text)
    out: list[dict] = []
    level: dict = dict.fromkeys(("part", "part_title", "chapter", "chapter_title", "heading"))

    def unit(kind: str, start: int, end: int, **more) -> None:
        out.append({"kind": kind, **level, "number": None, "letter": None, "subsection": None, **more, "start": start, "end": end, "text": text[start:end].strip()})

    first = next((m.start() for m in found if not m["sub"]), len(text))
    head = text[:first].strip()
    if head and (re.search(PROMULGATION, head) or len(head) > SHORTEST_PREAMBLE) and first < len(text):
        unit("preamble", 0, first)
    elif first < len(text):
        level["heading"] = next((x.strip() for x in reversed(head.split("\n")) if _heading(x.strip())), None)
    main = [i for i, m in enumerate(found) if not m["sub"]]
    for place, i in enumerate(main):
        m = found[i]
        end = found[main[place + 1]].start() if place + 1 < len(main) else len(text)
        if m["level"]:
            title, below = _title(text[m.end() : end])
            name = "part" if m["level"].lower() == "afsnit" else "chapter"
            if name == "part":
                level.update(part_title=None)
            level.update({name: re.sub(r"\s", "", m["label"]), f"{name}_title": title, "heading": None})
            lines = [x.strip() for x in text[m.end() : end].split("\n")[1 + below :]]
            level["heading"] = next((x for x in reversed(lines) if _heading(x)), None)
            unit(name, m.start(), end)
            continue
        number = {"number": m["number"], "letter": m["letter"]}
        unit("paragraph", m.start(), end, **number)
        subs = found[i + 1 : main[place + 1] if place + 1 < len(main) else len(found)]
        edges = [*(x.start() for x in subs), end]
        for s, a, b in zip(subs, edges, edges[1:], strict=False):
            unit("subsection", a, b, **number, subsection=int(s["sub"]))
    if not any(u["kind"] == "paragraph" for u in out) and text.strip():
        out.append({"kind": "text", **dict.fromkeys(level), "number": None, "letter": None, "subsection": None, "start": 0, "end": len(text), "text": text.strip()})
    return out


def _break(text: str, start: int, target: int, end: int, least: int) -> int:
    """The best place to end a passage: after a paragraph, else a sentence, else a word; the last such place up to the target."""
    for pattern in (r"\n\s*\n", r"(?<=[.!?])\s+(?=[A-ZÆØÅ§])"):
        places = [m.start() for m in re.compile(pattern).finditer(text, start, end) if m.start() - start >= least]
        if places:
            return max((p for p in places if p <= target), default=places[0])
    space = text.rfind(" ", start + least, target)
    return space if space > start else end


def _pieces(text: str, start: int, end: int, subs: list[int], target: int, most: int, least: int) -> list[tuple[int, int]]:
    """A paragraph whole, or cut at its subsections, else at sentences, else at words."""
    if end - start <= most:
        return [(start, end)]
    places = [p for p in subs if start < p < end] or [m.end() for m in re.compile(r"(?<=[.!?])\s+(?=[A-ZÆØÅ§])").finditer(text, start, end)]
    if places:
        edges = [start]
        for p in places:
            if p - edges[-1] >= target:
                edges.append(p)
        return list(zip(edges, [*edges[1:], end], strict=True))
    out = []
    while start < end:
        stop = min(start + most, end)
        space = text.rfind(" ", start + least, stop) if stop < end else -1
        stop = space if space > start else stop
        out.append((start, stop))
        start = stop
    return out


def chunks(text: str | None, target: int = 1200, most: int = 2000, overlap: int = 150, least: int = 120) -> list[dict]:
    """A paragraph is a chunk, with the headings before it; long ones are cut; a text without paragraphs becomes fragments that overlap."""
    text = text or ""
    units, out = parse(text), []
    fields = ("part", "part_title", "chapter", "chapter_title", "number", "letter")

    def chunk(kind: str, start: int, end: int, unit: dict | None = None, piece: int | None = None) -> None:
        if text[start:end].strip():
            out.append({"chunk_index": len(out), "kind": kind, **{f: unit[f] if unit else None for f in fields}, "piece": piece, "start": start, "end": end, "text": text[start:end].strip()})

    paragraphs = [u for u in units if u["kind"] == "paragraph"]
    if not paragraphs:
        at = 0
        while at < len(text):
            stop = len(text) if len(text) - at <= most else _break(text, at, at + target, at + most, least)
            chunk("fragment", at, stop)
            if stop == len(text):
                break
            at = max(stop - overlap, at + 1)
        return out
    cursor = 0
    if units[0]["kind"] == "preamble":
        cursor = units[0]["end"]
        chunk("preamble", 0, cursor)
    for u in paragraphs:
        subs = [s["start"] for s in units if s["kind"] == "subsection" and u["start"] <= s["start"] < u["end"]] if u["end"] - cursor > most else []
        end = len(text) if u is paragraphs[-1] else u["end"]
        pieces = _pieces(text, cursor, end, subs, target, most, least)
        for n, (a, b) in enumerate(pieces, 1):
            chunk("paragraph", a, b, u, n if len(pieces) > 1 else None)
        cursor = end
    return out


def _column(of, kind: str):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(of)

    return F.pandas_udf(run, kind)


def parsed(text: Column) -> Column:
    """All units of a text, in its order."""
    return _column(parse, UNITS)(legal_text(text))


def units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per unit, with its text and a sort key."""
    rows = docs.select(key, F.posexplode(parsed(F.col(text))).alias("position", "u")).select(key, "position", "u.*")
    return rows.withColumn("sort_key", F.when(F.col("number").isNotNull(), paragraph_key(F.col("number"), F.col("letter"))))


def paragraph_label(number: Column, letter: Column) -> Column:
    return F.when(number.isNotNull(), F.concat_ws(" ", F.lit("§"), number, letter))


def chunked(docs: DataFrame, key: str, text: str, target: int = 1200, most: int = 2000, title: str | None = None, document_number: str | None = None) -> DataFrame:
    """One row per chunk, with its address in the act, citation, heading and the text that is embedded."""
    carried = [c for c in (title, document_number) if c]
    found = F.explode(_column(lambda t: chunks(t, target, most), CHUNKS)(legal_text(F.col(text)))).alias("c")
    rows = docs.select(key, *[F.col(c).alias(f"_{n}") for n, c in zip(("title", "number"), carried, strict=False)], found)
    rows = rows.select(key, *[c for c in rows.columns if c not in (key, "c")], "c.*")
    name = or_empty(F.col("_title")) if title else F.lit("")
    label = paragraph_label(F.col("number"), F.col("letter"))
    chapter = F.when(F.col("chapter").isNotNull(), F.concat(F.lit("Kapitel "), "chapter"))
    preamble = F.col("kind") == "preamble"
    place = F.when(label.isNotNull() & F.col("chapter").isNotNull(), F.concat(label, F.lit(", kapitel "), "chapter")).otherwise(F.coalesce(label, chapter, F.lit("")))
    path = F.concat_ws(" · ", chapter, label)
    head = F.when(F.col("_number").isNotNull() & (name != ""), F.concat(name, F.lit(" (nr. "), "_number", F.lit(")"))).otherwise(name) if document_number else name
    context = F.concat_ws(" · ", F.when(F.col("chapter_title").isNotNull(), F.concat(chapter, F.lit(" — "), "chapter_title")).otherwise(chapter), "part_title", label)
    prefix = F.array_join(F.filter(F.array(head, context), lambda x: x != ""), " — ")
    return rows.withColumns(
        {
            "citation": F.trim(F.concat_ws(" ", name, F.when(preamble, "(præambel)").otherwise(place))),
            "heading": F.when(preamble, "Præambel").otherwise(F.coalesce(label, chapter, "part_title")),
            "legal_path": F.when((F.col("piece") > 1) & (path != ""), F.concat(path, F.lit(" (del "), F.col("piece").cast("string"), F.lit(")"))).otherwise(path),
            "embedding_text": F.when(prefix != "", F.concat(prefix, F.lit("\n"), "text")).otherwise(F.col("text")),
        }
    ).drop("_title", "_number")


def contents(found: DataFrame, key: str) -> DataFrame:
    """(key, contents) from units(): chapters in order, each with its title and the paragraphs in it."""
    rows = found.where("kind = 'paragraph'").groupBy(key, "part", "chapter", "chapter_title").agg(F.min("position").alias("position"), F.sort_array(F.collect_list(F.struct("position", paragraph_label(F.col("number"), F.col("letter")).alias("label"), "heading"))).alias("p"))
    entry = F.struct("position", "part", "chapter", "chapter_title", F.transform("p", lambda x: F.struct(x["label"].alias("label"), x["heading"].alias("heading"))).alias("paragraphs"))
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("contents"))


def anchor_slug(value: Column) -> Column:
    return F.regexp_replace(F.lower(or_empty(value)), "[^0-9a-zæøå]+", "")


def anchors(places: DataFrame, found: DataFrame, key: str, position: str) -> DataFrame:
    """places with `anchor`, the page anchor of the paragraph (and subsection from the second on) that holds a character position.

    found: units(). Places and units are swept in the order of positions, in cells, so a long document is not one task's work.
    """
    in_paragraph = containing(places, found.where("kind = 'paragraph'"), key, position, "start", "end", ["chapter", "number", "letter"], "_p")
    base = containing(in_paragraph, found.where("kind = 'subsection' AND subsection > 1"), key, position, "start", "end", ["subsection"], "_s")
    chapter = anchor_slug(F.col("_p.chapter"))
    number = anchor_slug(F.concat_ws("", "_p.number", "_p.letter"))
    sub = F.when(F.col("_s.subsection").isNotNull(), F.concat(F.lit("-stk"), F.col("_s.subsection").cast("string")))
    anchor = F.when(number != "", F.substring(F.concat_ws("", F.lit("p-"), F.when(chapter != "", F.concat(chapter, F.lit("-"))), number, sub), 1, 64))
    return base.select(*places.columns, anchor.alias("anchor"))


def stale(docs: DataFrame, indexed: DataFrame, key: str, version: str, model: str) -> DataFrame:
    """Documents whose chunks are missing or come from another version or model. indexed: (key, version, model), a row per document."""
    same = indexed.where(F.col("model") == model).select(key, version).distinct()
    return docs.join(same, [key, version], "left_anti")


def reindexed(chunks_now: DataFrame, indexed: DataFrame, docs: DataFrame, key: str, version: str, text: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, indexed) after the stale documents were cut anew: their old chunks go; documents without text count as done."""
    todo = stale(docs, indexed, key, version, model)
    fresh = chunked(todo, key, text).join(todo.select(key, version), key).withColumn("model", F.lit(model))
    kept = chunks_now.join(todo.select(key), key, "left_anti")
    done = todo.select(key, version, F.lit(model).alias("model"))
    return kept.unionByName(fresh, allowMissingColumns=True), indexed.join(todo.select(key), key, "left_anti").unionByName(done)
