"""Text functions as Columns. Missing text counts as empty, as everywhere in the engine.

Unicode composition (NFC) is no Spark function, so it is the one step here that leaves the JVM, as an Arrow batch. Where a
text is stored composed (`composed` does that once), `normalised=True` skips it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that are rewritten before matching.
FOLDED_ONE_TO_ONE = {"é": "e", "É": "e", "è": "e", "È": "e", "ô": "o", "Ô": "o", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "}
FOLDED_TO_TWO = {"æ": "ae", "Æ": "ae", "ø": "oe", "Ø": "oe", "å": "aa", "Å": "aa", "ä": "ae", "Ä": "ae", "ö": "oe", "Ö": "oe", "ü": "ue", "Ü": "ue"}
FOLDED_TO_NONE = ("­",)
_SPELLED = str.maketrans(FOLDED_ONE_TO_ONE | FOLDED_TO_TWO | dict.fromkeys(FOLDED_TO_NONE, ""))
# Tags that end a line, entities, letters of a token.
BLOCK_TAGS = r"(?i)</?(p|div|br|tr|li|h[1-6]|table|section|article)\b[^>]*>"
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}
TOKEN = "[0-9a-zæøåäöüéè]+"
#: White space as Unicode has it, as a Java pattern.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def _composed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column, normalised: bool = False) -> Column:
    """Composed Unicode form. normalised: the input is known to be composed, so the expression stays in the JVM."""
    return text if normalised else F.pandas_udf(_composed, "string")(text)


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """df with the columns in composed form, so that later functions may take them as `normalised`."""
    return df.withColumns({c: nfc(F.col(c)) for c in columns})


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fold(text: Column, normalised: bool = False) -> Column:
    """Matching form: composed, Danish letters spelled out, quotes and dashes plain, lower case."""
    out = nfc(or_empty(text), normalised)
    out = F.translate(out, "".join(FOLDED_ONE_TO_ONE) + "".join(FOLDED_TO_NONE), "".join(FOLDED_ONE_TO_ONE.values()))
    for a, b in FOLDED_TO_TWO.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.lower(out)


def fold_text(text: str | None) -> str:
    """fold() of a driver-side string, such as a term of a configuration."""
    return unicodedata.normalize("NFC", text or "").translate(_SPELLED).lower()


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(or_empty(text), SPACE, " "))


def strip_html(text: Column) -> Column:
    """Block tags become line ends, other tags spaces; six entities are decoded, lines collapsed, empty lines dropped."""
    out = F.regexp_replace(F.regexp_replace(or_empty(text), BLOCK_TAGS, "\n"), "<[^>]+>", " ")
    for a, b in ENTITIES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), collapse_space), lambda x: x != ""), "\n")


def content_hash(text: Column, normalised: bool = False) -> Column:
    """SHA-256 of the text without differences in white space or Unicode form; case counts."""
    return F.sha2(collapse_space(nfc(or_empty(text), normalised)), 256)


def tokenize(text: Column, normalised: bool = False) -> Column:
    return F.regexp_extract_all(fold(text, normalised), F.lit(TOKEN), F.lit(0))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    folded = fold(text)
    out = F.lit(False)
    for t in terms:
        if fold_text(t):
            out = out | folded.contains(fold_text(t))
    return out


def term_pattern(term: str, kind: str = "word", pattern: str | None = None) -> str:
    """A Java pattern over folded text: `word`, `prefix`, `substring` (spaces may vary) or `regex`."""
    folded = fold_text(term)
    if kind == "regex":
        return "(?iU)" + (pattern or quote(folded))
    if kind == "prefix":
        return rf"(?U)\b{quote(folded)}\w*"
    if kind == "substring":
        return "(?U)" + r"\s+".join(quote(p) for p in folded.split())
    return rf"(?U)\b{quote(folded)}\b"


def quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text, flags=re.A) if text.isascii() else re.escape(text)


class _Folds(dict):
    """What a character folds to, by its code point; each is worked out once."""

    def __missing__(self, point: int) -> str:
        self[point] = fold_text(chr(point))
        return self[point]


_FOLDS = _Folds()


def fold_with_origin(text: str) -> tuple[str, Sequence[int]]:
    """The folded text, and for each of its characters the place in the composed text that it comes from."""
    folded = text.translate(_FOLDS)
    sizes = {c: len(_FOLDS[ord(c)]) for c in set(text)}
    other = "".join(c for c, n in sizes.items() if n != 1)
    if not other:
        return folded, range(len(text))
    each = np.ones(len(text), np.int64)
    for m in re.finditer(f"[{re.escape(other)}]", text):
        each[m.start()] = sizes[m[0]]
    return folded, np.repeat(np.arange(len(text)), each)


def spelling_pattern(term: str) -> str:
    """A pattern, for Java and Python, of every spelling that folds to what the term folds to."""
    singles: dict[str, str] = {}
    for raw, plain in FOLDED_ONE_TO_ONE.items():
        singles[plain] = singles.get(plain, plain) + raw
    pairs: dict[str, str] = {}
    for raw, plain in FOLDED_TO_TWO.items():
        pairs[plain] = pairs.get(plain, "") + raw
    folded = fold_text(term)
    letter = lambda c: f"[{singles[c]}]" if c in singles else quote(c)
    out, at = [], 0
    while at < len(folded):
        two = folded[at : at + 2]
        # Overlapping pairs as in `aae`: the letters of a pair may also belong to its neighbours, so the rest is tried both ways.
        if two in pairs:
            out.append(f"(?:{letter(two[0])}{letter(two[1])}|[{pairs[two]}])" if folded[at + 1 : at + 3] not in pairs else f"(?:{letter(two[0])}{letter(two[1])}{letter(folded[at + 2])}|[{pairs[two]}]{letter(folded[at + 2])}|{letter(two[0])}[{pairs[folded[at + 1 : at + 3]]}])")
            at += 2 if folded[at + 1 : at + 3] not in pairs else 3
        else:
            out.append(letter(folded[at]))
            at += 1
    return "".join(out)


def first_hit(text: Column, terms: Sequence[str]) -> Column:
    """The place (from 0) in the composed text with single spaces where the first folded term begins; -1 without one."""
    wanted = [t for t in (fold_text(t).strip() for t in terms) if t]

    @F.pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str) -> int:
            folded, origin = fold_with_origin(t)
            places = [p for p in (folded.find(w) for w in wanted) if p >= 0]
            return int(origin[min(places)]) if places else -1

        for s in parts:
            yield s.map(one)

    return run(text) if wanted else F.lit(-1)


def snippet(text: Column, terms: Sequence[str], length: int = 320) -> Column:
    """A window of at most `length` characters around the first folded hit, cut at word ends, with ellipses where text is left out.

    Without a hit it is the beginning of the text.
    """
    plain = collapse_space(nfc(or_empty(text)))
    return F.transform(
        F.array(F.struct(plain.alias("t"), first_hit(plain, terms).alias("hit"))),
        lambda x: F.when(x["hit"] < 0, F.concat(F.substr(x["t"], F.lit(1), F.lit(length)), F.when(F.length(x["t"]) > length, "…").otherwise(""))).otherwise(_window(x["t"], F.length(x["t"]), x["hit"], length)),
    )[0]


def _window(t: Column, n: Column, hit: Column, length: int) -> Column:
    """Half of the length before the hit, moved to word ends that do not pass the hit."""
    start = F.greatest(F.lit(0), hit - length // 2)
    space = F.call_function("locate", F.lit(" "), t, start + 1)
    start = F.when((start > 0) & (space > 0) & (space - 1 < hit), space).otherwise(start)
    end = F.least(n, F.greatest(F.lit(0), hit - length // 2) + length)
    cut = F.substr(t, start + 1, end - start)
    back = F.length(F.regexp_extract(cut, r"(\s\S*)$", 1))
    shorter = F.when((end < n) & (back > 0) & (end - back > hit), F.substr(cut, F.lit(1), F.length(cut) - back)).otherwise(cut)
    return F.concat(F.when(start > 0, "…").otherwise(""), F.trim(shorter), F.when(end < n, "…").otherwise(""))


# Signs that count as a space, and signs without width.
SPACE_LIKE, ZERO_WIDTH = "[\u00a0\u2007\u202f\t]", "[\u200b\u200c\u200d\ufeff]"


def canonical(text: Column, normalised: bool = False) -> Column:
    """The form over which a rule's source text is hashed: composed (not by compatibility), spaces and line ends plain, one empty line at most."""
    out = F.regexp_replace(nfc(or_empty(text), normalised), r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, SPACE_LIKE, " "), ZERO_WIDTH, "")
    lines = F.transform(F.split(out, "\n"), collapse_space)
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def quoted_in(quote_: Column, content: Column, least: int = 40, normalised: bool = False) -> Column:
    """Why a quotation isn't proven: `too_short`, `not_found`, else null. White space of any kind counts as one space."""
    needle, hay = (collapse_space(canonical(c, normalised)) for c in (quote_, content))
    return F.when(F.length(needle) < least, "too_short").when(~F.contains(hay, needle), "not_found")


def metadata_text(metadata: Column, *fields: Column) -> Column:
    """All that describes a document, as one text: fields, then values and keys of its map; nulls and empty ones left out."""
    parts = F.concat(F.array(*[f.cast("string") for f in fields]).cast("array<string>"), F.coalesce(F.map_values(metadata), F.array().cast("array<string>")), F.coalesce(F.map_keys(metadata), F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (F.trim(x) != "")), " ")


def seconds_between(started: Column, finished: Column) -> Column:
    """Duration of a run; null while it runs."""
    return (F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1e6


def paragraph_key(number: Column, letter: Column) -> Column:
    """Sorts paragraphs: `0012a`; a number that isn't digits goes last as `9999` and its text."""
    digits = F.trim(or_empty(number))
    return F.when(digits.rlike("^[0-9]+$"), F.concat(F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")), F.lower(F.trim(or_empty(letter))))).otherwise(F.concat(F.lit("9999"), F.lower(digits)))


# Accepted forms of a date.
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyyMMdd", "yyyy/MM/dd", "d. M. yyyy")
# Danish month names.
MONTHS = ("januar", "februar", "marts", "april", "maj", "juni", "juli", "august", "september", "oktober", "november", "december")


def parse_date(raw: Column) -> Column:
    """Dates in seven formats, ISO with a zone, and written Danish dates; null where none fits."""
    t = F.trim(or_empty(raw))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(t, r"(?U)^\s*\d{1,2}\.?\s+(\p{L}+)\s+\d{4}", 1)))
    written = F.when(month > 0, F.concat_ws("-", F.regexp_extract(t, r"(\d{4})", 1), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, r"^\s*(\d{1,2})", 1), 2, "0")))
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})T", 1)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in DATE_FORMATS], F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(written, F.lit("yyyy-MM-dd"))))


def number_of(text: Column) -> Column:
    """A Danish number: `1.500` is 1500, `15,5` is 15.5; null without digits."""
    return F.replace(F.replace(F.nullif(F.regexp_extract(or_empty(text), r"([0-9][0-9.]*(?:,[0-9]+)?)", 1), F.lit("")), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def section_key(section: Column) -> Column:
    """`§ 3 a, stk. 2` as (number, letter, subsection); none goes last."""
    found = lambda g: F.regexp_extract(or_empty(section), r"(?i)§\s*(\d+)\s*([a-z]?)\b(?:.*?stk\.\s*(\d+))?", g)
    number = found(1).try_cast("int")
    return F.struct(F.coalesce(number, F.lit(1 << 30)).alias("number"), found(2).alias("letter"), F.coalesce(found(3).try_cast("int"), F.lit(0)).alias("subsection"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def saturate(raw: Column, at: float) -> Column:
    return F.when(raw > 0, raw / (raw + at)).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(100.0 * part / whole, 1)).otherwise(F.lit(0.0))


def language_score(text: Column, ours: Sequence[str], theirs: Sequence[str], min_words: int = 12, normalised: bool = False) -> Column:
    """(ours - theirs) / (ours + theirs) by function words; 0 for short texts."""
    tokens = tokenize(text, normalised)
    count = lambda words: F.size(F.filter(tokens, lambda x: x.isin(*words)))
    a, b = count(ours), count(theirs)
    return F.when((F.size(tokens) >= min_words) & (a + b > 0), (a - b) / (a + b)).otherwise(F.lit(0.0))
