"""Titles of acts as readers see them, and the authority behind an act, as Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.text import collapse_space, fold, fold_text, let, or_empty

# Openings of titles that name a kind of act; the first that fits counts.
LEADING = (
    *("Bekendtgørelse af lov om", "Bekendtgørelse af lov", "Anordning om ikrafttræden af lov om", "Lovbekendtgørelse om", "Bekendtgørelse om", "Bekendtgørelse af"),
    *("Cirkulæreskrivelse om", "Cirkulære om", "Vejledning om", "Anordning om", "Skrivelse om", "Meddelelse om", "Lov om"),
)
# Endings that never carry the subject, and places where a long title may be cut.
TAILS = (r"(?i),?\s*jf\.\s.*$", r"(?i),?\s*med senere ændringer.*$", r"(?i),?\s*som ændret ved.*$")
SOFT = (" samt ", ", herunder ", ", og ", " og om ", " og for ", ", jf. ", ", ")
LONGEST, SHORTEST = 78, 24
EDGES = r"^[ ,;–-]+|[ ,;–-]+$"
END = r"[ ,;–-]+$"


def leading_type(title: Column) -> Column:
    """(kind, rest) of a title."""

    def split(t: Column) -> Column:
        kind = F.coalesce(*[F.when(F.lower(t).startswith(x.lower()), F.lit(x)) for x in LEADING])
        return let(kind, lambda k: F.struct(k.alias("kind"), F.when(k.isNull(), t).otherwise(F.trim(F.substr(t, F.length(k) + 1))).alias("rest")))

    return let(collapse_space(title), split)


def _capital(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def _last(t: Column, boundary: str, most: int, least: int) -> Column:
    """The last place, from 0 and at least `least`, where a boundary begins and ends within `most` characters; -1 without one."""
    head = F.lower(F.substring(t, 1, most))
    at = lambda h: F.length(h) - F.instr(F.reverse(h), boundary[::-1]) - len(boundary) + 1
    return let(head, lambda h: F.when(F.contains(h, F.lit(boundary)) & (at(h) >= least), at(h)).otherwise(-1))


def display_title(title: Column, short_title: Column | None = None, most: int = LONGEST, least: int = SHORTEST) -> Column:
    """A short title: tails, footnotes and popular names in brackets go, a consolidation is called by its law, and a long one is cut.

    It is cut at a soft boundary, else between words; the source's own short title stands in where a cut was needed.
    """
    own = collapse_space(short_title) if short_title is not None else F.lit("")
    return let(collapse_space(title), lambda whole: let(_subject(whole, least), lambda t: let(_cut(t, most, least), lambda cut: _chosen(whole, t, cut, own))))


def _subject(whole: Column, least: int) -> Column:
    """The title without tails, footnote and popular name; a consolidation under the name of its law."""
    t = whole
    for tail in TAILS:
        t = F.regexp_replace(t, tail, "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*\d+\)\s*$", ""), EDGES, "")

    def named(lead: Column) -> Column:
        kind, rest = F.lower(or_empty(lead["kind"])), lead["rest"]
        law = F.concat(F.when(kind.endswith("om"), "Lov om ").otherwise("Lov "), rest)
        return F.when(kind.startswith("bekendtgørelse af lov"), collapse_space(law)).when((kind == "bekendtgørelse af") & (rest != ""), _capital(rest)).otherwise(F.concat_ws(" ", lead["kind"], rest))

    bare = lambda x: F.trim(F.regexp_replace(x, r"\s*\([^()]*\)\s*$", ""))
    return let(let(leading_type(t), named), lambda x: F.when((F.length(x) > least) & (F.length(bare(x)) >= least), bare(x)).otherwise(x))


def _cut(t: Column, most: int, least: int) -> Column:
    at, space = F.greatest(*[_last(t, b, most, least) for b in SOFT]), _last(t, " ", most, least)
    clean = lambda n: F.regexp_replace(F.substr(t, F.lit(1), n), END, "")
    return F.when(F.length(t) <= most, t).otherwise(let(F.struct(at.alias("at"), space.alias("space")), lambda x: F.when(x["at"] >= least, clean(x["at"])).when(x["space"] >= least, F.concat(clean(x["space"]), F.lit("…"))).otherwise(t)))


def _chosen(whole: Column, t: Column, cut: Column, own: Column) -> Column:
    out = F.when((cut != t) & (own != "") & (F.length(own) < F.length(cut)), _capital(own)).otherwise(cut)
    return F.when(out == "", whole).otherwise(out)


def authority(given: Column, title: Column, text: Column, hints: Sequence[tuple[str, str]] | Mapping[str, str], reach: int = 4000) -> Column:
    """The authority that a source gives, else the first of the hints (word, authority) in the title and the beginning of the text."""
    pairs = list(hints.items()) if isinstance(hints, Mapping) else list(hints)
    where = fold(F.concat_ws(" ", or_empty(title), F.substring(or_empty(text), 1, reach)))
    plain = F.nullif(collapse_space(given), F.lit(""))
    return F.coalesce(plain, *[F.when(F.contains(where, F.lit(fold_text(word))), F.lit(name)) for word, name in pairs])


def reason(classification: Column, score: Column, matched: Column, concepts: Column, title_floor: Column, most: int = 4) -> Column:
    """Why a document got its relevance, in a sentence: its class and score, the strongest terms, concepts, and a lift by its title."""
    terms = F.array_join(F.slice(matched, 1, most), ", ")
    more = F.size(matched) - most
    return F.concat(
        F.initcap(F.replace(classification, F.lit("_"), F.lit(" "))),
        F.lit(" ("), score.cast("string"), F.lit(")"),
        F.when(F.size(matched) > 0, F.concat(F.lit(": "), terms, F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))).otherwise(F.lit(": no terms")),
        F.when(F.size(concepts) > 1, F.concat(F.lit("; "), F.size(concepts).cast("string"), F.lit(" concepts"))).otherwise(""),
        F.when(title_floor, F.lit("; lifted by its title")).otherwise(""),
    )
