"""Configurations and curated registries in YAML. They are small and bounded, and are checked before anything runs."""

from __future__ import annotations

import datetime
import re
from collections.abc import Mapping
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from lexforge.operators.geography import Area
from lexforge.operators.terms import Category, Relevance, Term

MATCHES = ("word", "prefix", "substring", "regex")


def _load(path: str | Path) -> dict:
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no mapping")
    return data


def terms(rows: list[Mapping]) -> list[Term]:
    out = [Term(str(r["term"]), float(r.get("weight", 1.0)), r.get("match", "word"), r.get("pattern"), r.get("concept")) for r in rows or []]
    for t in out:
        if t.match not in MATCHES or t.match == "regex" and not t.pattern:
            raise ValueError(f"{t.term!r}: a term matches as {', '.join(MATCHES)}, a regex by its pattern")
    return out


def relevance(path: str | Path) -> Relevance:
    """Terms, negative terms, weights and thresholds of the relevance score; what a file leaves out has its default."""
    data = _load(path)
    scoring, thresholds, base = data.get("scoring") or {}, data.get("thresholds") or {}, Relevance(())
    given = lambda name, default: scoring.get(name, default)
    return Relevance(
        terms(data.get("terms")),
        terms(data.get("negative_terms")),
        given("field_weights", base.field_weights),
        given("max_occurrences_per_term_per_field", base.max_occurrences),
        given("bonus_per_extra_concept", base.bonus_per_concept),
        given("max_concept_bonus", base.max_bonus),
        given("saturation", base.saturation),
        given("decisive_title_min_weight", base.decisive_weight),
        given("decisive_title_floor_score", base.floor),
        next((v for k, v in thresholds.items() if k != "possible"), base.relevant_at),
        thresholds.get("possible", base.possible_at),
    )


def categories(path: str | Path) -> tuple[list[Category], dict]:
    """(categories, arguments of categorize): each slug once."""
    data = _load(path)
    found = [Category(str(c["slug"]), terms(c.get("terms"))) for c in data.get("categories") or []]
    if len({c.slug for c in found}) < len(found):
        raise ValueError("a category stands twice")
    scoring = data.get("scoring") or {}
    names = {"field_weights": "field_weights", "max_occurrences_per_term_per_field": "most", "saturation": "saturation", "min_confidence": "least", "max_categories_per_document": "top"}
    return found, {"fallback": data.get("fallback_category", "other")} | {names[k]: v for k, v in scoring.items() if k in names}


def areas(path: str | Path) -> list[Area]:
    """The gazetteer's areas, each slug once and with an alias."""
    rows = _load(path).get("areas") or []
    found = [Area(r["slug"], [str(a) for a in r.get("aliases") or []], bool(r.get("mention_only", False)), float(r.get("weight", 1.0))) for r in rows]
    if len({a.slug for a in found}) < len(found) or not all(0 < a.weight <= 1 for a in found):
        raise ValueError("areas need different slugs and weights above 0 up to 1")
    return found


# Kinds of instruments, and what an unverified one may not claim.
INSTRUMENTS = ("convention_family", "liability_family", "code_family")
CLAIMS = ("original_title", "canonical_url", "adopted_date", "published_date", "effective_date", "legal_status", "reviewed_at", "reviewer")
RECORD = frozenset((*CLAIMS, "external_id", "title", "instrument_type", "language", "review_state", "evidence_links", "verification_evidence"))
FILE = frozenset(("provider_key", "source_url", "terms_url", "review_state", "review_note", "records"))
MOST_RECORDS = 100


def _moment(value) -> datetime.datetime | None:
    try:
        found = datetime.datetime.fromisoformat(str(value))
    except ValueError:
        return None
    return found if found.tzinfo else None


def record_problem(record: Mapping, host: str) -> str | None:
    """Why a record of a registry is refused: unknown keys, a bad id, claims without proof, links to other hosts."""
    if set(record) - RECORD or not re.fullmatch("[A-Z][A-Z0-9-]{0,63}", str(record.get("external_id"))) or not record.get("title") or record.get("instrument_type") not in INSTRUMENTS:
        return "malformed"
    links, proofs = list(record.get("evidence_links") or []), list(record.get("verification_evidence") or [])
    if any(not re.match(rf"https://{re.escape(host)}/", str(u)) for u in [*links, *(p.get("url") for p in proofs), *filter(None, [record.get("canonical_url")])]):
        return "foreign_link"
    if record.get("review_state", "unverified") != "verified":
        return "claims_without_review" if any(record.get(c) for c in CLAIMS) else None
    reviewed = _moment(record.get("reviewed_at"))
    if not (record.get("original_title") and record.get("canonical_url") and reviewed and record.get("reviewer") and links and proofs):
        return "review_incomplete"
    if reviewed > datetime.datetime.now(datetime.timezone.utc):
        return "review_in_future"
    plain = lambda t: " ".join(str(t).casefold().split())
    if not any(plain(p.get("matched_title")) == plain(record["original_title"]) for p in proofs):
        return "title_unproven"
    if record["canonical_url"] not in links or any(p.get("url") not in links for p in proofs):
        return "uncited"
    seen = [_moment(p.get("observed_at")) for p in proofs]
    return None if all(s and s <= reviewed for s in seen) else "observed_after_review"


def registry(spark: SparkSession, path: str | Path, host: str) -> DataFrame:
    """(external_id, title, instrument_type, original_title, canonical_url, review_state, reviewed_at, reviewer) of a curated registry, refused whole if a record is faulty."""
    data = _load(path)
    rows = data.get("records")
    if set(data) - FILE or not isinstance(rows, list) or not 0 < len(rows) <= MOST_RECORDS or not all(isinstance(r, dict) for r in rows):
        raise ValueError(f"a registry has one to {MOST_RECORDS} records and no other keys")
    rows = [{"review_state": data.get("review_state", "unverified")} | r for r in rows]
    faults = [f"{r.get('external_id')}: {p}" for r in rows if (p := record_problem(r, host))]
    ids = [r["external_id"] for r in rows if "external_id" in r]
    if faults or len(set(ids)) < len(ids):
        raise ValueError("; ".join(faults) or "an instrument stands twice")
    names = ("external_id", "title", "instrument_type", "original_title", "canonical_url", "review_state", "reviewed_at", "reviewer")
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))
