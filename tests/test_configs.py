import pytest
import yaml

from lexforge.operators import terms as T
from lexforge.sources import configs as C


def write(path, data):
    path.write_text(yaml.safe_dump(data, allow_unicode=True), encoding="utf-8")
    return path


def test_terms_and_categories(spark, tmp_path):
    path = write(tmp_path / "r.yaml", {"version": 1, "scoring": {"saturation": 20.0, "field_weights": {"title": 2.0}}, "thresholds": {"maritime": 50, "possible": 20}, "terms": [{"term": "skib", "weight": 9, "match": "prefix", "concept": "s"}], "negative_terms": [{"term": "fly"}]})
    got = C.relevance(path)
    assert (got.saturation, got.relevant_at, got.possible_at, got.max_occurrences, got.negative[0].match) == (20.0, 50, 20, 3, "word")
    docs = spark.createDataFrame([("Skibe",)], "title string")
    assert T.score_relevance(docs, got).first().raw == 18.0
    found, more = C.categories(write(tmp_path / "c.yaml", {"fallback_category": "none", "scoring": {"min_confidence": 0.4}, "categories": [{"slug": "a", "terms": [{"term": "skibe", "weight": 3.0}]}]}))
    assert [c.slug for c in T.categorize(docs, found, **more).first().categories] == ["a"]
    for bad in ({"terms": [{"term": "x", "match": "odd"}]}, {"terms": [{"term": "x", "match": "regex"}]}, []):
        with pytest.raises(ValueError):
            C.relevance(write(tmp_path / "bad.yaml", bad))
    with pytest.raises(ValueError):
        C.categories(write(tmp_path / "bad.yaml", {"categories": [{"slug": "a"}, {"slug": "a"}]}))


def test_areas(tmp_path):
    got = C.areas(write(tmp_path / "a.yaml", {"areas": [{"slug": "x", "aliases": ["X", "Y"], "mention_only": True}, {"slug": "z", "aliases": ["Z"], "weight": 0.5}]}))
    assert [(a.slug, a.aliases, a.mention_only, a.weight) for a in got] == [("x", ["X", "Y"], True, 1.0), ("z", ["Z"], False, 0.5)]
    with pytest.raises(ValueError):
        C.areas(write(tmp_path / "a.yaml", {"areas": [{"slug": "x", "weight": 2}]}))


def test_registries(spark, tmp_path):
    url = "https://host.org/a"
    good = {"external_id": "ABC", "title": "A", "instrument_type": "code_family", "review_state": "verified", "original_title": "The A", "canonical_url": url, "reviewed_at": "2024-01-02T00:00:00+00:00", "reviewer": "r", "evidence_links": [url], "verification_evidence": [{"url": url, "observed_at": "2024-01-01T00:00:00+00:00", "matched_title": "the  a"}]}
    plain = {"external_id": "D-1", "title": "D", "instrument_type": "code_family"}
    rows = C.registry(spark, write(tmp_path / "r.yaml", {"records": [good, plain]}), "host.org").collect()
    assert [(r.external_id, r.review_state, r.original_title) for r in rows] == [("ABC", "verified", "The A"), ("D-1", "unverified", None)]
    bad = {
        "malformed": plain | {"extra": 1}, "foreign_link": good | {"canonical_url": "https://else.org/a"}, "claims_without_review": plain | {"reviewer": "x"}, "review_incomplete": good | {"reviewer": None},
        "review_in_future": good | {"reviewed_at": "2999-01-01T00:00:00+00:00"}, "title_unproven": good | {"original_title": "B"}, "uncited": good | {"canonical_url": "https://host.org/b"}, "observed_after_review": good | {"reviewed_at": "2023-01-01T00:00:00+00:00"},
    }
    assert {k: C.record_problem(r, "host.org") for k, r in bad.items()} == {k: k for k in bad}
    for records in ([], [plain, plain], [bad["malformed"]]):
        with pytest.raises(ValueError):
            C.registry(spark, write(tmp_path / "r.yaml", {"records": records}), "host.org")
