"""Relevance from kept counts against relevance counted anew."""

from dataclasses import replace

from lexforge.operators.score_store import ScoreStore
from lexforge.operators.terms import Relevance, Term, score_relevance

COLUMNS = ["id", "raw", "score", "classification", "matched_terms", "concepts", "title_floor"]
TEXTS = ["Skibe og havne", "Om fly og skibsfart, skib skib skib skib", "", None, "Havnen ved lov om havne", "skib", "Sejlads"]


def told(df):
    return sorted(tuple(repr(r[c]) for c in COLUMNS) for r in df.select(*COLUMNS).collect())


def test_only_what_changed_is_counted(spark, tmp_path):
    docs = spark.createDataFrame([(i * 10 + j, t, c) for i, t in enumerate(TEXTS) for j, c in enumerate(TEXTS)], "id int, title string, content string")
    config = Relevance([Term("skib", 9.0, "prefix", concept="ship"), Term("havn", 4.0, "prefix", concept="port"), Term("lov om", 2.0, "substring", concept="law")], [Term("fly", 3.0)])
    store = ScoreStore(spark, f"file://{tmp_path}", ["title", "content"], buckets=2)
    same = lambda d, c: told(store.scores(d, c)) == told(score_relevance(d, c))
    assert store.update(docs, config) == {"texts": 36, "terms": 8}  # null and empty texts are one
    assert same(docs, config)
    held = store.store.snapshot()
    # Weights, caps and thresholds need no count.
    other = replace(config, terms=[replace(t, weight=t.weight + 1) for t in config.terms], max_occurrences=2, saturation=20.0, floor=50)
    assert store.update(docs, other) == {"texts": 0, "terms": 0} and store.store.snapshot() == held
    assert same(docs, other)
    # One changed document is one text; one new term is one term a field; a term that goes needs nothing.
    changed = docs.selectExpr("id", "CASE WHEN id = 3 THEN 'Nyt skib' ELSE title END AS title", "content")
    assert store.update(changed, config) == {"texts": 1, "terms": 0} and same(changed, config)
    more = replace(config, terms=[*config.terms[1:], Term("sejlads", 8.0, concept="sailing")])
    before = store.store.read("counts").count()
    assert store.update(changed, more) == {"texts": 0, "terms": 2} and same(changed, more)
    added = store.store.read("counts").where("term LIKE '%sejlads%'").count()
    assert store.store.read("counts").count() == before + added and added
    # A term that comes back is counted again, and counts once.
    assert store.update(changed, config)["terms"] == 2 and same(changed, config)
