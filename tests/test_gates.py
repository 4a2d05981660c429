from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.operators import applicability as A
from lexforge.operators import ingest as I

RULE = {"rule_id": "r", "inclusion": {"field": "gt", "operator": "gte", "value": 500}, "exclusion": {"field": "kind", "operator": "eq", "value": "yacht"}, "jurisdictions": ["DK"], "valid_from": "2020-01-01"}
KINDS = {"gt": "number", "kind": "text"}


def test_gates(spark):
    rows = [(1, "DK", ["NO"], 600.0, "tanker"), (2, "SE", ["NO"], 600.0, "tanker"), (3, "SE", ["DK"], 495.0, "tanker"), (4, "DK", None, None, "tanker"), (5, "DK", None, 600.0, "yacht"), (6, None, None, 600.0, "ferry")]
    ships = spark.createDataFrame(rows, "id int, flag string, ports array<string>, gt double, kind string")
    got = {r.id: (r.verdict, r.confidence, r.reasons) for r in A.decide(ships, RULE, KINDS, "id", "2024-01-01", ports="ports", near=[("gt", 500.0)]).collect()}
    assert got == {
        1: ("applies", 100, []),
        2: ("other_jurisdiction", 100, []),
        3: ("does_not_apply", 85, ["near bound: gt"]),
        4: ("unclear", 85, ["unknown: gt"]),
        5: ("excluded", 100, []),
        6: ("unclear", 85, ["unknown: jurisdiction"]),
    }
    early = {r.verdict for r in A.decide(ships, RULE, KINDS, "id", "2019-12-31", ports="ports").collect()}
    assert early == {"not_in_force"}
    assert {r.verdict for r in A.decide(ships, RULE | {"state": "draft"}, KINDS, "id", "2024-01-01").collect()} == {"not_reviewed"}


def test_ranks(spark):
    ships = spark.createDataFrame([(1, "DK", 600.0, "tanker")], "id int, flag string, gt double, kind string")
    rules = [RULE, RULE | {"rule_id": "a", "discretion": True}, RULE | {"rule_id": "z", "jurisdictions": ["SE"]}]
    every = reduce(DataFrame.unionByName, [A.decide(ships, r, KINDS, "id", "2024-01-01") for r in rules])
    assert [(r.rule_id, r.rank) for r in A.ranked(every, "id").orderBy("rank").collect()] == [("r", 1), ("a", 2), ("z", 3)]


def test_store_and_links(spark):
    scored = spark.createDataFrame([(1, 29), (2, 30), (3, 5)], "id int, score int")
    decided = spark.createDataFrame([(3, "exclude")], "id int, decision string")
    assert {(r.id, r.decision) for r in I.storable(scored, decided, "id", "score").collect()} == {(2, None), (3, "exclude")}
    old = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.6), (1, "c", 0.7)], "id int, slug string, confidence double")
    new = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9), (1, "d", 0.7)], "id int, slug string, confidence double")
    assert {(r.slug, r.action) for r in I.reconcile_links(old, new, ["id", "slug"], "confidence").collect()} == {("a", "keep"), ("b", "update"), ("c", "remove"), ("d", "add")}


def test_queue(spark):
    queue = spark.createDataFrame([("a", "DONE", 1), ("b", "FAILED", 5), ("c", "PENDING", 0)], "id string, status string, attempt_count int")
    wanted = spark.createDataFrame([("a",), ("b",), ("d",), ("d",)], "id string")
    assert {tuple(r) for r in I.enqueue(queue, wanted, "id", ["FAILED"]).select("id", "status", "attempt_count").collect()} == {("a", "DONE", 1), ("b", "PENDING", 0), ("c", "PENDING", 0), ("d", "PENDING", 0)}
    claimed = spark.createDataFrame([("a", "PROCESSING", 0, "t"), ("b", "PROCESSING", 1, "t"), ("c", "PROCESSING", 4, "t"), ("d", "PROCESSING", 0, "u")], "id string, status string, attempt_count int, claim_token string")
    results = spark.createDataFrame([("a", "t", True), ("b", "t", False), ("c", "t", False), ("d", "t", True)], "id string, claim_token string, ok boolean")
    got = {r.id: r for r in I.finished(claimed, results, "id", F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "DONE", "b": "RETRY", "c": "FAILED", "d": "PROCESSING"}
    assert str(got["b"].next_attempt_at) == "2024-01-01 00:15:00" and got["d"].claim_token == "u"


def test_supporting_fragments(spark):
    rows = [(1, 1, "Skibe", "om havne", [1.0, 0.0]), (1, 2, None, "SKIBE i søen", [0.0, 1.0]), (1, 3, "x", "y", None), (2, 4, "Havne", "skib", [1.0, 1.0]), (2, 5, "z", "lov", [1.0])]
    chunks = spark.createDataFrame(rows, "document_id int, chunk_id int, heading string, content string, embedding array<double>")
    told = lambda **a: [(r.document_id, r.chunk_id, round(r.score, 4), r.method, r.n) for r in A.supporting_fragments(chunks, **a).orderBy("document_id", "n").collect()]
    assert told(query_vector=[1.0, 0.0], most=1) == [(1, 1, 1.0, "vector", 1), (2, 4, 0.7071, "vector", 1)]
    lexical = [(1, 1, 0.6667, "lexical", 1), (1, 2, 0.6667, "lexical", 2), (2, 4, 0.6667, "lexical", 1)]
    assert told(query_text="Skib havn soe i") == lexical == told(query_vector=[1.0] * 9, query_text="skib havn soe")
    assert told(query_text="af i") == told() == []
