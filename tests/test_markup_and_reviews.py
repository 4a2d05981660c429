from pyspark.sql import functions as F

from lexforge.operators import reviews as V
from lexforge.sources import markup as M

XML = '<d xmlns="urn:x" id="A1"><Meta><Title>Lov om <i>skibe</i></Title></Meta><Body><P>§ 1. Et <b>fed</b> ord</P><P>To</P>hale</Body></d>'


def test_xml(spark):
    rows = spark.createDataFrame([(1, XML), (2, "<d><p>brudt<p>to"), (3, None)], "id int, x string")
    got = {r.id: r for r in M.read_xml(rows, "x", {"key": ["accession", "id"], "title": ["title"]}).collect()}
    assert (got[1].key, got[1].title) == ("A1", "Lov om skibe")
    assert got[1].lines == ["Lov om skibe", "§ 1. Et fed ord", "To", "hale"]
    assert (got[2].title, got[2].lines) == (None, ["brudt", "to"]) and got[3].lines == []


def test_record_list(spark):
    payload = '{"total": 3, "facets": [{"n": 1}, {"n": 2}, {"n": 3}, {"n": 4}], "page": {"hits": [{"Accession-Number": "a"}, {"accessionnumber": "b"}, {"x": 1}]}}'
    assert [len(M.record_list(p, ["accession_number"])) for p in (payload, "{", None, "[]")] == [3, 0, 0, 0]
    rows = spark.createDataFrame([(1, payload)], "id int, x string")
    assert M.read_responses(rows, "x", ["accession_number"]).count() == 3


def test_reviews(spark):
    rows = [("r", 1, "draft", "ann"), ("r", 2, "in_review", "ann"), ("r", 3, "approved", "ann"), ("r", 4, "approved", "bo"), ("s", 1, "draft", "ann"), ("s", 2, "approved", "bo")]
    events = spark.createDataFrame(rows, "rule string, at int, status string, actor string")
    got = {r.rule: (r.status, r.reviewer, r.refused) for r in V.review_states(events, "rule", ["at"]).collect()}
    assert got == {"r": ("approved", "bo", 1), "s": ("draft", None, 1)}


def test_override_events(spark):
    events = spark.createDataFrame([("a", 1, "include"), ("a", 2, "include"), ("a", 3, "exclude"), ("a", 4, None), ("a", 5, None)], "id string, at int, d string")
    assert [r.kind for r in V.override_events(events, ["id"], ["at"], "d").orderBy("at").collect()] == ["created", "repeated", "changed", "cleared", "repeated"]


def test_claim_and_explanation(spark):
    now = F.lit("2024-01-01 10:00:00").cast("timestamp")
    queue = spark.sql("SELECT * FROM VALUES ('a','PENDING',1,null,null),('b','RETRY',5,timestamp'2024-01-01 09:00:00',null),('c','RETRY',9,timestamp'2024-01-02 09:00:00',null),('d','PROCESSING',0,null,timestamp'2024-01-01 09:00:00') AS t(id,status,priority,next_attempt_at,lease_expires_at)")
    assert [r.id for r in V.claim(queue, now, 2, "t", 30).orderBy("id").collect()] == ["a", "d"]
    verdicts = spark.createDataFrame([("unclear", 85, ["unknown: gt"])], "verdict string, confidence int, reasons array<string>")
    assert V.explained(verdicts).first().explanation == "The rule can't be decided on the facts given. Confidence 85.\n- unknown: gt"
