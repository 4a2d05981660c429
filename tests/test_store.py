"""The commit log, the queue and the documents that live in it."""

import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexforge.operators import committed as C
from lexforge.sources.store import Conflict, Snapshot, Store, Table

NOW = datetime(2024, 5, 1, 12)


def queue(spark, path, n=40, buckets=4):
    store = C.queue_store(spark, f"file://{path}", buckets)
    C.enqueue(store, spark.range(n).select(F.format_string("i%03d", "id").alias("id"), (F.col("id") % 3).cast("int").alias("priority")))
    return store


def ids(df):
    return sorted(r.id for r in df.collect())


def test_snapshots_and_upserts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", {"t": Table("k int, v string", ("k",))}, buckets=4)
    rows = lambda at=None: {r.k: r.v for r in store.read("t", at).collect()}
    assert store.snapshot() == Snapshot() and rows() == {}
    for i in range(12):
        store.upsert("t", spark.createDataFrame([(i, f"a{i}"), (i + 1, f"b{i}")], "k int, v string"), {"i": i})
    now = store.snapshot()
    assert now.version == 12 and rows() == {k: f"a{k}" for k in range(12)} | {12: "b11"}
    assert rows(store.snapshot(3)) == {0: "a0", 1: "a1", 2: "a2", 3: "b2"}
    assert [i["i"] for i in store.infos()] == list(range(12))
    # Opened anew, it reads the log from its last whole file on.
    again = Store(spark, f"file://{tmp_path}", store.tables, buckets=99)
    assert again.buckets == 4 and again.snapshot().files == now.files
    store.upsert("t", spark.createDataFrame([], "k int, v string"))
    assert store.snapshot().version == 12
    left = store.vacuum(keep=1)
    assert left and rows() == {k: f"a{k}" for k in range(12)} | {12: "b11"} and store.vacuum(keep=1) == []
    with pytest.raises(ValueError, match="no version 99"):
        store.snapshot(99)


def test_second_of_two_writers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", {"t": Table("k int, v string", ("k",))}, buckets=8)
    store.upsert("t", spark.range(64).selectExpr("int(id) AS k", "'old' AS v"))
    of = {r.k: r.b for r in store.read("t").select("k", store.bucket("t").alias("b")).collect()}
    one, other = next(k for k in of if of[k] == 0), next(k for k in of if of[k] == 1)
    at = store.snapshot()
    row = lambda k, v: spark.createDataFrame([(k, v)], "k int, v string")
    mine = store._written("t", at, row(one, "mine"), True)
    store.upsert("t", row(other, "theirs"))
    # Another bucket was changed meanwhile: this commit goes in behind it, unless it was decided on that bucket too.
    with pytest.raises(Conflict):
        store.commit(at, mine, {"t": None})
    assert store.commit(at, mine, {"t": [0]}) == 3
    with pytest.raises(Conflict):
        store.commit(at, mine, {})
    got = {r.k: r.v for r in store.read("t").collect()}
    assert got[one] == "mine" and got[other] == "theirs" and len(got) == 64


def test_two_workers_race_for_the_same_items(spark, tmp_path):
    queue(spark, tmp_path, n=20)
    tokens, errors = {}, []
    barrier = threading.Barrier(2)

    def work(worker):
        try:
            store = C.queue_store(spark, f"file://{tmp_path}")
            for i in range(2):
                barrier.wait()
                tokens[worker, i] = C.claim(store, worker, NOW, size=5)
        except Exception as e:  # shown below
            errors.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in ("w1", "w2")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    store = C.queue_store(spark, f"file://{tmp_path}")
    held = [ids(C.claimed(store, t)) for t in tokens.values()]
    assert [len(h) for h in held] == [5] * 4 and len({i for h in held for i in h}) == 20
    rows = store.read("queue").collect()
    assert {(r.status, r.attempt_count) for r in rows} == {("PROCESSING", 1)} and {r.worker for r in rows} == {"w1", "w2"}


def test_order_leases_and_late_tokens(spark, tmp_path):
    store = queue(spark, tmp_path, n=6)
    first = C.claim(store, "w1", NOW, size=3, lease_minutes=10)
    assert ids(C.claimed(store, first)) == ["i000", "i001", "i003"]
    results = lambda *r: spark.createDataFrame(r, "id string, ok boolean, retryable boolean, problem string")
    # The lease runs out; another worker takes the same items, and the first one's results come too late.
    later = NOW + timedelta(minutes=11)
    second = C.claim(store, "w2", later, size=2)
    assert ids(C.claimed(store, second)) == ["i000", "i003"]
    got = {r.id: r.refused for r in C.finish(store, first, results(("i000", True, None, None), ("i001", True, None, None)), later).collect()}
    assert got == {"i000": True, "i001": False}
    got = {r.id: r.refused for r in C.finish(store, second, results(("i000", False, True, "down"), ("i003", False, False, "gone")), later).collect()}
    assert got == {"i000": False, "i003": False}
    rows = {r.id: r for r in store.read("queue").collect()}
    assert (rows["i000"].status, rows["i000"].next_attempt_at, rows["i000"].problem) == ("RETRY", later + timedelta(minutes=15), "down")
    assert rows["i001"].status == "DONE" and rows["i003"].status == "FAILED" and rows["i002"].status == "PENDING"
    C.enqueue(store, spark.createDataFrame([("i000", 0), ("new", 0)], "id string, priority int"))
    assert store.read("queue").count() == 7 and store.read("queue").where("id = 'i000'").first().status == "RETRY"
    with pytest.raises(ValueError, match="one minute"):
        C.claim(store, "w", NOW, lease_minutes=0)


def test_documents_and_versions_in_one_commit(spark, tmp_path):
    store = C.document_store(spark, f"file://{tmp_path}", buckets=4)

    def docs(*rows):
        return spark.createDataFrame([("s", i, "t", status, c, f"h{c}", m) for i, c, status, m in rows], "source string, source_id string, title string, status string, content string, content_hash string, metadata_hash string")

    C.store_documents(store, docs(("a", "1", "ok", "m"), ("b", "1", "ok", "m"), ("c", "1", "ok", "m")), "run1")
    first = store.snapshot()
    C.store_documents(store, docs(("a", "2", "ok", "m"), ("b", "1", "old", "m"), ("c", "1", "ok", "m")), "run2")
    C.store_documents(store, docs(("a", "9", "ok", "m")), "run2")  # the same run again, as after a lost driver
    now = {r.source_id: (r.current_version, r.status, r.run) for r in store.read("documents").collect()}
    assert now == {"a": (2, "ok", "run2"), "b": (1, "old", "run2"), "c": (1, "ok", "run1")}
    assert sorted((r.source_id, r.version_number, r.content) for r in store.read("versions").collect()) == [("a", 1, "1"), ("a", 2, "2"), ("b", 1, "1"), ("c", 1, "1")]
    assert {r.source_id: r.current_version for r in store.read("documents", first).collect()} == {"a": 1, "b": 1, "c": 1}
    # Two runs of the same documents at once: one commits, the other decides again and numbers on.
    threads = [threading.Thread(target=C.store_documents, args=(C.document_store(spark, f"file://{tmp_path}"), docs(("a", v, "ok", "m")), f"run{v}")) for v in ("5", "6")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    versions = store.read("versions").where("source_id = 'a'").orderBy("version_number").collect()
    assert [r.version_number for r in versions] == [1, 2, 3, 4] and {r.content for r in versions[2:]} == {"5", "6"}
    assert store.read("documents").where("source_id = 'a'").first().current_version == 4
