"""Data sources over recorded responses, the import with failures aside, and states that end."""

import json

import pytest
from pyspark.sql import functions as F

from lexforge import streaming as X
from lexforge.operators import committed as C
from lexforge.operators import discovery as D
from lexforge.operators import terms as T
from lexforge.sources import feeds
from lexforge.streaming import importing as I


def record(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(value))


def hits(*ids, total=None, key="accessionsnummer"):
    return {"totalCount": total, "results": [{key: i, "title": f"t{i}"} for i in ids]}


def test_paged_searches_stop_by_the_sources_rules(spark, tmp_path):
    feeds.register(spark)
    pages = {
        "empty": [hits("a", "b"), hits(), hits("c", "d")],
        "short": [hits("a", "b"), hits("c"), hits("d", "e")],
        "total": [hits("a", "b", total=4), hits("b", "c", total=4), hits("d", "e", total=4), hits("f", "g")],
        "same": [hits("a", "b"), hits("a", "b"), hits("c", "d")],
        "endless": [hits(f"a{i}", f"b{i}") for i in range(12)],
        "plain": [[{"id": 1}, {"no": 2}], [{"id": 1}, {"id": 3}], []],
    }
    for search, some in pages.items():
        for i, page in enumerate(some, 1):
            record(tmp_path / search, f"{i}.json", page)
    read = spark.read.format("paged_search").option("path", str(tmp_path)).option("page_size", 2).option("most_pages", 10)
    got = {r.search: (r.pages, r.records, r.total, r.truncated, r.problem) for r in read.option("what", "searches").load().collect()}
    assert got == {
        "empty": (2, 2, None, False, None),
        "short": (2, 3, None, False, None),
        "total": (3, 5, 4, False, None),
        "same": (2, 2, None, False, "repeated_page"),
        "endless": (10, 20, None, True, None),
        "plain": (3, 2, None, False, None),
    }
    rows = read.option("what", "records").load()
    assert rows.rdd.getNumPartitions() == 6
    assert [(r.page, r.position, r.id) for r in rows.where("search = 'total'").orderBy("page", "position").collect()] == [(1, 0, "a"), (1, 1, "b"), (2, 1, "c"), (3, 0, "d"), (3, 1, "e")]
    assert json.loads(rows.where("search = 'plain' AND page = 2").first().record) == {"id": 3}


def test_a_feed_goes_on_where_it_stopped(spark, tmp_path):
    feeds.register(spark)
    for day in range(1, 5):
        record(tmp_path / "feed", f"2024-05-0{day}.json", [{"id": f"d{day}"}, {"id": f"e{day}"}])

    def run():
        stream = spark.readStream.format("change_feed").option("path", str(tmp_path / "feed")).option("today", "2024-05-08").option("since", "2024-05-02").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["d2", "d3", "d4", "e2", "e3", "e4"]
    record(tmp_path / "feed", "2024-05-06.json", {"results": [{"id": "d6"}]})
    assert run() == ["d2", "d3", "d4", "d6", "e2", "e3", "e4"] == run()
    batch = spark.read.format("change_feed").option("path", str(tmp_path / "feed")).option("today", "2024-05-13").load()
    assert sorted(r.id for r in batch.collect()) == ["d3", "d4", "d6", "e3", "e4"]
    with pytest.raises(Exception, match="reaches back to 2024-05-03"):
        spark.read.format("change_feed").option("path", str(tmp_path / "feed")).option("today", "2024-05-13").option("since", "2024-05-01").load().collect()


def brute(flags, most, carried):
    for i, f in enumerate(flags):
        carried = carried + 1 if f else 0
        if carried >= most:
            return i, most
    return None, carried


def test_where_failures_in_a_row_stop(spark):
    cases = [([1] * 5, 3, 0), ([1, 0, 1, 1, 0, 1], 3, 0), ([1, 1, 0, 1], 3, 1), ([1, 1], 5, 2), ([0] * 9 + [1] * 30 + [0], 25, 0), ([1] * 40, 41, 0), ([], 3, 2), ([0, 1] * 20, 2, 1), ([1, 0] * 20 + [1] * 3, 3, 0)]
    for flags, most, carried in cases:
        rows = spark.createDataFrame([(i, bool(f)) for i, f in enumerate(flags)], "i long, f boolean").repartition(5)
        assert I.stop_at(rows, "i", "f", most, carried) == brute(flags, most, carried), (flags, most, carried)


SCHEMA = "source string, source_id string, title string, status string, content string, position long"


def test_failing_documents_go_aside(spark, tmp_path):
    store = C.document_store(spark, f"file://{tmp_path}/store", buckets=2)
    rows = [("s", f"d{i}", "t", "ok", None if i % 10 == 3 else f"c{i}", i) for i in range(40)] + [("s", "d1", "t", "ok", "later", 90), ("s", " ", "t", "ok", "c", 91)]
    folder = f"{tmp_path}/in"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    go = lambda: I.import_stream(X.event_stream(spark, folder, SCHEMA), store, "feed", f"{tmp_path}/c").awaitTermination()
    go()
    version = store.snapshot().version
    assert store.read("documents").count() == 36 and store.read("versions").where("source_id = 'd1'").first().content == "later"
    assert sorted((r.source_id, r.problem, r.retryable) for r in store.read("failures").collect()) == [(" ", "no_id", False), ("d13", "no_content", True), ("d23", "no_content", True), ("d3", "no_content", True), ("d33", "no_content", True)]
    # The same batch again, as after a lost driver, and from the start with a new checkpoint: nothing is stored twice.
    I.import_batch(store, spark.createDataFrame(rows, SCHEMA), "feed-0", I.problem_of())
    assert store.snapshot().version == version and store.infos()[-1]["failing"] == 1


def test_many_failures_in_a_row_stop_the_import(spark, tmp_path):
    store = C.document_store(spark, f"file://{tmp_path}/store", buckets=2)
    batch = lambda bad, start, n: spark.createDataFrame([("s", f"d{i}", "t", "ok", None if i in bad else "c", i) for i in range(start, start + n)], SCHEMA)
    I.import_batch(store, batch(range(20, 30), 0, 30), "r-0", I.problem_of())
    with pytest.raises(I.TooManyFailures, match="position 44"):
        I.import_batch(store, batch(range(30, 60), 30, 50), "r-1", I.problem_of())
    assert store.read("failures").count() == 25 and store.read("documents").count() == 20
    I.import_batch(store, batch((), 100, 5), "r-2", I.problem_of())
    assert store.read("documents").count() == 25


def test_a_limiters_state_ends(spark, tmp_path):
    folder, schema = f"{tmp_path}/in", "user long, at timestamp, event long"
    rows = [(u, f"2024-01-01 00:0{m}:{s:02}", u * 100 + m * 10 + i) for u in (1, 2, 3) for m in (0, 1) for i, s in enumerate((0, 10, 20, 30))]
    frame = lambda r: spark.createDataFrame(r, "user long, t string, event long").select("user", F.col("t").cast("timestamp").alias("at"), "event")
    frame(rows).coalesce(1).write.parquet(folder)
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        stream = X.limited_with_end(X.event_stream(spark, folder, schema), "user", "at", "event", 3, 60.0)
        query = stream.writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
        query.processAllAvailable()
        got = {r.event: r.allowed for r in spark.table("ended").collect()}
        want = {r.event: r.allowed for r in X.limited_batch(frame(rows), "user", "at", "event", 3, 60.0).collect()}
        assert got == want and not all(got.values())
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] > 0
        # A much later hit of another user moves the watermark; nothing is left of the first three.
        for minute in (30, 40, 50):
            frame([(9, f"2024-01-01 00:{minute}:00", minute)]).coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
        query.stop()
        held = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "kept").load().collect()
        assert {r.key.user for r in held} <= {9}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def test_a_manifest_only_of_what_was_expected(spark, tmp_path):
    pages = {"inforce": [hits("a", "b", total=3), hits("c", total=3)], "historic": [hits("c", "d", total=4), hits("e")], "cut": [hits("f", "g"), hits("h", "i"), hits("j")]}
    for search, some in pages.items():
        for i, page in enumerate(some, 1):
            record(tmp_path / "in" / search, f"{i}.json", page)
    go = lambda **a: D.discover(spark, str(tmp_path / "in"), {"inforce": 3, "historic": 5, "absent": None, "cut": None}, str(tmp_path / "m"), most_pages=2, page_size=2, **a)
    with pytest.raises(D.CountsDiffer) as e:
        go(expected_total=9)
    assert str(e.value).split("; ") == ["all: overlap (1 found, 0 expected)", "cut: truncated (4 found, None expected)", "historic: count_mismatch (3 found, 5 expected)", "historic: reported_mismatch (3 found, 4 expected)"]
    assert not (tmp_path / "m").exists()
    with pytest.raises(D.CountsDiffer, match="all: total_mismatch"):
        go(expected_total=8)
    acts = go(allow=True)
    assert {r.id: r.search for r in acts.collect()} == {"a": "inforce", "b": "inforce", "c": "historic", "d": "historic", "e": "historic", "f": "cut", "g": "cut", "h": "cut", "i": "cut"}
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 9
    found = spark.createDataFrame([("a", "Bekendtgørelse om skibe", "x"), ("b", "Lov om fly", "x"), ("c", "Ændring af skibe", "x"), ("d", "Om skibe", "x")], "id string, title string, authority string")
    config = T.Relevance([T.Term("skib", 30.0, "prefix")])
    got = {r.id: r.decision for r in D.decided(found, spark.createDataFrame([("d",)], "id string"), config, denied="^Ændring").collect()}
    assert got == {"a": "queue", "b": "skip", "c": "denied", "d": "known"}
