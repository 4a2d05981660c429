import itertools

from pyspark.sql import functions as F

from lexforge import sources as S
from lexforge import streaming as X
from lexforge.operators import applicability as A
from lexforge.operators import history as H
from lexforge.operators import relations as G
from lexforge.operators import terms as T

def test_kleene(spark):
    rows = spark.createDataFrame([(a, b) for a in (1, 0, None) for b in (1, 0, None)], "a int, b int")
    kinds = {"a": "number", "b": "number"}
    one = lambda f: {"field": f, "operator": "eq", "value": 1}
    got = rows.select(A.compile_tree({"all": [one("a"), one("b")]}, kinds), A.compile_tree({"any": [one("a"), one("b")]}, kinds), A.compile_tree({"not": one("a")}, kinds), A.compile_tree({**one("a"), "unknown": "true"}, kinds)).collect()
    tri = [True, False, None]
    for r, (a, b) in zip(got, itertools.product(tri, tri), strict=True):
        both = False if False in (a, b) else None if None in (a, b) else True
        either = True if True in (a, b) else None if None in (a, b) else False
        assert tuple(r) == (both, either, None if a is None else not a, True if a is None else a)


def test_comparators(spark):
    rows = spark.createDataFrame([(["Tanker ", "Ferry"], "2020-05-01", 10.0), (None, None, None)], "l array<string>, d string, n double")
    tests = [("list", "contains", "l", "tanker"), ("list", "intersects", "l", ["x", "ferry"]), ("list", "not_in", "l", ["ferry"]), ("list", "contains", "l", "*"), ("date", "before", "d", "2020-06-01"), ("number", "between", "n", [10, 11]), ("number", "contains", "n", 1)]
    got = rows.select(*[A.compare(k, o, F.col(c), v).alias(str(i)) for i, (k, o, c, v) in enumerate(tests)]).collect()
    assert tuple(got[0]) == (True, True, False, True, True, True, None) and set(got[1]) == {None}


def test_relevance_floor_and_negatives(spark):
    docs = spark.createDataFrame([("Lov om skibe", "x"), ("Lov om skibe og fly", "x"), (None, None)], "title string, content string")
    config = T.Relevance([T.Term("skib", 12.0, "prefix", concept="ship")], [T.Term("fly", 3.0)])
    got = T.score_relevance(docs, config).collect()
    assert [(r.score, r.classification, r.title_floor) for r in got] == [(70, "relevant", True), (38, "possible", False), (0, "not_relevant", False)]
    assert got[0].matched_terms == ["skib"] and got[2].matched_terms == []


def test_categories_fall_back(spark):
    docs = spark.createDataFrame([("skib skib skib", "skib"), ("intet", None)], "title string, content string")
    got = T.categorize(docs, [T.Category("ships", [T.Term("skib", 5.0)])], "other").collect()
    assert [[(c.slug, c.confidence, c.raw) for c in r.categories] for r in got] == [[("ships", 0.8065, 50.0)], [("other", 0.55, 0.0)]]


def test_walk_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", None), ("c", "lost")], "source string, target string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth, r.cut) for r in G.walk(edges, start).collect()} == {("b", 1, False), ("c", 2, False), ("lost", 3, False)}
    assert {(r.node, r.depth, r.cut) for r in G.walk(edges, start, 2).collect()} == {("b", 1, False), ("c", 2, True)}


def test_versions_and_backoff(spark):
    old = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "id long, version_number int, content_hash string")
    new = spark.createDataFrame([(1, "z"), (2, "q")], "id long, content_hash string")
    assert {tuple(r) for r in H.append_versions(old, new, "id").collect()} == {(1, 1, "x"), (1, 2, "y"), (1, 3, "z"), (2, 1, "q")}
    got = spark.range(1, 7).select(H.backoff_minutes(F.col("id")).alias("m")).collect()
    assert [r.m for r in got] == [5, 15, 45, 135, 360, 360]


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes("﻿id,title\n# note\nA,one\nB,two\nA,three\n".encode())
    got = S.read_manifest(spark, str(path), ["id", "title"], "id").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("A", "one"), ("B", "two")]


def test_limiter_batch_and_stream_agree(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id")
    want = {}
    for user, rows in itertools.groupby(sorted(events.collect(), key=lambda r: (r.user_id, r.ts, r.event_id)), key=lambda r: r.user_id):
        rows = list(rows)
        allowed, _ = X.accepted([r.ts.timestamp() for r in rows], [], 2, 36000.0)
        want |= {r.event_id: a for r, a in zip(rows, allowed, strict=True)}
    assert {r.event_id: r.allowed for r in X.limited_batch(events, "user_id", "ts", "event_id", 2, 36000.0).collect()} == want
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = X.event_stream(spark, f"{tmp_path}/in", events.schema)
    query = X.limited(stream, "user_id", "ts", "event_id", 2, 36000.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert {r.event_id: r.allowed for r in spark.table("limited").collect()} == want


def test_walks_are_doubled(spark):
    """Least depths over a graph with a long chain, short cuts, cycles and dangling ends, like a breadth-first search's."""
    edges = [(i, i + 1) for i in range(40)] + [(3, 20), (41, 5), (40, 2), (7, 7), (60, 61), (61, 60), (9, None)]
    frame = spark.createDataFrame(edges, "source int, target int")
    starts = spark.createDataFrame([(0,), (19,), (60,), (99,)], "node int")
    out = {}
    for s, depth in ((0, 50), (19, 50), (60, 50), (99, 50)):
        seen, now = {s: 0}, [s]
        for d in range(1, depth + 1):
            now = [t for x in now for a, t in edges if a == x and t is not None and t not in seen and not seen.setdefault(t, d) == 0]
        out |= {(s, n): d for n, d in seen.items() if d}
    assert {(r.start, r.node): r.depth for r in G.walk(frame, starts).collect()} == out
    cut = G.walk(frame, starts, 7)
    assert {(r.start, r.node): r.depth for r in cut.collect()} == {k: d for k, d in out.items() if d <= 7}
    assert {r.depth for r in cut.where("cut").collect()} == {7}


def test_points_in_spans(spark, monkeypatch):
    import random

    from lexforge.operators import spans as P

    monkeypatch.setattr(P, "CELL", 50)
    r, spans, points = random.Random(6), [], []
    for key in ("a", "b", None):
        at = 0
        for i in range(30):
            at += r.choice((0, 0, 3, 20))
            end = at + r.choice((0, 1, 5, 40, 180))
            spans.append((key, at, end, f"{key}{i}"))
            at = end
        points += [(key, r.randrange(at + 60), "x") for _ in range(200)] + [(key, None, "x"), (key, 0, "x")]
    got = P.containing(spark.createDataFrame(points, "k string, at int, span string"), spark.createDataFrame(spans, "k string, a int, b int, name string"), "k", "at", "a", "b", ["name"], "held")
    want = sorted(((k, p, next((n for kk, a, b, n in spans if kk == k and p is not None and a <= p < b), None)) for k, p, _ in points), key=repr)
    assert sorted(((x.k, x.at, x.held and x.held.name) for x in got.collect()), key=repr) == want
