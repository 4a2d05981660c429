import json

import pytest
from pyspark.sql import functions as F

from lexforge import sources as S
from lexforge import streaming as X
from lexforge.operators import evaluation as E
from lexforge.operators import flat_rules as K
from lexforge.operators import history as H
from lexforge.operators import search as Q

RULE = {"rule_id": "A", "citation": "c", "topic_category": "t", "inclusion_conditions": [{"field": "gross_tonnage", "operator": "gte", "target_value": 500}]}


@pytest.mark.parametrize(
    "condition,kind",
    [
        ({"field": "speed", "operator": "eq", "target_value": 1}, "inclusion"),
        ({"field": "flag_state", "operator": "gt", "target_value": "DK"}, "inclusion"),
        ({"field": "gross_tonnage", "operator": "gte", "target_value": "500"}, "inclusion"),
        ({"field": "primary_type", "operator": "eq", "target_value": "fishing_vessel"}, "inclusion"),
        ({"field": "primary_type", "operator": "in", "target_value": []}, "inclusion"),
        ({"field": "keel_laid_date", "operator": "lt", "target_value": "soon"}, "exclusion"),
        ({"field": "is_primitive_wooden_build", "operator": "eq", "target_value": True}, "inclusion"),
    ],
)
def test_faulty_conditions(condition, kind):
    assert K.problem(condition, kind)
    assert K.problem({"field": "is_primitive_wooden_build", "operator": "eq", "target_value": True}, "exclusion") is None


def test_unset_is_no_default(spark):
    """A list that wasn't given is unknown, an empty one that was is none; an assumed default may exclude."""
    rule = RULE | {"inclusion_conditions": [{"field": "sub_types", "operator": "contains", "target_value": "Ro-Ro"}], "exclusion_conditions": [{"field": "is_primitive_wooden_build", "operator": "eq", "target_value": True}]}
    ships = spark.sql("""SELECT * FROM VALUES (1, array(), array('sub_types')), (2, array(), array()), (3, array('ro-ro '), array('sub_types')) AS t(id, sub_types, supplied)""")
    ships = ships.select("id", F.col("sub_types").cast("array<string>").alias("sub_types"), F.col("supplied").cast("array<string>").alias("supplied")).withColumns({"assessment_date": F.lit("2024-01-01").cast("date"), "keel_laid_date": F.lit("2000-01-01").cast("date")})
    got = {r.id: (r.verdict, r.step, r.missing_fields) for r in K.evaluate(ships, [rule], "id").collect()}
    assert got == {1: ("DOES_NOT_APPLY", "inclusions", []), 2: ("NEEDS_MANUAL_REVIEW", "missing_data", ["sub_types"]), 3: ("APPLIES", "inclusions", [])}
    assumed = K.evaluate(ships, [rule], "id").where("id = 3").first().conditions
    assert [(c.field, c.assumed, c.outcome) for c in assumed] == [("sub_types", False, "MET"), ("is_primitive_wooden_build", True, "NOT_MET")]


def test_batches():
    batch = {"schema_version": 1, "drafts": [{"rule": RULE, "source_text": "x"}]}
    assert K.read_batch(json.dumps(batch))[0]["rule"]["rule_id"] == "A"
    assert K.read_batch("schema_version: 1\ndrafts: []") == []
    for wrong in ({"drafts": batch["drafts"] * 2}, {"drafts": [{"rule": RULE | {"extra": 1}}]}, {"rules": []}, {"drafts": [{"rule": RULE | {"inclusion_conditions": []}}]}):
        with pytest.raises(ValueError):
            K.read_batch(json.dumps(wrong))


def test_hashes(spark):
    assert K.rule_hash(RULE) == K.rule_hash(dict(reversed(RULE.items())) | {"status": "APPROVED"}) != K.rule_hash(RULE, "text")
    rows = spark.sql("SELECT 1 AS id, 'DK' AS flag_state, 5.0D AS gross_tonnage, array('flag_state') AS supplied UNION ALL SELECT 2, 'DK', 5.0D, array('flag_state', 'gross_tonnage') UNION ALL SELECT 3, 'DK', 6.0D, array('flag_state')")
    got = {r.id: r.profile_hash for r in K.profile_hash(rows, "id").collect()}
    assert got[1] == got[3] != got[2]


def test_web_queries(spark):
    assert Q.read_query('skib "rød  Båd" or hav -"gammelt vrag" -x') == (["skib"], [["roed baad", "hav"]], ["gammelt vrag", "x"])
    docs = spark.createDataFrame([(1, "Skib", "på havet hav"), (2, "Hav", "et skib og et skib"), (3, "Skib hav", "vrag"), (4, "Skibe", "hav")], "id int, title string, body string")
    got = [r.id for r in Q.weighted_rank(docs, "skib hav -vrag", "id", {"title": "title", "body": "body"}).orderBy(F.desc("rank_score")).collect()]
    assert got == [2, 1]
    assert Q.weighted_rank(docs, "", "id", {"title": "title"}).count() == 0


def test_modes_and_floors():
    assert Q.resolved_mode("hybrid", True, True) == ("hybrid", None) and Q.resolved_mode("odd", True, True) == ("lexical", None)
    assert all(Q.resolved_mode("semantic", *s)[0] == "lexical" and Q.resolved_mode("semantic", *s)[1] for s in ((False, True), (True, False), (True, True, False)))
    assert Q.floor_of("multilingual-E5-small") == 0.75 and Q.floor_of("hashing") == 0.0 and Q.over_fetch(5) == 100 and Q.over_fetch(50) == 250


def test_picking_and_rendering(spark):
    rows = spark.createDataFrame([('{"Document Type": {"shortName": "BEK"}, "titleText": "Om", "x": ""}',), ('{"document_type":"LOV","x":null}',)], "r string")
    got = rows.select(S.pick("r", ["documentType"]).alias("a"), S.pick("r", ["title"]).alias("b"), S.pick("r", ["zz"]).alias("c")).collect()
    assert [tuple(r) for r in got] == [("BEK", "Om", None), ("LOV", None, None)]
    assert S.rendered({"q": "{term}", "page": "{page}", "type": "{kind}", "z": "a{kind}b"}, {"term": "skib", "page": 2, "kind": None}) == {"q": "skib", "page": "2", "z": "ab"}


def test_harvest_ends(spark):
    pages = lambda rows: spark.createDataFrame(rows, "page int, n long, size long, total long, digest string")
    run = lambda rows, most=10: tuple(S.harvested(pages(rows), most).first())
    assert run([(1, 5, 5, None, "a"), (2, 3, 5, None, "b"), (3, 5, 5, None, "c")]) == (2, 8, False, None)
    assert run([(1, 5, 5, 10, "a"), (2, 5, 5, 10, "b"), (3, 5, 5, 10, "c")]) == (2, 10, False, None)
    assert run([(1, 5, 5, None, "a"), (2, 5, 5, None, "a")]) == (1, 5, False, "repeated_page")
    assert run([(1, 5, 5, None, "a"), (2, 5, 5, None, "b"), (3, 5, 5, None, "c")], 2) == (2, 10, True, None)


def test_eval_sets(spark, tmp_path):
    path = tmp_path / "e.yaml"
    path.write_text("corpus: c\nqueries:\n- {query: skibe, relevant: [a, b]}\n- {query: 'nej', tags: [control]}\n")
    queries, relevant = E.eval_frames(spark, E.read_eval_set(str(path)))
    assert queries.count() == 2 and {tuple(r) for r in relevant.collect()} == {(0, "a"), (0, "b")}
    path.write_text("queries:\n- {query: skibe}\n- {query: ' Skibe'}\n")
    with pytest.raises(ValueError):
        E.read_eval_set(str(path))
    pool = spark.createDataFrame([(0, "a", ["x", "y"], 1), (0, "b", ["x"], 2)], "query_id int, doc_id string, modes array<string>, best_position int")
    E.write_scaffold(pool, f"{tmp_path}/s")
    marked = spark.read.csv(f"{tmp_path}/s", header=True).withColumn("relevant", F.when(F.col("doc_id") == "b", "Ja"))
    marked.coalesce(1).write.csv(f"{tmp_path}/r", header=True)
    assert [(r.query_id, r.relevant) for r in E.read_scaffold(spark, f"{tmp_path}/r").collect()] == [("0", ["b"])]


def test_query_log_grows_by_batches(spark, tmp_path):
    schema = "q string, at int, n int"
    folder, rows = f"{tmp_path}/in", [("Skib", 1, 0), ("skib ", 2, 5), ("hav", 3, 1)]
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = X.event_stream(spark, folder, schema)
    fold = lambda b: H.fold_queries(b, "q", "at", "n")
    for i in range(2):
        spark.createDataFrame(rows[i * 2 :][:2], schema).coalesce(1).write.mode("append").parquet(folder)
        X.upsert_query_log(stream, fold, f"{tmp_path}/log", f"{tmp_path}/c").awaitTermination()
    assert sorted((r.occurrences, r.last_result_count, r.best_result_count) for r in X.query_log(spark, f"{tmp_path}/log").collect()) == [(1, 1, 1), (2, 5, 5)]
