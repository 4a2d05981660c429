import pytest

from lexforge.llm import common


def test_keys(spark):
    space = common.Workspace(spark, "test")
    keys = lambda rows, schema: [r.k for r in common.keyed(spark.createDataFrame(rows, schema), "k", space).collect()]
    assert sorted(keys([(5,), (7,)], "doc_id long")) == [5, 7]
    for rows, schema in (([(5,), (5,), (None,)], "doc_id long"), ([("a1",), ("01",), ("1",)], "doc_id string"), ([(1,), (1,)], "other int")):
        assert len(set(keys(rows, schema))) == len(rows)
    common.delete(spark, space.root)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = spark.conf, Context()

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            common.shared_dir(Session())


def test_names_that_are_free(spark):
    docs = spark.createDataFrame([(1, 2)], "_KEY int, _key_ int")
    assert common.free_name(docs, "_key") == "_key__" and common.free_name(docs, "x") == "x"


def test_tables_are_deleted_after_a_stage(spark):
    common.release_all()
    with common.released():
        space = common.Workspace(spark, "stage")
        space.write(spark.range(3), "t")
        assert common.exists(spark, space.root)
    assert not common.exists(spark, space.root) and not common.Workspace.opened
