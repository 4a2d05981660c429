import re
from collections import Counter

from lexforge.llm import queries
from lexforge.llm.quality import judged
from tests.llm.fixtures import SF, no_docs, odd_docs


def brute(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def check(rows):
    for r in rows:
        n = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)


def test_odd_documents(spark):
    got = judged(odd_docs(spark)).collect()
    assert len(got) == odd_docs(spark).count()
    check(got)
    assert judged(no_docs(spark)).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = queries.op9_quality_rules(spark, SF)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    check(got.join(docs, "doc_id").collect())


def test_verdicts_agree_with_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    both = queries.op9_quality_rules(spark, SF).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in both) >= 0.98 * len(both)


def test_no_python_in_the_plan(spark):
    plan = queries.op9_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
