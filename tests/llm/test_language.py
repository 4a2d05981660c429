import math
from collections import Counter

from pyspark.sql import functions as F

from lexforge.llm import queries
from lexforge.llm.language import UNKNOWN, fit, grams, held_out, identify
from tests.llm.fixtures import SF, no_docs, odd_docs


def test_held_out_accuracy(spark):
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_language_id(spark, "/root/testdata/sf0.01").join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_query(spark):
    rows = queries.op10_language_id(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()}


def test_odd_documents(spark):
    docs = odd_docs(spark)
    model = fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = identify(spark, docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if grams(r.text or "") is None:
            assert (r.lang_pred, r.score, r.rejected) == (UNKNOWN, 0.0, True)
        else:
            assert r.lang_pred in model.languages
    assert identify(spark, no_docs(spark), model).count() == 0


def test_nothing_to_learn(spark):
    model = fit(no_docs(spark))
    assert {r.lang_pred for r in identify(spark, odd_docs(spark), model).collect()} == {UNKNOWN}


def test_every_language_is_learned_once_a_text(spark):
    """Many copies of few texts: every language is in the model, and copies change nothing in it."""
    texts = [(f"{name} word{chr(97 + i)} {name * 3} and other {name}s", name) for name in ("abc", "def", "ghi", "jkl", "mno", "pqr") for i in range(3)]
    few = spark.createDataFrame([(t, name) for t, name in texts], "text string, lang string")
    many = few.crossJoin(spark.range(2000).select()).union(spark.createDataFrame([("12 34", "digits")], "text string, lang string"))
    one, more = fit(few, per_language=2), fit(many, per_language=2)
    assert set(more.languages) == {name for _, name in texts}
    assert more.languages == one.languages and (more.centroids == one.centroids).all() and (more.idf == one.idf).all()


def test_emoji_are_no_letters(spark):
    assert grams("\U0001f600\U0001f601 12 \U0001f600") is None
    assert (grams("a \U0001f600 b") == grams("a b")).all() and grams("\U00010400\U00020000") is not None
    model = fit(spark.createDataFrame([("some words", "en"), ("viele Worte", "de")], "text string, lang string"))
    (r,) = identify(spark, spark.createDataFrame([("\U0001f600 7 \U0001f680",)], "text string"), model).collect()
    assert (r.lang_pred, r.score, r.rejected) == (UNKNOWN, 0.0, True)


def plain_grams(text):
    """The n-grams of a text counted one by one, with str.isalpha and whole numbers."""
    points, mix, full = [32], 0x9E3779B97F4A7C15, (1 << 64) - 1
    for c in text.lower():
        if c.isalpha():
            points.append(ord(c))
        elif points[-1] != 32:
            points.append(32)
    if points[-1] != 32:
        points.append(32)
    if len(points) == 1:
        return None
    counts = Counter()
    one = [p * mix & full for p in points]
    two = [(a ^ (p + (1 << 24))) * mix & full for a, p in zip(one, points[1:])]
    three = [(a ^ (p + (1 << 25))) * mix & full for a, p in zip(two, points[2:])]
    counts.update(h >> 50 for h in one + two + three)
    return counts


def test_against_brute_force(spark):
    """Every document against every centroid, one place after the other; letters are those of str.isalpha."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).union(spark.sql("SELECT -1L, '\U0001f600 12 \U0001d7d9', 'en', 's', 1L UNION SELECT -2L, '\u4e2d\u6587 \U00010400', 'en', 's', 2L"))
    model = fit(spark.read.parquet(f"{SF}/documents.parquet").where(~held_out(F.col("doc_id"))))
    for r in identify(spark, docs, model).collect():
        counts = plain_grams(r.text)
        if counts is None:
            assert (r.lang_pred, r.score) == (UNKNOWN, 0.0)
            continue
        vector = {p: n * float(model.idf[p]) for p, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        cosine = [sum(v * float(c[p]) for p, v in vector.items()) / norm for c in model.centroids]
        assert abs(max(cosine) - r.score) < 1e-3
        assert r.lang_pred in {name for name, c in zip(model.languages, cosine, strict=True) if c > max(cosine) - 1e-3}


def test_rejection(spark):
    """Clean texts of all lengths stay; other scripts, other Latin-script languages and noise go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    whole = identify(spark, docs, model)
    assert whole.where("rejected AND NOT (length(text) < 400)").count() <= 0.01 * docs.count()
    short = docs.select(*[c for c in docs.columns if c != "text"], F.substring_index("text", " ", 12).alias("text"))
    assert identify(spark, short, model).where("rejected").count() <= 0.02 * docs.count()
    others = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "xq zvkj wqpt zzkx vvbn qqrt xkcd zxcv bnmq wrtp lkjh gfds qzxw plmk",
    ]
    rows = identify(spark, spark.createDataFrame([(t,) for t in others], "text string"), model).collect()
    assert [r.rejected for r in rows] == [True] * len(others)
