import datetime
import math
import re

from pyspark.sql import functions as F

from lexforge.functions import text as X
from lexforge.functions import vectors as V


def values(spark, items, of, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", of(F.col("x")).alias("y")).orderBy("i").collect()]


def test_fold(spark):
    assert values(spark, ["Søfart ÆØÅ", None, "a­b", "“É”—ü", "café"], X.fold) == ["soefart aeoeaa", "", "ab", '"e"-ue', "cafe"]
    assert X.fold_text("Søfart ÆØÅ") == "soefart aeoeaa"


def test_decomposed_text_is_composed_first(spark):
    """A letter with a combining accent folds and hashes like the composed one, by default."""
    composed, loose = "Åse på café", "A\u030ase pa\u030a cafe\u0301"
    assert values(spark, [composed, loose], X.fold) == ["aase paa cafe"] * 2
    assert len(set(values(spark, [composed, loose], X.content_hash))) == 1
    assert values(spark, [loose], lambda c: X.contains_any(c, ["åse"]), "string") == [True]
    row = X.composed(spark.createDataFrame([(loose,)], "t string"), "t").select(X.fold(F.col("t"), normalised=True).alias("f")).first()
    assert row.f == "aase paa cafe"


def test_spellings(spark):
    for term, texts in (("Ærø", ["aeroe", "ærø", "ÆRØ", "Aerö"]), ("Aabenraa", ["Åbenrå", "aabenrå"]), ("café", ["cafe", "café"])):
        assert all(re.fullmatch(X.spelling_pattern(term), t, re.I) for t in texts)
    assert not re.fullmatch(X.spelling_pattern("ærø"), "aro", re.I)


def test_hits_have_places_in_the_source(spark):
    text = "Æbler og øl på Ærø, og så mere om færgen"
    assert values(spark, [text, None], lambda c: X.first_hit(X.collapse_space(c), ["FÆRGEN", "paa"]), "string") == [text.index("på"), -1]
    long = "ææ øø " * 60 + "målet her " + "ååå " * 80
    got = values(spark, [long], lambda c: X.snippet(c, ["maalet"], 60))[0]
    assert "målet" in got and len(got) <= 62 and got.strip("…") in long


def test_canonical_text_and_quotations(spark):
    assert values(spark, [" a\u00a0b \r\n\r\n\r\n\r\nc\u200bd\t", None, "m² ½"], X.canonical) == ["a b\n\ncd", "", "m² ½"]
    whole = "§ 1. Reglerne gælder for skibe med en bruttotonnage på 500 eller derover."
    rows = spark.createDataFrame([(whole.replace(" ", "\n", 3), whole + " Mere."), ("kort", whole), (whole + "x", whole)], "q string, c string")
    assert [r.p for r in rows.select(X.quoted_in(F.col("q"), F.col("c")).alias("p")).collect()] == [None, "too_short", "not_found"]


def test_metadata_and_durations(spark):
    row = spark.sql("SELECT map('b', 'x', 'a', '') AS m, 'T' AS t, CAST(NULL AS string) AS n, timestamp'2024-01-01 00:00:00' AS s, timestamp'2024-01-01 00:01:30.5' AS f, CAST(NULL AS timestamp) AS z")
    got = row.select(X.metadata_text(F.col("m"), F.col("t"), F.col("n")).alias("m"), X.seconds_between(F.col("s"), F.col("f")).alias("d"), X.seconds_between(F.col("s"), F.col("z")).alias("r")).first()
    assert tuple(got) == ("T x b a", 90.5, None)


def test_space_and_html(spark):
    assert values(spark, ["  a \n b ", None], X.collapse_space) == ["a b", ""]
    assert values(spark, ["<p>a&amp;b</p><br/>  <b>c</b>\n\n<div>d</div>", ""], X.strip_html) == ["a&b\nc\nd", ""]


def test_dates(spark):
    got = values(spark, ["2024-02-03", "03-02-2024", "3. februar 2024", "2024-02-03T10:00:00Z", "20240203", "nope", None, "31-02-2024"], X.parse_date)
    day = datetime.date(2024, 2, 3)
    assert got == [day, day, day, day, day, None, None, None]


def test_numbers_and_keys(spark):
    assert values(spark, ["1.500 tons", "15,5 m", "x", None], X.number_of) == [1500.0, 15.5, None, None]
    rows = spark.createDataFrame([("12", "A"), ("3", None), ("x", "")], "n string, l string").select(X.paragraph_key(F.col("n"), F.col("l")).alias("k")).collect()
    assert [r.k for r in rows] == ["0012a", "0003", "9999x"]
    keys = values(spark, ["§ 3, stk. 2", "§ 12 a", None], X.section_key)
    assert [tuple(k) for k in keys] == [(3, "", 2), (12, "a", 0), (1 << 30, "", 0)]


def test_term_patterns(spark):
    text = ["skibe og skib, et  skib"]
    for kind, term, n in (("word", "skib", 2), ("prefix", "skib", 3), ("substring", "et skib", 1), ("regex", "skib", 3)):
        assert values(spark, text, lambda c, k=kind, t=term: F.regexp_count(c, F.lit(X.term_pattern(t, k)))) == [n]


def test_snippet(spark):
    text = "word " * 100 + "needle " + "word " * 100
    got = values(spark, [text, "short", None], lambda c: X.snippet(c, ["needle"], 80))
    assert "needle" in got[0] and len(got[0]) <= 82 and got[0][0] == got[0][-1] == "…"
    assert got[1:] == ["short", ""]


def test_vectors(spark):
    assert values(spark, [[3.0, 4.0], [0.0, 0.0]], V.normalize, "array<float>") == [[0.6, 0.8], [0.0, 0.0]]
    assert values(spark, [[1.0, -2.5], None], lambda c: V.unpack(V.pack(c)), "array<float>") == [[1.0, -2.5], None]
    assert values(spark, [b"abc", b"\0\0\x80?"], lambda c: V.unpack(c, 2), "binary") == [None, [0.0, 0.0]]
    got = values(spark, ["skib skib havn", ""], lambda c: V.hashing_embedding(c, 64))
    assert math.isclose(sum(x * x for x in got[0]), 1.0, rel_tol=1e-5) and got[1] == [0.0] * 64
