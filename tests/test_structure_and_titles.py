from pyspark.sql import functions as F

from lexforge.operators import references as R
from lexforge.operators import structure as S
from lexforge.operators import titles as T

FLAT = "I medfør af § 4 i lov nr. 7 fastsættes: Kapitel 1 Rammer § 1. Reglen gælder, jf. § 3. Ministeren kan fravige, jf. dog § 2. Stk. 2. Den gælder ikke for § 5. § 2. Skibet skal synes. Kapitel 2 Slut § 3. Den træder i kraft."


def numbers(units, kind="paragraph"):
    return [(u["number"], u["letter"]) for u in units if u["kind"] == kind]


def test_references_are_no_paragraphs():
    units = S.parse(FLAT)
    assert numbers(units) == [("1", None), ("2", None), ("3", None)]
    assert [(u["chapter"], u["chapter_title"]) for u in units if u["kind"] == "chapter"] == [("1", "Rammer"), ("2", "Slut")]
    assert [u["kind"] for u in units][0] == "preamble" and [u["chapter"] for u in units if u["kind"] == "paragraph"] == ["1", "1", "2"]
    assert numbers(S.parse("§ 1. Føreren har ansvaret, jf. § 2. Ministeren kan fravige. § 2. Loven gælder.")) == [("1", None), ("2", None)]
    assert numbers(S.parse("§ 5. Efter § 3. Skibet synes. § 5 a. Nyt. § 4. Gammelt.")) == [("5", None), ("5", "a")]


def test_lines_parts_and_headings():
    text = "Afsnit II\nSkibe\nKapitel 3 a\nSyn\nOm tilsyn\n§ 12. Synet.\nStk. 2. Igen.\n§§ 3-5 er nævnt.\n§ 12 b Uden punktum\nBILAG\ntekst"
    units = S.parse(text)
    assert numbers(units) == [("12", None), ("12", "b")] and numbers(units, "subsection") == [("12", None)]
    p = next(u for u in units if u["kind"] == "paragraph")
    assert (p["part"], p["part_title"], p["chapter"], p["chapter_title"], p["heading"]) == ("II", "Skibe", "3a", "Syn", "Om tilsyn")
    assert all(text[u["start"] : u["end"]].strip() == u["text"] for u in units)
    assert [u["kind"] for u in S.parse("Kun tekst uden tegn.")] == ["text"] and S.parse(None) == []


def test_chunks_cover_the_text():
    for text in (FLAT, "§ 1. " + "Lang sætning uden ende. " * 200 + "\n§ 2. Kort.", "ord " * 3000, "§ 1. " + "ord" * 2000):
        made = S.chunks(text)
        covered = set()
        for c in made:
            covered.update(range(c["start"], c["end"]))
            assert c["end"] - c["start"] <= 2400 or "ord" * 700 in c["text"]
        assert all(i in covered for i, x in enumerate(text) if not x.isspace())
    assert {c["kind"] for c in S.chunks("ord " * 3000)} == {"fragment"}


def test_only_stale_documents_are_cut_anew(spark):
    docs = spark.createDataFrame([(1, 1, "§ 1. Et."), (2, 2, "§ 1. To.\n§ 2. Tre."), (3, 1, "")], "id int, version int, text string")
    indexed = spark.createDataFrame([(1, 1, "m"), (2, 1, "m")], "id int, version int, model string")
    old = S.chunked(docs.where("id < 3").withColumn("text", F.lit("§ 1. Gammel.")), "id", "text")
    chunks, done = S.reindexed(old, indexed, docs, "id", "version", "text", "m")
    assert sorted((r.id, r.text) for r in chunks.collect()) == [(1, "§ 1. Gammel."), (2, "§ 1. To."), (2, "§ 2. Tre.")]
    assert sorted((r.id, r.version) for r in done.collect()) == [(1, 1), (2, 2), (3, 1)]


def test_display_titles(spark):
    titles = [
        ("Bekendtgørelse af lov om sikkerhed til søs (søsikkerhedsloven)", None, "Lov om sikkerhed til søs"),
        ("Bekendtgørelse af søloven", None, "Søloven"),
        ("Bekendtgørelse om redningsmidler i skibe, jf. lov nr. 7", None, "Bekendtgørelse om redningsmidler i skibe"),
        ("Bekendtgørelse om syn af skibe1)", None, "Bekendtgørelse om syn af skibe"),
        ("Bekendtgørelse om bygning af skibe og deres udrustning i fart samt om tilsyn med dem i alle farvande", None, "Bekendtgørelse om bygning af skibe og deres udrustning i fart"),
        ("Bekendtgørelse om " + "overvågningsforanstaltninger " * 4, "skibsloven", "Skibsloven"),
        (None, None, ""),
    ]
    rows = spark.createDataFrame([t[:2] for t in titles], "t string, s string")
    assert [r.d for r in rows.select(T.display_title(F.col("t"), F.col("s")).alias("d")).collect()] == [t[2] for t in titles]


def test_reasons(spark):
    row = spark.sql("SELECT 'possible' AS c, 45 AS s, array('a','b','c','d','e','f') AS m, array('x','y') AS k, true AS f")
    assert row.select(T.reason(F.col("c"), F.col("s"), F.col("m"), F.col("k"), F.col("f")).alias("r")).first().r == "Possible (45): a, b, c, d and 2 more; 2 concepts; lifted by its title"


def test_references_of_queries():
    read = lambda q: (r.number, r.kind, r.year, r.rest) if (r := R.read_reference(q)) else None
    assert read("BEK nr. 0886 olieforurening på søen") == ("886", "BEK", None, "olieforurening på søen")
    assert read("Lovbekendtgørelse 160 af 2. maj 2018") == ("160", "LBK", 2018, "")
    assert read("nr. 12/2004 skibe") == ("12", None, 2004, "skibe")
    assert read("2207") == ("2207", None, None, "") and read("hviletid 24 timer") is None and read("24 timer") is None and read(None) is None


def test_keys_of_documents(spark):
    rows = spark.createDataFrame([("Lovbekendtgørelse", "0072", "2014-01-17", "Bekendtgørelse af lov om havne."), ("Vejledning", "3", None, "Om havne")], "k string, n string, d string, t string")
    got = rows.select(R.document_keys(F.col("k"), F.col("n"), F.to_date("d"), F.col("t")).alias("k"), R.type_code(F.col("k")).alias("c")).collect()
    assert [(r.k, r.c) for r in got] == [(["LBK 72/2014", "lov om havne"], "LBK"), (["VEJ 3"], "VEJ")]
