import re
from collections import Counter

import pytest

from lexforge.llm import phrases
from lexforge.llm.phrases import collocations, tokens
from tests.llm.fixtures import no_docs, odd_docs, odd_texts, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest, least, top):
    """rows: (lang, text)."""
    total, found = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            found.update((lang, *w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    often = {p: c for p, c in found.items() if c >= least}
    inside = {}
    for p, c in often.items():
        for i in range(1, len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p) - 1:
                    q = (p[0], *p[i:j])
                    inside[q] = max(inside.get(q, 0), c)
    out = {}
    for p, a in often.items():
        if len(p) > 2 and inside.get(p, 0) < a:
            n = total[p[0]]
            score, _, l, r = min((1000 * a * n // (often[p[: k + 1]] * often[p[0], *p[k + 1 :]]), k, often[p[: k + 1]], often[p[0], *p[k + 1 :]]) for k in range(1, len(p) - 1))
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), l, r, n))
    return {(lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, some in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(some)[:top])}


def got(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def texts(n=60):
    """Few words, so that long phrases repeat, with phrases that are always part of a longer one."""
    made = [" ".join("abcd"[ord(c) % 4] if c != " " else "Xy zé,! q" for c in prose(i, 60)[::2]) for i in range(n)]
    return [("en" if i % 3 else None, t.replace("a b", "a b.") if i % 5 else t + "\nalways the same. ALWAYS THE SAME") for i, t in enumerate(made)]


@pytest.mark.parametrize("longest,least,top", [(5, 20, 2000), (4, 3, 25), (3, 300, 10)])
def test_like_brute_force(spark, longest, least, top):
    rows = texts()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute(rows, longest, least, top)
    assert got(collocations(docs, longest=longest, least=least, top=top)) == want and want


def test_small_bitmaps_and_chunks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKETS", 12)
    monkeypatch.setattr(phrases, "MEMBERS", 12)
    monkeypatch.setattr(phrases, "CHUNK", 100)
    monkeypatch.setattr(phrases, "WORDS", 5)
    rows = texts(30)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert got(collocations(docs, longest=4, least=4, top=50)) == brute(rows, 4, 4, 50)


def test_odd_documents(spark):
    rows = [(r[2], r[1]) for r in odd_texts()]
    assert got(collocations(odd_docs(spark), least=2, top=300)) == brute(rows, 5, 2, 300)
    assert collocations(no_docs(spark)).count() == 0
    assert collocations(odd_docs(spark), least=10**6).count() == 0


def test_one_word(spark):
    docs = spark.createDataFrame([("en", "a a a a"), ("und", "a a"), (None, "a a")], "lang string, text string")
    assert got(collocations(docs, longest=2, least=2, top=5)) == {("en", 1, "a a", 3, 4, 4, 4, 750), ("und", 1, "a a", 2, 4, 4, 4, 500)}


def test_tokens():
    assert [t for t in tokens("A\tb, c\n\x00é") if t] == [b"a", b"b", b"\n", b"c", b"\n", b"\x00\xc3\xa9"]
