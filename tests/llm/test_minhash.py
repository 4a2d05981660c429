import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import minhash, queries
from lexforge.llm.minhash import classes, common_counts, floor_of
from tests.llm.fixtures import SF, no_docs, odd_docs, odd_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, shingle=2):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
        out.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set()))
    return out


def brute(ids, texts, shingle=2, percent=80):
    """(n_shingles, component) of each text, over all pairs that share a shingle."""
    sets, root = sets_of(texts, shingle), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = {}
    for i, s in enumerate(sets):
        near = set().union(*(having.get(g, ()) for g in s))
        for j in near:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            having.setdefault(g, set()).add(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(len(s), least.get(find(i))) for i, s in enumerate(sets)]


def edited(seed: int, copies: int, words: int, most: int, vocabulary: int = 60) -> list[str]:
    """Copies of one text, each with up to `most` words changed."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(r.randint(0, most)):
            text[r.randrange(words)] = f"e{r.randrange(vocabulary)}"
        out.append(" ".join(text))
    return out


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = brute([r.doc_id for r in rows], [r.text for r in rows])
    got = queries.op11_minhash(spark, SF).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_documents(spark):
    rows = odd_texts()
    want = brute([r[0] for r in rows], [r[1] for r in rows])
    got = classes(odd_docs(spark)).collect()
    key = lambda d, n, c: (d is None, d or 0, n, c is None, c or 0)
    assert sorted(key(*r) for r in got) == sorted(key(r[0], *w) for r, w in zip(rows, want, strict=True))
    assert classes(no_docs(spark)).count() == 0


@pytest.mark.parametrize("short,region", [(16, 256), (2, 40)])
def test_large_groups(spark, monkeypatch, short, region):
    """Groups of edited copies, many of which are no links of their hub's, in lists longer than short ones and over several regions."""
    monkeypatch.setattr(minhash, "SHORT", short)
    monkeypatch.setattr(minhash, "REGION_ROWS", region)
    texts = edited(1, 300, 120, 14) + edited(2, 150, 40, 5) + edited(3, 30, 400, 40) + edited(4, 60, 12, 2) + ["the same line of words"] * 40
    random.Random(5).shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [(r.n_shingles, r.component_id) for r in classes(docs).orderBy("doc_id").collect()]
    assert got == brute(range(len(texts)), texts)
    assert len({c for _, c in got}) > 20


def test_other_similarities_and_sketches(spark):
    texts = edited(7, 80, 60, 20) + edited(8, 80, 30, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for shingle, percent, k in ((1, 60, 128), (3, 90, 32)):
        got = [(r.n_shingles, r.component_id) for r in classes(docs, shingle=shingle, percent=percent, k=k).orderBy("doc_id").collect()]
        assert got == brute(range(len(texts)), texts, shingle, percent)


def test_common_counts():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 9000, r.integers(0, 6000))) for _ in range(12)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (common_counts(sets[:5], sets[5:]) == want[:5, 5:]).all()
    got = common_counts(sets, None)
    off = ~np.eye(len(sets), dtype=bool)
    assert (got[off] == want[off]).all()


def test_floor():
    assert floor_of(64, 80) == 34 and floor_of(4, 100) == 4


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "one two three"), ("a", "One two  three"), (None, "one two three"), ("c", None)], "doc_id string, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in classes(docs).collect()}
    assert got == {("b", 2, "a"), ("a", 2, "a"), (None, 2, "a"), ("c", 0, "c")}
    assert classes(docs.where(F.col("doc_id").isNull())).first().component_id is None


def test_regions_are_full_and_meet_in_waves(spark, monkeypatch):
    """A large group of texts that are not alike: as few regions as hold it, however many partitions are set, and no more pairs at once than the bound allows."""
    monkeypatch.setattr(minhash, "REGION_ROWS", 40)
    monkeypatch.setattr(minhash, "WAVE_BYTES", 1 << 16)
    monkeypatch.setattr(minhash, "WAVE_TIMES", 0)
    seen, write = {}, minhash.Workspace.write
    monkeypatch.setattr(minhash.Workspace, "write", lambda self, df, name, *a: seen.setdefault(name, write(self, df, name, *a).cache()))
    texts = edited(1, 300, 120, 14, 10**6) + edited(6, 100, 120, 40, 10**6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    run = minhash._Run(docs, "doc_id", "text", 2, 64, 80)
    try:
        prints = run.prints.where("n > 0")
        open_ = prints.select(F.lit(7).cast("long").alias("value"), F.col("key").alias("node"), "n", F.col("key").alias("root"), F.lit(400).cast("long").alias("members"))
        found = {(r.u, r.v) for r in run.long(open_).collect()}
        regions = seen["regions"].count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert regions <= 400 / 40 + 2
    assert sum(n.startswith("long-links") for n in seen) > 3
    sets = sets_of(texts)
    alike = {(a, b) for b in range(400) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert found <= alike and components_of(found, 400) == components_of(alike, 400)


def components_of(links, n):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_waves_bound_what_is_copied():
    for pairs, regions in ((0, 1), (170, 24), (24_000, 220), (500_000, 1000)):
        weight = regions * (1 << 20)
        waves = minhash._Run.waves(pairs, regions, weight)
        assert 2 * pairs * (1 << 20) <= waves * max(2 * weight, 128 << 20)
