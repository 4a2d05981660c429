import re

import numpy as np
import pytest
import xxhash

from lexforge.llm import queries
from lexforge.llm.common import Workspace
from lexforge.llm.simhash import classes, deduplicated, linked, links, orders_of
from tests.llm.fixtures import SF, no_docs, odd_docs, odd_texts


def brute_print(text, k=4):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=4, k=4):
    """Fingerprint and smallest id reachable, for (id, text) rows."""
    prints = [brute_print(t, k) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if label[a] > label[b] and (prints[a] ^ prints[b]).bit_count() <= distance:
                    label[a], changed = label[b], True
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return sorted(((i, p, least.get(x)) for (i, _), p, x in zip(rows, prints, label, strict=True)), key=repr)


def gray(f):
    f = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        f ^= f >> np.uint64(s)
    return f


@pytest.mark.parametrize("n,m,distance,words", [(37, 900, 4, 1), (400, 300, 9, 1), (3, 1, 4, 1), (1, 1, 0, 2), (1100, 70, 4, 1), (300, 500, 20, 2)])
def test_index_finds_all_links(n, m, distance, words):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, (40, words), dtype=np.uint64)

    def some(k):
        x = np.unique(np.array([base[rng.integers(40)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (rng.integers(1, 5), words)).astype(np.uint64), axis=0) for _ in range(k)], np.uint64), axis=0)
        return x[np.argsort(gray(x[:, 0]), kind="stable")]

    a, b = some(n), some(m)
    apart = lambda x, y: sum((int(p) ^ int(q)).bit_count() for p, q in zip(x, y, strict=True))
    pairs = lambda x, y, same: {(int(i), int(j)) for p, q in links(x, y, distance, same) for i, j in zip(p, q, strict=True)}
    assert pairs(a, b, False) == {(i, j) for i in range(len(a)) for j in range(len(b)) if apart(a[i], b[j]) <= distance}
    assert pairs(a, a, True) == {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if apart(a[i], a[j]) <= distance}


@pytest.mark.parametrize("count", [1, 5000, 10**6, 10**9, 10**13])
def test_every_link_has_an_order(count):
    """Exact orders: whatever four bits differ, some order has none of them in its prefix."""
    prefix, orders = orders_of(count, 64, 4)
    leads = [set(o[:prefix]) for o in orders]
    assert all(sorted(o) == list(range(64)) for o in orders)
    rng = np.random.default_rng(5)
    for _ in range(500):
        wrong = set(rng.choice(64, 4, replace=False).tolist())
        assert any(not lead & wrong for lead in leads)


def test_small_regions_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r.component_id for r in classes(docs).collect()}
    assert {r.doc_id: r.component_id for r in classes(docs, region=7).collect()} == whole
    one_bucket = spark.range(300).selectExpr("id AS doc_id", "concat('a b c ', id % 3) AS text").union(spark.range(300, 600).selectExpr("id AS doc_id", "concat('x', id) AS text"))
    rows = sorted((r.doc_id, r.text) for r in one_bucket.collect())
    assert sorted((r.doc_id, r.component_id) for r in classes(one_bucket, region=4).collect()) == sorted((i, c) for i, _, c in brute(rows))


def near(rng, words, similarity):
    """A text with about this Jaccard similarity of five-word shingles: words are replaced one by one, each taking five shingles."""
    n = len(words) - 4
    out, at = list(words), int(round(n * (1 - similarity) / (1 + similarity) / 5))
    for i in rng.choice(n // 5 - 1, at, replace=False):
        out[int(i) * 5 + 4] = f"n{rng.integers(1 << 40)}"
    return out


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a, b))
    return len(a & b) / len(a | b)


def test_recall_at_the_wanted_similarity(spark):
    """Pairs just above 0.8 are found, also through many small regions; pairs well below and strangers stay apart."""
    rng = np.random.default_rng(11)
    texts = []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 400))]
        texts += [words, near(rng, words, 0.83 if i % 2 else 0.6)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {i for i in range(0, 800, 2) if jaccard(texts[i], texts[i + 1]) >= 0.8}
    assert len(want) > 150
    for region in (4096, 64):
        found = {r.doc_id: r.component_id for r in classes(docs, shingle=5, distance=None, verify=0.8, words=2, region=region).collect()}
        linked = {i for i in range(0, 800, 2) if found[i] == found[i + 1]}
        assert linked <= want and len(linked) >= 0.95 * len(want)
        assert all(found[i] in (i, i - i % 2) for i in found)


def test_equal_fingerprints_of_different_texts_stay_apart(spark):
    """At a distance of all bits every pair is a candidate; only the texts decide."""
    docs = spark.createDataFrame([(0, "a b c d e f"), (1, "A b c  d e f"), (2, "u v w x y z"), (3, ""), (4, None), (5, "one")], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in classes(docs, shingle=5, distance=64, verify=0.8).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}


def test_odd_documents(spark):
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in classes(odd_docs(spark)).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in odd_texts()])
    assert classes(no_docs(spark)).count() == 0 and deduplicated(no_docs(spark)).count() == 0


def brute_near(texts, least=0.8, k=5):
    """Smallest place reachable over pairs of texts that share the part `least` of their shingles (lower case, sets)."""
    words = [[x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x] for t in texts]
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * max(1, len(sets[a] | sets[b])) or not sets[a] and not sets[b]:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return [root(i) for i in range(len(texts))]


def test_one_of_each_group_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = deduplicated(docs, shingle=5, distance=None, verify=0.8, words=2)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {rows[i][0] for i in brute_near([t for _, t in rows])}
    twice = deduplicated(docs.union(docs))
    assert twice.count() == len({c for _, _, c in brute(rows)})
    odd = odd_docs(spark)
    kept = deduplicated(odd, shingle=5, distance=None, verify=0.8, words=2)
    assert kept.columns == odd.columns and kept.count() == len(set(brute_near([r[1] for r in odd_texts()])))


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op4_simhash(spark, SF).collect()), key=repr)
    assert got == brute(rows)


def test_chance_neighbours_hide_no_copies(spark):
    """Families of a text, a copy of it and half-alike texts, all within the distance: only links that the check confirms join."""
    rng = np.random.default_rng(3)
    texts = []
    for family in range(12):
        base = [f"w{family}x{i}" for i in range(120)]
        for changed in (1, 30, 45, 0, 60):
            at = set(rng.choice(60, changed, replace=False).tolist()) if changed else set()
            texts.append(" ".join(f"v{len(texts)}y{i}" if i in at else w for i, w in enumerate(base)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    prints = [brute_print(t, 5) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 24 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = classes(docs, shingle=5, distance=24, verify=0.8).orderBy("doc_id").collect()
    assert len(set(label)) < len(texts) and [r.component_id for r in found] == label


def test_heavy_edits_of_one_text(spark):
    """A large group of copies of one text, many of them edited too much to be alike: few pairs are left to check, and none is lost."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(160):
        words = list(base)
        for at in rng.choice(150, i % 8, replace=False):
            words[int(at)] = f"x{i}y{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for region in (4096, 16):
        found = [r.component_id for r in classes(docs, shingle=5, distance=None, verify=0.8, words=2, region=region).orderBy("doc_id").collect()]
        assert found == brute_near(texts)


def test_a_small_group_is_one_region(spark, tmp_path):
    """However many partitions are set: regions of a few rows would be compared in pairs with a forest each."""
    rng = np.random.default_rng(4)
    prints = np.unique([np.bitwise_or.reduce(1 << rng.choice(63, 2)) for _ in range(300)]).tolist()
    nodes = spark.createDataFrame([(i, int(f)) for i, f in enumerate(prints)], "node long, f0 long")
    nodes.write.parquet(f"{tmp_path}/nodes")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        space = Workspace(spark, "few")
        found = [(r.u, r.v) for r in linked(spark.read.parquet(f"{tmp_path}/nodes"), space).collect()]
        regions = spark.read.parquet(space.path("regions")).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert regions == 1 and len(found) == len(prints) - 1
