import hashlib
import json
import re
import shutil
import time
from collections import Counter
from functools import partialmethod

import pytest
import xxhash
from pyspark.sql import functions as F

from lexforge.llm import queries, substring
from lexforge.llm.substring import FingerprintIndex, remove
from tests.llm.fixtures import SF, no_docs, odd_docs, odd_texts, prose


def brute(texts, size=35):
    docs = [[x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x] for t in texts]
    found = Counter(tuple(w[i : i + size]) for w in docs for i in range(len(w) - size + 1))
    out = []
    for w in docs:
        gone = {j for i in range(len(w) - size + 1) if found[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_odd_documents(spark):
    texts = [r[1] for r in odd_texts()]
    want = sorted((r[0] is None, r[0] or 0, *b[:3]) for r, b in zip(odd_texts(), brute(texts), strict=True))
    got = remove(odd_docs(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    for r in got:
        assert r.text in texts if not r.n_removed else hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
    assert remove(no_docs(spark)).count() == 0


def test_small_windows(spark):
    texts = ["a b a b a b", "b a b", "c", "a", "x y z", "x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (1, 2, 3):
        got = [(r.n_words, r.n_removed, r.kept_sha256, r.text if r.n_removed else None) for r in remove(docs, window=size, gram=2).orderBy("doc_id").collect()]
        assert [g[:3] for g in got] == [b[:3] for b in brute(texts, size)]


def test_three_batches_are_one(spark, tmp_path):
    """Batches in three calls, the index opened anew before each: each call sees all earlier ones, and all together is as at once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    seen = []
    for i in range(3):
        index = FingerprintIndex(spark, f"file://{tmp_path}/index", window=20, gram=7)
        assert index.state["batches"] == i and len(index.state["anchors"]) <= 2
        batch = docs.where(F.col("doc_id") % 3 == i)
        got = remove(batch, index=index).orderBy("doc_id").collect()
        seen += [r.doc_id for r in got]
        want = dict(zip(seen, brute([texts[d] for d in seen], 20), strict=True))
        assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == [want[r.doc_id][:3] for r in got]
        index.close()
    index = FingerprintIndex(spark, f"file://{tmp_path}/index")
    got = index.cut(docs).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == [b[:3] for b in brute(texts, 20)]
    index.close()


class Lost(Exception):
    pass


def test_a_lost_driver_leaves_the_index_whole(spark, tmp_path, monkeypatch):
    """The driver is lost after each single write or deletion of the third batch; the index is then that of two batches or of three."""
    shared = [prose(i, 30) for i in range(4)]
    texts = [f"{prose(10 + i, 25)} {shared[i % 4]} {prose(50 + i, 20 + i)}" for i in range(18)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = lambda i: docs.where(F.col("doc_id") % 3 == i)
    base, want = tmp_path / "base", {i: b[:3] for i, b in enumerate(brute(texts, 20))}
    for i in range(2):
        index = FingerprintIndex(spark, f"file://{base}", window=20, gram=7)
        remove(of(i), index=index).count()
        index.close()
    steps = ("_run", "_plain", "_commit", "_sweep")
    originals = {s: getattr(FingerprintIndex, s) for s in steps}
    k, whole = 0, False
    while not whole:
        path, seen, inside = tmp_path / f"copy{k}", [0], [False]
        shutil.copytree(base, path)
        index = FingerprintIndex(spark, f"file://{path}")

        def step(self, *args, _of, **kwargs):
            out = originals[_of](self, *args, **kwargs)
            if inside[0]:
                seen[0] += 1
                if seen[0] > k:
                    raise Lost
            return out

        for s in steps:
            monkeypatch.setattr(FingerprintIndex, s, partialmethod(step, _of=s))
        inside[0] = True
        try:
            index.take(of(2).select(F.col("doc_id").alias("key"), F.col("text").alias("t")))
            whole = True
        except Lost:
            pass
        monkeypatch.undo()
        index.close()
        again = FingerprintIndex(spark, f"file://{path}")
        left = {*again._held(), *(f"state-{i + 1}" for i in range(again.state["batches"]))}
        assert {x.name for x in path.iterdir()} == left
        if again.state["batches"] == 2:
            got = remove(of(2), index=again).collect()
            assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: w for i, w in want.items() if i % 3 == 2}
        else:
            assert again.state["batches"] == 3 and {r.key for r in again.starts(3).collect()} == {i for i, w in want.items() if i % 3 == 2 and w[1]}
        again.close()
        k += 1
    assert k > 5
    for name in [n for n in json.loads((path / "state-3").glob("part-*").__next__().read_text())["tables"] if n.startswith("windows")][:1]:
        shutil.rmtree(path / name)
    with pytest.raises(FileNotFoundError, match="lacks windows"):
        FingerprintIndex(spark, f"file://{path}")


def test_runs_are_merged_by_size(spark):
    index = FingerprintIndex(spark, None, window=4, gram=2)
    for i, n in enumerate((400, 90, 30, 12, 300)):
        index.take(spark.createDataFrame([(i, prose(i, n))], "key long, t string"))
        sizes = [r["rows"] for r in index.state["anchors"]]
        assert all(a >= 1.5 * b for a, b in zip(sizes, sizes[1:], strict=False)), sizes
    assert index.state["batches"] == 5 and len(sizes) < 5
    index.close()


def test_batches_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0")
    rows = lambda **a: sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in remove(docs, window=12, gram=5, with_text=False, **a).collect())
    assert rows(batches=1) == rows(batches=4)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = queries.op3_substring_dedup(spark, SF).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == [b[:3] for b in brute([r.text for r in rows])]


def test_word_hashes():
    """Each word's two hashes, also when the table grows within a text; a task that ends leaves no table behind."""
    words = [f"w{i % 9000}".encode() for i in range(20_000)]
    both = [divmod(xxhash.xxh3_128_intdigest(w), 1 << 64) for w in words]
    for _ in range(2):
        assert substring.word_hashes(words).T.tolist() == [[low, high] for high, low in both]
        assert substring.word_hashes([]).shape == (2, 0) and substring._hashes.of.shape[1] >= 9000
        substring.forget()
        assert not substring._hashes and substring._hashes.of.nbytes <= 1 << 16


def test_hashing_costs_little_more_than_the_hash_itself():
    """Words that are seldom seen again: a table of hashes, filled word by word, took over five times as long as hashing them."""
    texts = [[f"{i}-{j}".encode() for j in range(500)] for i in range(200)]

    def seconds(f):
        took = []
        for _ in range(5):
            substring.forget()
            began = time.process_time()
            for words in texts:
                f(words)
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(substring.word_hashes) < 3 * seconds(lambda words: b"".join(map(xxhash.xxh3_128_digest, words)))


def test_word_hashes_of_text_after_text():
    """Long and short texts in turn share the room; each gets its own hashes."""
    for n in (3, 9000, 0, 5, 9001, 1):
        words = [f"{n}:{i}".encode() for i in range(n)]
        want = [[x & ((1 << 64) - 1), x >> 64] for x in map(xxhash.xxh3_128_intdigest, words)]
        assert substring.word_hashes(words).T.tolist() == want and len(substring._hashes) == n


def test_starts_come_as_bitmaps(spark):
    """Places in blocks of 64, at most two bitmaps a block, the last bit of a block included; before, a list of every place."""
    shared = prose(1, 400)
    texts = [f"{prose(2, 70)} {shared}", f"{shared} {prose(3, 90)}", prose(4, 100)]
    index = FingerprintIndex(spark, None, window=20, gram=7)
    index.take(spark.createDataFrame(list(enumerate(texts)), "key long, t string"))
    got = {r.key: r.starts for r in index.starts().collect()}
    index.close()
    want = {0: set(range(70, 451)), 1: set(range(381))}
    assert {k: {x.block * 64 + i for x in s for i in range(64) if x.bits >> i & 1} for k, s in got.items()} == want
    assert all(len(s) <= 2 * 7 for s in got.values())
    for k, s in got.items():
        rows = substring.pa.array([(x.block, x.bits) for x in s], substring.pa.struct([("block", "int32"), ("bits", "int64")]))
        assert set(substring._places(rows).tolist()) == want[k] and set(substring._places(rows[1:]).tolist()) < want[k]
