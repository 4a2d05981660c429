import re
import struct
import zlib
from collections import defaultdict

import xxhash

from lexforge.llm import queries, shards
from lexforge.llm.shards import balanced
from tests.llm.fixtures import SF, no_docs, odd_docs


def check(rows, shards):
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) <= set(range(shards))
    return sizes


def test_odd_documents(spark):
    docs = odd_docs(spark)
    rows = balanced(docs, shards=3).collect()
    assert len(rows) == docs.count()
    check(rows, 3)
    sizes = {r.doc_id: r for r in rows}
    assert sizes[0].size == 1 and sizes[0].text_crc32 == 0
    assert balanced(no_docs(spark)).count() == 0


def test_balance_and_groups(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot text' WHEN id % 3 = 1 THEN concat('group ', id % 100) ELSE repeat(concat('t', id, ' '), 3) END AS text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = balanced(docs, shards=8).collect()
    sizes = check(rows, 8)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(sizes.values()) < 1.03 * mean and min(sizes.values()) > 0.97 * mean
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert [t for t, s in where.items() if len(s) > 1] == ["hot text"]  # more than half a shard: it can't stay whole


def test_a_giant_group_of_one_id_is_cut(spark):
    """Copies without an id of their own are units each, so the law holds also for them."""
    docs = spark.range(900).selectExpr("CASE WHEN id % 2 = 0 THEN 7 END AS doc_id", "'same text' AS text").union(spark.range(300).selectExpr("id", "concat('text ', id)"))
    sizes = check(balanced(docs, shards=4).collect(), 4)
    assert max(sizes.values()) < 1.15 * sum(sizes.values()) / 4


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op5_byte_shards(spark, SF)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    rows = got.collect()
    sizes = check(rows, 16)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(sizes.values()) < 1.2 * mean and min(sizes.values()) > 0.8 * mean
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def hashed(*values) -> int:
    """xxhash64 over longs and texts, each seeded by the one before."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed & ((1 << 64) - 1))
    return seed


def by_hand(texts, shards, fine):
    """The shard of each text, by the law as the module states it, over plain lists."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[signed(hashed(t)), zlib.crc32(t.encode()), len(t.encode()) + 1].append(i)
    total, n = sum(k[2] * len(g) for k, g in groups.items()), len(texts)
    target = total / shards
    size = {k: k[2] * len(g) for k, g in groups.items()}
    giant = {k for k, g in groups.items() if 2 * size[k] > target and len(g) > 1}
    large = sorted((k for k, g in groups.items() if len(g) > 1 and k not in giant and (size[k] * fine > total or len(g) * fine > n)), key=lambda k: (-size[k], k))
    out, used = {}, [0] * shards
    for rank, k in enumerate(large):
        turn = rank % (2 * shards)
        shard = turn if turn < shards else 2 * shards - 1 - turn
        used[shard] += size[k]
        out |= dict.fromkeys(groups[k], shard)
    room = [max(0.0, target - u) for u in used]
    ends = [sum(room[: i + 1]) * (total - sum(used)) / sum(room) for i in range(shards)]
    assert not giant  # their units hang on the numbers of rows
    at = 0
    for unit, k in sorted((hashed(*k), k) for k in groups if k not in set(large)):
        middle = at + size[k] / 2
        at += size[k]
        out |= dict.fromkeys(groups[k], min(shards - 1, sum(middle >= e for e in ends[:-1])))
    return [out[i] for i in range(n)]


def test_the_cut_is_the_law(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = queries.op5_byte_shards(spark, SF).orderBy("doc_id").collect()
    assert [r.shard for r in got] == by_hand([r.text for r in docs], 16, shards.FINE)
    texts = [f"text {i % 700} " * (1 + i % 9) for i in range(2000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [r.shard for r in balanced(frame, shards=5).orderBy("doc_id").collect()] == by_hand(texts, 5, shards.FINE)
