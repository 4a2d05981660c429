import math
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from lexforge.llm import queries
from lexforge.llm.mixing import STEPS, bisect_exponent, mixed
from tests.llm.fixtures import SF, no_docs, odd_docs


def brute_exponent(tokens, repetition):
    """Smallest exponent within the limit, by a fine grid."""
    total = sum(tokens)
    for i in range(100_001):
        a = i / 100_000
        q = [(t / total) ** (a - 1) for t in tokens]
        if max(q) / min(q) <= repetition + 1e-9:
            return a
    return 1.0


@pytest.mark.parametrize("tokens,repetition", [([100, 10, 1], 2.0), ([5, 5], 2.0), ([1000, 1], 1.5), ([7], 3.0)])
def test_repetition_limit(spark, tokens, repetition):
    shares = spark.createDataFrame([(t / sum(tokens),) for t in tokens], "share double")
    assert bisect_exponent(shares, repetition=repetition) == pytest.approx(brute_exponent(tokens, repetition), abs=2e-5)


def test_target_entropy(spark):
    p = [0.7, 0.2, 0.1]
    shares = spark.createDataFrame([(x,) for x in p], "share double")
    a = bisect_exponent(shares, entropy=0.5)
    q = [x**a for x in p]
    got = -sum(x / sum(q) * math.log(x / sum(q)) for x in q)
    found = -sum(x * math.log(x) for x in p)
    assert got == pytest.approx((found + math.log(3)) / 2, abs=1e-6)


def check(rows, repetition):
    tokens, mix, docs = Counter(), Counter(), defaultdict(list)
    for r in rows:
        mix[r.source] += r.n_tokens
        docs[(r.source, r.doc_id)].append(r.copy)
        tokens[r.source] += r.n_tokens * (r.copy == 0)
    for copies in docs.values():
        assert sorted(copies) == list(range(len(copies)))
    a = brute_exponent([t for t in tokens.values() if t], repetition)
    largest = max(tokens.values())
    for s, t in tokens.items():
        target = t**a * largest ** (1 - a)
        longest = max((r.n_tokens for r in rows if r.source == s), default=0)
        assert target - longest - 1e-3 * largest - 2 <= mix[s] <= target + 1e-3 * largest + 2


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op2_temperature_mixing(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    check(rows, 2.0)
    assert {r.block for r in rows} <= set(range(64))


def test_budget_and_odd_documents(spark):
    docs = odd_docs(spark)
    rows = mixed(docs).collect()
    assert len(rows) >= docs.count()
    assert Counter((r.doc_id, r.text) for r in rows if r["copy"] == 0) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert mixed(no_docs(spark)).count() == 0
    even = spark.range(300).selectExpr("id AS doc_id", "CASE WHEN id < 200 THEN 'a' ELSE 'b' END AS source", "'one two three four' AS text")
    got = Counter(r.source for r in mixed(even, repetition=1000.0, budget=400).collect())
    assert got == {"a": 50, "b": 50}


def hashed(*values) -> int:
    """xxhash64 over a long and then ints, as a signed number."""
    seed = 42
    for kind, v in zip("qiii", values, strict=False):
        seed = xxhash.xxh64_intdigest(struct.pack(f"<{kind}", v), seed & ((1 << 64) - 1))
    return seed - (1 << 64) if seed >> 63 else seed


def by_hand(rows, repetition, blocks):
    """(doc_id, copy, block, block_order) of (doc_id, source, tokens), over plain lists: budgets, permutations and cuts as the module states them."""
    tokens = Counter()
    for _, s, n in rows:
        tokens[s] += n
    total = sum(tokens.values())
    share = [t / total for t in tokens.values() if t]
    even = lambda x: max((p**x) / p for p in share) / min((p**x) / p for p in share) > repetition
    low, high = 0, STEPS
    while high - low > 1:
        low, high = ((low + high) // 2, high) if even((low + high) // 2 / STEPS) else (low, (low + high) // 2)
    a = high / STEPS if even(0.0) else 0.0
    q = {s: (t / total) ** a if t else 0.0 for s, t in tokens.items()}
    cover = max(t / q[s] for s, t in tokens.items() if t)
    out = set()
    for s, t in tokens.items():
        target = math.floor(q[s] * cover + 0.5)
        passes = target // t if t else 1
        rest = target - passes * t if t else 0
        at = 0
        for h, d, n in sorted((hashed(d, 7) & ((1 << 64) - 1), d, n) for d, source, n in rows if source == s):
            signed = h - (1 << 64) if h >> 63 else h
            for copy in range(passes + (rest > 0 and at + n <= rest)):
                block = min(blocks - 1, math.floor((copy * t + at) / max(target, 1) * blocks))
                out.add((d, copy, block, hashed(signed, copy)))
            at += n
    return out


def test_query_by_hand(spark):
    docs = [(r.doc_id, r.source, len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op2_temperature_mixing(spark, SF).collect()
    assert {(r.doc_id, r.copy, r.block, r.block_order) for r in got} == by_hand(docs, 2.0, 64)
    assert {(r.doc_id, r.source, r.n_tokens) for r in got} == set(docs)
    # Blocks are as equal as documents allow: none is off its share by more than a document of each source at either end.
    sizes, longest = Counter(), Counter()
    for r in got:
        sizes[r.block] += r.n_tokens
    for _, s, n in docs:
        longest[s] = max(longest[s], n)
    mean = sum(sizes.values()) / 64
    assert all(abs(sizes[b] - mean) <= 2 * sum(longest.values()) for b in range(64))
