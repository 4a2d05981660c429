"""Collocations: phrases of 2 to `longest` words found by hash-bucket counts (PCY, DHP) and Apriori pruning, then counted exactly.

Pass i over the texts counts phrases of i words and, of the phrases of i + 1 words that could be frequent, how many fall
into each of 2**BUCKETS hash buckets; a count stops at the least frequency, so a byte a bucket holds it. Between passes the
buckets that reach the least frequency become a bitmap, and so do the hashes of the frequent phrases of i words. Pass i + 1
looks at a place only if both phrases of i words in it are frequent by one bitmap and its bucket by the other. Both have a
fixed size, 2**BUCKETS and 2**MEMBERS bits (0.5 and 2 MB), and are all that is broadcast. With a bit set by chance a phrase
is counted that needn't be, so the result does not depend on hashes: counts are summed by the phrase itself.

A task numbers the words it meets, so that phrases in a chunk of text are told apart by exact numbers, and gives on one row
for each language, phrase and chunk; bucket counters leave a task as blocks and are added up block by block.

Frequencies of the parts of a phrase are joined by language and part, so no language is gathered in one task. A phrase is
dropped if a longer candidate is found as often: then so is one that is longer by one word, and only those are looked at.
The first phrases of each language come from lists that are cut in each of SALTS parts before they are merged.

Defined cases: null and empty texts have no words; a null language is `und`, and so is that language's own name; texts are
read whole; words are told apart by their bytes, after lower-casing A-Z; repeated rows count as often as they are there;
ties in rank go by frequency, then by the bytes of the phrase; no rows, or no frequent phrase: no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import Workspace

BUCKETS, MEMBERS = 22, 24
#: Buckets in a block.
BLOCK = 1 << 12
#: Words in a chunk, and different words that a task numbers before it starts anew.
CHUNK, WORDS = 1_000_000, 400_000
SALTS = 64
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_ODD = np.uint64(0xA0761D6478BD642F)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case, b"\\n" between pieces, and empty ones where white space is repeated."""
    return (text or "").encode().lower().translate(_ENDS).replace(b"\n", b" \n ").split(b" ")


class _Words(dict):
    """Numbers of words from 2 on, and their hashes; 0 is no word, 1 the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b"": 0, b"\n": 1})
        self.names, self.hashes = [b"", b"\n"], [0, 0]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


def hashes_of(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive word hashes (numbers of 64 bits)."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ (out >> np.uint64(29))) * _ODD + h[i : i + n]
        out = (out ^ (out >> np.uint64(32))) * _MIX
        return out ^ (out >> np.uint64(31))


def salted(lang: str, h: np.ndarray) -> np.ndarray:
    """Phrase hashes of a language."""
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))) * _MIX
        return h ^ (h >> np.uint64(32))


def _set(bits: np.ndarray, h: np.ndarray, power: int) -> np.ndarray:
    """Whether the bit of each hash is set in a bitmap of 2**power bits."""
    at = (h & np.uint64((1 << power) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _kind(least: int) -> type:
    """Of counters that stop at `least`."""
    return np.uint8 if least < 256 else np.int32


def _pass(size: int, least: int, members, buckets, more: bool):
    """Pass `size`: rows (lang, phrase, n, block, counts); either of a phrase, or of a block of the next pass's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, waiting = _Words(), {}, 0
        counters = np.zeros(1 << BUCKETS, np.int32) if more else None
        frequent = members.value if members else None
        possible = buckets.value if buckets else None

        def counted(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
            ids = np.concatenate(parts)
            h = np.array(numbers.hashes, np.uint64)[ids]
            n = max(0, len(ids) - size + 1)
            # Places where a phrase of this size lies within a piece.
            inner = np.concatenate([[0], np.cumsum(ids == 1)])
            whole = inner[size:][:n] == inner[:n]
            if size > 1:
                own = salted(lang, hashes_of(h, size - 1))
                yes = _set(frequent, own, MEMBERS)
                whole &= yes[:n] & yes[1:][:n] & _set(possible, salted(lang, hashes_of(h, size)), BUCKETS)
            if more:
                # Phrases of one word more whose two phrases of this size may be frequent, as far as is known before they are counted.
                longer = max(0, len(ids) - size)
                could = (inner[size + 1 :][:longer] == inner[:longer]) & whole[:-1][:longer] & whole[1:][:longer]
                np.add.at(counters, (salted(lang, hashes_of(h, size + 1)[could]) & np.uint64((1 << BUCKETS) - 1)).astype(np.int64), 1)
                np.minimum(counters, least, out=counters)
            at = np.flatnonzero(whole)
            key = ids[at]
            for i in range(1, size):  # exact numbers of phrases, word by word
                _, key = np.unique((key.astype(np.int64) << 32) | ids[at + i], return_inverse=True)
            _, first, times = np.unique(key, return_index=True, return_counts=True)
            name = numbers.names.__getitem__
            said = [b" ".join(map(name, ids[a : a + size].tolist())).decode() for a in at[first].tolist()]
            none = pa.nulls(len(said))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(said), pa.string()), pa.array(said, pa.string()), pa.array(times, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], ["lang", "phrase", "n", "block", "counts"])

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, numbers
            waiting = 0
            for lang, parts in held.items():
                yield counted(lang, parts)
            held.clear()
            if len(numbers) > WORDS:
                numbers = _Words()

        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("t"), strict=True):
                ids = np.fromiter(map(numbers.__getitem__, tokens(t.as_py())), np.int64)
                ids = ids[ids > 0]
                if len(ids):
                    held.setdefault(lang, []).extend((ids, np.ones(1, np.int64)))
                    waiting += len(ids)
                if waiting >= CHUNK:
                    yield from give()
        yield from give()
        if more:
            blocks = counters.astype(_kind(least)).reshape(-1, BLOCK)
            some = np.flatnonzero(blocks.any(1))
            none = pa.nulls(len(some))
            yield pa.RecordBatch.from_arrays([none.cast(pa.string()), none.cast(pa.string()), none.cast(pa.int64()), pa.array(some.astype(np.int32)), pa.array([r.tobytes() for r in blocks[some]], pa.binary())], ["lang", "phrase", "n", "block", "counts"])

    return run


def _added(least: int):
    """Over blocks of counters, those of one block in one partition: one row for each block, of its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column("block").to_pylist(), b.column("counts"), strict=True):
                now = np.frombuffer(counts.as_buffer(), _kind(least)).astype(np.int64)
                total[block] = np.minimum(total.get(block, 0) + now, least)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in total.values()], pa.binary())], ["block", "bits"])

    return run


def _members(size: int, least: int):
    """Rows (lang, phrase) into blocks of counters that are full where a phrase's hash is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(1 << MEMBERS, _kind(least))
        for b in batches:
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True):
                h = np.array([xxhash.xxh3_64_intdigest(w) for w in phrase.encode().split(b" ")], np.uint64)
                full[int(salted(lang, hashes_of(h, size))[0]) & ((1 << MEMBERS) - 1)] = least
        blocks = full.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([r.tobytes() for r in blocks[some]], pa.binary())], ["block", "counts"])

    return run


def _bitmap(blocks: DataFrame, power: int, least: int):
    """The broadcast bitmap of 2**power bits over blocks (block, counts) of any tasks; it comes to the driver as one row a block."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = np.zeros((1 << power) // 8, np.uint8)
    for r in blocks.repartition(parts, "block").mapInArrow(_added(least), "block int, bits binary").collect():
        bits[r.block * (BLOCK // 8) : (r.block + 1) * (BLOCK // 8)] = np.frombuffer(r.bits, np.uint8)
    return blocks.sparkSession.sparkContext.broadcast(bits)


def counts(docs: DataFrame, space: Workspace, text: str, lang: str, longest: int, least: int) -> tuple[list[DataFrame], DataFrame]:
    """((lang, phrase, f) of all phrases of 1, 2, ... words found `least` times and more, (lang, n) all words)."""
    given = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("t"))
    found, words, members, buckets = [], None, None, None
    for size in range(1, longest + 1):
        made = space.write(given.mapInArrow(_pass(size, least, members, buckets, size < longest), "lang string, phrase string, n long, block int, counts binary"), f"pass{size}")
        by = made.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if size == 1:
            words = space.write(made.where("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        found.append(space.write(by.where(F.col("f") >= least), f"frequent{size}"))
        for held in (members, buckets):
            if held:
                held.destroy()
        if size < longest:
            buckets = _bitmap(made.where("block IS NOT NULL").select("block", "counts"), BUCKETS, least)
            members = _bitmap(found[-1].select("lang", "phrase").mapInArrow(_members(size, least), "block int, counts binary"), MEMBERS, least)
        space.drop(f"pass{size}")
        space.free()
    return found, words


def _part(phrase: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(phrase, first, n), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by their lowest-scoring cut.

    a: how often the phrase is found; l and r: how often its two parts are; n: all words of the language. The score of a cut
    is floor(1000 * a * n / (l * r)), in exact decimals; ties go to the earlier cut.
    """
    space = Workspace(docs.sparkSession, "phrases")
    found, words = counts(docs, space, text, lang, longest, least)
    every = reduce(DataFrame.unionByName, found)
    phrases = reduce(DataFrame.unionByName, found[1:])
    split = F.split("phrase", " ", -1)
    # A candidate that is found as often as one that is longer by a word lies in it wherever it is.
    longer = phrases.select("lang", split.alias("w"), "f").where(F.size("w") > 2)
    inside = longer.select("lang", "f", F.explode(F.array(_part(F.col("w"), F.lit(1), F.size("w") - 1), _part(F.col("w"), F.lit(2), F.size("w") - 1))).alias("phrase")).distinct()
    kept = space.write(phrases.join(inside.hint("merge"), ["lang", "phrase", "f"], "left_anti"), "kept")
    cuts = kept.select("lang", "phrase", "f", split.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "f", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("first"), _part(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    side = lambda name, f: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(f)).hint("merge")
    exact = lambda c: F.col(c).cast("decimal(17,0)")
    both = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(words, "lang")
    both = both.select("lang", "phrase", "f", "k", "l", "r", "n", (F.lit(1000).cast("decimal(4,0)") * exact("f") * exact("n")).alias("over"), (exact("l") * exact("r")).alias("under"))
    scored = both.select("lang", "phrase", "f", "n", F.struct(F.expr("over div under").alias("score"), "k", "l", "r").alias("cut"))
    best = scored.groupBy("lang", "phrase", "f", "n").agg(F.min("cut").alias("cut"))
    row = best.select("lang", F.struct((-F.col("cut.score")).alias("neg"), (-F.col("f")).alias("less"), "phrase", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n").alias("row"))
    row = space.write(row, "scored")
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("row.phrase"), F.lit(SALTS))).orderBy("row")
    ahead = row.withColumn("i", F.row_number().over(part)).where(F.col("i") <= top)
    out = ahead.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list("row")), 1, top).alias("rows")).select("lang", F.posexplode("rows").alias("i", "row"))
    space.drop("kept", *[f"frequent{i}" for i in range(1, longest + 1)])
    return out.select("lang", (F.col("i") + 1).cast("long").alias("rank"), "row.phrase", (-F.col("row.less")).alias("a"), "row.l", "row.r", "row.n", (-F.col("row.neg")).alias("score"))
