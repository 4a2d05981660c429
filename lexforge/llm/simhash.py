"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: 64 bits from the XXH64 hashes (seed 42) of all word shingles of a text, or a multiple of 64 bits, the
further words from mixed hashes. Equal ones are gathered first, with map-side counts. An order of the index is a
permutation of the bits: fingerprints are sorted by the Gray rank of the permuted bits (neighbours differ in few bits),
and those with the same first `prefix` bits form a bucket. A bucket is cut into regions of at most `REGION_ROWS`
fingerprints, however large it is. In a region fingerprints form a tree with `FAN` children to a node: a node holds the
mask of the bits in which all its fingerprints agree and their pattern there. Regions of a bucket are compared by walking
both trees at once: the differences in commonly fixed bits add up, word by word and from node to child, and a pair of
nodes beyond the distance is dropped with all that is under it. Pairs of whole regions are dropped in the same way by
their summaries, in a join. So no task holds more than two regions, whatever the number of documents.

The prefix grows with the logarithm of the number of fingerprints, so that a bucket has about a region of chance members.
Which orders there are makes the prefix safe:

- exact (`similarity` not given): the bits are cut into s blocks and each order leads with another choice of s - distance
  of them. Two fingerprints within the distance agree wholly in one such choice, so no link is lost at any size.
- by similarity: each order leads with other bits, and there are so many that texts of just this similarity meet in one
  of them with the probability `MEET` at least; the distance is that which they keep with the probability `WITHIN`.

A pair of regions gives a spanning forest of its links (at most one row per fingerprint), never all pairs of a group of
copies. Where links are checked by the texts (`verify`), nodes are different texts, not fingerprints, and the forest is
only a first pass: a refuted link in it may stand for a true one. So components with a refuted link are walked once more,
and every link between two parts of them that the confirmed links leave apart is checked; within a part no link can
change anything. Of these a pair can reach the similarity only if it could with all shingles that its texts share with
any text of those components, which is known from counts. The others are compared where they meet, in the task that has
their regions, which then hold the sets of shingles too; once a link joins two parts, the task skips their other pairs. So
only confirmed links leave it, never all pairs of a large group of edited copies. Components come from the forests by
repeated hooking to the smallest label, in Spark, with a written table each round.

Defined cases: null, empty or blank text: fingerprint zero, linked like any other; fewer words than a shingle: the
whole sequence is one; texts are read whole; repeated rows share a fingerprint and a component; a null doc_id is left
out of the choice of the smallest; no rows: no rows; ties do not arise, as a component is a set; other columns, whatever
their names, pass through `deduplicated`.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import Workspace, free_name, keyed

REGION_ROWS = 4096
FAN = 32
#: Regions that a task packs at least, if there are so many, and those with sets: a task's last region isn't full, but is compared with as many others, and each pair has a forest.
PACKED, PACKED_SETS = 8, 2
#: Bytes of shingle sets at which a region with such sets ends.
REGION_BYTES = 4 << 20
#: Pairs of nodes that are looked at together.
CHUNK = 1 << 7
#: Probabilities, for texts of just the wanted similarity, that they meet in an order and that they are within the distance.
MEET, WITHIN = 0.985, 0.985
FLIP = -(1 << 63)


def bit_apart(similarity: float) -> float:
    """Probability that a bit differs between texts of this Jaccard similarity: their sets have the cosine 2 J / (1 + J), and it is angle / pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def distance_at(similarity: float, bits: int = 64, within: float = WITHIN) -> int:
    """The least number of bits within which the fingerprints of two such texts are with the probability `within`."""
    p, sum_ = bit_apart(similarity), 0.0
    for d in range(bits + 1):
        sum_ += math.comb(bits, d) * p**d * (1 - p) ** (bits - d)
        if sum_ >= within:
            return d
    return bits


def orders_of(count: int, bits: int, distance: int, similarity: float | None = None, region: int = REGION_ROWS) -> tuple[int, list[list[int]]]:
    """(prefix, permutations of the bits) for so many fingerprints; see the module's description."""
    prefix = max(0, math.ceil(math.log2(max(1, count) / region)))
    if not prefix:
        return 0, [list(range(bits))]
    if similarity is not None:
        alone = (1 - bit_apart(similarity)) ** prefix
        n = 1 if alone >= MEET else math.ceil(math.log(1 - MEET) / math.log(1 - alone))
        leads = [random.Random(o).sample(range(bits), prefix) for o in range(n)]
    else:
        blocks = distance + 1
        while blocks < bits and (blocks - distance) * (bits // blocks) < prefix:
            blocks += 1
        size = bits // blocks
        parts = [list(range(i * size, (i + 1) * size)) for i in range(blocks)]
        leads = [sum(chosen, []) for chosen in combinations(parts, blocks - distance)]
        prefix = min(prefix, len(leads[0]))
    return prefix, [lead + [b for b in range(bits) if b not in set(lead)] for lead in leads]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, in order; of fewer words the whole sequence; of none nothing."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z become lower case, only ASCII white space separates
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(joined[a : b - 1], 42) for a, b in zip(starts[:n], ends[min(shingle, len(words)) - 1 :], strict=False)], dtype="<u8")


def _further(h: np.ndarray, word: int) -> np.ndarray:
    """Hashes for a further word of a fingerprint; word 0: as they are."""
    if word:
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(31)) ^ np.uint64(word)) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            h = h ^ (h >> np.uint64(32))
    return h


def fingerprint(text: str | None, shingle: int = 4, words: int = 1) -> tuple[int, ...]:
    hashes = shingle_hashes(text, shingle)
    out = []
    for word in range(words):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 4096):
            h = _further(hashes[at : at + 4096], word)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little"))
    return tuple(out)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, key: str, text: str = "text", shingle: int = 4, words: int = 1, by_text: bool = False) -> DataFrame:
    """(key, f0, f1, ...): fingerprints as signed longs; by_text: also t0 and t1, a 128-bit hash of the words in lower case."""
    names = [f"f{w}" for w in range(words)] + ["t0", "t1"] * by_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("t"):
                t = t.as_py()
                h = divmod(xxhash.xxh3_128_intdigest(b" ".join((t or "").encode().lower().split())), 1 << 64) if by_text else ()
                rows.append((*fingerprint(t, shingle, words), *h))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("key"), *map(_signed, columns)], ["key", *names])

    given = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    schema = given.select("key").schema
    for n in names:
        schema = schema.add(n, "long")
    return given.mapInArrow(run, schema)


class Tree:
    """The levels of a region's tree, leaves first; each level holds (pattern, mask) of each word of the nodes, padded to whole groups."""

    def __init__(self, fps: np.ndarray):
        self.n = len(fps)
        self.levels = []
        pattern, mask = fps.T, np.full(fps.T.shape, ~np.uint64(0))
        while True:
            more = -pattern.shape[1] % FAN
            pattern = np.concatenate([pattern, np.repeat(pattern[:, -1:], more, 1)], 1)
            mask = np.concatenate([mask, np.repeat(mask[:, -1:], more, 1)], 1)
            self.levels.append((pattern, mask))
            if pattern.shape[1] == FAN:
                break
            pattern, mask = _above(pattern, mask)

    def lift(self, levels: int) -> None:
        """Roots above the root, up to so many levels."""
        while len(self.levels) < levels:
            self.levels.append(tuple(np.repeat(x, FAN, 1) for x in _above(*self.levels[-1])))


def _above(pattern: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parents of a level. A bit that a child doesn't fix is zero in its pattern, so it counts as fixed only where all children fix it."""
    p, m = (x.reshape(len(x), -1, FAN) for x in (pattern, mask))
    fixed = np.bitwise_and.reduce(m, axis=2) & ~(np.bitwise_or.reduce(p, axis=2) ^ np.bitwise_and.reduce(p, axis=2))
    return p[:, :, 0] & fixed, fixed


_GRID = np.divmod(np.arange(FAN * FAN), FAN)
_SHIFT = (FAN * FAN).bit_length() - 1


def links(a: np.ndarray, b: np.ndarray, distance: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of places (i, j) with at most `distance` differing bits; a and b (rows by words) are in Gray order; same: i < j only."""
    ta = Tree(a)
    tb = ta if same else Tree(b)
    height = max(len(ta.levels), len(tb.levels))
    ta.lift(height)
    tb.lift(height)
    stack = [(height - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > CHUNK:
            stack += [(level, i[at : at + CHUNK], j[at : at + CHUNK]) for at in range(0, len(i), CHUNK)]
            continue
        (pa_, ma), (pb, mb) = ta.levels[level], tb.levels[level]
        diff = pa_[0].reshape(-1, FAN)[i][:, :, None] ^ pb[0].reshape(-1, FAN)[j][:, None, :]
        if level:
            diff &= ma[0].reshape(-1, FAN)[i][:, :, None] & mb[0].reshape(-1, FAN)[j][:, None, :]
        count = np.bitwise_count(diff).ravel()
        hits = np.flatnonzero(count <= distance)
        if not len(hits):
            continue
        near, at = hits >> _SHIFT, hits & (FAN * FAN - 1)
        x, y = i[near] * FAN + _GRID[0][at], j[near] * FAN + _GRID[1][at]
        n, m = (len(a), len(b)) if not level else (ta.levels[level - 1][0].shape[1] // FAN, tb.levels[level - 1][0].shape[1] // FAN)
        ok = (x < n) & (y < m)
        if same:
            ok &= (x < y) if level == 0 else (x <= y)
        x, y, total = x[ok], y[ok], count[hits[ok]].astype(np.int64)
        for w in range(1, len(pa_)):
            if not len(x):
                break
            diff = pa_[w][x] ^ pb[w][y]
            if level:
                diff &= ma[w][x] & mb[w][y]
            total += np.bitwise_count(diff)
            ok = total <= distance
            x, y, total = x[ok], y[ok], total[ok]
        if len(x):
            if level:
                stack.append((level - 1, x, y))
            else:
                yield x, y


def forest(n: int, chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links that join two components when they come: a spanning forest, at most n - 1 links."""
    label = np.arange(n)
    us, vs = [], []
    for x, y in chunks:
        while True:
            a, b = label[x], label[y]
            apart = a != b
            if not apart.any():
                break
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], np.diff(high[order]) > 0])]
            label[high[first]] = low[first]  # each root hooks once, to a smaller one
            us.append(x[first])
            vs.append(y[first])
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs])


def _permuted(orders: list[list[int]], prefix: int, words: int):
    """Rows (node, root, size, shared, f0, ...) into one row per order, with the bucket and the Gray rank of the permuted fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.stack([b.column(f"f{w}").to_numpy() for w in range(words)], 1).astype("<i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), 8 * words), axis=1, bitorder="little")
            for o, order in enumerate(orders):
                rank = np.ascontiguousarray(np.packbits(bits[:, order[:64]], axis=1)).view(">u8").astype(np.uint64).ravel()
                for shift in (1, 2, 4, 8, 16, 32):
                    rank ^= rank >> np.uint64(shift)
                bucket = rank >> np.uint64(64 - prefix) if prefix else np.zeros_like(rank)
                made = [pa.array(np.full(len(fps), o, np.int32)), pa.array(bucket.view(np.int64)), pa.array((rank ^ np.uint64(1 << 63)).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*made, *(b.column(n) for n in b.schema.names)], ["o", "bucket", "rank", *b.schema.names])

    return run


def _pack(words: int, region: int, with_sets: bool):
    """Rows sorted by (o, bucket, rank) into regions: (o, bucket, region, fps, rest, every, some), and their sets of shingles."""
    names = ["o", "bucket", "region", "fps", "rest", "every", "some"] + ["sets"] * with_sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []  # rows of one bucket, as longs (fps, node, root, size, shared)
        sets: list[pa.Array] = []
        size, weight, now = 0, 0, None

        def give() -> pa.RecordBatch:
            nonlocal number, size, weight
            rows = np.concatenate(held)
            held.clear()
            size = weight = 0
            number += 1
            more = []
            if with_sets:
                every = pa.concat_arrays(sets)
                more = [pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)]
                sets.clear()
            fps = np.ascontiguousarray(rows[:, :words])
            parts = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (fps, rows[:, words:].T)]
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]]), pa.array([number - 1]), *parts, *(pa.array([f.reduce(fps, axis=0)], pa.list_(pa.int64())) for f in (np.bitwise_and, np.bitwise_or)), *more], names)

        for b in batches:
            o, bucket = b.column("o").to_numpy(), b.column("bucket").to_numpy()
            rows = np.stack([b.column(n).to_numpy() for n in (*(f"f{w}" for w in range(words)), "node", "root", "size", "shared")], 1)
            edges = np.flatnonzero((o[1:] != o[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            for start, end in zip([0, *edges], [*edges, len(o)], strict=True):
                if start == end:
                    continue
                if size and now != (o[start], bucket[start]):
                    yield give()
                now = (o[start], bucket[start])
                while start < end:
                    take = min(end - start, region - size)
                    if with_sets:  # row by row, as far as the bytes allow
                        take = int(np.searchsorted(np.cumsum(8 * rows[start : start + take, words + 2]) + weight, REGION_BYTES)) + 1
                        take = min(take, end - start, region - size)
                        sets.append(b.column("shingles").slice(start, take))
                        weight += int(8 * rows[start : start + take, words + 2].sum())
                    held.append(rows[start : start + take])
                    size += take
                    start += take
                    if size == region or weight >= REGION_BYTES:
                        yield give()
        if size:
            yield give()

    return run


def _compare(distance: int, words: int, rooted: bool, closest_first: bool, least: float):
    """Over pairs of regions (or one region with itself, where b's columns are null): forests of links, or all links between different roots that may reach the similarity `least`."""

    def spread(us: np.ndarray, vs: np.ndarray) -> Iterator[pa.RecordBatch]:
        low, high = np.minimum(us, vs), np.maximum(us, vs)
        for s in range(0, len(us), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + (1 << 16)]) for x in (low, high)], ["u", "v"])

    def joining(a: np.ndarray, b: np.ndarray, rest: list[np.ndarray], sets: list, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of links that the shingles confirm and that join two parts when they come."""
        (nodes_a, roots_a, size_a, shared_a), (nodes_b, roots_b, size_b, shared_b) = rest
        of = [lambda i, c=c: np.frombuffer(c[i].as_buffer(), "<u8") for c in sets]
        up: dict[int, int] = {}

        def part(root: int) -> int:
            while (next_ := up.get(root, root)) != root:
                root = next_
            return root

        us, vs = [], []
        for i, j in links(a, b, distance, same):
            common = np.minimum(shared_a[i], shared_b[j])
            may = (roots_a[i] != roots_b[j]) & (common >= least * np.maximum(1, size_a[i] + size_b[j] - common))
            for x, y in zip(i[may].tolist(), j[may].tolist(), strict=True):
                p, q = part(int(roots_a[x])), part(int(roots_b[y]))
                if p != q and _similar(of[0](x), of[1](y), least):
                    up[max(p, q)] = min(p, q)
                    us.append(nodes_a[x])
                    vs.append(nodes_b[y])
        return np.array(us, np.int64), np.array(vs, np.int64)

    columns = ["fps", "rest"] + ["sets"] * rooted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in zip(*(batch.column(f"{n}_{s}") for s in "ab" for n in columns), strict=True):
                of_a, of_b = cells[: len(columns)], cells[len(columns) :]
                same = not of_b[0].is_valid
                of_b = of_a if same else of_b
                a, b = (np.frombuffer(c[0].as_buffer(), np.uint64).reshape(-1, words) for c in (of_a, of_b))
                rest = [np.frombuffer(c[1].as_buffer(), "<i8").reshape(4, -1) for c in (of_a, of_b)]
                if rooted:
                    yield from spread(*joining(a, b, rest, [c[2].values for c in (of_a, of_b)], same))
                    continue
                nodes = rest[0][0] if same else np.concatenate([rest[0][0], rest[1][0]])
                shift = 0 if same else len(a)
                rounds = sorted({distance // 2, distance}) if closest_first else [distance]
                u, v = forest(len(nodes), ((i, j + shift) for d in rounds for i, j in links(a, b, d, same)))
                yield from spread(nodes[u], nodes[v])

    return run


def _similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets of shingles, sorted, share the part `least`; two empty ones do."""
    if not len(x) or not len(y):
        return len(x) == len(y)
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return common >= least * max(1, len(x) + len(y) - common)


def linked(nodes: DataFrame, space: Workspace, words: int = 1, distance: int = 4, similarity: float | None = None, closest_first: bool = False, region: int = REGION_ROWS, least: float = 0.0) -> DataFrame:
    """(u, v) between nodes, u < v: spanning forests of all links at up to `distance`. nodes: (node long, f0, ...), a written table.

    Where nodes have root, size, shared and shingles also (the set of shingles, its size, and how many of them any other
    node has), they are links with the similarity `least` between different roots instead, as many as join what can be
    joined. closest_first: the forests prefer close links, which a check is less likely to refute.
    """
    rooted, count = "root" in nodes.columns, nodes.count()
    prefix, orders = orders_of(count, 64 * words, distance, similarity, region)
    fps = [f"f{w}" for w in range(words)]
    more = ["root", "size", "shared"]
    given = nodes.select("node", *[F.col(c) if rooted else F.lit(0).cast("long").alias(c) for c in more], *fps, *["shingles"] * rooted)
    longs = ", ".join(f"{n} long" for n in ("bucket", "rank", "node", *more, *fps))
    ranked = given.mapInArrow(_permuted(orders, prefix, words), f"o int, {longs}" + ", shingles binary" * rooted)
    parts = max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * len(orders) // (64 * region)))
    by = ["o", "bucket", "rank", "node"]
    tasks = min(parts, math.ceil(count * len(orders) / (region * (PACKED_SETS if rooted else PACKED))))
    packed = ranked.repartitionByRange(parts, *by).sortWithinPartitions(*by).coalesce(max(1, tasks)).mapInArrow(_pack(words, region, rooted), "o int, bucket long, region long, fps binary, rest binary, every array<long>, some array<long>" + ", sets array<binary>" * rooted)
    packed = space.write(packed, "regions")
    cells = {"fps": "binary", "rest": "binary"} | ({"sets": "array<binary>"} if rooted else {})
    side = lambda s: packed.select(F.col("region").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cells])
    alone = packed.select(*[F.col(c).alias(f"{c}_a") for c in cells], *[F.lit(None).cast(t).alias(f"{c}_b") for c, t in cells.items()])
    # Pairs of regions of one bucket go by their summaries: rows without fingerprints.
    tops = lambda s: packed.select("o", "bucket", F.col("region").alias(s), F.col("every").alias(f"e_{s}"), F.col("some").alias(f"s_{s}"))
    apart = sum((F.bit_count(_fixed_apart(w)) for w in range(words)), F.lit(0))
    pairs = tops("a").join(tops("b"), ["o", "bucket"]).where((F.col("a") < F.col("b")) & (apart <= distance)).select("a", "b")
    pairs = space.write(pairs, "pairs")
    tiles = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    both = alone.repartition(parts).unionByName(tiles.select(*alone.columns))
    return both.mapInArrow(_compare(distance, words, rooted, closest_first, least), "u long, v long").distinct()


def _fixed_apart(w: int) -> Column:
    """Bits of word w that both regions fix, each in its way."""
    e_a, s_a, e_b, s_b = (F.get(n, F.lit(w)) for n in ("e_a", "s_a", "e_b", "s_b"))
    loose = e_a.bitwiseXOR(s_a).bitwiseOR(e_b.bitwiseXOR(s_b))
    return e_a.bitwiseXOR(e_b).bitwiseAND(F.bitwise_not(loose))


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, root) of every node of `edges` (u, v): root is one node of its component. Each round writes its edges anew.

    A node hooks to its smallest neighbour if that is smaller; chains of hooks are then followed by pointer jumping and
    the edges rewritten between roots, until none is left. Labels are joined on keys that may be hot on the side of the
    edges; the side of the labels has one row per node.
    """
    edges = space.write(edges.where("u <> v").distinct(), "edges0")
    roots = space.write(edges.selectExpr("u AS node").union(edges.selectExpr("v AS node")).distinct().selectExpr("node", "node AS root"), "roots0")
    done, step = ["edges0", "roots0"], 0
    while not edges.isEmpty():
        step += 1
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        hook = space.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), f"hook{step}")
        while True:  # pointer jumping: every chain is half as long after each pass
            step += 1
            up = hook.alias("h").join(hook.select(F.col("u").alias("p"), F.col("p").alias("q")), "p", "left").select("u", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") != F.col("p")).alias("moved"))
            up = space.write(up, f"hook{step}")
            space.drop(f"hook{step - 1}")
            hook = up.select("u", "p")
            if up.where("moved").isEmpty():
                break
        to = lambda side: hook.select(F.col("u").alias(side), F.col("p").alias(f"{side}_root"))
        rewritten = edges.join(to("u"), "u").join(to("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).where("u <> v").distinct()
        new_roots = roots.join(hook.select(F.col("u").alias("root"), F.col("p").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        old = step
        edges = space.write(rewritten, f"edges{step}")
        roots = space.write(new_roots, f"roots{step}")
        for name in done:
            space.drop(name)
        done = [f"edges{old}", f"roots{old}", f"hook{old}"]
    return roots


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, shingles) into (node, size, h), a row for every shingle."""
    for b in batches:
        for node, x in zip(b.column("node").to_pylist(), b.column("shingles"), strict=True):
            h = np.frombuffer(x.as_buffer(), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node, np.int64)), pa.array(np.full(len(h), len(h), np.int64)), pa.array(h)], ["node", "size", "h"])


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                keep.append(_similar(x, y, least))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _checked(edges: DataFrame, texts: DataFrame, shingle: int, least: float, space: Workspace) -> DataFrame:
    """Those edges of which the texts share at least the part `least` of their shingles. texts: (node, t), a row a node."""
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    sets = space.write(texts.join(nodes.hint("merge"), "node", "left_semi").mapInArrow(_shingle_sets(shingle), "node long, shingles binary"), "sets")
    side = lambda n, s: sets.select(F.col("node").alias(n), F.col("shingles").alias(s)).hint("merge")
    return space.write(edges.join(side("u", "x"), "u").join(side("v", "y"), "v").select("u", "v", "x", "y").mapInArrow(_alike(least), "u long, v long"), "checked")


def _verified(edges: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, least: float, space: Workspace, **index) -> DataFrame:
    """(node, root) over the links that the texts confirm, from the forests `edges` of all links."""
    checked = _checked(edges, texts, shingle, least, space)
    roots = components(checked, Workspace(space.spark, "confirmed"))
    refuted = edges.join(checked, ["u", "v"], "left_anti")
    space.drop("regions", "sets")
    if refuted.isEmpty():
        return roots
    # A refuted link may have taken the place of a true one of its component, all of whose open links are checked.
    every = components(edges, Workspace(space.spark, "unconfirmed"))
    doubtful = refuted.join(every.withColumnRenamed("node", "u"), "u").select("root").distinct()
    among = every.join(doubtful, "root", "left_semi").select("node")
    again = Workspace(space.spark, "again")
    among = again.write(among, "among")
    sets = again.write(texts.join(among.hint("merge"), "node", "left_semi").mapInArrow(_shingle_sets(shingle), "node long, shingles binary"), "sets")
    have = sets.mapInArrow(_shingles, "node long, size long, h long")
    alone = have.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    size = (F.octet_length("shingles") / 8).cast("long")
    sizes = sets.join(alone.hint("merge"), "node", "left").select("node", size.alias("size"), (size - F.coalesce("alone", F.lit(0))).alias("shared"), "shingles")
    rooted = nodes.join(sizes.hint("merge"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = again.write(rooted, "rooted")
    again.drop("sets", "among")
    more = again.write(linked(rooted, again, least=least, **index), "links")
    again.drop("regions", "pairs", "rooted")
    return roots if more.isEmpty() else components(checked.union(more), again)


def _classes(docs: DataFrame, text: str, shingle: int, distance: int | None, words: int, key: str, verify: float | None, region: int, space: Workspace) -> tuple[DataFrame, DataFrame, list[str]]:
    """(prints, named, by): fingerprints of all rows; of each node its columns `by`, and component_id."""
    by_text = verify is not None
    fps = [f"f{w}" for w in range(words)]
    by = ["t0", "t1"] if by_text else fps
    prints = space.write(fingerprints(docs, key, text, shingle, words, by_text), "prints")
    # A text's fingerprint follows from its words, so any of equal rows will do.
    same = prints.groupBy(*by).agg(F.min("key").alias("least"), *[F.min(f).alias(f) for f in fps if f not in by])
    nodes = space.write(same.withColumn("node", F.col("least" if by_text else "f0").cast("long")), "nodes")
    index = {"words": words, "distance": distance_at(verify, 64 * words) if distance is None else distance, "region": region, "similarity": verify if distance is None else None}
    edges = space.write(linked(nodes.select("node", *fps), space, closest_first=by_text, **index), "links")
    if by_text:
        texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("t"))
        roots = _verified(edges, nodes.select("node", *fps), texts, shingle, verify, space, **index)
    else:
        roots = components(edges, space)
    named = space.write(nodes.join(roots, "node", "left").select(*by, "least", F.coalesce("root", "node").alias("root")), "named")
    smallest = space.write(named.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")  # written, so that the join below can split a hot root
    named = space.write(named.join(smallest, "root").select(*by, "least", "component_id"), "by_print")
    space.drop("regions", "pairs", "nodes", "links", "sets", "checked", "named", "smallest")
    space.free()
    return prints, named, by


def classes(docs: DataFrame, text: str = "text", shingle: int = 4, distance: int | None = 4, key: str = "doc_id", verify: float | None = None, words: int = 1, region: int = REGION_ROWS) -> DataFrame:
    """(key, fp, component_id): the first word of the fingerprint (long), and the smallest `key` of all texts reachable over links.

    verify: links of which the texts share less than this part of their shingles (Jaccard) don't count; it needs a
    unique long `key`. distance None: that which texts of the similarity `verify` keep; the index is then by similarity.
    More than one word needs `verify`.
    """
    if words > 1 and verify is None or distance is None and verify is None:
        raise ValueError("wider fingerprints and derived distances need a similarity to verify")
    prints, named, by = _classes(docs, text, shingle, distance, words, key, verify, region, Workspace(docs.sparkSession, "simhash"))
    return prints.join(named.select(*by, "component_id"), by).select(F.col("key").alias(key), F.col("f0").alias("fp"), "component_id")


def deduplicated(docs: DataFrame, text: str = "text", shingle: int = 4, distance: int | None = 4, verify: float | None = None, words: int = 1, region: int = REGION_ROWS) -> DataFrame:
    """docs with one row left of every component: the one with the smallest doc_id (of repeated ids one row)."""
    space = Workspace(docs.sparkSession, "simhash-kept")
    key = free_name(docs, "_key")
    rows = keyed(docs, key, space)
    _, named, _ = _classes(rows.select(key, text), text, shingle, distance, words, key, verify, region, space)
    keep = named.where("least = component_id").select(F.col("least").alias(key))
    return rows.join(keep, key, "left_semi").select(*docs.columns)
