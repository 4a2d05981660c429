"""MinHash near-duplicates from bottom-k sketches of one hash function.

A text's set is that of its distinct word shingles, as 63-bit hashes; its sketch are the k smallest. Texts with equal sets
are one node. The steps:

1. Inverted lists: every node is posted under some of its retained values. Nodes of the wanted similarity share at least
   `floor_of` values of their sketches (fewer with the probability MISS at most; for sets that a sketch holds whole the
   number is exact), so they share one among each one's rarest values, if all but floor_of - 1 are posted. Values that many
   texts have are therefore posted only by nodes that have no rarer ones, and lists stay short where texts are not alike.
2. Stars: the members of a list are compared with one of them, its hub. That is a row a posting, however long the list is.
   Pairs are filtered by the sketch of their union (the k smallest of both; which part of them both have estimates the
   similarity), then the full sets decide.
3. What the stars leave apart: lists whose members are in two components or more. Short ones give their pairs, which go
   the same way. Members of long ones are packed into regions of bounded size, neighbours by their longest list and size;
   regions that share a long list's value meet, two to a task, which compares all sets of both in one matrix product over
   the shingles that both have, and gives on one confirmed link between two components, never all pairs of a group. The
   pairs of regions go in waves, so that their copies on disk are bounded by the regions' own bytes, however many they are.
4. Components come from the confirmed links, by hooking to the smallest label with a written table each round.

So no pair within reach is left out: a group of n copies whose edits keep them apart is compared with itself in regions,
and costs the more the less alike its members are, but no rows. Sets are compared by 63-bit hashes: in a pair's union of
10^5 shingles two share a hash with a probability of 10^-9.

Defined cases: null, empty and blank texts have no shingles, link with nothing and are components of their own; fewer words
than a shingle: the whole sequence is one; texts are read whole; repeated rows are equal sets; a null id is left out of the
choice of the smallest, and a component of null ids has none; no rows: no rows; other columns are ignored by `classes`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm.common import Workspace, free_name, keyed
from lexforge.llm.simhash import components, forest
from lexforge.llm.substring import _ODD, forget, rolling, word_hashes

#: Probability, for two texts of just the wanted similarity, that fewer retained values are common than the lists rely on.
MISS = 1e-6
#: Members up to which an open list gives its pairs.
SHORT = 16
#: A region's members, and the bytes of their sets.
REGION_ROWS, REGION_BYTES = 512, 4 << 20
#: Regions that a task packs at least, if there are so many: the last one of a task isn't full, but meets as many others.
PACKED = 8
#: Copies of regions that are on disk at once: times the bytes of all regions, and bytes that are allowed in any case.
WAVE_TIMES, WAVE_BYTES = 2, 128 << 20
#: Shingles in one piece of a matrix product.
COLUMNS = 4096


def floor_of(k: int, percent: int) -> int:
    """The most values of k that two sets of this similarity have in common with the probability 1 - MISS at least."""
    p, sum_ = percent / 100, 0.0
    for m in range(k + 1):
        sum_ += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if sum_ > MISS:
            return m
    return k


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct 63-bit hashes of a text's shingles, ascending."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z become lower case, only ASCII white space separates
    if not words:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = rolling(word_hashes(words)[0], shingle, _ODD[0]) if len(words) >= shingle else rolling(word_hashes(words)[1], len(words), _ODD[1])
    return np.unique(h >> np.uint64(1)).view(np.int64)


def _sketches(shingle: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, high, low, some = [], [], [], []
            for t in b.column("t"):
                s = shingle_set(t.as_py(), shingle)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                sizes.append(len(s))
                high.append(h >> 64)
                low.append(h & ((1 << 64) - 1))
                some.append(s[:k])
            at = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32)
            values = np.concatenate([np.empty(0, np.int64), *some])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array(sizes, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (high, low)), pa.ListArray.from_arrays(pa.array(at), pa.array(values))], ["key", "id", "n", "t0", "t1", "sketch"])
        forget()

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in b.column("t")], pa.binary())], ["node", "hashes"])
        forget()

    return run


def _alike(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<i8"), np.frombuffer(y.as_buffer(), "<i8")
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, root, hashes) in order into regions: one row each, numbered by task."""
    number = TaskContext.get().partitionId() << 32
    held: list[list] = [[], [], []]
    weight = 0

    def give() -> pa.RecordBatch:
        nonlocal number, weight
        number, weight = number + 1, 0
        made = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([held[0]], pa.list_(pa.int64())), pa.array([held[1]], pa.list_(pa.int64())), pa.array([held[2]], pa.list_(pa.binary()))], ["region", "nodes", "roots", "sets"])
        for x in held:
            x.clear()
        return made

    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in ("node", "root", "hashes")), strict=True):
            for x, cell in zip(held, row, strict=True):
                x.append(cell)
            weight += len(row[2])
            if len(held[0]) == REGION_ROWS or weight >= REGION_BYTES:
                yield give()
    if held[0]:
        yield give()


def common_counts(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many values each set of a shares with each of b (None: of a), by matrix products over the values that can be shared."""
    both = [np.concatenate([np.empty(0, np.int64), *s]) for s in (a, b if b is not None else a)]
    if b is None:
        values, times = np.unique(both[0], return_counts=True)
        values = values[times > 1]
    else:
        values = np.intersect1d(np.unique(both[0]), np.unique(both[1]))
    total = np.zeros((len(a), len(b if b is not None else a)), np.float32)
    if not len(values):
        return total.astype(np.int64)
    places = []
    for sets, flat in zip((a, b if b is not None else a), both, strict=True):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
        hit = values[at] == flat
        order = np.argsort(at[hit], kind="stable")
        places.append((row[hit][order], at[hit][order], len(sets)))
    for start in range(0, len(values), COLUMNS):
        tiles = []
        for row, at, n in places:
            lo, hi = np.searchsorted(at, [start, start + COLUMNS])
            tile = np.zeros((n, min(COLUMNS, len(values) - start)), np.float32)
            tile[row[lo:hi], at[lo:hi] - start] = 1
            tiles.append(tile)
        total += tiles[0] @ tiles[1].T
    return total.astype(np.int64)


def _meet(percent: int):
    """Over pairs of regions (or one with itself, b null): links between the roots of similar members, as many as join what they can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in zip(*(batch.column(f"{n}_{s}") for s in "ab" for n in ("roots", "sets")), strict=True):
                same = not cells[2].is_valid
                roots, sets = [], []
                for r, s in (cells[:2],) if same else (cells[:2], cells[2:]):
                    roots.append(r.values.to_numpy())
                    sets.append([np.frombuffer(x.as_buffer(), "<i8") for x in s.values])
                sizes = [np.array([len(x) for x in s]) for s in sets]
                common = common_counts(sets[0], None if same else sets[1])
                close = 100 * common >= percent * (sizes[0][:, None] + sizes[-1][None] - common)
                i, j = np.nonzero(close & (roots[0][:, None] != roots[-1][None]))
                names, at = np.unique(np.concatenate(roots), return_inverse=True)
                u, v = forest(len(names), iter([(at[i], at[j if same else j + len(roots[0])])]))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(names[u], names[v])), pa.array(np.maximum(names[u], names[v]))], ["u", "v"])

    return run


class _Run:
    """One run's parameters and work tables."""

    def __init__(self, docs: DataFrame, key: str, text: str, shingle: int, k: int, percent: int):
        self.space = Workspace(docs.sparkSession, "minhash")
        self.shingle, self.k, self.percent, self.least = shingle, k, percent, floor_of(k, percent)
        row = free_name(docs, "_row")
        rows = keyed(docs.select(F.col(key), F.col(text)), row, self.space)
        given = rows.select(F.col(row).alias("key"), F.col(key).alias("id"), F.col(text).alias("t"))
        schema = T.StructType([*given.select("key", "id").schema.fields, *[T.StructField(c, T.LongType()) for c in ("n", "t0", "t1")], T.StructField("sketch", T.ArrayType(T.LongType()))])
        self.texts = given.select(F.col("key").alias("node"), "t")
        self.prints = self.space.write(given.mapInArrow(_sketches(shingle, k), schema), "prints")

    def share(self, n: Column) -> Column:
        """The least number of whole shingles that a set of n has in common with a similar one."""
        return F.ceil(n * self.percent / F.lit(100))

    def fit(self, a: Column, b: Column) -> Column:
        """Sizes that similar sets can have."""
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def postings(self, nodes: DataFrame) -> DataFrame:
        """(value, node, n): nodes under their rarest retained values, but for values that only one node retains."""
        retained = nodes.select("node", "n", F.explode("sketch").alias("value"))
        often = self.space.write(retained.groupBy("value").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "often")
        shared = retained.join(often.hint("merge"), "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("times", "value"))).alias("shared"))
        # In the order of rarity, values that nobody else retains come first and need no list; of the others all but the last few are posted.
        most = F.size("shared") - F.least(self.share(F.col("n")), F.lit(self.least)) + 1
        posted = shared.select("node", "n", F.explode(F.slice("shared", 1, F.greatest(most, F.lit(0)).cast("int"))).alias("p"))
        return self.space.write(posted.select(F.col("p.value").alias("value"), "node", "n"), "postings")

    def estimated(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Those pairs (u, v) that the sketch of their union doesn't refute."""
        side = lambda n, s: nodes.select(F.col("node").alias(n), F.col("sketch").alias(s)).hint("merge")
        both = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v")
        union = F.slice(F.array_sort(F.array_union("x", "y")), 1, self.k)
        common = both.select("u", "v", F.size(union).alias("of"), F.size(F.array_intersect(F.array_intersect("x", "y"), union)).alias("common"))
        return common.where(F.col("common") >= F.when(F.col("of") < self.k, self.share(F.col("of"))).otherwise(F.lit(self.least))).select("u", "v")

    def sets_of(self, nodes: DataFrame, name: str) -> DataFrame:
        return self.space.write(self.texts.join(nodes.select("node").hint("merge"), "node", "left_semi").mapInArrow(_sets(self.shingle), "node long, hashes binary"), name)

    def confirmed(self, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """Those pairs whose full sets are similar."""
        pairs = self.space.write(self.estimated(pairs, nodes), f"{name}-estimated")
        sets = self.sets_of(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct(), f"{name}-sets")
        side = lambda n, s: sets.select(F.col("node").alias(n), F.col("hashes").alias(s)).hint("merge")
        found = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v").select("u", "v", "x", "y").mapInArrow(_alike(self.percent), "u long, v long")
        found = self.space.write(found, name)
        self.space.drop(f"{name}-estimated", f"{name}-sets")
        return found

    def stars(self, postings: DataFrame) -> DataFrame:
        hubs = postings.groupBy("value").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
        hubs = self.space.write(hubs.join(postings.select(F.col("node").alias("hub"), F.col("n").alias("hub_n")).distinct(), "hub").select("value", "hub", "hub_n"), "hubs")
        met = postings.join(hubs.hint("merge"), "value").where((F.col("node") > F.col("hub")) & self.fit(F.col("n"), F.col("hub_n")))
        return self.space.write(met.select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct(), "stars")

    def open_lists(self, postings: DataFrame, roots: DataFrame) -> DataFrame:
        """(value, node, n, root, members) of lists with members in two components or more."""
        rooted = self.space.write(postings.join(roots.hint("merge"), "node", "left").select("value", "node", "n", F.coalesce("root", "node").alias("root")), "rooted")
        lists = rooted.groupBy("value").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
        lists = self.space.write(lists.select("value", "members"), "lists")
        return self.space.write(rooted.join(lists.hint("merge"), "value"), "open")

    def short(self, open_: DataFrame, tested: DataFrame) -> DataFrame:
        some = open_.where(F.col("members") <= SHORT)
        side = lambda s: some.select("value", F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("root").alias(f"root_{s}"))
        met = side("u").join(side("v"), "value").where((F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v")) & self.fit(F.col("n_u"), F.col("n_v")))
        return self.space.write(met.select("u", "v").distinct().join(tested, ["u", "v"], "left_anti"), "short-pairs")

    def long(self, open_: DataFrame) -> DataFrame:
        """Links between roots among the members of long open lists."""
        space, some = self.space, open_.where(F.col("members") > SHORT)
        among = some.groupBy("node").agg(F.max(F.struct("members", "value")).alias("lead"), F.min("n").alias("n"), F.min("root").alias("root"))
        among = space.write(among, "among")
        sets = self.sets_of(among, "long-sets")
        rows = among.join(sets.hint("merge"), "node")
        by = ["lead", "n", "node"]
        parts = int(space.spark.conf.get("spark.sql.shuffle.partitions"))
        count, weight = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0))).first()
        tasks = math.ceil(max(count / REGION_ROWS, weight / REGION_BYTES) / PACKED)
        sorted_ = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("node", "root", "hashes").coalesce(max(1, tasks))
        packed = space.write(sorted_.mapInArrow(_pack, "region long, nodes array<long>, roots array<long>, sets array<binary>"), "regions")
        space.drop("long-sets")
        region_of = packed.select("region", F.explode("nodes").alias("node"))
        # What a region has of a list: sizes from, to, and its root if there is one only.
        stretch = some.join(region_of.hint("merge"), "node").groupBy("value", "region").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        stretch = space.write(stretch, "stretches")
        side = lambda s: stretch.select("value", *[F.col(c).alias(f"{c}_{s}") for c in ("region", "low", "high", "r0", "r1")])
        apart = (F.col("r0_a") != F.col("r1_a")) | (F.col("r0_b") != F.col("r1_b")) | (F.col("r0_a") != F.col("r0_b"))
        in_reach = (100 * F.col("high_a") >= self.percent * F.col("low_b")) & (100 * F.col("high_b") >= self.percent * F.col("low_a"))
        pairs = side("a").join(side("b"), "value").where((F.col("region_a") <= F.col("region_b")) & apart & in_reach).select(F.col("region_a").alias("a"), F.col("region_b").alias("b")).distinct()
        pairs = space.write(pairs, "region-pairs")
        cells = {"roots": "array<long>", "sets": "array<binary>"}
        of = lambda s: packed.select(F.col("region").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cells]).hint("merge")
        alone = pairs.where("a = b").join(of("a"), "a").select(*[F.col(f"{c}_a") for c in cells], *[F.lit(None).cast(t).alias(f"{c}_b") for c, t in cells.items()])
        meet = lambda met, name: space.write(met.mapInArrow(_meet(self.percent), "u long, v long").distinct(), name)
        links = [meet(alone, "long-links")]
        waves = self.waves(pairs.where("a < b").count(), packed.count(), weight)
        for i in range(waves):
            mine = pairs.where((F.col("a") < F.col("b")) & (F.pmod(F.xxhash64("a", "b"), F.lit(waves)) == i))
            links.append(meet(mine.join(of("a"), "a").join(of("b"), "b").select(*alone.columns[:2], *[f"{c}_b" for c in cells]), f"long-links{i}"))
            space.free()
        links = space.write(reduce(DataFrame.union, links).distinct(), "all-long-links")
        space.drop("long-links", *[f"long-links{i}" for i in range(waves)])
        space.drop("regions", "region-pairs", "stretches", "among")
        return links

    @staticmethod
    def waves(pairs: int, regions: int, weight: int) -> int:
        """Parts in which so many pairs go, of regions of `weight` bytes in all: a pair is shuffled with one of its regions, and may be spilled so."""
        return math.ceil(2 * pairs * weight / max(1, regions) / max(WAVE_TIMES * weight, WAVE_BYTES))

    def links(self, nodes: DataFrame) -> DataFrame:
        space = self.space
        postings = self.postings(nodes)
        stars = self.stars(postings)
        first = self.confirmed(stars, nodes, "star-links")
        space.drop("often", "hubs")
        roots = components(first, Workspace(space.spark, "minhash-stars"))
        open_ = self.open_lists(postings, roots)
        more = self.confirmed(self.short(open_, stars), nodes, "short-links")
        rest = self.long(open_)
        space.drop("postings", "stars", "rooted", "lists", "open", "short-pairs")
        return first.union(more).union(rest)


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 2, percent: int = 80, k: int = 64) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the size of its set and the smallest key reachable over links of texts that share `percent` % of their shingles."""
    run = _Run(docs, key, text, shingle, k, percent)
    space, prints = run.space, run.prints
    by = ["t0", "t1"]
    nodes = prints.where("n > 0").groupBy(*by).agg(F.min("key").alias("node"), F.min("id").alias("least"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    nodes = space.write(nodes, "nodes")
    roots = components(run.links(nodes.select("node", "n", "sketch")), Workspace(space.spark, "minhash-links"))
    named = space.write(nodes.join(roots.hint("merge"), "node", "left").select(*by, "least", F.coalesce("root", "node").alias("root")), "named")
    smallest = space.write(named.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")  # written, so that the join can split a large component
    named = space.write(named.join(smallest.hint("merge"), "root").select(*by, "component_id"), "by-set")
    space.drop("nodes", "named", "smallest", "star-links", "short-links", "all-long-links")
    space.free()
    out = [F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id"]
    linked = prints.where("n > 0").select("id", "n", *by).join(named.hint("merge"), by).select(*out)
    return linked.unionByName(prints.where("n = 0").select("id", "n", F.col("id").alias("component_id")).select(*out))
