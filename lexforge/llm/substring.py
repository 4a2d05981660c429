"""Removal of repeated passages, with a log-structured fingerprint index.

A passage is a window of `window` consecutive words of one document; a window is repeated if its word sequence starts
anywhere else too. Every window is represented by the smallest hash among the `gram`-word sequences inside it (its
anchor), so equal windows have equal anchors and about one place in ten has to be kept. `FingerprintIndex` holds immutable
runs, tables sorted by hash in hash buckets: of anchors, with their number and the place of those found once, and of the
windows around repeated anchors, with their number. A batch of documents goes through it so:

1. The batch's anchors are counted into a run of their own, which is merge-joined with every run of history, without a
   shuffle of either. An anchor of the batch that was found twice or more, in history or in the batch, is a candidate;
   history's runs give the place of one that now meets its first equal.
2. Verification: around candidates every window's own 96-bit hash is made from the whole texts, of the batch and of the
   places met in history. Their counts become a run of windows, and those found twice or more over all runs are repeated;
   nothing is decided by an anchor alone. (Hashes stand for word sequences: among 10^12 windows the odds that two different
   ones share a hash are about 10^-5.)
3. Compaction by size: the new run is merged with its predecessor as long as that has less than GROWTH times its rows, so
   the number of runs grows with the logarithm of the batches, and so does how often a row is rewritten.
4. All words under a repeated window go; windows are judged on the input, not on what is left.

New files are written first, then the batch's state, which names all that belongs to the index; what no state names is
deleted after that, or when the index is opened again. So a driver that is lost at any point leaves the index as it was
before the batch or after it. If a file that the state names is missing, opening raises an error.

`remove` takes documents through an index in batches and judges each when all are in. An index with a path is kept there,
in the shared folder of the cluster, and can be opened again: later calls compare their documents with all earlier ones.
`cut` judges documents again when later batches have come.

Hot fingerprints: counts are combined before they are shuffled. Where places are looked up, one side of the join has one
row per fingerprint and both sides are shuffled for it alone, so adaptive execution splits the partitions of hot ones.

Defined cases: null text: no words; empty or short texts: no windows; texts of any length are read whole (a worker holds
one text at a time); overlapping equal windows of one text repeat each other; repeated rows repeat each other, so
nothing of them is left if they are long enough; ties of an anchor: the first place; no rows: no rows; other columns,
whatever their names, pass through `remove`.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm.common import Workspace, children, delete, exists, free_name, keyed

#: Parts, by hash, in which the windows around candidates are counted one after the other.
SLICES = 2
#: How much larger than the next one a run is at least.
GROWTH = 1.5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class _Hashes:
    """Room for the two hashes of each word of a text, used again for the next text."""

    def __init__(self) -> None:
        self.clear()

    def __len__(self) -> int:
        return self.n

    def put(self, digests: bytes) -> np.ndarray:
        both = np.frombuffer(digests, ">u8").reshape(-1, 2)
        self.n = len(both)
        if self.n > self.of.shape[1]:
            self.of = np.empty((2, self.n), np.uint64)
        self.of[0, : self.n], self.of[1, : self.n] = both[:, 1], both[:, 0]
        return self.of[:, : self.n]

    def clear(self) -> None:
        self.n, self.of = 0, np.empty((2, 1 << 12), np.uint64)


_hashes = _Hashes()


def forget() -> None:
    """For the end of a task: workers live on, and a long text needs much room. (What a task's function names itself is a copy; only this reaches the module's own.)"""
    _hashes.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word: shape (2, n). The next call writes over them.

    Every word is hashed again: that takes a third of the time of looking it up in a table of the words seen before.
    """
    return _hashes.put(b"".join(map(xxhash.xxh3_128_digest, words)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def rolling(h: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    """Hash of every `size` consecutive hashes: a polynomial in an odd number modulo 2**64, built by doubling."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    out, done, power, width = None, 0, odd, 1
    part = h  # part[i]: of `width` hashes from i; power: odd ** width
    while True:
        if size & width:
            if out is None:
                out, done = part, width
            else:
                n = len(h) - done - width + 1
                out = out[:n] * power + part[done : done + n]
                done += width
        if width * 2 > size:
            break
        n = len(h) - 2 * width + 1
        part = part[:n] * power + part[width : width + n]
        power = power * power
        width *= 2
    return _mixed(out[: len(h) - size + 1])


def anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for every window the place of its anchor: its smallest gram hash, the first of equals."""
    g = rolling(h, gram, _ODD[0])
    n, span = len(h) - window + 1, window - gram + 1
    if n <= 0:
        return g, np.empty(0, np.int64)
    # Place of the smallest of `span` values from each place, by doubling.
    best, width = np.arange(len(g)), 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(g[b] < g[a], b, a)
        width += step
    return g, best[:n]


def _bytes(texts: pa.Array) -> pa.Array:
    """The same texts in UTF-8, which no one has to decode."""
    return texts.cast(pa.large_binary())


def _split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # bytes split at ASCII white space only


def _spool(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                fps, keys, ats = [], [], []
                for t, key in zip(_bytes(b.column("t")), b.column("key").to_pylist(), strict=True):
                    words = _split(t.as_py())
                    if len(words) >= window:
                        g, at = anchors(word_hashes(words)[0], window, gram)
                        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                        fps.append(g[at].view(np.int64))
                        ats.append(at.astype(np.int32))
                        keys.append(np.full(len(at), key, np.int64))
                if fps:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (fps, keys, ats)], ["fp", "key", "at"])
        forget()

    return run


def _candidates(window: int, gram: int):
    """Texts with the places of candidate anchors: 96-bit hashes and places of the windows that have one of those anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for t, batch, key, ats in zip(_bytes(b.column("t")), b.column("batch").to_pylist(), b.column("key").to_pylist(), b.column("ats"), strict=True):
                    h = word_hashes(_split(t.as_py()))
                    g, anchor = anchors(h[0], window, gram)
                    wanted = np.zeros(len(g), bool)
                    wanted[ats.values.to_numpy()] = True
                    start = np.flatnonzero(wanted[anchor])
                    a, c = rolling(h[0], window, _ODD[1])[start], rolling(h[1], window, _ODD[0])[start]
                    part = (a >> np.uint64(32)) % np.uint64(SLICES)
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(c.astype(np.uint32).view(np.int32)), pa.array(np.full(len(start), key, np.int64)), pa.array(start.astype(np.int32)), pa.array(np.full(len(start), batch, np.int32))], ["part", "h", "c", "key", "at", "batch"])
        forget()

    return run


def _places(starts: pa.StructArray) -> np.ndarray:
    """The places in bitmaps (block, bits), some of which may be of one block."""
    block, bits = (x.to_numpy() for x in starts.flatten())
    found = np.flatnonzero(np.unpackbits(bits.astype("<i8").view(np.uint8), bitorder="little"))
    return block[found >> 6].astype(np.int64) * 64 + (found & 63)


def _cut(window: int, names: list[str], text: str, with_text: bool, given_text: str, given_starts: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, digest, texts = [], [], [], []
            for t, starts in zip(_bytes(b.column(given_text)), b.column(given_starts), strict=True):
                given = t.as_py()
                words = _split(given)
                kept = words
                if starts.is_valid:
                    at = _places(starts.values)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, np.minimum(at + window, len(words)), -1)
                    kept = [w for w, c in zip(words, np.cumsum(edge).tolist(), strict=False) if not c]
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(joined if len(kept) < len(words) else given)
            cols = [pa.array(texts, pa.binary()).view(pa.string()) if n == text and with_text else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], [*names, "n_words", "n_removed", "kept_sha256"])

    return run


WINDOWS = "part int, h long, c int, key long, at int"


class FingerprintIndex:
    """Runs of anchors and of windows around repeated ones, in immutable tables that a state names.

    path: a folder that all executors see, where the index is kept, with the texts, and opened again; None: for one call
    only, in a work folder, without the texts. `window` and `gram` are those of the first call.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 35, gram: int = 16):
        self.spark, self.space, self.kept = spark, Workspace(spark, "substring"), path is not None
        self.path = (path or self.space.path("index")).rstrip("/")
        self.buckets, self.names, self.given = int(spark.conf.get("spark.sql.shuffle.partitions")), set(), []
        self.tables, self.asked = [], []  # what the batch at hand has written
        self.state = {"batches": 0, "window": window, "gram": min(gram, window), "anchors": [], "windows": [], "tables": []}
        while self.kept and exists(spark, f"{self.path}/state-{self.state['batches'] + 1}/_SUCCESS"):
            (row,) = spark.read.text(f"{self.path}/state-{self.state['batches'] + 1}").collect()
            self.state = json.loads(row[0])
        self.window, self.gram = self.state["window"], self.state["gram"]
        if missing := [x for x in self._held() if not exists(spark, f"{self.path}/{x}/_SUCCESS")]:
            raise FileNotFoundError(f"the index at {self.path} lacks {', '.join(missing)}; it can't be used")
        if self.kept:
            self._sweep()

    def _held(self) -> list[str]:
        """Folders of the index that the state names."""
        return [r["name"] for kind in ("anchors", "windows") for r in self.state[kind]] + self.state["tables"]

    def _sweep(self) -> None:
        """Deletes what no state names: runs that were merged, and what an interrupted batch left."""
        held = {*self._held(), *(f"state-{i + 1}" for i in range(self.state["batches"]))}
        for name in children(self.spark, self.path):
            if name not in held:
                if name in self.names:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                    self.names.remove(name)
                delete(self.spark, f"{self.path}/{name}")

    def _run(self, df: DataFrame, keys: list[str]) -> dict:
        """Writes a run."""
        name = f"lexforge_run_{uuid.uuid4().hex}"
        df.write.format("parquet").option("path", f"{self.path}/{name}").option("compression", "zstd").bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(name)
        self.names.add(name)
        run = {"name": name, "buckets": self.buckets, "keys": keys, "schema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)}
        return run | {"rows": self._table(run).count()}

    def _table(self, run: dict) -> DataFrame:
        """A run as a bucketed table; one of an earlier session is made known to this one."""
        name = run["name"]
        if name not in self.names:
            keys = ", ".join(run["keys"])
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({run['schema']}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {run['buckets']} BUCKETS LOCATION '{self.path}/{name}'")
            self.names.add(name)
        return self.spark.table(name).hint("merge")

    def _plain(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Writes a table that isn't sorted."""
        name = f"{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        self.tables.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _compacted(self, kind: str, new: dict) -> list[dict]:
        """The runs of a kind with the new one, merged with those before it that have less than GROWTH times its rows."""
        runs = [*self.state[kind]]
        while runs and runs[-1]["rows"] < GROWTH * new["rows"]:
            old = runs.pop()
            both = self._table(old).alias("a").join(self._table(new).alias("b"), new["keys"], "full_outer")
            sum_ = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(0)) + F.coalesce(F.col(f"b.{c}"), F.lit(0))
            rest = [c for c in self._table(new).columns if c not in (*new["keys"], "n")]
            new = self._run(both.select(*new["keys"], sum_("n").alias("n"), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in rest]), new["keys"])
        return [*runs, new]

    def _repeated(self, kind: str) -> DataFrame:
        """Keys of a kind that all runs together have twice or more."""
        (first, *others) = self.state[kind]
        keys, total = first["keys"], self._table(first).select(*first["keys"], "n")
        for run in others:
            more = self._table(run).select(*keys, F.col("n").alias("more"))
            total = total.join(more, keys, "full_outer").select(*keys, (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        return total.where("n > 1").select(*keys)

    def take(self, texts: DataFrame) -> None:
        """Adds a batch (key long, t), keys unique in it."""
        space, number, self.tables, self.asked = self.space, self.state["batches"] + 1, [], []
        texts = self._plain(texts, f"texts-{number}") if self.kept else texts
        before, held = self._texts(), self.state["tables"]
        spool = space.write(texts.mapInArrow(_spool(self.window, self.gram), "fp long, key long, at int"), "spool")
        # Of an anchor that is found once, the least key and place are its own.
        counted = spool.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.lit(number).alias("batch"), F.min("key").alias("key"), F.min("at").alias("at"))
        fresh = self._run(counted, ["fp"])
        met, n_old = self._table(fresh).select("fp", "n"), F.lit(0)
        places = []
        for i, run in enumerate(self.state["anchors"]):
            old = self._table(run).select("fp", F.col("n").alias(f"n{i}"), F.when(F.col("n") == 1, F.struct("batch", "key", "at")).alias(f"place{i}"))
            met = met.join(old, "fp", "left")
            n_old = n_old + F.coalesce(f"n{i}", F.lit(0))
            places.append(f"place{i}")
        # Written plainly: a bucketed table would not be shuffled, and then hot partitions of the other side could not be split.
        place = F.when(n_old == 1, F.coalesce(*places)) if places else F.lit(None).cast("struct<batch:int,key:bigint,at:int>")
        candidates = space.write(met.where(F.col("n") + n_old > 1).select("fp", place.alias("place")), "candidates")
        asked = spool.join(candidates.select("fp").hint("merge"), "fp").groupBy("key").agg(F.collect_list("at").alias("ats"))
        windows = [self._windows(texts.withColumn("batch", F.lit(number)), asked.withColumn("batch", F.lit(number)))]
        if before is not None:
            once = candidates.where("place IS NOT NULL").select("place.*").groupBy("batch", "key").agg(F.collect_list("at").alias("ats"))
            windows.append(self._windows(before, once))
        made = self._plain(reduce(DataFrame.unionByName, windows), f"windows-{number}", "part")
        space.drop("spool", "candidates", *self.asked)
        space.free()
        counts = self._run(made.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n")), ["h", "c"])
        space.free()
        runs = {"anchors": self._compacted("anchors", fresh), "windows": self._compacted("windows", counts)}
        self.state |= runs | {"batches": number, "tables": [*held, *self.tables]}
        self.given.append(texts.withColumn("batch", F.lit(number)))
        self._commit(number)
        self._sweep()
        space.free()

    def _commit(self, number: int) -> None:
        """From here on the index has the batch: its state counts once the writer has marked it as whole."""
        if self.kept:
            self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/state-{number}")

    def _texts(self) -> DataFrame | None:
        """(batch, key, t) of all earlier batches."""
        if self.kept:
            stored = [n for n in self.state["tables"] if n.startswith("texts-")]
            frames = [self.spark.read.schema("key long, t string").parquet(f"{self.path}/{n}").withColumn("batch", F.lit(int(n.split("-")[1]))) for n in stored]
        else:
            frames = self.given
        return reduce(DataFrame.unionByName, frames) if frames else None

    def _windows(self, texts: DataFrame, asked: DataFrame) -> DataFrame:
        """Windows of the texts around the places asked for: (batch, key, ats)."""
        name = f"asked-{uuid.uuid4().hex}"
        self.asked.append(name)
        asked = self.space.write(asked, name)
        return texts.join(asked.hint("merge"), ["batch", "key"]).select("batch", "key", "t", "ats").mapInArrow(_candidates(self.window, self.gram), f"{WINDOWS}, batch int")

    def _starts(self, windows: DataFrame) -> DataFrame:
        """(batch, key, starts) of the repeated ones among windows. starts: bitmaps of 64 places each."""
        space, parts = self.space, []
        for part in range(SLICES):  # one slice of the windows at a time, which bounds what is shuffled at once
            mine = F.shiftrightunsigned("h", 32) % SLICES == part
            repeated = space.write(self._repeated("windows").where(mine), f"repeated{part}")
            found = windows.where(F.col("part") == part).join(repeated.hint("merge"), ["h", "c"])
            # Bitmaps of 64 places are combined in flat buffers; lists of places need one object a document.
            bits = found.groupBy("batch", "key", F.shiftright("at", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits"))
            parts.append(space.write(bits, f"starts{part}"))
            space.drop(f"repeated{part}")
            space.free()
        starts = reduce(DataFrame.unionByName, parts).groupBy("batch", "key").agg(F.collect_list(F.struct("block", "bits")).alias("starts"))
        starts = space.write(starts, f"starts-{uuid.uuid4().hex}")
        space.drop(*[f"starts{part}" for part in range(SLICES)])
        return starts

    def starts(self, least: int = 1) -> DataFrame:
        """(batch, key, starts): where (bitmaps of 64 places each) repeated windows start in the batches from `least` on, by all that the index has."""
        tables = [n for n in self.state["tables"] if n.startswith("windows-") and int(n.split("-")[1]) >= least]
        read = lambda n: self.spark.read.schema(f"{WINDOWS}, batch int").parquet(f"{self.path}/{n}")
        return self._starts(reduce(DataFrame.unionByName, map(read, tables)).where(F.col("batch") >= least))

    def cut(self, docs: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
        """remove() against the index as it is, without adding docs to it: for documents that earlier batches brought."""
        if not self.state["batches"]:
            raise ValueError("the index is empty")
        key = free_name(docs, "_key")
        rows = keyed(docs, key, self.space, f"keyed-{uuid.uuid4().hex}")
        texts = rows.select(F.lit(0).alias("batch"), F.col(key).alias("key"), F.col(text).alias("t"))
        fps = self.space.write(self._repeated("anchors"), "known")
        spool = self.space.write(texts.select("key", "t").mapInArrow(_spool(self.window, self.gram), "fp long, key long, at int"), "spool-again")
        asked = spool.join(fps.hint("merge"), "fp").groupBy("key").agg(F.collect_list("at").alias("ats")).withColumn("batch", F.lit(0))
        windows = self.space.write(self._windows(texts, asked), "windows-again")
        starts = self._starts(windows).select("key", "starts")
        self.space.drop("known", "spool-again", "windows-again", *self.asked)
        return _without(rows, docs.columns, key, starts, text, self.window, with_text)

    def close(self) -> None:
        """Takes the runs' names out of the session's catalog; with a path the index itself stays."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names.clear()
        if not self.kept:
            delete(self.spark, self.path)


def remove(docs: DataFrame, text: str = "text", window: int = 35, gram: int = 16, with_text: bool = True, index: FingerprintIndex | None = None, batches: int = 3) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and, if wanted, `text` without the words under repeated windows.

    A text that loses words becomes its kept words joined by one space; others stay as they are. docs are a new batch of
    `index`, compared with all that it has. Without one they go through an index of their own in so many batches, by hash
    of their keys, and are judged when all are in.
    """
    held = index or FingerprintIndex(docs.sparkSession, None, window, gram)
    key = free_name(docs, "_key")
    rows = keyed(docs, key, held.space, f"keyed-{uuid.uuid4().hex}")
    first, texts = held.state["batches"] + 1, rows.select(F.col(key).alias("key"), F.col(text).alias("t"))
    for i in range(1 if index else batches):
        held.take(texts if index else texts.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == i))
    starts = held.starts(first).select("key", "starts")
    if index is None:
        held.close()
    held.space.free()
    return _without(rows, docs.columns, key, starts, text, held.window, with_text)


def _without(rows: DataFrame, columns: list[str], key: str, starts: DataFrame, text: str, window: int, with_text: bool) -> DataFrame:
    names = [c for c in columns if c not in ("n_words", "n_removed", "kept_sha256") and (with_text or c != text)]
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    given_text, given_starts = free_name(rows, "_text"), free_name(rows, "_starts")
    joined = rows.join(starts.select(F.col("key").alias(key), F.col("starts").alias(given_starts)).hint("merge"), key, "left")
    return joined.select(*[c for c in names if c != text], F.col(text).alias(given_text), given_starts).mapInArrow(_cut(window, names, text, with_text, given_text, given_starts), schema)
