"""Vector code compression: product quantisation, its codebooks found by Lloyd's rounds with Elkan's bounds.

Vectors become integers floor(scale * x) and are cut into consecutive parts; each part position has a codebook of its own.
What a round knows of a row is kept in a written table beside its integers: for each part the entry it has, an upper bound
of the distance to that entry, and one lower bound for every entry, held as a byte times a step of the row (rounded down,
so that it stays a bound; a byte an entry is four times what a vector of 64 floats takes). The next round shifts all bounds
by how far the entries moved and computes a distance only where the triangle inequality leaves it open:

- no entry is looked at where the upper bound is less than half the distance from the row's entry to the nearest other;
- an entry is left out where its lower bound, or half its distance from the row's entry, is greater than the upper bound.

Both tests are strict and bounds are rounded outwards, so an entry that ties is never left out; distances that are computed
are exact integers, and ties between them go to the lower index. Sums for new entries are made where the rows are read, so
that a task sends one row an entry. Each round's state is a table in the shared folder that takes the last one's place.

Only codebooks go through the driver: parts * entries * components numbers, whatever the number of rows.

Defined cases: vectors that are null or hold a null or non-finite component are dropped; components beyond 2**26 after
scaling (less, above 512 components) count as that; the length of vectors is that of the smallest id's, and rows of another
length, empty ones too, have no code and no error; where the parts can't be of equal length the first ones are longer by
one; fewer rows than entries: as many entries as rows; repeated ids and rows: each row is coded, and of equal ids the
smaller vector starts first; null ids are coded and start last; null labels are one label; no rows: no rows, and empty
codebooks; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm.common import Workspace

#: Rows whose distances are held together.
CHUNK = 1024
#: Distances that are computed together where bounds leave pairs open.
PAIRS = 1 << 18


@dataclass
class Codebooks:
    """entries[p]: the entries of part p, as rows of integers."""

    entries: list[np.ndarray]

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()

    def decoded(self, code: str) -> list[int]:
        """The integers that a code of two hex digits a part stands for."""
        return [x for p, part in enumerate(self.entries) for x in part[int(code[2 * p : 2 * p + 2], 16)].tolist()]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x from all rows of y, as int64."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in y], 1)


def _up(v: np.ndarray) -> np.ndarray:
    return v * (1 + 1e-12) + 1e-9


def _down(v: np.ndarray) -> np.ndarray:
    return np.maximum(v * (1 - 1e-12) - 1e-9, 0)


def halves(book: np.ndarray) -> np.ndarray:
    """Half the distance between all entries, rounded down; an entry's from itself is infinite."""
    half = _down(np.sqrt(squared(book, book)) / 2)
    np.fill_diagonal(half, np.inf)
    return half


def nearest(x: np.ndarray, book: np.ndarray, half: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Makes `own` the nearest entry of each row and tightens the bounds, in place; returns how many distances it computed."""
    nearest_other = half.min(1, initial=np.inf)
    open_ = np.flatnonzero(upper >= nearest_other[own])
    best = ((x[open_] - book[own[open_]]) ** 2).sum(1)
    computed = len(open_)
    upper[open_] = _up(np.sqrt(best))
    lower[open_, own[open_]] = _down(np.sqrt(best))
    still = upper[open_] >= nearest_other[own[open_]]
    open_, best = open_[still], best[still]
    for start in range(0, len(open_), max(1, PAIRS // max(1, len(book)))):
        at = slice(start, start + max(1, PAIRS // max(1, len(book))))
        rows, least = open_[at], best[at]
        now = own[rows]
        left = (lower[rows] <= upper[rows, None]) & (half[now] <= upper[rows, None])
        i, c = np.nonzero(left)
        if not len(i):
            continue
        d = ((x[rows[i]] - book[c]) ** 2).sum(1)
        computed += len(i)
        lower[rows[i], c] = _down(np.sqrt(d))
        order = np.lexsort((c, d, i))
        first = order[np.concatenate([[True], np.diff(i[order]) > 0])]
        i, c, d = i[first], c[first], d[first]
        wins = (d < least[i]) | (d == least[i]) & (c < now[i])
        i, c, d = i[wins], c[wins], d[wins]
        own[rows[i]] = c
        upper[rows[i]] = _up(np.sqrt(d))
    return computed


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value a row."""
    n, width = len(rows), rows[:1].nbytes
    if n * width > (1 << 31) - 1:
        raise ValueError("an Arrow batch holds too many vectors")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _rows(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _cuts(dim: int, parts: int) -> list[int]:
    return [0, *np.cumsum([dim // parts + (p < dim % parts) for p in range(parts)]).tolist()]


def _start(books: list[np.ndarray], cuts: list[int], keep: list[str]):
    """Rows (keep, v) into the first state: every distance is computed once."""
    k = len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                some = b.slice(at, CHUNK)
                x = some.column("v").flatten().to_numpy().astype(np.int64).reshape(some.num_rows, cuts[-1])
                own, upper, lower = _empty(len(x), len(books), k)
                for p, book in enumerate(books):
                    d = squared(x[:, cuts[p] : cuts[p + 1]], book)
                    own[:, p] = d.argmin(1)
                    upper[:, p] = _up(np.sqrt(d.min(1)))
                    lower[:, p] = _down(np.sqrt(d))
                yield _state(some, keep, x, own, upper, lower)

    return run


def _empty(n: int, parts: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts, k))


def _state(rows: pa.RecordBatch, keep: list[str], x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    step = np.maximum(lower.max(2) / 255 * (1 + 1e-12), 1e-300)
    held = np.minimum(lower / step[:, :, None], 255).astype(np.uint8)
    made = [_binary(x.astype("<i4")), _binary(own.astype("<u2")), _binary(np.stack([upper, step], 1).reshape(len(x), -1).astype("<f8")), _binary(held.reshape(len(x), -1))]
    return pa.RecordBatch.from_arrays([*(rows.column(n) for n in keep), *made], [*keep, "x", "own", "bounds", "lower"])


def _advance(books: list[np.ndarray], moved: list[np.ndarray], cuts: list[int], keep: list[str], last: bool):
    """A state into the next one, for entries that moved so far; last: into (keep, code, error)."""
    parts, k = len(books), len(books[0])
    half = [halves(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                some = b.slice(at, CHUNK)
                x = _rows(some.column("x"), "<i4").astype(np.int64)
                own = _rows(some.column("own"), "<u2").astype(np.int64)
                upper, step = np.moveaxis(_rows(some.column("bounds"), "<f8").reshape(len(x), 2, parts), 1, 0)
                upper = upper.copy()
                lower = _rows(some.column("lower"), np.uint8).reshape(len(x), parts, k) * (step * (1 - 1e-12))[:, :, None]
                error = np.zeros(len(x), np.int64)
                for p, book in enumerate(books):
                    part = x[:, cuts[p] : cuts[p + 1]]
                    mine, u, low = own[:, p].copy(), _up(upper[:, p] + moved[p][own[:, p]]), _down(lower[:, p] - moved[p])
                    nearest(part, book, half[p], mine, u, low)
                    own[:, p], upper[:, p], lower[:, p] = mine, u, low
                    if last:
                        error += ((part - book[mine]) ** 2).sum(1)
                if last:
                    code = pa.array([r.tobytes().hex() for r in own.astype(np.uint8)], pa.string())
                    yield pa.RecordBatch.from_arrays([*(some.column(n) for n in keep), code, pa.array(error)], [*keep, "code", "error"])
                else:
                    yield _state(some, keep, x, own, upper, lower)

    return run


def _sums(parts: int, k: int, cuts: list[int]):
    """One row for each part and entry that a task's rows have: their number and the sums of their components."""
    width = max(b - a for a, b in zip(cuts, cuts[1:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            x, own = _rows(b.column("x"), "<i4").astype(np.int64), _rows(b.column("own"), "<u2").astype(np.int64)
            for p in range(parts):
                np.add.at(total[p, :, : cuts[p + 1] - cuts[p]], own[:, p], x[:, cuts[p] : cuts[p + 1]])
                count[p] += np.bincount(own[:, p], minlength=k)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), *(pa.array(total[p, e, i]) for i in range(width))], ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    return run, "part int, entry int, n long" + "".join(f", s{i} long" for i in range(width))


def _moved(state: DataFrame, books: list[np.ndarray], cuts: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Entries at the floor of the mean of their rows, and how far each moved, rounded up; at most parts * entries rows come to the driver."""
    run, schema = _sums(len(books), len(books[0]), cuts)
    made = state.select("x", "own").mapInArrow(run, schema)
    sums = [c for c in made.columns if c[0] == "s"]
    rows = made.groupBy("part", "entry").agg(*[F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in ("n", *sums)]).collect()
    new = [b.copy() for b in books]
    for r in rows:
        width = cuts[r.part + 1] - cuts[r.part]
        new[r.part][r.entry] = [int(r[c]) // int(r.n) for c in sums[:width]]
    return new, [_up(np.sqrt(((a - b) ** 2).sum(1))) for a, b in zip(new, books, strict=True)]


def _integers(vector: Column, scale: float, most: int) -> Column:
    """floor(scale * x) of every component, at most `most` from zero; null if the vector or a component is null or not finite."""
    x = F.transform(vector.cast("array<double>"), lambda v: F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.floor(F.greatest(F.least(v * scale, F.lit(float(most))), F.lit(-float(most)))).cast("int")))
    return F.when(~F.exists(x, lambda v: v.isNull()), x)


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error) of every valid row, the codebooks) after so many rounds and a last assignment."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    space, keep = Workspace(vectors.sparkSession, "codes"), ["_id", "_label"]
    named = vectors.select(F.col(vec_id).alias("_id"), F.col(label).alias("_label"), F.col(embedding).alias("_e"))
    first = lambda v, n: named.select("_id", v.alias("v")).where("v IS NOT NULL").orderBy(F.asc_nulls_last("_id"), "v").limit(n)
    start = first(_integers(F.col("_e"), scale, 1 << 26), 1).collect()
    dim = len(start[0].v) if start else 0
    rows = named.select(*keep, _integers(F.col("_e"), scale, min(1 << 26, math.isqrt((1 << 60) // max(1, dim)))).alias("v")).where("v IS NOT NULL")
    if not dim:
        return _coded(rows, vec_id, label), Codebooks([np.zeros((0, 0), np.int64)] * parts)
    cuts = _cuts(dim, parts)
    lead = np.array([r.v for r in rows.where(F.size("v") == dim).orderBy(F.asc_nulls_last("_id"), "v").limit(entries).collect()], np.int64)
    books = [lead[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    kinds = T.StructType([f for f in rows.schema.fields if f.name in keep])
    held = T.StructType([*kinds.fields, *[T.StructField(n, T.BinaryType()) for n in ("x", "own", "bounds", "lower")]])
    state = space.write(rows.where(F.size("v") == dim).mapInArrow(_start(books, cuts, keep), held), "state0")
    moved = [np.zeros(len(b)) for b in books]
    for i in range(rounds):
        books, moved = _moved(state, books, cuts)
        if i < rounds - 1:
            state = space.write(state.mapInArrow(_advance(books, moved, cuts, keep, False), held), f"state{i + 1}")
            space.drop(f"state{i}")
    last = state.mapInArrow(_advance(books, moved, cuts, keep, True), T.StructType([*kinds.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    coded = last.select(F.col("_id").alias(vec_id), F.col("_label").alias(label), "code", "error")
    other = _coded(rows.where(F.size("v") != dim), vec_id, label)
    written = space.write(coded.unionByName(other), "coded")
    space.drop(f"state{max(0, rounds - 1)}")
    return written, Codebooks(books)


def _coded(rows: DataFrame, vec_id: str, label: str) -> DataFrame:
    """Rows that no codebook fits."""
    return rows.select(F.col("_id").alias(vec_id), F.col("_label").alias(label), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))


def with_group_error(coded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """coded, a written table, with label_error: the error summed over equal labels, nulls together.

    Sums are combined before they are shuffled; they are written, so that the join back can split a label that many rows have.
    """
    space = Workspace(coded.sparkSession, "codes-labels")
    sums = space.write(coded.groupBy(F.col(label).alias("_of")).agg(F.sum(F.col(error).cast("decimal(19,0)")).cast("long").alias("label_error")), "sums")
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_of")), "left").drop("_of")
