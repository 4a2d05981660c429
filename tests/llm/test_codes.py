import hashlib
import random

import numpy as np
import pytest

from lexforge.llm import codes
from lexforge.llm.codes import compress, halves, nearest, squared, with_group_error


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Lloyd in whole numbers over (vec_id, vector), sorted; codes, errors and the digest."""
    rows = sorted(rows)
    xs = [[int(np.floor(scale * float(x))) for x in v] for _, v in rows]
    size = len(xs[0]) // parts
    books = [[x[p * size : (p + 1) * size] for x in xs[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda x, p: min((dist(x[p * size : (p + 1) * size], e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [pick(x, p)[1] for x in xs]
            entries_p = []
            for i, e in enumerate(books[p]):
                own = [x[p * size : (p + 1) * size] for x, c in zip(xs, of, strict=True) if c == i]
                entries_p.append([sum(c) // len(own) for c in zip(*own, strict=True)] if own else e)
            new.append(entries_p)
        books = new
    found = [[pick(x, p) for p in range(parts)] for x in xs]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{c:02x}" for _, c in f), sum(d for d, _ in f)) for (i, _), f in zip(rows, found, strict=True)}, digest


def vectors(seed: int, n: int, dim: int, step: float) -> list[tuple[int, list[float]]]:
    """Vectors on a grid, so that many distances tie."""
    r = random.Random(seed)
    return [(i * 3 % (3 * n + 1), [round(r.gauss(0, 1) / step) * step for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("step,entries", [(0.5, 16), (0.001, 32), (1.0, 256)])
def test_like_plain_lloyd(spark, step, entries):
    rows = vectors(1, 400, 8, step)
    table = spark.createDataFrame([(i, v, i % 7) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    got, books = compress(table, entries=entries)
    stored = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    want, digest = brute(stored, entries=entries)
    assert {r.vec_id: (r.code, r.error) for r in got.collect()} == want
    assert books.sha256() == digest
    sums = {r.label: r.label_error for r in with_group_error(got).collect()}
    assert sums == {k: sum(e for i, (_, e) in want.items() if i % 7 == k) for k in range(7)}
    i, (code, error) = next(iter(want.items()))
    x = [int(np.floor(1024 * c)) for c in dict(stored)[i]]
    assert sum((a - b) ** 2 for a, b in zip(x, books.decoded(code), strict=True)) == error


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0] * 8, "a"), (2, [0.5] * 8, None), (2, [0.25] * 8, None), (None, [2.0] * 8, "a"), (7, None, "a"), (8, [1.0] * 7 + [None], "b"), (9, [nan] * 8, "b"), (10, [inf] * 8, "b"), (11, [1.0] * 4, "c"), (12, [], "c"), (13, [1e300] * 8, "d"), (5, [1.0] * 8, "a")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label string, code int, _id int")
    coded, books = compress(table, entries=4)
    got = with_group_error(coded).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 2), (False, 2), (False, 5), (False, 5), (False, 11), (False, 12), (False, 13), (True, 0)]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert {r.code for r in by[11] + by[12]} == {None} and {r.label_error for r in by[11]} == {None}
    # Four entries are the rows of ids 2, 2, 5, 5; of the equal ones the first gets the far row too and follows it.
    assert sorted(r.code for r in by[2]) == ["00000000", "01010101"] and {r.code for r in by[5]} == {"03030303"} and by[13][0].code == "02020202"
    assert {r.label_error for r in by[2]} == {0} and len({r.label_error for r in by[5] + by[None]}) == 1
    assert len(books.entries) == 4 and books.entries[0].shape == (4, 2)
    none, books = compress(table.where("vec_id = 7"))
    assert none.count() == 0 and [len(e) for e in books.entries] == [0] * 4
    assert compress(table.where("vec_id = 12"))[0].collect()[0].code is None


def test_uneven_parts_and_no_rounds(spark):
    table = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0, 4.0], 1) for i in range(5)], "vec_id long, embedding array<double>, label int")
    got, books = compress(table, parts=2, entries=3, rounds=0)
    assert [e.shape for e in books.entries] == [(3, 3), (3, 2)]
    assert [r.code for r in got.orderBy("vec_id").collect()] == ["0000", "0100", "0200", "0200", "0200"]


def test_bounds_spare_distances():
    """Few distances are computed where the bounds are known, and none is missed."""
    r = np.random.default_rng(3)
    centres = r.integers(-2000, 2000, (64, 6))
    x = (centres[r.integers(0, 64, 3000)] + r.integers(-40, 40, (3000, 6))).astype(np.int64)
    d = np.sqrt(squared(x, centres))
    own, upper, lower = d.argmin(1), d.min(1) * (1 + 1e-9), d * (1 - 1e-9)
    moved = centres + r.integers(-9, 9, centres.shape)
    by = np.sqrt(((moved - centres) ** 2).sum(1))
    upper, lower = upper + by[own] + 1e-6, np.maximum(lower - by - 1e-6, 0)
    computed = nearest(x, moved, halves(moved), own, upper, lower)
    assert (own == squared(x, moved).argmin(1)).all() and computed < 0.1 * 64 * 3000


def test_large_numbers_are_exact():
    x = np.array([[codes.CHUNK << 16, -(1 << 26)], [3, 4]], np.int64)
    assert squared(x, x).tolist() == [[0, int(((x[0] - x[1]).astype(object) ** 2).sum())], [int(((x[0] - x[1]).astype(object) ** 2).sum()), 0]]
