"""Language identification by the nearest of several centroids per language.

A text is the vector of its character 1- to 3-grams (letters in lower case, everything else one space), hashed to a
fixed number of places, weighted by TF-IDF and brought to length one. Each language has a few centroids, found by
spherical k-means over a bounded sample of labelled rows; a text gets the language of the centroid with the highest
cosine. The cosine grows with the length of a text, so the bound under which it is rejected does: training texts and windows
of them of `SIZES` characters give, for each language and size, the cosine that nearly all of them reach; less a margin it
is the bound for texts of that size and more, up to the next.

Bounds of the model (all parameters): `per_language` training texts a language, `clusters` centroids each, `PLACES`
numbers in a centroid; so it grows with the number of languages, not with the rows. Prediction reads whole texts of all rows.

Defined cases: null text or no letter: `und`, score 0, rejected; null label: not learned from; no training rows: all
`und`; texts of any length are read whole; repeated rows are predicted alike and learned once; equal cosines: the language that comes first
in order; no rows: no rows; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm.common import Workspace, free_name, small_batches

PLACES = 1 << 14
#: Lengths, in letters and single spaces, from which on a bound of its own holds; shorter texts are not rejected.
SIZES = (16, 32, 64, 128, 256, 512, 1024)
UNKNOWN = "und"
_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text; None if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    letter = _LETTER[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32).astype(np.uint64)
    # Of a run of spaces one is left, and one stands at both ends.
    kept = points[letter | np.concatenate([[False], letter[:-1]])]
    points = np.concatenate([[np.uint64(32)], kept, np.full(int(kept[-1] != 32), 32, np.uint64)])
    mix = np.uint64(0x9E3779B97F4A7C15)
    one = points * mix
    two = (one[:-1] ^ (points[1:] + np.uint64(1 << 24))) * mix
    three = (two[:-1] ^ (points[2:] + np.uint64(1 << 25))) * mix
    return np.bincount(np.concatenate([one, two, three]) >> np.uint64(50), minlength=PLACES).astype(np.float32)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # of each centroid and size: the cosine under which a text is rejected


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means. It starts from rows at even steps of the order by cosine to the mean, so no odd row has a centroid for itself.

    A cluster that loses all its rows goes.
    """
    order = np.argsort(x @ _unit(x.mean(0)), kind="stable")
    start = sorted({int(order[(2 * i + 1) * len(x) // (2 * k)]) for i in range(k)})
    c = x[start]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        size = np.bincount(near, minlength=len(c))
        c = _unit(np.stack([x[near == j].sum(0) for j in np.flatnonzero(size)]))
    return c


def size_of(counts: np.ndarray) -> np.ndarray:
    """Place in SIZES of the length of texts by their n-gram counts (rows), counted from 1; 0: shorter than all."""
    return np.searchsorted(SIZES, (counts.sum(-1) + 3) / 3 - 2, side="right")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 400, clusters: int = 4, margin: float = 0.85) -> Model:
    """Learns from labelled rows with a text and a label.

    Of each language the `per_language` different texts with the smallest hashes are taken (all, if there are fewer), of
    those that have a letter; copies count once. Only their vectors, not the texts, come to the driver, one a text.
    `margin`: part of the low (0.5 %) cosine of the training texts of its size that a text must reach.
    """
    rows = labelled.where(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("h"))
    distinct = rows.select("lang", "h").distinct()
    # Spark limits the ranks before the shuffle too, so a language's task gets `per_language` rows of each task before it at most.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = distinct.withColumn("place", place).where(F.col("place") <= per_language).select("lang", "h")
    space = Workspace(labelled.sparkSession, "language")
    # One row a text: at most `per_language` a language.
    sample = space.write(rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")), "sample")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [grams(t.as_py()) for t in b.column("text")]
            at = [None if v is None else np.flatnonzero(v) for v in found]
            cells = [[None if v is None else x.astype(kind).tobytes() for v, x in zip(found, some, strict=True)] for some, kind in ((at, "<u2"), ([None if v is None else v[a] for v, a in zip(found, at, strict=True)], "<f4"))]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), *(pa.array(c, pa.binary()) for c in cells)], ["lang", "h", "at", "n"])

    taken: dict[str, list] = {}
    found = sample.mapInArrow(vectors, "lang string, h long, at binary, n binary").where("at IS NOT NULL").orderBy("lang", "h")
    for r in found.toLocalIterator():
        taken.setdefault(r["lang"], []).append((np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<f4")))
    if not taken:
        return Model([], np.zeros((0, PLACES), np.float32), np.ones(PLACES, np.float32), np.zeros((0, len(SIZES) + 1)))
    df = np.zeros(PLACES)
    for group in taken.values():
        for at, _ in group:
            df[at] += 1
    total = sum(map(len, taken.values()))
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    own: dict[str, np.ndarray] = {}
    for name in sorted(taken):
        x = np.zeros((len(taken[name]), PLACES), np.float32)
        for row, (at, n) in zip(x, taken.pop(name), strict=True):
            row[at] = n * idf[at]
        own[name] = _cluster(_unit(x), clusters).astype(np.float32)
        del x
    bounds = _bounds(sample, own, idf, margin)
    space.drop("")
    languages = [name for name, c in own.items() for _ in c]
    return Model(languages, np.concatenate(list(own.values())), idf, np.array([bounds[name] for name in languages]))


def _bounds(sample: DataFrame, own: dict[str, np.ndarray], idf: np.ndarray, margin: float) -> dict[str, list[float]]:
    """For each language the bound of each size, from the cosines of its training texts and of windows in their middle; only numbers come to the driver."""
    shared = sample.sparkSession.sparkContext.broadcast((own, idf))

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, weights = shared.value
        for b in batches:
            lang, size, cosine = [], [], []
            for name, t in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                t = t.as_py()
                for window in [t, *(t[(len(t) - s) // 2 :][:s] for s in SIZES if s < len(t))]:
                    v = grams(window)
                    if v is not None and name in centroids:
                        lang.append(name)
                        size.append(int(size_of(v)))
                        cosine.append(float((centroids[name] @ _unit(v * weights)).max()))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(cosine, pa.float64())], ["lang", "size", "cosine"])

    low = sample.mapInArrow(cosines, "lang string, size int, cosine double").groupBy("lang", "size").agg(F.percentile("cosine", 0.005).alias("low")).collect()
    known = {(r["lang"], r["size"]): margin * r["low"] for r in low}
    out = {}
    for name in own:
        out[name] = [0.0]
        for size in range(1, len(SIZES) + 1):  # a size without a text: as the size below
            out[name].append(known.get((name, size), out[name][-1]))
    return out


def identify(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score (cosine, 0 to 1) and rejected."""
    small_batches(spark)
    new = ("lang_pred", "score", "rejected")
    shared = spark.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name not in new and (keep_text or f.name != text)]
    names, given = [f.name for f in rest], free_name(docs, "_text")
    schema = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = np.ascontiguousarray((m.centroids * m.idf).T)
        for b in batches:
            column = b.column(given)
            lang, score, rejected = [UNKNOWN] * len(column), [0.0] * len(column), [True] * len(column)
            if m.languages:
                for start in range(0, len(column), 128):
                    rows, at = [], []
                    for i in range(start, min(start + 128, len(column))):
                        v = grams(t) if (t := column[i].as_py()) else None
                        if v is not None:
                            rows.append(v)
                            at.append(i)
                    if not rows:
                        continue
                    x = np.stack(rows)
                    cosine = (x @ weights) / np.maximum(np.sqrt((x * m.idf) ** 2 @ np.ones(PLACES, np.float32)), 1e-12)[:, None]
                    for i, best, row, size in zip(at, cosine.argmax(1), cosine, size_of(x), strict=True):
                        lang[i], score[i] = m.languages[best], float(min(1.0, max(0.0, row[best])))
                        rejected[i] = bool(row[best] < m.least[best, size])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names, *new])

    return docs.select(*names, F.col(text).alias(given)).mapInArrow(run, schema)
