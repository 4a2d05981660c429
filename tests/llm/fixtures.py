"""Documents with the odd cases: nulls, empty and very long texts, repeated rows and ids, clashing extra columns."""

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
CLASHING = ["n_words", "shard", "slot", "score", "rejected", "fp", "component_id", "copy", "block", "ids", "size", "kept", "starts", "batch", "at", "key", "_key", "_text", "_starts", "_source", "_words", "_lines", "_unit", "_slice", "text_hash", "giant", "_html", "node", "root", "t", "f0"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(1, 7))) for _ in range(n))


def odd_texts() -> list[tuple]:
    shared = prose(1, 60)
    texts = [None, "", " \n\t ", "one", "A b\x0bC", prose(2, 34), prose(3, 35), prose(4, 50) + "\n" + shared, shared + " " + prose(5, 40), "x " * 90, prose(6, 20_000), "ends. Oné ▁ two  \U0001f600 \x00 </s>", shared]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, prose(7, 80), "de", "s1", 1), (3, prose(8, 40), "de", "s1", 1)]


def odd_docs(spark):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in odd_texts()], SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
