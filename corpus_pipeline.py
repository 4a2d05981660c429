"""A training-data pipeline over `documents`: language ID, SimHash near-dedup, substring dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import Workspace, released
from lexforge.llm.language import fit, held_out, identify
from lexforge.llm.mixing import mixed
from lexforge.llm.pieces import encode
from lexforge.llm.simhash import deduplicated
from lexforge.llm.substring import remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the model rejects go."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(spark, docs, model).where(~F.col("rejected")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts that share 0.8 and more of their five-word shingles are linked.

    Fingerprints have 128 bits, at the distance within which nearly all such texts are, so that hardly any link is chance.
    """
    return deduplicated(docs, shingle=5, distance=None, verify=0.8, words=2)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 and more words that are also found elsewhere."""
    return remove(docs, window=35).select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: every document once at least, and small sources up to twice as often as the largest."""
    return mixed(docs, repetition=2.0).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every text."""
    import public_tokenizers

    return encode(spark, docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]

#: No stage but the fourth could be put in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what lies between two of them is a written table, and the stages' work tables go with them.

    Null, empty and very long texts, repeated rows and ids, empty tables and further columns with any names are defined by
    the operators: a null or letterless text ends at the first stage, repeated rows are copies to the second, and further
    columns pass through the first four stages.
    """
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with released():
            docs = space.write(stage(spark, docs, sf_dir), str(i))
        if i:
            space.drop(str(i - 1))
    return docs
