"""Relevance kept by content: how often each term stands in each field of a text is counted once and stored under the text's hash.

A changed document is a new hash and is counted alone; a new term is counted alone, over the documents that are there; and
changed weights, caps or thresholds count nothing anew, since the store holds plain counts. Scores are then a join of the
counts with the configuration. What belongs together (the counts, the hashes and the terms that they cover) is one commit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.text import saturate
from lexforge.operators.history import hash_of
from lexforge.operators.terms import Relevance, Term, _folded, _occurrences
from lexforge.sources.store import Snapshot, Store, Table

TABLES = {
    "counted": Table("hash string", ("hash",)),
    "terms": Table("field string, term string, live boolean", ("field", "term")),
    "counts": Table("hash string, field string, term string, n int", ("hash",)),
}


def _name(term: Term) -> str:
    """What a term's count hangs on."""
    return "\x1f".join((term.match, term.term, term.pattern or ""))


class ScoreStore:
    """Counts of one kind of documents, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, fields: Sequence[str], buckets: int = 16):
        self.spark, self.fields = spark, tuple(fields)
        self.store = Store(spark, path, TABLES, buckets)

    def _hashed(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("_hash", hash_of(*self.fields))

    def update(self, docs: DataFrame, config: Relevance) -> dict[str, int]:
        """Counts what is missing for these documents and this configuration; returns how many texts and terms were new."""
        wanted = {(f, _name(t)): t for f in self.fields if f in config.field_weights for t in (*config.terms, *config.negative)}
        texts = self._hashed(docs).select(F.col("_hash").alias("hash"), *self.fields).dropDuplicates(["hash"])
        told: dict[str, int] = {}

        def decide(at: Snapshot) -> dict[str, DataFrame]:
            known = {(r.field, r.term) for r in self.store.read("terms", at).where("live").collect()}  # a configuration's terms
            counted = self.store.read("counted", at)
            added = [k for k in wanted if k not in known]
            fresh = texts.join(counted, "hash", "left_anti")
            parts = [self._counts(fresh, {k: wanted[k] for k in wanted})]
            if added:
                # Texts that other documents had are not at hand and can't be counted; they are new again when they come back.
                parts.append(self._counts(texts.join(counted, "hash", "left_semi"), {k: wanted[k] for k in added}))
            told.update(texts=fresh.count(), terms=len(added))
            if not told["texts"] and not added:
                return {}
            live = [(*k, k in wanted) for k in sorted({*known, *wanted})]
            return {"counts": reduce(DataFrame.unionByName, parts), "counted": fresh.select("hash"), "terms": self.spark.createDataFrame(live, TABLES["terms"].schema)}

        self.store.change(decide, {"counted": None, "terms": None}, append=("counts",))
        return told

    def _counts(self, texts: DataFrame, terms: dict[tuple[str, str], Term]) -> DataFrame:
        """(hash, field, term, n) where a term is found; each text is folded and cut once."""
        folded, names = _folded(texts, sorted({f for f, _ in terms}))
        each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(n).alias("term"), _occurrences(names[f], t).cast("int").alias("n")) for (f, n), t in terms.items()])
        return folded.select("hash", F.inline(each)).where("n > 0")

    def scores(self, docs: DataFrame, config: Relevance) -> DataFrame:
        """docs, which `update` has seen with these terms, with the columns of `terms.score_relevance`."""
        rows = []
        for good, terms in ((True, config.terms), (False, config.negative)):
            for i, (f, t) in enumerate((f, t) for f in config.field_weights if f in docs.columns for t in terms):
                rows.append((f, _name(t), good, i, float(t.weight * config.field_weights[f]), t.concept, t.term, f == "title" and t.weight >= config.decisive_weight))
        table = self.spark.createDataFrame(rows, "field string, term string, good boolean, i int, weight double, concept string, shown string, decisive boolean")
        held = self.store.read("counts").groupBy("hash", "field", "term").agg(F.max("n").alias("n"))
        points = held.join(table, ["field", "term"]).withColumn("p", F.least("n", F.lit(config.max_occurrences)) * F.col("weight"))
        good, title = F.col("good"), F.col("field") == "title"
        sums = points.groupBy("hash").agg(
            F.sum(F.when(good, F.col("p")).otherwise(0.0)).alias("_good"),
            F.sum(F.when(~good, F.col("p")).otherwise(0.0)).alias("_bad"),
            F.array_sort(F.collect_set(F.when(good & (F.col("p") > 0), F.col("concept")))).alias("concepts"),
            F.max(good & F.col("decisive")).alias("_decisive"),
            F.max(~good & title).alias("_title_bad"),
            F.array_sort(F.collect_list(F.when(good & (F.col("p") > 0), F.struct((-F.col("p")).alias("p"), "i", "shown")))).alias("_hits"),
        )
        out = self._hashed(docs).join(sums.withColumnRenamed("hash", "_hash"), "_hash", "left")
        concepts = F.coalesce("concepts", F.array().cast("array<string>"))
        bonus = F.least(F.greatest(F.size(concepts) - 1, F.lit(0)) * config.bonus_per_concept, F.lit(config.max_bonus))
        raw = F.greatest(F.lit(0.0), F.coalesce("_good", F.lit(0.0)) + bonus - F.coalesce("_bad", F.lit(0.0)))
        out = out.withColumns({"raw": raw, "matched_terms": F.coalesce(F.array_distinct(F.transform("_hits", lambda h: h["shown"])), F.array().cast("array<string>"))}).withColumn("concepts", concepts)
        score = F.bround(100.0 * saturate(F.col("raw"), config.saturation)).cast("int")
        lifted = F.coalesce("_decisive", F.lit(False)) & ~F.coalesce("_title_bad", F.lit(False)) & (score < config.floor)
        out = out.withColumn("title_floor", lifted).withColumn("score", F.when(lifted, config.floor).otherwise(score))
        label = F.when(F.col("score") >= config.relevant_at, "relevant").when(F.col("score") >= config.possible_at, "possible").otherwise("not_relevant")
        return out.withColumn("classification", label).drop("_hash", "_good", "_bad", "_decisive", "_title_bad", "_hits")
