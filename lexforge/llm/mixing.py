"""Temperature mixing of sources to target weights.

A source's share p of all tokens becomes the weight p ** a, normalised. The exponent a in [0, 1] (1: as found, 0: even)
is bisected: either down to a target entropy of the weights, as a part of its range from a = 1 to a = 0, or as far down
as the repetition limit allows, which bounds how many times more often than the largest source any source is passed.

The weights are realised as budgets of tokens: source i gets b_i = w_i * B. By default B is the least for which every
source is passed at least once, so no document is lost and small sources repeat; a given budget may also cut sources.
A source is passed as a permutation of its documents, floor(b_i / T_i) times whole and once more up to the rest of its
budget. The permutation orders documents by (bin, hash); its first documents whose tokens stay within the rest form the
last, partial pass. The mixed stream consists of `blocks` blocks with equal budgets: the copy at position x of its
source's b_i tokens goes to block floor(x / b_i * blocks), so each block holds the sources at their weights, and blocks
are permuted by a hash.

Sums by (source, bin) come from map-side partial sums; a prefix sum never spans more than `BINS` bins or the documents
of one bin. Exponents are tried 31 at once, five steps of the bisection in one pass over the table of source totals, so
the table itself stays in Spark.

Defined cases: null source: a source of its own; null, empty or blank text: no tokens, passed once with each whole pass;
sources without tokens: weight 0, passed once; repeated rows: each a document; equal hashes in a permutation: by the
rows' keys; no rows: no rows; texts of any length are counted whole; other columns, whatever their names, pass through.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import Workspace, free_name, keyed, words

BINS = 1024
#: The bisection ends at steps of 1 / STEPS in the exponent.
STEPS = 1 << 25
SOURCE = "source"


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _curves(totals: DataFrame, exponents: list[float]) -> list[dict]:
    """Entropy of the weights, and the largest repetition against the largest source, at each exponent. totals: (share,) with shares above 0."""
    e = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(exponents)])).alias("e")
    tried = totals.select("share", e).select("share", "e.*").withColumn("q", F.pow("share", F.col("a")))
    # With Z = sum of q: entropy = ln Z - sum(q ln q) / Z; a source is passed q / share times for the largest one's q0 / share0.
    sums = tried.groupBy("i").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("qlq"), F.max(F.col("q") / F.col("share")).alias("most"), F.min(F.col("q") / F.col("share")).alias("least"))
    rows = sums.select("i", (F.log("z") - F.col("qlq") / F.col("z")).alias("entropy"), (F.col("most") / F.col("least")).alias("repetition")).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["i"])]


def bisect_exponent(totals: DataFrame, repetition: float | None = None, entropy: float | None = None) -> float:
    """The exponent: the smallest that keeps within `repetition`, or the largest that reaches the part `entropy` (0 to 1) of the range of entropies."""
    if (repetition is None) == (entropy is None):
        raise ValueError("give a repetition limit or an entropy")
    ends = _curves(totals, [0.0, 1.0])
    if not ends:
        return 1.0
    goal = None if entropy is None else ends[1]["entropy"] + entropy * (ends[0]["entropy"] - ends[1]["entropy"])

    def too_even(r: dict) -> bool:
        return r["repetition"] > repetition if goal is None else r["entropy"] > goal + 1e-12

    if not too_even(ends[0]):
        return 0.0
    low, high = 0, STEPS  # too even at low, not so at high
    while high - low > 1:
        step = max(1, (high - low) // 32)
        tried = [x for x in range(low + step, high, step)][:31]
        for x, r in zip(tried, _curves(totals, [x / STEPS for x in tried]), strict=True):
            if too_even(r):
                low = x
            else:
                high = x
                break
    return high / STEPS


def plan(docs: DataFrame, space: Workspace, repetition: float | None = 2.0, entropy: float | None = None, budget: int | None = None, source: str = SOURCE) -> DataFrame:
    """(source, tokens, weight, target, passes, rest) per source. docs: (source, n_tokens)."""
    totals = space.write(docs.groupBy(source).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "totals")
    every = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.where("tokens > 0").select((F.col("tokens") / F.lit(float(max(every, 1)))).alias("share"))
    a = bisect_exponent(shares, repetition, entropy)
    q = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(every, 1))), F.lit(a))).otherwise(F.lit(0.0))
    weighed = totals.withColumn("q", q)
    z = weighed.agg(F.sum("q").alias("z"), F.max(F.when(F.col("q") > 0, F.col("tokens") / F.col("q"))).alias("cover")).first()
    scale = (z["cover"] or 0.0) if budget is None else budget / (z["z"] or 1.0)
    # The largest source's target must not fall short of its tokens by rounding.
    target = F.round(F.col("q") * F.lit(scale)).cast("long")
    out = weighed.withColumns({"exponent": F.lit(a), "weight": F.col("q") / F.lit(z["z"] or 1.0), "target": target})
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(1).cast("int")
    out = out.withColumn("passes", whole).withColumn("rest", F.when(F.col("tokens") > 0, F.col("target") - F.col("passes") * F.col("tokens")).otherwise(0))
    return space.write(out.drop("q"), "plan")


def mixed(docs: DataFrame, text: str = "text", source: str = SOURCE, repetition: float | None = 2.0, entropy: float | None = None, budget: int | None = None, blocks: int = 64, seed: int = 7) -> DataFrame:
    """docs, each row as often as its source's budget says, with n_tokens, copy (from 0), block and block_order."""
    space = Workspace(docs.sparkSession, "mixing")
    key = free_name(docs, "_key")
    rows = keyed(docs, key, space)
    small = space.write(rows.select(F.col(key).alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("_source"), F.col(source).isNull().alias("_none"), token_count(F.col(text)).alias("n_tokens")), "small")
    by = ["_source", "_none"]
    small = small.withColumn("_s", F.struct(*by))
    sources = plan(small.select(F.to_json("_s").alias("s"), "n_tokens"), space, repetition, entropy, budget, "s")
    h = F.xxhash64("_key", F.lit(seed))
    binned = small.select("_key", "n_tokens", F.to_json("_s").alias("s"), h.alias("h"), F.shiftrightunsigned(h, 54).cast("int").alias("bin"))
    bins = binned.groupBy("s", "bin").agg(F.sum("n_tokens").alias("b"))
    order = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    starts = bins.withColumn("before", F.coalesce(F.sum("b").over(order), F.lit(0)))
    starts = space.write(starts.join(sources.hint("merge"), "s").select("s", "bin", "before", "tokens", "target", "passes", "rest"), "starts")
    inside = F.sum("n_tokens").over(Window.partitionBy("s", "bin", "fine").orderBy("h", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Bins are cut finer for the sums by document, so that a window stays small in a hot source.
    fine = binned.withColumn("fine", (F.shiftrightunsigned("h", 44) % BINS).cast("int"))
    fines = fine.groupBy("s", "bin", "fine").agg(F.sum("n_tokens").alias("b"))
    in_bin = Window.partitionBy("s", "bin").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    offsets = fines.withColumn("skip", F.coalesce(F.sum("b").over(in_bin), F.lit(0))).join(starts, ["s", "bin"]).drop("b")
    placed = fine.withColumn("inside", inside).join(offsets.hint("merge"), ["s", "bin", "fine"])
    end = F.col("before") + F.col("skip") + F.col("inside")
    copies = F.col("passes") + F.when((F.col("rest") > 0) & (end <= F.col("rest")), 1).otherwise(0)
    listed = placed.withColumn("at", end - F.col("n_tokens")).withColumn("times", copies.cast("int")).where("times > 0")
    at = F.col("copy") * F.col("tokens") + F.col("at")
    block = F.least(F.lit(blocks - 1), F.floor(at / F.greatest(F.col("target"), F.lit(1)) * blocks)).cast("int")
    chosen = listed.select("_key", "n_tokens", "h", "tokens", "target", "at", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    chosen = space.write(chosen.select("_key", "n_tokens", "copy", block.alias("block"), F.xxhash64("h", "copy").alias("block_order")), "chosen")
    space.drop("small", "totals", "plan", "starts")
    space.free()
    chosen = chosen.withColumnRenamed("_key", key)
    return rows.drop("n_tokens", "copy", "block", "block_order").join(chosen.hint("merge"), key).select(*[c for c in docs.columns if c not in ("n_tokens", "copy", "block", "block_order")], "n_tokens", "copy", "block", "block_order")
