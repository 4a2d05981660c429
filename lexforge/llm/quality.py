r"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every measure is computed inside its row: words, symbols, repeated lines, words in repeated three-word windows and stop
words. No text is cut and nothing is shuffled.

Defined cases: null or blank text: all measures zero and the base fails; text of any length is measured whole; repeated
rows: each; ties do not arise; no rows: no rows; other columns, whatever their names, pass through, but those named like a
measure are replaced by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import words

# Function words of the four languages that the corpus is written in.
STOP_WORDS = (
    "the of and to in is that it for on with as are this be by from at or an not have was which"
    " der die das und ist von zu den mit sich des auf für nicht ein eine dem im auch als"
    " de la el que en los se del las un por con una su para es al lo como más"
    " le les et des une dans pour qui est sur pas au avec du ce il elle"
).split()

#: measure, least and most value; None: open. Measures are those of `MEASURES`.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_ratio", None, 0.25),
    ("stop_word_ratio", 0.03, None),
    ("dup_line_ratio", None, 0.4),
    ("repeat_word_ratio", None, 0.5),
)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


MEASURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "mean_word_chars": lambda: _ratio("word_chars", "n_words"),
    "symbol_ratio": lambda: _ratio("n_symbols", "n_words"),
    "stop_word_ratio": lambda: _ratio("n_stop_words", "n_words"),
    "dup_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeat_word_ratio": lambda: _ratio("n_repeat_words", "n_words"),
}


def compile_rules(rules=RULES) -> Column:
    """True where every rule holds."""
    tests = [F.lit(True)]
    for measure, least, most in rules:
        value = MEASURES[measure]()
        tests += [value >= least] * (least is not None) + [value <= most] * (most is not None)
    return reduce(lambda a, b: a & b, tests)


def _marks(places: Column, known: Column, same) -> Column:
    """Those of the sorted `places` of which a neighbour is the same."""
    return F.filter(places, lambda x, j: ((j > 0) & same(F.get(known, j - 1), x)) | ((j < F.size(known) - 1) & same(F.get(known, j + 1), x)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the long columns n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words and n_repeat_words."""
    # The caller's columns wait in a struct, so that no name can clash.
    out = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    stop = [F.lit(x) for x in STOP_WORDS]
    out = out.withColumn("_words", words(t))
    # A window's place is packed below the upper bits of its hash, so that sorting longs brings equal windows together.
    n = F.size("_words")
    out = out.withColumn("_bits", F.ceil(F.log2(n + 1)).cast("int"))
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1
    out = out.withColumns(
        {
            "_low": low,
            "_packed": F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: window(i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<bigint>")),
            "_lines": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    # Neighbours that share the upper bits are few; among them the whole hashes are sorted with their places and decide.
    upper = lambda a, b: a.bitwiseXOR(b).between(0, F.col("_low"))
    out = out.withColumn("_near", _marks(F.col("_packed"), F.col("_packed"), upper))
    out = out.withColumn("_near", F.sort_array(F.transform("_near", lambda x: F.struct(window(x.bitwiseAND(F.col("_low")).cast("int")).alias("h"), x.bitwiseAND(F.col("_low")).cast("int").alias("i")))))
    out = out.withColumn("_hits", F.transform(_marks(F.col("_near"), F.col("_near"), lambda a, b: a["h"] == b["h"]), lambda x: x["i"]))
    long = lambda c: c.cast("long")
    found = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_stop_words": F.size(F.filter("_words", lambda x: x.isin(*stop))),
        "n_repeat_words": F.size(F.array_distinct(F.concat("_hits", F.transform("_hits", lambda i: i + 1), F.transform("_hits", lambda i: i + 2)))),
    }
    # Through a generator, below which no filter on a measure is pushed: pushed down, it would be worked out anew for every word.
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in found], F.inline(F.array(F.struct(*[long(v).alias(k) for k, v in found.items()]))))


def judged(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """measured() with base_failed and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
