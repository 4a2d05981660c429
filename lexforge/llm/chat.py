r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become one message; the
messages are rendered and concatenated. A conversation becomes one string, so its turns meet in one row by definition.

Template: each message is `[INST]role[/INST]text</s>`; the texts of merged turns are set apart by `<s>`, so that no
turn is lost. Control strings inside roles and texts get one backslash after their first character (`[INST]` becomes
`[\INST]`, `[\INST]` becomes `[\\INST]`), which takes away exactly one backslash when read back.

Defined cases: null role or text: empty; null conversation id: a conversation of its own; ties in `turn`: by role, then
text; repeated rows: each a turn; null turn: first; texts are read whole; a conversation of any number of turns is one
row by definition, and its cost grows little faster than its turns; no rows: no conversations; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT, END = "[INST]", "[/INST]", "<s>", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)(/?(?:INST\]|s>))", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)(/?(?:INST\]|s>))", "$1$2$3")


def _run(n: Column, loss: Column, text: bool = False) -> Column:
    return F.struct(n.cast("long").alias("n"), loss.alias("loss"), F.lit(text).alias("text"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv, `formatted`, and `mask`, the runs of code points (n, loss, text) of `formatted` in order.

    Under the loss are the texts of the role `trained`, without marks; text: the run is the text of a turn.
    """
    rows = turns.select(F.col(conv).alias(conv), F.struct(F.col(turn).alias("turn"), escape(F.coalesce(F.col(role), F.lit(""))).alias("role"), escape(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("t"))
    sorted_turns = rows.groupBy(conv).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    heads = sorted_turns.withColumn(
        "heads",
        F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])),
    )
    messages = heads.withColumn(
        "messages",
        F.transform(
            "heads",
            lambda h, j: F.struct(
                F.get("turns", h)["role"].alias("role"),
                F.transform(F.slice("turns", h + 1, F.coalesce(F.get("heads", j + 1), F.size("turns")) - h), lambda t: t["text"]).alias("texts"),
            ),
        ),
    )
    no, wanted = F.lit(False), escape(F.lit(trained))
    return messages.select(
        conv,
        F.array_join(F.transform("messages", lambda m: F.concat(F.lit(OPEN), m["role"], F.lit(CLOSE), F.array_join(m["texts"], NEXT), F.lit(END))), "").alias("formatted"),
        F.flatten(
            F.transform(
                "messages",
                lambda m: F.concat(
                    F.array(_run(F.length(m["role"]) + len(OPEN + CLOSE), no)),
                    F.flatten(F.transform(m["texts"], lambda x, k: F.array(_run(F.when(k > 0, len(NEXT)).otherwise(0), no), _run(F.length(x), m["role"] == wanted, True)))),
                    F.array(_run(F.lit(len(END)), no)),
                ),
            )
        ).alias("mask"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """chats with `turns` (role, text), read from `formatted`, and `loss_texts`, its texts under the loss by `mask`, each as long as the mask says."""
    parts = F.split("formatted", END, -1)
    # A message is split once; its texts then take the role from the parts.
    messages = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda m: F.struct(F.split(m, r"\[/INST\]", 2).alias("s")))
    cut = F.flatten(F.transform(messages, lambda m: F.transform(F.split(F.get(m["s"], F.lit(1)), NEXT, -1), lambda x: F.struct(F.substr(F.get(m["s"], F.lit(0)), F.lit(len(OPEN) + 1)).alias("role"), x.alias("text")))))
    runs = F.filter("mask", lambda r: r["text"])
    zipped = F.filter(F.arrays_zip(cut.alias("c"), runs.alias("r")), lambda z: z["r"]["loss"])
    return chats.withColumns(
        {
            "turns": F.transform(cut, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))),
            "loss_texts": F.transform(zipped, lambda z: unescape(F.substr(z["c"]["text"], F.lit(1), z["r"]["n"].cast("int")))),
        }
    )
