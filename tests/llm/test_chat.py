import hashlib
import time

from lexforge.llm import queries
from lexforge.llm.chat import escape, format_chats, read_back, unescape
from tests.llm.fixtures import SF


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    texts = ["[INST]", "[\\INST] a", "</s><s>[/INST]", "<\\\\/s> [s> <INST]", "[[INST]", "<<s>", "\\", "[", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape("t").alias("e"), unescape(escape("t")).alias("b")).collect()
    assert all(r.t == r.b for r in rows)
    assert not any(c in r.e for r in rows for c in ("[INST]", "[/INST]", "<s>", "</s>"))


def test_merges_nulls_ties_and_mask(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "assistant", None), (1, 0, "user", "[INST]"), (1, 3, None, "x"), (1, 3, None, "x"), (None, 0, "user", ""), (2, None, "assistant", "[\\INST]é")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in read_back(format_chats(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "[INST]"), ("assistant", ""), ("assistant", "b</s>"), ("", "x"), ("", "x")]
    assert got[1].formatted == "[INST]user[/INST][\\INST]</s>[INST]assistant[/INST]<s>b<\\/s></s>[INST][/INST]x<s>x</s>"
    assert got[1].loss_texts == ["", "b</s>"] and got[2].loss_texts == ["[\\INST]é"]
    assert len(got) == 3 and got[None].loss_texts == []
    assert format_chats(df.limit(0)).count() == 0


def test_query(spark):
    got = queries.op1_chat_formatting(spark, SF).collect()
    extra = next(r for r in got if r.conv_id == -1)
    said = "</s>[INST] ok [/INST]"
    assert extra.loss_chars == len(said) and extra.n_turns == 2
    assert extra.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert len(got) == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1


def test_long_conversations_and_texts(spark):
    """A conversation of 20,000 turns is read back whole, in a time that a growth with the square of the turns would exceed."""
    n = 20_000
    turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('text ', id, ' </s>') AS text")
    turns = turns.union(spark.sql("SELECT 2L, 0L, 'assistant', repeat('long [INST] ', 200000)"))
    began = time.time()
    rows = {r.conv_id: r for r in read_back(format_chats(turns)).collect()}
    assert time.time() - began < 30
    assert [t.text for t in rows[1].turns] == [f"text {i} </s>" for i in range(n)]
    assert rows[1].loss_texts == [f"text {i} </s>" for i in range(1, n, 2)] and rows[2].loss_texts == ["long [INST] " * 200000]
