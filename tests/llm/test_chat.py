import hashlib

import pytest
from pyspark.sql import functions as F

from loomgrain.llm.chat_format import Template, format_conversations, read_back

SCHEMA = "conv_id long, turn long, role string, text string, segments string"
TEXTS = ["", "plain", "###", "####", "#####", "######", "\\", "\\h", "\\b", "\\\\h###", "</turn>", "<</turn>>", "</turn>\n### User: x</turn>\n", "é###\n", "\\t</turn", "### Assistant: "]


@pytest.mark.parametrize("text", TEXTS)
def test_escape_is_reversible(spark, text):
    t = Template()
    row = spark.createDataFrame([(text,)], "x string").select(t.escape(F.col("x")).alias("e")).select("e", t.unescape(F.col("e")).alias("u")).first()
    assert row.u == text and "###" not in row.e and "</turn>" not in row.e


def test_round_trip(spark):
    rows = [(1, k, role, text, "z") for k, (role, text) in enumerate([("system", "s"), *[(("user", "assistant")[k % 2], t) for k, t in enumerate(TEXTS)]])]
    rows += [(2, 0, "assistant", "early", "z"), (2, 1, None, None, "z"), (2, 2, "we:ird ###", "x", "z"), (2, None, "user", "last", "z"), (2, 1, None, None, "z"), (None, 0, "user", "n", "z")]
    got = {r.conv_id: r for r in read_back(format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(got) == {1, 2, None}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3]) for r in rows if r[0] == 1]
    assert got[1].valid and got[1].loss_text == "".join(t for k, t in enumerate(TEXTS) if k % 2)
    assert [(t.role, t.text) for t in got[2].turns] == [("assistant", "early"), (None, ""), (None, ""), ("we:ird ###", "x"), ("user", "last")]
    assert not got[2].valid and got[2].invalid_turns == 4
    assert "".join(s.text for s in got[1].segments) == got[1].formatted


@pytest.mark.parametrize(("roles", "valid", "bad"), [("ua", True, 0), ("sua", True, 0), ("uaua", True, 0), ("u", False, 0), ("s", False, 0), ("au", False, 1), ("uu", False, 1), ("usa", False, 2), ("uaa", False, 1)])
def test_machine(spark, roles, valid, bad):
    name = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(1, k, name[r], "t", "z") for k, r in enumerate(roles)]
    got = format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.valid, got.invalid_turns) == (valid, bad)


def test_empty_and_long(spark):
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "x###" * 200_000
    got = read_back(format_conversations(spark.createDataFrame([(1, 0, "user", "q", ""), (1, 1, "assistant", long, "")], SCHEMA))).first()
    assert hashlib.sha256(got.loss_text.encode()).digest() == hashlib.sha256(long.encode()).digest()
