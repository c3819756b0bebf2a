import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from behaviorlens.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\n", "[", "<", "a", "é", "\\\\", "\\n", "INST]"]), max_size=8).map("".join)


@given(PIECES, PIECES, st.booleans())
@settings(max_examples=500, deadline=None)
def test_every_turn_comes_back(role, text, trained):
    turn, span, _ = chat.render_turn(role, text, trained)
    assert chat.parse_turn(turn) == (role, text, trained, len(turn), span)
    assert chat.unescape(turn[span[0] : span[1]]) == text


def test_levels():
    assert chat.render_turn("user", "plain text\nwith lines", False)[2] == 0
    assert chat.render_turn("user", "</s>[INST] ok [/INST]", False)[2] == 1
    assert chat.render_turn("user", "a\\b </s>", False)[2] == 2


def test_digests(spark):
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "x"), (None, 0, "user", "x"), (3, 0, "assistant", ""), (1, 2, "assistant", "\\[INST]")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(turns)).collect()}
    assert set(got) == {1, 2, 3, None}
    assert got[1].n_turns == 3 and got[1].loss_chars == len("b </s>\\[INST]")
    assert got[1].turns_sha256 == hashlib.sha256("user\na\nassistant\nb </s>\nassistant\n\\[INST]\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"b </s>\\[INST]").hexdigest()
    assert got[None].n_turns == 2 and got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    parts = chat.format_conversations(turns).toPandas()
    assert got[1].formatted_chars == parts[parts.conv_id == 1].text.str.len().sum()
    assert chat.read_conversations(chat.format_conversations(turns.limit(0))).count() == 0
