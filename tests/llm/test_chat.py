"""The chat grammar's round trip."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxmill.llm import chat

PARTS = st.lists(st.sampled_from(["[INST]", "[/INST]", "<s>", "</s>", "\\", "[", "<", "/", "INST]", "s>", "\n", "a", "é𝒳"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), st.just("user"), PARTS), PARTS), max_size=5))
def test_round_trip(turns):
    pieces = [chat.render_turn(*t) for t in turns]
    assert [t[:2] for t in chat.parse("".join(p[0] for p in pieces))] == turns
    for (role, text), (piece, a, b) in zip(turns, pieces):
        assert chat.unescape(piece[a:b]) == text


def test_plain_text_stays():
    assert chat.render_turn("user", "a [b] <c> \\d")[0] == "[INST]user\na [b] <c> \\d[/INST]"
    with pytest.raises(ValueError):
        list(chat.parse("[INST]user\nno end"))


def test_conversations(spark):
    rows = [(1, 2, "assistant", "two</s>"), (1, 0, "user", None), (1, 1, None, "x"), (2, 0, "assistant", ""), (2, 0, "assistant", "tie"), (None, 5, "user", "q"), (1, 2, "assistant", "two</s>")]
    frame = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, piece string").repartition(4)
    got = {r["conv_id"]: r for r in chat.write_and_read(chat.with_conflict(frame)).collect()}
    for conv in (1, 2, None, -1):
        own = [r[1:] for r in rows if r[0] == conv] if conv != -1 else [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
        own = sorted((t, r or "", x or "") for t, r, x in own)
        said = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[-1]["formatted_chars"] == len("[INST]user\n<\\/s>[\\INST] ok [\\/INST][/INST]".replace("\\/s", "\\/s")) + len("<s>assistant\n<\\/s>[\\INST] ok [\\/INST]</s>")
    assert chat.write_and_read(frame.limit(0)).count() == 0


def test_joined_text_and_mask(spark):
    """The pieces of a conversation, joined, parse to its turns; the mask covers the
    assistant's texts alone."""
    rows = [(1, t, ("user", "assistant", "system")[t % 3], f"{'[/INST]' * (t % 4)} text {t} </s>" + "x" * (200_000 if t == 4 else 0)) for t in range(12)]
    formatted = sorted(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect(), key=lambda r: r["turn"])
    joined = "".join(r["piece"] for r in formatted)
    assert [t[:2] for t in chat.parse(joined)] == [r[2:] for r in rows]
    for r, (_, _, role, text) in zip(formatted, rows):
        assert (r["loss_start"] is None) == (role != "assistant")
        if role == "assistant":
            assert chat.unescape(r["piece"][r["loss_start"] : r["loss_end"]]) == text


def test_a_wrong_mask_is_found(spark):
    formatted = chat.format_turns(spark.createDataFrame([(1, 0, "assistant", "abc")], "conv_id long, turn long, role string, text string"))
    with pytest.raises(Exception, match="mask"):
        chat.read_back(formatted.withColumn("loss_end", formatted.loss_end - 1)).collect()
