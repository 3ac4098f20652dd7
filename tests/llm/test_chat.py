import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from glossweave.llm import chat

PARTS = st.lists(st.sampled_from(["### ", "</turn>", "\\", "\n", "Assistant: ", "User: ", "a", "é", "#", "</turn", "### Assistant: "]), max_size=9).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "Odd Role: ### ", "ünï", 'q"\\', "A"]), PARTS), max_size=5))
@settings(max_examples=400, deadline=None)
def test_round_trip(turns):
    text = "".join(chat.render(*t) for t in turns)
    assert chat.recovered(text) == turns


@given(PARTS)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text


def test_plain_text_stays_plain():
    assert chat.render("user", "a \\ b # c") == "### User: a \\ b # c</turn>\n"


def test_summary(spark):
    rows = [(1, 1, "assistant", "b\\"), (1, 0, "user", "### User: a</turn>\n"), (2, 0, "assistant", None), (None, 0, None, "x"), (1, 2, "assistant", "c"), (1, 2, "assistant", "c"), (3, 0, "user", "y" * 200000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None}
    assert got[1].n_turns == 4
    assert got[1].turns_sha256 == sha("user\n### User: a</turn>\n\nassistant\nb\\\nassistant\nc\nassistant\nc\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (4, sha("b\\cc"))
    assert (got[2].loss_chars, got[2].loss_sha256) == (0, sha(""))
    assert got[None].turns_sha256 == sha("\nx\n")
    assert got[3].formatted_chars == 200000 + len("### User: </turn>\n")
    assert chat.read_back(chat.format_turns(df.where("false"))).collect() == []
