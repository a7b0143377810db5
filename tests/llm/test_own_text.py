"""What a message says itself stays as it stands."""

from __future__ import annotations

from wattpanel.llm import quotes

CODE = "def f():\n    if x:\n        return 1\n\n\n    return 2  \n"


def test_unquoted_text_is_not_touched():
    for text in (CODE, "", None, " lead\n\n\n\ttabs ", "a > b\n->c", "On Monday she wrote:\nnothing quoted"):
        assert quotes.unquoted(text) == (text or "")


def test_own_lines_around_quotes_keep_their_form():
    assert quotes.unquoted("> asked\n> more\n    indented\n\n\n  after\n\nOn Monday Ann wrote:\n> old\n>> older\n\nend  \n\n") == "    indented\n\n\n  after\n\nend  "
    assert quotes.unquoted("> only\n> quotes") == ""


def test_conversation_keeps_code(spark):
    rows = [(1, 0, "user", "How does this work?"), (1, 1, "assistant", "> How does this work?\n\n" + CODE), (1, 2, "user", CODE)]
    got = {r["turn"]: r["text"] for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: "How does this work?", 1: CODE.rstrip("\n"), 2: CODE}
