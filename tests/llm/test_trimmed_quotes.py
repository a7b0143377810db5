"""Quotes of a line or sentence of a longer paragraph find their original."""

from __future__ import annotations

from wattpanel.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def test_trimmed_quotes_link(spark):
    rows = [
        (1, 0, "u", "Something else entirely.\nNothing to see."),
        (1, 1, "u", "The first line is here\nand the second one there\nthen the third."),
        (1, 2, "a", "> and the second one there\nI agree."),  # a line
        (1, 3, "a", "> The first line is here\n> then the third.\nNo."),  # a trimmed paragraph
        (2, 0, "u", "One sentence stands here. Another follows\nit. A last one."),
        (2, 1, "a", "> Another follows it.\nYes."),  # a sentence across two lines
        (3, 0, "u", "Shared greeting\nlong words of the first"),
        (3, 1, "u", "Shared greeting\nmany other words of the second message"),
        (3, 2, "a", "> Shared greeting\n> many other words of the second message\nFine."),  # whole
        (3, 3, "a", "> Shared greeting\n> many other words of the second message\n> [..]\nFine."),  # more words
        (4, 0, "u", "a line\nin a paragraph"),
        (4, 1, "u", "a line"),
        (4, 2, "a", "> a line\nok"),  # the whole passage is the stronger vote
    ]
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["n_linked"]) for r in quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(1, 2): (1, 1), (1, 3): (1, 1), (2, 1): (0, 1), (3, 2): (1, 1), (3, 3): (1, 1), (4, 2): (1, 1)}
    assert {k: v for k, v in got.items() if v[0] is not None} == want
