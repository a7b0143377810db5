"""Tags without an end: the rest of the page stays, and a page's tags cost in proportion to their number."""

from __future__ import annotations

import time

import pytest

from wattpanel.llm import html_blocks

FIRST = "The first paragraph is one of the longer ones and it has all of the usual words in it, so that it counts as text."
LAST = "The second paragraph is also one of the longer ones and it has all of the usual words in it, so that it counts too."


@pytest.mark.parametrize("tag", ["svg", "math", "select", "video", "audio", "object", "canvas", "template", "noscript"])
def test_a_tag_without_its_end_does_not_take_the_rest(tag):
    text = html_blocks.main_text(f"<html><body><article><p>{FIRST}</p><{tag}><p>{LAST}</p></article></body></html>")
    assert text == f"{FIRST}\n\n{LAST}"
    closed = html_blocks.main_text(f"<html><body><article><p>{FIRST}</p><{tag}>inside</{tag}><p>{LAST}</p></article></body></html>")
    assert closed == f"{FIRST}\n\n{LAST}"


@pytest.mark.parametrize("tag", ["script", "style", "textarea"])
def test_scripts_run_to_the_end(tag):
    assert html_blocks.main_text(f"<article><p>{FIRST}</p><{tag}><p>{LAST}</p></article>") == FIRST


@pytest.mark.parametrize("page", ["<span>" * 8000 + "<p>x</p>" * 8000, "<div>" + "</div></span>" * 8000 + "<p>x" * 8000, "<svg><a>" * 8000 + "<li>x" * 8000, "<p>" * 8000 + "<a><i>" * 8000])
def test_many_open_tags_are_quick(page):
    began = time.process_time()
    html_blocks.main_text(page)
    assert time.process_time() - began < 1.0
