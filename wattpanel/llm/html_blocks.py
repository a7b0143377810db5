"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags.  First pass: blocks inside boilerplate elements (menus, headers, footers, sidebars, forms,
adverts, notices, comments, told by tag, role, class or id) and blocks of links are bad; blocks with enough text and enough
stop words are good; the rest are ambiguous.  Second pass: an ambiguous block takes the class of its nearest decided neighbours, of
which the edge of an article counts as good and the edge of the page as bad.  Where a page marks its
article (``article``, ``main``), only blocks inside it can be good, and boilerplate elements set into it are no neighbours;
elsewhere every block is judged by the rules alone.

Null html is empty and gives empty text; cut-off tags end the page; a page is worked on alone, row by row, so rows, ids and
columns do not matter to each other and very long pages cost time in proportion to their length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CHARS = 70
STOP_DENSITY = 0.2
LINK_DENSITY = 0.5

# fixed values: frequent function words
STOP_WORDS = frozenset(
    """the of and to in a is that it was for on with as be at by this are from or an not but have had his her they which you we
    der die das und in zu den von ist mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer im dem einen um am sind noch wie
    le la les de des et un une que qui dans en pour pas sur au avec ce il est par plus ne se son sa ses du ou mais nous vous ont été
    el los las y del que en un una por con no para es al lo como más su pero sus o este sí porque esta entre cuando muy sin sobre
    il di che è per non una del con si da come più ma dei le nel alla o que e do da em para com não uma os no se na por mais as dos
    het een en van ik te dat die in je niet zijn is was op aan met als voor had er maar om""".split()
)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("address article aside blockquote details dialog dl div fieldset figure footer form head header main menu nav ol section table td ul button select noscript object svg template label p h1 h2 h3 h4 h5 h6 li span a".split())
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg select math canvas audio video object".split())
TO_THE_END = frozenset("script style textarea title iframe noembed noframes xmp".split())  # of the raw ones: without an end tag they take the rest of the page
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav header footer aside form menu dialog head button fieldset label".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsorship promo promotion promoted banner cookie cookies consent gdpr notice notices notification
    alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar
    comment comments disqus reply replies respond share sharing social related recommended recommendations widget widgets toolbar pagination pager login search form skip""".split()
)
IN_ARTICLE = frozenset("article entry post story content".split())
CLOSES_P = BLOCK_TAGS - {"body", "html", "head", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}

OPEN = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    link_chars: int
    bad: bool
    article: bool


def _attributes(text: str) -> tuple[bool, bool]:
    """(boilerplate, marks the main text) by an element's attributes."""
    bad = main = False
    if "hidden" in text and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", text):
        bad = True
    for name, a, b, c in ATTRIBUTE.findall(text):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "role":
            bad |= value in BAD_ROLES
            main |= value in ("main", "article")
        elif name in ("class", "id", "aria-label"):
            parts = set(re.split(r"[^a-z]+", value))
            hits = parts & BAD_NAMES
            if parts & {"has", "no", "with", "without"} or hits == {"header"} and parts & IN_ARTICLE or hits <= {"sidebar", "sidebars"} and parts & {"content", "main"}:
                hits = set()  # names of the layout or of the article's own head
            bad |= bool(hits)
        elif name == "style":
            bad |= "display:none" in value.replace(" ", "")
        elif name == "aria-hidden":
            bad |= value == "true"
    return bad, main


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with what its markup says of each."""
    out: list[Block] = []
    pieces: list[str] = []
    link_chars = 0
    stack: list[tuple[str, bool, bool]] = []  # tag, inside boilerplate, inside the article
    places: dict[str, list[int]] = {}  # of each tag in the stack
    block_places: list[int] = []
    unclosed: set[str] = set()  # raw tags without an end tag from here on
    links = 0

    def close(to: int) -> None:
        """Take tags off the stack; each is put there and taken off once, so a page's tags cost in proportion to their number."""
        nonlocal links
        while len(stack) > to:
            name = stack.pop()[0]
            places[name].pop()
            if name in BLOCK_TAGS:
                block_places.pop()
            links -= name == "a"

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                bad, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                out.append(Block(text, link_chars, bad, article))
            pieces.clear()
        link_chars = 0

    def add(text: str) -> None:
        nonlocal link_chars
        if "&" in text:
            text = entities.unescape(text)
        pieces.append(text)
        if links:
            link_chars += len("".join(text.split()))

    at, n = 0, len(page)
    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            add(page[at:])
            break
        if cut > at:
            add(page[at:cut])
        follows = page[cut + 1 : cut + 2]
        if follows in ("!", "?"):
            if page.startswith("<!--", cut):
                end = page.find("-->", cut + 4)
                end = n if end < 0 else end + 3
            else:
                end = page.find(">", cut)
                end = n if end < 0 else end + 1
            at = end
        elif follows == "/":
            end = page.find(">", cut)
            if end < 0:
                break
            words = page[cut + 2 : end].split(None, 1)
            tag = words[0].lower() if words else ""
            at = end + 1
            if tag in BLOCK_TAGS:
                flush()
            if tag in CONTAINERS:
                if places.get(tag):
                    i = places[tag][-1]
                    if tag in BLOCK_TAGS or not block_places or block_places[-1] < i:  # a stray inline end tag closes no block
                        close(i)
        elif follows.isascii() and follows.isalpha():
            m = OPEN.match(page, cut)
            if m:
                tag, rest, at = m[1].lower(), m[2], m.end()
            else:
                end = page.find(">", cut)
                if end < 0:
                    break
                tag, rest, at = re.split(r"[\s/]", page[cut + 1 : end], maxsplit=1)[0].lower(), "", end + 1
            if tag == "br":
                add(" ")
                continue
            if tag in RAW_TAGS:
                if not rest.endswith("/") and tag not in unclosed:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                    if end:
                        at = end.end()
                    elif tag in TO_THE_END:
                        at = n
                    else:
                        unclosed.add(tag)
                continue
            if tag in BLOCK_TAGS:
                flush()
            if tag in VOID_TAGS:
                continue
            if tag in CLOSES_P or tag in ("li", "dd", "dt"):
                name = stack[block_places[-1]][0] if block_places else ""
                if name == "p" or name.startswith("h") and len(name) == 2 or tag == "li" and name == "li":
                    close(block_places[-1])
            if tag == "body":
                close(0)
            elif tag in CONTAINERS and not rest.endswith("/"):
                bad, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                named, main = _attributes(rest) if rest else (False, False)
                marks = tag in ("article", "main") or main
                inside_inline = tag in ("a", "span")
                places.setdefault(tag, []).append(len(stack))
                if tag in BLOCK_TAGS:
                    block_places.append(len(stack))
                stack.append((tag, bad or tag in BAD_TAGS or named and not marks and not inside_inline, article or marks))
                links += tag == "a"
        else:
            add("<")
            at = cut + 1
    flush()
    return out


def classify(found: list[Block]) -> list[bool]:
    """True for each block that belongs to the main text."""
    marked = any(b.article and not b.bad for b in found)
    decided: list[bool | None] = []
    for b in found:
        chars = len("".join(b.text.split()))
        if b.bad or marked and not b.article:
            decided.append(False)
        elif b.link_chars > LINK_DENSITY * chars:
            decided.append(False)
        else:
            words = WORD.findall(b.text.lower())
            stops = sum(w in STOP_WORDS for w in words)
            enough = stops >= STOP_DENSITY * max(1, len(words))
            decided.append(True if len(b.text) >= MIN_CHARS and enough else None)
    n = len(found)
    before: list[tuple[bool, int]] = []
    seen: tuple[bool, int] = (marked, -1)
    for i in range(n):
        if decided[i] is not None and not (marked and (found[i].bad or not found[i].article)):
            seen = (bool(decided[i]), i)
        before.append(seen)
    out = [False] * n
    after: tuple[bool, int] = (marked, n)
    for i in range(n - 1, -1, -1):
        if decided[i] is not None:
            out[i] = bool(decided[i])
            if not (marked and (found[i].bad or not found[i].article)):
                after = (bool(decided[i]), i)
            continue
        left, right = before[i], after
        if left[0] == right[0]:
            out[i] = left[0]
        elif i - left[1] == right[1] - i:
            out[i] = marked or len(found[i].text) >= MIN_CHARS
        else:
            out[i] = left[0] if i - left[1] < right[1] - i else right[0]
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, good in zip(found, classify(found)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
