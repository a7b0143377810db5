"""Secret scan: fixed patterns, and a randomness test battery over other tokens.

A token of at least 16 characters of an encoding's alphabet is a candidate if it could hold 64 bits
(128 if it has letters of one case alone).  A run of characters that signs join (a path, a name before a key) is judged as a whole where it fits
an alphabet, and so is each of its parts of that length, cut at the signs of either base64 form or of both; a part inside a longer
secret is not reported again.  Its encoding (hex, base32, base62, base64, base64url, letters) is inferred from its characters, and three tests
of randomness run over it: chi-squared uniformity over the encoding's alphabet, runs above and below the middle of the alphabet,
and serial correlation of neighbouring characters; Fisher's method joins their p-values
(of short mixed-case letters also that of the number of capitals, which tells names joined by capitals from keys).  Ordinary tokens fail.
Within each length class (longer tokens give the tests more power) the Benjamini-Hochberg step over
the candidates of all documents fixes which tokens are rejected as random at the false-discovery rate; the others are secrets.

The step needs counts per length class and p-value bin only, a bounded table, so the documents are read twice and
nothing else is kept.  Null text is empty; repeated rows each come back; offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, text_or_empty, unpacked

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE_KINDS = ("assign", "access", "hex")

LEAST = 16
CUTS = (re.compile(r"[A-Za-z0-9_-]+={0,2}"), re.compile(r"[A-Za-z0-9+/]+={0,2}"), re.compile(r"[A-Za-z0-9]+={0,2}"))  # at '+/', at '-_', at both
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
ENCODINGS = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef"),
    ("base32", re.compile(r"[A-Z2-7]+=*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", re.compile(r"[A-Za-z0-9]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", re.compile(r"[A-Za-z0-9+/]+=*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", re.compile(r"[A-Za-z0-9_-]+=*"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LENGTH_CLASSES = (24, 32, 48, 64)
FALSE_DISCOVERY = 0.05
BINS = 300  # tenths of -log10(p)
MARK = "[SECRET]"

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(start, end, BASE_KINDS[kind]) for start, kind, end in sorted(found)]


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(values: list[int], size: int) -> tuple[float, float, float]:
    """p-values under randomness: chi-squared uniformity, runs, serial correlation."""
    n = len(values)
    chi = size / n * sum(c * c for c in Counter(values).values()) - n
    uniform = _tail((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    high = [2 * v >= size for v in values]
    above = sum(high)
    below = n - above
    if above and below:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        expected = 1 + 2 * above * below / n
        spread = math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
        runs_p = 2 * _tail(abs(runs - expected) / spread)
    else:
        runs_p = 2 * 0.5**n
    mean = sum(values) / n
    around = [v - mean for v in values]
    energy = sum(a * a for a in around)
    if energy:
        correlation = sum(a * b for a, b in zip(around, around[1:])) / energy
        serial_p = 2 * _tail(abs(correlation + 1 / n) * math.sqrt(n))
    else:
        serial_p = 0.0
    return uniform, min(1.0, runs_p), min(1.0, serial_p)


def judge(token: str) -> tuple[str, int, int] | None:
    """(encoding, length class, p-value bin) of a candidate token; None if it is no candidate."""
    body = token.rstrip("=")
    short = False
    digits = sum(c.isdigit() for c in body)
    if digits == len(body):
        return None
    if digits == 0 and body.isalpha():
        mixed = not (body.islower() or body.isupper() or body[1:].islower())
        if mixed and len(body) * math.log2(52) >= 128:
            name, alphabet = "base62", ENCODINGS[2][2]
        elif mixed and body.isascii() and len(body) >= LEAST:
            name, alphabet, short = "base62", ENCODINGS[2][2][:52], True
        elif len(body) * math.log2(26) >= 128:
            name, alphabet, body = "letters", LETTERS, body.lower()
        else:
            return None
    elif digits == 0:
        return None  # words joined by signs: their parts are judged
    else:
        name, _, alphabet = next((e for e in ENCODINGS if e[1].fullmatch(token)), ENCODINGS[-1])
        if name == "hex":
            body = body.lower()
        if not all(c in alphabet for c in body):
            return None  # signs of both base64 forms: its parts are judged
        if len(body) * math.log2(len(alphabet)) < 64:
            return None
    p = [max(x, 1e-60) for x in battery([alphabet.index(c) for c in body], len(alphabet))]
    if short:
        capitals = sum(c.isupper() for c in body)
        p.append(max(1e-60, min(1.0, 2 * _tail(abs(2 * capitals - len(body)) / math.sqrt(len(body))))))
    x = -sum(map(math.log, p))
    joined = math.exp(-x) * sum(x**i / math.factorial(i) for i in range(len(p)))  # Fisher: chi-squared with twice as many degrees of freedom
    return name, sum(len(body) >= c for c in LENGTH_CLASSES), min(BINS, int(-10 * math.log10(max(joined, 1e-40))))


def parts(token: str) -> list[tuple[int, int]]:
    """(start, end) of the token and of its parts of at least ``LEAST`` characters between signs."""
    found = {(0, len(token)): None}
    if not token.rstrip("=").isalnum():
        for cut in CUTS:
            found.update(((m.start(), m.end()), None) for m in cut.finditer(token) if len(m[0].rstrip("=")) >= LEAST)
    return list(found)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, str, int, int]]:
    """(start, end, encoding, length class, bin) of the candidate tokens and parts of tokens that touch no base span."""
    found = []
    ordered = sorted((x, y) for x, y, _ in base)
    starts = [x for x, _ in ordered]
    reach = list(accumulate((y for _, y in ordered), max))  # how far the spans up to each one reach
    for m in TOKEN.finditer(text):
        for a, b in parts(m[0]):
            start, end = m.start() + a, m.start() + b
            before = bisect_left(starts, end)
            if before and reach[before - 1] > start:
                continue
            seen = judge(m[0][a:b])
            if seen:
                found.append((start, end, *seen))
    return found


def cutoffs(docs: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> dict[int, int]:
    """For each length class the smallest p-value bin that is rejected as random (none: no class entry)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                t = text.as_py()
                seen.update((c[3], c[4]) for c in candidates(t, base_spans(t)))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["class", "bin", "n"]
        )

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(count, "class int, bin int, n long").groupBy("class", "bin").agg(F.sum("n").alias("n")).collect()  # at most 5 x 301 rows
    out = {}
    for k in {r["class"] for r in rows}:
        bins = sorted(((r["bin"], r["n"]) for r in rows if r["class"] == k), reverse=True)
        total, below = sum(n for _, n in bins), 0
        for b, n in bins:
            below += n
            if 10 ** (-b / 10) <= false_discovery * below / total:
                out[k] = b
    return out


def all_spans(text: str, limits: dict[int, int]) -> tuple[list[Span], list[Span]]:
    """(base spans, base and random spans by start)."""
    base = base_spans(text)
    more = [(start, end, f"random_{name}") for start, end, name, k, b in candidates(text, base) if b < limits.get(k, BINS + 1)]
    more.sort(key=lambda s: (s[0], -s[1]))
    outer, reach = [], -1  # without those inside another
    for s in more:
        if s[1] > reach:
            outer.append(s)
            reach = s[1]
    more = outer
    return base, sorted([*base, *more], key=lambda s: s[0]) if more else base


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row."""
    limits = cutoffs(docs, false_discovery)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = all_spans(text.as_py(), limits)
                n = Counter(kind for _, _, kind in base)
                rows.append((n["assign"], n["access"], n["hex"], len(spans) - len(base), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(6))], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every (merged) span replaced by ``MARK``."""
    pieces, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            pieces += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def redact(docs: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """``docs`` with secrets masked in ``text`` (and ``n_chars``, if there, set to the new length of changed texts); every row stays."""
    limits = cutoffs(docs, false_discovery)

    @F.pandas_udf("string")
    def mask(texts):  # noqa: ANN001, ANN202
        def one(t: str | None) -> str | None:
            if not t:
                return t
            _, spans = all_spans(t, limits)
            return masked(t, spans) if spans else t

        return texts.map(one, na_action="ignore")

    out = docs.select(packed(docs), mask(F.col("text")).alias("_masked"))
    changed = {"text": F.col("_masked")}
    if "n_chars" in docs.columns:
        n = F.col("_row").getField("n_chars")
        changed["n_chars"] = F.when(F.col("_masked") != F.col("_row").getField("text"), F.length("_masked").cast("long")).otherwise(n)
    return out.select(*unpacked(docs, **changed))
