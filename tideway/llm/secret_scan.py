"""Secret scan: an Aho-Corasick prefilter, anchored expressions at its hits, then embedded checksums.

One automaton over the lower-cased bytes of a text reports where a keyword or token prefix begins. Only there
is the rule's expression tried, anchored. Runs of hexadecimal digits have no keyword; their prefilter maps every
byte to its class and searches for 24 hexadecimal digits in a row. Tokens that carry a CRC-32 of themselves are
kept only if that checksum holds.

Defined results: a null text counts as empty, an empty text has no findings, very long texts are scanned whole (an expression is tried at hits
alone, so time grows with the length), findings that begin together follow in the order of ``KINDS``, repeated rows are scanned each on its
own, an empty table gives an empty result, extra input columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.llm.runtime import columns, utf8

# The three base rules, given by the task.
ASSIGN = re.compile(
    rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

# Prefixes of tokens that end in a base-62 CRC-32 of their first thirty characters.
CHECKED_PREFIXES = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
CHECKED = re.compile(rb"[a-z]{3}_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", *CHECKED_PREFIXES)
BASE_KINDS = KINDS[:3]
HEX_CLASS = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))
HEX_RUN = b"x" * LEAST_HEX

FINDING = "array<struct<kind:string,start:long,end:long,value:string>>"
_ARROW_FINDING = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
)


def base62_crc32(body: bytes) -> str:
    number, digits = zlib.crc32(body), ""
    for _ in range(6):
        number, digit = divmod(number, 62)
        digits = BASE62[digit] + digits
    return digits


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ASSIGN_KEYWORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for kind, prefixes in CHECKED_PREFIXES.items():
        for prefix in prefixes:
            found.add_word(prefix, (kind, len(prefix)))
    found.make_automaton()
    return found


def _byte_spans(data: bytes, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) in bytes, by start and kind."""
    spans, done = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - size + 1, kind) for end, (kind, size) in automaton.iter(data.lower().decode("latin-1")))
    for start, kind in hits:
        if start < done[kind]:
            continue
        if kind == "assign":
            if match := ASSIGN.match(data, start):
                done[kind] = match.end()
                if len(match[1]) >= LEAST_ASSIGN:
                    spans.append((start, 0, match.end()))
        elif kind == "access":
            if match := ACCESS.match(data, start):
                done[kind] = match.end()
                if match.end() - start >= LEAST_ACCESS:
                    spans.append((start, 1, match.end()))
        elif (match := CHECKED.match(data, start)) and base62_crc32(match[1]) == match[2].decode():
            done[kind] = match.end()
            spans.append((start, KINDS.index(kind), match.end()))
    classes = data.translate(HEX_CLASS)
    start = classes.find(HEX_RUN)
    while start >= 0:
        end = HEX.match(data, start).end()
        spans.append((start, 2, end))
        start = classes.find(HEX_RUN, end)
    return sorted(spans)


def find_secrets(data: bytes, automaton: ahocorasick.Automaton | None = None) -> list[dict]:
    """Findings of one UTF-8 text, with offsets in code points (end exclusive)."""
    spans = _byte_spans(data, automaton or _automaton())
    if not spans:
        return []
    points, at, seen = {0: 0}, 0, 0
    for place in sorted({x for start, _, end in spans for x in (start, end)}):
        seen += len(data[at:place].decode("utf-8", "replace"))
        at = place
        points[place] = seen
    return [
        {"kind": KINDS[kind], "start": points[start], "end": points[end], "value": data[start:end].decode("ascii")}
        for start, kind, end in spans
    ]


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and its ``findings`` (kind, start, end, value), by start and kind."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            (texts,) = columns(batch, "text")
            found = [find_secrets(data, automaton) if data else [] for data in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, _ARROW_FINDING)], ["doc_id", "findings"]
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, findings {FINDING}")


def span_text(findings: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
