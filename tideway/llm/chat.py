"""Chat formatting with typed content parts.

A turn is a list of parts: text, image, audio or document. A visitor flattens them in order: text is escaped, each other part
becomes a numbered placeholder, and its reference is recorded with the place of the placeholder and the number of tokens the
attachment expands to. A turn becomes one segment; a conversation's output is its segments in turn order, so no conversation is ever
gathered in one row, however long it is.

Template, by segment: ``<|turn|>role<|text|>`` + content + ``<|end|>`` + a line feed; what is learned lies between ``<|loss|>`` and
``<|/loss|>``. Inside texts and roles a backslash is doubled and one is put after the first character of every control
string, so that none is left; ``unescape`` takes them away again.

Defined results: a null text counts as empty, a null role as the empty role; rows of a conversation with the same turn follow
by role and text; rows with a null conversation form one; a turn without parts is an empty text; very long texts are one
segment each, and a long conversation is digested segment by segment; repeated rows are turns each; an empty table gives an empty
result; extra input columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.runtime import columns

# The template's control strings.
TURN, TEXT, END, LOSS, LOSS_END = "<|turn|>", "<|text|>", "<|end|>\n", "<|loss|>", "<|/loss|>"
#: What begins a control string: of this template, and of common others (</s>, [INST], <<SYS>>).
CONTROL = re.compile(r"\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
SEGMENT = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*)<\|end\|>\n", re.DOTALL)
LEARNED = re.compile(r"<\|loss\|>(.*?)<\|/loss\|>", re.DOTALL)

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<place:int,kind:string,ref:string,offset:long,tokens:long>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


class PartVisitor:
    """Flattens the parts of one turn; ``visit`` calls the method of a part's kind."""

    def __init__(self, patch: int = PATCH, audio_rate: float = AUDIO_RATE, page_tokens: int = PAGE_TOKENS):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.out: list[str] = []
        self.size = 0
        self.attachments: list[dict] = []

    def write(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.write(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = ((part.get(side) or 0) for side in ("width", "height"))
        self.attach("image", part, math.ceil(across / self.patch) * math.ceil(down / self.patch))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * self.page_tokens)

    def visit_other(self, part: dict) -> None:
        self.attach("file", part, 0)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        place = len(self.attachments) + 1
        self.attachments.append({"place": place, "kind": kind, "ref": part.get("ref"), "offset": self.size, "tokens": tokens})
        self.write(f"<|{kind}:{place}|>")


def format_turn(role: str | None, parts: list[dict] | None, learned_roles: tuple[str, ...] = ("assistant",)) -> tuple[str, list[dict]]:
    """A turn's segment, and its attachments with the places of their placeholders in it."""
    visitor, role = PartVisitor(), role or ""
    visitor.write(TURN + escape(role) + TEXT)
    if role in learned_roles:
        visitor.write(LOSS)
    for part in parts or ():
        visitor.visit(part)
    if role in learned_roles:
        visitor.write(LOSS_END)
    visitor.write(END)
    return "".join(visitor.out), visitor.attachments


def format_turns(turns: DataFrame, learned_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, turn, segment, attachments, expanded_tokens)`` from ``(conv_id, turn, role, parts)``; see ``PART``."""
    kinds = {n: turns.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}
    attachments = pa.list_(
        pa.struct([("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int64()), ("tokens", pa.int64())])
    )

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turn(role, parts, learned_roles) for role, parts in zip(*columns(batch, "role", "parts"), strict=True)]
            arrays = [batch.column("conv_id"), batch.column("turn"), pa.array([x for x, _ in done], pa.string())]
            arrays += [pa.array([x for _, x in done], attachments), pa.array([sum(a["tokens"] for a in x) for _, x in done], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "turn", "segment", "attachments", "expanded_tokens"])

    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, segment string, attachments array<{ATTACHMENT}>, expanded_tokens long"
    return turns.select("conv_id", "turn", "role", "parts").mapInArrow(formatted, schema)


def text_parts(text: str = "text"):
    """The parts of a turn that is text alone."""
    fields = [F.lit("text").alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref")]
    fields += [F.lit(None).cast("int").alias(n) for n in ("width", "height")]
    fields += [F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")]
    return F.array(F.struct(*fields))


def read_segment(segment: str) -> tuple[str, str, list[str]]:
    """Role, text and learned texts of a segment, unescaped. Placeholders stay in the text."""
    role, content = SEGMENT.fullmatch(segment).groups()
    learned = [unescape(x) for x in LEARNED.findall(content)]
    return unescape(role), unescape(content.replace(LOSS, "").replace(LOSS_END, "")), learned


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from sorted segments; holds one conversation's running digests, not its texts."""
    conv, state, begun = None, None, False

    def row():
        n, turns, chars, loss, size = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    for batch in batches:
        out = []
        for now, segment in zip(*columns(batch, "conv_id", "segment"), strict=True):
            if not begun or now != conv:
                if begun:
                    out.append(row())
                conv, begun, state = now, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text, learned = read_segment(segment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            for part in learned:
                state[2] += len(part)
                state[3].update(part.encode())
            state[4] += len(segment)
        if out:
            yield _digest_rows(out, batch.schema.field("conv_id").type)
    if begun:
        yield _digest_rows([row()], batch.schema.field("conv_id").type)


def _digest_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, read from its segments in order: ``conv_id`` and what ``_DIGEST`` names."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    rows = segments.select("conv_id", "turn", "segment").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return rows.select("conv_id", "segment").mapInArrow(_read, f"conv_id {kind}, {_DIGEST}")
