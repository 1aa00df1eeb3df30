"""Conversations as marked text, from typed parts, and back.

A message is a list of typed parts. A visitor flattens them in order: texts are escaped, and
images, audio and documents become placeholders, whose references and numbers of tokens are
recorded. Conversations are streamed in order of turns and given out in chunks of bounded
size, so that one may hold any number of turns; a conversation of ordinary size is one chunk.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augur.llm.common import freed, slices

#: The template's own marks, and the placeholders of attachments.
BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
PLACEHOLDER = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
CONTROL = (BEGIN, END, ROLE, TEXT, *PLACEHOLDER.values())
#: A break that no control string holds.
BREAK = "\\-"

#: A part: its type, its text or its reference, and what its number of tokens follows.
PARTS = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
PLACE = ("place", "turn", "type", "ref", "tokens", "at")
ATTACHMENT = "struct<place: long, turn: long, type: string, ref: string, tokens: long, at: long>"
CHUNK = f"chunk long, n_turns long, formatted string, loss array<struct<begin: long, end: long>>, attachments array<{ATTACHMENT}>, expanded_tokens long"
SIZE = 1 << 20  # code points of a chunk

_starts = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ").", re.S)
_marks = re.compile("|".join(map(re.escape, CONTROL)))
_escaped = re.compile(r"\\([\\-])")


def escape(text: str) -> str:
    """``text`` without control strings: backslashes are doubled, and every control string, also
    one that overlaps another, is broken behind its first sign."""
    return _starts.sub(lambda m: m[0] + BREAK, text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[1] if m[1] == "\\" else "", text)


@dataclass(frozen=True)
class Expansion:
    """Tokens that an attachment takes: an image by patches, audio by time, a document by pages;
    what is not stated counts as ``unknown``."""

    patch: int = 14
    per_second: float = 25.0
    per_page: int = 560
    unknown: int = 1

    def image(self, part: dict) -> int:
        w, h = part.get("width"), part.get("height")
        return math.ceil(w / self.patch) * math.ceil(h / self.patch) if w and h else self.unknown

    def audio(self, part: dict) -> int:
        return math.ceil(part["seconds"] * self.per_second) if part.get("seconds") else self.unknown

    def document(self, part: dict) -> int:
        return part["pages"] * self.per_page if part.get("pages") else self.unknown


@dataclass
class Flattener:
    """Visits the parts of messages and writes them into one chunk."""

    expansion: Expansion = Expansion()
    out: list[str] = field(default_factory=list)
    size: int = 0
    turns: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple] = field(default_factory=list)
    place: int = 0  # attachments of the conversation so far

    def put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit(self, turn: int | None, part: dict, learned: bool) -> None:
        kind = part.get("type") or "text"
        if kind == "text":
            self.visit_text(part, learned)
        elif kind in PLACEHOLDER:
            self.visit_attachment(turn, kind, part)
        else:
            raise ValueError(f"a part of an unknown type: {kind}")

    def visit_text(self, part: dict, learned: bool) -> None:
        begin = self.size
        self.put(escape(part.get("text") or ""))
        if learned and self.size > begin:
            self.loss.append((begin, self.size))

    def visit_attachment(self, turn: int | None, kind: str, part: dict) -> None:
        tokens: Callable[[dict], int] = getattr(self.expansion, kind)
        self.attachments.append((self.place, turn, kind, part.get("ref"), tokens(part), self.size))
        self.place += 1
        self.put(PLACEHOLDER[kind])

    def message(self, turn: int | None, role: str, parts: list[dict]) -> None:
        self.put(ROLE + escape(role) + TEXT)
        for part in parts:
            self.visit(turn, part, role == "assistant")
        self.put(END)
        self.turns += 1

    def taken(self) -> tuple:
        """The chunk, after which the next one is empty."""
        got = (self.turns, "".join(self.out), self.loss, self.attachments, sum(a[4] for a in self.attachments))
        self.out, self.size, self.turns, self.loss, self.attachments = [], 0, 0, [], []
        return got


def text_part(text: Column) -> Column:
    """A list of one text part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()))).cast(PARTS)


def format_conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", expansion: Expansion = Expansion(), size: int = SIZE) -> DataFrame:
    """conv_id, chunk, n_turns, formatted, loss, attachments, expanded_tokens: conversations as
    text, in chunks of about ``size`` code points and at least one turn, in order within
    a task. Spans and places are code points of the chunk's text; an attachment's ``place``
    counts through the conversation.

    Turns stand in order of ``turn``, nulls first, then of role and parts where turns are equal;
    repeated rows are turns of their own. Null roles are empty, null parts and texts too; a
    null id is a conversation; further columns are not read. A part of an unknown type fails
    the job. A conversation is streamed through one task in sorted order, since its text is one
    sequence; nothing but the chunk at hand is held.
    """
    kind = messages.schema[conv_id].dataType
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(PARTS)).alias("parts"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    names = ["conv_id", "chunk", "n_turns", "formatted", "loss", "attachments", "expanded_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, chunk, sheet, out = none, 0, Flattener(expansion), []
        loss = pa.list_(pa.struct([(n, pa.int64()) for n in ("begin", "end")]))
        spot = pa.list_(pa.struct([(n, pa.string() if n in ("type", "ref") else pa.int64()) for n in PLACE]))

        def given() -> pa.RecordBatch:
            cols = list(zip(*out))
            spans = [[{"begin": a, "end": b} for a, b in x] for x in cols[4]]
            found = [[dict(zip(PLACE, a)) for a in x] for x in cols[5]]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:3]), pa.array(cols[3], pa.string()), pa.array(spans, loss), pa.array(found, spot), pa.array(cols[6], pa.int64())], names
            )

        held, id_type = 0, None  # code points in ``out``

        def end_chunk() -> None:
            nonlocal held
            held += sheet.size
            out.append((now, chunk, *sheet.taken()))

        for batch in slices(batches):
            id_type = batch.column(0).type
            for conv, at, who, what in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now or now is none:
                    if now is not none:
                        end_chunk()
                    now, chunk, sheet = conv, 0, Flattener(expansion)
                    sheet.put(BEGIN)
                elif sheet.size >= size:
                    end_chunk()
                    chunk += 1
                sheet.message(at, who, what)
                if held >= size:
                    yield given()
                    held = 0
        if now is not none:
            end_chunk()
            yield given()

    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(CHUNK).fields])
    return ordered.mapInArrow(freed(run), schema)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a chunk, read from its marks alone; placeholders are no text."""
    role, start, kept = None, 0, []
    for m in _marks.finditer(formatted):
        if m[0] == TEXT:
            role, kept = unescape(formatted[start : m.start()]), []
        elif role is not None:
            kept.append(unescape(formatted[start : m.start()]))
            if m[0] == END:
                yield role, "".join(kept)
                role = None
        start = m.end()


def digests(chunks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, expanded_tokens of
    conversations, read back from their chunks: turns from the marks, what is learned from
    the spans of ``loss``. ``chunks`` must come from :func:`format_conversations` directly, so that
    those of a conversation follow each other; each is read and forgotten."""
    some = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long"
    schema = T.StructType([chunks.schema["conv_id"], *T.StructType.fromDDL(some).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, n, out, id_type = none, [0, 0, 0, 0], [], None
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def given() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], schema.names)

        end = lambda: (now, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2], n[3])
        for batch in batches:
            if batch.num_rows == 0:
                continue
            id_type = batch.column(0).type
            for conv, _, _, text, spans, _, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now or now is none:
                    if now is not none:
                        out.append(end())
                    now, n, turns, loss = conv, [0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                for role, said in turns_of(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n[0] += 1
                for x in spans:
                    said = unescape(text[x["begin"] : x["end"]])
                    loss.update(said.encode())
                    n[1] += len(said)
                n[2] += len(text)
                n[3] += tokens
            if out:
                yield given()
        if now is not none:
            out.append(end())
            yield given()

    return chunks.mapInArrow(freed(run), schema)
