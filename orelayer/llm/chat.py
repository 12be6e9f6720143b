"""Chat formatting of typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor walks the turns of a conversation and writes
the formatted text: marks around each turn, escaped text, and a numbered placeholder per attachment, whose reference and
expanded token count it records. Text under the loss mask is recorded as spans of code points of the formatted text.

Control strings start with ``<|``. Inside a text a backslash is put between such a ``<`` and ``|``, after any that stand
there already, so no text can hold a control string and taking one backslash away gives the text back.

Defined results: null text, role or parts are empty; parts of an unknown kind are an error; rows of a conversation are ordered
by turn, then role, then content, nulls first, and repeated rows are repeated turns; a null conversation id is a
conversation; an empty table gives no rows. A conversation is one training example and is formatted as one row. Only the
columns named by the arguments are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
START, END, LINE = "<|im_start|>", "<|im_end|>", "<|line|>"
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
SPAN = "array<struct<start:bigint,length:bigint>>"
ATTACHMENT = "array<struct<number:int,kind:string,ref:string,tokens:bigint,at:bigint>>"

_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document)_([0-9]+)\|>")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


@dataclass(frozen=True)
class Expansion:
    """How many tokens stand for an attachment."""

    image_patch: int = 28
    audio_per_second: float = 12.5
    document_per_page: int = 600

    def image(self, part: dict) -> int:
        across, down = part.get("width") or 0, part.get("height") or 0
        return -(-across // self.image_patch) * -(-down // self.image_patch)

    def audio(self, part: dict) -> int:
        return -int(-(part.get("seconds") or 0.0) * self.audio_per_second // 1)

    def document(self, part: dict) -> int:
        return (part.get("pages") or 0) * self.document_per_page


@dataclass
class Formatter:
    """Visits the parts of a conversation in order."""

    expansion: Expansion = Expansion()
    trained: frozenset[str] = frozenset({"assistant"})
    pieces: list[str] = field(default_factory=list)
    size: int = 0
    loss: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def write(self, text: str, learned: bool = False) -> None:
        if learned and text:
            self.loss.append({"start": self.size, "length": len(text)})
        self.pieces.append(text)
        self.size += len(text)

    def turn(self, role: str | None, parts: list[dict] | None) -> None:
        role = role or ""
        self.write(START + escape(role).replace("\n", LINE) + "\n")
        texts: list[str] = []
        for part in parts or []:
            if part["kind"] == "text":
                texts.append(part["text"] or "")
                continue
            # Neighbouring texts are escaped as one, so that no control string arises where they meet.
            self.write(escape("".join(texts)), role in self.trained)
            texts.clear()
            self.attach(part)
        self.write(escape("".join(texts)), role in self.trained)
        self.write(END + "\n")

    def attach(self, part: dict) -> None:
        kind = part["kind"]
        if kind not in ("image", "audio", "document"):
            raise ValueError(f"unknown kind of part: {kind}")
        number = len(self.attachments) + 1
        tokens = getattr(self.expansion, kind)(part)
        self.attachments.append({"number": number, "kind": kind, "ref": part.get("ref"), "tokens": tokens, "at": self.size})
        self.write(f"<|{kind}_{number}|>")


def read_back(formatted: str, attachments: list[dict] | None = None) -> list[tuple[str, list[dict]]]:
    """The turns of a formatted conversation: roles and parts, attachments by their recorded references."""
    known = {a["number"]: a for a in attachments or []}
    turns = []
    for role, content in _TURN.findall(formatted):
        parts, end = [], 0
        for found in _PLACEHOLDER.finditer(content):
            if found.start() > end:
                parts.append({"kind": "text", "text": unescape(content[end : found.start()])})
            parts.append({"kind": found[1], "ref": known.get(int(found[2]), {}).get("ref")})
            end = found.end()
        if end < len(content):
            parts.append({"kind": "text", "text": unescape(content[end:])})
        turns.append((unescape(role.replace(LINE, "\n")), parts))
    return turns


def text_part(text: Column) -> Column:
    """The content of a turn that has one text."""
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *nothing)).cast(PARTS)


def format_chats(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    expansion: Expansion = Expansion(), trained: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: ``formatted``, ``loss`` spans, ``attachments`` and ``text_chars``."""
    rows = turns.select(
        turns[conversation].alias("id"), turns[turn].alias("turn"), turns[role].alias("role"), turns[parts].cast(PARTS).alias("parts")
    )
    kind = rows.schema["id"].dataType.simpleString()
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns"))

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for conversation_turns in batch.column(1):
                visitor = Formatter(expansion, frozenset(trained))
                for one in conversation_turns.as_py():
                    visitor.turn(one["role"], one["parts"])
                made.append(visitor)
            spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            links = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("at", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(["".join(v.pieces) for v in made], pa.string()), pa.array([v.loss for v in made], spans), pa.array([v.attachments for v in made], links)],
                ["id", "formatted", "loss", "attachments"],
            )

    found = whole.select("id", "turns").mapInArrow(formatted, f"id {kind}, formatted string, loss {SPAN}, attachments {ATTACHMENT}")
    return found.withColumnRenamed("id", conversation)


def digests(chats: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What is read back from formatted conversations: turns, text under the loss mask, sizes."""
    kind = chats.schema[conversation].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()
        for batch in batches:
            rows = []
            for body, spans, links in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                turns = read_back(body, links)
                said = "".join(f"{role}\n{''.join(p.get('text') or '' for p in parts)}\n" for role, parts in turns)
                learned = "".join(unescape(body[s["start"] : s["start"] + s["length"]]) for s in spans)
                rows.append((len(turns), sha(said), len(learned), sha(learned), len(body)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    found = chats.select(chats[conversation].alias("id"), "formatted", "loss", "attachments").mapInArrow(
        read, f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
    return found.withColumnRenamed("id", conversation)
