"""Chat formatting: typed content parts are flattened to placeholders, turns are marked, and both are read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\([n\\])")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

PART = "type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int"
ATTACHMENT = "kind: string, ref: string, position: int, tokens: long"
FORMATTED = (
    "conv_id long, turn long, role string, segment string, loss_start long, loss_end long, "
    f"attachments array<struct<{ATTACHMENT}>>, expanded_tokens long"
)


def escape(text: str) -> str:
    """Text in which no control string can start: a backslash goes into each `<|`, and one more where some are."""
    return _OPEN.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    """A role on one line: line breaks and backslashes as `\\n` and `\\\\`, then as any text."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n")) if "\\" in role or "\n" in role or "<" in role else role


def unescape_role(text: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else "\\", unescape(text)) if "\\" in text else text


@dataclass
class Flattened:
    """What a visitor makes of the parts of one turn.

    Texts that follow each other are escaped as one, so that no control string can begin in one and end in another.
    """

    body: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    expanded: int = 0

    def end_text(self) -> None:
        if self.texts:
            self.body.append(escape("".join(self.texts)))
            self.texts.clear()


class PartVisitor:
    """Visits the parts of a turn in order.  The sizes say how many tokens an attachment becomes in a model.

    An unknown type counts as text; a part without a size counts as one patch, second or page.
    """

    def __init__(self, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 256):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def flatten(self, parts: list[dict] | None) -> Flattened:
        out = Flattened()
        for part in parts or ():
            if part is not None:
                getattr(self, f"visit_{part.get('type')}", self.visit_text)(part, out)
        out.end_text()
        return out

    def visit_text(self, part: dict, out: Flattened) -> None:
        out.texts.append(part.get("text") or "")

    def visit_image(self, part: dict, out: Flattened) -> None:
        across, down = (max(1, -(-(part.get(k) or 0) // self.patch)) for k in ("width", "height"))
        self._attach("image", part, across * down, out)

    def visit_audio(self, part: dict, out: Flattened) -> None:
        self._attach("audio", part, max(1, round((part.get("seconds") or 0.0) * self.audio_rate)), out)

    def visit_document(self, part: dict, out: Flattened) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * self.page_tokens, out)
        if part.get("text"):
            self.visit_text(part, out)

    def _attach(self, kind: str, part: dict, tokens: int, out: Flattened) -> None:
        out.attachments.append({"kind": kind, "ref": part.get("ref"), "position": len(out.attachments), "tokens": tokens})
        out.end_text()
        out.body.append(f"<|{kind}:{len(out.attachments) - 1}|>")
        out.expanded += tokens


def text_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of plain texts as rows of one text part each."""
    null = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    part = F.struct(F.lit("text").alias("type"), F.col(text).cast("string").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in null.items()])
    return df.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_turns(df: DataFrame, visitor: PartVisitor | None = None, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each turn: its segment of the formatted conversation, with the loss mask as a span of code points.

    df has conv_id, turn, role and parts.  A conversation reads as its segments in the order of `turn_order`.
    Control strings inside texts and roles, and line breaks in roles, are escaped so that they can be read back.  Null
    texts and roles are empty, null parts are skipped, a turn without parts has an empty body; nulls in conv_id and
    turn stay.  Repeated rows are turns of their own; other columns are not read; an empty table gives no rows.
    """
    visitor = visitor or PartVisitor()
    own = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column("role").to_pylist()
            segments, starts, ends, attached, expanded = [], [], [], [], []
            for role, parts in zip(roles, batch.column("parts").to_pylist(), strict=True):
                flat = visitor.flatten(parts)
                head = f"{START}{escape_role(role)}\n"
                body = "".join(flat.body)
                segments.append(f"{head}{body}{END}\n")
                on = role in trained
                starts.append(len(head) if on else None)
                ends.append(len(head) + len(body) if on else None)
                attached.append(flat.attachments)
                expanded.append(flat.expanded)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int32()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": batch.column("conv_id"),
                    "turn": batch.column("turn"),
                    "role": batch.column("role"),
                    "segment": pa.array(segments, pa.string()),
                    "loss_start": pa.array(starts, pa.int64()),
                    "loss_end": pa.array(ends, pa.int64()),
                    "attachments": pa.array(attached, kind),
                    "expanded_tokens": pa.array(expanded, pa.int64()),
                }
            )

    return own.mapInArrow(run, FORMATTED)


def turn_order() -> list:
    """The order of turns in a conversation: by number, nulls first, ties by role and text."""
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("segment")]


class _Reader:
    """Reads the segments of one conversation, one after the other, and keeps digests only."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def feed(self, segment: str, start: int | None, end: int | None) -> None:
        at = 0
        for m in _TURN.finditer(segment):
            if m.start() != at:
                raise ValueError("text between turns")
            at = m.end()
            self.turns += 1
            self.all.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
        if at != len(segment):
            raise ValueError("a turn is not closed")
        if start is not None:
            text = unescape(segment[start:end])
            self.loss += len(text)
            self.masked.update(text.encode())
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation: what a reader of the formatted text finds in it.

    Conversations are dealt by id and sorted in their partitions; a task reads their turns as a stream and holds
    one turn and two running digests, so a conversation of any length fits.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, done = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")]
            for conv, segment, start, end in zip(*columns, strict=True):
                if reader is None or reader.conv_id != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv)
                reader.feed(segment, start, end)
            if len(done) >= 1000:
                yield out()
                done = []
        if reader is not None:
            done.append(reader.row())
            yield out()

    own = formatted.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end")
    return own.repartition("conv_id").sortWithinPartitions(*turn_order()).mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
