"""Chat formatting: a finite-state machine over roles and a declarative template with per-segment loss flags.

A conversation's rows are taken in turn order. The machine says for each turn whether the template's turn order
allows it; turns out of order are still formatted and flagged. Each turn gives segments (text, whether the loss
counts), so a conversation of any length streams through a task in bounded memory. Control strings inside a text
are escaped reversibly: to a `<` that is followed by backslashes and a bar, one backslash is added; reading back
removes it. Escaped text therefore never holds `<|`.

One shuffle, by conversation and then sorted by turn within partitions. A conversation is ordered by nature: its
turns meet in one task, which streams them and keeps nothing but the machine's state and a running digest.

Defined cases: a null text is the empty text and a null role the empty role; null turns come first; rows equal in
turn are ordered by role, then text; rows with a null conversation id form one conversation; repeated rows are
turns each; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, slices

SEGMENTS = "conv_id long, turn_no long, segment_no int, text string, loss boolean, in_order boolean"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"


@dataclass(frozen=True)
class Template:
    """What stands around a turn, the roles whose text is under the loss, and which roles may follow which ('' is the start)."""

    before: str = "<|im_start|>"
    between: str = "\n"
    after: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")})


CHATML = Template()
OPEN = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return OPEN.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def turn_segments(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    head = template.before + escape_role(role) + template.between
    return [(head, False), (escape(text), role in template.loss_roles), (template.after, False)]


def _ordered(df: DataFrame, cols: tuple[str, str, str, str]) -> DataFrame:
    conv, turn, role, text = (F.col(f"`{c}`") for c in cols)
    rows = df.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_segments(df: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Three rows per turn: its head, its text and its tail, in order; joined by conversation they are the formatted text.

    Rows of a conversation come out together and in order within one partition. in_order is false from the first
    turn on that the machine does not allow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = ()
        state, number, good = "", 0, True
        for b in slices(batches):
            out: list[tuple] = []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now != (conv,):
                    now, state, number, good = (conv,), "", 0, True
                good = good and role in template.follows.get(state, ())
                for k, (s, loss) in enumerate(turn_segments(role, text, template)):
                    out.append((conv, number, k, s, loss, good))
                state, number = role, number + 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            yield batch(["conv_id", "turn_no", "segment_no", "text", "loss", "in_order"], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)])

    return _ordered(df, (conv_col, turn_col, role_col, text_col)).mapInArrow(run, SEGMENTS)


def conversations(segments: DataFrame) -> DataFrame:
    """One formatted text per conversation, for conversations that fit into a row."""
    parts = F.array_sort(F.array_agg(F.struct("turn_no", "segment_no", "text")))
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda s: s["text"]), "").alias("formatted"), F.min("in_order").alias("in_order"))


class Reader:
    """Reads one conversation back from its segments, as they come, by the template's marks alone."""

    def __init__(self, template: Template):
        self.template = template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.in_order = True
        self.held = ""

    def feed(self, text: str, loss: bool, in_order: bool) -> None:
        self.chars += len(text)
        self.in_order = self.in_order and in_order
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.held += text
        if self.held.endswith(self.template.after):
            t = self.template
            whole = self.held[: -len(t.after)]
            assert whole.startswith(t.before)
            role, _, body = whole[len(t.before) :].partition(t.between)
            self.turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
            self.held = ""

    def row(self) -> tuple:
        return (self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.in_order)


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """Per conversation what its formatted text holds: turns, digests and the text under the loss. Reads format_segments' rows in their order."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order"]

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[]] * len(kinds)
        return batch(names, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        for b in slices(batches, rows=4096):
            done: list[tuple] = []
            for conv, text, loss, good in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                if reader is None or now != conv:
                    if reader is not None:
                        done.append((now, *reader.row()))
                    now, reader = conv, Reader(template)
                reader.feed(text, loss, good)
            yield rows(done)
        if reader is not None:
            yield rows([(now, *reader.row())])

    return segments.mapInArrow(run, READ)
