"""Conversations to marked text segments with loss flags, and back.

A declarative template names the marks, the roles whose texts count for the
loss, and the finite-state machine over roles.  Rows of a conversation are
sorted by (turn, role, text) and walked as a stream, so memory holds one
Arrow batch and one turn, however long the conversation is.  The digests of
a conversation are sequential, so one conversation is walked by one task;
nothing of it is gathered.

Control strings inside texts and roles are escaped with a backslash and
come back unchanged.

Defined results: null role or text counts as empty; a null turn sorts
first; rows repeated with the same turn each stay one turn; rows with a null
conversation id form one conversation; an empty table gives an empty
result; extra columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = ""


@dataclass(frozen=True)
class Template:
    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    control: str = "<|"                     # escaped wherever it occurs in texts and roles
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state (the last role) -> roles that may come next
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        """Refuse marks that escaped roles and texts could not be told from."""
        if len(self.control) < 2 or "\\" in self.control or "\n" in self.control:
            raise ValueError("control needs two characters or more, none of them a backslash or a newline")
        if not self.opening.startswith(self.control) or not self.closing.startswith(self.control):
            raise ValueError("opening and closing must begin with the control string")
        if not self.after_role.startswith("\n"):
            raise ValueError("after_role must begin with a newline, which roles have escaped")

    def escape(self, s: str) -> str:
        return s.replace("\\", "\\\\").replace(self.control, self.control[0] + "\\" + self.control[1:])

    def unescape(self, s: str) -> str:
        return re.sub(r"\\(.)", r"\1", s, flags=re.S)

    def escape_role(self, s: str) -> str:
        """Roles end at ``after_role``, so that is escaped too."""
        return self.escape(s).replace("\n", "\\n")

    def unescape_role(self, s: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S)


def format_conversations(conversations: DataFrame, template: Template | None = None, conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments ``conv_id, seg, segment, loss, state, legal``, in order within their partition.

    Joined by ``seg``, the segments of a conversation are its formatted text;
    ``loss`` flags those that count.  ``state`` is the machine's state after
    the segment's turn, ``legal`` whether the move there was allowed.
    """
    t = template or Template()
    rows = conversations.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, seg, fresh = None, START, 0, True
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(),
                                     strict=True):
                if fresh or c != conv:
                    conv, state, seg, fresh = c, START, 0, False
                legal = role in t.moves.get(state, ())
                state = role
                for piece, loss in ((t.opening + t.escape_role(role) + t.after_role, False),
                                    (t.escape(text), role in t.loss_roles), (t.closing, False)):
                    for held, x in zip(out, (conv, seg, piece, loss, state, legal), strict=True):
                        held.append(x)
                    seg += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(),
                                                      pa.bool_()), strict=True)],
                ["conv_id", "seg", "segment", "loss", "state", "legal"])

    return rows.mapInArrow(segments, "conv_id bigint, seg bigint, segment string, loss boolean, "
                                     "state string, legal boolean")


class Reader:
    """Reads one conversation back from its segments, a turn at a time."""

    def __init__(self, template: Template):
        self.t = template
        self.turn = re.compile(re.escape(template.opening) + r"(.*?)" + re.escape(template.after_role) + r"(.*)"
                               + re.escape(template.closing), re.S)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.legal, self.state, self.held = True, START, []

    def feed(self, segment: str, loss: bool, state: str, legal: bool) -> None:
        self.chars += len(segment)
        self.legal &= legal
        self.state = state
        self.held.append(segment)
        if loss:
            text = self.t.unescape(segment)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        if segment == self.t.closing:        # texts are escaped, so only a mark can equal it
            m = self.turn.fullmatch("".join(self.held))
            if m is None:
                raise ValueError("segments do not form a turn")
            self.turns.update(f"{self.t.unescape_role(m[1])}\n{self.t.unescape(m[2])}\n".encode())
            self.n += 1
            self.held = []

    def row(self, conv) -> tuple:
        return (conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
                self.legal and self.state in self.t.final)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation the digests of what :func:`format_conversations` wrote, read from its segments.

    Takes the segments as that function returns them: whole conversations in
    order within a partition.
    """
    t = template or Template()
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds,
                                                                              strict=True)], names)
        conv, reader = None, None
        for b in batches:
            done = []
            for c, segment, loss, state, legal in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)),
                                                      strict=True):
                if reader is None or c != conv:
                    if reader is not None:
                        done.append(reader.row(conv))
                    conv, reader = c, Reader(t)
                reader.feed(segment, loss, state, legal)
            if done:
                yield batch(done)
        if reader is not None:
            yield batch([reader.row(conv)])

    return segments.mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                       "loss_sha256 string, formatted_chars bigint, valid boolean")
