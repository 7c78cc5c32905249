"""Chat formatting: a finite-state machine over roles, and a declarative template that marks turns.

Each turn becomes three segments: an opening mark, its text with control strings escaped, a closing mark. Only texts of
roles that the template trains carry the loss flag. Control strings inside texts are escaped with a backslash, which
itself is doubled where it stands in a text, so reading the output back gives the turns and the trained text exactly.

Conversations stream through tasks ordered by (conv_id, turn, role, text); only one turn is held at a time, whatever the
length of a conversation.

Defined cases: null text and null role count as empty; turns with equal numbers go by role, then text; null turn numbers come
first; a null conv_id is a conversation of its own; repeated rows are turns of their own; roles outside the template are
written with their name and make the conversation invalid; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    end: str = "</s>"
    roles: dict[str, Role] = field(default_factory=lambda: {"system": Role("[SYS]", "[/SYS]"), "user": Role("[INST]", "[/INST]"), "assistant": Role("[ANS]", "[/ANS]", True)})
    #: Any other role: its name between the first two, its text before the third.
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    escape: str = "\\"
    #: Which role may follow which; None is the beginning.
    order: dict[str | None, tuple[str, ...]] = field(default_factory=lambda: {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        marks = {self.begin, self.end, *self.other, *(x for r in self.roles.values() for x in (r.opening, r.closing))}
        return sorted(marks, key=lambda x: (-len(x), x))


class Formatter:
    def __init__(self, template: Template) -> None:
        self.template = template
        marks = "|".join(map(re.escape, template.controls()))
        slash = re.escape(template.escape)
        self._special = re.compile(f"{slash}|{marks}")
        self._escaped = re.compile(f"{slash}({slash}|{marks})")
        self._scan = re.compile(f"{slash}(?:{slash}|{marks})|({marks})")
        self._closing = {r.opening: (name, r.closing) for name, r in template.roles.items()}

    def escape(self, text: str) -> str:
        return self._special.sub(lambda m: self.template.escape + m[0], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[1], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's segments with their loss flags."""
        known = self.template.roles.get(role)
        if known:
            return [(known.opening, False), (self.escape(text), known.loss), (known.closing, False)]
        a, b, c = self.template.other
        return [(a + self.escape(role) + b, False), (self.escape(text), False), (c, False)]

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Turns (role, text) of a formatted conversation or of a part that holds whole turns."""
        marks = [(m.start(1), m.end(1), m[1]) for m in self._scan.finditer(formatted) if m[1]]
        a, b, c = self.template.other
        k = 0
        while k < len(marks):
            start, end, mark = marks[k]
            if mark in (self.template.begin, self.template.end):
                k += 1
            elif mark in self._closing:
                role, closing = self._closing[mark]
                if marks[k + 1][2] != closing:
                    raise ValueError(f"{mark} is followed by {marks[k + 1][2]}")
                yield role, self.unescape(formatted[end : marks[k + 1][0]])
                k += 2
            elif mark == a and [m[2] for m in marks[k + 1 : k + 3]] == [b, c]:
                yield self.unescape(formatted[end : marks[k + 1][0]]), self.unescape(formatted[marks[k + 1][1] : marks[k + 2][0]])
                k += 3
            else:
                raise ValueError(f"{mark} does not open a turn")


class Conversation:
    """One pass over a conversation's turns: the state of the machine and digests of what is read back from the output."""

    def __init__(self, formatter: Formatter, conv_id: int | None) -> None:
        self.formatter, self.template, self.conv_id = formatter, formatter.template, conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = 0
        self.formatted_chars = len(self.template.begin)
        self.role: str | None = None
        self.error: str | None = None

    def add(self, role: str, text: str) -> str:
        """Take a turn and return its part of the output."""
        if self.error is None and role not in self.template.order.get(self.role, ()):
            self.error = f"turn {self.n_turns}: {role or 'no role'} after {self.role or 'the beginning'}"
        self.role = role
        segments = self.formatter.segments(role, text)
        part = "".join(s for s, _ in segments)
        for r, t in self.formatter.read(part):
            self.turns.update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        # The mask is spans of the output, and what lies under it is read back from there.
        ends = list(accumulate(len(s) for s, _ in segments))
        for (s, loss), end in zip(segments, ends, strict=True):
            if loss:
                own = self.formatter.unescape(part[end - len(s) : end])
                self.loss.update(own.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(own)
        self.formatted_chars += len(part)
        return part

    def row(self) -> tuple:
        error = self.error
        if error is None and self.role not in self.template.last:
            error = f"ends with {self.role or 'no turn'}"
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars + len(self.template.end), error is None, error


def format_conversation(turns: list[tuple[str, str]], template: Template | None = None) -> tuple[str, list[tuple[str, bool]]]:
    """The formatted text and its segments with loss flags."""
    formatter = Formatter(template or Template())
    segments = [(formatter.template.begin, False)]
    for role, text in turns:
        segments += formatter.segments(role, text)
    segments.append((formatter.template.end, False))
    return "".join(s for s, _ in segments), segments


ROWS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("error", pa.string())])
ROWS_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, error string"
SEGMENTS_DDL = "conv_id long, turn long, place int, text string, loss boolean"


def _rows(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    formatter, now, done = Formatter(template), None, []

    def flushed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), ROWS, strict=True)], schema=ROWS)
        done.clear()
        return made

    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = Conversation(formatter, conv_id)
            now.add(role, text)
        if len(done) > 5000:
            yield flushed()
    if now is not None:
        done.append(now.row())
    if done:
        yield flushed()


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def format_digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """A row per conversation with digests of the turns and the trained text, as read back from the formatted output."""
    template = template or Template()
    ordered = _turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(lambda b: _rows(b, template), ROWS_DDL)


def format_segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Every segment of every turn with its loss flag; a scan without a shuffle."""
    template = template or Template()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = Formatter(template)
        for batch in batches:
            out = [(c, t, k, s, loss) for c, t, r, x in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True) for k, (s, loss) in enumerate(formatter.segments(r, x))]
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "place", "text", "loss"])

    return _turns(conversations).mapInArrow(segments, SEGMENTS_DDL)
