"""Chat formatting: a state machine over roles and a declarative template.

A conversation becomes a stream of segments, each with a loss flag. The machine's
state is the last role; every turn is checked against the roles that may follow.
Texts and unknown roles are escaped, so that the template's marks occur in the
output only where a turn begins or ends, and :func:`read_back` finds exactly the
turns that went in.

A conversation's rows are sorted by an external sort and go through the machine
one after the other, batch by batch: nothing is held but the state and, when
reading, the turn at hand.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and characters handed back at once.
OUT_ROWS, OUT_CHARS = 2_000, 1 << 22
START = None


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles are trained, and which may follow which.

    A turn is ``opening, name, naming, text, closing, after``. A role without a
    name stands there itself, behind ``other``. ``follows`` maps the last role
    (``START`` before the first turn) to the roles that may come next.
    """

    opening: str = "### "
    naming: str = ": "
    closing: str = "</turn>"
    after: str = "\n"
    escape: str = "\\"
    other: str = "?"
    names: Mapping[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"}
    )
    trained: Sequence[str] = ("assistant",)
    follows: Mapping[str | None, Sequence[str]] = field(
        default_factory=lambda: {
            START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)
        }
    )

    def __post_init__(self) -> None:
        marks = (self.opening, self.naming, self.closing)
        for mark in marks:
            if not mark or self.escape in mark:
                raise ValueError(f"a mark is empty or holds the escape character: {mark!r}")
            # A mark that ends as it begins could start in a text's last characters.
            if any(mark[:i] == mark[-i:] for i in range(1, len(mark))):
                raise ValueError(f"a mark ends as it begins: {mark!r}")
        if len(self.escape) != 1 or len(set(self.names.values())) < len(self.names):
            raise ValueError("one escape character and different names are needed")
        if not self.other or any(n.startswith(self.other) or self.escaped_role(n) != n for n in self.names.values()):
            raise ValueError("a name holds a mark")

    def _pattern(self, *marks: str) -> re.Pattern:
        return re.compile("|".join(re.escape(x) for x in (self.escape, self.opening, *marks)))

    def escaped(self, text: str) -> str:
        return self._pattern(self.closing).sub(lambda m: self.escape + m.group(), text)

    def escaped_role(self, role: str) -> str:
        return self._pattern(self.closing, self.naming).sub(lambda m: self.escape + m.group(), role)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)

    def head(self, role: str) -> str:
        name = self.names.get(role)
        if name is None:
            name = self.other + self.escaped_role(role)
        return self.opening + name + self.naming

    def role_of(self, name: str) -> str:
        if name.startswith(self.other):
            return self.unescaped(name[len(self.other) :])
        return {shown: role for role, shown in self.names.items()}[name]


TEMPLATE = Template()


class Machine:
    """The state machine over the roles of one conversation."""

    def __init__(self, template: Template):
        self.template, self.state = template, START

    def step(self, role: str) -> bool:
        """Goes on to ``role``; false if it may not follow here."""
        allowed = role in self.template.follows.get(self.state, ())
        self.state = role
        return allowed


SEGMENTS = "conv_id long, segment long, text string, loss boolean, allowed boolean"
TURNS = "conv_id long, n long, role string, text string, loss_text string, n_chars long"


def _batches(rows: Iterator[tuple], schema: pa.Schema, text_at: int) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[text_at])
        if len(held) >= OUT_ROWS or chars >= OUT_CHARS:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema
            )
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema
        )


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def segments(conversations: DataFrame, template: Template = TEMPLATE, id_column: str = "conv_id") -> DataFrame:
    """(conv_id, segment, text, loss, allowed): the formatted conversations, in order.

    Joined by ``segment``, a conversation's texts are its formatted string; the
    loss flag covers the escaped texts of trained roles, nothing else. ``allowed``
    is false for the segments of a turn whose role may not follow the one before.
    No turn is dropped.

    Turns stand in order, null turns first, equal ones by role and text. Null
    roles and texts are empty ones. Rows without conversation take no part;
    repeated rows are repeated turns; an empty table gives an empty one; further
    columns are not looked at.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("segment", pa.int64()), ("text", pa.string()),
        ("loss", pa.bool_()), ("allowed", pa.bool_()),
    ])

    def turn_segments(batches):
        at, machine, number = None, Machine(template), 0
        for conv, role, text in _rows(batches):
            if conv != at:
                at, machine, number = conv, Machine(template), 0
            allowed = machine.step(role)
            head, body = template.head(role), template.escaped(text)
            tail = template.closing + template.after
            parts = ((head, False), (body, True), (tail, False)) if role in template.trained else (
                (head + body + tail, False),
            )
            for part, loss in parts:
                yield conv, number, part, loss, allowed
                number += 1

    rows = conversations.filter(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(
        lambda batches: _batches(turn_segments(batches), schema, 2), SEGMENTS
    )


class Reader:
    """Finds the turns in a stream of segments; holds one turn at a time."""

    def __init__(self, template: Template):
        t = self.template = template

        def up_to(mark: str) -> str:
            """Everything before the first unescaped ``mark``, without keeping places to return to."""
            first, escape = re.escape(mark[0]), re.escape(t.escape)
            return f"((?:[^{escape}{first}]++|{escape}.|(?!{re.escape(mark)}){first})*+){re.escape(mark)}"

        self.turn = re.compile(
            re.escape(t.opening) + up_to(t.naming) + up_to(t.closing) + re.escape(t.after), re.DOTALL
        )
        self.closing = t.closing + t.after
        self.held: list[str] = []
        self.masked: list[str] = []

    def feed(self, text: str, loss: bool) -> Iterator[tuple[str, str, str, int]]:
        """(role, text, text under the loss mask, characters) of each turn that ends here."""
        self.held.append(text)
        if loss:
            self.masked.append(text)
        if not text.endswith(self.closing):  # a turn ends where a segment ends
            return
        found = self.turn.fullmatch("".join(self.held))
        if found:
            t = self.template
            yield t.role_of(found[1]), t.unescaped(found[2]), t.unescaped("".join(self.masked)), len(found[0])
            self.held, self.masked = [], []

    def finish(self) -> None:
        if self.held:
            raise ValueError("the segments end inside a turn")


def _turns(batches, template: Template) -> Iterator[tuple]:
    at, reader, n = None, Reader(template), 0
    for conv, text, loss, allowed in _rows(batches):
        if conv != at:
            reader.finish()
            at, n = conv, 0
        for role, body, masked, chars in reader.feed(text, loss):
            yield conv, n, role, body, masked, chars, allowed
            n += 1
    reader.finish()


def _in_order(formatted: DataFrame, ordered: bool) -> DataFrame:
    if not ordered:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return formatted.select("conv_id", "text", "loss", "allowed")


def read_back(formatted: DataFrame, template: Template = TEMPLATE, ordered: bool = False) -> DataFrame:
    """(conv_id, n, role, text, loss_text, n_chars): the turns that :func:`segments` went through.

    ``loss_text`` is what the loss mask covers, unescaped; ``n_chars`` counts the
    turn's formatted characters. ``ordered`` says that the rows come straight
    from :func:`segments`. Segments that hold no whole turn fail the job.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string()),
        ("loss_text", pa.string()), ("n_chars", pa.int64()),
    ])
    return _in_order(formatted, ordered).mapInArrow(
        lambda batches: _batches((row[:-1] for row in _turns(batches, template)), schema, 3), TURNS
    )


SUMMARY = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)


def summaries(formatted: DataFrame, template: Template = TEMPLATE, ordered: bool = False) -> DataFrame:
    """One row per conversation, read back from its segments.

    n_turns, turns_sha256 (role, line break, text, line break per turn),
    loss_chars and loss_sha256 of all text under the loss mask, formatted_chars,
    and valid: every role was allowed where it stands.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
        ("valid", pa.bool_()),
    ])

    def rows(batches):
        at = None
        for conv, n, role, text, masked, chars, allowed in _turns(batches, template):
            if conv != at:
                if at is not None:
                    yield at, turns, whole.hexdigest(), lost, under.hexdigest(), total, valid
                at, whole, under = conv, hashlib.sha256(), hashlib.sha256()
                lost, total, valid = 0, 0, True
            turns = n + 1
            whole.update(f"{role}\n{text}\n".encode())
            under.update(masked.encode())
            lost, total, valid = lost + len(masked), total + chars, valid and allowed
        if at is not None:
            yield at, turns, whole.hexdigest(), lost, under.hexdigest(), total, valid

    return _in_order(formatted, ordered).mapInArrow(lambda batches: _batches(rows(batches), schema, 2), SUMMARY)
