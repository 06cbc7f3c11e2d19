"""Chat formatting: a finite-state machine over roles, a declarative template, and loss flags.

Rows of a conversation are taken by turn. The machine checks the order of roles; whatever the order, each turn becomes
segments of text with a loss flag, true for what an assistant said. Control strings inside a text, and the escape
character, get an escape character in front, so that a formatted conversation can be read back exactly.

Conversations are dealt out by id and read in order, row after row: a long one is never gathered in memory. Null roles
and texts are empty; rows with a null id form one conversation; rows of one turn number are ordered by role and text.
Unknown roles get a general frame and break the order. An empty table gives no rows. Other columns are not read. The
order of a conversation makes one task read all of it, and all rows without an id, but only one row at a time; long texts
are formatted one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_arrow


@dataclass(frozen=True)
class Template:
    """Frames around each role's text, the roles that loss is taken on, and the order of roles as state -> role -> state."""

    frames: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("<<ROLE>>", "<<TEXT>>", "<</TEXT>>")
    escape: str = "\\"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    ends: frozenset[str] = frozenset({"user", "assistant"})

    def controls(self) -> list[str]:
        return sorted({x for pair in self.frames.values() for x in pair} | {*self.other}, key=lambda x: (-len(x), x))


class Formatter:
    """Turns into segments, and segments back into turns."""

    def __init__(self, template: Template):
        self.template = template
        self.control = re.compile("|".join(map(re.escape, [*template.controls(), template.escape])))
        self.escaped = re.compile(re.escape(template.escape) + "(" + "|".join(map(re.escape, [*template.controls(), template.escape])) + ")")
        self.begin = {a: role for role, (a, _) in template.frames.items()}

    def escape(self, text: str) -> str:
        return self.control.sub(lambda m: self.template.escape + m[0], text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[1], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        loss = role in self.template.loss_roles
        if role in self.template.frames:
            before, after = self.template.frames[role]
        else:
            first, second, after = self.template.other
            before = first + self.escape(role) + second
        return [(before, False), (self.escape(text), loss), (after, False)]

    def turns(self, formatted: str) -> Iterator[tuple[str, str, bool]]:
        """Role, text and loss flag of each turn of a formatted string of whole turns."""
        marks: list[tuple[int, int, str]] = []
        at = 0
        while m := self.control.search(formatted, at):
            if m[0] == self.template.escape:
                literal = self.control.match(formatted, m.end())
                at = literal.end() if literal else m.end()
            else:
                marks.append((m.start(), m.end(), m[0]))
                at = m.end()
        i = 0
        while i < len(marks):
            if marks[i][2] in self.begin:
                role = self.begin[marks[i][2]]
            else:
                role, i = self.unescape(formatted[marks[i][1] : marks[i + 1][0]]), i + 1
            yield role, self.unescape(formatted[marks[i][1] : marks[i + 1][0]]), role in self.template.loss_roles
            i += 2


def valid_order(template: Template):
    """A machine: give it roles one by one; ``ok`` so far, ``done`` if it may end here."""

    class Machine:
        state, ok = template.start, True

        def step(self, role: str) -> None:
            following = template.moves.get(self.state, {}).get(role)
            self.ok = self.ok and following is not None
            self.state = following or self.state

        @property
        def done(self) -> bool:
            return self.ok and self.state in template.ends

    return Machine()


def _dealt(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def format_conversations(turns: DataFrame, template: Template | None = None, *, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(id, seq, segment, loss): the text segments of every conversation, in order."""
    template = template or Template()
    dealt = _dealt(turns, conv_column, turn_column, role_column, text_column)
    kind = dealt.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter, last, seq = Formatter(template), (), 0
        for batch in batches:
            conv, number, out = [], [], []
            for c, role, text in _rows([batch]):
                if last != (c,):
                    last, seq = (c,), 0
                for segment in formatter.segments(role, text):
                    conv.append(c)
                    number.append(seq)
                    out.append(segment)
                    seq += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, batch.schema.field(0).type), pa.array(number, pa.int64()), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.bool_())], ["conv", "seq", "segment", "loss"]
            )

    return map_arrow(dealt, run, f"conv {kind}, seq long, segment string, loss boolean").withColumnRenamed("conv", conv_column)


def conversation_digests(turns: DataFrame, template: Template | None = None, *, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per conversation, read back from its formatted turns as they are made: counts, SHA-256 digests, and whether the order is valid."""
    template = template or Template()
    dealt = _dealt(turns, conv_column, turn_column, role_column, text_column)
    kind = dealt.schema["conv"].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = Formatter(template)
        done: list[tuple] = []
        conv_type, state = None, None

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        def end(s: dict) -> tuple:
            return s["conv"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["machine"].done

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, role, text in _rows([batch]):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        done.append(end(state))
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "machine": valid_order(template)}
                formatted = "".join(s for s, _ in formatter.segments(role, text))
                state["chars"] += len(formatted)
                for own_role, own_text, loss in formatter.turns(formatted):
                    state["n"] += 1
                    state["turns"].update(f"{own_role}\n{own_text}\n".encode())
                    state["machine"].step(own_role)
                    if loss:
                        state["loss"].update(own_text.encode())
                        state["loss_chars"] += len(own_text)
            if len(done) >= 1000:
                yield flush(done)
                done = []
        if state is not None:
            done.append(end(state))
        if done:
            yield flush(done)

    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return map_arrow(dealt, run, schema).withColumnRenamed("conv", conv_column)
