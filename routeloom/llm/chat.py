"""Chat formatting by a finite-state machine over roles and a declarative template.

The template says how each role's turn opens and closes, which turns bear loss and which role may follow which. The
machine walks a conversation's turns in order, checks each transition and emits text segments with loss flags: the
opening, the text with control strings escaped, the closing. Joined, the segments are the formatted conversation;
``read_back`` parses it into the turns again.

Scale: one shuffle by conversation, sorted by turn; segments are streamed, so memory does not grow with a conversation.
A conversation's digest is sequential, so its rows pass through one task, as a stream and never as a collected group.

Defined results: turns are ordered by (turn, role, text), nulls first; a null text is empty, a null role is the role
"", roles the template lacks are written in its general form; rows with null conv_id are one conversation; repeated
rows are turns each; an invalid order is formatted all the same and flagged (``valid`` false from that turn on). Other
columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, text_bytes


@dataclass(frozen=True)
class Template:
    """opens/closes: control strings by role; general: (open, end of the role's name, close) of other roles."""

    turns: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    general: tuple = ("[ROLE]", "[/ROLE]", "[END]")
    loss: frozenset = frozenset({"assistant"})
    follows: dict = field(default_factory=lambda: {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})

    def __post_init__(self):
        controls = self.controls()
        for a in controls:
            if not a or "\\" in a:
                raise ValueError(f"control string {a!r}: empty or with the escape character")
            for b in controls:
                if a != b and (a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b))))):
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")
        if len(set(controls)) < len(controls):
            raise ValueError("a control string is used twice")

    def controls(self) -> list[str]:
        return [x for pair in self.turns.values() for x in pair] + list(self.general)

    def pattern(self) -> re.Pattern:
        """Groups: an escaped backslash or control string; a control string."""
        either = "|".join(map(re.escape, self.controls()))
        return re.compile(rf"\\(\\|{either})|({either})")

    def escape(self, text: str) -> str:
        return self._sub().sub(lambda m: "\\" + m[0], text)

    def _sub(self) -> re.Pattern:
        return re.compile("|".join([r"\\", *map(re.escape, self.controls())]))


class Machine:
    """Segments (text, loss) of turns that come one by one, and whether the order has been valid so far."""

    def __init__(self, template: Template):
        self.t, self.sub = template, template._sub()
        self.start()

    def start(self) -> None:
        self.state, self.valid = None, True

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        self.valid &= role in self.t.follows.get(self.state, ())
        self.state = role
        body = self.sub.sub(lambda m: "\\" + m[0], text)
        if role in self.t.turns:
            opens, closes = self.t.turns[role]
        else:
            opens, named, closes = self.t.general
            opens = opens + self.sub.sub(lambda m: "\\" + m[0], role) + named
        return [(opens, False), (body, role in self.t.loss), (closes, False)]

    def finished(self) -> bool:
        """An order that ends before an answer is valid, too; only an empty conversation is not."""
        return self.valid and self.state is not None


class Reader:
    """Parses a formatted conversation, fed piece by piece (no piece ends inside a control string)."""

    def __init__(self, template: Template):
        self.t, self.pattern = template, template.pattern()
        self.opens = {a: (role, b) for role, (a, b) in template.turns.items()}
        self.start()

    def start(self) -> None:
        self.role, self.close, self.text, self.naming = None, None, [], False

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """Turns (role, text) that the piece completes."""
        done, at = [], 0
        for m in self.pattern.finditer(piece):
            self._plain(piece[at : m.start()])
            at = m.end()
            if m[1] is not None:
                self._plain(m[1])
            elif self.close is None and m[2] in self.opens:
                (self.role, self.close), self.text = self.opens[m[2]], []
            elif self.close is None and m[2] == self.t.general[0]:
                self.naming, self.close, self.text = True, self.t.general[2], []
            elif self.naming and m[2] == self.t.general[1]:
                self.role, self.naming, self.text = "".join(self.text), False, []
            elif not self.naming and m[2] == self.close:
                done.append((self.role, "".join(self.text)))
                self.close = None
            else:
                raise ValueError(f"unexpected {m[2]!r}")
        self._plain(piece[at:])
        return done

    def _plain(self, text: str) -> None:
        if text and self.close is None:
            raise ValueError(f"text outside a turn: {text[:40]!r}")
        self.text.append(text)


SEGMENT = "conv_id long, seq long, turn long, role string, text string, loss boolean, valid boolean"


def format_chat(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every conversation, each conversation's in order within one partition. valid: the order of roles up
    to this turn."""
    ready(conversations)
    template = template or Template()
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_bytes("role").alias("role"), text_bytes("text").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]

    def run(batches):
        machine, now, seq = Machine(template), object(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                out: list[list] = [[] for _ in names]
                part = batch.slice(k, 2000)
                for conv, turn, role, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if conv != now:
                        machine.start()
                        now, seq = conv, 0
                    role, text = role.decode("utf-8", "replace"), text.decode("utf-8", "replace")
                    for segment, loss in machine.turn(role, text):
                        for column, v in zip(out, (conv, seq, turn, role, segment, loss, machine.valid), strict=True):
                            column.append(v)
                        seq += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, SEGMENT)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation as parsed from its formatted text and loss flags. Needs format_chat's row order."""
    template = template or Template()
    names = [f.split()[0] for f in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches):
        reader, plain = Reader(template), template.pattern()
        now, held = object(), None

        def row(conv, h):
            return (conv, h["turns"], h["all"].hexdigest(), h["chars"], h["loss"].hexdigest(), h["formatted"], h["valid"])

        for batch in batches:
            out = []
            for conv, text, loss, valid in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if conv != now:
                    if held:
                        out.append(row(now, held))
                    now, held = conv, {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "valid": True}
                    reader.start()
                held["formatted"] += len(text)
                held["valid"] &= valid
                for role, said in reader.feed(text):
                    held["turns"] += 1
                    held["all"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if loss:
                    bare = plain.sub(lambda m: m[1] if m[1] is not None else m[0], text)
                    held["chars"] += len(bare)
                    held["loss"].update(bare.encode("utf-8", "surrogatepass"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(now, held), kinds, strict=True)], names=names)

    return segments.select("conv_id", "text", "loss", "valid").mapInArrow(run, DIGEST)
