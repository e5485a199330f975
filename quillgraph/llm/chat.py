"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Turns are dealt by conversation and sorted; a task streams through them with
one state per conversation, so a conversation of any length needs no more
memory than one turn.  The output is one row per segment with its loss flag.
``read_back`` streams through segments the same way, joins them to the formatted
text and parses that with the template: no role and no text is taken from the
rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id bigint, turn_no bigint, segment int, kind string, text string, loss boolean, valid boolean"
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands around a turn of each role, which texts bear loss, which role may follow which.

    ``other`` marks a turn whose role the template does not know; the role's
    name is then part of the output.
    """

    around: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<s><<SYS>>\n", "\n<</SYS>>"),
            "user": ("<s>[INST] ", " [/INST]"),
            "assistant": ("<s>", "</s>"),
        }
    )
    other: tuple[str, str, str] = ("<s>[ROLE] ", " [/ROLE] ", "[/TURN]")
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "asked", ("start", "user"): "question", ("asked", "user"): "question",
            ("question", "assistant"): "answer", ("answer", "user"): "question",
        }
    )
    final: frozenset[str] = frozenset({"answer"})
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]")

    def pattern(self) -> re.Pattern:
        return re.compile(r"\\|" + "|".join(f"(?={re.escape(c)})." for c in self.controls), re.DOTALL)

    def segments(self, role: str, text: str, mark: re.Pattern) -> list[tuple[str, str, bool]]:
        """``(kind, text, loss)`` of one turn."""
        kept = escape(text, mark)
        if role in self.around:
            before, after = self.around[role]
            return [("mark", before, False), ("text", kept, role in self.loss), ("mark", after, False)]
        before, between, after = self.other
        return [
            ("mark", before, False), ("role", escape(role, mark), False), ("mark", between, False),
            ("text", kept, role in self.loss), ("mark", after, False),
        ]


def escape(text: str, mark: re.Pattern) -> str:
    """Put a backslash behind the first character of every control string, and double backslashes."""
    return mark.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    r"""Undo ``escape``: a pair of backslashes is one, a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", text) if ESCAPE in text else text


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4_096) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows and characters."""
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or chars > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_SEGMENT_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())]
)
_READ_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())]
)


def format_chat(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of every conversation, in order within it.

    ``turns`` has ``conv_id, turn, role, text``; turns of equal number are
    ordered by role and text.  A null role or text counts as empty, rows with a
    null ``conv_id`` are one conversation, a null turn comes first.  ``valid``
    is false from the first turn that the role machine does not allow; such
    turns are formatted all the same.  No rows give no rows.
    """

    def run(batches):
        mark = template.pattern()

        def walk():
            seen, state, number = object(), template.start, 0
            for conv, role, text in _rows(batches):
                if conv != seen:
                    seen, state, number = conv, template.start, 0
                state = template.moves.get((state, role), "refused")
                for at, (kind, part, loss) in enumerate(template.segments(role, text, mark)):
                    yield conv, number, at, kind, part, loss, state != "refused"
                number += 1

        return _batches(walk(), _SEGMENT_SCHEMA)

    ordered = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


def parse_turns(formatted: str, template: Template = Template()) -> Iterator[tuple[str, int, int, int]]:
    """``(role, start, end, after)`` of each whole turn at the head of a formatted text.

    The escaped text of the turn is ``formatted[start:end]``, the next turn
    begins at ``after``.  A turn that is not closed yet ends the walk; a place
    where no turn can begin is an error.  Escaped texts hold no control string,
    so the first closing mark is the turn's own.
    """
    opened, between, closed = template.other
    # An opening mark may begin with another one.
    marks = sorted([(before, role) for role, (before, _) in template.around.items()] + [(opened, None)], key=lambda m: -len(m[0]))
    at = 0
    while at < len(formatted):
        before, role = next(((b, r) for b, r in marks if formatted.startswith(b, at)), (None, None))
        if before is None:
            raise ValueError("the formatted text does not follow the template")
        start, closing = at + len(before), closed
        if role is None:
            middle = formatted.find(between, start)
            if middle < 0:
                return
            role, start = unescape(formatted[start:middle]), middle + len(between)
        else:
            closing = template.around[role][1]
        end = formatted.find(closing, start)
        if end < 0:
            return
        at = end + len(closing)
        yield role, start, end, at


class _Conversation:
    """What has been read of one conversation: digests, and the formatted text behind the last whole turn."""

    def __init__(self, conv: int | None, template: Template):
        self.conv, self.template, self.state = conv, template, template.start
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.valid = True
        self.rest = ""

    def read(self, parts: list[tuple[str, bool]]) -> None:
        """Take the texts of some segments with their loss flags."""
        formatted, masked = self.rest + "".join(text for text, _ in parts), []
        at = len(self.rest)
        for text, loss in parts:
            if loss:
                masked.append((at, at + len(text)))
            at += len(text)
        self.chars += at - len(self.rest)
        done = 0
        for role, start, end, after in parse_turns(formatted, self.template):
            self.turns.update(f"{role}\n{unescape(formatted[start:end])}\n".encode("utf-8", "surrogatepass"))
            under = unescape("".join(formatted[max(a, done) : min(b, after)] for a, b in masked if a < after and b > done))
            self.loss.update(under.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(under)
            self.n_turns += 1
            self.state = self.template.moves.get((self.state, role), "refused")
            self.valid = self.valid and self.state != "refused"
            done = after
        self.rest = formatted[done:]
        if any(b > done for _, b in masked):
            raise ValueError("a segment under the loss mask is not within a whole turn")

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("the formatted text ends within a turn")
        valid = self.valid and self.state in self.template.final
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid


def read_back(segments: DataFrame, template: Template = Template(), in_order: bool = False) -> DataFrame:
    """One row per conversation, parsed from the formatted text that its segments join to.

    Only the texts and the loss flags of the segments are read.  Segments are
    brought into order first, so they may come from any files; with
    ``in_order`` they are taken as ``format_chat`` returns them.  ``valid``
    tells whether the roles came in an allowed order and ended in a final
    state.  A text that does not follow the template is an error.
    """

    def run(batches):
        def walk():
            reader, turn, parts = None, None, []
            for conv, number, part, loss in _rows(batches):
                if reader is None or conv != reader.conv or number != turn:
                    if reader is not None:
                        reader.read(parts)
                        if conv != reader.conv:
                            yield reader.row()
                    if reader is None or conv != reader.conv:
                        reader = _Conversation(conv, template)
                    turn, parts = number, []
                parts.append((part, loss))
            if reader is not None:
                reader.read(parts)
                yield reader.row()

        return _batches(walk(), _READ_SCHEMA)

    if not in_order:
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "segment")
    return segments.select("conv_id", "turn_no", "text", "loss").mapInArrow(run, READ)
