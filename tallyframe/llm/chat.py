"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string.  Where a turn stands in the output is
found without looking inside the template: successive prefixes of the turns are rendered, and what an
output adds to the one before is the turn's span.  A template whose output for a longer prefix does not
begin with the output for the shorter one rewrites history, and is reported as such.

Conversations are streamed in turn order.  A long one is rendered in windows of turns that overlap by
the context that the template says it looks back, so neither memory nor time grows with the square of
its length, and a conversation that holds a third of all rows is no special case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
#: Turns that are rendered together.
WINDOW = 32
Turn = tuple[str, str]


class RewritesHistory(ValueError):
    """The template changes what it said of earlier turns when a turn is added."""


def escape(text: str) -> str:
    """Reversible, and free of control strings: `<|` becomes `<\\|`, after any run of backslashes
    between the two characters has been lengthened by one."""
    if "<" not in text:
        return text
    out, at = [], 0
    while (i := text.find("<", at)) >= 0:
        j = i + 1
        while text.startswith("\\", j):
            j += 1
        out.append(text[at:j])
        if text.startswith("|", j):
            out.append("\\")
        at = j
    return "".join(out) + text[at:]


def unescape(text: str) -> str:
    if "<\\" not in text:
        return text
    out, at = [], 0
    while (i := text.find("<\\", at)) >= 0:
        j = i + 1
        while text.startswith("\\", j):
            j += 1
        out.append(text[at : j - 1] if text.startswith("|", j) else text[at:j])
        at = j
    return "".join(out) + text[at:]


def chatml(turns: list[Turn]) -> str:
    """The template of the query: each turn is marked, and texts and roles are escaped."""
    return "".join(f"{START}{_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def _role(role: str) -> str:
    return escape(role).replace("&", "&amp;").replace("\n", "&#10;")


def read_turn(span: str) -> tuple[str, str, int, int]:
    """chatml's span of one turn -> role, text, and where the escaped text begins and ends in it."""
    if not span.startswith(START) or not span.endswith(END + "\n"):
        raise ValueError("the span is not one turn")
    nl, end = span.index("\n"), len(span) - len(END) - 1
    if nl >= end or END in span[:end] or START in span[len(START) :]:
        raise ValueError("the span holds a control string")
    role = unescape(span[len(START) : nl].replace("&#10;", "\n").replace("&amp;", "&"))
    return role, unescape(span[nl + 1 : end]), nl + 1, end


def spans(render: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The output for all turns, and each turn's (start, end) in it.  What is there without any turn
    belongs to none; of a template that refuses an empty list with a LookupError or ValueError, what
    stands before the first turn belongs to that."""
    try:
        before = render([])
    except (LookupError, ValueError):
        before = ""
    found = []
    for k in range(1, len(turns) + 1):
        now = render(turns[:k])
        if not now.startswith(before):
            raise RewritesHistory(f"turn {k} changed the {len(before)} characters before it")
        found.append((len(before), len(now)))
        before = now
    return before, found


@dataclass(frozen=True)
class Template:
    render: Callable[[list[Turn]], str] = chatml
    read: Callable[[str], tuple[str, str, int, int]] = read_turn
    #: Turns before a turn that its rendering may depend on; None: any, so all are rendered each time.
    #: A number is a promise that isn't checked; without one, only chatml is known to look at none.
    context: int | None = None
    #: Roles whose texts the loss mask covers.
    trained: tuple[str, ...] = ("assistant",)

    def pieces(self, turns: Iterable[Turn], window: int = WINDOW) -> Iterator[tuple[bool, str]]:
        """The output in parts: (is it a turn, its text).  What the template puts before the first turn
        is a part of its own, where there is any; then each turn's span follows, in order."""
        context = 0 if self.context is None and self.render is chatml else self.context
        if context is None:
            out, found = spans(self.render, list(turns))
            if found and found[0][0]:
                yield False, out[: found[0][0]]
            yield from ((True, out[a:b]) for a, b in found)
            return
        begun = False
        behind: list[Turn] = []
        ahead: list[Turn] = []

        def flush() -> Iterator[tuple[bool, str]]:
            nonlocal behind, ahead, begun
            out, found = spans(self.render, behind + ahead)
            if not begun and found[0][0]:
                yield False, out[: found[0][0]]
            begun = True
            yield from ((True, out[a:b]) for a, b in found[len(behind) :])
            behind, ahead = (behind + ahead)[len(behind + ahead) - context :], []

        for turn in turns:
            ahead.append(turn)
            if len(ahead) == window:
                yield from flush()
        if ahead:
            yield from flush()


class Digest:
    """What is read back from the output of one conversation, turn by turn."""

    def __init__(self, template: Template) -> None:
        self.template, self.turns, self.loss = template, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, span: str) -> tuple[int, int] | None:
        """Returns the loss mask's part in the span, if any."""
        role, text, a, b = self.template.read(span)
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n_turns += 1
        masked = None
        if role in self.template.trained:
            self.loss.update(text.encode())
            self.loss_chars += len(text)
            masked = (self.chars + a, self.chars + b)
        self.chars += len(span)
        return masked

    def skip(self, text: str) -> None:
        """Text of no turn."""
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _conversations(batches) -> Iterator[tuple]:
    """Rows sorted by conversation and turn, as (new conversation?, id, role, text)."""
    last: tuple = ()
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield (conv,) != last, conv, role, text
            last = (conv,)


def _formatted(template: Template, keep_output: bool):
    def run(batches):
        rows: list[tuple] = []
        stream = _conversations(batches)
        head = next(stream, None)
        while head:
            conv, digest, out, mask = head[1], Digest(template), [], []
            nxt: list = [None]

            def turns(first=head, nxt=nxt):
                yield first[2], first[3]
                for row in stream:
                    if row[0]:
                        nxt[0] = row
                        return
                    yield row[2], row[3]

            for is_turn, span in template.pieces(turns()):
                masked = digest.add(span) if is_turn else digest.skip(span)
                if keep_output:
                    out.append(span)
                    mask += [masked] if masked else []
            rows.append((conv, *digest.row()) + (("".join(out), [{"start": a, "end": b} for a, b in mask]) if keep_output else ()))
            if len(rows) == 500:
                yield _batch(rows, keep_output)
                rows = []
            head = nxt[0]
        if rows:
            yield _batch(rows, keep_output)

    return run


def _batch(rows: list[tuple], keep_output: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    if keep_output:
        kinds += [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        names += ["formatted", "loss_spans"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def formatted(turns: DataFrame, template: Template | None = None, keep_output: bool = False) -> DataFrame:
    """(conv_id, turn, role, text) -> one row for each conversation; keep_output adds the formatted
    text and the loss mask's spans (that holds a conversation in memory; the digests alone don't).

    The digests go over a conversation's turns in order, so one task streams all of them, however many
    they are; it holds a window of turns, or all of them for a template without a context.

    Null texts and roles are empty; rows with null conv_id form one conversation.  Turns go by
    number, nulls first, and equal numbers by role and text; repeated rows all count.  An empty table
    gives an empty result; other columns are ignored."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role"), F.lit("")).alias("role"), text_or_empty().alias("text"), F.col("turn").alias("turn"))
    dealt = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long" + ", formatted string, loss_spans array<struct<start:long,end:long>>" * keep_output
    return dealt.mapInArrow(bounded(_formatted(template or Template(), keep_output)), kind)
