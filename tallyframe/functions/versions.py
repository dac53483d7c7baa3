"""Client versions: splitting, comparing, and finding them in assets."""

from __future__ import annotations

import re
from itertools import zip_longest

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.config import DEFAULT, Layout

_U64 = (1 << 64) - 1
_SPLIT = r"(?s)\A([^0-9]+)([0-9].*)\z"


def split_version(version: Column) -> Column:
    """struct<prefix, number>, null without a prefix or without a digit."""
    part = lambda i: F.regexp_extract(version, _SPLIT, i)
    return F.when(part(1) != "", F.struct(part(1).alias("prefix"), part(2).alias("number")))


def split_text(version: str) -> tuple[str, str] | None:
    m = re.match(r"(?s)([^0-9]+)([0-9].*)\Z", version)
    return (m[1], m[2]) if m else None


def _parts(number: Column) -> Column:
    """array<decimal(20,0)>: null where a component isn't a number of 64 bits; one leading dot is skipped."""
    texts = F.when(number == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(number, r"\A\.", ""), "[.]", -1))

    def value(x: Column) -> Column:
        bare = F.regexp_replace(x, "^0+(?=.)", "")
        fits = (F.length(bare) < 20) | ((F.length(bare) == 20) & (bare <= str(_U64)))
        return F.when(x.rlike(r"\A[0-9]+\z") & fits, bare.cast("decimal(20,0)"))

    return F.transform(texts, value)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1, by the first components that differ; missing ones are zero.  Null if a component up to
    there is malformed; what stands behind it doesn't matter."""
    zero = F.array(F.lit(0).cast("decimal(20,0)"))
    pa, pb = _parts(a), _parts(b)
    size = F.greatest(F.size(pa), F.size(pb))
    padded = lambda p: F.concat(p, F.flatten(F.array_repeat(zero, size - F.size(p))))
    order = F.zip_with(padded(pa), padded(pb), lambda x, y: F.when(x < y, -1).when(x > y, 1).when(x == y, 0))
    first = F.filter(order, lambda o: o.isNull() | (o != 0))
    return F.when(a.isNull() | b.isNull(), None).when(F.size(first) > 0, F.get(first, F.lit(0))).otherwise(0)


def _numbers(text: str) -> list[int | None]:
    parts = (text[1:] if text.startswith(".") else text).split(".") if text else []
    return [int(p) if re.fullmatch("[0-9]+", p, re.A) and int(p) <= _U64 else None for p in parts]


def compare_text(a: str, b: str) -> int | None:
    """The same for two texts."""
    for x, y in zip_longest(_numbers(a), _numbers(b), fillvalue=0):
        if x is None or y is None:
            return None
        if x != y:
            return 1 if x > y else -1
    return 0


_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}]|"', re.S)


def _object_end(data: bytes, start: int) -> int:
    """Past the closing brace of the object at start, by braces outside strings; -1 if it stays open."""
    depth = 0
    for m in _TOKEN.finditer(data, start):
        if m[0] == b"{":
            depth += 1
        elif m[0] == b"}":
            depth -= 1
            if not depth:
                return m.end()
        elif m[0] == b'"':
            return -1  # a string without end
    return -1


def _field(data: bytes, start: int, end: int, name: bytes) -> bytes | None:
    """The string of the first such field that has one, at any depth; none if that string is escaped."""
    found = re.compile(re.escape(name) + rb'[ \t\r\n]*:[ \t\r\n]*"([^"\\]*)(["\\])').search(data, start, end)
    return found[1] if found and found[2] == b'"' else None


def version_in(data: bytes, layout: Layout = DEFAULT) -> str | None:
    """The field's string in the first object after a marker that has it."""
    name = b'"' + layout.version_field.encode() + b'"'
    for marker in re.finditer(re.escape(layout.version_marker.encode()), data):
        start = data.find(b"{", marker.end())
        end = _object_end(data, start) if start >= 0 else -1
        if end >= 0 and (found := _field(data, start, end, name)) is not None:
            return found.decode("utf-8", "replace")
    return None


def version_in_file(stream, layout: Layout = DEFAULT) -> str | None:
    """The same over windows: a match is certain to be found if it spans no more than the tail."""
    tail = b""
    while True:
        block = stream.read(layout.scan_block)
        data = tail + block
        if (found := version_in(data, layout)) is not None:
            return found
        if not block:
            return None
        tail = data[-layout.scan_tail :]
