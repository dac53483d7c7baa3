"""Manifests: newline-delimited JSON, read strictly.

Spark's own text and JSON readers are not used: they drop files whose names begin with an underscore,
split on bare carriage returns, and accept trailing text, repeated keys and negative sizes.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyframe.config import DEFAULT, Layout
from tallyframe.functions.paths import check_path
from tallyframe.plans.manifests import combine
from tallyframe.schema import ENTRY, ManifestError

_HEX = frozenset("0123456789abcdefABCDEF")
_BLANK = b" \t\r\n"
#: Bytes from which on manifests are read in parts, and bytes of such a part.
PART = 8 << 20
_PART_ROWS = T.StructType([*(T.StructField(f.name, f.dataType, f.name != "line_no") for f in ENTRY.fields), T.StructField("kind", T.StringType()), T.StructField("detail", T.StringType())])


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key is repeated")
    return out


def _not_a_number(text: str):
    raise ValueError(text)


_NUMBER = re.compile(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


def _size(value: object) -> int:
    """A whole number of 64 bits; text that spells one, and 5.0 for 5, will do."""
    if isinstance(value, str) and _NUMBER.fullmatch(value):
        value = float(value) if set(value) & set(".eE") else int(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if type(value) is not int or not 0 <= value < 1 << 64:
        raise ValueError("fileSize is not a size")
    return value


def parse_line(line: bytes) -> tuple[str, int, str]:
    try:
        row = json.loads(line.decode("utf-8"), object_pairs_hook=_unique, parse_constant=_not_a_number)
        path, md5, size = row["remoteName"], row["md5"], _size(row["fileSize"])
        path.encode()
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ManifestError("InvalidManifestJson", str(e)) from None
    if not isinstance(path, str) or not isinstance(md5, str):
        raise ManifestError("InvalidManifestJson", "a field is of another type")
    return path, size, md5


def _entries(lines: Iterable[tuple[int, bytes]], layout: Layout) -> Iterator[tuple[int, str, int, bytes]]:
    for line_no, line in lines:
        line = line.strip(_BLANK)
        if not line:
            continue
        path, size, md5 = parse_line(line)
        check_path(path, layout)
        if len(md5) != 32 or not _HEX.issuperset(md5):
            raise ManifestError("InvalidMd5", path)
        yield line_no, path, size, bytes.fromhex(md5)


def parse(data: bytes, layout: Layout = DEFAULT) -> Iterator[tuple[int, str, int, bytes]]:
    """(line_no, path, size, md5).  The first bad line is the error; within a line, JSON comes before
    the path, the path before the digest, and the digest before repeated paths."""
    seen: set[str] = set()
    for entry in _entries(enumerate(data.split(b"\n")), layout):
        if entry[1] in seen:
            raise ManifestError("DuplicateManifestPath", entry[1])
        seen.add(entry[1])
        yield entry
    if not seen:
        raise ManifestError("EmptyManifest")


def verdict(data: bytes) -> str:
    """ok, or the kind of the first error."""
    try:
        for _ in parse(data):
            pass
    except ManifestError as e:
        return e.kind
    return "ok"


def verdicts(rows: DataFrame) -> DataFrame:
    """rows (doc_id, data), manifests in memory -> (doc_id, verdict)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([verdict(d) for d in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "verdict"])

    return rows.mapInArrow(run, "doc_id long, verdict string")


def checked_size(path: str, limit: int) -> int:
    """A regular file's size, refused over the limit."""
    if not os.path.exists(path):
        raise ManifestError("FileNotFound", path)
    if not os.path.isfile(path):
        raise ManifestError("NotAFile", path)
    size = os.path.getsize(path)
    if size > limit:
        raise ManifestError("FileTooLarge", path)
    return size


def read_bytes(path: str, limit: int) -> bytes:
    """A regular file's content, refused over the limit."""
    size = checked_size(path, limit)
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > limit:
        raise ManifestError("FileTooLarge", path)
    if len(data) < size:
        raise ManifestError("UnexpectedEof", path)
    return data


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(0)
        self.paths = paths


class _Part(InputPartition):
    """Whole lines of one file; line_no is the number of the first.  Without bytes: there are no entries at all."""

    def __init__(self, path: str, start: int, size: int, line_no: int) -> None:
        super().__init__(0)
        self.path, self.start, self.size, self.line_no = path, start, size, line_no

    def lines(self) -> Iterator[tuple[int, bytes]]:
        with open(self.path, "rb") as f:
            f.seek(self.start)
            left, line_no = self.size, self.line_no
            while left:
                line = f.readline(left)
                if not line:
                    raise ManifestError("UnexpectedEof", self.path)
                yield line_no, line
                left, line_no = left - len(line), line_no + 1


def _parts(paths: list[str], size: int) -> list[_Part]:
    """The files as one manifest, a line break after each, in parts of so many bytes, up to a block, and the rest of a line."""
    parts, line_no, blank = [], 0, True
    for path in paths:
        at, start, first = 0, 0, line_no
        with open(path, "rb") as f:
            while data := f.read(min(size, DEFAULT.block)):
                blank = blank and not data.strip(_BLANK)
                line_no += data.count(b"\n")
                end = at + data.rfind(b"\n") + 1
                if end > at and end - start >= size:
                    parts.append(_Part(path, start, end - start, first))
                    start, first = end, line_no
                at += len(data)
        if at > start:
            parts.append(_Part(path, start, at - start, first))
        line_no += 1
    return [_Part(paths[0], 0, 0, 0)] if blank else parts


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.limit, self.in_parts = int(options.get("limit", DEFAULT.manifest_limit)), int(options.get("parts", 0))

    def partitions(self):
        # One for small manifests: a path repeated in another of the files is an error.
        return _parts(self.paths, self.in_parts) if self.in_parts else [_Files(self.paths)]

    def read(self, partition):
        from decimal import Decimal

        if self.in_parts:
            line_no = partition.line_no

            def lines():
                nonlocal line_no
                for line_no, line in partition.lines():
                    yield line_no, line

            try:
                if not partition.size:
                    raise ManifestError("EmptyManifest")
                for n, path, size, md5 in _entries(lines(), DEFAULT):
                    yield n, path, Decimal(size), md5, None, None
            except ManifestError as e:
                yield line_no, None, None, None, e.kind, e.detail
            return
        data = b"\n".join(read_bytes(p, self.limit) for p in partition.paths)
        for line_no, path, size, md5 in parse(data):
            yield line_no, path, Decimal(size), md5


class ManifestSource(DataSource):
    """format("manifest"): options path, or paths as a JSON list that is read as one manifest, and limit in bytes.
    With parts, a number of bytes, the manifest is read in parts, and each adds its first error as a row; see load."""

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def schema(self):
        return _PART_ROWS if "parts" in self.options else ENTRY

    def reader(self, schema):
        return _Reader(dict(self.options))


def load(spark: SparkSession, files: list[str], layout: Layout = DEFAULT, at_once: bool = False) -> DataFrame:
    """The files as one manifest.  Larger ones, and those to be checked at once, are read in parts, after a first
    pass that finds the first bad line of all, repeated paths among them."""
    spark.dataSource.register(ManifestSource)
    source = spark.read.format("manifest").option("paths", json.dumps(files)).option("limit", str(layout.manifest_limit))
    if not at_once and sum(os.path.getsize(p) for p in files if os.path.isfile(p)) <= PART:
        return source.load()
    for p in files:
        checked_size(p, layout.manifest_limit)
    rows = source.option("parts", str(PART)).load()
    again = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) > 1
    kind = F.coalesce("kind", F.when(again, "DuplicateManifestPath"))
    wrong = rows.select("line_no", kind.alias("kind"), F.coalesce("detail", "path").alias("detail")).where("kind IS NOT NULL").orderBy("line_no").head(1)
    if wrong:
        raise ManifestError(wrong[0].kind, wrong[0].detail)
    return rows.where("kind IS NULL").select(*ENTRY.names)


def load_main(spark: SparkSession, game: str, layout: Layout = DEFAULT) -> DataFrame:
    return load(spark, [os.path.join(game, layout.root_manifest)], layout)


def audio_files(game: str, layout: Layout = DEFAULT) -> list[str]:
    with os.scandir(game) as found:
        return sorted(e.path for e in found if e.is_file(follow_symlinks=False) and e.name.startswith(layout.audio_prefix) and e.name.endswith(layout.manifest_suffix))


def load_audio(spark: SparkSession, game: str, layout: Layout = DEFAULT) -> DataFrame | None:
    files = audio_files(game, layout)
    return load(spark, files, layout) if files else None


def load_all(spark: SparkSession, game: str, layout: Layout = DEFAULT) -> DataFrame:
    """The main manifest and what audio manifests add; one of the two may be missing."""
    audio = load_audio(spark, game, layout)
    if not os.path.exists(os.path.join(game, layout.root_manifest)):
        if audio is None:
            raise ManifestError("FileNotFound", layout.root_manifest)
        return audio
    main = load_main(spark, game, layout)
    return main if audio is None else combine(main, audio)


def manifest_digest(game: str, layout: Layout = DEFAULT) -> str | None:
    """SHA-256 of the main manifest as it is, or None if it can't be read."""
    path = os.path.join(game, layout.root_manifest)
    try:
        checked_size(path, layout.manifest_limit)
    except ManifestError:
        return None
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
