"""ZIP archives: the central directory as rows, and members with every stated fact checked."""

from __future__ import annotations

import hashlib
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyframe.config import DEFAULT, Layout
from tallyframe.functions.paths import check_path
from tallyframe.functions.versions import version_in
from tallyframe.schema import MEMBER, ManifestError

STORE, DEFLATE = 0, 8
_OPEN = 0xFFFFFFFF


_RECORD = struct.Struct("<4s6H3I5H2I")


def _wide(extra: bytes, size: int, packed: int, offset: int) -> tuple[int, int, int]:
    """The facts that a record leaves to its extra field of 64 bits."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if n > len(extra) - at - 4:
            raise ManifestError("BadZip", "corrupt extra field")
        if kind == 1:
            data, facts = extra[at + 4 : at + 4 + n], []
            for fact in (size, packed, offset):
                if fact == _OPEN:
                    if len(data) < 8:
                        raise ManifestError("BadZip", "corrupt zip64 extra field")
                    fact, data = int.from_bytes(data[:8], "little"), data[8:]
                facts.append(fact)
            size, packed, offset = facts
        at += 4 + n
    return size, packed, offset


def _records(path: str) -> Iterator[tuple]:
    """(name, method, crc, packed, size, offset) of each record of the central directory, read as a stream."""
    with open(path, "rb") as f:
        try:
            end = zipfile._EndRecData(f)
        except OSError:
            end = None
        if not end:
            raise ManifestError("BadZip", "File is not a zip file")
        left, start, at = end[5], end[6], end[9]
        moved = at - left - start - (76 if end[0] == b"PK\x06\x06" else 0)  # what stands before the archive
        if start + moved < 0:
            raise ManifestError("BadZip", "bad offset of the central directory")
        f.seek(start + moved)
        while left > 0:
            head = f.read(_RECORD.size)
            if len(head) < _RECORD.size:
                raise ManifestError("BadZip", "truncated central directory")
            mark, _, _, flags, method, _, _, crc, packed, size, n, n_extra, n_note, _, _, _, offset = _RECORD.unpack(head)
            if mark != b"PK\x01\x02":
                raise ManifestError("BadZip", "bad record in the central directory")
            tail = f.read(n + n_extra + n_note)
            if len(tail) < n + n_extra + n_note:
                raise ManifestError("BadZip", "truncated central directory")
            if n_extra:
                size, packed, offset = _wide(tail[n : n + n_extra], size, packed, offset)
            try:
                name = tail[:n].decode("utf-8" if flags & 0x800 else "cp437")
            except UnicodeDecodeError as e:
                raise ManifestError("BadZip", str(e)) from None
            yield name, method, crc, packed, size, offset + moved
            left -= _RECORD.size + len(tail)


def members(path: str, layout: Layout = DEFAULT) -> Iterator[tuple]:
    """MEMBER rows in archive order; folder records are checked and skipped."""
    seen: set[str] = set()
    for ordinal, (name, method, crc, packed, size, offset) in enumerate(_records(path)):
        if name.endswith("/"):
            if size or crc:
                raise ManifestError("InvalidZipDirectory", name)
            check_path(name[:-1], layout)
            continue
        check_path(name, layout)
        if name in seen:
            raise ManifestError("DuplicateZipPath", name)
        seen.add(name)
        yield ordinal, name, method, crc, packed, size, offset


def _data_offset(f, member: tuple) -> int:
    """Past the local header, whose facts must be those of the central directory."""
    _, name, method, crc, packed, size, offset = member
    f.seek(offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ManifestError("BadLocalHeader", name)
    local_method, = struct.unpack_from("<H", head, 8)
    local_crc, local_packed, local_size, name_len, extra_len = struct.unpack_from("<IIIHH", head, 14)
    raw = f.read(name_len)
    flags, = struct.unpack_from("<H", head, 6)
    same_name = raw == name.encode("utf-8") or not flags & 0x800 and raw.decode("cp437") == name
    open_or = lambda a, b: a in (0, _OPEN) or a == b
    if not same_name or local_method != method or local_crc not in (0, crc) or not open_or(local_packed, packed) or not open_or(local_size, size):
        raise ManifestError("LocalHeaderMismatch", name)
    return offset + 30 + name_len + extra_len


def content(f, member: tuple, block: int = DEFAULT.block) -> Iterator[bytes]:
    """The member in blocks; an error if method, sizes, checksum or end are not as stated."""
    _, name, method, crc, packed, size, _ = member
    if method not in (STORE, DEFLATE):
        raise ManifestError("UnsupportedCompression", name)
    f.seek(_data_offset(f, member))
    inflate = zlib.decompressobj(-15) if method == DEFLATE else None
    left, total, check = packed, 0, 0
    while left:
        part = f.read(min(block, left))
        if not part:
            raise ManifestError("UnexpectedEof", name)
        left -= len(part)
        todo = part
        while True:
            try:
                out = inflate.decompress(todo, block) if inflate else todo
            except zlib.error as e:
                raise ManifestError("BadDeflate", f"{name}: {e}") from None
            total += len(out)
            check = zlib.crc32(out, check)
            if total > size:
                raise ManifestError("SizeMismatch", name)
            if out:
                yield out
            todo = inflate.unconsumed_tail if inflate else b""
            if not todo:
                break
        if inflate and inflate.eof and (left or inflate.unused_data):
            raise ManifestError("TrailingData", name)
    if inflate:
        while not inflate.eof and (out := inflate.decompress(b"", block)):
            total += len(out)
            check = zlib.crc32(out, check)
            yield out
        if not inflate.eof:
            raise ManifestError("UnexpectedEof", name)
    if total != size:
        raise ManifestError("SizeMismatch", name)
    if check != crc:
        raise ManifestError("CrcMismatch", name)


def read_member(path: str, member: tuple, limit: int) -> bytes:
    if member[5] > limit:
        raise ManifestError("FileTooLarge", member[1])
    with open(path, "rb") as f:
        return b"".join(content(f, member))


def find(path: str, name: str) -> tuple | None:
    return next((m for m in members(path) if m[1] == name), None)


def package_version(path: str, layout: Layout = DEFAULT) -> str | None:
    """From the first asset, in the layout's order, that is within the limit and names a version."""
    by_name = {m[1]: m for m in members(path, layout) if m[1] in layout.version_assets}
    for name in layout.version_assets:
        m = by_name.get(name)
        if m and m[5] <= layout.asset_limit and (found := version_in(read_member(path, m, layout.asset_limit), layout)) is not None:
            return found
    return None


def member_digests(found: DataFrame, path: str) -> DataFrame:
    """found, MEMBER rows of the archive at path -> (path, md5, n_bytes) of the members' contents, every
    stated fact checked; read in parallel and in blocks."""

    def run(batches):
        with open(path, "rb") as f:
            for batch in batches:
                rows = []
                for member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    digest, n = hashlib.md5(), 0
                    for part in content(f, member):
                        digest.update(part)
                        n += len(part)
                    rows.append((member[1], digest.digest(), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["path", "md5", "n_bytes"])

    return found.select(*MEMBER.names).mapInArrow(run, "path string, md5 binary, n_bytes long")


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        yield from members(self.path)


class ArchiveSource(DataSource):
    """format("zip_central"): option path, the archive."""

    @classmethod
    def name(cls) -> str:
        return "zip_central"

    def schema(self):
        return MEMBER

    def reader(self, schema):
        return _Reader(os.fspath(self.options["path"]))


def archive(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("zip_central").option("path", path).load()
