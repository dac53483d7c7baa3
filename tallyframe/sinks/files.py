"""What changes files: writing an archive, extracting one, deleting.  Nothing here asks; callers
confirm first.  Paths are checked again where they are used.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import nullcontext
from typing import BinaryIO

from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.config import DEFAULT
from tallyframe.functions.paths import check_path
from tallyframe.plans.manifests import first_duplicate
from tallyframe.progress import Progress, followed
from tallyframe.schema import ManifestError
from tallyframe.shared import fixed
from tallyframe.sources.archive import content

#: Bytes of a member over which its header has room for sizes of 64 bits.
_BIG = int(zipfile.ZIP64_LIMIT / 1.05)


def _blocks(row, root: str) -> Iterator[bytes]:
    if row.inline_bytes is not None:
        yield bytes(row.inline_bytes)
        return
    with open(os.path.join(root, row.path), "rb") as f:
        while part := f.read(DEFAULT.block):
            yield part


def _info(path: str, size: int, crc: int = 0) -> zipfile.ZipInfo:
    info = zipfile.ZipInfo(path, (1980, 0, 0, 0, 0, 0))
    info.file_size = info.compress_size = size
    info.CRC, info.external_attr = crc, 0o600 << 16
    return info


def _central(info: zipfile.ZipInfo, name: bytes, flags: int, offset: int) -> bytes:
    """A member's record in the central directory."""
    extra, size = b"", info.file_size
    if size > zipfile.ZIP64_LIMIT:
        extra += struct.pack("<QQ", size, size)
        size = 0xFFFFFFFF
    if offset > zipfile.ZIP64_LIMIT:
        extra += struct.pack("<Q", offset)
        offset = 0xFFFFFFFF
    if extra:
        extra = struct.pack("<HH", 1, len(extra)) + extra
    version = max(45 if extra else 0, info.extract_version)
    return struct.pack("<4s4B4HL2L5H2L", b"PK\1\2", version, info.create_system, version, 0, flags, 0, 0, 0, info.CRC, size, size, len(name), len(extra), 0, 0, 0, info.external_attr, offset) + name + extra


def _end(count: int, size: int, offset: int) -> bytes:
    """What closes an archive whose central directory has so many records and bytes and stands there."""
    out = b""
    if count > 0xFFFF or size > zipfile.ZIP64_LIMIT or offset > zipfile.ZIP64_LIMIT:
        out = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, offset) + struct.pack("<4sLQL", b"PK\6\7", 0, offset + size, 1)
    count = min(count, 0xFFFF)
    return out + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, count, count, min(size, 0xFFFFFFFF), min(offset, 0xFFFFFFFF), 0)


def _store(f: BinaryIO, row, root: str, moved: Accumulator | None) -> bytes:
    """Writes a member where f stands and returns its record in the central directory."""
    name = check_path(row.path).encode()
    flags = 0 if row.path.isascii() else 0x800
    offset, size, crc, md5 = f.tell(), 0, 0, hashlib.md5()
    big = row.size > _BIG
    f.write(_info(row.path, row.size).FileHeader(big))
    for part in _blocks(row, root):
        size, crc = size + len(part), zlib.crc32(part, crc)
        if size > row.size:  # the next member's place
            raise ManifestError("SizeMismatch", row.path)
        f.write(part)
        md5.update(part)
        if moved is not None:
            moved.add(len(part))
    if size != row.size:
        raise ManifestError("SizeMismatch", row.path)
    if row.md5 is not None and md5.digest() != bytes(row.md5):
        raise ManifestError("HashMismatch", row.path)
    info = _info(row.path, size, crc)
    f.seek(offset)
    f.write(info.FileHeader(big))
    f.seek(size, os.SEEK_CUR)
    return _central(info, name, flags, offset)


def write_archive(sources: DataFrame, root: str, out: str, progress: Progress | None = None) -> int:
    """Stores the sources in their order, uncompressed, and returns their number.

    Sizes are known, so offsets are too: each task writes a range of members into its place, and its share of
    the central directory beside the archive, which is put together at the end.  The archive appears under its
    name only when it is whole, and never in place of another file.  Every executor must see its folder."""
    spark = sources.sparkSession
    out = os.path.abspath(out)
    tmp = f"{out}.tmp"
    for path in (out, tmp):
        if os.path.lexists(path):
            raise ManifestError("PathAlreadyExists", path)
    ranges = 4 * spark.sparkContext.defaultParallelism
    with fixed(sources.repartitionByRange(ranges, "ordinal").sortWithinPartitions("ordinal")) as members:
        twice = first_duplicate(members.select(F.col("ordinal").alias("line_no"), "path")).head(1)
        if twice:
            raise ManifestError("DuplicateZipPath", twice[0].path)
        room = F.col("size") + 30 + F.octet_length("path") + F.when(F.col("size") > _BIG, 20).otherwise(0)
        sums = members.select(F.spark_partition_id().alias("part"), room.alias("room")).groupBy("part").agg(F.sum("room").alias("room"), F.count("*").alias("n")).collect()
        starts, at = {}, 0
        for r in sorted(sums, key=lambda r: r.part):
            starts[r.part], at = at, at + r.room
        counts = {r.part: r.n for r in sums}

        def run(number: int, rows: Iterator) -> Iterator[tuple[int, str, str]]:
            if number not in starts:
                return
            share = f"{tmp}.{number}"
            own = f"{share}-{uuid.uuid4().hex}"
            with open(tmp, "r+b") as f, open(own, "wb") as directory:
                f.seek(starts[number])
                for row in rows:
                    try:
                        directory.write(_store(f, row, root, moved))
                    except ManifestError as e:
                        yield row.ordinal, e.kind, e.detail
                        break
                    if done is not None:
                        done.add(1)
            os.replace(own, share)

        with open(tmp, "xb") as f:
            try:
                with followed(spark.sparkContext, progress) if progress else nullcontext((None, None)) as (moved, done):
                    wrong = members.rdd.mapPartitionsWithIndex(run).collect()
                    if wrong:
                        raise ManifestError(*min(wrong)[1:])
                f.seek(at)
                for number in sorted(starts):
                    with open(f"{tmp}.{number}", "rb") as share:
                        shutil.copyfileobj(share, f, DEFAULT.block)
                f.write(_end(sum(counts.values()), f.tell() - at, at))
                f.flush()
                os.link(tmp, out)  # fails if the name is taken meanwhile
            finally:
                folder, name = os.path.split(tmp)
                for found in os.listdir(folder):
                    if found.startswith(f"{name}.") or found == name:
                        os.unlink(os.path.join(folder, found))
    return sum(counts.values())


def extract_archive(members: DataFrame, archive: str, root: str, moved: Accumulator | None = None, done: Accumulator | None = None) -> None:
    """Writes each member under root, in parallel, replacing what is there.  There is no way back: a
    failure leaves what was written so far.  What is written adds to the accumulators."""

    def run(rows):
        with open(archive, "rb") as f:
            for row in rows:
                target = os.path.join(root, check_path(row.path))
                os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
                with open(target, "wb") as out:
                    for part in content(f, tuple(row)):
                        out.write(part)
                        if moved is not None:
                            moved.add(len(part))
                if done is not None:
                    done.add(1)

    members.foreachPartition(run)


def delete_files(plan: DataFrame, root: str, moved: Accumulator | None = None, done: Accumulator | None = None) -> None:
    """Deletes the plan's files by their raw paths; folders stay.  What is deleted adds to the accumulators."""

    def run(rows):
        for row in rows:
            check_path(row.path)
            os.unlink(os.path.join(root, row.raw_path))
            if moved is not None:
                moved.add(row.size)
            if done is not None:
                done.add(1)

    plan.foreachPartition(run)
