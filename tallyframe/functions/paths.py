"""Rules about paths, as columns and, for readers and writers, as plain functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.config import DEFAULT, Layout
from tallyframe.schema import ManifestError


def verdict(path: Column, layout: Layout = DEFAULT) -> Column:
    """'ok', 'UnsafePath' or 'PathTooLongForZip'; lengths are of bytes, and the order decides."""
    back = F.lit("\\")
    rooted = (path == "") | path.startswith("/") | F.startswith(path, back) | path.rlike(r"\A[\x00-\x7F]:") | F.contains(path, back) | F.contains(path, F.lit("\0"))
    odd = F.exists(F.split(path, "/", -1), lambda part: part.isin("", ".", ".."))
    return F.when(rooted, "UnsafePath").when(F.octet_length(path) > layout.path_limit, "PathTooLongForZip").when(odd, "UnsafePath").otherwise("ok")


def check_path(path: str, layout: Layout = DEFAULT) -> str:
    raw = path.encode("utf-8", "surrogatepass")
    if not raw or raw[:1] in b"/\\" or raw[1:2] == b":" or b"\\" in raw or b"\0" in raw:
        raise ManifestError("UnsafePath", path)
    if len(raw) > layout.path_limit:
        raise ManifestError("PathTooLongForZip", path[:80])
    if any(part in ("", ".", "..") for part in path.split("/")):
        raise ManifestError("UnsafePath", path)
    return path


def is_protected(path: Column, layout: Layout = DEFAULT) -> Column:
    """Manifests in the root are never stale, whatever stands before the suffix."""
    return ~F.contains(path, F.lit("/")) & ((path == layout.root_manifest) | path.endswith(layout.manifest_suffix))


def is_audio_manifest(name: Column, layout: Layout = DEFAULT) -> Column:
    return name.startswith(layout.audio_prefix) & name.endswith(layout.manifest_suffix)


def may_be_stale(path: Column, layout: Layout = DEFAULT) -> Column:
    """The marker may stand anywhere in the path, in any ASCII case."""
    return path.rlike(f"(?i){layout.stale_marker}")


def first_part(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 1, F.substring_index(path, "/", 1))


def is_zip_name(path: str) -> bool:
    return path[-4:].lower() == ".zip"
