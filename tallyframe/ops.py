"""The three operations: clean an install, make an update, apply an update.

Each plans with DataFrames, says what it would do, asks, and only then changes files.  A plan that
decides about deletion is fixed before anything is extracted.
"""

from __future__ import annotations

import hashlib
import os
import sys
import tempfile
from dataclasses import dataclass, field
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.config import DEFAULT, Layout
from tallyframe.functions.sizes import bytes_text
from tallyframe.functions.versions import compare_text, split_text, version_in_file
from tallyframe.plans import manifests as plans
from tallyframe.progress import Progress, followed
from tallyframe.schema import ManifestError
from tallyframe.shared import fixed, local_folder
from tallyframe.sinks.files import delete_files, extract_archive, write_archive
from tallyframe.sources import archive as zips
from tallyframe.sources import manifest as sources
from tallyframe.sources.tree import disk_state, file_md5, hashed, tree


class Aborted(Exception):
    """The answer was no."""


class Reported(Exception):
    """What is wrong has been said already."""


def ask(stream: TextIO, out: TextIO, assume_yes: bool) -> bool:
    """Only y or Y, after blanks, is a yes; the end of input or an empty line is a no."""
    if assume_yes:
        return True
    out.write("\ncontinue? [y/N] ")
    out.flush()
    while (c := stream.read(1)) in (" ", "\t", "\r"):
        pass
    return c in ("y", "Y")


@dataclass
class Game:
    path: str
    manifest: DataFrame
    version: str
    prefix: str
    number: str


@dataclass
class Engine:
    spark: SparkSession
    layout: Layout = DEFAULT
    out: TextIO = field(default_factory=lambda: sys.stdout)
    stdin: TextIO = field(default_factory=lambda: sys.stdin)
    assume_yes: bool = False

    # Reading

    def detect_version(self, game: str) -> str | None:
        for name in self.layout.version_assets:
            path = os.path.join(game, name)
            if os.path.isfile(path):
                with open(path, "rb") as f:
                    if (found := version_in_file(f, self.layout)) is not None:
                        return found
        return None

    def load_game(self, path: str) -> Game:
        version = self.detect_version(path)
        if version is None:
            raise ManifestError("VersionNotFound", path)
        parts = split_text(version)
        if parts is None or compare_text(parts[1], parts[1]) is None:
            raise ManifestError("InvalidVersion", version)
        return Game(path, sources.load_main(self.spark, path, self.layout), version, *parts)

    def stale_plan(self, game: str, manifest: DataFrame) -> DataFrame:
        return plans.stale(tree(self.spark, game), manifest, self.layout)

    def verified(self, game: str, manifest: DataFrame, hashes: bool) -> DataFrame:
        """Sizes first; contents are only read where the size agrees, and digests are fixed once read."""
        disk = disk_state(tree(self.spark, game))
        if hashes:
            to_read = plans.sizes_agree(manifest, disk)
            total = plans.total_size(manifest.join(to_read.select("path"), "path", "left_semi")).first()
            with followed(self.spark.sparkContext, Progress(self.out, "Verify", int(total.total), total.n, True)) as done, fixed(hashed(to_read, game, 0, *done)) as sums:
                disk = disk.join(sums, "path", "left")
        return plans.verify(manifest, disk, hashes)

    # Operations

    def clean(self, game: str, verify_md5: bool = False) -> int:
        """Returns the number of files removed.  Problems found afterwards are told, not raised."""
        manifest = sources.load_all(self.spark, game, self.layout).persist()
        try:
            return self._clean(game, manifest, verify_md5)
        finally:
            manifest.unpersist()

    def _clean(self, game: str, manifest: DataFrame, verify_md5: bool) -> int:
        n = 0
        with fixed(self.stale_plan(game, manifest)) as plan:
            total = plans.total_size(plan).first()
            if n := total.n:
                self._say(f"Clean {self.detect_version(game) or 'game'}:\n    Game: {game}\n\nStale files to remove: {n} ({bytes_text(int(total.total))})")
                self._confirm()
                self._delete(plan, game, total)
            else:
                self._say("No files to remove.")
        for hashes in (False, True) if verify_md5 else (False,):
            self._report(self.verified(game, manifest, hashes))
        self._say("\nComplete!")
        return n

    def make(self, left: str, right: str, out_path: str | None = None) -> str:
        a, b = self.load_game(left), self.load_game(right)
        if a.prefix != b.prefix:
            self._say(f"versions of different clients: {a.version} and {b.version}")
            raise Reported
        order = compare_text(a.number, b.number)
        if order is None:
            raise ManifestError("InvalidVersion", f"{a.number}, {b.number}")
        if order == 0:
            raise ManifestError("AmbiguousVersions", a.number)
        old, new = (a, b) if order < 0 else (b, a)
        out_path = out_path or self.layout.archive_name.format(old=old.number, new=new.number)
        main = os.path.join(new.path, self.layout.root_manifest)
        data = sources.checked_size(main, self.layout.manifest_limit), file_md5(main)
        changed = plans.changes(old.manifest, new.manifest)
        if plans.lookup(new.manifest, self.layout.root_manifest).head(1):
            raise ManifestError("DuplicateZipPath", self.layout.root_manifest)
        packed = plans.archive_sources(data, changed, self.layout)
        total = plans.total_size(packed).first()
        self._say(f"Create update {old.version} to {new.version}:\n    Old: {old.path}\n    New: {new.path}\n    Output: {out_path}\n\nFiles to package: {total.n} ({bytes_text(int(total.total))})")
        self._confirm()
        write_archive(packed, new.path, out_path, Progress(self.out, "Package", int(total.total), total.n, True))
        self._say("\nComplete!")
        return out_path

    def apply(self, zip_path: str, game: str, verify_md5: bool = False) -> bool:
        """Returns whether anything was to do.  Problems found afterwards are an error."""
        head = zips.find(zip_path, self.layout.root_manifest)
        if head is None:
            raise ManifestError("PackageMissingManifest", zip_path)
        if head[5] > self.layout.manifest_limit:
            raise ManifestError("FileTooLarge", head[1])
        with tempfile.TemporaryDirectory(prefix="tallyframe-", dir=local_folder(self.spark) or os.path.dirname(os.path.abspath(zip_path))) as folder:
            main, digest = os.path.join(folder, self.layout.root_manifest), hashlib.sha256()
            with open(zip_path, "rb") as f, open(main, "wb") as out:
                for part in zips.content(f, head):
                    out.write(part)
                    digest.update(part)
            os.chmod(folder, 0o755)  # executors may be another user's
            new = sources.load(self.spark, [main], self.layout, True)
            audio = sources.load_audio(self.spark, game, self.layout)
            clean_manifest = (new if audio is None else plans.combine(new, audio)).persist()
            try:
                return self._apply(zip_path, game, verify_md5, digest.hexdigest(), new, clean_manifest)
            finally:
                clean_manifest.unpersist()

    def _apply(self, zip_path: str, game: str, verify_md5: bool, digest: str, new: DataFrame, clean_manifest: DataFrame) -> bool:
        members = zips.archive(self.spark, zip_path)
        wrong = plans.package_status(members.withColumn("size", F.col("uncompressed_size")), new, self.layout).where("status <> 'ok'").orderBy("ordinal").head(1)
        if wrong:
            raise ManifestError(wrong[0].status, wrong[0].path)
        version, current = zips.package_version(zip_path, self.layout), self.detect_version(game)
        if version is not None and self._applied(current, version, sources.manifest_digest(game, self.layout), digest):
            self._say("Already up to date.")
            return False
        with fixed(self.stale_plan(game, clean_manifest)) as plan:
            payload, extra = plans.total_size(members, "uncompressed_size").first(), plans.total_size(plan).first()
            self._say(f"Update {current or 'unknown'} to {version or 'unknown'}:\n    Update: {zip_path}\n    Game: {game}\n\n"
                      f"New files to update: {payload.n} ({bytes_text(int(payload.total))})\nStale files to remove: {extra.n} ({bytes_text(int(extra.total))})")
            self._confirm()
            with followed(self.spark.sparkContext, Progress(self.out, "Extract", int(payload.total), payload.n, True)) as done:
                extract_archive(members.repartition(self.spark.sparkContext.defaultParallelism), zip_path, game, *done)
            if extra.n:
                self._delete(plan, game, extra)
        for hashes in (False, True) if verify_md5 else (False,):
            bad = plans.first_failure(self.verified(game, clean_manifest, hashes)).head(1)
            if bad:
                self._say(_line(bad[0]))
                raise Reported
        self._say("\nComplete!")
        return True

    def _applied(self, current: str | None, version: str, here: str | None, new: str) -> bool:
        return self.spark.range(1).select(plans.already_applied(*map(F.lit, (current, version, here, new)))).first()[0]

    def _delete(self, plan: DataFrame, game: str, total) -> None:
        with followed(self.spark.sparkContext, Progress(self.out, "Remove", int(total.total), total.n)) as done:
            delete_files(plan, game, *done)

    # Saying and asking

    def _say(self, text: str) -> None:
        self.out.write(text + "\n")
        self.out.flush()

    def _confirm(self) -> None:
        if not ask(self.stdin, self.out, self.assume_yes):
            raise Aborted

    def _report(self, verified: DataFrame) -> int:
        n = 0
        for row in plans.failures(verified).orderBy("line_no").toLocalIterator():
            self._say(_line(row))
            n += 1
        if n:
            self._say(f"{n} files have problems")
        return n


def _line(row) -> str:
    sizes = f" (expected {row.size}, found {row.actual_size})" if row.status == "size_mismatch" else ""
    return f"{row.status.replace('_', ' ')}: {row.path}{sizes}"
