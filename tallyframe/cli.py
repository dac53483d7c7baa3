"""Command line: one folder cleans, two make an update, an archive and a folder apply one."""

from __future__ import annotations

import os
import sys
from collections import defaultdict
from dataclasses import dataclass

from tallyframe.functions.paths import is_zip_name
from tallyframe.schema import ManifestError

USAGE = """Usage:
  tallyframe <game-folder>
  tallyframe <old-folder> <new-folder> [out.zip]
  tallyframe <update.zip> <game-folder>

Options:
  -y  don't ask
  -v  verify MD5 digests as well
"""


@dataclass(frozen=True)
class Request:
    operation: str
    paths: tuple[str, ...]
    assume_yes: bool = False
    verify_md5: bool = False


class Problem(Exception):
    def __init__(self, text: str, usage: bool = False) -> None:
        super().__init__(text)
        self.usage = usage


def expand_home(path: str, env: dict | None = None) -> str:
    env = os.environ if env is None else env
    if path != "~" and not path.startswith(("~/", "~\\")):
        return path
    home = env.get("HOME") or env.get("USERPROFILE")
    if not home:
        raise Problem("cannot expand ~: HOME is not set")
    return home + path[1:]


def classify(path: str) -> str:
    if os.path.isdir(path):
        return "folder"
    if os.path.isfile(path):
        return "zip_input" if is_zip_name(path) else "invalid"
    if os.path.exists(path):
        return "invalid"
    return "zip_output" if is_zip_name(path) else "missing"


def parse(args: list[str]) -> Request:
    """The order of arguments doesn't matter, but that of two folders is kept."""
    yes = verify = False
    found: dict[str, list[str]] = defaultdict(list)
    for arg in args:
        if arg == "-y":
            yes = True
        elif arg == "-v":
            verify = True
        elif arg.startswith("-"):
            raise Problem(f"unknown option: {arg}", usage=True)
        elif not arg:
            raise Problem("empty argument", usage=True)
        else:
            path = expand_home(arg)
            found[classify(path)].append(path)
    if not found:
        raise Problem("no arguments given", usage=True)
    shape = {k: len(v) for k, v in found.items()}
    folders = found["folder"] if "folder" in shape else []
    if shape == {"folder": 1}:
        return Request("clean", (folders[0],), yes, verify)
    if shape == {"folder": 2}:
        return Request("make", tuple(folders), yes, verify)
    if shape == {"folder": 2, "zip_output": 1}:
        return Request("make", (*folders, found["zip_output"][0]), yes, verify)
    if shape == {"folder": 1, "zip_input": 1}:
        return Request("apply", (found["zip_input"][0], folders[0]), yes, verify)
    if shape == {"folder": 1, "zip_output": 1}:
        raise Problem(f"update archive not found: {found['zip_output'][0]}")
    if "missing" in shape:
        raise Problem(f"path not found: {found['missing'][0]}")
    if "invalid" in shape:
        raise Problem(f"neither a folder nor an archive: {found['invalid'][0]}")
    raise Problem("expected one folder, two folders, or a folder and an archive", usage=True)


def main(args: list[str] | None = None, spark=None) -> int:
    try:
        request = parse(sys.argv[1:] if args is None else args)
    except Problem as e:
        sys.stderr.write(f"Error: {e}\n" + (f"\n{USAGE}" if e.usage else ""))
        return 1
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from tallyframe.ops import Aborted, Engine, Reported

    engine = Engine(spark or SparkSession.builder.appName("tallyframe").getOrCreate(), assume_yes=request.assume_yes)
    try:
        if request.operation == "make":
            engine.make(*request.paths)
        else:
            getattr(engine, request.operation)(*request.paths, verify_md5=request.verify_md5)
    except (Aborted, Reported):
        return 1
    except (ManifestError, OSError, PySparkException) as e:
        sys.stderr.write(f"Error: {getattr(e, 'kind', None) or e}\n")
        return 1
    return 0
