import hashlib
import io
import json
import os
import struct
import zipfile

import pytest

from tallyframe import cli
from tallyframe.operators import files
from tallyframe.ops import Aborted, Engine, Reported
from tallyframe.plans import manifests as plans
from tallyframe.schema import ManifestError
from tallyframe.sinks import files as sinks
from tallyframe.sources import archive as zips
from tallyframe.sources import manifest as sources
from tallyframe.sources.tree import hashed, tree

DATA = "Game_Data/StreamingAssets/"
ASSET = "ZenlessZoneZero_Data/resources.assets"


def line(path, data):
    return json.dumps({"remoteName": path, "md5": hashlib.md5(data).hexdigest(), "fileSize": len(data), "more": 1})


def install(root, version, files, audio=()):
    files = dict(files) | {ASSET: b"\0app_version{\"DispatchVersion\":\"%s\"}" % version.encode()}
    for path, data in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    (root / "pkg_version").write_text("\r\n".join(line(p, d) for p, d in files.items() if p not in dict(audio)) + "\n\n")
    if audio:
        (root / "Audio_En_pkg_version").write_text("\n".join(line(p, d) for p, d in audio))
        for p, d in audio:
            (root / p).parent.mkdir(parents=True, exist_ok=True)
            (root / p).write_bytes(d)
    return str(root)


def listing(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs}


def engine(spark, answer="", yes=True):
    return Engine(spark, out=io.StringIO(), stdin=io.StringIO(answer), assume_yes=yes)


OLD = {DATA + "a": b"one", DATA + "b": b"two", DATA + "gone": b"x", "exe": b"old"}
NEW = {DATA + "a": b"one", DATA + "b": b"TWO!", DATA + "sub/c": b"three" * 1000, "exe": b"new"}


@pytest.fixture
def games(tmp_path):
    audio = [(DATA + "Audio/v", b"sound")]
    return install(tmp_path / "old", "Win1.9", OLD, audio), install(tmp_path / "new", "Win1.10", NEW)


def test_make_then_apply_turns_old_into_new(spark, games, tmp_path):
    old, new = games
    out = str(tmp_path / "u.zip")
    e = engine(spark)
    assert e.make(new, old, out) == out  # the order of the folders doesn't matter
    with zipfile.ZipFile(out) as z:
        assert z.namelist()[0] == "pkg_version" and set(z.namelist()) == {"pkg_version", DATA + "b", DATA + "sub/c", "exe", ASSET}
        assert all(i.compress_type == 0 for i in z.infolist()) and z.testzip() is None
    with pytest.raises(ManifestError, match="PathAlreadyExists"):
        e.make(old, new, out)
    assert e.apply(out, old, verify_md5=True)
    want = listing(new) | {"Audio_En_pkg_version": listing(old)["Audio_En_pkg_version"], DATA + "Audio/v": b"sound"}
    assert listing(old) == want
    assert e.apply(out, old) is False and "Already up to date" in e.out.getvalue()
    assert "1.9" in e.out.getvalue() and not os.path.exists(out + ".tmp")


def test_clean_removes_only_stale_files(spark, games):
    old, _ = games
    extra = [DATA + "_hidden", DATA + ".dot", "x/sTREAMINGassets.txt", DATA + "pkg_version"]
    stay = ["My_pkg_version", "other/file"]
    for p in extra + stay:
        os.makedirs(os.path.dirname(os.path.join(old, p)) or old, exist_ok=True)
        open(os.path.join(old, p), "wb").write(b"1")
    os.symlink("a", os.path.join(old, DATA + "link"))
    with pytest.raises(Aborted):
        engine(spark, " \tn", yes=False).clean(old)
    assert all(p in listing(old) for p in extra)
    e = engine(spark, " \ty", yes=False)
    assert e.clean(old, verify_md5=True) == 4
    left = listing(old)
    assert not any(p in left for p in extra) and all(p in left for p in [*stay, DATA + "link", DATA + "Audio/v"])
    assert engine(spark).clean(old) == 0


def test_clean_tells_all_problems_and_apply_stops_at_the_first(spark, games, tmp_path):
    old, new = games
    os.remove(os.path.join(old, DATA + "a"))
    os.mkdir(os.path.join(old, DATA + "a"))
    os.remove(os.path.join(old, DATA + "gone"))
    open(os.path.join(old, DATA + "b"), "wb").write(b"TWO")
    open(os.path.join(old, "exe"), "wb").write(b"longer")
    e = engine(spark)
    e.clean(old, verify_md5=True)
    said = e.out.getvalue()
    for text in (f"not file: {DATA}a", f"missing: {DATA}gone", f"hash mismatch: {DATA}b", "size mismatch: exe (expected 3, found 6)"):
        assert text in said
    out = engine(spark).make(old, new, str(tmp_path / "u.zip"))
    e = engine(spark)
    with pytest.raises(Reported):
        e.apply(out, old)
    assert e.out.getvalue().rstrip().endswith(f"not file: {DATA}a")


def test_manifests_do_not_pass_through_the_driver(spark, games, tmp_path, monkeypatch):
    """An update is made and applied from manifests that are never read whole nor put into a row."""
    old, new = games
    monkeypatch.setattr(sources, "PART", 200)
    monkeypatch.setattr(sources, "read_bytes", None)
    monkeypatch.setattr(zips, "read_member", lambda path, member, limit, read=zips.read_member: read(path, member, limit) if member[1] == ASSET else None)
    packed = []
    monkeypatch.setattr("tallyframe.ops.write_archive", lambda rows, *rest, write=sinks.write_archive: (packed.extend(rows.collect()), write(rows, *rest)))
    out = engine(spark).make(old, new, str(tmp_path / "u.zip"))
    assert len(packed) == 5 and all(r.inline_bytes is None for r in packed)
    with zipfile.ZipFile(out) as z:
        assert z.read("pkg_version") == listing(new)["pkg_version"]
    assert engine(spark).apply(out, old, verify_md5=True) and not engine(spark).apply(out, old)
    assert listing(old)["pkg_version"] == listing(new)["pkg_version"]


def test_a_document_is_written_by_the_task_that_reads_it(spark, tmp_path, monkeypatch):
    """No task gets the whole table for the manifest of an install."""
    rows = spark.createDataFrame([(i, f"text {i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    rows.repartition(8).write.option("parquet.block.size", 1024).parquet(str(tmp_path / "documents.parquet"))
    parts = []
    monkeypatch.setattr(files, "_write_lines", lambda lines, *rest, write=files._write_lines: (parts.append(lines.rdd.getNumPartitions()), write(lines, *rest)))
    root = files._game(spark, str(tmp_path))
    assert parts[0] > 1 and len(open(os.path.join(root, "pkg_version"), "rb").read().splitlines()) == 41


def test_versions_that_cannot_be_ordered(spark, tmp_path):
    a, b, c = (install(tmp_path / n, v, {"x": b"1"}) for n, v in (("a", "Win1.0"), ("b", "Win1"), ("c", "Mac2")))
    with pytest.raises(ManifestError, match="AmbiguousVersions"):
        engine(spark).make(a, b)
    with pytest.raises(Reported):
        engine(spark).make(a, c)


@pytest.mark.parametrize(("text", "kind"), [
    ("", "EmptyManifest"), (" \r\n\n", "EmptyManifest"), ("{", "InvalidManifestJson"), (line("a", b"") + "x", "InvalidManifestJson"), ('{"remoteName":"a","md5":"%s"}' % ("0" * 32), "InvalidManifestJson"),
    (line("a", b"").replace('"fileSize": 0', '"fileSize": -1'), "InvalidManifestJson"), (line("a", b"").replace('"fileSize": 0', '"fileSize": 0, "fileSize": 0'), "InvalidManifestJson"),
    (line("../a", b"").replace(hashlib.md5().hexdigest(), "x"), "UnsafePath"), (line("a", b"").replace(hashlib.md5().hexdigest(), "f" * 31), "InvalidMd5"), (line("a", b"") + "\n" + line("a", b"1"), "DuplicateManifestPath")])
def test_bad_manifests(text, kind):
    with pytest.raises(ManifestError) as e:
        list(sources.parse(text.encode()))
    assert e.value.kind == kind


def test_sizes_in_other_spellings():
    for text, size in (('"5"', 5), ("5.0", 5), ("5e1", 50), ('"18446744073709551615"', (1 << 64) - 1)):
        assert sources.parse_line(('{"remoteName":"a","md5":"","fileSize":%s}' % text).encode())[1] == size
    for text in ("5.5", "true", "null", '"x"', "18446744073709551616", "-1", "[5]", "1e30"):
        with pytest.raises(ManifestError, match="InvalidManifestJson"):
            sources.parse_line(('{"remoteName":"a","md5":"","fileSize":%s}' % text).encode())


def test_manifest_source(spark, tmp_path):
    text = line("a", b"x") + "\n\n \r\n" + line("é", b"yy").replace('"fileSize": 2', '"fileSize": 18446744073709551615')
    (tmp_path / "pkg_version").write_text(text)
    rows = sources.load_main(spark, str(tmp_path)).collect()
    assert [(r.line_no, r.path, int(r.size)) for r in rows] == [(0, "a", 1), (3, "é", (1 << 64) - 1)]
    for n in ("A", "B"):
        (tmp_path / f"Audio_{n}_pkg_version").write_text(line("same", b""))
    with pytest.raises(Exception, match="DuplicateManifestPath"):
        sources.load_audio(spark, str(tmp_path)).collect()
    empty = sources.load_main(spark, str(tmp_path)).limit(0)
    assert plans.changes(empty, empty).collect() == [] and plans.total_size(empty).first().total == 0


def test_manifests_in_parts(spark, tmp_path, monkeypatch):
    """Line numbers and the first bad line of all, wherever the parts begin."""
    monkeypatch.setattr(sources, "PART", 300)
    (tmp_path / "pkg_version").write_text("\n\n".join(line(f"p{i}", b"x" * i) for i in range(40)))
    rows = sources.load_main(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 5  # one before
    assert sorted((r.line_no, r.path, int(r.size)) for r in rows.collect()) == [(2 * i, f"p{i}", i) for i in range(40)]
    for n, paths in (("A", ["a", "b"]), ("B", ["c" * 400, "d"])):
        (tmp_path / f"Audio_{n}_pkg_version").write_text("\n".join(line(p, b"") for p in paths))
    assert sorted((r.line_no, r.path[0]) for r in sources.load_audio(spark, str(tmp_path)).collect()) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert sources.load_all(spark, str(tmp_path)).count() == 44
    lines = [line(f"p{i}", b"") for i in range(40)]
    for wrong, kind in (({30: lines[3], 35: "{"}, "DuplicateManifestPath"), ({30: "{", 35: lines[3]}, "InvalidManifestJson"), (dict.fromkeys(range(40), " " * 20), "EmptyManifest")):
        (tmp_path / "pkg_version").write_text("\n".join(wrong.get(i, x) for i, x in enumerate(lines)))
        with pytest.raises(ManifestError) as e:
            sources.load_main(spark, str(tmp_path))
        assert e.value.kind == kind


def test_lines_are_written_by_more_than_one_task(spark, tmp_path):
    files._write_lines(spark.range(0, 1000, 1, 7).selectExpr("CAST(id AS string) line"), str(tmp_path / "m"), b" \r\n")
    assert (tmp_path / "m").read_bytes() == b"".join(b"%d \r\n" % i for i in range(1000))


def test_tree_and_digests(spark, tmp_path):
    (tmp_path / "d/_e").mkdir(parents=True)
    (tmp_path / "d/_e/.f").write_bytes(b"abc")
    (tmp_path / "back\\slash").write_bytes(b"")
    os.symlink("nowhere", tmp_path / "dead")
    got = {r.raw_path: (r.path, r.kind, r.target_kind, r.size) for r in tree(spark, str(tmp_path)).collect()}
    assert got["d/_e/.f"] == ("d/_e/.f", "file", "file", 3) and got["back\\slash"][0] == "back/slash" and got["dead"][1:3] == ("link", "missing") and got["d/_e"][1] == "directory"
    sums = hashed(tree(spark, str(tmp_path)).where("kind = 'file' AND size > 0"), str(tmp_path)).collect()
    assert [bytes(r.md5) for r in sums] == [hashlib.md5(b"abc").digest()]


def archive(path, entries, **kw):
    with zipfile.ZipFile(path, "w") as z:
        for name, data, method in entries:
            z.writestr(zipfile.ZipInfo(name), data, method, **kw)
    return str(path)


def test_archive_members_are_checked(tmp_path):
    good = archive(tmp_path / "g.zip", [("d/", b"", 0), ("d/a", b"x" * 5000, 8), ("b", b"y", 0)])
    assert [(m[0], m[1], m[2]) for m in zips.members(good)] == [(1, "d/a", 8), (2, "b", 0)]
    assert zips.read_member(good, zips.find(good, "d/a"), 5000) == b"x" * 5000
    with pytest.raises(ManifestError, match="FileTooLarge"):
        zips.read_member(good, zips.find(good, "d/a"), 4999)
    raw = bytearray(open(good, "rb").read())
    raw[raw.rindex(b"y", 0, raw.index(b"PK\x01\x02"))] ^= 1
    open(tmp_path / "crc.zip", "wb").write(raw)
    with pytest.raises(ManifestError, match="CrcMismatch"):
        zips.read_member(str(tmp_path / "crc.zip"), zips.find(str(tmp_path / "crc.zip"), "b"), 9)
    for name, kind in (("../x", "UnsafePath"), ("a//b", "UnsafePath")):
        with pytest.raises(ManifestError, match=kind):
            list(zips.members(archive(tmp_path / "bad.zip", [(name, b"", 0)])))
    with pytest.warns(UserWarning), pytest.raises(ManifestError, match="DuplicateZipPath"):
        list(zips.members(archive(tmp_path / "dup.zip", [("a", b"1", 0), ("a", b"2", 0)])))
    with pytest.raises(ManifestError, match="InvalidZipDirectory"):
        list(zips.members(archive(tmp_path / "dir.zip", [("a/", b"1", 0)])))
    bz = archive(tmp_path / "bz.zip", [("a", b"1", 12)])
    with pytest.raises(ManifestError, match="UnsupportedCompression"):
        zips.read_member(bz, zips.find(bz, "a"), 9)
    raw = bytearray(open(good, "rb").read())
    struct.pack_into("<I", raw, 14, 12345)  # the first record's checksum
    raw[26:28] = b"\x01\x00"
    open(tmp_path / "local.zip", "wb").write(raw)
    m = next(zips.members(good))
    assert m[1] == "d/a"
    with open(tmp_path / "cut.zip", "wb") as f:
        f.write(open(good, "rb").read()[: m[6] + 40])
    with open(tmp_path / "cut.zip", "rb") as f, pytest.raises(ManifestError, match="UnexpectedEof"):
        list(zips.content(f, m))


def test_an_archive_is_written_by_many_tasks_as_by_one(spark, tmp_path):
    data = {f"d/{'é' if i % 9 == 0 else ''}{i}": b"%d" % i * (i % 50) for i in range(700)} | {"large": b"ab" * 1_500_000}
    for path, content in data.items():
        (tmp_path / "g" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "g" / path).write_bytes(content)
    rows = [(i, p, len(d), hashlib.md5(d).digest(), None) for i, (p, d) in enumerate(data.items())] + [(-1, "pkg_version", 2, None, b"me")]
    schema = "ordinal long, path string, size long, md5 binary, inline_bytes binary"
    assert sinks.write_archive(spark.createDataFrame(rows[::-1], schema), str(tmp_path / "g"), str(tmp_path / "o.zip")) == 702
    with zipfile.ZipFile(tmp_path / "want.zip", "w") as z:
        for path, content in [("pkg_version", b"me"), *data.items()]:
            info = zipfile.ZipInfo(path, (1980, 0, 0, 0, 0, 0))
            with z.open(info, "w") as f:
                f.write(content)
    assert (tmp_path / "o.zip").read_bytes() == (tmp_path / "want.zip").read_bytes()
    assert sorted(os.listdir(tmp_path)) == ["g", "o.zip", "want.zip"]
    for wrong, kind in (((5, "d/5", 1, None, None), "SizeMismatch"), ((5, "d/5", 5, b"x" * 16, None), "HashMismatch"), ((5, "d/7", 7, None, None), "DuplicateZipPath"), ((5, "../d", 7, None, None), "UnsafePath")):
        with pytest.raises(ManifestError, match=kind):
            sinks.write_archive(spark.createDataFrame([*rows[:5], wrong, *rows[6:]], schema), str(tmp_path / "g"), str(tmp_path / "no.zip"))
        assert sorted(os.listdir(tmp_path)) == ["g", "o.zip", "want.zip"]


def test_archive_rows_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"1")
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    sinks.write_archive(spark.sql("SELECT 0L ordinal, 'a' path, 1L size, CAST(NULL AS binary) md5, CAST(NULL AS binary) inline_bytes"), str(tmp_path), str(tmp_path / "o.zip"))
    assert [m[1] for m in zips.members(str(tmp_path / "o.zip"))] == ["a"]


def test_wide_archives(tmp_path):
    """Records beyond 65,535 members or 2 GiB, as zipfile reads them."""
    raw = b"".join(sinks._central(sinks._info(f"é{i}", s, i), f"é{i}".encode(), 0x800, o) for i, (s, o) in enumerate([(5, 3 << 30), (5 << 30, 7), (1, 1), (6 << 30, 8 << 30)] + [(0, 0)] * 70_000))
    (tmp_path / "w.zip").write_bytes(raw + sinks._end(70_004, len(raw), 0))
    with zipfile.ZipFile(tmp_path / "w.zip") as z:
        want = [(i, x.orig_filename, x.compress_type, x.CRC, x.compress_size, x.file_size, x.header_offset) for i, x in enumerate(z.infolist())]
    assert len(want) == 70_004 and want[3][5:] == (6 << 30, 8 << 30) and list(zips.members(str(tmp_path / "w.zip"))) == want


def test_packages_that_do_not_fit_their_manifest(spark, tmp_path):
    game = install(tmp_path / "g", "Win1", {"x": b"1"})
    for entries, kind in (([("x", b"1", 0)], "PackageMissingManifest"), ([("pkg_version", line("x", b"1"), 0), ("y", b"1", 0)], "ZipEntryNotInManifest"), ([("pkg_version", line("x", b"1"), 0), ("x", b"12", 0)], "ZipEntrySizeMismatch")):
        with pytest.raises(ManifestError, match=kind):
            engine(spark).apply(archive(tmp_path / f"{kind}.zip", entries), game)
    assert listing(game)["x"] == b"1"


def test_command_line(spark, tmp_path, capsys):
    game = install(tmp_path / "g", "Win1", {"x": b"1"})
    z = archive(tmp_path / "u.ZIP", [("a", b"", 0)])
    text = tmp_path / "t.txt"
    text.write_text("")
    assert cli.parse(["-v", game]) == cli.Request("clean", (game,), False, True)
    assert cli.parse([game, "-y", game]).operation == "make"
    assert cli.parse([game, str(tmp_path / "o.zip"), game]).paths == (game, game, str(tmp_path / "o.zip"))
    assert cli.parse([game, z]) == cli.Request("apply", (z, game))
    for args, said in (([], "no arguments"), ([""], "empty"), (["-x"], "unknown option"), ([game, str(tmp_path / "no.zip")], "not found"), (["nope"], "path not found"), ([str(text)], "neither"), ([z], "expected")):
        with pytest.raises(cli.Problem, match=said):
            cli.parse(args)
    assert cli.expand_home("~/a", {"USERPROFILE": "/u"}) == "/u/a"
    with pytest.raises(cli.Problem, match="HOME"):
        cli.expand_home("~", {})
    assert cli.main(["-y", game], spark) == 0 and cli.main(["-x"], spark) == 1 and cli.main(["-y", game, game], spark) == 1
    assert "AmbiguousVersions" in capsys.readouterr().err
