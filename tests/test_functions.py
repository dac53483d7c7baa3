import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import paths, sizes, versions
from tallyframe.schema import ManifestError

PATHS = {"": "UnsafePath", "/a": "UnsafePath", "\\a": "UnsafePath", "C:/x": "UnsafePath", "a\\b": "UnsafePath", "a//b": "UnsafePath", "a/": "UnsafePath", "a/./b": "UnsafePath", "..": "UnsafePath", "é:x": "ok",
         "a/..b": "ok", "ok/x.bin": "ok", "a" * 65_536: "PathTooLongForZip", "é" * 32_768: "PathTooLongForZip", "/" + "a" * 65_536: "UnsafePath", "a//" + "a" * 65_536: "PathTooLongForZip"}


def test_path_rules(spark):
    got = {r.p: r.v for r in spark.createDataFrame([(p,) for p in PATHS], "p string").select("p", paths.verdict(F.col("p")).alias("v")).collect()}
    assert got == PATHS
    for p, want in PATHS.items():
        if want == "ok":
            assert paths.check_path(p) == p
        else:
            with pytest.raises(ManifestError) as e:
                paths.check_path(p)
            assert e.value.kind == want


def test_versions(spark):
    pairs = [("1.4", "1.4.0", 0), ("1.10", "1.9", 1), ("1.", "1", None), ("1..2", "1", None), ("1-b", "1", None), ("18446744073709551615", "18446744073709551616", None), ("18446744073709551615", "9.9", 1), ("007", "7", 0), ("2", "10", -1)]
    rows = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    got = {(r.a, r.b): r.c for r in rows.select("a", "b", versions.compare_versions(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {(a, b): c for a, b, c in pairs}
    assert all(versions.compare_text(a, b) == c for a, b, c in pairs)
    for v, want in {"OSPRODWin1.4.0": ("OSPRODWin", "1.4.0"), "1.4": None, "abc": None, "a\n1\n": ("a\n", "1\n")}.items():
        assert versions.split_text(v) == want
        got = spark.createDataFrame([(v,)], "v string").select(versions.split_version(F.col("v")).alias("s")).first().s
        assert (tuple(got) if got else None) == want


def test_finding_versions():
    ok = b'\x00app_version\x00\x01{"a": {"b": "}"}, "DispatchVersion" : "CNBeta1.2.3"}'
    assert versions.version_in(ok) == "CNBeta1.2.3"
    assert versions.version_in(b'app_version {"x": 1} app_version {"n": {"DispatchVersion":"A1"}}') == "A1"
    assert versions.version_in(b'app_version {"DispatchVersion": "a\\"b"}') is None
    assert versions.version_in(b'app_version {"DispatchVersion": 5} x') is None
    assert versions.version_in(b'{"DispatchVersion": "A1"}') is None
    for pad in (0, 32_750, 32_768, 70_000):
        assert versions.version_in_file(io.BytesIO(b"\x07" * pad + ok + b"\x07" * 50_000)) == "CNBeta1.2.3"


@given(st.integers(0, 1 << 60))
@settings(max_examples=200, deadline=None)
def test_byte_texts_are_cut_off(n):
    text, unit = sizes.bytes_text(n).split()
    scale = 1024 ** ("B", "KiB", "MiB", "GiB", "TiB").index(unit)
    hundredths = int(text.replace(".", "")) if unit != "B" else int(text) * 100
    assert hundredths * scale <= n * 100 < (hundredths + 1) * scale or unit == "B"


def test_byte_columns(spark):
    n = [0, 1023, 1024, 1_572_863, 1 << 40, 1 << 62]
    got = {r.n: r.t for r in spark.createDataFrame([(x,) for x in n], "n long").select("n", sizes.format_bytes(F.col("n")).alias("t")).collect()}
    assert got == {x: sizes.bytes_text(x) for x in n} and got[1023] == "1023 B" and got[1024] == "1.00 KiB" and got[1_572_863] == "1.49 MiB"


def test_md5_texts(spark):
    rows = [("5d41402abc4b2a76b9719d911017c592", True), ("5D41402ABC4B2A76B9719D911017C592", True), ("5d41402abc4b2a76b9719d911017c59", False), ("5d41402abc4b2a76b9719d911017c5921", False), ("z" * 32, False)]
    got = {r.t: r.ok for r in spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", sizes.parse_md5(F.col("t")).isNotNull().alias("ok")).collect()}
    assert got == dict(rows)


def test_comparison_stops_at_the_first_difference(spark):
    pairs = [("1.4", "2.x", -1), ("2.x", "1", 1), ("1.x", "1.4", None), (".1", "1", 0), ("", "0.0", 0), ("", "1", -1), ("1.", "1", None), ("3", "1..2", 1), ("18446744073709551616", "1", None)]
    rows = spark.createDataFrame(pairs, "a string, b string, c int")
    got = rows.select("a", "b", versions.compare_versions(F.col("a"), F.col("b")).alias("c")).collect()
    assert [tuple(r) for r in got] == pairs
    assert all(versions.compare_text(a, b) == c for a, b, c in pairs)


def test_shares_and_speeds_just_under_a_whole_number_are_cut_off(spark):
    """A decimal quotient has six places, and would be rounded up to 1."""
    row = spark.sql("SELECT 10000000 - 1L d, 10000000000000000L ns, 1000000000 - 1L part, 100000000000L total, 0L none").select(
        sizes.speed(F.col("d"), F.col("ns")).alias("speed"), sizes.percent(F.col("part"), F.col("total"), F.col("none"), F.col("none")).alias("bytes"), sizes.percent(F.col("none"), F.col("none"), F.col("part"), F.col("total")).alias("files"))
    assert tuple(map(int, row.first())) == (0, 0, 0)


def test_byte_texts_just_under_a_unit_are_cut_off(spark):
    n = [(1 << 40) - 1, (1 << 30) - 1, (1 << 50) - 1, 163_836 * 40_961]
    got = spark.createDataFrame([(x,) for x in n], "n long").select(sizes.format_bytes(F.col("n")).alias("t")).collect()
    assert [r.t for r in got] == [sizes.bytes_text(x) for x in n] and got[0].t == "1023.99 GiB"
