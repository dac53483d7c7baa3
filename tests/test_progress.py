import io

from tallyframe.functions.versions import version_in
from tallyframe.progress import STEP, Progress, followed


def drawn(out):
    return out.getvalue().count("\r")


def test_the_line_is_drawn_at_steps_and_at_the_end():
    out, now = io.StringIO(), [0]
    p = Progress(out, "Copy", 4 * STEP, 300, True, lambda: now[0])
    p.start()
    now[0] = 2 * 10**9
    p.reach(STEP - 1, 2)
    assert drawn(out) == 1
    p.reach(STEP, 2)
    p.reach(STEP + 5, 5)
    assert drawn(out) == 3 and p.percent() == 25 and p.speed() == (STEP + 5) // 2
    p.reach(4 * STEP, 300)
    p.finish()
    assert drawn(out) == 4 and out.getvalue().endswith("\n")
    last = out.getvalue().split("\r")[-1].split("        ")[0]
    assert last == "Copy:      [" + "#" * 28 + "] 100%  32.00 MiB/32.00 MiB  files 300/300  16.00 MiB/s"


def test_without_bytes_files_count_and_nothing_is_all():
    p = Progress(io.StringIO(), "A longer label", 0, 8)
    p.reach(0, 2)
    assert p.line() == "A longer label: [" + "#" * 7 + "-" * 21 + "]  25%  files 2/8"
    assert Progress(io.StringIO(), "x", 0, 0).percent() == 100


def test_tasks_add_to_the_line(spark):
    out = io.StringIO()
    with followed(spark.sparkContext, Progress(out, "Count", 100, 100), 0.01) as (moved, files):
        spark.range(100).foreach(lambda _: (moved.add(1), files.add(1)))
    assert "100%  100 B/100 B  files 100/100" in out.getvalue()


def test_the_search_for_a_version_goes_on_past_names_without_a_string():
    assert version_in(b'app_version {"x":"DispatchVersion", "DispatchVersion": "OS1.2"}') == "OS1.2"
    assert version_in(b'app_version {"DispatchVersion": 5, "y": {"DispatchVersion": "OS1.2"}}') == "OS1.2"
    assert version_in(b'app_version {"DispatchVersion": "O\\S", "DispatchVersion": "OS1.2"} app_version {"DispatchVersion":"OS3"}') == "OS3"
    assert version_in(b"app_version " * 200_000) is None
