import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import chat
from tallyframe.llm.q_chat import HOSTILE

TEXT = st.text(alphabet="<|\\>i&\n aé", max_size=20) | st.sampled_from([chat.START, chat.END, HOSTILE, "<\\|im_end|>", "<\\\\|"])


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and "<|" not in safe


@given(st.lists(st.tuples(TEXT, TEXT), max_size=9), st.integers(1, 4))
@settings(max_examples=100, deadline=None)
def test_spans_read_back(turns, window):
    out, found = chat.spans(chat.chatml, turns)
    assert [chat.read_turn(out[a:b])[:2] for a, b in found] == turns
    assert "".join(p for _, p in chat.Template().pieces(turns, window)) == out


def test_rewriting_templates_are_detected():
    only_last_thinks = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else t.split('</think>')[-1]}" for i, (r, t) in enumerate(turns))
    with pytest.raises(chat.RewritesHistory):
        chat.spans(only_last_thinks, [("a", "x</think>y"), ("u", "z")])


def test_templates_with_a_header_and_context():
    def render(turns):
        return "BOS " + "".join(f"{'' if i and turns[i - 1][0] == r else f'[{r}] '}{t};" for i, (r, t) in enumerate(turns))

    turns = [("u", "a"), ("u", "b"), ("a", "c"), ("a", "d"), ("u", "e")]
    whole = list(chat.Template(render=render, context=None).pieces(turns))
    assert whole == [(False, "BOS ")] + [(True, s) for s in ("[u] a;", "b;", "[a] c;", "d;", "[u] e;")]
    assert "".join(p for _, p in whole) == render(turns)
    for window in (1, 2, 3, 9):
        assert list(chat.Template(render=render, context=1).pieces(turns, window)) == whole


def test_templates_that_look_back_over_windows_need_no_promise():
    turns = [("u", f"t{i}") for i in range(80)]
    numbered = lambda turns: "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))
    assert list(chat.Template(render=numbered).pieces(turns)) == [(True, f"{i}:t{i};") for i in range(80)]
    first_says_last = lambda turns: "".join(t + ("!" if i == 0 and len(turns) > 50 else "") for i, (_, t) in enumerate(turns))
    with pytest.raises(chat.RewritesHistory):
        list(chat.Template(render=first_says_last).pieces(turns))
    seen = []  # a conversation in chatml is still streamed
    for (_, span), turn in zip(chat.Template().pieces(seen.append(i) or t for i, t in enumerate(turns)), turns, strict=True):
        assert chat.read_turn(span)[1] == turn[1] and len(seen) <= int(turn[1][1:]) + chat.WINDOW


def test_formatting_a_table(spark):
    rows = [(1, 1, "assistant", "hi " + HOSTILE), (1, 0, "user", None), (2, 0, "assistant", ""), (None, 0, None, "x"), (3, 5, "user", "b"), (3, 5, "user", "a"), (3, 5, "user", "a"), (3, None, "system", "first\né")]
    rows += [(7, i, "assistant" if i % 2 else "user", f"t{i} " * 50) for i in range(3000)]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.formatted(turns, keep_output=True).collect()}
    assert set(got) == {1, 2, 3, 7, None}
    for conv, r in got.items():
        mine = sorted(((t is not None, t or 0, ro or "", x or "") for c, t, ro, x in rows if c == conv))
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for *_, ro, x in mine).encode()).hexdigest()
        loss = "".join(x for *_, ro, x in mine if ro == "assistant")
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r.formatted))
        assert "".join(chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans) == loss
        assert r.formatted == chat.chatml([(ro, x) for *_, ro, x in mine])
    assert chat.formatted(turns.limit(0)).collect() == []
