from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import conversations as C
from quillspark.llm import splitting as P

TEXT = st.text(alphabet="ab 。，.!\n\r\t　#*é́中", max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(12, 60))
def test_pieces_cover_the_text_with_exact_overlap(text, limit):
    overlap = limit // 4
    pieces = P.spans(text, limit, overlap)
    assert "".join(P.units(text, limit - overlap)) == text
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < b - a <= limit for a, b in pieces)
    for (_, end), (begin, _) in zip(pieces, pieces[1:]):
        assert begin == end - overlap


def test_natural_boundaries():
    paragraphs = "\n\n".join("Sentence number %d is here. And another one follows it." % i * 4 for i in range(12))
    text = "# One\n" + paragraphs + "\n# Two\n" + paragraphs
    cuts = [text[:b] for _, b in P.spans(text)[:-1]]
    assert all(c.endswith("\n") for c in cuts)
    chinese = "这是一句话，说明账单。" * 200
    assert all(chinese[b - 1] in "。，" for _, b in P.spans(chinese)[:-1])
    assert [b - a for a, b in P.spans("x" * 3000)][:2] == [810, 900]


def test_frame(spark):
    schema = "chunk_id long, text string, breadcrumb string, piece_no string, begin int"
    rows = [(1, "  short　\n", "b", "clash", 0), (2, None, None, None, None), (3, " \t", "b", None, 0), (4, "\n" + "x" * 900 + " ", "b", None, 0), (5, "字。" * 20_000, "deep > path", None, 0), (5, "字。" * 20_000, "deep > path", None, 0)]
    got = P.split_texts(spark.createDataFrame(rows, schema), "chunk_id", "text")
    assert len(got.columns) == len(set(got.columns))
    by = {}
    for r in got.collect():
        by.setdefault(r["chunk_id"], []).append(r)
    assert [(len(by[i]), by[i][0]["piece_text"]) for i in (1, 2, 3)] == [(1, "short"), (1, ""), (1, "")]
    assert len(by[4]) == 1 and by[5][0]["n_pieces"] * 2 == len(by[5]) and {r["breadcrumb"] for r in by[5]} == {"deep > path"}
    one = {r["piece_no"]: r for r in by[5]}
    text = one[0]["piece_text"] + "".join(one[i]["piece_text"][90:] for i in range(1, len(one)))
    assert text == "字。" * 20_000
    assert P.split_texts(spark.createDataFrame([], schema), "chunk_id", "text").count() == 0


# --- conversations ----------------------------------------------------------------------------------------------------

SCHEMA = "session_id string, seq int, payload string, kind string, text string"


def turns(*kinds):
    """Events numbered from 1: u user, U blank user, a answer, A blank answer, t tool call, e error."""
    made = {"u": ("turn_start", "hi"), "U": ("turn_start", " ​\n"), "a": ("answer", "yes"), "A": ("answer", None), "t": ("tool_call", None), "e": ("error", None)}
    return [{"type": made[k][0], "seq": i, **({"text": made[k][1]} if k in "uUaA" else {})} for i, k in enumerate(kinds, 1)]


def rows_of(session, events, wrap=False):
    return [(session, e["seq"], json.dumps(json.dumps(e) if wrap else e), "x", "y") for e in events]


def verdicts(spark, rows):
    return {r["session_id"]: r["reason"] for r in C.judged(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("block", [10_000, 2])
def test_reasons(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = rows_of("good", turns(*"utaeua")) + rows_of("good", turns(*"utaeua"), wrap=True)
    rows += rows_of("two answers", turns(*"uaAaua")) + rows_of("no start", turns(*"tt")) + rows_of("blank start", turns(*"Ua"))
    rows += rows_of("answer first", turns(*"aua")) + rows_of("open end", turns(*"uau")) + rows_of("skipped", turns(*"uttuta")) + rows_of("blank answer", turns(*"uA"))
    rows += rows_of("gap", [e for e in turns(*"utta") if e["seq"] != 2]) + rows_of("clash", [*turns(*"ua"), {"type": "answer", "text": "no", "seq": 2}])
    rows += [*rows_of("broken", turns(*"ua")), ("broken", 3, '{"type": "t', "x", "y"), *rows_of("null", turns(*"ua")), ("null", 3, None, None, None), ("no seq", None, '{"type":"turn_start","text":"x"}', None, None)]
    rows += [("seq inside", None, json.dumps(e), None, None) for e in turns(*"ua")] + [(None, 1, "{}", None, None), ("list", 1, "[1]", None, None), ("untyped", 1, '{"a":1}', None, None)]
    got = verdicts(spark, rows)
    assert got == {
        "good": None, "two answers": None, "seq inside": None, "no start": "no question", "blank start": "no question", "answer first": "answer first", "open end": "unanswered", "skipped": "unanswered",
        "blank answer": "unanswered", "gap": "gap", "clash": "clash", "broken": "unreadable", "null": "unreadable", "no seq": "unreadable", "list": "unreadable", "untyped": "unreadable",
    }
    said = [(r["session_id"], r["message_no"], r["seq"], r["role"]) for r in C.conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("session_id", "message_no").collect()]
    assert [s[1:] for s in said if s[0] == "good"] == [(1, 1, "user"), (2, 3, "assistant"), (3, 5, "user"), (4, 6, "assistant")]
    assert [s[1:] for s in said if s[0] == "two answers"] == [(1, 1, "user"), (2, 2, "assistant"), (3, 4, "assistant"), (4, 5, "user"), (5, 6, "assistant")]
    assert {s[0] for s in said} == {"good", "two answers", "seq inside"}


@pytest.mark.parametrize("seed", range(3))
def test_random_sessions_equal_a_walk(spark, monkeypatch, seed):
    monkeypatch.setattr(C, "BLOCK", 3)
    rng = random.Random(seed)
    rows, expected = [], {}
    for s in range(60):
        kinds = [rng.choice("uuaaaAUt") if rng.random() < 0.4 else "ua"[i % 2] for i in range(rng.randrange(1, 14))]
        events = turns(*kinds)
        rows += rng.sample(rows_of(str(s), events), len(events))
        state, bad = None, "u" not in kinds and "U" not in kinds or "U" in kinds
        for k in kinds:
            if k in "uU":
                bad |= state is False
                state = False
            elif k in "aA":
                bad |= state is None
                state = True if k == "a" and state is not None else state
        expected[str(s)] = bad or state is not True
    assert {k: v is not None for k, v in verdicts(spark, rows).items()} == expected


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.judged(none).count() == 0 and C.conversations(none).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_sessions_by_time(spark, seed):
    rng = random.Random(seed)
    start = datetime(2026, 1, 1, 20)
    rows, now = [], {c: start for c in "abc"}
    for _ in range(300):
        c = rng.choice("aaabc")
        now[c] += timedelta(seconds=rng.choice([0, 3, 20, 60]) if rng.random() < 0.85 else rng.randrange(30_000, 200_000))
        rows.append((c, now[c], rng.choice(["me", "bot", None]), rng.choice(["x", "y", " ", "z"])))
    frame = spark.createDataFrame([*rows, *rows[:20], (None, start, "me", "x"), ("a", None, "me", "x")], "room string, at timestamp, who string, said string")
    messages = sorted({(c, t, w or "", x) for c, t, w, x in rows if x.strip()})
    spaced = C.gaps(frame.where("room is not null and at is not null").selectExpr("room as channel", "unix_micros(at) as us", "struct(who, said) as tie"))
    assert 60e6 < C.calibrated_gap(spaced) < 30_000e6
    sessions = []
    for message in messages:
        if not sessions or sessions[-1][-1][0] != message[0] or (message[1] - sessions[-1][-1][1]).total_seconds() > 3600:
            sessions.append([])
        sessions[-1].append(message)
    expected, numbers = set(), {}
    for session in sessions:
        c = session[0][0]
        numbers[c] = numbers.get(c, 0) + 1
        if session[-1][2] != session[0][2]:
            expected |= {(c, numbers[c], i, "user" if w == session[0][2] else "assistant", x) for i, (_, _, w, x) in enumerate(session, 1)}
    for gap in (None, 3600e6):
        got = C.sessionized(frame, "room", "at", "who", "said", gap).collect()
        assert expected and {(r["channel"], r["session_no"], r["message_no"], r["role"], r["text"]) for r in got} == expected and len(got) == len(expected)
    assert C.sessionized(frame.limit(0), "room", "at", "who", "said").count() == 0
