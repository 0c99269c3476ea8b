import random

import pytest

from ledgerloom.llm import conversations as cv
from ledgerloom.plans.materialise import Cuts

SCHEMA = "event_id bigint, session_id string, host string, ts string, type string, data string, speaker string"
U, A, T, R, P = "user/message", "assistant/message", "tool/call", "tool/result", "plugin/message"


def say(text):
    return '{"content": "%s"}' % text


def call(c, text=None):
    return '{"call_id": "%s"%s}' % (c, "" if text is None else ', "content": "%s"' % text)


SESSIONS = {
    "good": ([(1, U, say("hi")), (2, T, call("c1")), (3, R, call("c1", "r")), (4, " Assistant/Message\n", say("yo")), (5, P, say("note"))], None),
    "repeated": ([(1, U, say("hi")), (1, U, say("hi")), (2, A, say("yo")), (2, A, say("yo"))], None),
    "empty": ([(1, "turn/start", '{"turn": 1}')], "empty"),
    "blank": ([(1, U, say("  ")), (2, A, '{"content": null}'), (3, A, "{}")], "empty"),
    "cut": ([(1, U, say("hi")), (2, A, '{"content": "x')], "unreadable"),
    "trailing": ([(1, U, say("hi")), (2, A, say("x") + " y}")], "unreadable"),
    "no brace": ([(1, U, say("hi")), (2, A, say("x")[1:])], "unreadable"),
    "null data": ([(1, U, say("hi")), (2, A, say("x")), (3, A, None)], "unreadable"),
    "bad time": ([(1, U, say("hi")), (2, A, say("x")), ("yesterday", A, say("y"))], "unreadable"),
    "starts wrong": ([(1, A, say("x")), (2, U, say("hi")), (3, A, say("x"))], "starts without user"),
    "no reply": ([(1, U, say("hi")), (2, U, say("hi2")), (3, A, say("x"))], "missing reply"),
    "no last reply": ([(1, U, say("hi")), (2, A, say("x")), (3, U, say("bye"))], "missing reply"),
    "orphan": ([(1, U, say("hi")), (2, R, call("c9", "r")), (3, A, say("x"))], "orphan"),
    "late call": ([(1, U, say("hi")), (2, R, call("c1", "r")), (3, T, call("c1")), (4, A, say("x"))], "orphan"),
    "same instant": ([(1, U, say("hi")), (2, T, call("c1")), (2, R, call("c1", "r")), (4, A, say("x"))], "orphan"),
    "no call id": ([(1, U, say("hi")), (2, R, say("r")), (4, A, say("x"))], "orphan"),
    "other session": ([(1, U, say("hi")), (3, R, call("far", "r")), (4, A, say("x"))], "orphan"),
    "has far": ([(1, U, say("hi")), (2, T, call("far")), (4, A, say("x" * 100000))], None),
    "bad call time": ([(1, U, say("hi")), ("n/a", T, call("c1")), (2, R, call("c1", "r")), (4, A, say("x"))], "orphan"),
}


def events(spark, sessions=SESSIONS, seed=1):
    rows = []
    for name, (part, _) in sessions.items():
        for t, kind, data in part:
            rows.append([None, name, "h", t if isinstance(t, str) else f"2025-01-01T00:{t // 60:02d}:{t % 60:02d}Z", kind, data, "clash"])
    random.Random(seed).shuffle(rows)
    rows += [[None, None, None, None, None, None, None]]
    for i, r in enumerate(rows):
        r[0] = i
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame([("h", "UTC")], "origin string, zone_name string")


def test_sessions(spark, zones):
    rows = events(spark)
    sessions, messages = cv.rebuild(spark, rows, zones)
    assert {r.session_id: r.reason for r in sessions.collect()} == {k: v[1] for k, v in SESSIONS.items()}
    kept = cv.ordered_messages(sessions, messages, rows).where("session_id = 'good'").orderBy("position").collect()
    assert [(r.position, r.speaker, r.content) for r in kept] == [(1, "user", "hi"), (2, "tool", "r"), (3, "assistant", "yo"), (4, "user", "note")]


def test_long_session_over_partitions(spark, zones):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        part = [(i, U if i % 2 == 0 else A, say(f"m{i}")) for i in range(400)]
        rows = events(spark, {"long": (part, None), "b": ([(1, U, say("x"))], None)})
        sessions, messages = cv.rebuild(spark, rows, zones)
        assert {r.session_id: r.reason for r in sessions.collect()} == {"long": None, "b": "missing reply"}
        got = [r.content for r in cv.ordered_messages(sessions, messages, rows).orderBy("position").collect()]
        assert got == [f"m{i}" for i in range(400)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty(spark, zones):
    sessions, messages = cv.rebuild(spark, events(spark, {}).limit(0), zones)
    assert sessions.count() == 0 and messages.count() == 0


def test_pointers(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, -1), (5, 4), (6, 7), (7, 6), (8, 7), (9, 99), (10, 10)] + [(100 + i, 99 + i if i else 1) for i in range(70)]
    ends, opened = cv.resolve(Cuts(spark, "t"), spark.createDataFrame(rows, "id bigint, ptr bigint"))
    got = {r.id: (r.root if r.status != "cycle" else None, r.status, r.depth) for r in ends.collect()}
    assert len(got) == len(rows)
    assert got[1] == (1, "root", 1) and got[3] == (1, "ok", 3) and got[169] == (1, "ok", 71)
    assert got[4][1:] == ("orphan", 1) and got[5] == (4, "orphan", 2) and got[9][1:] == ("orphan", 1)
    assert got[6] == got[7] == got[8] == got[10] == (None, "cycle", None)
    assert opened[0] == 77 and opened == sorted(opened, reverse=True) and opened[6] > opened[-1] == 4  # the joins resolve them, 2**k steps a round


def test_pointers_against_walking(spark):
    rng = random.Random(8)
    ptr = {i: rng.choice([None, -1, rng.randrange(400), rng.randrange(max(1, i)), i - 1 if i else None]) for i in range(300)}
    want = {}
    for i in ptr:
        x, path = i, []
        while x in ptr and x not in path and ptr[x] is not None and ptr[x] in ptr:
            path.append(x)
            x = ptr[x]
        want[i] = ("cycle", None) if x in path else ("orphan" if ptr[x] is not None else "ok" if path else "root", len(path) + 1)
    ends, _ = cv.resolve(Cuts(spark, "t"), spark.createDataFrame(list(ptr.items()), "id bigint, ptr bigint"))
    assert {r.id: (r.status, r.depth) for r in ends.collect()} == want
