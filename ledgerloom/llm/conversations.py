"""Conversations rebuilt from message rows.

Every message points to its parent, the message before it in its session; a tool's result without the call it answers
points to nothing. The pointers are resolved by pointer jumping: each round joins the open pointers with the table and
doubles their reach, until each message has its root, its depth below it, and its status. What hangs from a pointer to
nothing is an orphan, pointers that never end are a cycle. A session is kept if all its messages resolve to one root, a
user's, and every user message is answered; its conversation is the path from the root to the last message, ordered by depth.

Defined results: rows without session belong to none; rows that agree in session, instant, type and data are one; equal
instants are ordered by event_id; an empty table gives no rows. A message row is a row of one of the four message types;
without content (missing, null, blank) it is no message, but an unreadable instant or data still breaks its session, and so
does a result without call.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import json_object
from ledgerloom.operators import timestamps
from ledgerloom.plans.materialise import Cuts
from ledgerloom.plans.ordering import last_before, ranged

#: The message types and their speakers.
SPEAKERS = {"user/message": "user", "assistant/message": "assistant", "plugin/message": "user", "tool/result": "tool"}
CALL, RESULT = "tool/call", "tool/result"


def resolve(cuts: Cuts, nodes: DataFrame, closed: bool = False) -> tuple[DataFrame, list[int]]:
    """(id, root, status, depth of ``nodes``; how many pointers were open before each round of joins).

    ``nodes`` has id and ptr: a null ptr is a root, a negative one or one to an id that isn't there makes an orphan, and so
    is what points to an orphan. depth counts from 1 at the root or orphan. After k rounds a pointer reaches 2**k steps, so
    what is open when that exceeds the number of pointers is on or leads into a cycle (null root and depth). A round
    writes the nodes that were open; those it ends are never written again. ``closed`` says that no pointer leads to an
    id that isn't there, which saves the look at that.
    """
    if not closed:
        there = nodes.select(F.col("id").alias("_id")).distinct()
        nodes = nodes.join(there, F.col("ptr") == F.col("_id"), "left").select("id", F.when(F.col("ptr").isNotNull(), F.coalesce("_id", F.lit(-1))).alias("ptr"))
    root = F.when(F.col("ptr").isNull() | (F.col("ptr") < 0), F.col("id"))
    status = F.when(F.col("ptr").isNull(), "root").when(F.col("ptr") < 0, "orphan")
    one = F.lit(1).cast("bigint")
    state, seen = cuts.observed(nodes.select("id", "ptr", root.alias("root"), status.alias("status"), one.alias("depth")), open=F.count_if(root.isNull()))
    done, opened = [state.where("status is not null")], []
    while seen["open"] and 2 ** len(opened) <= 2 * max([seen["open"], *opened[:1]]):
        opened.append(seen["open"])
        goal = state
        for d in done[:-1]:
            goal = goal.unionByName(d)
        goal = goal.select(*[F.col(c).alias(f"_{c}") for c in goal.columns])
        u = state.where("status is null").join(goal, F.col("ptr") == F.col("_id")).select(
            "id", F.col("_ptr").alias("ptr"), F.col("_root").alias("root"),
            F.when(F.col("_status") == "root", "ok").otherwise(F.col("_status")).alias("status"), (F.col("depth") + F.col("_depth")).alias("depth"),
        )
        state, seen = cuts.observed(u, open=F.count_if(F.col("status").isNull()))
        done.append(state.where("status is not null"))
    rest = state.where("status is null").select("id", "root", F.lit("cycle").alias("status"), F.lit(None).cast("bigint").alias("depth"))
    for d in done:
        rest = rest.unionByName(d.select("id", "root", "status", "depth"))
    return rest, opened


def _kind(c: str = "type"):
    return F.lower(F.btrim(F.col(c), F.lit(timestamps.SPACE)))


def _content(data):
    return F.try_variant_get(json_object(data), "$.content", "string")


def read_rows(events: DataFrame, zones: DataFrame) -> DataFrame:
    """One row for each distinct message or call row of a session: session_id, utc_us, event_id, kind, whole, message, call_id.

    Equal data is told by 128 bits of it.
    """
    rows = events.where("session_id is not null").withColumn("kind", _kind()).where(F.col("kind").isin(*SPEAKERS, CALL)).select("session_id", "event_id", "ts", "host", "kind", "data")
    rows = timestamps.normalise(rows, "ts", zones, "host").withColumn("json", json_object(F.col("data")))
    content = F.try_variant_get("json", "$.content", "string")
    spoken = (F.col("kind") != CALL) & content.isNotNull() & ~content.rlike(r"^[\s\p{Z}]*$")
    rows = rows.select(
        "session_id", "utc_us", "event_id", "kind", F.col("json").isNotNull().alias("whole"), F.coalesce(spoken, F.lit(False)).alias("message"),
        F.when(F.col("kind").isin(CALL, RESULT), F.try_variant_get("json", "$.call_id", "string")).alias("call_id"),
        F.xxhash64(F.col("data").isNull(), "data").alias("x"), F.xxhash64(F.lit("second"), F.col("data").isNull(), "data").alias("y"),
    )
    return rows.groupBy(*[c for c in rows.columns if c != "event_id"]).agg(F.min("event_id").alias("event_id")).drop("x", "y")


def rebuild(spark, events: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions: session_id, n_messages, dropped, reason; messages of all sessions: session_id, position, event_id, speaker, utc_us)."""
    cuts = Cuts(spark, "conversations")
    rows = cuts.cut(read_rows(events, zones))
    clear = F.col("utc_us").isNotNull() & F.col("whole")
    calls = rows.where(clear & (F.col("kind") == CALL) & F.col("call_id").isNotNull()).groupBy("session_id", "call_id").agg(F.min("utc_us").alias("called"))
    answers = rows.where(clear & (F.col("kind") == RESULT)).join(calls, ["session_id", "call_id"], "left")
    # A call that isn't strictly earlier answers nothing.
    lonely = cuts.cut(answers.where(~F.coalesce(F.col("called") < F.col("utc_us"), F.lit(False))).select("session_id", "event_id", F.lit(True).alias("lonely")))
    spoken = rows.where(clear & F.col("message")).select("session_id", "utc_us", "event_id", "kind")
    order = ranged(cuts, spoken, "session_id", "utc_us", "event_id")
    talk = F.col("kind").isin("user/message", "assistant/message")
    linked = last_before(order, "session_id", {"before": (F.lit(True), F.col("seq")), "turn": (talk, F.col("kind"))})
    linked = linked.join(lonely.select("event_id", "lonely"), "event_id", "left")
    linked = cuts.cut(linked.withColumn("ptr", F.when(F.col("lonely"), F.lit(-1)).otherwise(F.col("before"))).select("session_id", "seq", "event_id", "kind", "utc_us", "turn", "ptr"))
    ends, _ = resolve(cuts, linked.select(F.col("seq").alias("id"), "ptr"), closed=True)
    lost = linked.select("session_id", "seq").join(ends.where(~F.col("status").isin("root", "ok")).select(F.col("id").alias("seq")), "seq", "left_semi")
    user, reply = F.col("kind") == "user/message", F.col("kind") == "assistant/message"
    facts = ("n_messages", "n_broken", "n_lost", "n_asked", "n_answered", "n_odd_start")

    def some(df: DataFrame, **given) -> DataFrame:
        return df.select("session_id", *[given.get(f, F.lit(0)).cast("bigint").alias(f) for f in facts])

    one = F.lit(1)
    parts = [
        some(events.where("session_id is not null").select("session_id").distinct()),
        some(rows.where((F.col("kind") != CALL) & ~clear), n_broken=one),
        some(lonely, n_lost=one),
        some(lost, n_lost=one),
        some(linked, n_messages=one, n_asked=user.cast("int"), n_answered=F.coalesce(reply & (F.col("turn") == "user/message"), F.lit(False)).cast("int"), n_odd_start=(F.col("ptr").isNull() & ~user).cast("int")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.groupBy("session_id").agg(*[F.sum(f).alias(f) for f in facts])
    reason = (
        F.when(F.col("n_messages") == 0, "empty").when(F.col("n_broken") > 0, "unreadable").when(F.col("n_odd_start") > 0, "starts without user")
        .when(F.col("n_lost") > 0, "orphan").when(F.col("n_asked") > F.col("n_answered"), "missing reply")
    )
    sessions = cuts.cut(every.select("session_id", "n_messages", reason.isNotNull().alias("dropped"), reason.alias("reason")))
    speaker = F.try_element_at(F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv]), F.col("kind"))
    placed = linked.join(ends.select(F.col("id").alias("seq"), F.col("depth").alias("position")), "seq")
    return sessions, placed.select("session_id", "position", "event_id", speaker.alias("speaker"), "utc_us")


def ordered_messages(sessions: DataFrame, messages: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, position (from 1), speaker, utc_us, content of the kept sessions: of each the path from root to leaf."""
    kept = messages.join(sessions.where("not dropped").select("session_id"), "session_id", "left_semi")
    texts = events.where(_kind().isin(*SPEAKERS)).select("event_id", _content(F.col("data")).alias("content"))
    return kept.join(texts, "event_id").select("session_id", "position", "speaker", "utc_us", "content")
