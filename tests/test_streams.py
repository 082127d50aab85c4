"""Streaming jobs over several files, against the batch operators."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import functions as F

from cloakframe.operators import access as A
from cloakframe.operators import audit as Q
from cloakframe.operators import conversation as C
from cloakframe.session import scratch_path
from cloakframe.streaming import jobs as J
from cloakframe.streaming.stateful import ApprovalMachine

TURNS = [
    (1, 0, "Customer Omar Khan here"), (2, 0, "mail a@x.qa"), (1, 1, "Omar Khan, mail a@x.qa"), (1, 2, "client Sara Costa and Omar Khan"),
    (2, 1, "a@x.qa b@x.qa"), (1, 3, "Sara Costa 28412345678"),
]


def test_chat_state_survives_between_batches(spark):
    folder = scratch_path(spark, "chat-in")
    schema = "conv_id long, turn long, role string, text string"
    for i in range(3):
        rows = [(c, t, "user", text) for c, t, text in TURNS[2 * i : 2 * i + 2]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/talk.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{folder}/talk.parquet")
    got = J.redact_chat(stream, scratch_path(spark, "chat-out"))
    batch = spark.createDataFrame([(c, t, "user", x) for c, t, x in TURNS], schema)
    want = C.redact_conversations(batch)
    pick = ["conv_id", "turn", "redacted", "protected_count"]
    if not got.where("late").isEmpty():
        # Files may be read in any order; then only the vault of each conversation is comparable.
        assert got.count() == want.count()
    else:
        assert sorted(got.select(pick).collect()) == sorted(want.select(pick).collect())


def test_late_turns_are_marked_and_never_dropped(spark):
    folder = scratch_path(spark, "late-in")
    schema = "conv_id long, turn long, role string, text string"
    query_dir = scratch_path(spark, "late-out")

    got = []

    def drain() -> None:
        stream = spark.readStream.schema(schema).parquet(folder)
        got.append(J.redact_chat(stream, query_dir))

    for turns in ([(1, 5, "user", "Customer Omar Khan")], [(1, 2, "user", "Omar Khan"), (1, 6, "user", "Omar Khan")]):
        spark.createDataFrame(turns, schema).coalesce(1).write.mode("append").parquet(folder)
        drain()
    found = {r["turn"]: (r["redacted"], r["late"]) for r in got[-1].collect()}
    assert found == {5: ("Customer [NAME_1]", False), 2: ("[NAME_1]", True), 6: ("[NAME_1]", False)}


def test_lockout_stream_equals_the_trailing_window(spark):
    folder = scratch_path(spark, "attempts")
    start = datetime.datetime(2024, 1, 1)
    seconds = {"a": [30, 200, 400, 600, 915, 916, 3000], "b": [0, 300, 600, 901, 1800], None: [1, 2, 3, 4, 5, 6]}
    rows = [(ip, 0, start + datetime.timedelta(seconds=s)) for ip, times in seconds.items() for s in times]
    rows += [("a", 1, start + datetime.timedelta(seconds=s)) for s in range(10)]
    spark.createDataFrame(rows, "ip string, success int, at timestamp").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("ip string, success int, at timestamp").parquet(folder)
    got = J.run_available(J.lockout_alerts(stream), "alerts")
    found = {(r["ip"], (r["locked_at"] - start).total_seconds(), (r["since"] - start).total_seconds()) for r in got.collect()}
    assert found == {("a", 915, 30), ("a", 916, 200)}


DAY = datetime.datetime(2024, 1, 1)


def at(hours: float) -> datetime.datetime:
    return DAY + datetime.timedelta(hours=hours)


def test_sessions_end_by_access_or_timer_alike(spark):
    """Three micro-batches and one say the same as the batch operator; a limit holds to the microsecond."""
    tick = datetime.timedelta(microseconds=1)
    sessions = [("idle", at(0), at(0), None, None), ("edge", at(0), at(0), None, None), ("hard", at(0), at(0), at(8), None), ("out", at(0), at(0), None, at(5)),
                ("quiet", at(0), at(0), at(30), None), ("open", at(0), at(60), None, None)]
    accesses = [(1, "idle", at(10)), (2, "edge", at(20)), (3, "hard", at(8)), (4, "out", at(4)), (5, "none", at(1)), (6, None, at(2)),
                (7, "idle", at(34) + tick), (8, "edge", at(44)), (9, "hard", at(8) + tick), (10, "out", at(5)), (11, "idle", at(34.5)),
                (12, "edge", at(68) + tick), (13, "open", at(70)), (14, "hard", at(70)), (15, "edge", at(71)), (16, "idle", at(72)), (17, "idle", at(72))]
    accesses.sort(key=lambda a: (a[2], a[0]))
    held = spark.createDataFrame([(t, c, s, e, r, "admin") for t, c, s, e, r in sessions],
                                 "token string, created_at timestamp, last_seen_at timestamp, expires_at timestamp, revoked_at timestamp, role string")
    schema = "event_id long, token string, seen_at timestamp"
    batch = A.access_validity(spark.createDataFrame(accesses, schema), held)
    want = sorted((r.event_id, r.state) for r in batch.collect())
    ends = None
    for cuts in ([17], [6, 12, 17]):
        folder, out = scratch_path(spark, "accesses"), scratch_path(spark, "sessions")
        done = 0
        for cut in cuts:  # each call goes on where the one before stopped
            spark.createDataFrame(accesses[done:cut], schema).coalesce(1).write.mode("append").parquet(folder)
            got = J.run_available(J.session_states(spark.readStream.schema(schema).parquet(folder), held, "0 seconds"), "states", folder=out).collect()
            done = cut
        assert sorted((r.event_id, r.state) for r in got if r.kind == "access") == want
        found = sorted((r.token, r.at, r.state) for r in got if r.kind == "end")
        assert ends in (None, found)
        ends = found
    assert ends == [("edge", at(68) + tick, "idle"), ("hard", at(8) + tick, "expired"), ("idle", at(34) + tick, "idle"), ("out", at(5), "revoked"),
                    ("quiet", at(24) + tick, "idle")]


LEDGER = "id long, created_at timestamp, status string, reason string, prompt_redacted string"
DECISION = "request_id long, decision_id long, decided_at timestamp, verdict string, approver string, notes string"


def test_a_request_is_settled_once(spark):
    asked, made, out = (scratch_path(spark, n) for n in ("asked", "made", "approvals"))
    steps = [
        ([(1, at(0), "pending", "why", "text [NAME_1]"), (2, at(1), "completed", "fine", "x")], [(3, 30, at(2), "approve", "lead", None), (9, 90, at(2), "approve", "lead", None)]),
        ([(3, at(1.5), "pending", "late", "y"), (4, at(3), "pending", "open", "z")], [(1, 12, at(4), "reject", "lead", ""), (1, 11, at(4), "approve", "first", None), (2, 20, at(4), "approve", "lead", None)]),
        ([(3, at(1.5), "pending", "again", "y")], [(1, 13, at(5), "approve", "lead", None), (3, 31, at(6), "reject", "second", "no")]),
    ]
    for requests, decisions in steps:
        spark.createDataFrame(requests, LEDGER).coalesce(1).write.mode("append").parquet(asked)
        spark.createDataFrame(decisions, DECISION).coalesce(1).write.mode("append").parquet(made)
        events = J.approval_events(spark.readStream.schema(LEDGER).parquet(asked), spark.readStream.schema(DECISION).parquet(made), "2 hours")
        rows = J.run_available(events, "events", folder=out)
    got = {r.decision_id: (r.ok, r.error, r.status, r.approver, r.reason) for r in rows.where("kind = 'decided'").collect()}
    settled = lambda s: f"Request is '{s}', not pending"
    assert got == {
        11: (True, None, "completed", "first", "why"), 12: (False, settled("completed"), "completed", None, "why"), 13: (False, settled("completed"), "completed", None, "why"),
        20: (False, settled("completed"), "completed", None, "fine"), 30: (True, None, "completed", "lead", "late"), 31: (False, settled("completed"), "completed", None, "late"),
        90: (False, "Request not found", None, None, None)}
    assert sorted((r.request_id, r.status) for r in rows.where("kind = 'opened'").collect()) == [(1, "pending"), (2, "completed"), (3, "pending"), (4, "pending")]
    assert [(r.request_id, r.opened_at) for r in J.open_requests(rows).collect()] == [(4, at(3))]
    reply = rows.where("decision_id = 11").first()
    assert reply.output_redacted and reply.provider and reply.model


class Store:
    """A state store that counts visits."""

    def __init__(self):
        self.lists, self.timers, self.visits = {}, set(), 0

    def getListState(self, name, schema):
        store, rows = self, self.lists.setdefault(name, [])

        class List:
            def exists(self):
                store.visits += 1
                return bool(rows)

            def get(self):
                store.visits += 1
                return iter(list(rows))

            def put(self, new):
                store.visits += 1
                rows[:] = new

            def clear(self):
                store.visits += 1
                rows.clear()

        return List()

    def registerTimer(self, moment):
        self.timers.add(moment)


def test_a_block_of_requests_is_settled_request_by_request_in_few_visits():
    machine, store = ApprovalMachine(), Store()
    machine.init(store)
    fields = ["request_id", "at_us", "decision_id", "verdict", "approver", "notes", "status", "reason", "reply"]
    asked = [(i, 1000, None, None, None, None, "pending", "why", f"text {i}") for i in range(200)]
    made = [(i, 3000 + n, 4 * i + n, "reject" if i % 2 else "approve", "lead", None, None, None, None) for i in range(50, 256) for n in range(2)]
    [told] = machine.handleInputRows((0,), iter([pd.DataFrame(asked + made, columns=fields)]), None)
    assert (told["kind"] == "opened").sum() == 200 and told["ok"].eq(True).sum() == 150 and (told["kind"] == "decided").sum() == 300
    assert set(told.loc[told["ok"].eq(True), "output_redacted"].dropna()) == {f"text {i}" for i in range(50, 200, 2)}
    assert store.visits <= 8 and store.timers == {4}
    # A request that comes now finds what waited for it; the others are refused when the watermark has passed them.
    [late] = machine.handleInputRows((0,), iter([pd.DataFrame([(200, 900, None, None, None, None, "pending", "why", "late")], columns=fields)]), None)
    assert late["ok"].tolist() == [None, True, False]

    class Passed:
        def getExpiryTimeInMs(self):
            return 4

    [over] = machine.handleExpiredTimer((0,), None, Passed())
    assert set(over["request_id"]) == set(range(201, 256)) and set(over["error"]) == {"Request not found"} and len(over) == 110
    assert not store.lists["waiting"] and len(store.lists["requests"]) == 201


def test_a_table_stored_as_a_folder_of_parts_is_streamed(spark):
    folder = scratch_path(spark, "parts-in")
    rows = [(i, f"text {i}") for i in range(20)]
    spark.createDataFrame(rows, "id long, text string").repartition(3).write.parquet(f"{folder}/talk.parquet")
    got = J.run_available(J.read_stream(spark, folder, "talk"), "parts-out")
    assert sorted(map(tuple, got.collect())) == rows


def test_activity_snapshots_go_on_and_repeat(spark):
    source, folder = scratch_path(spark, "log"), scratch_path(spark, "activity")
    schema = "action string, created_at timestamp"
    log = [("a", at(1)), ("b", at(2)), ("a", at(30)), (None, at(31)), ("a", at(31)), (None, at(32)), ("b", at(47.5)), ("a", at(47.6))]
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(source)
    for cut in (3, 5, 8):
        spark.createDataFrame(log[{3: 0, 5: 3, 8: 5}[cut] : cut], schema).coalesce(1).write.mode("append").parquet(source)
        got = J.activity_snapshots(read(), folder)
        want = spark.createDataFrame(log[:cut], schema).groupBy(F.date_trunc("day", "created_at").alias("window_start"), "action").agg(F.count("*").alias("n"))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    again = J.activity_snapshots(read(), folder)  # nothing new: the same snapshot
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)
    summary = {r.action: r.n for r in Q.summarise_audit(spark.createDataFrame(log, schema), Q.AuditFilter()).collect()}
    assert {r.action: r.n for r in got.groupBy("action").agg(F.sum("n").alias("n")).collect()} == summary
