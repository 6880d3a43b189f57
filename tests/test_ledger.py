"""Ledger rules on small logs, and the replay against a sequential fold."""

import random

import pytest
from pyspark.sql import functions as F

from tunelake.operators import ledger

COLUMNS = (
    "job_id string, tenant string, at_us long, seq long, command string, worker string, fence int, payload string, "
    "ttl_us long, lease_us long, result string, effect string, error string, retryable boolean"
)


def log(spark, rows):
    full = []
    for seq, row in enumerate(rows):
        base = dict(job_id="j", tenant="t", worker=None, fence=None, payload="{}", ttl_us=None, lease_us=None,
                    result=None, effect=None, error=None, retryable=None, seq=seq)
        base.update(row)
        full.append(tuple(base[c.split()[0]] for c in COLUMNS.split(", ")))
    return spark.createDataFrame(full, COLUMNS)


def fold(rows, policy, horizon):
    """Sequential reference: one job's commands in order, lapses at the moment they fall due."""
    state = None

    def lapse(until):
        while state and state["state"] in ("pending", "leased"):
            due = state["lease"] if state["state"] == "leased" else state["deadline"]
            if due > until:
                return
            state["fence"] += 1
            state["worker"] = None
            if due >= state["deadline"]:
                state.update(state="failed", error="deadline", finished=due)
            elif state["attempt"] >= policy.max_attempts:
                state.update(state="failed", error="attempts_exhausted", finished=due)
            else:
                state.update(state="pending", error="lease_expired")

    for r in rows:
        at, command = r["at_us"], r["command"]
        lapse(at)
        if command == "submit":
            if state is None:
                state = dict(state="pending", attempt=0, fence=0, worker=None, lease=None, error=None, finished=None,
                             result=None, deadline=at + (r.get("ttl_us") or policy.ttl_us))
            continue
        if state is None:
            continue
        lease = r.get("lease_us") or policy.lease_us
        own = state["state"] == "leased" and r.get("worker") == state["worker"] and r.get("fence") in (None, state["fence"])
        if command == "claim" and state["state"] == "pending":
            state.update(state="leased", worker=r["worker"], attempt=state["attempt"] + 1, fence=state["fence"] + 1,
                         lease=min(at + lease, state["deadline"]), error=None)
        elif command == "renew" and own:
            state["lease"] = min(at + lease, state["deadline"])
        elif command == "commit" and own:
            state.update(state="succeeded", result=r.get("result"), finished=at)
        elif command == "fail" and own:
            again = r.get("retryable", True) and state["attempt"] < policy.max_attempts
            state.update(state="pending" if again else "failed", worker=None, fence=state["fence"] + 1, error=r.get("error"),
                         finished=None if again else at)
        elif command == "cancel" and state["state"] in ("pending", "leased"):
            state.update(state="cancelled", fence=state["fence"] + 1, finished=at)
    lapse(horizon)
    return state


@pytest.mark.parametrize("hot_rows", [1 << 20, 8])
def test_replay_equals_sequential_fold(spark, hot_rows):
    rng = random.Random(11)
    policy = ledger.ReplayPolicy(ttl_us=400, lease_us=30, max_attempts=3)
    rows, per_job = [], {}
    at = 0
    for _ in range(900):
        at += rng.randrange(0, 4)
        job = "hot" if rng.random() < 0.35 else f"j{rng.randrange(25)}"
        command = rng.choice(["submit", "claim", "claim", "renew", "renew", "commit", "fail", "cancel"][: 7 + (rng.random() < 0.15)])
        row = dict(job_id=job, at_us=at, command=command, worker=rng.choice(["a", "b"]), result=str(rng.randrange(3)), error="e")
        if command in ("renew", "claim"):
            row["lease_us"] = rng.choice([10, 40])
        if command == "fail":
            row["retryable"] = rng.random() < 0.7
        rows.append(row)
        per_job.setdefault(job, []).append(row)
    want = {j: fold(r, policy, at) for j, r in per_job.items()}
    want = {j: s for j, s in want.items() if s}
    jobs, _ = ledger.replay_ledger(log(spark, rows), policy, at, hot_rows)
    got = {r.job_id: r for r in jobs.collect()}
    assert set(got) == set(want)
    for job, s in want.items():
        r = got[job]
        assert (r.state, r.attempt, r.fence, r.finished_us, r.result) == (
            s["state"], s["attempt"], s["fence"], s["finished"], s["result"]
        ), job


def test_expired_lease_makes_first_commit_stale(spark):
    rows = [
        dict(at_us=0, command="submit"),
        dict(at_us=1, command="claim", worker="a", lease_us=2),
        dict(at_us=3, command="claim", worker="b", lease_us=2),
        dict(at_us=3, command="commit", worker="a", fence=1, result="r"),
        dict(at_us=4, command="commit", worker="b", result="r"),
    ]
    jobs, history = ledger.replay_ledger(log(spark, rows), ledger.ReplayPolicy(ttl_us=100, lease_us=2), 10)
    job = jobs.collect()[0]
    assert (job.state, job.attempt, job.worker, job.fence) == ("succeeded", 2, "b", 3)
    text = ledger.job_history(history).collect()[0].history
    assert text == "accepted@0>leased@1>lease_expired@2>leased@3>committed@3"


def test_three_failures_exhaust_a_job(spark):
    rows = [dict(at_us=0, command="submit")]
    for i in range(4):
        rows += [dict(at_us=2 * i + 1, command="claim", worker="a"), dict(at_us=2 * i + 2, command="fail", worker="a", error="e")]
    jobs, _ = ledger.replay_ledger(log(spark, rows), ledger.ReplayPolicy(ttl_us=100, lease_us=50), 50)
    assert [(r.state, r.attempt, r.error) for r in jobs.collect()] == [("failed", 3, "e")]


def test_idempotent_submissions(spark):
    rows = [(1, 0, 0, '{"a": 1}'), (1, 1, 1, '{ "a":1 }'), (1, 2, 2, '{"a": 2}')]
    frame = spark.createDataFrame(rows, "job_id long, at_us long, seq long, payload string")
    frame = frame.withColumn("payload_text", ledger.canonical_payload(F.col("payload")))
    got = ledger.idempotent_submissions(frame).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["accepted", "replay", "conflict"]


def test_admission_counts_active_jobs(spark):
    rows = [("t", i, i, "accepted") for i in range(5)] + [("t", 5, 5, "cancelled"), ("u", 6, 6, "accepted")]
    frame = spark.createDataFrame(rows, "tenant string, at_us long, seq long, kind string")
    got = ledger.admission_audit(ledger.job_activity(frame), 64, 4).orderBy("seq").collect()
    assert [(r.own_active, r.all_active, r.within_limits) for r in got] == [
        (0, 0, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, False), (0, 4, True),
    ]


def test_tool_plans(spark):
    call = "struct<tool: string, a: double, b: double, key: string>"
    rows = [
        (1, [("add", 1.0, 2.0, None)], ["3.0"]),
        (2, [("add", 1.0, 2.0, None)], ["4.0"]),
        (3, [("unsupported", 1.0, 2.0, None)], []),
        (4, [("lookup", None, None, None)], []),
        (5, [("add", float("inf"), 1.0, None)], []),
        (6, [], []),
        (7, [("lookup", None, None, "lease"), ("multiply", 2.0, 4.0, None)], ["temporary ownership", "8.0"]),
        (8, [("add", 1.0, 2.0, None)], ["3"]),
        (9, [("add", 1.0, 2.0, None)], ["3", "4"]),
    ]
    plans = spark.createDataFrame(rows, f"plan_id int, calls array<{call}>, expected array<string>")
    got = {r.plan_id: (r.error, r.task_correct) for r in ledger.evaluate_tool_plans(plans).collect()}
    assert got == {
        1: (None, True), 2: (None, False), 3: ("unknown_tool", None), 4: ("invalid_lookup_key", None),
        5: ("invalid_operand", None), 6: ("invalid_plan", None), 7: (None, True),
        8: (None, True), 9: (None, False),
    }


def test_policy_conflict(spark):
    kinds = "k int, max_active long, tenant_active long, tenant_running long, max_attempts long"
    supplied = spark.createDataFrame([(1, 2, None, None, None), (2, 2, None, None, None), (3, 0, None, None, None)], kinds)
    stored = spark.createDataFrame([(1, 1, 16, 4, 3)], kinds)
    got = {r.k: (r.outcome, r.max_active) for r in ledger.policy_conflicts(supplied, stored, ["k"]).collect()}
    assert got == {1: ("policy_mismatch", 1), 2: ("ok", 2), 3: ("limits must be positive", 0)}


def test_fault_matrix(spark):
    rows = [(kind, state, 1) for kind, state in ledger.FAULT_OUTCOMES.items() for _ in range(32)]
    got = ledger.fault_matrix_summary(spark.createDataFrame(rows, "kind string, state string, effects int")).collect()
    assert sum(r.succeeded for r in got) == 128 and sum(r.failed for r in got) == 64 and sum(r.cancelled for r in got) == 32
    assert sum(r.wrong_terminal for r in got) == 0


def test_ledger_ids_and_payloads(spark):
    row = spark.range(1).select(
        ledger.ledger_job_id(F.lit("t"), F.lit('k"1')).alias("i"), ledger.canonical_payload(F.lit('{"b": 1, "a": [1, 2]}')).alias("p")
    ).collect()[0]
    import hashlib
    import json

    assert row.i == hashlib.sha256(json.dumps(["t", 'k"1'], separators=(",", ":")).encode()).hexdigest()
    assert row.p == '{"a":[1,2],"b":1}'


def test_canonical_text_is_ascii_and_keeps_number_kinds(spark):
    import hashlib
    import json

    texts = ['{"b": "é😀", "a": 1}', '{"a": 1.0}', '{"a":1}', '{"a": 1e2}', '{"a": 100.0}', '{"a": "x, 1.5, \\" 2.5"}', "[1", None]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, payload string")
    got = {r.n: r.p for r in frame.select("n", ledger.canonical_payload(F.col("payload")).alias("p")).collect()}
    for n in (0, 1, 2, 3, 4, 5):
        assert got[n] == json.dumps(json.loads(texts[n]), sort_keys=True, separators=(",", ":"))
    assert got[6] is None and got[7] is None
    job = spark.range(1).select(ledger.ledger_job_id(F.lit("té"), F.lit("k😀")).alias("i")).first().i
    assert job == hashlib.sha256(json.dumps(["té", "k😀"], separators=(",", ":")).encode()).hexdigest()


def test_payload_limit_counts_escapes(spark):
    rows = [("k", '{"a": "' + "é" * n + '"}', 1.0) for n in (5000, 8000)]
    frame = spark.createDataFrame(rows, "request_key string, payload string, ttl_s double")
    assert [r.rejection for r in ledger.submission_checks(frame).collect()] == [None, "payload_limit"]


def test_foreign_tenants_do_not_know_the_job(spark):
    rows = [
        dict(at_us=0, command="submit"),
        dict(at_us=1, command="cancel", tenant="other"),
        dict(at_us=2, command="claim", worker="x", tenant="other"),
        dict(at_us=3, command="claim", worker="a"),
        dict(at_us=4, command="commit", worker="a", tenant="other", result="bad"),
        dict(at_us=5, command="commit", worker="a", result="good"),
    ]
    commands = log(spark, rows)
    jobs, history = ledger.replay_ledger(commands, ledger.ReplayPolicy(ttl_us=100, lease_us=50), 10)
    assert [(r.state, r.result, r.attempt) for r in jobs.collect()] == [("succeeded", "good", 1)]
    found = ledger.cancellations(commands.filter("command = 'cancel'"), history).collect()
    assert [r.outcome for r in found] == ["unknown_job"]


def test_renewals_count_among_many_other_commands(spark):
    rows = [dict(at_us=0, command="submit"), dict(at_us=1, command="claim", worker="a", lease_us=5)]
    rows += [dict(at_us=2, command=f"note{n}") for n in range(80)]
    rows += [dict(at_us=4, command="renew", worker="a", lease_us=20), dict(at_us=15, command="commit", worker="a", result="r")]
    jobs, _ = ledger.replay_ledger(log(spark, rows), ledger.ReplayPolicy(ttl_us=100, lease_us=5), 50)
    assert [r.state for r in jobs.collect()] == ["succeeded"]


def test_commits_need_their_own_fence_tenant_and_a_leased_job(spark):
    leases = spark.createDataFrame(
        [("j", 1, 1, "t", "a", 1, 50, 99), ("j", 10, 2, "t", "a", 3, 50, 99)],
        "job_id string, at_us long, seq long, tenant string, worker string, fence int, lease_until_us long, deadline_us long",
    )
    rows = [
        ("j", 11, 3, "t", "a", 1, "leased", "r"), ("j", 12, 4, "u", "a", 3, "leased", "r"), ("j", 13, 5, "t", "a", 3, "cancelled", "r"),
        ("j", 14, 6, "t", "a", 3, "leased", "r"), ("j", 15, 7, "t", "a", 3, "succeeded", "r"), ("j", 16, 8, "t", "a", 3, "succeeded", "s"),
    ]
    commits = spark.createDataFrame(rows, "job_id string, at_us long, seq long, tenant string, worker string, fence int, state string, result string")
    attached = ledger.attach_lease(commits.withColumn("effect", F.col("result")), leases)
    got = [r.outcome for r in ledger.classify_commits(attached).orderBy("seq").collect()]
    assert got == ["stale", "stale", "stale", "committed", "duplicate", "stale"]


def test_canonical_numbers_without_loss(spark):
    long, other = "1" * 40, "1" * 39 + "2"
    texts = {
        '{"a":1E400}': None,
        '{"a":[0, -1e999]}': None,
        '{"a":%s.5}' % ("9" * 320): None,
        '{"a":"1E400","b":1e308}': '{"a":"1E400","b":1.0E308}',
        '{"a":%s}' % long: '{"a":%s}' % long,
        '{"b": [-%s, "%s"], "a": %s}' % (other, other, long): '{"a":%s,"b":[-%s,"%s"]}' % (long, other, other),
        '{"a":%s}' % ("7" * 320): '{"a":%s}' % ("7" * 320),
        '{"a":0%s}' % long: None,
    }
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, payload string")
    got = {r.n: r.p for r in frame.select("n", ledger.canonical_payload(F.col("payload")).alias("p")).collect()}
    assert [got[n] for n in range(len(texts))] == list(texts.values())
