"""Ledger queries. The twin of the replay folds the log one command per step in recursive SQL."""

from pyspark.sql import functions as F

from checks.base import check
from tunelake.operators import ledger as g

LV = "ledger_view"
DAY = 86_400_000_000
TTL, LEASE = 12 * DAY, 2 * DAY
HORIZON = 1_706_745_600_000_000
POLICY = g.ReplayPolicy(ttl_us=TTL, lease_us=LEASE, max_attempts=3)
ID_SQL = "sha256(concat('[\"', tenant, '\",\"', request_key, '\"]'))"
TEXT_SQL = "replace(payload, ' ', '')"
LOG_SQL = f"lg AS (SELECT *, {ID_SQL} AS job_id, {TEXT_SQL} AS payload_text, CASE WHEN seq % 2 = 0 THEN 'worker9' ELSE worker END AS by_worker FROM ledger_view)"


def log(s):
    rows = s.view(LV)
    return (
        rows.withColumn("job_id", g.ledger_job_id(F.col("tenant"), F.col("request_key")))
        .withColumn("payload_text", g.canonical_payload(F.col("payload")))
    )


@check(
    "ledger_job_id",
    "seq:long job_id:str payload_text:str payload_bytes:int",
    f"SELECT seq, {ID_SQL} AS job_id, {TEXT_SQL} AS payload_text, strlen({TEXT_SQL}) AS payload_bytes FROM ledger_view",
    LV,
)
def _(s):
    return log(s).withColumn("payload_bytes", F.octet_length("payload_text"))


@check(
    "submission_checks",
    "seq:long rejection:str",
    """
SELECT seq, CASE WHEN seq % 11 = 0 THEN 'invalid_request_key' WHEN seq % 7 = 0 THEN 'invalid_submission' WHEN seq % 5 = 0 THEN 'invalid_submission'
       WHEN seq % 3 = 0 THEN 'payload_limit' END AS rejection FROM ledger_view WHERE command = 'submit'
""",
    LV,
)
def _(s):
    seq = F.col("seq")
    big = F.concat(F.lit('{"k": "'), F.repeat(F.lit("é"), 8000), F.lit('"}'))
    rows = s.view(LV).filter("command = 'submit'").select(
        "seq",
        F.when(seq % 11 == 0, F.repeat(F.lit("k"), 257)).otherwise(F.col("request_key")).alias("request_key"),
        F.when(seq % 7 == 0, "[1]").when(seq % 3 == 0, big).otherwise(F.col("payload")).alias("payload"),
        F.when(seq % 5 == 0, float("nan")).otherwise(60.0).alias("ttl_s"),
    )
    return g.submission_checks(rows)


@check(
    "idempotent_submissions",
    "seq:long job_id:str outcome:str",
    f"""
WITH {LOG_SQL}, f AS (SELECT *, first_value(seq) OVER w AS fs, first_value(payload_text) OVER w AS fp FROM lg WHERE command = 'submit'
                      WINDOW w AS (PARTITION BY job_id ORDER BY at_us, seq))
SELECT seq, job_id, CASE WHEN seq = fs THEN 'accepted' WHEN payload_text = fp THEN 'replay' ELSE 'conflict' END AS outcome FROM f
""",
    LV,
)
def _(s):
    return g.idempotent_submissions(log(s).filter("command = 'submit'"))


# One command at a time per job: the state after command n from the state after command n - 1.
REPLAY_SQL = f"""{LOG_SQL},
     fs AS (SELECT job_id, min_by(seq, (at_us, seq)) AS fseq, min((at_us, seq)) AS pos FROM lg WHERE command = 'submit' GROUP BY job_id),
     cm AS (SELECT lg.job_id, lg.at_us, lg.seq, lg.command, lg.worker, lg.by_worker, lg.tenant,
                   row_number() OVER (PARTITION BY lg.job_id ORDER BY lg.at_us, lg.seq) AS n
              FROM lg JOIN fs ON fs.job_id = lg.job_id AND (lg.at_us, lg.seq) >= fs.pos),
     ct AS (SELECT job_id, max(n) AS last FROM cm GROUP BY job_id),
     al AS (SELECT job_id, at_us, seq, command, worker, by_worker, tenant, n FROM cm
            UNION ALL SELECT job_id, {HORIZON}, 1000000000000, 'end', '', '', '', last + 1 FROM ct
            UNION ALL SELECT job_id, {HORIZON}, 1000000000001, 'end', '', '', '', last + 2 FROM ct),
     st_rec AS (
       SELECT job_id, tenant, n, CAST('pending' AS VARCHAR) AS state, 0 AS attempt, 0 AS fence, CAST(NULL AS VARCHAR) AS holder, CAST(NULL AS BIGINT) AS until_us,
              at_us + {TTL} AS deadline_us, at_us AS created_us, CAST(NULL AS BIGINT) AS finished_us, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS BIGINT) AS leased_us,
              CAST('accepted@0' AS VARCHAR) AS history, CAST(NULL AS BIGINT) AS commit_seq, CAST(NULL AS BIGINT) AS cancel_seq, 0 AS lapses FROM cm WHERE n = 1
       UNION ALL
       SELECT job_id, tenant, n, CASE act WHEN 'claim' THEN 'leased' WHEN 'commit' THEN 'succeeded' WHEN 'cancel' THEN 'cancelled'
                WHEN 'fail' THEN CASE WHEN attempt < 3 THEN 'pending' ELSE 'failed' END ELSE state END,
              attempt + CASE WHEN act = 'claim' THEN 1 ELSE 0 END, fence + CASE WHEN act IN ('claim', 'cancel', 'fail') THEN 1 ELSE 0 END,
              CASE WHEN act = 'claim' THEN by_worker WHEN act = 'fail' THEN NULL ELSE holder END,
              CASE WHEN act = 'claim' THEN least(at_us + {LEASE}, deadline_us) WHEN act = 'fail' THEN NULL ELSE until_us END,
              deadline_us, created_us, CASE WHEN act IN ('commit', 'cancel') OR (act = 'fail' AND attempt >= 3) THEN at_us ELSE finished_us END,
              CASE WHEN act = 'claim' THEN NULL WHEN act = 'fail' THEN 'err' ELSE error END,
              CASE WHEN act = 'claim' AND leased_us IS NULL THEN at_us ELSE leased_us END,
              history || CASE act WHEN 'claim' THEN '>leased@' || (fence + 1) WHEN 'commit' THEN '>committed@' || fence WHEN 'cancel' THEN '>cancelled@' || (fence + 1)
                WHEN 'fail' THEN CASE WHEN attempt < 3 THEN '>retry@' ELSE '>failed@' END || (fence + 1) ELSE '' END,
              CASE WHEN act = 'commit' THEN seq ELSE commit_seq END, CASE WHEN act = 'cancel' THEN seq ELSE cancel_seq END, lapses
         FROM (SELECT *, CASE WHEN state = 'pending' AND command = 'claim' THEN 'claim' WHEN state IN ('pending', 'leased') AND command = 'cancel' THEN 'cancel'
                              WHEN state = 'leased' AND command = 'commit' AND by_worker = holder THEN 'commit'
                              WHEN state = 'leased' AND command = 'fail' AND by_worker = holder THEN 'fail' ELSE '' END AS act
                 FROM (SELECT job_id, tenant, n, at_us, seq, command, by_worker, deadline_us, created_us, attempt, leased_us, commit_seq, cancel_seq,
                              CASE WHEN lapse IN ('deadline', 'attempts_exhausted') THEN 'failed' WHEN lapse = 'lease_expired' THEN 'pending' ELSE state END AS state,
                              fence + CASE WHEN lapse = '' THEN 0 ELSE 1 END AS fence, CASE WHEN lapse = '' THEN holder END AS holder, CASE WHEN lapse = '' THEN until_us END AS until_us,
                              CASE WHEN lapse = 'deadline' THEN deadline_us WHEN lapse = 'attempts_exhausted' THEN until_us ELSE finished_us END AS finished_us,
                              CASE WHEN lapse = '' THEN error ELSE lapse END AS error,
                              history || CASE WHEN lapse = '' THEN '' ELSE '>' || lapse || '@' || (fence + 1) END AS history, lapses + CASE WHEN lapse = 'lease_expired' THEN 1 ELSE 0 END AS lapses
                         FROM (SELECT s.* EXCLUDE (n, tenant), s.tenant, c.n, c.at_us, c.seq, c.command, c.by_worker,
                                      CASE WHEN s.state = 'pending' AND s.deadline_us <= c.at_us THEN 'deadline'
                                           WHEN s.state = 'leased' AND s.until_us <= c.at_us AND s.until_us >= s.deadline_us THEN 'deadline'
                                           WHEN s.state = 'leased' AND s.until_us <= c.at_us AND s.attempt >= 3 THEN 'attempts_exhausted'
                                           WHEN s.state = 'leased' AND s.until_us <= c.at_us THEN 'lease_expired' ELSE '' END AS lapse
                                 FROM st_rec s JOIN al c ON c.job_id = s.job_id AND c.n = s.n + 1) AS q1) AS q2) AS q3
     ),
     fin AS (SELECT r.* FROM st_rec r JOIN ct ON ct.job_id = r.job_id AND r.n = ct.last + 2)"""
# A lease that lapses before a pending job's deadline needs a second look when both passed
# between two commands, hence the two closing rows; in between, a lapse is followed by the
# deadline only at the next command.


def commands(s):
    worker = F.when(F.col("seq") % 2 == 0, "worker9").otherwise(F.col("worker"))
    return log(s).select(
        "job_id", "tenant", "at_us", "seq", "command", worker.alias("worker"), F.col("payload_text").alias("payload"),
        F.col("payload_text").alias("result"), F.col("payload_text").alias("effect"), F.lit("err").alias("error"),
    )


def replay(s):
    return g.replay_ledger(commands(s), POLICY, HORIZON)


@check(
    "replay_ledger",
    "job_id:str tenant:str state:str attempt:int fence:int finished_us:long error:str result:str",
    f"""WITH {REPLAY_SQL}
SELECT fin.job_id, fin.tenant, state, attempt, fence, finished_us, error, lg.payload_text AS result FROM fin LEFT JOIN lg ON lg.seq = fin.commit_seq""",
    LV,
)
def _(s):
    return replay(s)[0]


@check("job_history", "job_id:str history:str", f"WITH {REPLAY_SQL}\nSELECT job_id, history FROM fin", LV)
def _(s):
    return g.job_history(replay(s)[1])


EVENTS_SQL = f"""{LOG_SQL},
     fa AS (SELECT job_id, tenant, min((at_us, seq)) AS p FROM lg WHERE command = 'submit' GROUP BY ALL),
     fe AS (SELECT lg.job_id, lg.tenant, min((lg.at_us, lg.seq)) AS p FROM lg JOIN fa ON fa.job_id = lg.job_id
             WHERE lg.command IN ('commit', 'cancel') AND (lg.at_us, lg.seq) > fa.p GROUP BY ALL),
     ac AS (SELECT job_id, tenant, p[1] AS at_us, p[2] AS seq, 1 AS delta FROM fa UNION ALL SELECT job_id, tenant, p[1], p[2], -1 FROM fe)"""


@check(
    "admission_audit",
    "job_id:str own_active:long all_active:long within_limits:bool",
    f"""WITH {EVENTS_SQL}, r AS (SELECT *, coalesce(sum(delta) OVER (PARTITION BY tenant ORDER BY at_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own_active,
               coalesce(sum(delta) OVER (ORDER BY at_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS all_active FROM ac)
SELECT *, all_active < 64 AND own_active < 16 AS within_limits FROM r WHERE delta > 0""",
    LV,
)
def _(s):
    rows = log(s)
    first = rows.filter("command = 'submit'").groupBy("job_id", "tenant").agg(F.min(F.struct("at_us", "seq")).alias("p"))
    ends = rows.filter("command IN ('commit', 'cancel')").join(first.select("job_id", F.col("p").alias("f")), "job_id")
    ends = ends.filter(F.struct("at_us", "seq") > F.col("f")).groupBy("job_id", "tenant").agg(F.min(F.struct("at_us", "seq")).alias("p"))
    history = first.withColumn("kind", F.lit("accepted")).unionByName(ends.withColumn("kind", F.lit("committed")))
    return g.admission_audit(g.job_activity(history.select("job_id", "tenant", "kind", "p.*")))


SNAP_SQL = f"""{LOG_SQL},
     sn AS (SELECT job_id, tenant, max_by(seq, (at_us, seq)) AS seq, min(at_us) AS created_us, count(*) FILTER (command = 'claim') % 4 AS attempt,
                   max_by(command, (at_us, seq)) AS lastc, max(at_us) AS at_us FROM lg GROUP BY ALL),
     jb AS (SELECT *, CASE WHEN lastc IN ('submit', 'fail') THEN 'pending' WHEN lastc = 'claim' THEN 'leased' WHEN lastc = 'commit' THEN 'succeeded' ELSE 'cancelled' END AS state,
                   attempt AS fence, at_us + {2 * DAY} AS lease_until_us, at_us + {DAY} * (2 + seq % 3) AS deadline_us FROM sn)"""


def snapshot(s):
    rows = log(s)
    last = rows.groupBy("job_id", "tenant").agg(
        F.max(F.struct("at_us", "seq", "command")).alias("l"), F.min("at_us").alias("created_us"),
        (F.count_if(F.col("command") == "claim") % 4).cast("int").alias("attempt"),
    )
    state = (
        F.when(F.col("l.command").isin("submit", "fail"), "pending").when(F.col("l.command") == "claim", "leased")
        .when(F.col("l.command") == "commit", "succeeded").otherwise("cancelled")
    )
    at = F.col("l.at_us")
    none = F.lit(None)
    return last.select(
        "job_id", "tenant", "created_us", "attempt", state.alias("state"), F.col("attempt").alias("fence"),
        F.lit("w").alias("worker"), (at + 2 * DAY).alias("lease_until_us"),
        (at + (2 + F.col("l.seq") % 3) * DAY).alias("deadline_us"), none.cast("string").alias("error"), none.cast("long").alias("finished_us"),
    )


@check(
    "claim_order",
    "tenant:str job_id:str claim_rank:long",
    f"""WITH {SNAP_SQL}, b AS (SELECT tenant, count(*) FILTER (state = 'leased') AS r FROM jb GROUP BY tenant),
     p AS (SELECT tenant, job_id, row_number() OVER (PARTITION BY tenant ORDER BY created_us, job_id) AS claim_rank FROM jb WHERE state = 'pending' AND substr(job_id, 1, 1) < 'c')
SELECT p.* FROM p JOIN b USING (tenant) WHERE claim_rank <= 12 - r""",
    LV,
)
def _(s):
    jobs = snapshot(s)
    return g.claim_order(jobs, jobs.filter("substr(job_id, 1, 1) < 'c'"), 12)


AS_OF = 1_706_745_600_000_000 - 2 * DAY


@check(
    "expire_as_of",
    "job_id:str state:str fence:int error:str finished_us:long",
    f"""WITH {SNAP_SQL}, x AS (SELECT *, state IN ('pending', 'leased') AND deadline_us <= {AS_OF} AS dl, state = 'leased' AND lease_until_us <= {AS_OF} AS lp FROM jb)
SELECT job_id, CASE WHEN dl OR (lp AND attempt >= 3) THEN 'failed' WHEN lp THEN 'pending' ELSE state END AS state,
       fence + CASE WHEN dl OR lp THEN 1 ELSE 0 END AS fence, CASE WHEN dl THEN 'deadline' WHEN lp AND attempt >= 3 THEN 'attempts_exhausted' WHEN lp THEN 'lease_expired' END AS error,
       CASE WHEN dl OR (lp AND attempt >= 3) THEN {AS_OF} END AS finished_us FROM x""",
    LV,
)
def _(s):
    return g.expire_as_of(snapshot(s), AS_OF)


COMMITS_SQL = f"""{LOG_SQL},
     no AS (SELECT job_id, min((at_us, seq)) AS cancelled FROM lg WHERE command = 'cancel' GROUP BY job_id),
     ls AS (SELECT job_id, at_us, seq, tenant AS lease_tenant, by_worker AS lease_worker, at_us + {LEASE} AS lease_until_us, at_us + {DAY} + seq % 5 * {DAY} AS deadline_us,
                   row_number() OVER (PARTITION BY job_id ORDER BY at_us, seq) AS fence FROM lg WHERE command = 'claim'),
     cl AS (SELECT c.job_id, c.at_us, c.seq, c.by_worker AS worker, c.payload_text AS result, l.fence AS lease_fence,
                   CASE WHEN c.seq % 7 = 0 THEN 'intruder' ELSE c.tenant END AS tenant, l.fence - CASE WHEN c.seq % 5 = 0 THEN 1 ELSE 0 END AS fence,
                   no.cancelled IS NOT NULL AND no.cancelled < (c.at_us, c.seq) AS gone, l.lease_tenant, l.lease_worker, l.lease_until_us, l.deadline_us
              FROM lg c ASOF LEFT JOIN ls l ON l.job_id = c.job_id AND c.at_us >= l.at_us LEFT JOIN no ON no.job_id = c.job_id WHERE c.command = 'commit'),
     cv AS (SELECT *, coalesce(tenant = lease_tenant AND fence = lease_fence AND NOT gone AND worker = lease_worker AND at_us < lease_until_us AND at_us < deadline_us, false) AS valid FROM cl),
     cw AS (SELECT job_id, min_by(seq, (at_us, seq)) AS ws, min((at_us, seq)) AS wp, min_by(fence, (at_us, seq)) AS wf, min_by(worker, (at_us, seq)) AS ww, min_by(tenant, (at_us, seq)) AS wt, min_by(result, (at_us, seq)) AS wr FROM cv WHERE valid GROUP BY job_id),
     co AS (SELECT cv.*, CASE WHEN seq = ws THEN 'committed' WHEN ws IS NOT NULL AND (at_us, seq) > wp AND fence = wf AND tenant = wt AND worker = ww AND result = wr THEN 'duplicate' ELSE 'stale' END AS outcome
              FROM cv LEFT JOIN cw USING (job_id))"""


def commits(s):
    rows = log(s)
    worker = F.when(F.col("seq") % 2 == 0, "worker9").otherwise(F.col("worker"))
    from tunelake.operators.scans import running, total

    claims = running(
        rows.filter("command = 'claim'").withColumn("worker", worker), ["job_id"], ["at_us", "seq"], g.hour(F.col("at_us")),
        {"fence": total(F.lit(1).cast("long"))},
    ).select(
        "job_id", "at_us", "seq", "tenant", "fence", "worker", (F.col("at_us") + LEASE).alias("lease_until_us"),
        (F.col("at_us") + DAY + F.col("seq") % 5 * DAY).alias("deadline_us"),
    )
    seq = F.col("seq")
    ends = rows.filter("command = 'cancel'").groupBy("job_id").agg(F.min(F.struct("at_us", "seq")).alias("cancelled"))
    done = rows.filter("command = 'commit'").join(ends, "job_id", "left")
    gone = F.coalesce(F.col("cancelled") < F.struct("at_us", "seq"), F.lit(False))
    done = done.select(
        "job_id", "at_us", "seq", F.when(seq % 7 == 0, "intruder").otherwise(F.col("tenant")).alias("tenant"), worker.alias("worker"),
        F.col("payload_text").alias("result"), F.col("payload_text").alias("effect"), F.when(gone, "cancelled").otherwise("leased").alias("state"),
    )
    # Every fifth commit still holds the fence of the lease before.
    return g.attach_lease(done, claims).withColumn("fence", F.col("lease_fence") - (seq % 5 == 0).cast("int"))


@check("classify_commits", "job_id:str seq:long fence:long outcome:str", f"WITH {COMMITS_SQL}\nSELECT * FROM co", LV)
def _(s):
    return g.classify_commits(commits(s))


@check(
    "effects_once",
    "job_id:str effect:str effects:long",
    f"WITH {COMMITS_SQL}\nSELECT job_id, result AS effect, 1 AS effects FROM co WHERE outcome = 'committed'",
    LV,
)
def _(s):
    return g.effects_once(g.classify_commits(commits(s)))


@check(
    "lease_renewals",
    "job_id:str seq:long renewed:bool new_until_us:long",
    f"""WITH {LOG_SQL},
     rn AS (SELECT job_id, at_us, seq, (at_us // {10 * DAY}) AS fence, least(at_us + {3 * DAY}, (at_us // {10 * DAY}) * {10 * DAY} + {9 * DAY}) AS until_us,
                   (at_us // {10 * DAY}) * {10 * DAY} + {9 * DAY} AS deadline_us, (at_us // {10 * DAY}) * {10 * DAY} + {4 * DAY} AS claim_until FROM lg WHERE command = 'claim'),
     pv AS (SELECT *, coalesce(lag(until_us) OVER (PARTITION BY job_id, fence ORDER BY at_us, seq), claim_until) AS before FROM rn),
     bk AS (SELECT *, bool_or(at_us >= before OR at_us >= deadline_us) OVER (PARTITION BY job_id, fence ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING) AS broken FROM pv)
SELECT job_id, seq, NOT broken AS renewed, CASE WHEN NOT broken THEN until_us END AS new_until_us FROM bk""",
    LV,
)
def _(s):
    term = F.floor(F.col("at_us") / (10 * DAY)).cast("long")
    rows = log(s).filter("command = 'claim'").select("job_id", "at_us", "seq", term.alias("fence"), F.lit(3 * DAY).alias("lease_us"))
    base = F.col("fence") * (10 * DAY)
    return g.lease_renewals(
        rows.withColumn("deadline_us", base + 9 * DAY).withColumn("claim_until_us", base + 4 * DAY)
    )


@check(
    "retry_outcomes",
    "seq:long new_state:str new_fence:int",
    "SELECT seq, CASE WHEN seq % 3 <> 0 AND seq % 5 < 3 THEN 'pending' ELSE 'failed' END AS new_state, seq % 4 + 1 AS new_fence FROM ledger_view WHERE command = 'fail'",
    LV,
)
def _(s):
    failures = s.view(LV).filter("command = 'fail'").select(
        "seq", (F.col("seq") % 3 != 0).alias("retryable"), (F.col("seq") % 5).alias("attempt"), (F.col("seq") % 4).alias("fence")
    )
    return g.retry_outcomes(failures)


@check(
    "cancellations",
    "job_id:str seq:long outcome:str",
    f"""WITH {REPLAY_SQL},
     cn AS (SELECT lg.job_id, lg.seq, lg.at_us, r.state, r.cancel_seq, fs.pos FROM lg LEFT JOIN fs ON fs.job_id = lg.job_id LEFT JOIN cm ON cm.job_id = lg.job_id AND cm.seq = lg.seq
              LEFT JOIN st_rec r ON r.job_id = cm.job_id AND r.n = cm.n WHERE lg.command = 'cancel')
SELECT job_id, seq, CASE WHEN seq % 3 = 0 OR pos IS NULL OR (at_us, seq) < pos THEN 'unknown_job' WHEN cancel_seq = seq THEN 'cancelled' ELSE 'already_ended' END AS outcome FROM cn""",
    LV,
)
def _(s):
    tenant = F.when(F.col("seq") % 3 == 0, "intruder").otherwise(F.col("tenant"))
    cancels = log(s).filter("command = 'cancel'").select("job_id", tenant.alias("tenant"), "seq", "at_us")
    return g.cancellations(cancels, replay(s)[1])


@check(
    "policy_conflicts",
    "key:long outcome:str max_active:long tenant_active:long tenant_running:long max_attempts:long",
    """
WITH x AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 END AS a, CASE WHEN c_custkey % 4 = 0 THEN 16 END AS t, c_custkey % 2 = 0 AS known FROM customer)
SELECT key, CASE WHEN a <= 0 THEN 'limits must be positive' WHEN known AND ((a IS NOT NULL AND a <> 3) OR (t IS NOT NULL AND t <> 8)) THEN 'policy_mismatch' ELSE 'ok' END AS outcome,
       CASE WHEN known THEN 3 ELSE coalesce(a, 64) END AS max_active, CASE WHEN known THEN 8 ELSE coalesce(t, 16) END AS tenant_active,
       CASE WHEN known THEN 2 ELSE 4 END AS tenant_running, 3 AS max_attempts FROM x
""",
)
def _(s):
    key = F.col("c_custkey")
    none = F.lit(None).cast("long")
    rows = s.table("customer")
    supplied = rows.select(
        key.alias("key"), F.when(key % 3 == 0, key % 5).alias("max_active"), F.when(key % 4 == 0, F.lit(16)).cast("long").alias("tenant_active"),
        none.alias("tenant_running"), none.alias("max_attempts"),
    )
    stored = rows.filter(key % 2 == 0).select(
        key.alias("key"), F.lit(3).alias("max_active"), F.lit(8).alias("tenant_active"), F.lit(2).alias("tenant_running"), F.lit(3).alias("max_attempts")
    )
    return g.policy_conflicts(supplied, stored, ["key"])


PLAN_SQL = """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY call_no, a, b, lookup_key, tool) AS turn,
                  CASE WHEN tool = 'unsupported' THEN 'unknown_tool' WHEN tool = 'lookup' AND lookup_key = 'other' THEN 'missing_fixture' END AS problem,
                  CASE WHEN tool = 'lookup' THEN CASE lookup_key WHEN 'lease' THEN 'temporary ownership' ELSE 'stale-writer rejection' END
                       WHEN tool = 'add' THEN CAST(a + b AS VARCHAR) ELSE CAST(a * b AS VARCHAR) END AS answer FROM plans_view),
     p AS (SELECT plan_id, count(*) AS n, min_by(problem, turn) FILTER (problem IS NOT NULL) AS problem, list(answer ORDER BY turn) AS answers,
                  bool_and(tool = 'add' AND b = 0) AS plain FROM c GROUP BY plan_id)
SELECT plan_id, CASE WHEN n > 16 THEN 'invalid_plan' ELSE problem END AS error,
       CASE WHEN n <= 16 AND problem IS NULL THEN len(answers) END AS n_answers,
       CASE WHEN n <= 16 AND problem IS NULL THEN len(list_filter(answers, lambda x: x LIKE '%i%')) END AS lookups,
       CASE WHEN n <= 16 AND problem IS NULL THEN answers[1] = 'temporary ownership' AND n = 1 END AS task_correct FROM p
"""


@check("evaluate_tool_plans", "plan_id:long error:str n_answers:long lookups:long task_correct:bool", PLAN_SQL, "plans_view")
def _(s):
    calls = s.view("plans_view").withColumnRenamed("lookup_key", "key")
    plans = g.gather_plans(calls).withColumn("expected", F.array(F.lit("temporary ownership")))
    done = g.evaluate_tool_plans(plans)
    texts = F.filter("answers", lambda a: a.like("%i%"))
    return done.withColumn("n_answers", F.when(F.col("error").isNull(), F.size("answers"))).withColumn(
        "lookups", F.when(F.col("error").isNull(), F.size(texts))
    )


EPISODES_SQL = """
    SELECT seq, CASE seq % 7 WHEN 0 THEN 'success' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'lease_expiry' WHEN 3 THEN 'coordinator_restart' WHEN 4 THEN 'timeout' WHEN 5 THEN 'tool_failure' ELSE 'cancellation' END AS kind,
           CASE command WHEN 'fail' THEN 'failed' WHEN 'cancel' THEN 'cancelled' WHEN 'claim' THEN 'lost' ELSE 'succeeded' END AS state, seq % 4 AS effects FROM {ledger_view}
"""


@check(
    "fault_matrix_summary",
    "kind:str episodes:long succeeded:long failed:long cancelled:long lost:long duplicate_effects:long wrong_terminal:long",
    f"""WITH e AS ({EPISODES_SQL.format(ledger_view='ledger_view')})
SELECT kind, count(*) AS episodes, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'cancelled') AS cancelled,
       count(*) FILTER (state = 'lost') AS lost, sum(greatest(effects - 1, 0)) AS duplicate_effects,
       count(*) FILTER (state <> CASE WHEN kind IN ('timeout', 'tool_failure') THEN 'failed' WHEN kind = 'cancellation' THEN 'cancelled' ELSE 'succeeded' END) AS wrong_terminal
  FROM e GROUP BY kind""",
    LV,
)
def _(s):
    return g.fault_matrix_summary(s.sql(EPISODES_SQL, ledger_view=s.view(LV)))


@check(
    "ceil_rank",
    "run_id:long samples:long p50:long p99:long",
    "SELECT run_id, count(*) AS samples, quantile_disc(training_time_ms, 0.5) AS p50, quantile_disc(training_time_ms, 0.99) AS p99 FROM results_view GROUP BY run_id",
    "results_view",
)
def _(s):
    return g.ceil_percentiles(s.view("results_view"), ["run_id"], "training_time_ms", {"p50": 0.5, "p99": 0.99})


@check(
    "ledger_latency",
    "tenant:str admitted:long completed:long latency_p50_ms:dbl latency_p99_ms:dbl queue_wait_p99_ms:dbl admission_rate_per_s:dbl completion_rate_per_s:dbl",
    f"""WITH {REPLAY_SQL}
SELECT tenant, count(*) AS admitted, count(*) FILTER (state = 'succeeded') AS completed,
       quantile_disc(finished_us - created_us, 0.5) FILTER (state = 'succeeded') / CAST(1000 AS DOUBLE) AS latency_p50_ms,
       quantile_disc(finished_us - created_us, 0.99) FILTER (state = 'succeeded') / CAST(1000 AS DOUBLE) AS latency_p99_ms,
       quantile_disc(leased_us - created_us, 0.99) FILTER (state = 'succeeded') / CAST(1000 AS DOUBLE) AS queue_wait_p99_ms,
       count(*) / ((max(created_us) - min(created_us)) / CAST(1000000 AS DOUBLE)) AS admission_rate_per_s,
       count(*) FILTER (state = 'succeeded') / ((max(finished_us) - min(created_us)) / CAST(1000000 AS DOUBLE)) AS completion_rate_per_s FROM fin GROUP BY tenant""",
    LV,
)
def _(s):
    return g.ledger_latency(*replay(s))


@check(
    "recovery_time",
    "tenant:str recovered:long max_attempts:int recovery_p99_ms:dbl",
    f"""WITH {REPLAY_SQL}
SELECT tenant, count(*) AS recovered, max(attempt) AS max_attempts, quantile_disc(finished_us - created_us, 0.99) / CAST(1000 AS DOUBLE) AS recovery_p99_ms
  FROM fin WHERE state = 'succeeded' AND lapses > 0 GROUP BY tenant""",
    LV,
)
def _(s):
    return g.recovery_time(*replay(s))


@check(
    "ledger_integrity",
    "still_active:long unknown_states:long ended_without_time:long effects_without_commit:long repeated_effects:long",
    f"""WITH {REPLAY_SQL}
SELECT count(*) FILTER (state IN ('pending', 'leased')) AS still_active, 0 AS unknown_states,
       count(*) FILTER (state IN ('succeeded', 'failed', 'cancelled') AND finished_us IS NULL) AS ended_without_time, 0 AS effects_without_commit, 0 AS repeated_effects FROM fin""",
    LV,
)
def _(s):
    jobs, _ = replay(s)
    effects = jobs.filter("effect IS NOT NULL").groupBy("job_id").agg(F.count(F.lit(1)).alias("effects"))
    return g.ledger_integrity(jobs, effects)
