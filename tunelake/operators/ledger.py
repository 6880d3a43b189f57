"""Audits and replay of a job-ledger command log.

A log row is one command: ``seq, at_us, tenant, command, job_id`` and, by command, payload, ttl,
worker, fence, lease time, result, effect, error and retryable. Times are microseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.functions.scalars import is_finite
from tunelake.operators.scans import (
    as_of,
    ceil_rank,
    latest,
    lowest,
    meet_hot,
    number_block,
    order_statistics,
    peak,
    running,
    spread_hot,
    top_rows,
    total,
)
from tunelake.session import cut_lineage, hold

HOUR_US = 3_600_000_000
# Payload limit in bytes, key and error lengths, and the default policy.
PAYLOAD_LIMIT = 32768
KEY_LIMIT = 256
POLICY_DEFAULTS = {"max_active": 64, "tenant_active": 16, "tenant_running": 4, "max_attempts": 3}
TERMINAL = ["succeeded", "failed", "cancelled"]
STATES = ["pending", "leased", *TERMINAL]


def hour(at: Column) -> Column:
    return number_block(at, HOUR_US)


def _rewritten(text: Column, pattern: str, gap: Callable[[Column], Column], hit: Callable[[Column], Column]) -> Column:
    """The text with its matches and the gaps between them rewritten, each once."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def joined(p: Column) -> Column:
        pieces = F.transform(p["gaps"], lambda g, n: F.concat(gap(g), F.coalesce(hit(F.get(p["hits"], n)), F.lit(""))))
        return F.array_join(pieces, "")

    return F.get(F.transform(F.array(parts), joined), F.lit(0))


def escaped(text: Column) -> Column:
    """JSON text in ASCII: every other UTF-16 unit as a lower-case escape of four hex digits."""
    units = lambda run: F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(.{4})", r"\\u$1")
    return _rewritten(text, r"[^\x00-\x7f]+", lambda gap: gap, units)


#: Strings of JSON text, and numbers outside of them.
_STRING, _NUMBER = r'"(?:[^"\\]|\\.)*+"', r"-?[0-9]++(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
#: Whole numbers that the parser would round travel as text between these signs of no language.
_LONG_MARK = "\ue000\uf8ff\ue000"
_LONG = "-?[1-9][0-9]{38,}+"


def _marked_numbers(text: Column) -> Column:
    """Numbers with a point get an exponent, so that the parser keeps them as fractions, and long whole ones become text; strings stay."""

    def marked(gap: Column) -> Column:
        fractions = F.regexp_replace(gap, r"(-?[0-9]++\.[0-9]++)(?![0-9eE.])", "$1e0")
        return F.regexp_replace(fractions, rf"(?<![0-9.eE+-])({_LONG})(?![0-9.eE])", f'"{_LONG_MARK}$1{_LONG_MARK}"')

    return _rewritten(text, _STRING, marked, lambda hit: hit)


def _in_range(text: Column) -> Column:
    """False for JSON text with a fraction that no double holds. Only long exponents and very long digits can make one."""
    numbers = F.regexp_extract_all(F.regexp_replace(text, _STRING, '""'), F.lit(_NUMBER), F.lit(0))
    beyond = F.exists(numbers, lambda n: n.rlike("[.eE]") & (F.abs(n.try_cast("double")) == F.lit(float("inf"))))
    return F.when(text.rlike(r"[eE]\+?[0-9]{3}|[0-9]{200}"), ~beyond).otherwise(F.lit(True))


def ledger_job_id(tenant: Column, request_key: Column) -> Column:
    """Hash id of the canonical ``[tenant, key]`` text."""
    return F.sha2(escaped(F.to_json(F.array(tenant, request_key))), 256)


def canonical_payload(payload: Column) -> Column:
    """JSON text in ASCII with sorted keys and no blanks; null when it is not JSON or holds a number beyond all doubles.

    Whole numbers and fractions stay apart: ``1`` and ``1.0`` are different payloads, while all
    spellings of one fraction (``100.0``, ``1e2``) are written alike. Whole numbers keep all digits.
    """
    plain = escaped(F.to_json(F.try_parse_json(_marked_numbers(payload))))
    mark = "".join(f"\\\\u{ord(sign):04x}" for sign in _LONG_MARK)
    return F.when(_in_range(payload), F.regexp_replace(plain, f'"{mark}({_LONG}){mark}"', "$1"))


def submission_checks(submissions: DataFrame) -> DataFrame:
    """Reason for which a submission is refused before it reaches the store, else null."""
    text = F.col("payload_text")
    reason = (
        F.when(
            F.col("request_key").isNull() | (F.col("request_key") == "") | (F.length("request_key") > KEY_LIMIT),
            "invalid_request_key",
        )
        .when(text.isNull() | ~text.startswith("{"), "invalid_submission")
        .when(~is_finite(F.col("ttl_s")) | (F.col("ttl_s") <= 0), "invalid_submission")
        .when(F.octet_length(text) > PAYLOAD_LIMIT, "payload_limit")
    )
    return submissions.withColumn("payload_text", canonical_payload(F.col("payload"))).withColumn("rejection", reason)


def idempotent_submissions(submissions: DataFrame) -> DataFrame:
    """First submission of a job is accepted; the same payload is a replay, another a conflict."""
    first = running(
        submissions,
        ["job_id"],
        ["at_us", "seq"],
        hour(F.col("at_us")),
        {"_first": lowest(F.struct("at_us", "seq", "payload_text"))},
    )
    outcome = (
        F.when(F.col("_first.seq") == F.col("seq"), "accepted")
        .when(F.col("_first.payload_text") == F.col("payload_text"), "replay")
        .otherwise("conflict")
    )
    return first.withColumn("outcome", outcome).drop("_first")


def job_activity(history: DataFrame) -> DataFrame:
    """+1 when a job is accepted and -1 when it ends, from lifecycle events."""
    ends = ["committed", "failed", "cancelled", "deadline", "attempts_exhausted"]
    delta = F.when(F.col("kind") == "accepted", 1).when(F.col("kind").isin(ends), -1)
    return history.withColumn("delta", delta.cast("long")).filter("delta IS NOT NULL")


def admission_audit(
    activity: DataFrame, max_active: int = POLICY_DEFAULTS["max_active"], tenant_active: int = POLICY_DEFAULTS["tenant_active"]
) -> DataFrame:
    """Active jobs, of all tenants and of the own one, just before each acceptance."""
    own = running(
        activity, ["tenant"], ["at_us", "seq"], hour(F.col("at_us")), {"own_active": total(F.col("delta"), inclusive=False)}
    )
    both = running(
        cut_lineage(own), [], ["at_us", "seq"], hour(F.col("at_us")), {"all_active": total(F.col("delta"), inclusive=False)}
    )
    return both.filter("delta > 0").withColumn(
        "within_limits", (F.col("all_active") < max_active) & (F.col("own_active") < tenant_active)
    )


def claim_order(
    jobs: DataFrame, job_ids: DataFrame | None = None, tenant_running: int = POLICY_DEFAULTS["tenant_running"]
) -> DataFrame:
    """Jobs each tenant may claim next, oldest first, as many as its running quota leaves."""
    busy = jobs.groupBy("tenant").agg(F.count_if(F.col("state") == "leased").alias("running"))
    pending = jobs.filter("state = 'pending'")
    if job_ids is not None:
        pending = pending.join(job_ids.select("job_id"), "job_id", "left_semi")
    first = top_rows(pending, ["tenant"], [F.col("created_us"), F.col("job_id")], tenant_running, "claim_rank")
    return first.join(busy, "tenant").filter(F.col("claim_rank") <= F.lit(tenant_running) - F.col("running"))


def expire_as_of(jobs: DataFrame, at_us: int, max_attempts: int = POLICY_DEFAULTS["max_attempts"]) -> DataFrame:
    """Job states after the sweep at one moment: deadlines fail, lapsed leases return or exhaust."""
    active = F.col("state").isin("pending", "leased")
    deadline = active & (F.col("deadline_us") <= at_us)
    lapsed = (F.col("state") == "leased") & (F.col("lease_until_us") <= at_us)
    exhausted = lapsed & (F.col("attempt") >= max_attempts)
    swept = deadline | lapsed
    ended = deadline | exhausted
    return jobs.withColumns(
        {
            "error": F.when(deadline, "deadline")
            .when(exhausted, "attempts_exhausted")
            .when(lapsed, "lease_expired")
            .otherwise(F.col("error")),
            "finished_us": F.when(ended, F.lit(at_us)).otherwise(F.col("finished_us")),
            "fence": F.col("fence") + swept.cast("int"),
            "worker": F.when(~swept, F.col("worker")),
            "state": F.when(ended, "failed").when(lapsed, "pending").otherwise(F.col("state")),
            "lease_until_us": F.when(~swept, F.col("lease_until_us")),
        }
    )


def attach_lease(commands: DataFrame, leases: DataFrame) -> DataFrame:
    """The newest lease of each command's job at that moment, under names of its own.

    ``leases`` hold ``job_id, at_us, seq, tenant, worker, fence, lease_until_us, deadline_us``.
    """
    own = leases.select(
        "job_id",
        "at_us",
        "seq",
        *[F.col(c).alias(f"lease_{c}") for c in ("tenant", "worker", "fence")],
        "lease_until_us",
        "deadline_us",
    )
    payload = ["lease_tenant", "lease_worker", "lease_fence", "lease_until_us", "deadline_us"]
    return as_of(commands, own, ["job_id"], "at_us", payload, hour, tie="seq")


def classify_commits(commits: DataFrame) -> DataFrame:
    """Committed, duplicate or stale, for commits that carry the lease in force.

    A commit is valid for the tenant, worker and fence of that lease before its end and the deadline,
    while the job is leased (``state``, if there is such a column, is the job's state just before). The
    first valid one of a job wins; the same result and effect under the winner's fence and worker is a
    duplicate.
    """
    now = F.col("at_us")
    valid = (
        F.col("tenant").eqNullSafe(F.col("lease_tenant"))
        & (F.col("worker") == F.col("lease_worker"))
        & (F.col("fence") == F.col("lease_fence"))
        & (now < F.col("lease_until_us"))
        & (now < F.col("deadline_us"))
    )
    if "state" in commits.columns:
        valid = valid & (F.col("state") == "leased")
    won = F.when(
        F.coalesce(valid, F.lit(False)), F.struct("at_us", "seq", "tenant", "fence", "worker", "result", "effect")
    )
    marked = commits.withColumn("_won", won)
    first = running(marked, ["job_id"], ["at_us", "seq"], hour(now), {"_winner": lowest(F.col("_won"))})
    w = F.col("_winner")
    same = (
        w["tenant"].eqNullSafe(F.col("tenant"))
        & (w["fence"] == F.col("fence"))
        & (w["worker"] == F.col("worker"))
        & w["result"].eqNullSafe(F.col("result"))
        & w["effect"].eqNullSafe(F.col("effect"))
    )
    outcome = (
        F.when(w["seq"] == F.col("seq"), "committed")
        .when(w.isNotNull() & same, "duplicate")
        .otherwise("stale")
    )
    return first.withColumn("outcome", outcome).drop("_won", "_winner")


def lease_renewals(renewals: DataFrame) -> DataFrame:
    """New expiry of each renewal, or null when the lease had already lapsed.

    ``renewals`` carry ``claim_until_us`` and ``deadline_us`` of their lease. A renewal counts
    while every earlier one did and the expiry they left lies ahead.
    """
    keys = ["job_id", "fence"]
    until = F.least(F.col("at_us") + F.col("lease_us"), F.col("deadline_us"))
    order = ["at_us", "seq"]
    chained = running(
        renewals.withColumn("_until", until), keys, order, hour(F.col("at_us")), {"_before": latest(F.col("_until"), inclusive=False)}
    )
    late = (F.col("at_us") >= F.coalesce("_before", "claim_until_us")) | (F.col("at_us") >= F.col("deadline_us"))
    broken = running(
        cut_lineage(chained.withColumn("_late", late.cast("int"))), keys, order, hour(F.col("at_us")), {"_broken": peak(F.col("_late"))}
    )
    renewed = F.col("_broken") == 0
    return broken.withColumn("renewed", renewed).withColumn("new_until_us", F.when(renewed, F.col("_until"))).drop(
        "_until", "_before", "_late", "_broken"
    )


def retry_outcomes(failures: DataFrame, max_attempts: int = POLICY_DEFAULTS["max_attempts"]) -> DataFrame:
    """State after a reported failure: back to pending while retryable attempts remain."""
    again = F.col("retryable") & (F.col("attempt") < max_attempts)
    return failures.withColumn("new_state", F.when(again, "pending").otherwise("failed")).withColumn(
        "new_fence", F.col("fence") + 1
    )


def cancellations(cancels: DataFrame, history: DataFrame) -> DataFrame:
    """Whether each cancellation found its job pending or leased, by the history before it.

    ``history`` holds ``tenant`` and ``state`` after each lifecycle event. Commands of unknown jobs,
    and of tenants that do not own the job, are reported as such.
    """
    found = as_of(cancels, history, ["tenant", "job_id"], "at_us", ["state"], hour, tie="event_no", strict=True)
    outcome = (
        F.when(F.col("state").isNull(), "unknown_job")
        .when(F.col("state").isin("pending", "leased"), "cancelled")
        .otherwise("already_ended")
    )
    return found.withColumn("outcome", outcome)


@dataclass(frozen=True)
class ReplayPolicy:
    """Defaults for commands that do not carry their own times, and the attempt limit."""

    ttl_us: int = 60_000_000
    lease_us: int = 5_000_000
    max_attempts: int = POLICY_DEFAULTS["max_attempts"]


def _command_columns(commands: DataFrame, policy: ReplayPolicy) -> DataFrame:
    """The log with every optional column present."""

    def column(name: str, kind: str, default: object = None) -> Column:
        value = F.col(name) if name in commands.columns else F.lit(None)
        return F.coalesce(value.cast(kind), F.lit(default).cast(kind)).alias(name)

    return commands.select(
        "job_id",
        "tenant",
        "at_us",
        "seq",
        "command",
        column("worker", "string"),
        column("fence", "int"),
        column("payload", "string"),
        column("ttl_us", "long", policy.ttl_us),
        column("lease_us", "long", policy.lease_us),
        column("result", "string"),
        column("effect", "string"),
        column("error", "string"),
        column("retryable", "boolean", True),
    )


def _renewal_ends(commands: DataFrame) -> DataFrame:
    """Mark each renewal with the end of its unbroken chain under one worker and fence."""
    renewals = commands.filter("command = 'renew'").select("job_id", "tenant", "worker", "fence", "at_us", "seq", "lease_us")
    keys, order = ["job_id", "tenant", "worker", "_fence"], ["at_us", "seq"]
    staged = renewals.withColumn("_fence", F.coalesce("fence", F.lit(-1))).withColumn(
        "_until", F.col("at_us") + F.col("lease_us")
    )
    linked = running(staged, keys, order, hour(F.col("at_us")), {"_before": latest(F.col("_until"), inclusive=False)})
    gap = F.when(F.col("at_us") < F.col("_before"), 0).otherwise(1)
    islands = running(
        cut_lineage(linked.withColumn("_gap", gap)), keys, order, hour(F.col("at_us")), {"_island": total(F.col("_gap").cast("long"))}
    )
    ends = islands.groupBy(*keys, "_island").agg(F.max(F.struct("at_us", "seq", "_until"))["_until"].alias("chain_until_us"))
    return islands.join(ends, [*keys, "_island"]).select("job_id", "seq", "chain_until_us")


def replay_ledger(
    commands: DataFrame, policy: ReplayPolicy | None = None, horizon_us: int | None = None, hot_rows: int = 1 << 20
) -> tuple[DataFrame, DataFrame]:
    """Final state of every job and its lifecycle events, from the whole command log.

    A job changes state at most twice per attempt, so the fold is a fixed number of rounds. In
    each round every job looks for its next effective command: the first claim or cancel while
    pending, the first matching commit, failure or cancel while leased. That is a join with the
    one-row-per-job state and a map-side combined minimum. Commands of heavy jobs are salted, and
    no job is folded in one task. Lapses take effect at the moment they fall due. Renewals are
    chained beforehand, so their number adds no rounds.

    ``horizon_us`` is the last moment to which lapses are applied (default: end of the log).
    """
    policy = policy or ReplayPolicy()
    if horizon_us is None:
        horizon_us = commands.agg(F.max("at_us")).first()[0] or 0
    state = fold_commands(commands, policy, horizon_us, None, hot_rows)
    return final_jobs(state), job_events(state)


def final_jobs(state: DataFrame) -> DataFrame:
    """One row per job without the bookkeeping of the fold."""
    return state.drop("pos_us", "pos_seq", "_salts", "events", "past_events")


def job_events(state: DataFrame) -> DataFrame:
    """Lifecycle events of a fold, numbered over the whole life of each job."""
    rows = state.select("job_id", "tenant", "past_events", F.posexplode("events").alias("_no", "e"))
    return rows.select(
        "job_id",
        "tenant",
        (F.col("past_events") + F.col("_no")).cast("long").alias("event_no"),
        "e.kind",
        "e.at_us",
        "e.fence",
        "e.state",
    )


def fold_commands(
    commands: DataFrame, policy: ReplayPolicy, horizon_us: int, prior: DataFrame | None = None, hot_rows: int = 1 << 20
) -> DataFrame:
    """Fold commands into job states, starting from the states of an earlier fold if given."""
    log = _command_columns(commands, policy)
    if log.filter("command = 'renew'").isEmpty():
        log = log.withColumn("chain_until_us", F.lit(None).cast("long"))
    else:
        log = log.join(_renewal_ends(log), ["job_id", "seq"], "left")
    rows = log.filter(F.col("command") != "submit")
    salted, sizes = spread_hot(rows, ["job_id"], "seq", hot_rows)
    # Shuffled once; every round joins it in place.
    salted = hold(salted.repartition("job_id", "_salt"))

    created = log.filter("command = 'submit'").groupBy("job_id").agg(
        F.min(F.struct("at_us", "seq", "tenant", "payload", "ttl_us")).alias("s")
    )
    if prior is not None:
        created = created.join(prior.select("job_id"), "job_id", "left_anti")
    start = F.array(_event("accepted", F.col("s.at_us"), F.lit(0), "pending"))
    state = created.select(
        "job_id",
        F.col("s.tenant").alias("tenant"),
        F.col("s.payload").alias("payload"),
        F.lit("pending").alias("state"),
        F.lit(0).alias("attempt"),
        F.lit(0).alias("fence"),
        F.lit(None).cast("string").alias("worker"),
        F.lit(None).cast("long").alias("lease_until_us"),
        (F.col("s.at_us") + F.col("s.ttl_us")).alias("deadline_us"),
        F.col("s.at_us").alias("created_us"),
        F.lit(None).cast("long").alias("finished_us"),
        F.lit(None).cast("string").alias("result"),
        F.lit(None).cast("string").alias("effect"),
        F.lit(None).cast("string").alias("error"),
        F.col("s.at_us").alias("pos_us"),
        F.col("s.seq").alias("pos_seq"),
        F.lit(0).cast("long").alias("past_events"),
        start.alias("events"),
    )
    if prior is not None:
        old = prior.withColumn("past_events", F.col("past_events") + F.size("events")).withColumn(
            "events", F.filter("events", lambda e: F.lit(False))
        )
        state = state.unionByName(old.drop("_salts"))
    state = cut_lineage(
        state.join(sizes, "job_id", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1).cast("long")))
    )
    for _ in range(2 * policy.max_attempts + 1):
        # One row per job is written per round, so neither the plan nor its expressions nest.
        moved = cut_lineage(_round(state, salted, policy, horizon_us))
        state = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            break
    salted.unpersist()
    return state


def _event(kind: str | Column, at: Column, fence: Column, state: str | Column) -> Column:
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        as_column(kind).alias("kind"),
        at.cast("long").alias("at_us"),
        fence.cast("int").alias("fence"),
        as_column(state).alias("state"),
    )


def _round(state: DataFrame, commands: DataFrame, policy: ReplayPolicy, horizon_us: int) -> DataFrame:
    """Apply the next effective command or lapse of every job."""
    active = F.col("state").isin("pending", "leased")
    seeking = meet_hot(
        state.filter(active).select(
            "job_id", "state", F.col("tenant").alias("own_tenant"), F.col("worker").alias("own_worker"),
            F.col("fence").alias("own_fence"), "pos_us", "pos_seq", "_salts"
        )
    )
    later = (F.col("at_us") > F.col("pos_us")) | ((F.col("at_us") == F.col("pos_us")) & (F.col("seq") > F.col("pos_seq")))
    own = (F.col("worker") == F.col("own_worker")) & (F.col("fence").isNull() | (F.col("fence") == F.col("own_fence")))
    pending_next = (F.col("state") == "pending") & F.col("command").isin("claim", "cancel")
    leased_next = (F.col("state") == "leased") & (
        (F.col("command") == "cancel") | (F.col("command").isin("commit", "fail") & own)
    )
    renewal = (F.col("state") == "leased") & (F.col("command") == "renew") & own
    found = (
        commands.join(seeking, ["job_id", "_salt"])
        # A command of another tenant does not know the job.
        .filter(later & F.col("tenant").eqNullSafe(F.col("own_tenant")) & (pending_next | leased_next | renewal))
        .groupBy("job_id", "_salt")
        .agg(
            F.min(
                F.when(
                    pending_next | leased_next,
                    F.struct("at_us", "seq", "command", "worker", "lease_us", "result", "effect", "error", "retryable"),
                )
            ).alias("n"),
            F.min(F.when(renewal, F.struct("at_us", "seq", "chain_until_us"))).alias("r"),
        )
        .groupBy("job_id")
        .agg(F.min("n").alias("n"), F.min("r").alias("r"))
    )
    step = state.join(found, "job_id", "left")
    n = F.col("n")
    leased = F.col("state") == "leased"
    pending = F.col("state") == "pending"
    extended = F.when(
        leased & (F.col("r.at_us") < F.col("lease_until_us")),
        F.least(F.greatest(F.col("r.chain_until_us"), F.lit(0).cast("long")), F.col("deadline_us")),
    )
    bound = F.when(leased, F.coalesce(extended, "lease_until_us")).otherwise(F.col("deadline_us"))
    step = step.withColumn("_bound", bound)
    acts = (leased | pending) & n.isNotNull() & (n["at_us"] < F.col("_bound"))
    lapses = (leased | pending) & ~F.coalesce(acts, F.lit(False)) & (F.col("_bound") <= horizon_us)
    deadline = lapses & (F.col("_bound") >= F.col("deadline_us"))
    exhausted = lapses & ~deadline & (F.col("attempt") >= policy.max_attempts)
    again = n["retryable"] & (F.col("attempt") < policy.max_attempts)
    kind = (
        F.when(acts & (n["command"] == "claim"), "leased")
        .when(acts & (n["command"] == "commit"), "committed")
        .when(acts & (n["command"] == "cancel"), "cancelled")
        .when(acts & (n["command"] == "fail") & again, "retry")
        .when(acts & (n["command"] == "fail"), "failed")
        .when(deadline, "deadline")
        .when(exhausted, "attempts_exhausted")
        .when(lapses, "lease_expired")
    )
    step = step.withColumn("_kind", kind)
    k = F.col("_kind")
    new_state = (
        F.when(k == "leased", "leased")
        .when(k == "committed", "succeeded")
        .when(k == "cancelled", "cancelled")
        .when(k.isin("retry", "lease_expired"), "pending")
        .when(k.isin("failed", "deadline", "attempts_exhausted"), "failed")
        .otherwise(F.col("state"))
    )
    moved = F.when(k.isin("lease_expired", "deadline", "attempts_exhausted"), F.col("_bound")).otherwise(n["at_us"])
    fence = F.col("fence") + F.when(k.isNull() | (k == "committed"), 0).otherwise(1)
    ended = k.isin("committed", "cancelled", "failed", "deadline", "attempts_exhausted")
    released = k.isin("retry", "failed", "lease_expired", "deadline", "attempts_exhausted")
    error = (
        F.when(k == "leased", F.lit(None).cast("string"))
        .when(k.isin("retry", "failed"), n["error"])
        .when(k.isin("deadline", "attempts_exhausted", "lease_expired"), k)
        .otherwise(F.col("error"))
    )
    return step.select(
        "job_id",
        "tenant",
        "payload",
        new_state.alias("state"),
        (F.col("attempt") + F.when(k == "leased", 1).otherwise(0)).alias("attempt"),
        fence.cast("int").alias("fence"),
        F.when(k == "leased", n["worker"]).when(released, F.lit(None).cast("string")).otherwise(F.col("worker")).alias("worker"),
        F.when(k == "leased", F.least(n["at_us"] + n["lease_us"], F.col("deadline_us")))
        .when(released, F.lit(None).cast("long"))
        .when(leased, F.col("_bound"))
        .otherwise(F.col("lease_until_us"))
        .alias("lease_until_us"),
        "deadline_us",
        "created_us",
        F.when(ended, moved).otherwise(F.col("finished_us")).alias("finished_us"),
        F.when(k == "committed", n["result"]).otherwise(F.col("result")).alias("result"),
        F.when(k == "committed", n["effect"]).otherwise(F.col("effect")).alias("effect"),
        error.alias("error"),
        F.coalesce(moved, "pos_us").alias("pos_us"),
        F.when(k.isin("lease_expired", "deadline", "attempts_exhausted"), F.lit(-1).cast("long"))
        .otherwise(F.coalesce(n["seq"], "pos_seq"))
        .alias("pos_seq"),
        F.when(
            k.isNotNull(), F.concat("events", F.array(_event(k, moved, fence, new_state)))
        ).otherwise(F.col("events")).alias("events"),
        "past_events",
        "_salts",
        k.isNotNull().alias("_moved"),
    )


def effects_once(outcomes: DataFrame) -> DataFrame:
    """Effects recorded per job: the effect of its committed row, and how many there were."""
    done = outcomes.filter("outcome = 'committed' AND effect IS NOT NULL")
    return done.groupBy("job_id").agg(
        F.min_by("effect", F.struct("at_us", "seq")).alias("effect"), F.count(F.lit(1)).alias("effects")
    )


def job_history(history: DataFrame) -> DataFrame:
    """Lifecycle of each job as one text of ``kind@fence`` steps; a job has few events."""
    steps = F.array_sort(F.collect_list(F.struct("event_no", "kind", "fence")))
    text = F.array_join(F.transform(steps, lambda e: F.concat(e["kind"], F.lit("@"), e["fence"].cast("string"))), ">")
    return history.groupBy("job_id").agg(F.count(F.lit(1)).alias("events"), text.alias("history"))


def policy_conflicts(supplied: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Supplied limits that contradict the stored policy; a missing policy takes the defaults."""
    names = list(POLICY_DEFAULTS)
    joined = supplied.join(stored.select(*keys, *[F.col(n).alias(f"stored_{n}") for n in names]), list(keys), "left")
    known = F.lit(False)
    for name in names:
        known = known | F.col(f"stored_{name}").isNotNull()
    conflict = F.lit(False)
    columns = []
    for name, default in POLICY_DEFAULTS.items():
        kept, asked = F.col(f"stored_{name}"), F.col(name)
        conflict = conflict | (known & asked.isNotNull() & ~asked.eqNullSafe(kept))
        columns.append(F.when(known, kept).otherwise(F.coalesce(asked, F.lit(default))).alias(name))
    invalid = F.lit(False)
    for name in names:
        invalid = invalid | F.coalesce(F.col(name) <= 0, F.lit(False))
    outcome = F.when(invalid, "limits must be positive").when(conflict, "policy_mismatch").otherwise("ok")
    return joined.select(*keys, outcome.alias("outcome"), *columns)


# Answers of the lookup tool and the operand limit.
LOOKUP_ANSWERS = {"lease": "temporary ownership", "fence": "stale-writer rejection"}
OPERAND_LIMIT = 1e9
MAX_CALLS = 16


def evaluate_tool_plans(plans: DataFrame) -> DataFrame:
    """Answers of each plan, whether they are the expected ones, or the first error.

    ``plans`` holds ``plan_id``, ``calls array<struct<tool, a, b, key>>`` and ``expected
    array<string>``. A plan can succeed with a wrong task result.
    """
    pairs = [F.lit(item) for pair in LOOKUP_ANSWERS.items() for item in pair]
    answers = F.create_map(*pairs)

    def fine(x: Column) -> Column:
        return F.coalesce(is_finite(x) & (F.abs(x) <= OPERAND_LIMIT), F.lit(False))

    def problem(call: Column) -> Column:
        lookup = call["tool"] == "lookup"
        return (
            F.when(call.isNull() | call["tool"].isNull() | ~call["tool"].isin("add", "multiply", "lookup"), "unknown_tool")
            .when(lookup & call["key"].isNull(), "invalid_lookup_key")
            .when(lookup & F.try_element_at(answers, call["key"]).isNull(), "missing_fixture")
            .when(~lookup & ~(fine(call["a"]) & fine(call["b"])), "invalid_operand")
        )

    def answer(call: Column) -> Column:
        return (
            F.when(call["tool"] == "lookup", F.try_element_at(answers, call["key"]))
            .when(call["tool"] == "add", (call["a"] + call["b"]).cast("string"))
            .otherwise((call["a"] * call["b"]).cast("string"))
        )

    def same(given: Column, wanted: Column) -> Column:
        """Numbers agree as numbers, however they are written; other answers as text."""
        left, right = given.try_cast("double"), wanted.try_cast("double")
        return F.when(left.isNotNull() & right.isNotNull(), left == right).otherwise(given.eqNullSafe(wanted))

    agreed = F.coalesce(
        (F.size("answers") == F.size("expected")) & F.forall(F.zip_with("answers", "expected", same), lambda ok: ok), F.lit(False)
    )
    calls = F.col("calls")
    size = F.coalesce(F.size(calls), F.lit(0))
    problems = F.filter(F.transform(calls, problem), lambda p: p.isNotNull())
    error = F.when((size < 1) | (size > MAX_CALLS), "invalid_plan").otherwise(F.get(problems, 0))
    return (
        plans.withColumn("error", error)
        .withColumn("answers", F.when(F.col("error").isNull(), F.transform(calls, answer)))
        .withColumn("task_correct", F.when(F.col("error").isNull(), agreed))
    )


def gather_plans(calls: DataFrame) -> DataFrame:
    """Calls collected per plan in order. Plans with too many calls keep one more than allowed,
    which is enough to reject them."""
    first = top_rows(calls, ["plan_id"], [F.col(c) for c in ("call_no", "a", "b", "key", "tool")], MAX_CALLS + 1, "_turn")
    listed = F.array_sort(F.collect_list(F.struct("_turn", "tool", "a", "b", "key")))
    return first.groupBy("plan_id").agg(listed.alias("_c")).select(
        "plan_id",
        F.transform("_c", lambda c: F.struct(c["tool"].alias("tool"), c["a"].alias("a"), c["b"].alias("b"), c["key"].alias("key"))).alias("calls"),
    )


# Terminal state each kind of fault must end in.
FAULT_OUTCOMES = {
    "success": "succeeded",
    "duplicate": "succeeded",
    "lease_expiry": "succeeded",
    "coordinator_restart": "succeeded",
    "timeout": "failed",
    "tool_failure": "failed",
    "cancellation": "cancelled",
}


def fault_matrix_summary(episodes: DataFrame, keys: Sequence[str] = ("kind",)) -> DataFrame:
    """Terminal counts, losses, duplicate effects and wrong outcomes per kind of fault."""
    pairs = [F.lit(item) for pair in FAULT_OUTCOMES.items() for item in pair]
    expected = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("kind")), F.lit("succeeded"))
    return episodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("episodes"),
        *[F.count_if(F.col("state") == s).alias(s) for s in TERMINAL],
        F.count_if(F.col("state") == "lost").alias("lost"),
        F.sum(F.greatest(F.col("effects") - 1, F.lit(0))).alias("duplicate_effects"),
        F.count_if(F.col("state") != expected).alias("wrong_terminal"),
    )


def ceil_percentiles(frame: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Ceil nearest-rank percentiles; groups without samples have no row."""
    return order_statistics(frame, keys, value, {name: ceil_rank(p) for name, p in shares.items()})


def ledger_latency(jobs: DataFrame, history: DataFrame, keys: Sequence[str] = ("tenant",)) -> DataFrame:
    """Queue wait and latency percentiles and the admission and completion rates of finished jobs."""
    first = history.filter("kind = 'leased'").groupBy("job_id").agg(F.min("at_us").alias("_leased"))
    done = jobs.filter("state = 'succeeded'").join(first, "job_id")
    timed = done.select(
        *keys,
        F.expr(
            "stack(2, 'latency', CAST(finished_us - created_us AS BIGINT), 'wait', CAST(_leased - created_us AS BIGINT))"
        ).alias("measure", "us"),
    )
    stats = ceil_percentiles(timed, [*keys, "measure"], "us", {"p50": 0.5, "p99": 0.99})
    wide = stats.groupBy(*keys).agg(
        *[
            (F.max(F.when(F.col("measure") == m, F.col(p))) / F.lit(1000.0)).alias(name)
            for name, m, p in (
                ("latency_p50_ms", "latency", "p50"),
                ("latency_p99_ms", "latency", "p99"),
                ("queue_wait_p99_ms", "wait", "p99"),
            )
        ]
    )
    spans = jobs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("admitted"),
        F.count_if(F.col("state") == "succeeded").alias("completed"),
        ((F.max("created_us") - F.min("created_us")) / F.lit(1e6)).alias("admission_s"),
        ((F.max("finished_us") - F.min("created_us")) / F.lit(1e6)).alias("elapsed_s"),
    )
    rate = lambda n, s: F.when(F.col(s) > 0, F.col(n) / F.col(s))
    return (
        spans.withColumn("admission_rate_per_s", rate("admitted", "admission_s"))
        .withColumn("completion_rate_per_s", rate("completed", "elapsed_s"))
        .join(wide, list(keys), "left")
    )


def recovery_time(jobs: DataFrame, history: DataFrame, keys: Sequence[str] = ("tenant",)) -> DataFrame:
    """p99 of submit-to-commit time and the attempts of jobs that recovered from a lost lease."""
    lost = history.filter("kind = 'lease_expired'").select("job_id").distinct()
    saved = jobs.filter("state = 'succeeded'").join(lost, "job_id", "left_semi").withColumn(
        "recovery_us", F.col("finished_us") - F.col("created_us")
    )
    stats = ceil_percentiles(saved, keys, "recovery_us", {"p99": 0.99})
    attempts = saved.groupBy(*keys).agg(F.count(F.lit(1)).alias("recovered"), F.max("attempt").alias("max_attempts"))
    return attempts.join(stats, list(keys)).withColumn("recovery_p99_ms", F.col("p99") / F.lit(1000.0))


def ledger_integrity(jobs: DataFrame, effects: DataFrame) -> DataFrame:
    """Counts that must be zero in a drained ledger."""
    stray = effects.join(jobs.filter("state = 'succeeded'"), "job_id", "left_anti").agg(
        F.count(F.lit(1)).alias("effects_without_commit")
    )
    doubled = effects.agg(F.coalesce(F.sum(F.col("effects") - 1), F.lit(0)).cast("long").alias("repeated_effects"))
    counts = jobs.agg(
        F.count_if(F.col("state").isin("pending", "leased")).alias("still_active"),
        F.count_if(~F.col("state").isin(STATES)).alias("unknown_states"),
        F.count_if(F.col("state").isin(TERMINAL) & F.col("finished_us").isNull()).alias("ended_without_time"),
    )
    return counts.withColumn("effects_without_commit", stray.scalar()).withColumn("repeated_effects", doubled.scalar())
