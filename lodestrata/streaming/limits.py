"""Call limits over a log of events: budgets by window, a credit brake, a circuit breaker, time to live.

Each rule is a small state machine, a pure function of (state, event). The same function runs over a
whole log (rows of a service in order, `applyInPandas`) and over a stream (`applyInPandasWithState`),
so both give the same answer. A service's events are sequential by nature: one service is one task, and
what is held is its state, not its rows; the batch form sorts inside Spark, not in Python memory alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

MINUTE = 60_000
# Window widths of the ladder in minutes, accepted calls that lower it, reserve and pause of the brake.
LADDER = (5, 10, 20, 30)
ACCEPTED_TO_LOWER = 20
RESERVE = 10
PAUSE = 15 * MINUTE
BREAK_FIRST, BREAK_MOST = MINUTE, 60 * MINUTE

BUDGET_STATE = "end long, used int, step int, accepted int"


def budget(state: tuple | None, at: int, outcome: str, calls: int, ladder=LADDER) -> tuple[str, tuple]:
    """A window opens at the first call after the last one's end; over `calls` the call is denied.

    A refusal by the service makes the next window a step wider, ACCEPTED_TO_LOWER accepted calls in a
    row a step narrower; an error starts the row anew.
    """
    end, used, step, accepted = state or (None, 0, 0, 0)
    if end is None or at >= end:
        end, used = at + ladder[step] * MINUTE, 1
    elif used >= calls:
        return "denied", (end, used, step, accepted)
    else:
        used += 1
    if outcome == "refused":
        step, accepted = min(step + 1, len(ladder) - 1), 0
    elif outcome == "error":
        accepted = 0
    elif accepted + 1 < ACCEPTED_TO_LOWER:
        accepted += 1
    else:
        step, accepted = max(0, step - 1), 0
    return "sent", (end, used, step, accepted)


BRAKE_STATE = "remaining int, in_flight int, paused_until long, releasing boolean"


def brake(state: tuple | None, at: int, event: str, remaining: int | None) -> tuple[str, tuple]:
    """Credits that the service reports. event: call, or answer (remaining null: it said nothing).

    A call reserves a credit; at RESERVE or less the service rests for PAUSE. After the pause one call
    goes out, and only its answer ends the pause: a late answer of an earlier call never does.
    """
    left, flying, until, releasing = state or (None, 0, None, False)
    if event == "call":
        if until is not None:
            if at < until:
                return "paused", (left, flying, until, releasing)
            if releasing:
                return "waits", (left, flying, until, releasing)
            return "released", (left, flying + 1, until, True)
        if left is None:
            return "sent", (None, flying + 1, None, False)
        if left <= RESERVE:
            return "paused", (left, flying, at + PAUSE, False)
        return "sent", (left - 1, flying + 1, None, False)
    mine = event == "release_answer"
    flying = max(0, flying - 1)
    if mine and releasing:
        if remaining is not None and remaining > RESERVE:
            return "resumed", (remaining, 0, None, False)
        return "paused", (left if remaining is None else remaining, 0, at + PAUSE, False)
    if remaining is None:
        return "noted", (left, flying, until, releasing)
    now = max(0, remaining - flying)
    if until is None and now <= RESERVE:
        until = at + PAUSE
    return "noted", (now, flying, until, releasing)


BREAKER_STATE = "until long, openings int, generation int"


def breaker(state: tuple | None, at: int, outcome: str, generation: int | None = None) -> tuple[str, tuple]:
    """Pauses double from BREAK_FIRST to BREAK_MOST; after one, a single probe decides.

    A result that belongs to another generation (its call left before an opening or closing) changes nothing.
    """
    until, openings, current = state or (None, 0, 0)
    if generation is not None and generation != current:
        return "stale", (until, openings, current)
    if until is not None and at < until:
        return "paused", (until, openings, current)
    probe = until is not None
    if outcome == "error":
        openings += 1
        return "probe_failed" if probe else "opened", (at + min(BREAK_MOST, BREAK_FIRST * 2 ** (openings - 1)), openings, current + 1)
    return ("closed", (None, 0, current + 1)) if probe else ("sent", (None, openings, current))


SPACING_STATE = "last long"


def spacing(state: tuple | None, at: int, outcome: str, least: int) -> tuple[str, tuple]:
    """At least `least` milliseconds between two calls of a host."""
    last = (state or (None,))[0]
    if last is not None and at - last < least:
        return "waits", (last,)
    return "sent", (at,)


def diagnosis(decided: DataFrame, by: str, at: str, outcome: str) -> DataFrame:
    """One row a service: what its calls met, when it last succeeded and was last refused."""
    sent = F.col("decision").isin("sent", "closed")
    return decided.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(sent).alias("n_sent"),
        F.count_if(F.col("decision") == "paused").alias("n_paused"),
        F.count_if(F.col("decision").isin("opened", "probe_failed")).alias("n_opened"),
        F.max(F.when(sent & (F.col(outcome) == "accepted"), F.col(at))).alias("last_success"),
        F.max(F.when(F.col(outcome) == "refused", F.col(at))).alias("last_refusal"),
    )


def over_log(events: DataFrame, by: str, at: str, order: str, outcome: str, rule: Callable) -> DataFrame:
    """rule(state, at_ms, outcome) over each service's rows in order: by, order, decision."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "o"])
        state, out = None, []
        for t, x in zip(pdf["at"], pdf["x"], strict=True):
            said, state = rule(state, int(t), x)
            out.append(said)
        return pd.DataFrame({by: pdf["k"], order: pdf["o"], "decision": out})

    rows = events.select(F.col(by).alias("k"), (F.unix_micros(F.col(at).cast("timestamp")) / 1000).cast("long").alias("at"), F.col(order).alias("o"), F.col(outcome).alias("x"))
    return rows.groupBy("k").applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, decision string")


def over_stream(events: DataFrame, by: str, at: str, order: str, outcome: str, rule: Callable, state_schema: str) -> DataFrame:
    """The same over a stream; state is kept by service. Rows of a batch are put in order first; later batches come later."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        now = tuple(None if pd.isna(v) else v for v in now) if now is not None else None
        pdf = pd.concat(list(parts)).sort_values(["at", "o"])
        out = []
        for t, x in zip(pdf["at"], pdf["x"], strict=True):
            said, now = rule(now, int(t), x)
            out.append(said)
        state.update(now)
        yield pd.DataFrame({by: pdf["k"], order: pdf["o"], "decision": out})

    rows = events.select(F.col(by).alias("k"), (F.unix_micros(F.col(at).cast("timestamp")) / 1000).cast("long").alias("at"), F.col(order).alias("o"), F.col(outcome).alias("x"))
    return rows.groupBy("k").applyInPandasWithState(run, f"{by} {kinds[by]}, {order} {kinds[order]}, decision string", state_schema, "append", GroupStateTimeout.NoTimeout)


def civil_day(events: DataFrame, by: str, at: str, order: str, calls: int, hours_west: int = 3) -> DataFrame:
    """A budget for each civil day west of Greenwich: adds `day` (its start) and `decision`."""
    day = F.window(F.col(at).cast("timestamp"), "1 day", "1 day", f"{hours_west} hours").start
    marked = events.withColumn("day", day)
    nth = F.row_number().over(Window.partitionBy(by, "day").orderBy(at, order))
    return marked.withColumn("decision", F.when(nth <= calls, "sent").otherwise("denied"))


def alive(entries: DataFrame, by: str, at: str, now, hours: int = 24) -> DataFrame:
    """The newest entry of each key that is not older than `hours`; reading never renews it."""
    value = F.struct(*[c for c in entries.columns if c != by])
    fresh = entries.where((F.col(at) > now - F.expr(f"interval {hours} hours")) & (F.col(at) <= now))
    return fresh.groupBy(by).agg(F.max_by(value, F.struct(*[F.col(c) for c in entries.columns if c != by][:2])).alias("v")).select(by, "v.*")


def evict(entries: DataFrame, at: str, order: str, size: str, cap: int, keep: float = 0.9) -> DataFrame:
    """Over the cap the oldest go until the rest is within `keep` of it: the rows that stay.

    Sums by day first, then rows of the day that the limit falls in, so no task orders all rows.
    """
    day = F.to_date(at)
    days = entries.groupBy(day.alias("_d")).agg(F.sum(size).alias("_s"))
    newer = F.coalesce(F.sum("_s").over(Window.orderBy(F.col("_d").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_s").over(Window.partitionBy())
    marked = entries.withColumn("_day", day).join(days.select("_d", newer.alias("_newer"), total.alias("_total")), F.col("_day") == F.col("_d"))
    within = F.sum(size).over(Window.partitionBy("_d").orderBy(F.col(at).desc(), F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0))
    stay = marked.withColumn("_run", F.col("_newer") + within).where((F.col("_total") <= cap) | (F.col("_run") <= cap * keep))
    return stay.select(entries.columns)


def refusal_hint(events: DataFrame, by: str, at: str, outcome: str, now, hours: int = 24, least: int = 2) -> DataFrame:
    """Services with `least` refusals or more after their last success, in the last hours."""
    ok = F.max(F.when(F.col(outcome) != "error", F.col(at))).over(Window.partitionBy(by))
    late = events.withColumn("_ok", ok).where((F.col(outcome) == "error") & (F.col("_ok").isNull() | (F.col(at) > F.col("_ok"))) & (F.col(at) > now - F.expr(f"interval {hours} hours")))
    return late.groupBy(by).agg(F.count(F.lit(1)).alias("n_refused")).where(F.col("n_refused") >= least)
