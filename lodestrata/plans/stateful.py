"""Call limits over the events table: user_id is the service, an error event a refusal."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import limits

QUERIES: dict = {}
ORACLES: dict = {}
CALLS = 3


def register(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", (F.col("user_id") % 50).alias("user_id"), F.when(F.col("event_type") == "error", "refused").when(F.col("event_type") == "signup", "error").otherwise("accepted").alias("outcome"))


_LOG = "l AS (SELECT event_id, user_id % 50 AS user_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, CASE event_type WHEN 'error' THEN 'refused' WHEN 'signup' THEN 'error' ELSE 'accepted' END AS oc FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS rn FROM l)"
_W = "[300000, 600000, 1200000, 1800000]"


def _step(prefix: str, sent: str) -> str:
    return f"CASE WHEN {sent} THEN CASE oc WHEN 'refused' THEN least({prefix}step + 1, 3) WHEN 'error' THEN {prefix}step ELSE CASE WHEN {prefix}acc + 1 < 20 THEN {prefix}step ELSE greatest(0, {prefix}step - 1) END END ELSE {prefix}step END"


def _acc(prefix: str, sent: str) -> str:
    return f"CASE WHEN {sent} THEN CASE oc WHEN 'accepted' THEN CASE WHEN {prefix}acc + 1 < 20 THEN {prefix}acc + 1 ELSE 0 END ELSE 0 END ELSE {prefix}acc END"


@register(f"""WITH RECURSIVE {_LOG}, z AS (SELECT *, 0 AS step, 0 AS acc FROM n WHERE rn = 1),
r AS (SELECT user_id, event_id, rn, ms + 300000 AS fim, 1 AS used, {_step('', 'true')} AS step, {_acc('', 'true')} AS acc, 'sent' AS decision FROM z
UNION ALL SELECT n.user_id, n.event_id, n.rn, CASE WHEN n.ms >= r.fim THEN n.ms + ({_W})[r.step + 1] ELSE r.fim END, CASE WHEN n.ms >= r.fim THEN 1 WHEN r.used < {CALLS} THEN r.used + 1 ELSE r.used END, {_step('r.', f'(n.ms >= r.fim OR r.used < {CALLS})')}, {_acc('r.', f'(n.ms >= r.fim OR r.used < {CALLS})')}, CASE WHEN n.ms >= r.fim OR r.used < {CALLS} THEN 'sent' ELSE 'denied' END FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1)
SELECT user_id, event_id, decision FROM r""")
def window_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that open with their first call, on a ladder of widths."""
    return limits.over_log(events(spark, sf_dir), "user_id", "ts", "event_id", "outcome", partial(limits.budget, calls=CALLS))


@register("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id % 50, CAST(ts - INTERVAL 3 HOUR AS DATE) ORDER BY ts, event_id) <= 4 THEN 'sent' ELSE 'denied' END AS decision FROM events")
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget for each civil day at UTC-3."""
    return limits.civil_day(events(spark, sf_dir), "user_id", "ts", "event_id", 4).select("event_id", "decision")


_BREAKER = f"""WITH RECURSIVE {_LOG}, r AS (SELECT user_id, event_id, rn, CASE WHEN oc = 'error' THEN ms + 60000 END AS til, CASE WHEN oc = 'error' THEN 1 ELSE 0 END AS op, CASE WHEN oc = 'error' THEN 'opened' ELSE 'sent' END AS decision FROM n WHERE rn = 1
UNION ALL SELECT n.user_id, n.event_id, n.rn, CASE WHEN r.til IS NOT NULL AND n.ms < r.til THEN r.til WHEN oc = 'error' THEN n.ms + CAST(least(3600000, 60000 * pow(2, r.op)) AS BIGINT) END, CASE WHEN r.til IS NOT NULL AND n.ms < r.til THEN r.op WHEN oc = 'error' THEN r.op + 1 WHEN r.til IS NOT NULL THEN 0 ELSE r.op END,
CASE WHEN r.til IS NOT NULL AND n.ms < r.til THEN 'paused' WHEN oc = 'error' THEN CASE WHEN r.til IS NOT NULL THEN 'probe_failed' ELSE 'opened' END WHEN r.til IS NOT NULL THEN 'closed' ELSE 'sent' END FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1)"""


@register(_BREAKER + " SELECT user_id, event_id, decision FROM r")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubling pauses with one probe."""
    return limits.over_log(events(spark, sf_dir), "user_id", "ts", "event_id", "outcome", limits.breaker)


@register(_BREAKER + """ SELECT r.user_id, count(*) AS n_calls, count(*) FILTER (WHERE decision IN ('sent', 'closed')) AS n_sent, count(*) FILTER (WHERE decision = 'paused') AS n_paused, count(*) FILTER (WHERE decision IN ('opened', 'probe_failed')) AS n_opened,
max(ts) FILTER (WHERE decision IN ('sent', 'closed') AND event_type NOT IN ('error', 'signup')) AS last_success, max(ts) FILTER (WHERE event_type = 'error') AS last_refusal FROM r JOIN events e ON e.event_id = r.event_id GROUP BY r.user_id""")
def limit_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each service."""
    e = events(spark, sf_dir)
    decided = limits.over_log(e, "user_id", "ts", "event_id", "outcome", limits.breaker)
    return limits.diagnosis(decided.join(e.drop("user_id"), "event_id"), "user_id", "ts", "outcome")


@register(f"""WITH RECURSIVE {_LOG}, r AS (SELECT user_id, event_id, rn, ms AS last, 'sent' AS decision FROM n WHERE rn = 1 UNION ALL SELECT n.user_id, n.event_id, n.rn, CASE WHEN n.ms - r.last < 3600000 THEN r.last ELSE n.ms END, CASE WHEN n.ms - r.last < 3600000 THEN 'waits' ELSE 'sent' END FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1) SELECT user_id, event_id, decision FROM r""")
def call_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour at least between two calls of a service."""
    return limits.over_log(events(spark, sf_dir), "user_id", "ts", "event_id", "outcome", partial(limits.spacing, least=3_600_000))


@register("WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id % 50 AS user_id, max(ts) AS ts FROM events, m WHERE ts > now - INTERVAL 24 HOUR AND ts <= now GROUP BY 1")
def live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each key within a day."""
    e = events(spark, sf_dir)
    now = e.agg(F.max("ts")).first()[0]
    return limits.alive(e.select("user_id", "ts", "event_id"), "user_id", "ts", F.lit(now)).select("user_id", "ts")


@register("WITH s AS (SELECT event_id, ts, CAST(value AS BIGINT) + 1 AS size FROM events), r AS (SELECT *, sum(size) OVER (ORDER BY ts DESC, event_id DESC) AS run, sum(size) OVER () AS total FROM s) SELECT event_id FROM r WHERE run <= 20000 * 0.9 OR total <= 20000")
def evicted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the cap the oldest go until nine tenths are left."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", (F.round("value").cast("long") + 1).alias("size"))
    return limits.evict(e, "ts", "event_id", "size", 20000).select("event_id")


@register("WITH m AS (SELECT max(ts) AS now FROM events), e AS (SELECT user_id % 50 AS user_id, ts, event_type = 'error' AS bad FROM events), o AS (SELECT user_id, max(ts) FILTER (WHERE NOT bad) AS ok FROM e GROUP BY 1) SELECT e.user_id, count(*) AS n_refused FROM e JOIN o ON e.user_id = o.user_id, m WHERE bad AND (ok IS NULL OR ts > ok) AND ts > now - INTERVAL 240 HOUR GROUP BY e.user_id HAVING count(*) >= 1")
def refusal_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals since the last success."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 50).alias("user_id"), "ts", "event_type")
    now = e.agg(F.max("ts")).first()[0]
    return limits.refusal_hint(e, "user_id", "ts", "event_type", F.lit(now), 240, 1)
