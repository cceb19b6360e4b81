import datetime as dt
import random
from functools import partial

from pyspark.sql import functions as F

from lodestrata.streaming import limits as m

MIN = m.MINUTE


def run(rule, events):
    state, out = None, []
    for e in events:
        said, state = rule(state, *e)
        out.append(said)
    return out, state


def test_budget_windows_open_at_the_first_call():
    said, _ = run(partial(m.budget, calls=2), [(0, "accepted"), (MIN, "accepted"), (2 * MIN, "accepted"), (5 * MIN, "accepted")])
    assert said == ["sent", "sent", "denied", "sent"]


def test_refusals_widen_and_accepted_calls_narrow():
    rule = partial(m.budget, calls=100)
    _, s = run(rule, [(0, "refused"), (1, "refused"), (2, "refused"), (3, "refused")])
    assert s[2] == 3 and s[0] == 5 * MIN
    for n in range(m.ACCEPTED_TO_LOWER):
        _, s = rule(s, 10 + n, "accepted")
    assert s[2] == 2


def test_brake_rests_and_one_call_releases():
    said, s = run(m.brake, [(0, "call", None), (1, "answer", 11), (2, "call", None), (3, "call", None)])
    assert said == ["sent", "noted", "sent", "paused"]
    said, s = m.brake(s, 4, "answer", 50)  # a late answer never ends a pause
    assert s[2] is not None
    later = 4 + m.PAUSE
    said, s = m.brake(s, later, "call", None)
    assert said == "released" and m.brake(s, later, "call", None)[0] == "waits"
    assert m.brake(s, later + 1, "release_answer", 40)[0] == "resumed"
    assert m.brake(s, later + 1, "release_answer", 3)[0] == "paused"


def test_breaker_doubles_and_stale_results_change_nothing():
    said, s = run(m.breaker, [(0, "error"), (1, "accepted"), (MIN, "error"), (2 * MIN, "accepted"), (3 * MIN, "accepted")])
    assert said == ["opened", "paused", "probe_failed", "paused", "closed"]
    assert m.breaker((None, 0, 3), 5, "error", generation=2) == ("stale", (None, 0, 3))


def log(spark, n=400):
    r = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, r.randrange(5), t0 + dt.timedelta(seconds=r.randrange(20_000)), r.choice(["accepted", "accepted", "refused", "error"])) for k in range(n)]
    return sorted(rows, key=lambda x: (x[2], x[0])), "event_id long, service int, ts timestamp, outcome string"


def test_stream_and_batch_agree(spark, tmp_path):
    rows, schema = log(spark)
    df = spark.createDataFrame(rows, schema)
    for n in range(4):  # files in time order, one a batch
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    for rule, state in ((partial(m.budget, calls=3), m.BUDGET_STATE), (m.breaker, m.BREAKER_STATE)):
        want = {tuple(r) for r in m.over_log(df, "service", "ts", "event_id", "outcome", rule).collect()}
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        name = f"out{len(state)}"
        q = m.over_stream(stream, "service", "ts", "event_id", "outcome", rule, state).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert {tuple(r) for r in spark.table(name).collect()} == want


def test_day_of_the_west(spark):
    rows = [(1, 1, dt.datetime(2024, 1, 1, 2, 59), "x"), (2, 1, dt.datetime(2024, 1, 1, 3, 0), "x"), (3, 1, dt.datetime(2024, 1, 2, 2, 0), "x")]
    got = {r.event_id: r.decision for r in m.civil_day(spark.createDataFrame(rows, "event_id long, service int, ts timestamp, outcome string"), "service", "ts", "event_id", 1).collect()}
    assert got == {1: "sent", 2: "sent", 3: "denied"}


def test_eviction_keeps_the_newest(spark):
    rows = [(n, dt.datetime(2024, 1, 1) + dt.timedelta(hours=n), 10) for n in range(50)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, size long")
    assert sorted(r.id for r in m.evict(df, "ts", "id", "size", 200).collect()) == list(range(32, 50))
    assert m.evict(df, "ts", "id", "size", 500).count() == 50
    assert m.alive(df.withColumn("k", F.lit(1)).select("k", "ts", "id"), "k", "ts", F.lit(dt.datetime(2024, 1, 3))).first()["id"] == 48
