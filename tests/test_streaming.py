"""Streams give what batches give."""

import json
import os
import random

from pyspark.sql import functions as F

from pulsegrid.plans.settings import DEFAULT
from pulsegrid.streaming import monitor

DATA = "/root/testdata/sf0.001/events.parquet"


def drained(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path):
    batch = spark.read.parquet(DATA)
    batch.write.parquet(str(tmp_path / "events"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))


def test_sliding_and_sessions(spark, tmp_path):
    """A last event, long after all others, moves the watermark past every window but its own."""
    batch, _ = source(spark, tmp_path)
    last = batch.orderBy(F.desc("ts")).limit(1).withColumns({"user_id": F.lit(-1).cast("bigint"), "value": F.lit(1.0), "ts": F.col("ts") + F.expr("interval 60 days")})
    last.select(*batch.columns).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))
    for k, f in enumerate((monitor.sliding, monitor.alarm_sessions)):
        want = sorted(tuple(r)[:4] for r in f(batch).collect())
        got = sorted(tuple(r)[:4] for r in drained(spark, f(stream), f"out{k}").where("user_id >= 0").collect())
        assert got == want and want


def test_interval_join(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    split = lambda df: (df.where("value < 20").select("user_id", F.col("ts").alias("at")), df.where("value < 10").select("user_id", F.col("ts").alias("onset")))
    want = sorted(map(tuple, monitor.alarms_before(*split(batch)).collect()))
    assert sorted(map(tuple, drained(spark, monitor.alarms_before(*split(stream)), "joined").collect())) == want and want


def states_by_hand(rows, expiry):
    """(user, at, state) of rows (user, us, event_id, value), user by user in order of time."""
    out = []
    for user in {r[0] for r in rows}:
        run, last = 0, None
        for _, us, _, value in sorted(r for r in rows if r[0] == user):
            if last is not None and us - last >= expiry:
                out += [(user, last + expiry, "off")] * (run >= DEFAULT.min_run)
                run = 0
            before, run = run, run + 1 if value < DEFAULT.low else 0
            if run == DEFAULT.min_run:
                out.append((user, us, "on"))
            if value >= DEFAULT.low and before >= DEFAULT.min_run:
                out.append((user, us, "off"))
            last = us
        if run >= DEFAULT.min_run:
            out.append((user, last + expiry, "off"))
    return sorted(out)


def test_state_machine(spark, tmp_path):
    """Four micro-batches, each shuffled and with rows that belong to the one before, give what the whole table gives.
    A row beyond the allowed lateness is dropped, and after the expiry no state is left."""
    hour, base = 3_600_000_000, 1_704_067_200_000_000
    rng = random.Random(3)
    rows = [(u, base + k * 7 * hour + u, 1000 * u + k, rng.choice([5.0, 10.0, 30.0, 50.0])) for u in range(12) for k in range(40) if u != 3 or k not in range(10, 20)]
    rows += [(20, base, 1, 5.0), (20, base + 1, 2, 5.0)]  # its alarm ends by expiry
    ends = base + 60 * 24 * hour
    order = sorted(rows, key=lambda r: r[1] + rng.randint(0, 20 * hour))  # out of order by up to 20 hours
    schema = "user_id long, us long, event_id long, value double"
    parts = [order[i * len(order) // 4 : (i + 1) * len(order) // 4] for i in range(4)]
    parts[3].append((5, base + 3, 77, 5.0))  # far too late
    parts += [[(-1, ends, 1, 50.0)], [(-1, ends + hour, 2, 50.0)]]
    for i, part in enumerate(parts):
        path = tmp_path / "in" / f"{i}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(json.dumps({"user_id": u, "us": us, "event_id": e, "value": v}) + "\n" for u, us, e, v in part))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros("us"))
    states = monitor.alarm_states(stream, late="21 hours")
    check = str(tmp_path / "check")
    q = states.writeStream.outputMode("append").format("memory").queryName("states").option("checkpointLocation", check).trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None
    got = spark.table("states").select("user_id", F.unix_micros("at").alias("at"), "state").where("user_id >= 0").collect()
    want = states_by_hand(rows, DEFAULT.window_h * hour)
    assert sorted(map(tuple, got)) == want and (20, base + 1 + DEFAULT.window_h * hour, "off") in want and len(want) > 50
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 6
    left = [spark.read.format("statestore").option("path", check).option("stateVarName", v).load() for v in ("run", "held")]
    assert [{r.key.user_id for r in x.select("key").collect()} - {-1} for x in left] == [set(), set()]
