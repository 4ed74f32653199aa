"""Streams fed in several steps give the rows of their batch twins."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from hostlake.operators import series
from hostlake.operators.episodes import alert_episodes
from hostlake.operators.rules import firings, offline_episodes
from hostlake.sources import landing, sinks
from hostlake.sources import testbed as T
from hostlake.streaming import jobs

SF = "/root/testdata/sf0.001"
LATE_MINUTES = 20 * 1440  # the steps deal events by id, so each holds rows of the whole month: later rows belong between earlier ones


def in_steps(spark, tmp_path, build, name):
    """Runs the stream over the events cut into four files, one trigger per file, and returns all rows."""
    src = os.path.join(tmp_path, "src")
    events = T.table(spark, SF, "events")
    q25, q50, q75 = events.selectExpr("percentile(event_id, array(0.25, 0.5, 0.75)) AS q").first()["q"]
    out, check = os.path.join(tmp_path, "out"), os.path.join(tmp_path, "check")
    for i, (lo, hi) in enumerate(((-1, q25), (q25, q50), (q50, q75), (q75, 10**12))):
        part = events.filter((F.col("event_id") > lo) & (F.col("event_id") <= hi))
        part.coalesce(1).write.mode("append").parquet(os.path.join(src, f"p{i}"))
        stream = spark.readStream.schema(T.SCHEMAS["events"]).parquet(os.path.join(src, "p*"))
        df = build(T.system_samples(spark, SF, stream).withColumn("ts", F.col("ts").cast("timestamp")))
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def watermark(spark, late=10):
    """Rows up to here are out at the end of a stream: the newest time less the allowed lateness."""
    newest = T.table(spark, SF, "events").selectExpr("max(ts) AS t").first()["t"]
    return F.lit(newest - dt.timedelta(minutes=late)).cast("timestamp")


def rows(df, *cols):
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


def test_rates_carry_state_over_triggers(spark, tmp_path):
    jobs.use_rocksdb(spark)
    got = in_steps(spark, str(tmp_path), lambda s: jobs.counter_rates(s, late=f"{LATE_MINUTES} minutes"), "rates")
    want = series.network_rates(T.system_samples(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")))
    want = want.filter(F.col("ts") <= watermark(spark, LATE_MINUTES))
    assert rows(got, "node_id", "ts", "rx_mbps", "tx_mbps") == rows(want, "node_id", "ts", "rx_mbps", "tx_mbps")


def test_episodes_carry_state_over_triggers(spark, tmp_path):
    jobs.use_rocksdb(spark)
    got = in_steps(spark, str(tmp_path), lambda s: jobs.episode_stream(jobs.system_cycle_firings(s), late=f"{LATE_MINUTES} minutes"), "ep")
    s = T.system_samples(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    want = alert_episodes(firings({"system": s}), s)
    cols = ("node_id", "alert_type", "created_at", "severity", "notify")
    end = watermark(spark, LATE_MINUTES)
    assert want.filter(F.col("created_at") > end).count() and want.filter(F.col("created_at") <= end).count() > 200
    assert rows(got.filter("event = 'opened'"), *cols) == rows(want.filter(F.col("created_at") <= end), *cols)
    done = got.filter("event = 'resolved'").withColumn("resolved_at", F.col("at"))
    assert rows(done, *cols[:3], "resolved_at") == rows(want.filter(F.col("resolved_at") <= end), *cols[:3], "resolved_at")


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 4, 5], [2, 5]])
def test_offline_is_the_same_in_any_triggers(spark, tmp_path, cuts):
    """Six payloads with silences between them, cut into triggers anywhere, and a late row that changes nothing."""
    jobs.use_rocksdb(spark)
    t0 = dt.datetime(2024, 1, 1)
    seen = [t0 + dt.timedelta(seconds=s) for s in (0, 60, 3600, 3700, 9000, 9300)]
    schema = "node_id STRING, ts TIMESTAMP"
    out, check, src = (str(tmp_path / x) for x in ("out", "check", "src"))
    edges = [0, *cuts, len(seen)]
    for a, b in zip(edges, edges[1:]):
        part = [("n1", t) for t in seen[a:b]] + ([("n1", seen[a - 1] - dt.timedelta(seconds=1))] if a else [])  # dropped: too late
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{src}/p{a}")
        rows_ = spark.readStream.schema(schema).parquet(f"{src}/p*")
        none = F.expr("array()").cast("array<struct<alert_type:string,severity:string,message:string>>")
        df = jobs.episode_stream(rows_.select("node_id", "ts", none.alias("fired")), offline_minutes=5, late="0 seconds")
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(df.schema).parquet(out)
    batch = offline_episodes(spark.createDataFrame([("n1", t) for t in seen], schema), F.lit(seen[-1]).cast("timestamp"), 5)
    want = sorted((r.created_at, r.resolved_at) for r in batch.collect())
    opened = sorted(r["at"] for r in got.filter("event = 'opened'").collect())
    closed = sorted((r["created_at"], r["at"]) for r in got.filter("event = 'resolved'").collect())
    assert opened == [a for a, _ in want] and len(want) == 2 and [b for _, b in closed] == [b for _, b in want]


@pytest.mark.parametrize("order,cuts", [([0, 1, 2, 3, 4, 5, 6], []), ([0, 1, 2, 3, 4, 5, 6], [2]), ([5, 2, 0, 1, 4, 3, 6], [1, 3, 5]), ([1, 0, 3, 2, 5, 4, 6], [2])])
def test_rows_of_one_time_are_one_payload(spark, tmp_path, order, cuts):
    """Rows of a node with equal times and different firings, in any order and in any triggers, give the batch episodes."""
    jobs.use_rocksdb(spark)
    t0 = dt.datetime(2024, 1, 1)
    given = [(0, []), (60, [("cpu", "warning", "c1")]), (60, [("disk", "critical", "d1"), ("cpu", "critical", "c0")]), (120, [("disk", "critical", "d2")]), (120, []), (180, []),
             (9000, [])]
    schema = "node_id STRING, ts TIMESTAMP, fired ARRAY<STRUCT<alert_type: STRING, severity: STRING, message: STRING>>"
    rows_ = [("n1", t0 + dt.timedelta(seconds=given[i][0]), given[i][1]) for i in order]
    out, check, src = (str(tmp_path / x) for x in ("out", "check", "src"))
    edges = [0, *cuts, len(rows_)]
    for a, b in zip(edges, edges[1:]):
        spark.createDataFrame(rows_[a:b], schema).coalesce(1).write.mode("append").parquet(f"{src}/p{a}")
        df = jobs.episode_stream(spark.readStream.schema(schema).parquet(f"{src}/p*"), late="145 minutes")
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(df.schema).parquet(out)
    all_rows = spark.createDataFrame(rows_, schema)
    fired = all_rows.select("node_id", "ts", F.explode("fired").alias("f")).select("node_id", "ts", "f.*", F.lit(None).cast("double").alias("value"))
    want = alert_episodes(fired, all_rows.select("node_id", "ts"))
    cols = ("node_id", "alert_type", "created_at", "severity", "notify")
    assert want.count() == 2 and rows(got.filter("event = 'opened'"), *cols) == rows(want, *cols)
    done = got.filter("event = 'resolved'").withColumn("resolved_at", F.col("at"))
    assert rows(done, *cols[:3], "resolved_at") == rows(want, *cols[:3], "resolved_at")


def payloads(spark, lines, path):
    spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.mode("append").text(path)
    return jobs.payload_stream(spark.readStream.text(path))


def payload(second, cpu):
    return json.dumps({"lab_id": "n1", "timestamp": f"2024-01-01T00:00:{second:02d}Z", "collectors": {"system": {"cpu": {"total_percent": cpu, "count": 4}}}})


def test_thresholds_are_read_for_each_batch(spark, tmp_path):
    """A limit that changes between two micro-batches counts for the second one; a replayed batch writes over its own folder."""
    limits, src, out, check = [90.0], str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "check")
    read = lambda: spark.createDataFrame([("n1", limits[0])], "node_id STRING, cpu_warning DOUBLE")
    for second, limit in ((0, 90.0), (30, 50.0)):
        limits[0] = limit
        jobs.fire_batches(payloads(spark, [payload(second, 70)], src), read, out, check).awaitTermination()
    got = spark.read.parquet(out).select("ts", F.size("fired").alias("n")).orderBy("ts").collect()
    assert [r["n"] for r in got] == [0, 1]


def test_versions_of_thresholds_hold_at_the_time_of_a_payload(spark):
    """The newest version at or before a payload's time; before the first one the defaults; null versions and unknown nodes too."""
    raw = spark.createDataFrame([(payload(s, 70),) for s in (0, 10, 20, 30)] + [("{}",), (None,)], "value STRING")
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    versions = spark.createDataFrame([("n1", t(10), 60.0), ("n1", t(20), 80.0), ("n1", t(30), None), ("n2", t(0), 1.0)], "node_id STRING, valid_from TIMESTAMP, cpu_warning DOUBLE")
    got = jobs.payload_firings(landing.whole_payloads(raw), versions).select("ts", F.size("fired").alias("n")).orderBy("ts").collect()
    assert [r["n"] for r in got] == [0, 1, 0, 0]
    assert jobs.payload_firings(landing.whole_payloads(raw)).filter("size(fired) > 0").count() == 0


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """Batches merge once each: a replay of the last or an older one leaves the table as it is; dates without changes keep their files."""
    path = str(tmp_path / "episodes")
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    schema = "node_id STRING, alert_type STRING, event STRING, at TIMESTAMP, created_at TIMESTAMP, severity STRING, message STRING, notify BOOLEAN"
    one = spark.createDataFrame([("n1", "cpu", "opened", t(1, 1), t(1, 1), "warning", "a", True), ("n1", "disk", "opened", t(2, 1), t(2, 1), "critical", "b", True),
                                 ("n2", "cpu", "opened", t(1, 1), t(1, 1), "warning", "c", True), ("n2", "cpu", "resolved", t(1, 2), t(1, 1), "warning", "c2", True)], schema)
    two = spark.createDataFrame([("n1", "cpu", "resolved", t(3, 1), t(1, 1), "warning", "a2", True)], schema)
    table = lambda: rows(sinks.stored_episodes(spark, path), "node_id", "alert_type", "created_at", "message", "resolved_at", "notify")
    files = lambda day: sorted(f for f in os.listdir(f"{path}/date=2024-01-{day:02d}") if f.endswith("parquet"))
    assert sinks.last_applied(spark, path) == -1
    assert sinks.merge_episode_changes(one, 0, path) and len(table()) == 3
    first, second_day = table(), files(2)
    assert not sinks.merge_episode_changes(one, 0, path) and table() == first
    assert sinks.merge_episode_changes(two, 1, path) and len(table()) == 3 and table() != first and files(2) == second_day
    now = table()
    for batch, changes in ((1, two), (0, one)):
        assert not sinks.merge_episode_changes(changes, batch, path) and table() == now
    assert sinks.merge_episode_changes(two.limit(0), 2, path) and table() == now and sinks.last_applied(spark, path) == 2
    sinks.upsert_episodes(spark, spark.read.parquet(path).drop("date"), path, str(tmp_path / "again"))  # a batch lost between merge and note: the same rows again
    assert table() == now


def test_a_node_is_one_read_and_one_write_a_trigger():
    """However many rows and weeks are released, the processors call the state server for one value and at most one timer."""
    import pandas as pd

    calls = []

    class Handle:
        def getValueState(self, name, schema):
            self.value = None
            return self

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def registerTimer(self, ms):
            calls.append("timer")

        def getCurrentWatermarkInMs(self):
            return 4_000_000_000

    fired = json.dumps([{"fired": [{"alert_type": "cpu", "severity": "warning", "message": "m"}]}])
    rows_ = pd.DataFrame({"us": [w * 7 * 86_400_000_000 for w in range(6, -1, -1)], "items": [fired, '[{"fired":[]}]'] * 3 + [fired]})
    handle = Handle()
    episodes = jobs.Episodes(offline_minutes=5)
    episodes.init(handle)
    out = pd.concat(episodes.handleInputRows(("n1",), iter([rows_]), handle))
    assert calls == ["get", "update"]
    assert out[out["alert_type"] == "cpu"]["event"].tolist() == ["opened", "resolved"] * 3 + ["opened"] and (out["alert_type"] == "node_offline").sum() == 13


def test_parts_of_payloads_are_in_order_and_from_many_tasks(spark, tmp_path):
    from hostlake.checks.streams import payload_parts

    path, newest, n = str(tmp_path / "lines"), "", 0
    for i in payload_parts(spark, SF, 3, path):
        part = spark.read.text(f"{path}/part{i}").select(F.get_json_object("value", "$.timestamp").alias("t"))
        low, high, rows_ = part.agg(F.min("t"), F.max("t"), F.count("t")).first()
        assert low > newest and rows_ > 200
        newest, n = high, n + rows_
    assert n == T.payload_lines(spark, SF).count()


def test_nodes_of_a_bucket_are_one_read_and_one_write():
    """The rows of many nodes in one frame give each node's own events, for one value read and written."""
    import pandas as pd

    class Handle:
        calls, value = [], None

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    fired = json.dumps([{"fired": [{"alert_type": "cpu", "severity": "warning", "message": "m"}]}])
    given = [("n2", 30, fired), ("n1", 20, '[{"fired":[]}]'), ("n1", 10, fired), (None, 15, fired), ("n2", 5, '[{"fired":[]}]')]
    later = [("n1", 50, fired), ("n2", 60, '[{"fired":[]}]'), (None, 70, '[{"fired":[]}]'), ("null", 80, fired)]
    handle, out = Handle(), []
    episodes = jobs.Episodes(cooldown_minutes=0)
    episodes.init(handle)
    for part in (given, later):
        frame = pd.DataFrame(part, columns=["node_id", "us", "items"])
        out += [tuple(r) for x in episodes.handleInputRows((7,), iter([frame]), handle) for r in x[["node_id", "event", "at"]].itertuples(index=False)]
    assert handle.calls == ["get", "update"] * 2
    assert sorted((n or "", e, int(at.value // 1000)) for n, e, at in out) == [
        ("", "opened", 15), ("", "resolved", 70), ("n1", "opened", 10), ("n1", "opened", 50), ("n1", "resolved", 20), ("n2", "opened", 30), ("n2", "resolved", 60),
        ("null", "opened", 80)]


@pytest.mark.parametrize("cuts", [[], [4, 7]])
def test_silences_of_nodes_that_share_a_key(spark, tmp_path, monkeypatch, cuts):
    """Nodes of one key fall silent at their own times, with rows of others in between, in any triggers."""
    monkeypatch.setattr(jobs, "BUCKETS", 1)
    jobs.use_rocksdb(spark)
    t0 = dt.datetime(2024, 1, 1)
    seen = [("n1", 0), ("n2", 30), ("n3", 60), ("n2", 3600), ("n1", 3700), ("n3", 3720), ("n2", 9000), ("n1", 9300), ("n2", 9310), ("n1", 20000)]
    schema = "node_id STRING, ts TIMESTAMP"
    given = [(n, t0 + dt.timedelta(seconds=s)) for n, s in seen]
    out, check, src = (str(tmp_path / x) for x in ("out", "check", "src"))
    edges = [0, *cuts, len(seen)]
    for a, b in zip(edges, edges[1:]):
        spark.createDataFrame(given[a:b], schema).coalesce(1).write.mode("append").parquet(f"{src}/p{a}")
        none = F.expr("array()").cast("array<struct<alert_type:string,severity:string,message:string>>")
        df = jobs.episode_stream(spark.readStream.schema(schema).parquet(f"{src}/p*").select("node_id", "ts", none.alias("fired")), offline_minutes=5, late="0 seconds")
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(df.schema).parquet(out)
    batch = offline_episodes(spark.createDataFrame(given, schema), F.lit(given[-1][1]).cast("timestamp"), 5)
    opened, closed = got.filter("event = 'opened'"), got.filter("event = 'resolved'").withColumn("resolved_at", F.col("at"))
    closed = closed.filter(F.col("at") <= given[-1][1])  # the batch ends there, before the check that ends the last silence
    assert batch.count() >= 7 and rows(opened, "node_id", "created_at") == rows(batch, "node_id", "created_at")
    assert rows(closed, "node_id", "created_at", "resolved_at") == rows(batch.filter("resolved_at IS NOT NULL"), "node_id", "created_at", "resolved_at")


def test_a_line_is_parsed_once_and_meets_the_thresholds_as_values(spark, tmp_path):
    """One from_json a line, and whole payloads don't go through the join with the thresholds; the join gives the rows of the rules alone."""
    spark.createDataFrame([(payload(s, 70),) for s in (0, 10)] + [("{}",), ('{"lab_id":"n1"}',), ("x",), (None,)], "value STRING").write.text(str(tmp_path / "l"))
    limits = spark.createDataFrame([("n1", 60.0)], "node_id STRING, cpu_warning DOUBLE")
    df = jobs.payload_firings(landing.whole_payloads(spark.read.text(str(tmp_path / "l"))), limits)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and 0 < plan.index("Join") < plan.index("try_variant_get(")
    assert [r["n"] for r in df.select(F.size("fired").alias("n")).collect()] == [1, 1]


def test_parts_are_written_once_and_may_be_empty(spark, tmp_path):
    """Lines are moved, not copied, into their part; rows of one time are one part and the others are there without rows; null lines are none."""
    from hostlake.checks.streams import payload_parts

    t = dt.datetime(2024, 1, 1)
    events = [(i, t, i % 2, "view", 1.0, '{"k": 5}') for i in range(6)] + [(6, None, 1, "view", 1.0, '{"k": 5}'), (7, t, None, "view", 1.0, '{"k": 5}')]
    spark.createDataFrame(events, "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING").selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    path, staged = str(tmp_path / "lines"), lambda: {f for f in os.listdir(spark.conf.get("spark.checkpoint.dir")) if f.startswith("staged-lines")}
    before = staged()
    assert [spark.read.text(f"{path}/part{i}").count() for i in payload_parts(spark, str(tmp_path), 3, path)] == [6, 0, 0]
    left = [f for d in staged() - before for _, _, names in os.walk(os.path.join(spark.conf.get("spark.checkpoint.dir"), d)) for f in names if f.startswith("part-")]
    assert left == []
