"""Hand-computed boundary cases."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from hostlake.functions import questions as Q
from hostlake.functions import scalars as S
from hostlake.operators import accounts, agent_text, episodes, ordered, retention, rules, series, silver
from hostlake.plans.digest import node_digests
from hostlake.sources import landing

T0 = dt.datetime(2024, 1, 1)


def at(minutes=0, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def lit(ts):
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


# ---- uptime --------------------------------------------------------------------------------------

NODES = "node_id STRING"
TIMES = "node_id STRING, ts TIMESTAMP_NTZ"


def uptime(spark, times, as_of, hours=1):
    s = frame(spark, [("a", t) for t in times], TIMES)
    return values(series.uptime_segments(s, frame(spark, [("a",)], NODES), lit(as_of), hours), "start", "end", "status")


def test_uptime_gap_of_exactly_three_minutes_does_not_split(spark):
    got = uptime(spark, [at(60), at(63), at(66, 1)], at(68), 1)
    start = at(8)
    assert got == [(start, at(60), "offline"), (at(60), at(63), "online"), (at(63), at(66, 1), "offline"), (at(66, 1), at(68), "online")]


def test_uptime_without_samples_is_one_offline_segment(spark):
    s = frame(spark, [("b", at(1))], TIMES)
    got = values(series.uptime_segments(s, frame(spark, [("a",)], NODES), lit(at(60)), 1), "node_id", "start", "end", "status")
    assert got == [("a", T0, at(60), "offline")]


def test_uptime_start_at_window_start_has_no_leading_gap(spark):
    got = uptime(spark, [at(3), at(6)], at(60), 1)
    assert got[0] == (at(3), at(6), "online") and got[1] == (at(6), at(60), "offline")


# ---- counters ------------------------------------------------------------------------------------

NET = "node_id STRING, ts TIMESTAMP_NTZ, sample_id BIGINT, network ARRAY<STRUCT<interface STRING, bytes_recv BIGINT, bytes_sent BIGINT>>"


def rates(spark, *samples):
    rows = [("a", at(seconds=60 * i), i, net) for i, net in enumerate(samples)]
    return values(series.network_rates(frame(spark, rows, NET)), "sample_id", "rx_mbps")


def test_counter_reset_gives_zero(spark):
    assert rates(spark, [("eth0", 1000, 0)], [("eth0", 500, 0)]) == [(0, 0.0), (1, 0.0)]


def test_new_interface_counts_from_zero(spark):
    assert rates(spark, [("eth0", 0, 0)], [("eth0", 0, 0), ("eth1", 7_500_000, 0)])[1] == (1, 1.0)


def test_loopback_is_ignored(spark):
    assert rates(spark, [("lo", 0, 0)], [("lo", 10**9, 0)])[1] == (1, 0.0)


def test_rate_is_clamped(spark):
    assert rates(spark, [("eth0", 0, 0)], [("eth0", 10**12, 0)])[1] == (1, 1000.0)


def spikes(spark, vs):
    df = frame(spark, [("a", i, float(v)) for i, v in enumerate(vs)], "node_id STRING, i INT, v DOUBLE")
    return [v for _, v in values(series.spike_filter(df, ("v",)), "i", "v")]


def test_upper_medians(spark):
    """Against sorted lists: ties, wide ranges, neighbours inside one bucket, infinities, nulls, NaN, values not over 0, two columns."""
    rng = random.Random(8)
    lists = {"a": [rng.random() * 10 ** rng.randint(-300, 300) for _ in range(501)], "b": [7.0] * 40 + [7.000000001] * 41, "c": [1.0, 2.0], "d": [math.inf] * 3 + [1.0],
             "e": [100 + rng.random() / 1e9 for _ in range(200)], "f": [0.0, -1.0, None, math.nan, 3.0, 1.0, 2.0], "g": [5e-324, 1e-323, 1.7e308], "h": [float(rng.randint(1, 9)) for _ in range(1000)]}
    rows = [(k, v, 2 * v if v is not None and abs(v) < 1e300 else None) for k, vs in lists.items() for v in vs]
    got = {r["node_id"]: (r["m_v"], r["m_w"]) for r in series.upper_medians(spark.createDataFrame(rows, "node_id STRING, v DOUBLE, w DOUBLE"), ("v", "w")).collect()}

    def plain(vs):
        vs = sorted(v for v in vs if v is not None and v > 0)
        return vs[len(vs) // 2] if len(vs) >= 3 else None

    want = {k: (plain(vs), plain([w for n, _, w in rows if n == k])) for k, vs in lists.items()}
    assert got == {k: v for k, v in want.items() if v != (None, None)}


def test_spike_filter(spark):
    assert spikes(spark, [1, 2, 3, 500]) == [1, 2, 3, 0]
    assert spikes(spark, [1, 500]) == [1, 500]
    assert spikes(spark, [0, 0, 50, 60, 700, 601]) == [0, 0, 50, 60, 700, 601]


def test_sparkline_picks_floor_positions(spark):
    rows = [("a", at(i), i, float(i)) for i in range(45)]
    df = frame(spark, rows, "node_id STRING, ts TIMESTAMP_NTZ, sample_id BIGINT, cpu DOUBLE")
    got = [v for _, v in values(series.sparkline(df, "cpu", lit(at(45)), 24, 30, slot_seconds=300), "ts", "value")]
    assert got == [float(int(i * 1.5)) for i in range(30)]


# ---- payload shapes ------------------------------------------------------------------------------

def test_load_shapes(spark):
    bodies = ['{"load_average":{"load1":1.5}}', '{"load_average":[2.5,1]}', '{"load_average":3.5}', "{}"]
    raw = frame(spark, [(f'{{"lab_id":"n{i}","timestamp":"2024-01-01T00:00:00Z","collectors":{{"system":{b}}}}}',) for i, b in enumerate(bodies)],
                "value STRING")
    got = values(silver.system_samples(landing.land_payloads(raw)), "node_id", "load1")
    assert got == [("n0", 1.5), ("n1", 2.5), ("n2", 3.5), ("n3", None)]


def test_services_wrapped_or_bare(spark):
    body = ['{"services":[{"name":"a","healthy":false}]}', '[{"name":"b"}]']
    raw = frame(spark, [(f'{{"lab_id":"n","timestamp":"2024-01-01T00:00:00Z","collectors":{{"services":{b}}}}}',) for b in body], "value STRING")
    rows = silver.explode_items(silver.service_samples(landing.land_payloads(raw)), "services")
    assert values(rows, "name", "healthy") == [("a", False), ("b", True)]


def test_broken_lines_and_unknown_senders_are_dropped(spark):
    raw = frame(spark, [("not json",), ('{"collectors":{"system":{}}}',)], "value STRING")
    assert landing.land_payloads(raw).count() == 0


# ---- rules ---------------------------------------------------------------------------------------

SYS = ("node_id STRING, ts TIMESTAMP_NTZ, cpu_percent DOUBLE, memory_percent DOUBLE, load1 DOUBLE, cpu_count INT, "
       "disks ARRAY<STRUCT<mountpoint STRING, device STRING, used_percent DOUBLE>>")


def system_firings(spark, cpu=0.0, mem=0.0, load=0.0, cpus=1, disks=()):
    df = frame(spark, [("a", T0, cpu, mem, load, cpus, [(m, None, p) for m, p in disks])], SYS)
    return values(rules.firings({"system": df}), "alert_type", "severity", "message")


def test_thresholds_are_strict(spark):
    assert system_firings(spark, cpu=90.0) == []
    assert system_firings(spark, cpu=90.1) == [("cpu_high", "warning", "CPU usage at 90.1% (threshold: 90%)")]


def test_memory_fires_one_rule(spark):
    assert [r[0] for r in system_firings(spark, mem=96.0)] == ["memory_critical"]
    assert [r[0] for r in system_firings(spark, mem=95.0)] == ["memory_high"]


def test_first_of_equally_full_disks(spark):
    got = system_firings(spark, disks=[("/", 95.0), ("/data", 95.0)])
    assert got == [("disk_critical", "critical", "Disk usage at 95.0% (/) (threshold: 90%)")]


def test_load_rule_needs_cpu_count(spark):
    assert [r[0] for r in system_firings(spark, load=4.1, cpus=2)] == ["load_high"]
    assert system_firings(spark, load=4.1, cpus=None) == []


# ---- episodes ------------------------------------------------------------------------------------

FIRE = "node_id STRING, ts TIMESTAMP_NTZ, alert_type STRING, severity STRING, message STRING, value DOUBLE"


def run_episodes(spark, cycle_minutes, fires, **kw):
    cycles = frame(spark, [("a", at(m)) for m in cycle_minutes], TIMES)
    rows = [("a", at(m), k, s, msg, 1.0) for m, k, s, msg in fires]
    out = episodes.alert_episodes(frame(spark, rows, FIRE), cycles, **kw)
    return values(out, "alert_type", "created_at", "resolved_at", "severity", "message", "notify")


def test_severity_of_first_message_of_last(spark):
    got = run_episodes(spark, [0, 1, 2], [(0, "t", "warning", "86"), (1, "t", "critical", "97"), (2, "t", "critical", "98")])
    assert got == [("t", at(0), None, "warning", "98", True)]


def test_payload_without_collector_resolves(spark):
    assert run_episodes(spark, [0, 1], [(0, "t", "warning", "x")]) == [("t", at(0), at(1), "warning", "x", True)]


@pytest.mark.parametrize("refire, notify", [((24, 59), False), ((25, 0), True)])
def test_cooldown_is_strict(spark, refire, notify):
    t = refire[0] + refire[1] / 60
    got = run_episodes(spark, [0, 10, t], [(0, "t", "w", "a"), (t, "t", "w", "b")])
    assert [g[-1] for g in got] == [True, notify]


def test_slot_width_does_not_change_episodes(spark):
    import random

    rnd = random.Random(5)
    minutes = sorted(rnd.sample(range(3000), 400))
    fires = [(m, k, "w", f"{m}") for m in minutes for k in "xy" if rnd.random() < 0.5]
    want = run_episodes(spark, minutes, fires, slot_seconds=10**8)
    assert run_episodes(spark, minutes, fires, slot_seconds=600) == want
    # and by a plain walk over the cycles
    walk, opened, resolved = [], {}, {}
    fired = {(m, k): msg for m, k, _, msg in fires}
    for m in minutes:
        for k in "xy":
            if (m, k) in fired:
                if k in opened:
                    opened[k][4] = fired[m, k]
                else:
                    ok = not (k in resolved and resolved[k] > at(m) - dt.timedelta(minutes=15))
                    opened[k] = [k, at(m), None, "w", fired[m, k], ok]
            elif k in opened:
                opened[k][2] = resolved[k] = at(m)
                walk.append(tuple(opened.pop(k)))
    walk += [tuple(e) for e in opened.values()]
    assert sorted(walk, key=repr) == sorted(want, key=repr)


def test_offline_threshold_is_strict(spark):
    seen = frame(spark, [("a", at(0)), ("b", at(1))], "node_id STRING, last_seen TIMESTAMP_NTZ")
    assert values(seen.filter(S.online("last_seen", lit(at(5)), 5)), "node_id") == [("b",)]


def test_offline_episode_ticks(spark):
    s = frame(spark, [("a", at(0)), ("a", at(9)), ("a", at(10))], TIMES)
    got = values(rules.offline_episodes(s, lit(at(12))), "created_at", "resolved_at")
    assert got == [(at(6), at(10))]


# ---- accounts ------------------------------------------------------------------------------------

def test_threshold_cascade(spark):
    nodes = frame(spark, [("n1",), ("n2",), ("n3",)], NODES)
    own = frame(spark, [("acc", "n1"), ("acc", "n2")], "account STRING, node_id STRING")
    prefs = frame(spark, [("acc", None, {"cpu_warning": 80.0}), ("acc", "n1", {"cpu_warning": 70.0})],
                  "account STRING, node_id STRING, data MAP<STRING, DOUBLE>")
    got = values(accounts.threshold_cascade(nodes, own, prefs), "node_id", "cpu_warning", "memory_warning")
    assert got == [("n1", 70.0, 85.0), ("n2", 80.0, 85.0), ("n3", 90.0, 85.0)]


def test_retention_windows(spark):
    nodes = frame(spark, [("f",), ("p",), ("g",)], NODES)
    own = frame(spark, [("a", "f", "free"), ("a", "p", "pro"), ("a", "g", "gold")], "account STRING, node_id STRING, plan STRING")
    facts = frame(spark, [(n, T0) for n in "fpgo"], TIMES)
    late = T0 + dt.timedelta(hours=721)
    got = values(retention.expire_metrics(facts, nodes, own, lit(late)), "node_id", "expired")
    assert got == [("f", True), ("g", True), ("o", True), ("p", False)]
    on_time = T0 + dt.timedelta(hours=720)
    assert not any(e for _, e in values(retention.expire_metrics(facts, nodes, own, lit(on_time)), "node_id", "expired"))


def test_rate_limit_window_is_strict(spark):
    df = frame(spark, [("ip", at(0), 1), ("ip", at(59), 2), ("ip", at(60), 3)], "ip STRING, ts TIMESTAMP_NTZ, i INT")
    got = values(accounts.rate_limit_audit(df, ["ip"], "ts", 3600, 1), "i", "earlier", "allowed")
    assert got == [(1, 0, True), (2, 1, False), (3, 1, False)]


# ---- digest --------------------------------------------------------------------------------------

def digest_row(spark, **over):
    base = dict(node_id="a", sample_count=5, alerts_total=1, alerts_resolved=1)
    for m in ("cpu", "memory", "disk", "load"):
        base.update({f"{m}_min": 10.0, f"{m}_max": 10.0, f"{m}_avg": 10.0, f"{m}_current": 10.0})
    base.update(over)
    summary = spark.createDataFrame([base])
    return node_digests(summary, frame(spark, [("a", "h"), ("b", "h2")], "node_id STRING, hostname STRING"), 168)


def test_digest_grades(spark):
    for n, grade in enumerate(("A", "B+", "B-", "C")):
        over = dict([("cpu_max", 95.0), ("memory_avg", 75.0), ("load_avg", 11.0)][:n])
        assert values(digest_row(spark, **over), "node_id", "grade") == [("a", grade), ("b", "?")]


def test_disk_growth_days(spark):
    over = dict(disk_min=50.0, disk_max=60.0, disk_avg=55.0, disk_current=60.0)
    assert values(digest_row(spark, **over).filter("node_id = 'a'"), "days_to_full", "concerns") == [(28.0, "disk_growth")]


# ---- text ----------------------------------------------------------------------------------------

def test_level_inference(spark):
    df = frame(spark, [("Error: x",), ("warned",), ("trace y",), ("ok",)], "m STRING")
    assert [r[0] for r in df.select(S.infer_level("m")).collect()] == ["error", "warn", "debug", "info"]


def test_syslog_priorities(spark):
    got = [r[0] for r in spark.range(8).select(S.priority_to_level("id")).collect()]
    assert got == ["error"] * 4 + ["warn", "info", "info", "debug"]


@pytest.mark.parametrize("text, want", [
    ("alert me when CPU exceeds 85%", (True, "cpu_warning", 85, "warning", True)),
    ("critical disk 95", (True, "disk_critical", 95, "critical", True)),
    ("cpu 150", (False, None, None, None, False)),
    ("gpu mem 90", (True, "memory_warning", 90, "warning", True)),
    ("load 300", (True, "load_warning", 300, "warning", False)),
])
def test_rule_phrases(spark, text, want):
    assert tuple(one(spark, Q.parse_alert_rule(F.lit(text)))) == want


@pytest.mark.parametrize("text, want", [
    ("Which server uses the most CPU?", "comparative"), ("Show me all alerts", "alerts"), ("Why is pve slow?", "diagnostic"),
    ("stautus of fleet", "fleet_overview"), ("how do i add a node", "howto"), ("what's the weather", "out_of_scope"),
    ("/alerts active", "slash_alerts"), ("/cluster help", "slash_cluster_help"), ("/nope", "slash_unknown"), ("hello", "greeting"),
    ("is the server up", "status_no_target"), ("are my drives healthy", "smart"), ("xyzzy", "fallback"), ("x" * 2001, "error"),
    ("what happened last night", "time_range"), ("show logs from db", "logs"), ("привіт", "greeting"),
])
def test_routes(spark, text, want):
    df = Q.route_questions(frame(spark, [(text,)], "question STRING"))
    assert df.first()["query_type"] == want


def test_bare_host_name_is_a_status_question(spark):
    known = frame(spark, [("pve-1", "n1")], "text STRING, node_id STRING")
    df = Q.route_questions(frame(spark, [("pve-1",), ("other",)], "question STRING"), known=known)
    assert values(df, "question", "query_type") == [("other", "fallback"), ("pve-1", "status")]


def test_copies_of_a_payload_change_nothing(spark):
    fires = [(0, "t", "w", "a")] * 5 + [(1, "t", "w", "b"), (1, "u", "w", "c")]
    got = run_episodes(spark, [0, 0, 0, 1, 2], fires)
    assert got == [("t", at(0), at(2), "w", "b", True), ("u", at(1), at(2), "w", "c", True)]


def test_staged_tables(spark, tmp_path):
    from hostlake.sources import sinks

    rows = frame(spark, [("a", at(0), 1), ("b", at(1500), 2)], "node_id STRING, created_at TIMESTAMP_NTZ, v INT")
    path = str(tmp_path / "episodes")
    sinks.write_alert_episodes(rows, path)
    sinks.write_alert_episodes(rows.filter("v = 2").withColumn("v", F.lit(3)), path)
    assert values(spark.read.parquet(path), "node_id", "v") == [("a", 1), ("b", 3)]
    kept = sinks.rewrite_kept(spark, path, str(tmp_path / "next"), lambda df: df.filter("v = 3"))
    assert values(kept, "node_id") == [("b",)] and spark.read.parquet(path).count() == 2
    sinks.append_by_date(rows, str(tmp_path / "facts"), "created_at")
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 2
    logged = Q.route_questions(frame(spark, [("hello",)], "question STRING"))
    sinks.log_questions(logged, str(tmp_path / "log"))
    assert values(spark.read.parquet(str(tmp_path / "log")), "query_type", "matched") == [("greeting", True)]


def test_csv_export_columns(spark, tmp_path):
    from hostlake.plans import exports
    from hostlake.sources import testbed as T

    sf = "/root/testdata/sf0.001"
    rows = exports.system_csv(T.system_samples(spark, sf), T.registrations(spark, sf), T.as_of(), 168)
    exports.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert tuple(back.columns) == exports.CSV_COLUMNS and back.count() == rows.count()


def test_canonical_terms_longest_first(spark):
    terms = {"raconte-moi": "tell me", "raconte": "tell", "der": "", "wie": "how"}
    assert one(spark, Q.canonical_terms(F.lit("Raconte-moi der  wieder raconte wie"), terms)) == "tell me wieder tell how"


def test_uptime_text(spark):
    got = [one(spark, S.format_uptime(F.lit(s))) for s in (0, 59, 3600 + 120, 90000)]
    assert got == ["unknown", "0m", "1h 2m", "1d 1h"]


def test_until_relative(spark):
    got = [one(spark, S.until_relative(lit(at(m)), lit(T0))) for m in (0, 59, 125, 3000)]
    assert got == ["expired", "59m left", "2h 5m left", "2d left"]


def test_container_share():
    assert [agent_text.container_share(100, n) for n in (0, 4, 50)] == [100, 25, 10]


# ---- ordered helpers -----------------------------------------------------------------------------

def test_slot_width_follows_density(spark):
    df = frame(spark, [("a", at(seconds=i)) for i in range(2000)], TIMES)
    width = ordered.slot_seconds_for(df, ["node_id"], "ts", max_rows=100, start=3600)
    fullest = df.groupBy("node_id", ordered.time_slot("ts", width)).count().agg(F.max("count")).first()[0]
    assert fullest <= 100


def test_neighbours_across_empty_slots(spark):
    df = frame(spark, [("a", at(m), m) for m in (0, 1, 200, 201, 500)], "k STRING, ts TIMESTAMP_NTZ, v INT")
    out = ordered.with_neighbours(df, ["k"], "ts", ["v"], lead=True, slot_seconds=3600)
    assert values(out, "v", "prev_v", "next_v") == [(0, None, 1), (1, 0, 200), (200, 1, 201), (201, 200, 500), (500, 201, None)]
    pos = ordered.with_position(df, ["k"], "ts", slot_seconds=3600)
    assert values(pos, "v", "pos", "group_size") == [(0, 0, 5), (1, 1, 5), (200, 2, 5), (201, 3, 5), (500, 4, 5)]


@pytest.mark.parametrize("length", [2, 7, 70, 2000])
def test_names_of_any_length_match(spark, length):
    from hostlake.operators import names

    host = ("h" + "0123456789abcdefghijklmnopqrstuvwxyz" * 60)[:length]
    nodes = frame(spark, [("n1", host, at(0)), ("n2", "#" * 300, at(1))], "node_id STRING, hostname STRING, last_seen TIMESTAMP_NTZ")
    asked = frame(spark, [(f"status of {host.upper()} now",), (host,), (host[:max(1, length - 4)],), ("",), (None,)], "name STRING")
    assert {r["name"] for r in names.match_node(asked, nodes).filter("node_id = 'n1'").collect()} == {r["name"] for r in asked.collect() if r["name"]}
    texts = frame(spark, [(f"is {host} up?",), ("x " * 3000 + host,), ("nothing",)], "text STRING")
    assert names.extract_node_name(texts, nodes).filter("node_id = 'n1'").count() == 2
    rows = frame(spark, [("n1", 0, host, "running", "", 0)], "node_id STRING, pos INT, name STRING, state STRING, status STRING, restart_count INT")
    assert names.find_container(asked, rows, nodes).count() == 3


def test_names_in_texts_are_those_of_brute_force(spark):
    """Names of all sizes in texts of all sizes, beyond ASCII too; only places where a name may be become rows."""
    import random

    from hostlake.operators import names
    from hostlake.operators.grams import SIZES, bitmap, grams

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé日-1") for _ in range(n))
    wanted = [word(n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 15, 16, 17, 31, 32, 40, 90) for _ in range(4)]
    given = [word(n) + rng.choice(wanted) + word(n) for n in (0, 1, 30, 300) for _ in range(40)] + ["", None, "x" * 5000]
    texts, asked = frame(spark, [(t,) for t in given], "body STRING"), frame(spark, [(w,) for w in wanted] + [("",), (None,)], "name STRING")
    got = {(r["body"], r["name"]) for r in names.contained(texts, "body", asked, "name").collect()}
    assert got == {(t, w) for t in given if t for w in wanted if w in t} and len({len(w) for _, w in got}) > 12
    one = grams(frame(spark, [("building-77",)], "name STRING"), "name", "name")
    long = frame(spark, [(i, f"{i} words " * 2000) for i in range(5)] + [(5, "is building-77 up")], "k INT, body STRING")
    found = grams(long, "k", "body", bitmap(one)).collect()
    assert {r["k"] for r in found} == {5} and len(found) == 4 and {r["size"] for r in found} == {8} and 8 in SIZES


def test_rows_of_grams_are_measured_before_they_are_joined(spark):
    """A broadcast of rows that a small table was expanded into, unseen by Spark's estimate, took the driver's memory."""
    from hostlake.operators import names

    asked = frame(spark, [(f"node building-{i}",) for i in range(50)], "name STRING")
    nodes = frame(spark, [(f"n{i}", f"building-{i}", at(i)) for i in range(50)], "node_id STRING, hostname STRING, last_seen TIMESTAMP_NTZ")
    got = names.match_node(asked, nodes)
    assert got.count() == 50
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    above = lambda i: next((x for x in reversed(plan[:i]) if "Exchange" in x), "")
    expanded = [i for i, x in enumerate(plan) if "MapInArrow" in x or "Generate explode" in x]
    assert expanded and all("hashpartitioning" in above(i) for i in expanded)


def test_a_node_registered_twice_multiplies_nothing(spark):
    nodes = frame(spark, [("n1",), ("n2",)], "node_id STRING")
    own = frame(spark, [("a", "n1", "free", at(0)), ("b", "n1", "pro", at(1)), ("b", "n2", "pro", at(1))],
                "account STRING, node_id STRING, plan STRING, created_at TIMESTAMP_NTZ")
    assert values(accounts.node_plan(nodes, own), "node_id", "plan") == [("n1", "pro"), ("n2", "pro")]
    facts = frame(spark, [("n1", at(0)), ("n2", at(0)), ("n3", at(0))], "node_id STRING, ts TIMESTAMP_NTZ")
    assert values(retention.metric_windows(nodes, own), "node_id", "hours") == [("n2", 8760)]
    assert retention.expire_metrics(facts, nodes, own, lit(at(1))).count() == 3
    assert retention.expire_logs(facts, nodes, own, lit(at(1))).count() == 3
    prefs = frame(spark, [("b", None, {"cpu_warning": 50.0})], "account STRING, node_id STRING, data MAP<STRING, DOUBLE>")
    assert values(accounts.threshold_cascade(nodes, own, prefs), "node_id", "cpu_warning") == [("n1", 50.0), ("n2", 50.0)]


def test_retention_touches_only_dates_that_can_expire(spark, tmp_path):
    import datetime as dt
    import os

    from hostlake.operators.selection import window_since
    from hostlake.sources import sinks

    now = dt.datetime(2024, 1, 31)
    rows = frame(spark, [("n1", now - dt.timedelta(days=k), k) for k in range(40)], "node_id STRING, ts TIMESTAMP_NTZ, k INT")
    path = str(tmp_path / "facts")
    sinks.append_by_date(rows, path)
    files = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("date=")}
    done = sinks.expire_dates(spark, path, str(tmp_path / "staged"), lambda df: df.filter("k < 12"), now, 10 * 24, 20 * 24)
    assert (len(done["kept"]), len(done["rewritten"]), len(done["dropped"])) == (10, 11, 19)
    assert all(sorted(os.listdir(f"{path}/date={d}")) == files[f"date={d}"] for d in done["kept"])
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == list(range(12))
    plan = window_since(spark.read.parquet(path), 48, lit(now))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_episode_upsert_keeps_the_other_rows_of_a_date(spark, tmp_path):
    from hostlake.sources import sinks

    schema = "node_id STRING, alert_type STRING, created_at TIMESTAMP_NTZ, v INT"
    path = str(tmp_path / "episodes")
    sinks.upsert_episodes(spark, frame(spark, [("a", "t", at(0), 1), ("b", "t", at(0), 2), ("c", "t", at(3000), 3)], schema), path, str(tmp_path / "s1"))
    sinks.upsert_episodes(spark, frame(spark, [("a", "t", at(0), 9), ("d", "t", at(1), 4)], schema), path, str(tmp_path / "s2"))
    assert values(spark.read.parquet(path), "node_id", "v") == [("a", 9), ("b", 2), ("c", 3), ("d", 4)]
