"""Ownership, plans, retention, erasure, upserts, limits."""

from pyspark.sql import functions as F

from ..functions.scalars import clean_email, redact_config, sanitise_hostname, valid_email
from ..operators import accounts as acc
from ..operators import latest, retention
from ..operators import selection as sel
from ..plans import reports as R
from ..sources import landing
from ..sources import testbed as T
from .base import AS_OF, query


@query("scope_account", "SELECT alert_id, al.node_id, severity FROM al JOIN own USING (node_id) WHERE account = 'acct7'")
def _(spark, d):
    return sel.scope(T.alerts(spark, d), T.ownership(spark, d), "acct7").select("alert_id", "node_id", "severity")


@query("nodes_of_account", "SELECT reg.*, account FROM reg JOIN own USING (node_id)")
def _(spark, d):
    return acc.nodes_of_account(T.registrations(spark, d), T.ownership(spark, d))


@query("node_plan", "SELECT reg.node_id, coalesce(plan, 'free') AS plan FROM reg LEFT JOIN own USING (node_id)")
def _(spark, d):
    return acc.node_plan(T.registrations(spark, d), T.ownership(spark, d))


PLAN = "pa AS (SELECT account, coalesce(p, 'free') AS plan FROM (SELECT account, plan AS p FROM own QUALIFY row_number() OVER (PARTITION BY account ORDER BY created_at DESC, node_id DESC) = 1))"


@query("plan_of_account", f"WITH {PLAN} SELECT * FROM pa")
def _(spark, d):
    return acc.plan_of_account(T.ownership(spark, d))


@query("account_node_usage", f"""WITH {PLAN}, c AS (SELECT account, count(*) AS node_count FROM own GROUP BY 1)
    SELECT account, plan, node_count, CASE WHEN plan = 'free' THEN 3 END AS node_cap, CASE WHEN plan = 'free' THEN greatest(3 - node_count, 0) END AS remaining,
    plan = 'free' AND node_count >= 3 AS at_limit FROM c JOIN pa USING (account)""")
def _(spark, d):
    return acc.account_node_usage(T.ownership(spark, d))


@query("orphan_metrics", "SELECT node_id, ts, sample_id FROM e WHERE node_id NOT IN (SELECT node_id FROM reg)")
def _(spark, d):
    return acc.orphans(T._base(spark, d).select("node_id", "ts", "sample_id"), T.registrations(spark, d))


@query("plan_retention_metrics", f"""WITH w AS (SELECT e.node_id, ts, CASE WHEN plan IN ('pro', 'business') AND reg.node_id IS NOT NULL THEN 336 ELSE 120 END AS h
    FROM e LEFT JOIN reg USING (node_id) LEFT JOIN own ON own.node_id = e.node_id)
    SELECT node_id, count(*) FILTER (ts < {AS_OF} - to_hours(h)) AS removed, count(*) FILTER (ts >= {AS_OF} - to_hours(h)) AS kept FROM w GROUP BY 1""")
def _(spark, d):
    """The plan windows are cut to 120 and 336 hours, as the test events cover only a month."""
    rows = retention.expire_metrics(T._base(spark, d).select("node_id", "ts"), T.registrations(spark, d), T.ownership(spark, d), T.as_of(),
                                    limits={"free": 120, "pro": 336, "business": 336})
    return retention.removed_per_node(rows)


@query("plan_retention_logs", f"""WITH {PLAN}, w AS (SELECT l.node_id, ts, CASE WHEN reg.node_id IS NULL THEN NULL WHEN pa.plan = 'pro' THEN 168 WHEN pa.plan = 'business' THEN 720 ELSE 24 END AS h
    FROM l LEFT JOIN reg USING (node_id) LEFT JOIN own ON own.node_id = l.node_id LEFT JOIN pa USING (account))
    SELECT node_id, count(*) FILTER (h IS NOT NULL AND ts < {AS_OF} - to_hours(h)) AS removed, count(*) FILTER (h IS NULL OR ts >= {AS_OF} - to_hours(h)) AS kept FROM w GROUP BY 1""")
def _(spark, d):
    logs = landing.normalise_logs(T.raw_logs(spark, d)).select("node_id", "ts")
    return retention.removed_per_node(retention.expire_logs(logs, T.registrations(spark, d), T.ownership(spark, d), T.as_of()))


@query("purge_alerts", f"SELECT * FROM al WHERE created_at >= {AS_OF} - INTERVAL 240 HOUR")
def _(spark, d):
    return retention.kept(retention.expire_flat(T.alerts(spark, d), 240, T.as_of(), "created_at"))


@query("delete_nodes", "SELECT node_id, ts, sample_id FROM e WHERE node_id NOT IN (SELECT node_id FROM ac WHERE critical_count >= 2)")
def _(spark, d):
    from ..operators.aggregates import alert_counts
    gone = alert_counts(T.alerts(spark, d)).filter("critical_count >= 2")
    return retention.delete_nodes({"metrics": T._base(spark, d).select("node_id", "ts", "sample_id")}, gone)["metrics"]


@query("erase_account", """SELECT 'alerts' AS tbl, count(*) AS rows FROM al WHERE node_id NOT IN (SELECT node_id FROM own WHERE account = 'acct3') UNION ALL
    SELECT 'channels', count(*) FROM ch WHERE owner IS DISTINCT FROM 'acct3' UNION ALL
    SELECT 'metrics', count(*) FROM e WHERE node_id NOT IN (SELECT node_id FROM own WHERE account = 'acct3') UNION ALL
    SELECT 'ownership', count(*) FROM own WHERE account <> 'acct3'""")
def _(spark, d):
    left = retention.erase_account("acct3", T.ownership(spark, d), {"metrics": T._base(spark, d), "alerts": T.alerts(spark, d)},
                                   {"channels": T.channels(spark, d)})
    out = None
    for name, df in left.items():
        c = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("tbl"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


def _prefs(spark, d, parity):
    """Settings changed by orders: one account type setting per priority, newest order wins."""
    o = T.table(spark, d, "orders").filter("o_orderstatus = 'P'" if parity else "o_orderstatus <> 'P'")
    return o.select(F.concat(F.lit("acct"), F.col("o_custkey")).alias("account"), F.col("o_orderpriority").alias("pref_type"),
                    F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("n"), F.col("o_custkey"))).alias("node_id"),
                    F.col("o_totalprice").alias("value"), F.struct("o_orderdate", "o_orderkey").alias("updated_at"))


@query("upsert_pref", """SELECT 'acct' || o_custkey AS account, o_orderpriority AS pref_type, CASE WHEN o_orderstatus <> 'O' THEN 'n' || o_custkey END AS node_id,
    arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS value FROM orders GROUP BY 1, 2, 3""")
def _(spark, d):
    return latest.upsert_preferences(_prefs(spark, d, True), _prefs(spark, d, False)).drop("updated_at")


@query("upsert_channels", """SELECT 'c' || o_custkey AS channel_id, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS setting FROM orders GROUP BY 1
    HAVING arg_max(o_orderstatus, (o_orderdate, o_orderkey)) <> 'F'""")
def _(spark, d):
    o = T.table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("channel_id"), F.col("o_totalprice").alias("setting"),
                                           (F.col("o_orderstatus") == "F").alias("deleted"), F.struct("o_orderdate", "o_orderkey").alias("updated_at"))
    return latest.upsert_channels(o.filter("deleted"), o.filter("not deleted")).select("channel_id", "setting")


@query("claim_once", """SELECT o_custkey AS event_id, min(o_orderdate) AS claimed_at, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS claim_id FROM orders GROUP BY 1""")
def _(spark, d):
    o = T.table(spark, d, "orders")
    return latest.claim_once(o.select(F.col("o_custkey").alias("event_id"), F.col("o_orderdate").alias("claimed_at"), F.col("o_orderkey").alias("claim_id")))


@query("apply_plan_changes", """WITH ev AS (SELECT 'acct' || (o_custkey % 40) AS account, o_orderdate, o_orderkey,
        CASE WHEN o_orderstatus = 'F' THEN 'free' WHEN o_orderpriority = '1-URGENT' THEN 'pro' WHEN o_orderpriority = '2-HIGH' THEN 'business' END AS p FROM orders),
    nw AS (SELECT account, arg_max(p, (o_orderdate, o_orderkey)) AS p FROM ev WHERE p IS NOT NULL GROUP BY 1)
    SELECT own.account, node_id, coalesce(p, plan) AS plan FROM own LEFT JOIN nw USING (account)""")
def _(spark, d):
    o = T.table(spark, d, "orders")
    pr = F.col("o_orderpriority")
    ev = o.select(F.concat(F.lit(" ACCT"), F.col("o_custkey") % 40).alias("email"), F.col("o_orderdate").alias("occurred_at"), F.col("o_orderkey").alias("event_id"),
                  F.when(F.col("o_orderstatus") == "F", "subscription_deleted").otherwise("checkout").alias("kind"),
                  F.when(pr == "1-URGENT", "Pro").when(pr == "2-HIGH", "business").otherwise("gold").alias("plan"))
    return acc.apply_plan_changes(T.ownership(spark, d), ev).select("account", "node_id", "plan")


@query("rate_limit_signups", """SELECT *, earlier < 2 AS allowed FROM (SELECT ip_address, node_id, (SELECT count(*) FROM own b WHERE b.ip_address = own.ip_address AND b.created_at > own.created_at - INTERVAL 24 HOUR
    AND b.created_at <= own.created_at) - 1 AS earlier FROM own)""")
def _(spark, d):
    own = T.ownership(spark, d).select("ip_address", "node_id", "created_at")
    return acc.rate_limit_audit(own, ["ip_address"], "created_at", 86_400, 2).drop("created_at")


@query("rate_limit_logins", """SELECT node_id, sample_id, count(*) OVER (PARTITION BY node_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) - 1 AS earlier,
    earlier < 3 AS allowed FROM e""")
def _(spark, d):
    return acc.rate_limit_audit(T._base(spark, d).select("node_id", "sample_id", "ts"), ["node_id"], "ts", 86_400, 3).drop("ts")


@query("active_maintenance", f"SELECT mt.* FROM mt SEMI JOIN reg USING (node_id) WHERE enabled AND (ends_at IS NULL OR ends_at > {AS_OF})")
def _(spark, d):
    return sel.active_maintenance(T.maintenance(spark, d), T.as_of(), T.registrations(spark, d))


@query("maintenance_report", f"""WITH m AS (SELECT node_id, hostname, reason, started_at, ends_at, (epoch_us(ends_at) - epoch_us({AS_OF})) // 60000000 AS mins FROM mt JOIN reg USING (node_id)
    WHERE enabled AND (ends_at IS NULL OR ends_at > {AS_OF}))
    SELECT * EXCLUDE (mins), CASE WHEN ends_at IS NULL THEN 'no end time' WHEN mins <= 0 THEN 'expired' WHEN mins < 60 THEN mins || 'm left'
    WHEN mins < 1440 THEN (mins // 60) || 'h ' || (mins % 60) || 'm left' ELSE (mins // 1440) || 'd left' END AS until FROM m""")
def _(spark, d):
    return R.maintenance_report(T.maintenance(spark, d), T.registrations(spark, d), T.as_of())


@query("pinned_first", "SELECT reg.node_id, hostname, reg.node_id IN (SELECT node_id FROM ac WHERE critical_count > 0) AS pinned FROM reg")
def _(spark, d):
    from ..operators.aggregates import alert_counts
    pins = alert_counts(T.alerts(spark, d)).filter("critical_count > 0")
    return acc.pinned_first(T.registrations(spark, d).select("node_id", "hostname"), pins, F.col("hostname"))


@query("redact_config", """SELECT event_id, CASE WHEN length('tok-' || event_id) > 4 THEN left('tok-' || event_id, 4) || '...' || right('tok-' || event_id, 2) ELSE 'tok-' || event_id END AS token,
    CASE WHEN length(event_type) > 4 THEN left(event_type, 4) || '...' || right(event_type, 2) ELSE event_type END AS url, event_type AS topic FROM events""")
def _(spark, d):
    b = T._base(spark, d)
    cfg = redact_config(F.create_map(F.lit("token"), F.concat(F.lit("tok-"), F.col("sample_id")), F.lit("url"), F.col("event_type"), F.lit("topic"), F.col("event_type")))
    return b.select(F.col("sample_id").alias("event_id"), cfg["token"].alias("token"), cfg["url"].alias("url"), cfg["topic"].alias("topic"))


@query("clean_registrations", """SELECT page_id, coalesce(nullif(left(regexp_replace(url, '[^a-zA-Z0-9._-]', '', 'g'), 64), ''), 'my-server') AS hostname,
    lower(trim(replace(url, '://', '@'))) AS email, regexp_matches(lower(trim(replace(url, '://', '@'))), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS valid FROM pages""")
def _(spark, d):
    p = T.table(spark, d, "pages")
    mail = clean_email(F.replace("url", F.lit("://"), F.lit("@")))
    return p.select("page_id", sanitise_hostname("url").alias("hostname"), mail.alias("email"), valid_email(mail).alias("valid"))
