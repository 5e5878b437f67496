"""Canonical SaaS tables derived from the driver's parquet tables.

The reference reads a CRM/billing schema and an event collection. The test
harness supplies TPC-H-like tables instead, so this module maps them onto the
canonical tables (FIXTURES.md section B). Each mapping exists twice, written
the same way: as Spark DataFrame code (used by the jobs) and as a DuckDB CTE
(used by the SQL oracle). Only column derivation happens here; none of the
jobs' work does.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed reference times for the driver data (FIXTURES.md section B).
AS_OF = _dt.date(2001, 8, 2)
AS_OF_TS = _dt.datetime(2024, 1, 31, 0, 0, 0)
AS_OF_SQL = "DATE '2001-08-02'"
AS_OF_TS_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
AS_OF_MIDNIGHT_SQL = "TIMESTAMP '2001-08-02 00:00:00'"

# The plan catalogue (plan_id, plan_name, tier).
PLAN_ROWS = [
    (1, "Starter", "free"),
    (2, "Basic", "free"),
    (3, "Professional", "pro"),
    (4, "Business", "pro"),
    (5, "Enterprise", "enterprise"),
]

# Parameters for the driver events.
SESSION_EVENTS = ("view", "click", "purchase")
FEATURE_EVENTS = ("view", "click")
FUNNEL_STAGES = ("signup", "view", "click", "purchase")
FUNNEL_FEATURE = "feature_3"
TEAM_SLOTS = 3
# Company names: two words and a number, chosen by the customer key.
NAME_FIRST = ("Amber", "Brack", "Copper", "Dunmore", "Eastlight", "Fern", "Greyfold", "Harrow", "Ironquay", "Juniper", "Kestrel",
              "Larkspur")
NAME_SECOND = ("Kiln", "Water Works", "Lines", "Mills", "Foundry", "Hollow", "Press", "and Pike", "Yard", "Lane Trading")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plans(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    return spark.createDataFrame(PLAN_ROWS, "plan_id int, plan_name string, tier string")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    domain = F.concat(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit(".com"))
    created = F.expr(
        "timestamp_ntz'1994-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 365 as int), c_nationkey, 0, 0)")
    key = F.col("c_custkey")
    word = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))
    name = F.concat_ws(" ", word(NAME_FIRST, key), word(NAME_SECOND, F.floor(key / 12)), (key % 97).cast("string"))
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        name.alias("company_name"),
        F.concat(F.lower("c_name"), F.lit("@"), domain).alias("email"),
        domain.alias("email_domain"),
        F.col("c_nationkey").alias("country_code"),
        created.alias("created_at"),
        (created + F.expr("make_dt_interval(cast(c_custkey % 30 as int), 0, 0, 0)")).alias("updated_at"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    plan_id = (F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).cast("int")
    status = (F.when(F.col("o_orderstatus") == "O", "active")
              .when(F.col("o_orderstatus") == "F", "cancelled")
              .when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0), "downgraded")
              .when(F.col("o_orderstatus") == "P", "paused"))
    start = F.to_date("o_orderdate")
    change = F.date_add(start, (F.lit(30) + F.col("o_orderkey") % 320).cast("int"))
    return (o.select(
        F.col("o_orderkey").alias("subscription_id"),
        F.col("o_custkey").alias("customer_id"),
        plan_id.alias("plan_id"),
        status.alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("monthly_revenue"),
        start.alias("start_date"),
        change.alias("_change"),
    ).select(
        "subscription_id", "customer_id", "plan_id",
        F.when(F.col("status") == "downgraded", F.least(F.lit(5), F.col("plan_id") + 1))
        .cast("int").alias("previous_plan_id"),
        "status", "monthly_revenue", "start_date",
        F.when(F.col("status").isin("cancelled", "downgraded"), F.col("_change")).alias("end_date"),
        F.when(F.col("status") == "downgraded", F.col("_change")).alias("downgrade_date"),
        F.when(F.col("status") == "cancelled", F.col("_change")).alias("cancellation_date"),
    ))


def _line_key() -> F.Column:
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                       F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.where(F.col("l_returnflag") != "R").select(
        _line_key().alias("billing_id"),
        F.col("l_orderkey").alias("subscription_id"),
        F.to_date("l_shipdate").alias("invoice_date"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )


def support_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    prio = F.element_at(F.array(*[F.lit(p) for p in ("low", "medium", "high", "critical")]),
                        (F.col("l_linenumber") % 4 + 1).cast("int"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        _line_key().alias("ticket_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_orderkey").alias("subscription_id"),
        prio.alias("priority"),
        F.col("l_shipdate").alias("created_at"),
        (F.col("l_shipdate") + F.expr("make_dt_interval(0, 1 + l_linenumber * 5, 0, 0)")).alias("resolved_at"),
    )


def team_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey")
    j = F.explode(F.sequence(F.lit(0), F.lit(TEAM_SLOTS - 1))).alias("j")
    return c.select("c_custkey", j).select(
        (F.col("c_custkey") * TEAM_SLOTS + F.col("j")).alias("team_member_id"),
        F.col("c_custkey").alias("customer_id"),
        F.concat(F.lit("m"), ((F.col("c_custkey") * 7 + F.col("j") * 131) % 997).cast("string"),
                 F.lit("@x.com")).alias("email"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_from(_read(spark, sf_dir, "events"))


def events_from(e: DataFrame) -> DataFrame:
    """The canonical-events mapping on a raw driver events frame (batch or stream)."""
    tier = F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("enterprise")),
                        (F.col("user_id") % 3 + 1).cast("int"))
    feature = F.concat(F.lit("feature_"),
                       (F.get_json_object("props", "$.k").cast("bigint") % 20).cast("string"))
    return e.select(
        "event_id",
        "user_id",
        F.col("user_id").alias("customer_id"),
        "event_type",
        feature.alias("feature_name"),
        tier.alias("subscription_tier"),
        F.col("ts").alias("timestamp"),
        F.struct(F.col("value").alias("duration_seconds")).alias("properties"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("user_id", "ts")
    day = F.to_date("ts")
    g = e.groupBy("user_id", day.alias("d")).agg(F.min("ts").alias("start_time"),
                                                   F.max("ts").alias("end_time"))
    return g.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("d").cast("string")).alias("session_id"),
        F.col("user_id").alias("customer_id"),
        "user_id", "start_time", "end_time",
        ((F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp")))
         / F.lit(1_000_000))
        .cast("bigint").alias("duration"),
    )


# ---------------------------------------------------------------------------
# Dirty overlay (FIXTURES.md section C): the driver events as a raw text
# table with deterministic defects, for the profiling and cleaning jobs.
# ---------------------------------------------------------------------------

DUP_OFFSET = 10_000_000


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    i = F.col("event_id")
    tier = F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("enterprise")),
                        (F.col("user_id") % 3 + 1).cast("int"))
    feature = F.concat(F.lit("feature_"), (F.get_json_object("props", "$.k").cast("bigint") % 20).cast("string"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shifted = F.date_format(F.col("ts") + F.expr("INTERVAL '05:30' HOUR TO MINUTE"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    naive = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    ts_text = (F.when(i % 19 == 0, F.lit(None).cast("string"))
               .when(i % 4 == 0, F.concat(iso, F.lit("Z")))
               .when(i % 4 == 1, F.concat(shifted, F.lit("+05:30")))
               .when((i % 4 == 3) & (i % 101 == 0), F.concat(F.lit("not-a-date "), (i % 5).cast("string")))
               .otherwise(naive))
    raw = e.select(
        i.alias("event_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.when(i % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(i % 23 == 0, F.lit(None).cast("string")).when(i % 31 == 0, F.lit("zzz"))
        .otherwise(F.col("event_type")).alias("event_type"),
        F.when(i % 47 == 0, F.unhex(F.lit("61FF62")).cast("string")).when(i % 43 == 0, F.lit("null"))
        .when(i % 41 == 0, F.lit("")).otherwise(feature).alias("feature_name"),
        F.when(i % 5 == 0, F.lit(None).cast("string")).when(i % 37 == 0, F.lit("gold"))
        .otherwise(tier).alias("subscription_tier"),
        ts_text.alias("timestamp"),
        F.to_json(F.struct(F.col("value").alias("duration_seconds"))).alias("properties"),
    )
    dups = raw.where(F.col("event_id") % 29 == 0).withColumn("event_id", F.col("event_id") + F.lit(DUP_OFFSET))
    return raw.unionByName(dups)



def drifting_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver events with properties as text whose keys and notation change
    from row to row: JSON, dict reprs with both kinds of quotes, nested values,
    text that breaks off, none at all."""
    e = _read(spark, sf_dir, "events")
    v = F.col("value").cast("string")
    k = F.get_json_object("props", "$.k")
    kinds = [
        F.concat(F.lit('{"duration_seconds": '), v, F.lit(', "k": '), k, F.lit(', "note": "None shall pass"}')),
        F.concat(F.lit("{'session_duration': "), v, F.lit(", 'note': 'None shall pass', 'ok': True, 'gone': None}")),
        F.concat(F.lit("{'duration_seconds': "), v, F.lit(", 'who': \"it's False\", 'say': 'a \"True\" word', 'at': 'caf\\xe9'}")),
        F.concat(F.lit('{"duration_seconds": '), v, F.lit(', "geo": {"city": "True North", "n": [1, 2]}}')),
        F.lit("{'duration_seconds': "),
        F.lit(None).cast("string"),
    ]
    text = F.element_at(F.array(*kinds), (F.col("event_id") % len(kinds) + 1).cast("int"))
    return e.select("event_id", F.col("user_id").cast("string").alias("user_id"), "event_type",
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), text.alias("properties"))


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id % 13 = 0 takes the previous customer's email; % 53 = 0 has none."""
    c = customers(spark, sf_dir)
    prev = c.select((F.col("customer_id") + 1).alias("customer_id"), F.col("email").alias("__prev"))
    i = F.col("customer_id")
    return c.join(prev, "customer_id", "left").withColumn(
        "email", F.when(i % 53 == 0, F.lit(None).cast("string")).when(i % 13 == 0, F.col("__prev"))
        .otherwise(F.col("email"))).drop("__prev").select(*c.columns)


def dirty_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subscription_id % 59 = 0 ends before it starts; % 61 = 0 has no start."""
    s = subscriptions(spark, sf_dir)
    i = F.col("subscription_id")
    return s.withColumn("end_date", F.when(i % 59 == 0, F.date_sub("start_date", 1)).otherwise(F.col("end_date"))) \
        .withColumn("start_date", F.when(i % 61 == 0, F.lit(None).cast("date")).otherwise(F.col("start_date")))


def dirty_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices of subscription_id % 7 = 0 have no amount."""
    b = billing(spark, sf_dir)
    return b.withColumn("amount", F.when(F.col("subscription_id") % 7 == 0, F.lit(None).cast("decimal(18,2)"))
                        .otherwise(F.col("amount")))


CANONICAL = {
    "plans": plans,
    "customers": customers,
    "subscriptions": subscriptions,
    "billing": billing,
    "support_tickets": support_tickets,
    "team_members": team_members,
    "app_events": events,
    "app_sessions": sessions,
    "dirty_events": dirty_events,
    "drifting_events": drifting_events,
    "dirty_customers": dirty_customers,
    "dirty_subscriptions": dirty_subscriptions,
    "dirty_billing": dirty_billing,
}


# ---------------------------------------------------------------------------
# Oracle side: the same mapping as DuckDB CTEs over the driver's views.
# ---------------------------------------------------------------------------

_PLAN_VALUES = ", ".join(f"({i}, '{n}', '{t}')" for i, n, t in PLAN_ROWS)

ORACLE_CTES = {
    "plans": f"SELECT * FROM (VALUES {_PLAN_VALUES}) AS p(plan_id, plan_name, tier)",
    "customers": f"""
        SELECT c_custkey AS customer_id,
               concat_ws(' ', ({list(NAME_FIRST)})[c_custkey % {len(NAME_FIRST)} + 1],
                         ({list(NAME_SECOND)})[c_custkey // 12 % {len(NAME_SECOND)} + 1],
                         CAST(c_custkey % 97 AS VARCHAR)) AS company_name,
               lower(c_name) || '@' || lower(c_mktsegment) || CAST(c_nationkey AS VARCHAR) || '.com' AS email,
               lower(c_mktsegment) || CAST(c_nationkey AS VARCHAR) || '.com' AS email_domain,
               c_nationkey AS country_code,
               TIMESTAMP '1994-01-01 00:00:00' + to_days(CAST(c_custkey % 365 AS INTEGER))
                   + to_hours(c_nationkey) AS created_at,
               TIMESTAMP '1994-01-01 00:00:00' + to_days(CAST(c_custkey % 365 AS INTEGER))
                   + to_hours(c_nationkey) + to_days(CAST(c_custkey % 30 AS INTEGER)) AS updated_at
        FROM customer""",
    "subscriptions": """
        SELECT subscription_id, customer_id, plan_id,
               CAST(CASE WHEN status = 'downgraded' THEN least(5, plan_id + 1) END AS INTEGER) AS previous_plan_id,
               status, monthly_revenue, start_date,
               CASE WHEN status IN ('cancelled', 'downgraded') THEN chg END AS end_date,
               CASE WHEN status = 'downgraded' THEN chg END AS downgrade_date,
               CASE WHEN status = 'cancelled' THEN chg END AS cancellation_date
        FROM (
            SELECT o_orderkey AS subscription_id, o_custkey AS customer_id,
                   CAST(6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS plan_id,
                   CASE WHEN o_orderstatus = 'O' THEN 'active'
                        WHEN o_orderstatus = 'F' THEN 'cancelled'
                        WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'downgraded'
                        WHEN o_orderstatus = 'P' THEN 'paused' END AS status,
                   CAST(o_totalprice AS DECIMAL(18,2)) AS monthly_revenue,
                   CAST(o_orderdate AS DATE) AS start_date,
                   CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 320 AS INTEGER) AS chg
            FROM orders) o""",
    "billing": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS billing_id,
               l_orderkey AS subscription_id, CAST(l_shipdate AS DATE) AS invoice_date,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
        FROM lineitem WHERE l_returnflag <> 'R'""",
    "support_tickets": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ticket_id,
               o_custkey AS customer_id, l_orderkey AS subscription_id,
               (['low', 'medium', 'high', 'critical'])[l_linenumber % 4 + 1] AS priority,
               l_shipdate AS created_at,
               l_shipdate + to_hours(1 + l_linenumber * 5) AS resolved_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_returnflag = 'R'""",
    "team_members": f"""
        SELECT c_custkey * {TEAM_SLOTS} + j AS team_member_id, c_custkey AS customer_id,
               'm' || CAST((c_custkey * 7 + j * 131) % 997 AS VARCHAR) || '@x.com' AS email
        FROM customer CROSS JOIN range(0, {TEAM_SLOTS}) AS r(j)""",
    "app_events": """
        SELECT event_id, user_id, user_id AS customer_id, event_type,
               'feature_' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS VARCHAR) AS feature_name,
               (['free', 'pro', 'enterprise'])[user_id % 3 + 1] AS subscription_tier,
               ts AS "timestamp", value AS duration_seconds
        FROM events""",
    "app_sessions": """
        SELECT CAST(user_id AS VARCHAR) || '-' || CAST(d AS VARCHAR) AS session_id,
               user_id AS customer_id, user_id, start_time, end_time,
               CAST(trunc((epoch_us(end_time) - epoch_us(start_time)) / 1000000) AS BIGINT) AS duration
        FROM (SELECT user_id, CAST(ts AS DATE) AS d, min(ts) AS start_time, max(ts) AS end_time
              FROM events GROUP BY 1, 2) s""",
    "dirty_events": f"""
        WITH raw AS (
            SELECT event_id, CAST(user_id AS VARCHAR) AS customer_id,
                   CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id,
                   CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'zzz' ELSE event_type END
                       AS event_type,
                   -- invalid bytes x'61FF62' cannot live in a DuckDB VARCHAR: they appear here already
                   -- repaired to 'ab' (what dropping the invalid byte yields)
                   CASE WHEN event_id % 47 = 0 THEN 'ab' WHEN event_id % 43 = 0 THEN 'null'
                        WHEN event_id % 41 = 0 THEN ''
                        ELSE 'feature_' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS VARCHAR)
                   END AS feature_name,
                   event_id % 47 = 0 AS bad_bytes,
                   CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 37 = 0 THEN 'gold'
                        ELSE (['free', 'pro', 'enterprise'])[user_id % 3 + 1] END AS subscription_tier,
                   CASE WHEN event_id % 19 = 0 THEN NULL
                        WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
                        WHEN event_id % 4 = 1 THEN strftime(ts + INTERVAL '5 hours 30 minutes',
                                                            '%Y-%m-%dT%H:%M:%S.%f') || '+05:30'
                        WHEN event_id % 4 = 3 AND event_id % 101 = 0 THEN 'not-a-date ' || CAST(event_id % 5 AS VARCHAR)
                        ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS "timestamp",
                   value AS duration_seconds
            FROM events)
        SELECT * FROM raw
        UNION ALL
        SELECT event_id + {DUP_OFFSET}, customer_id, user_id, event_type, feature_name, bad_bytes,
               subscription_tier, "timestamp", duration_seconds
        FROM raw WHERE event_id % 29 = 0""",
    # what each row's text says, row by row (no text is parsed on this side)
    "drifting_events": """
        SELECT event_id, CASE WHEN event_id % 6 < 4 THEN value END AS duration_seconds, key, val
        FROM events LEFT JOIN (VALUES (0, 'k', ''), (0, 'note', 'None shall pass'), (1, 'note', 'None shall pass'),
            (1, 'ok', 'true'), (1, 'gone', NULL), (2, 'who', 'it''s False'), (2, 'say', 'a "True" word'), (2, 'at', 'café'),
            (3, 'geo', '{"city":"True North","n":[1,2]}')) AS extra(kind, key, val) ON event_id % 6 = kind""",
    "dirty_customers": """
        SELECT c.customer_id, c.company_name,
               CASE WHEN c.customer_id % 53 = 0 THEN NULL WHEN c.customer_id % 13 = 0 THEN p.email
                    ELSE c.email END AS email,
               c.email_domain, c.country_code, c.created_at, c.updated_at
        FROM customers c LEFT JOIN customers p ON p.customer_id + 1 = c.customer_id""",
    "dirty_subscriptions": """
        SELECT subscription_id, customer_id, plan_id, previous_plan_id, status, monthly_revenue,
               CASE WHEN subscription_id % 61 = 0 THEN NULL ELSE start_date END AS start_date,
               CASE WHEN subscription_id % 59 = 0 THEN CAST(start_date - 1 AS DATE) ELSE end_date END AS end_date,
               downgrade_date, cancellation_date
        FROM subscriptions""",
    "dirty_billing": """
        SELECT billing_id, subscription_id, invoice_date,
               CASE WHEN subscription_id % 7 = 0 THEN NULL ELSE amount END AS amount
        FROM billing""",
}


def parse_time_sql(raw: str) -> str:
    """DuckDB text-to-UTC-timestamp with the same rules as the Spark parser,
    written without relying on DuckDB's time-zone setting."""
    body = f"replace(left({raw}, length({raw}) - 6), 'T', ' ')"
    hh = f"CAST(substr({raw}, length({raw}) - 4, 2) AS INTEGER)"
    mm = f"CAST(substr({raw}, length({raw}) - 1, 2) AS INTEGER)"
    return f"""(CASE WHEN regexp_matches({raw}, '[+-][0-9]{{2}}:[0-9]{{2}}$') THEN
              CASE WHEN substr({raw}, length({raw}) - 5, 1) = '+'
                   THEN TRY_CAST({body} AS TIMESTAMP) - to_hours({hh}) - to_minutes({mm})
                   ELSE TRY_CAST({body} AS TIMESTAMP) + to_hours({hh}) + to_minutes({mm}) END
            WHEN {raw} LIKE '%Z' THEN TRY_CAST(replace(left({raw}, length({raw}) - 1), 'T', ' ') AS TIMESTAMP)
            ELSE TRY_CAST(replace(trim({raw}), 'T', ' ') AS TIMESTAMP) END)"""


def with_ctes(sql: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs of the canonical tables it reads."""
    order = list(ORACLE_CTES)
    wanted = sorted(set(names), key=order.index)
    ctes = ",\n".join(f"{n} AS ({ORACLE_CTES[n]})" for n in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
