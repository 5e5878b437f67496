"""Golden micro-tables for the subscription jobs (FIXTURES.md section D)."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlight.plans import subscriptions as sj
from ledgerlight.sources.fixtures import PLAN_ROWS

AS_OF = dt.date(2001, 8, 2)
SUBS = ("subscription_id bigint, customer_id bigint, plan_id int, previous_plan_id int, status string, "
        "monthly_revenue int, start_date date, end_date date, downgrade_date date, cancellation_date date")
BILLS = "billing_id string, subscription_id bigint, invoice_date date, amount int"


def _subs(spark, rows):
    return spark.createDataFrame(rows, SUBS).withColumn("monthly_revenue", F.col("monthly_revenue")
                                                        .cast("decimal(18,2)"))


def _bills(spark, rows):
    return spark.createDataFrame(rows, BILLS).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def _plans(spark):
    return spark.createDataFrame(PLAN_ROWS, "plan_id int, plan_name string, tier string")


def test_plan_metrics_fan_out(spark):
    subs = _subs(spark, [(1, 7, 3, None, "active", 10, dt.date(2001, 1, 1), None, None, None)])
    bills = _bills(spark, [("b1", 1, dt.date(2001, 7, 1), 10), ("b2", 1, dt.date(2001, 7, 2), 10)])
    tix = spark.createDataFrame([(f"t{i}", 7, dt.datetime(2001, 7, 1)) for i in range(3)],
                                "ticket_id string, customer_id bigint, created_at timestamp")
    for mode, revenue in (("as_coded", 60), ("corrected", 20)):
        r = sj.plan_metrics(_plans(spark), subs, bills, tix, AS_OF, mode=mode) \
            .where(F.col("plan_name") == "Professional").first()
        assert float(r.six_month_total_revenue) == revenue
        assert r.total_support_tickets == 3 and r.active_customers == 1
    empty = sj.plan_metrics(_plans(spark), subs, bills, tix, AS_OF).where(F.col("plan_name") == "Starter").first()
    assert empty.active_customers == 0 and float(empty.six_month_total_revenue) == 0


def _plan_metrics_naive(plans, subscriptions, billing, tickets,
                       as_of, months=6):
    """PQ1 exactly as the reference joins it (three-way fan-out). Kept only as
    the yardstick for the pre-aggregated plan; do not use on large data."""
    since = F.add_months(sj._d(as_of), -months)
    since_ts = sj._ts(as_of) - F.expr(f"INTERVAL {months} MONTHS")
    s = subscriptions.alias("s")
    b = billing.alias("b")
    t = tickets.alias("t")
    j = plans.alias("p").join(
        s, (F.col("p.plan_id") == F.col("s.plan_id")) & (F.col("s.status") == "active")
        & (F.col("s.start_date") <= sj._d(as_of)) & (F.col("s.end_date").isNull() | (F.col("s.end_date") >= since)),
        "left").join(
        b, (F.col("s.subscription_id") == F.col("b.subscription_id")) & (F.col("b.invoice_date") >= since), "left"
    ).join(t, (F.col("s.customer_id") == F.col("t.customer_id")) & (F.col("t.created_at") >= since_ts), "left")
    return j.groupBy("p.plan_id", "p.plan_name", "p.tier").agg(
        F.countDistinct("s.customer_id").alias("active_customers"),
        F.round(F.avg(F.col("s.monthly_revenue").cast("double")), 2).alias("avg_monthly_revenue_per_customer"),
        F.countDistinct("s.subscription_id").alias("total_subscriptions"),
        F.coalesce(F.sum("b.amount"), F.lit(0)).cast("decimal(18,2)").alias("six_month_total_revenue"),
        F.countDistinct("t.ticket_id").alias("total_support_tickets"),
    ).drop("plan_id")


def test_plan_metrics_matches_naive_join(spark):
    import random
    rnd = random.Random(7)
    subs = _subs(spark, [(i, rnd.randint(1, 6), rnd.randint(1, 5), None, rnd.choice(["active", "active", "paused"]),
                          rnd.randint(1, 90), dt.date(2000, rnd.randint(1, 12), 1), None, None, None)
                         for i in range(60)])
    bills = _bills(spark, [(f"b{i}", rnd.randint(0, 59), dt.date(2001, rnd.randint(1, 8), 1), rnd.randint(1, 50))
                           for i in range(150)])
    tix = spark.createDataFrame(
        [(f"t{i}", rnd.randint(1, 6), dt.datetime(2001, rnd.randint(1, 8), 2)) for i in range(40)],
        "ticket_id string, customer_id bigint, created_at timestamp")
    cols = ["plan_name", "active_customers", "avg_monthly_revenue_per_customer", "total_subscriptions",
            "six_month_total_revenue", "total_support_tickets"]
    a = sorted(tuple(r) for r in sj.plan_metrics(_plans(spark), subs, bills, tix, AS_OF).select(*cols).collect())
    b = sorted(tuple(r) for r in _plan_metrics_naive(_plans(spark), subs, bills, tix, AS_OF).select(*cols).collect())
    assert a == b


def test_downgrade_last_ticket_after_downgrade(spark):
    cust = spark.createDataFrame([(1, "A", "a@x")], "customer_id bigint, company_name string, email string")
    subs = _subs(spark, [(1, 1, 1, 2, "downgraded", 5, dt.date(2001, 1, 1), dt.date(2001, 7, 1),
                          dt.date(2001, 7, 1), None)])
    before = [(f"t{i}", 1, dt.datetime(2001, 6, 1 + i)) for i in range(4)]
    tix = spark.createDataFrame(before + [("t9", 1, dt.datetime(2001, 7, 5))],
                                "ticket_id string, customer_id bigint, created_at timestamp")
    assert sj.downgrade_risk(subs, cust, _plans(spark), tix, AS_OF).count() == 0
    tix2 = spark.createDataFrame(before, "ticket_id string, customer_id bigint, created_at timestamp")
    r = sj.downgrade_risk(subs, cust, _plans(spark), tix2, AS_OF).first()
    assert r.risk_category == "HIGH_RISK" and r.support_tickets_30d_before_downgrade == 4
    assert r.days_since_downgrade == 32


def test_growth_and_rolling_churn(spark):
    def sub(i, start, cancel=None):
        return (i, 1, 3, None, "cancelled" if cancel else "active", 1, start, cancel, None, cancel)
    rows = [sub(i, dt.date(2001, 5, 3)) for i in range(3)] + [sub(10 + i, dt.date(2001, 6, 3)) for i in range(5)]
    rows += [sub(20 + i, dt.date(2000, 1, 1), dt.date(2001, 7, 9)) for i in range(6)]
    df = _subs(spark, rows)
    coded = {r.metric_month: r for r in sj.growth_churn(df, _plans(spark), AS_OF).where("tier = 'pro'").collect()}
    fixed = {r.metric_month: r for r in sj.growth_churn(df, _plans(spark), AS_OF, mode="corrected")
             .where("tier = 'pro'").collect()}
    june = dt.date(2001, 6, 1)
    assert coded[june].mom_growth_rate_percent == 0.0
    assert fixed[june].mom_growth_rate_percent == 66.67
    july = dt.date(2001, 7, 1)
    assert coded[july].rolling_3month_avg_churn == 2.0 and coded[july].churn_anomaly_flag == "ANOMALY_ALERT"


def test_ltv_percent_rank(spark):
    cust = spark.createDataFrame([(i, f"C{i}", f"c{i}@x") for i in (1, 2, 3)],
                                 "customer_id bigint, company_name string, email string")
    subs = _subs(spark, [(i, i, 3, None, "active", 1, dt.date(2000, 1, 1), None, None, None) for i in (1, 2, 3)])
    bills = _bills(spark, [(f"b{i}", i, dt.date(2001, 1, 1), 10 * i) for i in (1, 2, 3)])
    rows = sj.ltv_ranking(cust, subs, _plans(spark), bills).collect()
    assert sorted(r.ltv_percentile for r in rows) == [0.0, 50.0, 100.0]
    assert sorted(r.ltv_rank_in_tier for r in rows) == [1, 2, 3]


def test_latest_downgrade_needs_its_plan(spark):
    """The newest downgrade whose plan exists counts, not the newest of all."""
    day = dt.date
    subs = _subs(spark, [(1, 7, 2, 3, "downgraded", 10, day(2001, 1, 1), None, day(2001, 7, 1), None),
                         (2, 7, 99, 3, "downgraded", 10, day(2001, 1, 1), None, day(2001, 7, 20), None),
                         (3, 8, 99, 3, "downgraded", 10, day(2001, 1, 1), None, day(2001, 7, 20), None)])
    cust = spark.createDataFrame([(7, "a", "a@b"), (8, "c", "c@d")], "customer_id bigint, company_name string, email string")
    tix = spark.createDataFrame([(f"t{i}", 7, dt.datetime(2001, 6, 20)) for i in range(5)],
                                "ticket_id string, customer_id bigint, created_at timestamp")
    for mode, least in (("as_coded", 3), ("corrected", 1)):
        got = sj.downgrade_risk(subs, cust, _plans(spark), tix, AS_OF, min_tickets=least, mode=mode).collect()
        assert [(r.customer_id, r.downgrade_date, r.support_tickets_30d_before_downgrade) for r in got] == [(7, day(2001, 7, 1), 5)]


def test_many_tiers(spark):
    plans = spark.range(1200).select(F.col("id").cast("int").alias("plan_id"), F.lit("p").alias("plan_name"),
                                     F.concat(F.lit("t"), F.col("id").cast("string")).alias("tier"))
    subs = _subs(spark, [(1, 7, 3, None, "active", 10, dt.date(2001, 1, 1), None, None, None)])
    got = sj.growth_churn(subs, plans, AS_OF, months=1, mode="corrected")
    assert got.count() == 2 * 1200
