"""Cleaning, statistics and segment micro-tables."""

from pyspark.sql import functions as F

from ledgerlight.plans import cleaning, customer360 as c3


def test_email_domain_and_dedupe(spark):
    df = spark.createDataFrame([(1, "X@Foo.COM"), (2, "nodomain"), (3, "X@Foo.COM"), (4, None), (5, None)],
                               "customer_id long, email string")
    out, log = cleaning.clean_customers(df)
    got = {r.customer_id: r.email_domain for r in out.collect()}
    assert got == {1: "foo.com", 2: None}
    assert log.first().rows_removed == 3


def test_subscriptions_are_not_dealt_by_tier_or_plan(spark):
    """A few tiers and plans: dealt by them, all invoices would lie in a few tasks."""
    plans = spark.createDataFrame([(1, "a", "free"), (2, "b", "pro"), (3, "c", None)], "plan_id int, plan_name string, tier string")
    subs = spark.createDataFrame([(i, i % 5, i % 4 + 1, "active", "2024-01-01", None) for i in range(40)],
                                 "subscription_id long, customer_id long, plan_id int, status string, start_date string, end_date string")
    billing = spark.createDataFrame([(i % 40, f"2024-02-{i % 28 + 1:02}", None if i % 3 == 0 else float(i % 7)) for i in range(200)],
                                    "subscription_id long, invoice_date string, amount double")
    extract = c3.subscription_extract(subs, plans, billing)
    marked = cleaning.mark_subscriptions(extract, plans)
    rows = marked.collect()
    assert len(rows) == 150 and all(r._kept for r in rows)      # plan 4 is not in the catalogue
    filled = {r.tier: {x.monthly_revenue for x in rows if x.tier == r.tier} for r in rows}
    assert set(filled) == {"free", "pro", None} and None not in filled[None]    # the tier NULL has its mean too
    plan = marked._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert dealt and not [x for x in dealt if "hashpartitioning(plan_id" in x or "hashpartitioning(coalesce(tier" in x]


def test_mode_tie_and_segment_stats(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate("aabb")], "customer_id long, tier string") \
        .select("customer_id", "tier", F.lit("S").alias("customer_segment"), F.lit(1.0).alias("lifetime_value"),
                F.lit(1.0).alias("engagement_score"), F.lit(0).alias("total_tickets"))
    assert c3.segment_stats(df).first().primary_tier == "a"


def test_t_test_moments(spark):
    # engaged rows have engagement 10, others 0; churn flags a: 0,0,1,1  b: 1,1,1,0
    rows = [(i, s, 0, 0, 10.0 if i < 4 else 0.0) for i, s in
            enumerate(["x", "x", "cancelled", "cancelled", "cancelled", "cancelled", "cancelled", "x"])]
    df = spark.createDataFrame(rows, "customer_id long, status string, total_tickets long, total_sessions long, "
                                     "avg_session_duration double").withColumn("total_events", F.lit(0))
    # engagement = duration / 60 * 0.3: 0.05 for the first four
    r = c3.hypothesis_test(df).first()
    assert (r.engaged_churn_rate, r.disengaged_churn_rate) == (0.5, 0.75)
    assert abs(r.t_statistic + 0.654654) < 1e-6 and r.degrees_of_freedom == 6
    assert abs(r.p_value - 0.5369) < 1e-3 and r.reject_h0 is False
    assert abs(r.cohens_d + 0.462910) < 1e-6 and r.effect_interpretation == "Small to medium effect"


def test_segment_edge_is_inclusive(spark):
    rows = [(i, 100.0 * i, 0, 0, 60.0 * i) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "customer_id long, monthly_revenue double, total_events long, "
                                     "total_sessions long, avg_session_duration double") \
        .withColumn("total_tickets", F.lit(0)).withColumn("tier", F.lit("pro"))
    seg = {r.customer_id: r.customer_segment for r in c3.segments(df).collect()}
    assert seg[9] == "VIP_ENGAGED" and seg[1] == "AT_RISK"


def test_quality_phase_modes(spark):
    from ledgerlight.catalog import Tables
    raw = Tables(spark, "/root/testdata/sf0.001").dirty_events
    assert set(cleaning.run_quality_phase(raw, "analyze")) == {"quality_report"}
    full = cleaning.run_quality_phase(raw, "full", clean_mode="corrected")
    assert set(full) == {"quality_report", "clean_events", "cleaning_report"}
    # corrected mode drops every row missing a critical field
    c = full["clean_events"]
    assert c.where(F.col("timestamp").isNull() | F.col("event_type").isNull() | F.col("user_id").isNull()).count() == 0
    # dedupe is idempotent
    from ledgerlight.plans.cleaning import dedupe_exact
    once = dedupe_exact(c.drop("flagged_outlier"))
    assert once.count() == dedupe_exact(once.drop("_copies")).count()


def test_drop_missing_critical_modes(spark):
    df = spark.createDataFrame([(None, "a", "x"), ("u", None, "x"), ("u", "t", None), ("u", "t", "x")],
                               "user_id string, timestamp string, event_type string")
    assert cleaning.drop_missing_critical(df, "as_coded").count() == 3
    assert cleaning.drop_missing_critical(df, "corrected").count() == 1
