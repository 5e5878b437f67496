"""Relational subscription analytics: plan metrics, LTV ranking, downgrade
risk, growth and churn, and the two utility listings.

Conventions: ``as_of`` is a ``datetime.date`` (the reference's CURRENT_DATE);
its midnight stands for CURRENT_TIMESTAMP. No join is hinted: the planner
broadcasts the plan catalogue when it measures small.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.exprs import safe_div
from ledgerlight.operators.ranking import rank_in_groups
from ledgerlight.session import materialize

AS_CODED, CORRECTED = "as_coded", "corrected"


def _d(as_of: dt.date):
    return F.lit(as_of).cast("date")


def _ts(as_of: dt.date):
    return F.lit(as_of).cast("date").cast("timestamp")


def _check_mode(mode: str) -> None:
    if mode not in (AS_CODED, CORRECTED):
        raise ValueError(f"mode must be {AS_CODED!r} or {CORRECTED!r}, got {mode!r}")


# ---------------------------------------------------------------- U1, U2

def customers_by_recency(customers: DataFrame) -> DataFrame:
    """All customers, newest first."""
    return customers.select("customer_id", "company_name", "email", "email_domain",
                            "created_at", "updated_at") \
        .orderBy(F.col("created_at").desc_nulls_first(), "customer_id")


def subscription_stats(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Subscription counts and revenue by tier. Rows are first combined to
    one per (tier, subscription), which gives all three distinct counts."""
    s = subscriptions.join(plans.select("plan_id", "tier"), "plan_id")
    once = s.groupBy("tier", "subscription_id").agg(
        F.max((F.col("status") == "active").cast("int")).alias("active"),
        F.max((F.col("status") == "cancelled").cast("int")).alias("cancelled"),
        F.sum("monthly_revenue").alias("revenue"), F.count("monthly_revenue").alias("n"))
    known = F.col("subscription_id").isNotNull()
    return once.groupBy("tier").agg(
        F.count("subscription_id").alias("total_subscriptions"),
        F.count_if(known & (F.col("active") == 1)).alias("active_subscriptions"),
        F.count_if(known & (F.col("cancelled") == 1)).alias("cancelled_subscriptions"),
        F.round(safe_div(F.sum("revenue").cast("double"), F.sum("n").cast("double")), 2).alias("avg_monthly_revenue"),
        F.sum("revenue").cast("decimal(18,2)").alias("total_monthly_revenue"),
    ).orderBy(F.col("tier").desc())


# ---------------------------------------------------------------- PQ1

def plan_metrics(plans: DataFrame, subscriptions: DataFrame, billing: DataFrame, tickets: DataFrame,
                 as_of: dt.date, months: int = 6, mode: str = AS_CODED) -> DataFrame:
    """PQ1: per plan, active customers, average revenue, subscriptions,
    six-month billed revenue and support load.

    The reference joins subscription x invoice x ticket rows, so its SUM and
    AVG are weighted by that fan-out. The product is never built here:
    invoices are pre-aggregated per subscription and tickets per customer,
    and ``as_coded`` reproduces the fan-out through weights, while
    ``corrected`` counts each subscription and invoice once.
    """
    _check_mode(mode)
    since = F.add_months(_d(as_of), -months)
    since_ts = _ts(as_of) - F.expr(f"INTERVAL {months} MONTHS")
    subs = subscriptions.where(
        (F.col("status") == "active") & (F.col("start_date") <= _d(as_of))
        & (F.col("end_date").isNull() | (F.col("end_date") >= since))
    ).select("subscription_id", "customer_id", "plan_id", "monthly_revenue")
    bills = billing.where(F.col("invoice_date") >= since).groupBy("subscription_id").agg(
        F.count(F.lit(1)).alias("n_b"), F.sum("amount").alias("amt"))
    tix = tickets.where(F.col("created_at") >= since_ts).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_t"), F.countDistinct("ticket_id").alias("d_t"))

    sb = subs.join(bills, "subscription_id", "left")
    nb = F.greatest(F.coalesce(F.col("n_b"), F.lit(0)), F.lit(1))
    rev = F.col("monthly_revenue")
    # One row per (plan, customer): what the customer contributes per ticket row.
    if mode == AS_CODED:
        per_cust = sb.groupBy("plan_id", "customer_id").agg(
            F.count(F.lit(1)).alias("subs"),
            F.sum(rev * nb).alias("rev_w"),
            F.sum(F.when(rev.isNotNull(), nb)).alias("w"),
            F.sum("amt").alias("amt"),
        )
    else:
        per_cust = sb.groupBy("plan_id", "customer_id").agg(
            F.count(F.lit(1)).alias("subs"),
            F.sum(rev).alias("rev_w"),
            F.count(rev).alias("w"),
            F.sum("amt").alias("amt"),
        )
    pc = per_cust.join(tix, "customer_id", "left")
    nt = F.greatest(F.coalesce(F.col("n_t"), F.lit(0)), F.lit(1)) if mode == AS_CODED else F.lit(1)
    per_plan = pc.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("active_customers"),
        F.sum(F.col("rev_w") * nt).alias("rev_w"),
        F.sum(F.col("w") * nt).alias("w"),
        F.sum("subs").alias("total_subscriptions"),
        F.sum(F.col("amt") * nt).alias("revenue"),
        F.sum(F.coalesce(F.col("d_t"), F.lit(0))).alias("tickets"),
    )
    out = plans.join(per_plan, "plan_id", "left").select(
        "plan_name", "tier",
        F.coalesce(F.col("active_customers"), F.lit(0)).cast("bigint").alias("active_customers"),
        F.round(safe_div(F.col("rev_w").cast("double"), F.col("w").cast("double")), 2)
        .alias("avg_monthly_revenue_per_customer"),
        F.coalesce(F.col("total_subscriptions"), F.lit(0)).cast("bigint").alias("total_subscriptions"),
        F.coalesce(F.col("revenue"), F.lit(0)).cast("decimal(18,2)").alias("six_month_total_revenue"),
        F.coalesce(F.col("tickets"), F.lit(0)).cast("bigint").alias("total_support_tickets"),
        F.round(safe_div(F.coalesce(F.col("tickets"), F.lit(0)).cast("double"),
                         F.col("active_customers").cast("double")) / F.lit(float(months)), 2)
        .alias("support_ticket_rate_per_customer_per_month"),
    )
    return out.orderBy(F.col("six_month_total_revenue").desc(), F.col("active_customers").desc(), "plan_name")


# ---------------------------------------------------------------- PQ2

def customer_ltv(customers: DataFrame, subscriptions: DataFrame, plans: DataFrame, billing: DataFrame,
                 mode: str = AS_CODED) -> DataFrame:
    """One row per (customer, plan) with its lifetime value, invoice count,
    first subscription date and number of plan changes (PQ2 before ranking)."""
    _check_mode(mode)
    p = plans.select("plan_id", "plan_name", "tier")
    sb = subscriptions.select("subscription_id", "customer_id", "plan_id", "start_date") \
        .join(billing.select("subscription_id", "invoice_date", "amount"), "subscription_id", "left")
    inv = F.countDistinct("invoice_date") if mode == AS_CODED else F.count("invoice_date")
    cl = sb.groupBy("customer_id", "plan_id").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(18,2)").alias("lifetime_value"),
        inv.alias("total_invoices"),
        F.min("start_date").alias("first_subscription_date"),
    )
    if mode == AS_CODED:
        cl = cl.withColumn("num_plan_changes", F.lit(1).cast("bigint"))
    else:
        changes = subscriptions.groupBy("customer_id").agg(
            (F.countDistinct("plan_id") - 1).cast("bigint").alias("num_plan_changes"))
        cl = cl.join(changes, "customer_id")
    return cl.join(p, "plan_id").join(customers.select("customer_id", "company_name", "email"), "customer_id")


def tier_averages(ltv: DataFrame) -> DataFrame:
    """Average lifetime value by tier, not rounded."""
    return ltv.groupBy("tier").agg(F.avg(F.col("lifetime_value").cast("double")).alias("tier_avg_ltv"))


def ltv_ranking(customers: DataFrame, subscriptions: DataFrame, plans: DataFrame, billing: DataFrame,
                mode: str = AS_CODED, partitions: int | None = None) -> DataFrame:
    """PQ2: lifetime value per (customer, plan), compared with the tier
    average, ranked inside the tier.

    ``as_coded``: total_invoices counts distinct invoice dates and
    num_plan_changes is COUNT(DISTINCT plan_id) inside a plan group (always 1).
    ``corrected``: total_invoices counts invoices and num_plan_changes is the
    customer's distinct plans minus one.
    The rank runs through :func:`rank_in_groups`, so a tier is not one task.
    """
    # read three times below (tier averages, running counts, rows): compute once
    cl = materialize(customer_ltv(customers, subscriptions, plans, billing, mode))
    ranked = rank_in_groups(cl, ["tier"], "lifetime_value", descending=True,
                            rank_col="ltv_rank_in_tier", pct_col="__pr", partitions=partitions)
    out = ranked.join(tier_averages(cl), "tier").select(
        "customer_id", "company_name", "email", "plan_name", "tier",
        F.col("lifetime_value").cast("decimal(18,2)").alias("lifetime_value"),
        F.round(F.col("tier_avg_ltv").cast("double"), 2).alias("tier_average_ltv"),
        F.round(safe_div(F.col("lifetime_value").cast("double") - F.col("tier_avg_ltv").cast("double"),
                         F.col("tier_avg_ltv").cast("double")) * F.lit(100.0), 2).alias("ltv_vs_tier_avg_percentage"),
        "ltv_rank_in_tier",
        F.round(F.col("__pr") * F.lit(100.0), 2).alias("ltv_percentile"),
        "first_subscription_date", "total_invoices", "num_plan_changes",
    )
    return out.orderBy("tier", F.col("lifetime_value").desc(), "customer_id", "plan_name")


# ---------------------------------------------------------------- PQ3

def downgrade_risk(subscriptions: DataFrame, customers: DataFrame, plans: DataFrame, tickets: DataFrame,
                   as_of: dt.date, days: int = 90, ticket_days: int = 120, min_tickets: int = 3,
                   mode: str = AS_CODED, window_days: int = 30) -> DataFrame:
    """PQ3: customers whose latest downgrade falls in the last ``days`` days
    and who filed many support tickets.

    ``as_coded`` counts tickets of the last ``ticket_days`` days, drops a
    customer whose latest such ticket is on/after the downgrade, and keeps
    only counts ``> min_tickets`` (so only HIGH_RISK rows survive).
    ``corrected`` counts tickets in ``[downgrade - window_days, downgrade)``
    and keeps counts ``>= min_tickets`` with all three labels.
    Ties on the downgrade date break by the higher subscription_id.
    """
    _check_mode(mode)
    cur = plans.select(F.col("plan_id"), F.col("plan_name").alias("current_plan"),
                                         F.col("tier").alias("current_tier"))
    prev = plans.select(F.col("plan_id").alias("previous_plan_id"),
                                          F.col("plan_name").alias("previous_plan"),
                                          F.col("tier").alias("previous_tier"))
    s = subscriptions.where(
        F.col("downgrade_date").isNotNull() & F.col("previous_plan_id").isNotNull()
        & (F.col("downgrade_date") >= F.date_sub(_d(as_of), days))
    ).select("customer_id", "subscription_id", "plan_id", "previous_plan_id", "downgrade_date", "monthly_revenue")
    # a downgrade counts only with its customer and plan; the latest is chosen after that
    s = s.join(customers.select("customer_id"), "customer_id", "left_semi") \
        .join(plans.select("plan_id"), "plan_id", "left_semi")
    # latest downgrade per customer as an aggregate (map-side partial
    # aggregation), not a row_number window that sorts a hot customer in one task
    rest = [c for c in s.columns if c != "customer_id"]
    latest = s.groupBy("customer_id").agg(
        F.max_by(F.struct(*rest), F.struct("downgrade_date", "subscription_id")).alias("__l")) \
        .select("customer_id", "__l.*")
    dc = latest.join(customers.select("customer_id", "company_name", "email"), "customer_id") \
        .join(cur, "plan_id").join(prev, "previous_plan_id", "left")
    dd_ts = F.col("downgrade_date").cast("timestamp")
    if mode == AS_CODED:
        sbd = tickets.where(F.col("created_at") >= _ts(as_of) - F.expr(f"INTERVAL {ticket_days} DAYS")) \
            .groupBy("customer_id").agg(F.count("ticket_id").alias("n"),
                                        F.max("created_at").alias("last_ticket_before_downgrade"))
        j = dc.join(sbd, (dc.customer_id == sbd.customer_id)
                    & (sbd.last_ticket_before_downgrade < dd_ts), "left").drop(sbd.customer_id)
        n = F.coalesce(F.col("n"), F.lit(0))
        j = j.withColumn("__n", n).where(F.col("__n") > min_tickets)
    else:
        lo = F.date_sub(_d(as_of), days + window_days).cast("timestamp")
        t = tickets.where(F.col("created_at") >= lo).select(
            F.col("customer_id").alias("__c"), "ticket_id", "created_at")
        keys = dc.select("customer_id", "downgrade_date")
        counted = keys.join(t, (keys.customer_id == t.__c)
                            & (t.created_at >= F.date_sub(F.col("downgrade_date"), window_days).cast("timestamp"))
                            & (t.created_at < F.col("downgrade_date").cast("timestamp"))) \
            .groupBy("customer_id").agg(F.count("ticket_id").alias("n"),
                                        F.max("created_at").alias("last_ticket_before_downgrade"))
        j = dc.join(counted, "customer_id", "left")
        j = j.withColumn("__n", F.coalesce(F.col("n"), F.lit(0))).where(F.col("__n") >= min_tickets)
    n = F.col("__n")
    high = (n > 3) if mode == AS_CODED else (n >= 3)
    label = F.when(high, "HIGH_RISK").when(n >= 2, "MEDIUM_RISK").otherwise("LOW_RISK")
    return j.select(
        "customer_id", "company_name", "email", "downgrade_date", "previous_plan", "previous_tier",
        "current_plan", "current_tier",
        n.cast("bigint").alias("support_tickets_30d_before_downgrade"),
        "last_ticket_before_downgrade",
        F.col("monthly_revenue").cast("decimal(18,2)").alias("subscription_revenue_lost"),
        label.alias("risk_category"),
        F.date_diff(_d(as_of), F.col("downgrade_date")).cast("int").alias("days_since_downgrade"),
    ).orderBy(F.col("support_tickets_30d_before_downgrade").desc(), F.col("downgrade_date").desc(), "customer_id")


# ---------------------------------------------------------------- PQ4

def growth_churn(subscriptions: DataFrame, plans: DataFrame, as_of: dt.date, months: int = 24,
                 mode: str = AS_CODED) -> DataFrame:
    """PQ4: new and churned subscriptions per month and tier, month-over-month
    growth, 3-row rolling churn average, anomaly flag and new revenue.

    ``as_coded``: growth uses truncating integer division and LAG runs over
    the months that have data. ``corrected``: real division over a dense
    month calendar (missing months are zero rows).
    """
    _check_mode(mode)
    since = F.add_months(_d(as_of), -months)
    s = subscriptions.join(plans.select("plan_id", "tier"), "plan_id")
    ms = s.where(F.col("start_date") >= since).groupBy(
        F.trunc("start_date", "month").alias("metric_month"), "tier").agg(
        F.countDistinct("subscription_id").alias("new_subscriptions"),
        F.sum("monthly_revenue").alias("monthly_revenue"))
    mc = s.where(F.col("cancellation_date").isNotNull() & (F.col("cancellation_date") >= since)).groupBy(
        F.trunc("cancellation_date", "month").alias("metric_month"), "tier").agg(
        F.countDistinct("subscription_id").alias("churned_subscriptions"))
    cm = ms.join(mc, ["metric_month", "tier"], "full_outer")
    if mode == CORRECTED:
        months_ = F.sequence(F.trunc(since, "month"), F.trunc(_d(as_of), "month"), F.expr("INTERVAL 1 MONTH"))
        grid = plans.select("tier").distinct().select(F.explode(months_).alias("metric_month"), "tier")
        cm = grid.join(cm, ["metric_month", "tier"], "left")
    cm = cm.select(
        "metric_month", "tier",
        F.coalesce(F.col("new_subscriptions"), F.lit(0)).cast("bigint").alias("new_subscriptions"),
        F.coalesce(F.col("churned_subscriptions"), F.lit(0)).cast("bigint").alias("churned_subscriptions"),
        F.coalesce(F.col("monthly_revenue"), F.lit(0)).cast("decimal(18,2)").alias("monthly_revenue"),
    )
    w = Window.partitionBy("tier").orderBy("metric_month")
    prev = F.lag("new_subscriptions").over(w)
    if mode == AS_CODED:
        # bigint / bigint truncates toward zero before the * 100
        growth = (((F.col("new_subscriptions") - prev) / F.nullif(prev, F.lit(0))).cast("bigint")
                  * F.lit(100)).cast("double")
    else:
        growth = F.round((F.col("new_subscriptions") - prev).cast("double")
                         / F.nullif(prev, F.lit(0)).cast("double") * F.lit(100.0), 2)
    roll = F.avg(F.col("churned_subscriptions").cast("double")).over(w.rowsBetween(-2, 0))
    return cm.select(
        "metric_month", "tier", "new_subscriptions", "churned_subscriptions",
        growth.alias("mom_growth_rate_percent"),
        F.round(roll, 2).alias("rolling_3month_avg_churn"),
        F.when(F.col("churned_subscriptions") > F.lit(2.0) * F.coalesce(roll, F.lit(0.0)), "ANOMALY_ALERT")
        .otherwise("NORMAL").alias("churn_anomaly_flag"),
        F.col("monthly_revenue").cast("decimal(18,2)").alias("monthly_revenue"),
    ).orderBy(F.col("metric_month").desc(), "tier")
