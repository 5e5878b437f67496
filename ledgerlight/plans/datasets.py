"""Dashboard datasets (DB1-DB14): the tables behind the dashboard cards and
the BI report, composed from the jobs in this package.

Most are small aggregates of already distributed results. Month-level
series are computed from per-month counts and running sums over months
(never a months x subscriptions expansion).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.exprs import safe_div

# Dashboard constants (annual value of a high-value user, ARPU x months).
HIGH_VALUE_ARPU, MONTHS_PER_YEAR = 120, 12
CHURN_TICKETS = 5
STATUS_FUNNEL = ("active", "downgraded", "cancelled")


def _d(x: dt.date):
    return F.lit(x).cast("date")


# ---------------------------------------------------------------- DB1, DB2

def feature_top10(feature_dau: DataFrame, n: int = 10) -> DataFrame:
    """DB1: the first ``n`` features by DAU with retention as a percentage."""
    return feature_dau.orderBy(F.col("dau").desc(), "feature").limit(n).select(
        "feature", "dau", "retention7Day", F.round(F.col("retention7Day") * 100.0, 1).alias("retention_pct"))


def funnel_percentages(funnel: DataFrame) -> DataFrame:
    """DB1: funnel stages with conversion and drop-off as percentages."""
    return funnel.select("stage", "step_number", "count",
                         F.round(F.col("conversionRate") * 100.0, 1).alias("conversion_pct"),
                         F.round(F.col("dropOffRate") * 100.0, 1).alias("dropoff_pct"))


def upsell_summary(engaged: DataFrame, funnel: DataFrame) -> DataFrame:
    """DB2: high-value upsell targets, their annual potential (n x 120 x 12),
    and the drop-off at the second funnel stage in %."""
    hv = engaged.agg(F.count_if(F.col("potentialValue") == "High")).scalar()
    second = funnel.where(F.col("step_number") == 2).agg(
        F.max(F.round((F.lit(1.0) - F.col("conversionRate")) * 100.0, 1))).scalar()
    return engaged.sparkSession.range(1).select(
        hv.alias("high_value_users"),
        (hv * HIGH_VALUE_ARPU * MONTHS_PER_YEAR).cast("bigint").alias("annual_potential"),
        second.alias("second_stage_dropoff_pct"))


# ---------------------------------------------------------------- DB3, DB4, DB5

def active_customers_kpi(subscriptions: DataFrame) -> DataFrame:
    """DB3: distinct customers with an active subscription."""
    return subscriptions.where(F.col("status") == "active").agg(
        F.countDistinct("customer_id").alias("active_customers"))


def revenue_kpis(subscriptions: DataFrame, as_of: dt.date, months: int = 12) -> DataFrame:
    """DB4: active customers, MRR and annualised MRR, and churn rate over the
    period (cancelled in (start, as_of] / active at the period start)."""
    p0 = F.add_months(_d(as_of), -months)
    s = subscriptions
    active_at_start = (F.col("start_date") <= p0) & (F.col("end_date").isNull() | (F.col("end_date") > p0))
    cancelled_in = F.col("cancellation_date").isNotNull() & (F.col("cancellation_date") > p0) \
        & (F.col("cancellation_date") <= _d(as_of))
    active = F.col("status") == "active"
    return s.agg(
        F.countDistinct(F.when(active, F.col("customer_id"))).alias("active_customers"),
        F.sum(F.when(active, F.col("monthly_revenue"))).cast("decimal(18,2)").alias("mrr"),
        (F.sum(F.when(active, F.col("monthly_revenue"))) * MONTHS_PER_YEAR).cast("decimal(20,2)")
        .alias("annualised_mrr"),
        F.count_if(active_at_start).alias("active_at_period_start"),
        F.count_if(cancelled_in).alias("cancelled_in_period"),
    ).withColumn("churn_rate_pct", F.round(safe_div(F.col("cancelled_in_period").cast("double"),
                                                    F.col("active_at_period_start").cast("double")) * 100.0, 2))


def avg_ltv_by_tier(ltv: DataFrame) -> DataFrame:
    """DB4: mean lifetime value per tier, from the LTV ranking rows."""
    return ltv.groupBy("tier").agg(F.round(F.avg(F.col("lifetime_value").cast("double")), 2).alias("avg_ltv"))


def monthly_growth_churn(subscriptions: DataFrame, as_of: dt.date, months: int = 12) -> DataFrame:
    """DB5: per month of the last ``months``: new subscriptions, cancellations,
    subscriptions active at the month start and churn rate in %.

    Active-at-start comes from per-month counts of starts and ends and a
    running sum over months, so the work is one aggregation of the table.
    """
    first = F.trunc(F.add_months(_d(as_of), -(months - 1)), "month")
    last = F.trunc(_d(as_of), "month")
    s = subscriptions
    starts = s.where(F.col("start_date").isNotNull()) \
        .groupBy(F.trunc("start_date", "month").alias("m")).agg(F.count(F.lit(1)).alias("starts"))
    # a subscription ended on day d is no longer active at any month start
    # after d: key it by the first month start strictly after d
    ends = s.where(F.col("end_date").isNotNull()) \
        .groupBy(F.add_months(F.trunc("end_date", "month"), 1).alias("m")) \
        .agg(F.count(F.lit(1)).alias("ends_before"))
    cancels = s.where(F.col("cancellation_date").isNotNull()) \
        .groupBy(F.trunc("cancellation_date", "month").alias("m")).agg(F.count(F.lit(1)).alias("cancelled"))
    allm = starts.select("m").unionByName(ends.select("m")).unionByName(cancels.select("m")) \
        .unionByName(s.sparkSession.range(1).select(
            F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).alias("m"))).distinct()
    g = allm.join(starts, "m", "left").join(ends, "m", "left").join(cancels, "m", "left").fillna(0)
    w = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)  # one row per month: small
    g = g.select("m", "starts", "cancelled",
                 (F.coalesce(F.sum("starts").over(w), F.lit(0))
                  - F.coalesce(F.sum(F.col("ends_before")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                               F.lit(0))).alias("active_at_start"))
    return g.where((F.col("m") >= first) & (F.col("m") <= last)).select(
        F.col("m").alias("month"),
        F.col("starts").cast("bigint").alias("new_subscriptions"),
        F.col("cancelled").cast("bigint").alias("cancelled_subscriptions"),
        F.col("active_at_start").cast("bigint").alias("active_at_month_start"),
        F.round(safe_div(F.col("cancelled").cast("double"), F.col("active_at_start").cast("double")) * 100.0, 2)
        .alias("churn_rate_pct"),
    ).orderBy("month")


# ---------------------------------------------------------------- DB6

def plan_performance_by_tier(plans: DataFrame, subscriptions: DataFrame, billing: DataFrame,
                             as_of: dt.date, months: int = 6) -> DataFrame:
    """DB6: active customers (distinct at tier level), mean monthly revenue,
    subscriptions and six-month billed revenue per tier."""
    since = F.add_months(_d(as_of), -months)
    s = subscriptions.where((F.col("status") == "active") & (F.col("start_date") <= _d(as_of))
                            & (F.col("end_date").isNull() | (F.col("end_date") >= since))) \
        .join(plans.select("plan_id", "tier"), "plan_id")
    bills = billing.where(F.col("invoice_date") >= since).groupBy("subscription_id").agg(
        F.sum("amount").alias("amt"))
    j = s.join(bills, "subscription_id", "left")
    return j.groupBy("tier").agg(
        F.countDistinct("customer_id").alias("active_customers"),
        F.round(F.avg(F.col("monthly_revenue").cast("double")), 2).alias("avg_monthly_revenue"),
        F.count(F.lit(1)).alias("total_subscriptions"),
        F.coalesce(F.sum("amt"), F.lit(0)).cast("decimal(18,2)").alias("six_month_total_revenue"),
    ).orderBy(F.col("six_month_total_revenue").desc())


# ---------------------------------------------------------------- DB7, DB8, DB9, DB10

def engagement_revenue_points(segmented: DataFrame) -> DataFrame:
    """DB7: one point per merged row: engagement, LTV, events + sessions,
    churn status and tickets (projection of the segments)."""
    return segmented.select(
        "customer_id", "subscription_id", "tier",
        F.round("engagement_score", 6).alias("engagement_score"),
        F.round("lifetime_value", 6).alias("lifetime_value"),
        (F.col("total_events") + F.col("total_sessions")).alias("events_plus_sessions"),
        F.when(F.coalesce(F.col("status") == "cancelled", F.lit(False)), "churned").otherwise("active")
        .alias("churn_status"),
        "total_tickets")


def high_risk_table(downgrades: DataFrame, n: int = 20) -> DataFrame:
    """DB8: the first ``n`` rows of the downgrade-risk report."""
    return downgrades.orderBy(F.col("support_tickets_30d_before_downgrade").desc(),
                              F.col("downgrade_date").desc(), "customer_id").limit(n).select(
        "customer_id", "company_name", "previous_plan", "current_plan",
        "support_tickets_30d_before_downgrade", "subscription_revenue_lost", "risk_category")


def segment_distribution(segmented: DataFrame) -> DataFrame:
    """DB9: rows per segment and share of all rows in %."""
    counts = segmented.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("customers"))
    total = segmented.agg(F.count(F.lit(1))).scalar()
    return counts.select("customer_segment", "customers",
                         F.round(F.col("customers") / total * 100.0, 2).alias("share_pct"))


def customer_measures(customers: DataFrame, subscriptions: DataFrame, billing: DataFrame,
                      tickets: DataFrame, events: DataFrame | None, sessions: DataFrame | None) -> DataFrame:
    """DB10: per customer, LTV = all billed amounts, the report's engagement
    score (seconds, not minutes), and churn risk = any cancelled subscription
    or more than 5 tickets."""
    ltv = subscriptions.select("subscription_id", "customer_id") \
        .join(billing.select("subscription_id", "amount"), "subscription_id") \
        .groupBy("customer_id").agg(F.sum("amount").alias("ltv"))
    cancelled = subscriptions.groupBy("customer_id").agg(
        F.max((F.col("status") == "cancelled").cast("int")).alias("__cancelled"))
    tix = tickets.groupBy("customer_id").agg(F.count(F.lit(1)).alias("__tickets"))
    m = customers.select("customer_id").join(ltv, "customer_id", "left").join(cancelled, "customer_id", "left") \
        .join(tix, "customer_id", "left")
    if events is not None:
        m = m.join(events.groupBy("customer_id").agg(F.count(F.lit(1)).alias("__ev")), "customer_id", "left")
    else:
        m = m.withColumn("__ev", F.lit(None).cast("bigint"))
    if sessions is not None:
        m = m.join(sessions.groupBy("customer_id").agg(F.count(F.lit(1)).alias("__ses"),
                                                       F.avg("duration").alias("__dur")), "customer_id", "left")
    else:
        m = m.withColumn("__ses", F.lit(None).cast("bigint")).withColumn("__dur", F.lit(None).cast("double"))
    score = (F.coalesce(F.col("__ev"), F.lit(0)) * 0.3 + F.coalesce(F.col("__ses"), F.lit(0)) * 0.4
             + F.coalesce(F.col("__dur"), F.lit(0.0)) * 0.3)
    risk = (F.coalesce(F.col("__cancelled"), F.lit(0)) == 1) | (F.coalesce(F.col("__tickets"), F.lit(0)) > CHURN_TICKETS)
    return m.select("customer_id", F.coalesce(F.col("ltv"), F.lit(0)).cast("decimal(18,2)").alias("ltv"),
                    F.round(score, 6).alias("engagement_score"), risk.cast("int").alias("churn_risk"))


def tier_revenue(plan_metrics: DataFrame) -> DataFrame:
    """DB10: six-month revenue per tier from the plan metrics."""
    return plan_metrics.groupBy("tier").agg(
        F.sum("six_month_total_revenue").cast("decimal(18,2)").alias("tier_revenue"))


# ---------------------------------------------------------------- DB11

def feature_adoption_by_tier(events: DataFrame, feature_events: Sequence[str] | None = None) -> DataFrame:
    """DB11: share of a tier's users that used each feature."""
    e = events.where(F.col("feature_name").isNotNull())
    if feature_events:
        e = e.where(F.col("event_type").isin(list(feature_events)))
    tier = F.coalesce(F.col("subscription_tier"), F.lit("unknown"))
    users = events.select(tier.alias("tier"), "user_id").distinct().groupBy("tier") \
        .agg(F.count(F.lit(1)).alias("tier_users"))
    used = e.select(tier.alias("tier"), "feature_name", "user_id").distinct() \
        .groupBy("tier", "feature_name").agg(F.count(F.lit(1)).alias("feature_users"))
    # per-tier user counts: left to AQE, which broadcasts them when it measures them small
    return used.join(users, "tier").select(
        "tier", "feature_name", "feature_users", "tier_users",
        F.round(F.col("feature_users") / F.col("tier_users") * 100.0, 2).alias("adoption_pct"))


def session_duration_trend(sessions: DataFrame) -> DataFrame:
    """DB11: mean session duration per day."""
    return sessions.groupBy(F.to_date("start_time").alias("day")).agg(
        F.count(F.lit(1)).alias("sessions"), F.round(F.avg("duration"), 4).alias("avg_duration"))


def tickets_by_severity(tickets: DataFrame) -> DataFrame:
    """DB11: tickets per priority."""
    return tickets.groupBy("priority").agg(F.count(F.lit(1)).alias("tickets"))


def churn_funnel(subscriptions: DataFrame, stages: Sequence[str] = STATUS_FUNNEL) -> DataFrame:
    """DB11: subscriptions per status along active -> downgraded -> cancelled."""
    order = subscriptions.sparkSession.createDataFrame(
        [(s, i + 1) for i, s in enumerate(stages)], "status string, step_number int")
    counts = subscriptions.groupBy("status").agg(F.count(F.lit(1)).alias("subscriptions"))
    return F.broadcast(order).join(counts, "status", "left").select(
        "status", "step_number", F.coalesce(F.col("subscriptions"), F.lit(0)).cast("bigint").alias("subscriptions"))


# ---------------------------------------------------------------- DB12, DB13, DB14

def revenue_drilldown(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """DB12: tier -> plan -> customer roll-up of subscriptions and revenue,
    with the grouping level."""
    s = subscriptions.join(plans.select("plan_id", "plan_name", "tier"), "plan_id")
    return s.rollup("tier", "plan_name", "customer_id").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("subscriptions"),
        F.sum("monthly_revenue").cast("decimal(20,2)").alias("monthly_revenue"))


def apply_filters(df: DataFrame, date_col: str | None = None, since: dt.date | None = None,
                  until: dt.date | None = None, as_of: dt.date | None = None, default_months: int = 12,
                  tiers: Sequence[str] | None = None, tier_col: str = "tier",
                  churn_status: str | None = None, status_col: str = "status") -> DataFrame:
    """DB13: dashboard filters as predicates (pushed to the scan by Catalyst):
    a date range (default: the last ``default_months`` before ``as_of``),
    a tier list and a churn status ('churned' = cancelled, 'active' = not)."""
    out = df
    if date_col is not None:
        if since is None and as_of is not None:
            since = _months_back(as_of, default_months)
        if since is not None:
            out = out.where(F.col(date_col) >= F.lit(since))
        if until is not None:
            out = out.where(F.col(date_col) <= F.lit(until))
        elif as_of is not None:
            out = out.where(F.col(date_col) <= F.lit(as_of))
    if tiers:
        out = out.where(F.col(tier_col).isin(list(tiers)))
    if churn_status == "churned":
        out = out.where(F.col(status_col) == "cancelled")
    elif churn_status == "active":
        out = out.where(~F.coalesce(F.col(status_col) == "cancelled", F.lit(False)))
    return out


def _months_back(d: dt.date, months: int) -> dt.date:
    import calendar
    y, m = divmod(d.year * 12 + (d.month - 1) - months, 12)
    day = min(d.day, calendar.monthrange(y, m + 1)[1])
    return dt.date(y, m + 1, day)


def monthly_event_summary(events: DataFrame) -> DataFrame:
    """DB14: events and distinct users per month and event type."""
    return events.groupBy(F.trunc(F.to_date("timestamp"), "month").alias("month"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))


def monthly_session_summary(sessions: DataFrame) -> DataFrame:
    """DB14: sessions, distinct users and mean duration per month."""
    return sessions.groupBy(F.trunc(F.to_date("start_time"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("sessions"), F.countDistinct("user_id").alias("users"),
        F.round(F.avg("duration"), 4).alias("avg_duration"))
