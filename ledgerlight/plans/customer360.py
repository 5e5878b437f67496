"""Customer-360 batch: extract, clean, merge, hypothesis test, segments
(MG1-MG5, HT1-HT6, SG1-SG3, RUN).

Everything stays distributed. Thresholds (quantiles) are one-row aggregates
joined back by broadcast; the t tail probability is a column expression on
the one-row moments frame.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.stats import ALPHA, EFFECT_BANDS, LARGE_EFFECT, t_two_sided_p_col
from ledgerlight.operators.ranking import quantiles_of_columns
from ledgerlight.plans import cleaning
from ledgerlight.session import materialize
from ledgerlight.sources import sinks

GRAIN_INVOICE, GRAIN_CUSTOMER = "invoice", "customer"

# Engagement weights of the merged data set (events, sessions, minutes).
W_EVENTS, W_SESSIONS, W_MINUTES = 0.3, 0.4, 0.3
# Segment thresholds (quantiles) and LTV months.
Q_LOW, Q_HIGH = 0.33, 0.66
LTV_MONTHS = 12


# ---------------------------------------------------------------- extract

def subscription_extract(subscriptions: DataFrame, plans: DataFrame, billing: DataFrame) -> DataFrame:
    """MG1: subscriptions JOIN plans LEFT JOIN billing, invoice amount as
    monthly_revenue (one row per subscription x invoice)."""
    # the plan catalogue is broadcast: dealt by plan, the rows would lie in as many tasks as there are plans
    p = F.broadcast(plans.select("plan_id", "plan_name", "tier"))
    b = billing.select("subscription_id", "invoice_date", F.col("amount").alias("monthly_revenue"))
    s = subscriptions.select("subscription_id", "customer_id", "plan_id", "status", "start_date", "end_date")
    return s.join(p, "plan_id").join(b, "subscription_id", "left").select(
        "subscription_id", "customer_id", "plan_name", "tier", "monthly_revenue", "status",
        "start_date", "end_date", "invoice_date")


def recent_tickets(tickets: DataFrame, as_of: dt.date, days: int = 180) -> DataFrame:
    """Tickets of the last ``days`` days (filter reaches the scan)."""
    since = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")
    return tickets.where(F.col("created_at") >= since)


# ---------------------------------------------------------------- summaries

def _ticket_sums() -> list[Column]:
    return [F.count("ticket_id").alias("total_tickets"),
            F.count_if(F.col("priority") == "critical").alias("critical_tickets"),
            F.avg("resolution_time_hours").alias("avg_resolution_time")]


def _event_sums() -> list[Column]:
    return [F.count("event_type").alias("total_events"), F.max("timestamp").alias("last_event_date")]


def _session_sums() -> list[Column]:
    return [F.avg("duration").alias("avg_session_duration"), F.count("session_id").alias("total_sessions")]


def ticket_summary(tickets: DataFrame) -> DataFrame:
    """MG2: per customer, ticket count, critical tickets, mean resolution hours."""
    return tickets.groupBy("customer_id").agg(*_ticket_sums())


def event_summary(events: DataFrame) -> DataFrame:
    """MG3: per customer, events with a type and the last event time."""
    return events.groupBy("customer_id").agg(*_event_sums())


def session_summary(sessions: DataFrame) -> DataFrame:
    """MG4: per customer, mean session duration and session count."""
    return sessions.groupBy("customer_id").agg(*_session_sums())


def merge(customers: DataFrame, subs: DataFrame, tickets: DataFrame | None, events: DataFrame | None,
          sessions: DataFrame | None, grain: str = GRAIN_INVOICE) -> DataFrame:
    """MG5: customers left-joined with subscriptions and the summaries of
    tickets, events and sessions; see ``merge_summaries``."""
    return merge_summaries(customers, subs, *[None if x is None else f(x) for f, x in (
        (ticket_summary, tickets), (event_summary, events), (session_summary, sessions))], grain)


def merge_summaries(customers: DataFrame, subs: DataFrame, tickets: DataFrame | None, events: DataFrame | None,
                    sessions: DataFrame | None, grain: str = GRAIN_INVOICE) -> DataFrame:
    """MG5 from the summaries per customer: counts default to 0; optional
    summaries may be None.

    ``invoice`` (as coded) keeps one row per subscription x invoice.
    ``customer`` keeps one row per customer: revenue is the latest invoice
    of each active subscription, summed, and status/plan come from the
    latest subscription.
    """
    if grain == GRAIN_CUSTOMER:
        subs = _customer_grain(subs)
    m = customers
    zero = []
    if tickets is not None:
        m = m.join(tickets, "customer_id", "left")
        zero += ["total_tickets", "critical_tickets"]
    else:
        m = m.withColumn("total_tickets", F.lit(0).cast("bigint")) \
            .withColumn("critical_tickets", F.lit(0).cast("bigint")) \
            .withColumn("avg_resolution_time", F.lit(None).cast("double"))
    if events is not None:
        m = m.join(events, "customer_id", "left")
        zero.append("total_events")
    else:
        m = m.withColumn("total_events", F.lit(0).cast("bigint")) \
            .withColumn("last_event_date", F.lit(None).cast("timestamp_ntz"))
    if sessions is not None:
        m = m.join(sessions, "customer_id", "left")
        zero.append("total_sessions")
    else:
        m = m.withColumn("total_sessions", F.lit(0).cast("bigint")) \
            .withColumn("avg_session_duration", F.lit(None).cast("double"))
    # the invoices come last: their rows pass through one join only, which can
    # split a customer that has very many of them
    m = m.fillna(0, subset=zero).join(subs.drop("email"), "customer_id", "left")
    rest = [c for c in m.columns if c not in customers.columns and c not in subs.columns]
    return m.select(*customers.columns, *[c for c in subs.columns if c not in ("email", "customer_id")], *rest)


def _customer_grain(subs: DataFrame) -> DataFrame:
    """One row per customer from subscription x invoice rows: the latest
    invoice (by date, then amount) of each subscription, summed over active
    subscriptions; status, plan and tier of the latest subscription. Two
    aggregations with partial aggregation, no window."""
    per_sub = subs.groupBy("subscription_id", "customer_id", "status", "plan_name", "tier", "start_date").agg(
        F.max_by("monthly_revenue", F.struct("invoice_date", "monthly_revenue")).alias("__amt"))
    return per_sub.groupBy("customer_id").agg(
        F.sum(F.when(F.col("status") == "active", F.col("__amt"))).alias("monthly_revenue"),
        F.max_by(F.struct("subscription_id", "status", "plan_name", "tier", "start_date"),
                 F.struct("start_date", "subscription_id")).alias("__l"),
    ).select("customer_id", "monthly_revenue", "__l.*")


# ---------------------------------------------------------------- hypothesis test

def engagement(df: DataFrame) -> DataFrame:
    """HT1: engagement = 0.3 events + 0.4 sessions + 0.3 (mean seconds / 60)."""
    return df.withColumn("engagement_score",
                         F.coalesce(F.col("total_events"), F.lit(0)) * F.lit(W_EVENTS)
                         + F.coalesce(F.col("total_sessions"), F.lit(0)) * F.lit(W_SESSIONS)
                         + F.coalesce(F.col("avg_session_duration"), F.lit(0.0)) / F.lit(60.0) * F.lit(W_MINUTES))


def test_moments(merged: DataFrame) -> DataFrame:
    """HT1-HT3, HT6: churn flag, median split, per-group sizes, churn rates,
    pooled t statistic, degrees of freedom and Cohen's d, as one row.

    Churn = status 'cancelled' or tickets above their 75th percentile
    (linear interpolation). Engaged = engagement above its median.
    """
    df = engagement(merged)
    # thresholds: one-row results used as scalar subqueries
    at = quantiles_of_columns(df, {"total_tickets": {"p75": 0.75}, "engagement_score": {"med": 0.5}}).select(F.struct("*")).scalar()
    df = df.withColumn("__at", at)
    p75, med = F.col("__at")["p75"], F.col("__at")["med"]
    churned = (F.coalesce(F.col("status") == "cancelled", F.lit(False))
               | (F.col("total_tickets") > p75)).cast("int")
    hi = F.col("engagement_score") > med
    j = df.select(hi.alias("hi"), churned.alias("c"), p75.alias("tickets_p75"), med.alias("engagement_median"))
    g = j.agg(
        F.first("tickets_p75").alias("tickets_p75"),
        F.first("engagement_median").alias("engagement_median"),
        F.count_if(F.col("hi")).alias("engaged_n"),
        F.count_if(~F.col("hi")).alias("disengaged_n"),
        F.avg(F.when(F.col("hi"), F.col("c"))).alias("engaged_churn_rate"),
        F.avg(F.when(~F.col("hi"), F.col("c"))).alias("disengaged_churn_rate"),
        F.var_samp(F.when(F.col("hi"), F.col("c"))).alias("v1"),
        F.var_samp(F.when(~F.col("hi"), F.col("c"))).alias("v2"),
    )
    n1, n2 = F.col("engaged_n"), F.col("disengaged_n")
    m1, m2 = F.col("engaged_churn_rate"), F.col("disengaged_churn_rate")
    sp2 = ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2)
    t = (m1 - m2) / F.sqrt(sp2 * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    d = (m1 - m2) / F.sqrt((F.col("v1") + F.col("v2")) / 2)
    band = F.when(F.abs(d) < EFFECT_BANDS[0][0], EFFECT_BANDS[0][1]) \
        .when(F.abs(d) < EFFECT_BANDS[1][0], EFFECT_BANDS[1][1]) \
        .when(F.abs(d) < EFFECT_BANDS[2][0], EFFECT_BANDS[2][1]).otherwise(LARGE_EFFECT)
    return g.select(
        F.round("tickets_p75", 6).alias("tickets_p75"),
        F.round("engagement_median", 6).alias("engagement_median"),
        "engaged_n", "disengaged_n",
        F.round(m1, 6).alias("engaged_churn_rate"), F.round(m2, 6).alias("disengaged_churn_rate"),
        F.round(t, 6).alias("t_statistic"),
        (n1 + n2 - 2).alias("degrees_of_freedom"),
        F.round(d, 6).alias("cohens_d"),
        F.when(d.isNull(), F.lit(None)).otherwise(band).alias("effect_interpretation"),
    )


def hypothesis_test(merged: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """HT4-HT5: the moments row plus the two-sided p-value (pooled t test)
    and the decision at ``alpha``. The p-value is a column expression on the
    one-row moments frame (incomplete beta by continued fraction), so
    nothing is collected."""
    mom = test_moments(merged)
    p = F.round(t_two_sided_p_col(F.col("t_statistic"), F.col("degrees_of_freedom")), 6)
    return mom.withColumn("p_value", p).withColumn(
        "reject_h0", F.when(F.col("p_value").isNull(), F.lit(None)).otherwise(F.col("p_value") < F.lit(alpha)))


# ---------------------------------------------------------------- segments

def scored(merged: DataFrame) -> DataFrame:
    """The merged rows with engagement and LTV, without thresholds."""
    return engagement(merged).withColumn(
        "lifetime_value", F.coalesce(F.col("monthly_revenue").cast("double"), F.lit(0.0)) * F.lit(float(LTV_MONTHS)))


def segments(merged: DataFrame) -> DataFrame:
    """SG1-SG2: LTV = monthly revenue x 12 (missing = 0), engagement, and the
    first matching segment rule against the 33rd / 66th percentiles."""
    df = scored(merged)
    # the four thresholds from one pass over both columns
    at = quantiles_of_columns(df, {"lifetime_value": {"ltv_lo": Q_LOW, "ltv_hi": Q_HIGH},
                                   "engagement_score": {"eng_lo": Q_LOW, "eng_hi": Q_HIGH}}).select(F.struct("*")).scalar()
    df = df.withColumn("__at", at)
    at, ltv, eng = F.col("__at"), F.col("lifetime_value"), F.col("engagement_score")
    seg = (F.when((ltv >= at["ltv_hi"]) & (eng >= at["eng_hi"]), "VIP_ENGAGED")
           .when((ltv >= at["ltv_hi"]) & (eng < at["eng_lo"]), "VIP_AT_RISK")
           .when((ltv >= at["ltv_lo"]) & (eng >= at["eng_hi"]), "GROWTH_POTENTIAL")
           .when((ltv < at["ltv_lo"]) & (eng >= at["eng_hi"]), "ENGAGED_STARTER")
           .when((ltv < at["ltv_lo"]) & (eng < at["eng_lo"]), "AT_RISK")
           .otherwise("STABLE"))
    return df.withColumn("customer_segment", seg).drop("__at") \
        .withColumn("support_intensity", F.coalesce(F.col("total_tickets"), F.lit(0)))


def segment_stats(segmented: DataFrame) -> DataFrame:
    """SG3: per segment, rows, LTV mean and sum, mean engagement, mean
    tickets (2 dp, half-even) and the modal tier (smallest on ties,
    'unknown' when there is none)."""
    return segmented.groupBy("customer_segment").agg(
        F.count("customer_id").alias("customers"),
        F.bround(F.avg("lifetime_value"), 2).alias("ltv_mean"),
        F.bround(F.sum("lifetime_value"), 2).alias("ltv_sum"),
        F.bround(F.avg("engagement_score"), 2).alias("engagement_mean"),
        F.bround(F.avg("total_tickets"), 2).alias("tickets_mean"),
        F.coalesce(F.mode("tier", True), F.lit("unknown")).alias("primary_tier"),
    )


# ---------------------------------------------------------------- RUN

class Customer360:
    """RUN result. Cleaned inputs and the merged table are stored at their first
    use in the shared checkpoint folder; the log, moments, segments and
    statistics read the stored rows."""

    def __init__(self, marked: dict[str, DataFrame], grain: str):
        self._marked, self._grain = marked, grain
        self._stored: dict[str, DataFrame] = {}
        self._merged = self._segments = None

    def _input(self, name: str) -> DataFrame | None:
        if name not in self._marked:
            return None
        if name not in self._stored:
            self._stored[name] = materialize(self._marked[name])
        return self._stored[name]

    @property
    def cleaning_log(self) -> DataFrame:
        """CL13 from the marks and counters the stored inputs carry."""
        counters = {"rows": F.sum("_rows"), "left": F.sum("_left")}
        logs = [cleaning.log_row(name, self._input(name), **({} if name in ("customers", "subscriptions") else counters))
                for name in self._marked]
        out = logs[0]
        for log in logs[1:]:
            out = out.unionByName(log)
        return out

    @property
    def merged(self) -> DataFrame:
        """Written at first use; the log alone never builds it."""
        if self._merged is None:
            summaries = [None if x is None else x.drop("_rows", "_left") for x in map(self._input, ("support_tickets", "events", "sessions"))]
            self._merged = materialize(merge_summaries(
                cleaning.kept(self._input("customers")), cleaning.kept(self._input("subscriptions")), *summaries, self._grain))
        return self._merged

    @property
    def moments(self) -> DataFrame:
        return test_moments(self.merged)

    @property
    def scored(self) -> DataFrame:
        return scored(self.merged)

    @property
    def segments(self) -> DataFrame:
        if self._segments is None:
            self._segments = segments(self.merged)
        return self._segments

    @property
    def segment_stats(self) -> DataFrame:
        return segment_stats(self.segments)


def _counted(sums: list[Column], marked: DataFrame) -> DataFrame:
    """A summary per customer, with the numbers of input and kept rows it stands
    for. Only rows without a customer are not kept, and those meet no customer."""
    return marked.groupBy("customer_id").agg(*sums, F.sum("_rows").alias("_rows"), F.count_if(F.col("_kept")).alias("_left"))


def customer360(customers: DataFrame, subscriptions: DataFrame, plans: DataFrame, billing: DataFrame,
                tickets: DataFrame, as_of: dt.date, events: DataFrame | None = None,
                sessions: DataFrame | None = None, grain: str = GRAIN_INVOICE) -> Customer360:
    """RUN: relational inputs are mandatory, events and sessions optional."""
    marked = {
        "customers": cleaning.mark_customers(customers),
        "subscriptions": cleaning.mark_subscriptions(subscription_extract(subscriptions, plans, billing), plans),
        "support_tickets": _counted(_ticket_sums(), cleaning.mark_tickets(recent_tickets(tickets, as_of))),
    }
    if events is not None:
        marked["events"] = _counted(_event_sums(), cleaning.mark_rows(events))
    if sessions is not None:
        marked["sessions"] = _counted(_session_sums(), cleaning.mark_rows(sessions))
    return Customer360(marked, grain)


def export_run(run: Customer360, path: str) -> DataFrame:
    """RUN's last step: the merged rows as CSV, the cleaning log, the test and
    the segment statistics as JSON lines below ``path``, and the summary it
    prints as (section, metric, value) rows, stored beside them."""
    sinks.export_csv(run.merged, f"{path}/merged_analysis_data")
    log, stats = materialize(run.cleaning_log), materialize(run.segment_stats)
    test = materialize(hypothesis_test(run.merged))
    for name, df in (("data_cleaning_log", log), ("hypothesis_test", test), ("segment_stats", stats)):
        sinks.write_metrics(df, f"{path}/{name}")

    def rows(section: str, df: DataFrame, names: list[str], key: str | None = None) -> DataFrame:
        items = [F.struct(F.lit(section).alias("section"),
                          (F.concat(F.col(key), F.lit(f".{n}")) if key else F.lit(n)).alias("metric"),
                          F.col(n).cast("double").alias("value")) for n in names]
        return df.select(F.explode(F.array(*items)).alias("r")).select("r.*")

    merged = run.merged.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("customer_id").alias("customers"))
    summary = rows("merged", merged, ["rows", "customers"]) \
        .unionByName(rows("cleaning", cleaning.cleaning_totals(log), ["tables", "rows_before", "rows_after", "rows_removed", "pct_removed"])) \
        .unionByName(rows("test", test, ["engaged_n", "disengaged_n", "t_statistic", "cohens_d"])) \
        .unionByName(rows("segments", stats, ["customers"], "customer_segment"))
    sinks.write_metrics(summary, f"{path}/summary")
    return summary.sparkSession.read.schema(summary.schema).json(f"{path}/summary")
