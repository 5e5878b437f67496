"""Cleaning jobs (CL1-CL13).

Nothing is mutated in place: each step is a DataFrame transformation that
marks or filters rows, and the report is computed from flag columns in one
aggregation per stage. Write the result to a new location and swap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.plans.quality import EXPECTED_EVENTS, EXPECTED_TIERS
from ledgerlight.session import materialize
from ledgerlight.sources.canonical import canonical_events, parse_event_time

AS_CODED, CORRECTED = "as_coded", "corrected"
CRITICAL_FIELDS = ("user_id", "timestamp", "event_type")
TEXT_FIELDS = ("user_id", "event_type", "feature_name")
# different unreadable times are different events
DEDUPE_KEY = ("user_id", "event_type", "timestamp", "timestamp_raw")


# ---------------------------------------------------------------- events

def drop_missing_critical(df: DataFrame, mode: str = AS_CODED,
                          fields: Sequence[str] = CRITICAL_FIELDS) -> DataFrame:
    """CL1: drop rows missing a critical field. ``as_coded`` checks only the
    first field (the reference built its query for one field only)."""
    checked = fields[:1] if mode == AS_CODED else fields
    return df.dropna(how="any", subset=list(checked))


def fill_tier(df: DataFrame, default: str = "unknown") -> DataFrame:
    """CL2: NULL tier becomes ``default``."""
    return df.fillna({"subscription_tier": default})


def parse_timestamps(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """CL3: text timestamps to UTC. ``_ts_parsed`` marks text that parsed. Text
    that does not parse is left, in ``timestamp_raw``, beside a NULL time
    (NULL where the time parsed or there was none); see :func:`quarantine`."""
    if dict(df.dtypes)[col] != "string":
        return df.withColumn("_ts_parsed", F.lit(False)).withColumn("timestamp_raw", F.lit(None).cast("string"))
    parsed = parse_event_time(col)
    return df.withColumn("_ts_parsed", parsed.isNotNull()) \
        .withColumn("timestamp_raw", F.when(parsed.isNull(), F.col(col))).withColumn(col, parsed)


def quarantine(clean: DataFrame) -> DataFrame:
    """Cleaned events whose time could not be read, with the text as it came."""
    return clean.where(F.col("timestamp_raw").isNotNull())


def dedupe_exact(df: DataFrame, key: Sequence[str] = DEDUPE_KEY, order_col: str = "event_id") -> DataFrame:
    """CL4: keep the first row (lowest ``order_col``) of every key. Done as an
    aggregation (``min_by`` with map-side partial aggregation), so a key with
    a huge number of copies is combined before the shuffle instead of being
    sorted in one task. ``_copies`` carries the group size."""
    others = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.min_by(F.struct(*others), F.col(order_col)).alias("__r"),
                            F.count(F.lit(1)).alias("_copies"))
    return g.select(*key, "__r.*", "_copies").select(*df.columns, "_copies")


def _repair_text(c: Column) -> Column:
    return F.when(c.isNull() | F.is_valid_utf8(c), c) \
        .otherwise(F.regexp_replace(F.make_valid_utf8(c), "\uFFFD", ""))


def repair_utf8(df: DataFrame, fields: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    """CL5: drop invalid UTF-8 byte sequences from text fields (whole table;
    the reference looked at its first 1000 documents). ``_enc_fixed`` marks
    rows that changed."""
    present = [f for f in fields if f in df.columns]
    changed = F.lit(False)
    for f in present:
        changed = changed | F.coalesce(~F.is_valid_utf8(F.col(f)), F.lit(False))
    out = df.withColumn("_enc_fixed", changed)
    for f in present:
        out = out.withColumn(f, _repair_text(F.col(f)))
    return out


def flag_outliers(df: DataFrame, factor: float = 10.0, col: str = "properties.duration_seconds") -> DataFrame:
    """CL6: ``flagged_outlier`` = duration > factor x mean duration. The mean
    is a scalar subquery (one aggregation, inlined as a value); rows are kept."""
    d = F.col(col).cast("double")
    mean = df.agg(F.avg(d.cast("decimal(38,9)")).cast("double")).scalar()
    return df.withColumn("flagged_outlier", F.coalesce(d > F.lit(float(factor)) * mean, F.lit(False)))


# what became of a raw row: kept (with its copies), or dropped for one reason
_KEPT, _MISSING, _UNREADABLE = 0, 1, 2


def clean_events(raw: DataFrame, mode: str = AS_CODED, outlier_factor: float = 10.0,
                 expected_events: Sequence[str] = EXPECTED_EVENTS,
                 expected_tiers: Sequence[str] = EXPECTED_TIERS) -> tuple[DataFrame, DataFrame]:
    """CL8: canonicalise, then CL1 -> CL2 -> CL3 -> CL4 -> CL5 -> CL6, and the
    CL7 report (with the DQ9 counts). Returns (clean events, report).

    The raw events are read once. Dropped rows go through the deduplication as
    one row for each reason, so its group sizes count every raw row, and the
    stored result holds all that the report needs."""
    canon = canonical_events(raw, parse_time=False)
    checked = CRITICAL_FIELDS[:1] if mode == AS_CODED else CRITICAL_FIELDS
    miss = F.lit(False)
    for f in checked:
        miss = miss | F.col(f).isNull()
    read = parse_timestamps(fill_tier(canon.withColumn("_missing", miss)))
    unreadable = F.col("timestamp").isNull() if mode == CORRECTED else F.lit(False)
    read = read.withColumn("_state", F.when(F.col("_missing"), _MISSING).when(unreadable, _UNREADABLE).otherwise(_KEPT)).drop("_missing")
    gone = F.col("_state") != _KEPT
    read = read.withColumns({c: F.when(~gone, F.col(c)) for c in DEDUPE_KEY})
    done = materialize(repair_utf8(dedupe_exact(read, ("_state", *DEDUPE_KEY))))
    flagged = flag_outliers(done.where(F.col("_state") == _KEPT), outlier_factor)
    clean = flagged.select(*[c for c in flagged.columns if c not in ("_state", "_ts_parsed", "_copies", "_enc_fixed")])

    counts = done.agg(
        F.sum("_copies").alias("before_total"),
        F.sum(F.when(F.col("_state") == _MISSING, F.col("_copies"))).alias("null_corrections"),
        F.sum(F.when((F.col("_state") == _KEPT) & F.col("_ts_parsed"), F.col("_copies"))).alias("timezone_corrections"),
        F.sum(F.when(F.col("_state") == _KEPT, F.col("_copies") - 1)).alias("duplicates_removed"))
    after = flagged.agg(
        F.count(F.lit(1)).alias("after_total"),
        F.count_if(F.col("_enc_fixed")).alias("encoding_fixes"),
        F.count_if(F.col("flagged_outlier")).alias("outliers_flagged"),
        F.count_if(~F.coalesce(F.col("event_type").isin(*expected_events), F.lit(False)))
        .alias("unexpected_event_types"),
        F.count_if(~F.coalesce(F.col("subscription_tier").isin(*expected_tiers), F.lit(False)))
        .alias("unexpected_tiers"),
    )
    wide = after.withColumn("__c", counts.select(F.struct("*")).scalar()).select("*", "__c.*").fillna(0) \
        .withColumn("records_removed", F.col("before_total") - F.col("after_total"))
    metrics = ["before_total", "after_total", "records_removed", "null_corrections", "timezone_corrections", "duplicates_removed",
               "encoding_fixes", "outliers_flagged", "unexpected_event_types", "unexpected_tiers"]
    stack = ", ".join(f"'{m}', CAST(`{m}` AS BIGINT)" for m in metrics)
    report = wide.select(F.expr(f"stack({len(metrics)}, {stack}) AS (metric, value)"))
    return clean, report


def run_quality_phase(raw: DataFrame, mode: str = "full", clean_mode: str = AS_CODED,
                      outlier_factor: float = 10.0, expected_events: Sequence[str] = EXPECTED_EVENTS,
                      expected_tiers: Sequence[str] = EXPECTED_TIERS) -> dict[str, DataFrame]:
    """CL8 driver: ``analyze`` profiles the raw events (DQ8 report),
    ``clean`` runs the cleaning chain and its report, ``full`` does both."""
    from ledgerlight.plans.quality import quality_report
    if mode not in ("analyze", "clean", "full"):
        raise ValueError(f"mode must be analyze, clean or full, got {mode!r}")
    out: dict[str, DataFrame] = {}
    if mode in ("analyze", "full"):
        out["quality_report"] = quality_report(canonical_events(raw), expected_events, expected_tiers)
    if mode in ("clean", "full"):
        out["clean_events"], out["cleaning_report"] = clean_events(
            raw, clean_mode, outlier_factor, expected_events, expected_tiers)
    return out


# ---------------------------------------------------------------- customer-360 inputs
#
# Every step marks rows instead of dropping them: ``_rows`` is the number of
# input rows a row stands for, ``_kept`` whether it stays. The log is one sum over
# the marked rows, so no input is read again to count it.

def kept(marked: DataFrame) -> DataFrame:
    return marked.where(F.col("_kept")).drop("_rows", "_kept")


def mark_customers(customers: DataFrame) -> DataFrame:
    """CL9: one row per email (first customer_id kept; NULL emails count as one
    value); rows without email go; email_domain = lower(text after @), NULL when
    there is none."""
    g = customers.groupBy("email").agg(F.min_by(F.struct(*[c for c in customers.columns if c != "email"]),
                                                F.col("customer_id")).alias("__r"), F.count(F.lit(1)).alias("_rows"))
    domain = F.nullif(F.lower(F.regexp_extract("email", "@(.+)$", 1)), F.lit(""))
    return g.select("email", "__r.*", "_rows").withColumn("email_domain", domain).select(
        *dict.fromkeys([*customers.columns, "email_domain"]), "_rows", F.col("email").isNotNull().alias("_kept"))


def mark_subscriptions(subs: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """CL10: coerce dates, drop end < start, fill NULL revenue with the tier
    mean, drop rows without customer_id or start_date. The mean is taken
    before the NULL-key drop (as the reference does), exactly over decimals
    and rounded half-up to 6 dp. Text that is no date becomes NULL."""
    s = subs.withColumn("start_date", F.col("start_date").try_cast("date")) \
        .withColumn("end_date", F.col("end_date").try_cast("date"))
    if "tier" not in s.columns:
        s = s.join(F.broadcast(plans.select("plan_id", "tier")), "plan_id", "left")
    ends_before = F.coalesce(F.col("end_date") < F.col("start_date"), F.lit(False))
    rev = F.col("monthly_revenue").cast("decimal(18,2)")
    means = s.where(~ends_before).groupBy(F.col("tier").alias("__tier")).agg(F.round(F.avg(rev), 6).alias("__m"))
    # one row a tier: broadcast, else the rows are dealt by their tier, a third of them to one task
    s = s.join(F.broadcast(means), F.col("tier").eqNullSafe(F.col("__tier")), "left")
    s = s.withColumn("monthly_revenue", F.coalesce(rev.cast("decimal(24,6)"), F.col("__m"))).drop("__m", "__tier")
    return s.withColumn("_rows", F.lit(1).cast("bigint")).withColumn(
        "_kept", ~ends_before & F.col("customer_id").isNotNull() & F.col("start_date").isNotNull())


def mark_tickets(tickets: DataFrame) -> DataFrame:
    """CL11: drop tickets without customer; resolution_time_hours. Text that is
    no time becomes NULL."""
    times = {c: F.col(c).try_cast("timestamp_ntz") for c in ("created_at", "resolved_at")}
    return tickets.withColumns(times).withColumn(
        "resolution_time_hours",
        (F.unix_micros(F.col("resolved_at").cast("timestamp"))
         - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(3.6e9)) \
        .withColumn("_rows", F.lit(1).cast("bigint")).withColumn("_kept", F.col("customer_id").isNotNull())


def mark_rows(df: DataFrame) -> DataFrame:
    """CL12: full-row duplicate removal (map columns serialised first)."""
    maps = [c for c, t in df.dtypes if t.startswith("map")]
    tmp = df.withColumns({c: F.to_json(c) for c in maps})
    once = tmp.groupBy(*tmp.columns).agg(F.count(F.lit(1)).alias("_rows"))
    return once.withColumns({c: F.from_json(c, dict(df.dtypes)[c]) for c in maps}).withColumn("_kept", F.lit(True))


def clean_customers(customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CL9: (clean, log); see ``mark_customers``."""
    marked = mark_customers(customers)
    return kept(marked), log_row("customers", marked)


def clean_subscriptions(subs: DataFrame, plans: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """CL10: (clean, log); see ``mark_subscriptions``."""
    marked = mark_subscriptions(subs, plans)
    return kept(marked), log_row("subscriptions", marked, revenue_missing_after_fill=F.count_if(
        F.col("_kept") & F.col("monthly_revenue").isNull()))


def clean_tickets(tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CL11: (clean, log); see ``mark_tickets``."""
    marked = mark_tickets(tickets)
    return kept(marked), log_row("support_tickets", marked)


def dedupe_rows(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """CL12: (distinct rows, log); see ``mark_rows``."""
    marked = mark_rows(df)
    return kept(marked), log_row(table, marked)


def _removed(before: Column, after: Column) -> list[Column]:
    return [(before - after).alias("rows_removed"),
            F.bround(F.when(before > 0, (before - after) / before * 100.0).otherwise(0.0), 2).alias("pct_removed")]


def log_row(table: str, marked: DataFrame, rows: Column | None = None, left: Column | None = None, **extra: Column) -> DataFrame:
    """CL13: one row per table: before, after, removed, % removed. ``rows`` and
    ``left`` are the sums that give before and after (by default over the marks)."""
    sums = marked.agg(F.coalesce(F.sum("_rows") if rows is None else rows, F.lit(0)).alias("rows_before"),
                      (F.count_if(F.col("_kept")) if left is None else F.coalesce(left, F.lit(0))).alias("rows_after"),
                      *[v.alias(k) for k, v in extra.items()])
    return sums.select(F.lit(table).alias("table"), "rows_before", "rows_after",
                       *_removed(F.col("rows_before"), F.col("rows_after")), *extra)


def cleaning_totals(log: DataFrame) -> DataFrame:
    """CL13: the sums over all tables of a cleaning log, as one row."""
    sums = log.agg(F.count(F.lit(1)).alias("tables"), F.sum("rows_before").alias("rows_before"), F.sum("rows_after").alias("rows_after"))
    return sums.select("tables", "rows_before", "rows_after", *_removed(F.col("rows_before"), F.col("rows_after")))
