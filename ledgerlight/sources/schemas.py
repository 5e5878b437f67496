"""Explicit schemas of the input files (nothing is inferred at read time)."""

from __future__ import annotations

from pyspark.sql.types import StructType

MONEY = "decimal(18,2)"

CSV_SCHEMAS: dict[str, str] = {
    "plans": f"plan_id int, plan_name string, tier string, base_price {MONEY}, features_included string",
    "customers": ("customer_id bigint, company_name string, email string, email_domain string, phone string, "
                  "country string, created_at timestamp, updated_at timestamp"),
    "subscriptions": (f"subscription_id bigint, customer_id bigint, plan_id int, previous_plan_id int, "
                      f"status string, monthly_revenue {MONEY}, start_date date, end_date timestamp, "
                      f"downgrade_date timestamp, cancellation_date timestamp, created_at timestamp, "
                      f"updated_at timestamp"),
    "billing": (f"billing_id bigint, subscription_id bigint, customer_id bigint, invoice_date date, "
                f"amount {MONEY}, currency string, billing_period_start date, billing_period_end date, "
                f"payment_status string, created_at timestamp"),
    "support_tickets": ("ticket_id bigint, customer_id bigint, subscription_id bigint, title string, "
                        "description string, priority string, status string, created_at timestamp, "
                        "resolved_at timestamp, updated_at timestamp"),
    "team_members": ("team_member_id bigint, customer_id bigint, name string, email string, email_domain string, "
                     "role string, invited_date timestamp, created_at timestamp"),
    "feature_flags": ("flag_id bigint, customer_id bigint, subscription_id bigint, feature_name string, "
                      "is_enabled boolean, enabled_date timestamp, created_at timestamp"),
    # the document collections arrive as text and go through the canonicaliser
    "events": ("customer_id string, user_id string, event_type string, feature string, timestamp string, "
               "properties string"),
    "sessions": ("session_id string, customer_id string, user_id string, start_time string, end_time string, "
                 "duration string, device string, browser string, ip_address string"),
}

RELATIONAL = ("customers", "plans", "subscriptions", "billing", "support_tickets", "team_members", "feature_flags")
COLLECTIONS = ("events", "sessions")

# The primary keys of the relational tables.
PRIMARY_KEYS = {
    "customers": "customer_id",
    "plans": "plan_id",
    "subscriptions": "subscription_id",
    "billing": "billing_id",
    "support_tickets": "ticket_id",
    "team_members": "team_member_id",
    "feature_flags": "flag_id",
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(CSV_SCHEMAS[table])
