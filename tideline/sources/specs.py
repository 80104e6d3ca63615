"""Destination tables of the replicated documents, and where columns come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

STRING, INT64, FLOAT64, BOOL, TIMESTAMP, JSON = (
    "STRING", "INT64", "FLOAT64", "BOOL", "TIMESTAMP", "JSON",
)

SPARK_TYPES = {
    STRING: T.StringType(), INT64: T.LongType(), FLOAT64: T.DoubleType(),
    BOOL: T.BooleanType(), TIMESTAMP: T.TimestampType(), JSON: T.StringType(),
}

# Values a column takes from the change itself instead of from the document.
DOCUMENT_ID, OPERATION, CHANGE_TIME, RAW = "@id", "@operation", "@time", "@raw"

# Name, type and document path (or @derived value) per column.
_LEDGER = """
order_id STRING @id
operation_type STRING @operation
customer_id STRING customerId
customer_name STRING customerName
customer_email STRING customerEmail
customer_segment STRING customerSegment
order_status STRING orderStatus
payment_status STRING paymentStatus
payment_method STRING paymentMethod
currency STRING currency
grand_total FLOAT64 financials.grandTotal
subtotal FLOAT64 financials.subtotal
profit_margin FLOAT64 financials.profitMargin
change_timestamp TIMESTAMP @time
document_data JSON @raw
"""

_ORDERS = """
order_id STRING @id
customer_id STRING customerId
customer_name STRING customerName
customer_email STRING customerEmail
customer_segment STRING customerSegment
order_status STRING orderStatus
payment_status STRING paymentStatus
payment_method STRING paymentMethod
currency STRING currency
subtotal FLOAT64 financials.subtotal
tax_amount FLOAT64 financials.taxAmount
shipping_fee FLOAT64 financials.shippingFee
discount_total FLOAT64 financials.discountTotal
grand_total FLOAT64 financials.grandTotal
profit_margin FLOAT64 financials.profitMargin
total_spend_90d FLOAT64 transactionalMetrics.totalSpend90d
lifetime_spend FLOAT64 transactionalMetrics.lifetimeSpend
avg_order_value FLOAT64 transactionalMetrics.avgOrderValue
purchase_frequency_monthly FLOAT64 transactionalMetrics.purchaseFrequencyMonthly
days_since_last_purchase INT64 transactionalMetrics.daysSinceLastPurchase
orders_count_last_12m INT64 transactionalMetrics.ordersCountLast12m
login_frequency_monthly INT64 engagement.loginFrequencyMonthly
avg_session_duration_minutes FLOAT64 engagement.avgSessionDurationMinutes
app_engagement_score FLOAT64 engagement.appEngagementScore
app_sessions_last_30d INT64 engagement.appSessionsLast30d
cart_abandonment_count INT64 engagement.cartAbandonmentCount
abandoned_cart_value_90d FLOAT64 engagement.abandonedCartValue90d
support_tickets_count INT64 supportMetrics.supportTicketsCount
open_support_tickets_count INT64 supportMetrics.openSupportTicketsCount
complaints_count INT64 supportMetrics.complaintsCount
return_rate_percent FLOAT64 supportMetrics.returnRatePercent
sentiment_score FLOAT64 supportMetrics.sentimentScore
has_active_complaint BOOL supportMetrics.hasActiveComplaint
primary_complaint_reason STRING supportMetrics.primaryComplaintReason
feedback_rating INT64 customerFeedback.rating
feedback_channel STRING customerFeedback.channel
loyalty_tier STRING accountState.loyaltyTier
is_loyalty_member BOOL accountState.isLoyaltyMember
account_age_days INT64 accountState.accountAgeDays
shipping_city STRING shippingAddress.city
shipping_country_code STRING shippingAddress.countryCode
created_at TIMESTAMP createdAt
updated_at TIMESTAMP updatedAt
change_timestamp TIMESTAMP @time
"""

_CUSTOMERS = """
customer_id STRING @id
customer_name STRING customerName
customer_email STRING customerEmail
customer_segment STRING customerSegment
loyalty_tier STRING loyaltyTier
is_loyalty_member BOOL isLoyaltyMember
account_age_days INT64 accountAgeDays
lifetime_spend FLOAT64 lifetimeSpend
orders_count INT64 ordersCount
last_order_at TIMESTAMP lastOrderAt
days_since_last_purchase INT64 daysSinceLastPurchase
login_frequency_monthly INT64 engagement.loginFrequencyMonthly
avg_session_duration_minutes FLOAT64 engagement.avgSessionDurationMinutes
app_engagement_score FLOAT64 engagement.appEngagementScore
cart_abandonment_count INT64 engagement.cartAbandonmentCount
support_tickets_count INT64 supportMetrics.supportTicketsCount
open_support_tickets_count INT64 supportMetrics.openSupportTicketsCount
complaints_count INT64 supportMetrics.complaintsCount
return_rate_percent FLOAT64 supportMetrics.returnRatePercent
iam_principal STRING iamPrincipal
is_demo_persona BOOL isDemoPersona
updated_at TIMESTAMP updatedAt
change_timestamp TIMESTAMP @time
total_spend_90d FLOAT64 totalSpend90d
return_frequency INT64 supportMetrics.returnFrequency
sentiment_score FLOAT64 supportMetrics.sentimentScore
has_active_complaint BOOL supportMetrics.hasActiveComplaint
primary_complaint_reason STRING supportMetrics.primaryComplaintReason
recent_friction_event STRING supportMetrics.recentFrictionEvent
feedback_rating INT64 customerFeedback.rating
"""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    source: str

    @property
    def derived(self) -> bool:
        return self.source.startswith("@")


@dataclass(frozen=True)
class TableSpec:
    """One destination: its columns, its key (none for a ledger) and its layout."""

    name: str
    columns: tuple[ColumnSpec, ...]
    key: str | None = None
    partition_by: str | None = None
    cluster_by: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, SPARK_TYPES[c.kind]) for c in self.columns])


def _columns(text: str) -> tuple[ColumnSpec, ...]:
    return tuple(ColumnSpec(*line.split()) for line in text.strip().splitlines())


ORDERS_LEDGER = TableSpec(
    "retail_cdc", _columns(_LEDGER), partition_by="change_timestamp",
    cluster_by=("order_id", "customer_id", "order_status"),
)
ORDERS_CURRENT = TableSpec(
    "retail_current", _columns(_ORDERS), key="order_id", cluster_by=("customer_id", "order_status"),
)
CUSTOMERS_CURRENT = TableSpec(
    "customers_current", _columns(_CUSTOMERS), key="customer_id",
    cluster_by=("customer_segment", "loyalty_tier"),
)

# Which tables a document collection is replicated into.
ROUTES: dict[str, tuple[TableSpec, ...]] = {
    "retail": (ORDERS_LEDGER, ORDERS_CURRENT),
    "customers": (CUSTOMERS_CURRENT,),
}
