"""Cart totals, offer pricing and the order rows they lead to.

Money is added up as exact decimals and rounded half up to cents.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import as_col, integer_request, is_text, lookup, null_if_empty

# Fixed values.
TAX_RATE = "0.21"
SHIPPING_FEE = "45.00"
DEFAULT_PRICE = 100.0
COST_SHARE = 0.60
TIER_DISCOUNT_RATES = {
    "ENTERPRISE_VIP": 0.15, "PLATINUM": 0.12, "GOLD": 0.10, "SILVER": 0.05,
    "BRONZE": 0.02, "NONE": 0.0,
}
SENTIMENT_BANDS = {
    "POSITIVE": (0.60, 0.98), "NEUTRAL": (-0.15, 0.35), "NEGATIVE": (-0.95, -0.40),
}
TIER_SEGMENTS = {
    "ENTERPRISE_VIP": "ENTERPRISE_VIP", "PLATINUM": "RETAIL_PRO", "GOLD": "RETAIL_PRO",
    "SILVER": "STANDARD_LOYALTY", "BRONZE": "STANDARD_LOYALTY", "NONE": "CASUAL_SHOPPER",
}
APP_ORDER_PREFIX = "ORD-26-MOB-"
COMPLAINT_RATING = 2
RECOVERY_MIN_PRIOR_ORDERS = 2
RECOVERY_MIN_RATING = 4
RECOVERED_READINGS = {
    "login_frequency_monthly": 14, "avg_session_duration_minutes": 10.0,
    "app_engagement_score": 0.68, "app_sessions_last_30d": 18,
    "cart_abandonment_count": 1, "abandoned_cart_value_90d": 300.00,
    "support_tickets_count": 1, "open_support_tickets_count": 0,
    "complaints_count": 0, "return_frequency": 1, "return_rate_percent": 4.0,
}

_CENTS = "decimal(18,2)"


def sentiment_band(rating: Column | str) -> Column:
    r = as_col(rating)
    return F.when(r >= 4, "POSITIVE").when(r == 3, "NEUTRAL").otherwise("NEGATIVE")


def sentiment_bounds(rating: Column | str) -> tuple[Column, Column]:
    """Lowest and highest sentiment score that goes with a rating."""
    band = sentiment_band(rating)
    low = lookup({k: v[0] for k, v in SENTIMENT_BANDS.items()}, band)
    high = lookup({k: v[1] for k, v in SENTIMENT_BANDS.items()}, band)
    return low, high


def complaint_flag(rating: Column | str) -> Column:
    return as_col(rating) <= COMPLAINT_RATING


def with_complaint_counters(orders: DataFrame, rating: str = "rating") -> DataFrame:
    """Flag complaints and raise the three support counters of those orders."""
    flag = F.coalesce(complaint_flag(rating), F.lit(False))
    extra = F.when(flag, 1).otherwise(0)
    counters = ["support_tickets_count", "open_support_tickets_count", "complaints_count"]
    return orders.withColumns(
        {"has_active_complaint": flag, **{c: F.col(c) + extra for c in counters}}
    )


def tier_discount_rate(tier: Column | str) -> Column:
    return lookup(TIER_DISCOUNT_RATES, as_col(tier), 0.0)


def segment_for_tier(tier: Column | str) -> Column:
    return lookup(TIER_SEGMENTS, as_col(tier), "CASUAL_SHOPPER")


def is_member(tier: Column | str) -> Column:
    return as_col(tier) != "NONE"


def return_frequency(return_rate: Column | str) -> Column:
    return F.floor(as_col(return_rate) / 4).cast("bigint")


def offer_percent(discount: Column | str, from_text: bool = False) -> Column:
    """Percent of an offer as an integer within 0..100; unreadable gives 0."""
    percent = integer_request(discount, from_text)
    return F.least(F.greatest(percent, F.lit(0)), F.lit(100))


def offer_pricing(offers: DataFrame) -> DataFrame:
    """What of an offer changes a price; a row without offer id prices at list."""
    applied = F.col("offer_id").isNotNull()
    percent = offer_percent("discount_percent", is_text(offers, "discount_percent"))
    return offers.withColumns(
        {
            "offer_applied": applied,
            "discount_percent": F.when(applied, percent).otherwise(F.lit(0)),
            "free_express_shipping": applied & F.coalesce("free_express_shipping", F.lit(False)),
            "promo_code": F.when(applied, F.col("promo_code")),
        }
    )


def priced_lines(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cart lines with the catalog's price and cost, or the stated fallbacks.

    A line's own name and category come before the catalog's.  The catalog is joined without a hint: its size decides the strategy, and a
    bestseller's lines are split by the adaptive skew join.
    """
    listed = catalog.select(
        "sku", F.col("name").alias("_name"), F.col("category").alias("_category"),
        F.col("unit_price").alias("_price"), F.col("cost").alias("_cost"),
    )
    price = F.coalesce("_price", "unit_price", F.lit(DEFAULT_PRICE))
    cost = F.coalesce(F.col("_cost"), F.col("_unit_price") * COST_SHARE)
    quantity = F.greatest(F.coalesce(F.col("quantity"), F.lit(1)), F.lit(1))

    def own(column: str) -> list[Column]:
        return [null_if_empty(column)] if column in items.columns else []

    return (
        items.join(listed, "sku", "left")
        .withColumn("_unit_price", price)
        .withColumn("_quantity", quantity)
        .select(
            *[c for c in items.columns if c not in ("sku", "unit_price", "quantity", "name", "category")],
            F.coalesce("sku", F.lit("SKU-CUSTOM")).alias("sku"),
            F.coalesce(*own("name"), "_name", F.lit("Industrial Component")).alias("name"),
            F.coalesce(*own("category"), "_category", F.lit("Hardware")).alias("category"),
            F.col("_quantity").alias("quantity"),
            F.col("_unit_price").alias("unit_price"),
            F.round(F.col("_quantity") * F.col("_unit_price"), 2).cast(_CENTS).alias("total_price"),
            F.round(F.col("_quantity") * cost, 2).cast(_CENTS).alias("total_cost"),
        )
    )


def money_columns(
    subtotal: Column, percent: Column, free_shipping: Column, total_cost: Column | None = None
) -> dict[str, Column]:
    """Tax, discount, shipping, grand total and margin of a subtotal."""
    tax = F.round(subtotal * F.lit(TAX_RATE).cast("decimal(3,2)"), 2).cast(_CENTS)
    discount = F.round(
        subtotal * percent.cast("decimal(3,0)") * F.lit("0.01").cast("decimal(3,2)"), 2
    ).cast(_CENTS)
    shipping = F.when(free_shipping, F.lit("0.00")).otherwise(F.lit(SHIPPING_FEE)).cast(_CENTS)
    grand = (subtotal - discount + tax + shipping).cast(_CENTS)
    columns = {
        "subtotal": subtotal, "tax_amount": tax, "discount_total": discount,
        "shipping_fee": shipping, "grand_total": grand,
    }
    if total_cost is not None:
        earned = (grand - total_cost - tax).cast("double")
        columns["profit_margin"] = F.round(
            earned / F.greatest(grand.cast("double"), F.lit(1.0)), 3
        )
    return {name: col.cast("double") for name, col in columns.items()}


def order_financials(
    items: DataFrame, catalog: DataFrame, offers: DataFrame, key: str = "cart_id"
) -> DataFrame:
    """Financials per cart.

    ``offers`` has at most one row per cart with ``offer_id``,
    ``discount_percent``, ``free_express_shipping`` and ``promo_code``.
    """
    totals = (
        priced_lines(items, catalog)
        .groupBy(key)
        .agg(
            F.sum("total_price").cast(_CENTS).alias("_subtotal"),
            F.sum("total_cost").cast(_CENTS).alias("_total_cost"),
            F.sum("quantity").alias("units"),
        )
    )
    priced = offer_pricing(totals.join(offers, key, "left"))
    money = money_columns(
        F.col("_subtotal"), F.col("discount_percent"), F.col("free_express_shipping"),
        F.col("_total_cost"),
    )
    return priced.select(
        key, "units", *[col.alias(name) for name, col in money.items()],
        F.col("_total_cost").cast("double").alias("total_cost"),
        "offer_applied", "offer_id", "promo_code", "discount_percent", "free_express_shipping",
    )


def merge_cart_lines(items: DataFrame, key: str = "cart_id") -> DataFrame:
    """One line per article: adding an article again adds its quantity."""
    return items.groupBy(key, "sku").agg(
        F.sum("quantity").alias("quantity"), F.max("unit_price").alias("unit_price")
    )


def cart_totals(items: DataFrame, offers: DataFrame, key: str = "cart_id") -> DataFrame:
    """Cart preview from the prices shown on the lines themselves."""
    merged = merge_cart_lines(items, key)
    totals = merged.groupBy(key).agg(
        F.count(F.lit(1)).alias("articles"),
        F.sum("quantity").alias("units"),
        F.sum(F.round(F.col("unit_price") * F.col("quantity"), 2).cast(_CENTS)).cast(_CENTS).alias("_subtotal"),
    )
    priced = offer_pricing(totals.join(offers, key, "left"))
    money = money_columns(
        F.coalesce("_subtotal", F.lit(0).cast(_CENTS)), F.col("discount_percent"),
        F.col("free_express_shipping"),
    )
    return priced.select(key, "articles", "units", *[c.alias(n) for n, c in money.items()])


def prior_app_orders(orders: DataFrame, prefix: str = APP_ORDER_PREFIX) -> DataFrame:
    """App orders each customer already has; customers without any count zero."""
    return orders.groupBy("customer_id").agg(
        F.count_if(F.col("order_id").startswith(prefix)).alias("prior_app_orders")
    )


def is_recovered(
    customer_id: Column | str, prior_orders: Column | str, rating: Column | str,
    recovering: Iterable[str],
) -> Column:
    return F.coalesce(
        as_col(customer_id).isin(list(recovering))
        & (as_col(prior_orders) >= RECOVERY_MIN_PRIOR_ORDERS)
        & (as_col(rating) >= RECOVERY_MIN_RATING),
        F.lit(False),
    )


def recovery_snapshot(orders: DataFrame, recovering: Iterable[str]) -> DataFrame:
    """Replace the behavioural readings of orders that show a recovery.

    Expects ``prior_app_orders`` and ``rating`` beside the readings.
    """
    back = is_recovered("customer_id", "prior_app_orders", "rating", recovering)
    readings = {
        name: F.when(back, F.lit(value).cast(orders.schema[name].dataType)).otherwise(F.col(name))
        for name, value in RECOVERED_READINGS.items()
        if name in orders.columns
    }
    return orders.withColumns({"recovered": back, **readings})


# What an order has where nothing else is given.
PAYMENT_METHOD, FEEDBACK_CHANNEL = "INVOICE_NET30", "MOBILE_APP"
WAREHOUSES = "WH-ROTTERDAM-1 WH-EEMSHAVEN-2 WH-EINDHOVEN-3 WH-FRANKFURT-1 WH-PARIS-2 WH-LONDON-1".split()
CARRIERS = "DHL_EXPRESS FEDEX_PRIORITY UPS_EXPEDITED POSTNL_CARGO".split()
ADDRESS = {"street_address": "Industrial Ave 1", "city": "Amsterdam", "province": "North Holland", "postal_code": "1016 BS",
           "country_code": "NL"}


def fraction(key: Column | str, label: str) -> Column:
    """A number in [0, 1) from a key; the same whenever it is asked for."""
    digest = F.md5(F.concat(as_col(key), F.lit(f":{label}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def picked(values: Iterable[str], key: Column | str, label: str) -> Column:
    """One of the values by a key."""
    values = list(values)
    place = F.floor(fraction(key, label) * len(values)).cast("int")
    return F.get(F.array(*[F.lit(v) for v in values]), place)


def price_orders(
    headers: DataFrame,
    items: DataFrame,
    catalog: DataFrame,
    offers: DataFrame,
    profiles: DataFrame,
    existing_orders: DataFrame,
    recovering: Iterable[str] = (),
    app_prefix: str = APP_ORDER_PREFIX,
) -> DataFrame:
    """Full order rows for submitted carts.

    ``headers`` is one row per order (order_id, customer_id, created_at, rating,
    complaint_reason, feedback_text, service_level, and where known payment_method,
    carrier_code, updated_at and the parts of the address); ``items`` and ``offers``
    are keyed by order_id; ``profiles`` holds each customer's identity, history,
    readings and defaults (default_warehouse, default_carrier, default_city and so on).  Lines stay a table of their own (``priced_lines``), so an
    order of any size is priced without being gathered into one row.
    """
    money = order_financials(items, catalog, offers, key="order_id")
    prior = prior_app_orders(existing_orders, app_prefix)
    base = (
        headers.join(money, "order_id")
        .join(profiles, "customer_id", "left")
        .join(prior, "customer_id", "left")
        .withColumn("prior_app_orders", F.coalesce("prior_app_orders", F.lit(0)))
    )
    shown = with_complaint_counters(recovery_snapshot(base, recovering))
    low, high = sentiment_bounds("rating")
    delivery_days = F.when(F.col("service_level") == "NEXT_DAY_AIR", 2).otherwise(4)
    readings = [c for c in RECOVERED_READINGS if c in base.columns]

    def given(*names: str, otherwise: Column | str | None = None) -> Column:
        """The first of these columns that is there and not NULL, else a default."""
        found = [F.col(n) for n in names if n in shown.columns]
        last = F.lit(otherwise) if otherwise is None or isinstance(otherwise, str) else otherwise
        return F.coalesce(*found, last) if found else last

    hub = given("default_warehouse", otherwise=picked(WAREHOUSES, "order_id", "hub"))
    return shown.select(
        "order_id", "customer_id", "customer_name", "customer_email", "customer_segment",
        F.lit("PROCESSING").alias("order_status"), F.lit("SETTLED").alias("payment_status"),
        given("payment_method", otherwise=PAYMENT_METHOD).alias("payment_method"),
        F.lit("EUR").alias("currency"),
        "subtotal", "tax_amount", "shipping_fee", "discount_total", "grand_total", "profit_margin",
        "offer_applied", "offer_id", "promo_code", "discount_percent", "free_express_shipping",
        "total_spend_90d",
        F.round(F.coalesce("lifetime_spend", F.lit(0.0)) + F.col("grand_total"), 2).alias("lifetime_spend"),
        *[given(c).alias(c) for c in ("avg_order_value", "purchase_frequency_monthly", "days_since_last_purchase")],
        (F.coalesce("orders_count_last_12m", F.lit(0)) + 1).alias("orders_count_last_12m"),
        *readings, "recovered", "loyalty_tier", given("is_loyalty_member").alias("is_loyalty_member"), "account_age_days",
        "rating", sentiment_band("rating").alias("sentiment_band"),
        low.alias("sentiment_low"), high.alias("sentiment_high"),
        # A score inside its band, the same whenever the order is priced again.
        F.round(low + (high - low) * fraction("order_id", "sentiment"), 2).alias("sentiment_score"), "has_active_complaint",
        F.when(F.col("has_active_complaint"), F.col("complaint_reason")).alias("primary_complaint_reason"),
        "feedback_text", F.lit(FEEDBACK_CHANNEL).alias("feedback_channel"), F.col("created_at").alias("feedback_at"),
        given("carrier_code", "default_carrier", otherwise=picked(CARRIERS, "order_id", "carrier")).alias("carrier_code"),
        "service_level", hub.alias("origin_hub"), F.lit(True).alias("require_signature"),
        *[given(c, f"default_{c}", otherwise=v).alias(f"shipping_{c}") for c, v in ADDRESS.items()],
        "created_at", given("updated_at", "created_at").alias("updated_at"),
        F.timestamp_add("DAY", delivery_days, F.col("created_at")).alias("estimated_delivery_at"),
    )


def allocated_lines(lines: DataFrame, profiles: DataFrame | None = None, key: str = "order_id") -> DataFrame:
    """Priced lines with the warehouse each is taken from.

    The line's own one, else the customer's (``profiles`` by customer_id, if the lines have
    one), else one of all, the same whenever the line is priced again.
    """
    rows, own = lines, []
    if "allocated_warehouse" in lines.columns:
        own.append(F.col("allocated_warehouse"))
    if profiles is not None:
        rows = lines.join(profiles.select("customer_id", "default_warehouse"), "customer_id", "left")
        own.append(F.col("default_warehouse"))
    chosen = F.coalesce(*own, picked(WAREHOUSES, F.concat_ws(":", key, "sku"), "line"))
    return rows.select(*[F.col(c) for c in lines.columns if c != "allocated_warehouse"], chosen.alias("allocated_warehouse"))


def financial_consistency(orders: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Orders whose grand total is off the sum of its parts by more than a cent."""
    expected = F.round(
        F.col("subtotal") - F.col("discount_total") + F.col("tax_amount") + F.col("shipping_fee"), 2
    )
    gap = F.round(F.col("grand_total") - expected, 4)
    return orders.withColumn("expected_total", expected).where(F.abs(gap) >= tolerance)
