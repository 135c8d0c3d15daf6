"""Order questions for all customers at once, over item-level orders.

Every operator takes DataFrames and is keyed by customer; ``customers`` and ``requests`` scope it. The rollup to orders is built
once and shared: latest order, status and history read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarspark.functions.columns import any_holds, clamp, like_pattern, top_n, total

#: Fields that a profile may show.
PROFILE = ["customer_code", "customer_group", "customer_type", "city", "customer_name", "gender", "mobile", "email", "created_date_persian", "first_purchase", "last_purchase", "success_ordered_cnt", "success_order_price", "item_cnt"]
COMPLETED = ("complete", "completed", "delivered")
CANCELLED = ("cancelled", "canceled")
SEARCHED = ["order_id", "order_items_name", "order_items_sku", "brand_name", "category_level1", "category_level2", "status", "city"]


def customer_profile(users: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Allowed fields only; unknown ones are left out and an empty choice means all. One row for each customer."""
    allowed = [f for f in PROFILE if f in users.columns]
    chosen = [f for f in (fields or []) if f in allowed] or allowed
    chosen = ["customer_code", *[f for f in chosen if f != "customer_code"]]
    return users.groupBy("customer_code").agg(*[F.min(f).alias(f) for f in chosen if f != "customer_code"]) if len(chosen) > 1 else users.select("customer_code").distinct()


def order_summary(items: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Orders, completed, cancelled, items and money of each customer. Customers without any get zeros."""
    status = F.lower("status")
    out = items.groupBy("customer_id").agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.count_distinct(F.when(status.isin(*COMPLETED), F.col("order_id"))).alias("completed_orders"),
        F.count_distinct(F.when(status.isin(*CANCELLED), F.col("order_id"))).alias("cancelled_orders"),
        F.count("*").alias("total_items"),
        total("final_price").alias("total_spent"),
    )
    if customers is not None:
        out = customers.select("customer_id").distinct().join(out, "customer_id", "left").fillna(0)
    return out


def order_rollup(items: DataFrame) -> DataFrame:
    """One row for each customer and order."""
    return items.groupBy("customer_id", "order_id").agg(
        F.min("created_at").alias("created_at"),
        F.max("status").alias("status"),
        F.max("delivered_date").alias("delivered_date"),
        F.max("method").alias("method"),
        F.max("city").alias("city"),
        F.count("*").alias("item_count"),
        total("final_price").alias("total_amount"),
    )


def latest_order(rollup: DataFrame) -> DataFrame:
    return top_n(rollup, ["customer_id"], [F.desc_nulls_last("created_at"), F.asc("order_id")], 1).drop("rank")


def order_status(rollup: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests are (request_id, customer_id, order_id)."""
    return requests.join(rollup, ["customer_id", "order_id"]).select("request_id", "customer_id", "order_id", "created_at", "status", "delivered_date", "method", "item_count", "total_amount")


def order_details(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Item rows of the requested orders, numbered by time."""
    rows = requests.join(items, ["customer_id", "order_id"])
    order = [F.asc_nulls_last("created_at"), F.asc("line_number"), F.asc("product_id"), F.asc("final_price")]
    return top_n(rows, ["request_id"], order, 2**31 - 1, "position")


def order_history(rollup: DataFrame, limit: int = 20) -> DataFrame:
    return top_n(rollup, ["customer_id"], [F.desc_nulls_last("created_at"), F.asc("order_id")], clamp(limit, 1, 50))


def search_orders(items: DataFrame, requests: DataFrame, limit: int = 20) -> DataFrame:
    """Orders with an item that matches a term, newest first. Counts and names cover matching items only.

    Requests are (request_id, customer_id, term). ``%`` and ``_`` in a term are wildcards.
    """
    asked = requests.withColumn("pattern", like_pattern(F.col("term")))
    rows = items.join(asked, "customer_id").where(any_holds(SEARCHED, "term", "pattern"))
    names = F.expr("listagg(DISTINCT order_items_name, ', ') WITHIN GROUP (ORDER BY order_items_name)")
    found = rows.groupBy("request_id", "customer_id", "order_id").agg(F.min("created_at").alias("created_at"), F.max("status").alias("status"), F.count("*").alias("item_count"), names.alias("products"), total("final_price").alias("total_amount"))
    return top_n(found, ["request_id"], [F.desc_nulls_last("created_at"), F.asc("order_id")], clamp(limit, 1, 50))


def purchased_products(items: DataFrame, limit: int = 50) -> DataFrame:
    order = [F.desc_nulls_last("created_at"), F.asc("order_id"), F.asc("line_number"), F.asc("product_id"), F.asc("final_price")]
    rows = items.select("customer_id", "order_id", "line_number", "created_at", "status", "product_id", "order_items_name", "order_items_sku", "brand_name", "ordered_qty", "final_price")
    return top_n(rows, ["customer_id"], order, clamp(limit, 1, 100))


def product_purchase_history(items: DataFrame, requests: DataFrame, limit: int = 20) -> DataFrame:
    """Products that match a term: orders, quantity, last purchase; newest first."""
    asked = requests.withColumn("pattern", like_pattern(F.col("term")))
    rows = items.join(asked, "customer_id").where(any_holds(["order_items_name", "order_items_sku", "product_id", "brand_name"], "term", "pattern"))
    keys = ["request_id", "customer_id", "order_items_name", "order_items_sku", "product_id", "brand_name"]
    found = rows.groupBy(*keys).agg(F.count_distinct("order_id").alias("order_count"), total("ordered_qty").alias("total_qty"), F.max("created_at").alias("last_purchased_at"))
    return top_n(found, ["request_id"], [F.desc_nulls_last("last_purchased_at"), F.asc("product_id")], clamp(limit, 1, 50))
