"""Registered queries on orders, customers and conversations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarspark.functions import columns
from bazaarspark.operators import conversations, orders
from bazaarspark.sources import ingest
from bazaarspark.sources.tables import table, view, with_views

MONEY = "sum(CASE WHEN regexp_full_match(coalesce({c}, ''), '[0-9]+(\\.[0-9]+)?') THEN CAST({c} AS DECIMAL(28, 10)) ELSE 0 END)::DOUBLE"
PRICE, QTY = MONEY.format(c="final_price"), MONEY.format(c="ordered_qty")
ROLLUP = f"""rollup AS (SELECT customer_id, order_id, min(created_at) AS created_at, max(status) AS status, max(delivered_date) AS delivered_date,
 max(method) AS method, max(city) AS city, count(*) AS item_count, {PRICE} AS total_amount FROM order_items GROUP BY ALL)"""


def _items(spark, d):
    return view(spark, d, "order_items")


def _rollup(spark, d):
    return orders.order_rollup(_items(spark, d))


def _order_requests(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderkey").cast("string").alias("order_id"))


ORDER_REQUESTS = "asked AS (SELECT o_orderkey AS request_id, CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS order_id FROM orders)"


def _term_requests(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").cast("string").alias("customer_id"), F.expr("element_at(array('steel', 'Brand#1', 'SKU-1_', 'tin%small', 'complete'), CAST(c_custkey % 5 + 1 AS INT))").alias("term"))


TERM_REQUESTS = "asked AS (SELECT c_custkey AS request_id, CAST(c_custkey AS VARCHAR) AS customer_id, ['steel', 'Brand#1', 'SKU-1_', 'tin%small', 'complete'][c_custkey % 5 + 1] AS term FROM customer)"
ANY = " OR ".join(f"coalesce({c} ILIKE '%' || term || '%', false)" for c in orders.SEARCHED)
NEWEST = "row_number() OVER (PARTITION BY customer_id ORDER BY id DESC)"
USABLE = "role IN ('user', 'assistant') AND length(trim(coalesce(content, ''))) > 0"


def _message_requests(spark, d):
    return view(spark, d, "messages").select("customer_id").distinct().select(F.col("customer_id").alias("request_id"), "customer_id", F.expr("CASE WHEN customer_id = '3' THEN '  ' WHEN CAST(customer_id AS INT) % 2 = 0 THEN 'the' ELSE 'er_n' END").alias("term"))


def _sheets(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("group"), F.col("c_custkey").alias("row_order"))
    return [c.where("code % 3 <> 0"), c.where("code % 2 = 0").withColumn("name", F.concat(F.lit("x-"), "name")), c.withColumn("name", F.concat(F.lit("y-"), "name"))]


SHEETS = {"code": "customer_code", "name": "customer_name", "group": "customer_group"}


def _turns(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user_message"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("assistant_message"))
    return t.withColumn("user_message", F.when(F.col("conv_id") % 7 == 0, F.lit("  ")).otherwise(F.col("user_message")))


def _feedback(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("message_id"), F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 7 == 0, "a;b").otherwise(F.concat(F.lit("c-"), "doc_id")).alias("conversation_id"), F.when(F.col("quality") == 1, "positive").when(F.col("doc_id") % 11 == 0, "odd").otherwise("negative").alias("rating"))


FEEDBACK = """feedback AS (SELECT CAST(doc_id AS VARCHAR) AS message_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN NULL ELSE 'c-' || doc_id END AS conversation_id,
 CASE WHEN quality = 1 THEN 'positive' WHEN doc_id % 11 = 0 THEN 'odd' ELSE 'negative' END AS rating FROM labels)"""

QUERIES = {
    "customer_profile": lambda s, d: orders.customer_profile(view(s, d, "users"), ["city", "customer_group", "personal_code", "unknown"]),
    "order_summary": lambda s, d: orders.order_summary(_items(s, d), view(s, d, "users").select(F.col("customer_code").alias("customer_id"))),
    "order_rollup": _rollup,
    "latest_order": lambda s, d: orders.latest_order(_rollup(s, d)),
    "order_status": lambda s, d: orders.order_status(_rollup(s, d), _order_requests(s, d)),
    "order_details": lambda s, d: orders.order_details(_items(s, d), _order_requests(s, d)).drop("seller_id"),
    "order_history": lambda s, d: orders.order_history(_rollup(s, d)),
    "search_orders": lambda s, d: orders.search_orders(_items(s, d), _term_requests(s, d)),
    "purchased_products": lambda s, d: orders.purchased_products(_items(s, d)),
    "product_purchase_history": lambda s, d: orders.product_purchase_history(_items(s, d), _term_requests(s, d)),
    "check_requests": lambda s, d: columns.check_requests(_message_requests(s, d).withColumn("limit", F.col("customer_id").cast("int") * 20), ["term"], {"limit": (1, 50)}),
    "result_payload": lambda s, d: columns.result_payload(orders.order_history(_rollup(s, d), 3).select("customer_id", "rank", "order_id", "status", "delivered_date"), ["customer_id"], ["rank"]),
    "recent_messages": lambda s, d: conversations.recent_messages(view(s, d, "messages")),
    "search_messages": lambda s, d: conversations.search_messages(view(s, d, "messages"), _message_requests(s, d)),
    "history_context": lambda s, d: conversations.history_context(view(s, d, "messages")),
    "append_message": lambda s, d: conversations.turns_to_messages(_turns(s, d)),
    "append_feedback": lambda s, d: conversations.clean_feedback(_feedback(s, d)),
    "feedback_counts": lambda s, d: conversations.feedback_counts(conversations.clean_feedback(_feedback(s, d))),
    "import_users": lambda s, d: ingest.import_users(_sheets(s, d), SHEETS),
    "import_audit": lambda s, d: ingest.import_audit(_sheets(s, d), ingest.import_users(_sheets(s, d), SHEETS)),
    "lookup_by_codes": lambda s, d: ingest.lookup_by_codes(table(s, d, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber"), F.when(F.col("l_partkey") % 9 == 0, "none").otherwise(F.col("l_partkey").cast("string")).alias("product_code")), view(s, d, "products").select("product_code", "product_name", "brand")),
    "parse_labels": lambda s, d: ingest.parse_labels(table(s, d, "labels").select("doc_id", F.format_string("%d, -%d;x%d  %d", F.col("doc_id"), F.col("doc_id"), F.col("doc_id"), F.col("quality")).alias("ids")), "ids"),
}

SHEET_SQL = """sheets AS (SELECT 0 AS sheet, c_custkey AS r, CAST(c_custkey AS VARCHAR) AS customer_code, c_name AS customer_name, c_mktsegment AS customer_group FROM customer WHERE c_custkey % 3 <> 0
 UNION ALL SELECT 1, c_custkey, CAST(c_custkey AS VARCHAR), 'x-' || c_name, c_mktsegment FROM customer WHERE c_custkey % 2 = 0
 UNION ALL SELECT 2, c_custkey, CAST(c_custkey AS VARCHAR), 'y-' || c_name, c_mktsegment FROM customer),
 kept AS (SELECT customer_code, customer_name, customer_group FROM sheets QUALIFY row_number() OVER (PARTITION BY customer_code ORDER BY sheet, r) = 1)"""

MESSAGE_REQUESTS = """asked AS (SELECT DISTINCT customer_id AS request_id, customer_id, CASE WHEN customer_id = '3' THEN '  ' WHEN CAST(customer_id AS INT) % 2 = 0 THEN 'the' ELSE 'er_n' END AS term FROM messages)"""

ORACLES = {
    "customer_profile": with_views("SELECT customer_code, city, customer_group FROM users", "users"),
    "result_payload": with_views(
        f"""WITH {ROLLUP}, h AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC NULLS LAST, order_id) AS rank FROM rollup QUALIFY rank <= 3)
        SELECT customer_id, '{{"found":true,"results":[' || string_agg('{{"rank":' || rank || ',"order_id":"' || order_id || '","status":"' || status || '"' || CASE WHEN delivered_date IS NOT NULL THEN ',"delivered_date":"' || delivered_date || '"' ELSE '' END || '}}', ',' ORDER BY rank) || ']}}' AS payload
        FROM h GROUP BY customer_id""",
        "order_items",
    ),
    "order_summary": with_views(
        f"""WITH s AS (SELECT customer_id, count(DISTINCT order_id) AS a, count(DISTINCT order_id) FILTER (lower(status) IN ('complete', 'completed', 'delivered')) AS b,
        count(DISTINCT order_id) FILTER (lower(status) IN ('cancelled', 'canceled')) AS c, count(*) AS n, {PRICE} AS m FROM order_items GROUP BY customer_id)
        SELECT u.customer_code AS customer_id, coalesce(a, 0) AS total_orders, coalesce(b, 0) AS completed_orders, coalesce(c, 0) AS cancelled_orders, coalesce(n, 0) AS total_items, coalesce(m, 0) AS total_spent
        FROM users u LEFT JOIN s ON s.customer_id = u.customer_code""",
        "order_items",
        "users",
    ),
    "order_rollup": with_views(f"WITH {ROLLUP} SELECT * FROM rollup", "order_items"),
    "latest_order": with_views(f"WITH {ROLLUP} SELECT * FROM rollup QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC NULLS LAST, order_id) = 1", "order_items"),
    "order_status": with_views(f"WITH {ROLLUP}, {ORDER_REQUESTS} SELECT request_id, customer_id, order_id, created_at, status, delivered_date, method, item_count, total_amount FROM asked JOIN rollup USING (customer_id, order_id)", "order_items"),
    "order_details": with_views(
        f"""WITH {ORDER_REQUESTS} SELECT request_id, i.* EXCLUDE (seller_id), row_number() OVER (PARTITION BY request_id ORDER BY created_at NULLS LAST, line_number, product_id, final_price) AS position
        FROM asked JOIN order_items i USING (customer_id, order_id)""",
        "order_items",
    ),
    "order_history": with_views(f"WITH {ROLLUP} SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC NULLS LAST, order_id) AS rank FROM rollup QUALIFY rank <= 20", "order_items"),
    "search_orders": with_views(
        f"""WITH {TERM_REQUESTS}, f AS (SELECT request_id, customer_id, order_id, min(created_at) AS created_at, max(status) AS status, count(*) AS item_count,
        string_agg(DISTINCT order_items_name, ', ' ORDER BY order_items_name) AS products, {PRICE} AS total_amount FROM asked JOIN order_items USING (customer_id) WHERE {ANY} GROUP BY 1, 2, 3)
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC NULLS LAST, order_id) AS rank FROM f QUALIFY rank <= 20""",
        "order_items",
    ),
    "purchased_products": with_views(
        """SELECT customer_id, order_id, line_number, created_at, status, product_id, order_items_name, order_items_sku, brand_name, ordered_qty, final_price,
        row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC NULLS LAST, order_id, line_number, product_id, final_price) AS rank FROM order_items QUALIFY rank <= 50""",
        "order_items",
    ),
    "product_purchase_history": with_views(
        f"""WITH {TERM_REQUESTS}, f AS (SELECT request_id, customer_id, order_items_name, order_items_sku, product_id, brand_name, count(DISTINCT order_id) AS order_count, {QTY} AS total_qty, max(created_at) AS last_purchased_at
        FROM asked JOIN order_items USING (customer_id) WHERE order_items_name ILIKE '%' || term || '%' OR order_items_sku ILIKE '%' || term || '%' OR product_id ILIKE '%' || term || '%' OR brand_name ILIKE '%' || term || '%' GROUP BY 1, 2, 3, 4, 5, 6)
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY last_purchased_at DESC NULLS LAST, product_id) AS rank FROM f QUALIFY rank <= 20""",
        "order_items",
    ),
    "check_requests": with_views(f"WITH {MESSAGE_REQUESTS} SELECT request_id, customer_id, term, CASE WHEN trim(term) = '' THEN 'blank_term' ELSE 'ok' END AS status, least(greatest(CAST(customer_id AS INT) * 20, 1), 50) AS \"limit\" FROM asked", "messages"),
    "recent_messages": with_views(f"WITH m AS (SELECT *, {NEWEST} AS r FROM messages) SELECT customer_id, id, role, content FROM m WHERE r <= 10 AND {USABLE}", "messages"),
    "search_messages": with_views(
        f"""WITH {MESSAGE_REQUESTS}, m AS (SELECT request_id, m.*, row_number() OVER (PARTITION BY request_id ORDER BY id DESC) AS r FROM messages m JOIN asked USING (customer_id) WHERE trim(term) <> '' AND content ILIKE '%' || trim(term) || '%')
        SELECT request_id, customer_id, id, role, content FROM m WHERE r <= 10 AND {USABLE}""",
        "messages",
    ),
    "history_context": with_views(
        f"""WITH m AS (SELECT *, {NEWEST} AS r FROM messages) SELECT customer_id, count(*) AS n_turns,
        string_agg((CASE WHEN role = 'user' THEN 'user' ELSE 'model' END) || ': ' || substr(trim(content, ' '), 1, 2000), chr(10) ORDER BY id) AS context FROM m WHERE r <= 8 AND {USABLE} GROUP BY customer_id""",
        "messages",
    ),
    "append_message": """WITH t AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN '  ' ELSE max(text) FILTER (role = 'user') END AS u, max(text) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
        m AS (SELECT conv_id, 'user' AS role, substr(trim(u, ' '), 1, 4000) AS content FROM t UNION ALL SELECT conv_id, 'assistant', substr(trim(a, ' '), 1, 4000) FROM t) SELECT * FROM m WHERE length(content) > 0""",
    "append_feedback": f"WITH {FEEDBACK} SELECT * FROM feedback WHERE rating <> 'odd'",
    "feedback_counts": f"WITH {FEEDBACK} SELECT rating, count(*) AS n FROM feedback WHERE rating <> 'odd' GROUP BY rating",
    "import_users": f"WITH {SHEET_SQL} SELECT * FROM kept",
    "import_audit": f"WITH {SHEET_SQL} SELECT (SELECT count(*) FROM sheets) AS rows_read, (SELECT count(*) FROM kept) AS rows_kept, (SELECT count(*) FROM sheets) - (SELECT count(*) FROM kept) AS rows_removed",
    "lookup_by_codes": with_views("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN 'none' ELSE CAST(l_partkey AS VARCHAR) END AS product_code, product_name, brand FROM lineitem LEFT JOIN products ON product_code = CASE WHEN l_partkey % 9 = 0 THEN 'none' ELSE CAST(l_partkey AS VARCHAR) END", "products"),
    "parse_labels": "SELECT doc_id, [CAST(doc_id AS BIGINT), CAST(-doc_id AS BIGINT), CAST(quality AS BIGINT)] AS ids FROM labels",
}
