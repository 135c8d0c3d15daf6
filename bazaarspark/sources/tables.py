"""Readers, and the shop's tables as views over the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# Each view is SQL that Spark and DuckDB read alike.
VIEWS: dict[str, tuple[list[str], str]] = {
    "products": (
        ["part"],
        """SELECT CAST(p_partkey AS STRING) AS product_code, p_name AS product_name, p_brand AS brand, p_type AS type,
                  concat('SKU-', CAST(p_partkey AS STRING)) AS sku, split_part(p_name, ' ', 2) AS category_level1, p_type AS category_level2,
                  CASE WHEN p_size % 5 = 0 THEN 'Disable' ELSE 'Enable' END AS last_status, CAST(p_size AS STRING) AS available_qty,
                  CAST(p_size AS STRING) AS size, CAST(NULL AS STRING) AS special_price,
                  CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 13 = 0 THEN concat(CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS STRING), ' T')
                       ELSE CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS STRING) END AS sum_of_price,
                  split_part(p_name, ' ', 1) AS color, CASE WHEN p_partkey % 4 = 0 THEN 'women' WHEN p_partkey % 4 = 1 THEN 'men' END AS gender
           FROM {part}""",
    ),
    "order_items": (
        ["lineitem", "orders", "part", "customer", "nation"],
        """SELECT CAST(o_custkey AS STRING) AS customer_id, CAST(o_orderkey AS STRING) AS order_id, CAST(l_partkey AS STRING) AS product_id,
                  CAST(l_suppkey AS STRING) AS seller_id, CAST(o_orderdate AS STRING) AS created_at,
                  CASE o_orderstatus WHEN 'F' THEN 'Complete' WHEN 'P' THEN 'canceled' ELSE 'processing' END AS status,
                  CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS STRING) END AS delivered_date, o_orderpriority AS method, n_name AS city,
                  CASE WHEN l_discount > 0.05 THEN 'DISC' END AS coupon_code, p_name AS order_items_name,
                  concat('SKU-', CAST(p_partkey AS STRING)) AS order_items_sku, p_brand AS brand_name, split_part(p_name, ' ', 2) AS category_level1,
                  p_type AS category_level2, CAST(CAST(l_quantity AS INT) AS STRING) AS ordered_qty,
                  concat(CASE WHEN l_returnflag = 'R' THEN '-' ELSE '' END, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING)) AS final_price,
                  CAST(l_linenumber AS BIGINT) AS line_number
           FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey JOIN {part} p ON l_partkey = p_partkey
                JOIN {customer} c ON o_custkey = c_custkey JOIN {nation} n ON c_nationkey = n_nationkey""",
    ),
    "users": (
        ["customer", "nation"],
        """SELECT CAST(c_custkey AS STRING) AS customer_code, c_mktsegment AS customer_group, n_name AS city, c_name AS customer_name,
                  CAST(NULL AS STRING) AS email, CAST(NULL AS STRING) AS phone, CAST(NULL AS STRING) AS personal_code
           FROM {customer} c JOIN {nation} n ON c_nationkey = n_nationkey""",
    ),
    "messages": (
        ["conversations"],
        """SELECT CAST(conv_id AS BIGINT) * 1000 + CAST(turn AS BIGINT) AS id, CAST(conv_id % 10 AS STRING) AS customer_id, role, text AS content
           FROM {conversations}""",
    ),
    "log_events": (
        ["events"],
        """SELECT event_id, ts, CAST(user_id AS STRING) AS user_id,
                  CASE event_type WHEN 'click' THEN 'request_completed' WHEN 'view' THEN 'product_search_completed' WHEN 'purchase' THEN 'llm_call'
                       WHEN 'signup' THEN 'feedback_recorded' WHEN 'error' THEN 'tool_execution' ELSE event_type END AS event,
                  CAST(value AS DOUBLE) AS latency_ms, CASE WHEN event_id % 10 = 0 THEN 500 ELSE 200 END AS status,
                  CASE event_id % 4 WHEN 0 THEN '/api/v1/chat' WHEN 1 THEN '/api/v1/feedback' WHEN 2 THEN '/api/v1/chat' ELSE '/health' END AS endpoint,
                  CASE WHEN event_id % 4 = 3 THEN 'GET' ELSE 'POST' END AS method,
                  CASE event_id % 3 WHEN 0 THEN 'search_products' WHEN 1 THEN 'get_order_summary' ELSE 'search_knowledge' END AS tool,
                  CASE event_id % 2 WHEN 0 THEN 'chat' ELSE 'rerank' END AS purpose, event_id % 17 = 0 AS timeout,
                  CAST(event_id % 900 AS BIGINT) AS input_tokens, CAST(event_id % 300 AS BIGINT) AS output_tokens,
                  event_id % 6 = 0 AS empty, event_id % 7 = 0 AS llm_fallback_triggered, event_id % 21 = 0 AS llm_failure,
                  CASE WHEN event_id % 3 = 0 THEN 'negative' ELSE 'positive' END AS rating
           FROM {events}""",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the shop over the given tables."""
    sources, sql = VIEWS[name]
    return spark.sql(sql, **{s: table(spark, sf_dir, s) for s in sources})


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores: a small file may hold millions of short rows, which Spark would read in a task or two. A number of
    partitions is given, as the adaptive planner would join partitions of so few bytes again."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that starts with the named views."""
    parts = ", ".join(f"{n} AS ({VIEWS[n][1].format(**{s: s for s in VIEWS[n][0]})})" for n in names)
    sql = sql.strip()
    if sql[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {parts}, {sql[14:]}"
    return f"WITH {parts}, {sql[4:]}" if sql[:4].upper() == "WITH" else f"WITH {parts} {sql}"


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All given tables and views by name. Scans are lazy: columns and filters of later steps reach them."""
    return {n: table(spark, sf_dir, n) for n in NAMES} | {n: view(spark, sf_dir, n) for n in VIEWS}


# Two query logs made of the catalog's own words: raw texts, and read queries of three kinds. Equal ones count once.
VIEWS["query_log"] = (
    ["part"],
    """SELECT p_partkey AS query_id, concat(
              CASE p_partkey % 4 WHEN 0 THEN 'محصولات ' WHEN 1 THEN 'نشون بده ' WHEN 2 THEN 'لطفا، ' ELSE '' END,
              CASE WHEN p_partkey % 2 = 0 THEN '' ELSE concat(CASE p_partkey % 11 WHEN 0 THEN 'شیائومی ' WHEN 1 THEN 'نایس پاپت ' WHEN 2 THEN 'سالوت ' WHEN 3 THEN 'دیفاکتو ' WHEN 4 THEN 'Note ' WHEN 5 THEN 'بدون برند مریدا ' WHEN 6 THEN 'از تریا نه ' ELSE '' END,
              CASE p_partkey % 9 WHEN 0 THEN 'رژ لب مایع ' WHEN 1 THEN 'کرم دست ' WHEN 2 THEN 'ماسک مو ' WHEN 3 THEN 'ضدآفتاب ' ELSE 'رنگ مو ' END,
              CASE p_partkey % 7 WHEN 0 THEN 'مشکی ' WHEN 1 THEN 'چرم ' WHEN 2 THEN 'زنانه ' ELSE '' END,
              CASE p_partkey % 13 WHEN 0 THEN 'زیر 300هزارتومان ' WHEN 1 THEN 'زیر ۲ میلیون ' WHEN 2 THEN 'بین 1 تا ۳ میلیون ' WHEN 3 THEN 'بالای ده هزار ' WHEN 4 THEN '250 ' WHEN 5 THEN 'بین دو هزار تا سه ' ELSE '' END,
              CASE p_partkey % 5 WHEN 0 THEN 'موجود ' WHEN 1 THEN 'ناموجود ' ELSE '' END) END, p_name, ' ', p_name) AS query
       FROM {part}""",
)
VIEWS["search_cases"] = (
    ["part"],
    """SELECT DISTINCT concat(CAST(p_partkey % 3 AS STRING), '|', CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE '' END, '|', p_name) AS query_id,
              p_name AS rank_query, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 = 1 THEN p_type END AS category,
              CAST(CASE WHEN p_partkey % 3 = 1 THEN 1200 END AS DOUBLE) AS price_max, CASE WHEN p_partkey % 3 = 2 THEN 'Brand#1' END AS excluded,
              CAST(p_partkey % 3 AS INT) AS kind
       FROM {part}""",
)

# Runs of two configurations over queries of a type and brand, and judgements of some products.
VIEWS["runs"] = (
    ["part"],
    """SELECT * FROM (
         SELECT 'a' AS config, concat(p_type, '|', p_brand) AS query_id, p_partkey AS doc_id, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM {part}
         UNION ALL
         SELECT 'b' AS config, concat(p_type, '|', p_brand) AS query_id, p_partkey AS doc_id, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_name, p_partkey) AS rank FROM {part}) r
       WHERE rank <= 20""",
)
VIEWS["qrels"] = (["part"], "SELECT concat(p_type, '|', p_brand) AS query_id, p_partkey AS doc_id, CAST(p_size % 4 AS DOUBLE) AS grade FROM {part} WHERE p_size % 5 < 3")

# Long runs, with few gold products far down.
VIEWS["deep_runs"] = (
    ["part"],
    """SELECT * FROM (
         SELECT 'a' AS config, concat(p_type, '|', CAST(p_size % 3 AS STRING)) AS query_id, p_partkey AS doc_id, row_number() OVER (PARTITION BY p_type, p_size % 3 ORDER BY p_retailprice DESC, p_partkey) AS rank FROM {part}
         UNION ALL
         SELECT 'b' AS config, concat(p_type, '|', CAST(p_size % 3 AS STRING)) AS query_id, p_partkey AS doc_id, row_number() OVER (PARTITION BY p_type, p_size % 3 ORDER BY p_name, p_partkey) AS rank FROM {part}) r
       WHERE rank <= 500""",
)
VIEWS["deep_qrels"] = (["part"], "SELECT concat(p_type, '|', CAST(p_size % 3 AS STRING)) AS query_id, p_partkey AS doc_id, CAST(CASE WHEN p_partkey % 97 = 0 THEN 3 ELSE 0 END AS DOUBLE) AS grade FROM {part} WHERE p_partkey % 13 < 9")
