"""Job inputs built from the test tables.

Each entry is one SQL text that both Spark and DuckDB run unchanged; ``{table}`` marks a base table.
``frame`` runs it in Spark, ``cte`` gives the text for an
oracle query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import time_slice
from .operators.ordered import ordered
from .sources import load

SQL = {
    "b_invoice_line": """
        SELECT o.o_custkey AS customer_id, l.l_orderkey AS subscription_id, l.l_linenumber AS line_no,
          p.p_type AS product_group, p.p_partkey AS product_id, l.l_suppkey AS supplier_id,
          CAST(o.o_orderdate AS DATE) AS start_dt,
          CAST(CAST(o.o_orderdate AS DATE) + INTERVAL '12' MONTH AS DATE) AS end_dt,
          CAST(p.p_size % 2 AS INT) = 0 AS monthly_payment,
          CAST(round(l.l_extendedprice * 100) AS BIGINT) AS net_cents,
          CAST(l.l_discount AS DECIMAL(10,2)) AS discount_pct, l.l_returnflag = 'R' AS full_refund,
          CASE WHEN o.o_orderstatus = 'P' THEN 'voided' ELSE 'paid' END AS invoice_status,
          CAST(l.l_quantity AS INT) AS quantity
        FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey""",
    # the reporting shape: one line with gross and refunded recurring revenue
    "b_line": """
        SELECT o.o_custkey AS customer_id, l.l_orderkey AS invoice_id, l.l_orderkey AS subscription_id,
          p.p_type AS product_group, l.l_partkey AS product_id,
          CASE WHEN o.o_orderstatus = 'P' THEN 'voided' ELSE 'paid' END AS invoice_status,
          CAST(o.o_orderdate AS DATE) AS start_dt,
          CAST(CAST(o.o_orderdate AS DATE) + INTERVAL '12' MONTH AS DATE) AS end_dt,
          l.l_returnflag = 'R' AS full_refund,
          CAST(l.l_extendedprice AS DECIMAL(12,2)) AS mrr_eur,
          CAST(CASE WHEN l.l_returnflag = 'A' THEN 10 ELSE 0 END AS DECIMAL(12,2)) AS refund_mrr_eur,
          CAST(l.l_quantity AS INT) AS item_quantity,
          CAST(CASE WHEN l.l_returnflag = 'A' THEN 1 ELSE 0 END AS INT) AS refund_item_quantity
        FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "b_customer": """
        SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, n.n_name AS country,
          c.c_mktsegment <> 'HOUSEHOLD' AS is_fleet,
          CASE WHEN c.c_custkey % 3 = 0 THEN 'CB' ELSE 'SH' END AS system,
          CASE WHEN c.c_custkey % 7 = 0 THEN 'cancelled' WHEN c.c_custkey % 11 = 0 THEN 'non_renewing'
               WHEN c.c_custkey % 13 = 0 THEN 'future' ELSE 'active' END AS customer_status,
          CAST(c.c_custkey % 40 AS INT) AS domain_id
        FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey""",
    "b_reading": """
        SELECT user_id AS car_id, ts AS reading_ts, CAST(round(value * 1000) AS BIGINT) AS odometer_km,
          event_id AS reading_id
        FROM {events} WHERE event_type = 'signup'""",
    "b_trip": """
        SELECT event_id AS trip_id, user_id AS car_id, ts AS trip_start_ts,
          ts + (event_id % 20 + 4) * INTERVAL '1' MINUTE AS trip_end_ts,
          CAST(round(value * 1000) AS BIGINT) AS distance_m
        FROM {events} WHERE event_type = 'purchase'""",
    # versions of a name in time order; Spark numbers them in time slices (``versions``)
    "b_version": """
        SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_nr,
          lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts
        FROM {events} WHERE event_type = 'view'""",
    "b_scd2": """
        SELECT domain_key, domain_name, version_nr, valid_from_ts, valid_to_ts, is_last_version FROM (
          WITH k AS (SELECT event_id AS domain_key, user_id AS domain_name, CAST(version_nr AS INT) AS version_nr,
              ts AS valid_from_ts,
              coalesce(next_ts + (event_id % 3 - 1) * INTERVAL '1' HOUR, CAST('2999-12-31 00:00:00' AS {ntz})) AS valid_to_ts,
              TRUE AS is_last_version FROM {b_version} v)
          SELECT * FROM k
          UNION ALL
          SELECT domain_key + 1000000, domain_name, version_nr, valid_from_ts, valid_to_ts, is_last_version
          FROM k WHERE domain_key % 7 = 0) s""",
    "b_user": """
        SELECT user_id, min(ts) AS created_ts, min(CASE WHEN event_type = 'click' THEN ts END) AS activated_ts,
          CASE WHEN user_id % 10 = 0 THEN max(ts) END AS deleted_ts, CAST(user_id % 20 AS INT) AS domain_id
        FROM {events} GROUP BY user_id""",
    "b_report": """
        SELECT o.o_custkey AS customer_id, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS reporting_month,
          o.o_orderpriority AS product_group,
          CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS mrr_eur, CAST(count(*) AS BIGINT) AS licenses
        FROM {orders} o
        GROUP BY o.o_custkey, CAST(date_trunc('month', o.o_orderdate) AS DATE), o.o_orderpriority""",
    "b_contract": """
        SELECT o_orderkey AS contract_id, o_custkey AS customer_id,
          CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'canceled' ELSE 'terminated' END AS status,
          CASE WHEN o_orderpriority = '1-URGENT' THEN 'track-3_years-yearly'
               WHEN o_orderpriority = '2-HIGH' THEN 'track-3_years-monthly'
               WHEN o_orderpriority = '3-MEDIUM' THEN 'office-monthly'
               WHEN o_orderpriority = '5-LOW' THEN 'hardware-x' ELSE 'office-yearly' END AS plan_id,
          CAST(o_orderdate AS DATE) AS started_dt,
          CAST(CAST(o_orderdate AS DATE) + INTERVAL '12' MONTH AS DATE) AS period_end_dt,
          CASE WHEN o_orderkey % 4 = 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL '40' DAY AS DATE) END AS canceled_dt,
          CAST(o_orderkey % 3 AS INT) AS quantity
        FROM {orders}""",
    # flat item rows of a contract; Spark folds them to JSON in contract_items
    "b_item": """
        SELECT l_orderkey AS contract_id,
          CASE WHEN l_partkey % 50 = 0 THEN 'fake' ELSE CAST(l_partkey AS {text}) END AS product_id,
          CAST(l_quantity AS INT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount
        FROM {lineitem}""",
    "b_product": """
        SELECT CAST(p_partkey AS {text}) AS product_id, p_partkey AS product_key, p_name AS product_name,
          p_type AS product_family, CAST(p_size % 2 AS INT) = 0 AS monthly_payment,
          p_size % 5 <> 0 AS is_recurring, p_size % 7 = 0 AS is_subsequent_recurring,
          p_size % 3 = 0 AS counts_device, p_size % 10 <> 0 AS counts_revenue,
          concat('plan-', CAST(p_size AS {text}), CASE WHEN p_size % 2 = 0 THEN '-monthly' ELSE '-yearly' END) AS plan_id,
          CAST(p_size AS INT) AS plan_nr
        FROM {part}""",
}

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def versions(events: DataFrame) -> DataFrame:
    """``b_version`` without a window over all rows of a name."""
    rows = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return ordered(rows, ["user_id"], ["ts", "event_id"], time_slice(F.col("ts")), lead={"next_ts": "ts"}, position="version_nr")


def frame(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The binding as a DataFrame."""
    text = SQL[name]
    used = {t: load(spark, root, t) for t in BASE_TABLES if "{" + t + "}" in text}
    if "{b_version}" in text:
        used["b_version"] = versions(load(spark, root, "events"))
    text = text.replace("{ntz}", "TIMESTAMP_NTZ").replace("{text}", "STRING")
    return spark.sql(text, **used)


def cte(*names: str) -> str:
    """``WITH`` list of the bindings for DuckDB (without the keyword)."""
    parts = []
    for name in names:
        text = SQL[name].replace("{b_version}", f"({SQL['b_version']})").replace("{ntz}", "TIMESTAMP").replace("{text}", "VARCHAR")
        parts.append(f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', text)})")
    return ", ".join(parts)


def contract_items(spark: SparkSession, root: str, column: str = "items") -> DataFrame:
    """Contracts with their items folded to a JSON array, as a shop stores them."""
    price = F.struct(F.struct(F.col("amount")).alias("net"))
    item = F.struct("product_id", "quantity", price.alias("price"), price.alias("total_provisioned_price"))
    items = frame(spark, root, "b_item")
    # spread the rows first: folding them map-side would not shrink them
    return items.repartition("contract_id").groupBy("contract_id").agg(F.to_json(F.collect_list(item)).alias(column))
