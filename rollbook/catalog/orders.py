"""Order and contract jobs on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import checks, orders
from .base import register
from .constructs import AS_OF
from .revenue import rdiv

# Discounts per contract: a percentage, an amount in cents, or none.
PERCENT, AMOUNT = "contract_id % 3 = 0", "contract_id % 3 = 1"


def discount_json():
    key = F.col("contract_id")
    percent = F.to_json(F.struct(F.lit("percentage").alias("type"), F.lit(0.15).alias("value")))
    amount = F.to_json(F.struct(F.lit("amount").alias("type"), F.struct((key % 50 + 100).alias("amount"), F.lit("EUR").alias("currency")).alias("value")))
    return F.when(key % 3 == 0, percent).when(key % 3 == 1, amount)


def contracts(t):
    """Contracts with JSON items and discount."""
    return t.b_contract.join(t.b_contract_items, "contract_id", "left").withColumns({
        "discount": discount_json(), "domain": F.concat(F.lit("Dom"), F.col("customer_id").cast("string"), F.lit(".")),
    })


def products(t):
    """Products with the flags of orders; some flags are not known."""
    nr = F.col("plan_nr")
    return t.b_product.withColumns({
        "counts_sold": F.when(nr % 11 != 5, nr % 4 != 0), "sales_counts": F.when(nr % 13 != 7, nr % 6 != 0), "changes_to_onetime": F.when(nr % 17 != 3, nr == 12),
        "is_subsequent_recurring": F.when(nr % 10 != 9, F.col("is_subsequent_recurring")),
    })


PRODUCT_SQL = """prod AS (SELECT * REPLACE (CASE WHEN plan_nr % 10 <> 9 THEN is_subsequent_recurring END AS is_subsequent_recurring),
    CASE WHEN plan_nr % 11 <> 5 THEN plan_nr % 4 <> 0 END AS counts_sold, CASE WHEN plan_nr % 13 <> 7 THEN plan_nr % 6 <> 0 END AS sales_counts,
    CASE WHEN plan_nr % 17 <> 3 THEN plan_nr = 12 END AS changes_to_onetime FROM b_product)"""
IMPORTER = "importer"
DISCOUNT_SQL = f"CASE WHEN {PERCENT} THEN 0.15 WHEN {AMOUNT} THEN contract_id % 50 + 100 END"


@register(
    "q_enrich_orders",
    """SELECT o.contract_id AS order_id, o.contract_id, 'dom' || o.customer_id AS domain_name,
    CASE WHEN o.contract_id % 11 = 0 THEN 'paid' WHEN o.contract_id % 11 = 1 AND o.contract_id % 2 = 0 THEN 'paid' WHEN o.contract_id % 11 = 1 THEN 'open'
      WHEN p.payment_status = 'authorised' THEN 'paid' WHEN o.contract_id % 6 <> 0 THEN 'open' ELSE 'no_invoice' END AS invoice_status,
    CASE WHEN o.contract_id % 3 = 0 THEN 0.15 END AS discount_percentage, CASE WHEN o.contract_id % 3 = 1 THEN o.contract_id % 50 + 100 END AS discount_cents,
    CASE WHEN o.contract_id % 3 = 1 THEN 'EUR' END AS discount_currency, o.plan_id AS coupon_code, i.cable_quantity, i.device_quantity, r.refunds IS NOT NULL AS has_refund,
    coalesce(CASE WHEN o.contract_id % 11 > 1 THEN r.refund_cents = CASE WHEN o.contract_id % 6 <> 0 THEN i.net_cents END ELSE o.contract_id % 11 = 1 AND o.contract_id % 4 = 0 END, FALSE) AS has_full_refund,
    coalesce(o.contract_id % 11 = 1 AND o.contract_id % 2 = 0 AND o.customer_id % 3 = 0, FALSE) OR (o.contract_id % 11 <> 1 AND coalesce(i.has_sellable, FALSE) AND coalesce(y.payable, TRUE)) AS is_sold,
    CASE WHEN o.contract_id % 11 = 1 THEN CAST((2 * (o.customer_id * 119 + 50) * 100 + 119) // 238 AS DOUBLE) / 100 ELSE CAST(o.customer_id * 7 AS DOUBLE) / 100 END AS net_invoice_amount,
    o.contract_id % 11 < 2 AS is_legacy_customer, o.contract_id % 7 = 0 AND o.contract_id % 6 <> 0 AS was_draft,
    CASE WHEN o.contract_id % 7 = 0 THEN 'importer' WHEN o.contract_id % 7 > 1 THEN 'shop' END AS creator, CASE WHEN o.contract_id % 2 = 1 THEN 'staff' END AS modifier,
    o.started_dt AS created_ts, o.period_end_dt AS modified_ts,
    coalesce(i.recurring_quantity > 0, FALSE) AS is_recurring, coalesce(i.top_is_subsequent, FALSE) AS is_subsequent_recurring, coalesce(i.changed, FALSE) AS changed_to_onetime,
    o.contract_id % 5 <> 0 AS is_cohort
    FROM b_contract o
    LEFT JOIN (SELECT i.contract_id, sum(amount) AS net_cents, CAST(sum(quantity) FILTER (WHERE i.product_id IN ('7', '8')) AS BIGINT) AS cable_quantity, CAST(sum(quantity) FILTER (WHERE counts_device) AS BIGINT) AS device_quantity,
        sum(quantity) FILTER (WHERE counts_device AND is_subsequent_recurring IS FALSE AND changes_to_onetime IS FALSE AND is_recurring AND counts_revenue) AS recurring_quantity,
        bool_or(coalesce(counts_device AND counts_revenue AND counts_sold AND sales_counts, FALSE)) AS has_sellable, bool_or(coalesce(changes_to_onetime, FALSE)) AS changed,
        bool_or(coalesce(counts_device AND is_subsequent_recurring, FALSE)) AS top_is_subsequent
      FROM b_item i LEFT JOIN prod p ON p.product_id = i.product_id GROUP BY i.contract_id) i ON i.contract_id = o.contract_id
    LEFT JOIN (SELECT contract_id, min(status) AS payment_status FROM pay WHERE refund_id IS NULL GROUP BY 1) p ON p.contract_id = o.contract_id AND o.contract_id % 6 <> 0
    LEFT JOIN (SELECT contract_id, bool_or(coalesce(method IN ('sepa', 'card', 'paypal') AND status = 'authorised' OR method = 'invoice' OR method IS NULL, FALSE)) AS payable FROM pay GROUP BY 1) y ON y.contract_id = o.contract_id
    LEFT JOIN (SELECT l_orderkey AS contract_id, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS refund_cents, count(*) AS refunds FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON r.contract_id = o.contract_id
    WHERE o.status <> 'canceled'""",
    uses="b_contract b_item b_product",
    extra=PRODUCT_SQL + """, pay AS (SELECT CASE WHEN l_linenumber < 4 THEN l_orderkey END AS contract_id, CASE WHEN l_linestatus = 'F' THEN 'authorised' ELSE 'cancelled' END AS status, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS refund_id,
      CASE l_suppkey % 5 WHEN 0 THEN 'sepa' WHEN 1 THEN 'card' WHEN 2 THEN 'invoice' WHEN 3 THEN 'voucher' END AS method FROM lineitem)""",
    money="discount_percentage net_invoice_amount",
    dates="created_ts modified_ts",
)
def enrich_orders(t):
    key, gross = F.col("contract_id"), F.col("customer_id") * 119 + 50
    apart = F.when(key % 6 == 0, -key - 1).otherwise(key)  # invoices of no order
    placed = contracts(t).select(
        key.alias("order_id"), "contract_id", "domain", F.when(F.col("status") != "canceled", "placed").otherwise("draft").alias("status"),
        F.when(key % 11 == 0, "7700").when(key % 11 == 1, "1200").alias("legacy_id"),
        F.when((key % 11 == 1) & (key % 4 == 0), "closed").when((key % 11 == 1) & (key % 2 == 0), "complete").when(key % 11 == 1, "pending").alias("legacy_status"),
        F.when(key % 11 == 1, F.when(F.col("customer_id") % 3 == 0, "14, 15").otherwise("3")).alias("legacy_product"),
        F.when(key % 11 == 1, F.format_string("%d.%02d €", F.floor(gross / 100), gross % 100)).alias("legacy_gross"),
        (F.col("customer_id") * 7).alias("total_net_cents"), F.col("plan_id").alias("coupon_code"), "discount", "items",
        F.when(key % 7 == 0, IMPORTER).when(key % 7 > 1, "shop").alias("creator"), F.when(key % 2 == 1, "staff").alias("modifier"),
        F.col("started_dt").alias("created_ts"), F.col("period_end_dt").alias("modified_ts"),
    )
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    lines = t.lineitem.select(F.col("l_orderkey").alias("order_id"), cents.alias("net_cents"), "l_returnflag")
    invoices = (
        t.b_item.groupBy(apart.alias("order_id")).agg(F.sum("amount").alias("net_cents"))
        .join(placed.select(apart.alias("order_id")), "order_id", "right").withColumn("invoice_id", F.col("order_id"))
    )
    method = F.expr("CASE l_suppkey % 5 WHEN 0 THEN 'sepa' WHEN 1 THEN 'card' WHEN 2 THEN 'invoice' WHEN 3 THEN 'voucher' END")
    paid = F.when(F.col("l_linenumber") < 4, F.col("l_orderkey"))
    payments = t.lineitem.select(
        paid.alias("invoice_id"), paid.alias("order_id"), F.when(F.col("l_linestatus") == "F", "authorised").otherwise("cancelled").alias("status"),
        F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("refund_id"), method.alias("method"),
    )
    refunds = lines.filter("l_returnflag = 'R'").select("order_id", "net_cents")
    made = F.when(key % 5 == 0, F.add_months("started_dt", -1)).otherwise(F.col("started_dt"))
    parents = t.b_contract.select("contract_id", made.alias("contract_created_ts"))
    return orders.enrich_orders(placed, invoices, payments, refunds, parents, products(t), ["7", "8"], IMPORTER)


@register(
    "q_contract_snapshot",
    f"""SELECT c.contract_id, c.customer_id, 'dom' || c.customer_id AS domain_name, CASE WHEN {PERCENT.replace('contract_id', 'c.contract_id')} THEN 'percentage' WHEN {AMOUNT.replace('contract_id', 'c.contract_id')} THEN 'amount' END AS discount_type,
    {DISCOUNT_SQL.replace('contract_id', 'c.contract_id')} AS discount_value, CASE WHEN {AMOUNT.replace('contract_id', 'c.contract_id')} THEN 'EUR' END AS currency_code, c.status, coalesce(d.devices, 0) AS devices,
    c.started_dt, c.period_end_dt, c.canceled_dt FROM b_contract c LEFT JOIN (SELECT i.contract_id, CAST(sum(i.quantity) AS BIGINT) AS devices FROM b_item i JOIN b_product p ON p.product_id = i.product_id
      WHERE p.counts_device GROUP BY 1) d ON d.contract_id = c.contract_id""",
    uses="b_contract b_item b_product",
    dates="started_dt period_end_dt canceled_dt",
    money="discount_value",
)
def contract_snapshot(t):
    return orders.contract_snapshot(contracts(t), t.b_product)


VALUE_SQL = f"""SELECT *, CASE WHEN {PERCENT} THEN amount * 85 * 119 WHEN {AMOUNT} THEN amount * 11900 - (contract_id % 50 + 100) * 10000 ELSE amount * 11900 END * CASE WHEN monthly_payment THEN 12 ELSE 1 END AS v
    FROM (SELECT DISTINCT i.contract_id, i.product_id, i.amount, p.monthly_payment FROM b_item i JOIN b_product p ON p.product_id = i.product_id WHERE p.counts_revenue) s"""


@register(
    "q_contract_net_value",
    f"SELECT contract_id, CAST({rdiv('sum(v)', '11900')} AS DOUBLE) / 100 AS net_value_eur FROM ({VALUE_SQL}) x GROUP BY contract_id",
    uses="b_item b_product",
    money="net_value_eur",
)
def contract_net_value(t):
    return orders.contract_net_value(contracts(t), t.b_product)


@register(
    "q_item_net_value",
    f"""SELECT contract_id, CAST({DISCOUNT_SQL} AS DOUBLE) AS discount_value, monthly_payment, amount AS total_net_cents, CAST({rdiv('sum(v)', '11900')} AS DOUBLE) / 100 AS net_value_eur
    FROM ({VALUE_SQL}) x GROUP BY contract_id, monthly_payment, amount""",
    uses="b_item b_product",
    money="net_value_eur discount_value",
)
def item_net_value(t):
    return orders.contract_net_value(contracts(t), t.b_product, by_item=True)


@register(
    "q_split_discount",
    f"""SELECT contract_id, product_id, total_net_cents, CASE WHEN {PERCENT} THEN 'percentage' WHEN {AMOUNT} THEN 'amount' END AS discount_type, CAST({DISCOUNT_SQL} AS DOUBLE) AS discount_value,
    CASE WHEN {PERCENT} THEN 0.15 WHEN {AMOUNT} THEN CAST((contract_id % 50 + 100) * {rdiv('total_net_cents * 100', 'total')} AS DOUBLE) / 100 END AS item_discount
    FROM (SELECT *, sum(total_net_cents) OVER (PARTITION BY contract_id) AS total FROM (SELECT DISTINCT contract_id, product_id, amount AS total_net_cents FROM b_item) a) b""",
    uses="b_item",
    money="discount_value item_discount",
)
def split_discount(t):
    return orders.split_discount(contracts(t).filter("items IS NOT NULL"))


@register(
    "q_fleet_contracts",
    """SELECT c.contract_id FROM b_contract c WHERE c.customer_id % 2 = 0 AND c.customer_id IN (SELECT user_id * 2 FROM events WHERE event_type IN ('view', 'click') AND user_id % 3 <> 0)
      AND EXISTS (SELECT 1 FROM b_item i JOIN b_product p ON p.product_id = i.product_id WHERE i.contract_id = c.contract_id AND (p.is_recurring OR p.is_subsequent_recurring))
    UNION SELECT customer_id FROM (SELECT o_custkey AS customer_id, p.product_name, CAST(l_shipdate + INTERVAL '1' HOUR AS DATE) AS end_dt, max(CAST(l_shipdate + INTERVAL '1' HOUR AS DATE)) OVER (PARTITION BY o_custkey) AS max_end
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN b_product p ON p.product_key = l_partkey WHERE p.is_recurring OR p.is_subsequent_recurring) s WHERE product_name LIKE '%ring%' AND end_dt = max_end""",
    uses="b_contract b_item b_product",
)
def fleet_contracts(t):
    roles = t.events.select(F.concat(F.expr("if(user_id % 3 <> 0, 'u', 'none')"), (F.col("user_id") * 2).cast("string")).alias("user_domain"), F.col("event_type").alias("role"))
    domain_map = t.customer.select(
        F.concat(F.lit("dom"), F.col("c_custkey").cast("string")).alias("domain_name"), F.concat(F.expr("if(c_custkey % 2 = 0, 'u', 'other')"), F.col("c_custkey").cast("string")).alias("user_domain")
    )
    names = t.b_product.select("product_id", "product_name")
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("contract_id"), F.col("l_partkey").cast("string").alias("product_id"), F.col("l_shipdate").alias("end_ts")
    ).join(names, "product_id")
    return orders.fleet_contracts(contracts(t), t.b_product, domain_map, roles, ["view", "click"], lines, "ring")


@register(
    "q_fleet_by_items",
    "SELECT DISTINCT i.contract_id, i.product_id FROM b_item i JOIN b_product p ON p.product_id = i.product_id WHERE p.product_name LIKE '%ring%'",
    uses="b_item b_product",
)
def fleet_by_items(t):
    return orders.fleet_by_items(t.b_contract_items, t.b_product, "ring")


@register(
    "q_returns",
    """SELECT l_orderkey AS contract_id, CAST(l_shipdate AS DATE) AS return_dt, l_linestatus AS reason, p_name AS product_name, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS quantity
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 10 <> 0 WHERE l_returnflag = 'R' AND CAST(l_shipdate AS DATE) BETWEEN DATE '1998-09-01' AND DATE '1998-09-30'
    AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1, 2, 3, 4""",
    dates="return_dt",
)
def returns(t):
    rows = t.lineitem.filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("contract_id"), F.col("l_shipdate").alias("created_ts"), F.col("l_linestatus").alias("reason"),
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"),
    )
    live = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("contract_id"))
    names = t.part.select(F.expr("if(p_partkey % 10 <> 0, p_partkey, -p_partkey - 1)").alias("product_id"), F.col("p_name").alias("product_name"))
    return orders.returns_report(rows, live, names, "1998-09-01", "1998-09-30")


@register(
    "q_ticket_ratings",
    """SELECT conv_id * 1000 + turn AS ticket_id, conv_id AS rating_id, role AS score, left(text, 2048) AS comment, CASE WHEN turn = 0 THEN 'first' END AS reason,
    TIMESTAMP '2024-01-01 00:00:00' AS created_ts FROM conversations WHERE role = 'user'""",
)
def ticket_ratings(t):
    doc = F.to_json(F.struct(
        F.col("conv_id").alias("id"), F.col("role").alias("score"), F.when(F.col("role") == "user", F.col("text")).alias("comment"),
        F.when(F.col("turn") == 0, "first").alias("reason"), F.lit("2024-01-01 00:00:00").alias("created_at"),
    ))
    tickets = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ticket_id"), doc.alias("satisfaction_rating"))
    return orders.ticket_ratings(tickets)


@register(
    "q_contract_car_ratio",
    """SELECT a.domain_name, a.cars, b.contracts, CAST((2 * b.contracts * 100 + a.cars) // (2 * a.cars) AS DOUBLE) / 100 AS contract_car_ratio
    FROM (SELECT lower(c_name) AS domain_name, count(*) AS cars FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY 1) a
    LEFT JOIN (SELECT lower(c_name) AS domain_name, count(*) AS contracts FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b ON b.domain_name = a.domain_name""",
    money="contract_car_ratio",
)
def contract_car_ratio(t):
    named = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("domain_name"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("ended_ts"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate")).alias("deleted_ts"),
    )
    return orders.contract_car_ratio(named, named)


@register(
    "q_domain_status",
    f"""SELECT 'dom' || customer_id AS domain_name, max(started_dt) AS started_dt, 'Customer' AS contract_type, CASE WHEN max(period_end_dt) > DATE '{AS_OF}' THEN 'Active' END AS contract_status
    FROM b_contract GROUP BY customer_id""",
    uses="b_contract",
    dates="started_dt",
)
def domain_status(t):
    named = t.b_contract.withColumn("domain", F.concat(F.lit("Dom"), F.col("customer_id").cast("string"), F.lit(".")))
    return orders.domain_status(named, AS_OF)


@register(
    "q_domain_cars",
    """SELECT lower(c_name) AS domain_name, count(*) FILTER (WHERE o_orderstatus <> 'F') AS active_cars, min(CAST(o_orderdate AS DATE)) AS first_usage_dt
    FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    dates="first_usage_dt",
)
def domain_cars(t):
    named = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("domain_name"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("ended_ts"), F.col("o_orderdate").alias("created_ts")
    )
    return orders.domain_cars(named)


@register(
    "q_checks",
    """SELECT 'unmapped products' AS "check", (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_name FROM part WHERE p_type = 'PROMO' AND p_brand NOT IN ('Brand#1', 'Brand#2')) s) AS "rows"
    UNION ALL SELECT 'impossible trip times', (SELECT count(*) FROM b_trip WHERE trip_start_ts < TIMESTAMP '2024-01-02 00:00:00' OR trip_start_ts > TIMESTAMP '2024-01-25 00:00:00')
    UNION ALL SELECT 'repeated order lines', (SELECT count(*) FROM (SELECT l_orderkey * 10 + l_linenumber FROM lineitem GROUP BY 1 HAVING count(*) > 1) s)""",
    uses="b_trip",
)
def data_checks(t):
    plans = t.part.select(F.col("p_brand").alias("plan_id"), F.col("p_name").alias("plan_name"), F.col("p_type").alias("product_group"))
    line_ids = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"))
    return checks.run_checks({
        "unmapped products": checks.unmapped_products(plans, "PROMO", ["Brand#1", "Brand#2"]),
        "impossible trip times": checks.impossible_times(t.b_trip, "trip_start_ts", "2024-01-02 00:00:00", "2024-01-25 00:00:00"),
        "repeated order lines": checks.duplicate_ids(line_ids, "line_id"),
    })
