"""Revenue jobs on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators.keyed import with_totals
from ..plans import revenue
from .base import register
from .constructs import AS_OF, age_months_sql


def rdiv(num: str, den: str) -> str:
    """Half-up rounded division of non-negative integers."""
    return f"((2 * ({num}) + ({den})) // (2 * ({den})))"


# Orders and lines in the shop's shape; refunds are a tenth of the returned net price.
SHOP_LINE = """SELECT l_orderkey AS order_key, l_partkey AS product_key, CAST(round(l_extendedprice * 100) AS BIGINT) AS net_cents,
    CAST(round(l_extendedprice * 100) AS BIGINT) * (100 + CAST(round(l_tax * 100) AS BIGINT)) {div} 100 AS gross_cents,
    CAST(l_quantity AS INT) AS quantity, CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN 'D' ELSE 'I' END AS opcode
    FROM {lineitem}"""
SHOP_ORDER = """SELECT o_orderkey AS order_key, o_orderkey AS order_id,
    CASE WHEN o_orderkey % 9 <> 0 THEN concat('R', CAST(o_orderkey AS {text})) END AS invoice_id,
    CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'paid' END AS invoice_status, concat('V', CAST(o_orderkey % 5000 AS {text})) AS contract_id,
    o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS created_dt, CAST(o_orderdate AS DATE) AS start_dt,
    CAST(CAST(o_orderdate AS DATE) + INTERVAL '12' MONTH AS DATE) AS end_dt,
    CASE WHEN o_orderkey % 5 = 2 THEN concat(' Code', CAST(o_orderkey % 10 AS {text}), ' ') END AS coupon_code,
    CASE WHEN o_orderkey % 5 = 0 THEN CAST(0.10 AS DECIMAL(10,2)) END AS discount_percentage,
    CASE WHEN o_orderkey % 5 = 1 THEN CAST(2500 AS BIGINT) END AS discount_cents,
    CASE WHEN o_orderkey % 2 = 0 THEN CAST(0.19 AS DECIMAL(4,2)) END AS tax_rate, o_orderstatus <> 'O' AS has_refund,
    o_orderstatus = 'P' AS has_full_refund, CASE WHEN o_orderkey % 100 = 3 THEN 'ghost contract' END AS cancelation_reason,
    CASE o_orderkey % 4 WHEN 0 THEN 'urn:service/contract-renewal' WHEN 1 THEN 'urn:service/new-user-checkout' WHEN 2 THEN concat('urn:principal/p', CAST(o_custkey AS {text})) END AS creator_urn,
    CASE o_orderkey % 5000 % 4 WHEN 0 THEN 'terminated' WHEN 1 THEN 'canceled' ELSE 'active' END AS contract_status,
    CASE WHEN o_orderkey % 5000 % 8 = 1 THEN DATE '1997-03-01' END AS contract_canceled_dt, DATE '1998-02-01' AS contract_modified_dt
    FROM {orders}"""
SHOP_BILLING = """SELECT c_custkey AS customer_id, concat('B', CAST(c_custkey AS {text})) AS billing_customer_id FROM {customer} WHERE c_custkey % 3 = 0"""
SHOP_PLAN = """SELECT DISTINCT concat('plan-', CAST(p_size AS {text}), CASE WHEN p_size % 2 = 0 THEN '-monthly' ELSE '-yearly' END) AS plan_id,
    CASE WHEN p_size % 4 <> 0 THEN concat('c', CAST(p_size AS {text})) END AS plan_code, concat('n', CAST(p_size AS {text})) AS plan_code_nbr FROM {part} WHERE p_size % 7 <> 0"""
SHOP_SUBSCRIPTION = """SELECT DISTINCT concat('V', CAST(l_orderkey % 5000 AS {text}), '_', CASE WHEN p_size % 3 = 0 THEN 'c' ELSE 'n' END, CAST(p_size AS {text})) AS subscription_id
    FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE p_size % 5 <> 1"""
SHOP_COUPON = """SELECT concat(' Code', CAST(n_nationkey AS {text}), ' ') AS coupon_code,
    CASE WHEN n_nationkey % 5 = 2 AND n_nationkey < 5 THEN 'percentage' ELSE 'amount' END AS discount_type,
    CAST(0.25 AS DECIMAL(10,2)) AS discount_value FROM {nation}"""
SHOP_REFUND = """SELECT concat('R', CAST(l_orderkey AS {text})) AS invoice_id,
    CAST(round(l_extendedprice * 100) AS BIGINT) {div} 10 AS refund_net_cents FROM {lineitem} WHERE l_returnflag = 'R'"""
SHOP = {
    "shop_line": SHOP_LINE, "shop_order": SHOP_ORDER, "shop_coupon": SHOP_COUPON, "shop_refund": SHOP_REFUND,
    "shop_billing": SHOP_BILLING, "shop_plan": SHOP_PLAN, "shop_subscription": SHOP_SUBSCRIPTION,
}
SHOP_TABLES = ("lineitem", "orders", "nation", "customer", "part")


def shop(t, name):
    text = SHOP[name].replace("{div}", "div").replace("{text}", "STRING")
    used = {x: getattr(t, x) for x in SHOP_TABLES if "{" + x + "}" in text}
    return t.spark.sql(text, **used)


def shop_cte(name):
    text = SHOP[name].replace("{div}", "//").replace("{text}", "VARCHAR")
    for table in SHOP_TABLES:
        text = text.replace("{" + table + "}", table)
    return f"{name} AS ({text})"


SHOP_CTES = ", ".join(map(shop_cte, SHOP))

TERMS_SQL = "CASE WHEN p.product_name LIKE '%ring%' THEN '36' ELSE '12' END || ' mths, ' || CASE WHEN p.monthly_payment THEN 'monthly' ELSE 'yearly' END || ' payment'"
ID_SQL = "CASE WHEN bc.billing_customer_id IS NOT NULL THEN coalesce(s1.subscription_id, s2.subscription_id, o.contract_id || '_' || md5(p.plan_id)) ELSE o.contract_id END"
LAPSED_SQL = "max(o.end_dt) OVER (PARTITION BY o.contract_id) < DATE '1999-07-01' - INTERVAL 6 MONTH"
RAW = f"""raw AS (SELECT l.*, o.* EXCLUDE (order_key, customer_id), p.* EXCLUDE (product_key), c.discount_type, c.discount_value,
      coalesce(r.refund_net_cents, 0) AS refund_cents,
      sum(l.net_cents) OVER (PARTITION BY o.order_id) AS order_net, sum(l.gross_cents) OVER (PARTITION BY o.order_id) AS order_gross,
      min(o.created_dt) OVER (PARTITION BY o.customer_id) AS first_created_dt, coalesce(bc.billing_customer_id, CAST(o.customer_id AS VARCHAR)) AS customer_id,
      {ID_SQL} AS subscription_id, {TERMS_SQL} AS product_terms,
      CASE WHEN contract_status = 'terminated' OR contract_status = 'active' AND {LAPSED_SQL} THEN 0 WHEN contract_status = 'canceled' THEN 1 ELSE 2 END AS status_code,
      CASE WHEN contract_status <> 'active' OR {LAPSED_SQL} THEN coalesce(contract_canceled_dt, contract_modified_dt) END AS terminated_dt,
      min(o.start_dt) FILTER (WHERE NOT has_full_refund) OVER (PARTITION BY o.customer_id) AS first_order_dt,
      coalesce(max(o.end_dt) FILTER (WHERE NOT has_full_refund) OVER (PARTITION BY o.customer_id), max(o.end_dt) OVER (PARTITION BY o.customer_id)) AS valid_to_dt,
      min(CAST(date_trunc('month', o.start_dt) AS DATE)) FILTER (WHERE NOT has_full_refund AND p.monthly_payment) OVER (PARTITION BY {ID_SQL}) AS first_monthly_mth,
      min(o.start_dt) FILTER (WHERE NOT has_full_refund AND p.product_name LIKE '%ring%') OVER (PARTITION BY {ID_SQL}) AS first_long_term_dt,
      min(o.created_dt) FILTER (WHERE NOT has_full_refund) OVER (PARTITION BY {ID_SQL}, p.product_family, {TERMS_SQL}) AS first_terms_dt,
      CAST(round(coalesce(CASE WHEN c.discount_type = 'percentage' THEN c.discount_value ELSE o.discount_percentage END, 0) * 100) AS BIGINT) AS pct,
      CASE WHEN p.monthly_payment THEN 1 ELSE 12 END AS months,
      l.net_cents > 0 AND (p.is_recurring OR p.is_subsequent_recurring) AS relevant
    FROM shop_line l JOIN shop_order o ON o.order_key = l.order_key JOIN b_product p ON p.product_key = l.product_key
    LEFT JOIN shop_coupon c ON c.coupon_code = o.coupon_code LEFT JOIN shop_billing bc ON bc.customer_id = o.customer_id
    LEFT JOIN shop_plan pl ON pl.plan_id = p.plan_id LEFT JOIN shop_subscription s1 ON s1.subscription_id = o.contract_id || '_' || pl.plan_code
    LEFT JOIN shop_subscription s2 ON s2.subscription_id = o.contract_id || '_' || pl.plan_code_nbr
    LEFT JOIN (SELECT invoice_id, sum(refund_net_cents) AS refund_net_cents FROM shop_refund GROUP BY invoice_id) r ON r.invoice_id = o.invoice_id
    WHERE l.opcode <> 'D' AND coalesce(o.cancelation_reason, '') <> 'ghost contract'
      AND NOT (o.invoice_id IS NULL AND o.created_dt >= DATE '1998-01-01')),
  off AS (SELECT *, """ + rdiv("coalesce(discount_cents, 0) * gross_cents * 100", "order_gross * 119") + """ AS off_gross_full,
      """ + rdiv("coalesce(discount_cents, 0) * net_cents * 100", "order_net * 119") + """ AS off_net_full,
      """ + rdiv("coalesce(discount_cents, 0) * gross_cents", "order_gross * 119") + """ AS off_eur_cents FROM raw),
  mrr AS (SELECT *, CASE WHEN NOT relevant THEN 0
        WHEN pct > 0 THEN """ + rdiv("net_cents * (100 - pct)", "100 * months") + """
        WHEN discount_cents > 0 AND months = 1 THEN net_cents - off_net_full
        WHEN discount_cents > 0 THEN """ + rdiv("net_cents - off_gross_full", "12") + """
        ELSE """ + rdiv("net_cents", "months") + """ END AS mrr_cents,
      CASE WHEN NOT relevant THEN 0 ELSE """ + rdiv("refund_cents * net_cents", "order_net * months") + """ END AS part_cents FROM off)"""


@register(
    "q_invoice_mrr",
    f"""SELECT coalesce(invoice_id, 'o-' || order_id) AS invoice_id, subscription_id, customer_id, created_dt, invoice_status,
    start_dt, end_dt, created_dt = first_created_dt AS is_first_invoice, coalesce(creator_urn NOT LIKE '%renewal%', FALSE) AS is_new_invoice,
    CASE WHEN creator_urn LIKE '%principal%' THEN split_part(creator_urn, '/', 2) END AS creator, status_code, terminated_dt,
    first_order_dt, valid_to_dt, first_monthly_mth, first_long_term_dt, first_terms_dt,
    lower(trim(coupon_code)) AS coupon_code, CASE WHEN pct > 0 THEN 'percentage' WHEN discount_cents > 0 THEN 'amount' END AS discount_kind,
    CASE WHEN pct > 0 THEN CAST(pct AS DOUBLE) / 100
      WHEN discount_cents > 0 THEN CAST({rdiv('discount_cents * gross_cents * 100', 'order_gross * 119')} AS DOUBLE) / 100 END AS discount_value_eur,
    CAST({rdiv('discount_cents * 1000', 'order_gross')} AS DOUBLE) / 1000 AS discount_share,
    has_refund, has_full_refund, product_id, product_name, product_family AS product_group,
    product_terms, CAST(mrr_cents AS DOUBLE) / 100 AS mrr_eur, CAST(CASE WHEN has_full_refund THEN mrr_cents ELSE part_cents END AS DOUBLE) / 100 AS refund_mrr_eur,
    quantity AS item_quantity, CAST(coalesce(CASE WHEN has_full_refund THEN quantity * 100
      WHEN mrr_cents = 0 THEN 0 ELSE {rdiv('quantity * part_cents * 100', 'greatest(mrr_cents, 1)')} END, 0) AS DOUBLE) / 100 AS refund_item_quantity
    FROM mrr""",
    uses="b_product",
    extra=f"{SHOP_CTES}, {RAW}",
    dates="created_dt start_dt end_dt terminated_dt first_order_dt valid_to_dt first_monthly_mth first_long_term_dt first_terms_dt",
    money="discount_value_eur discount_share mrr_eur refund_mrr_eur refund_item_quantity",
)
def invoice_mrr(t):
    """Discounts by percent, coupon and shared amount; refunds; ids of the billing system, status and first dates."""
    return revenue.invoice_mrr(
        shop(t, "shop_line"), shop(t, "shop_order"), t.b_product, shop(t, "shop_coupon"), shop(t, "shop_refund"),
        long_term_pattern="%ring%", as_of="1999-07-01", invoice_required_from="1998-01-01",
        billing={name: shop(t, f"shop_{table}") for name, table in (("customers", "billing"), ("plans", "plan"), ("subscriptions", "subscription"))},
    )


@register(
    "q_refund_share",
    f"""SELECT subscription_id, line_no, product_id, net_cents,
    CAST(CASE WHEN full_refund THEN mrr ELSE {rdiv('5000 * net_cents', 'total * months')} END AS DOUBLE) / 100 AS refund_mrr_eur,
    CAST(CASE WHEN full_refund THEN quantity * 100 ELSE {rdiv(f"quantity * {rdiv('5000 * net_cents', 'total * months')} * 100", 'mrr')} END AS DOUBLE) / 100 AS refund_item_quantity
    FROM (SELECT *, sum(net_cents) OVER (PARTITION BY subscription_id) AS total, CASE WHEN monthly_payment THEN 1 ELSE 12 END AS months,
      {rdiv('net_cents', 'CASE WHEN monthly_payment THEN 1 ELSE 12 END')} AS mrr FROM b_invoice_line) s""",
    uses="b_invoice_line",
    money="refund_mrr_eur refund_item_quantity",
)
def refund_share(t):
    lines = with_totals(t.b_invoice_line, ["subscription_id"], order_net_cents=F.sum("net_cents"))
    per_month = numbers.round_div([F.col("net_cents")], [revenue.billing_months(F.col("monthly_payment"))])
    lines = lines.withColumns({
        "order_id": F.col("subscription_id"), "refund_net_cents": F.lit(5000), "has_full_refund": F.col("full_refund"),
        "mrr_eur": numbers.euro(per_month), "is_mrr_relevant": F.lit(True),
    })
    return revenue.refund_share(lines).select(
        "subscription_id", "line_no", "product_id", "net_cents", "refund_mrr_eur", "refund_item_quantity"
    )


CONTRACT_ROWS = """SELECT customer_id AS contract_id, contract_id AS order_id, CASE customer_id % 4 WHEN 0 THEN 'terminated' WHEN 1 THEN 'canceled' ELSE 'active' END AS status,
    period_end_dt AS end_dt, canceled_dt, started_dt AS modified_dt FROM {b_contract}"""


@register(
    "q_contract_status",
    """SELECT contract_id, order_id, CASE WHEN status = 'active' AND last_end < DATE '2001-06-01' - INTERVAL '6' MONTH THEN 0 WHEN status = 'terminated' THEN 0
    WHEN status = 'canceled' THEN 1 WHEN status = 'active' THEN 2 END AS status_code,
    CASE WHEN status <> 'active' OR last_end < DATE '2001-06-01' - INTERVAL '6' MONTH THEN coalesce(canceled_dt, modified_dt) END AS terminated_dt
    FROM (SELECT *, max(end_dt) OVER (PARTITION BY contract_id) AS last_end FROM rows_in) s""",
    uses="b_contract",
    extra="rows_in AS (" + CONTRACT_ROWS.replace("{b_contract}", "b_contract") + ")",
    dates="terminated_dt",
)
def contract_status(t):
    rows = t.spark.sql(CONTRACT_ROWS, b_contract=t.b_contract)
    return revenue.contract_status(rows, "2001-06-01").select("contract_id", "order_id", "status_code", "terminated_dt")


RUNNING_SQL = f"invoice_status <> 'voided' AND start_dt <= DATE '{AS_OF}' AND end_dt > DATE '{AS_OF}'"


@register(
    "q_current_mrr",
    f"""SELECT c.customer_id, c.country, c.customer_status, c.system, sum(l.mrr_eur - l.refund_mrr_eur) AS mrr_eur
    FROM b_line l JOIN b_customer c ON c.customer_id = l.customer_id WHERE {RUNNING_SQL} GROUP BY c.customer_id, c.country, c.customer_status, c.system""",
    uses="b_line b_customer",
    money="mrr_eur",
)
def current_mrr(t):
    """Customers with running terms and their net recurring revenue."""
    customers = t.b_customer.select("customer_id", "country", "customer_status", "system")
    return revenue.current_mrr(t.b_line, customers, AS_OF)


DOMAIN_MAP = "SELECT CASE WHEN customer_id % 10 <> 0 THEN customer_id ELSE -customer_id - 1 END AS customer_id, domain_id FROM {b_customer}"
DOMAIN_MAP_CTE = "domain_map AS (" + DOMAIN_MAP.replace("{b_customer}", "b_customer") + ")"
CONFIG = """SELECT DISTINCT domain_id, domain_id % 3 = 0 AS has_admin, CASE WHEN domain_id % 4 <> 0 THEN domain_id % 4 = 1 END AS has_tracking,
    domain_id % 5 < 2 AS has_booking FROM {b_customer}"""
# Cars, their settings and their inventory, from one kind of event.
FLEET = {
    "cars": "SELECT CAST(user_id % 40 AS INT) AS domain_id, CASE WHEN event_id % 4 = 0 THEN ts END AS ended_ts FROM {events} WHERE event_type = 'view'",
    "vehicles": "SELECT event_id AS vehicle_id, CASE WHEN event_id % 4 = 0 THEN ts END AS ended_ts FROM {events} WHERE event_type = 'view'",
    "settings": """SELECT CAST(user_id % 40 AS INT) AS domain_id, concat('urn:vehicle/', CAST(event_id AS {text})) AS vehicle_urn, event_id % 3 = 0 AS has_tracking,
        event_id % 5 = 0 AS has_dynamic_tracking FROM {events} WHERE event_type <> 'click'""",
    "inventory": "SELECT CAST(user_id % 40 AS INT) AS domain_id, concat('urn:resource/', CAST(event_id AS {text}), '/x') AS resource_urn, event_id % 2 = 0 AS is_bookable FROM {events}",
}
FLEET_CTES = ", ".join(f"{n} AS ({text.replace('{events}', 'events').replace('{text}', 'VARCHAR')})" for n, text in FLEET.items()) + """,
    running AS (SELECT CAST(vehicle_id AS VARCHAR) AS vehicle_id FROM vehicles WHERE ended_ts IS NULL),
    counted AS (SELECT domain_id, 'cars' AS kind FROM cars WHERE ended_ts IS NULL
      UNION ALL SELECT domain_id, 'tracked' FROM settings JOIN running ON vehicle_id = split_part(vehicle_urn, '/', 2) WHERE has_tracking
      UNION ALL SELECT domain_id, 'dynamic' FROM settings JOIN running ON vehicle_id = split_part(vehicle_urn, '/', 2) WHERE has_dynamic_tracking
      UNION ALL SELECT domain_id, 'bookable' FROM inventory JOIN running ON vehicle_id = split_part(resource_urn, '/', 2) WHERE is_bookable),
    sides AS (SELECT domain_id, count(*) FILTER (WHERE kind = 'cars') AS cars, count(*) FILTER (WHERE kind = 'tracked') AS tracked_cars,
      count(*) FILTER (WHERE kind = 'dynamic') AS dynamic_cars, count(*) FILTER (WHERE kind = 'bookable') AS bookable_cars FROM counted GROUP BY domain_id)"""


def fleet(t):
    return {n: t.spark.sql(text.replace("{text}", "STRING"), events=t.events) for n, text in FLEET.items()}


def domain_map(t):
    return t.spark.sql(DOMAIN_MAP, b_customer=t.b_customer)


# Which licences a kind of cars is held against.
CAR_LICENCES = {"cars": "items_total", "tracked_cars": "items_economy", "dynamic_cars": "items_economy", "bookable_cars": "items_total"}


@register(
    "q_licence_check",
    f"""SELECT r.*, coalesce(d.domains, 0) AS domains, coalesce(d.has_admin, FALSE) AS has_admin, coalesce(d.has_tracking, FALSE) AS has_tracking,
    coalesce(d.has_booking, FALSE) AS has_booking, d.cars, d.tracked_cars, d.dynamic_cars, d.bookable_cars,
    {", ".join(f"CASE WHEN coalesce(d.domains, 0) = 0 THEN 'no linked domain' WHEN d.{c} > r.{i} THEN 'cars > licenses' WHEN d.{c} <= r.{i} THEN 'cars <= licenses' END AS {c}_check" for c, i in CAR_LICENCES.items())}
    FROM (SELECT customer_id, sum(mrr_eur - refund_mrr_eur) AS mrr_total, CAST(sum(item_quantity - refund_item_quantity) AS BIGINT) AS items_total,
      coalesce(sum(mrr_eur - refund_mrr_eur) FILTER (WHERE product_group = 'ECONOMY'), 0) AS mrr_economy,
      coalesce(CAST(sum(item_quantity - refund_item_quantity) FILTER (WHERE product_group = 'ECONOMY') AS BIGINT), 0) AS items_economy,
      coalesce(sum(mrr_eur - refund_mrr_eur) FILTER (WHERE product_group <> 'ECONOMY'), 0) AS mrr_other,
      coalesce(CAST(sum(item_quantity - refund_item_quantity) FILTER (WHERE product_group <> 'ECONOMY') AS BIGINT), 0) AS items_other
      FROM b_line WHERE {RUNNING_SQL} AND product_group <> 'PROMO' GROUP BY customer_id HAVING sum(mrr_eur - refund_mrr_eur) > 0) r
    LEFT JOIN (SELECT m.customer_id, count(m.domain_id) AS domains, bool_or(g.has_admin) AS has_admin, bool_or(g.has_tracking) AS has_tracking,
      bool_or(g.has_booking) AS has_booking, {", ".join(f"CAST(sum(CASE WHEN g.domain_id IS NOT NULL THEN coalesce(c.{c}, 0) END) AS BIGINT) AS {c}" for c in CAR_LICENCES)}
      FROM domain_map m LEFT JOIN config g ON g.domain_id = m.domain_id LEFT JOIN sides c ON c.domain_id = m.domain_id GROUP BY m.customer_id) d
    ON d.customer_id = r.customer_id""",
    uses="b_line b_customer",
    extra=f"{DOMAIN_MAP_CTE}, config AS ({CONFIG.replace('{b_customer}', 'b_customer')}), {FLEET_CTES}",
    money="mrr_total mrr_economy mrr_other",
)
def licence_check(t):
    per_product = revenue.product_revenue(t.b_line, AS_OF, {"economy": ["ECONOMY"]}, skip=["PROMO"])
    config, cars = t.spark.sql(CONFIG, b_customer=t.b_customer), revenue.car_side_counts(**fleet(t))
    return revenue.licence_check(per_product, domain_map(t), config, cars, ["has_admin", "has_tracking", "has_booking"], CAR_LICENCES)


VALID_SQL = "invoice_status <> 'voided' AND NOT full_refund"
FIRST_STARTS = f"first_starts AS (SELECT customer_id, min(start_dt) AS first_start_dt FROM b_line WHERE {VALID_SQL} GROUP BY customer_id)"
PRIORITY_SQL = "CASE " + " ".join(f"WHEN bool_or(c.customer_status = '{s}') THEN '{s}'" for s in revenue.STATUS_PRIORITY) + " END"


def net_quantity_sql(where: str = "TRUE") -> str:
    pick = lambda col: f"CAST(sum({col}) FILTER (WHERE {where}) AS HUGEINT)"
    m, r, q = pick("CAST(l.mrr_eur * 100 AS BIGINT)"), pick("CAST(l.refund_mrr_eur * 100 AS BIGINT)"), pick("l.item_quantity")
    return f"CAST({rdiv(f'{q} * ({m} - {r}) * 10', f'nullif({m}, 0)')} AS DOUBLE) / 10"


@register(
    "q_first_order",
    f"""SELECT m.domain_id, {PRIORITY_SQL} AS customer_status, min(f.first_start_dt) AS first_start_dt, {net_quantity_sql()} AS item_quantity
    FROM b_line l JOIN first_starts f ON f.customer_id = l.customer_id AND f.first_start_dt = l.start_dt JOIN b_customer c ON c.customer_id = l.customer_id
    JOIN domain_map m ON m.customer_id = l.customer_id WHERE {VALID_SQL} AND product_group = 'ECONOMY' GROUP BY m.domain_id""",
    uses="b_line b_customer",
    extra=f"{DOMAIN_MAP_CTE}, {FIRST_STARTS}",
    dates="first_start_dt",
    money="item_quantity",
)
def first_order(t):
    return revenue.first_order_profile(t.b_line, t.b_customer, domain_map(t), "ECONOMY")


@register(
    "q_initial_current",
    f"""SELECT m.domain_id, {PRIORITY_SQL} AS customer_status, min(start_dt) FILTER (WHERE product_group = 'ECONOMY') AS first_dt_economy,
    min(start_dt) FILTER (WHERE product_group = 'STANDARD') AS first_dt_standard,
    coalesce(bool_or(product_group = 'ECONOMY') FILTER (WHERE is_initial), FALSE) AS initial_has_economy,
    coalesce(bool_or(product_group = 'STANDARD') FILTER (WHERE is_initial), FALSE) AS initial_has_standard, {net_quantity_sql('is_initial')} AS initial_quantity,
    coalesce(bool_or(product_group = 'ECONOMY') FILTER (WHERE is_current), FALSE) AS current_has_economy,
    coalesce(bool_or(product_group = 'STANDARD') FILTER (WHERE is_current), FALSE) AS current_has_standard, {net_quantity_sql('is_current')} AS current_quantity
    FROM (SELECT b.*, coalesce(b.start_dt = f.first_start_dt, FALSE) AS is_initial, b.invoice_id IN (SELECT invoice_id FROM b_line WHERE NOT full_refund AND {RUNNING_SQL}) AS is_current
      FROM b_line b LEFT JOIN first_starts f ON f.customer_id = b.customer_id WHERE {VALID_SQL} AND product_group IN ('ECONOMY', 'STANDARD')) l
    JOIN b_customer c ON c.customer_id = l.customer_id JOIN domain_map m ON m.customer_id = l.customer_id WHERE is_initial OR is_current GROUP BY m.domain_id""",
    uses="b_line b_customer",
    extra=f"{DOMAIN_MAP_CTE}, {FIRST_STARTS}",
    dates="first_dt_economy first_dt_standard",
    money="initial_quantity current_quantity",
)
def initial_current(t):
    return revenue.initial_current_orders(t.b_line, t.b_customer, domain_map(t), ["ECONOMY", "STANDARD"], AS_OF)


@register(
    "q_first_occurrence",
    """SELECT invoice_id, plan_id, mrr_eur FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id, plan_id ORDER BY reporting_month, mrr_eur) AS n
    FROM report) s WHERE n = 1""",
    extra="""report AS (SELECT l_orderkey AS invoice_id, l_linenumber AS plan_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS reporting_month,
      CAST(l_extendedprice AS DECIMAL(12,2)) AS mrr_eur FROM lineitem)""",
    money="mrr_eur",
)
def first_occurrence(t):
    report = t.lineitem.select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("plan_id"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("reporting_month"), F.col("l_extendedprice").cast("decimal(12,2)").alias("mrr_eur"),
    )
    return revenue.first_occurrence_mrr(report)


NAMED = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
NAMED_SQL = "CASE WHEN product_group NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'Other' ELSE product_group END"
# Revenue movement by a rule: licences rise the change, cheap months lower it.
VALUE_REPORT = """SELECT r.*, f.first_month, CASE WHEN r.reporting_month = f.first_month THEN r.mrr_eur ELSE 0 END AS mrr_eur_new,
    CAST(CASE WHEN r.mrr_eur > 200000 THEN 100 * r.licenses WHEN r.mrr_eur < 100000 THEN -30 ELSE 5 END AS DECIMAL(12,2)) AS mrr_change,
    r.customer_id % 6 = 0 AND r.mrr_eur < 50000 AS churn_mth, c.country AS customer_country, c.customer_status, c.is_fleet,
    r.reporting_month >= DATE '1998-06-01' AS flag_future
    FROM {b_report} r JOIN {b_customer} c ON c.customer_id = r.customer_id JOIN (SELECT customer_id, min(reporting_month) AS first_month FROM {b_report} GROUP BY customer_id) f ON f.customer_id = r.customer_id"""
VALUE_CTE = "report AS (" + VALUE_REPORT.replace("{b_report}", "b_report").replace("{b_customer}", "b_customer") + ")"


def value_report(t):
    return t.spark.sql(VALUE_REPORT, b_report=t.b_report, b_customer=t.b_customer)


@register(
    "q_map_product",
    f"SELECT DISTINCT customer_id, {NAMED_SQL} AS product FROM b_report",
    uses="b_report",
)
def map_product(t):
    return t.b_report.select("customer_id", revenue.map_product(F.col("product_group"), NAMED).alias("product")).distinct()


@register(
    "q_customer_value",
    f"""SELECT customer_id, country_group, customer_status, churn_month, product, coalesce(sum(mrr_eur) FILTER (WHERE first), 0) AS mrr_eur_initial,
    coalesce(sum(mrr_eur) FILTER (WHERE current), 0) AS mrr_eur_current, coalesce(sum(mrr_eur) FILTER (WHERE last_value), 0) AS mrr_eur_last_value,
    coalesce(sum(mrr_change) FILTER (WHERE expanding), 0) AS expansion_eur FROM (SELECT r.*, {NAMED_SQL} AS product, mrr_eur_new > 0 AS first,
      CASE customer_country WHEN 'UNITED KINGDOM' THEN 'UK' WHEN 'FRANCE' THEN 'FR' ELSE 'DACH' END AS country_group, m.churn_month,
      reporting_month = max(reporting_month) OVER (PARTITION BY r.customer_id) AS current,
      reporting_month = max(reporting_month) FILTER (WHERE mrr_eur > 0) OVER (PARTITION BY r.customer_id) AS last_value,
      sum(mrr_change) OVER (PARTITION BY r.customer_id, reporting_month) > 0 AS expanding
      FROM report r LEFT JOIN (SELECT customer_id, max(reporting_month) AS churn_month FROM report WHERE churn_mth GROUP BY 1) m ON m.customer_id = r.customer_id
      WHERE is_fleet AND NOT flag_future) s
    WHERE first OR current OR last_value OR expanding GROUP BY ALL""",
    uses="b_report b_customer",
    extra=VALUE_CTE,
    dates="churn_month",
    money="mrr_eur_initial mrr_eur_current mrr_eur_last_value expansion_eur",
)
def customer_value(t):
    return revenue.customer_value(value_report(t), NAMED, {"UNITED KINGDOM": "UK", "FRANCE": "FR"}, "DACH")


MONTHS, YEARS = age_months_sql("reporting_month", "first_month"), "extract(year FROM age(CAST(reporting_month AS TIMESTAMP), CAST(first_month AS TIMESTAMP)))"


@register(
    "q_tenure_expansion",
    f"""WITH base AS (SELECT customer_id, {NAMED_SQL} AS product, {MONTHS} + 1 AS tenure_mths, {YEARS} + 1 AS tenure_years,
      CASE WHEN sum(mrr_change) OVER (PARTITION BY customer_id, reporting_month, product_group) > 0 THEN mrr_change END AS gain FROM report)
    SELECT m.*, y.year_expansion_eur FROM (SELECT customer_id, product, tenure_years, tenure_mths, coalesce(sum(gain), 0) AS month_expansion_eur FROM base GROUP BY ALL) m
    JOIN (SELECT customer_id, product, tenure_years, coalesce(sum(gain), 0) AS year_expansion_eur FROM base GROUP BY ALL) y
    ON y.customer_id = m.customer_id AND y.product = m.product AND y.tenure_years = m.tenure_years""",
    uses="b_report b_customer",
    extra=VALUE_CTE,
    money="month_expansion_eur year_expansion_eur",
)
def tenure_expansion(t):
    return revenue.tenure_expansion(value_report(t), NAMED, by_product=True)


@register(
    "q_tenure_expansion_total",
    f"""WITH base AS (SELECT customer_id, {MONTHS} AS tenure_mths, {YEARS} AS tenure_years,
      CASE WHEN sum(mrr_change) OVER (PARTITION BY customer_id, reporting_month) > 0 THEN mrr_change END AS gain FROM report)
    SELECT m.*, y.year_expansion_eur FROM (SELECT customer_id, tenure_years, tenure_mths, coalesce(sum(gain), 0) AS month_expansion_eur FROM base GROUP BY ALL) m
    JOIN (SELECT customer_id, tenure_years, coalesce(sum(gain), 0) AS year_expansion_eur FROM base GROUP BY ALL) y
    ON y.customer_id = m.customer_id AND y.tenure_years = m.tenure_years""",
    uses="b_report b_customer",
    extra=VALUE_CTE,
    money="month_expansion_eur year_expansion_eur",
)
def tenure_expansion_total(t):
    return revenue.tenure_expansion(value_report(t), NAMED, by_product=False)
