"""Account jobs on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lists
from ..plans import accounts
from .base import register
from .revenue import rdiv

# Orders with coupons, coupon categories and receivers, all derived from the keys of the test tables.
DOMAIN = "concat('d', CAST({key} AS {text}))"
CODE = "CASE WHEN o_orderkey % 4 = 0 THEN concat('Ab_CC_', CAST(o_orderkey % 20 AS {text})) WHEN o_orderkey % 4 = 1 THEN concat('Code', CAST(o_orderkey % 40 AS {text})) END"
TEXTS = {
    "a_order": "SELECT o_orderkey AS order_id, " + DOMAIN.replace("{key}", "o_custkey") + " AS domain_name, " + CODE + """ AS coupon_code,
      concat('V', CAST(o_orderkey % 5000 AS {text})) AS contract_id, CAST(o_orderdate AS DATE) AS order_dt, o_orderstatus = 'P' AS is_draft,
      o_orderpriority = '5-LOW' AS has_full_refund, CASE WHEN o_orderkey % 3 = 0 THEN CAST(0.15 AS DECIMAL(10,2)) END AS discount_percentage,
      CASE WHEN o_orderkey % 3 = 1 THEN CAST(1990 AS BIGINT) END AS discount_cents FROM {orders}""",
    "a_coupon": """SELECT concat('Code', CAST(n_nationkey AS {text})) AS coupon_code, CASE WHEN n_nationkey % 3 = 0 THEN 'partner' ELSE 'other' END AS category FROM {nation}
      UNION ALL SELECT concat(CASE WHEN n_nationkey < 12 THEN 'Ab_CC_' ELSE 'none_' END, CAST(n_nationkey AS {text})), 'other' FROM {nation}""",
    "a_receiver": """SELECT concat('CODE', CAST(s_suppkey % 40 AS {text})) AS coupon_code,
      CASE WHEN s_suppkey % 40 < 5 THEN concat(' Mail', CAST(s_suppkey % 40 AS {text}), '@Example.org') END AS receiver_email,
      concat('name ', CAST(s_suppkey % 40 AS {text})) AS receiver_name FROM {supplier}""",
    "a_customer": "SELECT c_custkey AS customer_id, " + DOMAIN.replace("{key}", "c_custkey") + """ AS domain_name, concat(c_mktsegment, ' ', c_name) AS company_name,
      concat('mail', CAST(c_custkey % 60 AS {text}), '@example.org ') AS email, n_name AS country,
      concat('region ', CAST(c_nationkey % 4 AS {text})) AS region, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS {text}) END AS postal_code
      FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey""",
}


def spark_text(t, name):
    sql = TEXTS[name]
    used = {x: getattr(t, x) for x in ("orders", "nation", "supplier", "customer") if "{" + x + "}" in sql}
    return t.spark.sql(sql.replace("{text}", "STRING"), **used)


def ctes(*names):
    out = []
    for name in names:
        sql = TEXTS[name].replace("{text}", "VARCHAR")
        for x in ("orders", "nation", "supplier", "customer"):
            sql = sql.replace("{" + x + "}", x)
        out.append(f"{name} AS ({sql})")
    return ", ".join(out)


NAME_PATTERNS = ["%HOUSE%", "%0000001%"]
CLASSIFIED = r"""by_coupon AS (SELECT DISTINCT domain_name, lower(coupon_code) AS coupon_code, 'ta_coupon_used' AS flag_base FROM a_order WHERE lower(coupon_code) IN
      (SELECT lower(coupon_code) FROM a_receiver WHERE receiver_email IS NOT NULL UNION SELECT lower(coupon_code) FROM a_coupon WHERE lower(coupon_code) LIKE '%\_cc\_%' ESCAPE '\' OR category = 'partner')),
    classified AS (SELECT * FROM by_coupon UNION SELECT domain_name, NULL, 'word_in_company_name' FROM a_customer c
      WHERE (company_name LIKE '%HOUSE%' OR company_name LIKE '%0000001%') AND NOT EXISTS (SELECT 1 FROM by_coupon b WHERE b.domain_name = c.domain_name))"""


def classified(t):
    return accounts.classify_accounts(
        spark_text(t, "a_order"), spark_text(t, "a_receiver"), spark_text(t, "a_coupon"), spark_text(t, "a_customer"), r"%\_cc\_%", ["partner"], NAME_PATTERNS
    )


@register("q_classify", "SELECT * FROM classified", extra=ctes("a_order", "a_coupon", "a_receiver", "a_customer") + ", " + CLASSIFIED)
def classify(t):
    return classified(t)


PRICED = """priced AS (SELECT l.*, coalesce(CASE WHEN has_full_refund THEN 0 ELSE CASE WHEN n < 0 THEN -1 ELSE 1 END * ((2 * abs(n) + total * 100 * months) // (2 * total * 100 * months)) END, 0) AS cents
    FROM (SELECT *, CASE WHEN discount_percentage > 0 THEN net_cents * 85 WHEN discount_cents > 0 THEN (net_cents - off) * 100 ELSE net_cents * 100 END * total - 100 * refund_net_cents * net_cents AS n
      FROM (SELECT *, """ + rdiv("coalesce(discount_cents, 0) * net_cents * 100", "total * 119") + """ AS off FROM (SELECT o.*, CAST(round(l_extendedprice * 100) AS BIGINT) AS net_cents,
        CAST(l_suppkey * 100 AS BIGINT) AS refund_net_cents, CASE WHEN p.monthly_payment THEN 1 ELSE 12 END AS months,
        sum(CAST(round(l_extendedprice * 100) AS BIGINT)) OVER (PARTITION BY o.order_id) AS total
        FROM lineitem JOIN a_order o ON o.order_id = l_orderkey JOIN b_product p ON p.product_key = l_partkey
        WHERE NOT o.is_draft AND (p.is_recurring OR p.is_subsequent_recurring) AND o.domain_name IN (SELECT domain_name FROM classified)) a) b) l)"""
RECEIVER_SQL = "who AS (SELECT DISTINCT lower(coupon_code) AS coupon_code, lower(trim(receiver_email)) AS receiver_email, upper(receiver_name) AS receiver_name FROM a_receiver)"
CENTRAL = r"coalesce(r.coupon_code LIKE '%\_cc\_%' ESCAPE '\', FALSE)"
CALL_CENTRE = {"receiver_name": "Central", "receiver_email": "central@example.org", "country": "DE", "region": "North", "postal_code": "01234"}


@register(
    "q_advisor_report",
    f"""SELECT r.domain_name, a.flag_base, c.company_name, r.contract_id, r.coupon_code, w.coupon_code IS NOT NULL AS coupon_has_receiver, {CENTRAL} AS coupon_call_centre,
    p.coupon_code IS NOT NULL AS coupon_partner, bool_or(p.coupon_code IS NOT NULL) OVER (PARTITION BY r.domain_name) OR a.flag_base = 'ta_coupon_used' AS domain_used_partner_coupon,
    r.order_dt, r.order_id, CAST(r.cents AS DOUBLE) / 100 AS mrr_order, CAST(sum(r.cents) OVER (PARTITION BY r.domain_name) AS DOUBLE) / 100 AS mrr_domain,
    {', '.join(f"CASE WHEN {CENTRAL} THEN '{v}' ELSE {'w' if k.startswith('receiver') else 'g'}.{k} END AS {k}" for k, v in CALL_CENTRE.items())}
    FROM (SELECT contract_id, domain_name, order_id, order_dt, lower(coupon_code) AS coupon_code, sum(cents) AS cents FROM priced GROUP BY ALL) r
    JOIN a_customer c ON c.domain_name = r.domain_name JOIN (SELECT DISTINCT domain_name, flag_base FROM classified) a ON a.domain_name = r.domain_name
    LEFT JOIN (SELECT DISTINCT coupon_code FROM classified) p ON p.coupon_code = r.coupon_code
    LEFT JOIN who w ON w.coupon_code = r.coupon_code
    LEFT JOIN (SELECT DISTINCT lower(trim(email)) AS receiver_email, first_value(country) OVER e AS country, first_value(region) OVER e AS region, first_value(postal_code) OVER e AS postal_code
      FROM a_customer WHERE country IS NOT NULL AND postal_code IS NOT NULL WINDOW e AS (PARTITION BY lower(trim(email)) ORDER BY country, region, postal_code)) g ON g.receiver_email = w.receiver_email""",
    uses="b_product",
    extra=", ".join([ctes("a_order", "a_coupon", "a_receiver", "a_customer"), CLASSIFIED, PRICED, RECEIVER_SQL]),
    dates="order_dt",
    money="mrr_order mrr_domain",
)
def advisor_report(t):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_key"), cents.alias("net_cents"), (F.col("l_suppkey") * 100).alias("refund_net_cents")
    )
    products = t.b_product.select("product_key", "monthly_payment", "is_recurring", "is_subsequent_recurring")
    rows = lines.join(spark_text(t, "a_order"), "order_id").join(products, "product_key")
    return accounts.advisor_report(rows, classified(t), spark_text(t, "a_customer"), spark_text(t, "a_receiver"), r"%\_cc\_%", CALL_CENTRE)


@register(
    "q_mapping_coverage",
    """SELECT count(*) AS total, count(b.o_custkey) AS matched, CAST((2 * count(b.o_custkey) * 100 + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS pct_matched
    FROM (SELECT DISTINCT c_custkey FROM customer) a LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) b ON b.o_custkey = a.c_custkey""",
    money="pct_matched",
)
def mapping_coverage(t):
    rich = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("key"))
    return accounts.mapping_coverage(t.customer.select(F.col("c_custkey").alias("key")), rich, "key")


@register(
    "q_active_net",
    """SELECT (SELECT count(DISTINCT event_id) FROM events e WHERE event_type = 'view' AND event_id % 4 <> 0 AND e.user_id NOT IN (3, 4)
      AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_name NOT LIKE '%7')
      AND NOT EXISTS (SELECT 1 FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING min(o_orderstatus) = 'P') s WHERE s.o_custkey = e.user_id))
    - (SELECT count(*) FROM lineitem WHERE l_shipdate >= DATE '2000-01-01' - 31 AND l_returnflag IN ('A', 'N') AND l_linenumber = 1 AND l_quantity > 49) AS cars""",
)
def active_net(t):
    domain = F.concat(F.lit("d"), F.col("user_id").cast("string"))
    cars = t.events.filter("event_type = 'view'").select(
        F.col("event_id").alias("car_id"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("ended_ts"), domain.alias("domain_name"), F.col("user_id").alias("owner_id")
    )
    owners = t.customer.select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("email"))
    status = F.when(F.col("o_orderstatus") == "P", "terminated").otherwise("active")
    contracts = t.orders.select(F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("domain_name"), status.alias("status"))
    shipments = t.lineitem.select(F.col("l_shipdate").alias("shipped_dt"), F.when(F.expr("l_linenumber = 1 AND l_quantity > 49"), F.col("l_returnflag")).alias("kind"))
    return accounts.active_cars_net(cars, owners, contracts, shipments, ["d3", "d4"], "%7", "2000-01-01", ["A", "N"])


@register(
    "q_normalised_key",
    """SELECT c.c_custkey AS customer_id, d.user_id AS domain_id, p.p_partkey AS car_id, m.drive, p.p_size % 4 <> 0 AS car_active
    FROM customer c LEFT JOIN (SELECT user_id FROM b_user) d ON d.user_id = c.c_custkey
    LEFT JOIN part p ON p.p_partkey % 150 = d.user_id
    LEFT JOIN (SELECT DISTINCT upper(p_brand) AS brand, p_type AS model, CASE WHEN p_type = 'ECONOMY' THEN 'electric' ELSE 'fuel' END AS drive FROM part WHERE p_size > 40) m
      ON m.brand = upper(p.p_brand) AND m.model = p.p_type""",
    uses="b_user",
)
def normalised_key(t):
    customers = t.customer.select(F.col("c_custkey").alias("customer_id"))
    domain_map = t.b_user.select(F.col("user_id").alias("customer_id"), F.col("user_id").alias("domain_name"))
    cars = t.part.select(
        (F.col("p_partkey") % 150).alias("domain_name"), F.col("p_partkey").alias("car_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"),
        F.when(F.col("p_size") % 4 == 0, F.col("p_size")).alias("ended_ts"),
    )
    drive = F.when(F.col("p_type") == "ECONOMY", "electric").otherwise("fuel")
    models = t.part.select(F.when(F.col("p_size") > 40, F.lower("p_brand")).alias("brand"), F.col("p_type").alias("model"), drive.alias("drive")).distinct()
    rows = accounts.customer_cars(customers, domain_map, cars, models)
    active = F.when(F.col("car_id").isNotNull(), F.col("car_active"))
    return rows.select("customer_id", F.col("domain_name").alias("domain_id"), "car_id", "drive", active.alias("car_active"))


@register(
    "q_flag_labels",
    """SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'carmanager' END AS role_carmanager, CASE WHEN user_id % 3 = 0 THEN 'admin' END AS role_admin,
    CASE WHEN activated_ts IS NOT NULL THEN 'subscriber' END AS role_subscriber FROM b_user WHERE deleted_ts IS NULL AND NOT user_id % 7 = 0""",
    uses="b_user",
)
def flag_labels(t):
    users = t.b_user.withColumns({
        "is_locked": F.col("user_id") % 7 == 0, "is_carmanager": F.col("user_id") % 2 == 0, "is_admin": F.col("user_id") % 3 == 0,
        "is_subscriber": F.col("activated_ts").isNotNull(),
    })
    return accounts.user_roles(users, {"is_carmanager": "carmanager", "is_admin": "admin", "is_subscriber": "subscriber"})


@register(
    "q_unified_products",
    """SELECT plan_id, plan_id AS product_name, 'hw' || plan_nr % 3 AS product_group, plan_id = 'plan-4-monthly' AS is_one_time, plan_id <> 'plan-4-monthly' AND plan_nr % 3 <> 0 AS is_recurring,
      'monthly' AS billing_frequency, 12 AS duration_mths, plan_nr AS price_net FROM (SELECT DISTINCT plan_id, plan_nr FROM b_product) s
    UNION ALL SELECT product_id, product_name, product_family, product_id = '5', (is_recurring OR is_subsequent_recurring) AND product_id <> '5',
      CASE WHEN monthly_payment THEN 'monthly' ELSE 'yearly' END, CASE WHEN product_name LIKE '%ring%' THEN 36 ELSE 12 END, plan_nr FROM b_product""",
    uses="b_product",
)
def unified_products(t):
    plans = t.b_product.select("plan_id", "plan_nr").distinct()
    billing = plans.select(
        "plan_id", F.col("plan_id").alias("product_name"), F.concat(F.lit("hw"), (F.col("plan_nr") % 3).cast("string")).alias("product_group"),
        F.lit("monthly").alias("billing_frequency"), F.lit(12).alias("duration_mths"), F.col("plan_nr").alias("price_net"),
    )
    shop = t.b_product.select(
        F.col("product_id").alias("plan_id"), "product_name", F.col("product_family").alias("product_group"), F.col("is_recurring").alias("recurring"),
        F.col("is_subsequent_recurring").alias("subsequent_recurring"), "monthly_payment", F.col("plan_nr").alias("price_net"),
    )
    return accounts.unified_products(billing, shop, ["plan-4-monthly", "5"], "hw0", "%ring%")


MARKETING = """SELECT o_custkey % 300 AS user_id, o_orderkey AS customer_id, CASE o_orderkey % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'future' WHEN 3 THEN 'non_renewing' END AS org_status,
    CASE WHEN o_orderkey % 5 = 0 THEN 'B2B' WHEN o_orderkey % 5 = 1 THEN 'B2C' END AS type, CASE WHEN o_orderkey % 7 = 0 THEN 'AT' END AS territory,
    CASE WHEN o_orderkey % 2 = 0 THEN 'com.acme.gb.x' ELSE 'com.acme.de.x' END AS domain, o_orderkey % 4 AS logbook, o_orderkey % 3 AS office FROM {orders}"""


@register(
    "q_user_marketing",
    """SELECT user_id, customer_id, coalesce(type, CASE WHEN main_domain % 3 = 0 THEN 'B2B' ELSE 'B2C' END) AS type,
    coalesce(territory, CASE WHEN domain LIKE '%.gb.%' THEN 'UK' ELSE 'DACH' END) AS territory, coalesce(org_status, CASE WHEN main_domain % 2 = 0 THEN 'active' ELSE 'inactive' END) AS org_status,
    licences_logbook, licences_office, licences_logbook > 0 AS has_logbook, licences_office > 0 AS has_office
    FROM (SELECT r.*, r.user_id % 10 AS main_domain, CAST(coalesce(sum(logbook) FILTER (WHERE org_status IN ('active', 'non_renewing')) OVER (PARTITION BY user_id), 0) AS BIGINT) AS licences_logbook,
      CAST(coalesce(sum(office) FILTER (WHERE org_status IN ('active', 'non_renewing')) OVER (PARTITION BY user_id), 0) AS BIGINT) AS licences_office,
      row_number() OVER (PARTITION BY user_id ORDER BY list_position(['active', 'future', 'non_renewing', 'cancelled', 'inactive'], org_status) NULLS LAST, type NULLS LAST, customer_id) AS n
      FROM marketing r) s WHERE n = 1""",
    extra="marketing AS (" + MARKETING.replace("{orders}", "orders") + ")",
)
def user_marketing(t):
    rows = t.spark.sql(MARKETING, orders=t.orders)
    users = rows.select("user_id").distinct().withColumn("main_domain", F.col("user_id") % 10)
    domains = users.select("main_domain").distinct()
    fleet, active = domains.filter("main_domain % 3 = 0"), domains.filter("main_domain % 2 = 0")
    return accounts.user_marketing_row(rows, users, fleet, active, ["logbook", "office"], ["customer_id"])


@register(
    "q_domain_mrr",
    """SELECT u.domain_name, u.users, c.cars, m.customer_ids, m.current_mrr_eur, coalesce(m.current_mrr_eur >= 200000, FALSE) AS is_large,
      s.* EXCLUDE (domain_name), p.user_id, p.email, p.first_name, p.last_name
    FROM (SELECT domain_id AS domain_name, count(*) FILTER (WHERE deleted_ts IS NULL AND user_id % 7 <> 0) AS users FROM b_user WHERE domain_id % 6 <> 0 GROUP BY 1) u
    JOIN (SELECT domain_id AS domain_name, user_id, 'u' || user_id || '@d' || domain_id AS email, CASE WHEN user_id % 9 <> 0 THEN 'First ' || user_id % 9 END AS first_name, 'Last ' || user_id AS last_name
      FROM b_user WHERE deleted_ts IS NULL AND user_id % 7 <> 0) p ON p.domain_name = u.domain_name
    LEFT JOIN (SELECT user_id % 20 AS domain_name, count(*) FILTER (WHERE event_id % 4 <> 0) AS cars FROM events WHERE event_type = 'view' AND user_id % 20 > 2 GROUP BY 1) c ON c.domain_name = u.domain_name
    LEFT JOIN (SELECT m.domain_id AS domain_name, string_agg(CAST(m.customer_id AS VARCHAR), '; ' ORDER BY CAST(m.customer_id AS VARCHAR)) AS customer_ids, sum(CAST(round(c_acctbal * 100) AS BIGINT)) / 100.0 AS current_mrr_eur
      FROM b_customer m JOIN customer ON c_custkey = m.customer_id WHERE customer_id % 8 <> 0 GROUP BY 1) m ON m.domain_name = u.domain_name
    LEFT JOIN (SELECT DISTINCT user_id AS domain_name, CASE WHEN user_id % 2 = 0 THEN 'fleet' ELSE 'single' END AS domain_customer_type, user_id % 5 <> 0 AS domain_is_active, user_id % 3 = 0 AS match_to_subscription,
      CASE WHEN user_id % 3 = 0 THEN 'fleet' END AS subscription_customer_type, CASE WHEN user_id % 3 = 0 THEN 'active' END AS subscription_customer_status
      FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)) s ON s.domain_name = u.domain_name""",
    uses="b_user b_customer",
    money="current_mrr_eur",
)
def domain_mrr(t):
    users = t.b_user.select(
        F.col("domain_id").alias("domain_name"), "user_id", F.expr("concat('u', user_id, '@d', domain_id)").alias("email"), F.expr("CASE WHEN user_id % 9 <> 0 THEN concat('First ', user_id % 9) END").alias("first_name"),
        F.expr("concat('Last ', user_id)").alias("last_name"), "deleted_ts", (F.col("user_id") % 7 == 0).alias("is_locked"),
    )
    domains = users.select("domain_name").distinct().withColumn("is_test", F.col("domain_name") % 6 == 0)
    cars = t.events.filter("event_type = 'view'").select(
        F.when(F.col("user_id") % 20 > 2, F.col("user_id") % 20).otherwise(-F.col("user_id") - 1).alias("domain_name"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("ended_ts")
    )
    linked = t.b_customer.select(F.col("domain_id").alias("domain_name"), "customer_id", F.when(F.col("customer_id") % 8 == 0, 2).otherwise(1).alias("record_nr"))
    balances = t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").cast("decimal(12,2)").alias("current_mrr_eur"))
    report = t.events.selectExpr(
        "user_id AS domain_name", "CAST(ts AS DATE) AS reporting_date", "IF(user_id % 2 = 0, 'fleet', 'single') AS domain_customer_type", "user_id % 5 <> 0 AS domain_is_active",
        "user_id % 3 = 0 AS match_to_subscription", "IF(user_id % 3 = 0, 'fleet', NULL) AS subscription_customer_type", "IF(user_id % 3 = 0, 'active', NULL) AS subscription_customer_status",
    ).distinct()
    return accounts.domain_mrr(users, domains, cars, linked, balances, report, 200000)


@register(
    "q_left_join",
    """SELECT u.user_id, u.domain_id, coalesce(m.mrr, 0) AS mrr_eur, i.items FROM b_user u
    LEFT JOIN (SELECT o_custkey AS domain_id, count(*) AS mrr FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1) m ON m.domain_id = u.domain_id
    LEFT JOIN (SELECT DISTINCT o_custkey AS domain_id, o_orderstatus AS items FROM orders WHERE o_custkey % 5 <> 0) i ON i.domain_id = u.domain_id""",
    uses="b_user",
)
def left_join(t):
    users = t.b_user.select("user_id", F.col("domain_id").alias("main_domain"))
    revenue = t.orders.groupBy(F.expr("if(o_custkey % 4 <> 0, o_custkey, -o_custkey - 1)").alias("main_domain")).agg(F.count(F.lit(1)).alias("mrr_eur"))
    items = t.orders.select(F.expr("if(o_custkey % 5 <> 0, o_custkey, -o_custkey - 1)").alias("main_domain"), F.col("o_orderstatus").alias("items"))
    rows = accounts.user_items(users, revenue, items)
    return rows.select("user_id", F.col("main_domain").alias("domain_id"), "mrr_eur", "items")


EMAIL = """SELECT customer_id, customer_name, CASE WHEN customer_id % 9 = 0 THEN 'a@web.example' ELSE concat('u', CAST(customer_id AS {text}), '@firm', CAST(customer_id % 200 AS {text}), '.example') END AS email,
    CASE WHEN customer_id % 200 < 50 THEN FALSE WHEN customer_id % 200 < 60 AND customer_id % 2 = 0 THEN NULL ELSE is_fleet END AS is_fleet FROM {b_customer}"""


@register(
    "q_email_domain",
    """SELECT customer_id, customer_name, email, is_fleet, split_part(email, '@', 2) AS email_domain FROM mails WHERE email NOT LIKE '%@web.example'
    AND split_part(email, '@', 2) IN (SELECT split_part(email, '@', 2) FROM mails WHERE email NOT LIKE '%@web.example' AND is_fleet)""",
    uses="b_customer",
    extra="mails AS (" + EMAIL.replace("{text}", "VARCHAR").replace("{b_customer}", "b_customer") + ")",
)
def email_domain(t):
    rows = t.spark.sql(EMAIL.replace("{text}", "STRING"), b_customer=t.b_customer)
    return accounts.email_domain_accounts(rows, ["%@web.example"])


@register(
    "q_string_agg",
    """SELECT o_custkey AS customer_id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS configurations FROM orders GROUP BY o_custkey""",
)
def string_agg(t):
    domain_map = t.orders.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("domain_name"))
    domains = t.orders.select(F.col("o_orderkey").alias("domain_name"), F.col("o_orderpriority").alias("configuration"))
    return accounts.customer_configuration(domain_map, domains)


PIECES_SQL = """SELECT {keys}, CAST((n - 1) // 500 AS INT) AS piece, count(*) AS n_values, string_agg(v, '; ' ORDER BY v) AS "values"
    FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY v) AS n FROM ({source}) s) t GROUP BY 1, 2"""


@register(
    "q_text_list_pieces",
    PIECES_SQL.format(keys="l_returnflag", source="SELECT DISTINCT l_returnflag, CAST(l_orderkey AS VARCHAR) AS v FROM lineitem"),
)
def text_list_pieces(t):
    """The orders of each return flag as a sorted list in pieces: three groups hold all rows."""
    return lists.text_list_pieces(t.lineitem, ["l_returnflag"], "l_orderkey", "; ", piece_values=500, slice_values=2000)


@register(
    "q_customer_list_pieces",
    PIECES_SQL.format(keys="domain_id", source="SELECT domain_id, CAST(customer_id % 97 AS VARCHAR) AS v FROM b_customer"),
    uses="b_customer",
)
def customer_list_pieces(t):
    """Linked customers of each domain as a sorted list in pieces, repeats kept."""
    linked = t.b_customer.select("domain_id", (F.col("customer_id") % 97).alias("number"))
    return lists.text_list_pieces(linked, ["domain_id"], "number", "; ", distinct=False, piece_values=500, slice_values=20)


@register(
    "q_crm_links",
    """SELECT DISTINCT l.l_orderkey AS deal_id, s.s_name AS owner_name, o.o_custkey AS customer_id FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
    JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'A'""",
)
def crm_links(t):
    deals = t.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("deal_id"), F.col("l_suppkey").alias("owner_id"), F.col("l_orderkey").alias("invoice_id"))
    owners = t.supplier.select(F.col("s_suppkey").alias("owner_id"), F.col("s_name").alias("owner_name"))
    lines = t.orders.select(F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("customer_id"))
    return accounts.crm_deals(deals, owners, lines)


@register(
    "q_crm_contacts",
    """SELECT s.s_suppkey AS contact_id, s.s_nationkey AS email, n.n_name AS account_name, string_agg(CAST(c.c_custkey AS VARCHAR), ', ' ORDER BY CAST(c.c_custkey AS VARCHAR)) AS customer_ids
    FROM supplier s JOIN nation n ON n.n_nationkey = s.s_suppkey % 25 JOIN customer c ON c.c_nationkey = s.s_nationkey GROUP BY 1, 2, 3""",
)
def crm_contacts(t):
    contacts = t.supplier.select(F.col("s_suppkey").alias("contact_id"), F.col("s_nationkey").alias("email"), (F.col("s_suppkey") % 25).alias("n"))
    names = t.nation.select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("account_name"))
    links = contacts.select("contact_id", "n").join(names, "n").select("contact_id", "account_name")
    customers = t.customer.select(F.col("c_nationkey").alias("email"), F.col("c_custkey").alias("customer_id"))
    return accounts.crm_contacts(contacts.drop("n"), links, customers)


@register(
    "q_agg_filter",
    """SELECT c_custkey AS domain_name, count(o_orderkey) AS cars_created, count(o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS cars_active
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment <> 'HOUSEHOLD' GROUP BY c_custkey""",
)
def agg_filter(t):
    domains = t.customer.select(F.col("c_custkey").alias("domain_name"), (F.col("c_mktsegment") == "HOUSEHOLD").alias("is_test"))
    cars = t.orders.select(
        F.col("o_custkey").alias("domain_name"), F.col("o_orderkey").alias("car_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("ended_ts")
    )
    return accounts.car_counts(domains, cars)
