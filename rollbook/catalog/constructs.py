"""Scans, filters, joins, aggregates, windows, sets, scalar functions and JSON on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates, json, numbers, text
from ..operators import aggregates as agg
from ..operators import filters, intervals, items, joins, keyed, ordered, sets, snapshots
from ..plans.features import reshape
from ..session import shared_folder
from ..sources import export_layout, high_water_mark, incremental_slice, load_csv, staged_projection
from ..sources.export import ExportColumn
from .base import register

AS_OF = "2000-01-01"  # for order dates
EVENT_AS_OF = "2024-01-31 00:00:00"  # for event times

# ---------------------------------------------------------------- scans, sources, sinks


@register("q_scan_region", "SELECT r_regionkey, r_name FROM region")
def scan_region(t):
    return t.region.select("r_regionkey", "r_name")


@register("q_scan_delimited", "SELECT c_custkey, c_name, c_mktsegment, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer")
def scan_delimited(t):
    """The customers as a delimited file with a header, read back with their stated schema."""
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    path = f"{shared_folder(t.spark)}/customers-{uuid.uuid4().hex}"
    rows.write.csv(path, sep=";", header=True)
    return load_csv(t.spark, path, rows.schema, ";")


@register("q_drop_columns", "SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment FROM customer")
def drop_columns(t):
    """Columns left out by name and by pattern, the rest renamed."""
    return reshape(t.customer, drop=["c_acctbal"], drop_like="key$", keep=["c_custkey"], rename={"c_custkey": "customer_id", "c_name": "customer_name", "c_mktsegment": "segment"})


@register(
    "q_staged_events",
    "SELECT event_id AS evt_insert_id, ts AS evt_ts, user_id AS evt_user_id, event_type AS evt_type, value AS evt_value FROM events",
)
def staged_events(t):
    names = {"event_id": "evt_insert_id", "ts": "evt_ts", "user_id": "evt_user_id", "event_type": "evt_type", "value": "evt_value"}
    return staged_projection(t.events, names)


@register("q_incremental_slice", "SELECT event_id, user_id, event_type FROM events WHERE event_id BETWEEN 1000 AND 4999")
def incremental(t):
    return incremental_slice(t.events, "event_id", 1000, 4999).select("event_id", "user_id", "event_type")


@register("q_high_water_mark", "SELECT max(event_id) AS high_water_mark FROM events WHERE event_type = 'purchase'")
def water_mark(t):
    return high_water_mark(t.events, "event_id", event_type="purchase")


@register(
    "q_export_layout",
    """SELECT o_orderkey AS "subscription[id]", strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "subscription[started_at]",
    o_orderstatus AS "subscription[status]", 28 AS "contract_term[cancellation_cutoff_period]",
    CAST(NULL AS VARCHAR) AS "subscription[po_number]" FROM orders""",
)
def export(t):
    layout = [
        ExportColumn("subscription[id]", "o_orderkey"),
        ExportColumn("subscription[started_at]", "o_orderdate", as_timestamp=True),
        ExportColumn("subscription[status]", "o_orderstatus"),
        ExportColumn("contract_term[cancellation_cutoff_period]", constant=28),
        ExportColumn("subscription[po_number]"),
        ExportColumn("subscription[po_number]"),
    ]
    return export_layout(t.orders, layout)


# ---------------------------------------------------------------- filters


@register("q_in_list", "SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber NOT IN (1, 7)")
def in_list(t):
    keep = F.col("l_returnflag").isin("A", "R") & ~F.col("l_linenumber").isin(1, 7)
    return t.lineitem.filter(keep).select("l_orderkey", "l_partkey", "l_returnflag")


@register(
    "q_like_ilike",
    r"""SELECT p_partkey, p_name, p_type FROM part
    WHERE (p_name ILIKE '%RING%' OR p_name ILIKE 'blue%') AND p_name NOT LIKE 'small%' AND p_type NOT LIKE '%\_%' ESCAPE '\'""",
)
def like_ilike(t):
    keep = text.like_any(F.col("p_name"), ["%RING%", "blue%"], ignore_case=True)
    keep &= ~F.col("p_name").like("small%") & ~text.like_any(F.col("p_type"), [r"%\_%"])
    return t.part.filter(keep).select("p_partkey", "p_name", "p_type")


@register(
    "q_regex_match",
    "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^HTTPS?://M[.]', 'i') AND NOT regexp_matches(url, '[0-9]$')",
)
def regex_match(t):
    return t.pages.filter(F.col("url").rlike("(?i)^HTTPS?://M[.]") & ~F.col("url").rlike("[0-9]$")).select("page_id", "url")


@register(
    "q_between",
    """SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00'""",
)
def between(t):
    inside = F.col("o_orderdate").between(dates.moment("1997-01-01 00:00:00"), dates.moment("1997-12-31 00:00:00"))
    return t.orders.filter(inside).select("o_orderkey", "o_totalprice")


@register(
    "q_null_predicates",
    """SELECT user_id, activated_ts IS NULL AS not_activated, deleted_ts IS NOT NULL AS deleted,
    (activated_ts > created_ts) IS TRUE AS later FROM b_user""",
    uses="b_user",
)
def null_predicates(t):
    return t.b_user.select(
        "user_id",
        F.col("activated_ts").isNull().alias("not_activated"),
        F.col("deleted_ts").isNotNull().alias("deleted"),
        (F.col("activated_ts") > F.col("created_ts")).eqNullSafe(F.lit(True)).alias("later"),
    )


@register(
    "q_null_safe_exclude",
    "SELECT contract_id, canceled_dt FROM b_contract WHERE coalesce(canceled_dt, DATE '1900-01-01') <> DATE '1997-03-01'",
    uses="b_contract",
    dates="canceled_dt",
)
def null_safe_exclude(t):
    cut = t.b_contract.select("contract_id", "canceled_dt")
    return filters.exclude_value(cut, "canceled_dt", dates.day("1997-03-01"))


@register(
    "q_running_at",
    f"SELECT contract_id, plan_id FROM b_contract WHERE started_dt <= DATE '{AS_OF}' AND period_end_dt > DATE '{AS_OF}'",
    uses="b_contract",
)
def running_at(t):
    return filters.running_at(t.b_contract, "started_dt", "period_end_dt", AS_OF).select("contract_id", "plan_id")


@register(
    "q_running_or_ending",
    f"""SELECT contract_id, period_end_dt FROM b_contract WHERE (started_dt <= DATE '{AS_OF}' AND period_end_dt > DATE '{AS_OF}')
    OR started_dt < DATE '{AS_OF}' AND period_end_dt >= DATE '{AS_OF}'""",
    uses="b_contract",
    dates="period_end_dt",
)
def running_or_ending(t):
    return filters.running_or_ending(t.b_contract, "started_dt", "period_end_dt", AS_OF).select("contract_id", "period_end_dt")


@register("q_lookback", "SELECT event_id, event_type FROM events WHERE ts >= DATE '2024-01-31' - INTERVAL '7' DAY")
def lookback(t):
    return filters.lookback(t.events, "ts", "2024-01-31", 7).select("event_id", "event_type")


@register(
    "q_exclude_test",
    """SELECT c_custkey, c_name FROM customer WHERE c_name NOT IN ('Customer#000000001', 'Customer#000000002')
    AND c_name NOT LIKE '%00' AND c_name NOT LIKE '%#0000001%'""",
)
def exclude_test(t):
    kept = filters.exclude_test_accounts(
        t.customer, "c_name", ["Customer#000000001", "Customer#000000002"], ["%00", "%#0000001%"]
    )
    return kept.select("c_custkey", "c_name")


# ---------------------------------------------------------------- joins


@register(
    "q_inner_join",
    """SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN nation n ON n.n_nationkey = c.c_nationkey""",
)
def inner_join(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select("o_orderkey", "c_name", "n_name")


@register(
    "q_exists_flag",
    """SELECT c.c_custkey, u.o_custkey IS NOT NULL AS has_urgent FROM customer c
    LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') u ON u.o_custkey = c.c_custkey""",
)
def exists_flag(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return joins.flag_exists(t.customer.select("c_custkey"), urgent, ["c_custkey"], "has_urgent")


@register(
    "q_semi_join",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
)
def semi_join(t):
    rich = t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(rich, "c_custkey", "left_semi").select("c_custkey", "c_name")


@register(
    "q_anti_join",
    "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)",
)
def anti_join(t):
    with_lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(with_lines, "o_orderkey", "left_anti")


@register(
    "q_date_spine",
    """SELECT d.date_key, count(*) AS running_contracts, count(DISTINCT c.customer_id) AS running_customers
    FROM (SELECT CAST(range AS DATE) AS date_key FROM range(DATE '1999-01-01', DATE '2000-01-01', INTERVAL 1 DAY)) d
    JOIN b_contract c ON c.started_dt <= d.date_key AND c.period_end_dt > d.date_key GROUP BY d.date_key""",
    uses="b_contract",
    dates="date_key",
)
def date_spine(t):
    return intervals.open_per_day(t.b_contract, "customer_id", "started_dt", "period_end_dt", "1999-01-01", "1999-12-31", "running_contracts", "running_customers")


VALIDITY_SQL = f"""validity AS (SELECT car_id, odometer_km, reading_id, reading_ts AS valid_from,
    coalesce(lead(reading_ts) OVER (PARTITION BY car_id ORDER BY reading_ts, reading_id), TIMESTAMP '{EVENT_AS_OF}') AS valid_until
    FROM b_reading)"""
MATCH_SQL = """t.trip_start_ts + INTERVAL '3' MINUTE >= v.valid_from AND t.trip_start_ts + INTERVAL '3' MINUTE < v.valid_until
    AND t.trip_end_ts - INTERVAL '3' MINUTE >= v.valid_from AND t.trip_end_ts - INTERVAL '3' MINUTE < v.valid_until"""


def reading_validity(t):
    return ordered.validity_intervals(
        t.b_reading, ["car_id"], "reading_ts", ["reading_id"], dates.time_slice(F.col("reading_ts")), dates.moment(EVENT_AS_OF)
    )


@register(
    "q_interval_join",
    f"""SELECT t.trip_id, t.car_id, v.reading_id, v.odometer_km FROM b_trip t JOIN validity v ON v.car_id = t.car_id AND {MATCH_SQL}""",
    uses="b_trip b_reading",
    extra=VALIDITY_SQL,
)
def interval_join(t):
    inside = intervals.contains_with_tolerance(
        F.col("trip_start_ts"), F.col("trip_end_ts"), F.col("valid_from"), F.col("valid_until"), 3
    )
    probe = dates.shift_minutes(F.col("trip_start_ts"), 3)
    joined = intervals.interval_join(t.b_trip, reading_validity(t), "car_id", inside, probe)
    return joined.select("trip_id", "car_id", "reading_id", "odometer_km")


@register(
    "q_asof_reading",
    """SELECT t.trip_id, t.car_id, r.reading_id, r.odometer_km FROM b_trip t ASOF LEFT JOIN
    (SELECT car_id, reading_ts, max(reading_id) AS reading_id, max_by(odometer_km, reading_id) AS odometer_km FROM b_reading GROUP BY 1, 2) r
    ON r.car_id = t.car_id AND r.reading_ts <= t.trip_start_ts""",
    uses="b_trip b_reading",
)
def asof_reading(t):
    joined = ordered.latest_before(t.b_trip, t.b_reading, ["car_id"], F.col("trip_start_ts"), "reading_ts", ["reading_id"])
    return joined.select("trip_id", "car_id", "reading_id", "odometer_km")


@register(
    "q_scalar_cross",
    """SELECT a.cars - b.returned AS net_cars FROM (SELECT count(DISTINCT o_custkey) AS cars FROM orders) a
    JOIN (SELECT count(*) AS returned FROM lineitem WHERE l_returnflag = 'R') b ON 1 = 1""",
)
def scalar_cross(t):
    cars = t.orders.agg(F.count_distinct("o_custkey").alias("cars"))
    returned = t.lineitem.filter("l_returnflag = 'R'").agg(F.count(F.lit(1)).alias("returned"))
    return cars.crossJoin(returned).select((F.col("cars") - F.col("returned")).alias("net_cars"))


@register("q_composed_key", "SELECT o_orderkey, o_orderkey || '_' || o_orderpriority AS contract_plan FROM orders")
def composed_key(t):
    key = F.concat(F.col("o_orderkey").cast("string"), F.lit("_"), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", key.alias("contract_plan"))


ZERO_KEY = "00000000-0000-0000-0000-000000000000"


@register(
    "q_sentinel_key",
    f"""SELECT CASE product_id WHEN 'fake' THEN '{ZERO_KEY}' ELSE product_id END AS repaired, nullif(product_id, 'fake') AS nulled,
    count(*) AS n FROM b_item GROUP BY 1, 2""",
    uses="b_item",
)
def sentinel_key(t):
    key = F.col("product_id")
    return (
        t.b_item.groupBy(joins.repair_key(key, "fake", ZERO_KEY).alias("repaired"), joins.repair_key(key, "fake").alias("nulled"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "q_rows_at_max",
    """SELECT r.customer_id, r.reporting_month, r.product_group FROM b_report r
    JOIN (SELECT customer_id, max(reporting_month) AS last_month FROM b_report GROUP BY customer_id) m
    ON m.customer_id = r.customer_id AND m.last_month = r.reporting_month""",
    uses="b_report",
    dates="reporting_month",
)
def rows_at_max(t):
    report = t.b_report.select("customer_id", "reporting_month", "product_group")
    return keyed.rows_at_max(report, ["customer_id"], "reporting_month")


@register(
    "q_latest_snapshot",
    "SELECT customer_id, product_group, reporting_month FROM b_report WHERE reporting_month = (SELECT max(reporting_month) FROM b_report)",
    uses="b_report",
    dates="reporting_month",
)
def latest_snapshot(t):
    return keyed.latest_snapshot(t.b_report.select("customer_id", "product_group", "reporting_month"), "reporting_month")


@register(
    "q_explode_lookup",
    """SELECT i.contract_id, p.plan_id, p.monthly_payment, max(i.amount) AS unit_net_cents, sum(i.quantity) AS item_quantity
    FROM b_item i JOIN b_product p ON p.product_id = i.product_id GROUP BY i.contract_id, p.plan_id, p.monthly_payment""",
    uses="b_item b_product",
)
def explode_lookup(t):
    rows = items.explode_items(t.b_contract_items, "items")
    lookup = t.b_product.select("product_id", "plan_id", "monthly_payment")
    return (
        rows.join(lookup, "product_id")
        .groupBy("contract_id", "plan_id", "monthly_payment")
        .agg(F.max("unit_net_cents").alias("unit_net_cents"), F.sum("quantity").alias("item_quantity"))
    )


@register(
    "q_lateral_agg",
    """SELECT c.contract_id, s.devices FROM (SELECT DISTINCT contract_id FROM b_item) c LEFT JOIN
    (SELECT i.contract_id, sum(i.quantity) AS devices FROM b_item i JOIN b_product p ON p.product_id = i.product_id AND p.counts_device
     GROUP BY i.contract_id) s ON s.contract_id = c.contract_id""",
    uses="b_item b_product",
)
def lateral_agg(t):
    devices = t.b_product.filter("counts_device").select("product_id")
    out = items.agg_items(t.b_contract_items, "contract_id", "items", devices, F.sum("quantity").alias("devices"))
    return out.select("contract_id", "devices")


@register(
    "q_preagg_join",
    """SELECT o.o_orderkey, coalesce(r.refund_cents, 0) AS refund_cents FROM orders o LEFT JOIN
    (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS refund_cents
     FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) r ON r.l_orderkey = o.o_orderkey""",
)
def preagg_join(t):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    refunds = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(cents).alias("refund_cents"))
    joined = t.orders.select("o_orderkey").join(refunds, "o_orderkey", "left")
    return joined.select("o_orderkey", F.coalesce("refund_cents", F.lit(0)).alias("refund_cents"))


@register(
    "q_two_grain",
    """SELECT m.customer_id, m.yr, m.reporting_month, m.month_licenses, y.year_licenses FROM
    (SELECT customer_id, year(reporting_month) AS yr, reporting_month, CAST(sum(licenses) AS BIGINT) AS month_licenses FROM b_report GROUP BY 1, 2, 3) m
    JOIN (SELECT customer_id, year(reporting_month) AS yr, CAST(sum(licenses) AS BIGINT) AS year_licenses FROM b_report GROUP BY 1, 2) y
    ON y.customer_id = m.customer_id AND y.yr = m.yr""",
    uses="b_report",
    dates="reporting_month",
)
def two_grain(t):
    report = t.b_report.withColumn("yr", F.year("reporting_month"))
    return joins.two_grain(
        report, ["customer_id", "yr", "reporting_month"], ["customer_id", "yr"],
        F.sum("licenses").alias("month_licenses"), F.sum("month_licenses").alias("year_licenses"),
    )


# ---------------------------------------------------------------- aggregates


@register(
    "q_group_basic",
    """SELECT is_fleet, country, count(*) AS customers, min(customer_id) AS first_id, max(customer_id) AS last_id,
    CAST(sum(domain_id) AS BIGINT) AS cars FROM b_customer WHERE customer_status = 'active' GROUP BY is_fleet, country""",
    uses="b_customer",
)
def group_basic(t):
    return t.b_customer.filter("customer_status = 'active'").groupBy("is_fleet", "country").agg(
        F.count(F.lit(1)).alias("customers"), F.min("customer_id").alias("first_id"),
        F.max("customer_id").alias("last_id"), F.sum("domain_id").alias("cars"),
    )


@register(
    "q_count_distinct",
    """SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE value > 50) AS big_users
    FROM events GROUP BY event_type""",
)
def count_distinct(t):
    return t.events.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("big_users")
    )


@register(
    "q_priority_status",
    """SELECT customer_id, CASE WHEN bool_or(status = 'active') THEN 'active' WHEN bool_or(status = 'canceled') THEN 'canceled'
    WHEN bool_or(status = 'terminated') THEN 'terminated' END AS status FROM b_contract GROUP BY customer_id""",
    uses="b_contract",
)
def priority_status(t):
    status = agg.priority_status(F.col("status"), ["active", "canceled", "terminated"])
    return t.b_contract.groupBy("customer_id").agg(status.alias("status"))


@register(
    "q_has_value",
    """SELECT o_custkey, coalesce(bool_or(o_orderpriority = '1-URGENT'), FALSE) AS has_urgent,
    coalesce(bool_or(o_orderpriority = '5-LOW') FILTER (WHERE o_orderstatus = 'F'), FALSE) AS has_low_final FROM orders GROUP BY o_custkey""",
)
def has_value(t):
    priority = F.col("o_orderpriority")
    return t.orders.groupBy("o_custkey").agg(
        agg.has_value(priority, "1-URGENT").alias("has_urgent"),
        agg.has_value(priority, "5-LOW", F.col("o_orderstatus") == "F").alias("has_low_final"),
    )


@register(
    "q_any_true",
    """SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE b) > 0 THEN TRUE WHEN count(*) FILTER (WHERE b IS NULL) > 0 THEN NULL
    ELSE FALSE END AS any_flag FROM (SELECT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN TRUE
    WHEN o_orderpriority <> '5-LOW' THEN FALSE END AS b FROM orders) s GROUP BY o_custkey""",
)
def any_true(t):
    flag = F.when(F.col("o_orderpriority") == "1-URGENT", True).when(F.col("o_orderpriority") != "5-LOW", False)
    return t.orders.select("o_custkey", flag.alias("b")).groupBy("o_custkey").agg(agg.any_true(F.col("b")).alias("any_flag"))


@register(
    "q_bool_or",
    """SELECT l_orderkey, bool_or(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity > 10 THEN TRUE ELSE FALSE END) AS is_sold
    FROM lineitem GROUP BY l_orderkey""",
)
def bool_or(t):
    sold = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 10)
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_or(sold).alias("is_sold"))


@register("q_having", "SELECT user_id, count(*) AS bookings FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) >= 2")
def having(t):
    counts = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("bookings"))
    return counts.filter("bookings >= 2")


@register("q_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct(t):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


LINE_ORDER = "l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"


@register(
    "q_distinct_on",
    f"""SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem
    ORDER BY l_orderkey, l_linenumber, {LINE_ORDER}""",
)
def distinct_on(t):
    order = [F.expr(c.replace(" DESC", "")).desc() if "DESC" in c else F.col(c) for c in LINE_ORDER.split(", ")]
    latest = keyed.latest_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], order)
    return latest.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@register(
    "q_ratio",
    """SELECT l_suppkey, CASE WHEN d = 0 THEN NULL ELSE CAST(((2 * n * 100 + d) // (2 * d)) AS DOUBLE) / 100 END AS pct_returned
    FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n, count(*) FILTER (WHERE l_linenumber < 7) AS d
    FROM lineitem GROUP BY l_suppkey) s""",
    money="pct_returned",
)
def ratio(t):
    returned, base = agg.count_if(F.col("l_returnflag") == "R"), agg.count_if(F.col("l_linenumber") < 7)
    return t.lineitem.groupBy("l_suppkey").agg(numbers.ratio(returned, base).alias("pct_returned"))


@register(
    "q_pivot_sum",
    """SELECT customer_id, coalesce(sum(net_cents) FILTER (WHERE product_group = 'ECONOMY'), 0)::BIGINT AS economy,
    coalesce(sum(net_cents) FILTER (WHERE product_group = 'STANDARD'), 0)::BIGINT AS standard,
    coalesce(sum(net_cents) FILTER (WHERE product_group NOT IN ('ECONOMY', 'STANDARD')), 0)::BIGINT AS rest
    FROM b_invoice_line GROUP BY customer_id""",
    uses="b_invoice_line",
)
def pivot_sum(t):
    return agg.pivot_sum(
        t.b_invoice_line, ["customer_id"], "product_group", {"ECONOMY": "economy", "STANDARD": "standard"}, "net_cents", "rest"
    )


@register("q_uniqueness", "SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS distinct_keys FROM lineitem")
def uniqueness(t):
    return keyed.uniqueness(t.lineitem, "l_orderkey")


# ---------------------------------------------------------------- windows


@register(
    "q_latest_row",
    """SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
    FROM events WHERE event_type <> 'error') s WHERE n = 1""",
)
def latest_row(t):
    cut = t.events.filter("event_type <> 'error'").select("user_id", "event_id", "event_type", "ts")
    return keyed.latest_per_key(cut, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])


@register(
    "q_duplicates",
    """SELECT domain_key, domain_name, version_nr FROM (SELECT *, row_number() OVER (PARTITION BY domain_name, version_nr ORDER BY domain_key) AS n
    FROM b_scd2) s WHERE n > 1""",
    uses="b_scd2",
)
def duplicates(t):
    return keyed.duplicates(t.b_scd2.select("domain_key", "domain_name", "version_nr"), ["domain_name", "version_nr"], ["domain_key"])


@register(
    "q_rank_ties",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS r
    FROM orders) s WHERE r = 1""",
)
def rank_ties(t):
    return keyed.top_rank(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus")


@register(
    "q_global_top",
    "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC, p_type DESC) AS r FROM part) s WHERE r = 1",
)
def global_top(t):
    ranked = t.part.select("p_partkey", "p_size", F.struct("p_size", "p_type").alias("best"))
    return keyed.rows_at_max(ranked, [], "best").drop("best")


@register("q_validity", "SELECT car_id, reading_id, odometer_km, valid_from, valid_until FROM validity", uses="b_reading", extra=VALIDITY_SQL)
def validity(t):
    return reading_validity(t).select("car_id", "reading_id", "odometer_km", "valid_from", "valid_until")


@register(
    "q_event_pairs",
    """SELECT user_id, ts AS from_ts, until_ts, CAST(extract(microsecond FROM until_ts - ts) AS DOUBLE) / 1000000 AS second_field,
    CAST(epoch_us(until_ts) - epoch_us(ts) AS DOUBLE) / 1000000 AS true_seconds FROM (SELECT user_id, ts, event_type,
    lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until_ts,
    lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until_type
    FROM events WHERE event_type IN ('view', 'click')) s WHERE event_type = 'view' AND until_type = 'click'""",
)
def event_pairs(t):
    cut = t.events.select("user_id", "ts", "event_type", "event_id")
    pairs = ordered.event_pairs(cut, ["user_id"], "ts", "event_type", ["event_id"], dates.time_slice(F.col("ts")), "view", "click")
    return pairs.select(
        "user_id", F.col("ts").alias("from_ts"), "until_ts",
        dates.second_field(F.col("until_ts"), F.col("ts")).alias("second_field"),
        dates.seconds_between(F.col("until_ts"), F.col("ts")).alias("true_seconds"),
    )


@register(
    "q_partition_total",
    """SELECT contract_id, customer_id, min(started_dt) OVER (PARTITION BY customer_id) AS first_dt,
    max(period_end_dt) OVER (PARTITION BY customer_id) AS last_dt,
    CAST(sum(quantity) OVER (PARTITION BY customer_id) AS BIGINT) AS total_quantity FROM b_contract""",
    uses="b_contract",
    dates="first_dt last_dt",
)
def partition_total(t):
    totals = keyed.with_totals(
        t.b_contract, ["customer_id"], first_dt=F.min("started_dt"), last_dt=F.max("period_end_dt"), total_quantity=F.sum("quantity")
    )
    return totals.select("contract_id", "customer_id", "first_dt", "last_dt", "total_quantity")


@register(
    "q_window_filter",
    """SELECT contract_id, min(started_dt) FILTER (WHERE plan_id LIKE '%monthly%') OVER (PARTITION BY customer_id) AS first_monthly_dt
    FROM b_contract""",
    uses="b_contract",
    dates="first_monthly_dt",
)
def window_filter(t):
    first = F.min(F.when(F.col("plan_id").like("%monthly%"), F.col("started_dt")))
    return keyed.with_totals(t.b_contract, ["customer_id"], first_monthly_dt=first).select("contract_id", "first_monthly_dt")


@register(
    "q_running_sum",
    "SELECT trip_id, car_id, CAST(sum(distance_m) OVER (PARTITION BY car_id ORDER BY trip_start_ts) AS BIGINT) AS rolling_m FROM b_trip",
    uses="b_trip",
)
def running_sum(t):
    slices = dates.time_slice(F.col("trip_start_ts"))
    cut = t.b_trip.select("trip_id", "car_id", "trip_start_ts", "distance_m")
    return ordered.ordered(cut, ["car_id"], ["trip_start_ts"], slices, running={"rolling_m": "distance_m"}).select("trip_id", "car_id", "rolling_m")


@register(
    "q_first_value",
    """SELECT DISTINCT c_nationkey, first_value(c_mktsegment) OVER w AS segment, first_value(c_name) OVER w AS name
    FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)""",
)
def first_value(t):
    cut = t.customer.withColumns({"segment": F.col("c_mktsegment"), "name": F.col("c_name")})
    return keyed.first_value(cut, ["c_nationkey"], ["segment", "name"], ["c_acctbal", "c_custkey"])


HOST_SQL = "split_part(split_part(url, '/', 3), ':', 1)"


@register(
    "q_count_rollup",
    f"""SELECT DISTINCT host, main_domain, pages FROM (SELECT {HOST_SQL} AS host, {HOST_SQL}[strpos({HOST_SQL}, '.') + 1:] AS main_domain,
    count(*) OVER (PARTITION BY {HOST_SQL}[strpos({HOST_SQL}, '.') + 1:]) AS pages FROM pages) s""",
)
def count_rollup(t):
    host = F.split_part(F.split_part(F.col("url"), F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1))
    hosts = t.pages.select(host.alias("host")).withColumn("main_domain", F.expr("substr(host, instr(host, '.') + 1)"))
    counted = agg.count_over_rollup(hosts, F.col("main_domain"), "pages")
    return counted.select("host", "main_domain", "pages").distinct()


@register(
    "q_window_any_in",
    """SELECT contract_id, bool_or(status IN ('active', 'canceled')) OVER (PARTITION BY customer_id) AS customer_is_live,
    status = 'terminated' AND bool_or(status IN ('active', 'canceled')) OVER (PARTITION BY customer_id) AS excluded FROM b_contract""",
    uses="b_contract",
)
def window_any_in(t):
    live = F.bool_or(F.col("status").isin("active", "canceled"))
    marked = keyed.with_totals(t.b_contract, ["customer_id"], customer_is_live=live)
    excluded = (F.col("status") == "terminated") & F.col("customer_is_live")
    return marked.select("contract_id", "customer_is_live", excluded.alias("excluded"))


@register(
    "q_threshold_crossing",
    """SELECT domain_id, min(created_ts) FILTER (WHERE n > 8) AS reached_ts FROM (SELECT domain_id, created_ts,
    row_number() OVER (PARTITION BY domain_id ORDER BY created_ts, user_id) AS n FROM b_user) s GROUP BY domain_id""",
    uses="b_user",
)
def threshold_crossing(t):
    slices = dates.time_slice(F.col("created_ts"))
    return ordered.crossing_time(t.b_user, ["domain_id"], "created_ts", ["user_id"], slices, F.lit(10) * 0.8, "reached_ts")


# ---------------------------------------------------------------- sort, limit, sets


@register(
    "q_custom_order",
    """SELECT customer_id, contract_id, status FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
    ORDER BY list_position(['terminated', 'active'], status) NULLS LAST, contract_id) AS n FROM b_contract) s WHERE n = 1""",
    uses="b_contract",
)
def custom_order(t):
    order = [keyed.order_by_list(F.col("status"), ["terminated", "active"]), F.col("contract_id")]
    return keyed.latest_per_key(t.b_contract, ["customer_id"], order).select("customer_id", "contract_id", "status")


@register("q_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(10)


@register("q_union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    customers = t.customer.select(F.col("c_nationkey").alias("nationkey"))
    return customers.union(t.supplier.select("s_nationkey")).distinct()


@register(
    "q_union_tagged",
    """SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_nationkey AS nationkey FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey FROM supplier""",
)
def union_tagged(t):
    pick = lambda df, p, key: df.select(F.col(f"{p}_{key}").alias("id"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("nationkey"))
    return sets.union_tagged("source", {"customer": pick(t.customer, "c", "custkey"), "supplier": pick(t.supplier, "s", "suppkey")})


@register(
    "q_union_fallback",
    """SELECT o_custkey AS customer_id, TRUE AS had_order FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') s
    UNION ALL SELECT c_custkey, FALSE FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'F' AND o.o_custkey = c.c_custkey)""",
)
def union_fallback(t):
    final = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("customer_id")).distinct()
    everyone = t.customer.select(F.col("c_custkey").alias("customer_id"))
    return sets.union_fallback(final.withColumn("had_order", F.lit(True)), everyone.withColumn("had_order", F.lit(False)), ["customer_id"])


# ---------------------------------------------------------------- scalar functions


@register(
    "q_str_case_trim",
    """SELECT p_partkey, lower(p_brand) AS lowered, upper(p_name) AS uppered, trim('  ' || p_name || ' ') AS trimmed,
    lower(rtrim(p_name || '..', '.')) AS no_dots FROM part""",
)
def str_case_trim(t):
    name = F.col("p_name")
    return t.part.select(
        "p_partkey", F.lower("p_brand").alias("lowered"), F.upper(name).alias("uppered"),
        F.btrim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        text.domain_name(F.concat(name, F.lit(".."))).alias("no_dots"),
    )


@register(
    "q_str_parts",
    """SELECT p_partkey, split_part(p_brand, '#', 2) AS brand_nr, left(p_name, 3) AS head, substr(p_name, 2, 4) AS middle,
    strpos(p_name, ' ') AS blank_at, length(p_name) AS chars, substr(p_name, 1, length(p_name) - 1) AS but_last FROM part""",
)
def str_parts(t):
    return t.part.select(
        "p_partkey", F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).alias("brand_nr"), F.left(F.col("p_name"), F.lit(3)).alias("head"),
        F.substr(F.col("p_name"), F.lit(2), F.lit(4)).alias("middle"), F.instr("p_name", " ").cast("bigint").alias("blank_at"),
        F.length("p_name").cast("bigint").alias("chars"), F.expr("substr(p_name, 1, length(p_name) - 1)").alias("but_last"),
    )


@register(
    "q_str_concat",
    """SELECT o_orderkey, o_orderpriority || '/' || nullif(o_orderstatus, 'P') AS strict,
    concat_ws('/', o_orderpriority, nullif(o_orderstatus, 'P')) AS lenient FROM orders""",
)
def str_concat(t):
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return t.orders.select(
        "o_orderkey", F.concat("o_orderpriority", F.lit("/"), status).alias("strict"), F.concat_ws("/", "o_orderpriority", status).alias("lenient")
    )


CLEAN_SQL = r"regexp_replace(text, '[\t\n\r\x{00a0}\x{180e}\x{2007}\x{200b}-\x{200f}\x{202f}\x{2060}\x{feff}]', '', 'g')"


@register("q_clean_text", f"SELECT doc_id, md5({CLEAN_SQL}) AS digest, length({CLEAN_SQL}) AS chars FROM documents")
def clean_text(t):
    cleaned = text.clean_text(F.col("text"))
    return t.documents.select("doc_id", F.md5(cleaned).alias("digest"), F.length(cleaned).cast("bigint").alias("chars"))


@register(
    "q_split_address",
    """SELECT doc_id, md5(CASE WHEN regexp_matches(text, '^([0-9]|$)') THEN text ELSE regexp_extract(text, '^[^0-9]*') END) AS street,
    md5(CASE WHEN regexp_matches(text, '^([0-9]|$)') OR NOT regexp_matches(text, '[0-9]') THEN NULL
    ELSE regexp_extract(text, '[0-9].*', 0, 's') END) AS house_number FROM documents""",
)
def split_address(t):
    raw = F.col("text")
    return t.documents.select("doc_id", F.md5(text.street_of(raw)).alias("street"), F.md5(text.house_number_of(raw)).alias("house_number"))


@register(
    "q_full_match",
    r"""SELECT p_partkey, CASE WHEN regexp_full_match(split_part(p_brand, '#', 2), '[0-9\s+.\-]*') THEN split_part(p_brand, '#', 2) END AS brand_nr,
    CASE WHEN regexp_full_match(p_name, '[0-9\s+.\-]*') THEN p_name END AS name_nr FROM part""",
)
def full_match(t):
    number = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2))
    return t.part.select("p_partkey", text.phone_number(number).alias("brand_nr"), text.phone_number(F.col("p_name")).alias("name_nr"))


@register(
    "q_to_char",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp,
    CASE WHEN o_orderkey <= 99999 THEN lpad(CAST(o_orderkey AS VARCHAR), 5, '0') END AS padded FROM orders""",
)
def to_char(t):
    return t.orders.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"), text.postal_code(F.col("o_orderkey").cast("string")).alias("padded")
    )


@register("q_md5", "SELECT doc_id, md5(text) AS digest FROM documents")
def md5(t):
    return t.documents.select("doc_id", F.md5("text").alias("digest"))


# Spring and autumn clock changes do not fall into the event month, so Berlin is one hour ahead of UTC throughout.
@register(
    "q_local_date",
    "SELECT event_id, CAST(ts + INTERVAL '1' HOUR AS DATE) AS local_dt FROM events",
    dates="local_dt",
)
def local_date(t):
    return t.events.select("event_id", dates.local_date(F.col("ts")).alias("local_dt"))


@register(
    "q_date_trunc",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_dt, CAST(date_trunc('year', o_orderdate) AS DATE) AS year_dt,
    CAST(date_trunc('day', o_orderdate) AS DATE) AS day_dt FROM orders""",
    dates="month_dt year_dt day_dt",
)
def date_trunc(t):
    ordered_on = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey", dates.month_of(ordered_on).alias("month_dt"), F.trunc(ordered_on, "year").alias("year_dt"), ordered_on.alias("day_dt")
    )


AGE_SQL = "age(CAST({e} AS TIMESTAMP), CAST({s} AS TIMESTAMP))"


def age_months_sql(end: str, start: str) -> str:
    age = AGE_SQL.format(e=end, s=start)
    return f"(extract(year FROM {age}) * 12 + extract(month FROM {age}))"


@register(
    "q_age_months",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {age_months_sql('l_shipdate', 'o_orderdate')} AS months,
    extract(year FROM {AGE_SQL.format(e='l_shipdate', s='o_orderdate')}) AS years
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def age_months(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        dates.months_between_whole(F.col("l_shipdate"), F.col("o_orderdate")).alias("months"),
        dates.years_between_whole(F.col("l_shipdate"), F.col("o_orderdate")).alias("years"),
    )


# Days are added as an integer: DuckDB treats INTERVAL '30' DAY and INTERVAL '1' MONTH as one common expression.
@register(
    "q_interval_math",
    """SELECT contract_id, CAST(started_dt + INTERVAL '1' MONTH AS DATE) AS plus_month, CAST(started_dt + INTERVAL '3' YEAR AS DATE) AS plus_years,
    CAST(period_end_dt - quantity * INTERVAL '1' MONTH AS DATE) AS minus_months, started_dt + 30 AS plus_days,
    started_dt + INTERVAL '1' MINUTE AS plus_minute FROM b_contract""",
    uses="b_contract",
    dates="plus_month plus_years minus_months plus_days",
)
def interval_math(t):
    started = F.col("started_dt")
    return t.b_contract.select(
        "contract_id", dates.shift_months(started, 1).alias("plus_month"), dates.shift_months(started, 36).alias("plus_years"),
        dates.shift_months(F.col("period_end_dt"), -F.col("quantity")).alias("minus_months"), F.date_add(started, 30).alias("plus_days"),
        dates.shift_minutes(started.cast("timestamp_ntz"), 1).alias("plus_minute"),
    )


@register(
    "q_date_diff",
    f"""SELECT contract_id, DATE '{AS_OF}' - started_dt AS age_days, CAST(DATE '{AS_OF}' - 120 AS DATE) AS cutoff_dt,
    coalesce(canceled_dt, DATE '{AS_OF}') - started_dt AS tenure_days FROM b_contract""",
    uses="b_contract",
    dates="cutoff_dt",
)
def date_diff(t):
    as_of = dates.day(AS_OF)
    return t.b_contract.select(
        "contract_id", F.datediff(as_of, "started_dt").cast("bigint").alias("age_days"), F.date_sub(as_of, 120).alias("cutoff_dt"),
        F.datediff(F.coalesce("canceled_dt", as_of), "started_dt").cast("bigint").alias("tenure_days"),
    )


@register(
    "q_time_diff",
    """SELECT user_id, CAST(epoch_us(activated_ts) - epoch_us(created_ts) AS DOUBLE) / 1000000 AS seconds,
    (epoch_us(activated_ts) - epoch_us(created_ts)) // 3600000000 AS hours FROM b_user""",
    uses="b_user",
)
def time_diff(t):
    end, start = F.col("activated_ts"), F.col("created_ts")
    return t.b_user.select("user_id", dates.seconds_between(end, start).alias("seconds"), dates.hours_between(end, start).alias("hours"))


@register(
    "q_make_date",
    "SELECT o_orderkey, make_date(year(o_orderdate) + 1, month(o_orderdate), 1) AS made_dt FROM orders",
    dates="made_dt",
)
def make_date(t):
    made = F.make_date(F.year("o_orderdate") + 1, F.month("o_orderdate"), F.lit(1))
    return t.orders.select("o_orderkey", made.alias("made_dt"))


@register(
    "q_null_funcs",
    """SELECT contract_id, coalesce(canceled_dt, period_end_dt) AS end_dt, nullif(quantity, 0) AS quantity,
    greatest(canceled_dt, started_dt) AS later_dt, least(canceled_dt, period_end_dt) AS earlier_dt FROM b_contract""",
    uses="b_contract",
    dates="end_dt later_dt earlier_dt",
)
def null_funcs(t):
    return t.b_contract.select(
        "contract_id", F.coalesce("canceled_dt", "period_end_dt").alias("end_dt"), F.nullif(F.col("quantity"), F.lit(0)).alias("quantity"),
        F.greatest("canceled_dt", "started_dt").alias("later_dt"), F.least("canceled_dt", "period_end_dt").alias("earlier_dt"),
    )


@register(
    "q_rounding",
    """SELECT l_orderkey, l_partkey, l_linenumber, round(CAST(l_extendedprice AS DECIMAL(12,2)), 1) AS half_up,
    round_even(l_quantity / 2, 0) AS half_even FROM lineitem""",
    money="half_up",
)
def rounding(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", F.round(numbers.dec(F.col("l_extendedprice"), 12, 2), 1).alias("half_up"),
        F.bround(F.col("l_quantity") / 2, 0).alias("half_even"),
    )


@register("q_int_math", "SELECT trip_id, distance_m // 1000 AS km, distance_m % 1000 AS rest_m FROM b_trip", uses="b_trip")
def int_math(t):
    return t.b_trip.select("trip_id", numbers.int_div(F.col("distance_m"), 1000).alias("km"), (F.col("distance_m") % 1000).alias("rest_m"))


@register(
    "q_casts",
    """SELECT p_partkey, CAST(p_retailprice AS DECIMAL(10,1)) AS price, TRY_CAST(split_part(p_brand, '#', 2) AS SMALLINT) AS brand_nr,
    TRY_CAST(p_name AS INTEGER) AS not_a_number, left(p_name, 4) AS short_name, CAST(p_size AS VARCHAR) AS size_text FROM part""",
    money="price",
)
def casts(t):
    return t.part.select(
        "p_partkey", F.col("p_retailprice").cast("decimal(10,1)").alias("price"),
        F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).try_cast("smallint").alias("brand_nr"),
        F.col("p_name").try_cast("int").alias("not_a_number"), F.left(F.col("p_name"), F.lit(4)).alias("short_name"),
        F.col("p_size").cast("string").alias("size_text"),
    )


# ---------------------------------------------------------------- JSON

EVENT_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@register("q_json_get", f"SELECT event_id, {EVENT_K} AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_get(t):
    props = F.col("props")
    return t.events.select("event_id", json.json_get(props, "k", "int").alias("k"), json.json_get(props, "missing").alias("missing"))


@register("q_explode_items", "SELECT contract_id, product_id, quantity, amount AS unit_net_cents FROM b_item", uses="b_item")
def explode_items(t):
    return items.explode_items(t.b_contract_items, "items").drop("total_net_cents")


@register("q_explode_distinct", "SELECT DISTINCT contract_id, product_id, amount AS total_net_cents FROM b_item", uses="b_item")
def explode_distinct(t):
    return items.explode_items(t.b_contract_items, "items").select("contract_id", "product_id", "total_net_cents").distinct()


def tagged_discounts(t):
    """Events as discount documents: percentage for even ``k``, amount for odd, none above 80."""
    k = json.json_get(F.col("props"), "k", "int")
    percent = F.to_json(F.struct(F.lit("percentage").alias("type"), (k / F.lit(100.0)).alias("value")))
    amount = F.to_json(F.struct(F.lit("amount").alias("type"), F.struct((k * 10).alias("amount"), F.lit("EUR").alias("currency")).alias("value")))
    return t.events.select("event_id", F.when(k > 80, None).when(k % 2 == 0, percent).otherwise(amount).alias("discount"))


@register(
    "q_tagged_value",
    f"""SELECT event_id, CASE WHEN k > 80 THEN NULL WHEN k % 2 = 0 THEN 'percentage' ELSE 'amount' END AS kind,
    CASE WHEN k > 80 THEN NULL WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) / 100 ELSE CAST(k AS DOUBLE) * 10 END AS discount
    FROM (SELECT event_id, {EVENT_K} AS k FROM events) s""",
    money="discount",
)
def tagged_value(t):
    col = F.col("discount")
    return tagged_discounts(t).select("event_id", json.discount_type(col).alias("kind"), json.discount_value(col).alias("discount"))


@register(
    "q_json_missing",
    "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, json_extract_string(props, '$.z') IS NOT NULL AS has_z FROM events",
)
def json_missing(t):
    return t.events.select("event_id", json.has_json(F.col("props"), "k").alias("has_k"), json.has_json(F.col("props"), "z").alias("has_z"))


@register("q_json_flag", "SELECT c_custkey, c_mktsegment <> 'HOUSEHOLD' AS fencing FROM customer")
def json_flag(t):
    config = F.to_json(F.struct(F.struct((F.col("c_mktsegment") != "HOUSEHOLD").alias("fencing")).alias("services")))
    documents = t.customer.select("c_custkey", config.alias("configuration"))
    return documents.select("c_custkey", json.json_flag(F.col("configuration"), "services.fencing").alias("fencing"))


@register(
    "q_format_address",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL WHEN c_custkey % 5 = 0 THEN c_name
    ELSE c_name || ', ' || c_nationkey || ' - ' || c_mktsegment || ', ' || n_name END AS address
    FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def format_address(t):
    street = F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))
    doc = F.to_json(F.struct(
        street.alias("streetName"), F.col("c_nationkey").cast("string").alias("postalCode"), F.col("c_mktsegment").alias("city"),
        F.col("n_name").alias("country"), F.col("c_name").alias("venueName"),
    ))
    category = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "PRIVATE").otherwise("BUSINESS")
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", json.format_address(doc, category).alias("address"))


# ---------------------------------------------------------------- table changes

SCD_AS_OF = "2024-01-20 00:00:00"
SCD_DEDUP = "dedup AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY domain_name, version_nr ORDER BY domain_key) AS n FROM b_scd2) s WHERE n = 1)"
SCD_FROM = f"""fixed_from AS (SELECT * EXCLUDE (valid_from_ts, prev_to), CASE WHEN prev_to > valid_from_ts AND prev_to < TIMESTAMP '{SCD_AS_OF}'
    THEN prev_to ELSE valid_from_ts END AS valid_from_ts FROM
    (SELECT *, lag(valid_to_ts) OVER (PARTITION BY domain_name ORDER BY domain_key) AS prev_to FROM dedup) s)"""
SCD_TO = f"""fixed_to AS (SELECT * EXCLUDE (valid_to_ts, next_from), CASE WHEN next_from < valid_to_ts AND next_from < TIMESTAMP '{SCD_AS_OF}'
    THEN next_from ELSE valid_to_ts END AS valid_to_ts FROM
    (SELECT *, lead(valid_from_ts) OVER (PARTITION BY domain_name ORDER BY domain_key) AS next_from FROM fixed_from) s)"""
SCD_FLAG = f"flagged AS (SELECT * REPLACE (CASE WHEN valid_to_ts < TIMESTAMP '{SCD_AS_OF}' THEN FALSE ELSE is_last_version END AS is_last_version) FROM fixed_to)"


@register("q_scd2_dedup", "SELECT * FROM dedup", uses="b_scd2", extra=SCD_DEDUP)
def scd2_dedup(t):
    return snapshots.drop_duplicate_versions(t.b_scd2)


@register("q_scd2_from", "SELECT * FROM fixed_from", uses="b_scd2", extra=f"{SCD_DEDUP}, {SCD_FROM}")
def scd2_from(t):
    return snapshots.raise_valid_from(snapshots.drop_duplicate_versions(t.b_scd2), SCD_AS_OF)


@register("q_scd2_to", "SELECT * FROM fixed_to", uses="b_scd2", extra=f"{SCD_DEDUP}, {SCD_FROM}, {SCD_TO}")
def scd2_to(t):
    return snapshots.lower_valid_to(scd2_from(t), SCD_AS_OF)


@register("q_scd2_flag", "SELECT * FROM flagged", uses="b_scd2", extra=f"{SCD_DEDUP}, {SCD_FROM}, {SCD_TO}, {SCD_FLAG}")
def scd2_flag(t):
    return snapshots.repair_scd2(t.b_scd2, SCD_AS_OF)


@register(
    "q_scd2_collapse",
    """SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY domain_name, valid_from_ts, valid_to_ts, is_last_version
    ORDER BY domain_key) AS n FROM b_scd2) s WHERE n = 1""",
    uses="b_scd2",
)
def scd2_collapse(t):
    return snapshots.collapse_versions(t.b_scd2)


@register(
    "q_point_fix",
    "SELECT contract_id, CASE WHEN contract_id = 42 THEN DATE '2001-10-03' ELSE period_end_dt END AS period_end_dt FROM b_contract",
    uses="b_contract",
    dates="period_end_dt",
)
def point_fix(t):
    contracts = t.b_contract.select("contract_id", "period_end_dt")
    fix = t.spark.range(1).select(F.lit(42).cast("bigint").alias("contract_id"), dates.day("2001-10-03").alias("period_end_dt"))
    return snapshots.apply_correction(contracts, fix, "contract_id", "period_end_dt")
