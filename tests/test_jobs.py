"""Jobs on hand-written rows."""

import hashlib
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from rollbook.plans import accounts, churn, features, logbook, migration, orders, revenue, usage

DAY = date(2024, 1, 1)


def shop(rows, discount_percentage=None, discount_cents=None, coupon=None, monthly=True, full_refund=False, refund=0):
    lines = rows(
        "order_key int, product_key int, net_cents long, gross_cents long, quantity int, opcode string",
        (1, 1, 1000, 1190, 1, "I"), (1, 2, 3000, 4000, 2, "I"), (1, 3, 500, 595, 1, "D"),
    )
    orders_ = rows(
        "order_key int, order_id string, invoice_id string, invoice_status string, contract_id string, customer_id string, created_dt date, start_dt date, end_dt date, "
        "coupon_code string, discount_percentage decimal(10,2), discount_cents long, tax_rate decimal(4,2), has_refund boolean, has_full_refund boolean, "
        "cancelation_reason string, creator_urn string, contract_status string, contract_canceled_dt date, contract_modified_dt date",
        (1, "o1", "R1", "paid", "V1", "K1", DAY, DAY, date(2025, 1, 1), coupon, discount_percentage, discount_cents, None, refund > 0, full_refund, None, "checkout", "active", None, None),
    )
    products = rows(
        "product_key int, product_id string, product_name string, product_family string, monthly_payment boolean, is_recurring boolean, is_subsequent_recurring boolean",
        *[(k, f"p{k}", "plan 3y" if k == 2 else "plan", "Track", monthly, True, False) for k in (1, 2, 3)],
    )
    coupons = rows("coupon_code string, discount_type string, discount_value decimal(10,2)", ("C", "percentage", None))
    coupons = coupons.withColumn("discount_value", F.lit(0.5).cast("decimal(10,2)"))
    refunds = rows("invoice_id string, refund_net_cents long", ("R1", refund // 2), ("R1", refund - refund // 2))
    out = revenue.invoice_mrr(lines, orders_, products, coupons, refunds, "%3y%", "2024-06-01")
    return {r["product_id"]: r for r in out.collect()}


def test_no_discount_monthly_and_yearly(rows):
    got = shop(rows)
    assert {k: float(r["mrr_eur"]) for k, r in got.items()} == {"p1": 10.0, "p2": 30.0}
    assert got["p2"]["product_terms"] == "36 mths, monthly payment" and got["p1"]["is_first_invoice"]
    assert {k: float(r["mrr_eur"]) for k, r in shop(rows, monthly=False).items()} == {"p1": 0.83, "p2": 2.5}


def test_percentage_and_coupon_discount(rows):
    from decimal import Decimal

    assert float(shop(rows, discount_percentage=Decimal("0.10"))["p1"]["mrr_eur"]) == 9.0
    assert float(shop(rows, coupon="C")["p1"]["mrr_eur"]) == 5.0


def test_amount_discount_uses_net_weight_monthly_and_gross_weight_yearly(rows):
    monthly = shop(rows, discount_cents=1190)
    assert float(monthly["p1"]["mrr_eur"]) == 7.5  # 1190 * 1/4 / 1.19 = 250 cents off
    yearly = shop(rows, discount_cents=1190, monthly=False)
    assert float(yearly["p1"]["mrr_eur"]) == 0.64  # 1190 * 1190/5190 / 1.19 = 229 cents off, over 12 months


def test_partial_and_full_refund(rows):
    partial = shop(rows, refund=400)
    assert [float(partial["p2"][c]) for c in ("refund_mrr_eur", "refund_item_quantity")] == [3.0, 0.2]
    full = shop(rows, refund=400, full_refund=True)
    assert [float(full["p2"][c]) for c in ("refund_mrr_eur", "refund_item_quantity")] == [30.0, 2.0]


def test_contract_status_lapses_after_six_months(rows):
    df = rows(
        "contract_id string, status string, end_dt date, canceled_dt date, modified_dt date",
        ("a", "active", date(2023, 6, 1), None, DAY), ("b", "active", date(2023, 7, 2), None, DAY), ("c", "canceled", DAY, date(2023, 1, 5), DAY), ("d", "terminated", DAY, None, DAY),
    )
    got = {r["contract_id"]: (r["status_code"], r["terminated_dt"]) for r in revenue.contract_status(df, DAY).collect()}
    assert got == {"a": (0, DAY), "b": (2, None), "c": (1, date(2023, 1, 5)), "d": (0, DAY)}


STEP = (
    "contract_id string, subscription_id string, plan_id string, plan_quantity long, status string, contract_created_dt date, tmp_term_start_dt date, "
    "tmp_term_end_dt date, cancelled_dt date, cancel_reason string, renewal_cycles int, min_start_dt date, max_start_dt date, max_end_dt date"
)


def step_row(name, plan, status="active", quantity=1, first=date(2023, 3, 1), last=date(2023, 3, 1), end=date(2024, 3, 1), cancelled=None):
    return (name, name, plan, quantity, status, first, first, end, cancelled, "moved", 1, first, last, end)


def steps(rows, *values, rules="grace30", as_of=DAY):
    df = migration.resolve_status(migration.contract_end(migration.term_dates(rows(STEP, *values)), as_of), as_of, rules)
    return {r["subscription_id"]: r for r in df.collect()}


def test_contract_ends(rows):
    got = steps(
        rows,
        step_row("yearly", "office-yearly"),
        step_row("monthly", "office-monthly", last=date(2023, 12, 1), end=DAY),
        step_row("long", "track-3_years-yearly", first=date(2022, 3, 1)),
        step_row("longm", "track-3_years-monthly", first=date(2022, 5, 9), end=date(2024, 1, 9)),
        step_row("leap", "track-3_years-yearly", first=date(2023, 2, 28), end=date(2024, 2, 29)),
    )
    assert {k: r["contract_end_dt"] for k, r in got.items()} == {
        "yearly": date(2024, 3, 1), "monthly": date(2024, 3, 1), "long": date(2025, 3, 1), "longm": date(2025, 5, 9), "leap": date(2026, 2, 28),
    }


def test_status_rules_by_version(rows):
    over = step_row("over", "office-yearly", end=date(2023, 12, 10))  # 22 days past its end
    values = [
        over, step_row("empty", "office-yearly", quantity=0), step_row("future", "office-yearly", first=date(2024, 2, 1)),
        step_row("leaving", "office-yearly", status="non_renewing"), step_row("gone", "office-yearly", status="non_renewing", end=DAY),
        step_row("today", "office-yearly", end=DAY), step_row("old", "office-yearly", end=date(2023, 11, 1)),
    ]
    status = lambda rules: {k: r["status"] for k, r in steps(rows, *values, rules=rules).items()}
    common = {"future": "future", "leaving": "non_renewing", "gone": "cancelled", "today": "active"}
    assert status("grace30") == common | {"over": "active", "empty": "cancelled", "old": "cancelled"}
    assert status("grace14") == common | {"over": "cancelled", "empty": "cancelled", "old": "cancelled"}
    assert status("none") == common | {"over": "active", "empty": "non_renewing", "old": "active"}


def finished(rows, *values, as_of=DAY):
    return {r["subscription_id"]: r for r in migration.date_steps(rows(STEP, *values), as_of).collect()}


def test_cancel_date_is_settled_and_clamped(rows):
    got = finished(
        rows,
        step_row("before", "office-yearly", status="cancelled", end=date(2023, 6, 1), cancelled=date(2023, 1, 1)),
        step_row("inside", "office-yearly", status="cancelled", end=date(2023, 6, 1), cancelled=date(2023, 4, 1)),
        step_row("after", "office-yearly", status="cancelled", end=date(2023, 6, 1), cancelled=date(2023, 9, 1)),
        step_row("none", "office-yearly", status="cancelled", end=date(2023, 6, 1)),
    )
    assert {k: r["cancelled_ts"] for k, r in got.items()} == {
        "before": datetime(2023, 3, 1, 0, 1), "inside": datetime(2023, 4, 1), "after": datetime(2023, 6, 1), "none": datetime(2023, 5, 31),
    }


def test_cycles_and_contract_start(rows):
    got = finished(
        rows,
        step_row("long", "track-3_years-yearly", first=date(2022, 3, 1)),
        step_row("longm", "track-3_years-monthly", first=date(2022, 5, 9), last=date(2023, 12, 9), end=date(2024, 1, 9)),
        step_row("leaving", "office-monthly", status="non_renewing", first=date(2023, 6, 1), last=date(2023, 12, 1), end=date(2024, 1, 31)),
        step_row("pushed", "office-yearly", end=DAY),
    )
    view = {k: (r["status"], r["cycles_left"], r["contract_start_dt"], r["pushed_by_one_cycle"]) for k, r in got.items()}
    assert view["long"] == ("active", 2, date(2022, 3, 1), False)
    assert view["longm"] == ("active", 17, date(2022, 5, 9), False)
    assert view["leaving"] == ("active", 5, date(2023, 5, 31), False)  # five cycles left in the contract year: promoted
    assert view["pushed"] == ("active", 1, date(2023, 1, 1), True)


def test_dead_plans_of_live_contracts_are_dropped(rows):
    live, dead = list(step_row("x", "office-yearly")), list(step_row("y", "office-yearly", status="cancelled", quantity=0, end=date(2023, 6, 1)))
    alone = list(step_row("z", "office-yearly", status="cancelled", quantity=0, end=date(2023, 6, 1)))
    live[0] = dead[0] = "same"
    got = finished(rows, tuple(live), tuple(dead), tuple(alone), step_row("h", "hardware-x"), step_row("a", "addons-plan"))
    assert sorted(got) == ["x", "z"]


def test_amount_discount_becomes_percent_code(rows):
    amount = '{"type":"amount","value":{"amount":%d}}'
    price = '{"gross":{"amount":%d}}'
    df = rows(
        "contract_id string, invoice_id string, created_ts timestamp_ntz, discount string, total_price string",
        ("a", "1", datetime(2024, 1, 1), amount % 10, price % 90), ("a", "2", datetime(2024, 2, 1), amount % 5, price % 995),
        ("b", "3", datetime(2024, 1, 1), amount % 10, price % 0), ("c", "4", datetime(2024, 1, 1), amount % 0, price % 5),
    )
    assert {r[0]: r[1] for r in migration.amount_to_percent(df).collect()} == {"a": "dummy_pct_0_0050", "b": "dummy_pct_1_0000"}


def test_export_has_every_header_once(rows):
    export = migration.migration_export(rows_with_columns(rows))
    assert len(export.columns) == len(set(export.columns)) == 64
    assert export.columns[:3] == ["customer[email]", "shop_customer_id", "subscription[id]"]
    row = export.first()
    assert row["customer[email]"] == "a@x" and row["subscription[started_at]"] == "2024-01-01 00:00:00" and row["subscription[po_number]"] is None


def rows_with_columns(rows):
    sources = {c.source for c in migration.EXPORT if c.source}
    df = rows("customer_email string, ship_email string, started_dt date", ("a@x,b@x", None, DAY))
    return df.select("*", *[F.lit(None).cast("date" if c.endswith("_dt") else "string").alias(c) for c in sorted(sources - set(df.columns))])


def test_logbook_boundaries(rows):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    readings = rows("car_id int, reading_id int, reading_ts timestamp_ntz, odometer_km long", (1, 1, t(8), 1000), (1, 2, t(12, 2), 2000), (1, 3, t(15, 58), None))
    trips = rows(
        "trip_id int, car_id int, trip_start_ts timestamp_ntz, trip_end_ts timestamp_ntz, distance_m long, adjustment_m long, category string, start_address string, end_address string",
        (1, 1, t(9), t(10), 10400, 100, "BUSINESS", None, None), (2, 1, t(10), t(11), 10100, 0, "PRIVATE", None, None),
        (3, 1, t(12), t(13), 5000, 0, "COMMUTE", None, None),  # reading in its first three minutes: after it
        (4, 1, t(11, 30), t(12, 20), 9000, 0, "BUSINESS", None, None),  # reading in the middle: no interval holds both ends
        (5, 1, t(7), t(7, 30), 1, 0, "BUSINESS", None, None),  # before the first reading
    )
    notes = {c: F.concat(F.lit(f"{c} "), F.col("trip_id").cast("string")) for c in logbook.NOTES}
    halves = {"distance_business_m": F.expr("distance_m * 6 div 10"), "distance_private_m": F.expr("distance_m * 4 div 10"), "distance_commute_m": F.lit(0)}
    trips = trips.withColumns({"is_merged": F.col("trip_id") == 1, **halves, **notes})
    cars = rows("car_id int, domain_name string, licence_plate string", (1, "d", "B-X 1"))
    merged = logbook.odometer_logbook(readings, trips, cars, t(20)).filter("merged = 'yes'").first()  # 10.4 km of two kinds
    assert tuple(merged[c] for c in ("trip_id", "business_km", "commute_km", "private_km", "driver")) == (1, 6, 0, 4, "driver 1")
    got = {r["trip_id"]: (r["departure_km"], r["arrival_km"], r["trips_since_reading"]) for r in logbook.odometer_logbook(readings, trips, cars, t(20)).collect()}
    assert got == {1: (1000, 1011, 1), 2: (1011, 1021, 2), 3: (2000, 2005, 1)}
    audit = {(r["trip_id"], r["reading_id"]): (r["start_fits"], r["end_fits"]) for r in logbook.odometer_join_audit(readings, trips, t(20)).collect()}
    assert audit == {(3, 1): (None, None), (4, 1): (True, None)}


def test_active_stats_counts_open_days(rows):
    subs = rows("domain_id int, start_dt date, end_dt date", (1, date(2023, 12, 1), date(2024, 1, 3)), (1, date(2024, 1, 2), date(2024, 1, 3)), (2, date(2024, 1, 2), date(2024, 1, 2)))
    users = rows("domain_id int, user_id int, created_dt date, activated_dt date, deleted_dt date",
                 (1, 1, date(2023, 1, 1), date(2024, 1, 2), None), (1, 2, date(2024, 1, 2), None, date(2024, 1, 2)), (9, 3, DAY, DAY, None))
    jobs = rows("date_key date, user_id int, domain_id int, jobs_last_7days int", (DAY, 1, 1, 10), (DAY, 2, 1, 9))
    got = {r["period"]: tuple(r)[1:] for r in usage.active_stats(subs, users, jobs, DAY, date(2024, 1, 4), "day").collect()}
    # subscription domains, all users, activated users, active domains, active users
    assert got == {DAY: (1, 1, 0, 1, 1), date(2024, 1, 2): (1, 2, 1, 1, 0), date(2024, 1, 3): (0, None, None, 0, 0)}


def test_discount_split_and_net_value(rows):
    item = '{"product_id":"%s","quantity":1,"total_provisioned_price":{"net":{"amount":%d}}}'
    df = rows(
        "contract_id string, items string, discount string",
        ("a", "[" + item % ("1", 1000) + "," + item % ("2", 2000) + "]", '{"type":"amount","value":{"amount":119}}'),
        ("p", "[" + item % ("1", 1000) + "]", '{"type":"percentage","value":0.1}'), ("n", "[]", None),
    )
    split = {(r["contract_id"], r["product_id"]): float(r["item_discount"]) for r in orders.split_discount(df).collect()}
    assert split == {("a", "1"): 39.27, ("a", "2"): 79.73, ("p", "1"): 0.1}
    products = rows("product_id string, monthly_payment boolean, counts_revenue boolean", ("1", True, True), ("2", None, True))
    value = {r[0]: float(r[1]) for r in orders.contract_net_value(df, products).collect()}
    assert value == {"a": round(((1000 - 100) * 12 + 2000 - 100) / 100, 2), "p": 108.0}


def test_churn_leaves_out_same_month_and_falls_back(rows):
    report = rows(
        "customer_id int, reporting_month date, product_terms string, product_group string, invoice_discount_pct int, mrr_eur decimal(12,2), flag_future boolean",
        (1, date(2023, 5, 1), "12 mths, monthly payment", "Track", 0, None, False),
    )
    report = report.withColumn("mrr_eur", F.lit(10).cast("decimal(12,2)"))
    fallback = report.drop("mrr_eur", "flag_future").withColumns({"amount": F.lit(8).cast("decimal(12,2)"), "exchange_rate": F.lit(2).cast("decimal(6,2)")})
    fallback = fallback.unionByName(fallback.withColumn("customer_id", F.lit(2))).unionByName(fallback.withColumn("customer_id", F.lit(3)))
    customers = rows(
        "customer_id int, is_fleet boolean, country string, customer_status string, system string, first_start_dt date, max_cancelled_dt date",
        (1, True, "DE", "active", "SH", date(2023, 1, 1), None), (2, True, "DE", "cancelled", "SH", date(2023, 1, 1), date(2023, 3, 1)),
        (3, True, "DE", "cancelled", "SH", date(2023, 1, 1), date(2023, 1, 20)),
    )
    got = {r["customer_id"]: r for r in churn.churn_features(report, fallback, customers, ["Track"], DAY).collect()}
    assert sorted(got) == [1, 2]
    assert (got[1]["churn_flag"], float(got[1]["mrr"]), got[1]["billing_every_1_mths"], got[1]["billing_every_12_mths"]) == (False, 10.0, True, None)
    assert (got[2]["churn_flag"], got[2]["churn_100d_flag"], got[2]["tenure_days"], float(got[2]["mrr"]), got[2]["had_revenue"]) == (True, True, 59, 4.0, False)


def test_quantiles_of_few_rows(rows):
    df = rows("x double", (1.0,), (2.0,), (2.0,), (10.0,), (None,))
    assert tuple(features.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 1.0]).first()) == (1.0, 1.75, 2.0, 10.0)


def test_label_codes_put_null_last(rows):
    df = rows("id int, t string, n int", (1, "b", 5), (2, "a", None), (3, None, 7), (4, "b", 5))
    got = sorted(tuple(r) for r in features.label_encode(df, ["t", "n"]).collect())
    assert got == [(1, 1, 0), (2, 0, 2), (3, 2, 1), (4, 1, 0)]


def test_uninformative_columns_are_dropped(rows):
    df = rows("id int, one int, half int, nul int", *[(i, 7, i // 2, None) for i in range(50)])
    assert features.drop_uninformative(df).columns == ["half"]


def test_label_slices_of_texts_that_begin_alike(spark):
    """No slice takes many values, however long their common start."""
    df = spark.range(100_000).selectExpr("concat('https://shop.example/customer/', lpad(id, 9, '0')) AS t")
    ranked = features._ranked_values(df, ["t"])
    most = ranked.groupBy("slice").count().agg(F.max("count"), F.sum("count")).first()
    assert most[1] == 100_000 and most[0] <= 0.05 * 100_000
    borders = ranked.groupBy("slice").agg(F.min("value").alias("low"), F.max("value").alias("high")).orderBy("slice").collect()
    assert all(a["high"] < b["low"] for a, b in zip(borders, borders[1:]))


def order_rows(rows, **changes):
    """One placed order with a product; flags and legacy values as given."""
    values = {
        "counts_device": True, "is_subsequent_recurring": False, "changes_to_onetime": False, "is_recurring": True, "counts_revenue": True, "counts_sold": True,
        "sales_counts": True, "legacy_id": None, "legacy_status": None, "legacy_product": None, "legacy_gross": None, "creator": "shop", "invoice": True,
        "refund": (9, 1),
    } | changes
    item = '[{"product_id":"p","quantity":3}]'
    placed = rows(
        "order_id int, contract_id int, domain string, status string, legacy_id string, legacy_status string, legacy_product string, legacy_gross string, total_net_cents long, "
        "coupon_code string, discount string, items string, creator string, created_ts timestamp, modifier string, modified_ts timestamp",
        (1, 1, "D.", "placed", values["legacy_id"], values["legacy_status"], values["legacy_product"], values["legacy_gross"], 1050, None, None, item, values["creator"], datetime(2024, 1, 5), None, None),
    )
    flags = ["counts_device", "is_subsequent_recurring", "changes_to_onetime", "is_recurring", "counts_revenue", "counts_sold", "sales_counts"]
    products = rows("product_id string, " + ", ".join(f"{f} boolean" for f in flags), ("p", *[values[f] for f in flags]))
    invoices = rows("invoice_id int, order_id int, net_cents long", (7, 1 if values["invoice"] else 2, 1050))
    payments = rows("invoice_id int, order_id int, status string, refund_id int, method string", (7, 1, "authorised", None, "card"))
    refunds = rows("order_id int, net_cents long", values["refund"])
    parents = rows("contract_id int, contract_created_ts timestamp", (1, datetime(2024, 1, 9)))
    return orders.enrich_orders(placed, invoices, payments, refunds, parents, products, ["x"], "importer").first()


def test_a_refund_without_amount_is_a_refund(rows):
    assert order_rows(rows, refund=(1, None))["has_refund"] and order_rows(rows, refund=(1, 5))["has_refund"] and not order_rows(rows)["has_refund"]
    assert not order_rows(rows, refund=(1, None))["has_full_refund"] and order_rows(rows, refund=(1, 1050))["has_full_refund"]


def test_unknown_product_flags_do_not_count_as_no(rows):
    assert order_rows(rows)["is_recurring"] and order_rows(rows)["is_sold"]
    for flag in ("is_subsequent_recurring", "changes_to_onetime"):
        assert not order_rows(rows, **{flag: None})["is_recurring"] and not order_rows(rows, **{flag: True})["is_recurring"]
    for flag in ("sales_counts", "counts_sold", "counts_device", "counts_revenue"):
        assert not order_rows(rows, **{flag: None})["is_sold"] and not order_rows(rows, **{flag: False})["is_sold"]


def test_legacy_orders_are_sold_by_product_and_status(rows):
    old = {"legacy_id": "1200", "legacy_gross": "119.00 €"}
    sold = order_rows(rows, **old, legacy_product="14, 15", legacy_status="complete")
    assert (sold["is_sold"], sold["is_legacy_customer"], float(sold["net_invoice_amount"])) == (True, True, 100.0)
    assert not order_rows(rows, **old, legacy_product="14", legacy_status="complete")["is_sold"]
    assert not order_rows(rows, **old, legacy_product="7", legacy_status="pending")["is_sold"]
    own = order_rows(rows, legacy_id="7701", legacy_gross="1.00 €")
    assert (float(own["net_invoice_amount"]), own["is_sold"]) == (10.5, True)


def test_drafts_are_imported_orders_with_an_invoice(rows):
    assert order_rows(rows, creator="importer")["was_draft"]
    assert not order_rows(rows, creator="importer", invoice=False)["was_draft"] and not order_rows(rows, creator=None)["was_draft"]


def test_plans_without_a_number_leave_the_migration(rows):
    """They have no subscription id, and they don't make their contract a live one."""
    base = rows(
        "contract_id string, subscription_id string, plan_id string, plan_quantity long, status string, contract_created_dt date, tmp_term_start_dt date, tmp_term_end_dt date, "
        "cancelled_dt date, cancel_reason string, renewal_cycles int, min_start_dt date, max_start_dt date, max_end_dt date",
        ("c", None, "unmapped-yearly", 1, "active", DAY, DAY, date(2025, 1, 1), None, None, 1, DAY, DAY, date(2025, 1, 1)),
        ("c", "c_1", "plan-yearly", 0, "cancelled", DAY, DAY, date(2024, 6, 1), DAY, "x", 1, DAY, DAY, date(2024, 6, 1)),
    )
    got = migration.date_steps(base, date(2024, 9, 1)).collect()
    assert [r["subscription_id"] for r in got] == ["c_1"]


def test_profiles_of_all_columns_in_few_scans(spark, rows):
    df = rows("a int, b double, c string", (1, 0.0, "x"), (None, -0.0, "x"), (1, 2.5, None), (4, None, "y"))
    assert {tuple(r) for r in features.column_cardinality(df).collect()} == {("a", 3, 4), ("b", 3, 4), ("c", 3, 4)}
    assert {tuple(r) for r in features.column_cardinality(df.limit(0)).collect()} == {(c, 0, 0) for c in "abc"}
    got = {r["column"]: tuple(r)[1:] for r in features.describe(df.withColumn("n", F.lit(None).cast("int")), ["a", "b", "n"]).collect()}
    assert got["a"][0] == 3 and got["a"][3:] == (1.0, 1.0, 1.0, 2.5, 4.0) and got["n"] == (0, *[None] * 7)
    for make in (lambda d: features.describe(d, ["x1", "x2", "x3", "x4"]), features.column_cardinality):
        plan = make(spark.range(10).selectExpr("id AS x1", "id AS x2", "id * 2 AS x3", "id AS x4"))._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan


def test_subscription_ids_follow_the_order_of_candidates(rows):
    lines = rows("contract_id string, plan_id string", ("V1", "p1"), ("V1", "p1"), ("V1", "p2"), ("V2", "p1"), ("V2", "p3"), ("V3", None))
    plans = rows("plan_id string, plan_code string, plan_code_nbr string", ("p1", "a", "b"), ("p2", None, "c"))
    known = rows("subscription_id string", ("V1_a",), ("V1_b",), ("V1_c",), ("V2_b",))
    got = {(r["contract_id"], r["plan_id"]): r["subscription_id"] for r in revenue.resolve_subscriptions(lines, plans, known).collect()}
    assert got == {("V1", "p1"): "V1_a", ("V1", "p2"): "V1_c", ("V2", "p1"): "V2_b", ("V2", "p3"): "V2_" + hashlib.md5(b"p3").hexdigest(), ("V3", None): None}


def _exchanges(plan):
    children = plan.children()
    own = [plan] if plan.nodeName() == "Exchange" else []
    return own + [e for i in range(children.size()) for e in _exchanges(children.apply(i))]


def test_lines_are_exchanged_without_the_columns_of_their_order(spark):
    """Only keys of lines travel besides the lines themselves, and the lines travel twice: to the products and to the orders."""
    from rollbook.catalog import revenue as r
    from rollbook.catalog.base import Inputs

    t = Inputs(spark, "/root/testdata/sf0.001")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = r.invoice_mrr(t)._jdf.queryExecution().executedPlan().initialPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    outputs = {tuple(sorted(c.split("#")[0] for c in e.output().mkString(",").split(","))) for e in _exchanges(plan)}
    assert not [o for o in outputs if "quantity" in o and ("invoice_status" in o or "subscription_id" in o)]
    assert len([o for o in outputs if "quantity" in o]) == 2
    assert len([o for o in outputs if "invoice_status" in o and "order_key" in o]) <= 4


def test_repeated_and_missing_keys_of_orders(rows):
    """Orders that share a key, customers with two billing ids, an order without contract, products without plan: totals count
    each sold row, and every line meets every order of its key once."""
    lines = rows("order_key int, product_key int, net_cents long, gross_cents long, quantity int, opcode string",
                 (1, 1, 1000, 1190, 1, "I"), (1, 1, 1000, 1190, 1, "I"), (1, 2, 3000, 3570, 2, None), (2, 2, 500, 595, 1, "I"), (3, 1, 700, 833, 1, "I"), (None, 1, 9, 9, 1, "I"), (4, 9, 9, 9, 1, "I"))
    day = lambda m: date(2024, m, 1)
    schema = """order_key int, order_id string, invoice_id string, invoice_status string, contract_id string, customer_id string, created_dt date, start_dt date, end_dt date,
        coupon_code string, discount_percentage decimal(10,2), discount_cents long, tax_rate decimal(4,2), has_refund boolean, has_full_refund boolean,
        cancelation_reason string, creator_urn string, contract_status string, contract_canceled_dt date, contract_modified_dt date"""
    order = lambda key, name, contract, customer, m, full=False: (
        key, name, f"R{name}", "paid", contract, customer, day(m), day(m), day(m + 1), None, None, None, None, False, full, None, None, "active", None, None)
    orders_ = rows(schema, order(1, "a", "V1", "K", 3), order(1, "b", "V1", "K", 2), order(1, "b", "V1", "K", 2), order(2, "c", None, "K", 1), order(3, "d", "V1", "L", 5, True), order(4, "e", "V1", "K", 1))
    products = rows("product_key int, product_id string, product_name string, product_family string, monthly_payment boolean, is_recurring boolean, is_subsequent_recurring boolean, plan_id string",
                    (1, "p1", "x", "Track", True, True, False, "m"), (2, "p2", None, "Track", True, True, False, None))
    coupons = rows("coupon_code string, discount_type string, discount_value decimal(10,2)", ("C", "amount", Decimal(1)))
    refunds = rows("invoice_id string, refund_net_cents long", ("Rz", 1))
    billing = {
        "customers": rows("customer_id string, billing_customer_id string", ("K", "B1"), ("K", "B2")),
        "plans": rows("plan_id string, plan_code string, plan_code_nbr string", ("m", "x", "y")),
        "subscriptions": rows("subscription_id string", ("V1_y",)),
    }
    out = revenue.invoice_mrr(lines, orders_, products, coupons, refunds, "%3y%", "2024-06-01", billing=billing).collect()
    got = sorted((r["invoice_id"], r["customer_id"], r["product_id"], r["subscription_id"] or "", r["first_created_dt"] if "first_created_dt" in r else r["is_first_invoice"], r["first_terms_dt"]) for r in out)
    of = lambda name, first, times: [
        (f"R{name}", b, p, s, first, d) for b in ("B1", "B2") for p, s, n, d in (("p1", "V1_y", 2, day(2)), ("p2", "", 1, day(1))) for _ in range(n * times)
    ]
    # the order without contract is the customer's first, and the first of the terms of lines without subscription
    assert got == sorted(of("a", False, 1) + of("b", False, 2) + [("Rd", "L", "p1", "V1", True, None)])


def test_first_dates_skip_full_refunds(rows):
    df = rows(
        "customer_id string, subscription_id string, product_family string, product_terms string, monthly_payment boolean, has_full_refund boolean, created_dt date, start_dt date, end_dt date",
        ("K", "S", "Track", "36 mths, monthly payment", True, False, date(2024, 2, 1), date(2024, 2, 15), date(2025, 2, 1)),
        ("K", "S", "Track", "12 mths, yearly payment", False, False, date(2024, 1, 1), date(2024, 1, 5), date(2024, 9, 1)),
        ("K", "S", "Track", "36 mths, monthly payment", True, True, date(2023, 1, 1), date(2023, 1, 5), date(2030, 1, 1)),
        ("L", "T", "Track", "12 mths, yearly payment", False, None, date(2023, 1, 1), date(2023, 1, 5), date(2024, 1, 1)),
    )
    got = {(r["customer_id"], r["product_terms"], r["created_dt"]): r for r in revenue.first_dates(df).collect()}
    one = got[("K", "36 mths, monthly payment", date(2024, 2, 1))]
    assert (one["first_created_dt"], one["first_order_dt"], one["valid_to_dt"]) == (date(2023, 1, 1), date(2024, 1, 5), date(2025, 2, 1))
    assert (one["first_monthly_mth"], one["first_long_term_dt"], one["first_terms_dt"]) == (date(2024, 2, 1), date(2024, 2, 15), date(2024, 2, 1))
    other = got[("L", "12 mths, yearly payment", date(2023, 1, 1))]
    assert other["first_order_dt"] is None and other["valid_to_dt"] == date(2024, 1, 1) and other["first_terms_dt"] is None


def test_customer_value_counts_past_fleet_months_but_any_churn(rows):
    month = lambda m: date(2024, m, 1)
    schema = """customer_id string, customer_country string, customer_status string, is_fleet boolean, flag_future boolean, reporting_month date, product_group string,
        mrr_eur decimal(10,2), mrr_eur_new decimal(10,2), mrr_change decimal(10,2), churn_mth boolean"""
    dec = lambda x: Decimal(x)
    df = rows(
        schema,
        ("K", "GB", "active", True, False, month(1), "Geo", dec(10), dec(10), dec(0), False), ("K", "GB", "active", True, False, month(2), "Geo", dec(12), dec(0), dec(2), False),
        ("K", "GB", "active", True, True, month(9), "Geo", dec(99), dec(0), dec(9), True),  # future: its churn counts, its value does not
        ("K", "GB", "active", False, False, month(3), "Geo", dec(50), dec(0), dec(0), False), ("L", "AT", "active", False, False, month(1), "Geo", dec(5), dec(5), dec(0), False),
    )
    (r,) = revenue.customer_value(df, ["Geo"], {"GB": "UK"}, "DACH").collect()
    assert (r["customer_id"], r["country_group"], r["churn_month"], r["product"]) == ("K", "UK", month(9), "Geo")
    assert [float(r[c]) for c in ("mrr_eur_initial", "mrr_eur_current", "mrr_eur_last_value", "expansion_eur")] == [10, 12, 12, 2]


def test_car_side_counts_by_urn(rows):
    cars = rows("domain_id int, ended_ts timestamp_ntz", (1, None), (1, None), (1, datetime(2024, 1, 1)), (2, None))
    vehicles = rows("vehicle_id string, ended_ts timestamp_ntz", ("a", None), ("b", datetime(2024, 1, 1)), ("c", None))
    settings = rows("domain_id int, vehicle_urn string, has_tracking boolean, has_dynamic_tracking boolean", (1, "urn:x/a", True, True), (1, "urn:x/b", True, False), (2, "urn:x/c", False, True), (2, "urn:x/zz", True, True))
    inventory = rows("domain_id int, resource_urn string, is_bookable boolean", (1, "urn:y/c/more", True), (1, "urn:y/a", False), (3, "none", True))
    got = {r["domain_id"]: tuple(r)[1:] for r in revenue.car_side_counts(cars, settings, inventory, vehicles).collect()}
    assert got == {1: (2, 1, 1, 1), 2: (1, 0, 1, 0)}


def test_trips_in_periods_of_a_hot_domain(spark):
    rng = random.Random(4)
    t0 = datetime(2024, 1, 1)
    trips = [(1 if rng.random() < 0.7 else rng.randrange(2, 6), t0 + timedelta(hours=rng.randrange(24 * 200)), rng.randrange(5000)) for _ in range(1500)]
    contracts = []
    for i in range(200):
        start = date(2024, 1, 1) + timedelta(days=rng.randrange(-20, 210))
        contracts.append((i, 1 if i % 2 else rng.randrange(2, 8), start, start + timedelta(days=rng.randrange(-1, 90))))
    got = usage.period_trip_counts(
        spark.createDataFrame(contracts, "contract_id int, domain_id int, period_start_dt date, period_end_dt date"),
        spark.createDataFrame(trips, "domain_id int, trip_start_ts timestamp_ntz, distance_m long"), ["contract_id"],
    )
    want = {}
    for i, d, a, b in contracts:
        inside = [m for e, ts, m in trips if e == d and a <= ts.date() <= b]
        want[i] = (len(inside), sum(inside) // 1000)
    assert {r["contract_id"]: (r["trips"], r["distance_km"]) for r in got.collect()} == want


def test_reshape_drops_by_name_and_pattern(rows):
    df = rows("a_key int, b_key int, note string, c int", (1, 2, "x", 3))
    out = features.reshape(df, drop=["c"], drop_like="key$", keep=["a_key"], rename={"a_key": "id"})
    assert out.columns == ["id", "note"] and tuple(out.first()) == (1, "x")


def test_domain_revenue_has_a_row_per_active_user(rows):
    users = rows("user_id int, domain_name string, email string, first_name string, last_name string, deleted_ts timestamp_ntz, is_locked boolean",
                 (1, "d", "a@d", "A", None, None, False), (2, "d", "b@d", "B", "C", None, False), (3, "d", "c@d", None, None, None, True), (4, "t", "x@t", None, None, None, False))
    domains = rows("domain_name string, is_test boolean", ("d", False), ("t", True))
    cars = rows("domain_name string, ended_ts timestamp_ntz", ("d", None), ("d", datetime(2024, 1, 1)))
    linked = rows("domain_name string, customer_id string, record_nr int", ("d", "K1", 1), ("d", "K2", 1), ("d", "K3", 2))
    customers = rows("customer_id string, current_mrr_eur decimal(12,2)", ("K1", Decimal(100)), ("K2", Decimal(150)), ("K3", Decimal(900)))
    report = rows(f"domain_name string, reporting_date date, {accounts.STATUS[0]} string, {accounts.STATUS[1]} boolean, {accounts.STATUS[2]} boolean, {accounts.STATUS[3]} string, {accounts.STATUS[4]} string",
                  ("d", date(2024, 1, 1), "old", False, False, None, None), ("d", date(2024, 2, 1), "fleet", True, True, "fleet", "active"))
    got = {r["user_id"]: r for r in accounts.domain_mrr(users, domains, cars, linked, customers, report, 200).collect()}
    assert set(got) == {1, 2}
    assert all((r["users"], r["cars"], r["customer_ids"], float(r["current_mrr_eur"]), r["is_large"], r["domain_customer_type"]) == (2, 1, "K1; K2", 250.0, True, "fleet") for r in got.values())


def test_contact_lists_are_put_together_once_per_email(rows):
    """Repeated contacts repeat each customer; an e-mail's customers are gathered before the contacts are joined."""
    contacts = rows("contact_id int, email string", (1, "a"), (1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c"))
    linked = rows("contact_id int, account_name string", (1, "X"), (2, "Y"), (2, "Y"), (2, None), (3, "Z"), (4, "Z"), (5, "Z"))
    customers = rows("email string, customer_id int", ("a", 20), ("a", 3), ("a", None), ("a", 3), ("b", None), (None, 9))
    out = accounts.crm_contacts(contacts, linked, customers)
    got = {tuple(r) for r in out.collect()}
    twice = "20, 20, 3, 3, 3, 3"
    assert got == {(1, "a", "X", twice), (2, "a", "Y", twice), (2, "a", None, "20, 3, 3"), (3, "b", "Z", None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    gathered = next(line for line in plan.splitlines() if "collect_list" in line)
    assert "Aggregate [email" in gathered


def test_contact_lists_are_written_once_for_many_contacts(spark, tmp_path):
    """A list of over 1 MB, which a Parquet dictionary ends at by default, is not written out for every contact."""
    contacts = spark.range(320).selectExpr("id AS contact_id", "'a' AS email")
    linked = contacts.selectExpr("contact_id", "'X' AS account_name")
    customers = spark.range(100_000, 250_000).selectExpr("'a' AS email", "id AS customer_id")
    out = accounts.crm_contacts(contacts, linked, customers)
    out.write.parquet(str(tmp_path / "out"))
    written = sum(f.stat().st_size for f in (tmp_path / "out").iterdir())
    kept = spark.read.parquet(str(tmp_path / "out")).agg(F.count("*"), F.count_distinct("contact_id"), F.min(F.length("customer_ids")), F.max(F.length("customer_ids"))).first()
    assert tuple(kept) == (320, 320, 8 * 150_000 - 2, 8 * 150_000 - 2)
    assert written < 16 * 1_200_000


def test_last_invoice_unfolds_the_items_once(spark):
    """Items of the last invoices; the JSON arrays are read by one branch of the plan only."""
    from rollbook.catalog import migration as m
    from rollbook.catalog.base import Inputs

    t = Inputs(spark, "/root/testdata/sf0.001")
    out = migration.last_invoice_quantity(m.invoices(t), m.customers(t), m.contracts(t), m.products(t), m.plan_map(t), m.INTERNAL)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("from_json(") == 1
