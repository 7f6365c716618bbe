"""Exchanges and readers of the migration steps, and their rows against the plain joins."""

from contextlib import contextmanager
from datetime import date, datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook.plans import migration


@contextmanager
def no_broadcast(spark):
    """Joins as over large tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def planned(df):
    """The plan before any stage has run."""
    return df._jdf.queryExecution().executedPlan().toString()


ITEM = '{"product_id":"%s","quantity":%d,"price":{"net":{"amount":%d}}}'
TS = datetime(2024, 3, 1, 23)


@pytest.fixture
def shop(rows):
    items = lambda *found: "[" + ",".join(ITEM % x for x in found) + "]"
    customers = rows("customer_key long, contact string", (1, '{"email":"a@firm"}'), (2, '{"email":"b@in"}'))
    products = rows(
        "product_id string, plan_id string, addon_id string, addon_price_net int, monthly_payment boolean",
        ("1", "yearly", None, None, False), ("2", "monthly", None, None, True), ("3", "odd", None, None, False), (migration.ZERO_PRODUCT, "yearly", None, None, True),
    )
    contracts = rows(
        "contract_id string, customer_key long, items string",
        ("a", 1, items(("1", 2, 5), ("1", 3, 7), ("2", 1, 4))), ("b", 2, items(("1", 1, 1))), (None, 1, items(("1", 9, 7))), ("c", 1, items(("fake", 1, 2))),
    )
    invoices = rows(
        "contract_id string, customer_key long, items_added string, start_ts timestamp_ntz, end_ts timestamp_ntz",
        ("a", 1, items(("1", 1, 7), ("3", 1, 9)), TS, TS), ("a", 1, items(("2", 1, 8)), TS, TS), (None, 1, items(("1", 1, 7)), TS, TS), ("c", 1, None, None, None),
    )
    plans = rows("plan_id string, plan_nr int", ("yearly", 1), ("monthly", 2))
    return contracts, customers, invoices, products, plans


def both(shop):
    contracts, customers, invoices, products, plans = shop
    of_invoices = migration.invoice_plans(invoices, customers, products, plans, "%@in")
    return of_invoices, migration.contract_plans(contracts, customers, products, plans, "%@in")


def test_items_are_unfolded_once_and_plans_meet_per_contract(spark, shop):
    with no_broadcast(spark):
        plan = planned(migration.unique_subscriptions(migration.plan_quantities(*both(shop))))
    assert plan.count("from_json(") == 2  # one of the contracts, one of the invoices
    above = plan[: plan.index("Union")]
    assert above.count("Exchange ") == 1 and "Exchange hashpartitioning(contract_id" in above


def test_items_move_once_to_the_catalogue(spark, shop):
    with no_broadcast(spark):
        plan = planned(both(shop)[0])
    moved = [line for line in plan[: plan.index("from_json(")].splitlines() if "Exchange hashpartitioning(" in line]
    assert [line.split("hashpartitioning(")[1].split("#")[0] for line in moved] == ["contract_id", "product_id"]


def test_dates_of_invoice_plans(shop):
    got = {(r["contract_id"], r["plan_id"]): r["min_start_dt"] for r in both(shop)[0].collect()}
    assert got == {(c, p): date(2024, 3, 2) for c, p in [("a", "yearly"), ("a", "odd"), ("a", "monthly"), (None, "yearly")]}


def joined(from_invoices, from_contracts):
    """Quantities by a plain join."""
    keys = ["contract_id", "plan_id", "unit_price_net"]
    columns = ["contract_id", "plan_id", "plan_nr", "unit_price_net", "addon_id", "addon_price_net", "monthly_payment"]
    totals = from_contracts.groupBy(*columns).agg(F.sum("item_quantity").alias("item_quantity"))
    found = from_invoices.select(*columns).join(totals.select(*keys, "item_quantity"), keys, "left")
    return found.select(*columns, F.coalesce("item_quantity", F.lit(0)).alias("item_quantity")).union(totals).distinct()


def test_quantities_as_by_a_join(rows, shop):
    schema = "contract_id string, plan_id string, plan_nr int, unit_price_net long, addon_id string, addon_price_net int, monthly_payment boolean"
    keys = [(c, p, u) for c in ("a", "b", None) for p in ("x", None) for u in (1, 2, None)]
    invoices = rows(schema, *[(c, p, 1, u, a, None, True) for c, p, u in keys for a in (None, "s")][5:] * 2)
    contracts = rows(schema + ", item_quantity long", *[(c, p, n, u, None, 3, m, q) for c, p, u in keys[:-4] for n, m, q in ((1, True, 4), (1, True, 4), (2, None, None), (1, False, 0))])
    for left, right in ((invoices, contracts), both(shop)):
        got, want = (sorted(map(tuple, x.collect()), key=str) for x in (migration.plan_quantities(left, right), joined(left, right)))
        assert got == want and got


def test_invoice_dates_leave_rows_with_their_contract(spark, rows):
    base = rows("x int, plan_id string, contract_id string", (1, "p", "a"), (1, "p", "a"), (2, "q", "a"), (3, None, "a"), (4, "p", None), (5, "p", "b"))
    dates = rows(
        "contract_id string, plan_id string, min_start_dt date, max_start_dt date, max_end_dt date",
        *[(c, p, date(2024, 1, d), None, date(2024, 2, d)) for c, p, d in [("a", "p", 1), ("a", "p", 2), ("a", None, 3), (None, "p", 4), ("b", "q", 5)]],
    )
    got, want = migration.with_invoice_dates(base, dates), base.join(dates, ["contract_id", "plan_id"], "left")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    with no_broadcast(spark):
        plan = planned(migration.with_invoice_dates(base, dates).withColumn("n", F.count("*").over(Window.partitionBy("contract_id"))))
    assert plan.count("Exchange hashpartitioning(contract_id") == 2  # the rows and the dates, once each
    assert plan.count("Exchange ") == 2
