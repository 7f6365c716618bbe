"""Recurring revenue: invoice lines, current revenue, first and current orders, customer segments.

The reporting line shape used below: customer_id, invoice_id, subscription_id, product_group,
invoice_status, start_dt, end_dt (half-open term), full_refund, mrr_eur, refund_mrr_eur,
item_quantity, refund_item_quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day, months_between_whole, years_between_whole
from ..functions.numbers import cents, dec, euro, ratio, round_div
from ..operators.aggregates import has_value, priority_status, sum_if
from ..operators.filters import exclude_value, is_running
from ..operators.joins import two_grain
from ..operators.keyed import join_null_safe, latest_per_key, numbered, with_totals, with_totals_at, with_totals_by

# Status priority of a customer group, and the excluded kind of contract.
STATUS_PRIORITY = ["active", "future", "in_trial", "non_renewing", "cancelled"]
GHOST_CONTRACT = "ghost contract"
DEFAULT_TAX_FACTOR = "1.19"
# Creators that are services, not people.
SERVICE_CREATORS = ["new-user-checkout", "contract-renewal", "importer"]


def product_terms(monthly: Column, product_name: Column, long_term_pattern: str) -> Column:
    """Term length and billing rhythm as text; NULL for one-time products."""
    return terms_text(monthly, product_name.like(long_term_pattern))


def terms_text(monthly: Column, is_long: Column) -> Column:
    months = F.when(is_long, F.lit("36")).otherwise(F.lit("12"))
    rhythm = F.when(monthly, F.lit("monthly")).when(~monthly, F.lit("yearly"))
    return F.concat(months, F.lit(" mths, "), rhythm, F.lit(" payment"))


def billing_months(monthly: Column) -> Column:
    """Months that one price covers."""
    return F.when(monthly, 1).when(~monthly, 12)


def refund_share(df: DataFrame) -> DataFrame:
    """Spread an order's refund over its lines by net price.

    Needs order_id, net_cents, order_net_cents (total), refund_net_cents, monthly_payment, quantity,
    mrr_eur, is_mrr_relevant and has_full_refund; adds refund_mrr_eur and refund_item_quantity.
    """
    months = billing_months(F.col("monthly_payment"))
    part = round_div([F.col("refund_net_cents"), F.col("net_cents")], [F.col("order_net_cents"), months])
    partial = F.coalesce(F.when(F.col("is_mrr_relevant"), part), F.lit(0))
    full, quantity = F.col("has_full_refund"), F.col("quantity")
    items = F.when(full, quantity * 100).otherwise(round_div([quantity, partial, 100], [cents(F.col("mrr_eur"))]))
    return df.withColumns({
        "refund_mrr_eur": F.when(full, F.col("mrr_eur")).otherwise(euro(partial)),
        "refund_item_quantity": euro(F.coalesce(items, F.lit(0))),
    })


def resolve_subscriptions(rows: DataFrame, plans: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One subscription_id per (contract_id, plan_id) of ``rows``.

    A plan has up to two codes (plan_code before plan_code_nbr); each gives a candidate ``contract_code``. The first
    candidate that is a known subscription wins; without any, the id is the contract with a digest of the plan. All
    candidates are looked up in one join of the distinct pairs.
    """
    pairs = rows.select("contract_id", "plan_id").distinct()
    codes = F.array(*[F.struct(F.lit(i).alias("priority"), F.col(c).alias("code")) for i, c in enumerate(("plan_code", "plan_code_nbr"))])
    coded = pairs.join(plans.select("plan_id", "plan_code", "plan_code_nbr"), "plan_id").select("contract_id", "plan_id", F.explode(codes).alias("c"))
    candidates = coded.select("contract_id", "plan_id", "c.priority", F.concat("contract_id", F.lit("_"), "c.code").alias("subscription_id"))
    known = candidates.join(subscriptions.select("subscription_id").distinct(), "subscription_id")
    first = known.groupBy("contract_id", "plan_id").agg(F.min_by("subscription_id", "priority").alias("known_id"))
    digest = F.concat("contract_id", F.lit("_"), F.md5("plan_id"))
    return join_null_safe(pairs, first, ["contract_id", "plan_id"]).select("contract_id", "plan_id", F.coalesce("known_id", digest).alias("subscription_id"))


def _date_levels() -> tuple:
    """The first and last dates of a customer, a subscription and its terms, as levels of totals."""
    kept = F.col("has_full_refund") == F.lit(False)
    when = lambda condition, value: F.when(kept & condition, value) if condition is not None else F.when(kept, value)
    start, month = F.col("start_dt"), F.trunc("start_dt", "month")
    return (
        (["customer_id"], {
            "first_created_dt": F.min("created_dt"), "first_order_dt": F.min(when(None, start)),
            "valid_to_dt": F.coalesce(F.max(when(None, F.col("end_dt"))), F.max("end_dt")),
        }),
        (["subscription_id"], {
            "first_monthly_mth": F.min(when(F.col("monthly_payment"), month)),
            "first_long_term_dt": F.min(when(F.col("product_terms").like("3%"), start)),
        }),
        (["subscription_id", "product_family", "product_terms"], {"first_terms_dt": F.min(when(None, F.col("created_dt")))}),
    )


def first_dates(rows: DataFrame) -> DataFrame:
    """First and last dates of each line's customer, subscription and subscription terms; each key set is aggregated once."""
    return with_totals_by(rows, *_date_levels())


def _live_orders(orders: DataFrame, coupons: DataFrame, invoice_required_from: str | None, billing: dict[str, DataFrame] | None) -> DataFrame:
    """Orders that count, with their coupon's discount and billing id, in the columns that ``invoice_mrr`` returns or computes from."""
    live = exclude_value(orders, "cancelation_reason", GHOST_CONTRACT).filter("order_key IS NOT NULL")
    if invoice_required_from:
        live = live.filter(F.col("invoice_id").isNotNull() | (F.col("created_dt") < day(invoice_required_from)))
    live = live.join(coupons, "coupon_code", "left")
    percent = F.when(F.col("discount_type") == "percentage", F.col("discount_value")).otherwise(F.col("discount_percentage"))
    creator = F.split_part(F.col("creator_urn"), F.lit("/"), F.lit(2))
    live = live.select(
        "order_key", "order_id", "invoice_id", "customer_id", "contract_id", "created_dt", "start_dt", "end_dt", "invoice_status", "discount_cents", "tax_rate",
        "has_refund", "has_full_refund", "contract_status", "contract_canceled_dt", "contract_modified_dt",
        F.lower(F.btrim("coupon_code")).alias("coupon_code"), dec(percent, 10, 2).alias("discount_percent"),
        F.coalesce(~F.col("creator_urn").like("%renewal%"), F.lit(False)).alias("is_new_invoice"),
        F.when((creator != "") & ~creator.isin(SERVICE_CREATORS), creator).alias("creator"),
    )
    if billing:
        live = live.join(billing["customers"].select("customer_id", "billing_customer_id"), "customer_id", "left").withColumns({
            "is_billed": F.col("billing_customer_id").isNotNull(),
            "customer_id": F.coalesce("billing_customer_id", F.col("customer_id").cast("string")),
        }).drop("billing_customer_id")
    return live


def _order_refunds(orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """Refund of each order key and invoice that has one, lying by order_key: one row for them, however many orders share both."""
    refunded = refunds.groupBy("invoice_id").agg(F.sum("refund_net_cents").alias("refund_net_cents"))
    found = orders.filter("order_key IS NOT NULL").select("order_key", "invoice_id").join(refunded, "invoice_id").repartition("order_key")
    return found.groupBy("order_key", F.col("invoice_id").alias("__invoice_id")).agg(F.max("refund_net_cents").alias("refund_net_cents"))


def order_totals(orders: DataFrame) -> DataFrame:
    """Keys of sold orders with the dates of their customer, the amounts of all orders of their id and the last end of their contract."""
    customer, _, _ = _date_levels()
    order = (["order_id"], {"order_net_cents": F.sum("net_cents"), "order_gross_cents": F.sum("gross_cents")})
    contract = (["contract_id"], {"last_end_dt": F.max("end_dt")})
    return with_totals_by(orders.select("order_key", "order_nr", "order_id", "customer_id", "contract_id"), customer, contract, order, source=orders)


def subscription_totals(groups: DataFrame) -> DataFrame:
    """Groups of lines (first dates for each of ``_date_levels``' flags) with the dates of their subscription and its terms."""
    _, subscription, terms = _date_levels()
    return with_totals_at(groups, (["subscription_id", "product_family", "product_terms"], subscription, terms))


def _wanted(columns: list[str]) -> Column:
    """0 or 1 from all columns: a reader that keeps it wants them all, and shares the exchange below with the others."""
    return F.max(F.pmod(F.xxhash64(*columns), F.lit(2)))


def invoice_mrr(
    lines: DataFrame, orders: DataFrame, products: DataFrame, coupons: DataFrame, refunds: DataFrame, long_term_pattern: str, as_of,
    invoice_required_from: str | None = None, billing: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Monthly recurring revenue per invoice line.

    A percentage discount (the coupon's, else the order's) scales the net price. An amount discount is
    shared over the order's lines - by net price for monthly, by gross price for yearly billing - and
    reduced by tax. Yearly prices are divided by twelve, cents by one hundred.

    ``billing`` holds the billing system's frames: customers (customer_id, billing_customer_id), plans and subscriptions.
    Lines of its customers carry their billing ids (see ``resolve_subscriptions``), all others the contract's.

    Lines and orders lie by order_key and stay there; only keys travel. Totals of customers, contracts and order ids are
    those of sold orders; totals of subscriptions are those of the kinds of lines (plan, family and terms) in an order. Lines
    without an order or contract count in the dates, but are left out. The rows of an order key and the groups of a contract
    or subscription are bounded.
    """
    monthly = F.col("monthly_payment")
    terms = F.coalesce(terms_text(monthly, F.col("is_long")), F.lit("one-time"))
    kind = [*(["plan_id"] if billing else []), "product_family", "monthly_payment", "is_long"]
    is_long = F.coalesce(F.col("product_name").like(long_term_pattern), F.lit(False))
    described = products.select(
        "product_key", "product_id", "product_name", *kind[:-1], (F.col("is_recurring") | F.col("is_subsequent_recurring")).alias("recurs"),
    )
    kept = exclude_value(lines, "opcode", "D").select("order_key", "product_key", "net_cents", "gross_cents", "quantity")
    by_order = kept.filter("order_key IS NOT NULL").join(described, "product_key").drop("product_key").repartition("order_key")
    live = numbered(_live_orders(orders, coupons, invoice_required_from, billing), "order_key", "order_nr")

    # an order that has lines, with their sums
    sums = by_order.groupBy("order_key").agg(
        F.sum("net_cents").alias("net_cents"), F.sum("gross_cents").alias("gross_cents"), _wanted(by_order.columns).alias("__seen")
    ).filter("__seen >= 0").drop("__seen")
    sold_orders = live.select(
        "order_key", "order_nr", "order_id", "customer_id", "contract_id", "created_dt", "start_dt", "end_dt", "has_full_refund"
    ).join(sums, "order_key")
    totals = order_totals(sold_orders).filter("order_id IS NOT NULL AND contract_id IS NOT NULL").select(
        "order_key", "order_nr", "first_created_dt", "first_order_dt", "valid_to_dt", "order_net_cents", "order_gross_cents", "last_end_dt"
    )

    numbered_kinds = by_order.withColumn("is_long", is_long).withColumn("kind_nr", F.dense_rank().over(Window.partitionBy("order_key").orderBy(*kind)))
    kinds = numbered_kinds.groupBy("order_key", "kind_nr", *kind).agg(_wanted(by_order.columns).alias("__seen")).filter("__seen >= 0").drop("__seen")
    of_order = ["contract_id", *(["is_billed"] if billing else [])]
    sold = kinds.join(live.select("order_key", "order_nr", *of_order, "has_full_refund", "start_dt", "created_dt"), "order_key")
    keys = [*of_order, *kind]
    groups = sold.groupBy(*keys, "has_full_refund").agg(F.min("start_dt").alias("start_dt"), F.min("created_dt").alias("created_dt"))
    if billing:
        groups = numbered(groups, "contract_id").drop("__nr")
        resolved = resolve_subscriptions(groups.filter("is_billed"), billing["plans"], billing["subscriptions"])
        groups = join_null_safe(groups, resolved, ["contract_id", "plan_id"])
        groups = groups.withColumn("subscription_id", F.when(F.col("is_billed"), F.col("subscription_id")).otherwise(F.col("contract_id")))
    else:
        groups = groups.withColumn("subscription_id", F.col("contract_id"))
    groups = groups.withColumn("product_terms", terms)
    dated = subscription_totals(numbered(groups, "contract_id").drop("__nr")).select(
        *keys, "subscription_id", "first_monthly_mth", "first_long_term_dt", "first_terms_dt"
    ).distinct()
    of_kind = join_null_safe(sold.select("order_key", "order_nr", "kind_nr", *keys), dated, keys).drop(*keys).repartition("order_key")

    status, ended = status_and_end(
        F.col("contract_status"), F.col("last_end_dt"), F.col("contract_canceled_dt"), F.col("contract_modified_dt"), as_of
    )
    # numbers and invoices are compared beside the joins, which so need order_key alone and move no row
    same = lambda name: F.col(name) - F.col(f"__{name}") == 0
    of_key = live.join(totals.repartition("order_key").withColumnRenamed("order_nr", "__order_nr"), "order_key").filter(same("order_nr")).drop("__order_nr")
    back = _order_refunds(orders, refunds).withColumnRenamed("order_key", "__order_key")
    refunded = (F.col("order_key") == F.col("__order_key")) & F.coalesce(F.col("invoice_id") == F.col("__invoice_id"), F.lit(False))
    of_key = of_key.join(back, refunded, "left").drop("__order_key", "__invoice_id").withColumns({
        "status_code": status, "terminated_dt": ended, "refund_net_cents": F.coalesce("refund_net_cents", F.lit(0)),
        "invoice_id": F.coalesce("invoice_id", F.concat(F.lit("o-"), F.col("order_id").cast("string"))),
    })
    of_kind = of_kind.withColumnsRenamed({"order_nr": "__order_nr", "kind_nr": "__kind_nr"})
    rows = numbered_kinds.join(of_kind, "order_key").filter(same("kind_nr")).drop("__kind_nr")
    rows = rows.join(of_key, "order_key").filter(same("order_nr")).withColumn("product_terms", terms)

    net, gross = F.col("net_cents"), F.col("gross_cents")
    amount = F.col("discount_cents")
    percent = F.col("discount_percent")
    tax = F.coalesce(1 + dec(F.col("tax_rate"), 4, 2), F.lit(DEFAULT_TAX_FACTOR).cast("decimal(5,2)"))
    by_net = round_div([amount, net, 100], [F.col("order_net_cents"), cents(tax)])
    by_gross = round_div([amount, gross, 100], [F.col("order_gross_cents"), cents(tax)])
    off = F.when(monthly, by_net).otherwise(by_gross)
    hundredfold = F.when(percent > 0, net * (100 - cents(percent))).when(amount > 0, (net - off) * 100).otherwise(net * 100)
    per_month = round_div([hundredfold], [100, billing_months(monthly)])
    relevant = (F.col("net_cents") > 0) & F.col("recurs")

    rows = rows.withColumns({
        "is_mrr_relevant": F.coalesce(relevant, F.lit(False)),
        "discount_kind": F.when(percent > 0, "percentage").when(amount > 0, "amount"),
        "discount_value_eur": F.when(percent > 0, percent).when(amount > 0, euro(by_gross)),
        "discount_share": ratio(amount, F.col("order_gross_cents"), 3),
        "mrr_eur": euro(F.coalesce(F.when(relevant, per_month), F.lit(0))),
    })
    return refund_share(rows).select(
        "invoice_id", "subscription_id", "customer_id", "created_dt", "invoice_status", "start_dt", "end_dt",
        (F.col("created_dt") == F.col("first_created_dt")).alias("is_first_invoice"), "is_new_invoice", "creator",
        "status_code", "terminated_dt", "first_order_dt", "valid_to_dt", "first_monthly_mth", "first_long_term_dt", "first_terms_dt",
        "coupon_code", "discount_kind", "discount_value_eur", "discount_share",
        "has_refund", "has_full_refund", "product_id", "product_name", F.col("product_family").alias("product_group"), "product_terms",
        "mrr_eur", "refund_mrr_eur", F.col("quantity").alias("item_quantity"), "refund_item_quantity",
    )


def status_and_end(status: Column, last_end: Column, canceled: Column, modified: Column, as_of) -> tuple[Column, Column]:
    """Status code (0 cancelled, 1 non-renewing, 2 active) and termination date of a contract.

    An active contract counts as cancelled once its last provisioning ended over six months ago.
    """
    lapsed = last_end < F.add_months(day(as_of), -6)
    code = F.when((status == "active") & lapsed, 0).when(status == "terminated", 0).when(status == "canceled", 1).when(status == "active", 2)
    return code, F.when((status != "active") | lapsed, F.coalesce(canceled, modified))


def contract_status(df: DataFrame, as_of) -> DataFrame:
    """Status code and termination date per row. Needs contract_id, status, end_dt, canceled_dt, modified_dt."""
    rows = with_totals(df, ["contract_id"], last_end_dt=F.max("end_dt"))
    code, ended = status_and_end(F.col("status"), F.col("last_end_dt"), F.col("canceled_dt"), F.col("modified_dt"), as_of)
    return rows.withColumns({"status_code": code, "terminated_dt": ended})


def _valid(lines: DataFrame) -> DataFrame:
    return lines.filter((F.col("invoice_status") != "voided") & ~F.col("full_refund"))


def current_mrr(lines: DataFrame, customers: DataFrame, as_of, product_group: str | None = None) -> DataFrame:
    """Net recurring revenue of terms running at ``as_of`` per customer, optionally for one product group."""
    rows = lines.filter((F.col("invoice_status") != "voided") & is_running("start_dt", "end_dt", as_of))
    if product_group:
        rows = rows.filter(F.col("product_group") == product_group)
    per_customer = rows.groupBy("customer_id").agg(F.sum(F.col("mrr_eur") - F.col("refund_mrr_eur")).alias("mrr_eur"))
    return customers.join(per_customer, "customer_id")


def product_revenue(lines: DataFrame, as_of, groups: dict[str, list[str]], skip: list[str] = ()) -> DataFrame:
    """Current revenue and licences per customer, in total, per named product group, and for the rest."""
    rows = lines.filter((F.col("invoice_status") != "voided") & is_running("start_dt", "end_dt", as_of))
    if skip:
        rows = rows.filter(~F.col("product_group").isin(list(skip)))
    mrr, items = F.col("mrr_eur") - F.col("refund_mrr_eur"), F.col("item_quantity") - F.col("refund_item_quantity")
    listed = [g for names in groups.values() for g in names]
    aggs = [F.coalesce(F.sum(mrr), F.lit(0)).alias("mrr_total"), F.coalesce(F.sum(items), F.lit(0)).alias("items_total")]
    for name, names in [*groups.items(), ("other", None)]:
        hit = F.col("product_group").isin(names) if names else ~F.col("product_group").isin(listed)
        aggs.append(F.coalesce(sum_if(hit, mrr), F.lit(0)).alias(f"mrr_{name}"))
        aggs.append(F.coalesce(sum_if(hit, items), F.lit(0)).alias(f"items_{name}"))
    return rows.groupBy("customer_id").agg(*aggs)


def car_side_counts(cars: DataFrame, settings: DataFrame, inventory: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Per domain: running cars, running cars with tracking and with tracking by the driver, running bookable cars.

    cars: domain_id, ended_ts. settings: domain_id, vehicle_urn, has_tracking, has_dynamic_tracking. inventory: domain_id,
    resource_urn, is_bookable. vehicles: vehicle_id, ended_ts; an urn names its vehicle behind the first slash.
    """
    running = vehicles.filter("ended_ts IS NULL").select(F.col("vehicle_id").cast("string").alias("vehicle_id"))
    of_urn = lambda df, urn: df.withColumn("vehicle_id", F.split_part(F.col(urn), F.lit("/"), F.lit(2))).join(running, "vehicle_id")
    tracked = of_urn(settings.filter("has_tracking OR has_dynamic_tracking"), "vehicle_urn")
    booked = of_urn(inventory.filter("is_bookable"), "resource_urn")
    kinds = {
        "cars": cars.filter("ended_ts IS NULL"), "tracked_cars": tracked.filter("has_tracking"),
        "dynamic_cars": tracked.filter("has_dynamic_tracking"), "bookable_cars": booked,
    }
    counted = None
    for kind, df in kinds.items():
        part = df.select("domain_id", F.lit(kind).alias("kind"))
        counted = part if counted is None else counted.unionByName(part)
    return counted.groupBy("domain_id").agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds])


def licence_check(
    revenue: DataFrame, domain_map: DataFrame, configurations: DataFrame, cars: DataFrame, flags: list[str], car_counts: dict[str, str]
) -> DataFrame:
    """Licences against cars per customer.

    ``configurations`` holds one row per domain with boolean ``flags``; ``cars`` one row per domain with
    count columns; ``car_counts`` maps a count column to the licence column it is compared with.
    """
    domains = configurations.join(cars, "domain_id", "left").fillna(0, list(car_counts))
    linked = domain_map.join(domains, "domain_id", "left")
    per_customer = linked.groupBy("customer_id").agg(
        F.count("domain_id").alias("domains"),
        *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags],
        *[F.sum(c).alias(c) for c in car_counts],
    )
    out = revenue.filter("mrr_total > 0").join(per_customer, "customer_id", "left").fillna(0, ["domains"]).fillna(False, flags)
    for count, licences in car_counts.items():
        verdict = (
            F.when(F.col("domains") == 0, "no linked domain")
            .when(F.col(count) > F.col(licences), "cars > licenses")
            .when(F.col(count) <= F.col(licences), "cars <= licenses")
        )
        out = out.withColumn(f"{count}_check", verdict)
    return out


def net_quantity(quantity: Column, refund: Column, mrr: Column) -> Column:
    """quantity * (1 - refund / mrr), rounded to one digit; NULL for no revenue."""
    paid = cents(mrr)
    return (round_div([quantity, paid - cents(refund), 10], [paid]) / dec(F.lit(10), 2)).cast("decimal(18,1)")


def first_starts(lines: DataFrame) -> DataFrame:
    return _valid(lines).groupBy("customer_id").agg(F.min("start_dt").alias("first_start_dt"))


def first_order_profile(lines: DataFrame, customers: DataFrame, domain_map: DataFrame, product_group: str) -> DataFrame:
    """Per domain: status and net quantity of ``product_group`` bought on the customers' first day."""
    bought = _valid(lines).filter(F.col("product_group") == product_group)
    rows = (
        bought.join(first_starts(lines), "customer_id")
        .filter(F.col("start_dt") == F.col("first_start_dt"))
        .join(customers.select("customer_id", "customer_status"), "customer_id")
        .join(domain_map, "customer_id")
    )
    return rows.groupBy("domain_id").agg(
        priority_status(F.col("customer_status"), STATUS_PRIORITY).alias("customer_status"),
        F.min("first_start_dt").alias("first_start_dt"),
        net_quantity(F.sum("item_quantity"), F.sum("refund_mrr_eur"), F.sum("mrr_eur")).alias("item_quantity"),
    )


def initial_current_orders(lines: DataFrame, customers: DataFrame, domain_map: DataFrame, products: list[str], as_of) -> DataFrame:
    """Per domain: products and net quantity of the initial order and of the order running at ``as_of``."""
    running = _valid(lines).filter(is_running("start_dt", "end_dt", as_of)).select("invoice_id").distinct()
    rows = (
        _valid(lines).filter(F.col("product_group").isin(products))
        .join(first_starts(lines), "customer_id", "left")
        .join(running.withColumn("is_current", F.lit(True)), "invoice_id", "left")
        .withColumn("is_initial", F.coalesce(F.col("start_dt") == F.col("first_start_dt"), F.lit(False)))
        .withColumn("is_current", F.coalesce("is_current", F.lit(False)))
        .filter("is_initial OR is_current")
        .join(customers.select("customer_id", "customer_status"), "customer_id")
        .join(domain_map, "customer_id")
    )
    group, aggs = F.col("product_group"), [priority_status(F.col("customer_status"), STATUS_PRIORITY).alias("customer_status")]
    for product in products:
        aggs.append(F.min(F.when(group == product, F.col("start_dt"))).alias(f"first_dt_{product.lower()}"))
    for kind in ("initial", "current"):
        flag = F.col(f"is_{kind}")
        aggs += [has_value(group, p, flag).alias(f"{kind}_has_{p.lower()}") for p in products]
        parts = [sum_if(flag, F.col(c)) for c in ("item_quantity", "refund_mrr_eur", "mrr_eur")]
        aggs.append(net_quantity(*parts).alias(f"{kind}_quantity"))
    return rows.groupBy("domain_id").agg(*aggs)


def first_occurrence_mrr(report: DataFrame) -> DataFrame:
    """Revenue per invoice and plan, counted in its first reporting month only."""
    first = latest_per_key(report, ["invoice_id", "plan_id"], [F.col("reporting_month").asc(), F.col("mrr_eur").asc()])
    return first.groupBy("invoice_id", "plan_id").agg(F.sum("mrr_eur").alias("mrr_eur"))


# ---------------------------------------------------------------- segments of the monthly report


def map_product(col: Column, named: list[str]) -> Column:
    """The product group itself when named, else ``Other``."""
    return F.when(col.isin(named), col).otherwise(F.when(col.isNotNull(), F.lit("Other")))


def customer_value(report: DataFrame, named: list[str], country_groups: dict[str, str], other_countries: str) -> DataFrame:
    """Initial, current, last non-zero revenue and lifetime expansion per customer, country group, status and product.

    Needs customer_id, customer_country, customer_status, is_fleet, flag_future, reporting_month, product_group, mrr_eur,
    mrr_eur_new, mrr_change (expansion plus contraction) and churn_mth. Only past months of fleet customers are valued;
    the churn month is the last one marked in any row of the customer.
    """
    churned = report.filter("churn_mth").groupBy("customer_id").agg(F.max("reporting_month").alias("churn_month"))
    group = F.lit(other_countries)
    for country, name in country_groups.items():
        group = F.when(F.col("customer_country") == country, name).otherwise(group)
    valued = report.filter("is_fleet AND NOT flag_future").withColumns({"country_group": group, "product": map_product(F.col("product_group"), named)})
    rows = with_totals_by(
        valued,
        (["customer_id"], {
            "last_month": F.max("reporting_month"),
            "last_value_month": F.max(F.when(F.col("mrr_eur") > 0, F.col("reporting_month"))),
        }),
        (["customer_id", "reporting_month"], {"month_change": F.sum("mrr_change")}),
    ).join(churned, "customer_id", "left")
    month = F.col("reporting_month")
    first = F.coalesce(F.col("mrr_eur_new") > 0, F.lit(False))
    current, expanding = month == F.col("last_month"), F.coalesce(F.col("month_change") > 0, F.lit(False))
    last_value = F.coalesce(month == F.col("last_value_month"), F.lit(False))
    amount = lambda flag, col: F.coalesce(sum_if(flag, F.col(col)), F.lit(0))
    return rows.filter(first | current | expanding | last_value).groupBy("customer_id", "country_group", "customer_status", "churn_month", "product").agg(
        amount(first, "mrr_eur").alias("mrr_eur_initial"),
        amount(current, "mrr_eur").alias("mrr_eur_current"),
        amount(last_value, "mrr_eur").alias("mrr_eur_last_value"),
        amount(expanding, "mrr_change").alias("expansion_eur"),
    )


def tenure_expansion(report: DataFrame, named: list[str], by_product: bool) -> DataFrame:
    """Expansion revenue by tenure month and tenure year, with or without product.

    Only months whose summed change is positive count. Needs customer_id, reporting_month, product_group,
    first_month and mrr_change. The month rows keep one row per (customer, product, month).
    """
    keys = ["customer_id", "product"] if by_product else ["customer_id"]
    scope = ["customer_id", "reporting_month"] + (["product_group"] if by_product else [])
    offset = 1 if by_product else 0
    rows = with_totals(report, scope, scope_change=F.sum("mrr_change")).withColumns({
        "product": map_product(F.col("product_group"), named),
        "tenure_mths": months_between_whole(F.col("reporting_month"), F.col("first_month")) + offset,
        "tenure_years": years_between_whole(F.col("reporting_month"), F.col("first_month")) + offset,
        "gain": F.when(F.col("scope_change") > 0, F.col("mrr_change")),
    })
    fine = [*keys, "tenure_years", "tenure_mths"]
    return two_grain(
        rows, fine, [*keys, "tenure_years"],
        F.coalesce(F.sum("gain"), F.lit(0)).alias("month_expansion_eur"),
        F.sum("month_expansion_eur").alias("year_expansion_eur"),
    )
