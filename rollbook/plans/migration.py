"""Moving shop contracts to a subscription system: one function per step.

Every step takes and returns a DataFrame, nothing is collected, and the reference date is an argument.
Dates are local (business zone) dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.dates import day, local_date, months_between_whole, years_between_whole
from ..functions.json import json_get
from ..functions.numbers import round_div
from ..functions.text import clean_text, house_number_of, phone_number, postal_code, street_of
from ..operators.aggregates import any_true
from ..operators.filters import exclude_value
from ..operators.items import explode_items
from ..operators.joins import repair_key
from ..operators.keyed import latest_per_key, spread_totals
from ..session import materialise
from ..sources.export import ExportColumn, export_layout

# Fixed values of the migration rules.
SENTINEL_PRODUCT, ZERO_PRODUCT = "fake", "00000000-0000-0000-0000-000000000000"
LIFETIME_PLANS = ["logbook_b2c-from_rent2buy-eur", "logbook_b2c-one_time_buy-eur"]
ADDON_PLAN, HARDWARE_PLANS = "addons-plan", "hardware%"
LONG_TERM, MONTHLY = "%3_years%", "%month%"
GHOST_CONTRACT = "ghost contract"
STATUS_MAP = {"active": "active", "canceled": "non_renewing", "terminated": "cancelled"}
LIVE_STATUS = ["active", "future", "non_renewing"]
CANCELLATION_CUTOFF = 28
ZERO_AS_NULL = "n/a"

def _one_contract() -> WindowSpec:
    """All rows of a contract. After aggregation it has one row per plan and add-on, so its size is bounded by
    the catalogue and a plain window is safe; totals joined back would compute all earlier steps twice."""
    return Window.partitionBy("contract_id")


def batch_progress(batch: DataFrame) -> DataFrame:
    """Distinct customers per batch: to migrate, pending, migrated, and in an error state."""
    pending, migrated = F.col("is_pending"), F.col("is_migrated")
    customers = lambda condition: F.count_distinct(F.when(condition, F.col("customer_id")))
    return batch.groupBy("batch_definition").agg(
        customers(~pending).alias("to_be_migrated"), customers(pending & ~migrated).alias("in_pending"),
        customers(migrated).alias("migrated"), customers(migrated & ~pending).alias("errors"),
    )


def batch_customers(customers: DataFrame, current: DataFrame, batch: DataFrame, skip_current: str, skip_batch: str) -> DataFrame:
    """Customers of the current batch without the excluding comments."""
    in_current = exclude_value(current, "comment", skip_current).select("customer_id")
    in_batch = exclude_value(batch, "comment", skip_batch).select("customer_id")
    return customers.join(in_current, "customer_id", "left_semi").join(in_batch, "customer_id", "left_semi")


def _percent_code(ten_thousandths: Column) -> Column:
    """dummy_pct_<0 or 1>_<four digits> for a share in 1/10000."""
    digits = F.lpad((ten_thousandths % 10000).cast("string"), 4, "0")
    return F.concat(F.when(ten_thousandths < 10000, F.lit("dummy_pct_0_")).otherwise(F.lit("dummy_pct_1_")), digits)


def amount_to_percent(invoices: DataFrame) -> DataFrame:
    """Coupon code for an amount discount: its share of the undiscounted price on the latest invoice of a contract."""
    amount = json_get(F.col("discount"), "value.amount", "bigint")
    gross = json_get(F.col("total_price"), "gross.amount", "bigint")
    rows = invoices.filter((json_get(F.col("discount"), "type") == "amount") & (amount > 0))
    rows = rows.select("contract_id", "created_ts", "invoice_id", amount.alias("a"), gross.alias("g"))
    latest = latest_per_key(rows, ["contract_id"], [F.col("created_ts").desc(), F.col("invoice_id")])
    return latest.select("contract_id", _percent_code(round_div([F.col("a"), 10000], [F.col("a") + F.col("g")])).alias("amount_code"))


def _external(customers: DataFrame, internal_emails: str) -> DataFrame:
    return customers.filter(~json_get(F.col("contact"), "email").like(internal_emails))


def _mapped_items(df: DataFrame, column: str, keep: list[str], products: DataFrame, plan_map: DataFrame) -> DataFrame:
    rows = explode_items(df, column, keep=keep)
    rows = rows.withColumn("product_id", repair_key(F.col("product_id"), SENTINEL_PRODUCT, ZERO_PRODUCT))
    return rows.join(products.join(plan_map, "plan_id", "left"), "product_id")  # the catalogue first: items move once


PLAN_KEYS = ["contract_id", "plan_id", "plan_nr", "addon_id", "monthly_payment"]


def contract_plans(contracts: DataFrame, customers: DataFrame, products: DataFrame, plan_map: DataFrame, internal_emails: str) -> DataFrame:
    """Items of the contracts per plan: highest unit price and add-on price, summed quantity."""
    mine = contracts.join(_external(customers, internal_emails).select("customer_key"), "customer_key", "left_semi")
    return _mapped_items(mine, "items", ["contract_id"], products, plan_map).groupBy(*PLAN_KEYS).agg(
        F.max("addon_price_net").alias("addon_price_net"), F.max("unit_net_cents").alias("unit_price_net"), F.sum("quantity").alias("item_quantity")
    )


def invoice_plans(invoices: DataFrame, customers: DataFrame, products: DataFrame, plan_map: DataFrame, internal_emails: str) -> DataFrame:
    """Items of the invoices per plan with the first and last provisioning dates."""
    mine = invoices.join(_external(customers, internal_emails).select("customer_key"), "customer_key", "left_semi")
    # dated once per invoice, not per item
    dated = mine.withColumns({"start_dt": local_date(F.col("start_ts")), "end_dt": local_date(F.col("end_ts"))})
    rows = _mapped_items(dated, "items_added", ["contract_id", "start_dt", "end_dt"], products, plan_map)
    return rows.groupBy(*PLAN_KEYS).agg(
        F.max("addon_price_net").alias("addon_price_net"), F.max("unit_net_cents").alias("unit_price_net"),
        F.min("start_dt").alias("min_start_dt"), F.max("start_dt").alias("max_start_dt"), F.max("end_dt").alias("max_end_dt"),
    )


def plan_quantities(from_invoices: DataFrame, from_contracts: DataFrame) -> DataFrame:
    """Invoice plans with the contract's quantity (0 if none), and all contract plans; duplicates merged.

    Both meet per contract, so the contract's plans are read once, and what follows per contract needs no further exchange.
    """
    columns = ["contract_id", "plan_id", "plan_nr", "unit_price_net", "addon_id", "addon_price_net", "monthly_payment"]
    totals = from_contracts.groupBy(*columns).agg(F.sum("item_quantity").alias("item_quantity"))
    invoiced = from_invoices.select(*columns, F.lit(None).cast("bigint").alias("item_quantity"), F.lit(True).alias("invoiced"))
    rows = invoiced.unionByName(totals.withColumn("invoiced", F.lit(False)))
    sold = F.struct("plan_id", "unit_price_net", F.coalesce("item_quantity", F.lit(0)).alias("item_quantity"))
    # a set will do, as duplicates are merged; a contract that is NULL equals no other
    rows = rows.withColumn("sold", F.collect_set(F.when(~F.col("invoiced") & F.col("contract_id").isNotNull(), sold)).over(_one_contract()))
    same = F.filter("sold", lambda x: (x["plan_id"] == F.col("plan_id")) & (x["unit_price_net"] == F.col("unit_price_net")))["item_quantity"]
    quantities = F.when(~F.col("invoiced"), F.array("item_quantity")).when(F.size(same) > 0, same).otherwise(F.array(F.lit(0).cast("bigint")))
    return rows.select(*columns, F.explode(quantities).alias("item_quantity")).distinct()


def unique_subscriptions(plans: DataFrame) -> DataFrame:
    """One row per subscription id (contract and plan number) and add-on."""
    unit = F.when(F.col("addon_id").isNull(), F.col("unit_price_net")).otherwise(0)
    rows = plans.groupBy("contract_id", "plan_nr", "plan_id", "addon_id", "addon_price_net").agg(
        any_true(F.col("monthly_payment")).alias("monthly_payment"), F.max(unit).alias("plan_unit_price"), F.sum("item_quantity").alias("item_quantity")
    )
    subscription = F.concat("contract_id", F.lit("_"), F.col("plan_nr").cast("string"))
    return rows.withColumn("subscription_id", subscription)


CONTACT_SCHEMA = (
    "first_name string, last_name string, email string, company_name string, phone_number string, mobile_phone_number string, "
    "address struct<street_address:string, locality:string, postal_code:string, country:string>"
)


def shipping_contacts(customers: DataFrame) -> DataFrame:
    """One row per customer with the cleaned contact: the shipping contact's value, else the contact's.

    Cleaned here, once per customer, so that the many subscriptions of a customer only join the result.
    """
    docs = customers.select(
        "customer_key", "customer_id", F.from_json("contact", CONTACT_SCHEMA).alias("c"), F.from_json("shipping_contact", CONTACT_SCHEMA).alias("s")
    )
    either = lambda path: F.coalesce(F.col("s." + path), F.col("c." + path))
    cleaned = lambda path: F.coalesce(*[F.btrim(clean_text(F.col(f"{doc}.{path}"))) for doc in "sc"])
    address = lambda path: F.nullif(clean_text(F.btrim(either("address." + path))), F.lit(ZERO_AS_NULL))
    # of the contact's own e-mail all blanks are removed
    email = F.lower(F.coalesce(F.btrim(clean_text(F.col("s.email"))), F.replace(clean_text(F.col("c.email")), F.lit(" "), F.lit(""))))
    return docs.select(
        "customer_key", "customer_id", F.lower(clean_text(F.col("c.email"))).alias("customer_email"),
        cleaned("first_name").alias("ship_first_name"), cleaned("last_name").alias("ship_last_name"), email.alias("ship_email"),
        cleaned("company_name").alias("ship_company"),
        F.coalesce(phone_number(either("phone_number")), phone_number(either("mobile_phone_number"))).alias("ship_phone"),
        address("street_address").alias("ship_address"), address("locality").alias("ship_city"),
        postal_code(either("address.postal_code")).alias("ship_zip"), address("country").alias("ship_country"),
    )


def percent_code(discount: Column) -> Column:
    """Coupon code of a percentage discount document."""
    kind, value = json_get(discount, "type"), json_get(discount, "value", "decimal(10,4)")
    return F.when((kind == "percentage") & (value > 0), _percent_code((value * 10000).cast("bigint")))


def subscription_base(subscriptions: DataFrame, contracts: DataFrame, customers: DataFrame, amount_codes: DataFrame) -> DataFrame:
    """Subscriptions with mapped status, contract dates, coupon and the cleaned shipping contact.

    The coupon is the contract's, else a code for its percentage discount, else the code for its amount discount.
    """
    mapped = F.create_map(*[F.lit(x) for pair in STATUS_MAP.items() for x in pair])[F.col("status")]
    dated = {"contract_created_dt": "created_ts", "tmp_started_dt": "started_ts", "tmp_term_start_dt": "period_start_ts",
             "tmp_term_end_dt": "period_end_ts", "cancelled_dt": "canceled_ts", "modified_dt": "modified_ts"}
    live = exclude_value(contracts, "cancelation_reason", GHOST_CONTRACT).select(
        "contract_id", "customer_key", mapped.alias("mapped_status"), *[local_date(F.col(src)).alias(dst) for dst, src in dated.items()],
        F.col("cancelation_reason").alias("cancel_reason"), F.coalesce("coupon_code", percent_code(F.col("discount"))).alias("own_code"),
    )
    contacts = shipping_contacts(customers)
    # by customer first: codes and subscriptions then meet the contract in one exchange
    rows = live.join(contacts, "customer_key").join(amount_codes, "contract_id", "left").join(subscriptions, "contract_id")
    lifetime = F.col("plan_id").isin(LIFETIME_PLANS)
    return rows.select(
        "contract_id", "subscription_id", "plan_id",
        F.when(F.col("addon_id").isNotNull(), 1).otherwise(F.col("item_quantity")).alias("plan_quantity"), "plan_unit_price",
        F.when(F.col("addon_id").isNotNull() | lifetime, "cancelled").otherwise(F.col("mapped_status")).alias("status"), *dated, "cancel_reason",
        F.coalesce(lifetime, F.lit(False)).alias("lifetime_licence"), F.when(F.col("plan_id").like(MONTHLY), 12).otherwise(1).alias("renewal_cycles"),
        F.coalesce("own_code", "amount_code").alias("coupon"), "customer_id", *[c for c in contacts.columns if c == "customer_email" or c.startswith("ship_")],
        "addon_id", F.col("item_quantity").alias("addon_quantity"), F.col("addon_price_net").alias("addon_unit_price"),
    )


def with_invoice_dates(base: DataFrame, from_invoices: DataFrame) -> DataFrame:
    """Add the first and last provisioning dates of the plan's invoices.

    The dates of a contract's plans (few, see ``_one_contract``) join in one row, so the wide rows of ``base`` stay with
    their contract.
    """
    dates = ["min_start_dt", "max_start_dt", "max_end_dt"]
    plans = from_invoices.groupBy("contract_id").agg(F.collect_list(F.struct("plan_id", *dates)).alias("plans"))
    own = F.filter("plans", lambda x: x["plan_id"] == F.col("plan_id"))
    rest = [c for c in base.columns if c not in ("contract_id", "plan_id")]
    rows = base.join(plans, "contract_id", "left").select("contract_id", "plan_id", *rest, F.explode_outer(own).alias("own"))
    return rows.select("contract_id", "plan_id", *rest, *[F.col(f"own.{c}").alias(c) for c in dates])


def term_dates(df: DataFrame) -> DataFrame:
    """Plan kind, subscription start and current term from the invoice dates."""
    addon, unbilled, term_start = F.col("plan_id") == ADDON_PLAN, F.col("min_start_dt").isNull(), F.col("tmp_term_start_dt")
    from_invoice = lambda column: F.when(addon, term_start).when(unbilled, None).otherwise(F.col(column))
    return df.withColumns({
        "is_3y": F.coalesce(F.col("plan_id").ilike(LONG_TERM), F.lit(False)),
        "is_monthly": F.coalesce(F.col("plan_id").ilike(MONTHLY), F.lit(False)),
        "started_dt": F.when(addon, term_start).when(unbilled, F.col("tmp_term_end_dt")).otherwise(F.least(term_start, F.col("min_start_dt"))),
        "term_start_dt": from_invoice("max_start_dt"),
        "term_end_dt": from_invoice("max_end_dt"),
    })


def contract_end(df: DataFrame, as_of) -> DataFrame:
    """Contract end by plan length and billing, never before the current term's end.

    Yearly billed 3-year plans end on the term end's day in the year of the contract's earliest 3-year start,
    plus 3 years (29 February becomes the 28th); monthly billed ones 3 years after that start; other yearly
    plans with the term; other monthly plans at the end of the running contract year.
    """
    today, end, started = day(as_of), F.col("term_end_dt"), F.col("started_dt")
    first = F.col("first_3y_dt")
    rows = df.withColumn("first_3y_dt", F.min(F.when(F.col("is_3y"), started)).over(_one_contract()))
    same_day = F.add_months(end, (F.year(first) - F.year(end)) * 12)
    month = F.trunc(today, "month")
    years = years_between_whole(month, F.date_add(F.trunc(started, "month"), 1)) + 1
    candidate = (
        F.when(F.col("is_3y") & ~F.col("is_monthly"), F.add_months(same_day, 36)).when(F.col("is_3y"), F.add_months(first, 36))
        .when(~F.col("is_monthly"), end).otherwise(F.add_months(started, (years * 12).cast("int")))
    )
    return rows.withColumn("contract_end_dt", F.greatest(end, candidate)).drop("first_3y_dt")


def resolve_status(df: DataFrame, as_of, rules: str = "grace30") -> DataFrame:
    """Final status from quantity and dates; default cycles by plan; street and house number.

    ``rules``: ``grace30`` (default) cancels active contracts over 30 days past their end, ``grace14``
    cancels whatever is over 14 days past its term, ``none`` has no grace and makes empty plans non-renewing.
    """
    today, status, end, term_end = day(as_of), F.col("status"), F.col("contract_end_dt"), F.col("term_end_dt")
    active = status == "active"
    empty = active & (F.col("plan_quantity") < 1)
    first = {
        "grace30": F.when(empty & (end < today), "cancelled").when(active & (end < F.date_sub(today, 30)), "cancelled").when(empty, "cancelled"),
        "grace14": F.when(F.date_add(term_end, 14) < today, "cancelled").when(empty & (end < today), "cancelled").when(empty, "cancelled"),
        "none": F.when(empty, "non_renewing"),
    }[rules]
    resolved = (
        first.when(F.col("started_dt") > today, "future").when(~active & (term_end == end) & (today < end), "non_renewing")
        .when(~active & (end <= today), "cancelled").when(active & (today <= end), "active").otherwise(status)
    )
    cycles = F.when(F.col("is_3y"), F.when(F.col("is_monthly"), 36).otherwise(3)).otherwise(F.when(F.col("is_monthly"), 12).otherwise(1))
    return df.withColumns({
        "status": resolved,
        "plan_quantity": F.when(F.col("plan_quantity") > 0, F.col("plan_quantity")),
        "default_cycles": cycles,
    })


def split_shipping_address(df: DataFrame) -> DataFrame:
    """Street and house number from the raw address line."""
    raw = F.col("ship_address")
    return df.withColumns({"ship_line1": street_of(raw), "ship_line2": house_number_of(raw)}).drop("ship_address")


def mask_by_status(df: DataFrame, as_of) -> DataFrame:
    """Blank fields that do not apply to the status, and settle the cancel date.

    ``cancelled_dt`` of a cancelled subscription: the given date if after the term start (else start), the
    term start otherwise, the day before an ended contract's end, or the term start (else a day after the start).
    """
    today, status, started, end = day(as_of), F.col("status"), F.col("started_dt"), F.col("contract_end_dt")
    term_start, term_end, cancelled = F.col("term_start_dt"), F.col("term_end_dt"), F.col("cancelled_dt")
    future, in_term = status == "future", status.isin("active", "non_renewing")
    fallback = F.coalesce(term_start, F.date_add(started, 1))
    cancel = (
        F.when(status != "cancelled", None)
        .when(cancelled > F.coalesce(term_start, started), cancelled).when(cancelled.isNotNull(), fallback)
        .when(end <= today, F.date_sub(end, 1)).otherwise(fallback)
    )
    return df.withColumns({
        "start_dt": F.when(future, started),
        "started_dt": F.when(~future, started),
        "term_start_dt": F.when(in_term, term_start),
        "term_end_dt": F.when(in_term, term_end),
        "cancelled_dt": F.when(status == "cancelled", cancel),
        "cancel_reason": F.when(status == "cancelled", F.col("cancel_reason")),
        "contract_end_dt": F.when(status == "cancelled", term_end).when(~future, end),
        "contract_start_dt": F.when(future, started).when(~F.col("is_3y"), F.add_months(end, -12)).otherwise(F.add_months(end, -36)),
    })


def clamp_cancel(df: DataFrame, as_of) -> DataFrame:
    """Term start from the term end; cancel time inside (start, contract end]; cycles of the first contract term."""
    started, end = F.col("started_dt"), F.col("contract_end_dt")
    cancelled = F.col("cancelled_dt")
    as_ts = lambda col: col.cast("timestamp_ntz")
    minute_later = as_ts(started) + F.expr("INTERVAL 1 MINUTE")
    clamped = (
        F.when((cancelled > started) & (cancelled <= end), as_ts(cancelled)).when(cancelled <= started, minute_later).when(cancelled > end, as_ts(end))
    )
    past = F.add_months(started, 36) <= day(as_of)
    return df.withColumns({
        "term_start_shop_dt": F.col("term_start_dt"),
        "term_start_dt": F.when(F.col("is_monthly"), F.add_months("term_end_dt", -1)).otherwise(F.add_months("term_end_dt", -12)),
        "cancelled_ts": clamped,
        "contract_cycles": F.when(F.col("is_3y") & past, F.when(F.col("is_monthly"), 12).otherwise(1)).otherwise(F.col("default_cycles")),
    }).drop("cancelled_dt")


def remaining_cycles(df: DataFrame, as_of) -> DataFrame:
    """Billing cycles left until the contract end; a non-renewing subscription with more than one becomes active."""
    status, end, start = F.col("status"), F.col("contract_end_dt"), F.col("term_start_dt")
    past = F.add_months("started_dt", 36) <= day(as_of)
    years, months = years_between_whole(end, start), months_between_whole(end, start)
    left = (
        F.when(F.col("is_3y") & F.col("is_monthly") & F.coalesce(past, F.lit(False)), F.lit(12))
        .otherwise(F.greatest(F.lit(1), F.when(F.col("is_monthly"), months).otherwise(years)))
    ).cast("int")
    return df.withColumns({
        "cycles_left": F.when(status == "cancelled", None).when(status == "future", F.col("default_cycles")).otherwise(left),
        "status": F.when((status == "non_renewing") & (left > 1), "active").otherwise(status),
    })


def back_compute_start(df: DataFrame, as_of) -> DataFrame:
    """Contract start from the term start and the cycles already used; starts lowered to the earliest date."""
    status = F.col("status")
    active, future = status == "active", status == "future"
    used = F.col("default_cycles") - F.col("cycles_left")
    start = F.when(active, F.add_months("term_start_dt", -used * F.when(F.col("is_monthly"), 1).otherwise(12)))
    created = F.when(active, F.col("contract_created_dt"))
    pushed = active & (F.col("term_end_dt") <= day(as_of))
    step = F.when(F.col("is_monthly"), 1).otherwise(12)
    return df.withColumns({
        "contract_start_dt": start,
        "contract_end_dt": F.when(active, F.col("contract_end_dt")),
        "start_dt": F.when(future, F.least("start_dt", "started_dt", start)),
        "started_dt": F.when(~future, F.least("started_dt", start)),
        "contract_created_dt": F.when(active, F.least(created, F.col("started_dt"), start)),
        "cycles_left": F.when(active, F.col("cycles_left")),
        "contract_cycles": F.when(active | future, F.col("contract_cycles")),
        "renewal_cycles": F.when(active | future, F.col("renewal_cycles")),
        "term_start_pushed_dt": F.when(pushed, F.add_months("term_start_dt", step)).otherwise(F.col("term_start_dt")),
        "pushed_by_one_cycle": F.coalesce(pushed, F.lit(False)),
    })


def exclude_dead_plans(df: DataFrame) -> DataFrame:
    """Drop hardware and add-on plans, and empty cancelled plans of contracts that are otherwise live."""
    marked = df.withColumn("contract_live", F.bool_or(F.col("status").isin(LIVE_STATUS)).over(_one_contract()))
    dead = (F.col("status") == "cancelled") & F.col("plan_quantity").isNull() & F.col("contract_live")
    sold = ~F.col("plan_id").like(HARDWARE_PLANS) & (F.col("plan_id") != ADDON_PLAN)
    return marked.filter(sold & ~F.coalesce(dead, F.lit(False))).drop("contract_live")


def date_steps(base: DataFrame, as_of, rules: str = "grace30") -> DataFrame:
    """All steps from the term dates to the exclusion of dead plans.

    Plans without a number have no subscription id; they leave before the plans of a contract are compared.
    """
    rows = resolve_status(contract_end(term_dates(base), as_of), as_of, rules)
    rows = remaining_cycles(clamp_cancel(mask_by_status(rows, as_of), as_of), as_of)
    return exclude_dead_plans(back_compute_start(rows, as_of).filter("subscription_id IS NOT NULL"))


def migration_rows(
    contracts: DataFrame, customers: DataFrame, invoices: DataFrame, products: DataFrame, plan_map: DataFrame, internal_emails: str, as_of,
    rules: str = "grace30",
) -> DataFrame:
    """The whole job up to the export columns. The plans of the invoices serve twice and are computed once."""
    from_invoices = materialise(invoice_plans(invoices, customers, products, plan_map, internal_emails))
    from_contracts = contract_plans(contracts, customers, products, plan_map, internal_emails)
    subscriptions = unique_subscriptions(plan_quantities(from_invoices, from_contracts))
    base = subscription_base(subscriptions, contracts, customers, amount_to_percent(invoices))
    return date_steps(split_shipping_address(with_invoice_dates(base, from_invoices)), as_of, rules)


# The import format, as header and source; a date source is written as a timestamp.
EXPORT = [
    ExportColumn("customer[email]", "customer_email"),
    ExportColumn("shop_customer_id", "customer_id"),
    ExportColumn("subscription[id]", "subscription_id"),
    ExportColumn("subscription[cf_vertragsnummer]", "contract_id"),
    ExportColumn("subscription[plan_id]", "plan_id"),
    ExportColumn("subscription[plan_quantity]", "plan_quantity"),
    ExportColumn("subscription[plan_unit_price]", "plan_unit_price"),
    ExportColumn("subscription[status]", "status"),
    ExportColumn("subscription[start_date]", "start_dt", as_timestamp=True),
    ExportColumn("subscription[started_at]", "started_dt", as_timestamp=True),
    ExportColumn("subscription[current_term_start_shop]", "term_start_shop_dt", as_timestamp=True),
    ExportColumn("subscription[current_term_start]", "term_start_dt", as_timestamp=True),
    ExportColumn("subscription[current_term_end]", "term_end_dt", as_timestamp=True),
    ExportColumn("contract term end", "contract_end_dt", as_timestamp=True),
    ExportColumn("contract_term[contract_start]", "contract_start_dt", as_timestamp=True),
    ExportColumn("contract_term[created_at]", "contract_created_dt", as_timestamp=True),
    ExportColumn("subscription[cancelled_at]", "cancelled_ts", as_timestamp=True),
    ExportColumn("pushed_by_one_billing_cycle", "pushed_by_one_cycle"),
    ExportColumn("billing_cycles", "cycles_left"),
    ExportColumn("contract_term[billing_cycle]", "contract_cycles"),
    ExportColumn("subscription[contract_term_billing_cycle_on_renewal]", "renewal_cycles"),
    ExportColumn("coupon_code_temp", "coupon"),
    ExportColumn("cancel_reason_code", "cancel_reason"),
    ExportColumn("cf_lifetime_licence", "lifetime_licence"),
    ExportColumn("create_current_term_invoice", constant=False),
    ExportColumn("shipping_address[first_name]", "ship_first_name"),
    ExportColumn("shipping_address[last_name]", "ship_last_name"),
    ExportColumn("shipping_address[email]", "ship_email"),
    ExportColumn("shipping_address[company]", "ship_company"),
    ExportColumn("shipping_address[phone]", "ship_phone"),
    ExportColumn("shipping_address[line1]", "ship_line1"),
    ExportColumn("shipping_address[line2]", "ship_line2"),
    ExportColumn("shipping_address[line3]"),
    ExportColumn("shipping_address[city]", "ship_city"),
    ExportColumn("shipping_address[state_code]"),
    ExportColumn("shipping_address[state]"),
    ExportColumn("shipping_address[zip]", "ship_zip"),
    ExportColumn("shipping_address[country]", "ship_country"),
    ExportColumn("shipping_address[validation_status]", constant="not_validated"),
    ExportColumn("default_billing_cycles", "default_cycles"),
    ExportColumn("total_amount_raised"),
    ExportColumn("subscription[setup_fee]"),
    ExportColumn("subscription[trial_start]"),
    ExportColumn("subscription[trial_end]"),
    ExportColumn("subscription[pause_date]"),
    ExportColumn("subscription[resume_date]"),
    ExportColumn("subscription[po_number]"),
    ExportColumn("coupon_ids[1]"),
    ExportColumn("subscription[payment_source_id]"),
    ExportColumn("subscription[invoice_notes]"),
    ExportColumn("subscription[meta_data]"),
    ExportColumn("contract_term[id]"),
    ExportColumn("contract_term[total_amount_raised]"),
    ExportColumn("contract_term[action_at_term_end]"),
    ExportColumn("contract_term[cancellation_cutoff_period]", constant=CANCELLATION_CUTOFF),
    ExportColumn("transaction[amount]"),
    ExportColumn("transaction[payment_method]"),
    ExportColumn("transaction[reference_number]"),
    ExportColumn("transaction[date]"),
    ExportColumn("subscription[cf_cancelled_devices]"),
    ExportColumn("subscription[cf_total_sent_devices_for_subscription]"),
    ExportColumn("subscription[cf_total_received_devices_for_subscription]"),
    ExportColumn("subscription[cf_currently_held_devices_for_subscription]"),
    ExportColumn("subscription[cf_to_be_returned_devices_for_subscription]"),
]


def migration_export(rows: DataFrame) -> DataFrame:
    """Text export with bracketed headers; of several e-mail addresses only the first is kept."""
    first = lambda c: F.split_part(F.col(c), F.lit(","), F.lit(1))
    return export_layout(rows.withColumns({"customer_email": first("customer_email"), "ship_email": first("ship_email")}), EXPORT)


def latest_payment_status(payments: DataFrame) -> DataFrame:
    """Status of the payment first authorised per invoice (of equal times the last modified); refunds left out."""
    order = [F.col("authorized_ts").asc_nulls_last(), F.col("modified_ts").desc_nulls_first(), F.col("payment_id")]
    return latest_per_key(payments.filter("refund_id IS NULL"), ["invoice_id"], order).select("invoice_id", "status")


def last_invoice_quantity(
    invoices: DataFrame, customers: DataFrame, contracts: DataFrame, products: DataFrame, plan_map: DataFrame, internal_emails: str
) -> DataFrame:
    """Quantity on the last invoice of each subscription, as far as that invoice belongs to a live contract's domain.

    invoices carry ``domain``, contracts ``domain``.
    """
    rows = _mapped_items(
        invoices.join(customers.select("customer_key"), "customer_key", "left_semi"), "items_added", ["contract_id", "invoice_id", "created_ts"], products, plan_map
    )
    key = F.concat("contract_id", F.lit("_"), F.coalesce(F.col("plan_nr").cast("string"), F.col("product_id")))
    rows = rows.select(key.alias("subscription_id"), "invoice_id", "created_ts", "quantity")
    # the items are unfolded once: rows_at_max would read them twice
    last = spread_totals(rows, ["subscription_id"], {"last_ts": ("max", "created_ts")}).filter("created_ts = last_ts")
    live = exclude_value(contracts, "cancelation_reason", GHOST_CONTRACT).select("domain")
    billed = invoices.join(_external(customers, internal_emails).select("customer_key"), "customer_key", "left_semi").join(live, "domain", "left_semi")
    return last.join(billed.select("invoice_id"), "invoice_id", "left_semi").groupBy("subscription_id").agg(F.sum("quantity").alias("quantity_last_invoice"))
