"""Orders and contracts stored with JSON items and discounts.

Items are arrays of {product_id, quantity, price, total_provisioned_price}; a discount is
{"type": "percentage", "value": 0.1} or {"type": "amount", "value": {"amount": cents, "currency": ..}}.
products: product_id, product_name, monthly_payment, is_recurring, is_subsequent_recurring, counts_device,
counts_revenue (and counts_sold, sales_counts, changes_to_onetime for orders). A flag that is NULL is neither true nor false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day, local_date, month_of
from ..functions.json import discount_type, discount_value, json_get
from ..functions.numbers import cents, euro, ratio, round_div
from ..functions.text import domain_name
from ..operators.aggregates import count_if, sum_if
from ..operators.items import agg_items, explode_items
from ..operators.joins import repair_key
from ..operators.keyed import rows_at_max

# Fixed values of the payment rules.
PAID_LEGACY_PREFIXES = ["77", "78"]
PAID_LEGACY_STATUS = ["complete", "closed"]
DIRECT_PAYMENTS = ["sepa", "card", "paypal"]
TAX_HUNDREDTHS = 119
LEGACY_SOLD_PRODUCTS = ["2", "7", "10", "14, 15"]
SENTINEL_PRODUCT = "fake"

# Contact fields and their greatest length in the warehouse.
CONTACT_FIELDS = {
    "first_name": ("first_name", 64), "last_name": ("last_name", 64), "street_address": ("address.street_address", 128),
    "postal_code": ("address.postal_code", 16), "locality": ("address.locality", 64), "region": ("address.region", 64),
    "country": ("address.country", 2), "email": ("email", 128), "gender": ("gender", 16), "company_name": ("company_name", 128),
    "phone_number": ("phone_number", 32), "mobile_phone_number": ("mobile_phone_number", 32),
}


def contact_columns(df: DataFrame, column: str, prefix: str, keep: list[str]) -> DataFrame:
    """``keep`` and the contact document as text columns, each cut to its length; a document is parsed once."""
    top = [path for path, _ in CONTACT_FIELDS.values() if "." not in path]
    inner = [path.removeprefix("address.") for path, _ in CONTACT_FIELDS.values() if "." in path]
    schema = ", ".join(f"{name} string" for name in top) + f", address struct<{', '.join(f'{name}:string' for name in inner)}>"
    parsed = df.select(*keep, F.from_json(column, schema).alias("__contact"))
    fields = [F.left(F.col(f"__contact.{path}"), F.lit(size)).alias(f"{prefix}_{name}") for name, (path, size) in CONTACT_FIELDS.items()]
    return parsed.select(*keep, *fields)


def invoice_status() -> Column:
    """paid, open or no_invoice from legacy id and status, payment status and invoice presence."""
    legacy, status = F.col("legacy_id"), F.col("legacy_status")
    return (
        F.when(F.left(legacy, F.lit(2)).isin(PAID_LEGACY_PREFIXES), "paid")
        .when(status.isin(PAID_LEGACY_STATUS), "paid")
        .when(status.isNotNull() & legacy.isNotNull(), "open")
        .when(F.col("payment_status") == "authorised", "paid")
        .when(F.col("invoice_id").isNotNull(), "open")
        .otherwise("no_invoice")
    )


def enrich_orders(
    orders: DataFrame, invoices: DataFrame, payments: DataFrame, refunds: DataFrame, contracts: DataFrame, products: DataFrame, cable_products: list[str],
    importer: str,
) -> DataFrame:
    """Placed orders with payment state, discount, amounts, refunds, device counts, sold, recurring, draft and cohort flags.

    orders: order_id, contract_id, domain, status, legacy_id, legacy_status, legacy_product, legacy_gross (text with a
    blank and a currency sign at its end), total_net_cents, coupon_code, discount, items, creator, created_ts, modifier,
    modified_ts. ``importer`` is the creator of imported drafts. invoices: invoice_id, order_id, net_cents (one per order). payments: invoice_id, order_id,
    status, refund_id, method. refunds: order_id, net_cents. contracts: contract_id, contract_created_ts.
    """
    placed = orders.filter("status = 'placed'")
    state = payments.filter("refund_id IS NULL").groupBy("invoice_id").agg(F.min("status").alias("payment_status"))
    refunded = refunds.groupBy("order_id").agg(F.sum("net_cents").alias("refund_cents"), F.count(F.lit(1)).alias("refunds"))
    method = F.col("method")
    payable = (method.isin(DIRECT_PAYMENTS) & (F.col("status") == "authorised")) | (method == "invoice") | method.isNull()
    payers = payments.groupBy("order_id").agg(F.bool_or(F.coalesce(payable, F.lit(False))).alias("payable"))

    # one pass over the exploded items serves all item-based columns
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    lines = explode_items(placed, "items", keep=["order_id"]).join(products, "product_id", "left")
    device = flag("counts_device")
    no = lambda name: F.col(name).eqNullSafe(F.lit(False))  # NULL does not count as no
    recurring = device & no("is_subsequent_recurring") & no("changes_to_onetime") & flag("is_recurring") & flag("counts_revenue")
    # The global rank puts devices that are subsequently recurring first, so such an item decides without ranking all
    # (unknown flags do not outrank known ones here).
    items = lines.groupBy("order_id").agg(
        sum_if(F.col("product_id").isin(cable_products), F.col("quantity")).alias("cable_quantity"),
        sum_if(device, F.col("quantity")).alias("device_quantity"),
        sum_if(recurring, F.col("quantity")).alias("recurring_quantity"),
        F.bool_or(device & flag("counts_revenue") & flag("counts_sold") & flag("sales_counts")).alias("has_sellable"),
        F.bool_or(flag("changes_to_onetime")).alias("changed_to_onetime"),
        F.bool_or(flag("is_subsequent_recurring") & device).alias("top_is_subsequent"),
    )
    rows = (
        placed.join(invoices.withColumnRenamed("net_cents", "invoice_cents"), "order_id", "left").join(state, "invoice_id", "left")
        .join(refunded, "order_id", "left").join(payers, "order_id", "left").join(items, "order_id", "left").join(contracts, "contract_id", "left")
    )
    discount, kind = F.col("discount"), discount_type(F.col("discount"))
    sold = flag("has_sellable") & F.coalesce("payable", F.lit(True))
    legacy, legacy_status = F.col("legacy_id"), F.col("legacy_status")
    legacy_sold = F.col("legacy_product").isin(LEGACY_SOLD_PRODUCTS) & legacy_status.isin(PAID_LEGACY_STATUS)
    gross = cents(F.col("legacy_gross").substr(F.lit(1), F.length("legacy_gross") - 2).cast("decimal(16,2)"))
    own_total = legacy.isNull() | F.left(legacy, F.lit(2)).isin(PAID_LEGACY_PREFIXES)
    return rows.select(
        "order_id", "contract_id", domain_name(F.col("domain")).alias("domain_name"), invoice_status().alias("invoice_status"),
        F.when(kind == "percentage", json_get(discount, "value", "decimal(3,2)")).alias("discount_percentage"),
        F.when(kind == "amount", json_get(discount, "value.amount", "int")).alias("discount_cents"),
        F.left(json_get(discount, "value.currency"), F.lit(3)).alias("discount_currency"), "coupon_code",
        "cable_quantity", "device_quantity", F.col("refunds").isNotNull().alias("has_refund"),
        F.coalesce(
            F.when(F.col("legacy_id").isNull(), F.col("refund_cents") == F.col("invoice_cents")).otherwise(F.col("legacy_status") == "closed"), F.lit(False)
        ).alias("has_full_refund"),
        F.when(legacy_sold, True).when(legacy_status.isNull(), sold).otherwise(False).alias("is_sold"),
        euro(F.when(own_total, F.col("total_net_cents")).otherwise(round_div([gross, 100], [TAX_HUNDREDTHS]))).alias("net_invoice_amount"),
        legacy.isNotNull().alias("is_legacy_customer"),
        (F.col("creator").eqNullSafe(importer) & F.col("invoice_id").isNotNull()).alias("was_draft"),
        F.coalesce(F.col("recurring_quantity") > 0, F.lit(False)).alias("is_recurring"),
        flag("top_is_subsequent").alias("is_subsequent_recurring"), flag("changed_to_onetime").alias("changed_to_onetime"),
        F.coalesce(month_of(F.col("created_ts")) == month_of(F.col("contract_created_ts")), F.lit(False)).alias("is_cohort"),
        "creator", "created_ts", "modifier", "modified_ts",
    )


def contract_snapshot(contracts: DataFrame, products: DataFrame) -> DataFrame:
    """Contracts with discount fields and the number of active devices among their items."""
    devices = products.filter("counts_device").select("product_id")
    rows = agg_items(contracts, "contract_id", "items", devices, F.sum("quantity").alias("devices"))
    discount = F.col("discount")
    return rows.select(
        "contract_id", "customer_id", domain_name(F.col("domain")).alias("domain_name"), discount_type(discount).alias("discount_type"),
        discount_value(discount).alias("discount_value"), json_get(discount, "value.currency").alias("currency_code"), "status",
        F.coalesce("devices", F.lit(0)).alias("devices"), "started_dt", "period_end_dt", "canceled_dt",
    )


def contract_items(contracts: DataFrame) -> DataFrame:
    """Distinct (contract, product, net price, discount) rows."""
    rows = explode_items(contracts, "items", keep=["contract_id", "discount"])
    return rows.select(
        "contract_id", "product_id", "total_net_cents", discount_type(F.col("discount")).alias("discount_type"),
        discount_value(F.col("discount")).alias("discount_value"),
    ).distinct()


def item_net_value(rows: DataFrame) -> Column:
    """Yearly net value of an item in 1/11900 cent: so both discount kinds add up without rounding."""
    net, value, kind = F.col("total_net_cents"), cents(F.col("discount_value")), F.col("discount_type")
    scaled = (
        F.when(kind == "percentage", net * (100 - value) * TAX_HUNDREDTHS)
        .when(kind == "amount", net * (100 * TAX_HUNDREDTHS) - value * 100)
        .when(kind.isNull(), net * (100 * TAX_HUNDREDTHS))
    )
    return scaled * F.when(F.col("monthly_payment"), 12).otherwise(1)


def contract_net_value(contracts: DataFrame, products: DataFrame, by_item: bool = False) -> DataFrame:
    """Yearly net value of a contract's revenue items after discount, per contract or per item price."""
    priced = products.filter("counts_revenue").select("product_id", "monthly_payment")
    rows = contract_items(contracts).join(priced, "product_id")
    keys = ["contract_id", "discount_value", "monthly_payment", "total_net_cents"] if by_item else ["contract_id"]
    total = F.sum(item_net_value(rows)).alias("v")
    return rows.groupBy(*keys).agg(total).select(*keys, euro(round_div([F.col("v")], [100 * TAX_HUNDREDTHS])).alias("net_value_eur"))


def split_discount(contracts: DataFrame) -> DataFrame:
    """Amount discounts spread over the contract's items by price share (rounded to two digits)."""
    # the items of a contract come from one document, so a window over them is bounded
    whole = F.sum("total_net_cents").over(Window.partitionBy("contract_id"))
    rows = contract_items(contracts).withColumn("contract_net_cents", whole)
    part = ratio(F.col("total_net_cents"), F.col("contract_net_cents"))
    value = F.col("discount_value")
    split = F.when(F.col("discount_type") == "percentage", value).when(F.col("discount_type") == "amount", value * part)
    return rows.withColumn("item_discount", split.cast("decimal(20,4)")).drop("contract_net_cents")


def fleet_by_last_product(lines: DataFrame, word: str) -> DataFrame:
    """Contracts whose latest ending order line is a product containing ``word``."""
    last = rows_at_max(lines.withColumn("end_dt", local_date(F.col("end_ts"))), ["contract_id"], "end_dt")
    return last.filter(F.col("product_name").contains(word)).select("contract_id").distinct()


def fleet_by_items(contracts: DataFrame, products: DataFrame, word: str) -> DataFrame:
    """Contracts with an item whose product name contains ``word``."""
    named = products.filter(F.col("product_name").contains(word)).select("product_id")
    return known_items(contracts).join(named, "product_id", "left_semi").select("contract_id", "product_id").distinct()


def known_items(contracts: DataFrame) -> DataFrame:
    rows = explode_items(contracts, "items", keep=["contract_id"])
    return rows.withColumn("product_id", repair_key(F.col("product_id"), SENTINEL_PRODUCT))


def fleet_contracts(contracts: DataFrame, products: DataFrame, domain_map: DataFrame, roles: DataFrame, role_names: list[str], lines: DataFrame, word: str) -> DataFrame:
    """Contracts of domains with a fleet role and a recurring item, and contracts whose last product is fleet.

    contracts carry ``domain``; domain_map: domain_name, user_domain; roles: user_domain, role.
    """
    fleet_domains = domain_map.join(roles.filter(F.col("role").isin(role_names)).select("user_domain"), "user_domain", "left_semi")
    recurring = products.filter("is_recurring OR is_subsequent_recurring").select("product_id")
    by_role = (
        contracts.withColumn("domain_name", domain_name(F.col("domain"))).join(fleet_domains.select("domain_name"), "domain_name", "left_semi")
    )
    by_role = known_items(by_role).join(recurring, "product_id", "left_semi").select("contract_id")
    sold = lines.join(recurring, "product_id", "left_semi")
    return by_role.union(fleet_by_last_product(sold, word)).distinct()


def returns_report(returns: DataFrame, contracts: DataFrame, products: DataFrame, low, high) -> DataFrame:
    """Returned quantity by contract, day, reason and product between two days."""
    on = F.col("created_ts").cast("date")
    rows = returns.filter(on.between(day(low), day(high))).join(contracts.select("contract_id"), "contract_id", "left_semi")
    keys = ["contract_id", on.alias("return_dt"), "reason", "product_name"]
    return rows.join(products.select("product_id", "product_name"), "product_id", "left").groupBy(*keys).agg(F.sum("quantity").alias("quantity"))


def ticket_ratings(tickets: DataFrame, column: str = "satisfaction_rating") -> DataFrame:
    """Rating fields of tickets with a comment; a document is parsed once."""
    parsed = F.from_json(column, "id string, score string, comment string, reason string, created_at string").alias("__rating")
    field = lambda name: F.col(f"__rating.{name}")
    return tickets.select("ticket_id", parsed).filter(field("comment").isNotNull()).select(
        "ticket_id", field("id").try_cast("bigint").alias("rating_id"), F.left(field("score"), F.lit(16)).alias("score"),
        F.left(field("comment"), F.lit(2048)).alias("comment"), F.left(field("reason"), F.lit(32)).alias("reason"),
        field("created_at").try_cast("timestamp_ntz").alias("created_ts"),
    )


def contract_car_ratio(cars: DataFrame, contracts: DataFrame) -> DataFrame:
    """Vehicle contracts per active car and domain."""
    per_car = cars.filter("ended_ts IS NULL").groupBy(F.lower("domain_name").alias("domain_name")).agg(F.count(F.lit(1)).alias("cars"))
    live = contracts.filter("deleted_ts IS NULL").groupBy(F.lower("domain_name").alias("domain_name")).agg(F.count(F.lit(1)).alias("contracts"))
    return per_car.join(live, "domain_name", "left").withColumn("contract_car_ratio", ratio(F.col("contracts"), F.col("cars")))


def domain_status(contracts: DataFrame, as_of) -> DataFrame:
    """Latest start and whether any contract period ends after ``as_of``, per domain."""
    rows = contracts.groupBy(domain_name(F.col("domain")).alias("domain_name")).agg(
        F.max("started_dt").alias("started_dt"), F.max("period_end_dt").alias("last_end_dt")
    )
    status = F.when(F.col("last_end_dt") > day(as_of), "Active")
    return rows.select("domain_name", "started_dt", F.lit("Customer").alias("contract_type"), status.alias("contract_status"))


def domain_cars(cars: DataFrame) -> DataFrame:
    """Active cars and first use per domain."""
    return cars.groupBy(F.lower("domain_name").alias("domain_name")).agg(
        count_if(F.col("ended_ts").isNull()).alias("active_cars"), F.min(F.col("created_ts").cast("date")).alias("first_usage_dt")
    )
