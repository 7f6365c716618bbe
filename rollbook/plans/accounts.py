"""Accounts: classification, advisor revenue, mapping coverage, marketing rows, domain revenue, CRM links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day
from ..functions.numbers import cents, euro, ratio, round_div
from ..functions.text import email_domain, flag_labels, like_any, normalised
from ..operators.aggregates import any_true, count_if, sum_if, text_list
from ..operators.joins import join_on_expr
from ..operators.keyed import first_value, latest_per_key, order_by_list, rows_at_max, spread_totals
from ..session import keep_repeats_short

LIST_PARTS = 16  # of the contacts of one e-mail

# Gross-to-net divisor in hundredths, and the two classification tags.
TAX_HUNDREDTHS = 119
BY_COUPON, BY_NAME = "ta_coupon_used", "word_in_company_name"


def category_coupons(coupons: DataFrame, code_pattern: str, categories: list[str]) -> DataFrame:
    """Distinct lower-case codes matching the pattern or belonging to a listed category."""
    code = F.lower("coupon_code")
    hit = code.like(code_pattern) | F.col("category").isin(categories)
    return coupons.filter(hit).select(code.alias("coupon_code")).distinct()


def receiver_coupons(receivers: DataFrame) -> DataFrame:
    """Distinct codes with their receiver, codes and e-mails in lower case, names in upper case."""
    return receivers.select(
        F.lower("coupon_code").alias("coupon_code"), normalised(F.col("receiver_email")).alias("receiver_email"),
        F.upper("receiver_name").alias("receiver_name"),
    ).distinct()


def classify_accounts(
    orders: DataFrame, receivers: DataFrame, coupons: DataFrame, customers: DataFrame, code_pattern: str, categories: list[str],
    name_patterns: list[str],
) -> DataFrame:
    """Domains that ordered with a partner coupon, and further domains with a partner word in the company name."""
    listed = receiver_coupons(receivers).filter("receiver_email IS NOT NULL").select("coupon_code")
    partner = listed.union(category_coupons(coupons, code_pattern, categories)).distinct()
    used = orders.select("domain_name", F.lower("coupon_code").alias("coupon_code")).distinct()
    by_coupon = used.join(partner, "coupon_code", "left_semi").select("domain_name", "coupon_code", F.lit(BY_COUPON).alias("flag_base"))
    named = customers.filter(like_any(F.col("company_name"), name_patterns)).select("domain_name")
    by_name = named.join(by_coupon, "domain_name", "left_anti").distinct()
    return by_coupon.unionByName(by_name.select("domain_name", F.lit(None).cast("string").alias("coupon_code"), F.lit(BY_NAME).alias("flag_base")))


def advisor_line_mrr(lines: DataFrame) -> DataFrame:
    """Net recurring revenue per line: discount and the line's share of the refund subtracted, none after a full refund.

    Needs order_id, net_cents, discount_percentage, discount_cents, refund_net_cents, monthly_payment, has_full_refund.
    """
    rows = lines.withColumn("order_net", F.sum("net_cents").over(Window.partitionBy("order_id")))  # the lines of one order are few
    net, total = F.col("net_cents"), F.col("order_net")
    refund = F.coalesce("refund_net_cents", F.lit(0))
    percent, amount = F.col("discount_percentage"), F.col("discount_cents")
    off = round_div([amount, net, 100], [total, TAX_HUNDREDTHS])
    hundredfold = F.when(percent > 0, net * (100 - cents(percent))).when(amount > 0, (net - off) * 100).otherwise(net * 100)
    months = F.when(~F.col("monthly_payment"), 12).otherwise(1)
    kept = round_div([hundredfold, total], [total, 100, months], minus=[refund, net, 100])
    return rows.withColumn("mrr_eur", euro(F.coalesce(F.when(F.col("has_full_refund"), 0).otherwise(kept), F.lit(0))))


def advisor_report(
    lines: DataFrame, accounts: DataFrame, customers: DataFrame, receivers: DataFrame, code_pattern: str, call_centre: dict[str, str]
) -> DataFrame:
    """Order revenue of classified domains with the coupon's receiver and the receiver's region.

    lines: the columns of ``advisor_line_mrr`` plus domain_name, contract_id, order_dt, coupon_code,
    is_draft, is_recurring, is_subsequent_recurring. customers: domain_name, company_name, email,
    country, region, postal_code. Codes matching ``code_pattern`` belong to the call centre, whose name,
    email, country, region and postal_code are given.
    """
    wanted = lines.filter(
        ~F.col("is_draft") & (F.col("net_cents") > 0) & (F.col("is_recurring") | F.col("is_subsequent_recurring"))
    ).join(accounts.select("domain_name"), "domain_name", "left_semi")
    keys = ["contract_id", "domain_name", "order_id", "order_dt", "coupon_code"]
    priced = advisor_line_mrr(wanted).withColumn("coupon_code", F.lower("coupon_code"))
    per_order = priced.groupBy(*keys).agg(F.sum("mrr_eur").alias("mrr_order"))

    who = receiver_coupons(receivers)
    located = customers.filter("country IS NOT NULL AND postal_code IS NOT NULL").select(
        normalised(F.col("email")).alias("receiver_email"), "country", "region", "postal_code"
    ).join(who.select("receiver_email"), "receiver_email", "left_semi")
    # the first located customer of an e-mail, in the order of its columns
    place = ["country", "region", "postal_code"]
    regions = first_value(located, ["receiver_email"], place, place)
    partner = accounts.filter("coupon_code IS NOT NULL").select("coupon_code").distinct().withColumn("is_partner", F.lit(True))

    rows = (
        per_order.join(customers.select("domain_name", "company_name"), "domain_name")
        .join(accounts.select("domain_name", "flag_base").distinct(), "domain_name")
        .join(partner, "coupon_code", "left")
        .join(who.withColumn("has_receiver", F.lit(True)), "coupon_code", "left")
        .join(regions, "receiver_email", "left")
        .withColumn("is_partner", F.coalesce("is_partner", F.lit(False)))
    )
    rows = spread_totals(rows, ["domain_name"], {"any_partner": ("any", "is_partner"), "mrr_domain": ("sum", "mrr_order")})
    central = F.coalesce(F.col("coupon_code").like(code_pattern), F.lit(False))
    or_central = lambda column: F.when(central, F.lit(call_centre[column])).otherwise(F.col(column)).alias(column)
    return rows.select(
        "domain_name", "flag_base", "company_name", "contract_id", "coupon_code", F.coalesce("has_receiver", F.lit(False)).alias("coupon_has_receiver"),
        central.alias("coupon_call_centre"), F.col("is_partner").alias("coupon_partner"),
        (F.col("any_partner") | (F.col("flag_base") == BY_COUPON)).alias("domain_used_partner_coupon"),
        "order_dt", "order_id", "mrr_order", "mrr_domain",
        *[or_central(c) for c in ("receiver_name", "receiver_email", "country", "region", "postal_code")],
    )


def mapping_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys of the left system occur in the right one."""
    mapped = right.select(key).distinct().withColumn("hit", F.lit(1))
    joined = left.select(key).distinct().join(mapped, key, "left")
    counts = joined.agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("matched"))
    return counts.withColumn("pct_matched", ratio(F.col("matched"), F.col("total")))


def active_cars_net(
    cars: DataFrame, owners: DataFrame, contracts: DataFrame, shipments: DataFrame, skip_domains: list[str], skip_owner: str, as_of, kinds: list[str]
) -> DataFrame:
    """Cars in use outside test domains and ended contracts, minus test devices shipped in the last 31 days."""
    ended = contracts.groupBy("domain_name").agg(F.min("status").alias("s")).filter("s = 'terminated'").select("domain_name")
    in_use = (
        cars.filter(F.col("ended_ts").isNull() & ~F.col("domain_name").isin(skip_domains))
        .join(owners.filter(~F.col("email").like(skip_owner)).select("owner_id"), "owner_id", "left_semi")
        .join(ended, "domain_name", "left_anti")
    )
    total = in_use.agg(F.count_distinct("car_id").alias("cars"))
    tests = shipments.filter((F.col("shipped_dt") >= F.date_sub(day(as_of), 31)) & F.col("kind").isin(kinds))
    return total.crossJoin(tests.agg(F.count(F.lit(1)).alias("tests"))).select((F.col("cars") - F.col("tests")).alias("cars"))


def customer_cars(customers: DataFrame, domain_map: DataFrame, cars: DataFrame, models: DataFrame) -> DataFrame:
    """Cars per customer with the drive type looked up by brand (any case) and model."""
    owned = customers.join(domain_map, "customer_id", "left").join(cars, "domain_name", "left")
    key = F.concat_ws("|", F.upper("brand"), F.col("model"))
    lookup = models.select(F.upper("brand").alias("__brand"), F.col("model").alias("__model"), "drive")
    joined = join_on_expr(owned, lookup, key, F.concat_ws("|", "__brand", "__model"), "left").drop("__brand", "__model")
    return joined.withColumn("car_active", F.col("ended_ts").isNull())


def user_roles(users: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Users with one label column per role; deleted and locked users left out."""
    live = users.filter("deleted_ts IS NULL AND NOT is_locked")
    return live.select("user_id", *flag_labels(flags))


def unified_products(billing: DataFrame, shop: DataFrame, one_time: list[str], hardware: str, long_term_pattern: str) -> DataFrame:
    """One catalogue from the billing system's plans and the shop's products."""
    once = F.col("plan_id").isin(one_time)
    a = billing.select(
        "plan_id", "product_name", "product_group", once.alias("is_one_time"), (~once & (F.col("product_group") != hardware)).alias("is_recurring"),
        "billing_frequency", "duration_mths", "price_net",
    )
    b = shop.select(
        "plan_id", "product_name", "product_group", once.alias("is_one_time"),
        ((F.col("recurring") | F.col("subsequent_recurring")) & ~once).alias("is_recurring"),
        F.when(F.col("monthly_payment"), "monthly").otherwise("yearly").alias("billing_frequency"),
        F.when(F.col("product_name").like(long_term_pattern), 36).otherwise(12).alias("duration_mths"), "price_net",
    )
    return a.unionByName(b)


# The status order of the chosen customer, and the statuses whose licences count.
MARKETING_ORDER = ["active", "future", "non_renewing", "cancelled", "inactive"]
LICENSED = ["active", "non_renewing"]


def user_marketing_row(
    rows: DataFrame, users: DataFrame, fleet_domains: DataFrame, active_domains: DataFrame, licences: list[str], tie: list[str]
) -> DataFrame:
    """One row per user linked to several customers: the best-status customer, licences summed over all.

    rows: user_id, customer_id, org_status, type, territory, domain and the licence columns.
    """
    status = F.col("org_status")
    sums = {f"licences_{c}": F.coalesce(sum_if(status.isin(LICENSED), F.col(c)), F.lit(0)) for c in licences}
    base = (
        rows.join(users, "user_id")
        .join(fleet_domains.select("main_domain").distinct().withColumn("fm", F.lit(True)), "main_domain", "left")
        .join(active_domains.select("main_domain").distinct().withColumn("act", F.lit(True)), "main_domain", "left")
    )
    totals = rows.groupBy("user_id").agg(*[expr.alias(n) for n, expr in sums.items()])
    order = [order_by_list(status, MARKETING_ORDER), F.col("type").asc_nulls_last(), *[F.col(c) for c in tie]]
    best = latest_per_key(base, ["user_id"], order).join(totals, "user_id")
    return best.select(
        "user_id", "customer_id",
        F.coalesce("type", F.when(F.col("fm"), "B2B").otherwise("B2C")).alias("type"),
        F.coalesce("territory", F.when(F.col("domain").like("%.gb.%"), "UK").otherwise("DACH")).alias("territory"),
        F.coalesce("org_status", F.when(F.col("act"), "active").otherwise("inactive")).alias("org_status"),
        *[F.col(n) for n in sums], *[(F.col(f"licences_{c}") > 0).alias(f"has_{c}") for c in licences],
    )


STATUS = ("domain_customer_type", "domain_is_active", "match_to_subscription", "subscription_customer_type", "subscription_customer_status")


def domain_mrr(
    users: DataFrame, domains: DataFrame, cars: DataFrame, domain_map: DataFrame, customers: DataFrame, status_report: DataFrame, large_from: int
) -> DataFrame:
    """One row per active user: users, cars, linked customers and revenue of the domain, with its latest reported status.

    users: user_id, domain_name, email, first_name, last_name, deleted_ts, is_locked. domain_map: domain_name, customer_id,
    record_nr (only the first record of a customer counts). status_report: domain_name, reporting_date and ``STATUS``.
    """
    live = F.col("deleted_ts").isNull() & ~F.col("is_locked")
    known = users.join(domains.filter("NOT is_test"), "domain_name", "left_semi")
    per_user = known.groupBy("domain_name").agg(count_if(live).alias("users"))
    per_car = cars.groupBy("domain_name").agg(count_if(F.col("ended_ts").isNull()).alias("cars"))
    linked = domain_map.filter("record_nr = 1").join(customers.select("customer_id", "current_mrr_eur"), "customer_id", "left").groupBy("domain_name").agg(
        text_list(F.col("customer_id").cast("string"), "; ", distinct=False).alias("customer_ids"), F.sum("current_mrr_eur").alias("current_mrr_eur")
    )
    status = rows_at_max(status_report, [], "reporting_date").select("domain_name", *STATUS)
    rows = per_user.join(per_car, "domain_name", "left").join(linked, "domain_name", "left").join(status, "domain_name", "left")
    rows = rows.withColumn("is_large", F.coalesce(F.col("current_mrr_eur") >= large_from, F.lit(False)))
    people = known.filter(live).select("user_id", "domain_name", "email", "first_name", "last_name")
    return rows.join(people, "domain_name")


def user_items(users: DataFrame, domain_revenue: DataFrame, domain_items: DataFrame) -> DataFrame:
    """Users with revenue and licences of their main domain."""
    items = domain_items.distinct()
    return users.join(domain_revenue, "main_domain", "left").join(items, "main_domain", "left").withColumn("mrr_eur", F.coalesce("mrr_eur", F.lit(0)))


def email_domain_accounts(customers: DataFrame, skip_patterns: list[str]) -> DataFrame:
    """All accounts of e-mail domains with at least one fleet account; public mail providers left out."""
    rows = customers.filter(~like_any(F.col("email"), skip_patterns)).withColumn("email_domain", email_domain(F.col("email")))
    fleet = rows.groupBy("email_domain").agg(any_true(F.col("is_fleet")).alias("any_fleet")).filter("any_fleet IS TRUE")
    return rows.join(fleet, "email_domain", "left_semi")


def customer_configuration(domain_map: DataFrame, domains: DataFrame, name: str = "configuration") -> DataFrame:
    """Sorted distinct configuration names of each customer's domains."""
    return domain_map.join(domains, "domain_name").groupBy("customer_id").agg(text_list(F.col(name), ",").alias("configurations"))


def crm_deals(deals: DataFrame, owners: DataFrame, lines: DataFrame) -> DataFrame:
    """Won deals with their owner and the customer of the noted invoice."""
    return deals.join(owners, "owner_id").join(lines.select("invoice_id", "customer_id"), "invoice_id").select("deal_id", "owner_name", "customer_id").distinct()


def crm_contacts(contacts: DataFrame, accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """Contacts with their account and all customers sharing the e-mail.

    The list of an e-mail is put together once, not once for each contact. A contact and account that come ``times``
    over have each customer as often. Lists go to ``LIST_PARTS`` parts of the contacts, so that an e-mail of many
    contacts is not one task. A task has few lists and many rows of each; written as Parquet, a list is stored once there.
    """
    keep_repeats_short(contacts.sparkSession)
    keys = ["contact_id", "email", "account_name"]
    linked = contacts.join(accounts, "contact_id").groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("times"))
    linked = linked.withColumn("part", F.pmod(F.xxhash64("contact_id", "account_name"), F.lit(LIST_PARTS)).cast("int"))
    given = customers.select("email", F.col("customer_id").cast("string").alias("customer"))
    sorted_once = given.groupBy("email").agg(F.array_sort(F.collect_list("customer")).alias("customers"))
    repeated = F.flatten(F.transform("customers", lambda c: F.array_repeat(c, F.col("times"))))
    text = F.array_join(F.when(F.col("times") == 1, F.col("customers")).otherwise(repeated), ", ")
    lists = linked.select("email", "times").distinct().join(sorted_once, "email").select(
        "email", "times", F.when(F.size("customers") > 0, text).alias("customer_ids")
    )
    parts = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit(LIST_PARTS - 1))).alias("part"))
    # few bytes are read and long lists written: a fixed number of tasks, which Spark does not merge
    by = ["email", "times", "part"]
    spread, dealt = (df.repartition(4 * LIST_PARTS, *by) for df in (linked, parts))
    return spread.join(dealt, by).select(*keys, "customer_ids")


def car_counts(domains: DataFrame, cars: DataFrame) -> DataFrame:
    """Cars ever created and still active per non-test domain."""
    joined = domains.filter("NOT is_test").join(cars, "domain_name", "left")
    return joined.groupBy("domain_name").agg(
        F.count("car_id").alias("cars_created"), count_if(F.col("car_id").isNotNull() & F.col("ended_ts").isNull()).alias("cars_active")
    )


def origin_system(shop_id: Column, billing_id: Column) -> tuple[Column, Column]:
    """Origin system (shop unless there is no shop id) and current system (billing once it has an id)."""
    return F.when(shop_id.isNotNull(), "SH").otherwise("CB"), F.when(billing_id.isNotNull(), "CB").otherwise("SH")
