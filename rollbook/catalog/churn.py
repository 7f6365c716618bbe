"""Churn features, statistics and the model on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import keyed
from ..plans import churn, features, model
from ..session import materialise
from .base import register

AS_OF = "2000-01-01"
PRODUCTS = ["ECONOMY", "STANDARD", "PROMO"]

# Term texts from the part size, revenue from the price; every sixth customer has no revenue in the report.
TERMS = """CASE p.p_size % 6 WHEN 0 THEN '36 mths, yearly payment' WHEN 1 THEN '36 mths, monthly payment' WHEN 2 THEN '12 mths, yearly payment'
    WHEN 3 THEN '12 mths, monthly payment' WHEN 4 THEN '1 mths, quarterly payment' ELSE '6 mths, bi-yearly payment' END"""
REPORT = f"""SELECT o.o_custkey AS customer_id, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS reporting_month, {TERMS} AS product_terms, p.p_type AS product_group,
    CAST(l.l_discount AS DECIMAL(10,2)) AS invoice_discount_pct, CAST(CASE WHEN o.o_custkey % 6 = 0 THEN 0 ELSE l.l_extendedprice END AS DECIMAL(12,2)) AS mrr_eur,
    o.o_orderdate > CAST('2000-01-01 00:00:00' AS {{ntz}}) AS flag_future, CAST(l.l_extendedprice AS DECIMAL(12,2)) AS amount, CAST(2 AS DECIMAL(6,2)) AS exchange_rate
    FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey JOIN {{part}} p ON p.p_partkey = l.l_partkey"""
PROFILE = """SELECT c.customer_id, c.is_fleet, c.country, c.customer_status, c.system, s.first_start_dt,
    CASE WHEN c.customer_id % 4 = 0 THEN CAST(s.first_start_dt + CAST(c.customer_id % 400 AS INT) * INTERVAL '1' DAY AS DATE) END AS max_cancelled_dt
    FROM {b_customer} c JOIN (SELECT o_custkey AS customer_id, CAST(min(o_orderdate) AS DATE) AS first_start_dt FROM {orders} GROUP BY o_custkey) s ON s.customer_id = c.customer_id"""


def report(t):
    return t.spark.sql(REPORT.replace("{ntz}", "TIMESTAMP_NTZ"), lineitem=t.lineitem, orders=t.orders, part=t.part)


def profile(t):
    return t.spark.sql(PROFILE, b_customer=t.b_customer, orders=t.orders)


def feature_rows(t):
    rows = report(t)
    return churn.churn_features(rows.drop("amount", "exchange_rate"), rows.drop("mrr_eur", "flag_future"), profile(t), PRODUCTS, AS_OF)


REPORT_SQL = "report AS (" + REPORT.replace("{ntz}", "TIMESTAMP").replace("{lineitem}", "lineitem").replace("{orders}", "orders").replace("{part}", "part") + ")"
PROFILE_SQL = "profile AS (" + PROFILE.replace("{b_customer}", "b_customer").replace("{orders}", "orders") + ")"


def _feature_sql(valued: str, amount: str, where: str) -> str:
    flags = ", ".join(f"bool_or(CASE WHEN product_terms LIKE '{p}' THEN TRUE END) AS {n}" for n, p in churn.TERM_FLAGS.items())
    sums = ", ".join(f"CAST(sum({amount}) FILTER (WHERE product_group = '{p}') AS DECIMAL(18,2)) AS mrr_{p.lower()}" for p in PRODUCTS)
    return f"""SELECT c.customer_id, c.is_fleet, c.country, c.customer_status, c.system, c.first_start_dt,
      CASE WHEN c.customer_status IN ('cancelled', 'non_renewing') THEN c.max_cancelled_dt END AS cancelled_dt, coalesce(c.max_cancelled_dt, DATE '{AS_OF}') AS reference_dt,
      coalesce(c.max_cancelled_dt, DATE '{AS_OF}') - 120 AS cutoff_start_dt, {flags}, bool_or(CASE WHEN invoice_discount_pct > 0 THEN TRUE END) AS has_discount,
      CAST(sum({amount}) AS DECIMAL(18,2)) AS mrr, {sums}
    FROM report r JOIN (SELECT customer_id, max(reporting_month) AS last_month FROM report WHERE {valued} GROUP BY 1) l ON l.customer_id = r.customer_id AND l.last_month = r.reporting_month
    JOIN profile c ON c.customer_id = r.customer_id WHERE {where} GROUP BY ALL"""


# Amounts are divided by the exchange rate 2; sums are halved in cents, half a cent upwards.
PAID_SQL = "paid AS (" + _feature_sql("mrr_eur > 0 AND NOT flag_future", "mrr_eur", "TRUE") + ")"
UNPAID_SQL = "unpaid AS (" + _feature_sql("amount > 0", "amount", "c.customer_status IN ('cancelled', 'non_renewing')") + ")"
HALVED = ", ".join(f"CAST((CAST({c} * 100 AS BIGINT) + 1) // 2 AS DECIMAL(18,2)) / 100 AS {c}" for c in ["mrr", *[f"mrr_{p.lower()}" for p in PRODUCTS]])
FEATURE_SQL = f"""features AS (SELECT *, cancelled_dt IS NOT NULL AS churn_flag, coalesce(cancelled_dt - first_start_dt <= 100, FALSE) AS churn_100d_flag,
    coalesce(cancelled_dt, DATE '{AS_OF}') - first_start_dt AS tenure_days FROM (SELECT *, TRUE AS had_revenue FROM paid
      UNION ALL BY NAME SELECT * REPLACE ({HALVED}), FALSE AS had_revenue FROM unpaid u WHERE NOT EXISTS (SELECT 1 FROM paid p WHERE p.customer_id = u.customer_id)) s
    WHERE date_trunc('month', first_start_dt) <> coalesce(date_trunc('month', cancelled_dt), DATE '2100-01-01'))"""
FEATURES = ", ".join([REPORT_SQL, PROFILE_SQL, PAID_SQL, UNPAID_SQL, FEATURE_SQL])
MONEY = "mrr mrr_economy mrr_standard mrr_promo"


@register(
    "q_churn_features", "SELECT * FROM features", uses="b_customer", extra=FEATURES, dates="first_start_dt cancelled_dt reference_dt cutoff_start_dt", money=MONEY
)
def churn_features(t):
    """Term flags, revenue by product, churn flags and tenure per customer."""
    return feature_rows(t)


# ---------------------------------------------------------------- preparation

PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@register(
    "q_column_cardinality",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_values, count(*) AS rows FROM orders" for c in PROFILED),
)
def column_cardinality(t):
    return features.column_cardinality(t.orders.select(*PROFILED))


@register(
    "q_drop_uninformative", "SELECT o_custkey, o_orderstatus FROM orders",
)
def drop_uninformative(t):
    columns = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").withColumns({"constant": F.lit(1), "empty": F.lit(None).cast("string")})
    return features.drop_uninformative(columns)


@register(
    "q_null_profile",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM b_user" for c in ("user_id", "created_ts", "activated_ts", "deleted_ts", "domain_id")),
    uses="b_user",
)
def null_profile(t):
    return features.null_profile(t.b_user)


@register(
    "q_coerce",
    """SELECT p_partkey, coalesce(TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE), 0) AS brand_nr, coalesce(TRY_CAST(p_name AS DOUBLE), 0) AS name_nr,
    TRY_CAST(CASE WHEN p_size > 25 THEN '2020-01-' || (p_size - 20) ELSE 'soon' END AS DATE) AS since_dt FROM part""",
    dates="since_dt",
)
def coerce(t):
    day_text = F.when(F.col("p_size") > 25, F.concat(F.lit("2020-01-"), (F.col("p_size") - 20).cast("string"))).otherwise("soon")
    rows = t.part.select("p_partkey", F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).alias("brand_nr"), F.col("p_name").alias("name_nr"), day_text.alias("since_dt"))
    return features.coerce(rows, ["brand_nr", "name_nr"], ["since_dt"])


@register(
    "q_encode_map",
    """SELECT user_id, CASE WHEN deleted_ts IS NOT NULL THEN 1 ELSE 0 END AS is_deleted, CASE domain_id WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 END AS region FROM b_user""",
    uses="b_user",
)
def encode_map(t):
    rows = t.b_user.select(
        "user_id", F.when(F.col("deleted_ts").isNotNull(), True).alias("is_deleted"), features.encode_map(F.col("domain_id").cast("string"), {"1": 1, "2": 2, "3": 2}).alias("region")
    )
    return features.encode_flags(rows, ["is_deleted"])


@register(
    "q_churn_labels",
    """SELECT customer_id, CASE WHEN cancelled_dt IS NULL THEN 0 ELSE 1 END AS churned, CASE WHEN mrr_economy > 0 THEN 1 ELSE 0 END AS economy,
    CASE WHEN mrr_standard > 0 THEN 1 ELSE 0 END AS standard FROM features""",
    uses="b_customer",
    extra=FEATURES,
)
def churn_labels(t):
    rows = features.churn_labels(feature_rows(t), "cancelled_dt", {"mrr_economy": "economy", "mrr_standard": "standard"})
    return rows.select("customer_id", "churned", "economy", "standard")


@register(
    "q_tenure_days",
    f"""SELECT contract_id, CASE WHEN canceled_dt < started_dt THEN 0 ELSE coalesce(canceled_dt, DATE '{AS_OF}') - started_dt END AS tenure_days FROM
    (SELECT contract_id, started_dt, canceled_dt - CAST(contract_id % 60 AS INT) AS canceled_dt FROM b_contract) s""",
    uses="b_contract",
)
def tenure_days(t):
    moved = t.b_contract.withColumn("canceled_dt", F.date_sub("canceled_dt", (F.col("contract_id") % 60).cast("int")))
    return moved.select("contract_id", features.tenure_days(F.col("started_dt"), F.col("canceled_dt"), AS_OF).alias("tenure_days"))


@register(
    "q_tenure_minimum",
    f"""SELECT contract_id, tenure_days FROM (SELECT contract_id, DATE '{AS_OF}' - started_dt AS tenure_days FROM b_contract) s
    WHERE tenure_days = (SELECT min(DATE '{AS_OF}' - started_dt) FROM b_contract)""",
    uses="b_contract",
)
def tenure_minimum(t):
    rows = t.b_contract.select("contract_id", F.datediff(dates.day(AS_OF), "started_dt").alias("tenure_days"))
    return keyed.rows_at_max(rows, [], "tenure_days", lowest=True)


PCT = lambda part, whole: f"CAST((2 * ({part}) * 10000 + ({whole})) // (2 * ({whole})) AS DOUBLE) / 100"


@register(
    "q_churn_share",
    f"""SELECT {PCT('n - g', 'n')} AS customers_stayed_pct, {PCT('g', 'n')} AS customers_churned_pct, {PCT('m - gm', 'm')} AS revenue_stayed_pct, {PCT('gm', 'm')} AS revenue_churned_pct
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE canceled_dt IS NOT NULL) AS g, CAST(sum(contract_id) AS HUGEINT) AS m, CAST(sum(contract_id) FILTER (WHERE canceled_dt IS NOT NULL) AS HUGEINT) AS gm FROM b_contract) s""",
    uses="b_contract",
    money="customers_stayed_pct customers_churned_pct revenue_stayed_pct revenue_churned_pct",
)
def churn_share(t):
    rows = t.b_contract.select(F.col("canceled_dt").isNotNull().cast("int").alias("churned"), F.col("contract_id").alias("mrr"))
    return features.churn_share(rows, "churned", "mrr")


MEASURES = ["l_quantity", "l_linenumber", "l_suppkey"]


@register(
    "q_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS p25,
        CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem""" for c in MEASURES
    ),
)
def describe(t):
    rows = features.describe(t.lineitem, MEASURES)
    return rows.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@register(
    "q_correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(MEASURES) for b in MEASURES[i:]
    ),
)
def correlation(t):
    return features.correlation(t.lineitem, MEASURES).withColumn("corr", F.round("corr", 6))


@register(
    "q_histogram",
    """SELECT l_returnflag, CAST(least(floor((l_quantity - lo) / (hi - lo) * 10), 9) AS INT) AS bin, count(*) AS rows FROM
    (SELECT l_returnflag, l_quantity, min(l_quantity) OVER (PARTITION BY l_returnflag) AS lo, max(l_quantity) OVER (PARTITION BY l_returnflag) AS hi FROM lineitem) s GROUP BY 1, 2""",
)
def histogram(t):
    return features.histogram(t.lineitem.select("l_returnflag", "l_quantity"), "l_quantity", "l_returnflag")


@register(
    "q_label_encode",
    """SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand, dense_rank() OVER (ORDER BY p_retailprice) - 1 AS p_retailprice,
    dense_rank() OVER (ORDER BY big NULLS LAST) - 1 AS big FROM (SELECT *, CASE WHEN p_size > 10 THEN p_size END AS big FROM part) s""",
)
def label_encode(t):
    rows = t.part.select("p_partkey", "p_brand", "p_retailprice", F.when(F.col("p_size") > 10, F.col("p_size")).alias("big"))
    return features.label_encode(rows, ["p_brand", "p_retailprice", "big"])


@register(
    "q_standardise",
    """SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size,
    round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part""",
)
def standardise(t):
    scaled = features.standardise(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return scaled.withColumns({c: F.round(c, 6) for c in ("p_size", "p_retailprice")})


BUCKET_SQL = "CAST(('0x' || substr(md5('42|' || o_orderkey), 1, 8)) AS BIGINT) % 100"


@register("q_split", f"SELECT o_orderkey, {BUCKET_SQL} < 20 AS is_test FROM orders")
def split(t):
    train, test = model.split(t.orders.select("o_orderkey"), "o_orderkey")
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


RATE = lambda part, whole: f"CASE WHEN coalesce({whole}, 0) = 0 THEN 0 ELSE CAST((2 * {part} * 10000 + ({whole})) // (2 * ({whole})) AS DOUBLE) / 10000 END"


@register(
    "q_class_report",
    f"""SELECT class, {RATE('hits', 'guessed')} AS precision, {RATE('hits', 'support')} AS recall, {RATE('2 * hits', 'guessed + support')} AS f1, support FROM
    (SELECT quality AS class, count(*) AS support, count(*) FILTER (WHERE quality = guess) AS hits FROM guesses GROUP BY 1) a LEFT JOIN (SELECT guess AS class, count(*) AS guessed FROM guesses GROUP BY 1) b USING (class)""",
    extra="guesses AS (SELECT l.quality, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS guess FROM labels l JOIN documents d ON d.doc_id = l.doc_id)",
    money="precision recall f1",
)
def class_report(t):
    guess = F.when(F.col("n_chars") > 500, 1).otherwise(0)
    rows = t.labels.join(t.documents, "doc_id").select("quality", guess.alias("guess"))
    return model.classification_report(rows, "quality", "guess")


@register(
    "q_class_report_summary",
    """SELECT 'accuracy' AS "row", CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall, round(avg(CASE WHEN quality = guess THEN 1.0 ELSE 0.0 END), 4) AS f1, count(*) AS support FROM guesses
    UNION ALL SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), CAST(sum(support) AS BIGINT) FROM rates
    UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4), round(sum(f * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM rates""",
    extra="""guesses AS (SELECT l.quality, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS guess FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
    rates AS (SELECT c, support, coalesce(hits / nullif(guessed, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r, coalesce(2 * hits / nullif(guessed + support, 0), 0) AS f FROM
      (SELECT c, CAST(count(*) FILTER (WHERE quality = c) AS DOUBLE) AS support, CAST(count(*) FILTER (WHERE guess = c) AS DOUBLE) AS guessed, CAST(count(*) FILTER (WHERE quality = c AND guess = c) AS DOUBLE) AS hits
       FROM guesses, (SELECT quality AS c FROM guesses UNION SELECT guess FROM guesses) k GROUP BY c) s)""",
)
def class_report_summary(t):
    guess = F.when(F.col("n_chars") > 500, 1).otherwise(0)
    rows = t.labels.join(t.documents, "doc_id").select("quality", guess.alias("guess"))
    return model.report_summary(rows, "quality", "guess")


@register(
    "q_class_balance",
    "SELECT quality, count(*) AS rows, CAST((2 * count(*) * 10000 + sum(count(*)) OVER ()) // (2 * sum(count(*)) OVER ()) AS DOUBLE) / 10000 AS share FROM labels GROUP BY quality",
    money="share",
)
def class_balance(t):
    return features.class_balance(t.labels, "quality")


# ---------------------------------------------------------------- model

INPUTS = ["subscription_length_36_mths", "subscription_length_12_mths", "billing_every_12_mths", "billing_every_1_mths", "has_discount", "mrr", "mrr_economy", "mrr_standard", "tenure_days"]
FLAGS = [c for c in INPUTS if c.startswith(("subscription", "billing", "has_"))]


def model_rows(t):
    rows = features.encode_flags(feature_rows(t), FLAGS).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in INPUTS if c.startswith("mrr")})
    rows = rows.select("customer_id", F.col("churn_flag").cast("int").alias("churned"), *[F.col(c).cast("double").alias(c) for c in INPUTS])
    return features.standardise(materialise(rows), INPUTS)


def _model_sql() -> str:
    """The standardised rows, with their bucket of 100 and fold of 5."""
    plain = ", ".join(f"CAST(CASE WHEN {c} THEN 1 ELSE 0 END AS DOUBLE) AS {c}" if c in FLAGS else f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in INPUTS)
    scaled = ", ".join(f"({c} - avg({c}) OVER ()) / CASE stddev_pop({c}) OVER () WHEN 0 THEN 1 ELSE stddev_pop({c}) OVER () END AS {c}" for c in INPUTS)
    number = "CAST(('0x' || substr(md5('42|' || customer_id), 1, 8)) AS BIGINT)"
    return f"""inputs AS MATERIALIZED (SELECT customer_id, CAST(churn_flag AS INT) AS churned, {plain} FROM features),
    scaled AS MATERIALIZED (SELECT customer_id, churned, {scaled}, {number} % 100 AS bucket, CAST({number} % 5 AS INT) AS fold FROM inputs)"""


def _newton_sql(members: str) -> str:
    """Newton steps of all models of ``members`` (model, x, y): moments, then Gauss-Jordan elimination by recursion."""
    size = len(INPUTS) + 1
    steps = [f"w0 AS (SELECT DISTINCT model, list_transform(range({size}), lambda i: 0.0::DOUBLE) AS w FROM members)"]
    for s in range(model.STEPS):
        steps.append(f"""scored{s} AS MATERIALIZED (SELECT m.model, x, y, 1 / (1 + exp(-list_inner_product(x, w))) AS p FROM members m JOIN w{s} USING (model)),
    moments{s} AS (SELECT model, i, j, sum(CASE WHEN j = {size + 1} THEN x[i] * (p - y) ELSE x[i] * x[j] * p * (1 - p) END) AS v
      FROM scored{s}, range(1, {size + 1}) AS a(i), range(1, {size + 2}) AS b(j) GROUP BY ALL),
    start{s} AS (SELECT model, list(line ORDER BY i) AS m FROM (SELECT model, i, list(v + CASE WHEN i > 1 AND j = i THEN 1 WHEN i > 1 AND j = {size + 1} THEN w[i] ELSE 0 END ORDER BY j) AS line
      FROM moments{s} JOIN w{s} USING (model) GROUP BY model, i) GROUP BY model),
    solve{s} AS (SELECT model, 0 AS k, m FROM start{s} UNION ALL SELECT model, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / r[k + 1])
        ELSE list_transform(list_zip(r, m[k + 1]), lambda z: z[1] - z[2] * r[k + 1] / m[k + 1][k + 1]) END) FROM solve{s} WHERE k < {size}),
    w{s + 1} AS MATERIALIZED (SELECT model, list_transform(list_zip(w, m), lambda z: z[1] - z[2][{size + 1}]) AS w FROM w{s} JOIN solve{s} USING (model) WHERE k = {size})""")
    return f"members AS MATERIALIZED ({members}), " + ", ".join(steps)


X_SQL = "[1.0::DOUBLE, " + ", ".join(INPUTS) + "]"
MARGIN_SQL = f"list_inner_product({X_SQL}, w)"


@register(
    "q_logistic",
    f"""WITH RECURSIVE {_newton_sql(f"SELECT 0 AS model, {X_SQL} AS x, churned AS y FROM scaled WHERE bucket >= 20")}
    SELECT customer_id, churned, {", ".join(f"round({c}, 6) AS {c}" for c in INPUTS)}, CASE WHEN {MARGIN_SQL} > 0 THEN 1 ELSE 0 END AS prediction
    FROM scaled, w{model.STEPS} WHERE bucket < 20""",
    uses="b_customer",
    extra=f"{FEATURES}, {_model_sql()}",
)
def logistic(t):
    """Predicted churn of the held-out customers beside their features."""
    rows = model_rows(t)
    train, test = model.split(rows, "customer_id")
    return model.predict(model.fit_logistic(train, INPUTS, "churned"), test, INPUTS).withColumns({c: F.round(c, 6) for c in INPUTS})


@register(
    "q_cross_validate",
    f"""WITH RECURSIVE {_newton_sql(f"SELECT CAST(model AS INT) AS model, {X_SQL} AS x, churned AS y FROM scaled, range(5) AS r(model) WHERE fold <> model")}
    SELECT fold, CAST((2 * count(*) FILTER (WHERE churned = CASE WHEN {MARGIN_SQL} > 0 THEN 1 ELSE 0 END) * 10000 + count(*)) // (2 * count(*)) AS DOUBLE) / 10000 AS accuracy
    FROM scaled JOIN w{model.STEPS} ON model = fold GROUP BY fold""",
    uses="b_customer",
    extra=f"{FEATURES}, {_model_sql()}",
    money="accuracy",
)
def cross_validate(t):
    return model.cross_validate(model_rows(t), "customer_id", INPUTS, "churned")
