"""Logbook and usage jobs on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..plans import logbook, usage
from .base import register
from .constructs import EVENT_AS_OF, MATCH_SQL, VALIDITY_SQL

# ---------------------------------------------------------------- logbook

ADDRESS_SQL = """CASE WHEN category = 'PRIVATE' THEN NULL WHEN {id} % 5 = 0 THEN 'Venue ' || {id}
    ELSE 'Street ' || {id} || ', ' || {id} % 100 || ' - City, DE' END"""
CATEGORY = "CASE trip_id % 3 WHEN 0 THEN 'BUSINESS' WHEN 1 THEN 'COMMUTE' ELSE 'PRIVATE' END"


def trips(t):
    """Trips with category, adjustment and JSON addresses derived from their ids."""

    def address(key):
        number = F.col(key).cast("string")
        return F.to_json(F.struct(
            F.when(F.col(key) % 5 != 0, F.concat(F.lit("Street "), number)).alias("streetName"),
            (F.col(key) % 100).cast("string").alias("postalCode"), F.lit("City").alias("city"), F.lit("DE").alias("country"),
            F.concat(F.lit("Venue "), number).alias("venueName"),
        ))

    return t.b_trip.withColumns({
        "category": F.expr(CATEGORY), "adjustment_m": (F.col("trip_id") % 7) * 10, **{c: F.expr(e) for c, e in TRIP_PARTS.items()},
        "start_address": address("trip_id"), "end_address": address("car_id"),
    })


def cars(t):
    return t.b_user.select(
        F.col("user_id").alias("car_id"), F.concat(F.lit("d"), F.col("domain_id").cast("string")).alias("domain_name"),
        F.concat(F.lit("B-X "), F.col("user_id").cast("string")).alias("licence_plate"),
    )


# Every eleventh trip is merged: half of it private, whatever its category. {div} is whole division.
MERGED = "trip_id % 11 = 0"
KIND = {"business": 0, "commute": 1, "private": 2}
TRIP_PARTS_SQL = {f"distance_{k}_m": f"CASE WHEN trip_id % 3 = {n} THEN distance_m - CASE WHEN {MERGED} THEN distance_m {{div}} 2 ELSE 0 END ELSE 0 END"
                  + (f" + CASE WHEN {MERGED} THEN distance_m {{div}} 2 ELSE 0 END" if k == "private" else "") for k, n in KIND.items()}
TRIP_PARTS_SQL |= {
    "is_merged": MERGED, "contact_name": "CASE WHEN trip_id % 4 = 0 THEN concat('Name ', trip_id) END", "contact_company": "CASE WHEN trip_id % 4 = 0 THEN concat('Company ', car_id) END",
    "reason": "CASE WHEN trip_id % 3 = 0 THEN 'visit' END", "driver": "concat('Driver ', car_id % 9)", "comment": "CASE WHEN trip_id % 13 = 0 THEN '' END",
}
TRIP_PARTS = {c: e.replace("{div}", "div") for c, e in TRIP_PARTS_SQL.items()}
TRIP_SQL = f"""trip AS (SELECT *, {CATEGORY} AS category, (trip_id % 7) * 10 AS adjustment_m,
    {", ".join(f"{e.replace('{div}', '//')} AS {c}" for c, e in TRIP_PARTS_SQL.items())} FROM b_trip)"""


@register(
    "q_odometer",
    f"""SELECT 'd' || u.domain_id AS domain_name, s.trip_id, s.car_id, 'B-X ' || s.car_id AS licence_plate, s.category,
    CAST(s.trip_start_ts + INTERVAL '1' HOUR AS DATE) AS departure_dt, CAST(s.trip_end_ts + INTERVAL '1' HOUR AS DATE) AS arrival_dt,
    row_number() OVER w AS trips_since_reading,
    CAST((2 * (s.odometer_km * 1000 + sum(s.driven_m) OVER w - s.driven_m) + 1000) // 2000 AS BIGINT) AS departure_km,
    CAST((2 * (s.odometer_km * 1000 + sum(s.driven_m) OVER w) + 1000) // 2000 AS BIGINT) AS arrival_km,
    (2 * distance_business_m + 1000) // 2000 AS business_km, (2 * distance_commute_m + 1000) // 2000 AS commute_km,
    (2 * distance_private_m + 1000) // 2000 AS private_km, CASE WHEN is_merged THEN 'yes' ELSE 'no' END AS merged,
    contact_name, contact_company, reason, driver, comment,
    {ADDRESS_SQL.format(id='s.trip_id')} AS start_address, {ADDRESS_SQL.format(id='s.car_id')} AS end_address
    FROM (SELECT t.*, v.reading_id, v.odometer_km, t.distance_m + t.adjustment_m AS driven_m FROM trip t JOIN validity v ON v.car_id = t.car_id AND {MATCH_SQL}) s
    JOIN b_user u ON u.user_id = s.car_id WINDOW w AS (PARTITION BY s.car_id, s.reading_id ORDER BY s.trip_start_ts, s.trip_id)""",
    uses="b_trip b_reading b_user",
    extra=f"{VALIDITY_SQL}, {TRIP_SQL}",
    dates="departure_dt arrival_dt",
)
def odometer(t):
    """Departure and arrival odometer per trip."""
    return logbook.odometer_logbook(t.b_reading, trips(t), cars(t), EVENT_AS_OF)


@register(
    "q_odometer_audit",
    """SELECT * FROM (SELECT t.trip_id, v.reading_id, t.trip_start_ts, t.trip_end_ts, v.valid_from, v.valid_until,
      CASE WHEN t.trip_start_ts + INTERVAL '3' MINUTE >= v.valid_from AND t.trip_start_ts + INTERVAL '3' MINUTE < v.valid_until THEN TRUE END AS start_fits,
      CASE WHEN t.trip_end_ts - INTERVAL '3' MINUTE >= v.valid_from AND t.trip_end_ts - INTERVAL '3' MINUTE < v.valid_until THEN TRUE END AS end_fits,
      CASE WHEN v.valid_from BETWEEN t.trip_end_ts - INTERVAL '3' MINUTE AND t.trip_end_ts
        OR v.valid_until BETWEEN t.trip_end_ts - INTERVAL '3' MINUTE AND t.trip_end_ts THEN TRUE END AS reading_near_end
      FROM b_trip t JOIN validity v ON v.car_id = t.car_id AND t.trip_start_ts BETWEEN v.valid_from AND v.valid_until) s
    WHERE TRUE AND start_fits IS NULL OR end_fits IS NULL""",
    uses="b_trip b_reading",
    extra=VALIDITY_SQL,
)
def odometer_audit(t):
    return logbook.odometer_join_audit(t.b_reading, t.b_trip, EVENT_AS_OF)


# ---------------------------------------------------------------- usage

PROFILE = """SELECT CASE WHEN domain_id = 7 THEN 1007 ELSE domain_id END AS domain_id, CAST(min(created_ts) AS DATE) AS first_start_dt, CASE WHEN domain_id % 3 = 0 THEN 'cancelled' ELSE 'active' END AS customer_status,
    CAST(count(*) * 8 AS DECIMAL(18,1)) AS item_quantity FROM {b_user} GROUP BY domain_id"""
CAR = """SELECT CAST(user_id % 20 AS INT) AS domain_id, event_id AS car_id, ts AS created_ts, CASE WHEN event_id % 4 = 0 THEN ts END AS ended_ts,
    CASE WHEN event_id % 3 <> 0 THEN ts + (event_id % 5 - 2) * INTERVAL '1' HOUR END AS first_trip_ts FROM {events} WHERE event_type = 'view'"""


@register(
    "q_activation_funnel",
    """SELECT p.domain_id, u.first_user_created_dt, u.users_created, u.users_deleted, CAST(u.first_activated_ts AS DATE) AS first_activated_dt, u.users_activated, u.users_activated_72h,
    CAST((2 * u.users_activated * 100 + u.users_created) // (2 * u.users_created) AS DOUBLE) / 100 AS pct_activated,
    CAST((2 * u.users_activated_72h * 100 + u.users_created) // (2 * u.users_created) AS DOUBLE) / 100 AS pct_activated_72h,
    p.first_start_dt, p.customer_status, p.item_quantity, c.active_cars, c.first_car_ts,
    CASE WHEN c.first_car_ts IS NOT NULL THEN greatest(CAST(c.first_car_ts AS DATE) - p.first_start_dt, 0) END AS days_to_first_car,
    CASE WHEN c.first_car_ts IS NOT NULL THEN greatest(CAST(c.reached_ts AS DATE) - p.first_start_dt, 0) END AS days_to_car_threshold,
    CASE WHEN u.first_activated_ts IS NOT NULL AND c.first_car_ts IS NOT NULL THEN greatest(CAST(trunc((epoch_us(c.first_car_ts) - epoch_us(u.first_activated_ts)) / 3600000000) AS BIGINT), 0) END AS hours_to_first_car,
    CASE WHEN u.first_activated_ts IS NOT NULL AND c.first_trip_ts IS NOT NULL THEN greatest(CAST(trunc((epoch_us(c.first_trip_ts) - epoch_us(u.first_activated_ts)) / 3600000000) AS BIGINT), 0) END AS hours_to_first_trip,
    CASE WHEN c.first_car_ts < u.first_activated_ts THEN 0 ELSE round_even((epoch_us(c.first_car_ts) - epoch_us(u.first_activated_ts)) / 1000000, 0) END AS seconds_to_first_car,
    CASE WHEN c.first_trip_ts < u.first_activated_ts THEN 0 ELSE round_even((epoch_us(c.first_trip_ts) - epoch_us(u.first_activated_ts)) / 1000000, 0) END AS seconds_to_first_trip
    FROM profile p LEFT JOIN (SELECT domain_id, min(CAST(created_ts + INTERVAL '1' HOUR AS DATE)) AS first_user_created_dt, count(*) AS users_created, count(deleted_ts) AS users_deleted,
      min(activated_ts) + INTERVAL '1' HOUR AS first_activated_ts, count(activated_ts) AS users_activated,
      count(*) FILTER (WHERE epoch_us(activated_ts) - epoch_us(created_ts) <= 72 * 3600000000) AS users_activated_72h
      FROM b_user WHERE deleted_ts IS NULL OR CAST(deleted_ts AS DATE) - CAST(created_ts AS DATE) > 2 GROUP BY domain_id) u ON u.domain_id = p.domain_id
    LEFT JOIN (SELECT c.domain_id, count(*) FILTER (WHERE ended_ts IS NULL) AS active_cars, min(created_ts) + INTERVAL '1' HOUR AS first_car_ts,
      min(CASE WHEN created_ts > first_trip_ts THEN created_ts ELSE first_trip_ts END) + INTERVAL '1' HOUR AS first_trip_ts,
      min(created_ts) FILTER (WHERE n > item_quantity * 0.8) + INTERVAL '1' HOUR AS reached_ts
      FROM (SELECT car.*, p.item_quantity, row_number() OVER (PARTITION BY car.domain_id ORDER BY created_ts, car_id) AS n FROM car LEFT JOIN profile p ON p.domain_id = car.domain_id) c
      GROUP BY c.domain_id) c ON c.domain_id = p.domain_id""",
    uses="b_user",
    extra=f"profile AS ({PROFILE.replace('{b_user}', 'b_user')}), car AS ({CAR.replace('{events}', 'events')})",
    dates="first_user_created_dt first_activated_dt first_start_dt",
    money="item_quantity pct_activated pct_activated_72h",
)
def activation_funnel(t):
    profile, car = t.spark.sql(PROFILE, b_user=t.b_user), t.spark.sql(CAR, events=t.events)
    return usage.activation_funnel(profile, t.b_user, car)


@register(
    "q_screen_time",
    """SELECT user_id, CAST(ts + INTERVAL '1' HOUR AS DATE) AS job_date,
    round_even(CAST(sum(extract(microsecond FROM until_ts - ts)) AS DOUBLE) / 1000000 / 60 / 30, 0) AS jobs,
    round_even(CAST(sum(extract(microsecond FROM until_ts - ts)) AS DOUBLE) / 1000000 / 60, 0) AS minutes,
    CAST(sum(epoch_us(until_ts) - epoch_us(ts)) AS DOUBLE) / 1000000 AS total_seconds FROM (SELECT user_id, ts, event_type,
    lead(ts) OVER w AS until_ts, lead(event_type) OVER w AS until_type FROM events WHERE event_type IN ('view', 'click')
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) s WHERE event_type = 'view' AND until_type = 'click' GROUP BY 1, 2""",
    dates="job_date",
    money="total_seconds",
)
def screen_time(t):
    return usage.screen_time(t.events, "view", "click")


JOBS = {"view": "route_history", "purchase": "trips_export", "signup": "trips_export"}


@register(
    "q_job_counts",
    """SELECT user_id, CAST(ts + INTERVAL '1' HOUR AS DATE) AS job_date, count(*) AS jobs,
    CASE WHEN event_type = 'view' THEN 'route_history' ELSE 'trips_export' END AS job_type FROM events
    WHERE event_type IN ('view', 'purchase', 'signup') GROUP BY user_id, event_type, 2""",
    dates="job_date",
)
def job_counts(t):
    return usage.job_counts(t.events, JOBS)


TERM = """SELECT CASE WHEN domain_id = 3 THEN 1003 ELSE domain_id END AS domain_id, CAST(created_ts AS DATE) + 2 AS start_dt, CAST(CAST(created_ts AS DATE) + 2 + CAST(user_id % 25 AS INT) AS DATE) AS end_dt
    FROM {b_user}"""
PEOPLE = """SELECT CASE WHEN domain_id = 5 THEN 1005 ELSE domain_id END AS domain_id, user_id, CAST(created_ts AS DATE) AS created_dt, CAST(activated_ts AS DATE) AS activated_dt, CAST(deleted_ts AS DATE) AS deleted_dt
    FROM {b_user}"""
DONE = """SELECT CAST(ts AS DATE) AS date_key, user_id, CAST(user_id % 20 AS INT) AS domain_id, count(*) * 4 AS jobs_last_7days FROM {events}
    GROUP BY CAST(ts AS DATE), user_id, CAST(user_id % 20 AS INT)"""
STATS_LOW, STATS_AS_OF = "2023-12-30", "2024-02-03"


def _stats_sql(grain: str) -> str:
    period = "d.date_key" if grain == "daily" else "CAST(date_trunc('month', d.date_key) AS DATE)"
    job_period = "date_key" if grain == "daily" else "CAST(date_trunc('month', date_key) AS DATE)"
    return f"""SELECT '{grain}' AS aggregation_method, x.period, count(x.domain_id) AS subscription_domains, CAST(sum(u.all_users) AS BIGINT) AS all_users,
      CAST(sum(u.activated_users) AS BIGINT) AS activated_users,
      count(x.domain_id) FILTER (WHERE u.activated_users * 2 >= u.all_users OR a.active_users IS NOT NULL) AS active_domains,
      CAST(sum(coalesce(a.active_users, 0)) AS BIGINT) AS active_users
    FROM (SELECT DISTINCT {period} AS period, s.domain_id FROM spine d LEFT JOIN term s ON s.start_dt <= d.date_key AND s.end_dt > d.date_key WHERE d.date_key < DATE '{STATS_AS_OF}') x
    LEFT JOIN (SELECT {period} AS period, domain_id, count(DISTINCT user_id) AS all_users, count(DISTINCT user_id) FILTER (WHERE d.date_key >= p.activated_dt) AS activated_users
      FROM people p JOIN spine d ON d.date_key BETWEEN p.created_dt AND coalesce(p.deleted_dt, DATE '{STATS_AS_OF}') WHERE EXISTS (SELECT 1 FROM term s WHERE s.domain_id = p.domain_id)
      GROUP BY 1, 2) u ON u.period = x.period AND u.domain_id = x.domain_id
    LEFT JOIN (SELECT {job_period} AS period, domain_id, count(DISTINCT user_id) AS active_users FROM done WHERE jobs_last_7days >= 10 GROUP BY 1, 2) a
      ON a.period = x.period AND a.domain_id = x.domain_id
    GROUP BY x.period"""


@register(
    "q_active_stats",
    f"{_stats_sql('monthly')} UNION ALL {_stats_sql('daily')}",
    uses="b_user",
    extra=f"""term AS ({TERM.replace('{b_user}', 'b_user')}), people AS ({PEOPLE.replace('{b_user}', 'b_user')}), done AS ({DONE.replace('{events}', 'events')}),
      spine AS (SELECT CAST(range AS DATE) AS date_key FROM range(DATE '{STATS_LOW}', DATE '{STATS_AS_OF}' + 1, INTERVAL 1 DAY))""",
    dates="period",
)
def active_stats(t):
    frames = [t.spark.sql(TERM, b_user=t.b_user), t.spark.sql(PEOPLE, b_user=t.b_user), t.spark.sql(DONE, events=t.events)]
    return usage.active_report(*frames, STATS_LOW, STATS_AS_OF)


CONTRACT_LINE = """SELECT o.o_custkey AS customer_id, CAST(o.o_orderdate AS DATE) AS period_start_dt,
    CAST(CAST(o.o_orderdate AS DATE) + INTERVAL '12' MONTH AS DATE) AS period_end_dt, o.o_orderstatus AS status, p.p_name AS product_name,
    p.p_size % 7 = 0 AS is_subsequent_recurring FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey"""


@register(
    "q_fleet_trips",
    """SELECT f.*, t.user_id, t.trip_id, t.distance_m // 1000 AS distance_km, CAST(t.trip_start_ts AS DATE) AS trip_start_dt, strftime(t.trip_start_ts, '%Y%m') AS yyyymm
    FROM (SELECT customer_id, period_start_dt, period_end_dt, status, string_agg(DISTINCT split_part(product_name, ' ', 1), ',' ORDER BY split_part(product_name, ' ', 1)) AS products
      FROM line WHERE regexp_matches(product_name, 'RING', 'i') AND NOT is_subsequent_recurring GROUP BY 1, 2, 3, 4) f
    JOIN (SELECT user_id AS customer_id, user_id FROM b_user) u ON u.customer_id = f.customer_id
    JOIN (SELECT *, car_id AS user_id FROM b_trip) t ON t.user_id = u.user_id AND CAST(t.trip_start_ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    uses="b_user b_trip",
    extra="line AS (" + CONTRACT_LINE.replace("{", "").replace("}", "") + ")",
    dates="period_start_dt period_end_dt trip_start_dt",
)
def fleet_trips(t):
    lines = t.spark.sql(CONTRACT_LINE, lineitem=t.lineitem, orders=t.orders, part=t.part)
    customers = t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_custkey").alias("domain_id"))
    users = t.b_user.select("user_id", F.col("user_id").alias("domain_id"))
    trip = t.b_trip.withColumnRenamed("car_id", "user_id")
    rows = usage.fleet_trips(usage.fleet_products(lines, "RING", 1), customers, users, trip, "2024-01-05", "2024-01-20")
    keep = "customer_id period_start_dt period_end_dt status products user_id trip_id distance_km trip_start_dt yyyymm".split()
    return rows.select(*keep)


FLEET_CONTRACT = """SELECT c_custkey AS contract_id, CAST(c_custkey % 25 AS INT) AS domain_id, DATE '2024-01-01' + CAST(c_custkey % 20 AS INT) AS period_start_dt,
    DATE '2024-01-01' + CAST(c_custkey % 20 + c_custkey % 12 - 1 AS INT) AS period_end_dt FROM {customer}"""


@register(
    "q_fleet_trip_counts",
    """SELECT c.*, count(t.trip_id) AS trips, CAST(coalesce(sum(t.distance_m), 0) AS BIGINT) // 1000 AS distance_km FROM contract c
    LEFT JOIN b_trip t ON t.car_id % 20 = c.domain_id AND CAST(t.trip_start_ts AS DATE) BETWEEN c.period_start_dt AND c.period_end_dt GROUP BY ALL""",
    uses="b_trip",
    extra="contract AS (" + FLEET_CONTRACT.replace("{customer}", "customer") + ")",
    dates="period_start_dt period_end_dt",
)
def fleet_trip_counts(t):
    """Trips of each contract's domain inside the contract's period."""
    contracts = t.spark.sql(FLEET_CONTRACT, customer=t.customer)
    trips = t.b_trip.select((F.col("car_id") % 20).cast("int").alias("domain_id"), "trip_start_ts", "distance_m")
    return usage.period_trip_counts(contracts, trips, ["contract_id"])


@register(
    "q_rollup_usage",
    """SELECT DISTINCT domain_name, feature_users, domain_users, CAST((2 * feature_users * 100 + domain_users) // (2 * domain_users) AS DOUBLE) / 100 AS share
    FROM (SELECT *, count(CASE WHEN uses THEN 1 END) OVER (PARTITION BY main) AS feature_users, count(*) OVER (PARTITION BY main) AS domain_users
      FROM (SELECT *, CASE WHEN domain_name LIKE 'com.acme.de.%' THEN 'com.acme.de.' || split_part(domain_name, '.', 4) ELSE 'com.acme.' || split_part(domain_name, '.', 3) END AS main
        FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'com.acme.de.k' || c_nationkey || '.site' || c_custkey % 5 ELSE 'com.acme.' || lower(c_mktsegment) || '.s' || c_custkey % 4 END AS domain_name,
          c_acctbal > 5000 AS uses FROM customer) a) b) c WHERE uses""",
    money="share",
)
def rollup_usage(t):
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    german = F.concat(F.lit("com.acme.de.k"), nation, F.lit(".site"), (key % 5).cast("string"))
    other = F.concat(F.lit("com.acme."), F.lower("c_mktsegment"), F.lit(".s"), (key % 4).cast("string"))
    users = t.customer.select(F.when(key % 3 == 0, german).otherwise(other).alias("domain_name"), (F.col("c_acctbal") > 5000).alias("uses"))
    return usage.rollup_usage(users, text.main_domain(F.col("domain_name"), "com.acme", "com.acme.de"), F.col("uses"))


@register(
    "q_feature_flags",
    """SELECT d.user_id AS domain_id, coalesce(v.domain_id IS NOT NULL, FALSE) AS uses_location, coalesce(b.domain_id IS NOT NULL, FALSE) AS uses_booking
    FROM (SELECT DISTINCT user_id FROM events) d
    LEFT JOIN (SELECT DISTINCT user_id AS domain_id FROM events WHERE ts >= DATE '2024-01-31' - INTERVAL '5' DAY AND event_type IN ('view', 'click')) v ON v.domain_id = d.user_id
    LEFT JOIN (SELECT user_id AS domain_id FROM events WHERE ts >= DATE '2024-01-31' - INTERVAL '5' DAY AND event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 2) b ON b.domain_id = d.user_id""",
)
def feature_flags(t):
    events = t.events.withColumnRenamed("user_id", "domain_id")
    used = {
        "uses_location": usage.recent_users(events, ["view", "click"], "2024-01-31", days=5),
        "uses_booking": usage.recent_users(events, ["purchase"], "2024-01-31", days=5, at_least=2),
    }
    return usage.feature_flags(events, used)


@register(
    "q_fencing_domains",
    """SELECT DISTINCT lower(c.c_name) AS domain_name FROM customer c WHERE c.c_mktsegment <> 'HOUSEHOLD'
    AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'O')""",
)
def fencing_domains(t):
    config = F.to_json(F.struct(F.struct((F.col("c_mktsegment") != "HOUSEHOLD").alias("fencing")).alias("services")))
    configurations = t.customer.select(F.col("c_name").alias("domain_name"), config.alias("configuration"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "pool").otherwise("private")
    fences = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat("c_name", F.lit(".")).alias("domain"), kind.alias("kind"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("off").alias("state")
    )
    return usage.fencing_domains(configurations, fences)


@register(
    "q_platform_share",
    """SELECT user_id AS domain_id, ios AS platform_sessions, n AS all_sessions FROM (SELECT user_id, count(*) FILTER (WHERE event_type ILIKE '%VIEW%' OR event_type ILIKE 'clic%') AS ios,
    count(*) AS n FROM events GROUP BY user_id) s WHERE (2 * ios * 100 + n) // (2 * n) >= 50""",
)
def platform_share(t):
    sessions = t.events.select(F.col("user_id").alias("domain_id"), F.col("event_type").alias("user_agent"))
    return usage.platform_share(sessions, ["%VIEW%", "clic%"])
