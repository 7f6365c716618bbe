"""Product usage: activation, screen time, job counts, active statistics, feature flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day, hours_between, local_date, local_timestamp, second_field, seconds_between, time_slice
from ..functions.json import json_flag
from ..functions.numbers import dec, ratio
from ..functions.text import like_any
from ..operators.aggregates import count_if, count_over_rollup, text_list
from ..operators.filters import lookback
from ..operators.ordered import crossing_time, event_pairs, latest_before, ordered
from ..operators.sets import union_tagged

# Fixed values of the activation rules.
ACTIVATION_HOURS = 72
SHORT_LIVED_DAYS = 2
CAR_THRESHOLD = 0.8
ACTIVE_SHARE = 0.5
ACTIVE_JOBS = 10


def activation_funnel(profile: DataFrame, users: DataFrame, cars: DataFrame) -> DataFrame:
    """Per domain: users created and activated, and the time to the first car, first trip and 80 percent of the cars.

    profile: domain_id, customer_status, first_start_dt, item_quantity. users: domain_id, user_id,
    created_ts, activated_ts, deleted_ts. cars: domain_id, car_id, created_ts, ended_ts, first_trip_ts.
    """
    lived = F.datediff(F.col("deleted_ts").cast("date"), F.col("created_ts").cast("date"))
    kept = users.filter(F.col("deleted_ts").isNull() | (lived > SHORT_LIVED_DAYS))
    quick = seconds_between(F.col("activated_ts"), F.col("created_ts")) <= ACTIVATION_HOURS * 3600
    per_user = kept.groupBy("domain_id").agg(
        F.min(local_date(F.col("created_ts"))).alias("first_user_created_dt"),
        F.count(F.lit(1)).alias("users_created"),
        F.count("deleted_ts").alias("users_deleted"),
        F.min(local_timestamp(F.col("activated_ts"))).alias("first_activated_ts"),
        F.count("activated_ts").alias("users_activated"),
        count_if(quick).alias("users_activated_72h"),
    )
    first_trip = F.when(F.col("created_ts") > F.col("first_trip_ts"), F.col("created_ts")).otherwise(F.col("first_trip_ts"))
    per_car = cars.groupBy("domain_id").agg(
        count_if(F.col("ended_ts").isNull()).alias("active_cars"),
        F.min(local_timestamp(F.col("created_ts"))).alias("first_car_ts"),
        F.min(local_timestamp(first_trip)).alias("first_trip_ts"),
    )
    wanted = cars.select("domain_id", "car_id", "created_ts").join(profile.select("domain_id", "item_quantity"), "domain_id")
    reached = crossing_time(
        wanted, ["domain_id"], "created_ts", ["car_id"], time_slice(F.col("created_ts")), F.col("item_quantity") * F.lit(CAR_THRESHOLD).cast("decimal(3,1)"), "reached_ts"
    )
    rows = profile.join(per_user, "domain_id", "left").join(per_car, "domain_id", "left").join(reached, "domain_id", "left")

    car, trip, active, start = F.col("first_car_ts"), F.col("first_trip_ts"), F.col("first_activated_ts"), F.col("first_start_dt")
    days_after_start = lambda ts: F.when(car.isNotNull(), F.greatest(F.datediff(ts.cast("date"), start), F.lit(0)))
    hours = lambda ts: F.when(active.isNotNull() & ts.isNotNull(), F.greatest(hours_between(ts, active), F.lit(0)))
    seconds = lambda ts: F.when(ts < active, F.lit(0.0)).otherwise(F.bround(seconds_between(ts, active)))
    return rows.select(
        "domain_id", "first_user_created_dt", "users_created", "users_deleted", active.cast("date").alias("first_activated_dt"),
        "users_activated", "users_activated_72h",
        ratio(F.col("users_activated"), F.col("users_created")).alias("pct_activated"),
        ratio(F.col("users_activated_72h"), F.col("users_created")).alias("pct_activated_72h"),
        start, "customer_status", "item_quantity", "active_cars", car,
        days_after_start(car).alias("days_to_first_car"),
        days_after_start(local_timestamp(F.col("reached_ts"))).alias("days_to_car_threshold"),
        hours(car).alias("hours_to_first_car"), hours(trip).alias("hours_to_first_trip"),
        seconds(car).alias("seconds_to_first_car"), seconds(trip).alias("seconds_to_first_trip"),
    )


def screen_time(events: DataFrame, first: str, second: str) -> DataFrame:
    """Minutes and 30-minute jobs per user and local day from open/leave pairs.

    The duration keeps only the seconds field of each pair's difference; ``total_seconds`` is the true sum.
    Needs user_id, event_id, ts, event_type.
    """
    cut = events.select("user_id", "event_id", "ts", "event_type")
    pairs = event_pairs(cut, ["user_id"], "ts", "event_type", ["event_id"], time_slice(F.col("ts")), first, second)
    end, start = F.col("until_ts"), F.col("ts")
    # summed as decimal: a sum of doubles would depend on the order of the rows
    field, true = dec(second_field(end, start), 12, 6), dec(seconds_between(end, start), 18, 6)
    sums = pairs.groupBy("user_id", local_date(start).alias("job_date")).agg(F.sum(field).alias("s"), F.sum(true).alias("total_seconds"))
    s = F.col("s").cast("double")
    return sums.select(
        "user_id", "job_date", F.bround(s / 60 / 30).alias("jobs"), F.bround(s / 60).alias("minutes"), "total_seconds"
    )


def job_counts(events: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Events per user, local day and event type, named by the job the type stands for."""
    kind = F.col("event_type")
    job = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[kind]
    rows = events.filter(kind.isin(list(mapping)))
    counts = rows.groupBy("user_id", local_date(F.col("ts")).alias("job_date"), "event_type").agg(F.count(F.lit(1)).alias("jobs"))
    return counts.withColumn("job_type", job).drop("event_type")


def _next_period(col: Column, grain: str) -> Column:
    return F.date_add(col, 1) if grain == "day" else F.add_months(col, 1)


def _period(col: Column, grain: str) -> Column:
    return col if grain == "day" else F.trunc(col, "month")


def open_counts(frame: DataFrame, intervals: dict[str, DataFrame], low, grain: str) -> DataFrame:
    """Number of intervals open per (domain_id, period) of ``frame``.

    Each interval frame has domain_id, first_dt, last_dt (both included). Instead of expanding every
    interval to its days, +1 is booked at its first period and -1 after its last; the running sum over
    the calendar gives the count. Work grows with intervals plus domain-periods, and a domain's calendar
    bounds the window.
    """
    names, moves = list(intervals), []
    for name, df in intervals.items():
        clipped = df.filter((F.col("last_dt") >= day(low)) & (F.col("first_dt") <= F.col("last_dt")))
        first, last = F.greatest("first_dt", day(low)), F.col("last_dt")
        both = F.array(
            F.struct(_period(first, grain).alias("period"), F.lit(1).alias("move")),
            F.struct(_next_period(_period(last, grain), grain).alias("period"), F.lit(-1).alias("move")),
        )
        moves.append(clipped.select("domain_id", F.lit(name).alias("what"), F.explode(both).alias("m")))
    booked = moves[0]
    for more in moves[1:]:
        booked = booked.unionByName(more)
    per_period = booked.groupBy("domain_id", F.col("m.period").alias("period")).agg(
        *[F.sum(F.when(F.col("what") == n, F.col("m.move"))).alias(n) for n in names]
    )
    calendar = Window.partitionBy("domain_id").orderBy("period")
    filled = frame.join(per_period, ["domain_id", "period"], "left")
    return filled.select("domain_id", "period", *[F.coalesce(F.sum(n).over(calendar), F.lit(0)).alias(n) for n in names])


def active_stats(subscriptions: DataFrame, users: DataFrame, jobs: DataFrame, low, as_of, grain: str) -> DataFrame:
    """Subscribed domains, their users, activated users and active domains per day or month up to ``as_of`` - 1.

    A domain is active when half of its users are activated or a user did enough jobs. subscriptions:
    domain_id, start_dt, end_dt (half-open). users: domain_id, user_id, created_dt, activated_dt,
    deleted_dt. jobs: date_key, user_id, domain_id, jobs_last_7days.
    """
    high = F.date_sub(day(as_of), 1)
    step = F.expr("INTERVAL 1 DAY" if grain == "day" else "INTERVAL 1 MONTH")
    periods = F.sequence(_period(day(low), grain), _period(high, grain), step)
    domains = subscriptions.select("domain_id").distinct()
    frame = domains.select("domain_id", F.explode(periods).alias("period"))

    terms = subscriptions.select("domain_id", F.col("start_dt").alias("first_dt"), F.date_sub("end_dt", 1).alias("last_dt"))
    alive = users.join(domains, "domain_id", "left_semi").select(
        "domain_id", F.col("created_dt").alias("first_dt"), F.coalesce("deleted_dt", day(as_of)).alias("last_dt"), "activated_dt"
    )
    activated = alive.filter("activated_dt IS NOT NULL").withColumn("first_dt", F.greatest("first_dt", "activated_dt"))
    counts = open_counts(
        frame, {"terms": terms, "all_users": alive.drop("activated_dt"), "activated_users": activated.drop("activated_dt")}, low, grain
    ).filter("terms > 0")

    doing = jobs.filter(F.col("jobs_last_7days") >= ACTIVE_JOBS).groupBy("domain_id", _period(F.col("date_key"), grain).alias("period"))
    doing = doing.agg(F.count_distinct("user_id").alias("active_users"))
    rows = counts.join(doing, ["domain_id", "period"], "left")
    # no user at all means no user rows, so the sums skip the domain
    users_there = lambda c: F.when(F.col("all_users") > 0, F.col(c))
    by_share = users_there("activated_users") >= F.lit(ACTIVE_SHARE) * F.col("all_users")
    per_period = rows.groupBy("period").agg(
        F.count(F.lit(1)).alias("subscription_domains"),
        F.sum(users_there("all_users")).alias("all_users"),
        F.sum(users_there("activated_users")).alias("activated_users"),
        count_if(by_share | F.col("active_users").isNotNull()).alias("active_domains"),
        F.sum(F.coalesce("active_users", F.lit(0))).alias("active_users"),
    )
    one = subscriptions.sparkSession.range(1).select(F.explode(periods).alias("period"))
    return one.join(per_period, "period", "left").fillna(0, ["subscription_domains", "active_domains", "active_users"])


def active_report(subscriptions: DataFrame, users: DataFrame, jobs: DataFrame, low, as_of) -> DataFrame:
    """Daily and monthly active statistics in one table."""
    stats = lambda grain: active_stats(subscriptions, users, jobs, low, as_of, grain)
    return union_tagged("aggregation_method", {"monthly": stats("month"), "daily": stats("day")})


def fleet_products(contract_lines: DataFrame, word: str, part: int) -> DataFrame:
    """Contracts with a product whose name contains ``word``: the distinct ``part`` words of those names."""
    name = F.col("product_name")
    kept = contract_lines.filter(name.rlike(f"(?i){word}") & ~F.col("is_subsequent_recurring"))
    keys = ["customer_id", "period_start_dt", "period_end_dt", "status"]
    return kept.groupBy(*keys).agg(text_list(F.split_part(name, F.lit(" "), F.lit(part))).alias("products"))


def fleet_trips(products: DataFrame, customers: DataFrame, users: DataFrame, trips: DataFrame, low, high) -> DataFrame:
    """Trips in [low, high] of the users of each fleet customer's domain, with calendar keys."""
    on = F.col("trip_start_ts").cast("date")
    inside = trips.filter(on.between(day(low), day(high)) & F.col("distance_m").isNotNull())
    joined = products.join(customers, "customer_id").join(users, "domain_id").join(inside, "user_id")
    return joined.withColumns({
        "trip_start_dt": on, "distance_km": F.expr("distance_m div 1000"), "yyyymm": F.date_format(on, "yyyyMM"),
    })


def period_trip_counts(contracts: DataFrame, trips: DataFrame, contract_keys: list[str], domain: str = "domain_id") -> DataFrame:
    """Trips and whole kilometres of a contract's domain in its period [period_start_dt, period_end_dt].

    Contracts and trips of a domain are never joined. Trips are summed per domain and day, the days to running totals;
    each contract looks the total up before its period and at its end, and the difference is what the period holds. Work
    grows with contracts plus days, also where one domain has most of both. ``contract_keys`` identify a contract.
    """
    per_day = trips.groupBy(domain, F.col("trip_start_ts").cast("date").alias("day_dt")).agg(F.count(F.lit(1)).alias("trips"), F.sum("distance_m").alias("metres"))
    months = F.trunc("day_dt", "month")
    upto = ordered(per_day, [domain], ["day_dt"], months, running={"trips_upto": "trips", "metres_upto": "metres"}).select(domain, "day_dt", "trips_upto", "metres_upto")
    ends = F.array(F.struct(F.lit(-1).alias("sign"), F.date_sub("period_start_dt", 1).alias("at_dt")), F.struct(F.lit(1).alias("sign"), F.col("period_end_dt").alias("at_dt")))
    bounds = contracts.select(domain, *contract_keys, "period_start_dt", "period_end_dt", F.explode(ends).alias("e")).select("*", "e.*").drop("e")
    found = latest_before(bounds, upto, [domain], F.col("at_dt"), "day_dt", ["day_dt"], "month")
    held = lambda column: F.coalesce(F.sum(F.col("sign") * F.col(column)), F.lit(0))
    counted = found.groupBy(domain, *contract_keys, "period_start_dt", "period_end_dt").agg(held("trips_upto").alias("trips"), held("metres_upto").alias("metres"))
    nothing = F.col("period_end_dt") < F.col("period_start_dt")
    return counted.select(
        domain, *contract_keys, "period_start_dt", "period_end_dt", F.when(nothing, 0).otherwise(F.col("trips")).alias("trips"),
        F.when(nothing, 0).otherwise(F.expr("metres div 1000")).alias("distance_km"),
    )


def rollup_usage(users: DataFrame, group: Column, uses: Column) -> DataFrame:
    """Per domain: users with the feature and all users of its main domain. Domains without use are left out."""
    counted = count_over_rollup(users.withColumn("__uses", F.when(uses, F.lit(1))), group, "domain_users")
    counted = count_over_rollup(counted, group, "feature_users", counted="__uses")
    per_domain = counted.filter("__uses = 1").select("domain_name", "feature_users", "domain_users").distinct()
    return per_domain.withColumn("share", ratio(F.col("feature_users"), F.col("domain_users")))


def recent_users(events: DataFrame, types: list[str], as_of, days: int = 30, at_least: int = 1) -> DataFrame:
    """Domains with at least ``at_least`` events of the given types in the last ``days`` days."""
    recent = lookback(events, "ts", as_of, days).filter(F.col("event_type").isin(types))
    return recent.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least).select("domain_id")


def fencing_domains(configurations: DataFrame, fences: DataFrame) -> DataFrame:
    """Domains with fencing switched on and an active pool fence; fence domains carry a trailing character."""
    active = fences.filter("kind = 'pool' AND state = 'active'").select(F.expr("substr(domain, 1, length(domain) - 1)").alias("domain_name"))
    on = configurations.filter(json_flag(F.col("configuration"), "services.fencing"))
    return on.join(active, "domain_name", "left_semi").select(F.lower("domain_name").alias("domain_name")).distinct()


def feature_flags(domains: DataFrame, used: dict[str, DataFrame], key: str = "domain_id") -> DataFrame:
    """One row per domain, one boolean per feature."""
    hits = [df.select(key, F.lit(name).alias("feature")) for name, df in used.items()]
    tagged = hits[0]
    for more in hits[1:]:
        tagged = tagged.unionByName(more)
    per_domain = tagged.groupBy(key).agg(*[F.bool_or(F.col("feature") == n).alias(n) for n in used])
    return domains.select(key).distinct().join(per_domain, key, "left").fillna(False, list(used))


def platform_share(sessions: DataFrame, patterns: list[str], share: float = 0.5) -> DataFrame:
    """Domains where at least ``share`` of the sessions come from the platform named by ``patterns``."""
    hits = count_if(like_any(F.col("user_agent"), patterns, ignore_case=True))
    counts = sessions.groupBy("domain_id").agg(hits.alias("platform_sessions"), F.count(F.lit(1)).alias("all_sessions"))
    return counts.filter(ratio(F.col("platform_sessions"), F.col("all_sessions")) >= share)
