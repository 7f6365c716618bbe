"""Odometer logbook: trips between odometer readings.

Readings: car_id, reading_id, reading_ts, odometer_km (valid ones only). Trips: trip_id, car_id,
trip_start_ts, trip_end_ts, distance_m, adjustment_m, the distances by kind (``KINDS``, a merged trip can have
several), is_merged, category, addresses and the columns of ``NOTES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import local_date, moment, shift_minutes, time_slice
from ..functions.json import format_address
from ..functions.numbers import round_div
from ..operators.intervals import contains_with_tolerance
from ..operators.ordered import latest_before, ordered, validity_intervals


KINDS = ("business", "commute", "private")
NOTES = ("contact_name", "contact_company", "reason", "driver", "comment")


def reading_intervals(readings: DataFrame, as_of, unit: str = "hour") -> DataFrame:
    """Each reading valid from its time until the next one of the car, the last until ``as_of``."""
    usable = readings.filter("odometer_km IS NOT NULL").dropDuplicates(["car_id", "reading_ts", "odometer_km"])
    slices = time_slice(F.col("reading_ts"), unit)
    return validity_intervals(usable, ["car_id"], "reading_ts", ["reading_id"], slices, moment(as_of))


def trips_with_reading(readings: DataFrame, trips: DataFrame, as_of, tolerance_minutes: int = 3, unit: str = "hour") -> DataFrame:
    """Trips whose start (shifted later) and end (shifted earlier) lie in one reading's interval."""
    inside = contains_with_tolerance(
        F.col("trip_start_ts"), F.col("trip_end_ts"), F.col("valid_from"), F.col("valid_until"), tolerance_minutes
    )
    probe = shift_minutes(F.col("trip_start_ts"), tolerance_minutes)
    # the intervals of a car do not overlap, so only its latest reading can contain the start
    latest = latest_before(trips, reading_intervals(readings, as_of, unit), ["car_id"], probe, "valid_from", ["reading_id"], unit)
    return latest.filter(inside)


def odometer_logbook(
    readings: DataFrame, trips: DataFrame, cars: DataFrame, as_of, tolerance_minutes: int = 3, unit: str = "hour"
) -> DataFrame:
    """Odometer at departure and arrival of each trip: the reading plus the distance driven since it."""
    rows = trips_with_reading(readings, trips, as_of, tolerance_minutes, unit)
    rows = rows.select(
        "car_id", "reading_id", "odometer_km", "trip_id", "trip_start_ts", "trip_end_ts", "category", "is_merged", "start_address", "end_address",
        *[f"distance_{kind}_m" for kind in KINDS], *NOTES,
        (F.col("distance_m") + F.col("adjustment_m")).alias("driven_m"),
    )
    rows = ordered(
        rows, ["car_id", "reading_id"], ["trip_start_ts", "trip_id"], time_slice(F.col("trip_start_ts"), unit),
        running={"rolling_m": "driven_m"}, position="trips_since_reading",
    )
    at_start, at_end = F.col("rolling_m") - F.col("driven_m"), F.col("rolling_m")
    kilometres = lambda metres: round_div([F.col("odometer_km") * 1000 + metres], [1000])
    return rows.join(cars, "car_id").select(
        "domain_name", "trip_id", "car_id", "licence_plate", "category",
        local_date(F.col("trip_start_ts")).alias("departure_dt"), local_date(F.col("trip_end_ts")).alias("arrival_dt"),
        "trips_since_reading", kilometres(at_start).alias("departure_km"), kilometres(at_end).alias("arrival_km"),
        *[round_div([F.col(f"distance_{kind}_m")], [1000]).alias(f"{kind}_km") for kind in KINDS],
        F.when(F.col("is_merged"), "yes").otherwise("no").alias("merged"),
        format_address(F.col("start_address"), F.col("category")).alias("start_address"),
        format_address(F.col("end_address"), F.col("category")).alias("end_address"),
        *NOTES,
    )


def odometer_join_audit(readings: DataFrame, trips: DataFrame, as_of, tolerance_minutes: int = 3, unit: str = "hour") -> DataFrame:
    """Trips starting inside an interval (both ends included) that fail the start test or the end test."""
    start, end = F.col("trip_start_ts"), F.col("trip_end_ts")
    trips = trips.select("trip_id", "car_id", "trip_start_ts", "trip_end_ts")
    intervals = reading_intervals(readings, as_of, unit)
    # one interval at most goes on past the start; any others end exactly at it
    running = latest_before(trips, intervals, ["car_id"], start, "valid_from", ["reading_id"], unit).filter(F.col("valid_until") > start)
    ending = trips.join(intervals.withColumn("trip_start_ts", F.col("valid_until")), ["car_id", "trip_start_ts"])
    rows = running.unionByName(ending.select(*running.columns))
    inside = lambda ts: (ts >= F.col("valid_from")) & (ts < F.col("valid_until"))
    early = shift_minutes(end, -tolerance_minutes)
    rows = rows.withColumns({
        "start_fits": F.when(inside(shift_minutes(start, tolerance_minutes)), True),
        "end_fits": F.when(inside(early), True),
        "reading_near_end": F.when(F.col("valid_from").between(early, end) | F.col("valid_until").between(early, end), True),
    })
    # the condition reads (TRUE AND start_fits IS NULL) OR end_fits IS NULL
    return rows.filter(F.col("start_fits").isNull() | F.col("end_fits").isNull()).select(
        "trip_id", "reading_id", "trip_start_ts", "trip_end_ts", "valid_from", "valid_until", "start_fits", "end_fits", "reading_near_end"
    )
