"""Operators against brute force and edge rows, including a key that holds most rows."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from rollbook.functions.dates import time_slice
from rollbook.operators import aggregates as agg
from rollbook.operators import filters, intervals, joins, keyed, lists, ordered, sets, snapshots

from .conftest import DATA

T0 = datetime(2024, 1, 1)


def skewed(spark, n=1500, seed=3):
    """Rows (key, ts, id, x): two thirds belong to one key, some times repeat."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if rng.random() < 0.66 else f"k{rng.randrange(8)}"
        data.append((key, T0 + timedelta(minutes=rng.randrange(4000)), i, rng.randrange(100)))
    return data, spark.createDataFrame(data, "key string, ts timestamp_ntz, id int, x int")


def by_key(data):
    groups = defaultdict(list)
    for row in data:
        groups[row[0]].append(row)
    return {k: sorted(v, key=lambda r: (r[1], r[2])) for k, v in groups.items()}


def test_ordered_equals_plain_windows(spark):
    data, df = skewed(spark)
    out = ordered.ordered(
        df, ["key"], ["ts", "id"], time_slice(F.col("ts")), lead={"next_x": "x"}, lag={"prev_id": "id"}, running={"total": "x"}, position="n"
    )
    got = {r["id"]: (r["next_x"], r["prev_id"], r["total"], r["n"]) for r in out.collect()}
    want = {}
    for group in by_key(data).values():
        total = 0
        for i, row in enumerate(group):
            total += row[3]
            want[row[2]] = (group[i + 1][3] if i + 1 < len(group) else None, group[i - 1][2] if i else None, total, i + 1)
    assert got == want


def test_running_sum_counts_peers_together(spark):
    data, df = skewed(spark)
    out = ordered.ordered(df, ["key"], ["ts"], time_slice(F.col("ts")), running={"total": "x"})
    got = {r["id"]: r["total"] for r in out.collect()}
    groups = by_key(data)
    assert got == {r[2]: sum(o[3] for o in groups[r[0]] if o[1] <= r[1]) for r in data}


def test_latest_before_equals_search(spark):
    data, facts = skewed(spark)
    other, points = skewed(spark, n=300, seed=9)
    points = points.select("key", F.col("ts").alias("since"), F.col("id").alias("point"))
    got = {r["id"]: r["point"] for r in ordered.latest_before(facts, points, ["key"], F.col("ts"), "since", ["point"]).collect()}
    groups = by_key(other)
    want = {}
    for r in data:
        before = [o for o in groups.get(r[0], []) if o[1] <= r[1]]
        want[r[2]] = before[-1][2] if before else None
    assert got == want


def scans(df):
    """File scans that really ran, exchanges that were reused left out."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


def test_sliced_windows_read_their_input_once(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id", "ts", "value")
    slices = time_slice(F.col("ts"))
    for more in ({"lead": {"next": "value"}}, {"lag": {"prev": "value"}}, {"running": {"total": "value"}}, {"position": "n"}):
        out = ordered.ordered(events, ["user_id"], ["ts", "event_id"], slices, **more)
        assert scans(out) == 1, more
        assert scans(out.drop("user_id").filter("event_id > 10")) == 1, more
    nested = ordered.ordered(ordered.ordered(events, ["user_id"], ["ts"], slices, running={"a": "value"}), ["user_id"], ["ts"], slices, running={"b": "a"})
    assert scans(nested) == 1
    points = spark.read.parquet(f"{DATA}/events.parquet").filter("event_type = 'view'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("point"))
    assert scans(ordered.latest_before(events, points, ["user_id"], F.col("ts"), "since", ["point"]).select("event_id", "point")) == 2


def test_spread_totals_equal_totals_and_read_once(spark):
    data, df = skewed(spark)
    df = df.withColumn("odd", F.col("x") % 2 == 1).withColumn("key", F.nullif("key", F.lit("k3")))
    wanted = {"total": F.sum("x"), "low": F.min("ts"), "high": F.max("id"), "any_odd": F.bool_or("odd")}
    kinds = {"total": ("sum", "x"), "low": ("min", "ts"), "high": ("max", "id"), "any_odd": ("any", "odd")}
    got = keyed.spread_totals(df, ["key"], kinds, parts=5)
    assert sorted(got.collect(), key=str) == sorted(keyed.with_totals(df, ["key"], **wanted).collect(), key=str)
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id", "value")
    assert scans(keyed.spread_totals(events, ["user_id"], {"total": ("sum", "value")})) == 1


def test_open_per_day_equals_counting_each_day(spark):
    """Overlapping, touching, empty and ten-year intervals, NULL keys; one key has most rows. No row per key and day."""
    rng = random.Random(8)
    low, high = date(2020, 1, 1), date(2020, 3, 31)
    spans = []
    for i in range(400):
        key = None if i % 41 == 0 else 1 if rng.random() < 0.4 else rng.randrange(2, 60)
        start = low + timedelta(days=rng.randrange(-60, 100))
        spans.append((key, start, start + timedelta(days=rng.choice([0, 1, 3, 10, 3650, -2]))))
    spans += [(99, date(2015, 1, 1), date(2025, 1, 1)), (100, date(2019, 1, 1), low), (101, high, None), (102, None, high)]
    df = spark.createDataFrame(spans, "key int, s date, e date")
    got = {r["date_key"]: (r["open_rows"], r["open_keys"]) for r in intervals.open_per_day(df, "key", "s", "e", low, high).collect()}
    want = {}
    clipped = [(k, max(s or low, low), min(e or high + timedelta(days=1), high + timedelta(days=1))) for k, s, e in spans]
    for n in range((high - low).days + 1):
        day = low + timedelta(days=n)
        inside = [k for k, s, e in clipped if s <= day < e]
        if inside:
            want[day] = (len(inside), len({k for k in inside if k is not None}))
    assert got == want
    plan = intervals.open_per_day(df, "key", "s", "e", low, high)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "NestedLoop" not in plan  # the calendar is folded, no interval is expanded


def test_text_list_pieces_join_to_the_whole_list(spark):
    """One group has most values, many begin alike; NULL keys and values; pieces are bounded and in order."""
    rng = random.Random(6)
    data = []
    for _ in range(3000):
        key = "hot" if rng.random() < 0.7 else None if rng.random() < 0.1 else f"k{rng.randrange(9)}"
        data.append((key, None if rng.random() < 0.05 else f"Customer#{rng.randrange(1500):06d}"))
    df = spark.createDataFrame(data + [("empty", None)], "key string, v string").repartition(5)
    for distinct in (True, False):
        pieces = defaultdict(list)
        for r in lists.text_list_pieces(df, ["key"], "v", distinct=distinct, piece_values=64, slice_values=100).collect():
            pieces[r["key"]].append((r["piece"], r["n_values"], r["values"]))
        want = defaultdict(list)
        for key, v in data:
            if v is not None:
                want[key].append(v)
        assert set(pieces) == set(want)
        for key, values in want.items():
            values = sorted(set(values) if distinct else values)
            found = sorted(pieces[key])
            assert ",".join(text for _, _, text in found) == ",".join(values)
            assert [n for _, n, _ in found] == [len(values[i : i + 64]) for i in range(0, len(values), 64)] and [p for p, _, _ in found] == list(range(len(found)))


def test_interval_join_equals_nested_loop(spark):
    data, facts = skewed(spark, n=400)
    spans, _ = skewed(spark, n=120, seed=5)
    spans = [(k, s, s + timedelta(minutes=90 * (i % 40)), i) for k, s, i, _ in spans]
    validity = spark.createDataFrame(spans, "key string, valid_from timestamp_ntz, valid_until timestamp_ntz, span int")
    inside = (F.col("ts") >= F.col("valid_from")) & (F.col("ts") < F.col("valid_until"))
    joined = intervals.interval_join(facts, validity, "key", inside, F.col("ts"))
    got = sorted((r["id"], r["span"]) for r in joined.collect())
    assert got == sorted((i, s) for k, t, i, _ in data for sk, a, b, s in spans if k == sk and a <= t < b)


def test_long_intervals_are_listed_under_few_slices(spark):
    """Ten years, one day and a century: at most a tier's slices each, and every fact finds what contains it."""
    born = datetime(1990, 5, 17, 3, 30)
    spans = [("a", born, born + timedelta(days=n), n) for n in (0, 1, 31, 32, 40, 900, 1100, 3652, 36_525)] + [("a", born, born - timedelta(days=3), -3), ("a", None, born, -1)]
    validity = spark.createDataFrame(spans, "key string, valid_from timestamp_ntz, valid_until timestamp_ntz, span int")
    times = [(i, "a", born + timedelta(days=i * 37 - 50, hours=i)) for i in range(400)]
    facts = spark.createDataFrame(times, "id int, key string, ts timestamp_ntz")
    inside = (F.col("ts") >= F.col("valid_from")) & (F.col("ts") < F.col("valid_until"))
    joined = intervals.interval_join(facts, validity, "key", inside, F.col("ts"))
    want = sorted((i, n) for i, _, t in times for _, a, b, n in spans if a and a <= t < b)
    assert sorted((r["id"], r["span"]) for r in joined.collect()) == want


def test_expand_to_days_total_length(rows):
    df = rows("id int, s date, e date", (1, date(2024, 1, 30), date(2024, 2, 2)), (2, date(2024, 1, 1), date(2024, 1, 1)), (3, date(2023, 1, 1), date(2025, 1, 1)))
    out = intervals.expand_to_days(df, "s", "e", "2024-01-01", "2024-02-01")
    assert {r["id"]: r["count"] for r in out.groupBy("id").count().collect()} == {1: 3, 3: 32}
    months = intervals.expand_to_months(df, "s", "e", "2024-01-01", "2024-02-01")
    assert {r["id"]: r["count"] for r in months.groupBy("id").count().collect()} == {1: 2, 3: 2}


def test_running_and_ending(rows):
    day = date(2024, 1, 10)
    df = rows("id int, s date, e date", (1, day, date(2024, 2, 1)), (2, date(2024, 1, 1), day), (3, day, day))
    assert [r["id"] for r in filters.running_at(df, "s", "e", day).collect()] == [1]
    assert sorted(r["id"] for r in filters.running_or_ending(df, "s", "e", day).collect()) == [1, 2]


def test_exclude_value_keeps_null(rows):
    df = rows("c string", ("a",), ("b",), (None,))
    assert [r["c"] for r in filters.exclude_value(df, "c", "a").collect()] == ["b", None]


def test_latest_row_with_null_and_equal_times(rows):
    df = rows("k int, t int, id int", (1, None, 1), (1, 5, 2), (1, 5, 3), (2, None, 4))
    out = keyed.latest_per_key(df, ["k"], [F.col("t").desc_nulls_last(), F.col("id").desc()])
    assert sorted(r["id"] for r in out.collect()) == [3, 4]


def test_totals_keep_null_keys(rows):
    df = rows("k int, x int", (1, 2), (1, 3), (None, 4), (None, 5))
    got = sorted((r["x"], r["total"]) for r in keyed.with_totals(df, ["k"], total=F.sum("x")).collect())
    assert got == [(2, 5), (3, 5), (4, 9), (5, 9)]


def test_duplicates_and_first_rows_are_complements(rows):
    df = rows("k int, id int", (1, 3), (1, 1), (1, 2), (2, 9))
    assert sorted(r["id"] for r in keyed.duplicates(df, ["k"], ["id"]).collect()) == [2, 3]
    assert sorted(r["id"] for r in keyed.first_rows(df, ["k"], ["id"]).collect()) == [1, 9]


def test_any_true_is_three_valued(rows):
    df = rows("k int, b boolean", (1, None), (1, None), (2, False), (2, None), (3, False), (4, True), (4, None))
    got = {r["k"]: r["v"] for r in df.groupBy("k").agg(agg.any_true(F.col("b")).alias("v")).collect()}
    assert got == {1: None, 2: None, 3: False, 4: True}


def test_priority_and_contains(rows):
    df = rows("k int, s string", (1, "b"), (1, "a"), (2, "z"), (3, None))
    got = {r["k"]: (r["p"], r["h"]) for r in df.groupBy("k").agg(
        agg.priority_status(F.col("s"), ["a", "b"]).alias("p"), agg.has_value(F.col("s"), "b").alias("h")
    ).collect()}
    assert got == {1: ("a", True), 2: (None, False), 3: (None, False)}


def test_list_order_puts_unknown_last(rows):
    df = rows("s string", ("x",), ("b",), ("a",), (None,))
    got = [r["s"] for r in df.orderBy(keyed.order_by_list(F.col("s"), ["a", "b"]), F.col("s").asc_nulls_last()).collect()]
    assert got == ["a", "b", "x", None]


def test_repair_key(rows):
    df = rows("k string", ("fake",), ("1",))
    assert [tuple(r) for r in df.select(joins.repair_key(F.col("k"), "fake", "0"), joins.repair_key(F.col("k"), "fake")).collect()] == [("0", None), ("1", "1")]


def test_fallback_rows_only_for_missing_keys(rows):
    a, b = rows("k int, v string", (1, "a")), rows("k int, v string", (1, "b"), (2, "b"))
    assert sorted(tuple(r) for r in sets.union_fallback(a, b, ["k"]).collect()) == [(1, "a"), (2, "b")]


def test_correction_replaces_only_given_rows(rows):
    df, fix = rows("k int, v int", (1, 10), (2, 20)), rows("k int, v int", (2, 21))
    assert sorted(tuple(r) for r in snapshots.apply_correction(df, fix, "k", "v").collect()) == [(1, 10), (2, 21)]


def test_repair_of_a_hot_name_equals_plain_steps(spark):
    """A third of all versions belongs to one name, in several slices of keys, with repeated versions."""
    rng, as_of = random.Random(2), datetime(2024, 6, 1)
    versions = []
    for i in range(900):
        name = "hot" if i % 3 == 0 else f"n{rng.randrange(200)}"
        start = T0 + timedelta(hours=rng.randrange(5000))
        key = i * 997 if name == "hot" else i
        versions.append((key, name, rng.randrange(1, 400), start, start + timedelta(hours=rng.randrange(900)), True))
    df = spark.createDataFrame(versions, "domain_key long, domain_name string, version_nr int, valid_from_ts timestamp_ntz, valid_to_ts timestamp_ntz, is_last_version boolean")
    kept = {}
    for v in sorted(versions):
        kept.setdefault((v[1], v[2]), list(v))
    groups = defaultdict(list)
    for v in sorted(kept.values()):
        groups[v[1]].append(v)
    want = []
    for group in groups.values():
        ends, starts = [v[4] for v in group], []
        for i, v in enumerate(group):
            starts.append(ends[i - 1] if i and ends[i - 1] > v[3] and ends[i - 1] < as_of else v[3])
        for i, v in enumerate(group):
            after = starts[i + 1] if i + 1 < len(group) else None
            end = after if after and after < v[4] and after < as_of else v[4]
            want.append((v[0], v[1], v[2], starts[i], end, not end < as_of))
    assert sorted(map(tuple, snapshots.repair_scd2(df, as_of).collect())) == sorted(want)


def test_repaired_versions_do_not_overlap(rows):
    far = datetime(2999, 12, 31)
    df = rows(
        "domain_key long, domain_name string, version_nr int, valid_from_ts timestamp_ntz, valid_to_ts timestamp_ntz, is_last_version boolean",
        (1, "d", 1, T0, T0 + timedelta(days=3), True),
        (2, "d", 2, T0 + timedelta(days=2), T0 + timedelta(days=5), True),  # starts before the first ends
        (3, "d", 3, T0 + timedelta(days=5), far, True),
        (9, "d", 3, T0 + timedelta(days=5), far, True),  # repeated version
        (4, "e", 1, T0, far, True),
    )
    fixed = snapshots.repair_scd2(df, datetime(2024, 6, 1)).orderBy("domain_key").collect()
    assert [r["domain_key"] for r in fixed] == [1, 2, 3, 4]
    assert fixed[1]["valid_from_ts"] == T0 + timedelta(days=3)
    assert [r["is_last_version"] for r in fixed] == [False, False, True, True]
    d = [r for r in fixed if r["domain_name"] == "d"]
    assert all(a["valid_to_ts"] <= b["valid_from_ts"] for a, b in zip(d, d[1:]))
    assert snapshots.collapse_versions(df).count() == 4


def test_text_list_slices_join_on_bounded_rows(spark):
    """A value never carries all borders of its group, and a large group is not brought into one task by its key."""
    df = spark.range(4000).select(F.lit("hot").alias("key"), F.col("id").cast("string").alias("__v"))
    placed = lists._with_slices(df, ["key"], "__v", 10)  # some 400 borders
    rows = sorted(placed.collect(), key=lambda r: r["__v"])
    got = [r["__s"] for r in rows]
    sizes = [got.count(s) for s in set(got)]
    assert got == sorted(got) and len(sizes) > 200 and max(sizes) < 100
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert all("strategy=broadcast" in line for line in plan.splitlines() if " Join " in f" {line}")


def test_totals_at_a_grain_equal_totals_level_by_level(spark):
    """NULL and repeated keys; the wide rows meet one join for each grain, not one for each level."""
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", None, 7), (None, 1, 2), (None, None, 3), ("b", 2, None)], "k string, o int, x int").withColumn("wide", F.lit("w"))
    levels = (["k"], {"k_max": F.max("x")}), (["o"], {"o_sum": F.sum("x")}), (["k", "o"], {"n": F.count("x")})
    want = keyed.with_totals_by(df, *levels)
    got = keyed.with_totals_at(df, (["k", "o"], *levels))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    joins_of_wide = lambda out: sum("wide" in j.output().mkString() for j in _joins(out._jdf.queryExecution().analyzed()))
    assert joins_of_wide(got) == 1 and joins_of_wide(want) == 3


def test_numbered_rows_are_exchanged_once_for_all_readers(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("b", 5), (None, 7), (None, None)], "k string, x int")
    at = keyed.numbered(df, "k")
    assert sorted(map(str, at.collect())) == sorted(str(r) for r in spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", 5, 1), (None, None, 1), (None, 7, 2)], "k string, x int, __nr int").collect())
    both = at.groupBy("k").count().unionByName(at.select("k", F.col("x").cast("bigint").alias("count")))
    both.collect()
    assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _joins(plan):
    children = plan.children()
    own = [plan] if plan.nodeName() == "Join" else []
    return own + [j for i in range(children.size()) for j in _joins(children.apply(i))]
