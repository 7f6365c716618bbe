"""Edge rows of the column functions."""

from datetime import date, datetime

from pyspark.sql import functions as F

from rollbook.functions import dates, json, numbers, text


def one(df, *cols):
    return tuple(df.select(*cols).first())


def test_whole_months_follow_the_day_of_month(rows):
    df = rows("s date, e date", (date(2021, 1, 31), date(2021, 2, 28)), (date(2021, 1, 31), date(2021, 3, 1)), (date(2021, 1, 5), date(2021, 1, 5)))
    got = [r[0] for r in df.select(dates.months_between_whole(F.col("e"), F.col("s"))).collect()]
    assert got == [0, 1, 0]


def test_month_shift_clamps_to_month_end(rows):
    df = rows("d date", (date(2024, 1, 31),), (date(2024, 2, 29),))
    got = [tuple(r) for r in df.select(dates.shift_months(F.col("d"), 1), dates.shift_months(F.col("d"), 36)).collect()]
    assert got == [(date(2024, 2, 29), date(2027, 1, 31)), (date(2024, 3, 29), date(2027, 2, 28))]


def test_local_date_in_summer_and_winter(rows):
    df = rows("t timestamp_ntz", (datetime(2024, 1, 1, 23, 0),), (datetime(2024, 7, 1, 22, 0),), (datetime(2024, 7, 1, 21, 59),))
    assert [r[0] for r in df.select(dates.local_date(F.col("t"))).collect()] == [date(2024, 1, 2), date(2024, 7, 2), date(2024, 7, 1)]


def test_second_field_drops_minutes(rows):
    df = rows("s timestamp_ntz, e timestamp_ntz", (datetime(2024, 1, 1, 0, 0, 0), datetime(2024, 1, 1, 0, 2, 5)))
    assert one(df, dates.second_field(F.col("e"), F.col("s")), dates.seconds_between(F.col("e"), F.col("s"))) == (5.0, 125.0)


def test_clean_text_removes_invisible_characters(rows):
    df = rows("t string", ("a\tb​c d﻿\n e",))
    assert one(df, text.clean_text(F.col("t"))) == ("abcd e",)


def test_address_split(rows):
    df = rows("a string", ("Main St 12a",), ("12 First",), ("NoNumber",), (None,))
    got = [tuple(r) for r in df.select(text.street_of(F.col("a")), text.house_number_of(F.col("a"))).collect()]
    assert got == [("Main St ", "12a"), ("12 First", None), ("NoNumber", None), (None, None)]


def test_postal_codes(rows):
    df = rows("p string", ("123",), ("AB1",), ("12345678901",), ("123456",), (" 10115 ",), ("12.5",))
    assert [r[0] for r in df.select(text.postal_code(F.col("p"))).collect()] == ["00123", None, None, None, "10115", None]


def test_phone_numbers(rows):
    df = rows("p string", (" +49 30-1.2 ",), ("call me",), ("12a",), ("- .",))
    assert [r[0] for r in df.select(text.phone_number(F.col("p"))).collect()] == ["+49 30-1.2", None, None, None]


def test_like_any_escapes_underscore(rows):
    df = rows("c string", ("x_cc_1",), ("xaccb1",))
    assert [r[0] for r in df.select(text.like_any(F.col("c"), [r"%\_cc\_%"])).collect()] == [True, False]


def test_main_domain(rows):
    df = rows("d string", ("com.acme",), ("com.acme.Shop.x",), ("com.acme.de.k1.y",))
    got = [r[0] for r in df.select(text.main_domain(F.col("d"), "com.acme", "com.acme.de")).collect()]
    assert got == ["com.acme", "com.acme.shop", "com.acme.de.k1"]


def test_discount_documents(rows):
    df = rows(
        "d string", ('{"type":"percentage","value":0.15}',), ('{"type":"amount","value":{"amount":250,"currency":"EUR"}}',), ("{broken",), (None,),
        ('{"type":"amount","value":{"amount":"300"}}',),
    )
    got = [None if r[0] is None else float(r[0]) for r in df.select(json.discount_value(F.col("d"))).collect()]
    assert got == [0.15, 250.0, None, None, 300.0]


def test_json_presence(rows):
    df = rows("d string", ('{"g":["a"]}',), ('{"g":[]}',), ("{}",), (None,))
    assert [r[0] for r in df.select(json.has_json(F.col("d"), "g")).collect()] == [True, False, False, False]


def test_private_addresses_are_masked(rows):
    full = '{"streetName":"S 1","postalCode":"1","city":"C","country":"DE"}'
    df = rows("d string, c string", (full, "BUSINESS"), (full, "PRIVATE"), ('{"venueName":"V"}', "BUSINESS"))
    assert [r[0] for r in df.select(json.format_address(F.col("d"), F.col("c"))).collect()] == ["S 1, 1 - C, DE", None, "V"]


def test_round_div_is_exact(rows):
    df = rows("n long, d long", (5, 2), (-5, 2), (1, 3), (7, 0), (10**15, 3))
    assert [r[0] for r in df.select(numbers.round_div([F.col("n")], [F.col("d")])).collect()] == [3, -3, 0, None, 333333333333333]
    big = df.select(numbers.round_div([F.col("n"), 10**9, 7], [F.col("d"), 10**9], minus=[F.col("n"), 10**9])).collect()
    assert [r[0] for r in big] == [15, -15, 2, None, 2 * 10**15]
