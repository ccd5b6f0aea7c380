"""Timestamps against instants worked out by hand and against brute force over the zone's clock."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.operators import timestamps as T


def at(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 10**6


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2025-04-13T00:15:37z", None, None, at(2025, 4, 13, 0, 15, 37)),
        (" 2023-04-12T12:43:52Z ", None, None, at(2023, 4, 12, 12, 43, 52)),
        ("2024-07-24T08:33Z", None, None, at(2024, 7, 24, 8, 33)),
        ("2025-05-02T12:33:43.5292446Z", None, None, at(2025, 5, 2, 12, 33, 43) + 529245),
        ("2025-05-07T21:41:29,783235803+02:00", None, None, at(2025, 5, 7, 19, 41, 29) + 783236),
        ("20250707T043533Z", None, None, at(2025, 7, 7, 4, 35, 33)),
        ("20230328T041747+1100", None, None, at(2023, 3, 27, 17, 17, 47)),
        ("2025-09-11T13:02:51+10", None, None, at(2025, 9, 11, 3, 2, 51)),
        ("2024-02-12 09:32:42 JST", None, None, at(2024, 2, 12, 0, 32, 42)),
        ("13 March 2024 22:40:00 EDT", None, None, at(2024, 3, 14, 2, 40)),
        ("Nov 12, 2024, 6:45:55 AM UTC", None, None, at(2024, 11, 12, 6, 45, 55)),
        ("11. Mai 2023, 11:01:16", "Europe/Berlin", None, at(2023, 5, 11, 9, 1, 16)),
        ("2024-04-07 01:01:08 Asia/Tokyo", None, None, at(2024, 4, 6, 16, 1, 8)),
        ("2025-03-09T01:54:38 America/New_York", None, None, at(2025, 3, 9, 6, 54, 38)),
        ("Tue, 08 Jul 2025 18:28:04 +0100", None, None, at(2025, 7, 8, 17, 28, 4)),
        ("08/09/2023 10:52:13 PM", "America/New_York", "mdy", at(2023, 8, 10, 2, 52, 13)),
        ("08/09/2023 10:52:13", "Europe/Lisbon", "dmy", at(2023, 9, 8, 9, 52, 13)),
        ("25/12/2023 10:00:00", "Asia/Tokyo", None, at(2023, 12, 25, 1)),
        ("08/09/2023 10:00:00", "Asia/Tokyo", None, None),  # two days
        ("2023-03-27T20:29:41+02:00[Europe/Berlin]", None, None, at(2023, 3, 27, 18, 29, 41)),
        ("1758444055122", None, None, 1758444055122000),
        ("1780956836", None, None, 1780956836 * 10**6),
        ("1722688962734520", None, None, 1722688962734520),
        ("1761657985.170", None, None, 1761657985170000),
        ("2026-03-11 08:46:42", "America/Sao_Paulo", None, at(2026, 3, 11, 11, 46, 42)),
        ("2025-03-09T02:30:00", "America/New_York", None, None),  # skipped
        ("2025-11-02T01:35:16", "America/New_York", None, None),  # repeated
        ("2025-11-02T01:35:16", None, None, None),  # no zone at all
        ("2024-12-31T24:00:00Z", None, None, at(2025, 1, 1)),
        *((x, "Europe/Berlin", "dmy", None) for x in ("", " ", "NaN", "T", "yesterday", "2025-02-30 11:20:00Z", "2025-04-10T25:10:00Z", "2024-06-11", "10:05:00Z", "-1", "0", "2025-W", "24-06", "1970-01-01T00:00:00Z", "9999-12-31T23:59:59Z", "0000-00-00 00:00:00")),
        (None, "Europe/Berlin", "dmy", None),
    ],
)
def test_value(text, zone, order, want):
    assert T.utc_micros(text, zone, order) == want


@settings(max_examples=300, deadline=None)
@given(st.datetimes(datetime(2016, 1, 1), datetime(2034, 12, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo"]))
def test_alignment_is_the_set_of_instants_that_show_the_time(wall, zone):
    wall = wall.replace(microsecond=0)
    utc = wall.replace(tzinfo=timezone.utc)
    brute = {utc - timedelta(minutes=15 * k) for k in range(-60, 61) if (utc - timedelta(minutes=15 * k)).astimezone(ZoneInfo(zone)).replace(tzinfo=None) == wall}
    assert set(T.aligned(wall, zone)) == {T.micros(b) for b in brute}


def tables(spark, export_rows, activity_rows, header_rows, account_rows):
    return (
        spark.createDataFrame(export_rows, "path string, content string, received_at timestamp_ntz"),
        spark.createDataFrame(activity_rows, "activity_id long, account_id long, time_text string, header string, received_at timestamp_ntz, tz_name string"),
        spark.createDataFrame(header_rows, "conv_id long, updated_at double, title string"),
        spark.createDataFrame(account_rows, "account_id long, tz_name string, date_order string, rec_key string"),
    )


def test_found_with_nulls_repeats_and_clashing_names(spark):
    content = '{"uuid": "u1", "created_at": "2025-01-01T00:00:00", "account": {"user_id": "5"}, "chat_messages": []}'
    frames = tables(
        spark,
        [("a", content, None), ("b", content, None), ("c", None, None), ("d", "{", None), ("e", '{"uuid": "u2", "created_at": 1700000000.5, "chat_messages": []}', None)],
        [(1, 5, "2025-01-01 00:00:00", None, None, "x"), (1, 5, "2025-01-01 00:00:00", "h", None, "x"), (2, None, "2025-01-01 00:00:00", None, None, "x"), (None, 5, "2025-01-01T00:00:00Z", None, None, "x")],
        [(7, 1.7e12, "t"), (7, 1.7e12, "t"), (8, None, "t"), (9, float("nan"), "t"), (None, 1.7e9, "t")],
        [(5, "Asia/Tokyo", "dmy", "clash")],
    )
    got = {tuple(r) for r in T.found(*frames).collect()}
    assert got == {("claude", "u1", at(2024, 12, 31, 15)), ("claude", "u2", 1700000000500000), ("gemini", "1", at(2024, 12, 31, 15)), ("snapshot", "7", 1700000000000000)}


def test_found_on_empty_tables(spark):
    assert T.found(*tables(spark, [], [], [], [])).count() == 0


ACCOUNTS = [(1, None, "dmy"), (2, "Asia/Tokyo", "dmy"), (3, "America/New_York", "mdy"), (4, "Europe/Berlin", "dmy"), (5, "Europe/Paris", "dmy"), (6, " ", None)]


def estimates(spark, rows, sequence=None):
    accounts = spark.createDataFrame(ACCOUNTS, "account_id long, tz_name string, date_order string")
    seen = spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(rows)], "account_id long, value string, received_us long, nth long, zone string")
    return {r.account_id: (r.histories, r.violations, r.values_seen) for r in T.estimate_histories(seen, accounts, sequence).collect()}


def test_receipt_tells_the_zone(spark):
    received = at(2025, 1, 1, 0, 30)  # 09:00 in Tokyo is half an hour earlier, elsewhere it is later
    assert estimates(spark, [(1, "2025-01-01 09:00:00", received), (1, "2025-01-01 09:10:00", received), (2, "2025-01-01 09:00:00", received)]) == {1: (["Asia/Tokyo"], 0, 2)}


def test_stated_offsets_and_skipped_times_tell_the_zone(spark):
    rows = [(1, "2024-07-24T20:07:00-04:00", None), (1, "2024-01-24T20:07:00 EST", None), (1, "2024-01-24T20:07:00Z", None), (6, "2025-03-30 02:30:00", None), (6, "2024-11-24 20:00:00", None)]
    assert estimates(spark, rows) == {1: (["America/New_York"], 0, 2), 6: (["America/New_York", "Asia/Tokyo"], 0, 2)}


def test_sequence_tells_the_zone(spark):
    rows = [(1, "2025-01-01T12:00:00Z", None), (1, "2025-01-01 12:30:00", None), (1, "2025-01-01 13:10:00+00:00", None), (1, "2025-01-01 08:10:00", None)]
    assert estimates(spark, rows, "nth")[1] == (["America/New_York"], 0, 2)


def test_nothing_known_keeps_every_history(spark):
    assert estimates(spark, [(1, "2025-01-01 12:30:00", None), (1, "no time", None), (1, "1700000000", None)]) == {1: (["America/New_York", "Asia/Tokyo", "Europe/Berlin", "Europe/Paris"], 0, 1)}
    assert estimates(spark, []) == {}


def test_values_are_converted_where_the_best_histories_agree(spark):
    rows = [(10, 1, "2024-07-24T20:07:00+02:00"), (11, 1, "2024-07-24 20:07:00"), (12, 1, "2024-10-27 02:30:00"), (13, 6, "2024-07-24 20:07:00"), (14, 4, "2024-07-24 20:07:00")]
    frames = tables(spark, [], [(a, c, v, None, None, "x") for a, c, v in rows], [], [(*r, "clash") for r in ACCOUNTS])
    assert {tuple(r) for r in T.estimated(*frames).collect()} == {("gemini", "11", at(2024, 7, 24, 18, 7))}
    assert {r.rec_key for r in T.found(*frames).collect()} == {"10", "14"}


def test_hidden_zones_come_back(spark, sf):
    """The zones of a third of the accounts are hidden: nearly all zoneless values of theirs that are converted get the instant of the true zone."""
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet".replace("sf0.001/", "sf0.1/"))  # the smallest tables have too few such values
    exports, activity, headers, accounts = (read(n) for n in ("raw_export", "gemini_activity", "conversation_header", "account_profile"))
    hide = (F.col("account_id") % 3 == 0) & F.col("tz_name").isNotNull()
    true = {r[:2]: r[2] for r in T.found(exports, activity, headers, accounts).collect()}
    got = {r[:2]: r[2] for r in T.estimated(exports, activity, headers, accounts.withColumn("tz_name", F.when(~hide, F.col("tz_name")))).collect()}
    both = [k for k in got if k in true]
    assert len(both) >= 5 and sum(got[k] == true[k] for k in both) >= 0.95 * len(both)
