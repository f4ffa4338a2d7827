from datetime import datetime, timedelta

import pytest

from foliospark.functions.timestamps import parse_instant
from foliospark.operators.instants import distinct_values, extend_dictionary, normalise_instants
from foliospark.plans.stored import MOST_DELTAS, StoredTable


def at(text):
    return (datetime.fromisoformat(text) - datetime(1970, 1, 1)) // timedelta(microseconds=1)


@pytest.mark.parametrize(
    "raw, zone, order, wanted",
    [
        ("2020-08-19T20:05:32+02:00", None, None, "2020-08-19 18:05:32"), ("2024-01-18T03:58:47", "Europe/Paris", None, "2024-01-18 02:58:47"), ("Wed, 08 Apr 2020 08:32:23 -0500", None, None, "2020-04-08 13:32:23"),
        ("1743415779825", None, None, "2025-03-31 10:09:39.825"), ("1684253172", None, None, "2023-05-16 16:06:12"), ("2021-06-29", "America/New_York", None, "2021-06-29 04:00:00"), ("05/24/2024 06:46", "America/New_York", "MDY", "2024-05-24 10:46:00"),
        ("03/07/2024 14:54", "Europe/Paris", "DMY", "2024-07-03 12:54:00"), ("April 11, 2022 6:15 a.m.", "UTC", None, "2022-04-11 06:15:00"), ("12:30 PM", "UTC", None, None), ("August 22, 2021 12:05 p.m.", "UTC", None, "2021-08-22 12:05:00"),
        ("Tuesday, 13-May-25 06:36:59 GMT", None, None, "2025-05-13 06:36:59"), ("Sat Oct  5 08:48:54 2019", "UTC", None, "2019-10-05 08:48:54"), ("2022-07-16T02:17:09.553360885Z", None, None, "2022-07-16 02:17:09.553360"), ("2021-08-01T18:04:09,452+02:00", None, None, "2021-08-01 16:04:09.452"),
        ("2019-11-26T22:47:35-05:00[America/New_York]", "Asia/Tokyo", None, "2019-11-27 03:47:35"), ("2021-07-07 12:08:10 CEST", None, None, "2021-07-07 10:08:10"), ("20191106T192741Z", None, None, "2019-11-06 19:27:41"), ("24. Dezember 2019, 19:52 Uhr", "Europe/Berlin", None, "2019-12-24 18:52:00"),
        ("3 марта 2020 г., 07:08", "UTC", None, "2020-03-03 07:08:00"), ("12 décembre 2021 à 9h05", "UTC", None, "2021-12-12 09:05:00"), ("23 de agosto de 2023, 08:46", "UTC", None, "2023-08-23 08:46:00"), ("  2022-01-31t03:01:53+01:00 ", None, None, "2022-01-31 02:01:53"),
        ("2024-03-31T02:30:00", "Europe/Paris", None, None), ("2024-10-27T02:30:00", "Europe/Paris", None, None), ("2023-13-45T10:00:00Z", None, None, None), ("31/02/2023 10:15", "UTC", "DMY", None), ("05/24/2024 06:46", "UTC", "DMY", None), ("2024-01-01T00:00:00", None, None, None),
        ("3 hours ago", "UTC", None, None), ("", "UTC", None, None), (None, "UTC", None, None), ("now", "UTC", None, None), ("Thu, 12 Foo 2021 10:00:00 GMT", None, None, None), ("9" * 400, None, None, None), ("2024-01-01 10:00:00 XYZ", "UTC", None, None),
    ],
)
def test_parse(raw, zone, order, wanted):
    assert parse_instant(raw, zone, order) == (None if wanted is None else at(wanted))


SCHEMA = "field_name string, row_id long, raw string, zone string, date_order string"


def test_hot_values_and_repeated_rows_keep_all_rows(spark, tmp_path):
    rows = [("f", k, "2024-01-01T00:00:00Z", None, None) for k in range(500)] + [("f", 500 + k, f"2024-01-01T00:00:{k:02d}Z", None, None) for k in range(60)] + [("f", 900, "n/a", None, None), ("f", 901, None, None, None)] * 2
    found = normalise_instants(spark.createDataFrame(rows, SCHEMA), StoredTable(spark, f"file://{tmp_path}/d")).collect()
    assert len(found) == 560 and {r["row_id"] for r in found} == set(range(560))


def test_dictionary_grows(spark, tmp_path):
    one = [("f", 1, "2024-01-01T00:00:00Z", None, None)]
    first, second = spark.createDataFrame(one, SCHEMA), spark.createDataFrame(one * 3 + [("f", 2, "2024-01-02T00:00:00Z", None, None)], SCHEMA)
    stored = StoredTable(spark, f"file://{tmp_path}/dictionary")
    assert extend_dictionary(stored, distinct_values(first)).count() == 1
    assert extend_dictionary(stored, distinct_values(second)).count() == 2 and stored.deltas() == 2
    assert stored.append(stored.read().limit(1)).count() == 1  # as a second writer would
    assert sorted((r["row_id"], r["utc_us"]) for r in normalise_instants(second, stored).collect()) == [(1, at("2024-01-01"))] * 3 + [(2, at("2024-01-02"))]
    for k in range(MOST_DELTAS):
        extend_dictionary(stored, distinct_values(spark.createDataFrame([("f", 1, f"2024-02-{k + 1:02d}", "UTC", None)], SCHEMA)))
    assert stored.deltas() < MOST_DELTAS and stored.read().count() == 2 + MOST_DELTAS


def test_an_unreadable_dictionary_is_no_missing_one(spark, tmp_path):
    stored = StoredTable(spark, f"file://{tmp_path}/dictionary")
    values = distinct_values(spark.createDataFrame([("f", 1, "2024-01-01T00:00:00Z", None, None)], SCHEMA))
    extend_dictionary(stored, values)
    part = next((tmp_path / "dictionary").glob("delta-*/part-*"))
    part.write_bytes(b"broken")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):
        extend_dictionary(stored, values)
    assert stored.deltas() == 1
