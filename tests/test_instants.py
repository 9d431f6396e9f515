from datetime import datetime, timezone

import pytest

from shutterlake.functions.instants import offset_minutes, parse_instant
from shutterlake.operators.instants import InstantDictionary, normalise_instants


def ms(*a, us=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1000 + us


CASES = [
    ("2021-08-09T12:00:51+02:00", None, None, ms(2021, 8, 9, 10, 0, 51)),
    ("2021:06:02 06:45:21", "-0700", "Europe/Berlin", ms(2021, 6, 2, 13, 45, 21)),
    ("２０２２：１２：１３ ０４：４４：５５", "345", None, ms(2022, 12, 12, 22, 59, 55)),
    ("2017:01:25 20:55:56.4", "local", "Europe/Berlin", ms(2017, 1, 25, 19, 55, 56, us=400)),
    ("Mon, 14 Nov 2016 13:18:39 -0800", None, None, ms(2016, 11, 14, 21, 18, 39)),
    ("9/2/2021 12:29:34 AM", "Z", None, ms(2021, 9, 2, 0, 29, 34)),
    ("3.10.2021 14:32", "UTC+1:00", None, ms(2021, 10, 3, 13, 32)),
    ("2024年2月3日 下午3:41:10", "+00:00", None, ms(2024, 2, 3, 15, 41, 10)),
    ("2024年2月3日 上午12:41:10", "+00:00", None, ms(2024, 2, 3, 0, 41, 10)),
    ("VID-20160731-090612810.mov", None, "America/Phoenix", ms(2016, 7, 31, 16, 6, 12, us=810)),
    ("2024-01-25 20.11.59 (2).png", "", "Asia/Kolkata", ms(2024, 1, 25, 14, 41, 59)),
    ("20200502073256.ORF", "??", "UTC", ms(2020, 5, 2, 7, 32, 56)),
    ("2019-05-28 04:01:54 PDT", "+01:00", "Europe/London", ms(2019, 5, 28, 11, 1, 54)),
    ("2025-02-20T00:10:47,500291872+09:00", None, None, ms(2025, 2, 19, 15, 10, 47, us=500)),
    ("2021-10-31T02:01:09+02:00[Europe/Berlin]", None, None, ms(2021, 10, 31, 0, 1, 9)),
    # a local time that occurs twice is the earlier instant, one that is skipped takes the offset before the change
    ("2021-10-31 02:30:00 Europe/Berlin", None, None, ms(2021, 10, 31, 0, 30)),
    ("2021-03-28 02:30:00", None, "Europe/Berlin", ms(2021, 3, 28, 1, 30)),
    ("1739971645", "+05:00", "Asia/Tokyo", 1739971645000),
    ("1485491943.7869", None, None, 1485491943786),
    ("1636262295219", None, None, 1636262295219),
    ("1456792342535754", None, None, 1456792342535),
    ("1570594177650738256", None, None, 1570594177650),
    ("131865081879940866", None, None, 1542034587994),
    ("  2022:12:25 15:22:36 ", "−05:00", None, ms(2022, 12, 25, 20, 22, 36)),
]
UNUSABLE = ["", "   ", "not set", "----", "    :  :     :  :  ", "IMG_9717.jpg", "2022-06-31T07:02:10Z", "2020:11:04 27:06:11", "0000:00:00 00:00:00", "2021-05-06", "12", "x" * 100_000, "9" * 5000]


@pytest.mark.parametrize("text,offset,zone,want", CASES)
def test_notation(text, offset, zone, want):
    assert parse_instant(text, offset, zone) == want


@pytest.mark.parametrize("text", UNUSABLE)
def test_unusable(text):
    assert parse_instant(text, "+01:00", "Europe/Berlin") is None


def test_local_time_needs_a_zone():
    assert parse_instant("2021-05-06 07:08:09", None, None) is None
    assert parse_instant("2021-05-06 07:08:09", "local", "Mars/Base") is None


def test_offsets():
    got = [offset_minutes(x) for x in ("60", "-420", "+0930", "+10:30", "UTC+5:45", "GMT-03:30", "−07:00", "Z", "local", ":", "", None, "0930", "+25:00", "1:75")]
    assert got == [60, -420, 570, 630, 345, -210, -420, 0, None, None, None, None, None, None, None]


READS = "read_id long, repository_id string, millis string, offset_min string, instant_ms string"
ZONES = "repository_id string, tz_name string, millis string"


def test_rows_keep_their_number_and_clashing_columns_do_no_harm(spark, rows):
    reads = rows([(1, "a", "2021-05-06 07:08:09", None, "x"), (1, "a", "2021-05-06 07:08:09", None, "x"), (2, "b", "2021-05-06 07:08:09", None, "y"), (3, None, None, None, None), (4, "a", "", "Z", None), (5, "zz", "1636262295219", None, None)], READS)
    zones = rows([("a", "Europe/Berlin", "clash"), ("a", "Europe/Berlin", "again"), ("b", None, "clash")], ZONES)
    out = normalise_instants(reads, zones, reading="millis", offset="offset_min")
    assert sorted((r.read_id, r.instant_ms) for r in out.collect() if r.instant_ms) == [(1, ms(2021, 5, 6, 5, 8, 9))] * 2 + [(5, 1636262295219)]
    assert out.count() == 6
    assert normalise_instants(reads.limit(0), zones, reading="millis", offset="offset_min").count() == 0


def test_dictionary_parses_only_what_it_lacks(spark, rows, tmp_path):
    path = f"file://{tmp_path}/book"
    key = "reading string, offset_text string, tz_name string"
    book = InstantDictionary(spark, path)
    assert book.read() is None
    book.resolve(rows([("1636262295219", None, None), ("bad", None, None)], key))
    files = {p.name for p in (tmp_path / "book").glob("*.parquet")}
    got = book.resolve(rows([("1636262295219", None, None), ("2021-05-06 07:08:09Z", None, "UTC")], key))
    assert got.count() == 3
    added = [p for p in (tmp_path / "book").glob("*.parquet") if p.name not in files]
    assert spark.read.parquet(*map(str, added)).count() == 1
