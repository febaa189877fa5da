from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridsmith.functions.timestamps import is_canonical, with_instant

SCHEMA = "text string, zone string, ord string"


def micros(y, mo, d, h=0, mi=0, s=0, us=0):
    return int((datetime(y, mo, d, h, mi, s, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000 + us


def read(spark, cases):
    df = spark.createDataFrame([c[:3] for c in cases], SCHEMA)
    return [r["u"] for r in with_instant(df, "text", "u", "zone", "ord").collect()]


CASES = [
    ("2015-03-07T20:46:53.000Z", None, None, micros(2015, 3, 7, 20, 46, 53)),
    (" 2015-03-07t16:14:04.194030z", None, None, micros(2015, 3, 7, 16, 14, 4, 194030)),
    ("2016-02-15T14:21:00.327831314Z", None, None, micros(2016, 2, 15, 14, 21, 0, 327831)),
    ("2015-03-07T20:46:53,5Z", None, None, micros(2015, 3, 7, 20, 46, 53, 500000)),
    ("2015-069T14:09:29.493Z", None, None, micros(2015, 3, 10, 14, 9, 29, 493000)),
    ("2016-366T00:00:00Z", None, None, micros(2016, 12, 31)),
    ("2015-366T00:00:00Z", None, None, None),
    ("20150316T050021Z", None, None, micros(2015, 3, 16, 5, 0, 21)),
    ("04/08/2015 05:34:08 AM", "UTC", "dmy", micros(2015, 8, 4, 5, 34, 8)),
    ("04/08/2015 12:34:08 AM", "UTC", "mdy", micros(2015, 4, 8, 0, 34, 8)),
    ("04/08/2015 12:34:08 PM", "UTC", "mdy", micros(2015, 4, 8, 12, 34, 8)),
    ("13/08/2015 00:00:00", "UTC", "mdy", None),
    ("04/08/2015 00:00:00", "UTC", None, None),
    ("Sun, 29 Mar 2015 07:49:54 +1100", None, None, micros(2015, 3, 28, 20, 49, 54)),
    ("11-Mar-2015 08:27:03", "Asia/Kolkata", None, micros(2015, 3, 11, 2, 57, 3)),
    ("2015-03-13T10:54:04[Australia/Sydney]", None, None, micros(2015, 3, 12, 23, 54, 4)),
    ("2015-03-06 17:01:43 EAT", "Africa/Nairobi", None, micros(2015, 3, 6, 14, 1, 43)),
    ("2015-03-06 17:01:43 IST", "Asia/Kolkata", None, micros(2015, 3, 6, 11, 31, 43)),
    ("2015-03-06 17:01:43+03", None, None, micros(2015, 3, 6, 14, 1, 43)),
    ("2015-03-06 17:01:43.5-0330", None, None, micros(2015, 3, 6, 20, 31, 43, 500000)),
    ("2015-03-06T17:01:43-00:00", None, None, micros(2015, 3, 6, 17, 1, 43)),
    ("1425930301", None, None, 1425930301000000),
    ("1425265651352", None, None, 1425265651352000),
    ("1427479198050111", None, None, 1427479198050111),
    # a local time that occurs twice, and one that is skipped
    ("2015-04-05 02:30:00", "Australia/Sydney", None, micros(2015, 4, 4, 15, 30)),
    ("2015-10-04 02:30:00", "Australia/Sydney", None, micros(2015, 10, 3, 16, 30)),
    ("2015-11-01 01:30:00", "America/Denver", None, micros(2015, 11, 1, 7, 30)),
    ("2015-03-08 02:30:00", "America/Denver", None, micros(2015, 3, 8, 9, 30)),
    # no instants
    ("2015-03-06 17:01:43", None, None, None),
    ("2015-03-06 17:01:43", "Nowhere/Else", None, None),
    ("2018-07-14T25:10:00Z", None, None, None),
    ("2019-13-01T00:00:00Z", None, None, None),
    ("2015-02-29T00:00:00Z", None, None, None),
    ("2022-04-05T10:61:00Z", None, None, None),
    ("0000-00-00T00:00:00Z", None, None, None),
    ("n/a", "UTC", "dmy", None),
    ("", "UTC", "dmy", None),
    (None, "UTC", "dmy", None),
    ("9" * 5000, None, None, None),
]


def test_cases(spark):
    assert read(spark, CASES) == [c[3] for c in CASES]


def test_against_zoneinfo(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.tuples(st.datetimes(datetime(1990, 1, 1), datetime(2037, 1, 1)), st.sampled_from(["Australia/Sydney", "Europe/Berlin", "Asia/Kolkata", "Pacific/Auckland"])), min_size=20, max_size=40))
    def run(cases):
        want = []
        for t, z in cases:
            t = t.replace(microsecond=0)
            # fold 0 is the first occurrence; for a skipped time it takes the offset before the change
            off = t.replace(tzinfo=ZoneInfo(z), fold=0).utcoffset()
            want.append(int((t - off - datetime(1970, 1, 1)) / timedelta(microseconds=1)))
        got = read(spark, [(t.strftime("%Y-%m-%d %H:%M:%S"), z, None) for t, z in cases])
        assert got == want

    run()


def test_canonical(spark):
    df = spark.createDataFrame([("2015-03-07T20:46:53Z",), ("2015-03-07T20:46:53.123456Z",), ("2015-03-07T20:46:53.1234567Z",), ("2015-03-07 20:46:53Z",)], "t string")
    assert [r[0] for r in df.select(is_canonical(F.col("t"))).collect()] == [True, True, False, False]


def test_result_can_be_filtered_and_grouped(spark):
    df = with_instant(spark.createDataFrame([("2015-03-07T20:46:53Z", "x"), ("bad", "y")], "text string, p string"), "text", "u")
    assert df.filter("u IS NOT NULL").groupBy("u").count().count() == 1


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    assert with_instant(spark.createDataFrame([], SCHEMA), "text", "u", "zone", "ord").count() == n


def test_zones_of_an_image_without_a_zone_list(spark, monkeypatch):
    from gridsmith.functions import timestamps

    monkeypatch.setattr(timestamps.zoneinfo, "available_timezones", set)
    assert {"Europe/Berlin", "UTC", "Australia/Sydney"} <= set(timestamps._known_zones())
