"""Mixed timestamp texts to UTC instants (JVM-side, no Python rows).

Every accepted form is an alternative of ONE regular expression with named groups. ``regexp_replace`` runs it once per
text and writes the groups, joined by a separator, into a single string; splitting that gives all components. The
components are checked against the calendar and assembled to microseconds since 1970 by integer day arithmetic.

Defined results: null, blank, unreadable or impossible texts, texts on a local clock without a known zone and slashed
dates without a known order give null. So do forms that are none of the alternatives: dates without a time, week dates,
month names before the day, zone names without brackets, second 60 and hour 24. Fraction digits beyond six are cut off. A local time that occurs twice is its
first occurrence; a skipped one takes the offset before the change.
"""

from __future__ import annotations

import re
import zoneinfo

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English month abbreviations and the usual offsets of zone abbreviations, in minutes east of UTC.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "EAT": 180, "SAST": 120, "IST": 330, "PKT": 300, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "HST": -600,
    "AKST": -540, "AKDT": -480, "PST": -480, "PDT": -420, "MST": -420, "MDT": -360, "CST": -360, "CDT": -300,
    "EST": -300, "EDT": -240, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150,
}
# Abbreviations that mean something else on certain producers' clocks.
ZONE_ABBREVIATIONS = {("Europe/Dublin", "IST"): 60, ("Asia/Jerusalem", "IST"): 120, ("Asia/Shanghai", "CST"): 480, ("Asia/Manila", "PST"): 480}

_SEP = "\u0001"
_MON = "|".join(MONTHS)
_DATES = [
    r"(?<ya>\d{4})-(?<ma>\d{2})-(?<da>\d{2})",  # calendar date
    r"(?<yb>\d{4})-(?<jb>\d{3})",  # ordinal date
    r"(?<yc>\d{4})(?<mc>\d{2})(?<dc>\d{2})(?=T)",  # basic form
    r"(?<pd>\d{1,2})/(?<qd>\d{1,2})/(?<yd>\d{4})",  # slashed, order by producer
    rf"(?<de>\d{{1,2}})-(?<me>{_MON})-(?<ye>\d{{4}})",  # day, month name, year
    rf"(?:[a-z]{{3}},? )?(?<df>\d{{1,2}}) (?<mf>{_MON}) (?<yf>\d{{4}})",  # mail headers
]
_TIME = r"(?<hh>\d{1,2}):?(?<mi>\d{2})(?::?(?<ss>\d{2})(?:[.,](?<ff>\d+))?)?(?: ?(?<ap>[ap]m))?"
_ZONE = r"(?: ?(?:(?<sg>[+-])(?<oh>\d{2})(?::?(?<om>\d{2}))?|\[(?<iz>[a-z][a-z_/+0-9-]*)\]|(?<ab>[a-z]{1,5})))?"
PATTERN = rf"(?i)^(?:(?<num>\d{{9,20}})|(?:{'|'.join(_DATES)})(?:t| +){_TIME}{_ZONE})$"
_FIELDS = ["num", "ya|yb|yc|yd|ye|yf", "ma|mc", "me|mf", "da|dc|de|df", "jb", "pd", "qd", "hh", "mi", "ss", "ff", "ap", "sg", "oh", "om", "iz", "ab"]
REPLACEMENT = _SEP.join("".join(f"${{{g}}}" for g in f.split("|")) for f in _FIELDS)
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z$"


def is_canonical(text: Column) -> Column:
    """Whether a text is already ``yyyy-mm-ddThh:mm:ss[.ffffff]Z``."""
    return text.rlike(CANONICAL)


def _known_zones() -> list[str]:
    """Names of zones: Python's list, or the JVM's where the image has none."""
    names = zoneinfo.available_timezones()
    if not names and SparkContext._active_spark_context is not None:
        names = set(SparkContext._active_spark_context._jvm.java.time.ZoneId.getAvailableZoneIds())
    return sorted(z for z in names if "/" in z or z in ("UTC", "GMT"))


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def instant_sql(clock: str = "CAST(NULL AS string)", order: str = "CAST(NULL AS string)") -> str:
    """SQL expression of the UTC microseconds of the components ``p``; ``clock`` and ``order`` are SQL expressions.

    Intermediate values are bound by lambdas: each is evaluated once, and the generated code stays small enough for the
    JVM's compiler (spelled out as CASE expressions it exceeds the size of methods that are compiled at all).
    """
    at = {f.split("|")[0]: i for i, f in enumerate(_FIELDS)}

    def part(name: str) -> str:
        return f"get(p, {at[name]})"

    def num(name: str) -> str:
        # The groups hold digits or nothing; try_cast would raise and catch an exception for each empty one.
        return f"CAST(nullif({part(name)}, '') AS int)"

    month = f"""CASE WHEN {part('pd')} <> '' THEN CASE {order} WHEN 'dmy' THEN {num('qd')} WHEN 'mdy' THEN {num('pd')} END
        WHEN {part('me')} <> '' THEN (locate(lower({part('me')}), '{' '.join(MONTHS)}') + 3) div 4 ELSE {num('ma')} END"""
    day = f"CASE WHEN {part('pd')} <> '' THEN CASE {order} WHEN 'dmy' THEN {num('pd')} WHEN 'mdy' THEN {num('qd')} END ELSE {num('da')} END"
    hour = f"""CASE WHEN {part('ap')} = '' THEN {num('hh')} WHEN {num('hh')} BETWEEN 1 AND 12
        THEN {num('hh')} % 12 + IF(lower({part('ap')}) = 'pm', 12, 0) END"""
    fields = f"""named_struct('y', {num('ya')}, 'm', {month}, 'd', {day}, 'j', {num('jb')}, 'h', {hour}, 'mi', {num('mi')}, 's', coalesce({num('ss')}, 0),
        'f', CAST(substring(rpad({part('ff')}, 6, '0'), 1, 6) AS bigint), 'oh', coalesce({num('oh')}, 0), 'om', coalesce({num('om')}, 0))"""
    leap = "(c.y % 4 = 0 AND (c.y % 100 <> 0 OR c.y % 400 = 0))"
    length = f"CASE WHEN c.m = 2 THEN IF({leap}, 29, 28) WHEN c.m IN (4, 6, 9, 11) THEN 30 ELSE 31 END"
    valid = f"""c.y >= 1 AND c.h BETWEEN 0 AND 23 AND c.mi BETWEEN 0 AND 59 AND c.s BETWEEN 0 AND 59 AND c.om < 60 AND c.oh <= 18
        AND IF(c.j IS NULL, c.m BETWEEN 1 AND 12 AND c.d BETWEEN 1 AND {length}, c.j BETWEEN 1 AND IF({leap}, 366, 365))"""
    # Days since 1970 of a civil date: years start in March, 400-year eras; an ordinal date counts from 1 January.
    year = "IF(c.j IS NULL AND c.m > 2, c.y, c.y - 1)"
    in_year = "IF(c.j IS NULL, (153 * (c.m + IF(c.m > 2, -3, 9)) + 2) div 5 + c.d - 1, 305 + c.j)"
    days = _let(year, "y", f"(365L * y + y div 4 - y div 100 + y div 400 + {in_year} - 719468L)")
    local = f"CASE WHEN {valid} THEN ((({days} * 24 + c.h) * 60 + c.mi) * 60 + c.s) * 1000000 + c.f END"
    # Lookup tables are single literals: long lists of literals would slow down every pass of the optimizer.
    names = ",".join(f"{a}={m}" for a, m in ABBREVIATIONS.items())
    special = ",".join(f"{z} {a}={m}" for (z, a), m in ZONE_ABBREVIATIONS.items())
    name = f"upper({part('ab')})"
    offset = f"""CASE WHEN {part('sg')} <> '' THEN (c.oh * 60 + c.om) * IF({part('sg')} = '-', -1, 1) WHEN {part('ab')} <> ''
        THEN CAST(coalesce(str_to_map('{special}', ',', '=')[concat({clock}, ' ', {name})], str_to_map('{names}', ',', '=')[{name}]) AS int) END"""
    zone = f"CASE WHEN {part('iz')} <> '' THEN {part('iz')} WHEN {part('ab')} = '' THEN {clock} END"
    known = " ".join(_known_zones())
    by_clock = _let(zone, "z", f"CASE WHEN locate(concat(' ', z, ' '), ' {known} ') > 0 THEN unix_micros(to_utc_timestamp(timestamp_micros(l), z)) END")
    utc = _let(fields, "c", _let(local, "l", _let(offset, "o", f"CASE WHEN o IS NOT NULL THEN l - o * 60000000L ELSE {by_clock} END")))
    number = f"CAST({part('num')} AS decimal(20,0))"
    unit = f"""CAST(CASE WHEN length({part('num')}) <= 11 THEN {number} * 1000000 WHEN length({part('num')}) <= 14 THEN {number} * 1000
        WHEN length({part('num')}) <= 17 THEN {number} ELSE floor({number} / 1000) END AS bigint)"""
    return f"CASE WHEN size(p) <> {len(_FIELDS)} THEN NULL WHEN {part('num')} <> '' THEN {unit} ELSE {utc} END"


def with_instant(df: DataFrame, text: str, out: str, zone: str | None = None, date_order: str | None = None) -> DataFrame:
    """Add ``out`` (bigint): UTC microseconds of the text column ``text``.

    ``zone`` and ``date_order`` name columns with the IANA zone of the writer's clock and ``dmy`` or ``mdy``.
    """
    null = "CAST(NULL AS string)"
    parts = F.split(F.regexp_replace(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), PATTERN, REPLACEMENT), _SEP)
    p = f"__{out}"
    sql = re.sub(r"\bp\b(?=[,)])", f"`{p}`", instant_sql(f"`{zone}`" if zone else null, f"`{date_order}`" if date_order else null))
    # The partition test is always true; being non-deterministic, it keeps the optimizer from copying the whole
    # expression (and its regular expression) into every filter and column that uses the result.
    return df.withColumn(p, parts).withColumn(out, F.expr(f"IF(spark_partition_id() >= 0, {sql}, NULL)")).drop(p)
