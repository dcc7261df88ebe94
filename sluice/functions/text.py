"""Text rules: first-match classes, captures, street keys, hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The notice text's patterns and the road-type words.
CLOSURE_PATTERNS = [
    (r"impact to traffic will be (road|carriageway) closed|road (is |will be )?closed|full (road )?closure|closed to (all )?traffic", "road closed"),
    (r"impact to traffic will be [^.]*ramp", "ramp closed"),
    (r"impact to traffic will be [^.]*lane", "lanes closed"),
]
WINDOW_PATTERNS = [
    (r"(Weekdays|Weekends) 12:00 AM to 12:00 AM", "24 hours"),
    (r"(Weekdays|Weekends) ([7-9]|1[01]):[0-9]{2} PM to ([1-9]|1[0-2]):[0-9]{2} AM|(Weekdays|Weekends) 12:[0-9]{2} AM to [1-6]:[0-9]{2} AM", "night"),
    (r"(Weekdays|Weekends) ([5-9]|1[01]):[0-9]{2} AM to ([1-9]|1[0-2]):[0-9]{2} (AM|PM)", "day"),
]
IMPACT_TEXT = r"Impact to traffic will be ([^.]*)"
WORK_TIMES_TEXT = r"during the following times: ([^.]*?)\. Impact"
ROAD_TYPES = "STREET|ST|ROAD|RD|AVENUE|AVE|AV|HIGHWAY|HWY|PARADE|PDE|DRIVE|DR|BOULEVARD|BVD|BLVD|LANE|LA|PLACE|PL|CRESCENT|CRES|WAY|FREEWAY|FWY|TERRACE|TCE|GROVE|GR|COURT|CT"
NAME_WORDS = "STREET|ST|ROAD|RD|AVENUE|AVE|PARADE|PDE|HIGHWAY|HWY|DRIVE|DR|LANE|LN|PLACE|PL|BOULEVARD|BVD|BLVD"
CONNECTIVES = r"(?i)\b(?:between|and|to|from|at|near)\b|[,&/]"
HOUR = r"(?i)^(\d{1,2})(?::?(\d{2}))?\s*(am|pm)?$"
TIMES = r"(?i)(\b\d{1,2}(?::?\d{2})?\s*(?:am|pm)\b|\b\d{1,2}:\d{2}\b|\b[0-2]\d[0-5]\d\b)"
DAYS = r"(?i)(\b(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\b(?:\s*(?:to|-|–)\s*\b(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*)?)"


def first_match(text: Column, patterns: list[tuple[str, str]], otherwise: str = "unspecified") -> Column:
    """The class of the first pattern found in the text (null counts as empty)."""
    out = None
    for pattern, name in patterns:
        found = F.coalesce(text, F.lit("")).rlike(pattern)
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise(otherwise)


def closure_type(description: Column) -> Column:
    return first_match(F.lower(description), CLOSURE_PATTERNS)


def work_window(description: Column) -> Column:
    return first_match(description, WINDOW_PATTERNS)


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """The captured group, null without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def street_key(name: Column) -> Column:
    """Upper-case street name without a suburb after a dash and without its road type and what follows."""
    plain = F.regexp_replace(F.upper(name), r"\s*-\s.*$", "")
    return F.trim(F.regexp_replace(plain, rf"\s+({ROAD_TYPES})\b.*$", ""))


def bare_name(name: Column) -> Column:
    """Upper-case letters of a name without road-type words."""
    return F.regexp_replace(F.regexp_replace(F.upper(name), rf"\b({NAME_WORDS})\b\.?", ""), "[^A-Z]", "")


def name_in(key: Column, name: Column) -> Column:
    """Whether a street key of three letters or more stands in a name."""
    return F.coalesce((F.length(key) >= 3) & (F.instr(F.upper(name), key) > 0), F.lit(False))


def cross_streets(extent: Column, main: Column) -> Column:
    """Bare names of the streets an extent mentions besides the main one, in text order."""
    return F.filter(F.transform(F.split(extent, CONNECTIVES), bare_name), lambda c: (c != "") & (c != main))


def hour_of(text: Column) -> Column:
    """Hour of the day of '7am', '10 pm', '07:00' or '2200'; null otherwise or over 24."""
    t = F.trim(text)
    h = F.regexp_extract(t, HOUR, 1).try_cast("int")
    half = F.lower(F.regexp_extract(t, HOUR, 3))
    hour = F.when((half == "pm") & (h < 12), h + 12).when((half == "am") & (h == 12), F.lit(0)).otherwise(h)
    return F.when(t.rlike(HOUR) & hour.between(0, 24), hour)


def work_hours(text: Column, start: Column, end: Column) -> Column:
    """struct(start_hour, end_hour): the given fields, else the first two times in the text; an end of 0 is 24."""
    s, e = hour_of(start), hour_of(end)
    times = F.regexp_extract_all(text, F.lit(TIMES), F.lit(1))
    both = s.isNotNull() & e.isNotNull()
    read = ~both & (F.size(times) >= 2)
    first = F.when(read, hour_of(F.get(times, F.lit(0)))).otherwise(s)
    second = F.when(read, hour_of(F.get(times, F.lit(1)))).otherwise(e)
    return F.struct(first.alias("start_hour"), F.when(second == 0, 24).otherwise(second).alias("end_hour"))


def work_days(days: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(days, F.lit("")), F.regexp_extract(text, DAYS, 1))


def hour_label(hour: Column) -> Column:
    return F.when(hour.isin(0, 24), "midnight").when(hour == 12, "noon").when(hour < 12, F.concat(hour.cast("string"), F.lit("am"))).otherwise(F.concat((hour - 12).cast("string"), F.lit("pm")))


def round_up_half(x: Column) -> Column:
    """floor(x + 0.5), as a long."""
    return F.floor(x + 0.5)


def thousands(x: Column) -> Column:
    return F.format_number(round_up_half(x), 0)


def about(x: Column) -> Column:
    """Rounded for a sentence: from 1000 to hundreds, from 100 to tens."""
    return thousands(F.when(x >= 1000, round_up_half(x / 100) * 100).when(x >= 100, round_up_half(x / 10) * 10).otherwise(x))


def percent(x: Column) -> Column:
    return F.concat(round_up_half(x * 100).cast("string"), F.lit("%"))
