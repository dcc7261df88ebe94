"""Calendar columns: local dates, weekdays, Easter, public holidays, time bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The Friday before the football grand final, by proclamation.
GRAND_FINAL_FRIDAY = {2015: "2015-10-02", 2016: "2016-09-30", 2017: "2017-09-29", 2018: "2018-09-28", 2019: "2019-09-27", 2020: "2020-10-23", 2021: "2021-09-24", 2022: "2022-09-23", 2023: "2023-09-29", 2024: "2024-09-27", 2025: "2025-09-26", 2026: "2026-09-25"}


def local_date(epoch_ms: Column, zone: str = "Australia/Melbourne") -> Column:
    """Civil date in the zone of an instant in milliseconds, daylight saving included. The session runs in UTC."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(epoch_ms), zone))


def text_instant(text: Column, zone: str = "Australia/Melbourne", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """UTC timestamp of a local text; null where it can't be read."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), zone)


def weekday(day: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(day) + 1


def is_weekend(day: Column) -> Column:
    return weekday(day) >= 6


def time_band(hour: Column) -> Column:
    return F.when(hour.between(7, 8), "AM peak").when(hour.between(9, 15), "Inter-peak").when(hour.between(16, 18), "PM peak").otherwise("Night")


def month_label(day: Column) -> Column:
    """As in january_2024."""
    return F.lower(F.date_format(day, "MMMM_yyyy"))


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter, by Gauss's rule with the two April exceptions."""
    golden = year % 19
    century = F.floor(year / 100)
    leap_skips = century - F.floor(century / 4)
    moon_shift = F.floor((13 + 8 * century) / 25)
    paschal = (19 * golden + 15 - moon_shift + leap_skips) % 30
    late = (paschal == 29) | ((paschal == 28) & (golden > 10))
    full_moon = paschal - late.cast("int")  # days after 21 March
    # the Sunday strictly after that moon; 21 March's weekday follows from the date itself
    moon = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), full_moon.cast("int"))
    return F.next_day(moon, "SUNDAY")


def nth_weekday(year: Column, month: int, day: str, n: int) -> Column:
    """The n-th such day of a month; day as next_day() takes it."""
    before = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(before, day), 7 * (n - 1))


def public_holidays(spark: SparkSession, first: int = 2023, last: int = 2027) -> DataFrame:
    """day, holiday of Victoria's public holidays with observed days; names on one day joined by ' / '."""
    y = F.col("year")

    def fixed(month: int, day: int) -> Column:
        return F.make_date(y, F.lit(month), F.lit(day))

    sunday = easter_sunday(y)
    proclaimed = F.create_map(*[F.lit(x) for k, v in GRAND_FINAL_FRIDAY.items() for x in (k, v)])
    christmas = F.weekday(fixed(12, 25))
    monday_after = lambda d: F.when(is_weekend(d), F.next_day(d, "MONDAY"))
    days = [
        (fixed(1, 1), "New Year's Day"),
        (monday_after(fixed(1, 1)), "New Year's Day (observed)"),
        (fixed(1, 26), "Australia Day"),
        (monday_after(fixed(1, 26)), "Australia Day (observed)"),
        (nth_weekday(y, 3, "MONDAY", 2), "Labour Day"),
        (F.date_sub(sunday, 2), "Good Friday"),
        (F.date_sub(sunday, 1), "Easter Saturday"),
        (sunday, "Easter Sunday"),
        (F.date_add(sunday, 1), "Easter Monday"),
        (fixed(4, 25), "ANZAC Day"),
        (nth_weekday(y, 6, "MONDAY", 2), "King's/Queen's Birthday"),
        (nth_weekday(y, 11, "TUESDAY", 1), "Melbourne Cup"),
        (F.to_date(F.try_element_at(proclaimed, y)), "Friday before AFL Grand Final"),
        (fixed(12, 25), "Christmas Day"),
        (fixed(12, 26), "Boxing Day"),
        (F.when(christmas.isin(5, 6), fixed(12, 27)), "Christmas Day (observed)"),
        (F.when(christmas.isin(4, 5), fixed(12, 28)), "Boxing Day (observed)"),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("seq"), d.alias("day"), F.lit(name).alias("name")) for k, (d, name) in enumerate(days)])
    flat = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year")).select(F.inline(rows)).where("day is not null")
    named = flat.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("n"))
    return named.select("day", F.array_join(F.transform("n", lambda x: x["name"]), " / ").alias("holiday"))


def day_type(day: Column, holiday: Column) -> Column:
    """Holiday before Saturday before Sunday before Weekday."""
    return F.when(holiday.isNotNull(), "Public holiday").when(weekday(day) == 6, "Saturday").when(weekday(day) == 7, "Sunday").otherwise("Weekday")


def hours_between(start: Column, end: Column) -> Column:
    """Hours of the day from start up to end, past midnight where end is not later; equal or 0 to 24 is the whole day; null where either is."""
    all_hours = F.sequence(F.lit(0), F.lit(23))
    span = F.when(end > start, F.filter(all_hours, lambda h: (h >= start) & (h < end))).otherwise(F.filter(all_hours, lambda h: (h >= start) | (h < end)))
    return F.when(start.isNotNull() & end.isNotNull(), span)
