"""Civil dates, ages and tolerant parsing. Every rule takes its instant as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZONE = "Asia/Shanghai"
DAY_MICROS = 86_400_000_000.0
# Forms in which dates are sent.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy HH:mm:ss Z")


def civil_date(at: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def day_start(day: Column, zone: str = ZONE) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def age_days(earlier: Column, now: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(now) - F.unix_micros(earlier)) / DAY_MICROS


def visible(at: Column, now: Column) -> Column:
    """Published by now, compared in whole seconds."""
    return at.isNotNull() & (F.date_trunc("SECOND", at) <= F.date_trunc("SECOND", now))


def parsed(text: Column) -> Column:
    """The first form that fits; null where none does."""
    trimmed = F.regexp_replace(F.trim(text), r"^\p{L}{3}, ", "")  # a weekday says nothing new
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in FORMATS])


def public_parts(day: Column) -> Column:
    """Month, day, year and weekday as they are shown."""
    return F.struct(F.upper(F.date_format(day, "MMM")).alias("month"), F.date_format(day, "dd").alias("day"), F.date_format(day, "yyyy").alias("year"), F.upper(F.date_format(day, "EEEE")).alias("weekday"))


def minute_key(at: Column, zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyyMMddHHmm")


def at_civil_minute(day: Column, minute: int, zone: str = ZONE) -> Column:
    """The instant of a minute of a civil day."""
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr(f"interval {minute} minutes"), zone)


def health_window(now: Column) -> Column:
    """Civil date, minutes since midnight, the date that must be out by now, whether it is the grace half hour, and since
    when a check must have run."""
    local = F.from_utc_timestamp(now, ZONE)
    minutes = F.hour(local) * 60 + F.minute(local)
    today = F.to_date(local)
    since = at_civil_minute(F.when(minutes < 420, F.date_sub(today, 1)).otherwise(today), 390)
    return F.struct(today.alias("day"), minutes.alias("minutes"), F.when(minutes < 360, F.date_sub(today, 1)).otherwise(today).alias("expected"), ((minutes >= 360) & (minutes < 390)).alias("grace"), since.alias("check_since"))


def sniffed_month(text: Column) -> Column:
    """The first day of the first month a text names with its year in English; null where it names none."""
    found = F.regexp_extract(text, r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})\b", 1)
    return F.to_date(F.try_to_timestamp(F.concat(F.regexp_replace(F.nullif(found, F.lit("")), r"\s+", " "), F.lit(" 1")), F.lit("MMMM yyyy d")))
