"""Date functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of dates and of timestamps, by precedence (fixed values).
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "MMM dd yyyy", "MMMM dd yyyy")
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.[SSSSSSSSS][SSSSSS][SSS]", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.[SSSSSSSSS][SSSSSS][SSS]", "yyyy-MM-dd'T'HH:mm:ss'Z'")
DAYS_PER_MONTH = 30.4375


def parse_date(c: Column) -> Column:
    """The first format that reads the text; null if none does."""
    text = F.trim(c.cast("string"))
    days = [F.try_to_date(text, f) for f in DATE_FORMATS]
    moments = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in TIMESTAMP_FORMATS]
    return F.coalesce(*days, *moments)


def month_start(c: Column) -> Column:
    return F.trunc(c, "month")


def months_between_starts(later: Column, earlier: Column) -> Column:
    """Calendar months from one date's month to another's."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def age_months(day: Column, model_year: Column) -> Column:
    """Months since January 1st of the model year, not below 0."""
    return F.greatest(F.datediff(day, F.make_date(model_year, F.lit(1), F.lit(1))) / DAYS_PER_MONTH, F.lit(0.0))


def ownership_years(later: Column, earlier: Column) -> Column:
    """Years between two days; 0.001 for the same day."""
    y = F.datediff(later, earlier) / 365.25
    return F.when(y == 0, 0.001).otherwise(y)


def next_eligible(status: Column, now: Column, refresh_days: int = 30, backoff_hours: int = 24) -> Column:
    """When a queue entry is due again: finished ones after the refresh time,
    failed ones after the backoff, any other at once."""
    done, failed = ("complete", "zero_comments", "comments_disabled"), ("quota_exhausted", "api_error")
    return F.when(status.isin(*done), now + F.make_dt_interval(F.lit(refresh_days))).when(status.isin(*failed), now + F.make_dt_interval(F.lit(0), F.lit(backoff_hours))).otherwise(now)


def us_text(c: Column) -> Column:
    """MM-DD-YYYY, for reports only; dates are kept as dates."""
    return F.date_format(c, "MM-dd-yyyy")


def epoch_days(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 86_400e6
