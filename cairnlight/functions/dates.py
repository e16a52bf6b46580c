"""Dates in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = r"^\d{4}-\d{2}-\d{2}$"
MOMENT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_date(c: str | Column) -> Column:
    """A 10-character ISO day as it is, an ISO moment as its UTC day, anything else null (session time zone: UTC)."""
    c = _col(c)
    return F.when(c.rlike(DAY), c.try_cast("date")).when(c.rlike(MOMENT), F.to_date(c.try_cast("timestamp")))


def loose_date(c: str | Column) -> Column:
    """The first ten characters as a day, else null."""
    return F.substring(_col(c), 1, 10).try_cast("date")


def age_on(birth: str | Column, day: str | Column) -> Column:
    """Completed years."""
    b, d = _col(birth), _col(day)
    later = (F.month(d) * 100 + F.dayofmonth(d)) < (F.month(b) * 100 + F.dayofmonth(b))
    return F.year(d) - F.year(b) - later.cast("int")


def year_age(birth: str | Column, day: str | Column) -> Column:
    """Difference of the calendar years alone."""
    return F.year(_col(day)) - F.year(_col(birth))


def shifted_birthday(birth: str | Column, years: str | Column, cap: str | Column) -> Column:
    """The day years after birth (29 February becomes the 28th), not after cap."""
    b, y = _col(birth), _col(years)
    target = F.year(b) + y
    day = F.when((F.month(b) == 2) & (F.dayofmonth(b) == 29), F.lit(28)).otherwise(F.dayofmonth(b))
    return F.least(F.make_date(target, F.month(b), day), _col(cap))


def relative_time(day: str | Column, reference: str | Column) -> Column:
    """'n days/months/years ago': under 31 days in days, under 365 in months of 30 days, else in years of 365."""
    n = F.datediff(_col(reference), _col(day))
    count = F.when(n < 31, n).when(n < 365, F.floor(n / 30)).otherwise(F.floor(n / 365)).cast("int")
    unit = F.when(n < 31, "day").when(n < 365, "month").otherwise("year")
    return F.concat(count.cast("string"), F.lit(" "), unit, F.when(count == 1, "").otherwise("s"), F.lit(" ago"))
