"""Calendar functions, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of the months of a year of 365 days.
DAYS_365 = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def seconds_of_month(time: Column) -> Column:
    """Seconds of the month that `time` lies in, by the Gregorian calendar."""
    return F.day(F.last_day(time)).cast("double") * 86400.0


def seconds_of_month_365(time: Column) -> Column:
    """Seconds of the month in a calendar without leap years."""
    return F.element_at(F.array(*[F.lit(d * 86400.0) for d in DAYS_365]), F.month(time))


def format_box(box: tuple[float, float, float, float]) -> str:
    """West, east, south and north of a box as in `180W_180E_90S_60S`, for names of tables and files."""
    sides = [(box[0], "WE"), (box[1], "WE"), (box[2], "SN"), (box[3], "SN")]
    return "_".join(f"{abs(v):g}{names[v >= 0]}" for v, names in sides)


#: Model calendars of the CF conventions, and the kind of their years.
MODEL_CALENDARS = {"360_day": "360", "noleap": "365", "365_day": "365", "all_leap": "366", "366_day": "366", "julian": "julian"}
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _first_days(kind: str) -> list[int]:
    """The day of the year, from 0, on which each month begins."""
    days = [30] * 12 if kind == "360" else [n + (kind == "366" and k == 1) for k, n in enumerate(DAYS_365)]
    return [sum(days[:k]) for k in range(12)]


def _day_number(year: int, month: int, day: int, kind: str) -> int:
    """Days since year 0 began."""
    if kind == "julian":
        leap = year % 4 == 0
        return year * 365 + (year + 3) // 4 + _first_days("366" if leap else "365")[month - 1] + day - 1
    return year * int(kind) + _first_days(kind)[month - 1] + day - 1


def model_time(value: Column, units: str, calendar: str) -> Column:
    """A struct (year, month, day, second) of times `<units> since <date>` in a model's calendar.

    It holds dates that no timestamp does, such as 30 February in years of
    360 days; it sorts by time, and its fields group months and years. Null
    and NaN stay null; `second` is the second of the day, rounded.
    """
    kind = MODEL_CALENDARS.get(calendar.lower())
    if kind is None:
        raise ValueError(f"no model calendar {calendar!r}; known: {', '.join(MODEL_CALENDARS)}")
    unit, _, since = units.partition(" since ")
    date, _, clock = since.strip().replace("T", " ").removesuffix("Z").strip().partition(" ")
    year, month, day = (int(x) for x in date.split("-"))
    hms = [float(x) for x in clock.strip().split(":")] if clock.strip() else []
    start = _day_number(year, month, day, kind) * 86400 + round(sum(x * s for x, s in zip(hms, (3600, 60, 1), strict=False)))
    step = _SECONDS[unit.strip().lower().rstrip("s")]
    total = F.lit(start).cast("long") + F.round(F.nanvl(value.cast("double"), F.lit(None).cast("double")) * step).cast("long")
    days, second = F.floor(total / 86400).cast("long"), F.pmod(total, F.lit(86400)).cast("int")
    if kind == "julian":  # cycles of 1461 days, the first year being the long one
        cycle, rest = F.floor(days / 1461).cast("long"), F.pmod(days, F.lit(1461))
        later = F.floor((rest - 366) / 365)
        of_cycle = F.when(rest < 366, F.lit(0)).otherwise(later + 1)
        of_year = F.when(rest < 366, rest).otherwise(rest - 366 - later * 365)
        long = rest < 366
        years = cycle * 4 + of_cycle
        in_month = lambda k: F.when(long, F.lit(_first_days("366")[k])).otherwise(F.lit(_first_days("365")[k]))
    else:
        years, of_year = F.floor(days / int(kind)), F.pmod(days, F.lit(int(kind)))
        in_month = lambda k: F.lit(_first_days(kind)[k])
    months, first = F.lit(1), in_month(0)
    for k in range(1, 12):
        months, first = F.when(of_year >= in_month(k), k + 1).otherwise(months), F.when(of_year >= in_month(k), in_month(k)).otherwise(first)
    made = F.struct(years.cast("int").alias("year"), months.cast("int").alias("month"), (of_year - first + 1).cast("int").alias("day"), second.alias("second"))
    return F.when(total.isNotNull(), made)
