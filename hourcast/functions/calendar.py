"""Calendar columns, flags and the US federal holiday table (FN-DT*, FN-FL*, JN-2)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.functions.sqlexpr import q


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday_mon0(ts: Column | str) -> Column:
    """Day of week with Monday = 0 … Sunday = 6 (FN-DT4)."""
    return F.weekday(_c(ts))


def floor_hour(ts: Column | str) -> Column:
    """Truncate to the hour, staying TIMESTAMP_NTZ (FN-DT2)."""
    return F.date_trunc("hour", _c(ts)).cast("timestamp_ntz")


def add_hours(ts: Column | str, hours: Column | int) -> Column:
    """ts + hours (FN-DT5)."""
    h = F.lit(hours) if isinstance(hours, int) else hours
    return (_c(ts) + F.make_dt_interval(hours=h)).cast("timestamp_ntz")


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    """Fractional hours from ``earlier`` to ``later`` (FN-DT7)."""
    secs = F.unix_seconds(_c(later).cast("timestamp")) - F.unix_seconds(_c(earlier).cast("timestamp"))
    return secs / F.lit(3600.0)


def from_unix_seconds(c: Column | str) -> Column:
    """Unix seconds → TIMESTAMP_NTZ in UTC (FN-DT6)."""
    return F.timestamp_seconds(_c(c)).cast("timestamp_ntz")


def to_unix_seconds(c: Column | str) -> Column:
    return F.unix_seconds(_c(c).cast("timestamp"))


def flag(cond: Column) -> Column:
    """Boolean → 0/1 int; a null input gives 0, like a pandas comparison with NaT."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def is_weekend_of(dow: Column) -> Column:
    return flag(dow >= 5)


# Hours used by the weekday × hour flags.
DAY_HOUR_FLAG_HOURS = (8, 12, 17, 20)


def calendar_sql(ts: str, day_hour_flags: bool = True) -> dict[str, str]:
    """Ordered calendar features of a timestamp column as SQL text
    (FN-DT3, FN-FL1..8). Numeric parts stay null for a null timestamp; flags
    become 0."""
    t = q(ts)
    h, w, m, d = f"hour({t})", f"weekday({t})", f"month({t})", f"dayofmonth({t})"

    def fl(cond: str) -> str:
        return f"coalesce(CAST(({cond}) AS INT), 0)"

    cols = {
        "hour_of_day": h,
        "is_rush_hour_am": fl(f"{h} BETWEEN 7 AND 9"),
        "is_rush_hour_pm": fl(f"{h} BETWEEN 16 AND 19"),
        "is_business_hours": fl(f"{h} BETWEEN 9 AND 17"),
        "is_night": fl(f"{h} >= 22 OR {h} <= 5"),
        "day_of_week": w,
        "is_weekday": fl(f"{w} < 5"),
        "is_weekend": fl(f"{w} >= 5"),
        "is_monday": fl(f"{w} = 0"),
        "is_friday": fl(f"{w} = 4"),
        "month": m,
        "day": d,
        "is_summer": fl(f"{m} BETWEEN 6 AND 8"),
        "is_winter": fl(f"{m} = 12 OR {m} <= 2"),
        "is_spring": fl(f"{m} BETWEEN 3 AND 5"),
        "is_fall": fl(f"{m} BETWEEN 9 AND 11"),
        "is_start_of_month": fl(f"{d} <= 5"),
        "is_end_of_month": fl(f"{d} >= 25"),
    }
    if day_hour_flags:
        for dw in range(7):
            for hh in DAY_HOUR_FLAG_HOURS:
                cols[f"is_day{dw}_hour{hh}"] = fl(f"{w} = {dw} AND {h} = {hh}")
    return cols


def cyclical_sql(src: str, period: float) -> tuple[str, str]:
    a = f"({2 * math.pi!r} * {q(src)} / {float(period)!r})"
    return f"sin({a})", f"cos({a})"


def calendar_columns(ts: Column | str, day_hour_flags: bool = True) -> dict[str, Column]:
    """Column-API form of ``calendar_sql`` (FN-DT3, FN-FL1..8)."""
    if isinstance(ts, str):
        return {k: F.expr(v) for k, v in calendar_sql(ts, day_hour_flags).items()}
    t = _c(ts)
    hour = F.hour(t)
    dow = weekday_mon0(t)
    month = F.month(t)
    day = F.dayofmonth(t)
    cols: dict[str, Column] = {
        "hour_of_day": hour,
        "is_rush_hour_am": flag(hour.between(7, 9)),
        "is_rush_hour_pm": flag(hour.between(16, 19)),
        "is_business_hours": flag(hour.between(9, 17)),
        "is_night": flag((hour >= 22) | (hour <= 5)),
        "day_of_week": dow,
        "is_weekday": flag(dow < 5),
        "is_weekend": flag(dow >= 5),
        "is_monday": flag(dow == 0),
        "is_friday": flag(dow == 4),
        "month": month,
        "day": day,
        "is_summer": flag(month.between(6, 8)),
        "is_winter": flag((month == 12) | (month <= 2)),
        "is_spring": flag(month.between(3, 5)),
        "is_fall": flag(month.between(9, 11)),
        "is_start_of_month": flag(day <= 5),
        "is_end_of_month": flag(day >= 25),
    }
    if day_hour_flags:
        for d in range(7):
            for h in DAY_HOUR_FLAG_HOURS:
                cols[f"is_day{d}_hour{h}"] = flag((dow == d) & (hour == h))
    return cols


def cyclical(c: Column, period: float) -> tuple[Column, Column]:
    """sin / cos of 2π·c/period (FN-MA3..6)."""
    a = F.lit(2 * math.pi) * c / F.lit(float(period))
    return F.sin(a), F.cos(a)


# ------------------------------------------------------------------ holidays
#
# US federal holidays (default calendar, observed dates on):
#   New Year's Day            January 1
#   Martin Luther King Jr Day third Monday of January (from 1986)
#   Washington's Birthday     third Monday of February
#   Memorial Day              last Monday of May
#   Juneteenth                June 19 (from 2021)
#   Independence Day          July 4
#   Labor Day                 first Monday of September
#   Columbus Day              second Monday of October
#   Veterans Day              November 11
#   Thanksgiving              fourth Thursday of November
#   Christmas Day             December 25
# A fixed-date holiday on a Saturday is also observed on the Friday before,
# one on a Sunday on the Monday after.

def _nth_weekday_sql(month: int, dow: str, n: int) -> str:
    return f"date_add(next_day(date_sub(make_date(year, {month}, 1), 1), '{dow}'), {7 * (n - 1)})"


def holiday_rules() -> list[str]:
    """SQL of every holiday date of ``year``; null where the holiday does not exist that year."""
    rules = []
    for m, d, since in ((1, 1, None), (6, 19, 2021), (7, 4, None), (11, 11, None), (12, 25, None)):
        date = f"make_date(year, {m}, {d})"
        ok = "true" if since is None else f"year >= {since}"
        rules.append(f"CASE WHEN {ok} THEN {date} END")
        rules.append(f"CASE WHEN {ok} THEN CASE weekday({date}) WHEN 5 THEN date_sub({date}, 1) "
                     f"WHEN 6 THEN date_add({date}, 1) END END")
    return rules + [
        f"CASE WHEN year >= 1986 THEN {_nth_weekday_sql(1, 'Mon', 3)} END",
        _nth_weekday_sql(2, "Mon", 3),
        "next_day(date_sub(make_date(year, 5, 31), 7), 'Mon')",
        _nth_weekday_sql(9, "Mon", 1),
        _nth_weekday_sql(10, "Mon", 2),
        _nth_weekday_sql(11, "Thu", 4),
    ]


def holiday_table(years: DataFrame, year_col: str = "year") -> DataFrame:
    """Holiday dates for every year in ``years``, including the Dec 31 observed
    date of the following New Year. One row per distinct date: ``holiday_date``.

    Size is bounded by 13 × number of distinct years, so it is safe to broadcast.
    """
    wanted = years.selectExpr(f"CAST({q(year_col)} AS INT) AS year").where("year IS NOT NULL").distinct()
    yrs = wanted.union(wanted.selectExpr("year + 1 AS year")).distinct()
    dates = yrs.selectExpr(f"explode(array({', '.join(holiday_rules())})) AS holiday_date").where("holiday_date IS NOT NULL")
    # keep the dates that fall in a requested year (Dec 31 observed comes from y + 1)
    return (dates.join(F.broadcast(wanted), F.year("holiday_date") == F.col("year"), "left_semi")
            .distinct())


def with_is_holiday(df: DataFrame, ts_col: str = "datetime", out: str = "is_holiday",
                    date_col: str | None = None) -> DataFrame:
    """Add 0/1 ``is_holiday`` (JN-2, FN-FL9) by date arithmetic on the row's own date: the rules of its
    year, and the New Year of the year after, which may be observed on Dec 31. No list of years, no join."""
    d = f"CAST({q(ts_col)} AS DATE)"
    year = f"year({d})"
    dates = [r.replace("year", year) for r in holiday_rules()]
    dates.append(f"CASE weekday(make_date({year} + 1, 1, 1)) WHEN 5 THEN make_date({year}, 12, 31) END")
    hit = f"{d} IS NOT NULL AND ({' OR '.join(f'({d} <=> ({x}))' for x in dates)})"
    new = df.withColumn(out, flag(F.expr(hit)))
    return new.withColumn(date_col, F.expr(d)) if date_col else new
