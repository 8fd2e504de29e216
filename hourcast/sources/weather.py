"""Weather payloads: historical observations and forecasts (SRC-6, SRC-7,
FN-JS1..4, ST-4, JN-1, PRJ-5, PRJ-9, FN-MA7, FLT-2).

The HTTP clients of the reference are out of scope: payloads are landed as
``(datetime, payload)`` rows (JSON text) and parsed here with ``from_json``
against explicit schemas, fully inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.functions.calendar import (floor_hour, from_unix_seconds, hours_between,
                                         is_weekend_of, weekday_mon0)

_D = T.DoubleType()

CONDITION = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("main", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("icon", T.StringType()),
])

# Historical payload (F6). ``rain`` / ``snow`` stay raw JSON text: they may be
# an object {"1h": x}, a bare number, or absent.
HISTORY_SCHEMA = T.StructType([
    T.StructField("timezone", T.StringType()),
    T.StructField("timezone_offset", T.IntegerType()),
    T.StructField("data", T.ArrayType(T.StructType([
        *[T.StructField(n, _D) for n in ("temp", "feels_like", "pressure", "humidity", "dew_point",
                                         "uvi", "clouds", "visibility", "wind_speed", "wind_deg")],
        T.StructField("sunrise", T.LongType()),
        T.StructField("sunset", T.LongType()),
        T.StructField("rain", T.StringType()),
        T.StructField("snow", T.StringType()),
        T.StructField("weather", T.ArrayType(CONDITION)),
    ]))),
])

# Forecast payload (F8): 3-hourly entries.
FORECAST_SCHEMA = T.StructType([
    T.StructField("list", T.ArrayType(T.StructType([
        T.StructField("dt", T.LongType()),
        T.StructField("main", T.StructType([T.StructField(n, _D) for n in
                                            ("temp", "feels_like", "pressure", "humidity", "dew_point")])),
        T.StructField("clouds", T.StructType([T.StructField("all", _D)])),
        T.StructField("wind", T.StructType([T.StructField("speed", _D), T.StructField("deg", _D)])),
        T.StructField("weather", T.ArrayType(CONDITION)),
        T.StructField("rain", T.StructType([T.StructField("1h", _D)])),
        T.StructField("snow", T.StructType([T.StructField("1h", _D)])),
    ]))),
])

WEATHER_COLUMNS = ["temp", "feels_like", "pressure", "humidity", "dew_point", "uvi", "clouds",
                   "visibility", "wind_speed", "wind_deg", "weather_id", "weather_main",
                   "weather_description", "weather_icon", "sunrise", "sunset", "rain_1h",
                   "snow_1h", "timezone", "timezone_offset"]


def precipitation_1h(raw: Column) -> Column:
    """Polymorphic ``rain``/``snow``: object → its "1h", number → itself,
    absent or anything else → 0 (FN-JS3)."""
    return F.coalesce(F.get_json_object(raw, "$.1h").try_cast("double"),
                      raw.try_cast("double"),
                      F.lit(0.0))


def to_celsius(c: Column, unit: str) -> Column:
    """Bring temperatures to one unit (kelvin / celsius / fahrenheit input)."""
    unit = unit.lower()
    if unit == "kelvin":
        return c - F.lit(273.15)
    if unit == "fahrenheit":
        return (c - F.lit(32.0)) * F.lit(5.0 / 9.0)
    return c


def dedupe_payloads(payloads: DataFrame, ts_col: str = "datetime", order: str | None = None) -> DataFrame:
    """One payload per timestamp (ST-4): the one with the largest ``order`` (a time of receipt, a file number;
    nulls before all others), of equal ones and without an order the smallest text."""
    if order is None:
        return payloads.groupBy(ts_col).agg(F.min("payload").alias("payload"))
    # the newest first, then the smallest text of that order: two partial aggregates of fixed width
    newest = payloads.groupBy(ts_col, order).agg(F.min("payload").alias("payload"))
    rank = F.struct(F.col(order).isNotNull(), F.col(order))
    return newest.groupBy(ts_col).agg(F.max_by("payload", rank).alias("payload"))


def parse_weather(payloads: DataFrame, ts_col: str = "datetime", temp_unit: str | None = None) -> DataFrame:
    """``(datetime, payload)`` → one weather row per hour with data (SRC-6, FN-JS1..4).

    An empty ``data`` array yields no row; a missing ``weather`` list yields
    null condition fields; ``sunrise``/``sunset`` are UTC timestamps.
    """
    p = F.from_json(F.col("payload"), HISTORY_SCHEMA)
    parsed = payloads.select(F.col(ts_col).cast("timestamp_ntz").alias("datetime"), p.alias("_p"))
    first = F.try_element_at(F.col("_p.data"), F.lit(1))
    rows = parsed.select("datetime", "_p.timezone", "_p.timezone_offset", first.alias("_w")).where(
        F.col("_w").isNotNull())
    cond = F.try_element_at(F.col("_w.weather"), F.lit(1))
    temp = F.col("_w.temp")
    feels = F.col("_w.feels_like")
    if temp_unit:
        temp, feels = to_celsius(temp, temp_unit), to_celsius(feels, temp_unit)
    return rows.select(
        "datetime",
        temp.alias("temp"), feels.alias("feels_like"),
        *[F.col(f"_w.{n}").alias(n) for n in ("pressure", "humidity", "dew_point", "uvi", "clouds",
                                               "visibility", "wind_speed", "wind_deg")],
        cond["id"].alias("weather_id"),
        cond["main"].alias("weather_main"),
        cond["description"].alias("weather_description"),
        cond["icon"].alias("weather_icon"),
        from_unix_seconds(F.col("_w.sunrise")).alias("sunrise"),
        from_unix_seconds(F.col("_w.sunset")).alias("sunset"),
        precipitation_1h(F.col("_w.rain")).alias("rain_1h"),
        precipitation_1h(F.col("_w.snow")).alias("snow_1h"),
        "timezone", "timezone_offset",
    )


def add_weather(hourly: DataFrame, weather: DataFrame, on: str = "datetime") -> DataFrame:
    """LEFT join of the hourly series with weather (JN-1, PRJ-5).

    Weather has at most one row per hour, so the join never multiplies rows;
    AQE turns it into a broadcast join when the weather side is small.
    """
    w = weather.drop("timestamp") if "timestamp" in weather.columns else weather
    return hourly.join(w, on=on, how="left")


def parse_forecast(payloads: DataFrame, now: str | Column | None = None, hours_ahead: int | None = None,
                   temp_unit: str | None = None) -> DataFrame:
    """Forecast payloads → hourly rows with derived columns (SRC-7, FN-MA7, PRJ-9, FLT-2)."""
    e = F.col("_e")
    rows = payloads.select(F.explode(F.from_json(F.col("payload"), FORECAST_SCHEMA)["list"]).alias("_e"))
    cond = F.try_element_at(e["weather"], F.lit(1))
    ts = from_unix_seconds(e["dt"])
    temp = e["main"]["temp"]
    feels = e["main"]["feels_like"]
    if temp_unit:
        temp, feels = to_celsius(temp, temp_unit), to_celsius(feels, temp_unit)
    hum = e["main"]["humidity"]
    out = rows.select(
        ts.alias("datetime"),
        temp.alias("temp"), feels.alias("feels_like"),
        e["main"]["pressure"].alias("pressure"), hum.alias("humidity"),
        F.coalesce(e["main"]["dew_point"], temp - (F.lit(100.0) - hum) / F.lit(5.0)).alias("dew_point"),
        e["clouds"]["all"].alias("clouds"),
        e["wind"]["speed"].alias("wind_speed"), e["wind"]["deg"].alias("wind_deg"),
        cond["main"].alias("weather_main"),
        cond["description"].alias("weather_description"),
        cond["icon"].alias("weather_icon"),
        F.coalesce(e["rain"]["1h"], F.lit(0.0)).alias("rain_1h"),
        F.coalesce(e["snow"]["1h"], F.lit(0.0)).alias("snow_1h"),
    )
    dow = weekday_mon0("datetime")
    out = out.withColumns({
        "hour": F.hour("datetime"), "day": F.dayofmonth("datetime"), "day_of_week": dow,
        "month": F.month("datetime"), "is_weekend": is_weekend_of(dow),
        "uvi": F.lit(0.0), "visibility": F.lit(0.0), "weather_id": F.lit(0), "timezone_offset": F.lit(0),
    })
    if now is not None and hours_ahead is not None:
        n = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
        h = hours_between(F.col("datetime"), n)
        out = out.where((h >= 0) & (h <= hours_ahead))
    return out


# --------------------------------------- payloads derived from driver tables

def events_hourly_weather(events: DataFrame) -> DataFrame:
    """Hourly observation values derived from ``events`` (driver-table adapter).

    temp = avg(value), humidity = min(value), wind_speed = max(value),
    rain = sum(value of 'error' events) (absent when there is none),
    weather_main = most frequent event_type (lowest name on ties).
    Two-level aggregation: (hour, type) partials, then per hour.
    """
    by_type = (events.groupBy(floor_hour("ts").alias("datetime"), F.col("event_type"))
               .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"),
                    F.min("value").alias("mn"), F.max("value").alias("mx")))
    return by_type.groupBy("datetime").agg(
        (F.sum("s") / F.sum("n")).alias("temp"),
        F.min("mn").alias("humidity"),
        F.max("mx").alias("wind_speed"),
        F.sum(F.when(F.col("event_type") == "error", F.col("s"))).alias("rain"),
        F.sum("n").cast("long").alias("n_events"),
        F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("weather_main"),
    )


def compose_weather_payloads(hourly_weather: DataFrame) -> DataFrame:
    """JSON payloads in the historical layout from hourly values.

    Hours where hour % 7 = 0 get an empty ``data`` list (no observation), hours
    where hour % 11 = 0 lack the ``weather`` list; ``rain`` is an object on even
    days and a bare number on odd days.
    """
    hw = hourly_weather
    hour = F.hour("datetime")
    cond = F.array(F.struct(
        (F.lit(800) + F.col("n_events") % 10).cast("int").alias("id"),
        F.col("weather_main").alias("main"),
        F.concat(F.col("weather_main"), F.lit(" sky")).alias("description"),
        F.lit("01d").alias("icon")))
    base = F.struct(
        F.col("temp"),
        (F.col("temp") - F.lit(1.5)).alias("feels_like"),
        (F.lit(1000.0) + F.col("n_events").cast("double")).alias("pressure"),
        F.col("humidity"),
        (F.col("temp") - (F.lit(100.0) - F.col("humidity")) / F.lit(5.0)).alias("dew_point"),
        F.lit(0.0).alias("uvi"),
        (F.col("n_events") % 101).cast("double").alias("clouds"),
        F.lit(10000.0).alias("visibility"),
        F.col("wind_speed"),
        (F.col("n_events") * 7 % 360).cast("double").alias("wind_deg"),
        (F.unix_seconds(F.date_trunc("day", F.col("datetime")).cast("timestamp")) + 6 * 3600).alias("sunrise"),
        (F.unix_seconds(F.date_trunc("day", F.col("datetime")).cast("timestamp")) + 18 * 3600).alias("sunset"),
        F.when(hour % 11 != 0, cond).alias("weather"),
    )
    elem = F.to_json(base)
    rain = F.when(F.col("rain").isNull(), F.lit(None)).when(
        F.dayofmonth("datetime") % 2 == 0,
        F.concat(F.lit('{"1h":'), F.col("rain").cast("string"), F.lit("}"))
    ).otherwise(F.col("rain").cast("string"))
    elem = F.when(rain.isNull(), elem).otherwise(
        F.concat(F.expr("substring(to_json(_base), 1, length(to_json(_base)) - 1)"), F.lit(',"rain":'), rain,
                 F.lit("}")))
    body = F.when(hour % 7 == 0, F.lit("")).otherwise(elem)
    payload = F.concat(F.lit('{"timezone":"America/New_York","timezone_offset":-18000,"data":['), body,
                       F.lit("]}"))
    return hw.withColumn("_base", base).select("datetime", payload.alias("payload"))


def compose_forecast_payloads(hourly_weather: DataFrame) -> DataFrame:
    """Forecast layout: one payload per day listing its 3-hourly entries."""
    hw = hourly_weather.where(F.hour("datetime") % 3 == 0)
    entry = F.struct(
        F.unix_seconds(F.col("datetime").cast("timestamp")).alias("dt"),
        F.struct(F.col("temp"), (F.col("temp") - F.lit(1.5)).alias("feels_like"),
                 (F.lit(1000.0) + F.col("n_events").cast("double")).alias("pressure"),
                 F.col("humidity")).alias("main"),
        F.struct((F.col("n_events") % 101).cast("double").alias("all")).alias("clouds"),
        F.struct(F.col("wind_speed").alias("speed"),
                 (F.col("n_events") * 7 % 360).cast("double").alias("deg")).alias("wind"),
        F.array(F.struct(F.col("weather_main").alias("main"),
                         F.concat(F.col("weather_main"), F.lit(" sky")).alias("description"),
                         F.lit("01d").alias("icon"))).alias("weather"),
        F.when(F.col("rain").isNotNull(), F.struct(F.col("rain").alias("1h"))).alias("rain"),
    )
    return (hw.groupBy(F.to_date("datetime").alias("day"))
            .agg(F.array_sort(F.collect_list(entry)).alias("list"))
            .select("day", F.to_json(F.struct("list")).alias("payload")))
