"""DuckDB reference SQL for the registered queries (correctness oracle).

Written independently of the Spark code: plain window functions over the
whole ordered series, SQL holiday rules, ``quantile_cont`` for medians and
quartiles. Output conventions match ``plans.queries.presented``: doubles
rounded to 6 digits (``+ 0.0`` folds −0.0), dates as midnight timestamps.
"""

from __future__ import annotations

from types import SimpleNamespace

L, H = 12, 2
FORECAST_DAYS, FORECAST_HOURS = 9, 168
# The event types of the driver's ``events`` table, which are
# the weather categories of the derived weather rows.
WEATHER_CATEGORIES = ["click", "error", "purchase", "signup", "view"]


# Fixed values, written here once more so that a wrong list in the engine shows: lags, rolling
# windows and differences of the feature sets.
SPECS = {
    "h2": SimpleNamespace(lags=(1, 2, 3, 6, 9, 12, 24), ma=(2, 3, 6, 12, 24), std=(2, 3, 6, 12, 24), diff=(1, 2, 3, 6, 12, 24), day_hour_flags=True),
    "h2_frame": SimpleNamespace(lags=(1, 2, 3, 6, 9, 12, 24), ma=(2, 3, 6, 12, 24), std=(2, 3, 6, 12, 24), diff=(1, 2, 3, 6, 12, 24), day_hour_flags=True),
    "h3": SimpleNamespace(lags=(1, 2, 3, 6, 9, 12, 24), ma=(3, 6, 12, 24), std=(3, 6, 12, 24), diff=(1, 3, 6, 12, 24), day_hour_flags=True),
    "h24": SimpleNamespace(lags=(1, 2, 3, 6, 12, 24, 48), ma=(3, 6, 12, 24, 48), std=(24, 48), diff=(1, 24, 48), day_hour_flags=True),
    "base": SimpleNamespace(lags=(1, 2, 3, 6, 12, 24), ma=(3, 6, 12, 24), std=(24,), diff=(1, 24), day_hour_flags=False),
}
# Name patterns of the feature categories (h2).
CATEGORIES = {
    "Weather": ["temp", "feels_like", "humidity", "rain_1h", "snow_1h", "wind_speed", "clouds"],
    "Time": ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos"],
    "Special Periods": ["is_weekend", "is_holiday", "is_rush_hour_am", "is_rush_hour_pm", "is_business_hours", "is_night"],
    "Historical": ["trip_count_lag_1", "trip_count_lag_2", "trip_count_lag_3", "trip_count_ma_2h", "trip_count_ma_3h", "trip_count_ma_6h",
                   "trip_count_std_2h", "trip_count_std_3h", "trip_count_std_6h", "trip_count_diff_1", "trip_count_diff_2", "trip_count_diff_3"],
}


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS \"{name}\""


def d(v) -> str:
    return f"CAST({v} AS DOUBLE)"


LAT = lambda k: f"({d(42.30)} + {d(f'{k} % 100')} / {d(1000.0)})"
LNG = lambda k: f"({d(-71.10)} - {d(f'{k} % 37')} / {d(1000.0)})"

TRIPS = f"""
trips AS (
  SELECT 'events' AS source_file, CAST(ts AS TIMESTAMP) AS st, CAST(ts AS TIMESTAMP) AS et,
         CAST(user_id AS VARCHAR) AS sid, {LAT('user_id')} AS lat, {LNG('user_id')} AS lng,
         event_type AS rideable_type
  FROM events
  UNION ALL
  SELECT 'orders', CAST(o_orderdate AS TIMESTAMP), CAST(o_orderdate AS TIMESTAMP), CAST(o_custkey AS VARCHAR),
         {LAT('o_custkey')}, {LNG('o_custkey')}, NULL
  FROM orders)"""

EV_TRIPS = f"""
ev_trips AS (
  SELECT 'events' AS source_file, CAST(ts AS TIMESTAMP) AS st, CAST(user_id AS VARCHAR) AS sid,
         {LAT('user_id')} AS lat, {LNG('user_id')} AS lng, event_type AS rideable_type
  FROM events)"""


def hourly_cte(src: str = "ev_trips", name: str = "hourly", series: bool = False) -> str:
    s = "rideable_type, " if series else ""
    part = "PARTITION BY rideable_type " if series else ""
    join = "USING (rideable_type)" if series else "ON TRUE"
    return f"""
{name}_cnt AS (
  SELECT {s}date_trunc('hour', st) AS datetime, count(*) AS trip_count FROM {src}
  WHERE st IS NOT NULL GROUP BY ALL),
{name}_st AS (
  SELECT {s}sid, count(*) AS n, arg_min(lat, (source_file, st, lat, lng)) AS lat,
         arg_min(lng, (source_file, st, lat, lng)) AS lng
  FROM {src} WHERE sid IS NOT NULL GROUP BY ALL),
{name}_top AS (
  SELECT {s}lat, lng FROM (
    SELECT *, row_number() OVER ({part}ORDER BY n DESC, sid) AS k FROM {name}_st) WHERE k = 1),
{name} AS (
  SELECT {s}c.datetime, c.trip_count, CAST(hour(c.datetime) AS INTEGER) AS hour,
         CAST(day(c.datetime) AS INTEGER) AS day, CAST(isodow(c.datetime) - 1 AS INTEGER) AS day_of_week,
         CAST(month(c.datetime) AS INTEGER) AS month, CAST(isodow(c.datetime) >= 6 AS INTEGER) AS is_weekend,
         t.lat AS latitude, t.lng AS longitude
  FROM {name}_cnt c LEFT JOIN {name}_top t {join})"""


HOURLY_COLS_D = ["latitude", "longitude"]
HOURLY_COLS = ["datetime", "trip_count", "hour", "day", "day_of_week", "month", "is_weekend"]


def sel(cols_plain, cols_double, src) -> str:
    parts = [f'"{c}"' for c in cols_plain] + [r(f'"{c}"', c) for c in cols_double]
    return f"SELECT {', '.join(parts)} FROM {src}"


WEATHER = f"""
bt AS (
  SELECT date_trunc('hour', ts) AS datetime, event_type, count(*) AS n, sum(value) AS s,
         min(value) AS mn, max(value) AS mx
  FROM events GROUP BY ALL),
mode_t AS (
  SELECT datetime, event_type AS wmain FROM (
    SELECT datetime, event_type, row_number() OVER (PARTITION BY datetime ORDER BY n DESC, event_type) AS k
    FROM bt) WHERE k = 1),
hw AS (
  SELECT b.datetime, sum(s) / sum(n) AS temp, min(mn) AS humidity, max(mx) AS wind_speed,
         sum(CASE WHEN event_type = 'error' THEN s END) AS rain, sum(n) AS n_events, any_value(m.wmain) AS wmain
  FROM bt b JOIN mode_t m USING (datetime) GROUP BY b.datetime),
weather AS (
  SELECT datetime, temp, temp - {d(1.5)} AS feels_like, {d(1000.0)} + {d('n_events')} AS pressure, humidity,
         temp - ({d(100.0)} - humidity) / {d(5.0)} AS dew_point, {d(0.0)} AS uvi,
         {d('n_events % 101')} AS clouds, {d(10000.0)} AS visibility, wind_speed,
         {d('(n_events * 7) % 360')} AS wind_deg,
         CASE WHEN hour(datetime) % 11 <> 0 THEN CAST(800 + n_events % 10 AS INTEGER) END AS weather_id,
         CASE WHEN hour(datetime) % 11 <> 0 THEN wmain END AS weather_main,
         CASE WHEN hour(datetime) % 11 <> 0 THEN wmain || ' sky' END AS weather_description,
         CASE WHEN hour(datetime) % 11 <> 0 THEN '01d' END AS weather_icon,
         date_trunc('day', datetime) + INTERVAL 6 HOUR AS sunrise,
         date_trunc('day', datetime) + INTERVAL 18 HOUR AS sunset,
         coalesce(rain, {d(0.0)}) AS rain_1h, {d(0.0)} AS snow_1h, 'America/New_York' AS timezone,
         CAST(-18000 AS INTEGER) AS timezone_offset
  FROM hw WHERE hour(datetime) % 7 <> 0)"""

WEATHER_D = ["weather_id", "timezone_offset", "temp", "feels_like", "pressure", "humidity", "dew_point", "uvi", "clouds", "visibility",
             "wind_speed", "wind_deg", "rain_1h", "snow_1h"]
WEATHER_P = ["weather_main", "weather_description", "weather_icon", "sunrise", "sunset",
             "timezone"]

ENRICHED = """
enriched AS (SELECT * FROM hourly LEFT JOIN weather USING (datetime))"""

ENRICHED_NUMERIC = ["trip_count", "hour", "day", "day_of_week", "month", "is_weekend", "latitude", "longitude",
                    "temp", "feels_like", "pressure", "humidity", "dew_point", "uvi", "clouds", "visibility",
                    "wind_speed", "wind_deg", "weather_id", "rain_1h", "snow_1h", "timezone_offset"]


def holidays_cte(years_sql: str) -> str:
    """US federal holidays with observed dates, from SQL date rules."""
    def nth(m, dow, n):
        f = f"make_date(y, {m}, 1)"
        return f"{f} + CAST(({dow} - isodow({f}) + 7) % 7 + 7 * {n - 1} AS INTEGER)"
    last_mon_may = "make_date(y, 5, 31) - CAST((isodow(make_date(y, 5, 31)) - 1 + 7) % 7 AS INTEGER)"
    return f"""
yrs AS (SELECT DISTINCT y FROM ({years_sql}) WHERE y IS NOT NULL),
fixed AS (SELECT y, make_date(y, m, dd) AS dt, since FROM yrs,
          (VALUES (1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)) AS t(m, dd, since)
          WHERE y >= since),
hol AS (
  SELECT dt AS hd FROM fixed
  UNION SELECT CASE isodow(dt) WHEN 6 THEN dt - 1 WHEN 7 THEN dt + 1 END FROM fixed
  UNION SELECT {nth(1, 1, 3)} FROM yrs WHERE y >= 1986
  UNION SELECT {nth(2, 1, 3)} FROM yrs
  UNION SELECT {last_mon_may} FROM yrs
  UNION SELECT {nth(9, 1, 1)} FROM yrs
  UNION SELECT {nth(10, 1, 2)} FROM yrs
  UNION SELECT {nth(11, 4, 4)} FROM yrs),
holidays AS (SELECT DISTINCT hd FROM hol WHERE hd IS NOT NULL)"""


def calendar_exprs(ts: str = "datetime", day_hour: bool = True) -> list[tuple[str, str]]:
    h, w, m, dd = f"hour({ts})", f"(isodow({ts}) - 1)", f"month({ts})", f"day({ts})"
    f = lambda e: f"CAST(coalesce({e}, false) AS INTEGER)"
    out = [
        ("hour_of_day", f"CAST({h} AS INTEGER)"),
        ("is_rush_hour_am", f(f"{h} BETWEEN 7 AND 9")), ("is_rush_hour_pm", f(f"{h} BETWEEN 16 AND 19")),
        ("is_business_hours", f(f"{h} BETWEEN 9 AND 17")), ("is_night", f(f"({h} >= 22 OR {h} <= 5)")),
        ("day_of_week", f"CAST({w} AS INTEGER)"),
        ("is_weekday", f(f"{w} < 5")), ("is_weekend", f(f"{w} >= 5")),
        ("is_monday", f(f"{w} = 0")), ("is_friday", f(f"{w} = 4")),
        ("month", f"CAST({m} AS INTEGER)"), ("day", f"CAST({dd} AS INTEGER)"),
        ("is_summer", f(f"{m} BETWEEN 6 AND 8")), ("is_winter", f(f"({m} = 12 OR {m} <= 2)")),
        ("is_spring", f(f"{m} BETWEEN 3 AND 5")), ("is_fall", f(f"{m} BETWEEN 9 AND 11")),
        ("is_start_of_month", f(f"{dd} <= 5")), ("is_end_of_month", f(f"{dd} >= 25")),
    ]
    if day_hour:
        for dw in range(7):
            for hh in (8, 12, 17, 20):
                out.append((f"is_day{dw}_hour{hh}", f(f"({w} = {dw} AND {h} = {hh})")))
    return out


def cyc(src: str, period: int) -> tuple[str, str]:
    a = f"(2 * pi() * {src} / {d(period)})"
    return f"sin({a})", f"cos({a})"


def lag_exprs(spec, order: str, partition: str = "") -> list[tuple[str, str]]:
    w = f"OVER ({partition}ORDER BY {order})"
    y = "CAST(trip_count AS DOUBLE)"
    out = [(f"trip_count_lag_{k}", f"lag({y}, {k}) {w}") for k in spec.lags]
    for n in spec.ma:
        fr = f"OVER ({partition}ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        out.append((f"trip_count_ma_{n}h", f"CASE WHEN count({y}) {fr} = {n} THEN avg({y}) {fr} END"))
    for n in spec.std:
        fr = f"OVER ({partition}ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        out.append((f"trip_count_std_{n}h", f"CASE WHEN count({y}) {fr} = {n} THEN stddev_samp({y}) {fr} END"))
    out += [(f"trip_count_diff_{k}", f"{y} - lag({y}, {k}) {w}") for k in spec.diff]
    return out


def features_ctes(spec_name: str) -> tuple[str, list[str]]:
    """CTEs ending in ``feat`` (all columns DOUBLE except datetime) and the
    feature column names (without trip_count)."""
    spec = SPECS[spec_name]
    pass1 = ", ".join(
        f"coalesce(CAST(\"{c}\" AS DOUBLE), (SELECT median(CAST(\"{c}\" AS DOUBLE)) FROM enriched), 0.0) AS \"{c}\""
        for c in ENRICHED_NUMERIC)
    lags = ", ".join(f"{e} AS \"{n}\"" for n, e in lag_exprs(spec, "datetime"))
    cal = calendar_exprs("datetime", spec.day_hour_flags)
    cal_sql = ", ".join(f"{e} AS \"{n}\"" for n, e in cal)
    cal_names = {n for n, _ in cal}
    base_cols = [c for c in ENRICHED_NUMERIC if c not in cal_names]
    hs, hc = cyc("hour_of_day", 24)
    ds, dc = cyc("day", 31)
    ms, mc = cyc("month", 12)
    ws, wc = cyc("day_of_week", 7)
    onehot = ", ".join(f"CAST(coalesce(wm = '{c}', false) AS INTEGER) AS \"weather_{c}\""
                       for c in WEATHER_CATEGORIES)
    lag_names = [n for n, _ in lag_exprs(spec, "datetime")]
    stage_cols = (base_cols + lag_names + ["is_holiday"] + [n for n, _ in cal] +
                  ["temp_weekend_interaction", "rain_rush_hour_interaction",
                   "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos",
                   "day_of_week_sin", "day_of_week_cos"] + [f"weather_{c}" for c in WEATHER_CATEGORIES])
    pass2 = ", ".join(
        f"coalesce(CAST(\"{c}\" AS DOUBLE), (SELECT median(CAST(\"{c}\" AS DOUBLE)) FROM stage)) AS \"{c}\""
        for c in stage_cols)
    ctes = f"""{EV_TRIPS},{hourly_cte()},{WEATHER},{ENRICHED},
{holidays_cte("SELECT year(datetime) AS y FROM enriched UNION ALL SELECT year(datetime) + 1 FROM enriched")},
wmode AS (
  SELECT weather_main AS m FROM (SELECT weather_main, count(*) AS n FROM enriched WHERE weather_main IS NOT NULL
  GROUP BY ALL) ORDER BY n DESC, weather_main LIMIT 1),
p1 AS (SELECT datetime, {pass1}, coalesce(weather_main, (SELECT m FROM wmode)) AS wm FROM enriched),
p2 AS (SELECT *, {lags} FROM p1),
p3 AS (
  SELECT p2.* EXCLUDE ({", ".join(sorted(cal_names & set(ENRICHED_NUMERIC)))}),
         CAST(hd IS NOT NULL AS INTEGER) AS is_holiday, {cal_sql}
  FROM p2 LEFT JOIN holidays ON CAST(p2.datetime AS DATE) = holidays.hd),
stage AS (
  SELECT *, temp * is_weekend AS temp_weekend_interaction, rain_1h * is_rush_hour_am AS rain_rush_hour_interaction,
         {hs} AS hour_sin, {hc} AS hour_cos, {ds} AS day_sin, {dc} AS day_cos, {ms} AS month_sin, {mc} AS month_cos,
         {ws} AS day_of_week_sin, {wc} AS day_of_week_cos, {onehot}
  FROM p3),
feat AS (SELECT datetime, {pass2} FROM stage)"""
    feats = [c for c in stage_cols if c != "trip_count"]
    return ctes, feats


def features_query(spec_name: str) -> str:
    ctes, feats = features_ctes(spec_name)
    cols = ["trip_count", *feats]
    return f"WITH {ctes}\nSELECT datetime, {', '.join(r(chr(34) + c + chr(34), c) for c in cols)} FROM feat"


def _metrics_select(a: str = "actual", p: str = "predicted") -> str:
    e = f"({p} - {a})"
    sse, sst = f"sum({e} * {e})", f"(var_pop({a}) * count({a}))"
    r2 = f"CASE WHEN {sst} = 0 THEN CASE WHEN {sse} = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 - {sse} / {sst} END"
    smape = f"avg(2.0 * abs({e}) / (abs({a}) + abs({p}) + 1e-10))"
    hub = f"avg(CASE WHEN abs({e}) <= 1.0 THEN 0.5 * {e} * {e} ELSE abs({e}) - 0.5 END)"
    return ", ".join([f"count({a}) AS n", r(f"avg(abs({e}))", "mae"), r(f"sqrt(avg({e} * {e}))", "rmse"),
                      r(r2, "r2"), r(smape, "smape"), r(hub, "huber")])


PERSIST = f"""{EV_TRIPS},{hourly_cte()},
pf AS (
  SELECT row_number() OVER (ORDER BY datetime) AS rn, datetime AS target_time, CAST(trip_count AS DOUBLE) AS actual,
         CAST(lag(trip_count, {H}) OVER (ORDER BY datetime) AS DOUBLE) AS predicted
  FROM hourly),
pred AS (SELECT * FROM pf WHERE predicted IS NOT NULL)"""


def _corr(x: str, y: str) -> str:
    den = f"(stddev_samp({x}) * stddev_samp({y}))"
    return f"CASE WHEN {den} = 0 THEN NULL ELSE covar_samp({x}, {y}) / {den} END"


def importance_ctes() -> str:
    ctes, feats = features_ctes("h2")
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, abs({_corr(chr(34) + c + chr(34), 'y2')}) AS importance FROM fy" for c in feats)
    return f"""{ctes},
fy AS (SELECT * FROM (SELECT *, lead(trip_count, {H}) OVER (ORDER BY datetime) AS y2 FROM feat) WHERE y2 IS NOT NULL),
imp AS ({rows}),
top AS (SELECT *, row_number() OVER (ORDER BY importance DESC NULLS LAST, feature) AS rank FROM imp
        ORDER BY importance DESC NULLS LAST, feature LIMIT 15)"""


def _ols_ctes(member: str, h: int = H, after: int = H + 1, part: str = "test") -> str:
    """Least squares of the count ``h`` rows ahead on the count, fitted per member on the first rows;
    a row needs ``after`` rows behind it."""
    return f"""{EV_TRIPS},
h AS (SELECT date_trunc('hour', st) AS datetime, CAST(count(*) AS DOUBLE) AS y FROM ev_trips WHERE st IS NOT NULL GROUP BY ALL),
s AS (SELECT datetime, datetime + INTERVAL {h} HOUR AS target_time, y AS x, lead(y, {h}) OVER (ORDER BY datetime) AS t,
             row_number() OVER (ORDER BY datetime) AS rn, count(*) OVER () AS n FROM h),
e AS (SELECT *, {member} AS member FROM s WHERE rn <= n - {after}),
o AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY datetime) AS i, count(*) OVER (PARTITION BY member) AS m FROM e),
l AS (SELECT *, CASE WHEN i <= (m - ceil(m * 0.2)) - ceil((m - ceil(m * 0.2)) * 0.25) THEN 'train'
                     WHEN i <= m - ceil(m * 0.2) THEN 'val' ELSE 'test' END AS split FROM o),
f AS (SELECT member, regr_slope(t, x) AS b, regr_intercept(t, x) AS a FROM l WHERE split = 'train' GROUP BY member),
pred AS (SELECT member, datetime, target_time, t AS actual, a + b * x AS predicted FROM l JOIN f USING (member) WHERE split = '{part}')"""


def _ols(member: str, h: int = H, after: int = H + 1, part: str = "test", actual: bool = True) -> str:
    told = r("actual", "actual") + ", " if actual else ""
    return f"WITH {_ols_ctes(member, h, after, part)}\nSELECT member, datetime, target_time, {told}{r('predicted', 'predicted')} FROM pred"


def _series_ctes(n_seq: str, steps: int, last: str) -> str:
    """Two features per series and hour, ``x1`` the count and ``x2`` its hour, scaled by the series' median and
    quartile range over the rows its training sequences read, and scaled targets ``t1…``. ``n_seq`` is the number
    of sequences that the scalers count, ``last`` the last row with a sequence."""
    leads = ", ".join(f"lead(y, {h}) OVER w AS y{h}" for h in range(1, steps + 1))
    targets = ", ".join(f"(y{h} - lo) / rng AS t{h}" for h in range(1, steps + 1))
    iqr = "CASE WHEN quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25) = 0 THEN 1.0 ELSE quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25) END"
    train = "({m} - ceil({m} * 0.2)) - ceil(({m} - ceil({m} * 0.2)) * 0.25)"
    return f"""{EV_TRIPS},
h AS (SELECT rideable_type, date_trunc('hour', st) AS datetime, CAST(count(*) AS DOUBLE) AS y FROM ev_trips WHERE st IS NOT NULL GROUP BY ALL),
s AS (SELECT *, CAST(hour(datetime) AS DOUBLE) AS c, row_number() OVER w AS rn, count(*) OVER (PARTITION BY rideable_type) AS n, {leads}
      FROM h WINDOW w AS (PARTITION BY rideable_type ORDER BY datetime)),
p AS (SELECT rideable_type, quantile_cont(y, 0.5) AS m1, quantile_cont(c, 0.5) AS m2, {iqr.format('y')} AS s1, {iqr.format('c')} AS s2,
             min(y) AS lo, CASE WHEN max(y) = min(y) THEN 1.0 ELSE max(y) - min(y) END AS rng
      FROM (SELECT *, greatest({n_seq}, 1) AS q FROM s) WHERE rn <= {train.format(m='q')} GROUP BY rideable_type),
e AS (SELECT rideable_type, datetime, rn, lo, rng, (y - m1) / s1 AS x1, (c - m2) / s2 AS x2, {targets} FROM s JOIN p USING (rideable_type) WHERE rn <= {last}),
o AS (SELECT *, row_number() OVER (PARTITION BY rideable_type ORDER BY datetime) AS i, count(*) OVER (PARTITION BY rideable_type) AS m FROM e),
l AS (SELECT *, CASE WHEN i <= {train.format(m='m')} THEN 'train' WHEN i <= m - ceil(m * 0.2) THEN 'val' ELSE 'test' END AS split FROM o)"""


def _two_slopes(t: str, reg: float) -> str:
    """Slopes and intercept of a ridge of ``t`` on x1 and x2 over the training rows."""
    a, b, c = f"(covar_pop(x1, x1) + {reg})", "covar_pop(x1, x2)", f"(covar_pop(x2, x2) + {reg})"
    g1, g2 = f"covar_pop(x1, {t})", f"covar_pop(x2, {t})"
    det = f"({a} * {c} - {b} * {b})"
    return f"({c} * {g1} - {b} * {g2}) / {det} AS b1, ({a} * {g2} - {b} * {g1}) / {det} AS b2, avg(x1) AS u1, avg(x2) AS u2, avg({t}) AS v"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    std_cols = """source_file, st AS standardized_start_time, et AS standardized_end_time,
      CAST(CAST(st AS DATE) AS TIMESTAMP) AS start_date, CAST(hour(st) AS INTEGER) AS start_hour,
      CAST(isodow(st) - 1 AS INTEGER) AS start_day_of_week, CAST(month(st) AS INTEGER) AS start_month,
      sid AS start_station_id"""
    q["trips_standardized"] = f"""WITH {TRIPS}
SELECT {std_cols}, {r('lat', 'start_lat')}, {r('lng', 'start_lng')}, rideable_type FROM trips"""

    q["daily_trips"] = f"""WITH {TRIPS}
SELECT CAST(dte AS TIMESTAMP) AS date, count(*) AS trip_count, CAST(isodow(dte) - 1 AS INTEGER) AS day_of_week,
       CAST(month(dte) AS INTEGER) AS month, CAST(isodow(dte) >= 6 AS INTEGER) AS is_weekend
FROM (SELECT CAST(st AS DATE) AS dte FROM trips WHERE st IS NOT NULL) GROUP BY dte"""

    q["daily_from_hourly"] = q["daily_trips"]
    q["distinct_hours"] = f"WITH {EV_TRIPS} SELECT DISTINCT date_trunc('hour', st) AS datetime FROM ev_trips WHERE st IS NOT NULL"

    q["hourly_trips"] = f"WITH {EV_TRIPS},{hourly_cte()}\n" + sel(HOURLY_COLS, HOURLY_COLS_D, "hourly")
    q["hourly_trips_union"] = f"WITH {TRIPS},{hourly_cte('trips')}\n" + sel(HOURLY_COLS, HOURLY_COLS_D, "hourly")
    q["hourly_from_csv"] = q["hourly_trips_union"]
    q["trips_quarantine"] = """
WITH e AS (SELECT *, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS stamp FROM events)
SELECT event_id || ',error,' || stamp AS line, 'malformed' AS reason FROM e WHERE event_type = 'error'
UNION ALL
SELECT event_id || ',purchase,at ' || event_id || ',' || stamp || ',' || user_id, 'start_time' FROM e WHERE event_type = 'purchase' AND value >= 50"""
    q["weather_dedup"] = f"WITH {WEATHER}\n" + sel(["datetime", *WEATHER_P], WEATHER_D, "weather")
    q["ingest_round_trip"] = f"WITH {EV_TRIPS},{hourly_cte()},{WEATHER},{ENRICHED}\n" + sel([*HOURLY_COLS, *WEATHER_P], WEATHER_D, "enriched")
    q["hourly_by_series"] = (f"WITH {EV_TRIPS},{hourly_cte(series=True)}\n" +
                             sel(["rideable_type", *HOURLY_COLS], HOURLY_COLS_D, "hourly"))

    q["hourly_filled"] = f"""WITH {EV_TRIPS},
hs AS (SELECT rideable_type, date_trunc('hour', st) AS datetime, count(*) AS trip_count FROM ev_trips GROUP BY ALL),
span AS (SELECT rideable_type, min(datetime) AS lo, max(datetime) AS hi FROM hs GROUP BY ALL),
grid AS (SELECT rideable_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS datetime FROM span)
SELECT g.rideable_type, g.datetime, coalesce(h.trip_count, 0) AS trip_count,
       CAST(hour(g.datetime) AS INTEGER) AS hour, CAST(day(g.datetime) AS INTEGER) AS day,
       CAST(isodow(g.datetime) - 1 AS INTEGER) AS day_of_week, CAST(month(g.datetime) AS INTEGER) AS month,
       CAST(isodow(g.datetime) >= 6 AS INTEGER) AS is_weekend
FROM grid g LEFT JOIN hs h USING (rideable_type, datetime)"""

    q["top_station"] = f"""WITH {TRIPS},
st AS (SELECT sid, count(*) AS n, arg_min(lat, (source_file, st, lat, lng)) AS lat,
              arg_min(lng, (source_file, st, lat, lng)) AS lng FROM trips WHERE sid IS NOT NULL GROUP BY sid)
SELECT sid AS start_station_id, n AS station_trips, {r('lat', 'latitude')}, {r('lng', 'longitude')}
FROM st ORDER BY n DESC, sid LIMIT 1"""

    q["weather_rows"] = f"WITH {WEATHER}\n" + sel(["datetime", *WEATHER_P], WEATHER_D, "weather")

    q["enriched_hourly"] = (f"WITH {EV_TRIPS},{hourly_cte()},{WEATHER},{ENRICHED}\n" +
                            sel([*HOURLY_COLS, *WEATHER_P], [*HOURLY_COLS_D, *WEATHER_D], "enriched"))

    q["forecast_rows"] = f"""WITH {WEATHER},
fc AS (
  SELECT datetime, temp, temp - {d(1.5)} AS feels_like, {d(1000.0)} + {d('n_events')} AS pressure, humidity,
         temp - ({d(100.0)} - humidity) / {d(5.0)} AS dew_point, {d('n_events % 101')} AS clouds, wind_speed,
         {d('(n_events * 7) % 360')} AS wind_deg, wmain AS weather_main, wmain || ' sky' AS weather_description,
         '01d' AS weather_icon, coalesce(rain, {d(0.0)}) AS rain_1h, {d(0.0)} AS snow_1h,
         CAST(hour(datetime) AS INTEGER) AS hour, CAST(day(datetime) AS INTEGER) AS day,
         CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week, CAST(month(datetime) AS INTEGER) AS month,
         CAST(isodow(datetime) >= 6 AS INTEGER) AS is_weekend, {d(0.0)} AS uvi, {d(0.0)} AS visibility,
         CAST(0 AS INTEGER) AS weather_id, CAST(0 AS INTEGER) AS timezone_offset
  FROM hw WHERE hour(datetime) % 3 = 0
    AND datetime >= (SELECT date_trunc('day', min(ts)) FROM events) + INTERVAL {FORECAST_DAYS} DAY
    AND datetime <= (SELECT date_trunc('day', min(ts)) FROM events) + INTERVAL {FORECAST_DAYS} DAY + INTERVAL {FORECAST_HOURS} HOUR)
""" + sel(["datetime", "weather_main", "weather_description", "weather_icon", "hour", "day", "day_of_week",
           "month", "is_weekend"],
          ["weather_id", "timezone_offset", "temp", "feels_like", "pressure", "humidity", "dew_point", "clouds", "wind_speed", "wind_deg",
           "rain_1h", "snow_1h", "uvi", "visibility"], "fc")

    q["holiday_calendar"] = f"""WITH {TRIPS},
{holidays_cte("SELECT year(st) AS y FROM trips UNION ALL SELECT year(st) + 1 FROM trips")}
SELECT CAST(hd AS TIMESTAMP) AS holiday_date FROM holidays WHERE year(hd) IN (SELECT year(st) FROM trips)"""

    cal = calendar_exprs("datetime", True)
    cyc_sql = []
    for name, src, period in (("hour", "hour_of_day", 24), ("day", "day", 31), ("month", "month", 12),
                              ("day_of_week", "day_of_week", 7)):
        s_, c_ = cyc(src, period)
        cyc_sql += [r(s_, f"{name}_sin"), r(c_, f"{name}_cos")]
    q["calendar_features"] = f"""WITH {EV_TRIPS},{hourly_cte()},
{holidays_cte("SELECT year(datetime) AS y FROM hourly UNION ALL SELECT year(datetime) + 1 FROM hourly")},
c AS (SELECT h.datetime, h.trip_count, CAST(hd IS NOT NULL AS INTEGER) AS is_holiday,
             {", ".join(f"{e} AS {n}" for n, e in cal)}
      FROM hourly h LEFT JOIN holidays ON CAST(h.datetime AS DATE) = holidays.hd)
SELECT datetime, trip_count, is_holiday, {", ".join(n for n, _ in cal)}, {", ".join(cyc_sql)} FROM c"""

    spec = SPECS["h2"]
    lg = lag_exprs(spec, "datetime", "PARTITION BY rideable_type ")
    q["lag_features_series"] = f"""WITH {EV_TRIPS},
hs AS (SELECT rideable_type, date_trunc('hour', st) AS datetime, count(*) AS trip_count FROM ev_trips
       GROUP BY ALL)
SELECT rideable_type, datetime, {r('trip_count', 'trip_count')}, {", ".join(r(e, n) for n, e in lg)} FROM hs"""

    q["features_h2"] = features_query("h2")
    q["features_base"] = features_query("base")
    q["features_h3"] = features_query("h3")
    q["features_h24"] = features_query("h24")

    prof_cols = [*HOURLY_COLS, *HOURLY_COLS_D, *WEATHER_P, *WEATHER_D]
    q["null_profile"] = f"WITH {EV_TRIPS},{hourly_cte()},{WEATHER},{ENRICHED}\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE \"{c}\" IS NULL) AS BIGINT) AS null_count, "
        f"count(*) AS total_rows FROM enriched" for c in prof_cols)

    q["target_profile"] = f"""WITH {EV_TRIPS},{hourly_cte()},{WEATHER},{ENRICHED}
SELECT count(*) AS n_rows, CAST({len(prof_cols)} AS INTEGER) AS n_columns,
       {r('min(trip_count)', 'min_value')}, {r('max(trip_count)', 'max_value')},
       {r('avg(trip_count)', 'mean_value')}, count(*) FILTER (WHERE trip_count = 0) AS zero_count,
       count(*) FILTER (WHERE trip_count IS NULL) AS null_count
FROM enriched"""

    base = f"WITH {EV_TRIPS},{hourly_cte()},{WEATHER},{ENRICHED}\n"
    kind = "CASE WHEN any_value(typeof(\"{0}\")) IN ('BIGINT', 'INTEGER') THEN CASE WHEN count(*) > count(\"{0}\") THEN 'float64' ELSE 'int64' END WHEN any_value(typeof(\"{0}\")) = 'DOUBLE' THEN 'float64' WHEN any_value(typeof(\"{0}\")) = 'TIMESTAMP' THEN 'datetime64[ns]' ELSE 'object' END"
    q["column_types"] = base + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {kind.format(c)} AS dtype, count(*) - count(\"{c}\") AS null_count FROM enriched" for c in prof_cols)
    q["means_filled"] = base + "SELECT datetime, " + ", ".join(r(f"coalesce({c}, avg({c}) OVER ())", c) for c in ("temp", "humidity", "wind_speed", "rain_1h")) + " FROM enriched"

    ctes, feats = features_ctes("h2")
    allc = [*feats, "trip_count"]
    q["scaler_params"] = f"WITH {ctes}\n" + "\nUNION ALL ".join(
        f"""SELECT '{c}' AS feature, {r(f'quantile_cont("{c}", 0.5)', 'median')},
  {r(f'quantile_cont("{c}", 0.25)', 'q1')}, {r(f'quantile_cont("{c}", 0.75)', 'q3')},
  {r(f'CASE WHEN quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25) = 0 OR quantile_cont("{c}", 0.25) IS NULL THEN 1.0 ELSE quantile_cont("{c}", 0.75) - quantile_cont("{c}", 0.25) END', 'robust_scale')},
  {r(f'min("{c}")', 'min_value')}, {r(f'max("{c}")', 'max_value')} FROM feat""" for c in allc)

    params = ", ".join(
        f"quantile_cont(\"{c}\", 0.5) AS \"m_{c}\", "
        f"CASE WHEN quantile_cont(\"{c}\", 0.75) - quantile_cont(\"{c}\", 0.25) = 0 "
        f"OR quantile_cont(\"{c}\", 0.25) IS NULL THEN 1.0 "
        f"ELSE quantile_cont(\"{c}\", 0.75) - quantile_cont(\"{c}\", 0.25) END AS \"s_{c}\"" for c in feats)
    scaled = ", ".join(r(f'coalesce((feat."{c}" - p."m_{c}") / p."s_{c}", 0.0)', c) for c in feats)
    q["scaled_features"] = f"""WITH {ctes},
p AS (SELECT {params}, min(trip_count) AS tmin,
             CASE WHEN max(trip_count) - min(trip_count) = 0 THEN 1.0 ELSE max(trip_count) - min(trip_count) END AS trng
      FROM feat)
SELECT feat.datetime, {scaled}, {r('(feat.trip_count - p.tmin) / p.trng', 'trip_count')} FROM feat, p"""

    xs = ", ".join(r(f"lag(CAST(trip_count AS DOUBLE), {L - 1 - i}) OVER (ORDER BY datetime)", f"x_{i}")
                   for i in range(L))
    q["sequences"] = f"""WITH {EV_TRIPS},{hourly_cte()},
s AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS rn, count(*) OVER () AS n,
             {r(f'lead(CAST(trip_count AS DOUBLE), {H}) OVER (ORDER BY datetime)', 'target')}, {xs} FROM hourly)
SELECT datetime, target, {", ".join(f"x_{i}" for i in range(L))} FROM s WHERE rn >= {L} AND rn <= n - {H} - 1"""

    ts = ", ".join(r(f"lead(CAST(trip_count AS DOUBLE), {i}) OVER (ORDER BY datetime)", f"target_{i}")
                   for i in range(1, 7))
    q["multi_step_targets"] = f"""WITH {EV_TRIPS},{hourly_cte()},
s AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS rn, count(*) OVER () AS n, {ts} FROM hourly)
SELECT datetime, {", ".join(f"target_{i}" for i in range(1, 7))} FROM s WHERE rn <= n - 6"""

    q["chrono_split"] = f"""WITH {EV_TRIPS},
hs AS (SELECT rideable_type, date_trunc('hour', st) AS datetime, count(*) AS trip_count FROM ev_trips GROUP BY ALL),
s AS (SELECT rideable_type, datetime, row_number() OVER (PARTITION BY rideable_type ORDER BY datetime) AS rn,
             count(*) OVER (PARTITION BY rideable_type) AS n,
             lead(CAST(trip_count AS DOUBLE), {H}) OVER (PARTITION BY rideable_type ORDER BY datetime) AS target
      FROM hs),
q AS (SELECT rideable_type, datetime, target,
             row_number() OVER (PARTITION BY rideable_type ORDER BY datetime) AS seq_index,
             count(*) OVER (PARTITION BY rideable_type) AS m
      FROM s WHERE rn >= {L} AND rn <= n - {H} - 1)
SELECT rideable_type, datetime, {r('target', 'target')}, seq_index,
       CASE WHEN seq_index <= (m - ceil(m * 0.2)) - ceil((m - ceil(m * 0.2)) * 0.25) THEN 'train'
            WHEN seq_index <= m - ceil(m * 0.2) THEN 'val' ELSE 'test' END AS split
FROM q"""

    q["metrics_persistence"] = f"WITH {PERSIST}\nSELECT {_metrics_select()} FROM pred"

    steps = "\nUNION ALL ".join(
        f"SELECT CAST({h} AS INTEGER) AS hours_ahead, CAST(trip_count AS DOUBLE) AS actual, "
        f"CAST(lag(trip_count, {h}) OVER (ORDER BY datetime) AS DOUBLE) AS predicted FROM hourly"
        for h in range(1, 7))
    q["metrics_per_horizon"] = f"""WITH {EV_TRIPS},{hourly_cte()},
st AS ({steps})
SELECT hours_ahead, {_metrics_select()} FROM st WHERE predicted IS NOT NULL GROUP BY hours_ahead"""

    q["ensemble_metrics"] = f"""WITH {PERSIST},
m AS (SELECT *, CASE WHEN isodow(target_time) >= 6 THEN 'weekend' ELSE 'weekday' END AS member FROM pred)
SELECT coalesce(member, 'all') AS member, {_metrics_select()} FROM m GROUP BY ROLLUP (member)"""

    q["residuals"] = f"""WITH {PERSIST}
SELECT rn AS _rn, target_time, {r('actual', 'actual')}, {r('predicted', 'predicted')},
       {r('actual - predicted', 'residual')}, {r('abs(actual - predicted)', 'abs_error')}
FROM pred ORDER BY rn LIMIT 200"""

    names = ["trip_count", "temp", "rain_1h", "humidity"]
    q["correlation_nulls"] = f"WITH {EV_TRIPS},{hourly_cte()},{WEATHER},{ENRICHED}\n" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r(f'CASE WHEN isnan(corr({d(a)}, {d(b)})) THEN NULL ELSE corr({d(a)}, {d(b)}) END', 'corr')} FROM enriched"
        for a in names for b in names)

    member = "CASE WHEN isodow(target_time) >= 6 THEN 'weekend' ELSE 'weekday' END"
    q["model_ols_predictions"] = _ols("'all'")
    q["model_ols_ensemble"] = _ols(member)
    q["model_ols_next"] = _ols("'all'", h=1, after=1)
    q["model_ols_saved"] = _ols(member, part="train", actual=False)
    q["model_ols_metrics"] = f"WITH {_ols_ctes(chr(39) + 'all' + chr(39))}\nSELECT 'all' AS member, {_metrics_select()} FROM pred"
    steps = []
    for h in range(1, 7):
        steps.append(f"(WITH {_ols_ctes(chr(39) + 'all' + chr(39), h=h, after=6)}\nSELECT CAST({h} AS INTEGER) AS hours_ahead, datetime, "
                     f"{r('actual', 'actual')}, {r('predicted', 'predicted')} FROM pred)")
    q["model_ols_multistep"] = "\nUNION ALL\n".join(steps)

    stat = "SELECT rideable_type, '{0}' AS feature, {1} FROM s GROUP BY rideable_type"
    told = lambda e: ", ".join([
        r(f"quantile_cont({e}, 0.5)", "median"), r(f"quantile_cont({e}, 0.25)", "q1"), r(f"quantile_cont({e}, 0.75)", "q3"),
        r(f"CASE WHEN quantile_cont({e}, 0.75) = quantile_cont({e}, 0.25) THEN 1.0 ELSE quantile_cont({e}, 0.75) - quantile_cont({e}, 0.25) END", "robust_scale"),
        r(f"min({e})", "min_value"), r(f"max({e})", "max_value")])
    two = _series_ctes("n - 3", 2, "n - 3")
    q["scaler_params_series"] = f"WITH {two}\n" + " UNION ALL ".join(stat.format(f, told(e)) for f, e in (("level", "y"), ("clock", "c"), ("trip_count", "y")))

    q["model_importance_linear"] = f"""WITH {two},
f AS (SELECT {_two_slopes('t2', 0.0)} FROM l WHERE split = 'train'),
k AS (SELECT feature, CASE feature WHEN 'level' THEN b1 * x1 ELSE b2 * x2 END AS s,
             md5('42|' || feature || '|' || rideable_type || '|' || rn) AS k
      FROM l, f, (VALUES ('level'), ('clock')) AS names(feature) WHERE split = 'train'),
d AS (SELECT feature, s, coalesce(lag(s) OVER w, last_value(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS donor
      FROM k WINDOW w AS (PARTITION BY feature ORDER BY k))
SELECT 'all' AS member, feature, {r('avg(abs(donor - s))', 'importance')} FROM d GROUP BY feature"""

    six = _series_ctes("n - 7", 6, "n - 6")
    q["model_ridge_multistep"] = f"WITH {six}\n" + " UNION ALL ".join(
        f"""SELECT rideable_type, CAST({h} AS INTEGER) AS hours_ahead, datetime, {r(f't{h} * rng + lo', 'actual')},
       {r('(v + b1 * (x1 - u1) + b2 * (x2 - u2)) * rng + lo', 'predicted')}
FROM l, (SELECT {_two_slopes(f't{h}', 0.1)} FROM l WHERE split = 'train') WHERE split = 'test'""" for h in range(1, 7))

    # name: (λ, α) of λ(α|w| + (1 − α)/2·w²); with one input the weight has a closed form
    paths = {"none": (0.0, 0.0), "l2_small": (0.001, 0.0), "l2_large": (0.5, 0.0), "l1_small": (0.00025, 1.0), "l1_large": (0.025, 1.0), "l1_l2": (0.015, 1 / 3)}
    parts = []
    for name, (lam, alpha) in paths.items():
        for h in range(1, 7):
            g = f"covar_pop(x1, t{h})"
            w = f"sign({g}) * greatest(abs({g}) - {lam * alpha!r}, 0) / (covar_pop(x1, x1) + {lam * (1 - alpha)!r})"
            parts.append(f"SELECT '{name}' AS penalty, CAST({h} AS INTEGER) AS hours_ahead, t{h} * rng + lo AS actual, (v + w * (x1 - u)) * rng + lo AS predicted "
                         f"FROM l, (SELECT {w} AS w, avg(x1) AS u, avg(t{h}) AS v FROM l WHERE split = 'train') WHERE split = 'test'")
    q["model_penalty_path"] = f"WITH {six},\npred AS ({' UNION ALL '.join(parts)})\nSELECT penalty, hours_ahead, {_metrics_select()} FROM pred GROUP BY penalty, hours_ahead"

    routed = "CASE WHEN isodow(l.datetime) >= 6 THEN 'weekend' ELSE 'weekday' END"
    q["model_ols_routed"] = (f"WITH {_ols_ctes(member, h=1, after=1)}\nSELECT {routed} AS member, l.datetime, l.target_time, {r('f.a + f.b * l.x', 'predicted')} "
                             f"FROM l JOIN f ON f.member = {routed} WHERE split = 'train'")

    xs = ", ".join(r(f"lag(level, {12 - i}) OVER (PARTITION BY rideable_type ORDER BY datetime)", f"x_{i}") for i in range(12))
    q["forecast_windows"] = f"""WITH {EV_TRIPS},{WEATHER},
h AS (SELECT rideable_type, date_trunc('hour', st) AS datetime, CAST(count(*) AS DOUBLE) AS level FROM ev_trips WHERE st IS NOT NULL GROUP BY ALL),
past AS (SELECT * FROM h WHERE datetime <= (SELECT max(datetime) FROM h) - INTERVAL 5 DAY),
newest AS (SELECT rideable_type, max(datetime) AS newest FROM past GROUP BY ALL),
ahead AS (SELECT rideable_type, datetime, temp AS level FROM hw JOIN newest ON datetime > newest WHERE hour(datetime) % 3 = 0),
u AS (SELECT *, 0 AS told FROM past UNION ALL SELECT *, 1 FROM ahead),
w AS (SELECT rideable_type, datetime, told, row_number() OVER (PARTITION BY rideable_type ORDER BY datetime) AS rn, {xs} FROM u)
SELECT * EXCLUDE (told, rn) FROM w WHERE told = 1 AND rn > 12"""

    fit = lambda c: f"quantile_cont({c}, 0.5) AS m, CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1.0 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s"
    served = [("a", 0, "level", "level"), ("a", 1, "before", "before"), ("a", 2, "day", "0.0"), ("b", 0, "clock", "clock"), ("b", 1, "before", "before")]
    q["serving_features"] = f"""WITH {EV_TRIPS},
h AS (SELECT rideable_type, date_trunc('hour', st) AS datetime, CAST(count(*) AS DOUBLE) AS level FROM ev_trips WHERE st IS NOT NULL GROUP BY ALL),
x AS (SELECT *, lag(level) OVER (PARTITION BY rideable_type ORDER BY datetime) AS before, CAST(day(datetime) AS DOUBLE) AS day,
             CAST(hour(datetime) AS DOUBLE) AS clock FROM h)
""" + " UNION ALL ".join(f"SELECT '{v}' AS model_version, rideable_type, datetime, CAST({i} AS INTEGER) AS position, {r(f'coalesce(({raw} - m) / s, 0)', 'value')} FROM x, (SELECT {fit(c)} FROM x)" for v, i, c, raw in served)

    imp = importance_ctes()
    q["importance_top"] = f"WITH {imp}\nSELECT feature, {r('importance', 'importance')}, CAST(rank AS INTEGER) AS rank FROM top"

    cat_rows = ", ".join(f"('{c}', '{p}')" for c, ps in CATEGORIES.items() for p in ps)
    cat_names = ", ".join(f"('{c}')" for c in CATEGORIES)
    q["category_importance"] = f"""WITH {imp},
pats AS (SELECT * FROM (VALUES {cat_rows}) AS t(category, pattern)),
cats AS (SELECT * FROM (VALUES {cat_names}) AS t(category)),
hit AS (SELECT DISTINCT p.category, i.feature, i.importance FROM imp i JOIN pats p ON contains(i.feature, p.pattern)),
s AS (SELECT c.category, coalesce(sum(h.importance), 0.0) AS importance FROM cats c LEFT JOIN hit h USING (category)
      GROUP BY c.category)
SELECT category, {r('importance', 'importance')},
       {r('CASE WHEN sum(importance) OVER () = 0 THEN NULL ELSE importance / sum(importance) OVER () END', 'share')},
       CAST(row_number() OVER (ORDER BY importance DESC, category) AS INTEGER) AS rank
FROM s"""

    q["correlation_top"] = f"""WITH {imp},
sel AS (SELECT feature FROM top UNION ALL SELECT 'trip_count'),
lng AS (SELECT datetime AS __dt, feature, v FROM feat UNPIVOT INCLUDE NULLS
        (v FOR feature IN ({", ".join(chr(34) + c + chr(34) for c in [*feats, "trip_count"])}))),
l2 AS (SELECT * FROM lng WHERE feature IN (SELECT feature FROM sel))
SELECT a.feature AS feature_1, b.feature AS feature_2, {r(_corr('a.v', 'b.v'), 'corr')}
FROM l2 a JOIN l2 b ON a.__dt = b.__dt GROUP BY a.feature, b.feature"""

    corr_rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {_corr(chr(34) + c + chr(34), 'trip_count')} AS corr FROM feat" for c in feats)
    q["unexpected_features"] = f"""WITH {imp},
cr AS ({corr_rows})
SELECT t.feature, {r('t.importance', 'importance')}, {r('abs(cr.corr)', 'abs_corr')}, CAST(t.rank AS INTEGER) AS rank
FROM top t JOIN cr USING (feature)
WHERE t.importance > (SELECT avg(importance) FROM imp) AND abs(cr.corr) < 0.3"""

    q["last_hours"] = f"""WITH {EV_TRIPS},{hourly_cte(series=True)}
SELECT rideable_type, {", ".join(HOURLY_COLS)}, {r('latitude', 'latitude')}, {r('longitude', 'longitude')}
FROM (SELECT *, row_number() OVER (PARTITION BY rideable_type ORDER BY datetime DESC) AS k FROM hourly) WHERE k <= 24"""

    q["first_rows"] = f"""WITH {EV_TRIPS},{hourly_cte()}
SELECT {", ".join(HOURLY_COLS)}, {r('latitude', 'latitude')}, {r('longitude', 'longitude')},
       CAST(row_number() OVER (ORDER BY datetime) - 1 AS INTEGER) AS position
FROM hourly ORDER BY datetime LIMIT 21"""
    return q
