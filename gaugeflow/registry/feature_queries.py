"""Hydrological features."""

from pyspark.sql import functions as F

from gaugeflow.operators import hydro_features as H
from gaugeflow.registry.catalog import MOMENT, Tables, at, query
from gaugeflow.session import shared_folder
from gaugeflow.streaming.cycles import cycle_features

OLD = """
aged AS (SELECT *, last_value(struct_pack(v := current_level)) OVER (PARTITION BY station_id ORDER BY observation_time
 RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 3 HOURS PRECEDING).v AS old_level FROM obs)"""
RATE = "CASE WHEN (current_level - old_level) / 3 > 0 THEN (current_level - old_level) / 3 ELSE 0e0 END"
PERCENTILE = """CASE WHEN count(*) OVER (PARTITION BY station_id) < 2 THEN 50e0 WHEN current_level IS NULL THEN 0e0
 ELSE (rank() OVER (PARTITION BY station_id ORDER BY current_level NULLS LAST) - 1) / CAST(count(*) OVER (PARTITION BY station_id) AS DOUBLE) * 100 END"""
VOLATILITY = "coalesce(stddev_samp(current_level) OVER (PARTITION BY station_id), 0e0)"
SEASON = "sin(2 * pi() * month(observation_time) / 12)"
AGE = f"greatest(0e0, (epoch_us(TIMESTAMP '{MOMENT}') - epoch_us(observation_time)) / 3.6e9)"
RISING = "CASE trend WHEN 'rising' THEN 3 WHEN 'falling' THEN 0 ELSE 1 END"


@query("observations_with_station", """
SELECT obs_seq, o.station_id, current_level, station_name, basin, state FROM obs o LEFT JOIN station_dim s ON o.station_id = s.station_id""",
       ["obs", "station_dim"], "current_level")
def _(t: Tables):
    rows = H.with_station_columns(t.obs, t.station_dim, ["station_name", "basin", "state"])
    return rows.select("obs_seq", "station_id", "current_level", "station_name", "basin", "state")


@query("threshold_distances", """
SELECT obs_seq, current_level, warning_level - current_level AS distance_to_warning, danger_level - current_level AS distance_to_danger FROM obs""",
       ["obs"], "current_level distance_to_warning distance_to_danger")
def _(t: Tables):
    return H.distances(t.obs).select("obs_seq", "current_level", "distance_to_warning", "distance_to_danger")


@query("rate_of_rise", f"WITH {OLD} SELECT obs_seq, station_id, {RATE} AS rate_of_rise_3h FROM aged", ["obs"], "rate_of_rise_3h")
def _(t: Tables):
    return H.rate_of_rise(t.obs, hot=t.hot).select("obs_seq", "station_id", "rate_of_rise_3h")


@query("rising_hours_by_trend", f"SELECT obs_seq, {RISING} AS consecutive_rising_hours FROM obs", ["obs"])
def _(t: Tables):
    return t.obs.select("obs_seq", H.rising_hours(F.col("trend")).alias("consecutive_rising_hours"))


@query("rising_run_length", """
WITH steps AS (SELECT *, row_number() OVER w AS i, coalesce(current_level > lag(current_level) OVER w, false) AS rose FROM obs
 WINDOW w AS (PARTITION BY station_id ORDER BY observation_time NULLS LAST, obs_seq))
SELECT obs_seq, station_id, CAST(i - max(CASE WHEN NOT rose THEN i END) OVER (PARTITION BY station_id ORDER BY i) AS INTEGER) AS rising_run FROM steps""", ["obs"])
def _(t: Tables):
    return H.rising_run(t.obs, hot=t.hot).select("obs_seq", "station_id", "rising_run")


@query("historical_percentile", f"SELECT obs_seq, station_id, {PERCENTILE} AS historical_percentile FROM obs", ["obs"], "historical_percentile")
def _(t: Tables):
    return H.historical_percentile(t.obs, hot=t.hot).select("obs_seq", "station_id", "historical_percentile")


def _trailing(days: int) -> str:
    """Counted pair by pair on the SQL side."""
    return f"""
WITH pairs AS (SELECT a.obs_seq, a.current_level, count(b.obs_seq) AS n, count(b.obs_seq) FILTER (WHERE b.current_level < a.current_level) AS below
 FROM obs a LEFT JOIN obs b ON a.station_id = b.station_id AND b.observation_time <= a.observation_time
  AND b.observation_time >= a.observation_time - INTERVAL {days} DAYS GROUP BY a.obs_seq, a.current_level)
SELECT obs_seq, CASE WHEN n < 2 THEN 50e0 WHEN current_level IS NULL THEN 0e0 ELSE below / CAST(n AS DOUBLE) * 100 END AS trailing_percentile FROM pairs"""


@query("year_percentile", _trailing(365), ["obs"], "trailing_percentile")
def _(t: Tables):
    return H.trailing_percentile(t.obs, hot=t.hot).select("obs_seq", "trailing_percentile")


@query("ten_day_percentile", _trailing(10), ["obs"], "trailing_percentile")
def _(t: Tables):
    return H.trailing_percentile(t.obs, days=10, hot=t.hot).select("obs_seq", "trailing_percentile")


@query("basin_average_level", """
SELECT obs_seq, basin, CASE WHEN basin IS NOT NULL THEN avg(current_level) OVER (PARTITION BY basin) END AS basin_avg_level
FROM obs LEFT JOIN station_dim USING (station_id)""", ["obs", "station_dim"], "basin_avg_level")
def _(t: Tables):
    rows = H.with_station_columns(t.obs, t.station_dim, ["basin"])
    return H.basin_average(rows, t.station_dim).select("obs_seq", "basin", "basin_avg_level")


@query("rolling_level_average", """
SELECT obs_seq, avg(current_level) OVER (ORDER BY station_id, observation_time NULLS LAST, obs_seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS basin_avg_level
FROM obs""", ["obs"], "basin_avg_level")
def _(t: Tables):
    return H.rolling_average(t.obs, hot=t.hot).select("obs_seq", "basin_avg_level")


@query("station_volatility", f"SELECT obs_seq, station_id, {VOLATILITY} AS station_volatility FROM obs", ["obs"], "station_volatility")
def _(t: Tables):
    return H.station_volatility(t.obs, hot=t.hot).select("obs_seq", "station_id", "station_volatility")


@query("change_volatility", """
WITH steps AS (SELECT *, current_level - lag(current_level) OVER (PARTITION BY station_id ORDER BY observation_time NULLS LAST, obs_seq) AS change FROM obs)
SELECT obs_seq, station_id, coalesce(stddev_samp(change) OVER (PARTITION BY station_id ORDER BY observation_time
 RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW), 0e0) AS change_volatility FROM steps""", ["obs"], "change_volatility")
def _(t: Tables):
    return H.change_volatility(t.obs, hot=t.hot).select("obs_seq", "station_id", "change_volatility")


@query("hours_since_update", f"SELECT obs_seq, {AGE} AS hours_since_last_update, 0e0 AS hours_compat FROM obs", ["obs"], "hours_since_last_update")
def _(t: Tables):
    time = F.col("observation_time")
    return t.obs.select(
        "obs_seq", H.hours_since_update(time, at()).alias("hours_since_last_update"), H.hours_since_update(time, None).alias("hours_compat")
    )


@query("seasonal_factor", f"SELECT obs_seq, {SEASON} AS seasonal_factor FROM obs", ["obs"], "seasonal_factor")
def _(t: Tables):
    return t.obs.select("obs_seq", H.seasonal_factor(F.col("observation_time")).alias("seasonal_factor"))


HYDRO = OLD + f""",
hydro AS (SELECT obs_seq, a.station_id, observation_time, current_level, warning_level - current_level AS distance_to_warning,
 danger_level - current_level AS distance_to_danger, {RATE} AS rate_of_rise_3h, {RISING} AS consecutive_rising_hours,
 {PERCENTILE} AS historical_percentile,
 CASE WHEN basin IS NOT NULL THEN avg(current_level) OVER (PARTITION BY basin) END AS basin_avg_level,
 {VOLATILITY} AS station_volatility, {AGE} AS hours_since_last_update, {SEASON} AS seasonal_factor
 FROM (SELECT a.*, basin FROM aged a LEFT JOIN station_dim s ON a.station_id = s.station_id) a)"""
HYDRO_DOUBLES = ("current_level distance_to_warning distance_to_danger rate_of_rise_3h historical_percentile "
                 "basin_avg_level station_volatility hours_since_last_update seasonal_factor")


@query("hydro_features", "WITH " + HYDRO + " SELECT * EXCLUDE (observation_time) FROM hydro", ["obs", "station_dim"], HYDRO_DOUBLES)
def _(t: Tables):
    return H.hydro_features(t.obs, t.station_dim, as_of=at(), hot=t.hot).drop("observation_time")


# Readings arrive in four cycles: three stretches of time, and a last one of readings that come late.
CYCLE = ("CASE WHEN obs_seq % 50 = 0 THEN 3 WHEN observation_time < TIMESTAMP '2024-01-08 00:00:00' THEN 0 "
         "WHEN observation_time < TIMESTAMP '2024-01-20 00:00:00' THEN 1 ELSE 2 END")
SEEN = f"""
seen AS (SELECT *, row_number() OVER (PARTITION BY upto, station_id ORDER BY observation_time NULLS LAST, obs_seq) AS i
 FROM (SELECT *, {CYCLE} AS cycle FROM obs) JOIN (SELECT unnest([0, 1, 2, 3]) AS upto) ON cycle <= upto),
around AS (SELECT *, last_value(CASE WHEN current_level IS NOT NULL THEN i END IGNORE NULLS) OVER b AS li, last_value(current_level IGNORE NULLS) OVER b AS lv,
 first_value(CASE WHEN current_level IS NOT NULL THEN i END IGNORE NULLS) OVER a AS hi, first_value(current_level IGNORE NULLS) OVER a AS hv FROM seen
 WINDOW b AS (PARTITION BY upto, station_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 a AS (PARTITION BY upto, station_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT upto, cycle, station_id, obs_seq, observation_time, trend, warning_level, danger_level, CASE WHEN current_level IS NOT NULL THEN current_level
 WHEN li IS NOT NULL AND hi IS NOT NULL THEN lv + (hv - lv) * ((i - li) / CAST(hi - li AS DOUBLE)) ELSE coalesce(lv, hv) END AS x FROM around),
known AS (SELECT f.*, basin, rank() OVER (PARTITION BY upto, f.station_id ORDER BY x NULLS LAST) - 1 AS below, count(*) OVER (PARTITION BY upto, f.station_id) AS n,
 stddev_samp(x) OVER (PARTITION BY upto, f.station_id) AS spread, avg(x) OVER (PARTITION BY upto, basin) AS mean_of_basin,
 last_value(struct_pack(v := x)) OVER (PARTITION BY upto, f.station_id ORDER BY observation_time RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 3 HOURS PRECEDING).v AS old
 FROM filled f LEFT JOIN station_dim s ON f.station_id = s.station_id)"""


@query("cycle_features", f"""WITH {SEEN}
SELECT obs_seq, station_id, x AS current_level, warning_level - x AS distance_to_warning, danger_level - x AS distance_to_danger,
 CASE WHEN x > old THEN (x - old) / 3 ELSE 0e0 END AS rate_of_rise_3h, {RISING} AS consecutive_rising_hours,
 CASE WHEN n < 2 THEN 50e0 WHEN x IS NULL THEN 0e0 ELSE below / CAST(n AS DOUBLE) * 100 END AS historical_percentile,
 CASE WHEN basin IS NOT NULL THEN mean_of_basin END AS basin_avg_level, coalesce(spread, 0e0) AS station_volatility,
 {AGE} AS hours_since_last_update, {SEASON} AS seasonal_factor FROM known WHERE cycle = upto""", ["obs", "station_dim"], HYDRO_DOUBLES)
def _(t: Tables):
    """Each reading's features when its cycle ran, carried over from cycle to cycle by the station state."""
    root, rows, out = shared_folder(t.spark, "cycle-features"), t.obs.withColumn("_cycle", F.expr(CYCLE)), None
    for cycle in range(4):
        features = cycle_features(rows.filter(F.col("_cycle") == cycle).drop("_cycle"), cycle, root, t.station_dim, at()).drop("observation_time")
        out = features if out is None else out.unionByName(features)
    return out
