"""Rainfall features, snapshots and the nearest grid cell."""

from pyspark.sql import functions as F

from gaugeflow.operators import hydro_features as H, spatial, weather_features as W
from gaugeflow.fixed_values import WEATHER_FEATURES
from gaugeflow.registry.catalog import Tables, at, query
from gaugeflow.registry.feature_queries import HYDRO, HYDRO_DOUBLES

RAIN = ", ".join(f"coalesce(w.{c}, 0e0) AS {c}" for c in WEATHER_FEATURES[:3])
JOINED = f"""
rainy AS (SELECT o.obs_seq, o.station_id, danger_level - current_level AS distance_to_danger, {RAIN}
 FROM obs o LEFT JOIN weather w ON o.station_id = w.station_id)"""
DERIVED = """
farthest AS (SELECT max(distance_to_danger) AS m FROM {source}),
derived AS (SELECT *, rainfall_forecast_next_6h_mm - rainfall_last_6h_mm AS rainfall_intensity_trend,
 rainfall_forecast_next_6h_mm * {volatility} AS rainfall_runoff_index, rainfall_last_6h_mm / 5e0 AS saturation_proxy,
 rainfall_forecast_next_24h_mm * CASE WHEN m > 0 THEN 1 - distance_to_danger / m ELSE 0.5e0 END AS compound_risk_index FROM {source}, farthest)"""
ENDS = "ends AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in WEATHER_FEATURES) + " FROM derived)"
SCALED = ", ".join(
    f"CASE WHEN hi_{c} - lo_{c} > 0.01 THEN CASE WHEN {c} IS NOT NULL THEN greatest(0e0, least(1e0, ({c} - lo_{c}) / (hi_{c} - lo_{c}))) END "
    f"WHEN hi_{c} > 0 THEN CASE WHEN {c} IS NOT NULL THEN greatest(0e0, least(1e0, {c} / hi_{c})) END ELSE 0e0 END AS {c}"
    for c in WEATHER_FEATURES
)
ALL = " ".join(WEATHER_FEATURES)


def _rainy(t: Tables):
    return W.add_rainfall(H.distances(t.obs), t.weather)


@query("rainfall_joined", f"WITH {JOINED} SELECT obs_seq, station_id, {', '.join(WEATHER_FEATURES[:3])} FROM rainy", ["obs", "weather"], " ".join(WEATHER_FEATURES[:3]))
def _(t: Tables):
    return _rainy(t).select("obs_seq", "station_id", *WEATHER_FEATURES[:3])


@query("rainfall_without_snapshot", "SELECT obs_seq, " + ", ".join(f"0e0 AS {c}" for c in WEATHER_FEATURES) + " FROM obs", ["obs"])
def _(t: Tables):
    rows = W.add_weather_features(H.distances(t.obs).withColumn("station_volatility", F.lit(1.0)), None)
    # A row without a level has no distance, but an all-zero column is set to 0 everywhere.
    return rows.select("obs_seq", *WEATHER_FEATURES)


@query("rainfall_intensity_trend", f"WITH {JOINED} SELECT obs_seq, rainfall_forecast_next_6h_mm - rainfall_last_6h_mm AS rainfall_intensity_trend FROM rainy",
       ["obs", "weather"], "rainfall_intensity_trend")
def _(t: Tables):
    return _rainy(t).select("obs_seq", W.intensity_trend().alias("rainfall_intensity_trend"))


@query("rainfall_runoff_index", f"""WITH {JOINED}, v AS (SELECT station_id, coalesce(stddev_samp(current_level), 0e0) AS s FROM obs GROUP BY station_id)
SELECT obs_seq, rainfall_forecast_next_6h_mm * s AS rainfall_runoff_index, rainfall_forecast_next_6h_mm * 0.5 AS runoff_default
FROM rainy JOIN v USING (station_id)""", ["obs", "weather"], "rainfall_runoff_index runoff_default")
def _(t: Tables):
    rows = W.add_rainfall(H.station_volatility(t.obs, hot=t.hot), t.weather)
    return rows.select("obs_seq", W.runoff_index(rows.columns).alias("rainfall_runoff_index"), W.runoff_index([]).alias("runoff_default"))


@query("saturation_proxy", f"WITH {JOINED} SELECT obs_seq, rainfall_last_6h_mm / 5e0 AS saturation_default, rainfall_last_6h_mm / 7e0 AS saturation_known, 0e0 AS saturation_dry FROM rainy",
       ["obs", "weather"], "saturation_default saturation_known")
def _(t: Tables):
    return _rainy(t).select(
        "obs_seq", W.saturation_proxy().alias("saturation_default"), W.saturation_proxy(7.0).alias("saturation_known"),
        W.saturation_proxy(0.0).alias("saturation_dry"),
    )


@query("compound_risk_index", "WITH " + JOINED + "," + DERIVED.format(source="rainy", volatility="1") + " SELECT obs_seq, compound_risk_index FROM derived",
       ["obs", "weather"], "compound_risk_index")
def _(t: Tables):
    rows = _rainy(t)
    return W.compound_risk(rows).select("obs_seq", "compound_risk_index")


@query("normalized_rainfall", "WITH " + JOINED + "," + DERIVED.format(source="rainy", volatility="0.5") + "," + ENDS +
       f" SELECT obs_seq, {SCALED} FROM derived, ends", ["obs", "weather"], ALL)
def _(t: Tables):
    return W.add_weather_features(H.distances(t.obs), t.weather).select("obs_seq", *WEATHER_FEATURES)


@query("weather_aware_features", "WITH " + HYDRO + f""",
rainy AS (SELECT h.*, {RAIN} FROM hydro h LEFT JOIN weather w ON h.station_id = w.station_id),""" + DERIVED.format(source="rainy", volatility="station_volatility") + "," + ENDS + f"""
SELECT derived.* EXCLUDE (observation_time, m) REPLACE ({SCALED}) FROM derived, ends""", ["obs", "station_dim", "weather"], HYDRO_DOUBLES + " " + ALL)
def _(t: Tables):
    return W.weather_aware_features(t.obs, t.station_dim, t.weather, as_of=at(), hot=t.hot).drop("observation_time")


@query("feature_availability", """
SELECT 1 AS hydro_features, 3 AS weather_features, count(*) > 0 AS weather_active, 11 AS total_columns,
 CASE WHEN count(*) > 0 THEN 'WEATHER-AWARE' ELSE 'HYDRO-ONLY' END AS mode FROM weather""", ["weather"])
def _(t: Tables):
    return W.feature_availability(W.add_rainfall(t.obs, t.weather).drop("observation_time").withColumn("n", F.lit(1)), t.weather)


@query("nearest_grid_cell", """
WITH spots AS (SELECT lat, lon, min_by(rain_mm, cell_id) AS rain_mm, min(cell_id) AS cell_id FROM grid GROUP BY lat, lon)
SELECT station_id, min_by(cell_id, struct_pack(d := (lat - latitude) * (lat - latitude) + (lon - longitude) * (lon - longitude), c := cell_id)) AS cell_id,
 min_by(rain_mm, struct_pack(d := (lat - latitude) * (lat - latitude) + (lon - longitude) * (lon - longitude), c := cell_id)) AS rain_mm,
 sqrt(min((lat - latitude) * (lat - latitude) + (lon - longitude) * (lon - longitude))) AS distance
FROM station_dim, spots GROUP BY station_id""", ["station_dim", "grid"], "rain_mm distance")
def _(t: Tables):
    return spatial.nearest_cell(t.station_dim, t.grid).select("station_id", "cell_id", "rain_mm", "distance")
