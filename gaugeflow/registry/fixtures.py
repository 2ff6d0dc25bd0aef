"""Gauge tables derived from the given star-schema tables.

One SQL text per view, run by Spark here and by the checking engine as a common
table expression. Every view covers its whole input tables; event_id is the
unique tie-break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.session import tune

TABLES = ("region", "nation", "customer", "part", "events", "pages", "documents", "orders", "lineitem")

VIEWS: dict[str, str] = {
    "station_dim": """
SELECT c_custkey AS station_id, c_name AS station_name, concat('RIVER_', CAST(c_custkey % 10 AS STRING)) AS river_name,
 CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE r_name END AS basin, n_name AS state,
 CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('DIST_', n_name) END AS district,
 8e0 + (c_custkey % 110) * 0.25e0 + 0.07e0 AS latitude, 68e0 + (c_custkey % 118) * 0.25e0 + 0.04e0 AS longitude
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_custkey IN (SELECT user_id FROM events)""",
    "obs": """
SELECT event_id AS obs_seq, user_id AS station_id, ts AS observation_time,
 CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 101 = 0 THEN 150e0 ELSE value / 10e0 END AS current_level,
 8e0 + (user_id % 5) * 0.5e0 AS warning_level, 10e0 + (user_id % 5) * 0.5e0 AS danger_level,
 13e0 + (user_id % 5) * 0.5e0 AS highest_flood_level,
 CASE event_type WHEN 'view' THEN 'rising' WHEN 'click' THEN 'rising' WHEN 'error' THEN 'falling' WHEN 'signup' THEN 'stable' ELSE 'unknown' END AS trend
FROM events""",
    "obs_cm": """
SELECT obs_seq, station_id, observation_time, current_level, warning_level, danger_level * 100e0 AS danger_level,
 highest_flood_level, trend FROM obs""",
    "weather": """
SELECT c_custkey AS station_id, abs(c_acctbal) / 500e0 AS rainfall_last_6h_mm, abs(c_acctbal) / 300e0 AS rainfall_forecast_next_6h_mm,
 abs(c_acctbal) / 100e0 AS rainfall_forecast_next_24h_mm,
 CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-01-30 18:00:00' ELSE TIMESTAMP '2024-01-30 23:00:00' END AS fetched_at
FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""",
    "weather_log": """
SELECT user_id AS station_id, event_id AS log_id, value / 5e0 AS rainfall_last_6h_mm, value / 3e0 AS rainfall_forecast_next_6h_mm,
 value AS rainfall_forecast_next_24h_mm, ts AS fetched_at, CASE WHEN event_id % 3 = 0 THEN 'observed' ELSE 'forecast' END AS kind
FROM events""",
    "pred": """
SELECT obs_seq, station_id, observation_time, current_level, warning_level - current_level AS distance_to_warning,
 danger_level - current_level AS distance_to_danger,
 CASE WHEN danger_level - current_level <= 0 THEN 1e0 WHEN danger_level - current_level >= 5 THEN 0e0
  ELSE 1e0 - (danger_level - current_level) / 5e0 END AS risk_score,
 ((obs_seq * 37) % 1000) / 1000e0 AS warning_probability, CAST((obs_seq * 7) % 3 AS INT) AS risk_tier,
 CASE (obs_seq * 7) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk_tier_name,
 ((obs_seq * 13) % 40) / 100e0 AS rate_of_rise_3h
FROM obs WHERE current_level IS NOT NULL""",
    "factors": """
SELECT obs_seq, station_id, observation_time, current_level, distance_to_warning, distance_to_danger, rate_of_rise_3h,
 risk_score, warning_probability, risk_tier_name, CAST((obs_seq * 11) % 10 AS INT) AS consecutive_rising_hours,
 ((obs_seq * 29) % 1010) / 10e0 AS historical_percentile, 5e0 + (station_id % 7) AS basin_avg_level,
 (station_id % 11) / 4e0 AS station_volatility, (obs_seq % 48) / 2e0 AS hours_since_last_update, 0.5e0 AS seasonal_factor
FROM pred""",
    "grid": """
SELECT p_partkey AS cell_id, 8e0 + (p_partkey % 110) * 0.25e0 AS lat, 68e0 + (p_partkey % 118) * 0.25e0 AS lon,
 p_retailprice / 100e0 AS rain_mm FROM part""",
    "scrape_page": """
SELECT obs_seq AS page_id, concat('<html><table class="s"><tr><th>id</th></tr><tr><td> S', CAST(station_id AS STRING),
 ' </td><td>N</td><td><b>R</b></td><td>B</td><td>ST</td><td>',
 CASE WHEN obs_seq % 5 = 0 THEN 'n/a' ELSE CAST(obs_seq % 90 AS STRING) END, '</td><td>8</td><td>10</td>',
 CASE WHEN obs_seq % 3 = 0 THEN '<td>12.5</td><td> rising </td>' ELSE '' END,
 '</tr><tr><td>short</td></tr></table></html>') AS html FROM obs""",
    "forecast_feed": """
SELECT obs_seq AS page_id,
 CASE WHEN obs_seq % 2 = 0 THEN concat('[{"station_id": "S', CAST(station_id AS STRING), '", "forecast_level": ', CAST(obs_seq % 90 AS STRING),
  '.5, "forecast_time": "2024-02-01T00:00:00", "confidence": 0.5}]')
 ELSE concat('<table><tr><th>id</th></tr><tr><td>S', CAST(station_id AS STRING), '</td><td>',
  CASE WHEN obs_seq % 5 = 0 THEN '-' ELSE CAST(obs_seq % 90 AS STRING) END, '.25</td><td>2024-02-02T00:00:00</td><td>0.75</td></tr></table>') END AS body
FROM obs""",
    "scored": """
SELECT obs_seq, CAST((obs_seq * 7) % 3 AS INT) AS label,
 CASE WHEN obs_seq % 11 = 0 THEN CAST((obs_seq * 5) % 3 AS INT) ELSE CAST((obs_seq * 7) % 3 AS INT) END AS prediction,
 ((obs_seq * 37) % 1000) / 1000e0 AS probability,
 CAST(CASE WHEN (obs_seq * 37) % 1000 + (obs_seq % 300) > 800 THEN 1 ELSE 0 END AS INT) AS y_bin FROM obs""",
    "pred_low": """
SELECT obs_seq, station_id, observation_time, current_level, distance_to_warning, distance_to_danger, risk_score * 0.3e0 AS risk_score,
 warning_probability, 0 AS risk_tier, 'low' AS risk_tier_name, rate_of_rise_3h FROM pred""",
    "doc_text": """
SELECT obs_seq, concat('{',
 CASE WHEN obs_seq % 23 = 0 THEN '' ELSE concat('"prediction":{"flood_probability":',
   CASE WHEN obs_seq % 19 = 0 THEN '1.5' WHEN obs_seq % 29 = 0 THEN '"high"' ELSE CAST(CAST(warning_probability AS DECIMAL(5,3)) AS STRING) END,
   ',"risk_level":"', CASE WHEN obs_seq % 31 = 0 THEN 'SEVERE' ELSE upper(risk_tier_name) END, '"},') END,
 '"confidence":{', CASE WHEN obs_seq % 37 = 0 THEN '' ELSE '"model_confidence":0.5' END, '},',
 '"explanation":', CASE WHEN obs_seq % 41 = 0 THEN '"text"' WHEN obs_seq % 43 = 0 THEN '[]' WHEN obs_seq % 47 = 0 THEN '["a",5]' ELSE '["a","b"]' END, ',',
 '"context":{"location":{"district":"D","state":"S","latitude":1.0', CASE WHEN obs_seq % 53 = 0 THEN '' ELSE ',"longitude":2.0' END, '}',
 CASE WHEN obs_seq % 59 = 0 THEN '' ELSE ',"time_window":{"prediction_time":"t","valid_until":"v"}' END, '},',
 '"metadata":{"model_type":"m","model_version":"1","data_sources":["x"]', CASE WHEN obs_seq % 61 = 0 THEN '' ELSE ',"disclaimer":"d"' END, '}}') AS doc
FROM pred""",
}

NEEDS: dict[str, tuple[str, ...]] = {
    "station_dim": (), "obs": (), "weather": (), "weather_log": (), "grid": (),
    "obs_cm": ("obs",), "pred": ("obs",), "factors": ("obs", "pred"), "scrape_page": ("obs",), "forecast_feed": ("obs",),
    "scored": ("obs",), "pred_low": ("obs", "pred"), "doc_text": ("obs", "pred"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    naive = [n for n, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in naive}) if naive else df


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Build a view over the tables of a folder; nothing is read until it is used."""
    tune(spark)
    text = VIEWS[name]
    for t in TABLES:
        if f" {t}" in text.replace("\n", " "):
            table(spark, folder, t).createOrReplaceTempView(t)
    for needed in NEEDS[name]:
        view(spark, folder, needed).createOrReplaceTempView(needed)
    return spark.sql(text)


def observations_of(events: DataFrame) -> DataFrame:
    """The obs view over a given events table, for example one batch of a stream."""
    events.createOrReplaceTempView("events")
    return events.sparkSession.sql(VIEWS["obs"])


def with_views(sql: str, *names: str) -> str:
    """Prefix a check query with the views it reads."""
    needed: list[str] = []
    for name in names:
        for n in (*NEEDS[name], name):
            if n not in needed:
                needed.append(n)
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in needed]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
