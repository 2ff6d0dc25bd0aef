"""Sources, snapshots and profiles."""

from pyspark.sql import functions as F

from gaugeflow.operators import profile as P
from gaugeflow.operators.hydro_features import with_station_columns
from gaugeflow.registry.catalog import MOMENT, Tables, at, query
from gaugeflow.sources import html_tables, snapshots, tables

PARSED = """
parts AS (SELECT page_id, html, regexp_extract_all(html, '(?s)<tr>(.*?)</tr>', 1) AS rows FROM {source}),
lines AS (SELECT page_id, unnest(rows[2:]) AS line FROM parts),
cells AS (SELECT page_id, list_transform(regexp_extract_all(line, '(?s)<td[^>]*>(.*?)</td>', 1), lambda c : trim(regexp_replace(c, '<[^>]*>', '', 'g'))) AS c FROM lines)"""
STATION_ROWS = """
SELECT page_id, c[1] AS station_id, c[2] AS station_name, c[3] AS river_name, c[4] AS basin, c[5] AS state,
 TRY_CAST(c[6] AS DOUBLE) AS current_level, TRY_CAST(c[7] AS DOUBLE) AS warning_level, TRY_CAST(c[8] AS DOUBLE) AS danger_level,
 TRY_CAST(c[9] AS DOUBLE) AS highest_flood_level, coalesce(c[10], 'unknown') AS trend FROM cells
WHERE len(c) >= 8 AND TRY_CAST(c[6] AS DOUBLE) IS NOT NULL AND TRY_CAST(c[7] AS DOUBLE) IS NOT NULL AND TRY_CAST(c[8] AS DOUBLE) IS NOT NULL
 AND (len(c) <= 8 OR TRY_CAST(c[9] AS DOUBLE) IS NOT NULL)"""


@query("station_master", """
SELECT format('STN_{:04d}', c_custkey) AS station_id, c_name AS station_name, n_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(t: Tables):
    listing = t.given("customer").join(t.given("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("c_name").alias("Station Name"), F.col("n_name").alias("State name")
    )
    return tables.station_master(listing, "c_custkey")


@query("station_page_rows", "WITH " + PARSED.format(source="scrape_page") + STATION_ROWS, ["scrape_page"])
def _(t: Tables):
    return html_tables.parse_station_pages(t.busy("scrape_page"))


@query("nested_station_page_rows", "WITH " + PARSED.format(source="scrape_page") + ", found AS (" + STATION_ROWS + ") SELECT * FROM found UNION ALL SELECT * FROM found",
       ["scrape_page"])
def _(t: Tables):
    """Station tables inside a cell of a layout table, whose rows they are too."""
    page = F.concat(F.lit("<table><tr><td>menu<tr><td class='a>b'>"), "html", F.lit("<!-- <table> --></td></tr></table>"))
    return html_tables.parse_station_pages(t.busy("scrape_page").withColumn("html", page))


@query("forecast_feed_rows", """
WITH listed AS (SELECT page_id, unnest(from_json(body, '[{"station_id":"VARCHAR","forecast_level":"DOUBLE","forecast_time":"VARCHAR","confidence":"DOUBLE"}]')) AS e
 FROM forecast_feed WHERE json_valid(body)),""" + PARSED.format(source="(SELECT page_id, body AS html FROM forecast_feed WHERE NOT json_valid(body))") + """
SELECT page_id, e.station_id, e.forecast_level, e.forecast_time, e.confidence FROM listed
UNION ALL SELECT page_id, c[1], TRY_CAST(c[2] AS DOUBLE), c[3], TRY_CAST(c[4] AS DOUBLE) FROM cells
WHERE len(c) >= 4 AND TRY_CAST(c[2] AS DOUBLE) IS NOT NULL AND TRY_CAST(c[4] AS DOUBLE) IS NOT NULL""", ["forecast_feed"])
def _(t: Tables):
    return html_tables.parse_forecast_feed(t.busy("forecast_feed"))


@query("source_fallback", "WITH " + PARSED.format(source="scrape_page") + ", found AS (" + STATION_ROWS + """),
crawled AS (SELECT count(*) AS n FROM pages WHERE regexp_matches(html, '(?is)<table.*<td'))
SELECT found.* FROM found, crawled WHERE n = 0""", ["scrape_page"])
def _(t: Tables):
    """The crawled pages hold no station table, so the second source answers."""
    crawled = html_tables.parse_station_pages(t.given("pages"))
    return tables.first_with_rows(crawled, html_tables.parse_station_pages(t.busy("scrape_page")))


@query("newest_batch", "SELECT obs_seq, station_id, current_level FROM obs WHERE CAST(observation_time AS DATE) = (SELECT max(CAST(observation_time AS DATE)) FROM obs)",
       ["obs"], "current_level")
def _(t: Tables):
    rows = t.obs.withColumn("batch", F.to_date("observation_time"))
    return tables.newest_batch(rows, "batch").select("obs_seq", "station_id", "current_level")


@query("live_snapshot", f"""
SELECT station_id, max_by(log_id, struct_pack(f := fetched_at, l := log_id)) AS log_id,
 max_by(rainfall_last_6h_mm, struct_pack(f := fetched_at, l := log_id)) AS rainfall_last_6h_mm
FROM weather_log WHERE kind = 'observed' AND fetched_at >= TIMESTAMP '{MOMENT}' - INTERVAL 24 HOURS AND fetched_at <= TIMESTAMP '{MOMENT}'
GROUP BY station_id""", ["weather_log"], "rainfall_last_6h_mm")
def _(t: Tables):
    return snapshots.live_snapshot(t.weather_log, at(), "observed", ties=("log_id",)).select("station_id", "log_id", "rainfall_last_6h_mm")


@query("live_forecast", f"""
SELECT station_id, rainfall_forecast_next_6h_mm FROM weather WHERE fetched_at >= TIMESTAMP '{MOMENT}' - INTERVAL 3 HOURS AND fetched_at <= TIMESTAMP '{MOMENT}'""",
       ["weather"], "rainfall_forecast_next_6h_mm")
def _(t: Tables):
    return snapshots.live_snapshot(t.weather, at(), ttl_hours=3).select("station_id", "rainfall_forecast_next_6h_mm")


@query("snapshot_status", f"""
SELECT kind, true AS cached, (epoch_us(TIMESTAMP '{MOMENT}') - epoch_us(max(fetched_at))) / 3.6e9 AS age_hours,
 (epoch_us(TIMESTAMP '{MOMENT}') - epoch_us(max(fetched_at))) / 3.6e9 < CASE kind WHEN 'observed' THEN 24 ELSE 3 END AS valid
FROM weather_log GROUP BY kind""", ["weather_log"], "age_hours")
def _(t: Tables):
    return snapshots.snapshot_status(t.weather_log, at())


@query("table_metadata", """
SELECT count(*) AS record_count, count(DISTINCT station_id) AS unique_stations, count(DISTINCT basin) AS unique_basins,
 count(DISTINCT state) AS unique_states, 'gauges' AS source, 'obs_seq,station_id,basin,state' AS columns
FROM obs LEFT JOIN station_dim USING (station_id)""", ["obs", "station_dim"])
def _(t: Tables):
    rows = with_station_columns(t.obs.select("obs_seq", "station_id"), t.station_dim, ["basin", "state"])
    described = P.table_metadata(rows.select("obs_seq", "station_id", "basin", "state"), "gauges")
    return described.withColumn("columns", F.array_join("columns", ",")).drop("data_types")


@query("dataset_profile", """
SELECT count(*) AS total_records, count(DISTINCT station_id) AS stations, count(DISTINCT basin) AS basins, count(DISTINCT state) AS states,
 count(DISTINCT river_name) AS rivers, strftime(min(observation_time), '%Y-%m-%d %H:%M:%S') AS first_time,
 strftime(max(observation_time), '%Y-%m-%d %H:%M:%S') AS last_time FROM obs LEFT JOIN station_dim USING (station_id)""", ["obs", "station_dim"])
def _(t: Tables):
    rows = with_station_columns(t.obs.select("station_id", "observation_time"), t.station_dim, ["basin", "state", "river_name"])
    described = P.dataset_profile(rows)
    return described.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_time", "last_time")})


@query("basin_record_counts", """
SELECT basin, count(*) AS records FROM obs LEFT JOIN station_dim USING (station_id) WHERE basin IS NOT NULL GROUP BY basin
ORDER BY records DESC, basin LIMIT 10""", ["obs", "station_dim"])
def _(t: Tables):
    return P.basin_counts(with_station_columns(t.obs.select("obs_seq", "station_id"), t.station_dim, ["basin"]))
