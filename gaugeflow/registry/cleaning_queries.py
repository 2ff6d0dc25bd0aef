"""Cleaning operators."""

from pyspark.sql import functions as F

from gaugeflow.operators import cleaning as C
from gaugeflow.registry.catalog import Tables, query

JUMPS = """
jumps AS (SELECT *, coalesce(abs(current_level - lag(current_level) OVER (PARTITION BY station_id ORDER BY observation_time NULLS LAST, obs_seq)) > 2.0, false) AS is_jump FROM {source})"""

FLAGGED = JUMPS + """,
flagged AS (SELECT *, concat(CASE WHEN current_level IS NULL THEN 'MISSING_VALUE;' ELSE '' END,
 CASE WHEN current_level < -10 OR current_level > 100 THEN 'OUT_OF_RANGE;' ELSE '' END,
 CASE WHEN is_jump THEN 'SENSOR_ERROR;' ELSE '' END) AS validation_flags FROM jumps)"""

ORDER = "PARTITION BY station_id ORDER BY observation_time NULLS LAST, obs_seq"


def interpolated(source: str, name: str = "filled", column: str = "current_level") -> str:
    """CTEs that interpolate one column by row position."""
    return f"""
placed AS (SELECT *, row_number() OVER ({ORDER}) AS i FROM {source}),
around AS (SELECT *,
 last_value(CASE WHEN {column} IS NOT NULL THEN i END IGNORE NULLS) OVER b AS li, last_value({column} IGNORE NULLS) OVER b AS lv,
 first_value(CASE WHEN {column} IS NOT NULL THEN i END IGNORE NULLS) OVER a AS hi, first_value({column} IGNORE NULLS) OVER a AS hv
 FROM placed WINDOW b AS (PARTITION BY station_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 a AS (PARTITION BY station_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT * REPLACE (CASE WHEN {column} IS NOT NULL THEN {column} WHEN li IS NOT NULL AND hi IS NOT NULL
 THEN lv + (hv - lv) * ((i - li) / CAST(hi - li AS DOUBLE)) ELSE coalesce(lv, hv) END AS {column}) FROM around)"""


@query("missing_levels", "SELECT obs_seq, station_id, current_level IS NULL AS is_missing FROM obs", ["obs"])
def _(t: Tables):
    return t.obs.select("obs_seq", "station_id", C.is_missing(F.col("current_level")).alias("is_missing"))


@query("out_of_range_levels",
       "SELECT obs_seq, station_id, coalesce(current_level < -10 OR current_level > 100, false) AS is_out_of_range FROM obs", ["obs"])
def _(t: Tables):
    return t.obs.select("obs_seq", "station_id", C.is_out_of_range(F.col("current_level")).alias("is_out_of_range"))


@query("sensor_jumps", "WITH " + JUMPS.format(source="obs") + " SELECT obs_seq, station_id, is_jump FROM jumps", ["obs"])
def _(t: Tables):
    return C.flag_jumps(t.obs, hot=t.hot).select("obs_seq", "station_id", "is_jump")


@query("validation_flags", "WITH " + FLAGGED.format(source="obs") +
       " SELECT obs_seq, station_id, validation_flags, validation_flags = '' AS is_valid FROM flagged", ["obs"])
def _(t: Tables):
    return C.validate_levels(t.obs, hot=t.hot).select("obs_seq", "station_id", "validation_flags", "is_valid")


@query("validation_report", "WITH " + FLAGGED.format(source="obs") + """
SELECT count(*) AS total_records, count(*) FILTER (WHERE current_level < -10 OR current_level > 100) AS invalid_levels,
 count(*) FILTER (WHERE current_level IS NULL) AS missing_values, count(*) FILTER (WHERE is_jump) AS sensor_errors,
 count(*) FILTER (WHERE validation_flags <> '') AS flagged_records FROM flagged""", ["obs"])
def _(t: Tables):
    return C.validation_report(C.validate_levels(t.obs, hot=t.hot))


@query("interpolated_levels", "WITH " + interpolated("obs") + " SELECT obs_seq, station_id, current_level FROM filled", ["obs"], "current_level")
def _(t: Tables):
    return C.fill_gaps(t.obs, "interpolate", ("current_level",), hot=t.hot).select("obs_seq", "station_id", "current_level")


@query("forward_filled_levels", f"""
SELECT obs_seq, station_id, last_value(current_level IGNORE NULLS) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_level
FROM obs""", ["obs"], "current_level")
def _(t: Tables):
    return C.fill_gaps(t.obs, "forward_fill", hot=t.hot).select("obs_seq", "station_id", "current_level")


@query("rows_with_levels", "SELECT obs_seq, station_id, current_level FROM obs WHERE current_level IS NOT NULL", ["obs"], "current_level")
def _(t: Tables):
    return C.fill_gaps(t.obs, "drop").select("obs_seq", "station_id", "current_level")


@query("normalized_units", """
SELECT obs_seq, CASE WHEN (SELECT max(current_level) FROM obs_cm) > 1000 THEN current_level / 100 ELSE current_level END AS current_level,
 CASE WHEN (SELECT max(warning_level) FROM obs_cm) > 1000 THEN warning_level / 100 ELSE warning_level END AS warning_level,
 CASE WHEN (SELECT max(danger_level) FROM obs_cm) > 1000 THEN danger_level / 100 ELSE danger_level END AS danger_level,
 CASE WHEN (SELECT max(highest_flood_level) FROM obs_cm) > 1000 THEN highest_flood_level / 100 ELSE highest_flood_level END AS highest_flood_level
FROM obs_cm""", ["obs_cm"], "current_level warning_level danger_level highest_flood_level")
def _(t: Tables):
    return C.normalize_units(t.obs_cm).select("obs_seq", "current_level", "warning_level", "danger_level", "highest_flood_level")


@query("level_outliers", """
WITH q AS (SELECT quantile_cont(current_level, 0.25) AS a, quantile_cont(current_level, 0.75) AS b FROM obs)
SELECT obs_seq, station_id, coalesce(current_level < a - 1.5 * (b - a) OR current_level > b + 1.5 * (b - a), false) AS is_outlier FROM obs, q""", ["obs"])
def _(t: Tables):
    return C.detect_outliers(t.obs).select("obs_seq", "station_id", "is_outlier")


CLEANED = FLAGGED.format(source="obs") + "," + interpolated("flagged") + """,
quartiles AS (SELECT quantile_cont(current_level, 0.25) AS a, quantile_cont(current_level, 0.75) AS b FROM filled),
cleaned AS (SELECT *, validation_flags = '' AS is_valid,
 coalesce(current_level < a - 1.5 * (b - a) OR current_level > b + 1.5 * (b - a), false) AS is_outlier FROM filled, quartiles)"""


@query("cleaned_observations", "WITH " + CLEANED + " SELECT obs_seq, station_id, current_level, warning_level, danger_level, validation_flags, is_valid, is_outlier FROM cleaned",
       ["obs"], "current_level warning_level danger_level")
def _(t: Tables):
    return C.clean(t.obs, hot=t.hot).select(
        "obs_seq", "station_id", "current_level", "warning_level", "danger_level", "validation_flags", "is_valid", "is_outlier"
    )


@query("quality_counts", "WITH " + CLEANED + """
SELECT count(*) FILTER (WHERE is_valid) AS valid_records, count(*) FILTER (WHERE NOT is_valid) AS invalid_records,
 count(*) FILTER (WHERE is_outlier) AS outliers FROM cleaned""", ["obs"])
def _(t: Tables):
    return C.quality_counts(C.clean(t.obs, hot=t.hot))


@query("coerced_times", """
SELECT event_id AS obs_seq, strftime(CASE WHEN event_id % 10 = 0 THEN NULL ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS observation_time FROM events""")
def _(t: Tables):
    text = F.when(F.col("event_id") % 10 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = C.coerce_time(t.given("events").select(F.col("event_id").alias("obs_seq"), text.alias("timestamp")), "timestamp")
    return rows.select("obs_seq", F.date_format("observation_time", "yyyy-MM-dd HH:mm:ss").alias("observation_time"))
