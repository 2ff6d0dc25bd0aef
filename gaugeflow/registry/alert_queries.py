"""Derived prediction columns and alerts."""

from pyspark.sql import functions as F

from gaugeflow.fixed_values import ALERT_TEXT, RAIN_COLUMNS
from gaugeflow.operators import alerts as A, profile as P, scoring as S
from gaugeflow.registry.catalog import MOMENT, Tables, at, query

LEVEL = "CASE WHEN {s} < 0.33 THEN '{a}' WHEN {s} < 0.67 THEN '{b}' ELSE '{c}' END"
SEVERITY = """CASE WHEN risk_score > 0.8 AND warning_probability > 0.7 THEN 'CRITICAL' WHEN risk_tier_name = 'high' OR warning_probability > 0.7 THEN 'HIGH'
 WHEN risk_tier_name = 'medium' OR warning_probability > 0.5 THEN 'MEDIUM' WHEN warning_probability > 0.3 THEN 'LOW' ELSE 'NONE' END"""
RANK = "CASE alert_severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
ASSESSED = f"""
levels AS (SELECT *, {SEVERITY} AS alert_severity FROM pred),
assessed AS (SELECT *, alert_severity IN ('MEDIUM', 'HIGH', 'CRITICAL') AS alert_triggered FROM levels),
alerts AS (SELECT * FROM assessed WHERE alert_triggered)"""


def _percent(column: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}%', {column} * 100)"


def message(station: str) -> str:
    """The alert text as SQL, one branch per severity."""
    def text(word: str) -> str:
        out = "'" + ALERT_TEXT[word] + "'"
        for name, value in (("station", station), ("risk", _percent("risk_score", 0)), ("warning", _percent("warning_probability", 0))):
            out = out.replace("{" + name + "}", f"' || {value} || '")
        return out
    return "CASE alert_severity " + " ".join(f"WHEN '{w}' THEN {text(w)}" for w in ("CRITICAL", "HIGH", "MEDIUM", "LOW")) + f" ELSE {text('NONE')} END"


RAIN = ", ".join(f"coalesce(w.{c}, 0e0) AS {c}" for c in RAIN_COLUMNS)
HORIZONS = f"""
rainy AS (SELECT p.*, {RAIN} FROM pred p LEFT JOIN weather w ON p.station_id = w.station_id),
ahead AS (SELECT *, greatest(0e0, least(1e0, risk_score + least(rainfall_forecast_next_6h_mm / 50, 0.3e0))) AS risk_score_6h,
 greatest(0e0, least(1e0, risk_score + least(rainfall_forecast_next_24h_mm / 100, 0.5e0))) AS risk_score_24h FROM rainy),
horizons AS (SELECT *, risk_tier_name AS risk_tier_now, {LEVEL.format(s='risk_score_6h', a='LOW', b='MEDIUM', c='HIGH')} AS risk_tier_6h,
 {LEVEL.format(s='risk_score_24h', a='LOW', b='MEDIUM', c='HIGH')} AS risk_tier_24h FROM ahead)"""


def _horizons(t: Tables):
    return S.add_horizons(S.add_weather_context(t.pred, t.weather))


@query("risk_levels", f"SELECT obs_seq, {LEVEL.format(s='risk_score', a='low', b='medium', c='high')} AS risk_level FROM pred", ["pred"])
def _(t: Tables):
    return t.pred.select("obs_seq", S.risk_level(F.col("risk_score")).alias("risk_level"))


@query("tier_names", """SELECT obs_seq, CASE risk_tier WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'unknown' END AS tier_name,
 CASE risk_tier + 1 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'unknown' END AS next_name FROM pred""", ["pred"])
def _(t: Tables):
    return t.pred.select("obs_seq", S.tier_name(F.col("risk_tier")).alias("tier_name"), S.tier_name(F.col("risk_tier") + 1).alias("next_name"))


@query("weather_context", f"SELECT obs_seq, p.station_id, {RAIN} FROM pred p LEFT JOIN weather w ON p.station_id = w.station_id", ["pred", "weather"], " ".join(RAIN_COLUMNS))
def _(t: Tables):
    return S.add_weather_context(t.pred, t.weather).select("obs_seq", "station_id", *RAIN_COLUMNS)


@query("risk_horizons", f"WITH {HORIZONS} SELECT obs_seq, risk_score AS risk_score_now, risk_tier_now, risk_score_6h, risk_score_24h FROM horizons",
       ["pred", "weather"], "risk_score_now risk_score_6h risk_score_24h")
def _(t: Tables):
    return _horizons(t).select("obs_seq", "risk_score_now", "risk_tier_now", "risk_score_6h", "risk_score_24h")


@query("horizon_tiers", f"WITH {HORIZONS} SELECT obs_seq, risk_tier_6h, risk_tier_24h FROM horizons", ["pred", "weather"])
def _(t: Tables):
    return _horizons(t).select("obs_seq", "risk_tier_6h", "risk_tier_24h")


@query("prediction_modes", "SELECT obs_seq, 'WEATHER-AWARE' AS prediction_mode, true AS weather_data_used FROM pred", ["pred"])
def _(t: Tables):
    return S.add_mode(t.pred, True).select("obs_seq", "prediction_mode", "weather_data_used")


@query("alert_severity", f"WITH {ASSESSED} SELECT obs_seq, alert_severity FROM assessed", ["pred"])
def _(t: Tables):
    return A.assess(t.pred).select("obs_seq", "alert_severity")


@query("triggered_alerts", f"WITH {ASSESSED} SELECT obs_seq, station_id, alert_severity, alert_triggered FROM alerts", ["pred"])
def _(t: Tables):
    return A.assess(t.pred).filter("alert_triggered").select("obs_seq", "station_id", "alert_severity", "alert_triggered")


@query("alert_messages", f"WITH {ASSESSED} SELECT obs_seq, {message(chr(39) + 'Unknown Station' + chr(39))} AS alert_message FROM assessed", ["pred"])
def _(t: Tables):
    return A.with_messages(A.assess(t.busy("pred"))).select("obs_seq", "alert_message")


@query("alerts_with_station", f"""WITH {ASSESSED} SELECT obs_seq, alerts.station_id, {message("station_name")} AS alert_message, station_name, river_name, state,
 '2024-01-31T00:00:00' AS alert_timestamp FROM alerts LEFT JOIN station_dim s ON alerts.station_id = s.station_id""", ["pred", "station_dim"])
def _(t: Tables):
    rows = A.generate_alerts(t.busy("pred"), t.station_dim, at(), name_first=True)
    return rows.select("obs_seq", "station_id", "alert_message", "station_name", "river_name", "state", "alert_timestamp")


@query("alerts_by_severity", f"WITH {ASSESSED} SELECT obs_seq, alert_severity FROM assessed WHERE {RANK} >= 3", ["pred"])
def _(t: Tables):
    return A.filter_by_severity(A.assess(t.pred), "HIGH").select("obs_seq", "alert_severity")


@query("alerts_by_state", f"""WITH {ASSESSED} SELECT obs_seq, state FROM alerts LEFT JOIN station_dim s ON alerts.station_id = s.station_id
WHERE state IN ('NATION_2', 'NATION_17', 'NATION_19')""", ["pred", "station_dim"])
def _(t: Tables):
    rows = A.generate_alerts(t.pred, t.station_dim)
    return A.filter_by_states(rows, ["NATION_2", "NATION_17", "NATION_19"]).select("obs_seq", "state")


@query("top_alerts", f"WITH {ASSESSED} SELECT obs_seq, alert_severity, {RANK} AS severity_rank, risk_score FROM alerts ORDER BY severity_rank DESC, risk_score DESC, obs_seq LIMIT 10",
       ["pred"], "risk_score")
def _(t: Tables):
    return A.prioritize(A.assess(t.pred).filter("alert_triggered"), 10).select("obs_seq", "alert_severity", "severity_rank", "risk_score")


@query("alert_summary", f"""WITH {ASSESSED} SELECT count(*) AS total_alerts, count(*) FILTER (WHERE alert_severity = 'CRITICAL') AS critical_count,
 count(*) FILTER (WHERE alert_severity = 'HIGH') AS high_count, count(*) FILTER (WHERE alert_severity = 'MEDIUM') AS medium_count,
 avg(risk_score) AS avg_risk_score, avg(warning_probability) AS avg_warning_prob FROM alerts""", ["pred"], "avg_risk_score avg_warning_prob")
def _(t: Tables):
    return A.alert_summary(A.assess(t.pred).filter("alert_triggered"))


@query("severity_distribution", f"WITH {ASSESSED} SELECT alert_severity, count(*) AS alerts FROM alerts GROUP BY alert_severity", ["pred"])
def _(t: Tables):
    return A.severity_distribution(A.assess(t.pred).filter("alert_triggered"))


@query("alert_history", f"WITH {ASSESSED} SELECT obs_seq, station_id, alert_severity FROM alerts ORDER BY observation_time DESC, obs_seq DESC LIMIT 100", ["pred"])
def _(t: Tables):
    rows = A.assess(t.pred).filter("alert_triggered")
    return A.alert_history(rows, 100, time="observation_time").select("obs_seq", "station_id", "alert_severity")


@query("high_tier_alerts", f"""
SELECT obs_seq, p.station_id, 'Unknown Station' AS station_name, coalesce(district, 'Unknown') AS district, risk_score, 'HIGH_FLOOD_RISK' AS alert_type,
 '2024-01-31T00:00:00Z' AS timestamp,
 concat('ALERT: HIGH FLOOD RISK', chr(10), 'Station: Unknown Station', chr(10), 'District: ', coalesce(district, 'Unknown'), chr(10), 'Risk Score: ',
  {_percent("risk_score", 1)}, chr(10), 'Time: 2024-01-31T00:00:00Z', chr(10), 'Data Source: CWC (Govt. of India)', chr(10), 'Disclaimer: Research/Demo use only') AS message
FROM pred p LEFT JOIN station_dim s ON p.station_id = s.station_id WHERE risk_tier_name = 'high'""", ["pred", "station_dim"], "risk_score")
def _(t: Tables):
    return A.high_tier_alerts(t.busy("pred"), t.station_dim, at())


@query("predictive_alerts", f"""WITH {HORIZONS} SELECT obs_seq, CASE WHEN risk_tier_6h = 'HIGH' OR risk_tier_24h = 'HIGH' THEN 'PREDICTIVE_FLOOD_ALERT' END AS alert_type,
 CASE WHEN risk_tier_6h = 'HIGH' THEN 6 WHEN risk_tier_24h = 'HIGH' THEN 24 END AS horizon_hours FROM horizons""", ["pred", "weather"])
def _(t: Tables):
    rows = A.predictive_flag(_horizons(t), at())
    return rows.select("obs_seq", F.col("alerts")[0]["type"].alias("alert_type"), F.col("alerts")[0]["horizon_hours"].alias("horizon_hours"))


def _forced(source: str) -> str:
    return f"""
WITH quiet AS (SELECT count(*) FILTER (WHERE risk_tier_name IN ('medium', 'high')) = 0 AS q FROM {source}),
placed AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC NULLS LAST, obs_seq) AS i FROM {source})
SELECT obs_seq, CASE WHEN q AND i = 1 THEN 0.75e0 WHEN q AND i <= 3 THEN 0.55e0 ELSE risk_score END AS risk_score,
 CASE WHEN q AND i = 1 THEN 'high' WHEN q AND i <= 3 THEN 'medium' ELSE risk_tier_name END AS risk_tier_name,
 CASE WHEN q THEN risk_score END AS real_risk_score, CASE WHEN q THEN risk_tier_name END AS real_risk_level, q AND i <= 3 AS demo_mode,
 CASE WHEN NOT q THEN 'natural' WHEN i = 1 THEN 'forced_high' WHEN i <= 3 THEN 'forced_medium' END AS alert_mode FROM placed, quiet"""


@query("forced_demo_alerts", _forced("pred_low"), ["pred_low"], "risk_score real_risk_score")
def _(t: Tables):
    return A.force_demo_alerts(t.pred_low).select(
        "obs_seq", "risk_score", "risk_tier_name", "real_risk_score", "real_risk_level", "demo_mode", "alert_mode"
    )


@query("natural_demo_alerts", _forced("pred"), ["pred"], "risk_score real_risk_score")
def _(t: Tables):
    return A.force_demo_alerts(t.pred).select(
        "obs_seq", "risk_score", "risk_tier_name", "real_risk_score", "real_risk_level", "demo_mode", "alert_mode"
    )


@query("cycle_statistics", """
WITH c AS (SELECT strftime(observation_time, '%Y-%m-%d') AS cycle, count(*) AS total_predictions, count(*) FILTER (WHERE risk_tier_name = 'high') AS high_risk_count,
 count(*) FILTER (WHERE risk_tier_name = 'medium') AS medium_risk_count, count(*) FILTER (WHERE risk_tier_name = 'low') AS low_risk_count FROM pred GROUP BY ALL)
SELECT *, least(3, low_risk_count) AS low_risk_documents, high_risk_count + medium_risk_count + least(3, low_risk_count) AS documents,
 high_risk_count AS alerts_triggered FROM c""", ["pred"])
def _(t: Tables):
    return A.cycle_statistics(t.pred.withColumn("cycle", F.date_format("observation_time", "yyyy-MM-dd")), by="cycle")


@query("tier_distribution", f"""WITH {HORIZONS}, tiers AS (SELECT 'now' AS horizon, risk_tier_now AS tier FROM horizons UNION ALL SELECT '6h', risk_tier_6h FROM horizons
 UNION ALL SELECT '24h', risk_tier_24h FROM horizons) SELECT horizon, tier, count(*) AS stations FROM tiers GROUP BY horizon, tier""", ["pred", "weather"])
def _(t: Tables):
    return P.tier_distribution(_horizons(t))


ATTENTION = f"""
aged AS (SELECT *, last_value(struct_pack(v := current_level)) OVER (PARTITION BY station_id ORDER BY observation_time
 RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 3 HOURS PRECEDING).v AS old_level,
 coalesce(abs(current_level - lag(current_level) OVER (PARTITION BY station_id ORDER BY observation_time NULLS LAST, obs_seq)) > 2.0, false) AS is_jump FROM obs),
valid AS (SELECT *, danger_level - current_level AS distance_to_danger,
 CASE WHEN (current_level - old_level) / 3 > 0 THEN (current_level - old_level) / 3 ELSE 0e0 END AS rate_of_rise_3h FROM aged
 WHERE current_level BETWEEN -10 AND 100 AND NOT is_jump),
newest AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY observation_time DESC, obs_seq DESC) = 1)"""


@query("stations_needing_attention", f"""WITH {ATTENTION}, s AS (SELECT *, greatest(0e0, least(1e0, 1 - distance_to_danger / 5)) AS risk_score FROM newest)
SELECT station_id, obs_seq, current_level, distance_to_danger, rate_of_rise_3h, risk_score, {LEVEL.format(s='risk_score', a='low', b='medium', c='high')} AS risk_level
FROM s ORDER BY risk_score DESC, rate_of_rise_3h DESC, station_id LIMIT 20""", ["obs"], "current_level distance_to_danger rate_of_rise_3h risk_score")
def stations_needing_attention(t: Tables):
    """Newest valid reading per station, ranked by closeness to danger and rate of rise."""
    from gaugeflow.operators.cleaning import validate_levels
    from gaugeflow.operators.hydro_features import distances, rate_of_rise
    from gaugeflow.operators.labels import risk_score
    from gaugeflow.operators.ordered import timed
    from gaugeflow.operators.stations import latest_per_station

    rows = rate_of_rise(validate_levels(timed(t.obs), hot=t.hot), hot=t.hot)
    newest = latest_per_station(distances(rows.filter("is_valid")), "observation_time", "obs_seq")
    scored = newest.withColumn("risk_score", risk_score(F.col("distance_to_danger")))
    return scored.withColumn("risk_level", S.risk_level(F.col("risk_score"))).orderBy(
        F.col("risk_score").desc(), F.col("rate_of_rise_3h").desc(), "station_id"
    ).limit(20).select("station_id", "obs_seq", "current_level", "distance_to_danger", "rate_of_rise_3h", "risk_score", "risk_level")


assert MOMENT == "2024-01-31 00:00:00"  # the texts above spell it out
