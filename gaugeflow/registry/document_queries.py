"""Explanations, documents and their checks."""

from pyspark.sql import functions as F

from gaugeflow import fixed_values as V
from gaugeflow.operators import alerts as A, doc_checks as K, documents as D, explain as X, scoring as S
from gaugeflow.registry.alert_queries import HORIZONS, LEVEL
from gaugeflow.registry.catalog import Tables, at, query

# Fixed weights stand in for model importances so that results can be checked.
WEIGHTS = dict(zip(V.HYDRO_FEATURES, (0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.02)))
BY_MODEL = {
    "risk_regressor": WEIGHTS,
    "warning_classifier": dict(zip(V.HYDRO_FEATURES, reversed(WEIGHTS.values()))),
    "risk_tier_classifier": {f: 0.1 for f in V.HYDRO_FEATURES},
}


def pct(x: str, d: int = 1) -> str:
    return f"format('{{:.{d}f}}%', {x} * 100)"


def num(x: str, d: int) -> str:
    return f"format('{{:.{d}f}}', CAST({x} AS DOUBLE))"


def near(x: str, d: int) -> str:
    return f"CAST(format('{{:.{d}f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def text(template: str, **parts: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, value in parts.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


def contributions(weights: dict[str, float]) -> str:
    lines = " UNION ALL ".join(
        f"SELECT obs_seq, {i} AS n, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {f} * {w!r}e0 AS contribution, {w!r}e0 AS importance FROM factors"
        for i, (f, w) in enumerate(weights.items())
    )
    return f"""
entries AS ({lines}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY obs_seq ORDER BY abs(contribution) DESC, n) AS place FROM entries),
best AS (SELECT obs_seq, place, feature, {near('value', 3)} AS value, {near('contribution', 3)} AS contribution, {near('importance', 3)} AS importance
 FROM ranked WHERE place <= 5)"""


def _long(column):
    return F.posexplode(column)


@query("station_importance", """
WITH first AS (SELECT * FROM factors QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY observation_time NULLS LAST, obs_seq) = 1)
""" + " UNION ALL ".join(
    f"SELECT station_id, '{f}' AS feature, {w!r}e0 AS importance, CAST({f} AS DOUBLE) AS value FROM first" for f, w in WEIGHTS.items()), ["factors"], "importance value")
def _(t: Tables):
    return X.station_importance(t.factors, WEIGHTS)


@query("contribution_ranking", f"WITH {contributions(WEIGHTS)} SELECT obs_seq, CAST(place AS INTEGER) AS place, feature, value, contribution, importance FROM best",
       ["factors"], "value contribution importance")
def _(t: Tables):
    rows = t.busy("factors").select("obs_seq", F.posexplode(X.top_factors(WEIGHTS)).alias("place", "f"))
    return rows.select("obs_seq", (F.col("place") + 1).alias("place"), "f.*")


SCORE_TEXT = f"""{text('Risk Score: {risk} ({level}). ', risk=pct('risk_score'), level='upper(' + LEVEL.format(s='risk_score', a='low', b='medium', c='high') + ')')}
 || CASE WHEN distance_to_danger < 0.5 THEN 'Water level is dangerously close to danger threshold. ' WHEN distance_to_danger < 1.0 THEN 'Water level is approaching danger threshold. ' ELSE '' END
 || CASE WHEN rate_of_rise_3h > 0.1 THEN 'Water rising at ' || {num('rate_of_rise_3h', 2)} || 'm/hour. ' ELSE '' END"""
WARNING_TEXT = f"""'Warning Probability: ' || {pct('warning_probability')} || '. ' || CASE WHEN warning_probability > 0.7 THEN 'HIGH' WHEN warning_probability > 0.5 THEN 'MODERATE' ELSE 'LOW' END
 || ' likelihood of flood warning in next 6 hours. ' || CASE WHEN rate_of_rise_3h > 0.15 THEN 'Rapid water level rise detected. ' ELSE '' END"""
TIER_TEXT = """CASE risk_tier_name WHEN 'low' THEN 'Low flood risk. Normal conditions.' WHEN 'medium' THEN 'Moderate flood risk. Monitor water levels closely.'
 WHEN 'high' THEN 'High flood risk. Prepare for potential evacuation.' ELSE 'Unknown risk tier.' END || CASE WHEN distance_to_warning < 0.5 THEN ' Water level near warning threshold.' ELSE '' END"""


@query("score_summaries", f"SELECT obs_seq, {SCORE_TEXT} AS summary FROM factors", ["factors"])
def _(t: Tables):
    return t.busy("factors").select("obs_seq", X.score_summary(F.col("risk_score"), F.col("distance_to_danger"), F.col("rate_of_rise_3h")).alias("summary"))


@query("warning_summaries", f"SELECT obs_seq, {WARNING_TEXT} AS summary FROM factors", ["factors"])
def _(t: Tables):
    return t.busy("factors").select("obs_seq", X.warning_summary(F.col("warning_probability"), F.col("rate_of_rise_3h")).alias("summary"))


@query("tier_summaries", f"SELECT obs_seq, {TIER_TEXT} AS summary FROM factors", ["factors"])
def _(t: Tables):
    return t.busy("factors").select("obs_seq", X.tier_summary(F.col("risk_tier_name"), F.col("distance_to_warning")).alias("summary"))


FACTORS = f"""coalesce(nullif(concat_ws(chr(10), CASE WHEN rate_of_rise_3h > 0.1 THEN '  • Rapid water rise: ' || {num('rate_of_rise_3h', 3)} || 'm/h' END,
 CASE WHEN distance_to_danger < 1.0 THEN '  • Close to danger level: ' || {num('distance_to_danger', 2)} || 'm' END,
 CASE WHEN consecutive_rising_hours > 6 THEN '  • Sustained rise: ' || {num('consecutive_rising_hours', 0)} || ' hours' END,
 CASE WHEN historical_percentile > 80 THEN '  • High historical level: ' || {num('historical_percentile', 0)} || 'th percentile' END), ''),
 '  • No critical factors identified')"""
ADVICE = f"""CASE WHEN risk_tier_name = 'high' OR warning_probability > 0.7 THEN '{V.ADVICE_URGENT}'
 WHEN risk_tier_name = 'medium' OR warning_probability > 0.5 THEN '{V.ADVICE_CAUTION}' ELSE '{V.ADVICE_NORMAL}' END"""


@query("risk_factor_bullets", f"SELECT obs_seq, {FACTORS} AS factors FROM factors", ["factors"])
def _(t: Tables):
    return t.busy("factors").select("obs_seq", X.risk_factors().alias("factors"))


@query("recommendations", f"SELECT obs_seq, {ADVICE} AS advice FROM factors", ["factors"])
def _(t: Tables):
    return t.busy("factors").select("obs_seq", X.recommendation(F.col("risk_tier_name"), F.col("warning_probability")).alias("advice"))


@query("alert_bulletins", "SELECT obs_seq, " + text(
    V.BULLETIN, station="station_name", id="CAST(f.station_id AS VARCHAR)", risk=pct("risk_score"),
    level="upper(" + LEVEL.format(s="risk_score", a="low", b="medium", c="high") + ")", tier="upper(risk_tier_name)", warning=pct("warning_probability"),
    water=num("current_level", 2), to_warning=num("distance_to_warning", 2), to_danger=num("distance_to_danger", 2), rise=num("rate_of_rise_3h", 3),
    trend="CASE WHEN rate_of_rise_3h > 0 THEN 'RISING' ELSE 'FALLING' END", factors=FACTORS, advice=ADVICE,
) + " AS bulletin FROM factors f JOIN station_dim s ON f.station_id = s.station_id", ["factors", "station_dim"])
def _(t: Tables):
    from gaugeflow.operators.hydro_features import with_station_columns
    rows = with_station_columns(t.busy("factors"), t.station_dim, ["station_name"])
    return rows.select("obs_seq", X.bulletin(F.col("station_id"), F.col("station_name")).alias("bulletin"))


def lines(level: str, rise: str = "rate_of_rise_3h", danger: str = "distance_to_danger", water: str = "current_level", extra: str = "NULL") -> str:
    """The explanation list joined by ' | '."""
    risk = pct("risk_score")
    return f"""concat_ws(' | ', CASE {level} WHEN 'HIGH' THEN {text(V.LEVEL_LINE['HIGH'], risk=risk)} WHEN 'MEDIUM' THEN {text(V.LEVEL_LINE['MEDIUM'], risk=risk)} ELSE {text(V.LEVEL_LINE['LOW'], risk=risk)} END,
 CASE WHEN {danger} > 0 AND {danger} < 0.5 THEN {text(V.DANGER_LINES[0][1], value=num(danger, 2))} WHEN {danger} > 0 AND {danger} < 1.0 THEN {text(V.DANGER_LINES[1][1], value=num(danger, 2))}
  WHEN {danger} > 0 AND {danger} < 2.0 THEN {text(V.DANGER_LINES[2][1], value=num(danger, 2))} WHEN {danger} > 0 THEN {text(V.DANGER_LINE_FAR, value=num(danger, 2))}
  ELSE {text(V.DANGER_LINE_OVER, value=num(danger, 2))} END,
 CASE WHEN {rise} > 0.15 THEN {text(V.RISE_LINES[0][1], value=num(rise, 3))} WHEN {rise} > 0.05 THEN {text(V.RISE_LINES[1][1], value=num(rise, 3))}
  WHEN {rise} > 0.01 THEN {text(V.RISE_LINES[2][1], value=num(rise, 3))} ELSE {text(V.RISE_LINE_FLAT, value=num(rise, 3))} END,
 CASE WHEN {water} > 0 THEN {text(V.LEVEL_NOW_LINE, value=num(water, 2))} END, {extra})"""


DOC_LEVEL = "CASE risk_tier_name WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN 'MEDIUM' ELSE 'LOW' END"


@query("explanation_lists", f"SELECT obs_seq, {lines(DOC_LEVEL)} AS explanation FROM pred", ["pred"])
def _(t: Tables):
    rows = t.busy("pred")
    return rows.select("obs_seq", F.array_join(X.explanation_lines(rows, D.document_level(F.col("risk_tier_name"))), " | ").alias("explanation"))


RAIN_TEXT = f"""CASE WHEN rainfall_forecast_next_6h_mm > 0 OR rainfall_forecast_next_24h_mm > 0 THEN concat_ws(' ',
 CASE WHEN rainfall_forecast_next_24h_mm > 50 THEN {text(V.RAIN_HEAVY, value=num('rainfall_forecast_next_24h_mm', 1))}
  WHEN rainfall_forecast_next_24h_mm > 25 THEN {text(V.RAIN_MODERATE, value=num('rainfall_forecast_next_24h_mm', 1))}
  WHEN rainfall_forecast_next_6h_mm > 10 THEN {text(V.RAIN_SOON, value=num('rainfall_forecast_next_6h_mm', 1))} END,
 CASE WHEN rainfall_forecast_next_6h_mm > rainfall_last_6h_mm THEN {text(V.RAIN_INCREASING, before=num('rainfall_last_6h_mm', 1), after=num('rainfall_forecast_next_6h_mm', 1))} END)
 ELSE '' END"""


@query("weather_sentences", f"WITH {HORIZONS} SELECT obs_seq, {RAIN_TEXT} AS sentence FROM horizons", ["pred", "weather"])
def _(t: Tables):
    return S.add_weather_context(t.busy("pred"), t.weather).select("obs_seq", X.weather_sentence().alias("sentence"))


def _explained(model: str, name: str, summary: str) -> str:
    return f"""WITH {contributions(BY_MODEL[model])},
tops AS (SELECT obs_seq, string_agg(feature, ',' ORDER BY place) AS features FROM best GROUP BY obs_seq)
SELECT obs_seq, features AS {name}_features, {summary} AS {name}_summary FROM factors JOIN tops USING (obs_seq)"""


@query("explained_predictions", f"""
SELECT * FROM ({_explained('risk_regressor', 'score', SCORE_TEXT)}) JOIN ({_explained('warning_classifier', 'warning', WARNING_TEXT)}) USING (obs_seq)
JOIN ({_explained('risk_tier_classifier', 'tier', TIER_TEXT)}) USING (obs_seq)""", ["factors"])
def _(t: Tables):
    rows = X.explain_predictions(t.busy("factors"), BY_MODEL)
    parts = {"score": "risk_score_explained", "warning": "warning_explained", "tier": "risk_tier_explained"}
    return rows.select("obs_seq", *[c for n, col in parts.items() for c in (
        F.array_join(F.transform(F.col(f"{col}.top_factors"), lambda e: e["feature"]), ",").alias(f"{n}_features"),
        F.col(f"{col}.summary").alias(f"{n}_summary"),
    )])


CHOSEN = """
lowest AS (SELECT * FROM pred WHERE risk_tier_name = 'low' ORDER BY risk_score, obs_seq LIMIT 3),
chosen AS (SELECT * FROM pred WHERE risk_tier_name IN ('medium', 'high') UNION ALL SELECT * FROM lowest)"""


@query("document_selection", f"WITH {CHOSEN} SELECT obs_seq, risk_tier_name, risk_score FROM chosen", ["pred"], "risk_score")
def _(t: Tables):
    return D.select_for_documents(t.pred).select("obs_seq", "risk_tier_name", "risk_score")


@query("document_counts", """
WITH c AS (SELECT count(*) AS total_processed, count(*) FILTER (WHERE risk_tier_name = 'medium') AS medium_risk_count,
 count(*) FILTER (WHERE risk_tier_name = 'high') AS high_risk_count, count(*) FILTER (WHERE risk_tier_name = 'low') AS low_risk_count FROM pred)
SELECT *, least(3, low_risk_count) AS low_risk_json_generated, medium_risk_count + high_risk_count + least(3, low_risk_count) AS json_generated FROM c""", ["pred"])
def _(t: Tables):
    return D.document_counts(t.pred)


LOCATED = """
located AS (SELECT p.*, coalesce(s.district, s.river_name || ' Basin, ' || s.state, 'Not Available') AS district, coalesce(s.state, 'Unknown') AS state,
 coalesce(s.latitude, 0e0) AS latitude, coalesce(s.longitude, 0e0) AS longitude FROM {source} p LEFT JOIN station_dim s ON p.station_id = s.station_id)"""


@query("document_locations", "WITH " + LOCATED.format(source="pred") + " SELECT obs_seq, district, state, latitude, longitude FROM located", ["pred", "station_dim"], "latitude longitude")
def _(t: Tables):
    return D.resolve_location(t.busy("pred"), t.station_dim).select("obs_seq", "location.*")


def flat(df):
    """Documents as plain columns."""
    doc = df.select("obs_seq", "doc.*")
    return doc.select(
        "obs_seq", "prediction.flood_probability", "prediction.risk_level", "confidence.model_confidence", "confidence.forecast_support",
        "confidence.combined_confidence", F.col("forecast_signal.rainfall_trend").alias("rainfall_trend"), "context.location.district",
        "context.time_window.prediction_time", "context.time_window.valid_until", F.array_join("explanation", " | ").alias("explanation"),
        "metadata.model_type", "metadata.model_version", F.array_join("metadata.data_sources", " | ").alias("data_sources"), "metadata.disclaimer",
    )


CONFIDENCE = "flood_probability model_confidence forecast_support combined_confidence"


@query("hydro_documents", "WITH " + CHOSEN + "," + LOCATED.format(source="chosen") + f"""
SELECT obs_seq, {near('risk_score', 4)} AS flood_probability, {DOC_LEVEL} AS risk_level, {near('(risk_score + warning_probability) / 2', 4)} AS model_confidence,
 0e0 AS forecast_support, {near('(risk_score + warning_probability) / 2 / 2', 4)} AS combined_confidence, CAST(NULL AS VARCHAR) AS rainfall_trend, district,
 '2024-01-31T00:00:00Z' AS prediction_time, '2024-01-31T06:00:00Z' AS valid_until, {lines(DOC_LEVEL)} AS explanation, 'ml_hybrid' AS model_type, '1.0' AS model_version,
 '{V.DOC_SOURCE}' AS data_sources, '{V.DOC_DISCLAIMER}' AS disclaimer FROM located""", ["pred", "station_dim"], CONFIDENCE)
def _(t: Tables):
    return flat(D.prediction_documents(t.busy("pred"), t.station_dim, at()))


@query("forced_documents", f"""
WITH placed AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC NULLS LAST, obs_seq) AS i FROM pred_low),
forced AS (SELECT * REPLACE (CASE WHEN i = 1 THEN 0.75e0 WHEN i <= 3 THEN 0.55e0 ELSE risk_score END AS risk_score, CASE WHEN i = 1 THEN 'high' WHEN i <= 3 THEN 'medium' ELSE 'low' END AS risk_tier_name),
 risk_score AS real_score FROM placed),
lowest AS (SELECT * FROM forced WHERE risk_tier_name = 'low' ORDER BY risk_score, obs_seq LIMIT 3),
chosen AS (SELECT * FROM forced WHERE risk_tier_name <> 'low' UNION ALL SELECT * FROM lowest)
SELECT obs_seq, {near('risk_score', 4)} AS flood_probability, {DOC_LEVEL} AS risk_level,
 {lines(DOC_LEVEL, extra=f"CASE WHEN i <= 3 THEN '{V.DEMO_LINE}' END")} AS explanation, CASE WHEN i <= 3 THEN {near('real_score', 4)} END AS real_risk_score,
 CASE WHEN i <= 3 THEN 'LOW' END AS real_risk_level FROM chosen""", ["pred_low"], "flood_probability real_risk_score")
def _(t: Tables):
    docs = D.prediction_documents(A.force_demo_alerts(t.busy("pred_low")), None, at())
    return docs.select(
        "obs_seq", "doc.prediction.flood_probability", "doc.prediction.risk_level", F.array_join("doc.explanation", " | ").alias("explanation"),
        "doc.metadata.real_risk_score", "doc.metadata.real_risk_level",
    )


WET = HORIZONS + "," + LOCATED.format(source="horizons")
SUPPORT = "least(least(rainfall_forecast_next_24h_mm / 100, 1e0), 0.95e0)"
RAINY = "rainfall_forecast_next_6h_mm > 0"


@query("weather_documents", f"""WITH {WET}
SELECT obs_seq, {near('risk_score', 4)} AS flood_probability, {DOC_LEVEL} AS risk_level,
 CASE WHEN {RAINY} THEN {near('0.75 + risk_score * 0.15', 4)} ELSE {near('(risk_score + warning_probability) / 2', 4)} END AS model_confidence,
 CASE WHEN {RAINY} THEN {near(SUPPORT, 4)} ELSE 0e0 END AS forecast_support,
 CASE WHEN {RAINY} THEN {near(f'((0.75e0 + risk_score * 0.15e0) + {SUPPORT}) / 2', 4)} ELSE {near('(risk_score + warning_probability) / 2 / 2', 4)} END AS combined_confidence,
 CASE WHEN {RAINY} THEN CASE WHEN rainfall_forecast_next_6h_mm > rainfall_last_6h_mm * 1.5e0 THEN 'INCREASING'
  WHEN rainfall_forecast_next_6h_mm < rainfall_last_6h_mm * 0.5e0 THEN 'DECREASING' ELSE 'STABLE' END END AS rainfall_trend, district,
 '2024-01-31T00:00:00Z' AS prediction_time, CASE WHEN {RAINY} THEN '2024-02-01T00:00:00Z' ELSE '2024-01-31T06:00:00Z' END AS valid_until, {lines(DOC_LEVEL)} AS explanation,
 CASE WHEN {RAINY} THEN 'hybrid' ELSE 'ml_hybrid' END AS model_type, CASE WHEN {RAINY} THEN '1.1' ELSE '1.0' END AS model_version,
 CASE WHEN {RAINY} THEN '{V.DOC_SOURCE} | {V.DOC_RAIN_SOURCE}' ELSE '{V.DOC_SOURCE}' END AS data_sources,
 CASE WHEN NOT {RAINY} THEN '{V.DOC_DISCLAIMER}' END AS disclaimer FROM located""", ["pred", "weather", "station_dim"], CONFIDENCE)
def _(t: Tables):
    rows = S.add_weather_context(t.busy("pred"), t.weather)
    return flat(D.build_documents(D.resolve_location(rows, t.station_dim), at()))


@query("extended_documents", f"""WITH {WET}
SELECT obs_seq, {RAINY} AS weather_data_used, CASE WHEN {RAINY} THEN {near('rainfall_last_6h_mm', 2)} END AS last_6h_mm,
 CASE WHEN {RAINY} THEN {near('rainfall_forecast_next_24h_mm', 2)} END AS next_24h_mm, CASE WHEN {RAINY} THEN {near('risk_score_6h', 4)} END AS risk_score_6h,
 CASE WHEN {RAINY} THEN risk_tier_6h END AS risk_level_6h, CASE WHEN {RAINY} THEN {near('risk_score_24h', 4)} END AS risk_score_24h,
 CASE WHEN {RAINY} THEN risk_tier_24h END AS risk_level_24h FROM located""", ["pred", "weather", "station_dim"], "last_6h_mm next_24h_mm risk_score_6h risk_score_24h")
def _(t: Tables):
    rows = S.add_horizons(S.add_weather_context(t.busy("pred"), t.weather))
    docs = D.extend_with_weather(D.build_documents(D.resolve_location(rows, t.station_dim), at()))
    return docs.select(
        "obs_seq", "doc.metadata.weather_data_used", "doc.metadata.rainfall_forecast.last_6h_mm", "doc.metadata.rainfall_forecast.next_24h_mm",
        "doc.prediction.risk_score_6h", "doc.prediction.risk_level_6h", "doc.prediction.risk_score_24h", "doc.prediction.risk_level_24h",
    )


def _found(path: str) -> str:
    return f"json_exists(doc, '$.{path}')"


CHECKED = f"""
typed AS (SELECT obs_seq, doc, json_type(doc, '$.prediction.flood_probability') AS fp, json_extract_string(doc, '$.prediction.risk_level') AS rl,
 json_type(doc, '$.explanation') AS ex FROM doc_text),
checked AS (SELECT obs_seq, concat_ws('; ', CASE WHEN NOT {_found('prediction')} THEN 'Missing top-level key: prediction' END,
 CASE WHEN fp = 'VARCHAR' THEN 'prediction.flood_probability must be numeric'
  WHEN {_found('prediction')} AND NOT CAST(json_extract_string(doc, '$.prediction.flood_probability') AS DOUBLE) BETWEEN 0 AND 1 THEN 'prediction.flood_probability must be between 0 and 1' END,
 CASE WHEN rl NOT IN ('LOW', 'MEDIUM', 'HIGH') THEN 'Invalid risk_level: ' || rl END,
 CASE WHEN NOT {_found('confidence.model_confidence')} THEN 'Missing confidence.model_confidence' END,
 CASE WHEN ex <> 'ARRAY' THEN 'explanation must be a list' WHEN json_array_length(doc, '$.explanation') = 0 THEN 'explanation list is empty'
  WHEN json_type(doc, '$.explanation[1]') <> 'VARCHAR' THEN 'explanation[1] must be string' END,
 CASE WHEN NOT {_found('context.time_window')} THEN 'Missing context.time_window' END,
 CASE WHEN NOT {_found('context.location.longitude')} THEN 'Missing context.location.longitude' END,
 CASE WHEN NOT {_found('metadata.disclaimer')} THEN 'Missing metadata.disclaimer' END) AS errors FROM typed)"""


@query("document_errors", f"WITH {CHECKED} SELECT obs_seq, errors, errors = '' AS is_valid FROM checked", ["doc_text"])
def _(t: Tables):
    return K.check_documents(t.busy("doc_text"), "doc").select("obs_seq", F.array_join("errors", "; ").alias("errors"), "is_valid")


@query("document_report", f"""WITH {CHECKED} SELECT count(*) AS total_files, count(*) FILTER (WHERE errors = '') AS valid_files,
 count(*) FILTER (WHERE errors <> '') AS invalid_files, count(*) FILTER (WHERE errors <> '') = 0 AS valid FROM checked""", ["doc_text"])
def _(t: Tables):
    return K.check_report(K.check_documents(t.busy("doc_text"), "doc"))
