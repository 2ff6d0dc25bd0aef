"""Thresholds, names and texts that results must agree on.

Nothing here is derived; each value is part of the data contract.
"""

# --- validity of a level reading, metres -----------------------------------
LEVEL_MIN = -10.0
LEVEL_MAX = 100.0
JUMP_MAX = 2.0
CENTIMETRE_HINT = 1000.0
CENTIMETRES_PER_METRE = 100.0
OUTLIER_IQR_FACTOR = 1.5
FLAG_MISSING = "MISSING_VALUE;"
FLAG_RANGE = "OUT_OF_RANGE;"
FLAG_JUMP = "SENSOR_ERROR;"

# --- features ---------------------------------------------------------------
RATE_WINDOW_HOURS = 3
LOOKBACK_HOURS = 24
HISTORY_DAYS = 365
RISING_HOURS = {"rising": 3, "falling": 0}
RISING_HOURS_OTHER = 1
LONE_ROW_PERCENTILE = 50.0

HYDRO_FEATURES = (
    "current_level",
    "distance_to_warning",
    "distance_to_danger",
    "rate_of_rise_3h",
    "consecutive_rising_hours",
    "historical_percentile",
    "basin_avg_level",
    "station_volatility",
    "hours_since_last_update",
    "seasonal_factor",
)
RAIN_COLUMNS = (
    "rainfall_last_6h_mm",
    "rainfall_forecast_next_6h_mm",
    "rainfall_forecast_next_24h_mm",
)
WEATHER_FEATURES = RAIN_COLUMNS + (
    "rainfall_intensity_trend",
    "rainfall_runoff_index",
    "saturation_proxy",
    "compound_risk_index",
)
WEATHER_FEATURE_TEXT = {
    "rainfall_last_6h_mm": "Observed rainfall in last 6 hours (mm)",
    "rainfall_forecast_next_6h_mm": "GFS forecast rainfall for next 6 hours (mm)",
    "rainfall_forecast_next_24h_mm": "GFS forecast rainfall for next 24 hours (mm)",
    "rainfall_intensity_trend": "Trend in rainfall intensity (forecast - observed)",
    "rainfall_runoff_index": "Rainfall × station volatility (runoff potential)",
    "saturation_proxy": "Recent rainfall / historical average (basin saturation)",
    "compound_risk_index": "Forecast rainfall × proximity to danger level",
}
DEFAULT_VOLATILITY = 0.5
DEFAULT_RAIN_MEAN = 5.0
DEFAULT_PROXIMITY = 0.5
FLAT_RANGE = 0.01

# --- labels, tiers, training --------------------------------------------------
DANGER_SPAN = 5.0
WARNING_QUANTILE = 0.2
TIER_LOW_END = 0.33
TIER_MEDIUM_END = 0.67
TIER_NAMES = ("low", "medium", "high")
TRAIN_PERCENT = 80
TEMPORAL_TRAIN = 0.70
TEMPORAL_VALIDATION = 0.85
NOISE_SIGMA = 0.05
SEED = 42
TREES = 100
TREE_DEPTH = 5
LEAF_ROWS = 20
ROW_SHARE = 0.8
LEARNING_RATE = 0.1
LOGISTIC_C = 0.3
LOGISTIC_ITERATIONS = 1000
MODEL_NAMES = ("risk_regressor", "warning_classifier", "risk_tier_classifier")

# --- snapshots ------------------------------------------------------------------
FORECAST_TTL_HOURS = 3
OBSERVED_TTL_HOURS = 24

# --- horizons: rainfall divisor and largest uplift ---------------------------------
HORIZON_6H = (50.0, 0.3)
HORIZON_24H = (100.0, 0.5)
MODE_WEATHER = "WEATHER-AWARE"
MODE_HYDRO = "HYDRO-ONLY"

# --- alerts -----------------------------------------------------------------------
SEVERITIES = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")
TRIGGERING = ("MEDIUM", "HIGH", "CRITICAL")
UNKNOWN_STATION = "Unknown Station"
ALERT_TEXT = {
    "CRITICAL": "🚨 CRITICAL FLOOD ALERT - {station}: Risk {risk}, Warning Probability {warning}. IMMEDIATE ACTION REQUIRED.",
    "HIGH": "⚠️ HIGH FLOOD ALERT - {station}: Risk {risk}, Warning Probability {warning}. Prepare for potential evacuation.",
    "MEDIUM": "⚡ MODERATE FLOOD ALERT - {station}: Risk {risk}, Warning Probability {warning}. Monitor situation closely.",
    "LOW": "ℹ️ LOW FLOOD ALERT - {station}: Risk {risk}, Warning Probability {warning}. Continue monitoring.",
    "NONE": "✓ No alert - {station}: Risk {risk}",
}
HIGH_TIER_ALERT_TYPE = "HIGH_FLOOD_RISK"
HIGH_TIER_ALERT_TEXT = (
    "ALERT: HIGH FLOOD RISK\nStation: {station}\nDistrict: {district}\nRisk Score: {risk}\n"
    "Time: {time}Z\nData Source: CWC (Govt. of India)\nDisclaimer: Research/Demo use only"
)
ALERT_LOG_RULE = "\n" + "-" * 70
ALERT_LOG_GAP = "\n\n"
BLANK_WORDS = ("unknown", "nan", "")
PREDICTIVE_ALERT_TYPE = "PREDICTIVE_FLOOD_ALERT"
PREDICTIVE_ALERT_TEXT = "Forecast-based alert (weather-aware)"
FORCED_HIGH_SCORE = 0.75
FORCED_MEDIUM_SCORE = 0.55

# --- explanations ---------------------------------------------------------------------
TOP_FACTORS = 5
SCORE_SUMMARY = "Risk Score: {risk} ({level}). "
SCORE_SUMMARY_CLOSE = "Water level is dangerously close to danger threshold. "
SCORE_SUMMARY_NEAR = "Water level is approaching danger threshold. "
SCORE_SUMMARY_RISE = "Water rising at {rise}m/hour. "
WARNING_SUMMARY = "Warning Probability: {warning}. {likelihood} likelihood of flood warning in next 6 hours. "
WARNING_SUMMARY_RISE = "Rapid water level rise detected. "
TIER_SUMMARY = {
    "low": "Low flood risk. Normal conditions.",
    "medium": "Moderate flood risk. Monitor water levels closely.",
    "high": "High flood risk. Prepare for potential evacuation.",
}
TIER_SUMMARY_OTHER = "Unknown risk tier."
TIER_SUMMARY_NEAR = " Water level near warning threshold."
FACTOR_RISE = "  • Rapid water rise: {value}m/h"
FACTOR_DANGER = "  • Close to danger level: {value}m"
FACTOR_SUSTAINED = "  • Sustained rise: {value} hours"
FACTOR_HISTORY = "  • High historical level: {value}th percentile"
FACTOR_NONE = "  • No critical factors identified"
ADVICE_URGENT = "URGENT: Prepare for potential evacuation. Contact local authorities."
ADVICE_CAUTION = "CAUTION: Monitor situation closely. Be prepared to evacuate if conditions worsen."
ADVICE_NORMAL = "Continue normal monitoring. No immediate action required."
BULLETIN = (
    "\nFLOOD RISK ALERT - {station} (ID: {id})\n" + "=" * 60 + "\n\n"
    "RISK ASSESSMENT:\n- Risk Score: {risk} ({level})\n- Risk Tier: {tier}\n- Warning Probability: {warning}\n\n"
    "CURRENT CONDITIONS:\n- Water Level: {water}m\n- Distance to Warning: {to_warning}m\n"
    "- Distance to Danger: {to_danger}m\n- Rate of Rise (3h): {rise}m/h\n- Trend: {trend}\n\n"
    "KEY RISK FACTORS:\n{factors}\n\nRECOMMENDATION:\n{advice}\n\n"
    "Data Source: Central Water Commission (CWC), Government of India\n"
    "Disclaimer: This alert is for research/demonstration purposes only.\n"
    "Does NOT replace official CWC flood warnings.\n" + "=" * 60 + "\n"
)
LEVEL_LINE = {
    "HIGH": "HIGH FLOOD RISK: Risk score {risk}. Immediate action required.",
    "MEDIUM": "MODERATE FLOOD RISK: Risk score {risk}. Monitor water levels closely.",
    "LOW": "LOW FLOOD RISK: Risk score {risk}. Situation under control.",
}
DANGER_LINES = (
    (0.5, "CRITICAL: Water level is only {value}m below danger threshold."),
    (1.0, "WARNING: Water level is {value}m below danger threshold."),
    (2.0, "CAUTION: Water level is {value}m below danger threshold."),
)
DANGER_LINE_FAR = "Water level is {value}m below danger threshold."
DANGER_LINE_OVER = "Water level is at or above danger threshold (distance: {value}m)."
RISE_LINES = (
    (0.15, "RAPID RISE: Water level rising at {value}m/hour. High risk of flooding."),
    (0.05, "Moderate rise: Water level rising at {value}m/hour."),
    (0.01, "Slow rise: Water level rising at {value}m/hour."),
)
RISE_LINE_FLAT = "Water level stable or falling (change: {value}m/hour)."
LEVEL_NOW_LINE = "Current water level: {value}m."
DEMO_LINE = "Risk level elevated artificially for demonstration/testing purposes."
RAIN_HEAVY = "Heavy rainfall forecasted in next 24 hours ({value}mm). Significant flood risk expected."
RAIN_MODERATE = "Moderate rainfall forecasted in next 24 hours ({value}mm). Monitor water levels closely."
RAIN_SOON = "Rainfall expected in next 6 hours ({value}mm). Water levels may rise."
RAIN_INCREASING = "Rainfall intensity increasing (from {before}mm to {after}mm). Risk may escalate."

# --- documents ---------------------------------------------------------------------------
DOC_SOURCE = "Central Water Commission (CWC), Government of India"
DOC_RAIN_SOURCE = "NOAA GFS"
DOC_DISCLAIMER = "For research and demonstration purposes only. Does NOT replace official CWC flood warnings."
DOC_SIGNAL_SOURCE = "GFS"
HYDRO_DOC_MODEL = ("ml_hybrid", "1.0")
WEATHER_DOC_MODEL = ("hybrid", "1.1")
HYDRO_DOC_HOURS = 6
WEATHER_DOC_HOURS = 24
NO_DISTRICT = "Not Available"
NO_STATE = "Unknown"
LOWEST_DOCUMENTS = 3
DOC_KEYS = ("prediction", "confidence", "explanation", "context", "metadata")
DOC_LOCATION_KEYS = ("district", "state", "latitude", "longitude")
DOC_WINDOW_KEYS = ("prediction_time", "valid_until")
DOC_METADATA_KEYS = ("model_type", "model_version", "data_sources", "disclaimer")
DOC_METADATA_KEYS_STRICT = ("model_type", "model_version", "data_source", "disclaimer")
DOC_LEVELS = ("LOW", "MEDIUM", "HIGH")
