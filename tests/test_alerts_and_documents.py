"""Alerts, explanations and documents."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gaugeflow import fixed_values as V
from gaugeflow.operators import alerts as A, doc_checks as K, documents as D, explain as X, profile as P, scoring as S

def moment():
    return F.lit("2024-01-31 00:00:00.250").cast("timestamp")


PRED = ("obs_seq int, station_id string, observation_time timestamp, risk_score double, warning_probability double, risk_tier int, risk_tier_name string, "
        "distance_to_danger double, distance_to_warning double, rate_of_rise_3h double, current_level double")


def pred(spark, *rows):
    """(score, probability, tier name) rows."""
    t = dt.datetime(2024, 1, 1)
    tiers = {"low": 0, "medium": 1, "high": 2}
    return spark.createDataFrame(
        [(i, f"s{i % 3}", t, s, None if p is None else float(p), tiers.get(str(n).lower()), n, 1.5, 0.25, 0.12, 8.0) for i, (s, p, n) in enumerate(rows)], PRED
    )


def test_severity_bands(spark):
    rows = [(0.81, 0.71, "low"), (0.8, 0.71, "low"), (0.1, 0.1, "high"), (0.1, 0.1, "HIGH"), (0.1, 0.51, "low"), (0.1, 0.5, "low"),
            (0.1, 0.3, "low"), (None, None, None), (0.9, 0.7, "medium")]
    got = [r.alert_severity for r in A.assess(pred(spark, *rows)).orderBy("obs_seq").collect()]
    assert got == ["CRITICAL", "HIGH", "HIGH", "NONE", "MEDIUM", "LOW", "NONE", "NONE", "MEDIUM"]


def test_alert_text_and_half_even_percent(spark):
    df = A.with_messages(A.assess(pred(spark, (0.125, 0.705, "low"), (None, 0.1, "low"))))
    first, second = [r.alert_message for r in df.orderBy("obs_seq").collect()]
    assert first == f"⚠️ HIGH FLOOD ALERT - Unknown Station: Risk {0.125:.0%}, Warning Probability {0.705:.0%}. Prepare for potential evacuation."
    assert second == "✓ No alert - Unknown Station: Risk nan%"


def test_alert_join_order_and_fan_out(spark):
    dim = spark.createDataFrame([("s0", "North", "R", "ST"), ("s0", "South", "R", "ST")], "station_id string, station_name string, river_name string, state string")
    df = pred(spark, (0.9, 0.9, "high"), (0.9, 0.9, "high"))
    plain = A.generate_alerts(df, dim, moment()).orderBy("obs_seq").collect()
    assert len(plain) == 2 and "Unknown Station" in plain[0].alert_message and plain[0].station_name == "North"
    assert plain[0].alert_timestamp == "2024-01-31T00:00:00.250000"
    named = A.generate_alerts(df, dim, moment(), name_first=True).orderBy("obs_seq").collect()
    assert "North" in named[0].alert_message and named[1].station_name is None


def test_filters_ranking_summary(spark):
    df = A.assess(pred(spark, (0.9, 0.9, "high"), (0.2, 0.6, "low"), (0.7, 0.2, "high"), (0.7, 0.2, "high"), (0.1, 0.0, "low")))
    assert [r.obs_seq for r in A.prioritize(df, 3).collect()] == [0, 2, 3]
    assert A.filter_by_severity(df, "HIGH").count() == 3 and A.filter_by_severity(df, "odd").count() == 5
    s = A.alert_summary(df.filter("alert_triggered")).first()
    assert (s.total_alerts, s.critical_count, s.high_count, s.medium_count) == (4, 1, 2, 1)
    assert A.filter_by_states(df.withColumn("state", F.lit("X")), ["Y"]).isEmpty()
    assert A.alert_summary(df.limit(0)).first().total_alerts == 0


def test_high_tier_alert_districts(spark):
    dim = spark.createDataFrame([("s0", " nan "), ("s1", "  "), ("s2", " Delta ")], "station_id string, district string")
    got = A.high_tier_alerts(pred(spark, (0.9, 0.1, "HIGH"), (0.9, 0.1, "high"), (0.0625, 0.1, "High"), (0.9, 0.9, "low")), dim, moment()).orderBy("obs_seq").collect()
    assert [r.district for r in got] == ["Unknown", "Unknown", "Delta"]
    assert "Risk Score: 6.2%\n" in got[2].message and got[0].message.startswith("ALERT: HIGH FLOOD RISK\nStation: Unknown Station\n")
    assert A.high_tier_alerts(pred(spark, (0.9, 0.1, "high")), None, moment()).first().district == "Unknown"


def test_demo_override_only_without_real_alerts(spark):
    quiet = A.force_demo_alerts(pred(spark, (0.1, 0, "low"), (0.3, 0, "low"), (0.3, 0, "low"), (0.2, 0, "low"))).orderBy("obs_seq").collect()
    assert [(r.risk_tier_name, r.risk_score, r.demo_mode) for r in quiet] == [
        ("low", 0.1, False), ("high", 0.75, True), ("medium", 0.55, True), ("medium", 0.55, True)]
    assert quiet[1].real_risk_score == 0.3 and quiet[0].alert_mode is None
    busy = A.force_demo_alerts(pred(spark, (0.1, 0, "low"), (0.3, 0, "MEDIUM"))).collect()
    assert all(r.alert_mode == "natural" and not r.demo_mode and r.real_risk_score is None for r in busy)


def test_horizons_and_missing_rain(spark):
    df = pred(spark, (0.5, 0, "medium"), (0.9, 0, "high")).withColumns({
        "rainfall_forecast_next_6h_mm": F.lit(10.0), "rainfall_forecast_next_24h_mm": F.lit(90.0)})
    a, b = S.add_horizons(df).orderBy("obs_seq").collect()
    assert (a.risk_score_6h, a.risk_score_24h, a.risk_tier_6h, a.risk_tier_24h) == (0.7, 1.0, "HIGH", "HIGH")
    plain = S.add_horizons(pred(spark, (0.33, 0, "low"), (0.67, 0, "medium"))).orderBy("obs_seq").collect()
    assert [(r.risk_score_6h, r.risk_tier_24h) for r in plain] == [(0.33, "MEDIUM"), (0.67, "HIGH")]
    flagged = A.predictive_flag(S.add_horizons(df), moment()).orderBy("obs_seq").first()
    assert flagged.alerts[0].horizon_hours == 6 and flagged.alerts[0].timestamp.endswith("Z")
    assert P.tier_distribution(S.add_horizons(df)).count() == 4


def test_contributions_rank_and_round(spark):
    df = spark.createDataFrame([(1, 2.0, -30.0, 0.12345)], "obs_seq int, a double, b double, c double")
    got = df.select(X.top_factors({"a": 0.5, "b": 0.25, "c": 0.25}, 2).alias("t")).first().t
    assert [(e.feature, e.value, e.contribution, e.importance) for e in got] == [("b", -30.0, -7.5, 0.25), ("a", 2.0, 1.0, 0.5)]


def test_locations_fall_back(spark):
    dim = spark.createDataFrame([("s0", "ST", 1.0, 2.0, "unknown", "R"), ("s1", None, None, 2.0, None, None)],
                                "station_id string, state string, latitude double, longitude double, district string, river_name string")
    rows = pred(spark, (0.1, 0, "low"), (0.1, 0, "low"), (0.1, 0, "low"))
    got = [r.location for r in D.resolve_location(rows, dim).orderBy("obs_seq").collect()]
    assert [tuple(g) for g in got] == [("R Basin, ST", "ST", 1.0, 2.0), ("Not Available", "Unknown", 0.0, 2.0), ("Not Available", "Unknown", 0.0, 0.0)]
    named = D.resolve_location(rows.withColumn("station_name", F.lit("Agra, UP")), dim).collect()
    assert {r.location.district for r in named} == {"Agra"}


def test_documents_pass_their_checks(spark):
    rows = pred(spark, (0.2, 0.1, "low"), (0.5, 0.4, "medium"), (0.9, 0.8, "high"))
    dry = D.as_json(D.prediction_documents(rows, None, moment()))
    assert K.check_documents(dry).filter("NOT is_valid").isEmpty()
    strict = K.check_documents(dry, metadata_keys=V.DOC_METADATA_KEYS_STRICT).first()
    assert strict.errors == ["Missing metadata.data_source"]
    wet = rows.withColumns({"rainfall_last_6h_mm": F.lit(1.0), "rainfall_forecast_next_6h_mm": F.lit(2.0), "rainfall_forecast_next_24h_mm": F.lit(300.0)})
    docs = D.extend_with_weather(D.build_documents(D.resolve_location(S.add_horizons(wet), None), moment()))
    doc = json.loads(D.as_json(docs).orderBy("obs_seq").collect()[2].json)
    assert doc["prediction"]["risk_level"] == "HIGH" and doc["forecast_signal"]["rainfall_trend"] == "INCREASING"
    assert doc["confidence"]["forecast_support"] == 0.95 and "disclaimer" not in doc["metadata"]
    assert doc["context"]["time_window"] == {"prediction_time": "2024-01-31T00:00:00.250000Z", "valid_until": "2024-02-01T00:00:00.250000Z"}
    assert doc["metadata"]["rainfall_forecast"]["next_24h_mm"] == 300.0 and doc["prediction"]["risk_level_24h"] == "HIGH"
    assert D.document_counts(rows).first().json_generated == 3


def test_document_checks_find_each_violation(spark):
    good = json.loads(D.as_json(D.prediction_documents(pred(spark, (0.5, 0.4, "medium")), None, moment())).first().json)

    def errors(change):
        doc = json.loads(json.dumps(good))
        change(doc)
        return K.check_documents(spark.createDataFrame([(json.dumps(doc),)], "json string")).first().errors

    assert errors(lambda d: None) == []
    assert errors(lambda d: d.pop("context")) == ["Missing top-level key: context"]
    assert errors(lambda d: d["prediction"].update(flood_probability="x")) == ["prediction.flood_probability must be numeric"]
    assert errors(lambda d: d["prediction"].update(flood_probability=True)) == []
    assert errors(lambda d: d["confidence"].update(model_confidence=-0.1)) == ["confidence.model_confidence must be between 0 and 1"]
    assert errors(lambda d: d["prediction"].update(risk_level="high")) == ["Invalid risk_level: high"]
    assert errors(lambda d: d.update(explanation=[])) == ["explanation list is empty"]
    assert errors(lambda d: d.update(explanation="no")) == ["explanation must be a list"]
    assert errors(lambda d: d.update(explanation=["a", 1, None])) == ["explanation[1] must be string", "explanation[2] must be string"]
    assert errors(lambda d: d["context"]["location"].pop("state")) == ["Missing context.location.state"]
    assert errors(lambda d: d["context"]["time_window"].pop("valid_until")) == ["Missing context.time_window.valid_until"]
    bad = spark.createDataFrame([("{oops",)], "json string")
    assert K.check_documents(bad).first().errors == ["Failed to load JSON"]
    with pytest.raises(Exception, match="Failed to load JSON"):
        K.require_valid(bad).collect()
    report = K.check_report(K.check_documents(bad)).first()
    assert (report.total_files, report.valid_files, report.invalid_files, report.valid) == (1, 0, 1, False)
