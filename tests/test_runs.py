"""Sources, sinks, models, complete runs and cycles."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import alerts as A
from gaugeflow.operators.profile import table_metadata
from gaugeflow.operators.weather_features import feature_descriptions
from gaugeflow.plans import runs, training as T
from gaugeflow.registry.catalog import Tables, at
from gaugeflow.registry.model_queries import FEATURES, IDENTITY, labelled
from gaugeflow.sources import html_tables, sinks, snapshots, tables
from gaugeflow.streaming.cycles import CyclePlan, start_cycles


@pytest.fixture(scope="module")
def t(spark, folder):
    return Tables(spark, folder)


def test_csv_observations(spark, tmp_path):
    head = "station_id,station_name,river_name,basin,state,district,latitude,longitude,division,site_type,current_level,warning_level,danger_level,highest_flood_level,trend,timestamp,source_url"
    for name, level in (("cwc_hydrograph_1.csv", "1.5"), ("cwc_hydrograph_2.csv", "nan")):
        (tmp_path / name).write_text(f"{head}\nSTN_0001,A,R,B,S,D,1.0,2.0,,,{level},8,10,,rising,2024-01-01T03:00:00,u\nSTN_0002,A,R,B,S,D,1.0,2.0,,,x,8,10,,rising,bad,u\n")
    newest = tables.newest_file(spark, f"{tmp_path}/cwc_hydrograph_*.csv")
    assert newest.endswith("cwc_hydrograph_2.csv")
    rows = tables.read_observations(spark, newest).orderBy("station_id").collect()
    assert rows[0].current_level is None and rows[0].observation_time == dt.datetime(2024, 1, 1, 3)
    assert rows[1].current_level is None and rows[1].observation_time is None
    profile = {r.file_name: (r.records, r["columns"]) for r in tables.file_profile(spark, str(tmp_path)).collect()}
    assert profile["cwc_hydrograph_1.csv"] == (2, 17)
    assert tables.newest_file(spark, f"{tmp_path}/*.csv") == newest


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "o.csv").write_text("timestamp,extra,danger_level,station_id,current_level\n2024-01-01T03:00:00,e,10,S1, 1.5\nbad,e,x,S2,nan\n")
    rows = {r.station_id: r for r in tables.read_observations(spark, str(tmp_path / "o.csv")).collect()}
    assert (rows["S1"].current_level, rows["S1"].danger_level, rows["S1"].warning_level) == (1.5, 10.0, None)
    assert rows["S1"].observation_time == dt.datetime(2024, 1, 1, 3) and "extra" not in rows["S1"].asDict()
    assert (rows["S2"].current_level, rows["S2"].danger_level, rows["S2"].observation_time) == (None, None, None)


def test_each_csv_file_has_its_own_profile(spark, tmp_path):
    for name, text in {
        "a.csv": "x,y,z\n1,2,3\n\n4,5,6\n", "b.csv": 'p,"q,r"\n"a,b",2\n', "empty.csv": "", "blank.csv": "\n \n", "head.csv": "one,two",
        "wide.csv": "x,y\n1,2\n1,2,3\n", "other.txt": "x\n1\n",
    }.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "bytes.csv").write_bytes(b"x,y\n\xff\xfe,2\n")
    (tmp_path / "long.csv").write_text("k,v\n" + "".join(f"{i},{i}\n" for i in range(5000)))
    got = {r.file_name: (r.valid, r.records, r["columns"], r.error) for r in tables.file_profile(spark, str(tmp_path)).collect()}
    assert got == {
        "a.csv": (True, 2, 3, None), "b.csv": (True, 1, 2, None), "empty.csv": (False, 0, 0, "no columns to read"),
        "blank.csv": (False, 0, 0, "no columns to read"), "head.csv": (True, 0, 2, None), "wide.csv": (False, 2, 2, "expected 2 fields, saw 3"),
        "bytes.csv": (False, 1, 2, "not UTF-8 text"), "long.csv": (True, 5000, 2, None),
    }


def test_station_pages(spark):
    page = ("<TABLE><tr><td>head</td></tr><tr><td> s&amp;1 </td><td>n</td><td>r</td><td>b</td><td>st</td><td> 1.5 </td><td>2</td><td>3e0</td></tr>"
            "<tr><td>s2</td><td>n</td><td>r</td><td>b</td><td>st</td><td>1</td><td>2</td><td>3</td><td>x</td></tr>"
            "<tr><td>s3</td><td>n</td><td>r</td><td>b</td><td>st</td><td>nan</td><td>2</td><td>3</td><td>4</td><td> falling\n</td></tr></TABLE>"
            "<table><tr><td>only a first row with</td><td>n</td><td>r</td><td>b</td><td>st</td><td>1</td><td>2</td><td>3</td></tr></table>")
    rows = html_tables.parse_station_pages(spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id int, html string")).orderBy("station_id").collect()
    assert [(r.station_id, r.current_level, r.danger_level, r.highest_flood_level, r.trend) for r in rows] == [
        ("s&1", 1.5, 3.0, None, "unknown"), ("s3", None, 3.0, 4.0, "falling")]
    assert rows[0].asDict()["page_id"] == 1


def test_fallback_and_snapshot_limits(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert tables.first_with_rows(a.limit(0), b).first().x == 2 and tables.first_with_rows(a, b).first().x == 1
    assert tables.first_with_rows(None, b).first().x == 2
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    log = spark.createDataFrame([("a", 3.0, 1), ("b", 3.001, 2), ("a", 5.0, 3)], "station_id string, age double, n int").select(
        "station_id", "n", F.timestamp_micros(F.unix_micros(now) - (F.col("age") * 3.6e9).cast("long")).alias("fetched_at"), F.lit("forecast").alias("kind"))
    live = snapshots.live_snapshot(log, now, "forecast").collect()
    assert [(r.station_id, r.n) for r in live] == [("a", 1)]
    status = snapshots.snapshot_status(log, now).first()
    assert status.age_hours == 3.0 and status.valid is False


def test_sinks_replace_their_run_only(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a<b", None)], "x int, message string, v double")
    for run, times in (("r1", 2), ("r2", 1)):
        for _ in range(times):
            sinks.save_stage(df, root, "raw", run)
            sinks.save_metadata(df, root, "raw", run, "src")
            sinks.save_documents(df.select(F.lit('{"a":1}').alias("json")), root, run)
            sinks.save_alert_log(df, root, run)
    assert spark.read.parquet(f"{root}/raw").groupBy("run_ts").count().orderBy("run_ts").collect() == [("r1", 1), ("r2", 1)]
    assert spark.read.json(f"{root}/raw_metadata").count() == 2
    docs = tables.read_documents(spark, f"{root}/documents")
    assert docs.count() == 2 and docs.first().json == '{"a":1}'
    log = tables.read_documents(spark, f"{root}/alert_log/run_ts=r1", whole_files=True).first().json
    assert log == "a<b\n" + "-" * 70 + "\n\n"
    assert sinks.save_alert_log(df.limit(0), root, "r3") is None
    for kind in ("csv", "json", "html"):
        assert sinks.export_alerts(df, f"{root}/out_{kind}", kind)
    parts = sorted(p for p in os.listdir(f"{root}/out_html") if p.startswith("part-"))
    page = "".join(open(f"{root}/out_html/{p}").read() for p in parts).split("\n")
    assert page[0].endswith("<tr style=\"text-align: right;\"><th>x</th><th>message</th><th>v</th></tr></thead><tbody>")
    assert page[1:-1] == ["<tr><td>1</td><td>a&lt;b</td><td>NaN</td></tr>", "</tbody></table>"]
    assert not sinks.export_alerts(df, f"{root}/out_x", "xls") and not os.path.exists(f"{root}/out_x")
    weather = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "station_id string, rainfall_last_6h_mm double, rainfall_forecast_next_6h_mm double, rainfall_forecast_next_24h_mm double")
    sinks.append_snapshot(weather, f"{root}/weather", "forecast", at())
    sinks.append_snapshot(weather, f"{root}/weather", "observed", at())
    assert snapshots.live_snapshot(spark.read.parquet(f"{root}/weather"), at(), "observed").count() == 1
    meta = table_metadata(df, "src").first()
    assert meta.record_count == 1 and meta.data_types == ["int", "string", "double"]
    assert feature_descriptions(df).count() == 7


@pytest.fixture(scope="module")
def fitted(t):
    rows = labelled(t).cache()
    return rows, T.fit_models(rows, T.Settings(trees=4, depth=3, leaf_rows=5, noise=0.05), FEATURES, IDENTITY)


def test_models_learn_and_reload(spark, fitted, tmp_path):
    rows, models = fitted
    quality = T.evaluate(rows, models)
    by_split = {r.split: r for r in quality["risk_regressor"].collect()}
    assert by_split["test"].r2 > 0.6
    assert quality["warning_auc"].first().roc_auc > 0.9 and quality["risk_tier_classifier"].first().weighted_f1 > 0.7
    T.save_models({n: models[n] for n in ("risk_regressor", "warning_classifier")}, str(tmp_path))
    again = T.load_models(spark, str(tmp_path))
    assert set(again) == {"risk_regressor", "warning_classifier"}
    assert {r.model: r.available for r in T.model_status(spark, str(tmp_path)).collect()}["risk_tier_classifier"] is False
    before = T.score_all(rows, {n: models[n] for n in again})
    after = T.score_all(rows, again)
    assert before.columns == after.columns and "risk_tier" not in after.columns
    assert before.exceptAll(after).isEmpty() and after.count() == rows.count()
    assert after.filter("risk_score < 0 OR risk_score > 1 OR warning_probability < 0 OR warning_probability > 1").isEmpty()
    weights = T.importances(models["risk_tier_classifier"])
    assert set(weights) == set(FEATURES) and sum(weights.values()) == pytest.approx(1.0, abs=1e-6)


def test_inference_run_and_explanations(t, fitted):
    rows, models = fitted
    features = rows.drop("risk_score", "risk_tier", "warning_label", "split")
    predictions, alerts = runs.inference_run(features, models, t.station_dim, at())
    assert alerts.count() == A.assess(predictions).filter("alert_triggered").count()
    rest = [c for c in FEATURES if c not in predictions.columns]
    explained = runs.explained_run(predictions.join(features.select("obs_seq", *rest), "obs_seq"), models)
    row = explained.first()
    assert len(row.risk_score_explained.top_factors) == 5 and row.risk_tier_explained.summary


def test_full_run_writes_everything(spark, t, tmp_path):
    root = str(tmp_path)
    result = runs.full_run(t.obs, t.station_dim, t.weather, at(), root, "r1", T.Settings(trees=2, depth=2), demo=True)
    status = result.status.first()
    assert status.status == "success" and status.raw_records == status.prediction_records == t.obs.count()
    for name in ("cleaned", "features", "predictions", "documents", "results", "models"):
        assert os.path.isdir(f"{root}/{name}")
    assert spark.read.text(f"{root}/documents").count() == result.documents.count() > 0
    again = runs.full_run(t.obs, t.station_dim, None, at(), root, "r2", models=result.models)
    assert again.status.first().mode == "HYDRO-ONLY"
    assert spark.read.parquet(f"{root}/predictions").select("run_ts").distinct().count() == 2
    assert sorted(r.run_ts for r in sinks.published_runs(spark, root).collect()) == ["r1", "r2"]
    assert sinks.read_stage(spark, root, "predictions", "r1").count() == status.prediction_records


def test_cycles_replay_and_failure(spark, t, fitted, tmp_path):
    root = str(tmp_path)
    _, models = fitted
    T.save_models(models, f"{root}/models")
    obs = t.obs
    border = dt.datetime(2024, 1, 16)
    for name, part in (("a", obs.filter(F.col("observation_time") < border)), ("b", obs.filter(F.col("observation_time") >= border))):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        plan = CyclePlan(f"{root}/out", f"{root}/models", t.station_dim, t.weather, tolerate_failures=False)
        start_cycles(spark, f"{root}/in", obs.schema, plan, f"{root}/ckpt").awaitTermination()
    stats = spark.read.parquet(f"{root}/out/statistics").orderBy("batch_id").collect()
    assert [r.batch_id for r in stats] == [0, 1] and sum(r.total_predictions for r in stats) == obs.count()
    assert spark.read.parquet(f"{root}/out/history").count() == obs.count()
    # Nothing new: nothing is added. A lost checkpoint replays into the same partitions.
    start_cycles(spark, f"{root}/in", obs.schema, plan, f"{root}/ckpt").awaitTermination()
    start_cycles(spark, f"{root}/in", obs.schema, plan, f"{root}/ckpt2", files_per_cycle=1).awaitTermination()
    assert spark.read.parquet(f"{root}/out/predictions").count() == obs.count()
    # The second batch saw the first one's readings: its rates equal those of one pass over everything.
    from gaugeflow.operators.cleaning import clean
    from gaugeflow.operators.hydro_features import rate_of_rise
    late = spark.read.parquet(f"{root}/out/predictions").filter("batch_id = 1").select("obs_seq", F.round("rate_of_rise_3h", 9).alias("r"))
    whole = rate_of_rise(clean(obs)).select("obs_seq", F.round("rate_of_rise_3h", 9).alias("w"))
    assert late.join(whole, "obs_seq").filter("r <> w").isEmpty()
    # A cycle that cannot run is recorded and the stream goes on.
    broken = CyclePlan(f"{root}/bad", f"{root}/models", t.station_dim.drop("basin", "station_id"), None)
    start_cycles(spark, f"{root}/in", obs.schema, broken, f"{root}/ckpt3").awaitTermination()
    assert spark.read.parquet(f"{root}/bad/failures").first().status == "failed"


def test_alerts_and_documents_score_each_row_once(spark):
    """Later expressions and filters must not hold copies of the models' functions."""
    from gaugeflow.operators import scoring as S

    features = spark.range(400).select(
        F.col("id").alias("obs_seq"), (F.col("id") % 9).alias("station_id"), F.timestamp_seconds(F.col("id") * 3600).alias("observation_time"),
        *[((F.col("id") * (i + 3)) % 17 / 2.0).alias(c) for i, c in enumerate(FEATURES)])
    rows = features.withColumns({
        "risk_score": F.col("obs_seq") % 5 / 4.0, "warning_label": (F.col("obs_seq") % 2).cast("int"),
        "risk_tier": (F.col("obs_seq") % 3).cast("int"), "split": F.lit("train")})
    models = T.fit_models(rows, T.Settings(trees=2, depth=2, leaf_rows=1))
    predictions, alerts = runs.inference_run(features, models, None, F.lit("2024-01-31").cast("timestamp"))
    plan = alerts._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF(" not in plan
    expected = {r.obs_seq: (r.risk_score, r.risk_tier) for r in S.score_all(features, models).collect()}
    assert {r.obs_seq: (r.risk_score, r.risk_tier) for r in predictions.collect()} == expected


def test_training_rows_are_dealt_evenly_and_in_one_order(spark, monkeypatch):
    """Unlike partitions, as files leave them, would hold up every job of every tree."""
    from pyspark.ml.feature import VectorAssembler

    monkeypatch.setattr(T, "PARTITION_ROWS", 100)
    monkeypatch.setattr(T, "TASK_ROWS", 500)
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(900 * cores).select(
        (F.col("id") % 50).alias("station_id"), F.col("id").alias("obs_seq"), (F.col("id") % 7 / 7.0).alias("x"),
        (F.col("id") % 5 / 4.0).alias("risk_score"), (F.col("id") % 2).cast("int").alias("warning_label"), (F.col("id") % 3).cast("int").alias("risk_tier"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows).drop("x")
    uneven = rows.filter("obs_seq < 10").coalesce(1).union(rows.filter("obs_seq >= 10").coalesce(1))
    dealt = T._dealt(uneven, 900 * cores, ["station_id", "obs_seq"])
    assert set(dealt.columns) == {"features", "risk_score", "warning_label", "risk_tier"}
    held = dealt.rdd.glom().map(lambda part: [(r.features[0], r.risk_score, r.risk_tier) for r in part]).collect()
    assert len(held) == 2 * cores and sum(map(len, held)) == 900 * cores
    assert max(map(len, held)) < 1.5 * 450
    assert held == T._dealt(rows.repartition(3), 900 * cores, ["station_id", "obs_seq"]).rdd.glom().map(
        lambda part: [(r.features[0], r.risk_score, r.risk_tier) for r in part]).collect()
    assert T._dealt(uneven, 100, ["station_id", "obs_seq"]).rdd.getNumPartitions() == 1
