"""Model fitting and scoring. Results depend on the trainer, so there is no SQL twin."""

from pyspark.sql import functions as F

from gaugeflow import fixed_values as V
from gaugeflow.operators import cleaning as C, documents as D, explain as X, hydro_features as H, labels as L, scoring as S
from gaugeflow.plans import training as T
from gaugeflow.plans.runs import explained_run, full_run, inference_run, settled
from gaugeflow.registry.catalog import Tables, at, query
from gaugeflow.registry.fixtures import observations_of
from gaugeflow.session import shared_folder
from gaugeflow.streaming.cycles import CyclePlan, start_cycles

FEATURES = V.HYDRO_FEATURES
IDENTITY = ("station_id", "observation_time", "obs_seq")

_models: dict = {}
_labelled: dict = {}


def labelled(t: Tables):
    """Cleaned readings with all hydrological features, labels and a split; derived and written once per folder."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _labelled:
        rows = H.hydro_features(C.clean(t.obs, hot=t.hot), t.station_dim, as_of=at(), hot=t.hot)
        path = shared_folder(t.spark, "labelled")
        L.random_split(L.create_labels(rows), identity=IDENTITY).write.parquet(path)
        _labelled[key] = path
    return t.spark.read.parquet(_labelled[key])


def models(t: Tables, settings: T.Settings = T.Settings(), which=V.MODEL_NAMES) -> dict:
    """Models of full size, fitted once per folder and settings."""
    key = (t.spark.sparkContext.applicationId, t.folder, settings)
    fitted = _models.setdefault(key, {})
    missing = [n for n in which if n not in fitted]
    if missing:
        fitted.update(T.fit_models(labelled(t), settings, FEATURES, IDENTITY, missing))
    return {n: fitted[n] for n in which}


@query("risk_regression")
def _(t: Tables):
    return S.score_all(labelled(t), models(t, which=("risk_regressor",))).select("obs_seq", "station_id", "risk_score", "risk_level")


@query("risk_regression_forest")
def _(t: Tables):
    fitted = models(t, T.Settings(regressor="random_forest"), ("risk_regressor",))
    return S.score_all(labelled(t), fitted).select("obs_seq", "risk_score", "risk_level")


@query("warning_classification")
def _(t: Tables):
    rows = S.score_all(labelled(t), models(t, which=("warning_classifier",)))
    return rows.select("obs_seq", "warning_prediction", "warning_probability")


@query("warning_classification_logistic")
def _(t: Tables):
    fitted = models(t, T.Settings(warning="logistic_regression", noise=0.05), ("warning_classifier",))
    return S.score_all(labelled(t), fitted).select("obs_seq", "warning_prediction", "warning_probability")


@query("tier_classification")
def _(t: Tables):
    return S.score_all(labelled(t), models(t, which=("risk_tier_classifier",))).select("obs_seq", "risk_tier", "risk_tier_name")


@query("tier_classification_softmax")
def _(t: Tables):
    """Tiers by one boosted model of all three, instead of one model for each against the rest."""
    fitted = models(t, T.Settings(tiers="softmax"), ("risk_tier_classifier",))
    return S.score_all(labelled(t), fitted).select("obs_seq", "risk_tier", "risk_tier_name")


@query("model_quality")
def _(t: Tables):
    reports = T.evaluate(labelled(t), models(t))
    long = None
    for model, report in reports.items():
        keep = [c for c in report.columns if c not in ("split", "rows")]
        part = F.concat_ws("_", "split") if "split" in report.columns else F.lit("test")
        row = report.select(F.lit(model).alias("model"), part.alias("split"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in keep])).alias("m")).select("model", "split", "m.*")
        long = row if long is None else long.unionByName(row)
    return long


@query("scored_predictions")
def _(t: Tables):
    return S.predict_with_weather(labelled(t).drop("risk_score", "risk_tier"), models(t), t.weather).drop("observation_time")


@query("inference_alerts")
def _(t: Tables):
    _, alerts = inference_run(labelled(t).drop("risk_score", "risk_tier"), models(t), t.station_dim, at())
    return alerts.drop("observation_time")


@query("model_importances")
def _(t: Tables):
    return X.importance_table(t.obs, {n: T.importances(m) for n, m in models(t).items()})


@query("explained_scores")
def _(t: Tables):
    fitted = models(t)
    rows = labelled(t).drop("risk_score", "risk_tier")
    scored = S.score_all(rows, fitted)
    rows = scored.join(rows.select("obs_seq", *[c for c in FEATURES if c not in scored.columns]), "obs_seq")
    return explained_run(rows, fitted).select("obs_seq", F.col("risk_score_explained.summary").alias("score_summary"),
                                              F.col("warning_explained.summary").alias("warning_summary"), F.col("risk_tier_explained.summary").alias("tier_summary"))


@query("batch_documents")
def _(t: Tables):
    """Readings to documents: clean, derive, score, locate, build."""
    predictions = settled(S.predict_with_weather(labelled(t).drop("risk_score", "risk_tier"), models(t), t.weather), "predictions")
    return D.as_json(D.prediction_documents(predictions, t.station_dim, at())).select("obs_seq", "json")


@query("complete_run")
def _(t: Tables):
    """Clean, derive, train, score, alert and write everything; the run's record counts."""
    root = shared_folder(t.spark, "complete-run")
    return full_run(t.obs, t.station_dim, t.weather, at(), root, "r1", hot=t.hot).status


@query("streamed_cycles")
def _(t: Tables):
    """The events files as a stream of cycles with saved models; the statistics of each cycle."""
    root = shared_folder(t.spark, "cycles")
    T.save_models(models(t), f"{root}/models")
    plan = CyclePlan(f"{root}/out", f"{root}/models", t.station_dim, t.weather, tolerate_failures=False)
    raw = t.spark.read.parquet(f"{t.folder}/events.parquet").schema
    start_cycles(t.spark, f"{t.folder}/events*.parquet", raw, plan, f"{root}/checkpoint", prepare=observations_of).awaitTermination()
    return t.spark.read.parquet(f"{root}/out/statistics")
