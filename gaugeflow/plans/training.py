"""Fitting the three models: boosted ones by `boosting`, the others by Spark MLlib; all are MLlib models."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, OneVsRestModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow import fixed_values as V
from gaugeflow.functions.numbers import gaussian
from gaugeflow.operators import metrics as M
from gaugeflow.operators.labels import fill_features, label_noise
from gaugeflow.operators.ordered import KEY, TIME
from gaugeflow.operators.scoring import score_all
from gaugeflow.plans.boosting import Growth, Target, as_model, blocks_of, boost
from gaugeflow.plans.softmax_boosting import fit_softmax
from gaugeflow.session import use_checkpoints


PARTITION_ROWS = 100_000  # training rows that are worth a task of their own
TASK_ROWS = 1_000_000  # most rows of a task


@dataclass(frozen=True)
class Settings:
    """Model sizes; the defaults are the fixed values."""

    trees: int = V.TREES
    depth: int = V.TREE_DEPTH
    leaf_rows: int = V.LEAF_ROWS
    row_share: float = V.ROW_SHARE
    rate: float = V.LEARNING_RATE
    seed: int = V.SEED
    regressor: str = "gradient_boosting"
    warning: str = "gradient_boosting"
    tiers: str = "one_vs_rest"  # or "softmax": one model of all tiers, whose trees have split candidates of their own
    noise: float = 0.0


def _boosted(kind, s: Settings, **columns):
    return kind(
        maxIter=s.trees, maxDepth=s.depth, minInstancesPerNode=s.leaf_rows, subsamplingRate=s.row_share,
        stepSize=s.rate, seed=s.seed, featuresCol="features", checkpointInterval=10, **columns,
    )


def risk_regressor(s: Settings):
    if s.regressor == "random_forest":
        return RandomForestRegressor(
            numTrees=s.trees, maxDepth=s.depth, minInstancesPerNode=s.leaf_rows, seed=s.seed, featuresCol="features", labelCol="risk_score"
        )
    return _boosted(GBTRegressor, s, labelCol="risk_score")


def warning_classifier(s: Settings, train_rows: int):
    if s.warning == "logistic_regression":
        # The penalty is stated per data set elsewhere and per row here.
        return LogisticRegression(
            regParam=1.0 / (V.LOGISTIC_C * max(1, train_rows)), elasticNetParam=0.0, standardization=False,
            maxIter=V.LOGISTIC_ITERATIONS, featuresCol="features", labelCol="warning_label",
        )
    return _boosted(GBTClassifier, s, labelCol="warning_label")


def fit_boosted(rows: DataFrame, s: Settings, which: Sequence[str]) -> dict:
    """Boosted models of the names in `which`, all learnt in the same passes over the rows."""
    spark = rows.sparkSession
    labels = {"risk_regressor": "risk_score", "warning_classifier": "warning_label", "risk_tier_classifier": "risk_tier"}
    read = [labels[name] for name in which]
    tiers = "risk_tier_classifier" in which and s.tiers != "softmax"
    targets, makers = [], []  # a maker for each model, and for one-vs-rest one for each class
    for i, name in enumerate(which):
        if name == "risk_regressor":
            targets.append(Target(i, "squared"))
            makers.append(risk_regressor(s))
        elif name == "warning_classifier":
            targets.append(Target(i, "logistic"))
            makers.append(warning_classifier(s, 0))
        elif tiers:
            for k in range(int(rows.agg(F.max("risk_tier")).first()[0]) + 1):
                targets.append(Target(i, "logistic", float(k)))
                makers.append(_boosted(GBTClassifier, s, labelCol=f"mc2b${k}"))
    out: dict = {}
    if targets:
        growth = Growth(s.trees, s.depth, s.leaf_rows, s.row_share, s.rate, s.seed)
        weights = [1.0] + [s.rate] * (s.trees - 1)
        grown = list(zip(makers, boost(blocks_of(rows, read), targets, growth)))
        with ThreadPoolExecutor(len(grown)) as writes:
            made = list(writes.map(inheritable_thread_target(spark)(lambda one: as_model(spark, *one, weights)), grown))
        for name in which:
            if name != "risk_tier_classifier":
                out[name] = made.pop(0)
            elif tiers:
                parts = [made.pop(0) for target in targets if target.class_ is not None]
                rest = OneVsRest(classifier=_boosted(GBTClassifier, s, labelCol="risk_tier"), featuresCol="features", labelCol="risk_tier")
                out[name] = rest._copyValues(OneVsRestModel(models=parts))
    if "risk_tier_classifier" in which and not tiers:
        out["risk_tier_classifier"] = PipelineModel(
            fit_softmax(rows, "risk_tier", len(V.TIER_NAMES), s.trees, s.depth, s.leaf_rows, s.row_share, s.rate, s.seed))
    return out


class _Tiers:
    """The tier models, with the face of an estimator."""

    def __init__(self, s: Settings):
        self.s = s

    def fit(self, rows: DataFrame):
        return fit_boosted(rows, self.s, ["risk_tier_classifier"])["risk_tier_classifier"]


def tier_classifier(s: Settings):
    return _Tiers(s)


def _dealt(prepared: DataFrame, rows: int, identity: Sequence[str]) -> DataFrame:
    """Training rows in partitions that suit a trainer of several jobs a tree over all of them.

    Partitions of a handful of rows would only add task start-up time. More rows are dealt evenly, a
    multiple of the cores: as files leave them, the largest partition would hold up every job. Their order
    is fixed, because the trainer draws rows by place and pairs them by place with their residuals.
    """
    if rows <= PARTITION_ROWS:
        return prepared.drop(*identity).coalesce(1)
    cores = prepared.sparkSession.sparkContext.defaultParallelism
    tasks = min(cores, -(-rows // PARTITION_ROWS))
    if rows > tasks * TASK_ROWS:
        tasks *= -(-rows // (tasks * TASK_ROWS))
    keys = [*identity, "risk_score", "warning_label", "risk_tier"]
    return prepared.repartition(tasks, *keys).sortWithinPartitions(*keys, vector_to_array("features")).drop(*identity)


def fit_models(
    labelled: DataFrame,
    settings: Settings = Settings(),
    columns: Sequence[str] = V.HYDRO_FEATURES,
    identity: Sequence[str] = (KEY, TIME),
    which: Sequence[str] = V.MODEL_NAMES,
) -> dict[str, PipelineModel]:
    """Fit on rows with split = train; each model carries its own assembling and scaling stages."""
    spark = labelled.sparkSession
    use_checkpoints(spark)
    columns = [c for c in columns if c in labelled.columns]
    train = fill_features(labelled.filter(F.col("split") == "train"), columns)
    assembler = VectorAssembler(inputCols=columns, outputCol="raw_features")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True).fit(assembler.transform(train))
    if settings.noise > 0:
        who = [F.col(c) for c in identity]
        train = train.withColumns({
            c: F.col(c) + F.lit(settings.noise * float(std)) * gaussian(settings.seed, *who, F.lit(c))
            for c, std in zip(columns, scaler.std)
        })
        train = label_noise(train, ("risk_score",), settings.noise, settings.seed, identity)
    prepared = scaler.transform(assembler.transform(train))
    identity = [c for c in identity if c in prepared.columns]
    prepared = prepared.select(*identity, "features", "risk_score", "warning_label", "risk_tier")
    prepared = prepared.filter(F.col("risk_score").isNotNull())
    prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    dealt = prepared
    try:
        rows = prepared.count()
        dealt = _dealt(prepared, rows, identity)
        if rows > PARTITION_ROWS:
            dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)
            dealt.count()
            prepared.unpersist()
        fitted = {}
        if "risk_regressor" in which and settings.regressor == "random_forest":
            fitted["risk_regressor"] = risk_regressor(settings).fit(dealt)
        if "warning_classifier" in which and settings.warning == "logistic_regression":
            fitted["warning_classifier"] = warning_classifier(settings, rows).fit(dealt)
        fitted |= fit_boosted(dealt, settings, [name for name in which if name not in fitted])
        return {name: PipelineModel([assembler, scaler, fitted[name]]) for name in which}
    finally:
        dealt.unpersist()
        prepared.unpersist()


def evaluate(labelled: DataFrame, models: dict[str, PipelineModel]) -> dict[str, DataFrame]:
    """Quality on rows not used for training (and regression quality per split)."""
    scored = labelled
    named = {"risk_regressor": "predicted_score", "warning_classifier": "predicted_warning", "risk_tier_classifier": "predicted_tier"}
    scored = fill_features(scored)
    for name, column in named.items():
        if name in models:
            scored = models[name].transform(scored).withColumnRenamed("prediction", column).drop("features", "raw_features", "rawPrediction")
            if name == "warning_classifier":
                scored = scored.withColumn("warning_p", vector_to_array("probability")[1]).drop("probability")
    scored = scored.filter(F.col("risk_score").isNotNull())
    test = scored.filter(F.col("split") == "test")
    out = {}
    if "risk_regressor" in models:
        out["risk_regressor"] = M.regression_metrics(scored, "risk_score", "predicted_score", by="split")
    if "warning_classifier" in models:
        out["warning_classifier"] = M.binary_metrics(test, "warning_label", "predicted_warning")
        out["warning_auc"] = M.roc_auc(test, "warning_label", "warning_p")
    if "risk_tier_classifier" in models:
        out["risk_tier_classifier"] = M.multiclass_f1(test, "risk_tier", "predicted_tier")
    return out


def importances(model: PipelineModel) -> dict[str, float]:
    """Feature to importance; models of several parts (one-vs-rest, softmax) are averaged over them."""
    names, last = model.stages[0].getInputCols(), model.stages[-1]
    parts = last.models if hasattr(last, "models") else last.stages[:-1] if isinstance(last, PipelineModel) else [last]
    if not all(hasattr(p, "featureImportances") for p in parts):
        return {}
    vectors = [p.featureImportances.toArray() for p in parts]
    return {n: float(sum(v[i] for v in vectors) / len(vectors)) for i, n in enumerate(names)}


def save_models(models: dict[str, PipelineModel], folder: str) -> None:
    """One folder per model, replacing what was there; the writes are independent."""
    if not models:
        return
    with ThreadPoolExecutor(len(models)) as writes:
        list(writes.map(lambda item: item[1].write().overwrite().save(f"{folder}/{item[0]}"), models.items()))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_models(spark: SparkSession, folder: str, names: Sequence[str] = V.MODEL_NAMES) -> dict[str, PipelineModel]:
    """The models that are there; missing ones are tolerated."""
    return {n: PipelineModel.load(f"{folder}/{n}") for n in names if _exists(spark, f"{folder}/{n}")}


def model_status(spark: SparkSession, folder: str, names: Sequence[str] = V.MODEL_NAMES) -> DataFrame:
    rows = [(n, _exists(spark, f"{folder}/{n}")) for n in names]
    return spark.createDataFrame(rows, "model string, available boolean")


__all__ = [
    "Settings", "evaluate", "fit_models", "importances", "load_models", "model_status", "save_models", "score_all",
]
