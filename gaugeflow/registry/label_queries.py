"""Labels, splits, scaling and quality measures."""

from pyspark.sql import functions as F

from gaugeflow.operators import hydro_features as H, labels as L, metrics as M
from gaugeflow.registry.catalog import Tables, query

LABELLED = """
near AS (SELECT obs_seq, station_id, observation_time, danger_level - current_level AS distance_to_danger FROM obs),
cut AS (SELECT quantile_cont(distance_to_danger, 0.2) AS q FROM near),
scores AS (SELECT *, CASE WHEN distance_to_danger IS NOT NULL THEN greatest(0e0, least(1e0, 1 - distance_to_danger / 5)) END AS risk_score,
 CAST(coalesce(distance_to_danger < q, false) AS INTEGER) AS warning_label FROM near, cut),
labelled AS (SELECT *, CASE WHEN risk_score <= 0.33 THEN 0 WHEN risk_score <= 0.67 THEN 1 WHEN risk_score IS NOT NULL THEN 2 END AS risk_tier FROM scores)"""

SPLIT = """
placed AS (SELECT *, row_number() OVER (ORDER BY observation_time NULLS LAST, obs_seq) - 1 AS i, count(*) OVER () AS n FROM obs),
split AS (SELECT *, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM placed)"""


def _labelled(t: Tables):
    return L.create_labels(H.distances(t.obs))


@query("training_labels", f"WITH {LABELLED} SELECT obs_seq, risk_score, warning_label, risk_tier FROM labelled", ["obs"], "risk_score")
def _(t: Tables):
    return _labelled(t).select("obs_seq", "risk_score", "warning_label", "risk_tier")


@query("label_summary", f"""WITH {LABELLED} SELECT min(risk_score) AS min_score, max(risk_score) AS max_score, CAST(sum(warning_label) AS BIGINT) AS positives,
 avg(warning_label) AS positive_share, count(*) FILTER (WHERE risk_tier = 0) AS tier_0, count(*) FILTER (WHERE risk_tier = 1) AS tier_1,
 count(*) FILTER (WHERE risk_tier = 2) AS tier_2 FROM labelled""", ["obs"], "min_score max_score positive_share")
def _(t: Tables):
    return L.label_summary(_labelled(t))


def _digits(text: str, digits: int) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


def _normal(seed: int, *parts: str) -> str:
    """Box-Muller on the SQL side, from the same two hashes."""
    draw = {k: f"((CAST({_digits(' || '.join([*parts, f"'|{k}|{seed}'"]), 13)} AS DOUBLE) + 0.5) / 4503599627370496)" for k in ("radius", "angle")}
    return f"sqrt(-2 * ln({draw['radius']})) * cos(2 * pi() * {draw['angle']})"


def _split(source: str, *parts: str) -> str:
    bucket = _digits(" || '|' || ".join(parts) + " || '|42'", 8)
    return f"parted AS (SELECT *, CASE WHEN {bucket} % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM {source})"


@query("random_split", f"WITH {_split('obs', 'station_id', 'obs_seq')} SELECT obs_seq, split FROM parted", ["obs"])
def _(t: Tables):
    return L.random_split(t.obs, identity=("station_id", "obs_seq")).select("obs_seq", "split")


@query("temporal_split", f"WITH {SPLIT} SELECT obs_seq, split FROM split", ["obs"])
def _(t: Tables):
    return L.temporal_split(t.obs).select("obs_seq", "split")


@query("filled_features", """SELECT obs_seq, coalesce(current_level, 0e0) AS current_level, coalesce(danger_level - current_level, 0e0) AS distance_to_danger FROM obs""",
       ["obs"], "current_level distance_to_danger")
def _(t: Tables):
    return L.fill_features(H.distances(t.obs)).select("obs_seq", "current_level", "distance_to_danger")


@query("standardized_features", f"""WITH {SPLIT}, m AS (SELECT avg(current_level) FILTER (WHERE split = 'train') AS ma, stddev_pop(current_level) FILTER (WHERE split = 'train') AS sa,
 avg(warning_level) FILTER (WHERE split = 'train') AS mw, stddev_pop(warning_level) FILTER (WHERE split = 'train') AS sw FROM split)
SELECT obs_seq, split, (current_level - ma) / sa AS current_level, (warning_level - mw) / sw AS warning_level FROM split, m""", ["obs"], "current_level warning_level")
def _(t: Tables):
    rows = L.standardize(L.temporal_split(t.obs), ["current_level", "warning_level"])
    return rows.select("obs_seq", "split", "current_level", "warning_level")


@query("feature_noise", f"""WITH {_split('obs', 'obs_seq')}
SELECT obs_seq, split, CASE WHEN split = 'train' THEN warning_level + 0.05 * ({_normal(42, 'obs_seq', "'|warning_level'")}) ELSE warning_level END AS warning_level
FROM parted""", ["obs"], "warning_level")
def _(t: Tables):
    rows = L.feature_noise(L.random_split(t.obs, identity=["obs_seq"]), ["warning_level"], identity=["obs_seq"])
    return rows.select("obs_seq", "split", "warning_level")


@query("label_noise", f"""WITH {_split('pred', 'obs_seq')}
SELECT obs_seq, split, CASE WHEN split = 'train' THEN greatest(0e0, least(1e0, risk_score + 0.05 * ({_normal(43, 'obs_seq', "'|risk_score'")}))) ELSE risk_score END AS risk_score
FROM parted""", ["pred"], "risk_score")
def _(t: Tables):
    rows = L.random_split(t.pred, identity=["obs_seq"])
    return L.label_noise(rows, identity=["obs_seq"]).select("obs_seq", "split", "risk_score")


@query("regression_metrics", """
SELECT count(*) AS rows, avg(abs(label - probability)) AS mae, sqrt(avg((label - probability) * (label - probability))) AS rmse,
 1 - avg((label - probability) * (label - probability)) / var_pop(label) AS r2 FROM scored""", ["scored"], "mae rmse r2")
def _(t: Tables):
    return M.regression_metrics(t.scored, "label", "probability")


@query("binary_metrics", """
WITH cells AS (SELECT count(*) FILTER (WHERE y_bin = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y_bin = 0 AND p = 1) AS fp,
 count(*) FILTER (WHERE y_bin = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y_bin = 1 AND p = 1) AS tp
 FROM (SELECT *, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS p FROM scored))
SELECT *, tp / CAST(tp + fn AS DOUBLE) AS recall, tp / CAST(tp + fp AS DOUBLE) AS precision, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1,
 (tp + tn) / CAST(greatest(1, tp + fp) AS DOUBLE) AS precision_compat FROM cells""", ["scored"], "recall precision f1 precision_compat")
def _(t: Tables):
    return M.binary_metrics(t.scored.withColumn("p", (F.col("probability") > 0.5).cast("int")), "y_bin", "p")


@query("roc_auc", """
WITH s AS (SELECT probability, count(*) FILTER (WHERE y_bin = 1) AS pos, count(*) FILTER (WHERE y_bin = 0) AS neg FROM scored GROUP BY probability),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT CAST(sum(pos * (below + neg * 0.5e0)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc,
 CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM r""", ["scored"], "roc_auc")
def _(t: Tables):
    return M.roc_auc(t.scored, "y_bin", "probability")


REPORT = """
report AS (SELECT class, count(*) FILTER (WHERE label = class) AS support, count(*) FILTER (WHERE prediction = class) AS predicted,
 count(*) FILTER (WHERE label = class AND prediction = class) AS hits FROM scored, (SELECT DISTINCT label AS class FROM scored) GROUP BY class),
scores AS (SELECT class, hits / CAST(predicted AS DOUBLE) AS precision, hits / CAST(support AS DOUBLE) AS recall,
 2 * hits / CAST(support + predicted AS DOUBLE) AS f1, support FROM report)"""


@query("tier_confusion", "SELECT label, prediction, count(*) AS rows FROM scored GROUP BY label, prediction", ["scored"])
def _(t: Tables):
    return M.confusion(t.scored, "label", "prediction")


@query("class_report", f"WITH {REPORT} SELECT * FROM scores", ["scored"], "precision recall f1")
def _(t: Tables):
    return M.class_report(t.scored, "label", "prediction")


@query("multiclass_f1", f"WITH {REPORT} SELECT avg(f1) AS macro_f1, CAST(sum(f1 * support) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS weighted_f1 FROM scores", ["scored"], "macro_f1 weighted_f1")
def _(t: Tables):
    return M.multiclass_f1(t.scored, "label", "prediction")
