"""Time the headline queries and one complete run; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from gaugeflow.plans.runs import full_run
from gaugeflow.plans.training import Settings, load_models
from gaugeflow.operators.scoring import predict_with_weather
from gaugeflow.registry import catalog
from gaugeflow.registry.catalog import Tables, at
from gaugeflow.session import local_session
from gaugeflow.sources.tables import spread

HEADLINE = (
    "stations_needing_attention", "validation_flags", "cleaned_observations", "rate_of_rise", "historical_percentile",
    "change_volatility", "rolling_level_average", "hydro_features", "weather_aware_features", "nearest_grid_cell",
    "training_labels", "temporal_split", "roc_auc", "class_report", "risk_horizons", "alerts_with_station", "top_alerts",
    "forced_demo_alerts", "explained_predictions", "alert_bulletins", "weather_documents", "document_errors",
    "station_page_rows", "forecast_feed_rows", "live_snapshot", "dataset_profile",
)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    catalog.load_all()
    spark = local_session(cores, "bench")
    times: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    for name in HEADLINE:
        timed(name, lambda: consume(catalog.QUERIES[name](spark, folder)))
    tables = Tables(spark, folder)
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    # The complete run with the default model sizes: clean, features, three fits,
    # scores, alerts, documents, everything written.
    run = timed("complete_run", lambda: full_run(
        tables.obs, tables.station_dim, tables.weather, at(), root, "bench", Settings()
    ))
    models = load_models(spark, f"{root}/models")
    rows = run.features.count()
    timed("batch_scoring", lambda: consume(predict_with_weather(spread(run.features), models, tables.weather)))
    print(json.dumps({
        "metric": "headline_queries_and_complete_run", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "rows": rows,
        "scored_rows_per_sec": round(rows / times["batch_scoring"], 1),
        "complete_run_rows_per_sec": round(rows / times["complete_run"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
