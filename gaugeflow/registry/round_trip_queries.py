"""What the writers wrote, read back: the rows that went in, whatever else lies in the folder."""

from pyspark.sql import functions as F

from gaugeflow import fixed_values as V
from gaugeflow.operators import alerts as A
from gaugeflow.registry.alert_queries import ASSESSED, message
from gaugeflow.registry.catalog import Tables, at, query
from gaugeflow.session import shared_folder
from gaugeflow.sources import sinks, snapshots, tables

RUN, LATER = "20240130_0000", "20240131_0000"


@query("stage_round_trip", """SELECT obs_seq, station_id, strftime(observation_time, '%Y-%m-%d %H:%M:%S') AS observed, current_level, trend FROM obs""",
       ["obs"], "current_level")
def _(t: Tables):
    """A stage of the newest whole run: one run written twice, a later one that stopped half-way."""
    root = shared_folder(t.spark, "round-trip")
    rows = t.obs.select("obs_seq", "station_id", "observation_time", "current_level", "trend")
    for _ in range(2):
        sinks.open_run(t.spark, root, RUN)
        sinks.save_stage(rows, root, "raw", RUN)
        sinks.publish_run(t.spark, root, RUN)
    sinks.open_run(t.spark, root, LATER)
    sinks.save_stage(rows.where("obs_seq % 2 = 0"), root, "raw", LATER)
    read = sinks.read_stage(t.spark, root, "raw")
    return read.select("obs_seq", "station_id", F.date_format("observation_time", "yyyy-MM-dd HH:mm:ss").alias("observed"), "current_level", "trend")


@query("csv_stage_round_trip", "SELECT obs_seq, station_id, current_level, trend FROM obs", ["obs"], "current_level")
def _(t: Tables):
    root = shared_folder(t.spark, "round-trip")
    rows = t.obs.select("obs_seq", "station_id", "current_level", "trend")
    sinks.save_stage(rows, root, "cleaned", RUN, "csv")
    sinks.publish_run(t.spark, root, RUN)
    return sinks.read_stage(t.spark, root, "cleaned", RUN, "csv", rows._jdf.schema().toDDL())


@query("observations_from_csv", """
SELECT CAST(station_id AS VARCHAR) AS station_id, strftime(observation_time, '%Y-%m-%d %H:%M:%S') AS observed, current_level, warning_level,
 danger_level, trend, CAST(NULL AS VARCHAR) AS basin FROM obs""", ["obs"], "current_level warning_level danger_level")
def _(t: Tables):
    """Files with the columns in another order, one too many and some too few."""
    path = shared_folder(t.spark, "observations")
    text = F.date_format("observation_time", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    t.obs.select("trend", "danger_level", text, F.lit("x").alias("extra"), "current_level", "warning_level", "station_id").write.option("header", True).csv(path)
    rows = tables.read_observations(t.spark, path)
    return rows.select("station_id", F.date_format("observation_time", "yyyy-MM-dd HH:mm:ss").alias("observed"), "current_level", "warning_level", "danger_level", "trend", "basin")


@query("documents_round_trip", "SELECT doc AS json FROM doc_text", ["doc_text"])
def _(t: Tables):
    """Document texts, written twice, each in one line."""
    root = shared_folder(t.spark, "round-trip")
    for _ in range(2):
        sinks.save_documents(t.busy("doc_text").select(F.col("doc").alias("json")), root, RUN)
    return tables.read_documents(t.spark, f"{root}/documents").select("json")


MESSAGES = f"WITH {ASSESSED} SELECT obs_seq, {message(chr(39) + 'Unknown Station' + chr(39))} AS alert_message FROM assessed"


@query("alert_log_round_trip", MESSAGES.replace("SELECT obs_seq, ", "SELECT "), ["pred"])
def _(t: Tables):
    """Messages of the alert log, told apart by its rules."""
    root = shared_folder(t.spark, "round-trip")
    sinks.save_alert_log(A.with_messages(A.assess(t.busy("pred"))).withColumn("message", F.col("alert_message")), root, RUN)
    parted = t.spark.read.option("lineSep", V.ALERT_LOG_RULE + V.ALERT_LOG_GAP).text(f"{root}/alert_log")
    return parted.select(F.col("value").alias("alert_message"))


@query("alerts_from_csv", MESSAGES, ["pred"])
def _(t: Tables):
    path = shared_folder(t.spark, "alerts")
    sinks.export_alerts(A.with_messages(A.assess(t.busy("pred"))).select("obs_seq", "alert_message"), path, "csv")
    return t.spark.read.schema("obs_seq bigint, alert_message string").option("header", True).option("multiLine", True).csv(path)


@query("alerts_from_html", f"WITH {ASSESSED} SELECT obs_seq, alert_severity FROM assessed", ["pred"])
def _(t: Tables):
    """Cells of an alert table's rows, which are a line each."""
    path = shared_folder(t.spark, "alerts")
    sinks.export_alerts(A.assess(t.pred).select("obs_seq", "alert_severity"), path, "html")
    cells = F.regexp_extract_all("value", F.lit("<td>(.*?)</td>"), F.lit(1))
    rows = t.spark.read.text(path).where("value like '<tr><td>%'").select(cells.alias("c"))
    return rows.select(F.get("c", F.lit(0)).cast("long").alias("obs_seq"), F.get("c", F.lit(1)).alias("alert_severity"))


@query("snapshots_round_trip", """
SELECT station_id, CASE WHEN station_id % 2 = 0 THEN rainfall_last_6h_mm ELSE rainfall_last_6h_mm / 2 END AS rainfall_last_6h_mm FROM weather""",
       ["weather"], "rainfall_last_6h_mm")
def _(t: Tables):
    """The newest observation of each station out of a log that was appended to three times."""
    path = f"{shared_folder(t.spark, 'snapshots')}/log"
    halved = t.weather.withColumn("rainfall_last_6h_mm", F.col("rainfall_last_6h_mm") / 2)
    sinks.append_snapshot(halved, path, "observed", at() - F.expr("INTERVAL 2 HOURS"))
    sinks.append_snapshot(t.weather.where("station_id % 2 = 0"), path, "observed", at() - F.expr("INTERVAL 1 HOUR"))
    sinks.append_snapshot(halved, path, "forecast", at())
    return snapshots.live_snapshot(t.spark.read.parquet(path), at(), "observed").select("station_id", "rainfall_last_6h_mm")
