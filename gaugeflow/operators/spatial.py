"""Nearest rain grid cell per station, by branch and bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.ordered import KEY, attach, slice_in_order, slices_for
from gaugeflow.session import use_checkpoints

FAN = 3  # bits of either axis that a level opens: a bucket has at most 64 parts
_SPOT = ["latitude", "longitude"]


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _places(cells: DataFrame, axis: str, rows: int) -> DataFrame:
    """Every value of an axis with its place among the distinct ones, from 0."""
    values = cells.select(axis).distinct()
    sliced = slice_in_order(values, slices_for(cells.sparkSession, rows), F.col(axis))
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_slice", before.alias("_start"))  # one row per slice
    local = F.row_number().over(Window.partitionBy("_slice").orderBy(axis)) - 1
    return sliced.join(F.broadcast(starts), "_slice").select(axis, (F.col("_start") + local).alias(f"_{axis}"))


def _boxes(placed: DataFrame, shift: int) -> DataFrame:
    """The occupied buckets of a level: their numbers, their parent's, and the ends of what they hold."""
    keys = [F.shiftright(f"_{axis}", shift).alias(f"_{axis}") for axis in ("lat", "lon")]
    ends = [f(axis).alias(f"_{axis}_{name}") for axis in ("lat", "lon") for f, name in ((F.min, "low"), (F.max, "high"))]
    boxes = placed.groupBy(*keys).agg(*ends)
    return boxes.withColumns({f"_up_{axis}": F.shiftright(f"_{axis}", FAN) for axis in ("lat", "lon")})


def _reach(point: str, axis: str) -> tuple[Column, Column]:
    """Smallest and largest distance of a coordinate from what a bucket holds."""
    low, high, at = F.col(f"_{axis}_low"), F.col(f"_{axis}_high"), F.col(point)
    return F.greatest(low - at, at - high, F.lit(0.0)), F.greatest(high - at, at - low)


def nearest_cell(stations: DataFrame, grid: DataFrame) -> DataFrame:
    """Rain of the nearest cell (plane distance in degrees, ties to the smaller cell_id).

    Cells are first reduced to one per coordinate pair, the one with the smallest cell_id. Buckets
    are squares of *places*: a coordinate counts by its place among the distinct ones, so dense
    spots spread out and the number of levels is the logarithm of the number of cells, whatever
    the coordinates are. From the single top bucket down, a place keeps those parts of its buckets
    whose smallest distance is within the smallest of all their largest distances; at the bottom a
    bucket is one cell. Rounding keeps the order of distances, so no nearest cell is lost.

    Stations without finite coordinates, and all if the grid has no cell with them, get NULLs.
    Stations of one spot are searched once.
    """
    cells = (
        grid.filter(_finite("lat") & _finite("lon"))
        .groupBy((F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"))
        .agg(F.min_by(F.struct("cell_id", "rain_mm"), "cell_id").alias("c"))
    )
    use_checkpoints(stations.sparkSession)
    cells = cells.checkpoint()
    rows = cells.count()
    asked = stations.select(KEY, *_SPOT).distinct()
    if rows == 0:
        kinds = dict(grid.dtypes)
        return asked.select(
            KEY, *_SPOT, F.lit(None).cast(kinds["cell_id"]).alias("cell_id"), F.lit(None).cast(kinds["rain_mm"]).alias("rain_mm"),
            F.lit(None).cast("double").alias("distance"),
        )
    placed = cells
    for axis in ("lat", "lon"):
        placed = attach(placed, _places(cells, axis, rows), axis, "inner")
    placed = placed.checkpoint()
    levels = -(-max(1, (rows - 1).bit_length()) // FAN)
    spots = asked.filter(_finite("latitude") & _finite("longitude")).select(*_SPOT).distinct()
    open_ = spots.withColumns({"_up_lat": F.lit(0).cast("bigint"), "_up_lon": F.lit(0).cast("bigint")})
    spot = Window.partitionBy(*_SPOT)
    for level in reversed(range(levels)):
        met = open_.join(_boxes(placed, FAN * level), ["_up_lat", "_up_lon"])
        (near_y, far_y), (near_x, far_x) = _reach("latitude", "lat"), _reach("longitude", "lon")
        met = met.withColumns({"_near": near_y * near_y + near_x * near_x, "_far": far_y * far_y + far_x * far_x})
        kept = met.withColumn("_within", F.min("_far").over(spot)).filter(F.col("_near") <= F.col("_within"))
        open_ = kept.select(*_SPOT, F.col("_lat").alias("_up_lat"), F.col("_lon").alias("_up_lon"), "_near")
    bottom = placed.select(F.col("_lat").alias("_up_lat"), F.col("_lon").alias("_up_lon"), "c")
    best = open_.join(bottom, ["_up_lat", "_up_lon"]).groupBy(*_SPOT).agg(
        F.min(F.struct("_near", F.col("c.cell_id").alias("cell_id"), F.col("c.rain_mm").alias("rain_mm"))).alias("b"))
    found = best.select(*_SPOT, "b.cell_id", "b.rain_mm", F.sqrt("b._near").alias("distance"))
    return attach(asked, found, _SPOT, sized_by=spots).select(KEY, *_SPOT, "cell_id", "rain_mm", "distance")
