"""Work on the rows of a station in order, also when one station is huge.

Most stations fit into one task, so their rows are hashed by station and read
with ordinary windows. A station with more than HOT_ROWS rows is found by a
count up front; its rows are range-partitioned by (station, order) into slices
of similar size, written to the checkpoint folder so the slice borders stay put,
and windows run per slice. What earlier slices contribute to a slice is carried
over through one small row per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.session import use_checkpoints

HOT_ROWS = 4_000_000
BROADCAST_ROWS = 200_000

TIME = "observation_time"
SEQ = "obs_seq"
KEY = "station_id"
LEVEL = "current_level"
US = "_us"


@dataclass(frozen=True)
class HotKeys:
    """Keys above the row limit, as a side table `_hot` of at most total_rows / limit rows.

    The driver knows their number and their rows only; tables are parted by joins with the side table.
    """

    key: str
    table: DataFrame | None = None
    count: int = 0
    rows: int = 0
    slice_rows: int = HOT_ROWS

    def part(self, df: DataFrame, how: str) -> DataFrame:
        """Rows of the hot keys (left_semi) or of all others (left_anti); a missing key is a key."""
        side = F.broadcast(self.table) if self.count <= BROADCAST_ROWS else self.table
        return df.join(side, F.col(self.key).eqNullSafe(F.col("_hot")), how)


def find_hot(df: DataFrame, key: str = KEY, limit: int = HOT_ROWS, slice_rows: int | None = None) -> HotKeys:
    """Count rows per key (combined map-side); keys above the limit are written as a side table."""
    heavy = df.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    count, rows = heavy.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not count:
        return HotKeys(key)
    use_checkpoints(df.sparkSession)
    return HotKeys(key, heavy.select("_hot").checkpoint(), count, rows, slice_rows or limit)


@dataclass(frozen=True)
class Lane:
    """How rows of a key are laid out: whole keys, or ordered slices of keys (`rows` of them in all, where known)."""

    key: str = KEY
    parts: int = 0
    rows: int = 0

    @property
    def sliced(self) -> bool:
        return self.parts > 0

    def arrange(self, df: DataFrame, *order: Column) -> tuple[DataFrame, list[str]]:
        """Rows plus the columns that group them into one window partition."""
        if not self.sliced:
            return df, [self.key]
        ranged = slice_in_order(df, self.parts, F.col(self.key).asc_nulls_first(), *order)
        return ranged, [self.key, "_slice"]

    def carry(
        self,
        df: DataFrame,
        name: str,
        per_slice: Column,
        combine: Callable[[Column], Column],
        following: bool = False,
    ) -> DataFrame:
        """Add what all earlier (or following) slices of the key hold."""
        summary = self.carried(df, name, per_slice, combine, following)
        match = (F.col(self.key).eqNullSafe(F.col("_carry_key"))) & (F.col("_slice") == F.col("_carry_slice"))
        return df.join(F.broadcast(summary), match, "left").drop("_carry_key", "_carry_slice")

    def carried(
        self, df: DataFrame, name: str, per_slice: Column, combine: Callable[[Column], Column], following: bool = False
    ) -> DataFrame:
        """What earlier (or following) slices of a key hold, for the slices of keys that have any.

        Slices are in the order of the keys: only the first key of a slice can have begun in an
        earlier one, and only the last can go on. So there is at most one row for a slice, however
        many keys there are, and the table can be broadcast.
        """
        border = F.col("_slice").desc() if following else F.col("_slice").asc()
        ordered = Window.partitionBy(self.key).orderBy(border)
        summary = df.groupBy(self.key, "_slice").agg(per_slice.alias("_own"))
        placed = summary.select(
            F.col(self.key).alias("_carry_key"),
            F.col("_slice").alias("_carry_slice"),
            combine(F.col("_own")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias(name),
            F.row_number().over(ordered).alias("_nth"),
        )
        return placed.filter(F.col("_nth") > 1).drop("_nth")


def slice_in_order(df: DataFrame, parts: int, *order: Column) -> DataFrame:
    """Split a whole table into similar-sized, globally ordered slices (_slice)."""
    use_checkpoints(df.sparkSession)
    ranged = df.drop("_slice").repartitionByRange(parts, *order)
    return ranged.withColumn("_slice", F.spark_partition_id()).checkpoint()


def slices_for(spark, rows: int) -> int:
    """How many ordered slices a table of that many rows needs, never fewer than the session's partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * rows // HOT_ROWS))


@dataclass(frozen=True)
class Step:
    """One order-dependent operator: rows and lane in, rows out."""

    run: Callable[[DataFrame, Lane], DataFrame]
    options: dict = field(default_factory=dict)

    def __call__(self, df: DataFrame, lane: Lane) -> DataFrame:
        return self.run(df, lane, **self.options)


def per_station(
    df: DataFrame, steps: Sequence[Step], key: str = KEY, hot: HotKeys | None = None, limit: int = HOT_ROWS
) -> DataFrame:
    """Apply steps to every station; hot stations take the sliced lane.

    Steps that run one after the other in the whole-key lane share one exchange.
    """
    hot = find_hot(df, key, limit) if hot is None else hot

    def through(rows: DataFrame, lane: Lane) -> DataFrame:
        for step in steps:
            rows = step(rows, lane)
        return rows.drop("_slice")

    if not hot.count:
        return through(df, Lane(key))
    # Every slice costs border samples on the driver and a block in each task: there are no more than the rows need.
    parts = max(2, min(-(-2 * hot.rows // hot.slice_rows), slices_for(df.sparkSession, hot.rows)))
    usual = through(hot.part(df, "left_anti"), Lane(key))
    heavy = through(hot.part(df, "left_semi"), Lane(key, parts, hot.rows))
    return usual.unionByName(heavy)


def timed(df: DataFrame, time: str = TIME) -> DataFrame:
    """Add the microsecond order column all time windows share, unless it is there.

    Operators called on an already timed table keep the column, so that windows
    of several operators also share one sort.
    """
    return df if US in df.columns else df.withColumn(US, F.unix_micros(F.col(time).cast("timestamp")))


def as_before(rows: DataFrame, given: DataFrame) -> DataFrame:
    """Drop the order column again if the given table came without it."""
    return rows if US in given.columns else rows.drop(US)


def time_order(seq: str = SEQ) -> list[Column]:
    return [F.col(US).asc_nulls_last(), F.col(seq).asc_nulls_last()]


def running(by: list[str], *order: Column):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def numbered(df: DataFrame, lane: Lane, by: list[str], order: list[Column], name: str = "_pos") -> DataFrame:
    """Position of each row among the rows of its station."""
    rows = df
    if lane.sliced:
        rows = lane.carry(rows, "_ahead", F.count(F.lit(1)), F.sum)
    local = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    if not lane.sliced:
        return rows.withColumn(name, local)
    return rows.withColumn(name, local + F.coalesce("_ahead", F.lit(0))).drop("_ahead")


def previous_level(df: DataFrame, lane: Lane, level: str, seq: str, name: str) -> DataFrame:
    """Add the level of the preceding row of the station (time order, ties by seq)."""
    rows, by = lane.arrange(df, *time_order(seq))
    in_order = Window.partitionBy(*by).orderBy(*time_order(seq))
    if not lane.sliced:
        return rows.withColumn(name, F.lag(level).over(in_order))
    newest = F.max(F.struct(F.col(US).isNull(), F.col(US), F.col(seq), F.col(level).alias("v")))
    rows = lane.carry(rows, "_before", newest, F.max)
    local = F.lag(F.struct(F.col(level).alias("v"))).over(in_order)
    return rows.withColumn(
        name, F.when(local.isNotNull(), local["v"]).otherwise(F.col("_before")["v"])
    ).drop("_before")


def fold_until(
    rows: DataFrame, facts: DataFrame, lane: Lane, at: Column, folds: dict[str, tuple[Column, Callable]]
) -> DataFrame:
    """For each row, fold the facts of its station that are not later than `at`.

    For sliced lanes: a row is sent to the slice of the moment it asks about, so
    nothing is replicated. `facts` has the key, US and the columns the folds use;
    each fold is (value per fact, max or sum), applied to slices alike.
    """
    asked = rows.drop("_slice").select(
        lane.key, at.alias("_at"), F.lit(1).alias("_ask"), F.struct(F.col("*")).alias("_row")
    )
    known = facts.filter(F.col(US).isNotNull()).select(
        lane.key, F.col(US).alias("_at"), F.lit(0).alias("_ask"),
        *[value.alias(name) for name, (value, _) in folds.items()],
    )
    both = known.unionByName(asked, allowMissingColumns=True)
    both, by = lane.arrange(both, F.col("_at").asc_nulls_last(), F.col("_ask"))
    whole = Window.partitionBy(*by).orderBy(F.col("_at").asc_nulls_last(), F.col("_ask"))
    # RANGE up to the current (_at, _ask) pair: all facts of the same instant count.
    upto = whole.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for name, (_, fold) in folds.items():
        both = lane.carry(both, f"_c_{name}", fold(F.col(name)), fold)
        here, earlier = fold(F.col(name)).over(upto), F.col(f"_c_{name}")
        total = F.coalesce(here + earlier, here, earlier) if fold is F.sum else F.greatest(here, earlier)
        both = both.withColumn(f"_r_{name}", total)
    return both.filter("_ask = 1").select(
        "_row.*", *[F.when(F.col("_at").isNotNull(), F.col(f"_r_{n}")).alias(n) for n in folds]
    )


def attach(
    df: DataFrame,
    side: DataFrame,
    on: str | list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Join a side that is broadcast only if counted to be small.

    Otherwise it is a shuffle join, where adaptive execution splits hot keys.
    `sized_by` is a table with at least as many rows that is cheaper to count.
    """
    counted = side if sized_by is None else sized_by
    small = counted.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(side) if small else side, on, how)
