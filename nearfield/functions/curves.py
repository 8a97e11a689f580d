"""Space-filling order and fronts of points in the plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hilbert(x: Column, y: Column, order: int) -> Column:
    """Place of a grid cell on the Hilbert curve over 2**order by 2**order cells."""
    bits = F.array(*[F.struct(F.lit(1 << k).cast("long").alias("s"), F.lit(1 << (2 * k)).cast("long").alias("quarter")) for k in range(order - 1, -1, -1)])
    begin = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("place"))

    def step(at: Column, bit: Column) -> Column:
        s = bit["s"]
        right, up = at["x"].bitwiseAND(s) != 0, at["y"].bitwiseAND(s) != 0
        low_x, low_y = at["x"].bitwiseAND(s - 1), at["y"].bitwiseAND(s - 1)
        number = F.when(~right & ~up, 0).when(~right, 1).when(up, 2).otherwise(3)
        # the first quarter of the curve is transposed, the last against the other diagonal
        return F.struct(
            F.when(up, low_x).when(right, s - 1 - low_y).otherwise(low_y).alias("x"),
            F.when(up, low_y).when(right, s - 1 - low_x).otherwise(low_x).alias("y"),
            (at["place"] + number * bit["quarter"]).alias("place"),
        )

    return F.aggregate(bits, begin, step, lambda at: at["place"])


def on_grid(df: DataFrame, x: str, y: str, order: int) -> DataFrame:
    """``df`` with ``gx`` and ``gy``, the columns scaled to whole numbers below 2**order; one extent pass."""
    most = (1 << order) - 1
    ends = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    scaled = lambda c, a, b: F.when(F.col(b) > F.col(a), (F.col(c) - F.col(a)) / (F.col(b) - F.col(a)) * most).otherwise(0).cast("int")
    return df.crossJoin(F.broadcast(ends)).withColumns({"gx": scaled(x, "x0", "x1"), "gy": scaled(y, "y0", "y1")}).drop("x0", "x1", "y0", "y1")


def pareto(df: DataFrame, x: str, y: str, by: tuple[str, ...] = (), x_up: bool = True, y_up: bool = True) -> DataFrame:
    """Rows that no other of their group beats: none has a better y at a better or equal x.

    Of rows with equal y, the one with the best x stays, and of equal rows one.
    The best y of each x comes first, so a group is as large as it has x values.
    """
    best = F.max(y) if y_up else F.min(y)
    one = df.groupBy(*by, x).agg(best.alias(y))
    order = F.col(x).desc() if x_up else F.col(x).asc()
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    led = (F.max(y) if y_up else F.min(y)).over(before)
    better = F.col(y) > F.col("_led") if y_up else F.col(y) < F.col("_led")
    return one.withColumn("_led", led).where(F.col("_led").isNull() | better).drop("_led")
