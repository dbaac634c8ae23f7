"""Order statistics within groups that may hold most of the rows: prefix sums over ranges of values, ranks and exact medians.

Values are counted by group on the map side. A group's distinct values are cut into ranges by sign and magnitude, a rule
that rises with the value and needs no pass over the data; sums per range give each range its offset, so one task sorts
one range of a group and none sorts a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges for each factor of e between values.
RANGES = 16
_LARGEST = 1.7976931348623157e308


def magnitude(value: Column, ranges: int = RANGES) -> Column:
    """The range of a number; of two numbers the greater one never has the lesser range. NaN comes last."""
    v = value.cast("double")
    size = (F.floor(F.log(F.least(F.abs(v), F.lit(_LARGEST))) * ranges) + 2000 * ranges).cast("int")
    return F.when(v.isNull(), None).when(F.isnan(v), 10_000 * ranges).when(v == 0, 0).when(v > 0, size).otherwise(-size)


def _ranges(by: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each range of a group, those of the ranges before it, those of the group with a value, and all of them."""
    sums = by.groupBy(*keys, "__range").agg(F.sum("n").alias("__n"))
    w = Window.partitionBy(*keys)
    valued = F.when(F.col("__range").isNotNull(), F.col("__n"))
    before = F.coalesce(F.sum(valued).over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*keys, "__range", "__n", before.alias("__offset"), F.sum(valued).over(w).alias("total"), F.sum("__n").over(w).alias("n_rows"))


def _inside(keys: list[str], value: str) -> Column:
    return F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _counted(df: DataFrame, value: str, keys: list[str], ranges: int, weight: str | None = None) -> DataFrame:
    """Rows of each value of a group. The range is taken from an aggregate, else conditions on it would go below the
    aggregation, where the expression behind the value would be computed again for each mention."""
    by = df.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"), F.max(value).alias("__v"))
    return by.withColumn("__range", magnitude(F.col("__v"), ranges)).drop("__v")


def prefix_sums(df: DataFrame, value: str, keys: list[str], ranges: int = RANGES) -> DataFrame:
    """Each distinct value of a group with ``n``, its rows, ``before``, the group's rows of lesser values, and ``total``. NULL values are left out."""
    by = _counted(df, value, keys, ranges).where(F.col("__range").isNotNull())
    joined = by.withColumn("__inside", _inside(keys, value)).join(_ranges(by, keys), [*keys, "__range"])
    return joined.select(*keys, value, "n", (F.col("__offset") + F.col("__inside")).alias("before"), "total")


def average_rank(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """Fractional ranks within ``keys``; ties share their mean. NULLs have no rank and are left out."""
    ranked = prefix_sums(df, value, keys).select(*keys, value, (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranked, [*keys, value])


def exact_median(df: DataFrame, value: str, keys: list[str], out: str = "median", ranges: int = RANGES, weight: str | None = None) -> DataFrame:
    """The median of each group, the mean of the two middle values of an even number, and ``n_rows``, its rows with NULL values included.

    ``weight`` names a column of how many rows each row stands for.
    A group without a value has a NULL median. NaN counts as greater than all numbers, as in a sort. Only the one or two ranges
    of a group that hold its middle are sorted.
    """
    by = _counted(df, value, keys, ranges, weight)
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = (F.col("__offset") < high) & (F.col("__offset") + F.col("__n") >= low)
    target = _ranges(by, keys).where(F.col("__range").isNull() | middle)  # a group of NULLs alone keeps its row
    near = target.join(by, [*keys, "__range"], "left")
    near = near.withColumn("__before", F.col("__offset") + _inside(keys, value))
    holds = lambda place: (F.col("__before") < place) & (F.col("__before") + F.col("n") >= place)
    pick = lambda place: F.max(F.when(holds(place), F.col(value).cast("double")))
    found = near.groupBy(*keys).agg(pick(low).alias("__low"), pick(high).alias("__high"), F.max("n_rows").alias("n_rows"))
    median = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise((F.col("__low") + F.col("__high")) / 2)
    return found.select(*keys, median.alias(out), "n_rows")
