"""Positions and neighbours in a global order without a single-partition window.

Rows are dealt by ranges of the order and sorted within their part; the part and the place in it are
written down, so that they are fixed. Parts are then numbered by their sizes: the only unpartitioned
windows see one row per part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

#: monotonically_increasing_id() has the part above these bits and the place in it below.
_PLACE_BITS = 33


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with __part and __place, ascending with `order`; a written table."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = parts.withColumn("__id", F.monotonically_increasing_id())
    marked = marked.withColumn("__part", F.shiftright("__id", _PLACE_BITS)).withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    return written(marked.drop("__id"), "order")


def _offsets(dealt: DataFrame) -> DataFrame:
    """(__p, __before, __total): a row per part."""
    sizes = dealt.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"), F.sum("n").over(Window.partitionBy()).alias("__total"))


def _numbered(dealt: DataFrame, position: str, total: str) -> DataFrame:
    found = dealt.join(F.broadcast(_offsets(dealt)), F.col("__part") == F.col("__p"))
    return found.select(*dealt.columns, (F.col("__before") + F.col("__place") + 1).alias(position), F.col("__total").alias(total))


def _neighboured(dealt: DataFrame, columns: dict[str, tuple[str, int]], default: str) -> DataFrame:
    within, across = Window.partitionBy("__part").orderBy("__place"), Window.orderBy("__p")
    row = F.struct(*sorted({c for c, _ in columns.values()}))  # a row that is there is never null, whatever its values
    ends = dealt.groupBy(F.col("__part").alias("__p")).agg(F.min_by(row, "__place").alias("first"), F.max_by(row, "__place").alias("last"))
    edges = ends.select("__p", F.lag("last", 1).over(across).alias("__over_before"), F.lead("first", 1).over(across).alias("__over_after"))
    found = dealt.select("*", F.lag(row, 1).over(within).alias("__near_before"), F.lead(row, 1).over(within).alias("__near_after")).join(edges, F.col("__part") == F.col("__p"))
    before, after = F.coalesce("__near_before", "__over_before"), F.coalesce("__near_after", "__over_after")
    near = lambda at: before if at < 0 else after
    filled = [F.when(near(at).isNull(), default).otherwise(near(at)[c]).alias(n) for n, (c, at) in columns.items()]
    return found.select(*[c for c in dealt.columns if c not in columns], *filled)


def positions(df: DataFrame, *order: Column, position: str = "position", total: str = "total") -> DataFrame:
    """df with each row's position (from 1) in the order, and the number of rows. Rows that tie on all of `order` get some order."""
    return _numbered(_dealt(df, list(order)), position, total).drop("__part", "__place")


def with_neighbours(df: DataFrame, order: list[Column], columns: dict[str, tuple[str, int]], default: str = "") -> DataFrame:
    """df with columns of the row before or after in the order: {new: (column, -1 or 1)}; `default` at the ends; a neighbour's null stays null.

    Within a part by a window over the part. A part's first and last row look across its edge into a table
    with one row per part.
    """
    return _neighboured(_dealt(df, order), columns, default).drop("__part", "__place")


def positions_and_neighbours(df: DataFrame, order: list[Column], columns: dict[str, tuple[str, int]], default: str = "", position: str = "position", total: str = "total") -> DataFrame:
    """with_neighbours() and positions() of one and the same order, dealt and written once."""
    return _numbered(_neighboured(_dealt(df, order), columns, default), position, total).drop("__part", "__place")
