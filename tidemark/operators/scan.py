"""Scans of long logs in two levels: each piece of a key's log by itself, and what one piece hands to the next.

A piece is all rows of a key whose order lies in one stretch of ``width``: a day of nanoseconds, or some ids.  So a
log of a single host or collector is dealt out by pieces.  The summary that is carried over has one row a piece.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Ids of a piece of a log that is ordered by ids.
IDS = 1 << 16
PIECE, CARRIED = "_piece", "_carried"


def piece(order: str, width: int) -> Column:
    """The number of the stretch, in whole numbers; a negative order has the stretch below it."""
    return F.expr(f"(`{order}` - pmod(`{order}`, {width}L)) div {width}L")


def _with_carried(df: DataFrame, keys: Sequence[str], carried: DataFrame) -> DataFrame:
    """df (keys, PIECE) with CARRIED of carried (keys, PIECE, CARRIED), one row a piece; null keys are keys, too."""
    names = [*keys, PIECE]
    carried = carried.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), CARRIED)
    on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)))
    return df.join(carried, on, "left").drop(*(f"_k{i}" for i in range(len(names))))


def _neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], width: int, ahead: bool) -> DataFrame:
    step, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    df = df.withColumn(PIECE, piece(order[0], width)).withColumn("_own", F.struct(*(v.alias(n) for n, v in values.items())))
    ends = df.groupBy(*keys, PIECE).agg(edge("_own", F.struct(*order)).alias("_end"))
    ends = ends.withColumn(CARRIED, step("_end").over(W.partitionBy(*keys).orderBy(PIECE)))
    w = W.partitionBy(*keys, PIECE).orderBy(*order)
    out = _with_carried(df.withColumns({"_near": step("_own").over(w), "_inside": step(F.lit(True)).over(w)}), keys, ends)
    near = F.when(F.col("_inside"), F.col("_near")).otherwise(F.col(CARRIED))
    out = out.withColumn("_near", near).withColumns({n: F.col("_near")[n] for n in values})
    return out.drop(PIECE, "_own", "_near", "_inside", CARRIED)


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], width: int) -> DataFrame:
    """df with columns of the row before of the same keys; null for a key's first row.  The first order is a long, not null."""
    return _neighbour(df, keys, order, values, width, ahead=False)


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], width: int) -> DataFrame:
    """df with columns of the row after of the same keys; null for a key's last row."""
    return _neighbour(df, keys, order, values, width, ahead=True)


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, value: Column, width: int, inclusive: bool = True) -> DataFrame:
    """df with the greatest value of the rows up to each one, or of those before it; null if there is none."""
    df = df.withColumn(PIECE, piece(order[0], width)).withColumn("_own", value)
    most = df.groupBy(*keys, PIECE).agg(F.max("_own").alias("_end"))
    before = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    most = most.withColumn(CARRIED, F.max("_end").over(before))
    w = W.partitionBy(*keys, PIECE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = _with_carried(df.withColumn("_near", F.max("_own").over(w)), keys, most)
    return out.withColumn(name, F.greatest("_near", CARRIED)).drop(PIECE, "_own", "_near", CARRIED)


def windowed_count(df: DataFrame, keys: Sequence[str], order: str, reach: int, name: str, width: int) -> DataFrame:
    """df with the number of rows of the same keys whose order lies in the ``reach`` up to each row's; reach is at most width.

    Rows near a piece's end are counted in the next piece as well.
    """
    if reach > width:
        raise ValueError("a row can reach one piece ahead only")
    here, there = piece(order, width), F.expr(f"(`{order}` + {reach}L - pmod(`{order}` + {reach}L, {width}L)) div {width}L")
    df = df.withColumn(PIECE, F.explode(F.array_distinct(F.array(here, there)))).withColumn("_guest", F.col(PIECE) != here)
    w = W.partitionBy(*keys, PIECE).orderBy(order).rangeBetween(-reach, 0)
    return df.withColumn(name, F.count("*").over(w)).where(~F.col("_guest")).drop(PIECE, "_guest")
