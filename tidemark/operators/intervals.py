"""Half-open intervals [start_ns, end_ns): subtraction, segmentation, stabbing joins, merging, runs and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import NS
from ..sources.paths import stored
from . import scan

BOUNDS = ("start_ns", "end_ns")
DAY_NS = 86400 * NS
#: Cells of the lowest level are 2 ** CELL_BITS ns wide (37 minutes); a stretch touches 2 ** SPREAD_BITS + 1 cells at most.
CELL_BITS, SPREAD_BITS, LEVELS = 41, 5, 18
#: No instant is so far from 1970.
END_OF_TIME = 1 << 62


def in_range(start: int | Column, end: int | Column, at: str = "start_ns") -> Column:
    """start <= at < end."""
    return (F.col(at) >= start) & (F.col(at) < end)


def overlapping(start: int | Column, end: int | Column) -> Column:
    return (F.col("start_ns") < end) & (F.col("end_ns") > start)


def positive() -> Column:
    return F.col("end_ns") > F.col("start_ns")


def bucket(x: Column, width: int) -> Column:
    """The whole number of widths below x; exact for nanoseconds, which a quotient of doubles is not."""
    return ((x - F.pmod(x, F.lit(width))) / width).cast("long")


def _level(start: str, end: str) -> Column:
    """The level whose cells a stretch touches 2 ** SPREAD_BITS + 1 of at most: their width doubles with each level."""
    over = f"shiftright(shiftright({end}, 1) - shiftright({start}, 1), {CELL_BITS + SPREAD_BITS - 1})"  # halves, as the ends of time are too far apart
    return F.expr(f"CASE WHEN {over} <= 0 THEN 0 ELSE length(bin({over})) END")


def _in_cells(df: DataFrame) -> DataFrame:
    """df (f_start_ns, f_end_ns; positive) with a row for each cell (_level, _cell) that it touches."""
    df = df.where("f_end_ns > f_start_ns").withColumn("_level", _level("f_start_ns", "f_end_ns"))
    first, last = (F.expr(f"shiftright({t}, {CELL_BITS} + _level)") for t in ("f_start_ns", "f_end_ns - 1"))
    return df.withColumn("_cell", F.explode(F.sequence(first, last)))


def _cell(at: str, level: int) -> Column:
    return F.shiftright(at, CELL_BITS + level)


def _levels(cells: DataFrame) -> list[int]:
    """The levels that occur, of LEVELS."""
    return sorted(r[0] for r in cells.select("_level").distinct().collect())


def stabbed(points: DataFrame, at: str, facts: DataFrame, by: str | None = None, few_points: bool = False) -> DataFrame:
    """Each point with every fact (columns prefixed f_) of the same ``by`` that holds it: f_start_ns <= at < f_end_ns.

    A fact is in cells of a width that fits its length, 2 ** SPREAD_BITS + 1 at most however long it is; a point is looked up
    once on each level that facts have, or, with ``few_points``, on all of them, which saves a pass over the facts.  So it is
    an equi-join, which meets each pair once and is dealt out by time.
    """
    cells = _in_cells(facts.select(*(F.col(c).alias(f"f_{c}") for c in facts.columns)))
    look = F.array(*(F.struct(F.lit(level).alias("level"), _cell(at, level).alias("cell")) for level in (range(LEVELS) if few_points else _levels(cells))))
    p = points.withColumn("_p", F.explode(look.cast("array<struct<level:int,cell:bigint>>")))
    on = (F.col("_p.level") == F.col("_level")) & (F.col("_p.cell") == F.col("_cell")) & (F.col("f_start_ns") <= F.col(at)) & (F.col(at) < F.col("f_end_ns"))
    if by is not None:
        on &= F.col(by) == F.col(f"f_{by}")
    out = p.join(cells, on).drop("_p", "_level", "_cell")
    return out if by is None else out.drop(f"f_{by}")


def outside(points: DataFrame, at: str, windows: DataFrame) -> DataFrame:
    """Points in no window (start_ns, end_ns): an anti-join on the cells of each level that windows have."""
    cells = _in_cells(windows.select(F.col("start_ns").alias("f_start_ns"), F.col("end_ns").alias("f_end_ns")))
    for level in _levels(cells):
        held = (F.col("_cell") == _cell(at, level)) & (F.col("f_start_ns") <= F.col(at)) & (F.col(at) < F.col("f_end_ns"))
        points = points.join(cells.where(F.col("_level") == level).drop("_level"), held, "left_anti")
    return points


def free_stretches(windows: DataFrame) -> DataFrame:
    """(start_ns, end_ns) of what lies before, between and after the windows, from and to the ends of time."""
    low, high = F.lit(-END_OF_TIME), F.lit(END_OF_TIME)
    busy = merge_touching(windows.select(*BOUNDS).where(positive()))
    after = scan.with_next(busy, (), ("start_ns",), {"_to": F.col("start_ns")}, DAY_NS).select(F.col("end_ns").alias("start_ns"), F.coalesce("_to", high).alias("end_ns"))
    return busy.agg(low.alias("start_ns"), F.coalesce(F.min("start_ns"), high).alias("end_ns")).unionByName(after)


def subtract(a: DataFrame, windows: DataFrame) -> DataFrame:
    """a without what the windows (start_ns, end_ns) cover; pieces keep a's other columns.

    An interval meets the free stretch that holds its start, and those that start inside it, so it costs no more than the
    pieces that are left of it, whatever the number of windows.
    """
    free = stored(free_stretches(windows), "free")
    bounds = {"_from": F.col("f_start_ns"), "_to": F.col("f_end_ns")}
    a = a.where(positive())
    at_start = stabbed(a, "start_ns", free).withColumns(bounds).select(*a.columns, *bounds)
    begins = free.where(F.col("start_ns") > -END_OF_TIME).select(F.col("start_ns").alias("_from"), F.col("end_ns").alias("_to"))
    inside = stabbed(begins, "_from", a, few_points=True).where("f_start_ns < _from").select(*(F.col(f"f_{c}").alias(c) for c in a.columns), *bounds)
    out = at_start.unionByName(inside)
    return out.withColumns({"start_ns": F.greatest("start_ns", "_from"), "end_ns": F.least("end_ns", "_to")}).where(positive()).drop(*bounds)


def merge_touching(df: DataFrame, *by: str) -> DataFrame:
    """(by.., start_ns, end_ns): intervals that overlap or touch become one."""
    df = df.select(*by, *BOUNDS)
    df = scan.running_max(df, by, BOUNDS, "_before", F.col("end_ns"), DAY_NS, inclusive=False)
    new = F.col("_before").isNull() | (F.col("start_ns") > F.col("_before"))
    df = scan.running_max(df.withColumn("_new", F.when(new, F.col("start_ns"))), by, BOUNDS, "_island", F.col("_new"), DAY_NS)
    return df.groupBy(*by, "_island").agg(F.max("end_ns").alias("end_ns")).select(*by, F.col("_island").alias("start_ns"), "end_ns")


def segment(points: DataFrame, *by: str, at: str = "t") -> DataFrame:
    """(by.., start_ns, end_ns): what lies between neighbouring distinct points."""
    order = W.partitionBy(*by).orderBy(at)
    out = points.select(*by, at).distinct().withColumn("end_ns", F.lead(at).over(order)).withColumnRenamed(at, "start_ns")
    return out.where(F.col("end_ns").isNotNull())


def stab_join(segments: DataFrame, facts: DataFrame, by: str) -> DataFrame:
    """Segments with each fact (columns prefixed f_) of the same ``by`` that covers them whole."""
    return stabbed(segments, "start_ns", facts, by).where("f_end_ns >= end_ns")


def merge_adjacent(df: DataFrame, by: tuple[str, ...], state: tuple[str, ...]) -> DataFrame:
    """Neighbours that touch and agree in ``state`` become one."""
    order = W.partitionBy(*by).orderBy("start_ns")
    same = F.lag("end_ns").over(order).eqNullSafe(F.col("start_ns"))
    for c in state:
        same &= F.lag(c).over(order).eqNullSafe(F.col(c))
    df = df.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return df.groupBy(*by, "_island").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), *(F.first(c).alias(c) for c in state)).drop("_island")


def longest_run(df: DataFrame, by: str, bad: Column) -> DataFrame:
    """(by, longest_ns): the longest run of touching intervals for which ``bad`` holds; 0 if there is none.  Intervals do not overlap."""
    df = scan.with_previous(df.select(by, *BOUNDS, bad.alias("_bad")), (by,), BOUNDS, {"_end": F.col("end_ns"), "_was": F.col("_bad")}, DAY_NS)
    goes_on = F.col("_bad") & F.coalesce(F.col("_was"), F.lit(False)) & F.col("_end").eqNullSafe(F.col("start_ns"))
    df = scan.running_max(df.withColumn("_new", F.when(~goes_on, F.col("start_ns"))), (by,), BOUNDS, "_run", F.col("_new"), DAY_NS)
    runs = df.groupBy(by, "_run").agg(F.sum(F.when(F.col("_bad"), F.col("end_ns") - F.col("start_ns")).otherwise(0)).alias("_ns"))
    return runs.groupBy(by).agg(F.max("_ns").alias("longest_ns"))


def overlaps(df: DataFrame, by: str) -> DataFrame:
    """Intervals that end after the next one of the same ``by`` begins: an audit that should find none."""
    return scan.with_next(df, (by,), BOUNDS, {"next_start_ns": F.col("start_ns")}, DAY_NS).where(F.col("next_start_ns") < F.col("end_ns"))
