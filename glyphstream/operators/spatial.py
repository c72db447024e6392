"""Points in rectangles as an equality join on grid cells.

A rectangle goes to the grid whose cells are just larger than it, in each direction a power of four, and so to four cells at most, whatever its size; a point goes to its
cell of each grid that any rectangle uses. Cells are joined by equality, the rectangle itself is the rest of the condition. Few rectangles are
broadcast; else the join is by shuffle, where adaptive execution splits a cell that very many points lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 4


def _level(extent: Column) -> Column:
    """The grid for an extent: its cells are STEP ** level, more than the extent."""
    return F.ceil(F.log(float(STEP), extent + 1) + 1e-9).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(float(STEP)), level)).cast("long")


def _sized(places: DataFrame) -> DataFrame:
    whole = places.where((_double("y1") >= _double("y0")) & (_double("x1") >= _double("x0")))
    return whole.withColumns({"_ly": _level(_double("y1") - _double("y0")), "_lx": _level(_double("x1") - _double("x0"))})


def _double(c: str) -> Column:
    return F.col(c).cast("double")


def grids(places: DataFrame) -> list[tuple[int, int]]:
    """The grids that places (y0, x0, y1, x1) use, some hundred at most."""
    return sorted(map(tuple, _sized(places).select("_ly", "_lx").distinct().collect()))


def contained(points: DataFrame, places: DataFrame, page: str) -> DataFrame:
    """A row for each point (page, y, x) in a place (page, y0, x0, y1, x1), edges included: the columns of both, page once.

    Other columns of the two have different names, none of which begins with an underscore. Nulls lie nowhere, and a place whose end is before its start has no points. The
    driver gets the sizes of grids, some hundred at most.
    """
    double, sized = _double, _sized(places)
    span = lambda a, b, level: F.explode(F.sequence(_cell(double(a), F.col(level)), _cell(double(b), F.col(level))))
    tiles = sized.withColumn("_cy", span("y0", "y1", "_ly")).withColumn("_cx", span("x0", "x1", "_lx"))
    used = grids(places)
    each = F.array(*(F.struct(F.lit(a).alias("_ly"), F.lit(b).alias("_lx")) for a, b in used)) if used else F.expr("cast(array() as array<struct<_ly:int,_lx:int>>)")
    dealt = points.select("*", F.inline(each)).withColumns({"_cy": _cell(double("y"), F.col("_ly")), "_cx": _cell(double("x"), F.col("_lx"))})
    met = dealt.join(tiles, [page, "_ly", "_lx", "_cy", "_cx"])
    inside = double("y").between(double("y0"), double("y1")) & double("x").between(double("x0"), double("x1"))
    return met.where(inside).drop("_ly", "_lx", "_cy", "_cx")


def contained_by_page(d: DataFrame, page: str, at: str, used: list[tuple[int, int]]) -> DataFrame:
    """contained() of one table with points (page, y, x, ``at`` null) and places (page, ``at``: struct of y0, x0, y1, x1 and more), without a shuffle if it is partitioned by page.

    A row for each point in a place, which ``at`` tells, and for each cell of each place one without a point; a place that no point can lie in has one too. used: grids(). A cell is
    in one task.
    """
    double = lambda c: F.col(f"{at}.{c}").cast("double")
    cell = lambda ly, lx, cy, cx: F.struct(ly.cast("int").alias("_ly"), lx.cast("int").alias("_lx"), cy.alias("_cy"), cx.alias("_cx"))
    of_point = F.array(*(cell(F.lit(a), F.lit(b), _cell(_double("y"), F.lit(a)), _cell(_double("x"), F.lit(b))) for a, b in used))
    ly, lx = _level(double("y1") - double("y0")), _level(double("x1") - double("x0"))
    span = lambda a, b, level: F.sequence(_cell(double(a), level), _cell(double(b), level))
    of_place = F.flatten(F.transform(span("y0", "y1", ly), lambda cy: F.transform(span("x0", "x1", lx), lambda cx: cell(ly, lx, cy, cx))))
    whole = (double("y1") >= double("y0")) & (double("x1") >= double("x0"))
    none = F.array(cell(*(F.lit(None).cast("long") for _ in range(4))))
    # Arrays are columns of their own before they are exploded, as generators evaluate expressions row by row in no generated code.
    point = F.col(at).isNull()
    d = d.withColumn("_cells", F.when(point, of_point).when(whole, of_place).otherwise(none) if used else F.when(~point, none))
    d = d.select("*", F.inline("_cells")).drop("_cells")
    found = F.collect_list(at).over(Window.partitionBy(page, "_ly", "_lx", "_cy", "_cx"))
    d = d.withColumn("_found", found).withColumn("_found", F.when(point, F.col("_found")).otherwise(F.array(at)))
    d = d.select("*", F.explode("_found").alias("_hit"))
    hit = lambda c: F.col(f"_hit.{c}").cast("double")
    inside = _double("y").between(hit("y0"), hit("y1")) & _double("x").between(hit("x0"), hit("x1"))
    return d.where(~point | inside).withColumn(at, F.col("_hit")).drop("_ly", "_lx", "_cy", "_cx", "_found", "_hit")
