"""Joins of points with shapes on the leaves of a tree that is deep where points are dense.

The tree is made from counts of points: a node with more than `most` of them is divided into
8 x 8, down to cells of 0.09 by 0.04 degrees. Points belong to one leaf; shapes are cut into the
leaves that their boxes touch, level by level, so a wide shape over an empty ocean is one row and
one over a busy coast is many small ones. A leaf of the last level that is still too full (a
harbour with a third of all points) is dealt over as many salts as it has shares of `most`, and
shapes visit each. The tree has a node for every few `most` points and is broadcast only while it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import durable

BITS = 12
LEVELS = (0, 3, 6, 9, 12)
MOST = 20_000
FEW_NODES = 100_000  # a tree of so many is broadcast


def _step(degrees: Column, least: float, span: float) -> Column:
    """Place along an axis in cells of the last level."""
    at = F.floor((degrees - least) / span * (1 << BITS)).cast("long")
    return F.least(F.greatest(at, F.lit(0).cast("long")), F.lit((1 << BITS) - 1).cast("long"))


def _at(level: int, step: Column) -> Column:
    return F.shiftright(step, BITS - level)


def tree(points: DataFrame, lat: str, lng: str, most: int = MOST) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, leaves, few): (level, x, y) of nodes with children, and (level, x, y, salts) of leaves with points.

    The points are counted when the tree is made, once for all the levels that meet it.
    """
    cells = points.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    cells = cells.groupBy(_step(F.col(lng), -180.0, 360.0).alias("_x"), _step(F.col(lat), -90.0, 180.0).alias("_y")).agg(F.count(F.lit(1)).alias("n"))
    node = F.array(*[F.struct(F.lit(level).alias("level"), _at(level, F.col("_x")).alias("x"), _at(level, F.col("_y")).alias("y")) for level in LEVELS])
    counts = cells.select(F.explode(node).alias("c"), "n").groupBy("c.level", "c.x", "c.y").agg(F.sum("n").alias("n"))
    full = (F.col("n") > most) & (F.col("level") < LEVELS[-1])
    nodes = counts.filter(full).select("level", "x", "y")
    parents = nodes.select((F.col("level") + 3).alias("level"), F.col("x").alias("px"), F.col("y").alias("py"))
    ends = counts.filter(~full).withColumns({"px": F.shiftright("x", 3), "py": F.shiftright("y", 3)})
    under = ends.join(parents, ["level", "px", "py"], "left_semi").unionByName(ends.filter("level = 0"))
    under = under.select("level", "x", "y", F.ceil(F.col("n") / F.lit(most)).cast("int").alias("salts"))
    made = durable(nodes.withColumn("salts", F.lit(0)).unionByName(under))
    few = made.count() <= FEW_NODES
    hinted = F.broadcast(made) if few else made
    return hinted.filter("salts = 0").drop("salts"), hinted.filter("salts > 0"), few


def point_leaves(points: DataFrame, lat: str, lng: str, leaves: DataFrame, salt_by: Column, few: bool = False) -> DataFrame:
    """Points with `_level`, `_leaf_x`, `_leaf_y`, `_salt` of the leaf they are in."""
    placed = points.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).withColumns({"_x": _step(F.col(lng), -180.0, 360.0), "_y": _step(F.col(lat), -90.0, 180.0)})
    node = F.array(*[F.struct(F.lit(level).alias("level"), _at(level, F.col("_x")).alias("x"), _at(level, F.col("_y")).alias("y")) for level in LEVELS])
    salt = F.pmod(salt_by, F.col("salts")).cast("int")
    names = {"level": "_level", "x": "_leaf_x", "y": "_leaf_y"}
    if few:
        met = placed.withColumn("_c", F.explode(node)).withColumns({"level": F.col("_c.level"), "x": F.col("_c.x"), "y": F.col("_c.y")}).join(leaves, ["level", "x", "y"])
        return met.withColumn("_salt", salt).select(*points.columns, *[F.col(c).alias(n) for c, n in names.items()], "_salt")
    # The leaf is found once for every cell that has points, not for every point.
    cells = placed.select("_x", "_y").distinct().withColumn("c", F.explode(node)).select("_x", "_y", "c.*").join(leaves, ["level", "x", "y"])
    where = cells.select("_x", "_y", *[F.col(c).alias(n) for c, n in names.items()], "salts")
    return placed.join(where, ["_x", "_y"]).withColumn("_salt", salt).drop("_x", "_y", "salts")


def shape_leaves(shapes: DataFrame, nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Shapes once for every leaf and salt that their box (`_west`, `_south`, `_east`, `_north`, none across the date line) touches."""
    steps = {"_x0": _step(F.col("_west"), -180.0, 360.0), "_x1": _step(F.col("_east"), -180.0, 360.0), "_y0": _step(F.col("_south"), -90.0, 180.0), "_y1": _step(F.col("_north"), -90.0, 180.0)}
    # The root is worked out from columns: by a literal the first join would have no key, and be a nested loop.
    front = shapes.withColumns(steps).withColumns({"x": _at(0, F.col("_x0")), "y": _at(0, F.col("_y0"))})
    out = None
    for level in LEVELS:
        here = leaves.filter(F.col("level") == level).drop("level")
        found = front.join(here, ["x", "y"]).withColumn("_level", F.lit(level))
        out = found if out is None else out.unionByName(found)
        if level == LEVELS[-1]:
            break
        inner = front.join(nodes.filter(F.col("level") == level).drop("level"), ["x", "y"])
        for axis in ("x", "y"):
            first = F.greatest(F.shiftleft(axis, 3), _at(level + 3, F.col(f"_{axis}0")))
            last = F.least(F.shiftleft(axis, 3) + 7, _at(level + 3, F.col(f"_{axis}1")))
            inner = inner.withColumn(axis, F.explode(F.when(first <= last, F.sequence(first, last))))
        front = inner
    salted = out.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return salted.drop("salts", "_x0", "_x1", "_y0", "_y1").withColumnsRenamed({"x": "_leaf_x", "y": "_leaf_y"})


LEAF = ["_level", "_leaf_x", "_leaf_y", "_salt"]


def boxes_of(west: Column, south: Column, east: Column, north: Column) -> Column:
    """One box, or two where it crosses the date line, as an array to explode into `shape_leaves`' columns."""
    box = lambda w, e: F.struct(w.alias("_west"), south.alias("_south"), e.alias("_east"), north.alias("_north"))
    return F.when(west <= east, F.array(box(west, east))).otherwise(F.array(box(west, F.lit(180.0)), box(F.lit(-180.0), east)))


def circle_box(lat: Column, lng: Column, radius_km: Column) -> Column:
    """Boxes around a circle, a little wide; the whole width where it holds a pole."""
    delta = F.least(radius_km * (1.01 / 110.574), F.lit(180.0))
    sin_half = F.sin(F.radians(F.least(delta, F.lit(90.0)))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))
    whole = (F.abs(lat) + delta >= 89.9) | (sin_half >= 1)
    half = F.when(whole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), sin_half))) * 1.001 + 1e-6)
    turn = lambda v: F.pmod(v + 180.0, F.lit(360.0)) - 180.0
    south, north = F.greatest(lat - delta, F.lit(-90.0)), F.least(lat + delta, F.lit(90.0))
    all_round = boxes_of(F.lit(-180.0), south, F.lit(180.0), north)
    west = turn(lng - half)
    # A circle that reaches the date line from the east also holds points at 180 degrees.
    west = F.when(west <= -180.0 + 1e-5, F.lit(180.0)).otherwise(west)
    return F.when(half >= 180.0, all_round).otherwise(boxes_of(west, south, turn(lng + half), north))
