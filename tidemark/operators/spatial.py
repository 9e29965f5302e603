"""Radius and containment joins as equi-joins on grid cells.

Every join here explodes one side into the cells its circle touches, keeps one cell per
point on the other side, joins on the cell key and then tests the exact distance. So no
pair repeats and no nested loop is planned. Cells that hold very many points are salted:
their points spread over several join keys and the probing side visits each of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import EARTH_KM, arc_m, chord, chord_limit, geodesic_of, point_in_ring, unit_vector

_ROW = 1_000_000  # cell key = row * _ROW + column
HOT_CELL = 20_000  # points per cell and salt
MAX_HOT_CELLS = 10_000  # longest list of salted cells that is broadcast


def cell_size_deg(radius_m: float) -> float:
    """Rows as high as the radius, so that a circle touches at most three of them."""
    return min(30.0, max(radius_m * 1.01 / 110_574.0, 1e-3))


def _columns_in_row(row: Column, size: float) -> Column:
    """Cells of a latitude row; rows shrink towards the poles so that cells stay square-ish."""
    south = row * size - 90
    nearest_equator = F.least(F.abs(south), F.abs(south + size))
    crosses = (south < 0) & (south + size > 0)
    cos = F.when(crosses, F.lit(1.0)).otherwise(F.cos(F.radians(F.least(nearest_equator, F.lit(90.0)))))
    return F.greatest(F.lit(1), F.floor(360 * cos / size)).cast("bigint")


def cell_of(lat: Column, lng: Column, size: float) -> Column:
    row = F.floor((lat + 90) / size).cast("bigint")
    n = _columns_in_row(row, size)
    col = F.pmod(F.floor((lng + 180) / 360 * n).cast("bigint"), n)
    return row * _ROW + col


def explode_cells(df: DataFrame, at: tuple[str, str], radius_m: float | Column, size: float) -> DataFrame:
    """Each row once per cell (`_cell`) that its circle touches, across the date line and around the poles.

    Two plain explodes, first over latitude rows and then over the columns of a row: both
    compile into the surrounding stage, which nested array functions do not.
    """
    lat, lng = F.col(at[0]), F.col(at[1])
    radius = radius_m if isinstance(radius_m, Column) else F.lit(float(radius_m))
    delta = F.least(radius * (1.01 / 110_574.0), F.lit(180.0))  # degrees, widened for the ellipsoid
    first = F.greatest(F.lit(0), F.floor((lat - delta + 90) / size)).cast("bigint")
    last = F.least(F.lit(int(math.floor(180 / size))), F.floor((lat + delta + 90) / size)).cast("bigint")
    sin_half = F.sin(F.radians(F.least(delta, F.lit(90.0)))) / F.cos(F.radians(lat))
    polar = (F.abs(lat) + delta >= 89.9) | (sin_half >= 1)
    half = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), sin_half))))
    rows = df.withColumn("_half", half).withColumn("_row", F.explode(F.sequence(first, last)))
    n = F.col("_n")
    edge = lambda side: F.floor((lng + side * F.col("_half") + 180) / 360 * n).cast("bigint")
    spans = rows.withColumn("_n", _columns_in_row(F.col("_row"), size)).withColumns({"_west": edge(-1), "_east": edge(1)})
    whole = F.col("_east") - F.col("_west") + 1 >= n
    columns = F.sequence(F.when(whole, F.lit(0)).otherwise(F.col("_west")), F.when(whole, n - 1).otherwise(F.col("_east")))
    return (
        spans.withColumn("_column", F.explode(columns))
        .withColumn("_cell", F.col("_row") * _ROW + F.pmod(F.col("_column"), n))
        .drop("_half", "_row", "_n", "_west", "_east", "_column")
    )


def _with_vector(df: DataFrame, at: tuple[str, str], name: str, ellipsoid: bool = True) -> DataFrame:
    parts = unit_vector(F.col(at[0]), F.col(at[1]), ellipsoid)
    return df.withColumns({f"_{name}{i}": p for i, p in enumerate(parts)})


def _close(pairs: DataFrame, u: str, v: str, radius_m: float, ellipsoid: bool = True, earth_km: float = EARTH_KM) -> DataFrame:
    """Keep the pairs within the radius: a chord test without trigonometry, then the distance."""
    a, b = ([F.col(f"_{n}{i}") for i in range(3)] for n in (u, v))
    distance = geodesic_of(a, b) if ellipsoid else arc_m(a, b, earth_km)
    near = (chord(a, b) <= chord_limit(radius_m, 1.02)) & (distance <= radius_m)
    return pairs.filter(near).withColumn("distance_m", distance).drop(*[f"_{n}{i}" for n in (u, v) for i in range(3)])


def _salts_per_hot_cell(build: DataFrame, hot_cell: int) -> DataFrame | None:
    """(_cell, _salts) of the cells above the threshold, None if there is none.

    Cells are counted when the join is built. A list of up to MAX_HOT_CELLS becomes a local
    table, which is broadcast; a longer one stays distributed and is joined by the cell.
    """
    counts = build.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > hot_cell).select("_cell", F.ceil(F.col("_n") / F.lit(hot_cell)).cast("int").alias("_salts"))
    few = hot.limit(MAX_HOT_CELLS + 1).collect()
    if not few:
        return None
    return hot if len(few) > MAX_HOT_CELLS else build.sparkSession.createDataFrame(few, hot.schema)


def salted(probe_cells: DataFrame, build_cells: DataFrame, by: list[str], hot_cell: int | None = HOT_CELL) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns to join them on: a hot cell's rows are spread by a hash of `by`, the probing side visits each part."""
    hot = _salts_per_hot_cell(build_cells, hot_cell) if hot_cell else None
    if hot is None:
        return probe_cells, build_cells, ["_cell"]
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in by])
    build_cells = build_cells.join(hot, "_cell", "left").withColumn("_salt", F.pmod(row_hash, salts).cast("int")).drop("_salts")
    probe_cells = probe_cells.join(hot, "_cell", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return probe_cells, build_cells, ["_cell", "_salt"]


def spread(cells: DataFrame, keys: list[str], per_core: int = 0) -> DataFrame:
    """Dealt by the keys over as many tasks as the session shuffles to, or `per_core` for each core if that is more.

    Adaptive execution would merge the tasks by the bytes they read, but their work is the pairs, many times that.
    """
    spark = cells.sparkSession
    return cells.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism), *keys)


def radius_join(
    probe: DataFrame,
    build: DataFrame,
    radius_m: float,
    probe_at: tuple[str, str],
    build_at: tuple[str, str],
    condition: Column | None = None,
    metric: str = "geodesic",
    earth_km: float = EARTH_KM,
    hot_cell: int | None = HOT_CELL,
) -> DataFrame:
    """Pairs within the radius with `distance_m`; column names of the sides are disjoint.

    `condition` is any further predicate on a pair. `hot_cell=None` leaves salting out,
    for a build side whose size is small by construction.
    """
    size = cell_size_deg(radius_m)
    ellipsoid = metric == "geodesic"
    p_lat, p_lng = (F.col(c) for c in probe_at)
    b_lat, b_lng = (F.col(c) for c in build_at)
    build_cells = build.filter(b_lat.isNotNull() & b_lng.isNotNull()).withColumn("_cell", cell_of(b_lat, b_lng, size))
    probe_cells = explode_cells(probe.filter(p_lat.isNotNull() & p_lng.isNotNull()), probe_at, radius_m, size)
    probe_cells, build_cells, keys = salted(probe_cells, build_cells, build.columns, hot_cell)
    pairs = _with_vector(spread(probe_cells, keys), probe_at, "u", ellipsoid).join(
        _with_vector(spread(build_cells, keys), build_at, "v", ellipsoid), keys
    )
    if condition is not None:
        pairs = pairs.filter(condition)
    return _close(pairs, "u", "v", radius_m, ellipsoid, earth_km).drop("_cell", "_salt")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def self_pairs(points: DataFrame, id_col: str, radius_m: float, lat="lat", lng="lng", **kw) -> DataFrame:
    """Unordered pairs of a table within the radius, as a_* and b_* columns with a < b."""
    a, b = prefixed(points, "a_"), prefixed(points, "b_")
    ordered = F.col("a_" + id_col) < F.col("b_" + id_col)
    extra = kw.pop("condition", None)
    return radius_join(
        a, b, radius_m, ("a_" + lat, "a_" + lng), ("b_" + lat, "b_" + lng),
        condition=ordered if extra is None else ordered & extra, **kw,
    )


def within_of_places(points: DataFrame, places: DataFrame, radius_m: float, at=("lat", "lng"),
                     place_at=("port_lat", "port_lng")) -> DataFrame:
    """Points near fixed places: the places are exploded into cells, the points stay one row each."""
    size = cell_size_deg(radius_m)
    lat, lng = (F.col(c) for c in at)
    spread = explode_cells(places, place_at, radius_m, size)
    cells = points.filter(lat.isNotNull() & lng.isNotNull()).withColumn("_cell", cell_of(lat, lng, size))
    pairs = _with_vector(cells, at, "u").join(_with_vector(spread, place_at, "v"), "_cell")
    return _close(pairs, "u", "v", radius_m).drop("_cell")


ZONE_CELL_DEG = 1.0


def within_zones(points: DataFrame, zones: DataFrame, at=("lat", "lng")) -> DataFrame:
    """Points inside polygon rings: the cells of each ring's box, then ray casting."""
    lat, lng = (F.col(c) for c in at)
    size = ZONE_CELL_DEG
    bound = lambda axis, pick: pick(F.transform(F.col("ring"), lambda p: p[axis]))
    index = lambda v: F.floor(v / size).cast("int")
    boxed = zones.withColumn(
        "_y", F.explode(F.sequence(index(bound("lat", F.array_min)), index(bound("lat", F.array_max))))
    ).withColumn(
        "_x", F.explode(F.sequence(index(bound("lng", F.array_min)), index(bound("lng", F.array_max))))
    )
    cells = points.filter(lat.isNotNull() & lng.isNotNull()).withColumn("_y", index(lat)).withColumn("_x", index(lng))
    return cells.join(boxed, ["_y", "_x"]).filter(point_in_ring(lat, lng, F.col("ring"))).drop("_y", "_x", "ring")


def corroboration_counts(events: DataFrame, radius_m: float = 50_000.0, hours_window: float | None = None) -> DataFrame:
    """Per event, how many events of other layers lie within the radius (`corroborations`).

    Events at one position and layer (and, with a time window, hour of the window) are
    counted first and the join runs over those distinct positions only. Pairs are summed
    as they stream out of the join; they are never shuffled.
    """
    keys = ["lat", "lng", "layer"] + ([] if hours_window is None else ["_at"])
    base = events if hours_window is None else events.withColumn("_at", F.unix_micros("event_time"))
    spots = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("weight"))
    differs = F.col("a_layer") != F.col("b_layer")
    if hours_window is not None:
        differs = differs & (F.abs(F.col("a__at") - F.col("b__at")) <= hours_window * 3.6e9)
    pairs = radius_join(
        prefixed(spots, "a_"), prefixed(spots, "b_"), radius_m,
        ("a_lat", "a_lng"), ("b_lat", "b_lng"), condition=differs, metric="haversine",
    )
    found = pairs.groupBy(*["a_" + k for k in keys]).agg(F.sum("b_weight").alias("corroborations"))
    match = found.select(*[F.col("a_" + k).alias(k) for k in keys], "corroborations")
    return base.join(match, keys, "left").withColumn(
        "corroborations", F.coalesce("corroborations", F.lit(0))
    ).drop("_at")
