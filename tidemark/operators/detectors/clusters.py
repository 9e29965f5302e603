"""Density clusters of listed vessels (DBSCAN in Web Mercator), built from cell aggregates.

Cells have a side of eps / sqrt(2), so all points of one cell are neighbours. A cell with
`min_points` points therefore holds core points only, which are all connected: it enters
the graph as one node and its inner pairs are never formed. Only sparse cells compare
their points (at most min_points - 1 each) with the neighbouring cells.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import mercator_x, mercator_y
from tidemark.operators.bounds import since
from tidemark.operators.detectors.base import finding, hours, not_found_before, text_of
from tidemark.operators.detectors.listed import prop
from tidemark.operators.latest import latest_by, top_per_group
from tidemark.operators.lineage import durable

REACH = 2  # cells within eps of a cell, in each direction


def _neighbours(cells: DataFrame) -> DataFrame:
    """Each row once per cell of its 5 x 5 neighbourhood (n_cx, n_cy)."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-REACH, REACH + 1) for j in range(-REACH, REACH + 1)])
    return cells.withColumn("_s", F.explode(steps)).withColumns(
        {"n_cx": F.col("cx") + F.col("_s.i"), "n_cy": F.col("cy") + F.col("_s.j")}
    ).drop("_s")


def _distance2(ax, ay, bx, by) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node id of each component.

    Alternating large-star and small-star steps: O(log^2 n) rounds, and no node ever
    gathers more than its own neighbours' minimum. The driver reads one row per round.
    """
    link = durable(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v").distinct())
    if link.isEmpty():
        return link.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(max_rounds):
        both = link.unionByName(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Edges now point from a node to a smaller one, since m <= u < v.
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(ends).alias("e")).select("e.*")
        link = durable(small.filter("u <> v").distinct())
        now = tuple(link.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return link.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def dbscan(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """Adds `cluster` (null for noise) to rows with id, x, y.

    A point is core if eps holds min_points points, itself included. Border points join
    the lowest adjacent cluster. Clusters are named by their smallest node.
    """
    side = eps / math.sqrt(2)
    eps2 = eps * eps
    placed = durable(points).withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    sizes = placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    # Every later step reads this table; without the cut each would repeat what leads to it.
    placed = durable(placed.join(sizes, ["cx", "cy"]))
    dense = F.col("n") >= min_points
    sparse = placed.filter(~dense).select("id", "x", "y", "cx", "cy")
    # Neighbour counts of sparse points only.
    around = placed.select(
        F.col("id").alias("o_id"), F.col("x").alias("o_x"), F.col("y").alias("o_y"),
        F.col("cx").alias("n_cx"), F.col("cy").alias("n_cy"), "n", "first_id",
    )
    near = durable(
        _neighbours(sparse).join(around, ["n_cx", "n_cy"])
        .filter(_distance2(F.col("x"), F.col("y"), F.col("o_x"), F.col("o_y")) <= eps2)
        .select("id", "o_id")
    )
    cores_sparse = near.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_points).select("id")
    # Nodes: one per dense cell (its smallest id), one per sparse core point.
    node_of = placed.filter(dense).select("id", F.col("first_id").alias("node")).unionByName(
        cores_sparse.select("id", F.col("id").alias("node"))
    )
    sparse_links = (
        near.join(cores_sparse, "id")
        .join(node_of.select(F.col("id").alias("o_id"), F.col("node").alias("dst")), "o_id")
        .select(F.col("id").alias("src"), "dst")
    )
    links = sparse_links.unionByName(_dense_links(placed.filter(dense), side, eps2)).filter("src <> dst").distinct()
    labels = connected_components(links)
    cores = node_of.join(labels, "node", "left").select("id", F.coalesce("component", "node").alias("cluster"))
    border = (
        near.join(cores_sparse, "id", "left_anti")
        .join(cores.select(F.col("id").alias("o_id"), "cluster"), "o_id")
        .groupBy("id").agg(F.min("cluster").alias("cluster"))
    )
    return placed.select(*points.columns).join(cores.unionByName(border), "id", "left")


def _dense_links(dense: DataFrame, side: float, eps2: float, levels: tuple[int, ...] = (4, 32)) -> DataFrame:
    """Links between dense cells that have points within eps of each other.

    Cells are divided into sub-cells, reduced to the bounding boxes of their points. Two
    sub-cells whose boxes lie within eps even at their farthest corners link their cells
    without a point being looked at, and boxes too far apart are dropped. What is undecided
    between cells that are still unlinked goes to the next finer level, and at last to
    distinct positions.
    """
    spots = dense.select("cx", "cy", "first_id", "x", "y").distinct()
    if spots.isEmpty():
        return dense.select(F.col("first_id").alias("src"), F.col("first_id").alias("dst"))
    gap = lambda lo, hi, o_lo, o_hi: F.greatest(F.lit(0.0), F.col(o_lo) - F.col(hi), F.col(lo) - F.col(o_hi))
    far = lambda lo, hi, o_lo, o_hi: F.greatest(F.col(o_hi) - F.col(lo), F.col(hi) - F.col(o_lo))

    def square(extent) -> Column:
        w, h = extent("x0", "x1", "o_x0", "o_x1"), extent("y0", "y1", "o_y0", "o_y1")
        return w * w + h * h

    def placed(fine: int) -> DataFrame:
        return spots.withColumns({f"s{fine}x": F.floor(F.col("x") * fine / side), f"s{fine}y": F.floor(F.col("y") * fine / side)})

    def boxes(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy("cx", "cy", "first_id", *keys).agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
        )

    def mirrored(df: DataFrame) -> DataFrame:
        named = {"first_id": "dst", "cx": "n_cx", "cy": "n_cy"}
        return df.select(*[F.col(c).alias(named.get(c, "o_" + c)) for c in df.columns])

    found, todo = [], None
    coarse: list[str] = []
    table = spots
    for fine in levels:
        keys = [f"s{fine}x", f"s{fine}y"]
        table = placed(fine) if not coarse else table.withColumns(
            {k: F.floor(F.col(k[-1]) * fine / side) for k in keys}
        )
        subs = boxes(table, coarse + keys)
        if todo is None:
            pairs = _neighbours(subs).join(mirrored(subs), ["n_cx", "n_cy"]).filter(F.col("first_id") < F.col("dst"))
        else:
            pairs = todo.join(subs, ["first_id", *coarse]).join(
                mirrored(subs).drop("n_cx", "n_cy"), ["dst", *["o_" + k for k in coarse]]
            )
        pairs = durable(pairs.filter(square(gap) <= eps2).withColumn("sure", square(far) <= eps2))
        cells = pairs.groupBy("first_id", "dst").agg(F.bool_or("sure").alias("linked"))
        found.append(cells.filter("linked").select(F.col("first_id").alias("src"), "dst"))
        todo = pairs.join(cells.filter("not linked").select("first_id", "dst"), ["first_id", "dst"]).select(
            "first_id", "dst", *keys, *["o_" + k for k in keys]
        )
        table = table.select("cx", "cy", "first_id", "x", "y", *keys)
        coarse = keys
        if todo.isEmpty():  # every pair of cells is decided
            return reduce(DataFrame.unionByName, found)
    points = table.select("first_id", "x", "y", *coarse)
    touching = (
        todo.join(points, ["first_id", *coarse])
        .join(mirrored(points), ["dst", *["o_" + k for k in coarse]])
        .filter(_distance2(F.col("x"), F.col("y"), F.col("o_x"), F.col("o_y")) <= eps2)
        .select(F.col("first_id").alias("src"), "dst").distinct()
    )
    return reduce(DataFrame.unionByName, found, touching)


SWEEPS = 32


def _diameters(members: DataFrame, limit: float) -> DataFrame:
    """(cluster, diameter_m) of clusters no wider than the limit.

    The width along 32 directions bounds the diameter D from below, and D times the cosine
    of half the angle between directions from above. Both ends of a longest pair lie
    within width * (1 - cos) of an extreme in the nearest direction, so comparing only
    such points is exact.
    """
    angles = [math.pi * k / SWEEPS for k in range(SWEEPS)]
    along = lambda a: F.col("x") * math.cos(a) + F.col("y") * math.sin(a)
    spread = members.groupBy("cluster").agg(
        *[F.max(along(a)).alias(f"hi{i}") for i, a in enumerate(angles)],
        *[F.min(along(a)).alias(f"lo{i}") for i, a in enumerate(angles)],
    )
    widths = [F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(SWEEPS)]
    spread = spread.withColumn("width", F.greatest(*widths)).filter(F.col("width") <= limit)
    margin = F.col("width") * (1 - math.cos(math.pi / (2 * SWEEPS))) * 1.01 + 1e-6
    extreme = F.lit(False)
    for i, a in enumerate(angles):
        extreme = extreme | (along(a) >= F.col(f"hi{i}") - margin) | (along(a) <= F.col(f"lo{i}") + margin)
    rim = members.join(spread, "cluster").filter(extreme).select("cluster", "x", "y").distinct()
    other = rim.select("cluster", F.col("x").alias("o_x"), F.col("y").alias("o_y"))
    longest = rim.join(other, "cluster").groupBy("cluster").agg(
        F.sqrt(F.max(_distance2(F.col("x"), F.col("y"), F.col("o_x"), F.col("o_y")))).alias("diameter_m")
    )
    return longest.filter(F.col("diameter_m") <= limit)


def latest_matches(matches: DataFrame, as_of: Column, lookback_hours: int = 6) -> DataFrame:
    recent = since(matches, as_of - hours(lookback_hours)).filter(
        (F.col("event_type") == "sanctioned_vessel_underway") & F.col("lat").isNotNull() & F.col("entity_id").isNotNull()
    ).select(
        "entity_id", "event_time", "key", "lat", "lng", prop("sanctioning_authority").alias("authority"),
        prop("live_vessel_name").alias("name"), prop("mmsi").alias("mmsi"),
    )
    return latest_by(recent, ["entity_id"], ["event_time", "key"])


def fleet_members(latest: DataFrame, radius_m: float = 10_000, min_vessels: int = 3) -> DataFrame:
    """Every member of every cluster within the width limit: cluster, diameter_m and the vessel's columns."""
    points = latest.withColumns(
        {"id": F.col("entity_id"), "x": mercator_x(F.col("lng")), "y": mercator_y(F.col("lat"))}
    )
    labelled = durable(dbscan(points, radius_m, min_vessels).filter(F.col("cluster").isNotNull()))
    kept = _diameters(labelled.select("cluster", "x", "y"), radius_m * 3)
    return durable(labelled.join(kept, "cluster").drop("id", "x", "y"))


NAMES_SHOWN = 5


def fleet_clusters(
    members: DataFrame, as_of: Column, prior: DataFrame | None = None, algorithm: str = "shadow_fleet_cluster",
    lookback_hours: int = 6, radius_m: float = 10_000, min_vessels: int = 3, dedup_hours: float = 24,
) -> DataFrame:
    """One finding per cluster of `fleet_members`.

    A finding has all members (`entity_ids`) and their names, the size and an order-free
    hash of the member set, so that the same set is not reported twice; the sentence shows
    the first names. A fleet is as wide as three radii at most, which bounds the lists.
    `serving.membership` makes the narrow (finding, member) table of them.
    """
    first = lambda c: F.min_by(c, "entity_id").alias(c)
    h = F.xxhash64("entity_id")
    groups = members.groupBy("cluster", "diameter_m").agg(
        F.count(F.lit(1)).alias("cluster_size"), F.min("entity_id").alias("entity_id"),
        first("lat"), first("lng"), first("name"), first("mmsi"),
        F.array_sort(F.collect_set("authority")).alias("authorities"),
        F.array_sort(F.collect_set("entity_id")).alias("member_ids"), F.array_sort(F.collect_set("name")).alias("member_names"),
        F.bit_xor(h).alias("mix"), F.sum(h.cast("decimal(38,0)")).alias("total"),
    ).filter(F.col("cluster_size") >= min_vessels)
    rows = groups
    n, km = F.col("cluster_size"), f"{radius_m / 1000:.1f}"
    several = F.size("authorities") >= 2
    found = finding(
        rows,
        event_type="shadow_fleet_cluster",
        algorithm=algorithm,
        subtype=F.when(n >= 6, "large_fleet").when(n >= 4, "fleet").otherwise("cluster"),
        time=as_of,
        severity=F.lit(10.0),
        title=F.concat(
            F.lit("CRITICAL — Shadow-fleet cluster: "), n.cast("string"), F.lit(f" sanctioned vessels within {km} km"),
            F.when(several, " [multi-jurisdictional]").otherwise(""),
        ),
        description=F.concat(
            F.lit("Detected "), n.cast("string"), F.lit(f" active sanctioned-vessel broadcasts within {km} km of "),
            F.coalesce("name", F.concat(F.lit("MMSI "), "mmsi")), F.lit(". Members: "),
            F.array_join(F.slice("member_names", 1, NAMES_SHOWN), ", "),
            F.when(n > NAMES_SHOWN, F.concat(F.lit(" and others, "), n.cast("string"), F.lit(" in all"))).otherwise(""),
            F.lit(". Authorities involved: "), F.array_join("authorities", ", "), F.lit("."),
        ),
        entity_ids=F.col("member_ids"),
        key=F.concat_ws(":", n.cast("string"), F.hex("mix"), F.col("total").cast("string")),
        properties={
            "cluster": F.col("cluster"), "cluster_size": n, "radius_m": F.lit(radius_m),
            "diameter_m": F.round("diameter_m", 1), "lookback_hours": F.lit(lookback_hours),
            "member_entity_ids": F.col("member_ids"), "member_names": F.col("member_names"), "authorities": F.col("authorities"),
            "authority_count": F.size("authorities"), "multi_jurisdictional": several,
        },
    )
    return not_found_before(found, prior, as_of - hours(dedup_hours), ("shadow_fleet_cluster",), algorithm)
