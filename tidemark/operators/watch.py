"""Watch lists, subscriptions, digests and the grading of predictions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import EARTH_KM, haversine_km, in_bbox
from tidemark.functions.stats import round_even
from tidemark.operators import leaves
from tidemark.operators.latest import top_per_group
from tidemark.operators.lineage import durable
from tidemark.operators.spatial import cell_of, explode_cells, radius_join, spread
from tidemark.sources.refdata import CATEGORIES, LEVEL_RANK

WATCH_CELL_DEG = 2.0
CHUNK = 1_024  # sharers of a rule in one list
STRETCH = 64  # times all before it: the next stretch of events that watch lists look at for alerts
FEW_SHARERS = 1_000_000  # lists of so many sharers are broadcast
LOOSE = 100  # events without place that meet the rules of their type in one go
TASKS = 8  # of a join by rules for each core: its work is the pairs, which differ between keys
SUBSCRIPTION_RULE = ["categories", "subcategories", "min_confidence", "min_severity", "area", "west", "south", "east", "north", "center_lat", "center_lng", "radius_km"]
WATCH_RULE = ["layers", "center_lat", "center_lng", "radius_km", "min_severity"]


class Rules(NamedTuple):
    """Rows that ask for the same share a rule: events are tested once for each rule, not for each of its rows."""

    rules: DataFrame  # `_rule` and the columns that it is made of
    sharers: DataFrame  # `_rule`, `_sharers`: the other columns of its rows, up to CHUNK or so in a list
    own: list[str]
    few: bool


def rules_of(rows: DataFrame, by: list[str]) -> Rules:
    """`by`: columns of numbers, strings and arrays of them, of which `_rule` is a digest of 128 bits."""
    own = [c for c in rows.columns if c not in by]
    named = rows.withColumn("_rule", F.unhex(F.md5(F.to_json(F.struct(*by)))))
    sizes = named.groupBy("_rule").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).alias("_chunks"))
    chunk = F.pmod(F.xxhash64(*own), F.col("_chunks"))
    lists = named.join(sizes, "_rule").groupBy("_rule", chunk.alias("_chunk")).agg(F.collect_list(F.struct(*own)).alias("_sharers"))
    # A list of one column holds bare values, which are cheaper to take apart.
    values = F.transform("_sharers", lambda r: r[own[0]]) if len(own) == 1 else F.col("_sharers")
    return Rules(named.select("_rule", *by).dropDuplicates(["_rule"]), lists.select("_rule", values.alias("_sharers")), own, rows.count() <= FEW_SHARERS)


def share_out(met: DataFrame, rules: Rules, prefix: str = "") -> DataFrame:
    """Rows with `_rule` once for each row that shares it, whose own columns they get."""
    lists = F.broadcast(rules.sharers) if rules.few else rules.sharers
    rows = met.join(lists, "_rule").withColumn("_sharer", F.explode("_sharers"))
    value = lambda c: F.col("_sharer") if len(rules.own) == 1 else F.col("_sharer")[c]
    return rows.select(*[c for c in met.columns if c != "_rule"], *[value(c).alias(prefix + c) for c in rules.own])


def subscription_matches(event: str = "", sub: str = "") -> Column:
    """Predicate of one subscription on one event, over columns with the given prefixes.

    Events without coordinates match every area; the country area accepts all, because the
    events carry no country.
    """
    e, s = (lambda c: F.col(event + c)), (lambda c: F.col(sub + c))
    empty = lambda c: F.coalesce(F.size(s(c)), F.lit(0)) == 0
    lng_in = F.when(s("west") <= s("east"), e("lng").between(s("west"), s("east"))).otherwise(
        (e("lng") >= s("west")) | (e("lng") <= s("east"))
    )
    area = (
        F.when(e("lat").isNull() | e("lng").isNull(), True)
        .when((s("area") == "bbox") & s("west").isNotNull(), lng_in & e("lat").between(s("south"), s("north")))
        .when(
            (s("area") == "circle") & s("radius_km").isNotNull(),
            haversine_km(s("center_lat"), s("center_lng"), e("lat"), e("lng")) <= s("radius_km"),
        )
        .otherwise(True)
    )
    return (
        (empty("categories") | F.array_contains(s("categories"), e("event_type")))
        & (empty("subcategories") | F.coalesce(F.array_contains(s("subcategories"), e("event_subtype")), F.lit(False)))
        & (F.coalesce(e("confidence"), F.lit(0.0)) >= s("min_confidence"))
        & (F.coalesce(e("severity"), F.lit(0.0)) >= s("min_severity"))
        & area
    )


def _leaf_join(points: DataFrame, shapes: DataFrame, boxes: Column, most: int, more: list[str] | None = None) -> DataFrame:
    """Points with the shapes whose boxes hold their leaf; `more` are further columns to join on."""
    nodes, ends, few = leaves.tree(points, "lat", "lng", most)
    salt_by = F.xxhash64(*[F.col(f"`{c}`") for c in points.columns if points.schema[c].dataType.typeName() != "map"])
    boxed = shapes.withColumn("_box", F.explode(boxes)).select(*shapes.columns, "_box.*")
    keys = [*leaves.LEAF, *(more or [])]
    cut = spread(leaves.shape_leaves(boxed, nodes, ends), keys, TASKS)
    met = spread(leaves.point_leaves(points, "lat", "lng", ends, salt_by, few), keys, TASKS).join(cut, keys)
    # A shape across the date line has two boxes, which may share a leaf: a point meets it by the one that holds it.
    return met.filter(F.col("lng").between(F.col("_west"), F.col("_east"))).drop(*leaves.LEAF, "_west", "_south", "_east", "_north")


def _loose_join(loose: DataFrame, wanted: DataFrame) -> DataFrame:
    """Events without place with all rules of their type, dealt over as many salts as they have shares of LOOSE."""
    salts = loose.groupBy("event_type").agg(F.ceil(F.count(F.lit(1)) / F.lit(LOOSE)).cast("int").alias("_salts"))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in loose.columns if loose.schema[c].dataType.typeName() != "map"]), F.col("_salts")).cast("int")
    keys = ["event_type", "_salt"]
    points = loose.join(F.broadcast(salts), "event_type").withColumn("_salt", salt).drop("_salts")
    asked = wanted.join(F.broadcast(salts), "event_type").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return spread(points, keys, TASKS).join(spread(asked, keys, TASKS), keys).drop("_salt")


def subscription_join(events: DataFrame, subscriptions: DataFrame, most: int = leaves.MOST) -> DataFrame:
    """Events × subscriptions as an equi-join on event type and leaf of place, then the remaining predicate.

    Subscriptions that ask for the same share a rule, and only what a rule has met goes to each of
    them. A rule is exploded into the types it names and its area into leaves, which are
    small where events are dense, so neither a common type nor a busy harbour is one key. One
    that names no type takes every type of the events, which are few; one without area takes
    every leaf. Events without place meet all rules of their type.
    """
    shared = rules_of(subscriptions, SUBSCRIPTION_RULE)
    types = events.select("event_type").distinct().agg(F.collect_list("event_type")).scalar()
    empty = F.coalesce(F.size("categories"), F.lit(0)) == 0
    named = shared.rules.filter(~empty).withColumn("event_type", F.explode(F.array_distinct("categories")))
    every = shared.rules.filter(empty).withColumn("_types", types).withColumn("event_type", F.explode("_types")).drop("_types")
    wanted = named.unionByName(every.select(*named.columns))
    mine = wanted.select("event_type", "_rule", *[F.col(c).alias("sub_" + c) for c in SUBSCRIPTION_RULE])
    s = lambda c: F.col("sub_" + c)
    world = leaves.boxes_of(F.lit(-180.0), F.lit(-90.0), F.lit(180.0), F.lit(90.0))
    boxes = (
        F.when((s("area") == "bbox") & s("west").isNotNull(), leaves.boxes_of(s("west"), s("south"), s("east"), s("north")))
        .when((s("area") == "circle") & s("radius_km").isNotNull(), leaves.circle_box(s("center_lat"), s("center_lng"), s("radius_km")))
        .otherwise(world)
    )
    asked = wanted.select("event_type").distinct().agg(F.collect_list("event_type")).scalar()
    typed = events.filter(F.array_contains(asked, F.col("event_type")))
    placed = typed.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    loose = typed.filter(F.col("lat").isNull() | F.col("lng").isNull())
    near = _leaf_join(placed, mine, boxes, most, ["event_type"])
    found = near.select(*events.columns, *[c for c in mine.columns if c != "event_type"])
    rest = _loose_join(loose, mine).select(*found.columns)
    met = found.unionByName(rest).filter(subscription_matches("", "sub_"))
    return share_out(met, shared, "sub_").select(*events.columns, *["sub_" + c for c in subscriptions.columns])


def _watch_distance(w) -> Column:
    return haversine_km(w("center_lat"), w("center_lng"), F.col("lat"), F.col("lng"), EARTH_KM)


def _watch_hit(w) -> Column:
    """A rule's condition on an event; `w` gives its columns. The tests are in the order of their cost."""
    any_layer = F.coalesce(F.size(w("layers")), F.lit(0)) == 0
    return (
        (F.coalesce(F.col("severity"), F.lit(0)) >= w("min_severity")) & (F.abs(F.col("lat") - w("center_lat")) * 110.574 <= w("radius_km") * 1.01 + 1e-6)
        & (any_layer | F.arrays_overlap(w("layers"), F.col("event_layers"))) & (_watch_distance(w) <= w("radius_km"))
    )


def watch_rules(watchlists: DataFrame, once: bool = False) -> Rules:
    """Rules of the lists that are enabled; with `once`, an event meets a list of several circles by the first that holds it."""
    lists = watchlists.filter("enabled")
    if not once:
        return rules_of(lists, WATCH_RULE)
    if lists.groupBy("watch_id").count().filter("count > 1").isEmpty():
        return rules_of(lists, WATCH_RULE)
    # The circles of a list in one row for each: those before it go along, so that none repeats a match.
    circle = F.struct("layers", "center_lat", "center_lng", "radius_km", "min_severity")
    listed = Window.partitionBy("watch_id").orderBy("center_lat", "center_lng", "radius_km", "min_severity", "layers").rowsBetween(Window.unboundedPreceding, -1)
    return rules_of(lists.withColumn("_before", F.collect_list(circle).over(listed)), [*WATCH_RULE, "_before"])


def rule_matches(events: DataFrame, rules: DataFrame, most: int = leaves.MOST) -> DataFrame:
    """Event × rule of watch lists: layer, severity and circle.

    On tables circles are cut into leaves that follow the density of events; a stream, whose
    events are not known beforehand, joins on fixed cells.
    """
    rows = events.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    if events.isStreaming:
        cells = explode_cells(rules, ("center_lat", "center_lng"), F.col("radius_km") * 1000, WATCH_CELL_DEG)
        met = rows.withColumn("_cell", cell_of(F.col("lat"), F.col("lng"), WATCH_CELL_DEG)).join(cells, "_cell").drop("_cell")
        met = met.filter(_watch_hit(F.col))
        if "_before" in rules.columns:  # Spark does not compile functions of arrays into the join
            repeats = (F.size("_before") > 0) & F.exists("_before", lambda w: F.coalesce(_watch_hit(lambda name: w[name]), F.lit(False)))
            met = met.filter(~repeats).drop("_before")
    else:
        met = _leaf_join(rows, rules, leaves.circle_box(F.col("center_lat"), F.col("center_lng"), F.col("radius_km")), most).filter(_watch_hit(F.col))
    return met.withColumn("distance_km", round_even(_watch_distance(F.col), 1))


def watch_matches(events: DataFrame, watchlists: DataFrame, most: int = leaves.MOST) -> DataFrame:
    """Event × watch list; on a stream, an event meets a list of several circles once."""
    shared = watch_rules(watchlists, once=events.isStreaming)
    return share_out(rule_matches(events, shared.rules, most), shared)


def watch_sources(events: DataFrame, anomalies: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """What watch lists look at, in one shape: events, bucket anomalies and correlation cells."""
    out = events.select(
        F.lit("event").alias("kind"), F.lit(0).alias("kind_order"), F.concat_ws(":", "layer", F.col("event_id").cast("string")).alias("match_id"),
        F.array("layer").alias("event_layers"), "lat", "lng", F.col("severity").cast("int").alias("severity"), F.col("event_time"),
    )
    if anomalies is not None:
        out = out.unionByName(anomalies.select(
            F.lit("anomaly").alias("kind"), F.lit(1).alias("kind_order"),
            F.concat_ws(":", F.lit("anomaly"), "layer", "region", F.col("anomaly_severity").cast("string")).alias("match_id"),
            F.array("layer").alias("event_layers"), "lat", "lng", F.col("anomaly_severity").cast("int").alias("severity"),
            F.lit(None).cast("timestamp").alias("event_time"),
        ))
    if clusters is not None:
        out = out.unionByName(clusters.select(
            F.lit("correlation").alias("kind"), F.lit(2).alias("kind_order"),
            F.concat(
                F.lit("correlation:"), F.array_join("layers", "+"), F.lit("@"), round_even(F.col("center_lat"), 1).cast("string"), F.lit(","),
                round_even(F.col("center_lng"), 1).cast("string"),
            ).alias("match_id"),
            F.col("layers").alias("event_layers"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"),
            F.col("severity").cast("int").alias("severity"), F.lit(None).cast("timestamp").alias("event_time"),
        ))
    return out


def _stretches(events: DataFrame) -> list[Column]:
    """Conditions that cut the events, in the order of alerts, into stretches of which each is STRETCH times as long as all before it."""
    of_time = F.col("kind_order") == 0
    at = F.when(of_time, F.unix_micros("event_time"))
    n = events.agg(F.count(at)).first()[0]
    shares = []
    while n / STRETCH ** (len(shares) + 1) >= leaves.MOST:
        shares.insert(0, STRETCH ** -(len(shares) + 1.0))
    ends = events.agg(F.percentile_approx(at, shares)).first()[0] if shares else []
    to = [F.coalesce(at <= end, F.lit(False)) for end in ends] + [F.lit(True)]
    return [upto if k == 0 else upto & ~to[k - 1] for k, upto in enumerate(to)]


def watch_alerts(events: DataFrame, watchlists: DataFrame, fired: DataFrame, k: int = 5) -> DataFrame:
    """The first k matches per list that have not fired before (the alert shows five).

    `fired` has (watch_id, match_id); a row without a list is an event that an earlier run has dealt
    with for all lists. A list of which f events have fired finds its alerts among its first k + f matches. Rules look for
    those in ever longer stretches of the events, in their order, and only the rules of lists that
    still have too few look on, so neither all matches nor their repeats are ever stored or sorted.
    """
    order = [F.asc("kind_order"), F.asc_nulls_last("event_time"), F.asc("match_id")]
    done = fired.filter("watch_id IS NULL").select("match_id")
    pairs = fired.filter("watch_id IS NOT NULL").select("watch_id", "match_id").distinct()
    past = pairs.groupBy("watch_id").agg(F.count(F.lit(1)).alias("_fired"))
    lists = watchlists.filter("enabled").join(past, "watch_id", "left").withColumn("_need", F.coalesce("_fired", F.lit(0)) + k).drop("_fired")
    lists = durable(lists)
    most = lists.agg(F.max("_need")).first()[0] or k
    own, found = watchlists.columns, None
    for stretch in _stretches(events):
        rules = rules_of(lists, [*WATCH_RULE, "_need"])
        rows = events.filter(stretch).join(done, "match_id", "left_anti").select(*events.columns)
        first = top_per_group(rule_matches(rows, rules.rules), ["_rule"], order, most).filter(F.col("rank") <= F.col("_need")).drop("rank", "_need")
        new = share_out(first, rules).select(*events.columns, *own, "distance_km").join(pairs, ["watch_id", "match_id"], "left_anti")
        found = durable(new if found is None else found.unionByName(new))
        enough = found.groupBy("watch_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        lists = durable(lists.join(enough, "watch_id", "left_anti"))
        if lists.isEmpty():
            break
    return top_per_group(found, ["watch_id"], order, k)


def digest_items(events: DataFrame, categories: DataFrame, per_category: int = 3) -> DataFrame:
    """Newest items per category, with the category's total."""
    rows = events.filter(~F.col("withdrawn")).join(F.broadcast(categories), "event_type")
    totals = rows.groupBy("category_id").agg(F.count(F.lit(1)).alias("category_total"))
    return top_per_group(rows, ["category_id"], [F.desc("event_time"), F.asc("id")], per_category).join(totals, "category_id")


def digest(items: DataFrame, subscribers: DataFrame, limit: int = 25) -> DataFrame:
    """Items per verified subscriber who has not unsubscribed, most severe and newest first."""
    table = F.array(*[
        F.struct(F.lit(cid).alias("id"), F.lit(LEVEL_RANK[level]).alias("rank")) for cid, _, level in CATEGORIES
    ])
    rank_of = F.create_map(*[F.lit(x) for kv in LEVEL_RANK.items() for x in kv])
    floor = F.coalesce(F.try_element_at(rank_of, F.col("severity_floor")), F.lit(LEVEL_RANK["high"]))
    everything = F.coalesce(F.size("category_ids"), F.lit(0)) == 0
    wanted = F.filter(table, lambda c: (c["rank"] >= floor) & (everything | F.array_contains("category_ids", c["id"])))
    readers = subscribers.filter(F.col("verified") & F.col("unsubscribed_at").isNull()).select(
        "email", F.explode(F.transform(wanted, lambda c: c["id"])).alias("category_id")
    )
    level_rank = F.try_element_at(rank_of, F.col("level"))
    return top_per_group(
        readers.join(items.drop("rank"), "category_id"), ["email"], [F.desc(level_rank), F.desc("event_time"), F.asc("id")], limit
    ).withColumnRenamed("rank", "position")


def grade_predictions(predictions: DataFrame, quakes: DataFrame, articles: DataFrame, as_of: Column, radius_km: float = 500.0) -> DataFrame:
    """Outcome of due predictions: seismic ones against quakes nearby, conflict ones against any article."""
    category = F.lower(F.coalesce("category", F.lit("")))
    seismic = category.contains("earth") | category.contains("seismic") | category.contains("quake") | (category == "natural")
    conflict = category.contains("conflict") | category.contains("political") | category.contains("war")
    due = predictions.filter((F.col("due_at") <= as_of) & (F.col("status") == "pending"))
    # Many predictions and quakes share a position: counts and the best quake are found once for each pair of positions.
    asked = due.filter(seismic).select(F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")).distinct()
    order = F.struct(F.coalesce("magnitude", F.lit(0.0)).alias("m"), (-F.col("quake_id")).alias("first"))
    spots = quakes.groupBy(F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng")).agg(
        F.count(F.lit(1)).alias("weight"), F.max(order).alias("order"), F.max_by(F.struct("magnitude", "place"), order).alias("quake")
    )
    near = radius_join(asked, spots, radius_km * 1000, ("p_lat", "p_lng"), ("q_lat", "q_lng"), metric="haversine").filter(F.col("distance_m") < radius_km * 1000)
    best = F.max_by(F.struct("quake.magnitude", "quake.place", "distance_m"), "order")
    found = near.groupBy("p_lat", "p_lng").agg(F.sum("weight").alias("evidence_count"), best.alias("b"))
    any_article = articles.limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    outcome = (
        F.when(seismic, F.when(F.col("evidence_count") > 0, "win").otherwise("loss"))
        .when(conflict, F.when(any_article, "unresolved").otherwise("loss"))
        .otherwise("unresolved")
    )
    evidence = due.join(found, seismic & (F.col("lat") == F.col("p_lat")) & (F.col("lng") == F.col("p_lng")), "left")
    return evidence.select(
        "prediction_id", outcome.alias("outcome"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        F.col("b.magnitude").alias("magnitude"), F.round(F.col("b.distance_m") / 1000, 0).alias("distance_km"), F.col("b.place").alias("place"),
    )


def in_view(events: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    return events.filter(in_bbox(F.col("lat"), F.col("lng"), *bbox))
