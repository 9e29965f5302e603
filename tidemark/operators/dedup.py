"""Sliding-window near-duplicate filter over news events.

The filter is greedy: an event is rejected if an *accepted* earlier event of its subcategory
lies within the window, near enough, with similar enough text. Two events can only influence
each other through a chain of similar texts without a gap longer than the window. So texts
are first grouped by similarity (distinct token sets only, prefix-filtered equi-join, then
connected components), each group is cut at long gaps, and only such a chain is walked in
order. Rows stream through the walk; its state holds the accepted rows of one window.

A long chain is cut into blocks of time, which are walked side by side in rounds. All a block
needs of the past are the accepted rows of the window before it. The first round assumes none;
each further one walks the blocks again whose real past turned out different, until none is.
After round k the first k blocks are surely those of the single walk, and as a rule all are
after two or three, since walks from different pasts soon accept the same rows.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import set_jaccard, tokens
from tidemark.operators.detectors.clusters import connected_components
from tidemark.operators.lineage import dealt, durable

VERDICT = "chain string, block long, event_id string, duplicate_of string, similarity double"
BLOCK_ROWS = 100_000


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(left_sig, right_sig) of similar distinct token sets (`scope`, `sig`, `toks`) of one scope."""
    frequency = sets.select("scope", F.explode("toks").alias("tok")).groupBy("scope", "tok").agg(F.count(F.lit(1)).alias("freq"))
    ranked = (
        sets.select("scope", "sig", F.explode("toks").alias("tok")).join(frequency, ["scope", "tok"])
        .groupBy("scope", "sig").agg(F.array_sort(F.collect_list(F.struct("freq", "tok"))).alias("r"))
    )
    m = F.size("r")
    keep = m - F.ceil(m * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    index = ranked.select(
        "scope", "sig", F.transform("r", lambda x: x["tok"]).alias("toks"), F.explode(F.slice("r", F.lit(1), keep)).alias("x")
    ).select("scope", "sig", "toks", F.col("x.tok").alias("tok"))
    other = index.select("scope", "tok", F.col("sig").alias("right_sig"), F.col("toks").alias("right_toks"))
    low, high = F.size("toks"), F.size("right_toks")
    return (
        index.withColumnRenamed("sig", "left_sig").join(other, ["scope", "tok"])
        .filter(F.col("left_sig") < F.col("right_sig"))
        .filter((low >= high * F.lit(threshold) - 1e-9) & (high >= low * F.lit(threshold) - 1e-9))
        .filter(set_jaccard(F.col("toks"), F.col("right_toks")) >= threshold)
        .select("left_sig", "right_sig").distinct()
    )


def chains(events: DataFrame, window_minutes: float, threshold: float) -> DataFrame:
    """Adds `toks` and `chain`; events of different chains never affect each other."""
    text = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "actor1_name", "actor2_name", "subcategory")])
    rows = events.withColumn("toks", F.array_sort(tokens(text))).withColumn(
        "sig", F.sha1(F.concat_ws("\x1f", "subcategory", F.array_join("toks", "\x1e")))
    )
    sets = rows.select(F.col("subcategory").alias("scope"), "sig", "toks").dropDuplicates(["sig"])
    edges = similar_sets(sets, threshold).select(F.col("left_sig").alias("src"), F.col("right_sig").alias("dst"))
    groups = connected_components(edges).select(F.col("node").alias("sig"), F.col("component"))
    grouped = rows.join(groups, "sig", "left").withColumn("group", F.coalesce("component", "sig")).drop("component", "sig")
    # Gaps are found between distinct seconds of a group, not between its rows.
    seconds = grouped.select("group", F.unix_seconds("timestamp").alias("s")).distinct()
    order = Window.partitionBy("group").orderBy("s")
    cut = (F.col("s") - F.lag("s").over(order) > window_minutes * 60 + 1).cast("int")
    starts = seconds.withColumn("part", F.sum(F.coalesce(cut, F.lit(0))).over(order))
    return grouped.withColumn("s", F.unix_seconds("timestamp")).join(starts, ["group", "s"]).withColumn(
        "chain", F.concat_ws("#", "group", F.col("part").cast("string"))
    ).drop("group", "s", "part")


class GreedyWindow:
    """Accepted rows of the current window; decides one row at a time.

    Rows are kept by token set and, under it, by cell of a grid as wide as the radius. A row is
    compared with the similar sets, found once a set on the tokens of their prefixes, and with the
    rows in the cells that its circle touches; there are few, as accepted rows of one set lie apart.
    """

    def __init__(self, window_s: float, threshold: float, radius_km: float) -> None:
        self.window_s, self.threshold, self.radius_km = window_s, threshold, radius_km
        self.delta = min(180.0, radius_km / 111.0)  # degrees, a little wide
        self.size = min(30.0, max(self.delta, 1e-3))
        self.queue: deque[tuple] = deque()  # (at, event_id, set, lat, lng, place), as accepted
        self.at_place: dict[tuple, deque] = {}  # (set, cell) -> (number, at, event_id, lat, lng)
        self.of_set: dict[frozenset, deque] = {}  # all of a set's, in the same form
        self.by_token: dict[str, set] = {}
        self.similar: dict[frozenset, list] = {}  # what is known of the sets asked for since the accepted ones changed
        self.number = 0

    @property
    def rows(self) -> list[tuple[float, str, frozenset, float, float]]:
        return [r[:5] for r in self.queue]

    @rows.setter
    def rows(self, rows) -> None:
        self.__init__(self.window_s, self.threshold, self.radius_km)
        for r in rows:
            self._add(*r)

    def _columns(self, row: int) -> int:
        south = row * self.size - 90
        nearest = 0.0 if south < 0 < south + self.size else min(abs(south), abs(south + self.size), 90.0)
        return max(1, int(360 * math.cos(math.radians(nearest)) // self.size))

    def _cell(self, lat: float, lng: float) -> tuple[int, int]:
        row = math.floor((lat + 90) / self.size)
        n = self._columns(row)
        return row, math.floor((lng + 180) / 360 * n) % n

    def _cells(self, lat: float, lng: float) -> Iterator[tuple[int, int]]:
        sin_half = math.sin(math.radians(min(self.delta, 90.0))) / max(math.cos(math.radians(lat)), 1e-9)
        half = 180.0 if abs(lat) + self.delta >= 89.9 or sin_half >= 1 else math.degrees(math.asin(sin_half))
        for row in range(math.floor((lat - self.delta + 90) / self.size), math.floor((lat + self.delta + 90) / self.size) + 1):
            n = self._columns(row)
            west, east = (math.floor((lng + side * half + 180) / 360 * n) for side in (-1, 1))
            for column in range(west, min(east, west + n - 1) + 1):
                yield row, column % n

    def _prefix(self, toks: frozenset) -> list[str]:
        return sorted(toks)[: len(toks) - math.ceil(len(toks) * self.threshold - 1e-9) + 1] or [""]

    def _add(self, at: float, event_id: str, toks: frozenset, lat: float, lng: float) -> None:
        place = (toks, self._cell(lat, lng) if lat == lat and lng == lng else None)
        self.number += 1
        row = (self.number, at, event_id, lat, lng)
        if toks not in self.of_set:
            self.of_set[toks] = deque()
            for t in self._prefix(toks):
                self.by_token.setdefault(t, set()).add(toks)
            self.similar = {}
        self.of_set[toks].append(row)
        self.at_place.setdefault(place, deque()).append(row)
        self.queue.append((at, event_id, toks, lat, lng, place))

    def _expire(self, start: float) -> None:
        while self.queue and self.queue[0][0] < start:
            place = self.queue.popleft()[5]
            toks = place[0]
            for table, key in ((self.at_place, place), (self.of_set, toks)):
                table[key].popleft()
                if not table[key]:
                    del table[key]
            if toks not in self.of_set:
                for t in self._prefix(toks):
                    self.by_token[t].discard(toks)
                    if not self.by_token[t]:
                        del self.by_token[t]
                self.similar = {}

    def _sets(self, mine: frozenset) -> list[tuple[frozenset, float]]:
        """The sets of accepted rows that are similar to one."""
        if mine not in self.similar:
            met = set().union(*(self.by_token.get(t, ()) for t in self._prefix(mine)))
            least, most = len(mine) * self.threshold, len(mine) / self.threshold
            found = [(other, _jaccard(mine, other)) for other in met if least <= len(other) <= most]
            self.similar[mine] = [(other, s) for other, s in found if s >= self.threshold]
        return self.similar[mine]

    def judge(self, at: float, event_id: str, toks, lat: float, lng: float) -> tuple[str | None, float | None]:
        """(accepted row it duplicates, similarity), or (None, None) after accepting the row; of several the one accepted last."""
        start = at - self.window_s
        self._expire(start)
        mine = frozenset(toks)
        placed = lat == lat and lng == lng
        best = None
        cells = [None, *self._cells(lat, lng)] if placed else []
        for other, similarity in self._sets(mine):
            for rows in (self.at_place.get((other, cell), ()) for cell in cells) if placed else (self.of_set[other],):
                for row in reversed(rows):
                    if best is not None and row[0] < best[0]:
                        break
                    near = not placed or row[3] != row[3] or row[4] != row[4] or _km(lat, lng, row[3], row[4]) <= self.radius_km
                    if row[1] >= start and near:
                        best = (row[0], row[2], similarity)
                        break
        if best is not None:
            return best[1:]
        self._add(at, event_id, mine, lat, lng)
        return None, None

    def admit(self, at: float, event_id: str, toks, lat: float, lng: float) -> None:
        """Take a row that was accepted before."""
        self._add(at, event_id, frozenset(toks), lat, lng)


def _jaccard(a: frozenset, b: frozenset) -> float:
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if a or b else 1.0


def _km(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def _judge(rows: DataFrame, limits: tuple[float, float, float]) -> DataFrame:
    """Verdicts (VERDICT) of the rows of each block that are not known as accepted, which only count as past."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if (row.chain, row.block) != block:
                    block, state = (row.chain, row.block), GreedyWindow(*limits)
                lat, lng = (float("nan") if v is None else float(v) for v in (row.lat, row.lng))
                if row.known:
                    state.admit(row.at, row.event_id, row.toks, lat, lng)
                else:
                    out.append((row.chain, row.block, row.event_id, *state.judge(row.at, row.event_id, row.toks, lat, lng)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in VERDICT.split(", ")])

    columns = ["chain", "block", "at", "event_id", "toks", "lat", "lng", "known"]
    return dealt(rows.select(*columns), ["chain", "block"], "at", "event_id").mapInPandas(judge, VERDICT)


def _in_blocks(walk: DataFrame, window_s: float, block_rows: int) -> DataFrame:
    """Adds `block` and `next_at`, the time at which the next one begins; a block is two windows long at least."""
    whole = walk.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last")).filter(F.col("n") > block_rows)
    length = F.greatest(F.lit(2.0 * window_s), (F.col("last") - F.col("first")) * block_rows / F.col("n"))
    cut = walk.join(whole.select("chain", "first", length.alias("length")), "chain", "left")
    block = F.coalesce(F.floor((F.col("at") - F.col("first")) / F.col("length")), F.lit(0)).cast("long")
    return cut.withColumn("block", block).withColumn("next_at", F.col("first") + (F.col("block") + 1) * F.col("length")).drop("first", "length")


def _walked(walk: DataFrame, limits: tuple[float, float, float], block_rows: int) -> DataFrame:
    """(event_id, duplicate_of, similarity) as one walk through every chain gives them."""
    walk = durable(_in_blocks(walk, limits[0], block_rows))
    verdicts = durable(_judge(walk, limits))
    if walk.filter("block > 0").isEmpty():
        return verdicts.select("event_id", "duplicate_of", "similarity")
    border = walk.filter(F.col("at") >= F.col("next_at") - limits[0])
    past = None
    key = ["chain", "block"]
    while True:
        rejected = verdicts.filter("duplicate_of is not null").select(*key, "event_id")
        now = border.join(rejected, [*key, "event_id"], "left_anti").withColumns({"block": F.col("block") + 1, "known": F.lit(True)})
        now = durable(now.join(walk.select(*key).distinct(), key, "left_semi"))
        signs = now.select(*key, "event_id", F.lit(1).alias("sign"))
        if past is not None:
            signs = signs.unionByName(past.select(*key, "event_id", F.lit(-1).alias("sign")))
        changed = durable(signs.groupBy(*key, "event_id").agg(F.sum("sign").alias("s")).filter("s <> 0").select(*key).distinct())
        if changed.isEmpty():
            return verdicts.select("event_id", "duplicate_of", "similarity")
        again = walk.unionByName(now).join(changed, key, "left_semi")
        verdicts = durable(verdicts.join(changed, key, "left_anti").unionByName(_judge(again, limits)))
        past = now


def near_duplicates(
    events: DataFrame, window_minutes: float = 60, threshold: float = 0.85, radius_km: float = 50, accepted: DataFrame | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(event_id, duplicate_of, similarity) for every event; accepted ones have null in the last two.

    Of rows equal in text, place and time only the first can be accepted, so the others join
    its verdict afterwards and the walk sees each such spot once. `accepted` are earlier events,
    with the columns of `events`, that were accepted before and only count as past.
    """
    spot = ["chain", "timestamp", "toks", "lat", "lng"]
    used = ["event_id", "subcategory", "timestamp", "title", "actor1_name", "actor2_name", "lat", "lng"]
    both = events.select(*used, F.lit(False).alias("known"))
    if accepted is not None:
        both = both.unionByName(accepted.select(*used, F.lit(True).alias("known")))
    rows = durable(chains(both, window_minutes, threshold).select(*spot, "event_id", "known"))
    known_first = F.struct(~F.col("known"), "event_id")
    leaders = durable(rows.groupBy(*spot).agg(F.min_by("event_id", known_first).alias("leader"), F.max("known").alias("known")))
    walk = leaders.select("chain", (F.unix_micros("timestamp") / 1e6).alias("at"), F.col("leader").alias("event_id"), "toks", "lat", "lng", "known")
    verdicts = _walked(walk, (window_minutes * 60, threshold, radius_km), block_rows)
    own = leaders.select("leader", *[F.col(c).alias(f"l_{c}") for c in spot])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in spot])
    members = rows.filter(~F.col("known")).join(own, same).select("event_id", "leader")
    return members.join(verdicts.withColumnRenamed("event_id", "leader"), "leader", "left").select(
        "event_id",
        F.when(F.col("event_id") == F.col("leader"), F.col("duplicate_of")).otherwise(F.coalesce("duplicate_of", "leader")).alias("duplicate_of"),
        F.when(F.col("event_id") == F.col("leader"), F.col("similarity")).otherwise(F.coalesce("similarity", F.lit(1.0))).alias("similarity"),
    )


def duplicate_counts(verdicts: DataFrame) -> DataFrame:
    """How often each accepted event was repeated; the input of the priority score."""
    return verdicts.filter(F.col("duplicate_of").isNotNull()).groupBy(F.col("duplicate_of").alias("event_id")).agg(
        F.count(F.lit(1)).alias("duplicate_count")
    )
