"""Bounds in time and place that also prune stored events: day partitions, and ranges of a space-filling curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import in_bbox

DATE = "event_date"
PLACE = "place"
PLACE_BITS = 12  # per axis: cells of 0.088 by 0.044 degrees
RANGES = 32

Box = tuple[float, float, float, float]


def since(rows: DataFrame, lo: Column | None, hi: Column | None = None, column: str = "event_time") -> DataFrame:
    """Rows whose `column` is at least `lo` and at most `hi`.

    Tables written by `append_events` are partitioned by the day of `event_time`; where that
    column is there, the same bounds are put on it, so that other days are not opened.
    """
    keep = F.lit(True)
    for bound, test in ((lo, "__ge__"), (hi, "__le__")):
        if bound is None:
            continue
        keep = keep & getattr(F.col(column), test)(bound)
        if column == "event_time" and DATE in rows.columns:
            keep = keep & getattr(F.col(DATE), test)(F.to_date(bound))
    return rows.filter(keep)


def _step(degrees: Column, least: float, span: float) -> Column:
    at = F.floor((degrees - least) / span * (1 << PLACE_BITS)).cast("long")
    return F.least(F.greatest(at, F.lit(0).cast("long")), F.lit((1 << PLACE_BITS) - 1).cast("long"))


def _spread(bits: Column) -> Column:
    """The bits of a number with a gap after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return bits


def place_key(lat: Column, lng: Column) -> Column:
    """Place on a Z-order curve over cells of latitude and longitude: what is near is mostly near in this order."""
    x, y = _spread(_step(lng, -180.0, 360.0)), _spread(_step(lat, -90.0, 180.0))
    return F.when(lat.isNotNull() & lng.isNotNull(), x.bitwiseOR(F.shiftleft(y, 1)))


def box_ranges(box: Box, most: int = RANGES) -> list[tuple[int, int]]:
    """At most `most` ranges of place keys that hold a box: quadrants inside it, and those on its rim as finely as that allows."""
    west, south, east, north = box
    if west > east:
        return sorted(box_ranges((west, south, 180.0, north), most // 2) + box_ranges((-180.0, south, east, north), most // 2))
    side = 1 << PLACE_BITS
    at = lambda v, least, span: min(max(int((v - least) / span * side // 1), 0), side - 1)
    x0, x1, y0, y1 = at(west, -180.0, 360.0), at(east, -180.0, 360.0), at(south, -90.0, 180.0), at(north, -90.0, 180.0)
    inside, rim, width, total = [], [(0, 0, 0)], side, side * side
    while rim and width > 1:
        width //= 2
        total //= 4
        finer = []
        for x, y, first in rim:
            for k in range(4):
                cell = (x + (k & 1) * width, y + (k >> 1) * width, first + k * total)
                cx, cy, _ = cell
                if cx > x1 or cx + width <= x0 or cy > y1 or cy + width <= y0:
                    continue
                whole = cx >= x0 and cx + width - 1 <= x1 and cy >= y0 and cy + width - 1 <= y1
                (inside if whole else finer).append((cell[2], cell[2] + total - 1) if whole else cell)
        merged = _merged(inside + [(f, f + total - 1) for _, _, f in finer])
        if len(merged) > most:
            break
        found, rim = merged, finer
    return found


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and out[-1][1] + 1 >= lo:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def within(rows: DataFrame, box: Box, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Rows in a box. On tables laid out by `place` (see `sinks.write_by_place`) its key ranges reach the scan and skip row groups and pages."""
    keep = in_bbox(F.col(lat), F.col(lng), *box)
    if PLACE in rows.columns:
        ranges = [F.col(PLACE).between(lo, hi) for lo, hi in box_ranges(box)]
        near = ranges[0]
        for r in ranges[1:]:
            near = near | r
        keep = near & keep
    return rows.filter(keep)
