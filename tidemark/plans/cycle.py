"""One detection cycle: all detectors in dependency order for a moment, each on its own."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.detectors import clusters, encounters, listed, movement, ports
from tidemark.operators.lineage import durable

log = logging.getLogger(__name__)


@dataclass
class Inputs:
    """Tables of a cycle. `events` holds raw events and earlier findings alike."""

    current: DataFrame
    track: DataFrame
    events: DataFrame
    ports: DataFrame
    zones: DataFrame
    listed: DataFrame
    as_of: Column
    options: dict[str, dict] = field(default_factory=dict)
    found: dict[str, DataFrame] = field(default_factory=dict)

    def with_new(self, *names: str) -> DataFrame:
        """Earlier findings together with what this cycle's upstream detectors found."""
        rows = self.events
        for name in names:
            if name in self.found:
                rows = rows.unionByName(self.found[name], allowMissingColumns=True)
        return rows


def _fleet(i: Inputs, **o) -> DataFrame:
    """The options reach every step that they concern."""
    own = lambda *names: {k: o[k] for k in names if k in o}
    rows = clusters.latest_matches(i.with_new("sanctions_match"), i.as_of, **own("lookback_hours"))
    members = clusters.fleet_members(rows, **own("radius_m", "min_vessels"))
    return clusters.fleet_clusters(members, i.as_of, i.events, **o)


# Name -> function; the order matters: what a detector reads comes before it.
DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "event_proximity": lambda i, **o: encounters.event_proximity(i.current, i.events, i.as_of, i.events, **o),
    "entity_proximity": lambda i, **o: encounters.entity_proximity(i.current, i.as_of, i.events, **o),
    "dark_vessels": lambda i, **o: movement.dark_vessels(i.current, i.as_of, i.events, **o),
    "loitering": lambda i, **o: movement.loitering(i.current, i.track, i.as_of, i.events, **o),
    "rendezvous": lambda i, **o: encounters.rendezvous(i.current, i.track, i.as_of, i.events, **o),
    "port_arrivals": lambda i, **o: ports.port_arrivals(i.current, i.ports, i.as_of, i.events, **o),
    "port_calls": lambda i, **o: ports.port_calls(i.current, i.ports, i.as_of, i.events, **o),
    "port_departures": lambda i, **o: ports.port_departures(i.current, i.ports, i.as_of, i.with_new("port_arrivals", "port_calls"), **o),
    "military_flights": lambda i, **o: movement.military_flights(i.current, i.as_of, i.events, **o),
    "zone_intrusions": lambda i, **o: movement.zone_intrusions(i.current, i.zones, i.as_of, i.events, **o),
    "sanctions_match": lambda i, **o: listed.sanctions_matches(i.current, i.listed, i.as_of, i.events, **o),
    "multi_authority": lambda i, **o: listed.multi_authority(i.with_new("sanctions_match"), i.as_of, i.events, **o),
    "listed_and_dark": lambda i, **o: listed.listed_and_dark(i.current, i.listed, i.as_of, i.events, **o),
    "listed_rendezvous": lambda i, **o: listed.listed_rendezvous(i.current, i.listed, i.as_of, i.events, **o),
    "listed_port_arrivals": lambda i, **o: listed.listed_port_arrivals(
        i.with_new("sanctions_match", "port_arrivals", "port_calls"), i.as_of, i.events, **o
    ),
    "fleet_clusters": _fleet,
}


def run_cycle(inputs: Inputs, write: Callable[[str, DataFrame], None] | None = None) -> dict[str, str]:
    """Run every detector; a failing one is reported and the others go on.

    Findings are written durably before later detectors read them. Returns name -> 'ok' or
    the error.
    """
    inputs.current = durable(inputs.current)
    state = {}
    for name, detect in DETECTORS.items():
        try:
            found = durable(detect(inputs, **inputs.options.get(name, {})))
            if write is not None:
                write(name, found)
            inputs.found[name] = found
            state[name] = "ok"
        except Exception as error:  # noqa: BLE001 - one detector must not stop the cycle
            log.exception("detector %s failed", name)
            state[name] = f"{type(error).__name__}: {error}"
    return state


def totals(spark: SparkSession, inputs: Inputs, state: dict[str, str]) -> DataFrame:
    """Findings per detector of a cycle, with the state of each."""
    status = spark.createDataFrame(sorted(state.items()), "detector string, status string")
    counts = None
    for name, rows in inputs.found.items():
        one = rows.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(name).alias("detector"), "findings")
        counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        return status.withColumn("findings", F.lit(0).cast("bigint"))
    return status.join(counts, "detector", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
