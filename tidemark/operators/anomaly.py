"""Bucket anomalies: deviation from a moving baseline, an isolation forest, and both combined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import region_for
from tidemark.functions.stats import clamp, quantile_by_index, round_even
from tidemark.operators.latest import top_per_group

FEATURES = ("count", "avg_severity", "max_severity", "p90_severity", "sum_severity", "hour_sin", "hour_cos")


def ewma_anomalies(stats: DataFrame, baselines: DataFrame, min_sample: int = 5, z_threshold: float = 2.0, min_cycles: int = 3) -> DataFrame:
    """Buckets whose count lies two or more standard deviations from their baseline."""
    std = F.greatest(F.lit(1.0), F.coalesce("std_count", F.lit(1.0)))
    z = (F.col("count") - F.coalesce("mean_count", F.lit(0.0))) / std
    rows = stats.filter(F.col("count") >= min_sample).join(
        baselines.filter(F.col("n_cycles") >= min_cycles), ["layer", "region"]
    ).withColumns({"z": z, "std": std})
    severity = clamp(round_even(F.abs("z") + F.col("max_severity") / 2, 0).cast("int"), 3, 10)
    return rows.filter(F.abs("z") >= z_threshold).select(
        "layer", "region", "count", round_even(F.col("mean_count"), 2).alias("baseline_mean"), round_even(F.col("std"), 2).alias("baseline_std"),
        round_even(F.col("z"), 2).alias("z_score"), "max_severity", "avg_severity",
        F.when(F.col("z") > 0, "spike").otherwise("dropout").alias("direction"),
        severity.alias("anomaly_severity"), F.lit("ewma").alias("method"),
    )


def bucket_samples(events: DataFrame, k: int = 5) -> DataFrame:
    """First k events of each bucket, as evidence."""
    rows = events.filter(F.col("lat").isNotNull()).withColumn("region", region_for(F.col("lat"), F.col("lng")))
    return top_per_group(rows, ["layer", "region"], [F.asc("event_time"), F.asc("event_id")], k).select(
        "layer", "region", "rank", "event_id", "lat", "lng", "severity"
    )


def bucket_features(events: DataFrame, keys: tuple[str, ...] = ("layer", "region", "hour_start")) -> DataFrame:
    """Seven features per bucket. Severities are integers from 0 to 10, so a bucket is first
    reduced to at most eleven counts; the percentile is read off their running sum."""
    severity = F.coalesce(F.col("severity"), F.lit(0)).cast("int")
    rows = events.filter(F.col("lat").isNotNull()).select(
        F.coalesce("layer", F.lit("unknown")).alias("layer"), region_for(F.col("lat"), F.col("lng")).alias("region"),
        F.date_trunc("hour", "event_time").alias("hour_start"), severity.alias("severity"),
    )
    levels = rows.groupBy(*keys, "severity").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    per = levels.groupBy(*keys).agg(
        total.alias("count"),
        (F.sum(F.col("severity") * F.col("n")) / total).alias("avg_severity"),
        F.max("severity").cast("double").alias("max_severity"),
        F.sum(F.col("severity") * F.col("n")).cast("double").alias("sum_severity"),
        F.array_sort(F.collect_list(F.struct("severity", "n"))).alias("levels"),
    )
    wanted = F.floor(F.lit(0.9) * (F.col("count") - 1))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0).alias("value"))
    read = F.aggregate(
        "levels", start,
        lambda acc, x: F.when(acc["seen"] > wanted, acc).otherwise(
            F.struct((acc["seen"] + x["n"]).alias("seen"), x["severity"].alias("value"))
        ),
    )["value"]
    angle = F.hour("hour_start") * (2 * np.pi / 24)
    return per.select(
        *keys, F.col("count").cast("double").alias("count"), "avg_severity", "max_severity",
        read.cast("double").alias("p90_severity"), "sum_severity", F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"),
    )


def features_of(severities: Column, hour: Column) -> list[Column]:
    """The same features from an array of severities."""
    n, total = F.size(severities), F.aggregate(severities, F.lit(0.0), lambda a, x: a + x)
    angle = hour * (2 * np.pi / 24)
    return [
        n.cast("double"), F.coalesce(total / F.nullif(n, F.lit(0)), F.lit(0.0)), F.coalesce(F.array_max(severities), F.lit(0.0)),
        F.when(n > 0, quantile_by_index(severities, 0.9)).otherwise(0.0), total, F.sin(angle), F.cos(angle),
    ]


TREES, SAMPLE = 100, 256
TREE_SCHEMA = "tree int, nodes array<struct<feature:int,cut:double,left:int,right:int,size:int>>"


def _grow(rows: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, int]]:
    """One isolation tree over at most SAMPLE rows, as a flat list of nodes."""
    limit = int(np.ceil(np.log2(max(2, len(rows)))))
    nodes: list = []

    def add(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        spans = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(rows.shape[1])
        open_axes = np.flatnonzero(spans > 0)
        if depth >= limit or len(part) <= 1 or not len(open_axes):
            nodes.append((-1, 0.0, -1, -1, len(part)))
            return at
        axis = int(rng.choice(open_axes))
        cut = float(rng.uniform(part[:, axis].min(), part[:, axis].max()))
        nodes.append(None)
        below = part[:, axis] < cut
        nodes[at] = (axis, cut, add(part[below], depth + 1), add(part[~below], depth + 1), len(part))
        return at

    add(rows, 0)
    return nodes


def _expected_path(n: np.ndarray) -> np.ndarray:
    n = np.maximum(np.asarray(n, dtype=float), 1.0)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def train_forest(features: DataFrame, trees: int = TREES, seed: int = 7, sample: int = SAMPLE) -> DataFrame:
    """One tree per group, grown from the `sample` rows of smallest hash for that tree.

    The size of its sample is part of how an isolation tree is defined. Each row is offered
    to every tree, at any size of the table; a task passes on only the rows of smallest hash
    per tree (WindowGroupLimit), so the exchange holds tasks x trees x sample rows at most.
    """
    own = [c for c in features.columns if c not in FEATURES]
    offered = features.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    order = F.xxhash64(*FEATURES, *own, "tree", F.lit(seed))
    kept = top_per_group(offered, ["tree"], [F.asc(order)], sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["tree"].iloc[0])
        ordered = pdf.sort_values(list(FEATURES))[list(FEATURES)].to_numpy(dtype=float)
        nodes = _grow(ordered, np.random.default_rng([seed, number]))
        keys = ("feature", "cut", "left", "right", "size")
        return pd.DataFrame({"tree": [number], "nodes": [[dict(zip(keys, n)) for n in nodes]]})

    return kept.select("tree", *FEATURES).groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


def _score_udf(spark, trees: DataFrame):
    """Vectorised anomaly score. The model is bounded by trees x (2 x SAMPLE - 1) nodes."""
    flat = [
        {k: np.array([n[k] for n in row["nodes"]]) for k in ("feature", "cut", "left", "right", "size")}
        for row in trees.orderBy("tree").collect()
    ]
    model = spark.sparkContext.broadcast(flat)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forest = model.value
        size = max((int(t["size"][0]) for t in forest), default=1)
        for columns in parts:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            depth = np.zeros(len(x))
            for t in forest:
                at = np.zeros(len(x), dtype=int)
                steps = np.zeros(len(x))
                while (inner := t["feature"][at] >= 0).any():
                    i = np.flatnonzero(inner)
                    node = at[i]
                    below = x[i, t["feature"][node]] < t["cut"][node]
                    at[i] = np.where(below, t["left"][node], t["right"][node])
                    steps[i] += 1
                depth += steps + _expected_path(t["size"][at])
            mean = depth / max(1, len(forest))
            yield pd.Series(-np.power(2.0, -mean / max(1e-9, float(_expected_path(np.array([size]))[0]))))

    return score


def forest_scorer(trees: DataFrame):
    """Function that adds `raw_score` to feature rows; the forest is grown once, here."""
    score = _score_udf(trees.sparkSession, trees)
    return lambda features: features.withColumn("raw_score", score(*FEATURES))


def forest_anomalies(current: DataFrame, history: DataFrame, trees: DataFrame, contamination: float = 0.05, min_sample: int = 5) -> DataFrame:
    """Buckets scored below the contamination quantile of the history; lower is stranger."""
    score = forest_scorer(trees)
    offset = score(history).agg(F.percentile_approx("raw_score", contamination, 10000).alias("o"))
    scored = score(current.filter(F.col("count") >= min_sample)).withColumn(
        "iso_score", F.col("raw_score") - offset.scalar()
    )
    severity = clamp(
        round_even(3 + F.abs(F.least(F.lit(0.0), F.col("iso_score"))) * 30 + F.col("max_severity") / 2, 0).cast("int"), 3, 10
    )
    return scored.filter(F.col("iso_score") < 0).select(
        "layer", "region", F.col("count").cast("bigint").alias("count"), round_even(F.col("iso_score"), 4).alias("iso_score"),
        F.col("max_severity").cast("int").alias("max_severity"), round_even(F.col("avg_severity"), 2).alias("avg_severity"),
        severity.alias("anomaly_severity"), F.lit("isolation_forest").alias("method"),
    )


def combine(ewma: DataFrame, forest: DataFrame) -> DataFrame:
    """Union of both methods by bucket; agreement raises the severity by one."""
    a = ewma.select("layer", "region", F.struct("count", "z_score", "anomaly_severity", "max_severity").alias("e"))
    b = forest.select("layer", "region", F.struct("count", "iso_score", "anomaly_severity", "max_severity").alias("f"))
    both = F.col("e").isNotNull() & F.col("f").isNotNull()
    strongest = F.greatest("e.anomaly_severity", "f.anomaly_severity")
    return a.join(b, ["layer", "region"], "full_outer").select(
        "layer", "region", F.coalesce("e.count", "f.count").alias("count"), F.col("e.z_score").alias("z_score"),
        F.col("f.iso_score").alias("iso_score"), F.coalesce("e.max_severity", "f.max_severity").alias("max_severity"),
        F.when(both, F.least(F.lit(10), strongest + 1)).otherwise(strongest).alias("anomaly_severity"),
        F.when(both, "ewma+iso").when(F.col("e").isNotNull(), "ewma").otherwise("isolation_forest").alias("method"),
    )
