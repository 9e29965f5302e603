"""Probabilistic entity resolution: vessel to listed-vessel aliases with match weights.

Candidate pairs come from equi-joins (IMO, MMSI, rare trigrams). Each pair becomes one of a
few agreement patterns; expectation-maximisation runs over the pattern counts, whose number
is fixed by the comparison levels and not by the data.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import round_even
from tidemark.operators.lineage import durable
from tidemark.operators.names import similar_names

RELATION = "probabilistic_alias"
NAME_FLOOR = 0.75
LEVELS = {"imo_level": 3, "mmsi_level": 3, "name_level": 3}  # 0 is always "unknown or unlike"


def candidate_pairs(vessels: DataFrame, listed: DataFrame) -> DataFrame:
    """Pairs that agree on IMO or MMSI or have similar names, with their agreement levels."""
    v = vessels.select("entity_id", F.upper("display_name").alias("name"), "imo", F.col("canonical_id").alias("mmsi"))
    s = listed.select("listed_id", F.upper("listed_name").alias("listed_name"), "listed_imo", "listed_mmsi")
    names = similar_names(v.select("name"), s.select(F.col("listed_name").alias("name")), NAME_FLOOR)
    ids = (
        v.join(s, F.col("imo") == F.col("listed_imo")).select("entity_id", "listed_id")
        .unionByName(v.join(s, F.col("mmsi") == F.col("listed_mmsi")).select("entity_id", "listed_id"))
        .unionByName(
            v.join(names, F.col("name") == F.col("left_name"))
            .join(s, F.col("right_name") == F.col("listed_name")).select("entity_id", "listed_id")
        )
        .distinct()
    )
    full = ids.join(v, "entity_id").join(s, "listed_id").join(
        names.select(F.col("left_name").alias("name"), F.col("right_name").alias("listed_name"), "similarity"),
        ["name", "listed_name"], "left",
    )
    exact = lambda a, b: F.when(F.col(a).isNull() | F.col(b).isNull(), 0).when(F.col(a) == F.col(b), 2).otherwise(1)
    sim = F.coalesce("similarity", F.lit(0.0))
    return full.select(
        "entity_id", "listed_id", exact("imo", "listed_imo").alias("imo_level"), exact("mmsi", "listed_mmsi").alias("mmsi_level"),
        F.when(sim >= 0.9, 2).when(sim >= NAME_FLOOR, 1).otherwise(0).alias("name_level"),
    )


def fit(pairs: DataFrame, rounds: int = 25) -> dict[tuple[int, ...], float]:
    """Match probability per agreement pattern, by expectation-maximisation over pattern counts."""
    names = list(LEVELS)
    counted = pairs.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3*3*3 rows
    patterns = list(itertools.product(*[range(k) for k in LEVELS.values()]))
    n = np.array([sum(r["n"] for r in counted if tuple(r[c] for c in names) == p) for p in patterns], dtype=float)
    # Starting point: agreement is likely among matches and rare among others.
    m = [np.array(p) for p in ([0.1, 0.05, 0.85], [0.4, 0.2, 0.4], [0.15, 0.15, 0.7])]
    u = [np.array(p) for p in ([0.3, 0.69, 0.01], [0.5, 0.49, 0.01], [0.5, 0.4, 0.1])]
    share = 0.1
    levels = np.array(patterns)
    for _ in range(rounds):
        like_m = share * np.prod([m[i][levels[:, i]] for i in range(len(names))], axis=0)
        like_u = (1 - share) * np.prod([u[i][levels[:, i]] for i in range(len(names))], axis=0)
        post = like_m / (like_m + like_u)
        wm, wu = post * n, (1 - post) * n
        share = float(np.clip(wm.sum() / max(n.sum(), 1.0), 1e-4, 0.9999))
        for i, k in enumerate(LEVELS.values()):
            for weights, probs in ((wm, m), (wu, u)):
                mass = np.array([weights[levels[:, i] == level].sum() for level in range(k)]) + 0.5
                probs[i] = mass / mass.sum()
    like_m = share * np.prod([m[i][levels[:, i]] for i in range(len(names))], axis=0)
    like_u = (1 - share) * np.prod([u[i][levels[:, i]] for i in range(len(names))], axis=0)
    post = like_m / (like_m + like_u)
    # An equal IMO is definitive, whatever the fit says; different IMOs are different ships.
    post = np.where(levels[:, 0] == 2, np.maximum(post, 0.99), np.where(levels[:, 0] == 1, np.minimum(post, 0.01), post))
    return {p: float(x) for p, x in zip(patterns, post)}


def alias_edges(vessels: DataFrame, listed: DataFrame, as_of, min_probability: float = 0.5) -> DataFrame:
    """Edges (from_entity, to_entity, relation_type, valid_from, confidence), ready for an idempotent insert."""
    pairs = durable(candidate_pairs(vessels, listed))
    table = fit(pairs)
    scores = F.create_map(*[F.lit(x) for p, v in table.items() for x in ("".join(map(str, p)), v)])
    pattern = F.concat(*[F.col(c).cast("string") for c in LEVELS])
    return (
        pairs.withColumn("confidence", round_even(F.try_element_at(scores, pattern), 4))
        .filter(F.col("confidence") >= min_probability)
        .select(
            F.col("entity_id").alias("from_entity"), F.col("listed_id").alias("to_entity"), F.lit(RELATION).alias("relation_type"),
            F.date_trunc("day", as_of).alias("valid_from"), "confidence", pattern.alias("pattern"),
        )
    )


EDGE_KEYS = ["from_entity", "to_entity", "relation_type", "valid_from"]


def new_edges(existing: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(EDGE_KEYS).join(existing.select(*EDGE_KEYS), EDGE_KEYS, "left_anti")


def aliases_of(edges: DataFrame, entity_id: str, min_confidence: float = 0.0) -> DataFrame:
    return edges.filter(
        (F.col("relation_type") == RELATION) & (F.col("from_entity") == entity_id) & (F.col("confidence") >= min_confidence)
    ).orderBy(F.desc("confidence"), "to_entity")
