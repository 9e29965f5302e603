"""Inverted lists: vectors stored by their nearest of some centres, of which a search opens a few.

The centres come from k-means over a bounded sample, but every vector is in a list. A search
ranks the centres by cosine, opens the nearest `probes` lists (folders, so the others are not
read) and ranks their vectors exactly; with all lists open it is the exact scan. How many
lists a recall needs depends on the data: clustered vectors need few, evenly spread ones many.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.serving import similar_vectors

LISTS, SAMPLE = 64, 20_000


def write_lists(rows: DataFrame, path: str, lists: int = LISTS, sample: int = SAMPLE, seed: int = 7) -> None:
    """Store rows (id, embedding, ...) by list. Vectors that are null, zero or not finite have no direction and no place."""
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x * x))
    placed = rows.filter(F.col("embedding").isNotNull() & (norm > 0) & (norm < float("inf"))).withColumn("_v", array_to_vector(numbers))
    # The sample is the rows of smallest hash: the same in every run, at most `sample` of them.
    some = placed.select("_v", F.xxhash64(F.lit(seed), "id").alias("_h")).orderBy("_h").limit(sample)
    model = KMeans(k=lists, seed=seed, featuresCol="_v", predictionCol="list", distanceMeasure="cosine", maxIter=15).fit(some)
    model.transform(placed).drop("_v").repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    centres = [(k, [float(x) for x in v]) for k, v in enumerate(model.clusterCenters())]
    rows.sparkSession.createDataFrame(centres, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def from_lists(spark: SparkSession, path: str, seed: list[float], limit: int = 10, probes: int | None = 4, exclude=None) -> DataFrame:
    """The nearest rows to one vector by cosine distance, from its `probes` nearest lists (None: all, which is exact)."""
    rows = spark.read.parquet(f"{path}/lists")
    if probes is not None:
        size = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
        centres = spark.read.parquet(f"{path}/centres").collect()  # as many as lists
        rank = lambda r: (-sum(a * b for a, b in zip(seed, r.centre, strict=True)) / size(r.centre), r.list)
        rows = rows.filter(F.col("list").isin(*[r.list for r in sorted(centres, key=rank)[:probes]]))
    near = similar_vectors(rows, F.array(*[F.lit(float(x)) for x in seed]), limit, None if exclude is None else F.lit(exclude))
    return near.drop("list")
