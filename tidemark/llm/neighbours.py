"""Nearest neighbours with vantage-point trees, one per shard of the vectors.

Rows are spread evenly over shards by a hash of their id. Each shard's task builds a
vantage-point tree over its vectors and answers all queries, which reach it in blocks
after the vectors; each answer carries the shard's best `k`, and the best `k` of all
shards are the result. No task holds more than one shard and one block of queries.

The nearness is the inner product. A vector x of norm up to M becomes (x, sqrt(M2 - |x|2))
and a query (q, 0); the Euclidean distance of these falls as the inner product grows, so
the tree's triangle inequality applies. A branch is left out if no point of it can come
nearer than the k-th best so far: |d(q, vantage) - radius| > factor * that distance. The
factor 1 is the exact search, smaller ones visit fewer branches. On unclustered vectors of
64 dimensions nearly every branch is within reach, and the search is then what it costs to
go through all leaves with matrix products; the tree pays where vectors lie in clumps.

Scores are sums in the order of the components, in double precision, so equal vectors
score exactly alike and ties go to the smaller id.

Cases: vectors that are null, empty, of another length than the most common one, zero, or
with a null or non-finite component take no part, nor do rows with a null id; of rows with
one id all take part as candidates, and the query is asked once, with the first of them in
order of components; a query's own id is no candidate; with fewer than k candidates all are
returned; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
FACTOR = 1.0
LEAF = 256
SHARD_ROWS = 8192
BLOCK = 512
FOUND = "query_id long, vec_id long, score double"


class Tree:
    """A vantage-point tree as nested tuples: (vantage row, radius, inside, outside), or an array of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: float, leaf: int) -> None:
        self.ids, self.vectors, self.leaf = ids, vectors, leaf
        self.rest = np.sqrt(np.maximum(bound - (vectors**2).sum(1), 0.0))
        self.bound = bound
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # The row farthest from the first one lies at a rim, which splits best.
        from_first = self._distances(rows[0], rows)
        vantage = int(rows[np.argmax(from_first)])
        d = self._distances(vantage, rows)
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():  # equal distances: nothing to split by
            return rows
        return vantage, radius, self._build(rows[inside]), self._build(rows[~inside])

    def _distances(self, row: int, rows: np.ndarray) -> np.ndarray:
        d = ((self.vectors[rows] - self.vectors[row]) ** 2).sum(1) + (self.rest[rows] - self.rest[row]) ** 2
        return np.sqrt(d)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vector row, score) of each query's k best, and ties of the last."""
        n = len(queries)
        norm = (queries**2).sum(1)
        best = [np.zeros(0, np.int64)] * n  # candidate rows
        about = [np.zeros(0)] * n  # their inner products by matrix product, good to about 1e-12
        last = np.full(n, -np.inf)  # k-th best of them
        slack = 1e-9 * (1.0 + np.sqrt(norm * self.bound))

        def visit(node, asked: np.ndarray) -> None:
            if not len(asked):
                return
            if isinstance(node, tuple):
                vantage, radius, inside, outside = node
                to = np.sqrt(np.maximum(norm[asked] + self.bound - 2 * (queries[asked] @ self.vectors[vantage]), 0.0))
                within = to <= radius
                for first, second, mine in ((inside, outside, within), (outside, inside, ~within)):
                    near = asked[mine]
                    visit(first, near)
                    reach = np.sqrt(np.maximum(norm[near] + self.bound - 2 * (last[near] - slack[near]), 0.0))
                    visit(second, near[np.abs(to[mine] - radius) <= factor * reach])
                return
            product = queries[asked] @ self.vectors[node].T
            hit = (product >= (last[asked] - slack[asked])[:, None]) & (self.ids[node][None, :] != query_ids[asked][:, None])
            for i in np.flatnonzero(hit.any(1)):
                q, own = asked[i], hit[i]
                rows, near = np.append(best[q], node[own]), np.append(about[q], product[i, own])
                if len(rows) > k:
                    last[q] = np.partition(near, len(near) - k)[len(near) - k]
                    keep = near >= last[q] - slack[q]
                    rows, near = rows[keep], near[keep]
                elif len(rows) == k:
                    last[q] = near.min()
                best[q], about[q] = rows, near

        visit(self.root, np.arange(n))
        q = np.repeat(np.arange(n), [len(b) for b in best])
        rows = np.concatenate(best) if n else np.zeros(0, np.int64)
        score = np.zeros(len(q))
        for j in range(queries.shape[1]):
            score += queries[q, j] * self.vectors[rows, j]
        order = np.lexsort((self.ids[rows], -score, q))
        q, rows, score = q[order], rows[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < k
        return q[top], rows[top], score[top]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _answer(k: int, factor: float, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, vectors first, then query blocks."""
        shard, ids, parts, tree = None, [], [], None
        for batch in batches:
            of = batch.column(0).to_numpy()
            kind = batch.column(1).to_numpy()
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
                if of[a] != shard:
                    shard, ids, parts, tree = of[a], [], [], None
                run_of = batch.slice(a, b - a)
                if kind[a] < 0:
                    ids.append(run_of.column(2).to_numpy())
                    parts.append((_matrix(run_of.column(3)), run_of.column(4)[0].as_py()))
                    continue
                if not parts:
                    continue
                if tree is None:
                    tree = Tree(np.concatenate(ids), np.concatenate([p for p, _ in parts]), parts[0][1], leaf)
                for s in range(0, b - a, BLOCK):
                    block = run_of.slice(s, BLOCK)
                    asked = block.column(2).to_numpy()
                    q, rows, score = tree.search(asked, _matrix(block.column(3)), k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(tree.ids[rows]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, factor: float = FACTOR, leaf: int = LEAF, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product with each row for which `queries` holds."""
    asked = F.coalesce(queries, F.lit(False)).alias("asked")
    picked = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), asked)
    good = picked.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = good.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("bound"))
    facts = facts.orderBy(F.desc("n"), "width").limit(1).collect()
    width, n, bound = (facts[0]["width"], facts[0]["n"], facts[0]["bound"]) if facts else (1, 0, 0.0)
    shards = max(1, -(-n // shard_rows))
    good = good.filter(F.size("vector") == width)
    stored = good.select(F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(-1).alias("kind"), "id", "vector", F.lit(float(bound)).alias("bound"))
    questions = good.filter("asked").groupBy("id").agg(F.min("vector").alias("vector"))
    every = questions.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("kind"), "id", "vector", F.lit(float(bound)).alias("bound"))
    dealt = stored.unionByName(every).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "id")
    found = dealt.mapInArrow(_answer(k, factor, leaf), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 20 == 0)


ORACLE = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, x -> x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, x -> x <> 0)) > 0
),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), x -> x[1] * x[2])) AS score FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
