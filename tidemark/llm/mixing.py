"""Mixing sources to target weights by systematic sampling.

Every source gets a share of all words by its weight, at most `most` times what it has; what
it cannot take is shared by weight among the others. Within a source each document then has
the same expected number of copies, target over size. The expected copies are summed in
order of size, one offset that depends on the source and the seed is added, and a document
is taken once for every whole number its stretch of the sum crosses. Going by size makes
the sample follow the distribution of sizes, so that the words taken come near the target.

The running sum needs no window over a whole source. Documents are counted in groups of
(source, size class, salt), the groups of a source are summed up in order, and a document's
place is its place in its group plus what lies before the group. There are about
sqrt(rows) / 16 salts, so that neither the largest group nor the list of groups grows as
fast as the table: a source with a third of all rows, or a third of all rows with one size,
is spread over that many groups. The rows themselves are shuffled once.

Cases: a null or empty text has size 0 and takes 0 words, as does a source of such texts
only; a null source is one source, ordered last; rows repeated in full share the copies of
their places, so that a run repeats as a set of rows; an empty table gives an empty mix.
Equal input gives equal output, whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import durable

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(none, source, source_size, target) from (none, source, source_size); `none` marks the null source.

    With sources in order of size over weight, those that reach their limit come first: the
    n-th does if an even share of what is left after the limits before it would exceed it.
    """
    by_name = Window.orderBy("none", "source")
    named = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    named = named.withColumn("limit", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "none", "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    summed = named.withColumns({
        "left": F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(after),
    })
    level = F.col("left") / F.col("open")
    # Each source's own test; the first that passes it fixes the level of all after it.
    fits = F.when(level * F.col("weight") <= F.col("limit"), level)
    fixed = summed.withColumn("level", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight")))
    return fixed.select("none", "source", "source_size", target.cast("double").alias("target"))


def size_class(size: Column) -> Column:
    """Up to 32 exact, then 16 classes for each doubling; below a thousand in all."""
    power = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("long")
    return F.when(size < 32, size).otherwise(power * 16 + F.floor(size / F.pow(F.lit(2.0), power - 4)).cast("long"))


UNIT = 1 << 30


def copies_at(place: Column, rate: Column, offset: Column) -> Column:
    """Whole numbers that the prefix sum of `rate` passes at a place (from 1), begun at `offset` of UNIT parts.

    The rate's whole part goes to every row; only the rest, in UNIT parts, is summed, and in
    whole numbers of any size, so no row is taken more often than the rate rounded up.
    """
    part = F.floor((rate - F.floor(rate)) * float(UNIT)).cast("long")
    sum_to = lambda n: part * F.shiftright(n, 30) + F.shiftright(part * n.bitwiseAND(F.lit(UNIT - 1).cast("long")) + offset, 30)
    return F.floor(rate).cast("long") + sum_to(place) - sum_to(place - 1)


def with_copies(
    docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 1, name: str = "mix",
) -> DataFrame:
    """`docs` with size, source_size, target and copies, as fields of one struct column."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # clear of all helper names
    at = {c: F.col(own[c]) for c in (text_col, source_col, id_col)}
    text, source = at[text_col], at[source_col].cast("string")
    salts = 1 + isqrt(docs.count()) // 16
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    rows = rows.withColumns({"none": source.isNull(), "source": F.coalesce(source, F.lit("")), "size": size_of(text), "mark": F.xxhash64(F.coalesce(text, F.lit("")))})
    rows = rows.withColumns({"class": size_class(F.col("size")), "spread": F.xxhash64(F.lit(seed), at[id_col].cast("long"), "mark")})
    rows = rows.withColumn("salt", F.pmod("spread", F.lit(salts)))
    keys = ["none", "source", "class", "salt"]
    group = durable(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")))
    target = targets(group.groupBy("none", "source").agg(F.sum("words").alias("source_size")), weights, most)
    ahead = Window.partitionBy("none", "source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    group = group.withColumn("ahead", F.coalesce(F.sum("rows").over(ahead), F.lit(0))).drop("rows", "words").join(target, ["none", "source"])
    within = Window.partitionBy(*keys).orderBy("size", "spread", at[id_col], "mark")
    placed = rows.withColumn("place", F.row_number().over(within)).join(group, keys)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "none", "source"), F.lit(UNIT))
    copies = copies_at((F.col("ahead") + F.col("place")).cast("long"), rate, offset)
    mix = F.struct("size", "source_size", "target", copies.alias("copies"))
    return placed.select(*[F.col(a).alias(c) for c, a in own.items() if c != name], mix.alias(name))


def mixing(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of `docs`."""
    mixed = with_copies(docs.select("doc_id", "text", "source"))
    return mixed.select(F.col("doc_id").cast("long").alias("doc_id"), "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; copies keep all columns, the id included."""
    name = "mix" + "_" * max(map(len, docs.columns))  # longer than any column, so never one of them
    times = F.array_repeat(F.lit(1), F.col(f"{name}.copies").cast("int"))
    return with_copies(docs, name=name, **options).withColumn(name, F.explode(times)).drop(name)
