"""Exact-else-fuzzy matching of vessels against listed vessels.

Fuzzy matching is an equi-join on several of the rarest trigrams of each name at once (prefix
filter), which finds every pair at or above the threshold; the similarity is then computed exactly.
Names are de-duplicated first, so that a name shared by very many rows is compared once.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scoring import mapped
from tidemark.functions.text import set_jaccard, trigrams
from tidemark.operators.lineage import durable
from tidemark.sources.refdata import CONVENIENCE_FLAGS, REGIME_FLAGS

MIN_NAME = 4


TOGETHER = {4: 6, 3: 9, 2: 20}  # grams that make a key, and for how many grams outside the overlap at most
SKETCH = 2  # 64-bit words of a name's parity sketch


def _together(size: Column, threshold: float) -> Column:
    """How many grams make a key, for pairs whose smaller name has `size` grams."""
    overlap = _overlap(size, threshold)
    out = F.lit(1)
    for n, most in sorted(TOGETHER.items()):
        out = F.when((overlap >= n) & (size - overlap <= most), n).otherwise(out)
    return out


def _overlap(size: Column, threshold: float) -> Column:
    """How many grams of a name a similar one has at least."""
    return F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int")


def _choices(spark, threshold: float) -> DataFrame:
    """(n, kept, places): every choice of n places among the first `kept`."""
    rows = []
    for n, most in TOGETHER.items():
        for kept in range(n, math.ceil((most + 1) / threshold) + n + 1):
            rows += [(n, kept, list(places)) for places in itertools.combinations(range(1, kept + 1), n)]
    return spark.createDataFrame(rows, "n int, kept int, places array<int>")


def _indexed(names: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """(key, name, size, s0, s1): each name once per choice of n grams of its prefix, the size - overlap + n rarest of its grams.

    n follows the size of a pair's smaller name, so a name has keys for every n that names as
    small as its partners can be may have.
    """
    gram_bits = F.xxhash64("gram")
    bit = F.expr("shiftleft(1L, cast(xxhash64(gram) & 63 as int))")
    word = lambda w: F.bit_xor(F.when(F.pmod(F.shiftright(gram_bits, 8), F.lit(SKETCH)) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{w}")
    ranked = (
        names.select("name", F.explode("grams").alias("gram"))
        .join(frequency, "gram")
        .groupBy("name")
        .agg(F.array_sort(F.collect_list(F.struct("freq", "gram"))).alias("ranked"), *[word(w) for w in range(SKETCH)])
    )
    size = F.size("ranked")
    kinds = F.array_distinct(F.transform(F.sequence(_overlap(size, threshold), size), lambda k: _together(k, threshold)))
    rows = ranked.select("name", size.alias("size"), *[f"s{w}" for w in range(SKETCH)], F.transform("ranked", lambda r: r["gram"]).alias("grams"), F.explode(kinds).alias("n"))
    rows = rows.withColumn("kept", F.col("size") - _overlap(F.col("size"), threshold) + F.col("n"))
    own = ["name", "size", *[f"s{w}" for w in range(SKETCH)]]
    single = rows.filter("n = 1").select(*own, F.explode(F.slice("grams", F.lit(1), F.col("kept"))).alias("g")).select(F.xxhash64(F.lit(1), "g").alias("key"), *own)
    several = rows.filter("n > 1").join(F.broadcast(_choices(names.sparkSession, threshold)), ["n", "kept"])
    chosen = F.xxhash64("n", *[F.get("grams", F.get("places", F.lit(k)) - 1) for k in range(max(TOGETHER))])
    return single.unionByName(several.select(chosen.alias("key"), *own))


def similar_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_name, right_name, similarity) of all pairs of `name` at or above the threshold.

    Similar names share at least n of the size - overlap + n rarest grams of either, so they meet
    on a key of n grams. Single grams are shared by a part of all names, whatever their number;
    several together leave few. What meets is tested on parity sketches, whose Hamming distance
    never exceeds the number of grams in which two names differ, and then exactly, once a pair.
    """
    prepare = lambda df: df.select("name").distinct().withColumn("grams", trigrams(F.col("name"))).filter(
        F.size("grams") > 0
    )
    # Each side is read for its grams, their frequencies and the index; it is worked out once.
    a, b = durable(prepare(left)), durable(prepare(right))
    frequency = (
        a.unionByName(b).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    )
    side = lambda rows, end: _indexed(rows, frequency, threshold).select("key", *[F.col(c).alias(f"{end}_{c}") for c in ("name", "size", *[f"s{w}" for w in range(SKETCH)])])
    size_a, size_b = F.col("left_size"), F.col("right_size")
    plausible = (size_a >= size_b * F.lit(threshold) - F.lit(1e-9)) & (size_b >= size_a * F.lit(threshold) - F.lit(1e-9))
    apart = sum((F.bit_count(F.col(f"left_s{w}").bitwiseXOR(F.col(f"right_s{w}"))) for w in range(SKETCH)), F.lit(0))
    near = apart <= (size_a + size_b) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-9)
    # The keys are many times what they are made from, so neither side is to be broadcast by the size of that.
    met = side(a, "left").hint("merge").join(side(b, "right"), "key").filter(plausible & near).select("left_name", "right_name").distinct()
    found = met.withColumn("similarity", set_jaccard(trigrams(F.col("left_name")), trigrams(F.col("right_name"))))
    return found.filter(F.col("similarity") >= threshold)


def match_listed(vessels: DataFrame, listed: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Vessel × listed vessel: equal IMO, or similar names where either IMO is unknown.

    `vessels` has entity_id, display_name, imo; `listed` has listed_id, listed_name,
    listed_imo; other columns pass through. Adds match_kind and similarity.
    """
    by_imo = vessels.join(listed, F.col("imo") == F.col("listed_imo")).select(
        "*", F.lit("imo").alias("match_kind"), F.lit(None).cast("double").alias("similarity")
    )
    v = vessels.withColumn("_name", F.upper("display_name")).filter(F.length("display_name") >= MIN_NAME)
    s = listed.withColumn("_listed_name", F.upper("listed_name")).filter(F.length("listed_name") >= MIN_NAME)
    pairs = similar_names(
        v.select(F.col("_name").alias("name")), s.select(F.col("_listed_name").alias("name")), threshold
    )
    either_unknown = F.col("imo").isNull() | F.col("listed_imo").isNull()
    by_name = (
        v.join(pairs, F.col("_name") == F.col("left_name"))
        .join(s, F.col("right_name") == F.col("_listed_name"))
        .filter(either_unknown)
        .withColumn("match_kind", F.lit("name"))
        .select(*by_imo.columns)
    )
    return by_imo.unionByName(by_name)


def flag_of(mmsi: Column, identity_digits: DataFrame | dict[int, str]) -> Column:
    """ISO country of a nine-digit vessel identity, from its first three digits.

    The assignment table is a parameter, as the public list changes.
    """
    number = mmsi.try_cast("bigint")
    digits = F.when(number.between(100_000_000, 999_999_999), F.floor(number / 1_000_000).cast("int"))
    return mapped(digits, identity_digits, None)


def flag_consistent(flag: Column, regime: Column) -> Column:
    """False only for a known ordinary flag outside the regime's known set of flags."""
    expected = F.create_map(*[x for k, v in REGIME_FLAGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    flags = F.try_element_at(expected, F.upper(F.trim(regime)))
    return F.coalesce(flag.isNull() | flag.isin(*CONVENIENCE_FLAGS) | F.array_contains(flags, flag), F.lit(True))
