"""Line dedup: lines that many documents share stay in one of them only.

Lines are exploded as hashes (two of 64 bits; no text is shuffled), distinct documents are
counted per hash with a map-side combine, and the hashes over the threshold are joined back
to find the positions to drop. A document is put together again from the lines it keeps, in
their order. A line that a third of all documents hold is one row per document in the
counting shuffle, spread by (hash, document); in the join back it is the kind of hot key
that adaptive execution splits, as nothing above the join needs its rows together.

Cases: a null or empty text is one empty line; lines that differ in case (A-Z) or outer
white space only have one key; a null doc_id counts as one document below all others; rows
repeated in full are decided alike and stay repeated; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, last) of the keys in at least `min_docs` documents; `last` is the largest id."""
    per_document = lines.select("h1", "h2", "_id").distinct()
    found = per_document.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("last"))
    return found.filter(F.col("n") >= min_docs).drop("n")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """`docs` with the text that is left, and the counts of lines before and of lines dropped."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # clear of all helper names
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    text, doc_id = F.col(own[text_col]), F.coalesce(F.col(own[id_col]).cast("long"), F.lit(NO_ID))
    mark = F.xxhash64(F.coalesce(text, F.lit("")))
    exploded = rows.select(doc_id.alias("_id"), mark.alias("_mark"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keyed = exploded.select("_id", "_mark", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    hashed = keyed.select("_id", "_mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(min_chars), "key").alias("h2"))
    shared = shared_lines(hashed, min_docs)
    gone = hashed.join(shared, ["h1", "h2"]).filter(F.col("_id") < F.col("last"))
    gone = gone.groupBy("_id", "_mark").agg(F.collect_set("pos").alias("gone"))
    joined = rows.withColumns({"_id": doc_id, "_mark": mark}).join(gone, ["_id", "_mark"], "left")
    lines = lines_of(text)
    # array_except looks positions up in a hash set, so long documents stay linear.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: lines[i]), "\n"))
    out = [kept.alias(c) if c == text_col else F.col(a).alias(c) for c, a in own.items() if c not in (n_lines, n_dropped)]
    dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    return joined.select(*out, F.size(lines).cast("long").alias(n_lines), dropped.cast("long").alias(n_dropped))


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of `docs`."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = """
WITH base AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, i AS pos, parts[i] AS line, translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM base)
),
shared AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id <> s.last AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key AND length(l.key) >= 20)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
