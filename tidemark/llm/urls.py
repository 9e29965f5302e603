"""URL filter with redirect equivalence.

Rules are joined to urls by host suffix; of those whose path begins the url's path the
longest wins. Urls that stand for one page (a page and the canonical link or the refresh
target in its html, and any redirects given) are linked, and the connected components of
these links are aliases of each other. A url without a rule takes its aliases' decision:
allow if a rule allows one of them, else block if a rule blocks one, else allow. A url's own
rule always comes first.

Links are found per distinct url and only urls with a link enter the components, which run
as large-star and small-star rounds over tables. The rule join is a plain equi-join on the
host suffix: a short list is broadcast when Spark measures it as small, a long one shuffles,
and hot suffixes such as `com` are split as skewed keys.

Cases: a null url, or one without `://`, has an empty host and path, fits no rule and has no
alias, so it is allowed; null html has no link; repeated rows are judged each; an empty table
gives no row. A null or malformed target is no link. Other columns of `pages` are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.graph import connected_components
from tidemark.operators.lineage import durable

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(url: Column) -> Column:
    """A url without its scheme and fragment, host in lower case: the same page for all of them. Empty without a host."""
    return F.concat(host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]+([^#]*)", 1))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted either way or bare."""
    value = rf"""(?is)\s{name}\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
    return F.btrim(F.regexp_replace(F.regexp_extract(tag, value, 0), r"(?s)^\s\S+?\s*=\s*|[\"']", ""))


def absolute(rows: DataFrame, base: str, link: str, out: str) -> DataFrame:
    """`rows` with the link as seen from the page `base`; null if it is empty or of a scheme without `://`.

    Every step is a column of its own, so that no expression is copied into several others.
    """
    parts = rows.withColumns({
        "_scheme": F.regexp_extract(base, r"^([^:/?#]*:)//", 1),
        "_root": F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*", 0),
        "_folder": F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*([^?#]*/)", 1),
    })
    to = F.col(link)
    whole = (
        F.when(F.coalesce(to, F.lit("")) == "", None)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat("_scheme", to))
        .when(to.startswith("/"), F.concat("_root", to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^[?#]"), None)
        .otherwise(F.concat("_root", F.when(F.col("_folder") == "", "/").otherwise(F.col("_folder")), to))
    )
    return parts.withColumn(out, whole).drop("_scheme", "_root", "_folder")


def links(pages: DataFrame) -> DataFrame:
    """(src, dst) page keys of canonical links and refresh targets; only pages that hold such a word are looked at closely."""
    tag = r"(?is)<(?:link\b[^>]*\brel\s*=\s*[\"']?canonical|meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh)\b[^>]*>"
    hinted = pages.filter(F.col("html").rlike(r"(?i)canonical|refresh") & F.col("url").isNotNull())
    tags = hinted.select("url", F.explode(F.regexp_extract_all("html", F.lit(tag), F.lit(0))).alias("tag"))
    tags = durable(tags)
    href = _attribute(F.col("tag"), "href")
    after = F.btrim(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is);\s*url\s*=\s*(.*)", 1))
    targets = tags.withColumn("to", F.when(F.col("tag").rlike(r"(?i)^<link"), href).otherwise(after))
    seen = absolute(targets, "url", "to", "dst")
    return seen.select(page_key(F.col("url")).alias("src"), page_key(F.col("dst")).alias("dst"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = spark.createDataFrame([(v, h.lower(), p) for v, h, p in rules], "verdict string, rule_host string, rule_path string")
    return rows.filter("verdict in ('allow', 'block')")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of distinct (host, path) that a rule fits; ties of length go to block."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("host", "path").filter("host <> ''").distinct().withColumn("rule_host", F.explode(suffixes))
    fits = asked.join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), F.col("verdict").alias("verdict"), rule.alias("rule")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, aliases_block, aliases_allow) for every row of `pages`.

    `rules` has (verdict, rule_host, rule_path), `redirects` urls (source, target).
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = links(pages)
    if redirects is not None:
        found = found.unionByName(redirects.select(page_key(F.col("source")).alias("src"), page_key(F.col("target")).alias("dst")))
    found = durable(found.filter("src <> dst and src <> '' and dst <> ''").distinct())
    if not found.isEmpty():
        whole = connected_components(found, "src", "dst")
        as_url = F.concat(F.lit("x://"), F.col("node"))
        members = whole.withColumns({"host": host_of(as_url), "path": path_of(as_url)})
        judged = members.join(fitting_rules(members, rules), ["host", "path"])
        decided = judged.groupBy("component").agg(F.bool_or(F.col("verdict") == "block").alias("blocks"), F.bool_or(F.col("verdict") == "allow").alias("allows"))
        aliases = whole.join(decided, "component").select(F.col("node").alias("key"), "blocks", "allows")
        rows = rows.withColumn("key", page_key(F.col("url"))).join(aliases, "key", "left").drop("key")
    else:
        rows = rows.withColumns({"blocks": F.lit(False), "allows": F.lit(False)})
    out = rows.join(fitting_rules(rows, rules), ["host", "path"], "left")
    blocks, allows = F.coalesce("blocks", F.lit(False)), F.coalesce("allows", F.lit(False))
    passed_on = F.when(blocks & ~allows, "block").otherwise(DEFAULT)
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", passed_on).alias("verdict"), blocks.alias("aliases_block"), allows.alias("aliases_allow"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return filter_urls(pages, rule_table(pages.sparkSession, rules)).select("page_id", "host", "path", "rule", "verdict")


#: Without a link in the tables (`canonical` and `refresh` occur in no html of them) the aliases decide nothing.
ORACLE = """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM (
  SELECT page_id, host, path, arg_max({'rule': h || p, 'verdict': verdict}, length(h || p)) FILTER (h IS NOT NULL) AS best
  FROM (SELECT row_number() OVER () AS n, * FROM parts) LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY n, page_id, host, path
)
"""
