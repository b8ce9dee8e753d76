"""URL rules: host-suffix and path-prefix expressions, matched by short hash prefixes, then confirmed.

A rule is filed under its host and the longest part of its path that ends in a slash. A URL is
expanded into all such keys it could meet: every suffix of its host with every slash-ended prefix of
its path, no deeper than the deepest rule. Keys meet on the first 32 bits of their SHA-256; then the
full digest of what the rule says is compared with the digest of the same stretch of the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.llm.common import col, table
from kveil.session import cut_lineage

# Host, path and action of the rules.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DEFAULT_VERDICT = "allow"
RULE_SCHEMA = "host string, path string, action string"
SMALL_RULES = 10_000  # rule tables of up to so many rows are broadcast


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def slash_prefixes(path: Column, deepest: int) -> Column:
    """The slash-ended prefixes of a path with up to ``deepest`` slashes, and the empty one."""
    parts = F.slice(F.split(path, "/"), F.lit(1), F.least(F.size(F.split(path, "/")) - 1, F.lit(deepest)))
    ends = F.transform(parts, lambda p, i: F.concat(F.array_join(F.slice(parts, F.lit(1), i + 1), "/"), F.lit("/")))
    return F.concat(F.array(F.lit("")), ends)


def host_suffixes(host: Column, deepest: int) -> Column:
    """Suffixes of a host at label borders with up to ``deepest`` labels."""
    tail = F.slice(F.reverse(F.split(host, r"\.")), F.lit(1), F.lit(deepest))
    return F.transform(tail, lambda x, i: F.array_join(F.reverse(F.slice(tail, F.lit(1), i + 1)), "."))


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with the key they are filed under; of equal rules, block goes before allow."""
    host, path = ascii_lower(F.trim(F.coalesce("host", F.lit("")))), F.coalesce("path", F.lit(""))
    flat = rules.filter("host IS NOT NULL AND action IS NOT NULL").select(
        host.alias("rule_host"), path.alias("rule_path"), F.col("action")
    )
    flat = flat.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))
    key = F.regexp_extract("rule_path", r"^(?s:.*)/", 0)
    return flat.withColumns(
        {
            "short": F.substring(digest(F.col("rule_host"), key), 1, 8),
            "full": digest(F.col("rule_host"), F.col("rule_path")),
            "labels": F.size(F.split("rule_host", r"\.")),
            "slashes": F.size(F.split(key, "/")) - 1,
        }
    )


def url_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with columns host, path, rule and verdict.

    The longest fitting rule wins (host and path together), then the longer host. Every distinct
    URL is judged once and joined back, so repeated pages and null or repeated ids do no harm; a
    null URL, or one without ``://``, has an empty host and path. A URL that no rule fits has a null
    rule and the default verdict. An empty page or rule table is fine. Columns of ``pages`` named
    host, path, rule or verdict are replaced; columns of any other name stay.
    """
    filed = prepared(rules)
    size = filed.agg(
        F.count(F.lit(1)).alias("n"), F.max("labels").alias("labels"), F.max("slashes").alias("slashes")
    ).first()
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    urls = pages.select(col(url_col).alias("__url")).filter("__url IS NOT NULL").distinct()
    parts = urls.select("__url", host_of(F.col("__url")).alias("h"), path_of(F.col("__url")).alias("p"))
    suffixes = parts.withColumn("s", F.explode(host_suffixes(F.col("h"), size.labels or 1)))
    keys = suffixes.withColumn("k", F.explode(slash_prefixes(F.col("p"), size.slashes or 0)))
    keys = keys.withColumn("short", F.substring(digest(F.col("s"), F.col("k")), 1, 8))
    if size.n <= SMALL_RULES:
        filed = F.broadcast(filed)
    met = keys.join(filed, "short").withColumn("stretch", F.substring("p", F.lit(1), F.length("rule_path")))
    met = met.filter((F.col("s") == F.col("rule_host")) & (digest(F.col("s"), F.col("stretch")) == F.col("full")))
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("long"),
        F.length("rule_host").alias("host"),
        F.concat("rule_host", "rule_path").alias("rule"),
        "action",
    )
    best = met.groupBy("__url").agg(F.max(order).alias("b")).select("__url", "b.rule", "b.action")
    # a written table beside plain rows: Spark can split a URL, or null, that very many pages have
    best = cut_lineage(best)
    # in a struct the columns keep clear of the names used here
    rows = pages.select(F.struct(*(col(c) for c in pages.columns)).alias("row"), col(url_col).alias("__url"))
    found = rows.join(best, "__url", "left")
    return found.select(
        *(F.col("row")[c].alias(c) for c in own),
        host_of(F.col("__url")).alias("host"),
        path_of(F.col("__url")).alias("path"),
        F.col("rule"),
        F.coalesce("action", F.lit(DEFAULT_VERDICT)).alias("verdict"),
    )


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules(pages, spark.createDataFrame(list(RULES), RULE_SCHEMA))
    return judged.select("page_id", "host", "path", "rule", "verdict")
