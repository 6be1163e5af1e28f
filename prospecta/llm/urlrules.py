"""URL filters: host-suffix and path-prefix expressions against rules, by hash prefixes and full digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict): the rules of the registered query.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

#: Hex digits of the digest that are joined first; eight are 32 bits.
PREFIX = 8

#: Up to so many rules, the prefixes are broadcast (under 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_RULES = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path: after the first ``://``, up to ``/``, ``?``, ``#`` or the end; then up to ``?``, ``#`` or the end.

    A null url, or one without ``://``, has both empty.
    """
    begin = F.expr("locate('://', url)")
    rest = F.when(begin > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    with_host = pages.withColumn("__rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("__rest", r"^[^/?#]*", 0)
    return with_host.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn(
        "path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)).drop("__rest")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """Per page: page_id, host, path, rule (the one that decides, else null) and verdict (its verdict, else ``default``).

    A rule fits its host and every subdomain if the path starts with the rule's. Each page's host is expanded into all
    its label suffixes and its path into the prefixes as long as some rule's path. The digests of the expressions are joined
    on a short prefix, then compared in full; of the rules that fit, the longest decides, of equally long ones that with the
    longer host. Every row is judged by itself, so a page_id may be null or repeat, and equal rows get equal verdicts. A null
    url has empty host and path and gets ``default``; long urls are judged whole, by labels times distinct rule path
    lengths expressions; an empty table or no rules give an empty result or ``default``. Extra columns are left out.

    The expressions of a page are folded in its own task before the shuffle, so hot hosts and paths don't meet in one.
    """
    if not rules:
        return url_parts(pages.select("page_id", "url")).select(
            "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = sorted({len(path) for _, path, _ in rules})
    digest = F.sha2(F.concat_ws("\n", F.col("__suffix"), F.col("__prefix")), 256)
    table = (
        pages.sparkSession.createDataFrame(rules, "__suffix string, __prefix string, __verdict string")
        .withColumn("__full", digest).select(
            F.substring("__full", 1, PREFIX).alias("__short"), F.col("__full").alias("__rule_full"),
            F.concat("__suffix", "__prefix").alias("__rule"), F.length("__suffix").alias("__host_length"), "__verdict")
    )
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)

    parts = url_parts(pages.select("page_id", "url")).drop("url")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    prefixes = F.array_distinct(F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n)))
    expressions = parts.withColumn("__row", F.monotonically_increasing_id())
    # Each page carries its expressions to the rules and folds what fits at once, within its own task.
    fits = (
        expressions
        .withColumn("__suffix", F.explode_outer(suffixes))
        .withColumn("__prefix", F.explode_outer(prefixes))
        .withColumn("__full", digest)
        .withColumn("__short", F.substring("__full", 1, PREFIX))
        .join(table, "__short", "left")
    )
    confirmed = F.col("__full") == F.col("__rule_full")
    best = F.max(F.when(confirmed, F.struct(
        F.length("__rule").alias("length"), F.col("__host_length"), F.col("__rule"), F.col("__verdict"))))
    return fits.groupBy("__row", "page_id", "host", "path").agg(best.alias("__best")).select(
        "page_id", "host", "path", F.col("__best.__rule").alias("rule"),
        F.coalesce("__best.__verdict", F.lit(default)).alias("verdict"))
