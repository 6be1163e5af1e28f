"""Helpers that several operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.session import materialise

#: Rows of the broadcast table of hash buckets; at eight bytes each, its size is bounded by this alone.
BUCKETS = 1 << 20


def in_buckets(rows: DataFrame, key: str, of: DataFrame, of_key: str | None = None) -> DataFrame:
    """The rows whose key falls in a hash bucket that a key of ``of`` falls in.

    A cheap first sieve before an exact join: it loses no match, and at most ``BUCKETS`` rows are broadcast.
    """
    buckets = of.select(F.pmod(F.xxhash64(of_key or key), F.lit(BUCKETS)).alias("_bucket")).distinct()
    sieved = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    # The bound is on this side, so the table is never larger, whatever the number of keys.
    return sieved.join(F.broadcast(buckets), "_bucket", "left_semi").drop("_bucket")


def shared_keys(rows: DataFrame, key: str, member: str) -> DataFrame:
    """The rows whose key also occurs with another member.

    Keys are folded to their least and largest member before the shuffle, so that a hot key costs one row per task.
    """
    live = materialise(
        rows.groupBy(key).agg(F.min(member).alias("_least"), F.max(member).alias("_most"))
        .filter("_least <> _most").select(key)
    )
    return in_buckets(rows, key, live).join(live, key, "left_semi")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Alternates the large-star and the small-star step until the edges stop changing. Each round is a few
    aggregates and joins, written to the shared folder, so a lost executor repeats no earlier round.
    """
    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def pointed(pairs: DataFrame, keep: str) -> DataFrame:
        least = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("_least"))
        return pairs.filter(keep).join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b"))

    table = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = state(table)
    while seen[0]:
        both = table.union(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialise(pointed(both, "b > a").filter("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("_least"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
        table = materialise(
            small.union(least.select("a", F.col("_least").alias("b"))).filter("a <> b").distinct())
        now = state(table)
        if now == seen:
            break
        seen = now
    roots = table.select(F.col("b").alias("node")).distinct()
    return table.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and the n + 1 places where they begin; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[places[0]: places[-1]], places - places[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
