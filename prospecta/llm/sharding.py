"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from prospecta.session import materialise


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of the virtual nodes on the ring of signed 64-bit numbers, and the shard of each."""
    nodes = sorted(
        (int.from_bytes(hashlib.blake2b(f"{shard}:{copy}".encode(), digest_size=8).digest(), "big", signed=True), shard)
        for shard in range(shards) for copy in range(virtual_nodes)
    )
    return np.array([place for place, _ in nodes], np.int64), np.array([shard for _, shard in nodes], np.int64)


def allotted(loads: list[int], owners: np.ndarray, shards: int, slack: float) -> list[tuple[int, int, int]]:
    """(arc, load, shard): what each shard takes of each arc, in the order of the keys of the arc.

    ``loads[i]`` is the load between node i - 1 and node i; one more arc at the end leads round to node 0. An arc goes
    to the shard of its node; what a full shard can't take continues clockwise to the next node whose shard has
    room. All arcs are offered to their own shard first, then to the next node, and so on, so that overflowing keys never
    push out a key that is at home.
    """
    total = sum(loads)
    room = [-(-int(total * (1 + slack)) // shards) + 1] * shards
    left = [(arc, load) for arc, load in enumerate(loads) if load]
    taken: list[tuple[int, int, int]] = []
    step = 0
    while left:
        rest = []
        for arc, load in left:
            shard = int(owners[(arc + step) % len(owners)])
            take = min(load, room[shard])
            if take:
                room[shard] -= take
                taken.append((arc, take, shard))
            if take < load:
                rest.append((arc, load - take))
        left, step = rest, step + 1
    taken.sort(key=lambda part: part[0])  # stable: the parts of an arc stay in the order in which they were taken
    return taken


def place(
    df: DataFrame, keys: list[Column], size: Column, shards: int, virtual_nodes: int = 64, slack: float = 0.0005,
    order: list[Column] | None = None,
) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 within a shard) to every row.

    ``keys`` are hashed to a place on the ring; ``size`` is a row's load. A shard takes at most (1 + ``slack``) times the
    mean load plus one row. Rows of equal keys lie side by side on the ring, so they share a shard unless it fills up
    within them, however many they are. ``order`` breaks ties among them.

    Null keys are a key of their own; null sizes count 0; equal rows are interchangeable; an empty table gives an empty
    result; a very large row overfills its shard by its own size at most. Other columns pass through, whatever their names.

    The rows are range partitioned by place (hot keys are split by ``order``) and summed per partition; the driver sees
    one row per partition and at most shards * virtual_nodes + 1 loads, whatever the number of rows.
    """
    places, owners = ring(shards, virtual_nodes)
    names = df.columns
    ordered = df.select(
        *[F.col(f"`{name}`") for name in names],
        F.xxhash64(*keys).alias("__ring"), F.coalesce(size.cast("long"), F.lit(0)).alias("__size"))
    by = [F.col("__ring"), *(order or [])]
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load, rows = 0, 0
        for batch in batches:
            sizes = batch["__size"].to_numpy()
            batch["__arc"] = np.searchsorted(places, batch["__ring"].to_numpy(), "left")
            batch["__load"] = load + np.cumsum(sizes) - sizes
            batch["__row"] = rows + np.arange(len(batch))
            load, rows = load + int(sizes.sum()), rows + len(batch)
            yield batch

    schema = StructType([*ordered.schema.fields])
    for name in ("__arc", "__load", "__row"):
        schema = schema.add(name, LongType())
    saved = materialise(ordered.mapInPandas(summed, schema))

    parts = sorted(tuple(row) for row in saved.groupBy("__part").agg(F.sum("__size"), F.count("*")).collect())
    before_load = np.concatenate([[0], np.cumsum([part[1] for part in parts], dtype=np.int64)])
    before_rows = np.concatenate([[0], np.cumsum([part[2] for part in parts], dtype=np.int64)])
    ids = np.array([part[0] for part in parts], np.int64)
    loads = [0] * (len(places) + 1)
    for arc, load in saved.groupBy("__arc").agg(F.sum("__size")).collect():
        loads[arc] = load
    segments = allotted(loads, owners, shards, slack)
    cuts = np.concatenate([[0], np.cumsum([part[1] for part in segments], dtype=np.int64)])
    of_segment = np.array([part[2] for part in segments] or [0], np.int32)

    def sectioned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = np.searchsorted(ids, batch["__part"].to_numpy())
            start = before_load[part] + batch["__load"].to_numpy()
            middle = start + (batch["__size"].to_numpy() - 1) // 2  # a row on a cut goes where its middle lies
            segment = np.clip(np.searchsorted(cuts, middle, "right") - 1, 0, len(of_segment) - 1)
            batch["__segment"] = segment
            batch["__row"] += before_rows[part]
            yield batch.drop(columns=["__ring", "__size", "__part", "__arc", "__load"])

    kept = StructType([saved.schema[name] for name in names] + [schema["__row"]]).add("__segment", LongType())
    numbered = saved.mapInPandas(sectioned, kept)
    # Rows of a segment are consecutive, so its first row and its length number all its rows.
    first = np.zeros(len(of_segment), np.int64)
    base = np.zeros(len(of_segment), np.int64)
    filled = [0] * shards
    for segment, row, count in sorted(
            numbered.groupBy("__segment").agg(F.min("__row"), F.count("*")).collect()):
        shard = of_segment[segment]
        first[segment], base[segment] = row, filled[shard]
        filled[shard] += count

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            segment = batch["__segment"].to_numpy()
            batch["shard"] = of_segment[segment]
            batch["slot"] = batch["__row"].to_numpy() - first[segment] + base[segment]
            yield batch.drop(columns=["__row", "__segment"])

    result = StructType([saved.schema[name] for name in names]).add("shard", IntegerType()).add("slot", LongType())
    return numbered.mapInPandas(finished, result)


def documents_in_shards(documents: DataFrame, shards: int = 40) -> DataFrame:
    """Documents in shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 16. Equal texts lie side by side, and so does every null text; null doc_ids
    come first among equal texts. The law is ``bytes``, so grown_shard is null. Only three numbers of a document move, never
    its text. Extra columns are left out.
    """
    slim = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("__text"),
    )
    placed = place(slim, [F.col("__text")], F.col("size"), shards, order=[F.col("doc_id")])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
