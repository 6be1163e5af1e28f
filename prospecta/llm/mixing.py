"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many sources, their rates (one short row each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(
    sizes: list[tuple[str | None, int]], weights: tuple[int, ...], share: float, most: float,
) -> list[tuple[str | None, int, float]]:
    """(source, size, target): ``share`` of all words dealt by weight, no source above ``most`` times its own size.

    Sources are taken by code point, null last, and weigh ``weights``, repeating. What a source can't take is dealt
    again among the others until none is above; a source without words has target 0. If ``share`` is above ``most``, all
    stop at their limit.
    """
    ordered = sorted(sizes, key=lambda row: (row[0] is None, (row[0] or "").encode("utf-8")))
    weight = {i: weights[i % len(weights)] for i in range(len(ordered))}
    limit = [most * size for _, size in ordered]
    target = [0.0] * len(ordered)
    free = set(weight)
    words = share * sum(size for _, size in ordered)
    while free:
        unit = words / sum(weight[i] for i in free)
        above = {i for i in free if weight[i] * unit > limit[i]}
        if not above:
            for i in free:
                target[i] = weight[i] * unit
            break
        for i in above:
            target[i] = limit[i]
            words -= limit[i]
        free -= above
    return [(source, size, target[i]) for i, (source, size) in enumerate(ordered)]


def mix(
    documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0,
) -> DataFrame:
    """All rows and columns of the documents with __size, __source_size, __target and __copies.

    Words are summed per source (folded before the shuffle, so a hot source costs a row per task); a source's rate is
    its target over its size. A document is taken floor(rate) times, and once more if a hash of ``seed`` and its doc_id,
    read as a number from 0 to 1, is below the fraction. So reruns agree, rows of one doc_id are treated
    alike, and rows with a null doc_id share one draw. Null and empty texts have no words; a null source is a source; an
    empty table gives an empty result; a source without words has rate 0.

    The driver sees one row per source.
    """
    sized = documents.withColumn(
        "__size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    totals = sized.groupBy("source").agg(F.sum("__size").alias("size")).collect()
    targets = source_targets([(row["source"], row["size"]) for row in totals], weights, share, most)
    rates = documents.sparkSession.createDataFrame(
        targets, "__source string, __source_size long, __target double")
    if len(targets) <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 8), 16, 10)
    fraction = drawn.cast("double") / F.lit(float(1 << 32))
    return (
        sized.join(rates, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        .withColumn("__copies", (F.floor(rate) + (fraction < rate - F.floor(rate)).cast("int")).cast("int"))
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted)."""
    return mix(documents.select("doc_id", "text", "source")).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.round("__target", 4).alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def emitted(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns that the documents had."""
    taken = mix(documents, **options)
    copies = F.explode(F.expr("sequence(1, __copies)"))
    return taken.filter("__copies > 0").select(
        *[F.col(f"`{name}`") for name in documents.columns], copies.alias("__copy")).drop("__copy")
