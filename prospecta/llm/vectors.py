"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import connected_components
from prospecta.session import materialise

#: Cells are made for about so many vectors each, at most MOST_CELLS; larger cells are compared in blocks of so many.
CELL, MOST_CELLS = 4096, 1024
#: Cells are fitted to about so many vectors; all vectors are assigned and compared.
FITTED = 50_000
STRIP = 512


def cells(units: DataFrame, rows: int, dims: int, seed: int = 7) -> np.ndarray:
    """Centres of unit length, one row each, of the vectors (_rep, _unit)."""
    k = min(MOST_CELLS, -(-rows // CELL))
    if k < 2:
        return np.zeros((1, dims))
    share = F.pmod(F.xxhash64("_rep", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, FITTED / rows) * (1 << 30))
    points = units.filter(share).select(array_to_vector("_unit").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=6, distanceMeasure="cosine", initMode="random").fit(points)
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def compare(near: np.ndarray, ids: np.ndarray, labels: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of what ``near`` (rows by columns) links, given what is joined already (``labels``)."""
    edges = []
    for row in np.flatnonzero(near.any(axis=1)):
        linked = np.flatnonzero(near[row])
        found, first = np.unique(labels[linked], return_index=True)
        edges += [(ids[row], other[linked[at]]) for at in first]
        if len(found) > 1:
            labels[np.isin(labels, found[1:])] = found[0]
    return edges


def block_links(left: pd.DataFrame, right: pd.DataFrame, threshold: float, same: bool) -> pd.DataFrame:
    """(_rep, _links, _mate): what the vectors of two blocks (or of one with itself) add to each other's links, and edges
    that join all that is linked; not the pairs themselves."""
    x, y = np.stack(left["_unit"]), np.stack(right["_unit"])
    ids, other = left["_rep"].to_numpy(), right["_rep"].to_numpy()
    counts, own = right["_count"].to_numpy(float), left["_count"].to_numpy(float)
    rows, columns, edges = np.zeros(len(x)), np.zeros(len(y)), []
    labels = np.arange(len(y))
    for first in range(0, len(x), STRIP):
        near = x[first: first + STRIP] @ y.T >= threshold
        if same:
            near[np.arange(len(near)), first + np.arange(len(near))] = False
        if not near.any():
            continue
        rows[first: first + STRIP] = near @ counts
        if not same:
            columns += own[first: first + STRIP] @ near
        edges += compare(near, ids[first: first + STRIP], labels, other)
    parts = [(ids, rows), (other, columns)]
    out = pd.DataFrame({"_rep": np.concatenate([p[0] for p in parts]), "_links": np.concatenate([p[1] for p in parts])})
    out = out[out["_links"] > 0].assign(_mate=pd.NA)
    joined = pd.DataFrame(edges, columns=["_rep", "_mate"]).assign(_links=0)
    out = pd.concat([out, joined[["_rep", "_links", "_mate"]]]) if len(joined) else out
    return out.astype({"_rep": "int64", "_links": "int64", "_mate": "Int64"})


def _linked(classes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(_rep, _links, _mate) of the classes (_rep, _unit, _count) of one length.

    A vector is at home in the cell whose centre is nearest. If x is at home in i and y in j, then <y, c_i - c_j> <= 0;
    if they are linked, |x - y| <= sqrt(2 - 2 threshold); so <x, c_i - c_j> is at most that times
    |c_i - c_j|. Every x is also compared with all later cells that this bound allows: no pair is lost, and each is met once.
    """
    classes = materialise(classes)
    total = classes.count()
    centres = cells(classes, total, dims)
    reach = np.sqrt(2 - 2 * threshold) * np.linalg.norm(centres[:, None] - centres[None], axis=2) + 1e-9

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = np.stack(batch["_unit"]) @ centres.T
                home = near.argmax(axis=1)
                ahead = near[np.arange(len(home)), home][:, None] - near <= reach[home]
                ahead &= np.arange(len(centres)) > home[:, None]
                batch["_home"] = home.astype(np.int32)
                batch["_visits"] = [np.flatnonzero(row).astype(np.int32) for row in ahead]
                yield batch

    schema = "_rep long, _unit array<double>, _count long, _home int, _visits array<int>"
    housed = materialise(classes.mapInPandas(assigned, schema))
    targets = dict(housed.groupBy("_home").count().collect())
    guests = dict(housed.select(F.explode("_visits").alias("v")).groupBy("v").count().collect())
    # Blocks per cell, of its own vectors and of its visitors; at most MOST_CELLS entries each.
    sizes = housed.sparkSession.createDataFrame(
        [(cell, -(-targets[cell] // CELL), -(-guests.get(cell, 0) // CELL)) for cell in sorted(targets)] or [(0, 1, 0)],
        "_cell int, _own int, _guests int")
    lot = F.xxhash64("_rep")
    vector = ["_rep", "_unit", "_count"]
    own = housed.select(*vector, F.col("_home").alias("_cell")).join(F.broadcast(sizes), "_cell").withColumn(
        "_block", F.pmod(lot, F.col("_own")).cast("int"))
    visiting = housed.select(*vector, F.explode("_visits").alias("_cell")).join(F.broadcast(sizes), "_cell").withColumn(
        "_block", F.pmod(lot, F.col("_guests")).cast("int"))
    task = ["_cell", "_block", "_with"]
    # Own blocks meet the blocks of guests (_with >= 0) and each other (_with < 0), each pair of blocks once.
    right = own.withColumn("_with", F.explode(F.expr(
        "concat(if(_guests > 0, sequence(0, _guests - 1), array()), transform(sequence(_block, _own - 1), b -> -1 - b))")))
    left = visiting.withColumn("_with", F.col("_block")).withColumn("_block", F.explode(F.expr("sequence(0, _own - 1)"))).select(
        *task, *vector).union(
        own.withColumn("_with", -1 - F.col("_block")).withColumn("_block", F.explode(F.expr("sequence(0, _block)"))).select(
            *task, *vector))

    def links(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_rep": pd.Series(dtype="int64"), "_links": pd.Series(dtype="int64"),
                                 "_mate": pd.Series(dtype="Int64")})
        # A block with itself: both sides hold the same rows, in the same order.
        same = key[2] < 0 and key[1] == -1 - key[2]
        return block_links(a.sort_values("_rep"), b.sort_values("_rep"), threshold, same)

    def fresh(side: DataFrame):  # both sides come from one table; new names keep their columns apart
        return side.select(*[F.col(name).alias(name) for name in [*task, *vector]]).groupBy(*task)

    return fresh(left).cogroup(fresh(right)).applyInPandas(
        links, "_rep long, _links long, _mate long")


def near_vectors(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per vector: vec_id, n_links (long), component_id (long), kept (boolean).

    Two vectors are linked if their cosine, in double precision, is at least ``threshold``. A component is what links
    connect, named by its smallest vec_id, which is kept. Vectors that are null, zero or empty, or hold a null or non-finite
    component, are linked with nothing; so are vectors of different lengths, and rows with a null vec_id, whose
    component is null and which are kept. Rows of one vec_id are one node with all its links. Extra columns are left out, an
    empty table gives an empty result.

    Equal vectors are one class from the start, which counts as many links as it has rows; a block of a cell reports
    numbers of links and a spanning forest instead of pairs. So a large group costs its size in rows, not its square.
    """
    parts = F.col("embedding")
    sound = (
        parts.isNotNull() & (F.size(parts) > 0)
        & ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(parts, lambda x: x != 0))
    wide = parts.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda total, x: total + x * x))
    rows = materialise(embeddings.select(
        "vec_id", (F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()).alias("_sound"),
        F.transform(wide, lambda x: x + 0.0).alias("_wide"), norm.alias("_norm")).select(
        "vec_id", "_sound", F.xxhash64("_wide").alias("_h1"), F.xxhash64(F.lit(1), F.col("_wide")).alias("_h2"),
        F.size("_wide").alias("_dims"), F.when(F.col("_sound"), F.transform("_wide", lambda x: x / F.col("_norm"))).alias("_unit")))
    key = ["_h1", "_h2", "_dims"]
    classes = materialise(rows.filter("_sound").groupBy(*key).agg(
        F.min("vec_id").alias("_rep"), F.count("*").alias("_count"), F.min("_unit").alias("_unit")))
    lengths = [row["_dims"] for row in classes.select("_dims").distinct().limit(65).collect()]
    if len(lengths) > 64:
        raise ValueError("vectors of more than 64 lengths")
    found = None
    for dims in sorted(lengths):
        part = _linked(classes.filter(F.col("_dims") == dims).select("_rep", "_unit", "_count"), dims, threshold)
        found = part if found is None else found.union(part)
    none = F.lit(None).cast("long")
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = materialise(found)
    links = found.groupBy("_rep").agg(F.sum("_links").alias("_links"))
    components = connected_components(found.filter("_mate is not null").select(F.col("_rep").alias("a"), F.col("_mate").alias("b")))
    named = (
        classes.join(links, "_rep", "left").join(components, F.col("_rep") == F.col("node"), "left")
        .select(*key, (F.coalesce("_links", F.lit(0)) + F.col("_count") - 1).alias("_links"),
                F.coalesce("component", "_rep").alias("_component"))
    )
    component = F.when(F.col("vec_id").isNull(), none).otherwise(F.coalesce("_component", "vec_id"))
    return (
        rows.withColumn("_h1", F.when(F.col("_sound"), F.col("_h1"))).join(named, key, "left")
        .select("vec_id", F.coalesce("_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    )
