"""Hard negatives: scores at a parent anchor bound those at its children in a spanning tree; only what may matter is rescored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospecta.operators.ranking import with_positions
from prospecta.session import materialise

#: Anchors of a spanning tree; anchors whose scores are held at a time; candidates that are scored at a time.
TREE, GROUP, STRIP = 256, 2048, 1024
#: Bytes of anchors that one pass over the candidates broadcasts; more anchors take more passes.
PASS_BYTES = 8 << 20
#: Integers up to here are exact as doubles.
EXACT = float(1 << 53)
#: Where a bound leaves at least this share of the candidates, the whole row is computed as a matrix product.
DENSE = 0.2

#: The ends of a score; one below the least marks a free place.
LEAST, MOST = -(1 << 63) + 2, (1 << 63) - 2


def components(vectors: pd.Series, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as doubles without a fraction."""
    wide = np.stack(vectors.to_numpy()).astype(np.float64) if dims else np.zeros((len(vectors), 0))
    return np.floor(scale * wide)


def locality(vectors: np.ndarray) -> np.ndarray:
    """A number per vector; the signs of 32 fixed random projections, so that near vectors mostly come next to each other.

    Vectors with entries too large for exact doubles come last.
    """
    planes = np.random.default_rng(vectors.shape[1]).standard_normal((vectors.shape[1], 32))
    large = np.abs(vectors).max(axis=1, initial=0) >= 1 << 20
    signs = (np.where(large[:, None], 0, vectors) @ planes >= 0).astype(np.int64)
    return np.where(large, np.int64(1) << 40, signs @ (np.int64(1) << np.arange(31, -1, -1, dtype=np.int64)))


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, edge, level) by row: the tree of least total distance, grown from row 0 (parent -1)."""
    n = len(vectors)
    squares = np.square(vectors).sum(axis=1)
    parent, edge, level = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
    near, nearest, todo = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    new = 0
    for _ in range(n - 1):
        todo[new] = False
        distance = np.maximum(squares + squares[new] - 2 * (vectors @ vectors[new]), 0)
        closer = todo & (distance < near)
        near[closer], nearest[closer] = distance[closer], new
        near[new] = np.inf
        new = int(np.where(todo, near, np.inf).argmin())
        parent[new] = nearest[new]
        level[new] = level[parent[new]] + 1
    kids = parent >= 0
    edge[kids] = np.sqrt(np.square(vectors[kids] - vectors[parent[kids]]).sum(axis=1))
    return parent, edge, level


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers too large for doubles, exact, held at the ends of long."""
    own, others = ([[int(x) for x in row] for row in side] for side in (anchors, candidates))
    found = [[sum(a * b for a, b in zip(x, y, strict=True)) for y in others] for x in own]
    return np.array([[min(max(score, LEAST), MOST) for score in row] for row in found], np.int64).reshape(len(own), len(others))


class Best:
    """The first ``k`` candidates of every window, a score range of one anchor, over all the candidates it is shown.

    ``owner``, ``low`` and ``high`` give each window's anchor (row of ``vectors``) and its range, both ends included;
    ``same`` tells whether candidates must have the anchor's label or must not.
    """

    def __init__(self, ids, labels, vectors, parent, edge, level, owner, low, high, k: int, same: bool):
        self.ids, self.labels, self.vectors, self.k, self.same = ids, labels, vectors, k, same
        self.owner, self.low, self.high = owner, low, high
        self.levels = [(at, parent[at], edge[at]) for at in (np.flatnonzero(level == n) for n in range(int(level.max(initial=0)) + 1))]
        self.largest = np.abs(vectors).max(initial=0.0)
        self.score = np.full((len(owner), k), LEAST - 1, np.int64)
        self.mate = np.full((len(owner), k), MOST, np.int64)
        self.order = np.argsort(owner, kind="stable")
        self.first = np.searchsorted(owner[self.order], np.arange(len(ids) + 1))
        self.seen = self.computed = 0
        self.narrow()

    def narrow(self) -> None:
        """Raises the lower ends to the last place that is held, and takes the hull of each anchor's windows."""
        full = self.score[:, -1] >= self.low
        self.least = np.where(full, self.score[:, -1], self.low)
        self.hull_low, self.hull_high = np.full(len(self.ids), MOST), np.full(len(self.ids), LEAST)
        np.minimum.at(self.hull_low, self.owner, self.least)
        np.maximum.at(self.hull_high, self.owner, self.high)

    def show(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        reach = np.abs(vectors).max(axis=1, initial=0.0) * max(self.largest, 1.0) * max(vectors.shape[1], 1)
        plain = np.flatnonzero(reach < EXACT)
        for start in range(0, len(plain), STRIP):
            part = plain[start: start + STRIP]
            self.take(*self.bounded(vectors[part]), ids[part], labels[part])
        large = np.flatnonzero(reach >= EXACT)
        for start in range(0, len(large), STRIP):
            part = large[start: start + STRIP]
            found = scores(self.vectors, vectors[part])
            hit = (found >= self.hull_low[:, None]) & (found <= self.hull_high[:, None])
            row, column = np.nonzero(hit)
            self.take(row, column, found[row, column], ids[part], labels[part])

    def bounded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, candidate, score) of every score in its anchor's hull.

        ``low`` and ``high`` enclose each score. They are equal where it was computed; elsewhere they follow from the
        parent's by the edge times the candidate's norm, and lie outside the hull.
        """
        norms = np.sqrt(np.square(vectors).sum(axis=1)) * (1 + 1e-9)
        least, most = self.hull_low.astype(np.float64), self.hull_high.astype(np.float64)
        low, high = np.empty((len(self.ids), len(vectors))), np.empty((len(self.ids), len(vectors)))
        for at, parent, edge in self.levels:
            if parent[0] < 0:
                low[at] = high[at] = self.vectors[at] @ vectors.T
                self.computed += len(at) * len(vectors)
                continue
            width = edge[:, None] * norms[None, :]
            under, over = low[parent] - width, high[parent] + width
            need = (over >= least[at, None]) & (under <= most[at, None])
            if len(at) and (dense := need.mean(axis=1) >= DENSE).any():
                under[dense] = over[dense] = self.vectors[at[dense]] @ vectors.T
                self.computed += int(dense.sum()) * len(vectors)
                need[dense] = False
            row, column = np.nonzero(need)
            for start in range(0, len(row), 1 << 16):
                r, c = row[start: start + (1 << 16)], column[start: start + (1 << 16)]
                under[r, c] = over[r, c] = np.einsum("ij,ij->i", self.vectors[at[r]], vectors[c])
            self.computed += len(row)
            low[at], high[at] = under, over
        self.seen += low.size
        row, column = np.nonzero((low == high) & (low >= least[:, None]) & (low <= most[:, None]))
        return row, column, low[row, column].astype(np.int64)

    def take(self, row, column, score, ids, labels) -> None:
        """Merges the scores that fit into the places of their windows."""
        fits = ((self.labels[row] == labels[column]) == self.same) & (self.ids[row] != ids[column])
        row, score, mate = row[fits], score[fits], ids[column[fits]]
        many = self.first[row + 1] - self.first[row]
        entry = np.repeat(np.arange(len(row)), many)
        window = self.order[self.first[row][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)]
        score, mate = score[entry], mate[entry]
        fits = (score >= self.least[window]) & (score <= self.high[window])
        window, score, mate = window[fits], score[fits], mate[fits]
        if not len(window):
            return
        touched = np.unique(window)
        window = np.concatenate([window, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.score[touched].ravel()])
        mate = np.concatenate([mate, self.mate[touched].ravel()])
        best = np.lexsort((mate, -score, window))
        window, score, mate = window[best], score[best], mate[best]
        place = np.arange(len(window)) - np.searchsorted(window, window)
        keep = place < self.k
        self.score[window[keep], place[keep]] = score[keep]
        self.mate[window[keep], place[keep]] = mate[keep]
        self.narrow()

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, candidate id, score) of all places that are taken."""
        window, place = np.nonzero(self.score >= np.maximum(self.low, LEAST)[:, None])
        return window, self.mate[window, place], self.score[window, place]


def planted(rows: DataFrame, every: int, scale: int) -> DataFrame:
    """The anchors (vec_id a multiple of ``every``) with their place in a tree of at most ``TREE`` neighbours.

    _tree, _row, _parent, _edge and _level beside the columns of ``rows``. Trees are pieces of one order by locality.
    """
    schema = "vec_id long, label string, vector array<double>, _dims int"

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, part in batch.groupby("_dims"):
                yield part.assign(_code=locality(components(part["vector"], dims, scale)))

    def tree(part: pd.DataFrame) -> pd.DataFrame:
        grown = []
        for dims, own in part.sort_values("_position").groupby("_dims"):
            parent, edge, level = spanning_tree(components(own["vector"], dims, scale))
            grown.append(own.assign(_parent=parent, _edge=edge, _level=level, _row=np.arange(len(own))))
        return pd.concat(grown).drop(columns=["_position", "_code"])

    anchors = rows.filter(F.col("vec_id") % every == 0).mapInPandas(coded, schema + ", _code long")
    placed = with_positions(anchors, [F.col("_dims"), F.col("_code"), F.col("vec_id")], "_position")
    return placed.withColumn("_tree", F.floor((F.col("_position") - 1) / TREE)).groupBy("_tree").applyInPandas(
        tree, schema + ", _tree long, _parent long, _edge double, _level long, _row long")


def forest(anchors: pd.DataFrame, windows: pd.DataFrame, scale: int) -> list[tuple]:
    """Per length of vector and group of trees: what ``Best`` needs, with the windows' numbers and the names of the labels."""
    made = []
    for dims, own in anchors.groupby("_dims"):
        trees = sorted(own["_tree"].unique())
        step = max(1, GROUP // TREE)
        for start in range(0, len(trees), step):
            part = own[own["_tree"].isin(trees[start: start + step])].sort_values(["_tree", "_row"]).reset_index(drop=True)
            root = part.groupby("_tree")["_row"].transform("size").groupby(part["_tree"]).first()
            begin = part["_tree"].map((root.cumsum() - root)).to_numpy()
            parent = np.where(part["_parent"] < 0, -1, part["_parent"] + begin)
            names, labels = np.unique(part["label"].to_numpy(str), return_inverse=True)
            mine = windows[windows["vec_id"].isin(part["vec_id"])]
            owner = pd.Series(part.index, index=part["vec_id"]).reindex(mine["vec_id"]).to_numpy()
            made.append((int(dims), names, mine["window"].to_numpy(), (
                part["vec_id"].to_numpy(), labels, components(part["vector"], dims, scale), parent,
                part["_edge"].to_numpy(), part["_level"].to_numpy(), owner, mine["low"].to_numpy(np.int64),
                mine["high"].to_numpy(np.int64))))
    return made


def searched(rows: DataFrame, anchors: pd.DataFrame, windows: pd.DataFrame, k: int, same: bool, scale: int) -> DataFrame:
    """(window, vec_id, score, rank): the first ``k`` rows of every window, higher scores first, then smaller ids.

    Every task keeps its own first ``k`` of each window; a window function merges them.
    """
    context = rows.sparkSession.sparkContext
    known = context.broadcast(forest(anchors, windows, scale))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = [(dims, names, numbers, Best(*parts, k, same)) for dims, names, numbers, parts in known.value]
        for batch in batches:
            for dims, part in batch.groupby("_dims"):
                vectors = components(part["vector"], dims, scale)
                ids, own = part["vec_id"].to_numpy(), part["label"].to_numpy(str)
                for length, names, _, best in groups:
                    if length == dims:
                        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                        best.show(ids, np.where(names[at] == own, at, -1), vectors)
        for _, _, numbers, best in groups:
            window, mate, score = best.found()
            yield pd.DataFrame({"window": numbers[window], "vec_id": mate, "score": score})

    order = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    found = materialise(
        rows.mapInPandas(scan, "window long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    known.destroy()
    return found


def mine(
    rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, scale: int = 256,
) -> DataFrame:
    """Hard negatives of (vec_id, label, embedding): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x); a score is the whole inner product with the anchor, and higher scores come
    first, then smaller ids. Anchors are the rows whose vec_id is a multiple of ``every``; their positives are the first rows of
    the same label, and for each positive the negatives are the first rows of another label with
    50 * positive_score <= 100 * negative_score <= 95 * positive_score.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Of rows that share a
    vec_id the one with the smallest label, then vector, takes part. Vectors of different lengths have no score. Scores beyond
    a long count as its ends. An anchor without positives, and a positive without negatives (so one with a negative score), give no
    row; an empty table gives an empty result. Extra columns are left out.

    Anchors are planted in trees of ``TREE`` and broadcast a few megabytes at a time, so neither the driver nor a task
    holds more of them; each lot takes two passes over the candidates, which stay where they are. A task keeps the first few
    rows of each window alone, so a label or a group of copies of any size weighs no more than its rows.
    """
    parts = F.col("embedding")
    sound = parts.isNotNull() & ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = materialise(
        rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(
            F.col("label").cast("string").alias("label"), parts.cast("array<double>").alias("vector")).alias("_row"))
        .groupBy("vec_id").agg(F.min("_row").alias("_row"))
        .select("vec_id", "_row.label", "_row.vector", F.size("_row.vector").alias("_dims")))
    anchors = materialise(planted(rows, every, scale))
    trees, dims = anchors.agg(F.max("_tree"), F.max("_dims")).first()
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    result = rows.sparkSession.createDataFrame([], schema)
    step = max(1, PASS_BYTES // (8 * max(dims or 1, 1) * TREE))
    for start in range(0, 0 if trees is None else trees + 1, step):
        lot = anchors.filter(F.col("_tree").between(start, start + step - 1)).toPandas()  # at most PASS_BYTES of vectors
        whole = pd.DataFrame({"window": lot["vec_id"], "vec_id": lot["vec_id"], "low": LEAST, "high": MOST})
        near = searched(rows, lot, whole, positives, True, scale).filter("score >= 0")
        # 50 p <= 100 n <= 95 p, in whole numbers and without leaving long.
        p = F.col("score")
        ranges = near.select(
            F.col("window").alias("anchor_id"), F.col("vec_id").alias("positive_id"), p.alias("positive_score"),
            F.expr("score div 2 + score % 2").alias("low"),
            F.expr("score - score div 20 - if(score % 20 > 0, 1, 0)").alias("high")).filter("low <= high").toPandas()
        ranges["window"] = np.arange(len(ranges))
        asked = ranges.rename(columns={"anchor_id": "vec_id"})[["window", "vec_id", "low", "high"]]
        found = searched(rows, lot, asked, negatives, False, scale)
        named = rows.sparkSession.createDataFrame(
            ranges[["window", "anchor_id", "positive_id", "positive_score"]],
            "window long, anchor_id long, positive_id long, positive_score long")
        result = result.union(found.join(F.broadcast(named), "window").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")))
    return result


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The query's rows: where vec_id is divisible by 7, label first becomes (label + 1) % 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", label.alias("label"), "embedding"))
