"""Whitening of vectors: exact cross-products from bit planes by AND and popcount, centred as integers, then eigenvectors."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.session import materialise

#: Rows whose bit planes are packed at a time: so many bits are 64 words of 64.
PACKED = 4096
#: Bits of a limb: products are summed in limbs of so many bits, so that no sum leaves a long.
LIMB = 24
#: Bytes of models that are broadcast at a time; vectors of further lengths take further passes.
MODEL_BYTES = 64 << 20


def above(vectors: pd.Series, dims: int, low: int) -> np.ndarray:
    """The vectors' entries less ``low``, as whole numbers from 0 on; no difference of two longs leaves this range."""
    x = np.stack(vectors.to_numpy()) if dims else np.zeros((len(vectors), 0), np.int64)
    return x.astype(np.uint64) - np.uint64(low % (1 << 64))


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dimension, bit, words) of every bit plane that is not empty, of (rows, dimensions) whole numbers from 0 on.

    A plane holds one bit of one dimension for all rows, 64 rows a word. Dimension -1 has a one for every row, so its
    products are the sums and the number of rows.
    """
    n, dims = shifted.shape
    width = int(shifted.max(initial=0)).bit_length()
    bits = np.zeros((1 + dims * width, -(-max(n, 1) // 64) * 64), np.uint8)
    bits[0, :n] = 1
    for bit in range(width):
        bits[1 + bit * dims: 1 + (bit + 1) * dims, :n] = ((shifted >> np.uint64(bit)) & np.uint64(1)).T
    words = np.packbits(bits, axis=1).view(np.uint64)
    dimension = np.concatenate([[-1], np.tile(np.arange(dims), width)])
    level = np.concatenate([[0], np.repeat(np.arange(width), dims)])
    full = words.any(axis=1)
    return dimension[full], level[full], words[full]


def cross_products(shifted: np.ndarray) -> dict[int, np.ndarray]:
    """limb -> matrix of whole numbers; sum of matrix * 2**(LIMB * limb) has the cross-products of the columns, a column
    of ones before them. Each is the sum over pairs of planes of 2**(bits) times the ones that the planes share."""
    size = shifted.shape[1] + 1
    out: dict[int, np.ndarray] = {}
    for start in range(0, len(shifted), PACKED):
        dimension, level, words = planes(shifted[start: start + PACKED])
        for i in range(len(words)):
            shared = np.bitwise_count(words[i:] & words[i]).sum(axis=1, dtype=np.int64)
            weight = level[i:] + level[i]
            shared <<= weight % LIMB
            for limb in np.unique(weight // LIMB):
                here = weight // LIMB == limb
                matrix = out.setdefault(int(limb), np.zeros((size, size), np.int64))
                a, b = dimension[i] + 1, dimension[i:][here] + 1
                np.add.at(matrix, (np.minimum(a, b), np.maximum(a, b)), shared[here])
                # A pair of planes of one dimension stands for both orders; a plane with itself for one.
                twice = here & (dimension[i:] == dimension[i])
                twice[0] = False
                np.add.at(matrix, (a, a), shared[twice].sum())
    return out


def _scattered(fit: DataFrame, low: int) -> DataFrame:
    """(_dims, i, j, limb, value) of the cross-products over the fit list, every entry less ``low``, the least of all."""
    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        rows = 0

        def emitted() -> Iterator[pd.DataFrame]:
            for (dims, limb), matrix in total.items():
                i, j = np.nonzero(matrix)
                yield pd.DataFrame({"_dims": dims, "i": i, "j": j, "limb": limb, "value": matrix[i, j]})
            total.clear()

        for batch in batches:
            for dims, part in batch.groupby("_dims"):
                for limb, matrix in cross_products(above(part["_x"], dims, low)).items():
                    key = (dims, limb)
                    total[key] = total[key] + matrix if key in total else matrix
            rows += len(batch)
            if rows > 1 << 25:  # 2**24 * 64 pairs of planes * 2**25 rows is the most that a long holds
                yield from emitted()
                rows = 0
        yield from emitted()

    return fit.mapInPandas(scatter, "_dims int, i int, j int, limb int, value long").groupBy("_dims", "i", "j", "limb").agg(
        F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))


def refined(covariance: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and axes within the span of ``axes``, by Jacobi rotations in extended precision.

    The rounding of ``eigh`` is as large for the least component as for the greatest; where they are many orders of
    magnitude apart, this is what keeps the small ones right.
    """
    axes = axes.astype(np.longdouble)
    small = axes.T @ covariance @ axes
    for _ in range(12):
        for i in range(len(small)):
            for j in range(i + 1, len(small)):
                if small[i, j] * small[i, j] <= np.longdouble(1e-34) * abs(small[i, i] * small[j, j]):
                    continue
                half = (small[j, j] - small[i, i]) / (2 * small[i, j])
                t = (1 if half >= 0 else -1) / (abs(half) + np.sqrt(half * half + 1))
                turn = np.array([[1, t], [-t, 1]]) / np.sqrt(t * t + 1)
                small[:, [i, j]] = small[:, [i, j]] @ turn
                small[[i, j]] = turn.T @ small[[i, j]]
                axes[:, [i, j]] = axes[:, [i, j]] @ turn
    return np.diag(small).astype(float), axes.astype(float)


def fitted(sums: pd.DataFrame, dims: int, low: int, count: int) -> dict:
    """The model of one length, from its cross-products: all of it whole numbers until the eigenvectors."""
    square = np.zeros((dims + 1, dims + 1), object)
    for i, j, limb, value in zip(sums["i"], sums["j"], sums["limb"], sums["value"], strict=True):
        square[i, j] += int(value) << (LIMB * int(limb))
    square = np.triu(square) + np.triu(square, 1).T
    n, s = int(square[0, 0]), square[0, 1:]
    centred = n * square[1:, 1:] - np.outer(s, s)  # n**2 times the covariance, exact, whatever is taken off all rows
    covariance = np.array([[int(v) / (n * n) for v in row] for row in centred], float).reshape(dims, dims)
    rest = [[int(v) - int(float(v)) for v in row] for row in centred]
    exact = (centred.astype(float).astype(np.longdouble) + np.array(rest, float).reshape(dims, dims)) / n / n
    trace = int(np.trace(centred)) / (n * n) if dims else 0.0
    kept = min(count, dims)
    values, axes = refined(exact, np.linalg.eigh(covariance)[1][:, ::-1][:, :kept])
    order = np.argsort(-values, kind="stable")
    values, axes = values[order], axes[:, order]
    # What rounding can't tell from zero has no deviation to divide by.
    flat = values <= float(np.finfo(np.longdouble).eps) * dims * max(trace, 0.0)
    scale = np.where(flat, np.nan, 1 / np.sqrt(np.where(flat, 1.0, values)))
    return {"n": n, "low": low, "sums": [int(v) for v in s], "axes": axes * scale,
            "explained": np.where(flat, 0.0, values / trace) if trace else np.zeros(kept)}


def _models(fit: DataFrame, low: int, count: int) -> DataFrame:
    """(_dims, model) by length, the model as bytes; no larger than a square of the length, whatever the number of rows."""
    def solved(part: pd.DataFrame) -> pd.DataFrame:
        dims = int(part["_dims"].iloc[0])
        return pd.DataFrame({"_dims": [dims], "_model": [pickle.dumps(fitted(part, dims, low, count))]})

    return materialise(_scattered(fit, low).groupBy("_dims").applyInPandas(solved, "_dims int, _model binary"))


def projected(vectors: pd.Series, model: dict) -> tuple[np.ndarray, list]:
    """(whitened, deviations): rows by components, and the exact sum of (n * x - sum)**2, None where a long can't hold it."""
    n, dims = model["n"], len(model["sums"])
    shifted = above(vectors, dims, model["low"])
    if dims and int(shifted.max(initial=0)) * n < 1 << 62:
        away = shifted.astype(np.int64) * n - np.array(model["sums"], np.int64)
    else:
        away = np.array([[int(v) * n - s for v, s in zip(row, model["sums"], strict=True)] for row in shifted],
                        object).reshape(len(shifted), dims)
    if away.dtype != object and float(np.abs(away).max(initial=0)) ** 2 * max(dims, 1) < 2.0 ** 62:
        deviations = [int(v) for v in np.square(away).sum(axis=1)]
    else:
        deviations = [total if (total := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in away]
    return (away.astype(float) / n) @ model["axes"], deviations


def whitened(
    embeddings: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000,
) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Each entry c becomes x = floor(scale * c) + offset; the fit list is each distinct x vector once, n of them with the sums
    S. Components are unit eigenvectors of the covariance of x over the fit list (divisor n), the first ``components`` by
    falling eigenvalue e (as many as there are dimensions, if fewer). ``whitened`` is x - S/n on the component, over
    sqrt(e); ``deviation`` the exact sum of (n * x - S)**2; ``explained`` e over the sum of all; ``identity_error`` the
    largest entry, measured over the fit list, of whitened's covariance less the identity.

    Vectors that are null or hold null or non-finite entries are dropped; an entry beyond a long counts as its end. A vec_id may be null
    or repeat: each row gets its rows. Vectors of another length are a space of their own, with their own fit list.
    Where a component has no deviation (equal vectors, fewer vectors than dimensions) whitened is null and explained 0, and
    identity_error leaves it out; it is null if none is left. A deviation that a long can't hold is null. Empty vectors
    have no component and so no row; an empty table gives an empty result. Extra columns are left out.

    Every task packs the bit planes of its own rows and adds up one matrix a length; those matrices, not rows, are
    shuffled. Equal vectors are folded before, copies in the task that reads them.
    """
    spark = embeddings.sparkSession
    parts = F.col("embedding")
    sound = parts.isNotNull() & ~F.exists(parts, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    least, most = float(-(1 << 62)), float(1 << 62)

    def whole(c):
        return (F.floor(F.greatest(F.lit(least), F.least(F.lit(most), c * scale))).cast("long") + F.lit(offset)).cast("long")

    rows = materialise(
        embeddings.filter(F.coalesce(sound, F.lit(False)))
        .select("vec_id", F.transform(parts.cast("array<double>"), whole).alias("_x"))
        .withColumn("_dims", F.size("_x")))
    fit = materialise(rows.groupBy("_x").agg(F.first("_dims").alias("_dims")))
    low = fit.agg(F.min(F.array_min("_x"))).first()[0] or 0
    lengths = [row["_dims"] for row in fit.select("_dims").distinct().collect()]  # one number a length
    models = _models(fit, low, components)

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = schema.replace("vec_id long", f"vec_id {rows.schema['vec_id'].dataType.simpleString()}")
    lots: list[list[int]] = [[]]
    room = MODEL_BYTES
    for dims in sorted(lengths):
        size = 8 * (components + 8) * (dims + 64)
        if size > room and lots[-1]:
            lots.append([])
            room = MODEL_BYTES
        lots[-1].append(dims)
        room -= size
    result = spark.createDataFrame([], schema)
    for lot in lots:
        part = _projected(rows, fit, models, lot, schema)
        result = result.union(part)
    return result


def _projected(rows: DataFrame, fit: DataFrame, models: DataFrame, lot: list[int], schema: str) -> DataFrame:
    """The result for the vectors of some lengths, whose models are broadcast (at most about ``MODEL_BYTES``)."""
    context = rows.sparkSession.sparkContext
    among = F.col("_dims").isin(lot) if lot else F.lit(False)
    known = {row["_dims"]: pickle.loads(row["_model"]) for row in models.filter(among).collect()}
    shared = context.broadcast(known)

    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, own in batch.groupby("_dims"):
                w = projected(own["_x"], shared.value[dims])[0]
                w = np.column_stack([np.ones(len(w)), w])
                total[dims] = total.get(dims, 0) + w.T @ w
        for dims, matrix in total.items():
            i, j = np.indices(matrix.shape)
            yield pd.DataFrame({"_dims": dims, "i": i.ravel(), "j": j.ravel(), "value": matrix.ravel()})

    measured = fit.filter(among).mapInPandas(squares, "_dims int, i int, j int, value double").groupBy("_dims", "i", "j").agg(
        F.sum("value").alias("value")).toPandas()  # a few hundred numbers a length
    for dims, own in measured.groupby("_dims"):
        size = int(own["i"].max()) + 1
        matrix = np.zeros((size, size))
        matrix[own["i"], own["j"]] = own["value"]
        matrix /= matrix[0, 0]
        error = np.abs(matrix[1:, 1:] - np.outer(matrix[0, 1:], matrix[0, 1:]) - np.eye(size - 1))
        known[dims]["error"] = float(np.nanmax(error)) if np.isfinite(error).any() else None
    shared = context.broadcast(known)

    def whiten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, own in batch.groupby("_dims"):
                model = shared.value[dims]
                w, deviations = projected(own["_x"], model)
                count = w.shape[1]
                yield pd.DataFrame({
                    "vec_id": own["vec_id"].repeat(count).to_numpy(), "component": np.tile(np.arange(1, count + 1), len(own)),
                    "n": model["n"], "deviation": pd.array(deviations, "Int64").repeat(count),
                    "whitened": w.ravel(), "explained": np.tile(model["explained"], len(own)),
                    "identity_error": model["error"]})

    return rows.filter(among).mapInPandas(whiten, schema)
