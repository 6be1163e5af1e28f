"""Whitening against plain integer sums and numpy's own eigenvectors, and on odd tables."""

import numpy as np
import pytest

from prospecta.llm import whitening
from prospecta.llm.queries import all_queries

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


@pytest.mark.parametrize("rows,dims,top", [(1, 1, 2), (70, 3, 200), (300, 5, 1 << 40), (5000, 4, 90), (9, 2, (1 << 63) - 1), (0, 3, 2)])
def test_cross_products(rows, dims, top, monkeypatch):
    monkeypatch.setattr(whitening, "PACKED", 1000)
    x = np.random.default_rng(1).integers(0, top, (rows, dims)).astype(np.uint64)
    found = np.zeros((dims + 1, dims + 1), object)
    for limb, matrix in whitening.cross_products(x).items():
        found += matrix.astype(object) << (whitening.LIMB * limb)
    wide = np.column_stack([np.ones(rows, object), x.astype(object)])
    assert (found == np.triu(wide.T @ wide if rows else np.zeros((dims + 1, dims + 1), object))).all()


def expected(vectors):
    """(n, deviations, whitened, explained) by plain numpy over Python integers."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in vector] for vector in vectors]
    distinct = np.array(sorted(set(map(tuple, x))), object)
    n, s = len(distinct), distinct.sum(axis=0)
    away = distinct * n - s
    values, axes = np.linalg.eigh((away.T @ away).astype(float) / n ** 3)
    order = np.argsort(-values)[:16]
    own = np.array(x, object) * n - s
    return n, (own ** 2).sum(axis=1), own.astype(float) / n @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def held(result, ids, vectors, rounding=1e-6):
    """``rounding`` is that of numpy's eigenvectors, which grows with the ratio of the eigenvalues."""
    n, deviations, whitened, explained = expected(vectors)
    found = {(row["vec_id"], row["component"]): row for row in result}
    assert len(found) == len(result) == whitened.size
    assert {row["n"] for row in result} == {n}
    assert len({row["identity_error"] for row in result}) == 1 and result[0]["identity_error"] < 1e-9
    for k in range(whitened.shape[1]):
        own = np.array([found[i, k + 1]["whitened"] for i in ids])
        sign = np.sign(own @ whitened[:, k])
        assert np.abs(own * sign - whitened[:, k]).max() < rounding
        assert abs(found[ids[0], k + 1]["explained"] / explained[k] - 1) < rounding
    assert [found[i, 1]["deviation"] for i in ids] == [int(d) if d < 1 << 63 else None for d in deviations]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    held(all_queries()["op13_whitening"](spark, folder).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_copies_and_odd_rows(spark):
    """A third of the rows one vector, others equal after rounding; dropped rows; large entries."""
    random = np.random.default_rng(2)
    vectors = [[1.0, 2.0, 3.0, 4.0]] * 100 + [list(np.float32(v)) for v in random.standard_normal((200, 4)) * [1, 5, 900, 1e6]]
    vectors += [[v[0] + 1e-9, *v[1:]] for v in vectors[:3]]
    rows = [(i, [float(c) for c in vector], 1, "x") for i, vector in enumerate(vectors)]
    odd = [(900, None, 1, "x"), (901, [1.0, None, 1.0, 1.0], 1, "x"), (902, [float("nan")] * 4, 1, "x"), (903, [float("-inf")] * 4, 1, "x"), (904, [], 1, "x")]
    table = spark.createDataFrame(rows + odd, SCHEMA).repartition(6)
    held(whitening.whitened(table).collect(), range(len(rows)), vectors, 1e-4)


def test_flat_and_other_lengths(spark):
    rows = [(1, [1.0, 1.0], 1, "x"), (1, [1.0, 1.0], 1, "x"), (None, [1.0, 3.0], 1, "x"), (3, [5.0], 1, "x"), (4, [1e30, 0.0, 0.0], 1, "x")]
    found = sorted((r["vec_id"] or 0, r["component"], r["n"], r["deviation"], r["whitened"] and abs(round(r["whitened"], 9)), r["explained"])
                   for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(0, 1, 2, 16384, 1.0, 1.0), (0, 2, 2, 16384, None, 0.0), *[(1, 1, 2, 16384, 1.0, 1.0)] * 2, *[(1, 2, 2, 16384, None, 0.0)] * 2,
                     (3, 1, 1, 0, None, 0.0), *[(4, k, 1, 0, None, 0.0) for k in (1, 2, 3)]]
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).collect() == []
