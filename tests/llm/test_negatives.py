"""Hard negatives against brute force, on clustered, repeated, huge and odd vectors."""

import numpy as np
import pytest

from prospecta.llm import negatives
from prospecta.llm.queries import all_queries, all_sql
from tests.oracle import connect, differences

SCHEMA = "vec_id long, label int, embedding array<double>, window int, score string"


def brute(rows, every=50):
    """Plain Python integers, all pairs."""
    whole = [(i, label, [int(np.floor(256 * x)) for x in vector]) for i, label, vector in rows]
    out = set()
    for i, label, vector in whole:
        if i % every:
            continue
        others = sorted((-sum(a * b for a, b in zip(vector, other, strict=True)), j, own == label)
                        for j, own, other in whole if j != i and len(other) == len(vector))
        for p, positive, _ in [row for row in others if row[2]][:5]:
            fit = [(n, j) for n, j, same in others if not same and 50 * -p <= 100 * -n <= 95 * -p]
            out |= {(i, positive, rank, j, -p, -n) for rank, (n, j) in enumerate(fit[:3], 1)}
    return out


def mined(spark, rows, **options):
    table = spark.createDataFrame([(i, label, v and [x if x is None else float(x) for x in v], 1, "x") for i, label, v in rows], SCHEMA).repartition(5)
    return [tuple(row) for row in negatives.mine(table, **options).collect()]


def test_matches_brute_force(spark, monkeypatch):
    """Near and equal copies, ties, three lengths, scores beyond doubles; small trees, strips and passes."""
    random = np.random.default_rng(3)
    centres = random.standard_normal((6, 8))
    rows = [(i, int(random.integers(3)), list(centres[i % 6] + 0.01 * random.standard_normal(8) * (i % 4))) for i in range(500)]
    rows += [(1000 + i, i % 2, list(random.standard_normal(3))) for i in range(60)]
    rows += [(2000 + 10 * i, i % 2, [1e15 * x for x in random.standard_normal(8)]) for i in range(12)] + [(3000, 1, [])]
    for name, value in {"TREE": 7, "GROUP": 14, "STRIP": 50, "PASS_BYTES": 7 * 64 * 3}.items():
        monkeypatch.setattr(negatives, name, value)
    found = mined(spark, rows, every=10)
    expected = {row for row in brute(rows, 10) if max(row[4:]) <= negatives.MOST}
    assert len(found) == len(set(found)) and {row for row in found if row[4] < negatives.MOST} == expected


def test_bounds_spare_scores():
    """Near copies: most scores of the children follow from the parent's, and none that counts is lost."""
    random = np.random.default_rng(4)
    base = random.standard_normal((3, 32))
    anchors = np.floor(256 * (base[np.arange(90) % 3] + 0.002 * random.standard_normal((90, 32))))
    others = np.floor(256 * random.standard_normal((4000, 32)))
    parent, edge, level = negatives.spanning_tree(anchors)
    n = np.arange(90)
    best = negatives.Best(n, np.zeros(90), anchors, parent, edge, level, n, np.full(90, 1000), np.full(90, negatives.MOST), 3, False)
    best.show(1000 + np.arange(4000), np.ones(4000), others)
    assert best.computed < 0.3 * best.seen
    window, mate, score = best.found()
    for at in n:
        own = (others @ anchors[at]).astype(int)
        first = np.lexsort((np.arange(4000), -own))[:3]
        assert list(mate[window == at]) == list(1000 + first) and list(score[window == at]) == list(own[first])


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.7, 0.7]), (2, 2, [0.7, 0.7]), (3, None, [1.0, 1.0]), (4, 2, None),
            (5, 2, [0.7, None]), (6, 2, [0.7, float("nan")]), (7, 2, [float("inf"), 0.7]), (None, 2, [0.7, 0.7]), (50, 3, [9.0, 9.0]),
            (100, 1, [-1.0, -1.0]), (8, 2, [0.0, 0.0])]
    # 100 has positives of negative score alone, 50 none; 1 and 100 are positives of 0.
    assert mined(spark, rows) == [(0, 1, 1, 2, 2 * 256 * 256, 2 * 256 * 179)]
    assert mined(spark, []) == []


@pytest.mark.parametrize("name", ["op11_hard_negatives"])
def test_query(spark, name):
    folder = "/root/testdata/sf0.01"
    assert differences(all_queries()[name](spark, folder), connect(folder), all_sql()[name]) is None
