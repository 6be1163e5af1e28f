import math
from threading import Barrier

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from prospecta.learn import evaluate, importance, resample, split, train
from prospecta.learn.features import balanced_weight, positive_weight
from prospecta.learn import neighbours
from prospecta.learn.neighbours import leaf_of, nearest_neighbours, split_tree
from prospecta.session import materialise_by_rows
from prospecta.workload import learning


def outcomes(spark, tp, fp, fn, tn):
    rows = spark.createDataFrame([(1, 0.9, tp), (0, 0.9, fp), (1, 0.1, fn), (0, 0.1, tn)], "target int, probability double, n int")
    return rows.select("target", "probability", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))).alias("i"), "n").filter("i <= n")


@pytest.mark.parametrize("counts, published", [
    ((574, 737, 484, 7248), (0.8649784363596151, 0.43783371472158655, 0.5425330812854442, 0.48459265512874633)),
    ((1013, 6399, 45, 1586), (0.2874046223598363, 0.13667026443604965, 0.9574669187145558, 0.23919716646989375)),
])
def test_published_metrics(spark, counts, published):
    row = evaluate.metrics(outcomes(spark, *counts), 0.6).first()
    assert [row[n] for n in ("accuracy", "precision", "recall", "f1")] == pytest.approx(published, abs=1e-12)
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == counts


def test_metrics_without_positives_are_zero(spark):
    row = evaluate.metrics(outcomes(spark, 0, 0, 0, 5)).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)
    report = {r["class"]: r for r in evaluate.classification_report(
        evaluate.confusion(outcomes(spark, 0, 0, 0, 5), evaluate.at_threshold("probability", 0.6))).collect()}
    assert report["Subscription"]["support"] == 0 and report["weighted avg"]["recall"] == 1.0


@pytest.mark.parametrize("bounded", [True, False])
def test_auc_against_pairs(spark, bounded):
    rng = np.random.default_rng(3)
    rows = [(int(a), float(b)) for a, b in zip(rng.integers(0, 2, 400), np.round(rng.random(400), 2))]
    df = spark.createDataFrame(rows, "target int, probability double")
    positives, negatives = ([p for t, p in rows if t == side] for side in (1, 0))
    pairs = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives) / (len(positives) * len(negatives))
    assert evaluate.roc_auc(df, bounded=bounded).first()["roc_auc"] == pytest.approx(pairs, abs=1e-12)
    assert evaluate.roc_auc(df.filter("target = 1"), bounded=bounded).first()["roc_auc"] is None


def test_threshold_steps_compare_exactly(spark):
    scores = spark.range(10001).select((F.col("id") / F.lit(10000.0)).alias("p"))
    found = scores.select("p", evaluate._thresholds_passed(F.col("p")).alias("n")).collect()
    assert all(r["n"] == sum(r["p"] >= i / 100 for i in range(30, 81)) for r in found)


def test_threshold_falls_back_and_takes_the_lowest(spark):
    rows = spark.createDataFrame([(1, 0.9)] + [(0, 0.9)] * 9, "target int, probability double")
    best = evaluate.best_threshold(rows).first()
    assert best["threshold"] == 0.3 and best["precision"] == 0.1
    assert evaluate.best_threshold(rows.limit(0)).first()["threshold"] == 0.3


def test_ranking_ignores_zero_and_prefers_the_earlier(spark):
    rows = spark.createDataFrame([(0, "a", 0.0), (1, "b", 0.7), (2, "c", 0.7)], "place int, model string, roc_auc double")
    assert [r["model"] for r in evaluate.model_ranking(rows).collect()] == ["b", "c"]


def test_split_sizes_and_folds(spark):
    rows = spark.range(1003).select("id", (F.col("id") % 7 == 0).cast("int").alias("target"))
    marked = split.mark_test(rows)
    sizes = {(r["target"], r["is_test"]): r["count"] for r in marked.groupBy("target", "is_test").count().collect()}
    positives = sum(i % 7 == 0 for i in range(1003))
    assert sizes[(1, True)] == round(0.2 * positives) and sizes[(0, True)] == round(0.2 * (1003 - positives))
    folds = split.with_folds(marked).groupBy("target", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in folds if r["target"] == label]
        assert len(counts) == 3 and max(counts) - min(counts) <= 1
    assert split.mark_test(rows, seed=1).filter("is_test").join(marked.filter("is_test"), "id").count() < 201
    assert split.mark_test(rows.limit(0)).count() == 0


def test_weights(spark):
    row = spark.createDataFrame([(0,), (1,)], "target int").select(
        balanced_weight(80, 20).alias("b"), positive_weight(80, 20).alias("p")).collect()
    assert [tuple(r) for r in row] == [(0.625, 1.0), (2.5, 4.0)]


def test_tree_leaves_are_even():
    points = np.random.default_rng(0).normal(size=(4000, 5))
    sizes = np.bincount(leaf_of(points, split_tree(points, 8)), minlength=8)
    assert sizes.min() == 500 == sizes.max()


@pytest.mark.parametrize("leaf_rows, piece_rows", [(4096, 8192), (100, 37)])
def test_neighbours_against_brute_force(spark, leaf_rows, piece_rows):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(900, 8))
    points[:, 4:] = np.round(points[:, 4:])
    points[:300, :4] *= 1e-3  # a third of the points in one tight cluster
    points = np.unique(points, axis=0)
    df = spark.createDataFrame([(i, [float(v) for v in p], 1) for i, p in enumerate(points)], "point long, vec array<double>, copies long")
    found = nearest_neighbours(df, 5, leaf_rows, piece_rows).toPandas().sort_values(["point", "rank"])
    squares = ((points[:, None, :] - points[None]) ** 2).sum(-1)
    np.fill_diagonal(squares, np.inf)
    expected = np.sqrt(np.sort(squares, axis=1)[:, :5])
    assert np.allclose(found["distance"].to_numpy().reshape(-1, 5), expected, atol=1e-7)


@pytest.mark.parametrize("widths, crowd, empty, few", [((4, 3, 2), 3, False, 0), ((4, 3, 2), 0, True, 0), ((6, 6, 6), 0, False, 500)])
def test_neighbours_by_category_tuples(spark, monkeypatch, widths, crowd, empty, few):
    """A tuple that holds a third of the points, rows without a category, and the scan for the last few."""
    monkeypatch.setattr(neighbours, "FEW", few)
    rng = np.random.default_rng(6)
    slots = [np.eye(width)[rng.integers(0, width, 500)] for width in widths]
    if crowd:
        for block in slots:
            block[: 500 // crowd] = block[0]
    if empty:
        slots[0][::7] = 0
    points = np.unique(np.hstack([rng.normal(size=(500, 3)).round(2), *slots]), axis=0)
    df = spark.createDataFrame([(i, [float(v) for v in p], 1) for i, p in enumerate(points)], "point long, vec array<double>, copies long")
    asking = df.filter("point % 3 = 0")
    found = nearest_neighbours(df, 5, 40, 15, list(widths), asking.select("point")).toPandas().sort_values(["point", "rank"])
    squares = ((points[:, None, :] - points[None]) ** 2).sum(-1)
    np.fill_diagonal(squares, np.inf)
    expected = np.sqrt(np.sort(squares, axis=1)[::3, :5])
    assert np.allclose(found["distance"].to_numpy().reshape(-1, 5), expected, atol=1e-9)


def prepared(spark, minority, majority):
    rows = [(f"k{i:04d}", 1, [float(v) for v in p]) for i, p in enumerate(minority)]
    rows += [(f"m{i:04d}", 0, [100.0] * len(minority[0])) for i in range(majority)]
    return spark.createDataFrame(rows, "row_key string, target int, vec array<double>").select(
        "row_key", "target", array_to_vector("vec").alias("features"))


def test_smote_uses_the_nearest_rows(spark):
    rng = np.random.default_rng(8)
    minority = rng.normal(size=(60, 3))
    minority[:20] = minority[0]  # a third of the rows are copies
    made = resample.synthesise(prepared(spark, minority, 400), detail=True).collect()
    assert len(made) == math.floor(0.5 * 400) - 60
    squares = ((minority[:, None, :] - minority[None]) ** 2).sum(-1)
    np.fill_diagonal(squares, np.inf)
    reach = {tuple(p): np.sort(row)[4] for p, row in zip(minority, squares)}
    for row in made:
        base, other = np.array(row["base"]), np.array(row["neighbour"])
        assert ((base - other) ** 2).sum() <= reach[tuple(base)] + 1e-9
        assert np.allclose(row["made"], base + row["gap"] * (other - base)) and 0 <= row["gap"] < 1
    copies = [r for r in made if tuple(r["base"]) == tuple(minority[0])]
    assert copies and all(r["made"] == r["base"] for r in copies)


def test_smote_limits(spark):
    with pytest.raises(ValueError):
        resample.synthetic_rows_needed(100, 50)
    with pytest.raises(ValueError):
        resample.synthesise(prepared(spark, np.zeros((5, 2)), 100))


def test_parameter_draws():
    grid = {"a": [1, 2, 3], "b": [4, 5]}
    drawn = train.draw_parameters(grid, 12)
    assert len(drawn) == 6 and len({tuple(d.items()) for d in drawn}) == 6
    assert train.draw_parameters(grid, 3) == train.draw_parameters(grid, 3)
    assert [f.name for f in train.FAMILIES][:2] == ["Random Forest", "Gradient Boosting"]
    assert all(len(train.draw_parameters(f.grid, train.DRAWS)) == 12 for f in train.FAMILIES)


def test_permuted_copies_are_permutations(spark):
    from prospecta.schemas import FEATURES
    ranked = spark.range(50).select(F.col("id").alias("rank"), (F.col("id") % 2).alias("target"), *[F.col("id").alias(n) for n in FEATURES])
    copies = importance.permuted_copies(ranked, 50, [0, 1], seed=42).toPandas()
    for (_, feature), part in copies.groupby(["repeat", "feature"]):
        others = [n for n in FEATURES if n != feature]
        assert sorted(part[feature]) == list(range(50))
        assert (part[others].nunique(axis=1) == 1).all() and (part[feature] != part[others[0]]).any()


def test_search_gives_no_more_than_k_of_a_query(spark):
    """Of a group of 300 points, k pairs a query leave the task, not all 300."""
    df = spark.range(300).select(F.col("id").alias("point"), F.lit(1).cast("long").alias("copies"),
                                 F.array(F.rand(1), F.rand(2), F.lit(1.0)).alias("vec"))
    index = neighbours._Index(df, [1], 512, 4096)
    asking = index.points.withColumn("bound", F.lit(float("inf")))
    assert index.searched(0, asking, 300, 5).groupBy("point").count().agg(F.min("count"), F.max("count")).first() == (5, 5)


def test_tasks_of_trees_hold_few_rows(spark):
    rows = materialise_by_rows(spark.range(0, 1000, 1, 2), 100)
    assert rows.rdd.getNumPartitions() == 10 and rows.count() == 1000
    assert spark.conf.get("spark.sql.files.openCostInBytes") != spark.conf.get("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["standardised_numbers", "category_slots"])
def test_copies_are_taken_out_once(spark, folder, monkeypatch, name):
    """What is fitted on reads a written table; its plan has no exchange of all rows."""
    plans, fit = [], learning.features.fit_preprocessor

    def noted(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return fit(rows)

    monkeypatch.setattr(learning.features, "fit_preprocessor", noted)
    learning.registry.queries[name](spark, folder)
    assert plans and not any("Exchange" in plan for plan in plans)


def test_equal_draws_are_fitted_once(spark, monkeypatch):
    rows = spark.range(120).select(
        F.col("id").cast("string").alias("row_key"), (F.col("id") % 2).cast("int").alias("target"),
        (F.col("id") % 3).cast("int").alias("fold"), array_to_vector(F.array((F.col("id") % 7).cast("double"))).alias("features"))
    parts = [train.Prepared(None, rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)) for f in range(3)]
    monkeypatch.setattr(train, "draw_parameters", lambda *_: [{"numTrees": 9, "maxDepth": 2}, {"numTrees": 8, "maxDepth": 2}, {"numTrees": 7, "maxDepth": 1}])
    fits, classifier = [], train._classifier
    monkeypatch.setattr(train, "_classifier", lambda *a: fits.append(a[1]) or classifier(*a))
    tuned = train.tune(train.FAMILIES[0], rows, prepared=(parts, train.Prepared(PipelineModel([]), rows, None)), trees=2, draws=3)
    assert len(fits) == 2 * 3 + 1 and sorted(tuned.means) == [0, 1, 2] and tuned.means[0] == tuned.means[1]


def test_copies_of_prepared_rows_score_like_copies_of_rows(spark, monkeypatch):
    """The importance scores vectors in which one feature's slots are swapped; no copy goes through the preparation."""
    from prospecta import schemas as S
    from prospecta.learn.features import feature_slots, prepare
    from prospecta.workload.models import forest
    rows = spark.range(120).select(
        F.col("id").alias("rank"), (F.col("id") % 7 < 3).cast("int").alias("target"),
        *[(F.col("id") * 31 % (11 + i)).cast("int").alias(name) for i, name in enumerate(S.NUMERIC_FEATURES)],
        *[F.element_at(F.array(*[F.lit(value) for value in S.DOMAINS[name]]), (F.col("id") % len(S.DOMAINS[name]) + 1).cast("int")).alias(name)
          for name in S.CATEGORICAL_FEATURES])
    model = forest(rows.filter(F.col("job") != "student"))  # students have no slot
    slots = feature_slots(model.preparation)
    assert set(slots) == set(S.FEATURES) and slots["job"][1] == len(S.DOMAINS["job"]) - 1
    ready = prepare(model.preparation, rows, ["target", "rank"]).select("target", "rank", vector_to_array("features").alias("vec"))
    keys = ["repeat", "feature", "target", "probability"]
    swapped = model.of_prepared(importance.permuted_vectors(ready, 120, [0, 1], 42, slots)).select(keys).collect()
    copied = model.with_probability(importance.permuted_copies(rows, 120, [0, 1], 42)).select(keys).collect()
    assert len(swapped) == 120 * 15 * 2 and sorted(swapped) == sorted(copied)
    assert feature_slots(PipelineModel(model.preparation.stages[1:])) == {}

    general = {r["feature"]: r["importance"] for r in _importance_of_rows(monkeypatch, model, rows)}
    monkeypatch.setattr(importance, "permuted_copies", None)
    prepared_ = {r["feature"]: r["importance"] for r in importance.permutation_importance(model, rows, repeats=1).collect()}
    assert prepared_ == pytest.approx(general, abs=1e-12)


def _importance_of_rows(monkeypatch, model, rows):
    with monkeypatch.context() as patch:
        patch.setattr(importance, "feature_slots", lambda _: {})
        return importance.permutation_importance(model, rows, repeats=1).collect()


def test_folds_are_resampled_and_fitted_side_by_side(spark, monkeypatch):
    """The three folds and all rows wait for each other; so do the fits of a draw's folds."""
    rows = spark.range(120).select(
        F.col("id").cast("string").alias("row_key"), (F.col("id") % 2).cast("int").alias("target"),
        (F.col("id") % 3).cast("int").alias("fold"), array_to_vector(F.array((F.col("id") % 7).cast("double"))).alias("features"))
    parts = [train.Prepared(None, rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)) for f in range(3)]
    whole = train.Prepared(PipelineModel([]), rows, None)
    ready, classifier, resampling, fitting, fits = train._ready, train._classifier, Barrier(4), Barrier(3), []

    def resampled(*arguments):
        resampling.wait(60)
        return ready(*arguments)

    def fitted(*arguments):
        fits.append(arguments)
        if len(fits) <= 3:
            fitting.wait(60)
        return classifier(*arguments)

    monkeypatch.setattr(train, "_ready", resampled)
    monkeypatch.setattr(train, "_classifier", fitted)
    tuned = train.tune(train.FAMILIES[0], rows, prepared=(parts, whole), trees=2, draws=1)
    assert len(fits) == 4 and tuned.out_of_fold.count() == 120


@pytest.mark.parametrize("name, families", [("out_of_fold_rows", train.FAMILIES[:1]), ("compared_families", train.FAMILIES)])
def test_registered_searches_draw_from_the_whole_grids(spark, monkeypatch, name, families):
    """Every family is searched with twelve draws of its own grid, whose trees nothing limits."""
    from prospecta import schemas as S
    from prospecta.workload import models
    rows = spark.range(240).select(
        F.md5(F.col("id").cast("string")).alias("row_key"), (F.col("id") % 4 == 0).cast("int").alias("target"),
        *[(F.col("id") * 31 % (11 + i)).cast("int").alias(name) for i, name in enumerate(S.NUMERIC_FEATURES)],
        *[F.element_at(F.array(*[F.lit(value) for value in S.DOMAINS[name]]), (F.col("id") % len(S.DOMAINS[name]) + 1).cast("int")).alias(name)
          for name in S.CATEGORICAL_FEATURES])
    asked = []

    def small(family, parameters, label, seed):
        asked.append((family.name, tuple(parameters.items())))
        return train.RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=1, maxDepth=1, seed=seed)

    monkeypatch.setattr(models, "parts", lambda *_: (rows.filter("target >= 0"), rows))
    monkeypatch.setattr(train, "_classifier", small)
    monkeypatch.setattr(train, "oversample", lambda prepared, label, seed: prepared.select(label, "features"))
    models.registry.queries[name](spark, "").collect()
    for family in families:
        drawn = [tuple(parameters.items()) for parameters in train.draw_parameters(family.grid, 12)]
        assert {p for f, p in asked if f == family.name} == set(drawn) and len(set(drawn)) == 12
    assert f"{train.DRAWS} AS draws" in models.registry.sql[name] and train.DRAWS == 12


def test_cutoffs_are_found_once(spark):
    """A split that is read again ranks no row again."""
    rows = spark.range(500).select("id", (F.col("id") % 3 == 0).cast("int").alias("target"))
    marked = split.mark_test(rows)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "HashAggregate" not in plan
    assert {r["target"]: r["n"] for r in marked.filter("is_test").groupBy("target").agg(F.count("*").alias("n")).collect()} == {0: 67, 1: 33}
