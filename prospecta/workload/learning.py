"""Splits, features, evaluation, training, scoring and importance."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from prospecta import schemas as S
from prospecta.learn import evaluate, features, split
from prospecta.operators import quality
from prospecta.session import materialise
from prospecta.workload.fixtures import Registry, cte, load
from prospecta.workload.relational import CLEAN

registry = Registry()
add = registry.add

CLEAN_COLUMNS = list(S.TRAINING_COLUMNS.values())
KEY_SQL = "md5('2:42' || " + " || ".join(
    f"coalesce(length(CAST(\"{name}\" AS VARCHAR)) || ':' || CAST(\"{name}\" AS VARCHAR), '~')" for name in CLEAN_COLUMNS) + ")"
KEYED = CLEAN | {"keyed": f"SELECT *, {KEY_SQL} AS row_key FROM cleaned WHERE target IS NOT NULL"}


def cleaned(spark, folder):
    return quality.clean(load(spark, folder, "fx_raw_bank"))


def cleaned_once(spark, folder):
    """Written: each fit and the result read it, and would else take out the copies anew. The key is not kept but made of
    the columns where it is asked for."""
    return split.with_row_key(materialise(cleaned(spark, folder)))


# --- Splits ---------------------------------------------------------------------------------
@add("stratified_split", cte("fx_raw_bank", **KEYED) + """
SELECT row_key, target, row_number() OVER (PARTITION BY target ORDER BY row_key)
    <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY target)) AS is_test FROM keyed""")
def _(spark, folder):
    return split.mark_test(cleaned(spark, folder)).select("row_key", "target", "is_test")


@add("stratified_folds", cte("fx_raw_bank", **KEYED) + """
SELECT row_key, target, CAST((row_number() OVER (PARTITION BY target ORDER BY row_key) - 1) % 3 AS INT) AS fold FROM keyed""")
def _(spark, folder):
    keyed = split.with_row_key(cleaned(spark, folder))
    return split.with_folds(keyed).select("row_key", "target", "fold")


# --- Features -------------------------------------------------------------------------------
@add("standardised_numbers", cte("fx_raw_bank", **KEYED) + "SELECT row_key, " + ", ".join(
    f"round(({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER (), 6) + 0.0::DOUBLE AS {n}" for n in S.NUMERIC_FEATURES) + " FROM keyed")
def _(spark, folder):
    keyed = cleaned_once(spark, folder)
    model = features.fit_preprocessor(keyed)
    numbers = vector_to_array("features")
    return features.prepare(model, keyed, ["row_key"]).select(
        "row_key", *[(F.round(numbers[i], 6) + 0.0).alias(name) for i, name in enumerate(S.NUMERIC_FEATURES)])


# The encoder has not seen students, so their rows have no job slot.
_SEEN = " UNION ALL ".join(
    f"SELECT DISTINCT {i} AS field, \"{name}\" AS value FROM keyed WHERE job <> 'student'"
    for i, name in enumerate(S.CATEGORICAL_FEATURES))
_SLOT_JOINS = " ".join(
    f"LEFT JOIN slots s{i} ON s{i}.field = {i} AND s{i}.value = k.\"{name}\"" for i, name in enumerate(S.CATEGORICAL_FEATURES))


@add("category_slots", cte("fx_raw_bank", **KEYED, seen=_SEEN,
     slots="SELECT field, value, row_number() OVER (ORDER BY field, value) - 1 AS slot FROM seen") +
     "SELECT row_key, concat_ws(',', " + ", ".join(f"s{i}.slot" for i in range(len(S.CATEGORICAL_FEATURES))) +
     f") AS slots, (SELECT count(*) FROM slots) AS slot_count FROM keyed k {_SLOT_JOINS}")
def _(spark, folder):
    keyed = cleaned_once(spark, folder)
    model = features.fit_preprocessor(keyed.filter(F.col("job") != "student"))
    vector = vector_to_array("features")
    first = len(S.NUMERIC_FEATURES)
    slots = F.slice(vector, first + 1, F.size(vector) - first)
    active = F.filter(F.transform(slots, lambda v, i: F.when(v == 1.0, i)), lambda i: i.isNotNull())
    return features.prepare(model, keyed, ["row_key"]).select(
        "row_key", F.array_join(active.cast("array<string>"), ",").alias("slots"),
        F.size(slots).cast("bigint").alias("slot_count"))


@add("class_weights", cte("fx_raw_bank", **CLEAN, counts="""
SELECT count(*) FILTER (WHERE target = 0)::DOUBLE AS neg, count(*) FILTER (WHERE target = 1)::DOUBLE AS pos FROM cleaned""") + """
SELECT 0 AS target, round((neg + pos) / (2 * neg), 6) AS balanced, 1.0::DOUBLE AS positive FROM counts
UNION ALL SELECT 1, round((neg + pos) / (2 * pos), 6), round(neg / pos, 6) FROM counts""")
def _(spark, folder):
    weights = features.class_weights(cleaned(spark, folder))
    return weights.withColumns({"balanced": F.round("balanced", 6), "positive": F.round("positive", 6)})


# --- Evaluation on a fixed score ------------------------------------------------------------
def scored(spark, folder, name="fx_scored"):
    return load(spark, folder, name)


CONFUSION_SQL = """
SELECT count(*) FILTER (WHERE label = 0 AND score < 0.6::DOUBLE) AS tn, count(*) FILTER (WHERE label = 0 AND score >= 0.6::DOUBLE) AS fp,
    count(*) FILTER (WHERE label = 1 AND score < 0.6::DOUBLE) AS fn, count(*) FILTER (WHERE label = 1 AND score >= 0.6::DOUBLE) AS tp
FROM fx_scored"""
AUC_SQL = """
SELECT round((sum(r) FILTER (WHERE label = 1) - n1 * (n1 + 1) / 2) / (n1 * n0), 9) AS roc_auc
FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r,
    (count(*) FILTER (WHERE label = 1) OVER ())::DOUBLE AS n1, (count(*) FILTER (WHERE label = 0) OVER ())::DOUBLE AS n0 FROM {source})
GROUP BY n1, n0"""


@add("best_threshold", cte("fx_scored", grid="""
SELECT i::DOUBLE / 100::DOUBLE AS threshold, count(*) FILTER (WHERE label = 1 AND score >= i::DOUBLE / 100::DOUBLE) AS tp,
    count(*) FILTER (WHERE label = 0 AND score >= i::DOUBLE / 100::DOUBLE) AS fp, count(*) FILTER (WHERE label = 1) AS p
FROM fx_scored, range(30, 81) t(i) GROUP BY i""", rated="""
SELECT threshold, tp, fp, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision,
    CASE WHEN tp + fp + p > 0 THEN 2.0::DOUBLE * tp / (tp + fp + p) ELSE 0 END AS f1 FROM grid""") + """
SELECT threshold, tp, fp, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM rated
ORDER BY (precision >= 0.4::DOUBLE) DESC, rated.f1 DESC, threshold LIMIT 1""")
def _(spark, folder):
    best = evaluate.best_threshold(scored(spark, folder), "score", "label")
    return best.withColumns({"precision": F.round("precision", 6), "f1": F.round("f1", 6)})


@add("threshold_table", registry.sql["best_threshold"].split("ORDER BY")[0])
def _(spark, folder):
    table = evaluate.threshold_table(scored(spark, folder), "score", "label")
    return table.withColumns({"precision": F.round("precision", 6), "f1": F.round("f1", 6)})


@add("metrics_at_threshold", cte("fx_scored", counts=CONFUSION_SQL) + """
SELECT tn, fp, fn, tp, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 9) AS accuracy, round(tp::DOUBLE / (tp + fp), 9) AS precision,
    round(tp::DOUBLE / (tp + fn), 9) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9) AS f1 FROM counts""")
def _(spark, folder):
    row = evaluate.metrics(scored(spark, folder), 0.6, "score", "label")
    return row.withColumns({name: F.round(name, 9) for name in ("accuracy", "precision", "recall", "f1")})


@add("confusion_matrix", cte("fx_scored") + CONFUSION_SQL)
def _(spark, folder):
    return evaluate.confusion(scored(spark, folder), evaluate.at_threshold("score", 0.6), "label")


@add("roc_auc", cte("fx_scored") + AUC_SQL.format(source="fx_scored"))
def _(spark, folder):
    return evaluate.roc_auc(scored(spark, folder), "score", "label", bounded=True).withColumn("roc_auc", F.round("roc_auc", 9))


@add("roc_auc_unrounded_scores", cte("fx_raw_scored") + AUC_SQL.format(source="fx_raw_scored"))
def _(spark, folder):
    auc = evaluate.roc_auc(scored(spark, folder, "fx_raw_scored"), "score", "label")
    return auc.withColumn("roc_auc", F.round("roc_auc", 9))


@add("classification_report", cte("fx_scored", counts=CONFUSION_SQL, lines="""
SELECT 'No Subscription' AS class, tn::DOUBLE / (tn + fn) AS p, tn::DOUBLE / (tn + fp) AS r, 2.0::DOUBLE * tn / (2 * tn + fn + fp) AS f, tn + fp AS s FROM counts
UNION ALL SELECT 'Subscription', tp::DOUBLE / (tp + fp), tp::DOUBLE / (tp + fn), 2.0::DOUBLE * tp / (2 * tp + fp + fn), tp + fn FROM counts""") + """
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM lines
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM lines
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM lines""")
def _(spark, folder):
    counts = evaluate.confusion(scored(spark, folder), evaluate.at_threshold("score", 0.6), "label")
    report = evaluate.classification_report(counts)
    return report.withColumns({name: F.round(name, 6) for name in ("precision", "recall", "f1")})


CURVE_SQL = """
SELECT threshold, tp, fp, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr, round(tp::DOUBLE / (tp + fp), 6) AS precision
FROM (SELECT score AS threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
    FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {source} GROUP BY 1)
    WINDOW w AS (ORDER BY score DESC))"""


def _curve(spark, folder, name, bounded):
    points = evaluate.curve_points(scored(spark, folder, name), "score", "label", bounded)
    return points.withColumns({column: F.round(column, 6) for column in ("fpr", "tpr", "precision")})


@add("curve_points", cte("fx_scored") + CURVE_SQL.format(source="fx_scored"))
def _(spark, folder):
    return _curve(spark, folder, "fx_scored", True)


@add("curve_points_unrounded_scores", cte("fx_raw_scored") + CURVE_SQL.format(source="fx_raw_scored"))
def _(spark, folder):
    return _curve(spark, folder, "fx_raw_scored", False)
