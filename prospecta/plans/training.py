"""Training and evaluation as whole jobs: from the raw file to a saved model and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.learn import evaluate
from prospecta.learn.importance import REPEATS, permutation_importance
from prospecta.learn.score import ScoringModel
from prospecta.learn.split import train_test
from prospecta.learn.train import Training, train_families
from prospecta.operators import quality
from prospecta.session import materialise
from prospecta.sources.files import write_csv, write_report


def split_training_data(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean, split on the full row, then drop what a model must not see."""
    train, test = train_test(quality.clean(raw))
    return quality.feature_frame(train), quality.feature_frame(test)


def train_and_save(raw: DataFrame, model_path: str, report_path: str | None = None, **options) -> Training:
    """``options`` go to ``train_families``. The chosen threshold is saved with the model."""
    train, test = split_training_data(raw)
    training = train_families(train, test, **options)
    training.best.save(model_path)
    if report_path:
        write_report(training.results, f"{report_path}/model_comparison")
    return training


def evaluate_and_report(model: ScoringModel, test: DataFrame, report_path: str, repeats: int = REPEATS) -> DataFrame:
    """Writes metrics, confusion matrix, class report, curve points and feature importance; returns the metrics."""
    scored = materialise(model.with_probability(test).select("target", "probability"))
    counts = evaluate.confusion(scored, evaluate.at_threshold("probability", model.threshold))
    auc = evaluate.roc_auc(scored).first()["roc_auc"]
    # The column names of the metrics file.
    metrics = evaluate.metrics_of(counts).select(
        F.lit(model.threshold).alias("Threshold"), F.col("accuracy").alias("Accuracy"),
        F.col("precision").alias("Precision"), F.col("recall").alias("Recall"), F.col("f1").alias("F1 Score"),
        F.lit(auc).cast("double").alias("ROC AUC"))
    importance = permutation_importance(model, test, repeats).select(
        F.col("feature").alias("Feature"), F.col("importance").alias("Importance"))
    write_report(metrics, f"{report_path}/final_metrics")
    write_report(counts, f"{report_path}/confusion_matrix")
    write_report(evaluate.classification_report(counts), f"{report_path}/classification_report")
    write_report(importance, f"{report_path}/feature_importance")
    write_csv(evaluate.curve_points(scored), f"{report_path}/curve_points")
    return metrics
