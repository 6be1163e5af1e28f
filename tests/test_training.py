from prospecta.learn.score import ScoringModel
from prospecta.learn.train import FAMILIES
from prospecta.plans import training
from prospecta.workload.fixtures import load


def test_train_save_load_report(spark, folder, tmp_path):
    raw = load(spark, folder, "fx_raw_bank")
    done = training.train_and_save(
        raw, str(tmp_path / "model"), str(tmp_path / "reports"), families=FAMILIES[:1], draws=1, trees=10, choose_by="roc_auc")
    assert done.best_name == "Random Forest" and 0.3 <= done.best.threshold <= 0.8

    model = ScoringModel.load(spark, str(tmp_path / "model"))
    assert model.threshold == done.best.threshold and model.labels[model.positive_index] == 1
    _, test = training.split_training_data(raw)
    assert "duration" not in test.columns
    metrics = training.evaluate_and_report(model, test, str(tmp_path / "reports"), repeats=1).first()
    assert metrics["ROC AUC"] > 0.75

    written = spark.read.option("header", True).csv(str(tmp_path / "reports" / "final_metrics")).first()
    assert list(written.asDict()) == ["Threshold", "Accuracy", "Precision", "Recall", "F1 Score", "ROC AUC"]
    ranked = spark.read.option("header", True).csv(str(tmp_path / "reports" / "feature_importance")).collect()
    values = [float(row["Importance"]) for row in ranked]
    assert len(values) == 15 and values == sorted(values, reverse=True)
    points = spark.read.option("header", True).csv(str(tmp_path / "reports" / "curve_points")).count()
    assert points > 100


def test_unseen_categories_are_scored(spark, folder):
    from pyspark.sql import functions as F
    from prospecta.workload.models import forest
    train, test = training.split_training_data(load(spark, folder, "fx_raw_bank"))
    model = forest(train.filter(F.col("job") != "student"))
    rows = model.predict(test.filter(F.col("job") == "student")).collect()
    assert rows and all(0.0 <= row["probability"] <= 1.0 for row in rows)
