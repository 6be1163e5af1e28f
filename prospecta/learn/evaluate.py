"""Evaluation of scores: metrics, curves, AUC and the choice of a threshold.

Rows are reduced to counts per distinct score first. Scores rounded to a few places give a bounded
number of them (``bounded=True``); otherwise running totals over the counts are distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospecta import schemas as S
from prospecta.operators.ranking import running_totals
from prospecta.session import materialise

# Fixed values of the threshold search, in hundredths.
LOWEST, HIGHEST = 30, 80
MIN_PRECISION = 0.40


def _zero_if_undefined(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _zero_if_undefined(2 * tp, 2 * tp + fp + fn)


def confusion(df: DataFrame, predicted: Column, label: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp in one pass."""
    actual = F.col(label)
    return df.groupBy(*by).agg(
        F.count_if((actual == 0) & (predicted == 0)).alias("tn"),
        F.count_if((actual == 0) & (predicted == 1)).alias("fp"),
        F.count_if((actual == 1) & (predicted == 0)).alias("fn"),
        F.count_if((actual == 1) & (predicted == 1)).alias("tp"),
    )


def at_threshold(score: str, threshold: float) -> Column:
    return (F.col(score) >= F.lit(threshold)).cast("int")


def metrics_of(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(name) for name in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "accuracy": _zero_if_undefined(tp + tn, tp + tn + fp + fn),
        "precision": _zero_if_undefined(tp, tp + fp),
        "recall": _zero_if_undefined(tp, tp + fn),
        "f1": _f1(tp, fp, fn),
    })


def metrics(
    df: DataFrame, threshold: float = S.DECISION_THRESHOLD, score: str = "probability", label: str = "target"
) -> DataFrame:
    return metrics_of(confusion(df, at_threshold(score, threshold), label))


def classification_report(counts: DataFrame) -> DataFrame:
    """Per class, macro and weighted precision, recall, F1 and support, from one confusion row."""
    tn, fp, fn, tp = (F.col(name) for name in ("tn", "fp", "fn", "tp"))

    def line(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), _zero_if_undefined(hit, hit + wrong).alias("precision"),
            _zero_if_undefined(hit, hit + missed).alias("recall"), _f1(hit, wrong, missed).alias("f1"),
            (hit + missed).alias("support"))

    both = counts.select(line("No Subscription", tn, fn, fp).alias("no"), line("Subscription", tp, fp, fn).alias("yes"))
    support = F.col("no.support") + F.col("yes.support")

    def mean(name: str, field: str, weighted: bool) -> Column:
        no, yes = F.col(f"no.{field}"), F.col(f"yes.{field}")
        value = (
            _zero_if_undefined(no * F.col("no.support") + yes * F.col("yes.support"), support)
            if weighted else (no + yes) / 2
        )
        return value.alias(field)

    def average(name: str, weighted: bool) -> Column:
        return F.struct(F.lit(name).alias("class"), *[mean(name, f, weighted) for f in ("precision", "recall", "f1")],
                        support.alias("support"))

    lines = F.array("no", "yes", average("macro avg", False), average("weighted avg", True))
    return both.select(F.explode(lines).alias("line")).select("line.*")


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))


def roc_auc(
    df: DataFrame, score: str = "probability", label: str = "target", by: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """Area under the ROC curve by rank sums; ties count half. NULL if a class is missing."""
    counts = score_counts(df, score, label, by)
    totals = running_totals(counts, [F.col(score)], {"negatives_up_to": "negatives"}, by, bounded)
    below = F.col("negatives_up_to") - F.col("negatives") / 2
    pairs = F.sum("positives").cast("double") * F.sum("negatives")
    return totals.groupBy(*by).agg(F.try_divide(F.sum(F.col("positives") * below), pairs).alias("roc_auc"))


def curve_points(df: DataFrame, score: str = "probability", label: str = "target", bounded: bool = False) -> DataFrame:
    """ROC and precision-recall coordinates at every distinct score, used as threshold."""
    counts = materialise(score_counts(df, score, label))  # read again for the totals
    totals = running_totals(
        counts, [F.col(score).desc()], {"tp": "positives", "fp": "negatives"}, bounded=bounded)
    sized = totals.withColumns({
        "p": counts.agg(F.sum("positives")).scalar(), "n": counts.agg(F.sum("negatives")).scalar()})
    return sized.select(
        F.col(score).alias("threshold"), "tp", "fp",
        _zero_if_undefined(F.col("fp"), F.col("n")).alias("fpr"),
        _zero_if_undefined(F.col("tp"), F.col("p")).alias("tpr"),
        _zero_if_undefined(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def _thresholds_passed(score: Column) -> Column:
    """How many of 0.30, 0.31 .. 0.80 a score reaches.

    The product with 100 may be off by one place, so the neighbours are compared exactly.
    """
    steps = HIGHEST - LOWEST + 1
    guess = F.greatest(F.least(F.floor(score * 100).cast("int") - (LOWEST - 1), F.lit(steps)), F.lit(0))
    up = (guess < steps) & (score >= (guess + LOWEST) / F.lit(100.0))
    down = (guess > 0) & (score < (guess + (LOWEST - 1)) / F.lit(100.0))
    return guess + up.cast("int") - down.cast("int")


def threshold_table(df: DataFrame, score: str = "probability", label: str = "target") -> DataFrame:
    """Precision and F1 at each of the 51 thresholds.

    Rows are counted by the number of thresholds they reach (52 groups), then summed from the top.
    """
    reached = df.groupBy(_thresholds_passed(F.col(score)).alias("reached")).agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))
    grid = df.sparkSession.range(1, HIGHEST - LOWEST + 2).select(F.col("id").cast("int").alias("reached"))
    # Rows that reach more thresholds reach this one too; the window runs over 51 rows.
    from_top = Window.orderBy(F.col("reached").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = grid.join(reached, "reached", "left").select(
        (F.col("reached") + (LOWEST - 1)).alias("hundredths"),
        F.coalesce(F.sum("positives").over(from_top), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("negatives").over(from_top), F.lit(0)).alias("fp"),
    )
    total = reached.agg(F.coalesce(F.sum("positives"), F.lit(0)))
    fn = F.col("all_positives") - F.col("tp")
    return sums.withColumn("all_positives", total.scalar()).select(
        (F.col("hundredths") / F.lit(100.0)).alias("threshold"), "tp", "fp",
        _zero_if_undefined(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _f1(F.col("tp"), F.col("fp"), fn).alias("f1"),
    )


def best_threshold(
    df: DataFrame, score: str = "probability", label: str = "target", min_precision: float = MIN_PRECISION
) -> DataFrame:
    """Highest F1 among thresholds with enough precision, else the highest F1; the lowest wins ties."""
    precise = F.col("precision") >= min_precision
    return threshold_table(df, score, label).orderBy(
        precise.desc(), F.col("f1").desc(), F.col("threshold")).limit(1)


def model_ranking(results: DataFrame, by: str = "roc_auc") -> DataFrame:
    """Models by an AUC column; the earlier ``place`` wins ties and an AUC of 0 is never chosen."""
    return results.filter(F.col(by) > 0).orderBy(F.col(by).desc(), F.col("place"))
