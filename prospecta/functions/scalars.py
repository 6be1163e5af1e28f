"""Scalar expressions shared by the operators. All are built-in columns, no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospecta import schemas as S

BLANKS = " \t\n\r\x0b\x0c"
NUMBER = r"^\s*[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def strip(text: Column) -> Column:
    """Remove white space, not only blanks, from both ends."""
    return F.trim(text, F.lit(BLANKS))


def to_number(value: Column) -> Column:
    """Double, or NULL for text that is no decimal number and for NaN.

    The pattern keeps out spellings that Java reads and users do not mean, such as ``1d``. The input is
    named only twice: Spark repeats the whole expression for every mention.
    """
    text = value.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_int(value: Column) -> Column:
    """Integer with the fraction cut off, or NULL."""
    return to_number(value).try_cast("int")


def is_subscriber(prediction: Column) -> Column:
    """True for the accepted spellings of yes; NULL counts as no."""
    word = F.lower(strip(prediction.cast("string")))
    return F.coalesce(word.isin(S.SUBSCRIBER_WORDS), F.lit(False))


def priority(probability: Column, high: float = S.HIGH_PRIORITY, medium: float = S.MEDIUM_PRIORITY) -> Column:
    return (
        F.when(probability.isNull(), "Unknown")
        .when(probability >= high, "High")
        .when(probability >= medium, "Medium")
        .otherwise("Low")
    )


def priority_rank(probability: Column) -> Column:
    """0 for High to 3 for Unknown."""
    tier = priority(probability)
    rank = F.when(tier == S.PRIORITIES[0], 0)
    for place, name in enumerate(S.PRIORITIES[1:], 1):
        rank = rank.when(tier == name, place)
    return rank


def priority_label(tier: Column) -> Column:
    """The text shown to users."""
    label = F.lit(None).cast("string")
    for name, text in S.PRIORITY_LABELS.items():
        label = F.when(tier == name, text).otherwise(label)
    return label


def decide(probability: Column, threshold: float = S.DECISION_THRESHOLD) -> Column:
    """1 or 0 on the raw probability."""
    return F.when(probability >= F.lit(threshold), 1).when(probability < F.lit(threshold), 0)


def subscription(decision: Column) -> Column:
    return F.when(decision == 1, "Yes").when(decision == 0, "No")


def stored_probability(probability: Column) -> Column:
    """Four places, ties to even; apply after ``decide``."""
    return F.bround(probability, 4)


def percent(share: Column, places: int = 1) -> Column:
    """Percent for display: the scaled value to the nearest integer, ties to even."""
    return F.rint(share * 100 * 10.0**places) / 10.0**places


def safe_ratio(part: Column, whole: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def sgd_to_eur(balance: Column, rate: float = S.EUR_TO_SGD) -> Column:
    return balance / F.lit(rate)


def eur_to_sgd(balance: Column, rate: float = S.EUR_TO_SGD) -> Column:
    return balance * F.lit(rate)
