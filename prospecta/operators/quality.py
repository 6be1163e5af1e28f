"""Cleaning and profiling of the training data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospecta import schemas as S
from prospecta.functions import scalars as X


def rename_training(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(S.TRAINING_COLUMNS)


def recode_target(target: Column) -> Column:
    """1 -> 0 and 2 -> 1; anything else has no label."""
    return F.when(target == 1, 0).when(target == 2, 1)


def deduplicate(df: DataFrame) -> DataFrame:
    """Full-row de-duplication. Map-side partial aggregation folds a hot group of copies early."""
    return df.dropDuplicates()


def clean(raw: DataFrame) -> DataFrame:
    """Rename, de-duplicate on the full row (with duration), recode the target."""
    unique = deduplicate(rename_training(raw))
    return unique.withColumn("target", recode_target(F.col("target")))


def feature_frame(cleaned: DataFrame) -> DataFrame:
    """Model columns and target; duration is only known after the call and would leak."""
    return cleaned.drop("duration")


def profile(df: DataFrame) -> DataFrame:
    """Row, column, null and duplicate counts from one grouping by the full row."""
    names = [f"`{name}`" for name in df.columns]
    nulls = reduce(lambda a, b: a + b, [F.col(name).isNull().cast("bigint") for name in names])
    return (
        df.groupBy(*names).agg(F.count("*").alias("_copies"))
        .agg(
            F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.col("_copies") * nulls), F.lit(0)).alias("null_values"),
            F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
        )
        .withColumn("column_count", F.lit(len(df.columns)).cast("bigint"))
    )


def target_distribution(df: DataFrame, target: str = "target") -> DataFrame:
    """Count and percent per class, over the labelled rows."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("records"))
    # The window runs over one row per class.
    return counts.withColumn("percent", F.col("records") * 100.0 / F.sum("records").over(Window.partitionBy()))


def class_ratio(df: DataFrame, target: str = "target") -> DataFrame:
    """Negatives per positive; NULL without positives."""
    return df.agg(
        F.count_if(F.col(target) == 0).alias("negatives"),
        F.count_if(F.col(target) == 1).alias("positives"),
    ).withColumn("ratio", F.try_divide(F.col("negatives").cast("double"), F.col("positives")))


def with_subscription_flags(predictions: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Numeric probability, subscriber flag and priority tier."""
    return (
        predictions.withColumn("probability", X.to_number(F.col("probability")))
        .withColumn("subscribed", X.is_subscriber(F.col(prediction)))
        .withColumn("priority", X.priority(F.col("probability")))
    )
