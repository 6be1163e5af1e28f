"""Scans, point filters and projections of the campaign tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta import schemas as S
from prospecta.functions import scalars as X


def customer_by_id(customers: DataFrame, customer_id: int) -> DataFrame:
    return customers.filter(F.col("customer_id") == customer_id)


def customer_by_phone(customers: DataFrame, phone_number: str) -> DataFrame:
    """Stored numbers are stripped on load, so this plain equality reaches the Parquet scan."""
    return customers.filter(F.col("phone_number") == phone_number.strip())


def customer_by_untrimmed_phone(customers: DataFrame, phone_number: str) -> DataFrame:
    """For tables whose numbers were not stripped on load."""
    return customers.filter(X.strip(F.col("phone_number")) == phone_number.strip())


def pending_customers(customers: DataFrame) -> DataFrame:
    return customers.filter(F.col("prediction_status") == "PENDING")


def predictions_of_customer(predictions: DataFrame, customer_id: int) -> DataFrame:
    return predictions.filter(F.col("customer_id") == customer_id)


def campaigns_of_customer(campaigns: DataFrame, customer_id: int) -> DataFrame:
    return campaigns.filter(F.col("customer_id") == customer_id)


def batch_by_id(batches: DataFrame, batch_id: int) -> DataFrame:
    return batches.filter(F.col("batch_id") == batch_id)


def customers_of_batch(customers: DataFrame, batch_id: int) -> DataFrame:
    return customers.filter(F.col("batch_id") == batch_id)


def log_by_id(logs: DataFrame, log_id: int) -> DataFrame:
    return logs.filter(F.col("log_id") == log_id)


def customer_part(records: DataFrame) -> DataFrame:
    return records.select("phone_number", *[f"`{c}`" for c in S.CUSTOMER_FIELDS], "batch_id")


def campaign_part(records: DataFrame) -> DataFrame:
    return records.select("phone_number", *S.CAMPAIGN_FIELDS)


def model_part(records: DataFrame) -> DataFrame:
    """The model input: no identifiers."""
    return records.select(*[f"`{c}`" for c in S.FEATURES])


def preview(df: DataFrame, order_by: list[str], rows: int = 10) -> DataFrame:
    """The first rows with ``shown`` of ``total_rows``; a top-k, not a full sort."""
    total = df.agg(F.count("*")).scalar()
    return (
        df.orderBy(*order_by).limit(rows)
        .withColumn("total_rows", total)
        .withColumn("shown", F.least(F.lit(rows).cast("bigint"), F.col("total_rows")))
    )


def present(results: DataFrame) -> DataFrame:
    """Batch results as shown to users: percent, tier label, display names, no helper columns."""
    shown = (
        results.withColumn("campaign_priority", X.priority_label(F.col("priority")))
        .withColumn("probability", X.percent(F.col("probability")))
        .drop("subscribed", "priority")
    )
    return shown.withColumnsRenamed({
        "batch_id": "Batch ID",
        "customer_id": "Customer ID",
        "phone_number": "Phone Number",
        "probability": "Subscription Probability (%)",
        "prediction": "Predicted Subscription",
        "subscription": "Predicted Subscription",
        "campaign_priority": "Campaign Priority",
    })
