"""Joins, aggregates and rankings over customers, campaigns, predictions and batches.

Prediction and campaign rows may pile up on one customer. Aggregates therefore fold those tables
per customer first (map-side partial aggregation) and join the one-row-per-customer result; joins
that must return single rows leave the splitting of a hot partition to adaptive skew joins, with
the unique customer key on the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospecta import schemas as S
from prospecta.functions import scalars as X
from prospecta.operators.ranking import with_positions

KPI_NAMES = ["customers_scored", "predicted_subscribers", "high_priority", "medium_priority", "low_priority"]


# --- Joins ---------------------------------------------------------------------------------

def batch_results(
    customers: DataFrame, predictions: DataFrame, batches: DataFrame, batch_id: int | None = None
) -> DataFrame:
    """Predictions of the customers of a batch (or of every batch) with the batch header."""
    members = customers.select("customer_id", "phone_number", "age", "job", "batch_id")
    headers = batches.select("batch_id", "file_name", "total_records")
    if batch_id is not None:
        members = members.filter(F.col("batch_id") == batch_id)
        headers = headers.filter(F.col("batch_id") == batch_id)
    # Customers get their header first, so the predictions are shuffled once, by customer. Shuffled by
    # batch, a large batch would be one task.
    members = members.join(headers, "batch_id")
    return predictions.select("customer_id", "prediction", "probability", "predicted_at").join(members, "customer_id")


def predictions_per_batch(customers: DataFrame, predictions: DataFrame) -> DataFrame:
    per_customer = predictions.groupBy("customer_id").agg(F.count("*").alias("n"))
    return (
        customers.filter(F.col("batch_id").isNotNull()).select("customer_id", "batch_id")
        .join(per_customer, "customer_id")
        .groupBy("batch_id").agg(F.sum("n").alias("predictions"))
    )


def batch_counts(customers: DataFrame, predictions: DataFrame, distinct_customers: bool = False) -> DataFrame:
    """(batch_id, customers, predictions) of every batch that has customers."""
    per_customer = predictions.groupBy("customer_id").agg(F.count("*").alias("n"))
    scored = F.count("n") if distinct_customers else F.sum("n")
    return (
        customers.filter(F.col("batch_id").isNotNull()).select("customer_id", "batch_id")
        .join(per_customer, "customer_id", "left")
        .groupBy("batch_id").agg(F.count("*").alias("customers"), F.coalesce(scored, F.lit(0)).alias("predictions"))
    )


def status_of_counts(batches: DataFrame, counts: DataFrame) -> DataFrame:
    """``batches`` with the status that their counts give."""
    counts = counts.select("batch_id", F.col("customers").alias("_customers"), F.col("predictions").alias("_scored"))
    status = (
        F.when((F.coalesce("_scored", F.lit(0)) >= F.col("total_records")) & (F.col("total_records") > 0), "completed")
        .when(F.col("_customers") > 0, "processing")
        .otherwise("pending")
    )
    return batches.join(counts, "batch_id", "left").withColumn("status", status).drop("_scored", "_customers")


def batch_status(
    batches: DataFrame, customers: DataFrame, predictions: DataFrame, distinct_customers: bool = False
) -> DataFrame:
    """``batches`` with recomputed status.

    A batch is completed once it has as many predictions as records, processing once it has
    customers. Re-scored customers count each time unless ``distinct_customers`` is set.
    """
    return status_of_counts(batches, batch_counts(customers, predictions, distinct_customers))


def known_customers(rows: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of existing customers, rows rejected with ``reason``)."""
    keys = customers.select("customer_id")
    rejected = rows.join(keys, "customer_id", "left_anti").withColumn("reason", F.lit("customer_not_found"))
    return rows.join(keys, "customer_id", "left_semi"), rejected


def accept_predictions(
    predictions: DataFrame, customers: DataFrame, campaigns: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """A prediction needs an existing customer that has campaign data.

    The tests are made on the unique customers; each output reads every table once.
    """
    contacted = campaigns.select("customer_id").distinct().withColumn("_contacted", F.lit(True))
    tested = customers.select("customer_id").distinct().withColumn("_known", F.lit(True)).join(
        contacted, "customer_id", "left")
    reason = F.when(F.col("_known").isNull(), "customer_not_found").when(F.col("_contacted").isNull(), "no_campaign_data")
    checked = predictions.join(tested, "customer_id", "left").select(
        *[f"`{name}`" for name in predictions.columns], reason.alias("reason"))
    return checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL")


def accept_customers(customers: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A customer without batch is a manual entry; a named batch must exist."""
    keys = batches.select("batch_id")
    rejected = (
        customers.filter(F.col("batch_id").isNotNull()).join(keys, "batch_id", "left_anti")
        .select(*[f"`{name}`" for name in customers.columns], F.lit("batch_not_found").alias("reason"))
    )
    manual = customers.filter(F.col("batch_id").isNull())
    named = customers.join(keys, "batch_id", "left_semi")
    return manual.unionByName(named), rejected


def split_known_phones(incoming: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a new phone number, rows of known customers)."""
    phones = customers.select("phone_number")
    return incoming.join(phones, "phone_number", "left_anti"), incoming.join(phones, "phone_number", "left_semi")


def check_file_hashes(hashes: DataFrame, batches: DataFrame) -> DataFrame:
    """Per hash: does a batch exist, which one, and its status."""
    known = batches.select("file_hash", "batch_id", "status")
    return hashes.join(known, "file_hash", "left").select(
        "file_hash", F.col("batch_id").isNotNull().alias("exists"), "batch_id", "status"
    )


def _latest(df: DataFrame, order_by: list) -> DataFrame:
    """Newest row per customer. Only each task's best row per customer is shuffled."""
    newest = Window.partitionBy("customer_id").orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


def latest_campaign(campaigns: DataFrame) -> DataFrame:
    return _latest(campaigns, [F.col("created_at").desc_nulls_last(), F.col("campaign_id").desc()])


def latest_prediction(predictions: DataFrame) -> DataFrame:
    return _latest(predictions, [F.col("predicted_at").desc_nulls_last(), F.col("prediction_id").desc()])


def customer_overview(customers: DataFrame, campaigns: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each customer with the newest campaign row and the newest prediction."""
    last_campaign = latest_campaign(campaigns.select("customer_id", "campaign_id", "created_at", *S.CAMPAIGN_FIELDS))
    last_prediction = latest_prediction(
        predictions.select("customer_id", "prediction_id", "predicted_at", "prediction", "probability")
    )
    return (
        customers.drop("created_at", "updated_at")
        .join(last_campaign.drop("created_at"), "customer_id", "left")
        .join(last_prediction.drop("predicted_at"), "customer_id", "left")
    )


def model_input(customers: DataFrame, campaigns: DataFrame) -> DataFrame:
    """The 15 features per customer with campaign data, from the newest campaign row."""
    last = latest_campaign(campaigns.select("customer_id", "campaign_id", "created_at", *S.CAMPAIGN_FIELDS))
    return (
        customers.select("customer_id", *[f"`{c}`" for c in S.CUSTOMER_FIELDS])
        .join(last.drop("created_at", "campaign_id"), "customer_id")
    )


def predictions_with_job(predictions: DataFrame, customers: DataFrame) -> DataFrame:
    return predictions.join(customers.select("customer_id", "job"), "customer_id")


# --- Aggregates ----------------------------------------------------------------------------

def _kpi_aggregates() -> list:
    p = F.col("probability")
    return [
        F.count("*").alias("customers_scored"),
        F.count_if("subscribed").alias("predicted_subscribers"),
        F.count_if(p >= S.HIGH_PRIORITY).alias("high_priority"),
        F.count_if((p >= S.MEDIUM_PRIORITY) & (p < S.HIGH_PRIORITY)).alias("medium_priority"),
        F.count_if(p < S.MEDIUM_PRIORITY).alias("low_priority"),
    ]


def _with_rate(kpis: DataFrame) -> DataFrame:
    rate = X.safe_ratio(F.col("predicted_subscribers"), F.col("customers_scored"))
    return kpis.withColumn("subscription_rate", rate)


def batch_kpis(batches: DataFrame, customers: DataFrame, flagged: DataFrame) -> DataFrame:
    """KPIs of every batch; a batch without results shows zeros. ``flagged`` has the flag columns."""
    per_customer = flagged.groupBy("customer_id").agg(*_kpi_aggregates())
    per_batch = (
        customers.filter(F.col("batch_id").isNotNull()).select("customer_id", "batch_id")
        .join(per_customer, "customer_id")
        .groupBy("batch_id").agg(*[F.sum(name).alias(name) for name in KPI_NAMES])
    )
    filled = batches.select("batch_id").join(per_batch, "batch_id", "left").na.fill(0, KPI_NAMES)
    return _with_rate(filled)


def campaign_kpis(flagged: DataFrame) -> DataFrame:
    return _with_rate(flagged.agg(*_kpi_aggregates()))


def rate_by_job(flagged: DataFrame, customers: DataFrame) -> DataFrame:
    """Predicted subscription rate per job in percent, one place."""
    per_customer = flagged.groupBy("customer_id").agg(
        F.count("*").alias("n"), F.count_if("subscribed").alias("yes")
    )
    return (
        customers.filter(F.col("job").isNotNull()).select("customer_id", "job").join(per_customer, "customer_id")
        .groupBy("job").agg(X.percent(F.sum("yes") / F.sum("n")).alias("subscription_rate_pct"))
    )


def priority_distribution(flagged: DataFrame) -> DataFrame:
    """Four rows in fixed order, zero-filled."""
    counts = flagged.agg(*[F.count_if(F.col("priority") == tier).alias(tier) for tier in S.PRIORITIES])
    order = F.lit(0)
    for place, tier in enumerate(S.PRIORITIES):
        order = F.when(F.col("priority") == tier, place).otherwise(order)
    return (
        counts.unpivot([], S.PRIORITIES, "priority", "customers")
        .withColumn("campaign_priority", X.priority_label(F.col("priority")))
        .withColumn("place", order).orderBy("place")
    )


def probability_histogram(flagged: DataFrame) -> DataFrame:
    """Predictions per whole percent, missing probabilities left out."""
    return (
        flagged.filter(F.col("probability").isNotNull())
        .groupBy(X.percent(F.col("probability"), 0).alias("probability_pct"))
        .agg(F.count("*").alias("predictions"))
        .orderBy("probability_pct")
    )


def outcome_counts(flagged: DataFrame) -> DataFrame:
    names = ["Predicted Subscribe", "Predicted No Subscribe"]
    counts = flagged.agg(
        F.count_if("subscribed").alias(names[0]), F.count_if(~F.col("subscribed")).alias(names[1])
    )
    return counts.unpivot([], names, "outcome", "customers")


# --- Order ---------------------------------------------------------------------------------

def _order(kind: str, tiebreak: str) -> list:
    p = F.col("probability")
    orders = {
        "priority": [X.priority_rank(p), p.desc_nulls_last()],
        "highest": [p.desc_nulls_last()],
        "lowest": [p.asc_nulls_last()],
    }
    return [*orders[kind], F.col(tiebreak)]


def sort_results(results: DataFrame, kind: str, tiebreak: str = "prediction_id") -> DataFrame:
    """``priority``, ``highest`` or ``lowest`` first; a distributed range sort."""
    return results.orderBy(*_order(kind, tiebreak))


def number_results(results: DataFrame, kind: str, tiebreak: str = "prediction_id") -> DataFrame:
    """The same orders with the global ``position`` as a column."""
    return with_positions(results, _order(kind, tiebreak))


def recent_predictions(predictions: DataFrame, rows: int = 10) -> DataFrame:
    return predictions.orderBy(F.col("predicted_at").desc_nulls_last(), F.col("prediction_id").desc()).limit(rows)
