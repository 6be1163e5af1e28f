"""Scoring of uploaded customer files as one job.

Validate, register the file, upsert customers, append campaign rows and predictions, recompute the
states. Nothing is written here: the caller stores the returned tables together, after the whole
batch has succeeded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta import schemas as S
from prospecta.functions import scalars as X
from prospecta.functions import validation as V
from prospecta.operators import campaign, maintain
from prospecta.session import materialise
from prospecta.sources.files import check_upload_header

Scorer = Callable[[DataFrame], DataFrame]


IDS = {"batches": "batch_id", "customers": "customer_id", "campaigns": "campaign_id", "predictions": "prediction_id"}


@dataclass
class Marks:
    """What a batch has to know of the history without reading it: the largest id of each table, and the numbers of customers
    and predictions of each batch. Every scored batch gives the marks for the next."""

    highs: dict[str, int]
    counts: DataFrame

    @classmethod
    def of(cls, tables: CampaignTables) -> Marks:
        """From the whole tables, once."""
        highs = {name: getattr(tables, name).agg(F.coalesce(F.max(key), F.lit(0))).first()[0] for name, key in IDS.items()}
        return cls(highs, materialise(campaign.batch_counts(tables.customers, tables.predictions)))

    def after(self, batches: DataFrame, customers: DataFrame, campaigns: DataFrame, predictions: DataFrame) -> Marks:
        """The marks once the given rows are stored: touched ``customers``, and new rows of the other tables."""
        homes = customers.filter(F.col("batch_id").isNotNull()).select("customer_id", "batch_id")
        new = homes.filter(F.col("customer_id") > self.highs["customers"]).select(
            "batch_id", F.lit(1).alias("customers"), F.lit(0).alias("predictions"))
        scored = predictions.select("customer_id").join(homes, "customer_id").select(
            "batch_id", F.lit(0).alias("customers"), F.lit(1).alias("predictions"))
        counts = materialise(self.counts.unionByName(new).unionByName(scored).groupBy("batch_id").agg(
            F.sum("customers").alias("customers"), F.sum("predictions").alias("predictions")))
        rows = {"batches": batches, "customers": customers, "campaigns": campaigns, "predictions": predictions}
        tops = {name: df.agg(F.max(IDS[name])).first()[0] or 0 for name, df in rows.items()}
        return Marks({name: max(high, tops[name]) for name, high in self.highs.items()}, counts)


@dataclass
class CampaignTables:
    """``marks`` come from the batch before; with them no history is read, and ``customers`` may be the touched buckets alone."""

    batches: DataFrame
    customers: DataFrame
    campaigns: DataFrame
    predictions: DataFrame
    marks: Marks | None = None


@dataclass
class BatchOutcome:
    tables: CampaignTables
    results: DataFrame
    quarantine: DataFrame
    new_campaigns: DataFrame
    new_predictions: DataFrame

    def changes(self) -> dict[str, dict[str, DataFrame]]:
        """Arguments of ``TableStore.commit``: history only grows, so only its new rows are written."""
        return {
            "replace": {"batch_uploads": self.tables.batches, "customers": self.tables.customers},
            "append": {"campaign_history": self.new_campaigns, "predictions": self.new_predictions},
        }


def with_decision(scored: DataFrame, threshold: float, model_version: str | None) -> DataFrame:
    """Decide on the raw probability, then round it for storage."""
    p = F.col("probability")
    return (
        scored.withColumn("decision", X.decide(p, threshold))
        .withColumn("prediction", X.subscription(F.col("decision")))
        .withColumn("probability", X.stored_probability(p))
        .withColumn("model_version", F.lit(model_version))
    )


def unscored(results: DataFrame) -> DataFrame:
    """One row: how many scored rows lack a probability or a prediction."""
    incomplete = F.col("probability").isNull() | F.col("prediction").isNull()
    return results.agg(F.count_if(incomplete).alias("unscored"))


def require_scored(results: DataFrame) -> None:
    missing = unscored(results).first()["unscored"]
    if missing:
        raise ValueError(f"{missing} rows have no score; the batch is abandoned")


def score_uploads(
    tables: CampaignTables,
    uploads: DataFrame,
    scorer: Scorer,
    now: datetime,
    threshold: float = S.DECISION_THRESHOLD,
    model_version: str | None = S.MODEL_VERSION,
    strict: bool = True,
) -> BatchOutcome:
    """``uploads``: text columns, ``position`` (unique input order from 1), ``file_hash`` and ``file_name``.
    New campaign and prediction ids are the largest old id plus the position.

    ``strict`` abandons the job on the first kind of invalid row; otherwise those rows are returned in
    ``quarantine`` and the rest is scored. Files whose hash is known are left out.
    """
    check_upload_header(uploads)
    headers = uploads.groupBy("file_hash").agg(
        F.min("position").alias("position"),
        F.min("file_name").alias("file_name"),
        F.count("*").cast("int").alias("total_records"),
    )
    batches = maintain.register_batches(tables.batches, headers, now)
    # One row per new file; the join drops the rows of known files and brings the batch id.
    new_files = batches.join(tables.batches.select("file_hash"), "file_hash", "left_anti").select("file_hash", "batch_id")
    # Parsed and typed once; the checks, the upsert and the scoring read this table.
    records = materialise(V.typed_upload(uploads).join(new_files, "file_hash"))
    valid, quarantine = V.split_valid(records, V.customer_rules())
    if strict:
        checks = V.upload_checks(records).first()
        if checks["verdict"] != "ok":
            raise ValueError(f"upload rejected: {checks['verdict']}")
        broken = quarantine.agg(F.count("*")).first()[0]
        if broken:
            raise ValueError(f"upload rejected: {broken} invalid rows")

    # Written once: every table below sees the same customer numbers and the same scores.
    marks = tables.marks
    upserted = materialise(maintain.upsert_customers(
        tables.customers, valid, now, None if marks is None else marks.highs["customers"]))
    scored = with_decision(scorer(valid), threshold, model_version)
    results = materialise(scored.join(upserted.select("customer_id", "phone_number"), "phone_number"))
    require_scored(results)

    def high(name: str) -> Column:
        return maintain.next_id(getattr(tables, name), IDS[name]) if marks is None else F.lit(marks.highs[name])

    new_campaigns = results.select(
        (F.col("position") + high("campaigns")).alias("campaign_id"), "customer_id",
        *S.CAMPAIGN_FIELDS, F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )
    new_predictions = results.select(
        (F.col("position") + high("predictions")).alias("prediction_id"), "customer_id",
        "prediction", "probability", "model_version", F.lit(now).alias("predicted_at"),
    )
    campaigns = tables.campaigns.unionByName(new_campaigns, allowMissingColumns=True)
    predictions = tables.predictions.unionByName(new_predictions, allowMissingColumns=True)
    # Earlier rows already carry their status, so only the new predictions can change it.
    customers = maintain.completed_status(upserted, new_predictions)
    if marks is None:
        batches = campaign.batch_status(batches, customers, predictions)
    else:
        marks = marks.after(batches, upserted, new_campaigns, new_predictions)
        batches = campaign.status_of_counts(batches, marks.counts)
    states = CampaignTables(batches, customers, campaigns, predictions, marks)
    return BatchOutcome(states, results, quarantine, new_campaigns, new_predictions)
