"""Table maintenance. Every operator returns the new table state; writers store it as a new version."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta import schemas as S
from prospecta.operators.ranking import with_positions
from prospecta.session import materialise


def _last_set(name: str) -> Column:
    """Last value given for a field, in input order."""
    column = F.col(f"`{name}`")
    return F.max_by(column, F.when(column.isNotNull(), F.col("position"))).alias(name)


def next_id(df: DataFrame, key: str) -> Column:
    """Largest id so far, 0 for an empty table, as a scalar subquery."""
    return df.agg(F.coalesce(F.max(key), F.lit(0))).scalar()


def upsert_customers(
    customers: DataFrame, incoming: DataFrame, now: datetime, high: int | None = None
) -> DataFrame:
    """Insert new phone numbers, update given fields of known ones.

    ``high`` is the largest customer_id there is, where ``customers`` are not all of them (the touched buckets).

    ``incoming`` carries ``position``, its input order: the last given value of a field wins, while
    the batch of the first row stays. Rows of one phone number are folded by an aggregate, so a
    number that repeats without end is reduced before the shuffle.
    """
    clock = F.lit(now)
    folded = incoming.groupBy("phone_number").agg(
        F.min_by("batch_id", "position").alias("batch_id"),
        F.min("position").alias("_first"),
        *[_last_set(name) for name in S.CUSTOMER_FIELDS],
    )
    new_values = folded.select(
        "phone_number", "_first", F.col("batch_id").alias("_new_batch_id"),
        *[F.col(f"`{name}`").alias(f"_new_{name}") for name in S.CUSTOMER_FIELDS],
    )
    # Phone numbers are unique on both sides. Written once: the known rows are final, the new ones
    # are read again to be numbered.
    merged = materialise(customers.join(new_values, "phone_number", "full_outer").select(
        "customer_id", "phone_number", "batch_id", "_new_batch_id", "_first",
        *[F.coalesce(f"_new_{name}", f"`{name}`").alias(name) for name in S.CUSTOMER_FIELDS],
        "prediction_status", "created_at", "updated_at",
    ))
    updated = merged.filter(F.col("customer_id").isNotNull()).withColumn(
        "updated_at", F.when(F.col("_first").isNotNull(), clock).otherwise(F.col("updated_at"))
    ).drop("_new_batch_id", "_first")
    fresh = merged.filter(F.col("customer_id").isNull())
    inserted = with_positions(fresh, [F.col("_first"), F.col("phone_number")], "_place").select(
        (F.col("_place") + (next_id(updated, "customer_id") if high is None else F.lit(high))).alias("customer_id"),
        "phone_number", F.col("_new_batch_id").alias("batch_id"), *[f"`{name}`" for name in S.CUSTOMER_FIELDS],
        F.lit("PENDING").alias("prediction_status"), clock.alias("created_at"), clock.alias("updated_at"),
    )
    return updated.unionByName(inserted)


def patch_customers(customers: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """Partial update. ``changes``: customer_id, position, ``fields`` map<string,string>.

    A key that is present with a NULL value sets the field to NULL; an absent key leaves it alone.
    """
    patchable = ["phone_number", *S.CUSTOMER_FIELDS]

    def last_change(name: str) -> Column:
        given = F.map_contains_key("fields", name)
        return F.max_by(F.struct(F.element_at("fields", F.lit(name)).alias("value")), F.when(given, F.col("position")))

    folded = changes.groupBy("customer_id").agg(*[last_change(name).alias(f"_set_{name}") for name in patchable])
    joined = customers.join(folded.withColumn("_hit", F.lit(True)), "customer_id", "left")

    def applied(name: str) -> Column:
        old = F.col(f"`{name}`")
        change = F.col(f"`_set_{name}`")
        value = change["value"].cast(customers.schema[name].dataType)
        return F.when(change.isNotNull(), value).otherwise(old).alias(name)

    columns = []
    for name in customers.columns:
        if name in patchable:
            columns.append(applied(name))
        elif name == "updated_at":
            columns.append(F.when(F.col("_hit"), F.lit(now)).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(f"`{name}`"))
    return joined.select(*columns)


def delete_customers(
    doomed: DataFrame, customers: DataFrame, campaigns: DataFrame, predictions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the given customers and their rows."""
    keys = doomed.select("customer_id").distinct()
    return tuple(df.join(keys, "customer_id", "left_anti") for df in (customers, campaigns, predictions))


def register_batches(batches: DataFrame, uploads: DataFrame, now: datetime) -> DataFrame:
    """Append uploads whose content hash is new, once each; ``uploads``: file_hash, file_name,
    total_records, position."""
    once = uploads.groupBy("file_hash").agg(
        F.min_by("file_name", "position").alias("file_name"),
        F.min_by("total_records", "position").alias("total_records"),
        F.min("position").alias("_first"),
    )
    fresh = once.join(batches.select("file_hash"), "file_hash", "left_anti")
    clock = F.lit(now)
    added = with_positions(fresh, [F.col("_first"), F.col("file_hash")], "_place").select(
        (F.col("_place") + next_id(batches, "batch_id")).alias("batch_id"),
        "file_name", "total_records", "file_hash",
        F.lit("pending").alias("status"), clock.alias("created_at"), clock.alias("uploaded_at"),
    )
    return batches.select(*added.columns).unionByName(added)


def batch_headers(headers: DataFrame, records: DataFrame) -> DataFrame:
    """Fill a header from its records: their number, and a default file name."""
    counts = records.groupBy("batch_id").agg(F.count("*").alias("_records"))
    # Defaults apply only where records came with the header.
    has_records = F.col("_records").isNotNull()
    return headers.join(counts, "batch_id", "left").withColumns({
        "total_records": F.coalesce(F.col("total_records"), F.col("_records")),
        "file_name": F.coalesce(F.col("file_name"), F.when(has_records, F.lit(S.DEFAULT_FILE_NAME))),
    }).drop("_records")


def insert_defaults(df: DataFrame, table: str, now: datetime) -> DataFrame:
    """Column defaults on insert. The clock is a parameter, so a re-run gives the same rows."""
    clock = F.lit(now)
    defaults = {
        "customers": {"prediction_status": F.lit("PENDING"), "created_at": clock, "updated_at": clock},
        "campaign_history": {"created_at": clock, "updated_at": clock},
        "predictions": {"predicted_at": clock},
        "batch_uploads": {"status": F.lit("pending"), "created_at": clock, "uploaded_at": clock},
    }[table]
    return df.withColumns({
        name: F.coalesce(F.col(name), value) if name in df.columns else value for name, value in defaults.items()
    })


def completed_status(customers: DataFrame, predictions: DataFrame) -> DataFrame:
    """COMPLETED for customers with a stored prediction."""
    scored = predictions.select("customer_id").distinct().withColumn("_scored", F.lit(True))
    status = F.when(F.col("_scored"), "COMPLETED").otherwise(F.col("prediction_status"))
    return customers.join(scored, "customer_id", "left").withColumn("prediction_status", status).drop("_scored")


def rows_to_resume(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Only the rows of a batch that have no stored prediction yet."""
    return rows.join(predictions.select("customer_id").distinct(), "customer_id", "left_anti")


# Old column names of earlier table layouts.
RENAMED = {
    "phone_no": "phone_number",
    "credit_default": "default",
    "housing_loan": "housing",
    "personal_loan": "loan",
}


def migrate_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RENAMED)


def migrate_batches(batches: DataFrame, now: datetime) -> DataFrame:
    """Add missing columns with their defaults; take the hash from the old column where it is empty."""
    clock = F.lit(now)
    for name, default in (
        ("file_hash", F.lit(None).cast("string")), ("status", F.lit("pending")), ("created_at", clock)
    ):
        if name not in batches.columns:
            batches = batches.withColumn(name, default)
    if "content_hash" in batches.columns:
        batches = batches.withColumn("file_hash", F.coalesce("file_hash", "content_hash"))
    return batches
