"""Files written and read back, versioned tables, and streams run until their input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospecta import schemas as S
from prospecta.operators import campaign, logs, maintain
from prospecta.learn import evaluate
from prospecta.session import scratch_path
from prospecta.sources import files
from prospecta.sources.tables import TableStore
from prospecta.streaming import logs as log_streams
from prospecta.streaming import uploads as upload_streams
from prospecta.workload.fixtures import PROJECTIONS, Registry, cte, load
from prospecta.workload.operations import NORMAL_SQL, STORED, registry as operations
from prospecta.workload.relational import (
    BLANKS_SQL, CAMPAIGN_COLUMNS, CLOCK, FLAGGED, KEPT_SQL, TYPED_UPLOAD_SQL, VALID_SQL, _contacted, _kept, customers,
    flagged, registry as relational,
)
from prospecta.workload.learning import registry as learning, scored

registry = Registry()
add = registry.add

RAW_SQL = ", ".join(S.TRAINING_COLUMNS)
UPLOAD_SQL = ", ".join(f'"{c}"' for c in S.UPLOAD_FIELDS)


# --- Files ----------------------------------------------------------------------------------
@add("training_csv", cte("fx_raw_bank") + f"SELECT {RAW_SQL} FROM fx_raw_bank")
def _(spark, folder):
    path = scratch_path(spark, "training")
    files.write_csv(load(spark, folder, "fx_raw_bank"), path)
    return files.read_training_csv(spark, path)


# CSV keeps no difference between a blank and a missing value, so blanks become NULL.
@add("upload_csv", cte("fx_upload") + f"""
SELECT {UPLOAD_SQL.replace('"phone_number"', f"nullif(trim(phone_number, {BLANKS_SQL}), '') AS phone_number")}, TRUE AS has_source FROM fx_upload""")
def _(spark, folder):
    path = scratch_path(spark, "upload")
    rows = load(spark, folder, "fx_upload")
    # Two kinds of files: the columns in order, and in reverse.
    for half, names in enumerate((S.UPLOAD_FIELDS, S.UPLOAD_FIELDS[::-1])):
        files.write_csv(rows.filter(F.col("position") % 2 == half).select(*[f"`{c}`" for c in names]), f"{path}/{half}")
    rows = files.read_upload_csv(spark, f"{path}/*")
    files.check_upload_header(rows)
    phone = F.trim("phone_number")
    return rows.withColumn("has_source", F.col("source_file").endswith(".csv")).drop("source_file").withColumn(
        "phone_number", F.when(phone != "", phone))


@add("exported_results", relational.sql["batch_results"])
def _(spark, folder):
    path = scratch_path(spark, "results")
    results = campaign.batch_results(customers(spark, folder), flagged(spark, folder), load(spark, folder, "fx_batch_uploads"))
    files.write_csv(results, path)
    return spark.read.schema(results.schema).option("header", True).csv(path)


@add("exported_metrics", learning.sql["metrics_at_threshold"])
def _(spark, folder):
    path = scratch_path(spark, "metrics")
    row = evaluate.metrics(scored(spark, folder), 0.6, "score", "label")
    report = row.withColumns({name: F.round(name, 9) for name in ("accuracy", "precision", "recall", "f1")})
    files.write_report(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


@add("json_logs", cte("fx_raw_logs", logs=NORMAL_SQL) + """
SELECT service, level, event, method, endpoint, status_code, response_time_ms, message, metadata FROM logs""")
def _(spark, folder):
    path = scratch_path(spark, "logs")
    load(spark, folder, "fx_raw_logs").select(*S.RAW_LOGS.fieldNames()).write.json(path)
    return logs.stored_logs(files.read_log_json(spark, path))


# Hashes and sizes of the files, recomputed by the reader from the lines that the files hold.
FILE_SQL = cte("fx_batch_uploads", "fx_upload", files="""
SELECT position % 8 AS part, sha256(string_agg(position || ',' || coalesce(phone_number, '') || chr(10), '' ORDER BY position)) AS file_hash,
    CAST(count(*) AS INT) AS total_records FROM fx_upload GROUP BY 1""", fresh="""
SELECT file_hash, total_records, row_number() OVER (ORDER BY file_hash) AS place FROM files
WHERE file_hash NOT IN (SELECT file_hash FROM fx_batch_uploads)""") + """
SELECT batch_id, total_records, file_hash, status FROM fx_batch_uploads UNION ALL
SELECT (SELECT max(batch_id) FROM fx_batch_uploads) + place, total_records, file_hash, 'pending' FROM fresh"""


@add("registered_files", FILE_SQL)
def _(spark, folder):
    """The upload in eight files, hashed as a whole and once more under other names by streaming; equal bytes register once."""
    path = scratch_path(spark, "uploads")
    lines = load(spark, folder, "fx_upload").select(
        F.concat(F.col("position").cast("string"), F.lit(","), F.coalesce("phone_number", F.lit(""))).alias("value"),
        (F.col("position") % 8).alias("part"), "position")
    for copy in ("a", "b"):
        lines.repartition("part").sortWithinPartitions("part", "position").select(
            "value", "part").write.partitionBy("part").text(f"{path}/{copy}")
    found = files.file_hashes(spark, f"{path}/a/*/*.txt").union(files.file_hashes(spark, f"{path}/b/*/*.txt", whole_bytes=0))
    sizes = spark.read.text(f"{path}/*/*/*.txt").groupBy(F.col("_metadata.file_path").alias("source_file")).agg(
        F.count("*").cast("int").alias("total_records"))
    plain = F.regexp_replace("source_file", "^file:/+", "/")
    # Part names are random; the order of the hashes is not.
    incoming = found.withColumn("plain", plain).join(
        sizes.select(plain.alias("plain"), "total_records"), "plain").withColumn(
        "position", F.conv(F.substring("file_hash", 1, 15), 16, 10).cast("long"))
    known = maintain.insert_defaults(load(spark, folder, "fx_batch_uploads"), "batch_uploads", CLOCK)
    return maintain.register_batches(known, incoming, CLOCK).drop("created_at", "uploaded_at", "file_name")


# --- Tables ---------------------------------------------------------------------------------
@add("appended_predictions", relational.sql["accepted_predictions"].replace(
    "SELECT * FROM flagged WHERE", "SELECT prediction_id, customer_id, prediction, probability, predicted_at FROM flagged WHERE"))
def _(spark, folder):
    """Even ids first, odd ids appended; only rows that pass the referential checks."""
    store = TableStore(spark, scratch_path(spark, "tables"))
    good, _ = campaign.accept_predictions(flagged(spark, folder), _kept(spark, folder), _contacted(spark, folder))
    store.commit(replace={"predictions": good.filter(F.col("prediction_id") % 8 == 0)})
    store.commit(append={"predictions": good.filter(F.col("prediction_id") % 8 != 0)})
    return store.read("predictions").drop("model_version")


@add("appended_campaigns", cte("fx_customers", "fx_campaign_history", **KEPT_SQL) + f"""
SELECT campaign_id, customer_id, {CAMPAIGN_COLUMNS}, created_at FROM fx_campaign_history
WHERE customer_id IN (SELECT customer_id FROM kept)""")
def _(spark, folder):
    store = TableStore(spark, scratch_path(spark, "tables"))
    good, _ = campaign.known_customers(load(spark, folder, "fx_campaign_history"), _kept(spark, folder))
    store.commit(append={"campaign_history": good})
    return store.read("campaign_history").drop("updated_at")


@add("appended_historical", relational.sql["scan_historical"])
def _(spark, folder):
    store = TableStore(spark, scratch_path(spark, "tables"))
    store.commit(append={"historical_data": relational.queries["scan_historical"](spark, folder)})
    return store.read("historical_data").drop("predicted_subscription", "prediction_probability")


# --- Streams --------------------------------------------------------------------------------
def _log_stream(spark, folder):
    """The events table as a file stream of log records."""
    fields = load(spark, folder, "events").schema
    events = spark.readStream.schema(fields).parquet(f"{folder}/events*.parquet")
    _, columns, _ = PROJECTIONS["fx_raw_logs"]
    return events.selectExpr(*[f"{text} AS `{alias}`" for alias, text in columns.items()])


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@add("streamed_logs", cte("fx_raw_logs", **STORED) + "SELECT * FROM logs")
def _(spark, folder):
    path = scratch_path(spark, "stream")
    _run(log_streams.start_ingest(_log_stream(spark, folder), path, f"{path}/checkpoint", available_now=True))
    return log_streams.read_logs(spark, path)


@add("streamed_metrics_by_service", operations.sql["log_metrics_by_service"])
def _(spark, folder):
    path = scratch_path(spark, "stream")
    _run(log_streams.start_metrics(_log_stream(spark, folder), f"{path}/metrics", f"{path}/checkpoint", available_now=True))
    metrics = log_streams.metrics_by_service(spark, f"{path}/metrics")
    return metrics.withColumn("average_response_time_ms", F.round("average_response_time_ms", 6))


@add("streamed_metrics_totals", operations.sql["log_totals"])
def _(spark, folder):
    path = scratch_path(spark, "stream")
    _run(log_streams.start_metrics(_log_stream(spark, folder), f"{path}/metrics", f"{path}/checkpoint", available_now=True))
    totals = log_streams.metrics_totals(spark, f"{path}/metrics")
    return totals.withColumn("average_response_time_ms", F.round("average_response_time_ms", 6))


@add("streamed_retention", cte("fx_raw_logs", **STORED) + "SELECT * FROM logs ORDER BY log_id DESC LIMIT 700")
def _(spark, folder):
    """The log table in four files, one per batch; every second batch trims the table."""
    path = scratch_path(spark, "stream")
    raw = load(spark, folder, "fx_raw_logs")
    raw.repartitionByRange(4, "log_id").sortWithinPartitions("log_id").write.parquet(f"{path}/input")
    arriving = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/input")
    _run(log_streams.start_ingest(
        arriving, path, f"{path}/checkpoint", keep=700, retain_every=1, available_now=True))
    return log_streams.read_logs(spark, path)


UPLOADED_SQL = cte("fx_upload", typed=TYPED_UPLOAD_SQL) + f"""
SELECT phone_number, count(*) AS predictions, count(*) FILTER (WHERE age >= 60) AS yes
FROM typed WHERE {VALID_SQL} GROUP BY 1"""


@add("streamed_uploads", UPLOADED_SQL)
def _(spark, folder):
    """The upload in four files, two per batch, scored by a fixed rule; then the same files again."""
    path = scratch_path(spark, "stream")
    # Hash partitions: both writes must give the same bytes.
    rows = load(spark, folder, "fx_upload").repartition(4, "position").sortWithinPartitions("position")
    for target in ("arrivals/first", "arrivals/again"):
        files.write_csv(rows.select(*[f"`{c}`" for c in S.UPLOAD_FIELDS]), f"{path}/{target}")
    store = TableStore(spark, f"{path}/tables")

    def by_age(df):
        return df.withColumn("probability", F.when(F.col("age") >= 60, 0.9).otherwise(0.1))

    _run(upload_streams.start_upload_scoring(
        spark, f"{path}/arrivals/*", store, by_age, f"{path}/checkpoint", clock=lambda: CLOCK, files_per_batch=2,
        available_now=True))
    found = store.read("predictions").join(store.read("customers").select("customer_id", "phone_number"), "customer_id")
    return found.groupBy("phone_number").agg(
        F.count("*").alias("predictions"), F.count_if(F.col("prediction") == "Yes").alias("yes"))
