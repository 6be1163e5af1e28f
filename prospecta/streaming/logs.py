"""Log ingest, running metrics and retention as streams.

Each micro-batch writes the folder of its own number and overwrites it on a replay, so a batch that
runs twice after a failure leaves the same rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prospecta import schemas as S
from prospecta.functions import validation as V
from prospecta.functions.hashing import row_key
from prospecta.operators import logs
from prospecta.operators.ranking import with_positions
from prospecta.session import materialise

#: Where a record came from, as far as the stream tells: with the line, the order of arrival.
ARRIVAL = ("_file_time", "_file_path", "_file_block")


def json_log_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Log records with the file and block that each came from."""
    arriving = spark.readStream.schema(S.RAW_LOGS).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return arriving.select(
        "*", F.col("_metadata.file_modification_time").alias("_file_time"),
        F.col("_metadata.file_path").alias("_file_path"), F.col("_metadata.file_block_start").alias("_file_block"))


def _last_id(spark: SparkSession, path: str, epoch: int) -> int:
    """The largest id given before a batch, from the mark that the batch before has left."""
    if epoch == 0:
        return 0
    return spark.read.schema("last_id bigint").parquet(f"{path}/marks/epoch={epoch - 1}").first()["last_id"]


def _drop_generations(spark: SparkSession, path: str, before: int) -> None:
    """Generations older than that go; their readers have had the time of a whole generation to switch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/logs")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in system.listStatus(folder):
        name, _, number = found.getPath().getName().partition("=")
        if name == "generation" and int(number) < before:
            system.delete(found.getPath(), True)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The log table as it stands: the newest generation."""
    table = spark.read.parquet(f"{path}/logs")
    newest = table.agg(F.max("generation")).scalar()
    return table.filter(F.col("generation") == newest).drop("generation", "epoch")


def _earlier(spark: SparkSession, path: str, generation: int, epoch: int) -> DataFrame | None:
    try:
        table = spark.read.parquet(f"{path}/logs")
    except AnalysisException:
        return None
    return table.filter((F.col("generation") == generation) & (F.col("epoch") < epoch)).drop("generation", "epoch")


def start_ingest(
    stream: DataFrame, path: str, checkpoint: str, keep: int = S.LOG_RETENTION_DEFAULT,
    retain_every: int | None = None, available_now: bool = False,
) -> StreamingQuery:
    """Normalise, validate and append log records; bad ones go to ``quarantine``.

    Ids go on from the last batch in order of arrival: time of the file, its path, the place in it. A stream without
    the ``ARRIVAL`` columns is numbered by its contents. With ``retain_every`` a new generation starts every that
    many batches: it begins with the newest ``keep`` rows so far, readers switch to it, and the generations
    before the previous one are deleted.
    """
    rules = V.log_rules()

    def generation_of(epoch: int) -> int:
        return epoch // retain_every * retain_every if retain_every else 0

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        generation = generation_of(epoch)
        if "timestamp" not in batch.columns:
            batch = batch.withColumn("timestamp", F.current_timestamp())
        given = "log_id" in batch.columns
        # The source is parsed once; within a block, the running number follows the lines.
        batch = materialise(batch.withColumn("_line", F.monotonically_increasing_id()))
        good, bad = V.split_valid(batch, rules)
        bad = bad.drop("_line", *ARRIVAL)
        if not given:
            if set(ARRIVAL) <= set(batch.columns):
                order = [*ARRIVAL, "_line"]
            else:
                good = good.withColumn(
                    "_key", row_key(good, [c for c in good.columns if c not in ("timestamp", "_line")], epoch))
                order = ["_key", "_line"]
            start = _last_id(spark, path, epoch)
            good = with_positions(good, [F.col(c) for c in order], "_place").withColumn("log_id", F.col("_place") + F.lit(start))
            last = good.agg(F.max("log_id").alias("last_id"))
            last = last.select(F.coalesce("last_id", F.lit(start)).cast("long").alias("last_id"))
            last.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/epoch={epoch}")
        rows = logs.stored_logs(good)
        before = _earlier(spark, path, generation_of(epoch - 1), epoch) if epoch and generation == epoch else None
        if before is not None:
            rows = logs.retain(before.select(*rows.columns).unionByName(rows), keep)
        rows.write.mode("overwrite").parquet(f"{path}/logs/generation={generation}/epoch={epoch}")
        bad.write.mode("overwrite").parquet(f"{path}/quarantine/epoch={epoch}")
        if before is not None:
            _drop_generations(spark, path, generation_of(epoch - 1))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_metrics(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Running metrics; the state is one row per service, so no watermark is needed."""
    level = F.col("level")
    running = logs.normalise(stream).groupBy("service").agg(
        F.count("*").alias("total_logs"),
        F.count_if(level.isin("ERROR", "CRITICAL")).alias("errors"),
        F.count_if(level == "WARNING").alias("warnings"),
        F.sum("response_time_ms").alias("response_sum"),
        F.count("response_time_ms").alias("response_count"),
        F.max("response_time_ms").alias("response_max"),
    )

    def write(batch: DataFrame, epoch: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = running.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _newest_metrics(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(path)
    return table.filter(F.col("epoch") == table.agg(F.max("epoch")).scalar()).drop("epoch")


def metrics_by_service(spark: SparkSession, path: str) -> DataFrame:
    return _newest_metrics(spark, path).select(
        "service", "total_logs", "errors",
        F.try_divide("response_sum", "response_count").alias("average_response_time_ms"),
    ).orderBy("service")


def metrics_totals(spark: SparkSession, path: str) -> DataFrame:
    return _newest_metrics(spark, path).agg(
        F.coalesce(F.sum("total_logs"), F.lit(0)).alias("total_logs"),
        F.sum("errors").alias("total_errors"),
        F.sum("warnings").alias("total_warnings"),
        F.try_divide(F.sum("response_sum"), F.sum("response_count")).alias("average_response_time_ms"),
        F.max("response_max").alias("maximum_response_time_ms"),
    )
