"""Scoring of customer files as they arrive, each file once by its content hash."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prospecta import schemas as S
from prospecta.functions.validation import missing_columns
from prospecta.operators.ranking import with_positions
from prospecta.plans.batch_scoring import CampaignTables, Scorer, score_uploads
from prospecta.sources.files import CHUNK_BYTES, file_hashes, read_upload_rows
from prospecta.sources.tables import TableStore

# Columns of Spark's binaryFile source; a stream has to name them.
BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def stored_tables(store: TableStore) -> CampaignTables:
    return CampaignTables(
        store.read("batch_uploads"), store.read("customers"), store.read("campaign_history"), store.read("predictions"))


def collect_uploads(spark: SparkSession, files: list[tuple[str, str, str]]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Rows of the files (path, name, hash) in input order, and the files refused with the reason.

    Each file is read by its own header: column orders may differ between files.
    """
    frames, refused = [], []
    for path, name, digest in files:
        rows = read_upload_rows(spark, path)
        missing = missing_columns(rows)
        if missing:
            refused.append((name, "missing columns: " + ", ".join(missing)))
            continue
        frames.append(rows.select(
            *[f"`{c}`" for c in S.UPLOAD_FIELDS], "block_start", "line_id",
            F.lit(name).alias("file_name"), F.lit(digest).alias("file_hash")))
    if not frames:
        return None, refused
    together = reduce(DataFrame.unionByName, frames)
    ordered = with_positions(together, [F.col(c) for c in ("file_name", "file_hash", "block_start", "line_id")])
    return ordered.drop("block_start", "line_id"), refused


def start_upload_scoring(
    spark: SparkSession, folder: str, store: TableStore, scorer: Scorer, checkpoint: str,
    clock=lambda: datetime.now(timezone.utc).replace(tzinfo=None), files_per_batch: int = 16, available_now: bool = False,
) -> StreamingQuery:
    """``folder`` receives CSV files. A replayed batch finds its hashes registered and adds nothing.

    At most ``files_per_batch`` paths reach the driver; the bytes are hashed and read by the tasks.
    """
    arrivals = (
        spark.readStream.format("binaryFile").schema(BINARY_FILES).option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")
    )

    def score(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        paths = [row["path"] for row in batch.collect()]
        if not paths:
            return
        # A file is never one value in a task, but for those of a chunk's size.
        hashed = file_hashes(session, paths, CHUNK_BYTES).withColumnRenamed("source_file", "path")
        # The same bytes under two names count once.
        once = hashed.groupBy("file_hash").agg(F.min(F.struct("file_name", "path")).alias("file"))
        fresh = once.join(store.read("batch_uploads").select("file_hash"), "file_hash", "left_anti")
        files = [(r["file"]["path"], r["file"]["file_name"], r["file_hash"]) for r in fresh.orderBy("file").collect()]
        rows, refused = collect_uploads(session, files)
        if refused:
            session.createDataFrame(refused, "file_name string, reason string").coalesce(1).write.mode(
                "overwrite").parquet(f"{store.root}/refused_files/epoch={epoch}")
        if rows is None:
            return
        outcome = score_uploads(stored_tables(store), rows, scorer, clock(), strict=False)
        outcome.quarantine.write.mode("overwrite").parquet(f"{store.root}/quarantine/epoch={epoch}")
        store.commit(**outcome.changes())

    writer = arrivals.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
