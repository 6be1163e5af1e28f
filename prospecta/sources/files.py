"""CSV and JSON files in and out. Schemas are always given, never inferred."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta import schemas as S

# Tasks get the helpers of this module with the function, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Paths of stores that a task can open by itself.
DIRECT = r"\A(file|s3|s3a|s3n|gs|hdfs|abfs|abfss):"
#: Bytes read at a time for a header, and for a digest; files beyond the last are streamed.
HEADER_BYTES, CHUNK_BYTES, WHOLE_BYTES = 4096, 8 << 20, 256 << 20

# Spark's writer strips white space from values unless told not to.
_KEEP_BLANKS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Training rows; a file whose header has other names or another order is an error, not misread."""
    return spark.read.schema(S.RAW_TRAINING).option("header", True).option("enforceSchema", False).csv(path)


def _file_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) of every file; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _opened(path: str) -> pa.NativeFile:
    """A stream of the file's bytes, in a task."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"), compression=None)
    system, place = fs.FileSystem.from_uri(re.sub(r"\As3[an]:", "s3:", path))
    return system.open_input_stream(place, compression=None)


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        headers = []
        for path in batch["path"]:
            line = b""
            with _opened(path) as stream:
                while b"\n" not in line and (part := stream.read(HEADER_BYTES)):
                    line += part
            headers.append(line.partition(b"\n")[0].decode("utf-8", "replace").rstrip("\r"))
        yield pd.DataFrame({"file": batch["path"], "header": headers})


def _files_by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files of a folder, those with the same header line together. Tasks open each file and read its first line alone;
    in a store that only Spark opens, its lines are read instead."""
    listed = _file_list(spark, path)
    if listed.filter(~F.col("path").rlike(DIRECT)).isEmpty():
        headers = listed.mapInPandas(_first_lines, "file string, header string")
    else:
        lines = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"), "value")
        headers = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in headers.orderBy("file").toLocalIterator():  # as many as the files that the driver lists anyway
        groups.setdefault(row["header"], []).append(unquote(row["file"]))
    return list(groups.values())


def read_upload_csv(spark: SparkSession, path: str) -> DataFrame:
    """Customer files as text columns, with the file each row came from.

    Columns are matched by header name in each file, so their order is free. A column that all files lack shows
    up as missing, and ``check_upload_header`` reports it; one that only some lack is NULL in their rows.
    """
    def read(paths: str | list[str]) -> DataFrame:
        raw = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(paths)
        return raw.select("*", F.col("_metadata.file_path").alias("source_file"))

    groups = _files_by_header(spark, path)
    if len(groups) < 2:
        return read(path)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(read, groups))


def read_upload_rows(spark: SparkSession, path: str) -> DataFrame:
    """One customer file with what orders its lines: the block and the running number in it."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).select(
        "*", F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("line_id"))


def check_upload_header(df: DataFrame) -> None:
    missing = [name for name in S.UPLOAD_FIELDS if name not in df.columns]
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))


def read_log_json(spark: SparkSession, path: str) -> DataFrame:
    """Log records, one JSON object per line; metadata stays JSON text."""
    return spark.read.schema(S.RAW_LOGS).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Results as CSV with header, one file per partition."""
    df.write.mode("errorifexists").options(**_KEEP_BLANKS).option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report (metrics, importances) as a single CSV file. For bounded results only."""
    df.coalesce(1).write.mode("overwrite").options(**_KEEP_BLANKS).option("header", True).csv(path)


def _streamed_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            with _opened(path) as stream:
                while part := stream.read(CHUNK_BYTES):
                    digest.update(part)
            digests.append(digest.hexdigest())
        yield pd.DataFrame({"source_file": batch["path"], "file_hash": digests})


def file_hashes(spark: SparkSession, path: str | list[str], whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """SHA-256 of the bytes of every file, computed by the tasks that read them.

    Files of at most ``whole_bytes`` are read as one value. A larger one is streamed through the digest in chunks, so
    its size has no limit, where its store is one that tasks can open (``DIRECT``). Empty files are not listed.
    """
    content = spark.read.format("binaryFile").load(path)
    # Only a bare comparison of the length reaches the source; by any other filter each file is one value before it is left out.
    fits, larger = F.col("length") <= whole_bytes, F.col("length") > whole_bytes

    def hashed(files: DataFrame) -> DataFrame:
        return files.select(F.col("path").alias("source_file"), F.sha2("content", 256).alias("file_hash"))

    small = hashed(content.filter(fits))
    large = _file_list(spark, path).filter(larger)
    direct = F.col("path").rlike(DIRECT)
    if not large.filter(direct).isEmpty():
        # One file is one task's work; the files of a folder are dealt to all tasks.
        dealt = large.filter(direct).repartition(spark.sparkContext.defaultParallelism, "path")
        small = small.union(dealt.mapInPandas(_streamed_hashes, "source_file string, file_hash string"))
    if not large.filter(~direct).isEmpty():
        small = small.union(hashed(content.filter(larger & ~direct)))
    return small.withColumn("file_name", F.element_at(F.split("source_file", "/"), -1)).select(
        "source_file", "file_name", "file_hash")
