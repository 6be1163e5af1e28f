"""The campaign tables as Parquet folders with a ledger of commits.

A commit writes new table states and added rows to fresh folders and then enters them in the ledger,
itself a Parquet folder that only grows. Readers take the newest full state of a table and the rows
added since. A path that is being read is never overwritten, a failed write leaves no trace, and the
changes of one commit become visible together. One writer at a time is assumed.

Additions are folded as they come in: ``fold`` of one level become one folder of the next level, so a row is rewritten once
a level and a table has at most ``fold - 1`` folders a level, however many commits it has seen.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from prospecta import schemas as S

_LEDGER = T.StructType([
    T.StructField("commit", T.LongType()),
    T.StructField("table", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("full", T.BooleanType()),
    # A folded entry holds what the commits from ``since`` to ``until`` have added; a plain one what its own commit has.
    T.StructField("level", T.IntegerType()),
    T.StructField("since", T.LongType()),
    T.StructField("until", T.LongType()),
])
FOLD = 32


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns and types of the table schema; columns the frame lacks become NULL."""
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in S.TABLES[table].fields
    ])


class TableStore:
    def __init__(self, spark: SparkSession, root: str, fold: int = FOLD) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.fold = fold

    def _ledger(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LEDGER).parquet(f"{self.root}/_ledger")
        except AnalysisException:
            return self.spark.createDataFrame([], _LEDGER)

    def _parts(self, table: str) -> list[Row]:
        """Entries of the current state: the newest full one, and of those added since the ones that no other has taken in."""
        entries = self._ledger().filter(F.col("table") == table).fillna({"level": 0}).withColumns(
            {name: F.coalesce(name, "commit") for name in ("since", "until")})
        newest = entries.filter("full").agg(F.coalesce(F.max("commit"), F.lit(0))).first()[0]
        # Ranges are apart or one within the other, so one is taken in if an earlier or wider one reaches as far.
        before = Window.partitionBy("table").orderBy("since", F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
        added = entries.filter(~F.col("full") & (F.col("since") > newest)).withColumn("reached", F.max("until").over(before))
        live = added.filter(F.col("reached").isNull() | (F.col("until") > F.col("reached"))).drop("reached")
        return live.union(entries.filter(F.col("full") & (F.col("commit") == newest))).collect()

    def _paths(self, table: str) -> list[str]:
        return [row["path"] for row in self._parts(table)]

    def _next(self) -> int:
        return self._ledger().agg(F.coalesce(F.max("commit"), F.lit(0))).first()[0] + 1

    def _write(self, number: int, table: str, df: DataFrame) -> str:
        path = f"{self.root}/{table}/c{number:08d}-{uuid.uuid4().hex[:8]}"
        df.write.mode("errorifexists").parquet(path)
        return path

    def _enter(self, entries: list[tuple]) -> None:
        self.spark.createDataFrame(entries, _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.root}/_ledger")

    def _fold(self, table: str) -> None:
        """Makes one folder of the additions of a level where there are ``fold``, from the lowest level up."""
        level = 0
        while True:
            full = [part for part in self._parts(table) if not part["full"] and part["level"] == level]
            if len(full) < self.fold:
                return
            number, level = self._next(), level + 1
            rows = self.spark.read.schema(S.TABLES[table]).parquet(*[part["path"] for part in full])
            self._enter([(number, table, self._write(number, table, rows), False, level,
                          min(part["since"] for part in full), max(part["until"] for part in full))])

    def read(self, table: str) -> DataFrame:
        paths = self._paths(table)
        if not paths:
            return self.spark.createDataFrame([], S.TABLES[table])
        return self.spark.read.schema(S.TABLES[table]).parquet(*paths)

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None) -> None:
        number, entries = self._next(), []
        for full, states in ((True, replace or {}), (False, append or {})):
            for table, df in states.items():
                entries.append((number, table, self._write(number, table, conform(df, table)), full, 0, number, number))
        self._enter(entries)
        for table in append or {}:
            self._fold(table)

    def compact(self, table: str) -> None:
        """Rewrite a table as one folder."""
        self.commit(replace={table: self.read(table)})


class Buckets:
    """A table as Parquet partitions by the hash of a key; an update reads and rewrites only the buckets that it touches.

    The number of buckets is that of the first write; choose it so that one is a comfortable task. Spark's dynamic partition
    overwrite replaces the files of the written buckets and leaves the others as they are.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, count: int = 256) -> None:
        self.spark, self.path, self.schema, self.key, self.count = spark, path, schema, key, count

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.count)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys, at most as many as there are."""
        return sorted(row["bucket"] for row in rows.select(self._bucket().alias("bucket")).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose folders alone are listed as partitions to read."""
        try:
            stored = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        return (stored if buckets is None else stored.filter(F.col("bucket").isin(buckets))).drop("bucket")

    def replace(self, rows: DataFrame) -> None:
        """Writes the new state of every bucket that ``rows`` has. ``rows`` must not be read from these files any more."""
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
