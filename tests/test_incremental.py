"""Batches scored on marks instead of the history, and customers kept in buckets."""

import pathlib

from pyspark.sql import functions as F

from prospecta import schemas as S
from prospecta.operators import maintain
from prospecta.plans.batch_scoring import CampaignTables, Marks, score_uploads
from prospecta.sources.tables import Buckets, conform
from tests.test_operators import LATER, NOW, score, tables, upload


def rows_of(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())


def test_a_second_batch_reads_no_history(spark, tmp_path):
    """Same ids and states as from the whole tables, over two batches; plans of the second name none of the history's files."""
    whole = stored = tables(spark)
    stored.marks = Marks.of(stored)
    for number in (1, 2):
        uploads = upload(spark, "90000001", "90000002", f"9100000{number}", f"9200000{number}").withColumns(
            {"file_hash": F.lit(f"{number}" * 64), "file_name": F.lit(f"{number}.csv")})
        expected = score_uploads(CampaignTables(whole.batches, whole.customers, whole.campaigns, whole.predictions), uploads, score, LATER)
        # The history as files, so that a plan that reads it names them.
        history = tmp_path / f"history-{number}"
        for name in ("campaigns", "predictions"):
            getattr(stored, name).write.parquet(str(history / name))
            setattr(stored, name, spark.read.parquet(str(history / name)))
        found = score_uploads(stored, uploads, score, LATER)
        for made in (found.new_campaigns, found.new_predictions, found.tables.batches, found.tables.customers, found.tables.marks.counts):
            assert "history" not in made._jdf.queryExecution().toString()
        assert rows_of(found.new_predictions, "prediction_id", "customer_id") == rows_of(expected.new_predictions, "prediction_id", "customer_id")
        assert rows_of(found.new_campaigns, "campaign_id", "customer_id") == rows_of(expected.new_campaigns, "campaign_id", "customer_id")
        assert rows_of(found.tables.batches, "batch_id", "status") == rows_of(expected.tables.batches, "batch_id", "status")
        fresh = Marks.of(found.tables)
        assert fresh.highs == found.tables.marks.highs
        assert rows_of(fresh.counts, "batch_id", "customers", "predictions") == rows_of(
            found.tables.marks.counts, "batch_id", "customers", "predictions")
        whole, stored = expected.tables, found.tables


def test_upsert_rewrites_touched_buckets_alone(spark, tmp_path):
    """Files of untouched buckets keep their names; the table equals a plain upsert of all customers."""
    path = tmp_path / "customers"
    store = Buckets(spark, str(path), S.CUSTOMERS, "phone_number", 16)
    assert store.read().count() == 0
    people = tables(spark).customers
    first = people.limit(1).crossJoin(spark.range(200).withColumnRenamed("id", "i")).withColumns({
        "customer_id": F.col("i") + 1, "phone_number": (F.col("i") + 95000000).cast("string")}).drop("i")
    store.replace(conform(first, "customers"))
    before = {str(file.relative_to(path)) for file in path.rglob("*.parquet")}
    incoming = spark.createDataFrame([(1, "95000007", 41), (2, "97777777", 42)], "position long, phone_number string, age int").withColumns(
        {"batch_id": F.lit(3).cast("long"), **{name: F.lit(None).cast(S.CUSTOMERS[name].dataType) for name in S.CUSTOMER_FIELDS if name != "age"}})
    touched = store.touched(incoming)
    part = store.read(touched)
    assert len(touched) <= 2 and part.count() < 60
    assert "PartitionFilters: [isnotnull(bucket" in part._jdf.queryExecution().toString() or "bucket" in part._jdf.queryExecution().toString()
    store.replace(conform(maintain.upsert_customers(part, incoming, NOW, high=200), "customers"))
    after = {str(file.relative_to(path)) for file in path.rglob("*.parquet")}
    folders = {f"bucket={bucket}" for bucket in touched}
    assert {name for name in before if name.split("/")[0] not in folders} == {name for name in after if name.split("/")[0] not in folders}
    expected = maintain.upsert_customers(first, incoming, NOW)
    assert rows_of(store.read(), "customer_id", "phone_number", "age") == rows_of(expected, "customer_id", "phone_number", "age")
    assert store.read().count() == 201
