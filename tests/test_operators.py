import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from prospecta import schemas as S
from prospecta.operators import campaign, logs, maintain, quality
from prospecta.operators.ranking import running_totals, with_positions
from prospecta.plans.batch_scoring import CampaignTables, require_scored, score_uploads
from prospecta.sources import files

NOW = datetime(2024, 6, 1)
LATER = datetime(2024, 6, 2)


def customer_rows(spark, *rows):
    """(customer_id, phone, batch_id); the other fields are equal."""
    full = [(i, phone, batch, 30, "admin.", "single", "primary", "no", 1.0, "no", "no", "PENDING", NOW, NOW) for i, phone, batch in rows]
    return spark.createDataFrame(full, S.CUSTOMERS)


def batch_rows(spark, *rows):
    return spark.createDataFrame([(i, f"{i}.csv", total, f"{i:064x}", "pending", NOW, NOW) for i, total in rows], S.BATCH_UPLOADS)


def prediction_rows(spark, *rows):
    return spark.createDataFrame([(i, c, p, q, None, NOW) for i, c, p, q in rows], S.PREDICTIONS)


def test_positions_with_a_hot_value(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 3000).alias("p"))
    placed = with_positions(rows, [F.col("p").desc(), F.col("id")]).orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(1, 3001))
    assert [(-r["p"], r["id"]) for r in placed] == sorted((-r["p"], r["id"]) for r in placed)


def test_positions_of_nothing(spark):
    assert with_positions(spark.range(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("bounded", [True, False])
def test_running_totals_by_group(spark, bounded):
    rows = spark.range(500).select((F.col("id") % 2).alias("g"), "id", F.lit(1).alias("one"))
    totals = running_totals(rows, [F.col("id")], {"n": "one"}, by=["g"], bounded=bounded)
    assert all(r["n"] == r["id"] // 2 + 1 for r in totals.collect())


def test_batch_status_edges(spark):
    batches = batch_rows(spark, (1, 2), (2, 3), (3, 0), (4, 5))
    customers = customer_rows(spark, (1, "90000001", 1), (2, "90000002", 2), (3, "90000003", 3), (9, "90000009", None))
    predictions = prediction_rows(spark, (1, 1, "Yes", 0.9), (2, 1, "Yes", 0.9), (3, 9, "No", 0.1))
    status = {r["batch_id"]: r["status"] for r in campaign.batch_status(batches, customers, predictions).collect()}
    # Batch 1 has one customer scored twice; batch 3 announces no records; batch 4 has no customers.
    assert status == {1: "completed", 2: "processing", 3: "processing", 4: "pending"}
    distinct = campaign.batch_status(batches, customers, predictions, distinct_customers=True)
    assert {r["batch_id"]: r["status"] for r in distinct.collect()}[1] == "processing"


def test_kpis_of_an_empty_batch(spark):
    flagged = quality.with_subscription_flags(prediction_rows(spark, (1, 1, "Yes", None)))
    rows = campaign.batch_kpis(batch_rows(spark, (1, 1), (2, 1)), customer_rows(spark, (1, "90000001", 1)), flagged)
    by_batch = {r["batch_id"]: r.asDict() for r in rows.collect()}
    assert by_batch[1]["customers_scored"] == 1 and by_batch[1]["subscription_rate"] == 1.0
    assert by_batch[1]["low_priority"] == 0  # no probability, no tier
    assert by_batch[2]["customers_scored"] == 0 and by_batch[2]["subscription_rate"] == 0.0
    assert campaign.campaign_kpis(flagged.limit(0)).first()["subscription_rate"] == 0.0
    assert [r["customers"] for r in campaign.priority_distribution(flagged.limit(0)).collect()] == [0, 0, 0, 0]


def test_hot_customer(spark):
    """A third of the predictions belong to one customer; adaptive joins must not lose or repeat rows."""
    people = spark.range(1, 201).select(F.col("id").alias("customer_id"), F.format_string("9%07d", "id").alias("phone_number"),
                                        (F.col("id") % 5 + 1).alias("batch_id"), F.lit(30).alias("age"), F.lit("admin.").alias("job"))
    rows = spark.range(9000).select(
        F.col("id").alias("prediction_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 200 + 1).alias("customer_id"),
        F.when(F.col("id") % 2 == 0, "Yes").otherwise("No").alias("prediction"), ((F.col("id") % 100) / 100).alias("probability"),
        F.lit(NOW).alias("predicted_at"))
    batches = batch_rows(spark, *[(i, 10) for i in range(1, 6)])
    found = campaign.batch_results(people, rows, batches)
    assert found.count() == 9000 and found.filter("customer_id = 7").count() == rows.filter("customer_id = 7").count()
    kpis = {r["batch_id"]: r for r in campaign.batch_kpis(batches, people, quality.with_subscription_flags(rows)).collect()}
    assert sum(r["customers_scored"] for r in kpis.values()) == 9000
    assert sum(r["predicted_subscribers"] for r in kpis.values()) == 4500
    assert kpis[3]["customers_scored"] == found.filter("batch_id = 3").count() > 3000


def test_referential_checks(spark):
    customers = customer_rows(spark, (1, "90000001", 1), (2, "90000002", 7), (3, "90000003", None))
    contacts = spark.createDataFrame([(1, 1)], "campaign_id long, customer_id long")
    good, bad = campaign.accept_predictions(
        prediction_rows(spark, (1, 1, "Yes", 0.9), (2, 2, "No", 0.1), (3, 8, "No", 0.1)), customers, contacts)
    assert [r["prediction_id"] for r in good.collect()] == [1]
    assert {r["prediction_id"]: r["reason"] for r in bad.collect()} == {2: "no_campaign_data", 3: "customer_not_found"}
    good, bad = campaign.accept_customers(customers, batch_rows(spark, (1, 1)))
    assert sorted(r["customer_id"] for r in good.collect()) == [1, 3]
    assert [(r["customer_id"], r["reason"]) for r in bad.collect()] == [(2, "batch_not_found")]


def incoming(spark, *rows):
    schema = "position long, phone_number string, batch_id long, age int, job string"
    filled = spark.createDataFrame(list(rows), schema)
    return filled.withColumns({
        "marital": F.lit("single"), "education": F.lit("primary"), "default": F.lit("no"), "balance": F.lit(5.0),
        "housing": F.lit("no"), "loan": F.lit("no")})


def test_upsert(spark):
    customers = customer_rows(spark, (1, "90000001", None), (5, "90000005", 2))
    rows = incoming(spark, (1, "90000001", 9, 40, "retired"), (2, "90000007", 9, 50, "student"),
                    (3, "90000001", 9, None, "services"), (4, "90000006", 9, 60, "admin."), (5, "90000007", 10, 51, None))
    state = {r["phone_number"]: r for r in maintain.upsert_customers(customers, rows, LATER).collect()}
    known, untouched, first, second = (state[f"9000000{i}"] for i in (1, 5, 7, 6))
    assert (known["customer_id"], known["batch_id"], known["age"], known["job"]) == (1, None, 40, "services")
    assert known["created_at"] == NOW and known["updated_at"] == LATER
    assert untouched["updated_at"] == NOW
    # New numbers in the order of their first row; the batch of that row stays.
    assert (first["customer_id"], first["batch_id"], first["age"], first["job"]) == (6, 9, 51, "student")
    assert second["customer_id"] == 7 and second["prediction_status"] == "PENDING"


def test_patch_keeps_absent_fields_and_sets_null(spark):
    customers = customer_rows(spark, (1, "90000001", 3), (2, "90000002", 3))
    changes = spark.createDataFrame(
        [(1, 1, {"age": "44", "job": "retired"}), (1, 2, {"job": None}), (7, 1, {"age": "1"})],
        "customer_id long, position long, fields map<string,string>")
    state = {r["customer_id"]: r for r in maintain.patch_customers(customers, changes, LATER).collect()}
    assert (state[1]["age"], state[1]["job"], state[1]["marital"], state[1]["updated_at"]) == (44, None, "single", LATER)
    assert state[2]["updated_at"] == NOW and len(state) == 2


def test_file_registered_once(spark):
    uploads = spark.createDataFrame(
        [("a" * 64, "one.csv", 3, 1), ("a" * 64, "two.csv", 3, 2), (f"{1:064x}", "old.csv", 3, 3)],
        "file_hash string, file_name string, total_records int, position long")
    state = maintain.register_batches(batch_rows(spark, (1, 1)), uploads, NOW).orderBy("batch_id").collect()
    assert [(r["batch_id"], r["file_name"]) for r in state] == [(1, "1.csv"), (2, "one.csv")]


def test_log_levels_and_messages(spark):
    rows = spark.createDataFrame(
        [(1, "GET", "/a", 399, 0.001234), (2, "GET", None, 400, None), (3, None, "/b", 499, None), (4, "", "", 500, None), (5, None, None, None, None)],
        "log_id int, method string, endpoint string, status_code int, execution_time_seconds double")
    for name in ("service", "level", "event", "message"):
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    rows = rows.withColumn("response_time_ms", F.lit(None).cast("double"))
    found = logs.normalise(rows).orderBy("log_id").collect()
    assert [r["level"] for r in found] == ["INFO", "WARNING", "WARNING", "ERROR", "INFO"]
    assert [r["message"] for r in found] == [
        "GET /a returned HTTP 399", "GET returned HTTP 400", "/b returned HTTP 499", "API request returned HTTP 500", "API request completed"]
    assert found[0]["response_time_ms"] == 1.23 and found[0]["service"] == "api-gateway" and found[0]["event"] == "api_request"


def test_log_metrics_and_pages_of_nothing(spark):
    empty = spark.createDataFrame([], S.SYSTEM_LOGS)
    totals = logs.log_totals(empty).first()
    assert totals["total_logs"] == 0 and totals["total_errors"] is None and totals["average_response_time_ms"] is None
    assert logs.retain(empty).count() == 0
    assert logs.overall_status(empty).first()["overall_status"] == "healthy"


def test_retention_bounds(spark):
    rows = spark.range(1, 301).withColumnRenamed("id", "log_id")
    assert logs.retain(rows, 5).agg(F.min("log_id"), F.count("*")).first()[:] == (201, 100)  # never fewer than 100
    assert logs.retain(rows, 250).count() == 250 and logs.retain(rows, 1000).count() == 300


@pytest.mark.parametrize("arguments", [{"limit": 0}, {"limit": 1001}, {"level": "error"}])
def test_page_arguments(spark, arguments):
    with pytest.raises(ValueError):
        logs.latest_logs(spark.createDataFrame([], S.SYSTEM_LOGS), **arguments)


def test_profile(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert quality.profile(rows).first().asDict() == {"row_count": 3, "null_values": 2, "duplicate_rows": 1, "column_count": 2}
    assert quality.profile(rows.limit(0)).first()["row_count"] == 0


def upload(spark, *phones, **changes):
    base = dict(age="35", job="management", marital="single", education="tertiary", default="no", balance="2500", housing="yes",
                loan="no", contact="cellular", day="15", month="may", campaign="2", pdays="-1", previous="0", poutcome="unknown") | changes
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(phones, 1)], "position long, phone_number string")
    return rows.withColumns({k: F.lit(v) for k, v in base.items()} | {"file_hash": F.lit("f" * 64), "file_name": F.lit("f.csv")})


def tables(spark):
    return CampaignTables(batch_rows(spark, (1, 1)), customer_rows(spark, (1, "90000001", 1)),
                          spark.createDataFrame([], S.CAMPAIGN_HISTORY), prediction_rows(spark))


def score(df):
    return df.withColumn("probability", F.lit(0.65))


def test_flow_scores_and_registers(spark):
    outcome = score_uploads(tables(spark), upload(spark, "90000001", " 90000002 ", "90000002"), score, LATER)
    people = {r["phone_number"]: r for r in outcome.tables.customers.collect()}
    assert people["90000001"]["batch_id"] == 1 and people["90000002"]["batch_id"] == 2
    assert all(p["prediction_status"] == "COMPLETED" for p in people.values())
    assert {r["batch_id"]: r["status"] for r in outcome.tables.batches.collect()} == {1: "completed", 2: "processing"}
    assert outcome.tables.predictions.count() == 3 and outcome.tables.campaigns.count() == 3
    again = score_uploads(outcome.tables, upload(spark, "90000001"), score, LATER, strict=False)
    assert again.new_predictions.count() == 0


@pytest.mark.parametrize("phones, changes", [(["90000001", None], {}), (["90000001", "  "], {}), (["90000001"], {"job": "pilot"}), ([], {})])
def test_strict_flow_abandons_the_batch(spark, phones, changes):
    with pytest.raises(ValueError):
        score_uploads(tables(spark), upload(spark, *phones, **changes), score, LATER)


def test_missing_scores_abandon_the_batch(spark):
    rows = spark.createDataFrame([(0.5, "No"), (None, None)], "probability double, prediction string")
    with pytest.raises(ValueError):
        require_scored(rows)
    with pytest.raises(ValueError):
        score_uploads(tables(spark), upload(spark, "90000001").drop("poutcome"), score, LATER)


@pytest.mark.parametrize("step", [1, 7, 10**9])
def test_large_retention_takes_no_top_k(spark, step):
    """Beyond the limit of the top-k the cutoff comes from histograms of id ranges, however uneven the ids are."""
    rows = spark.range(30_000).select((F.col("id") * F.when(F.col("id") % 2 == 0, step).otherwise(1) + F.col("id")).alias("log_id")).distinct()
    ids = sorted((row["log_id"] for row in rows.collect()), reverse=True)
    for keep in (10_001, 20_000, 29_999, 10**7):
        kept = logs.retain(rows, keep)
        assert sorted((row["log_id"] for row in kept.collect()), reverse=True) == ids[:keep]
        assert "TakeOrdered" not in kept._jdf.queryExecution().executedPlan().toString()
    assert logs.retain(rows.limit(0), 20_000).count() == 0


def test_hashes_of_files_of_any_size(spark, tmp_path, monkeypatch):
    """A file above the limit is streamed in chunks and gets the digest of its bytes; Spark lists no empty files."""
    contents = {"a.csv": b"x" * 100, "b c.csv": bytes(range(256)) * 50_000, "e.csv": b"x" * 100}
    (tmp_path / "empty.csv").write_bytes(b"")
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(files, "CHUNK_BYTES", 1000)
    for whole in (0, 1000, files.WHOLE_BYTES):
        found = {row["file_name"]: row["file_hash"] for row in files.file_hashes(spark, str(tmp_path), whole).collect()}
        assert found == {name: hashlib.sha256(content).hexdigest() for name, content in contents.items()}


def test_a_larger_file_is_never_read_as_one_value(spark, tmp_path):
    """Spark refuses to read a file beyond its limit as a value, so the digest of one shows that none was read so."""
    contents = {"a.csv": b"x" * 100, "b.csv": b"y" * 5000}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        rows = files.file_hashes(spark, str(tmp_path), 500).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {row["file_name"]: row["file_hash"] for row in rows} == {
        name: hashlib.sha256(content).hexdigest() for name, content in contents.items()}


def test_headers_are_read_from_first_lines_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,a\n" + "1,2\n" * 2000)
    (tmp_path / "b.csv").write_bytes(b"a,b\r\n3,4\r\n")
    (tmp_path / "c.csv").write_text("x" * 9000 + ",a")
    groups = files._files_by_header(spark, str(tmp_path))
    assert sorted(len(group) for group in groups) == [1, 1, 1]
    rows = files.read_upload_csv(spark, f"{tmp_path}/[ab].csv").groupBy("a", "b").count().collect()
    assert sorted(tuple(row) for row in rows) == [("2", "1", 2000), ("3", "4", 1)]
