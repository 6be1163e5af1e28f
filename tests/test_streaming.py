import hashlib
import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from prospecta import schemas as S
from prospecta.sources import files
from prospecta.sources.tables import TableStore
from prospecta.streaming import logs, uploads

NOW = datetime(2024, 6, 1)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def write_logs(folder, name, records):
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def test_json_logs_get_ids_and_bad_ones_are_set_aside(spark, tmp_path):
    arriving, state = tmp_path / "in", str(tmp_path / "state")
    arriving.mkdir()
    write_logs(arriving, "a.json", [{"service": "x", "status_code": 500, "metadata": {"k": 1}}, {"status_code": 99}])
    def ingest():
        run(logs.start_ingest(logs.json_log_stream(spark, str(arriving)), state, f"{state}/checkpoint", available_now=True))

    ingest()
    write_logs(arriving, "b.json", [{"service": "y"}, {"service": "z", "level": "DEBUG"}])
    ingest()
    rows = logs.read_logs(spark, state).orderBy("log_id").collect()
    assert [(r["log_id"], r["service"]) for r in rows] == [(1, "x"), (2, "y"), (3, "z")]
    assert (rows[0]["service"], rows[0]["level"], rows[0]["metadata"]) == ("x", "ERROR", '{"k": 1}')
    assert all(r["timestamp"] is not None for r in rows)
    bad = spark.read.parquet(f"{state}/quarantine").collect()
    assert [r["failed_rules"] for r in bad] == [["status_code_range"]]


def test_ids_follow_the_lines_and_old_generations_go(spark, tmp_path):
    arriving, state = tmp_path / "in", tmp_path / "state"
    arriving.mkdir()
    for number, name in enumerate("dcba"):
        # Tied rows in each file; files arrive against the order of their names.
        write_logs(arriving, f"{name}.json", [{"service": "same"}, {"service": f"s{number}"}, {"service": "same"}])
        os.utime(arriving / f"{name}.json", (1_700_000_000 + number, 1_700_000_000 + number))
        run(logs.start_ingest(
            logs.json_log_stream(spark, str(arriving)), str(state), f"{state}/checkpoint", retain_every=1,
            available_now=True))
    rows = logs.read_logs(spark, str(state)).orderBy("log_id").collect()
    assert [r["log_id"] for r in rows] == list(range(1, 13))
    assert [r["service"] for r in rows] == [s for n in range(4) for s in ("same", f"s{n}", "same")]
    left = sorted(p.name for p in (state / "logs").iterdir() if p.is_dir())
    assert left == ["generation=2", "generation=3"]


def test_running_metrics_over_two_runs(spark, tmp_path):
    arriving, state = tmp_path / "in", str(tmp_path / "state")
    arriving.mkdir()
    for name, millis in (("a.json", 10.0), ("b.json", 30.0)):
        write_logs(arriving, name, [{"service": "x", "response_time_ms": millis}, {"service": "y", "status_code": 404}])
        stream = logs.json_log_stream(spark, str(arriving))
        run(logs.start_metrics(stream, f"{state}/m", f"{state}/checkpoint", available_now=True))
    rows = {r["service"]: r for r in logs.metrics_by_service(spark, f"{state}/m").collect()}
    assert rows["x"]["average_response_time_ms"] == 20.0 and rows["y"]["average_response_time_ms"] is None
    totals = logs.metrics_totals(spark, f"{state}/m").first()
    assert (totals["total_logs"], totals["total_errors"], totals["total_warnings"], totals["maximum_response_time_ms"]) == (4, 0, 2, 30.0)


def line(phone, **changes):
    base = dict(phone_number=phone, age="35", job="management", marital="single", education="tertiary", default="no", balance="2500",
                housing="yes", loan="no", contact="cellular", day="15", month="may", campaign="2", pdays="-1", previous="0", poutcome="unknown")
    return base | changes


def write_csv(path, rows, columns=S.UPLOAD_FIELDS):
    path.write_text("\n".join([",".join(columns)] + [",".join(r[c] for c in columns) for r in rows]) + "\n")


def test_uploads_are_scored_once(spark, tmp_path):
    arriving, state = tmp_path / "in", tmp_path / "state"
    arriving.mkdir()
    store = TableStore(spark, str(state))
    write_csv(arriving / "a.csv", [line("01234567"), line("91234567", job="pilot")])
    write_csv(arriving / "b.csv", [line("91234568")], columns=S.UPLOAD_FIELDS[::-1])
    write_csv(arriving / "copy_of_a.csv", [line("01234567"), line("91234567", job="pilot")])
    write_csv(arriving / "short.csv", [line("91234569")], columns=S.UPLOAD_FIELDS[:-1])

    def score_all():
        run(uploads.start_upload_scoring(
            spark, str(arriving), store, lambda df: df.withColumn("probability", F.lit(0.7)), str(state / "checkpoint"),
            clock=lambda: NOW, available_now=True))

    score_all()
    people = {r["phone_number"]: r for r in store.read("customers").collect()}
    assert set(people) == {"01234567", "91234568"}
    assert people["91234568"]["job"] == "management" and people["91234568"]["balance"] == 2500.0
    assert {r["file_name"]: r["total_records"] for r in store.read("batch_uploads").collect()} == {"a.csv": 2, "b.csv": 1}
    assert [r["file_name"] for r in spark.read.parquet(f"{state}/refused_files").collect()] == ["short.csv"]
    assert spark.read.parquet(f"{state}/quarantine").count() == 1

    write_csv(arriving / "c.csv", [line("01234567", age="50")])
    score_all()
    assert store.read("predictions").count() == 3
    again = {r["phone_number"]: r for r in store.read("customers").collect()}
    assert again["01234567"]["customer_id"] == people["01234567"]["customer_id"] and again["01234567"]["age"] == 50


def test_commits_show_together(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = spark.range(3).select(F.col("id").alias("prediction_id"))
    assert store.read("predictions").count() == 0
    store.commit(append={"predictions": rows})
    store.commit(append={"predictions": rows})
    assert store.read("predictions").count() == 6
    store.commit(replace={"predictions": rows.limit(1)}, append={"campaign_history": rows.select(F.col("prediction_id").alias("campaign_id"))})
    store.commit(append={"predictions": rows})
    store.compact("predictions")
    assert len(store._paths("predictions")) == 1
    assert store.read("predictions").count() == 4 and store.read("campaign_history").count() == 3


def test_additions_are_folded(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), fold=3)
    held = store.read("predictions")
    for number in range(14):
        store.commit(append={"predictions": spark.range(number, number + 1).select(F.col("id").alias("prediction_id"))})
        if number == 2:
            held = store.read("predictions")
        # In the digits of the number of commits to the base 3, each stands for so many folders of its level.
        commits, folders = number + 1, 0
        while commits:
            commits, digit = divmod(commits, 3)
            folders += digit
        assert len(store._paths("predictions")) == folders
    assert sorted(r["prediction_id"] for r in store.read("predictions").collect()) == list(range(14))
    assert held.count() == 3  # a frame that was read before keeps its files
    store.commit(replace={"predictions": store.read("predictions").filter("prediction_id < 2")})
    for number in range(3):
        store.commit(append={"predictions": spark.range(20 + number, 21 + number).select(F.col("id").alias("prediction_id"))})
    assert sorted(r["prediction_id"] for r in store.read("predictions").collect()) == [0, 1, 20, 21, 22]
    assert len(store._paths("predictions")) == 2


def test_uploaded_files_are_hashed_in_chunks(spark, tmp_path, monkeypatch):
    """Files beyond a chunk are streamed: the stream itself never reads contents, and the registered hash is that of the bytes."""
    line = ("91234567,30,admin.,single,primary,no,10,no,no,cellular,1,jan,1,-1,0,unknown\n")
    folder = tmp_path / "in"
    folder.mkdir()
    body = (",".join(S.UPLOAD_FIELDS) + "\n" + line).encode()
    (folder / "one file.csv").write_bytes(body)
    monkeypatch.setattr(uploads, "CHUNK_BYTES", 10)
    asked = []
    monkeypatch.setattr(uploads, "file_hashes", lambda spark, paths, whole: asked.append(whole) or files.file_hashes(spark, paths, whole))
    store = TableStore(spark, str(tmp_path / "tables"))
    uploads.start_upload_scoring(
        spark, str(folder), store, lambda df: df.withColumn("probability", F.lit(0.9)), str(tmp_path / "checkpoint"),
        clock=lambda: datetime(2024, 1, 1), available_now=True).awaitTermination()
    assert asked == [10]
    assert [row["file_hash"] for row in store.read("batch_uploads").collect()] == [hashlib.sha256(body).hexdigest()]
    assert store.read("predictions").count() == 1
