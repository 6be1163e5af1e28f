import pytest
from pyspark.sql import functions as F

from prospecta import schemas as S
from prospecta.functions import scalars as X
from prospecta.functions import validation as V
from prospecta.functions.hashing import row_key
from prospecta.sources import files


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_to_number(spark):
    values = ["0.5", " .5\t", "1e3", "-2.", "+7", "n/a", "", "1d", "0x10", "nan", "1,5", None]
    assert column(spark, values, "string", X.to_number) == [0.5, 0.5, 1000.0, -2.0, 7.0] + [None] * 7
    assert column(spark, ["inf", "-Infinity"], "string", X.to_number) == [float("inf"), float("-inf")]
    assert column(spark, [0.25, float("nan"), None], "double", X.to_number) == [0.25, None, None]


def test_to_int_cuts_the_fraction(spark):
    assert column(spark, ["35", "35.0", "35.9", "-1", "x", "99999999999"], "string", X.to_int) == [35, 35, 35, -1, None, None]


@pytest.mark.parametrize("kind, values, expected", [
    ("string", ["Yes", " 1 ", "1.0", "TRUE", "subscribed\n", "no", "0", "", "2", None], [True] * 5 + [False] * 5),
    ("boolean", [True, False, None], [True, False, False]),
    ("int", [1, 0, None], [True, False, False]),
    ("double", [1.0, 0.0], [True, False]),
])
def test_is_subscriber(spark, kind, values, expected):
    assert column(spark, values, kind, X.is_subscriber) == expected


def test_priority_edges(spark):
    values = [0.7, 0.69999, 0.6, 0.59996, 0.0, None]
    assert column(spark, values, "double", X.priority) == ["High", "Medium", "Medium", "Low", "Low", "Unknown"]
    assert column(spark, values, "double", X.priority_rank) == [0, 1, 1, 2, 2, 3]
    assert column(spark, S.PRIORITIES + [None], "string", X.priority_label) == list(S.PRIORITY_LABELS.values()) + [None]


def test_decision_uses_the_raw_probability(spark):
    assert column(spark, [0.59996, 0.6, None], "double", X.decide) == [0, 1, None]
    stored = column(spark, [0.59996], "double", X.stored_probability)
    assert stored == [0.6] and column(spark, stored, "double", X.priority) == ["Medium"]


def test_percent_rounds_half_to_even(spark):
    assert column(spark, [0.125, 0.0005, 0.6105], "double", X.percent) == [12.5, 0.0, 61.0]


def test_currencies(spark):
    assert column(spark, [148.0], "double", X.sgd_to_eur) == pytest.approx([100.0])
    assert column(spark, [100.0], "double", X.eur_to_sgd) == pytest.approx([148.0])


GOOD = dict(phone_number="91234567", age=35, job="management", marital="single", education="tertiary", default="no",
            balance=2500.0, housing="yes", loan="no", contact="cellular", day=15, month="may", campaign=2, pdays=-1,
            previous=0, poutcome="unknown")


def broken_by(spark, **changes):
    schema = ", ".join(f"`{n}` {'int' if n in ('age', 'day', 'campaign', 'pdays', 'previous') else 'double' if n == 'balance' else 'string'}" for n in GOOD)
    row = spark.createDataFrame([tuple((GOOD | changes).values())], schema)
    return V.with_failures(row, V.customer_rules()).first()["failed_rules"]


@pytest.mark.parametrize("changes, rules", [
    ({}, []),
    ({"age": 18}, []), ({"age": 100}, []), ({"age": 17}, ["age_range"]), ({"age": 101}, ["age_range"]),
    ({"phone_number": "1234567"}, ["phone_format"]), ({"phone_number": "123456789"}, ["phone_format"]),
    ({"phone_number": "+6591234567"}, ["phone_format"]), ({"phone_number": "91234567\n"}, ["phone_format"]),
    ({"phone_number": " 91234567"}, ["phone_format"]), ({"phone_number": None}, ["phone_format"]),
    ({"phone_number": "01234567"}, []),
    ({"job": "pilot", "month": None}, ["job_domain", "month_domain"]),
    ({"balance": -1_000_001.0}, ["balance_range"]), ({"day": 32, "campaign": 0}, ["day_range", "campaign_range"]),
    ({"pdays": -2, "previous": -1}, ["pdays_range", "previous_range"]),
])
def test_customer_rules(spark, changes, rules):
    assert broken_by(spark, **changes) == rules


def test_optional_log_fields_pass_when_missing(spark):
    rows = spark.createDataFrame(
        [(None,) * 9, ("s", "FATAL", "e" * 101, "", "m" * 11, "x" * 501, 600, -1.0, -0.1)],
        "service string, level string, event string, message string, method string, endpoint string, "
        "status_code int, response_time_ms double, execution_time_seconds double")
    assert [len(r["failed_rules"]) for r in V.with_failures(rows, V.log_rules()).collect()] == [0, 8]


@pytest.mark.parametrize("phones, verdict", [
    ([], "empty_file"), (["91234567", None], "null_phone"), (["91234567", " \t"], "blank_phone"), (["91234567"], "ok"),
])
def test_upload_checks(spark, phones, verdict):
    rows = spark.createDataFrame([(p,) for p in phones], "phone_number string")
    assert V.upload_checks(rows).first()["verdict"] == verdict


def test_missing_columns(spark):
    rows = spark.createDataFrame([("91234567", "35")], "phone_number string, age string")
    assert V.missing_columns(rows) == [c for c in S.UPLOAD_FIELDS if c not in ("phone_number", "age")]


def test_training_names_in_file_order():
    assert S.TRAINING_COLUMNS["V1"] == "age" and S.TRAINING_COLUMNS["V12"] == "duration"
    assert S.TRAINING_COLUMNS["V16"] == "poutcome" and S.TRAINING_COLUMNS["Class"] == "target"
    assert len(S.FEATURES) == 15


@pytest.mark.parametrize("kind, rows", [
    ("a double", [(0.0123,), (0.0141,), (1e-300,), (2e-300,), (None,)]),
    ("a string, b string", [("a|b", "c"), ("a", "b|c"), ("a", None), ("a", "~"), (None, "a"), ("a", ""), ("", "a"), ("1:a", "")]),
])
def test_row_keys_tell_rows_apart(spark, kind, rows):
    df = spark.createDataFrame(rows, kind)
    assert df.select(row_key(df, df.columns, 42)).distinct().count() == len(rows)


def test_upload_columns_follow_the_header_of_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("phone_number,job\n91234567,student\n")
    (tmp_path / "b 2.csv").write_text("job,phone_number\nretired,91234568\n")
    (tmp_path / "c.csv").write_text("phone_number\n91234569\n")
    rows = files.read_upload_csv(spark, str(tmp_path)).orderBy("phone_number").collect()
    assert [(r["phone_number"], r["job"]) for r in rows] == [("91234567", "student"), ("91234568", "retired"), ("91234569", None)]
