"""Campaign tables as projections of the given Parquet tables, for Spark and as SQL.

Each projection is one list of SQL expressions that both engines read; Spark selects them from the
Parquet scan, the checking SQL gets them as a common table expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prospecta import schemas as S


def pick(values: list[str], index: str) -> str:
    return f"split_part('{','.join(values)}', ',', CAST(1 + {index} AS INT))"


def yes_no(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'yes' ELSE 'no' END"


SCORE = "((o_orderkey * 7919 + 13) % 10001)"
SCORE_DOUBLE = f"CAST({SCORE} AS DOUBLE) / CAST(10000 AS DOUBLE)"

PROJECTIONS: dict[str, tuple[str, dict[str, str], str | None]] = {
    # name: (source table, output column -> expression, filter)
    "fx_customers": ("customer", {
        "customer_id": "c_custkey",
        "phone_number": "lpad(CAST(90000000 + c_custkey AS STRING), 8, '0')",
        "batch_id": "CASE WHEN c_custkey % 10 = 0 OR c_nationkey >= 23 THEN NULL ELSE c_nationkey + 1 END",
        "age": "CAST(18 + c_custkey % 70 AS INT)",
        "job": pick(S.JOBS, "c_custkey % 12"),
        "marital": pick(S.MARITAL, "(c_custkey % 7) % 3"),
        "education": pick(S.EDUCATION, "(c_custkey % 13) % 4"),
        "default": yes_no("c_custkey % 50 = 0"),
        "balance": "c_acctbal",
        "housing": yes_no("(c_custkey % 11) % 2 = 0"),
        "loan": yes_no("c_custkey % 5 = 0"),
    }, None),
    "fx_campaign_history": ("orders", {
        "campaign_id": "o_orderkey",
        "customer_id": "o_custkey",
        "contact": pick(S.CONTACTS, "o_orderkey % 3"),
        "day": "CAST(dayofmonth(o_orderdate) AS INT)",
        "month": pick(S.MONTHS, "month(o_orderdate) - 1"),
        "campaign": "CAST(1 + o_orderkey % 6 AS INT)",
        "pdays": "CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 400 ELSE -1 END AS INT)",
        "previous": "CAST(CASE WHEN o_orderkey % 4 = 0 THEN 1 + o_orderkey % 5 ELSE 0 END AS INT)",
        "poutcome": f"CASE WHEN o_orderkey % 4 = 0 THEN {pick(S.OUTCOMES[:3], 'o_orderkey % 3')} ELSE 'unknown' END",
        "created_at": "CAST(o_orderdate AS TIMESTAMP)",
    }, None),
    "fx_predictions": ("orders", {
        "prediction_id": "o_orderkey",
        # All orders; some customers are left without a prediction by moving theirs to another one.
        "customer_id": "CASE WHEN o_custkey % 13 = 0 THEN o_custkey - 1 ELSE o_custkey END",
        "prediction": f"CASE WHEN {SCORE} >= 6000 THEN {pick(['Yes', 'yes', ' 1 ', '1.0', 'True'], 'o_orderkey % 5')} "
                      f"WHEN o_orderkey % 5 = 4 THEN NULL ELSE {pick(['No', 'no', '0', '0.0'], 'o_orderkey % 5')} END",
        "probability": f"CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE CAST({SCORE_DOUBLE} AS STRING) END",
        "model_version": "CAST(NULL AS STRING)",
        "predicted_at": "CAST(o_orderdate AS TIMESTAMP)",
    }, None),
    "fx_batch_uploads": ("nation", {
        "batch_id": "n_nationkey + 1",
        "file_name": "concat('batch_', n_name, '.csv')",
        "total_records": "CAST(100 + n_nationkey * 4 AS INT)",
        "file_hash": "{sha256}(n_name{sha_bits})",
        "status": "'pending'",
    }, None),
    "fx_raw_bank": ("lineitem", {
        "V1": "CAST(18 + l_quantity AS INT)",
        "V2": pick(S.JOBS, "l_suppkey % 12"),
        "V3": pick(S.MARITAL, "l_partkey % 3"),
        "V4": pick(S.EDUCATION, "l_partkey % 4"),
        "V5": yes_no("l_partkey % 50 = 0"),
        "V6": "l_extendedprice",
        "V7": yes_no("l_discount >= 0.05"),
        "V8": yes_no("l_tax >= 0.06"),
        "V9": pick(S.CONTACTS, "l_linenumber % 3"),
        "V10": "CAST(dayofmonth(l_shipdate) AS INT)",
        "V11": pick(S.MONTHS, "month(l_shipdate) - 1"),
        "V12": "CAST(l_orderkey % 900 AS INT)",
        "V13": "CAST(l_linenumber AS INT)",
        "V14": "CAST(CASE WHEN l_returnflag = 'N' THEN -1 ELSE l_suppkey % 400 END AS INT)",
        "V15": "CAST(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_linenumber END AS INT)",
        "V16": "CASE l_returnflag WHEN 'R' THEN 'success' WHEN 'A' THEN 'failure' ELSE 'unknown' END",
        "Class": "CAST(CASE WHEN (l_returnflag = 'R' AND l_quantity >= 34) <> (l_partkey % 17 = 0) THEN 2 ELSE 1 END AS INT)",
    }, None),
    "fx_raw_logs": ("events", {
        "log_id": "event_id",
        "timestamp": "CAST(ts AS TIMESTAMP)",
        "service": f"CASE WHEN user_id % 4 = 0 THEN NULL ELSE "
                   f"{pick(['ai-interface', 'database-service', 'api-gateway'], 'user_id % 4 - 1')} END",
        "level": "CASE WHEN user_id % 10 = 0 THEN 'CRITICAL' ELSE NULL END",
        "event": "CAST(NULL AS STRING)",
        "message": "CAST(NULL AS STRING)",
        "method": f"CASE WHEN event_id % 11 = 0 THEN NULL ELSE {pick(['GET', 'POST', 'PUT'], 'event_id % 3')} END",
        "endpoint": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('/api/', event_type) END",
        "status_code": "CAST(CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_type = 'error' THEN 500 + event_id % 4 "
                       "WHEN event_type = 'signup' THEN 400 + event_id % 5 ELSE 200 END AS INT)",
        "response_time_ms": "CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END",
        "execution_time_seconds": "value / CAST(1000 AS DOUBLE)",
        "metadata": "props",
    }, None),
    "fx_scored": ("lineitem", {
        "label": "CASE WHEN (l_returnflag = 'R' AND l_quantity >= 34) <> (l_partkey % 17 = 0) THEN 1 ELSE 0 END",
        "score": "CAST((CASE WHEN (l_returnflag = 'R' AND l_quantity >= 34) <> (l_partkey % 17 = 0) THEN 1 ELSE 0 END)"
                 " * 3500 + (l_orderkey * 7919 + l_partkey * 31) % 6501 AS DOUBLE) / CAST(10000 AS DOUBLE)",
    }, None),
    # Scores that are not rounded: about as many distinct values as rows.
    "fx_raw_scored": ("lineitem", {
        "label": "CASE WHEN (l_returnflag = 'R' AND l_quantity >= 34) <> (l_partkey % 17 = 0) THEN 1 ELSE 0 END",
        "score": "l_extendedprice / CAST(120000 AS DOUBLE)",
    }, None),
    # An uploaded file, all text: one line per order, with known, new, repeated and invalid customers.
    "fx_upload": ("orders", {
        "position": "o_orderkey",
        "batch_id": "CAST(1000 AS BIGINT)",
        "phone_number": "CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 0 THEN '  ' "
                        "WHEN o_orderkey % 107 = 0 THEN '+6591234567' WHEN o_orderkey % 109 = 0 THEN '1234567' "
                        "WHEN o_orderkey % 2 = 0 THEN concat(' ', CAST(90000000 + o_custkey AS STRING), ' ') "
                        "ELSE CAST(90000000 + o_custkey AS STRING) END",
        "age": "CASE WHEN o_orderkey % 41 = 0 THEN '17' WHEN o_orderkey % 43 = 0 THEN 'old' "
               "WHEN o_orderkey % 7 = 0 THEN concat(CAST(18 + o_custkey % 83 AS STRING), '.0') "
               "ELSE CAST(18 + o_custkey % 83 AS STRING) END",
        "job": f"CASE WHEN o_orderkey % 47 = 0 THEN 'pilot' ELSE {pick(S.JOBS, 'o_orderkey % 12')} END",
        "marital": f"CASE WHEN o_orderkey % 53 = 0 THEN 'widowed' ELSE {pick(S.MARITAL, 'o_orderkey % 3')} END",
        "education": pick(S.EDUCATION, "o_orderkey % 4"),
        "default": yes_no("o_orderkey % 50 = 0"),
        "balance": "CASE WHEN o_orderkey % 59 = 0 THEN '-2000000' WHEN o_orderkey % 61 = 0 THEN 'n/a' "
                   "ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END",
        "housing": yes_no("o_orderkey % 3 = 0"),
        "loan": yes_no("o_orderkey % 5 = 0"),
        "contact": pick(S.CONTACTS, "o_orderkey % 3"),
        "day": "CASE WHEN o_orderkey % 67 = 0 THEN '32' ELSE CAST(dayofmonth(o_orderdate) AS STRING) END",
        "month": f"CASE WHEN o_orderkey % 71 = 0 THEN NULL ELSE {pick(S.MONTHS, 'month(o_orderdate) - 1')} END",
        "campaign": "CASE WHEN o_orderkey % 73 = 0 THEN '0' ELSE CAST(1 + o_orderkey % 6 AS STRING) END",
        "pdays": "CASE WHEN o_orderkey % 79 = 0 THEN '-2' WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 400 AS STRING) ELSE '-1' END",
        "previous": "CASE WHEN o_orderkey % 83 = 0 THEN '-1' WHEN o_orderkey % 4 = 0 THEN CAST(1 + o_orderkey % 5 AS STRING) ELSE '0' END",
        "poutcome": f"CASE WHEN o_orderkey % 89 = 0 THEN 'maybe' WHEN o_orderkey % 4 = 0 THEN {pick(S.OUTCOMES[:3], 'o_orderkey % 3')} ELSE 'unknown' END",
    }, None),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A projection, or one of the given tables, as a DataFrame."""
    if name not in PROJECTIONS:
        return table(spark, folder, name)
    source, columns, condition = PROJECTIONS[name]
    df = table(spark, folder, source)
    if condition:
        df = df.filter(condition)
    return df.selectExpr(*[
        f"{text.format(sha256='sha2', sha_bits=', 256')} AS `{alias}`" for alias, text in columns.items()
    ])


def cte(*names: str, **derived: str) -> str:
    """``WITH`` clause for DuckDB: the projections, then further named queries."""
    parts = []
    for name in names:
        source, columns, condition = PROJECTIONS[name]
        body = ", ".join(
            f'{text.format(sha256="sha256", sha_bits="")} AS "{alias}"' for alias, text in columns.items()
        )
        parts.append(f"{name} AS (SELECT {body} FROM {source}{' WHERE ' + condition if condition else ''})")
    parts += [f"{name} AS ({body})" for name, body in derived.items()]
    return "WITH " + ", ".join(parts) + " "


class Registry:
    """Named queries with their checking SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(build: Callable[[SparkSession, str], DataFrame]):
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = build
            if sql is not None:
                self.sql[name] = sql
            return build
        return register
