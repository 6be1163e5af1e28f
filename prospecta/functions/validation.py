"""Validation rules as data: one predicate per rule, evaluated in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta import schemas as S
from prospecta.functions import scalars as X

PHONE = r"\A[0-9]{8}\z"
FILE_HASH = r"\A[0-9a-f]{64}\z"


@dataclass(frozen=True)
class Rule:
    """``holds`` is the accepted case. NULL fails a required rule and passes an optional one."""

    name: str
    holds: Column
    required: bool = True

    @property
    def broken(self) -> Column:
        return ~F.coalesce(self.holds, F.lit(not self.required))


def domain_rules() -> list[Rule]:
    return [Rule(f"{name}_domain", F.col(f"`{name}`").isin(values)) for name, values in S.DOMAINS.items()]


def phone_rule() -> Rule:
    return Rule("phone_format", F.col("phone_number").rlike(PHONE))


def range_rules() -> list[Rule]:
    return [
        Rule("age_range", F.col("age").between(18, 100)),
        Rule("balance_range", F.col("balance") >= -1_000_000.0),
        Rule("day_range", F.col("day").between(1, 31)),
        Rule("campaign_range", F.col("campaign") >= 1),
        Rule("pdays_range", F.col("pdays") >= -1),
        Rule("previous_range", F.col("previous") >= 0),
    ]


def customer_rules() -> list[Rule]:
    return [phone_rule(), *domain_rules(), *range_rules()]


def file_hash_rule() -> Rule:
    return Rule("file_hash_format", F.col("file_hash").rlike(FILE_HASH))


def log_rules() -> list[Rule]:
    def length(name: str, low: int, high: int) -> Rule:
        return Rule(f"{name}_length", F.length(name).between(low, high), required=False)

    return [
        length("service", 1, 100),
        length("event", 0, 100),
        length("message", 1, 2000),
        length("method", 0, 10),
        length("endpoint", 0, 500),
        Rule("status_code_range", F.col("status_code").between(100, 599), required=False),
        Rule("response_time_sign", F.col("response_time_ms") >= 0, required=False),
        Rule("execution_time_sign", F.col("execution_time_seconds") >= 0, required=False),
        Rule("level_domain", F.col("level").isin(S.LOG_LEVELS), required=False),
    ]


def with_failures(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``failed_rules``, the names of the broken rules."""
    marks = F.array(*[F.when(rule.broken, F.lit(rule.name)) for rule in rules])
    return df.withColumn("failed_rules", F.array_compact(marks))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``failed_rules``)."""
    broken = F.lit(False)
    for rule in rules:
        broken = broken | rule.broken
    return df.filter(~broken), with_failures(df.filter(broken), rules)


def failure_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule, zero included; a single aggregate over the input."""
    counts = df.agg(*[F.count_if(rule.broken).alias(rule.name) for rule in rules])
    return counts.unpivot([], [rule.name for rule in rules], "rule", "failures")


def missing_columns(df: DataFrame, required: list[str] | None = None) -> list[str]:
    present = set(df.columns)
    return [name for name in (required or S.UPLOAD_FIELDS) if name not in present]


def upload_checks(df: DataFrame) -> DataFrame:
    """One row: number of records, missing and blank phone numbers, and the verdict."""
    phone = F.col("phone_number")
    counts = df.agg(
        F.count("*").alias("records"),
        F.count_if(phone.isNull()).alias("null_phones"),
        F.count_if(X.strip(phone) == "").alias("blank_phones"),
    )
    verdict = (
        F.when(F.col("records") == 0, "empty_file")
        .when(F.col("null_phones") > 0, "null_phone")
        .when(F.col("blank_phones") > 0, "blank_phone")
        .otherwise("ok")
    )
    return counts.withColumn("verdict", verdict)


def typed_upload(df: DataFrame) -> DataFrame:
    """Text columns of an upload as the typed record; what cannot be read becomes NULL."""
    integers = {"age", "day", "campaign", "pdays", "previous"}

    def typed(name: str) -> Column:
        column = F.col(f"`{name}`")
        if name == "phone_number":
            return X.strip(column).alias(name)
        if name in integers:
            return X.to_int(column).alias(name)
        if name == "balance":
            return X.to_number(column).alias(name)
        return column.cast("string").alias(name)

    kept = [F.col(f"`{name}`") for name in df.columns if name not in S.UPLOAD_FIELDS]
    return df.select(*[typed(name) for name in S.UPLOAD_FIELDS], *kept)
