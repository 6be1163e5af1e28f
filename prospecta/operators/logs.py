"""Normalising, filtering, retention and metrics of service logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta import schemas as S

#: Ranges of ids that one histogram has, at most so many rows in the driver.
RANGES = 4096


def normalise(logs: DataFrame) -> DataFrame:
    """Fill response time, level, message, service and event where the sender left them out."""
    code = F.col("status_code")
    elapsed = F.bround(F.col("execution_time_seconds") * 1000, 2)
    level = F.when(code >= 500, "ERROR").when(code >= 400, "WARNING").otherwise("INFO")
    request = F.concat_ws(" ", F.nullif("method", F.lit("")), F.nullif("endpoint", F.lit("")))
    subject = F.coalesce(F.nullif(request, F.lit("")), F.lit("API request"))
    ending = F.when(code.isNotNull(), F.concat(F.lit(" returned HTTP "), code.cast("string"))).otherwise(" completed")
    return logs.withColumns({
        "response_time_ms": F.coalesce("response_time_ms", elapsed),
        "level": F.coalesce("level", level),
        "message": F.coalesce("message", F.concat(subject, ending)),
        "service": F.coalesce("service", F.lit(S.DEFAULT_LOG_SERVICE)),
        "event": F.coalesce("event", F.lit(S.DEFAULT_LOG_EVENT)),
    })


def stored_logs(logs: DataFrame) -> DataFrame:
    """Normalised rows in the layout of the log table."""
    present = [name for name in S.SYSTEM_LOGS.fieldNames() if name in logs.columns]
    return normalise(logs).select(*present)


def request_logs(logs: DataFrame) -> DataFrame:
    """Drop health and root requests; seconds to four places."""
    noisy = F.coalesce(F.col("endpoint").isin(S.QUIET_ENDPOINTS), F.lit(False))
    return logs.filter(~noisy).withColumn("execution_time_seconds", F.bround("execution_time_seconds", 4))


def metadata_value(path: str, column: str = "metadata") -> Column:
    """One value of the JSON metadata as text, for example ``$.k``."""
    return F.get_json_object(column, path)


def health_checks(probes: DataFrame) -> DataFrame:
    """Probe rows (service, status_code, error) as health_check log rows with ``status``.

    A probe without status code got no answer.
    """
    healthy = F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    reason = F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
    return (
        probes.withColumn("status", F.when(healthy, "healthy").otherwise("unhealthy"))
        .withColumn("level", F.when(healthy, "INFO").otherwise("ERROR"))
        .withColumn("event", F.lit("health_check"))
        .withColumn("message", F.when(healthy, F.concat("service", F.lit(" is healthy"))).otherwise(
            F.concat(F.col("service"), F.lit(" health check failed: "), reason)))
    )


def overall_status(logs: DataFrame) -> DataFrame:
    """healthy if the newest health check of every service is, else degraded."""
    newest = (
        logs.filter(F.col("event") == "health_check")
        .groupBy("service").agg(F.max_by("level", "log_id").alias("level"))
    )
    return newest.agg(
        F.count("*").alias("services"),
        F.count_if(F.col("level") == "INFO").alias("healthy_services"),
    ).select(
        "services", "healthy_services",
        F.when(F.col("services") == F.col("healthy_services"), "healthy").otherwise("degraded").alias("overall_status"),
    )


def _errors() -> Column:
    return F.sum(F.col("level").isin("ERROR", "CRITICAL").cast("int"))


def log_totals(logs: DataFrame) -> DataFrame:
    """Sums and averages are NULL on an empty log."""
    return logs.agg(
        F.count("*").alias("total_logs"),
        _errors().alias("total_errors"),
        F.sum((F.col("level") == "WARNING").cast("int")).alias("total_warnings"),
        F.avg("response_time_ms").alias("average_response_time_ms"),
        F.max("response_time_ms").alias("maximum_response_time_ms"),
    )


def log_metrics_by_service(logs: DataFrame) -> DataFrame:
    return logs.groupBy("service").agg(
        F.count("*").alias("total_logs"),
        _errors().alias("errors"),
        F.avg("response_time_ms").alias("average_response_time_ms"),
    ).orderBy("service")


def facet(logs: DataFrame, column: str) -> DataFrame:
    """Distinct values of a filter column, sorted."""
    return logs.select(F.col(column).cast("string").alias(column)).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def latest_logs(
    logs: DataFrame, limit: int = S.LOG_PAGE_DEFAULT, service: str | None = None, level: str | None = None
) -> DataFrame:
    """A page of the newest logs, optionally of one service or level."""
    if not 1 <= limit <= S.LOG_PAGE_MAX:
        raise ValueError(f"limit must be between 1 and {S.LOG_PAGE_MAX}")
    if level is not None and not re.fullmatch("[A-Z]+", level):
        raise ValueError("level must be upper-case letters")
    if service:
        logs = logs.filter(F.col("service") == service)
    if level:
        logs = logs.filter(F.col("level") == level)
    return logs.orderBy(F.col("log_id").desc()).limit(limit)


def retain(logs: DataFrame, keep: int = S.LOG_RETENTION_DEFAULT) -> DataFrame:
    """The newest ``keep`` rows.

    Up to ``S.LOG_PAGE_MAX`` times ten rows, the oldest id kept comes from a top-k. Beyond, one task would hold them all; there
    a histogram of id ranges tells in which range the cutoff lies, and only that range is ranked.
    """
    keep = max(S.LOG_RETENTION_MIN, keep)
    if keep <= 10 * S.LOG_PAGE_MAX:
        cutoff = logs.select("log_id").orderBy(F.col("log_id").desc()).limit(keep).agg(F.min("log_id"))
        return logs.filter(F.col("log_id") >= cutoff.scalar())
    ends = logs.agg(F.min("log_id"), F.max("log_id")).first()
    if ends[0] is None:
        return logs
    low, high, wanted = ends[0], ends[1], keep
    while True:
        # Narrow the range that holds the cutoff; ids may be uneven, so the histogram is repeated until few are left.
        width = max(1, -(-(high - low + 1) // RANGES))
        inside = logs.filter(F.col("log_id").between(low, high))
        ranges = sorted(
            (row["range"], row["n"]) for row in inside.groupBy(
                F.expr(f"(log_id - {low}L) div {width}L").alias("range")).agg(F.count("*").alias("n")).collect())
        found = None
        for number, rows in reversed(ranges):
            if wanted <= rows:
                found = number
                break
            wanted -= rows
        if found is None:  # fewer rows than are kept
            return logs
        low, high = low + found * width, min(high, low + (found + 1) * width - 1)
        if width == 1:
            return logs.filter(F.col("log_id") >= low)
