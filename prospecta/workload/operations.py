"""Service logs and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospecta import schemas as S
from prospecta.functions import validation as V
from prospecta.operators import logs, lookups, maintain
from prospecta.plans import batch_scoring
from prospecta.workload.fixtures import Registry, cte, load
from prospecta.workload.relational import (
    BLANKS_SQL, CAMPAIGN_COLUMNS, CLOCK, CLOCK_SQL, CUSTOMER_COLUMNS, FLAGGED, KEPT_SQL, KNOWN_BATCHES_SQL, STATUS_SQL,
    TYPED_UPLOAD_SQL, VALID_SQL, _kept, _known_batches, customer_table, customers, flagged, in_list, rule_counts_sql,
)

registry = Registry()
add = registry.add

# --- Logs -----------------------------------------------------------------------------------
NORMAL_SQL = f"""
SELECT log_id, "timestamp", coalesce(service, '{S.DEFAULT_LOG_SERVICE}') AS service,
    coalesce(level, CASE WHEN status_code >= 500 THEN 'ERROR' WHEN status_code >= 400 THEN 'WARNING' ELSE 'INFO' END) AS level,
    coalesce(event, '{S.DEFAULT_LOG_EVENT}') AS event, method, endpoint, status_code,
    coalesce(response_time_ms, round_even(execution_time_seconds * 1000, 2)) AS response_time_ms,
    coalesce(message, CASE WHEN coalesce(method, '') = '' AND coalesce(endpoint, '') = '' THEN 'API request'
        ELSE concat_ws(' ', nullif(method, ''), nullif(endpoint, '')) END
        || CASE WHEN status_code IS NULL THEN ' completed' ELSE ' returned HTTP ' || status_code END) AS message, metadata
FROM fx_raw_logs"""
STORED = {"logs": NORMAL_SQL}


def stored(spark, folder):
    return logs.stored_logs(load(spark, folder, "fx_raw_logs"))


@add("normalised_logs", cte("fx_raw_logs", **STORED) + "SELECT * FROM logs")
def _(spark, folder):
    return stored(spark, folder)


@add("log_metadata", "SELECT event_id AS log_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, folder):
    return stored(spark, folder).select("log_id", logs.metadata_value("$.k").cast("bigint").alias("k"))


# Statuses and times shifted so that some break the rules.
BROKEN_SQL = """
SELECT log_id, service, CASE WHEN log_id % 19 = 0 THEN 'FATAL' ELSE level END AS level,
    CASE WHEN log_id % 23 = 0 THEN repeat('e', 101) ELSE event END AS event,
    CASE WHEN log_id % 29 = 0 THEN '' ELSE message END AS message,
    CASE WHEN log_id % 31 = 0 THEN 'PROPPATCHED' ELSE method END AS method, endpoint,
    CASE WHEN log_id % 37 = 0 THEN 600 ELSE status_code END AS status_code,
    CASE WHEN log_id % 41 = 0 THEN -1.0 ELSE response_time_ms END AS response_time_ms, execution_time_seconds
FROM fx_raw_logs"""
LOG_RULES_SQL = {
    "service_length": "length(service) BETWEEN 1 AND 100",
    "event_length": "length(event) <= 100",
    "message_length": "length(message) BETWEEN 1 AND 2000",
    "method_length": "length(method) <= 10",
    "endpoint_length": "length(endpoint) <= 500",
    "status_code_range": "status_code BETWEEN 100 AND 599",
    "response_time_sign": "response_time_ms >= 0",
    "execution_time_sign": "execution_time_seconds >= 0",
    "level_domain": f"level IN {in_list(S.LOG_LEVELS)}",
}


@add("log_rule_failures", cte("fx_raw_logs", broken=BROKEN_SQL) + rule_counts_sql(LOG_RULES_SQL, "broken", missing_passes=True))
def _(spark, folder):
    log_id = F.col("log_id")
    rows = load(spark, folder, "fx_raw_logs").withColumns({
        "level": F.when(log_id % 19 == 0, "FATAL").otherwise(F.col("level")),
        "event": F.when(log_id % 23 == 0, F.repeat(F.lit("e"), 101)).otherwise(F.col("event")),
        "message": F.when(log_id % 29 == 0, "").otherwise(F.col("message")),
        "method": F.when(log_id % 31 == 0, "PROPPATCHED").otherwise(F.col("method")),
        "status_code": F.when(log_id % 37 == 0, 600).otherwise(F.col("status_code")),
        "response_time_ms": F.when(log_id % 41 == 0, -1.0).otherwise(F.col("response_time_ms")),
    })
    return V.failure_counts(rows, V.log_rules())


@add("request_logs", """
SELECT event_id, CASE event_type WHEN 'view' THEN '/health' WHEN 'click' THEN '/' ELSE '/api/' || event_type END AS endpoint,
    round_even(value / 777::DOUBLE, 4) AS execution_time_seconds FROM events WHERE event_type NOT IN ('view', 'click')""")
def _(spark, folder):
    kind = F.col("event_type")
    rows = load(spark, folder, "events").select(
        "event_id",
        F.when(kind == "view", "/health").when(kind == "click", "/").otherwise(F.concat(F.lit("/api/"), kind)).alias("endpoint"),
        (F.col("value") / F.lit(777.0)).alias("execution_time_seconds"),
    )
    return logs.request_logs(rows)


PROBES_SQL = """
SELECT log_id, coalesce(service, 'api-gateway') AS service, status_code,
    CASE WHEN status_code IS NULL THEN 'connection refused' END AS error FROM fx_raw_logs"""
CHECKS_SQL = """
SELECT log_id, service, status_code, error, CASE WHEN coalesce(status_code BETWEEN 200 AND 299, FALSE) THEN 'healthy' ELSE 'unhealthy' END AS status,
    CASE WHEN coalesce(status_code BETWEEN 200 AND 299, FALSE) THEN 'INFO' ELSE 'ERROR' END AS level, 'health_check' AS event,
    CASE WHEN coalesce(status_code BETWEEN 200 AND 299, FALSE) THEN service || ' is healthy'
        ELSE service || ' health check failed: ' || coalesce(error, 'HTTP ' || status_code) END AS message
FROM probes"""


def _checks(spark, folder):
    probes = load(spark, folder, "fx_raw_logs").select(
        "log_id", F.coalesce("service", F.lit("api-gateway")).alias("service"), "status_code",
        F.when(F.col("status_code").isNull(), "connection refused").alias("error"))
    return logs.health_checks(probes)


@add("health_checks", cte("fx_raw_logs", probes=PROBES_SQL) + CHECKS_SQL)
def _(spark, folder):
    return _checks(spark, folder)


@add("overall_status", cte("fx_raw_logs", probes=PROBES_SQL, checks=CHECKS_SQL) + """
SELECT count(*) AS services, count(*) FILTER (WHERE level = 'INFO') AS healthy_services,
    CASE WHEN bool_and(level = 'INFO') THEN 'healthy' ELSE 'degraded' END AS overall_status
FROM (SELECT service, arg_max(level, log_id) AS level FROM checks GROUP BY service)""")
def _(spark, folder):
    return logs.overall_status(_checks(spark, folder))


@add("log_totals", cte("fx_raw_logs", **STORED) + """
SELECT count(*) AS total_logs, CAST(sum(CASE WHEN level IN ('ERROR', 'CRITICAL') THEN 1 ELSE 0 END) AS BIGINT) AS total_errors,
    CAST(sum(CASE WHEN level = 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS total_warnings,
    round(avg(response_time_ms), 6) AS average_response_time_ms, max(response_time_ms) AS maximum_response_time_ms FROM logs""")
def _(spark, folder):
    totals = logs.log_totals(stored(spark, folder))
    return totals.withColumn("average_response_time_ms", F.round("average_response_time_ms", 6))


@add("log_metrics_by_service", cte("fx_raw_logs", **STORED) + """
SELECT service, count(*) AS total_logs, CAST(sum(CASE WHEN level IN ('ERROR', 'CRITICAL') THEN 1 ELSE 0 END) AS BIGINT) AS errors,
    round(avg(response_time_ms), 6) AS average_response_time_ms FROM logs GROUP BY service""")
def _(spark, folder):
    metrics = logs.log_metrics_by_service(stored(spark, folder))
    return metrics.withColumn("average_response_time_ms", F.round("average_response_time_ms", 6))


for _column in ("service", "level"):
    def _facet(spark, folder, column=_column):
        return logs.facet(stored(spark, folder), column)

    add(f"log_{_column}s", cte("fx_raw_logs", **STORED) + f"SELECT DISTINCT {_column} FROM logs")(_facet)


@add("latest_logs", cte("fx_raw_logs", **STORED) + "SELECT * FROM logs ORDER BY log_id DESC LIMIT 100")
def _(spark, folder):
    return logs.latest_logs(stored(spark, folder))


@add("log_by_id", cte("fx_raw_logs", **STORED) + "SELECT * FROM logs WHERE log_id = 42")
def _(spark, folder):
    return lookups.log_by_id(stored(spark, folder), 42)


@add("latest_gateway_errors", cte("fx_raw_logs", **STORED) +
     "SELECT * FROM logs WHERE service = 'api-gateway' AND level = 'ERROR' ORDER BY log_id DESC LIMIT 25")
def _(spark, folder):
    return logs.latest_logs(stored(spark, folder), 25, "api-gateway", "ERROR")


@add("retained_logs", cte("fx_raw_logs", **STORED) + "SELECT * FROM logs ORDER BY log_id DESC LIMIT 5000")
def _(spark, folder):
    return logs.retain(stored(spark, folder))


# --- Maintenance ----------------------------------------------------------------------------
LAST_FIELDS_SQL = ", ".join(
    f'arg_max("{c}", position) FILTER (WHERE "{c}" IS NOT NULL) AS "{c}"' for c in S.CUSTOMER_FIELDS)
FOLDED = {
    "folded": f"SELECT phone_number, arg_min(batch_id, position) AS batch_id, min(position) AS first_position, "
              f"{LAST_FIELDS_SQL} FROM incoming GROUP BY phone_number",
    "upserted": "SELECT k.customer_id, k.phone_number, k.batch_id, "
                + ", ".join(f'coalesce(f."{c}", k."{c}") AS "{c}"' for c in S.CUSTOMER_FIELDS)
                + ", f.phone_number IS NOT NULL AS touched FROM kept k LEFT JOIN folded f USING (phone_number) UNION ALL "
                  "SELECT (SELECT max(customer_id) FROM kept) + row_number() OVER (ORDER BY first_position, phone_number), "
                  f"phone_number, batch_id, {CUSTOMER_COLUMNS}, TRUE FROM folded "
                  "WHERE phone_number NOT IN (SELECT phone_number FROM kept)",
}
KEPT_ONLY = {"kept": KEPT_SQL["kept"]}


# A tenth of the ages is left out, so that a later row does not replace an earlier value.
@add("upserted_customers", cte("fx_customers", "fx_upload", **KEPT_ONLY, typed=TYPED_UPLOAD_SQL, incoming=
     "SELECT * REPLACE (CASE WHEN position % 10 = 0 THEN NULL ELSE age END AS age) FROM typed WHERE phone_number IS NOT NULL",
     **FOLDED) + f"SELECT customer_id, phone_number, batch_id, {CUSTOMER_COLUMNS}, touched FROM upserted")
def _(spark, folder):
    typed = V.typed_upload(load(spark, folder, "fx_upload")).filter(F.col("phone_number").isNotNull())
    incoming = typed.withColumn("age", F.when(F.col("position") % 10 != 0, F.col("age")))
    kept = maintain.insert_defaults(_kept(spark, folder), "customers", CLOCK).withColumn(
        "updated_at", F.lit(None).cast("timestamp"))
    state = maintain.upsert_customers(kept, incoming, CLOCK)
    return state.withColumn("touched", F.col("updated_at").isNotNull()).drop("prediction_status", "created_at", "updated_at")


# Each order patches its customer: the job every third time, the balance every fourth (every eighth to NULL).
@add("patched_customers", cte("fx_customers", patches="""
SELECT o_custkey AS customer_id,
    arg_max({'v': 'job' || CAST(o_orderkey % 5 AS VARCHAR)}, o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS job_change,
    arg_max({'v': CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END}, o_orderkey)
        FILTER (WHERE o_orderkey % 4 = 0) AS balance_change
FROM orders GROUP BY 1""") + """
SELECT c.* REPLACE (CASE WHEN job_change IS NULL THEN job ELSE job_change.v END AS job,
    CASE WHEN balance_change IS NULL THEN balance ELSE balance_change.v END AS balance)
FROM fx_customers c LEFT JOIN patches USING (customer_id)""")
def _(spark, folder):
    key = F.col("o_orderkey")
    null = F.lit(None).cast("string")
    job = F.create_map(F.lit("job"), F.concat(F.lit("job"), (key % 5).cast("string")))
    balance = F.create_map(F.lit("balance"), F.when(key % 8 == 0, null).otherwise(key.cast("string")))
    empty = F.create_map().cast("map<string,string>")
    changes = load(spark, folder, "orders").select(
        F.col("o_custkey").alias("customer_id"), key.alias("position"),
        F.map_concat(F.when(key % 3 == 0, job).otherwise(empty), F.when(key % 4 == 0, balance).otherwise(empty)).alias("fields"),
    )
    state = maintain.patch_customers(customer_table(spark, folder), changes, CLOCK)
    return state.drop("prediction_status", "created_at", "updated_at")


@add("deleted_customers", cte("fx_customers", "fx_campaign_history", "fx_predictions") + """
SELECT 'customers' AS "table", count(*) AS remaining FROM fx_customers WHERE customer_id % 7 <> 0
UNION ALL SELECT 'campaign_history', count(*) FROM fx_campaign_history WHERE customer_id % 7 <> 0
UNION ALL SELECT 'predictions', count(*) FROM fx_predictions WHERE customer_id % 7 <> 0""")
def _(spark, folder):
    people = customers(spark, folder)
    states = maintain.delete_customers(
        people.filter(F.col("customer_id") % 7 == 0), people,
        load(spark, folder, "fx_campaign_history"), load(spark, folder, "fx_predictions"))
    counts = [
        df.agg(F.lit(name).alias("table"), F.count("*").alias("remaining"))
        for name, df in zip(("customers", "campaign_history", "predictions"), states)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# Every upload arrives once per nation and again per region; half of the nations are known.
@add("registered_batches", cte("fx_batch_uploads", known=KNOWN_BATCHES_SQL,
     uploads="SELECT sha256(n_name) AS file_hash, n_name || '.csv' AS file_name, 10 + n_nationkey AS total_records, n_nationkey AS position FROM nation "
             "UNION ALL SELECT sha256(n_name), n_name || '_again.csv', 10 + n_nationkey, 100 + n_nationkey FROM nation",
     once="SELECT file_hash, arg_min(file_name, position) AS file_name, arg_min(total_records, position) AS total_records, "
          "min(position) AS first_position FROM uploads WHERE file_hash NOT IN (SELECT file_hash FROM known) GROUP BY 1") + """
SELECT batch_id, file_name, total_records, file_hash, status FROM known UNION ALL
SELECT (SELECT max(batch_id) FROM known) + row_number() OVER (ORDER BY first_position), file_name, total_records, file_hash, 'pending' FROM once""")
def _(spark, folder):
    known = maintain.insert_defaults(_known_batches(spark, folder), "batch_uploads", CLOCK)
    nation = load(spark, folder, "nation")
    uploads = [
        nation.select(F.sha2("n_name", 256).alias("file_hash"), F.concat("n_name", F.lit(ending)).alias("file_name"),
                      (F.col("n_nationkey") + 10).alias("total_records"), (F.col("n_nationkey") + shift).alias("position"))
        for ending, shift in ((".csv", 0), ("_again.csv", 100))
    ]
    state = maintain.register_batches(known, uploads[0].unionByName(uploads[1]), CLOCK)
    return state.drop("created_at", "uploaded_at")


@add("completed_customers", cte("fx_customers", "fx_predictions") + """
SELECT customer_id, CASE WHEN customer_id IN (SELECT customer_id FROM fx_predictions) THEN 'COMPLETED' ELSE 'PENDING' END
    AS prediction_status FROM fx_customers""")
def _(spark, folder):
    state = maintain.completed_status(customer_table(spark, folder), load(spark, folder, "fx_predictions"))
    return state.select("customer_id", "prediction_status")


@add("rows_to_resume", cte("fx_customers", "fx_predictions") + """
SELECT * FROM fx_customers WHERE batch_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM fx_predictions)""")
def _(spark, folder):
    rows = customers(spark, folder).filter(F.col("batch_id").isNotNull())
    return maintain.rows_to_resume(rows, load(spark, folder, "fx_predictions"))


@add("migrated_customers", cte("fx_customers") + "SELECT * FROM fx_customers")
def _(spark, folder):
    old = customers(spark, folder).withColumnsRenamed({new: old for old, new in maintain.RENAMED.items()})
    return maintain.migrate_columns(old)


@add("migrated_batches", cte("fx_batch_uploads") + f"""
SELECT batch_id, file_name, total_records, file_hash AS content_hash, file_hash, 'pending' AS status, {CLOCK_SQL} AS created_at
FROM fx_batch_uploads""")
def _(spark, folder):
    old = load(spark, folder, "fx_batch_uploads").drop("status").withColumnRenamed("file_hash", "content_hash")
    return maintain.migrate_batches(old, CLOCK)


# --- Batch scoring flow with a fixed score column -------------------------------------------
FLOW = {
    **KEPT_ONLY,
    "typed": TYPED_UPLOAD_SQL,
    "incoming": "SELECT * EXCLUDE (batch_id), 26 AS batch_id, "
                f"((position * 7919 + 13) % 10001)::DOUBLE / 10000::DOUBLE AS p FROM typed WHERE {VALID_SQL}",
    **FOLDED,
    "added": "SELECT (SELECT max(o_orderkey) FROM orders) + position AS prediction_id, "
             "(SELECT max(o_orderkey) FROM orders) + position AS campaign_id, u.customer_id, i.phone_number, i.batch_id, "
             "CASE WHEN p >= 0.6::DOUBLE THEN 'Yes' ELSE 'No' END AS prediction, round_even(p, 4) AS probability, "
             + ", ".join(f"i.{c}" for c in S.CAMPAIGN_FIELDS) + " FROM incoming i JOIN upserted u USING (phone_number)",
}
FLOW_TABLES = ("fx_customers", "fx_upload", "fx_batch_uploads", "fx_predictions")


def _flow(spark, folder):
    uploads = load(spark, folder, "fx_upload").drop("batch_id").withColumns({
        "file_hash": F.sha2(F.lit("new upload"), 256), "file_name": F.lit("upload.csv")})
    tables = batch_scoring.CampaignTables(
        batches=maintain.insert_defaults(load(spark, folder, "fx_batch_uploads"), "batch_uploads", CLOCK),
        customers=maintain.insert_defaults(_kept(spark, folder), "customers", CLOCK),
        campaigns=load(spark, folder, "fx_campaign_history"),
        predictions=flagged(spark, folder).drop("subscribed", "priority"),
    )

    tables.marks = batch_scoring.Marks.of(tables)

    def fixed_score(df):
        score = (F.col("position") * 7919 + 13) % 10001
        return df.withColumn("probability", score.cast("double") / F.lit(10000.0))

    return batch_scoring.score_uploads(tables, uploads, fixed_score, CLOCK, strict=False)


@add("batch_flow_customers", cte(*FLOW_TABLES, **FLOW) + f"""
SELECT customer_id, phone_number, batch_id, {CUSTOMER_COLUMNS}, CASE WHEN customer_id IN (SELECT customer_id FROM added)
    THEN 'COMPLETED' ELSE 'PENDING' END AS prediction_status FROM upserted""")
def _(spark, folder):
    return _flow(spark, folder).tables.customers.drop("created_at", "updated_at")


@add("batch_flow_predictions", cte(*FLOW_TABLES, **FLOW, **FLAGGED) + f"""
SELECT prediction_id, customer_id, prediction, probability, predicted_at, NULL AS model_version FROM flagged
UNION ALL SELECT prediction_id, customer_id, prediction, probability, {CLOCK_SQL}, '{S.MODEL_VERSION}' FROM added""")
def _(spark, folder):
    return _flow(spark, folder).tables.predictions


@add("batch_flow_campaigns", cte(*FLOW_TABLES, "fx_campaign_history", **FLOW) + f"""
SELECT campaign_id, customer_id, {CAMPAIGN_COLUMNS} FROM fx_campaign_history
UNION ALL SELECT campaign_id, customer_id, {CAMPAIGN_COLUMNS} FROM added""")
def _(spark, folder):
    return _flow(spark, folder).tables.campaigns.drop("created_at", "updated_at")


@add("batch_flow_status", cte(*FLOW_TABLES, **FLOW, counted="""
SELECT u.batch_id, count(*) AS n FROM (SELECT customer_id FROM fx_predictions UNION ALL SELECT customer_id FROM added) p
JOIN upserted u USING (customer_id) GROUP BY 1""") + """
SELECT b.batch_id, b.file_name, b.total_records, CASE WHEN coalesce(n, 0) >= b.total_records AND b.total_records > 0 THEN 'completed'
    WHEN b.batch_id IN (SELECT batch_id FROM upserted) THEN 'processing' ELSE 'pending' END AS status
FROM (SELECT batch_id, file_name, total_records FROM fx_batch_uploads
      UNION ALL SELECT 26, 'upload.csv', (SELECT count(*) FROM fx_upload)) b LEFT JOIN counted USING (batch_id)""")
def _(spark, folder):
    return _flow(spark, folder).tables.batches.select("batch_id", "file_name", "total_records", "status")


@add("unscored_rows", cte(*FLOW_TABLES, **FLOW) + "SELECT count(*) FILTER (WHERE probability IS NULL OR prediction IS NULL) AS unscored FROM added")
def _(spark, folder):
    return batch_scoring.unscored(_flow(spark, folder).results)
