"""Scans, filters, validation, joins, aggregates and rankings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta import schemas as S
from prospecta.functions import scalars as X
from prospecta.functions import validation as V
from prospecta.operators import campaign, lookups, maintain, quality
from prospecta.workload.fixtures import Registry, cte, load

registry = Registry()
add = registry.add

CLOCK = datetime(2024, 6, 1, 12, 0, 0)
CLOCK_SQL = "TIMESTAMP '2024-06-01 12:00:00'"

# --- SQL fragments --------------------------------------------------------------------------
BLANKS_SQL = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
NUMBER_SQL = "TRY_CAST(probability AS DOUBLE)"
FLAG_SQL = (
    f"coalesce(lower(trim(prediction, {BLANKS_SQL})) IN "
    f"({', '.join(repr(w) for w in S.SUBSCRIBER_WORDS)}), FALSE)"
)
TIER_SQL = (
    "CASE WHEN p IS NULL THEN 'Unknown' WHEN p >= 0.7::DOUBLE THEN 'High' "
    "WHEN p >= 0.6::DOUBLE THEN 'Medium' ELSE 'Low' END"
)
FLAGGED = {
    "numbered": f"SELECT *, {NUMBER_SQL} AS p FROM fx_predictions",
    "flagged": "SELECT prediction_id, customer_id, prediction, p AS probability, predicted_at, "
               f"{FLAG_SQL} AS subscribed, {TIER_SQL} AS priority FROM numbered",
}
KPI_SQL = (
    "count(*) AS customers_scored, count(*) FILTER (WHERE subscribed) AS predicted_subscribers, "
    "count(*) FILTER (WHERE probability >= 0.7::DOUBLE) AS high_priority, "
    "count(*) FILTER (WHERE probability >= 0.6::DOUBLE AND probability < 0.7::DOUBLE) AS medium_priority, "
    "count(*) FILTER (WHERE probability < 0.6::DOUBLE) AS low_priority"
)
CUSTOMER_COLUMNS = ", ".join(f'"{c}"' for c in S.CUSTOMER_FIELDS)
CAMPAIGN_COLUMNS = ", ".join(S.CAMPAIGN_FIELDS)


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


CUSTOMER_RULES_SQL = {
    "phone_format": "regexp_full_match(phone_number, '[0-9]{8}')",
    **{f"{name}_domain": f'"{name}" IN {in_list(values)}' for name, values in S.DOMAINS.items()},
    "age_range": "age BETWEEN 18 AND 100",
    "balance_range": "balance >= -1000000",
    "day_range": "day BETWEEN 1 AND 31",
    "campaign_range": "campaign >= 1",
    "pdays_range": "pdays >= -1",
    "previous_range": "previous >= 0",
}


def _to_int_sql(name: str) -> str:
    return f"CAST(trunc(TRY_CAST({name} AS DOUBLE)) AS INT) AS {name}"


TYPED_UPLOAD_SQL = (
    f"SELECT position, batch_id, trim(phone_number, {BLANKS_SQL}) AS phone_number, {_to_int_sql('age')}, job, marital, "
    f'education, "default", TRY_CAST(balance AS DOUBLE) AS balance, housing, loan, contact, {_to_int_sql("day")}, '
    f"month, {_to_int_sql('campaign')}, {_to_int_sql('pdays')}, {_to_int_sql('previous')}, poutcome FROM fx_upload"
)
VALID_SQL = " AND ".join(f"coalesce({test}, FALSE)" for test in CUSTOMER_RULES_SQL.values())


def rule_counts_sql(rules: dict[str, str], source: str, missing_passes: bool = False) -> str:
    default = "TRUE" if missing_passes else "FALSE"
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (WHERE NOT coalesce({test}, {default})) AS failures FROM {source}"
        for name, test in rules.items()
    )


# --- Fixtures as the operators expect them --------------------------------------------------
def customers(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "fx_customers")


def customer_table(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the columns that inserts fill in."""
    return maintain.insert_defaults(customers(spark, folder), "customers", CLOCK)


def flagged(spark: SparkSession, folder: str) -> DataFrame:
    return quality.with_subscription_flags(load(spark, folder, "fx_predictions").drop("model_version"))


def typed_upload(spark: SparkSession, folder: str) -> DataFrame:
    return V.typed_upload(load(spark, folder, "fx_upload"))


# --- Scans ----------------------------------------------------------------------------------
@add("scan_customers", cte("fx_customers") + "SELECT * FROM fx_customers")
def _(spark, folder):
    return customers(spark, folder)


@add("scan_campaign_history", cte("fx_campaign_history") + "SELECT * FROM fx_campaign_history")
def _(spark, folder):
    return load(spark, folder, "fx_campaign_history")


@add("scan_predictions", cte("fx_predictions", **FLAGGED)
     + "SELECT prediction_id, customer_id, prediction, probability, predicted_at FROM flagged")
def _(spark, folder):
    return flagged(spark, folder).drop("subscribed", "priority")


@add("scan_batches", cte("fx_batch_uploads") + "SELECT * FROM fx_batch_uploads")
def _(spark, folder):
    return load(spark, folder, "fx_batch_uploads")


HISTORICAL_SQL = (
    "SELECT o.o_orderkey AS historical_id, c.age, c.job, c.marital, c.education, c.\"default\", c.balance, c.housing, "
    "c.loan, h.contact, h.day, h.month, h.campaign, h.pdays, h.previous, h.poutcome, "
    "CASE WHEN o.o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS actual_subscription "
    "FROM orders o JOIN fx_customers c ON c.customer_id = o.o_custkey "
    "JOIN fx_campaign_history h ON h.campaign_id = o.o_orderkey"
)


@add("scan_historical", cte("fx_customers", "fx_campaign_history") + HISTORICAL_SQL)
def _(spark, folder):
    outcomes = load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("campaign_id"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("actual_subscription"),
    )
    rows = load(spark, folder, "fx_campaign_history").drop("created_at").join(outcomes, "campaign_id")
    return rows.join(customers(spark, folder), "customer_id").select(
        F.col("campaign_id").alias("historical_id"), *[f"`{c}`" for c in S.FEATURES], "actual_subscription"
    )


# --- Projections and scalars ----------------------------------------------------------------
CLEAN_NAMES_SQL = ", ".join(f'{raw} AS "{name}"' for raw, name in S.TRAINING_COLUMNS.items())


@add("rename_training_columns", cte("fx_raw_bank") + f"SELECT {CLEAN_NAMES_SQL} FROM fx_raw_bank")
def _(spark, folder):
    return quality.rename_training(load(spark, folder, "fx_raw_bank"))


# The fixture holds the classes 1 and 2 only, so another code comes from the line number.
@add("recode_target",
     "SELECT l_linenumber AS code, CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 END AS target, count(*) AS records "
     "FROM lineitem GROUP BY ALL")
def _(spark, folder):
    codes = load(spark, folder, "lineitem").select(F.col("l_linenumber").alias("code"))
    recoded = codes.withColumn("target", quality.recode_target(F.col("code")))
    return recoded.groupBy("code", "target").agg(F.count("*").alias("records"))


FEATURE_NAMES_SQL = ", ".join(f'"{name}"' for name in [*S.FEATURES, "target"])
CLEAN = {
    "renamed": f"SELECT DISTINCT {CLEAN_NAMES_SQL} FROM fx_raw_bank",
    "cleaned": "SELECT * REPLACE (CASE target WHEN 1 THEN 0 WHEN 2 THEN 1 END AS target) FROM renamed",
}


@add("feature_frame", cte("fx_raw_bank", **CLEAN) + f"SELECT {FEATURE_NAMES_SQL} FROM cleaned")
def _(spark, folder):
    return quality.feature_frame(quality.clean(load(spark, folder, "fx_raw_bank")))


@add("customer_rule_failures", cte("fx_upload", typed=TYPED_UPLOAD_SQL) + rule_counts_sql(CUSTOMER_RULES_SQL, "typed"))
def _(spark, folder):
    return V.failure_counts(typed_upload(spark, folder), V.customer_rules())


@add("quarantined_records", cte("fx_upload", typed=TYPED_UPLOAD_SQL)
     + "SELECT position, concat_ws(',', "
     + ", ".join(f"CASE WHEN NOT coalesce({test}, FALSE) THEN '{name}' END" for name, test in CUSTOMER_RULES_SQL.items())
     + f") AS failed FROM typed WHERE NOT ({VALID_SQL})")
def _(spark, folder):
    _, bad = V.split_valid(typed_upload(spark, folder), V.customer_rules())
    return bad.select("position", F.concat_ws(",", "failed_rules").alias("failed"))


@add("valid_records", cte("fx_upload", typed=TYPED_UPLOAD_SQL) + f"SELECT * FROM typed WHERE {VALID_SQL}")
def _(spark, folder):
    good, _ = V.split_valid(typed_upload(spark, folder), V.customer_rules())
    return good


@add("upload_checks", cte("fx_upload") + f"""
SELECT *, CASE WHEN records = 0 THEN 'empty_file' WHEN null_phones > 0 THEN 'null_phone'
    WHEN blank_phones > 0 THEN 'blank_phone' ELSE 'ok' END AS verdict
FROM (SELECT count(*) AS records, count(*) FILTER (WHERE phone_number IS NULL) AS null_phones,
    count(*) FILTER (WHERE trim(phone_number, {BLANKS_SQL}) = '') AS blank_phones FROM fx_upload)""")
def _(spark, folder):
    return V.upload_checks(load(spark, folder, "fx_upload"))


@add("typed_upload", cte("fx_upload") + TYPED_UPLOAD_SQL)
def _(spark, folder):
    return typed_upload(spark, folder)


@add("coerce_probability", cte("fx_predictions", **FLAGGED) + "SELECT prediction_id, p AS probability FROM numbered")
def _(spark, folder):
    return load(spark, folder, "fx_predictions").select(
        "prediction_id", X.to_number(F.col("probability")).alias("probability")
    )


@add("subscriber_flag", cte("fx_predictions", **FLAGGED) + "SELECT prediction_id, prediction, subscribed FROM flagged")
def _(spark, folder):
    return flagged(spark, folder).select("prediction_id", "prediction", "subscribed")


@add("campaign_priority", cte("fx_predictions", **FLAGGED) + "SELECT prediction_id, probability, priority FROM flagged")
def _(spark, folder):
    return flagged(spark, folder).select("prediction_id", "probability", "priority")


# Scores with more than four places, so that rounding and the decision can disagree.
FINE_SCORE_SQL = "SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(l_orderkey * 7919 % 1000003 AS DOUBLE) / 1000003::DOUBLE AS p FROM lineitem"


@add("decision_and_rounding", cte(fine=FINE_SCORE_SQL) + f"""
SELECT l_orderkey, l_linenumber, CASE WHEN p >= 0.6::DOUBLE THEN 1 ELSE 0 END AS prediction,
    CASE WHEN p >= 0.6::DOUBLE THEN 'Yes' ELSE 'No' END AS subscription,
    round_even(p, 4) AS probability, round_even(p * 100, 1) AS probability_pct,
    CASE WHEN round_even(p, 4) >= 0.7::DOUBLE THEN 'High' WHEN round_even(p, 4) >= 0.6::DOUBLE THEN 'Medium' ELSE 'Low' END AS priority
FROM fine""")
def _(spark, folder):
    p = F.col("p")
    fine = load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        ((F.col("l_orderkey") * 7919 % 1000003).cast("double") / F.lit(1000003.0)).alias("p"),
    )
    return fine.select(
        "l_orderkey", "l_linenumber", X.decide(p).alias("prediction"),
        X.subscription(X.decide(p)).alias("subscription"),
        X.stored_probability(p).alias("probability"), X.percent(p).alias("probability_pct"),
        X.priority(X.stored_probability(p)).alias("priority"),
    )


RESULT_SQL = (
    "SELECT r.prediction_id, r.customer_id, r.prediction, r.probability, r.predicted_at, r.subscribed, r.priority, "
    "c.phone_number, c.batch_id FROM flagged r JOIN fx_customers c USING (customer_id)"
)
LABEL_SQL = "CASE priority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.PRIORITY_LABELS.items()) + " END"


@add("presented_results", cte("fx_predictions", "fx_customers", **FLAGGED, results=RESULT_SQL) + f"""
SELECT prediction_id, predicted_at, customer_id AS "Customer ID", batch_id AS "Batch ID",
    phone_number AS "Phone Number", prediction AS "Predicted Subscription",
    round_even(probability * 100, 1) AS "Subscription Probability (%)", {LABEL_SQL} AS "Campaign Priority"
FROM results""")
def _(spark, folder):
    members = customers(spark, folder).select("customer_id", "phone_number", "batch_id")
    return lookups.present(flagged(spark, folder).join(members, "customer_id"))


@add("balance_currencies", cte("fx_customers") +
     "SELECT customer_id, round(balance / 1.48::DOUBLE, 6) AS eur, round(balance * 1.48::DOUBLE, 6) AS sgd FROM fx_customers")
def _(spark, folder):
    balance = F.col("balance")
    return customers(spark, folder).select(
        "customer_id", F.round(X.sgd_to_eur(balance), 6).alias("eur"), F.round(X.eur_to_sgd(balance), 6).alias("sgd")
    )


# --- Point filters --------------------------------------------------------------------------
@add("customer_by_id", cte("fx_customers") + "SELECT * FROM fx_customers WHERE customer_id = 42")
def _(spark, folder):
    return lookups.customer_by_id(customers(spark, folder), 42)


@add("predictions_of_customer", cte("fx_predictions", **FLAGGED) + "SELECT * FROM flagged WHERE customer_id = 7")
def _(spark, folder):
    return lookups.predictions_of_customer(flagged(spark, folder), 7)


@add("campaigns_of_customer", cte("fx_campaign_history") + "SELECT * FROM fx_campaign_history WHERE customer_id = 7")
def _(spark, folder):
    return lookups.campaigns_of_customer(load(spark, folder, "fx_campaign_history"), 7)


@add("batch_by_id", cte("fx_batch_uploads") + "SELECT * FROM fx_batch_uploads WHERE batch_id = 3")
def _(spark, folder):
    return lookups.batch_by_id(load(spark, folder, "fx_batch_uploads"), 3)


@add("customers_of_batch", cte("fx_customers") + "SELECT * FROM fx_customers WHERE batch_id = 3")
def _(spark, folder):
    return lookups.customers_of_batch(customers(spark, folder), 3)


@add("pending_customers", cte("fx_customers", "fx_predictions") +
     "SELECT * FROM fx_customers WHERE customer_id NOT IN (SELECT customer_id FROM fx_predictions)")
def _(spark, folder):
    status = maintain.completed_status(customer_table(spark, folder), load(spark, folder, "fx_predictions"))
    return lookups.pending_customers(status).drop("prediction_status", "created_at", "updated_at")


@add("customer_by_phone", cte("fx_customers") + "SELECT * FROM fx_customers WHERE trim(phone_number) = '90000042'")
def _(spark, folder):
    return lookups.customer_by_phone(customers(spark, folder), " 90000042 ")


@add("upload_rows_by_phone", cte("fx_upload") +
     f"SELECT * FROM fx_upload WHERE trim(phone_number, {BLANKS_SQL}) = '90000042'")
def _(spark, folder):
    return lookups.customer_by_untrimmed_phone(load(spark, folder, "fx_upload"), " 90000042 ")


@add("file_hash_format", cte("fx_batch_uploads", hashes="""
SELECT batch_id, CASE batch_id % 4 WHEN 0 THEN upper(file_hash) WHEN 1 THEN substr(file_hash, 2) ELSE file_hash END AS file_hash
FROM fx_batch_uploads""") +
     "SELECT batch_id, file_hash, regexp_full_match(file_hash, '[0-9a-f]{64}') AS valid FROM hashes")
def _(spark, folder):
    file_hash = F.col("file_hash")
    place = F.col("batch_id") % 4
    hashes = load(spark, folder, "fx_batch_uploads").select("batch_id", F.when(place == 0, F.upper(file_hash)).when(
        place == 1, F.substring(file_hash, 2, 64)).otherwise(file_hash).alias("file_hash"))
    return hashes.withColumn("valid", ~V.file_hash_rule().broken)


@add("customer_part", cte("fx_upload", typed=TYPED_UPLOAD_SQL) + f"SELECT phone_number, {CUSTOMER_COLUMNS}, batch_id FROM typed")
def _(spark, folder):
    return lookups.customer_part(typed_upload(spark, folder))


@add("campaign_part", cte("fx_upload", typed=TYPED_UPLOAD_SQL) + f"SELECT phone_number, {CAMPAIGN_COLUMNS} FROM typed")
def _(spark, folder):
    return lookups.campaign_part(typed_upload(spark, folder))


@add("model_part", cte("fx_upload", typed=TYPED_UPLOAD_SQL) + f"SELECT {CUSTOMER_COLUMNS}, {CAMPAIGN_COLUMNS} FROM typed")
def _(spark, folder):
    return lookups.model_part(typed_upload(spark, folder))


@add("upload_preview", cte("fx_upload") + """
SELECT position, phone_number, age, job, total_rows, least(10, total_rows) AS shown
FROM (SELECT *, count(*) OVER () AS total_rows FROM fx_upload) ORDER BY position LIMIT 10""")
def _(spark, folder):
    rows = load(spark, folder, "fx_upload").select("position", "phone_number", "age", "job")
    return lookups.preview(rows, ["position"])


@add("batch_header_defaults", cte("fx_batch_uploads", "fx_customers") + f"""
SELECT h.batch_id, CASE WHEN h.batch_id % 3 = 0 AND n IS NOT NULL THEN '{S.DEFAULT_FILE_NAME}'
        WHEN h.batch_id % 3 = 0 THEN NULL ELSE file_name END AS file_name,
    CASE WHEN h.batch_id % 2 = 0 THEN CAST(n AS BIGINT) ELSE CAST(total_records AS BIGINT) END AS total_records
FROM fx_batch_uploads h LEFT JOIN (SELECT batch_id, count(*) AS n FROM fx_customers GROUP BY 1) c USING (batch_id)""")
def _(spark, folder):
    place = F.col("batch_id")
    headers = load(spark, folder, "fx_batch_uploads").select(
        "batch_id",
        F.when(place % 3 != 0, F.col("file_name")).alias("file_name"),
        F.when(place % 2 != 0, F.col("total_records").cast("bigint")).alias("total_records"),
    )
    return maintain.batch_headers(headers, customers(spark, folder))


@add("insert_defaults", cte("fx_customers") + f"""
SELECT *, CASE WHEN customer_id % 5 = 0 THEN 'COMPLETED' ELSE 'PENDING' END AS prediction_status,
    {CLOCK_SQL} AS created_at, {CLOCK_SQL} AS updated_at FROM fx_customers""")
def _(spark, folder):
    rows = customers(spark, folder).withColumn(
        "prediction_status", F.when(F.col("customer_id") % 5 == 0, "COMPLETED")
    )
    return maintain.insert_defaults(rows, "customers", CLOCK)


# --- Joins ----------------------------------------------------------------------------------
@add("batch_results", cte("fx_customers", "fx_predictions", "fx_batch_uploads", **FLAGGED) + """
SELECT c.batch_id, b.file_name, b.total_records, c.customer_id, c.phone_number, c.age, c.job, f.prediction, f.probability, f.predicted_at
FROM flagged f JOIN fx_customers c USING (customer_id) JOIN fx_batch_uploads b ON b.batch_id = c.batch_id""")
def _(spark, folder):
    return campaign.batch_results(
        customers(spark, folder), flagged(spark, folder), load(spark, folder, "fx_batch_uploads"))


@add("results_of_batch", cte("fx_customers", "fx_predictions", "fx_batch_uploads", **FLAGGED) + """
SELECT c.batch_id, b.file_name, b.total_records, c.customer_id, c.phone_number, c.age, c.job, f.prediction, f.probability, f.predicted_at
FROM flagged f JOIN fx_customers c USING (customer_id) JOIN fx_batch_uploads b ON b.batch_id = c.batch_id WHERE b.batch_id = 5""")
def _(spark, folder):
    return campaign.batch_results(
        customers(spark, folder), flagged(spark, folder), load(spark, folder, "fx_batch_uploads"), batch_id=5)


@add("predictions_per_batch", cte("fx_customers", "fx_predictions") + """
SELECT c.batch_id, count(*) AS predictions FROM fx_predictions p JOIN fx_customers c USING (customer_id)
WHERE c.batch_id IS NOT NULL GROUP BY 1""")
def _(spark, folder):
    return campaign.predictions_per_batch(customers(spark, folder), load(spark, folder, "fx_predictions"))


STATUS_SQL = """
SELECT b.* REPLACE (CASE
    WHEN (SELECT count(*) FROM fx_predictions p JOIN fx_customers c ON c.customer_id = p.customer_id
          WHERE c.batch_id = b.batch_id) >= b.total_records AND b.total_records > 0 THEN 'completed'
    WHEN EXISTS (SELECT 1 FROM fx_customers c WHERE c.batch_id = b.batch_id) THEN 'processing'
    ELSE 'pending' END AS status)
FROM fx_batch_uploads b"""


@add("batch_status", cte("fx_customers", "fx_predictions", "fx_batch_uploads") + STATUS_SQL)
def _(spark, folder):
    return campaign.batch_status(
        load(spark, folder, "fx_batch_uploads"), customers(spark, folder), load(spark, folder, "fx_predictions"))


# Whole tables with some keys moved to where nothing looks for them: every third customer has another id and phone number,
# even customers give their campaign rows to the next, every other batch has another file hash, late batches another id.
KEPT_SQL = {
    "kept": "SELECT * REPLACE (CASE WHEN customer_id % 3 = 0 THEN -customer_id ELSE customer_id END AS customer_id, "
            "CASE WHEN customer_id % 3 = 0 THEN '8' || substr(phone_number, 2) ELSE phone_number END AS phone_number) "
            "FROM fx_customers",
    "contacted": "SELECT * REPLACE (CASE WHEN customer_id % 2 = 0 THEN customer_id + 1 ELSE customer_id END AS customer_id) "
                 "FROM fx_campaign_history",
}
KNOWN_BATCHES_SQL = """SELECT * REPLACE (CASE WHEN batch_id % 2 = 1 THEN sha256(file_hash) ELSE file_hash END AS file_hash)
FROM fx_batch_uploads"""


def _kept(spark, folder):
    moved = F.col("customer_id") % 3 == 0
    return customers(spark, folder).withColumns({
        "customer_id": F.when(moved, -F.col("customer_id")).otherwise(F.col("customer_id")),
        "phone_number": F.when(moved, F.concat(F.lit("8"), F.expr("substr(phone_number, 2)"))).otherwise(
            F.col("phone_number")),
    })


def _contacted(spark, folder):
    return load(spark, folder, "fx_campaign_history").withColumn(
        "customer_id", F.col("customer_id") + F.when(F.col("customer_id") % 2 == 0, 1).otherwise(0))


def _known_batches(spark, folder):
    return load(spark, folder, "fx_batch_uploads").withColumn(
        "file_hash", F.when(F.col("batch_id") % 2 == 1, F.sha2("file_hash", 256)).otherwise(F.col("file_hash")))


@add("accepted_predictions", cte("fx_customers", "fx_predictions", "fx_campaign_history", **KEPT_SQL, **FLAGGED) + """
SELECT * FROM flagged WHERE customer_id IN (SELECT customer_id FROM kept)
    AND customer_id IN (SELECT customer_id FROM contacted)""")
def _(spark, folder):
    good, _ = campaign.accept_predictions(flagged(spark, folder), _kept(spark, folder), _contacted(spark, folder))
    return good


@add("rejected_predictions", cte("fx_customers", "fx_predictions", "fx_campaign_history", **KEPT_SQL) + """
SELECT prediction_id, customer_id, CASE WHEN customer_id NOT IN (SELECT customer_id FROM kept) THEN 'customer_not_found'
    ELSE 'no_campaign_data' END AS reason FROM fx_predictions
WHERE customer_id NOT IN (SELECT customer_id FROM kept) OR customer_id NOT IN (SELECT customer_id FROM contacted)""")
def _(spark, folder):
    _, bad = campaign.accept_predictions(flagged(spark, folder), _kept(spark, folder), _contacted(spark, folder))
    return bad.select("prediction_id", "customer_id", "reason")


@add("rejected_campaigns", cte("fx_customers", "fx_campaign_history", **KEPT_SQL) + """
SELECT campaign_id, customer_id, 'customer_not_found' AS reason FROM fx_campaign_history
WHERE customer_id NOT IN (SELECT customer_id FROM kept)""")
def _(spark, folder):
    _, bad = campaign.known_customers(load(spark, folder, "fx_campaign_history"), _kept(spark, folder))
    return bad.select("campaign_id", "customer_id", "reason")


@add("customer_batch_check", cte("fx_customers", "fx_batch_uploads") + """
SELECT customer_id, batch_id, CASE WHEN batch_id IS NULL OR batch_id IN
    (SELECT CASE WHEN batch_id > 15 THEN batch_id + 100 ELSE batch_id END FROM fx_batch_uploads) THEN 'accepted' ELSE 'batch_not_found' END AS verdict FROM fx_customers""")
def _(spark, folder):
    batches = load(spark, folder, "fx_batch_uploads").withColumn(
        "batch_id", F.col("batch_id") + F.when(F.col("batch_id") > 15, 100).otherwise(0))
    good, bad = campaign.accept_customers(customers(spark, folder), batches)
    return good.select("customer_id", "batch_id", F.lit("accepted").alias("verdict")).unionByName(
        bad.select("customer_id", "batch_id", F.col("reason").alias("verdict")))


@add("known_phones", cte("fx_customers", "fx_upload", **KEPT_SQL | {"contacted": "SELECT 1"}, typed=TYPED_UPLOAD_SQL) + """
SELECT position, phone_number, phone_number IN (SELECT phone_number FROM kept) AS known
FROM typed WHERE phone_number IS NOT NULL""")
def _(spark, folder):
    rows = typed_upload(spark, folder).filter(F.col("phone_number").isNotNull()).select("position", "phone_number")
    new, known = campaign.split_known_phones(rows, _kept(spark, folder))
    return new.withColumn("known", F.lit(False)).unionByName(known.withColumn("known", F.lit(True)))


@add("customer_overview", cte("fx_customers", "fx_campaign_history", "fx_predictions", **FLAGGED) + f"""
SELECT c.*, h.campaign_id, {CAMPAIGN_COLUMNS}, f.prediction_id, f.prediction, f.probability FROM fx_customers c
LEFT JOIN (SELECT * FROM fx_campaign_history QUALIFY row_number() OVER (PARTITION BY customer_id
    ORDER BY created_at DESC NULLS LAST, campaign_id DESC) = 1) h USING (customer_id)
LEFT JOIN (SELECT * FROM flagged QUALIFY row_number() OVER (PARTITION BY customer_id
    ORDER BY predicted_at DESC NULLS LAST, prediction_id DESC) = 1) f USING (customer_id)""")
def _(spark, folder):
    table = customers(spark, folder).withColumns({"created_at": F.lit(CLOCK), "updated_at": F.lit(CLOCK)})
    return campaign.customer_overview(table, load(spark, folder, "fx_campaign_history"), flagged(spark, folder))


@add("file_hash_lookup", cte("fx_batch_uploads", incoming="SELECT sha256(n_name) AS file_hash FROM nation "
                             "UNION ALL SELECT sha256(r_name || '?') FROM region",
                             known=KNOWN_BATCHES_SQL) + """
SELECT file_hash, batch_id IS NOT NULL AS "exists", batch_id, status FROM incoming LEFT JOIN known USING (file_hash)""")
def _(spark, folder):
    incoming = load(spark, folder, "nation").select(F.sha2("n_name", 256).alias("file_hash")).unionByName(
        load(spark, folder, "region").select(F.sha2(F.concat("r_name", F.lit("?")), 256).alias("file_hash")))
    return campaign.check_file_hashes(incoming, _known_batches(spark, folder))


@add("predictions_with_job", cte("fx_customers", "fx_predictions", **FLAGGED)
     + "SELECT f.*, c.job FROM flagged f JOIN fx_customers c USING (customer_id)")
def _(spark, folder):
    return campaign.predictions_with_job(flagged(spark, folder), customers(spark, folder))


@add("model_input", cte("fx_customers", "fx_campaign_history") + f"""
SELECT customer_id, {CUSTOMER_COLUMNS}, {CAMPAIGN_COLUMNS} FROM fx_customers JOIN (SELECT * FROM fx_campaign_history
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC NULLS LAST, campaign_id DESC) = 1) h USING (customer_id)""")
def _(spark, folder):
    return campaign.model_input(customers(spark, folder), load(spark, folder, "fx_campaign_history"))


# --- Aggregates -----------------------------------------------------------------------------
# Full rows of the fixture are all different; this narrower projection has real copies.
NARROW = ["V1", "V2", "V3", "V4", "V5", "V7", "V8", "V9", "V13", "V16", "Class"]


@add("deduplicated_rows", cte("fx_raw_bank") + f"SELECT DISTINCT {', '.join(NARROW)} FROM fx_raw_bank")
def _(spark, folder):
    return quality.deduplicate(load(spark, folder, "fx_raw_bank").select(*NARROW))


@add("cleaned_training_rows", cte("fx_raw_bank", **CLEAN) + "SELECT * FROM cleaned")
def _(spark, folder):
    raw = load(spark, folder, "fx_raw_bank")
    return quality.clean(raw.unionByName(raw.filter("V12 < 9")))


@add("data_profile", cte("fx_raw_bank", holed="SELECT * REPLACE (nullif(V16, 'unknown') AS V16) FROM fx_raw_bank",
                        profiled="SELECT * FROM holed UNION ALL SELECT * FROM holed WHERE V12 < 9") + f"""
SELECT count(*) AS row_count, {' + '.join(f'count(*) FILTER (WHERE "{name}" IS NULL)' for name in S.TRAINING_COLUMNS)} AS null_values,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM profiled)) AS duplicate_rows, 17::BIGINT AS column_count
FROM profiled""")
def _(spark, folder):
    """The whole training table, an unknown outcome taken as null, with some rows repeated."""
    raw = load(spark, folder, "fx_raw_bank").withColumn("V16", F.nullif(F.col("V16"), F.lit("unknown")))
    return quality.profile(raw.unionByName(raw.filter("V12 < 9")))


@add("target_distribution", cte("fx_raw_bank", **CLEAN) + """
SELECT target, count(*) AS records, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent
FROM cleaned WHERE target IS NOT NULL GROUP BY target""")
def _(spark, folder):
    cleaned = quality.clean(load(spark, folder, "fx_raw_bank"))
    return quality.target_distribution(cleaned).withColumn("percent", F.round("percent", 6))


@add("class_ratio", cte("fx_raw_bank", **CLEAN) + """
SELECT count(*) FILTER (WHERE target = 0) AS negatives, count(*) FILTER (WHERE target = 1) AS positives,
    round(count(*) FILTER (WHERE target = 0)::DOUBLE / count(*) FILTER (WHERE target = 1), 6) AS ratio FROM cleaned""")
def _(spark, folder):
    cleaned = quality.clean(load(spark, folder, "fx_raw_bank"))
    return quality.class_ratio(cleaned).withColumn("ratio", F.round("ratio", 6))


@add("batch_kpis", cte("fx_customers", "fx_predictions", "fx_batch_uploads", **FLAGGED, kpis=f"""
SELECT c.batch_id, {KPI_SQL} FROM flagged JOIN fx_customers c USING (customer_id) WHERE c.batch_id IS NOT NULL GROUP BY 1""") + """
SELECT b.batch_id, coalesce(customers_scored, 0) AS customers_scored, coalesce(predicted_subscribers, 0) AS predicted_subscribers,
    coalesce(high_priority, 0) AS high_priority, coalesce(medium_priority, 0) AS medium_priority, coalesce(low_priority, 0) AS low_priority,
    CASE WHEN customers_scored > 0 THEN round(predicted_subscribers::DOUBLE / customers_scored, 6) ELSE 0.0::DOUBLE END AS subscription_rate
FROM fx_batch_uploads b LEFT JOIN kpis USING (batch_id)""")
def batch_kpis(spark, folder):
    kpis = campaign.batch_kpis(
        load(spark, folder, "fx_batch_uploads"), customers(spark, folder), flagged(spark, folder))
    return kpis.withColumn("subscription_rate", F.round("subscription_rate", 6))


@add("campaign_kpis", cte("fx_predictions", **FLAGGED) + f"""
SELECT *, round(predicted_subscribers::DOUBLE / customers_scored, 6) AS subscription_rate FROM (SELECT {KPI_SQL} FROM flagged)""")
def _(spark, folder):
    return campaign.campaign_kpis(flagged(spark, folder)).withColumn("subscription_rate", F.round("subscription_rate", 6))


@add("rate_by_job", cte("fx_customers", "fx_predictions", **FLAGGED) + """
SELECT job, round_even(avg(CASE WHEN subscribed THEN 1 ELSE 0 END) * 100, 1) AS subscription_rate_pct
FROM flagged JOIN fx_customers USING (customer_id) GROUP BY job""")
def _(spark, folder):
    return campaign.rate_by_job(flagged(spark, folder), customers(spark, folder))


@add("priority_distribution", cte("fx_predictions", **FLAGGED, tiers=" UNION ALL ".join(
    f"SELECT {i} AS place, '{tier}' AS priority, '{S.PRIORITY_LABELS[tier]}' AS campaign_priority"
    for i, tier in enumerate(S.PRIORITIES))) + """
SELECT t.priority, count(f.prediction_id) AS customers, t.campaign_priority, t.place
FROM tiers t LEFT JOIN flagged f USING (priority) GROUP BY ALL""")
def _(spark, folder):
    return campaign.priority_distribution(flagged(spark, folder))


@add("probability_histogram", cte("fx_predictions", **FLAGGED) + """
SELECT round_even(probability * 100, 0) AS probability_pct, count(*) AS predictions
FROM flagged WHERE probability IS NOT NULL GROUP BY 1""")
def _(spark, folder):
    return campaign.probability_histogram(flagged(spark, folder))


@add("outcome_counts", cte("fx_predictions", **FLAGGED) + """
SELECT 'Predicted Subscribe' AS outcome, count(*) FILTER (WHERE subscribed) AS customers FROM flagged
UNION ALL SELECT 'Predicted No Subscribe', count(*) FILTER (WHERE NOT subscribed) FROM flagged""")
def _(spark, folder):
    return campaign.outcome_counts(flagged(spark, folder))


# --- Order ----------------------------------------------------------------------------------
RANK_SQL = ("CASE WHEN probability >= 0.7::DOUBLE THEN 0 WHEN probability >= 0.6::DOUBLE THEN 1 "
            "WHEN probability IS NOT NULL THEN 2 ELSE 3 END")
for _kind, _order_sql in {
    "priority": f"{RANK_SQL}, probability DESC NULLS LAST",
    "highest": "probability DESC NULLS LAST",
    "lowest": "probability ASC NULLS LAST",
}.items():
    def _build(spark, folder, kind=_kind):
        return campaign.number_results(flagged(spark, folder), kind)

    add(f"results_by_{_kind}", cte("fx_predictions", **FLAGGED) +
        f"SELECT *, row_number() OVER (ORDER BY {_order_sql}, prediction_id) AS position FROM flagged")(_build)


@add("recent_predictions", cte("fx_predictions", **FLAGGED) +
     "SELECT * FROM flagged ORDER BY predicted_at DESC NULLS LAST, prediction_id DESC LIMIT 10")
def _(spark, folder):
    return campaign.recent_predictions(flagged(spark, folder))
