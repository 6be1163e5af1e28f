"""Table schemas and the fixed values the data model is built on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: category domains -------------------------------------------------------
JOBS = [
    "admin.", "blue-collar", "entrepreneur", "housemaid", "management", "retired",
    "self-employed", "services", "student", "technician", "unemployed", "unknown",
]
MARITAL = ["married", "single", "divorced"]
EDUCATION = ["primary", "secondary", "tertiary", "unknown"]
YES_NO = ["yes", "no"]
CONTACTS = ["cellular", "telephone", "unknown"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
OUTCOMES = ["failure", "other", "success", "unknown"]
LOG_LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]

DOMAINS = {
    "job": JOBS,
    "marital": MARITAL,
    "education": EDUCATION,
    "default": YES_NO,
    "housing": YES_NO,
    "loan": YES_NO,
    "contact": CONTACTS,
    "month": MONTHS,
    "poutcome": OUTCOMES,
}

# --- Fixed values: column groups ----------------------------------------------------------
NUMERIC_FEATURES = ["age", "balance", "day", "campaign", "pdays", "previous"]
CATEGORICAL_FEATURES = list(DOMAINS)
CUSTOMER_FIELDS = ["age", "job", "marital", "education", "default", "balance", "housing", "loan"]
CAMPAIGN_FIELDS = ["contact", "day", "month", "campaign", "pdays", "previous", "poutcome"]
FEATURES = CUSTOMER_FIELDS + CAMPAIGN_FIELDS
UPLOAD_FIELDS = ["phone_number"] + FEATURES

# Anonymous names of the training file, in file order; duration is the only one that is no feature.
TRAINING_COLUMNS = {
    "V1": "age",
    "V2": "job",
    "V3": "marital",
    "V4": "education",
    "V5": "default",
    "V6": "balance",
    "V7": "housing",
    "V8": "loan",
    "V9": "contact",
    "V10": "day",
    "V11": "month",
    "V12": "duration",
    "V13": "campaign",
    "V14": "pdays",
    "V15": "previous",
    "V16": "poutcome",
    "Class": "target",
}

# --- Fixed values: thresholds and defaults ------------------------------------------------
DECISION_THRESHOLD = 0.6
HIGH_PRIORITY = 0.70
MEDIUM_PRIORITY = 0.60
SUBSCRIBER_WORDS = ["1", "1.0", "yes", "true", "subscribe", "subscribed"]
PRIORITIES = ["High", "Medium", "Low", "Unknown"]
PRIORITY_LABELS = {
    "High": "🟢 High Priority",
    "Medium": "🟡 Medium Priority",
    "Low": "🔴 Low Priority",
    "Unknown": "⚪ Unknown",
}
EUR_TO_SGD = 1.48
DEFAULT_FILE_NAME = "batch_upload.csv"
DEFAULT_LOG_SERVICE = "api-gateway"
DEFAULT_LOG_EVENT = "api_request"
QUIET_ENDPOINTS = ["/health", "/"]
LOG_PAGE_DEFAULT, LOG_PAGE_MAX = 100, 1000
LOG_RETENTION_DEFAULT, LOG_RETENTION_MIN = 5000, 100
SEED = 42
MODEL_NAME = "Bank Term Deposit Prediction Model"
MODEL_VERSION = "1.0"

_INT, _LONG, _STR, _DBL, _TS = (
    T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType(), T.TimestampType(),
)
_TYPES = {name: _INT for name in ("age", "day", "campaign", "pdays", "previous")} | {"balance": _DBL}


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def _fields(names: list[str]) -> list[tuple[str, T.DataType]]:
    return [(name, _TYPES.get(name, _STR)) for name in names]


# --- Tables -------------------------------------------------------------------------------
RAW_TRAINING = _struct(
    *[(raw, _INT if raw == "Class" or name == "duration" else _TYPES.get(name, _STR))
      for raw, name in TRAINING_COLUMNS.items()]
)
# Every upload column is read as text, so a phone number keeps its leading zero.
UPLOAD_TEXT = _struct(*[(name, _STR) for name in UPLOAD_FIELDS])
HISTORICAL = _struct(
    ("historical_id", _LONG), *_fields(FEATURES), ("actual_subscription", _STR),
    ("predicted_subscription", _STR), ("prediction_probability", _DBL),
)
BATCH_UPLOADS = _struct(
    ("batch_id", _LONG), ("file_name", _STR), ("total_records", _INT), ("file_hash", _STR),
    ("status", _STR), ("created_at", _TS), ("uploaded_at", _TS),
)
CUSTOMERS = _struct(
    ("customer_id", _LONG), ("phone_number", _STR), ("batch_id", _LONG), *_fields(CUSTOMER_FIELDS),
    ("prediction_status", _STR), ("created_at", _TS), ("updated_at", _TS),
)
CAMPAIGN_HISTORY = _struct(
    ("campaign_id", _LONG), ("customer_id", _LONG), *_fields(CAMPAIGN_FIELDS),
    ("created_at", _TS), ("updated_at", _TS),
)
PREDICTIONS = _struct(
    ("prediction_id", _LONG), ("customer_id", _LONG), ("prediction", _STR), ("probability", _DBL),
    ("model_version", _STR), ("predicted_at", _TS),
)
RAW_LOGS = _struct(
    ("service", _STR), ("level", _STR), ("event", _STR), ("message", _STR), ("method", _STR),
    ("endpoint", _STR), ("status_code", _INT), ("response_time_ms", _DBL),
    ("execution_time_seconds", _DBL), ("metadata", _STR),
)
SYSTEM_LOGS = _struct(
    ("log_id", _LONG), ("timestamp", _TS), ("service", _STR), ("level", _STR), ("event", _STR),
    ("method", _STR), ("endpoint", _STR), ("status_code", _INT), ("response_time_ms", _DBL),
    ("message", _STR), ("metadata", _STR),
)
TABLES = {
    "historical_data": HISTORICAL,
    "batch_uploads": BATCH_UPLOADS,
    "customers": CUSTOMERS,
    "campaign_history": CAMPAIGN_HISTORY,
    "predictions": PREDICTIONS,
    "system_logs": SYSTEM_LOGS,
}
