"""Record layouts shared by sources, operators and streams."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "timestamp": T.TimestampType(),
}


def _struct(spec: str) -> T.StructType:
    fields = (part.split() for part in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


LOG_EVENT = _struct(
    "source string, workspace_id string, job_id string, run_id string, task_id string, "
    "level string, timestamp string, message string, raw_log_uri string"
)
LOG_EVENT_REQUIRED = ["source", "job_id", "run_id", "level", "timestamp", "message"]

AIRFLOW_PUSH = _struct(
    "dag_id string, run_id string, task_id string, exception string, log_url string, execution_date string"
)
AIRFLOW_STATE = _struct(
    "dag_id string, run_id string, task_id string, state string, execution_date string, "
    "log_url string, exception string, try_number int"
)
GENERIC_WEBHOOK = _struct(
    "pipeline string, run_id string, level string, message string, timestamp string, source string"
)

QUEUE_RECORD = _struct(
    "workspace_id string, job_id string, run_id string, message string, ts timestamp, event_id bigint"
)

AI_RESULT = _struct("root_cause string, suggested_fix string, confidence_score double")

DASHBOARD_ERROR = _struct(
    "pipeline string, error string, rootCause string, fix string, detectedAt string"
)

STUDENTS = _struct("student_id int, name string, department string, year int, email string")
GRADES = _struct("student_id int, course string, semester string, score string")
CUSTOMERS = _struct(
    "customer_id string, segment string, avg_monthly_revenue float, monthly_churn_rate float, tenure_months int"
)
