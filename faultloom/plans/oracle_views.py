"""SQL text of the log-shaped views and of the results expected for each message template.

EXPECTED was worked out by hand from the parsing rules; it is the independent side of the check.
"""

from .. import fixed_values as fv
from .testviews import MESSAGES


def lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


_V = "CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)"

# slot: (scrubbed message or None if unchanged, redactions, format, category, class, summary)
_ONE_LINE = "Exception: UnknownException: unknown"
_AIRFLOW_TRACE = (
    "Task context: Task failed with code {v}\nException: KeyError: 'region_{v}'\n"
    "User code frames:\n  /dags/load_{v}.py:42 in run() → result = frame[key]"
)
EXPECTED = [
    (None, "", "airflow", "OOM", "UnknownException", _ONE_LINE),
    (None, "", "airflow", "MISSING_KEY", "UnknownException", _ONE_LINE),
    (None, "", "airflow", "DATA_TYPE", "UnknownException", _ONE_LINE),
    (None, "", "airflow", "SCHEMA_MISMATCH", "UnknownException", _ONE_LINE),
    (None, "", "generic", "UNKNOWN", "ExecutorLostFailure",
     "Exception: ExecutorLostFailure: ExecutorLostFailure: executor {v} exited"),
    (None, "", "airflow", "NULL_REF", "UnknownException", _ONE_LINE),
    (None, "", "airflow", "TIMEOUT", "UnknownException", _ONE_LINE),
    (None, "", "airflow", "DIVIDE_BY_ZERO", "UnknownException", _ONE_LINE),
    ("PermissionError: denied for [REDACTED_EMAIL]", "email", "airflow", "PERMISSIONS", "UnknownException", _ONE_LINE),
    ("IOException: read failed from [REDACTED_IP] at {v}", "ipv4", "airflow", "IO_ERROR", "UnknownException", _ONE_LINE),
    (None, "", "spark_java", "OOM", "OutOfMemoryError",
     "Exception: SparkException: job {v} aborted\nCaused by chain:\n  → OutOfMemoryError: Java heap space\n"
     "Root cause: OutOfMemoryError: Java heap space\nUser code frames:\n  com.acme.Job.run(Job.scala:10)"),
    (None, "", "generic", "UNKNOWN", "plain notice", "Exception: plain notice: plain notice: {v}"),
    (None, "", "airflow", "MISSING_KEY", "KeyError", _AIRFLOW_TRACE),
    (None, "", "spark_java", "DATA_TYPE", "ValueError",
     "Exception: PythonException: Traceback (most recent call last): ValueError: bad literal {v}\n"
     "Root cause: ValueError: bad literal {v}\nUser code frames:\n  com.acme.Etl.load(Etl.scala:77)"),
    (None, "", "spark_java", "UNKNOWN", "FileNotFoundException",
     "Task context: Task 3 in stage {v} failed 4 times, most recent failure: ERROR lost task\n"
     "Exception: UnknownException: Job aborted due to stage failure: Task 3 in stage {v} failed 4 times, "
     "most recent failure: ERROR lost task\nCaused by chain:\n  → FileNotFoundException: /data/part-{v}.parquet\n"
     "Root cause: FileNotFoundException: /data/part-{v}.parquet"),
    ("FATAL login failed: password=[REDACTED_PASSWORD] for db", "password_kv", "generic", "UNKNOWN", "UnknownError", None),
    ("ERROR fetch [REDACTED_URL_CREDENTIALS]@repo.example.org/api with Bearer [REDACTED_TOKEN]",
     "url_credentials,bearer_token", "generic", "UNKNOWN", "UnknownError", None),
    ("ERROR sink [REDACTED_CONNECTION_STRING] refused", "db_connection_string", "generic", "UNKNOWN", "UnknownError", None),
    ("ERROR key [REDACTED_AWS_KEY] with aws_secret_access_key=[REDACTED_SECRET] near {v}",
     "aws_access_key,aws_secret_key", "generic", "UNKNOWN", "UnknownError", None),
    ("CRITICAL card [REDACTED_CC] phone [REDACTED_PHONE] for {v}", "credit_card,phone", "generic", "UNKNOWN",
     "UnknownError", None),
    ("ERROR auth [REDACTED_JWT] rejected {v}", "jwt", "generic", "UNKNOWN", "UnknownError", None),
    ("ERROR key [REDACTED_PEM_KEY] loaded", "pem_key", "generic", "UNKNOWN", "UnknownError", None),
    (None, "", "spark_java", "NULL_REF", "UnknownException",
     "Exception: UnknownException: ERROR first java.lang.NullPointerException: row {v}\n"
     "User code frames:\n  com.acme.Job.step(Job.scala:5)"),
    ("ERROR AirflowException raised on [REDACTED_IP] attempt {v}", "ipv4", "generic", "UNKNOWN", "UnknownError", None),
]


def _values(rows: list[tuple]) -> str:
    return ",\n".join("(" + ", ".join(str(x) if isinstance(x, (int, float)) else lit(x) for x in r) + ")" for r in rows)


# Severities and rule scores as the results must have them, written out here so that the SQL side does not read them
# from the code that it checks.
SEVERITY = {
    "OOM": "critical", "DATA_TYPE": "high", "MISSING_KEY": "high", "MISSING_FILE": "high", "DB_CONNECTION": "high",
    "DB_ERROR": "high", "NETWORK": "high", "SCHEMA_MISMATCH": "high", "EXECUTOR_FAILURE": "high", "BROADCAST_OOM": "high",
    "NULL_REF": "medium", "CLASSPATH": "medium", "IO_ERROR": "medium", "TIMEOUT": "medium", "AIRFLOW_INTERNAL": "low",
    "PERMISSIONS": "high", "DIVIDE_BY_ZERO": "medium", "ASSERTION": "medium", "ENCODING": "low",
}
RULE_SCORE = {
    "OOM": 0.82, "BROADCAST_OOM": 0.80, "EXECUTOR_FAILURE": 0.78, "DATA_TYPE": 0.78, "MISSING_KEY": 0.77, "MISSING_FILE": 0.77,
    "SCHEMA_MISMATCH": 0.80, "NETWORK": 0.75, "IO_ERROR": 0.74, "TIMEOUT": 0.74, "NULL_REF": 0.72, "PERMISSIONS": 0.78,
    "CLASSPATH": 0.73, "DIVIDE_BY_ZERO": 0.76, "AIRFLOW_INTERNAL": 0.70, "ENCODING": 0.71, "ASSERTION": 0.72,
}

# One marker per category, in the order of the catalogue.
MARKERS = {
    "OOM": "Java heap space", "DATA_TYPE": "ValueError", "MISSING_KEY": "KeyError", "MISSING_FILE": "FileNotFoundError",
    "DB_CONNECTION": "OperationalError", "DB_ERROR": "IntegrityError", "NETWORK": "socket.timeout",
    "SCHEMA_MISMATCH": "AnalysisException", "EXECUTOR_FAILURE": "ExecutorLostFailure", "BROADCAST_OOM": "MemoryStore",
    "NULL_REF": "NullPointerException", "CLASSPATH": "ClassNotFoundException", "IO_ERROR": "S3Exception",
    "TIMEOUT": "TaskKilledException", "AIRFLOW_INTERNAL": "DagRunAlreadyExists", "PERMISSIONS": "AccessDeniedException",
    "DIVIDE_BY_ZERO": "ZeroDivisionError", "ASSERTION": "AssertionError", "ENCODING": "UnicodeDecodeError",
}


def _expected_rows() -> list[tuple]:
    severity = SEVERITY
    rows = []
    for slot, (clean, redactions, form, category, cls, summary) in enumerate(EXPECTED):
        clean = MESSAGES[slot] if clean is None else clean
        summary = f"Exception: UnknownError: {clean}" if summary is None else summary
        rows.append(
            (slot, MESSAGES[slot], clean, redactions, form, category, cls, severity.get(category, "medium"), summary)
        )
    return rows


TEMPLATES = f"""
tpl(slot, msg, clean, redactions, form, category, cls, severity, summary) AS (VALUES
{_values(_expected_rows())}
)"""

LOG_EVENTS = f"""{TEMPLATES},
log_events AS (
  SELECT event_id AS seq, event_type, user_id, value, ts, slot,
    CAST(user_id % 20 AS VARCHAR) AS workspace_id,
    'job_' || (user_id % 7) AS job_id,
    'run_' || user_id || '_' || (event_id // 450) AS run_id,
    CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
    {_V} AS v,
    replace(msg, '{{v}}', {_V}) AS message,
    replace(clean, '{{v}}', {_V}) AS clean,
    redactions, form, category, severity, category || ':' || cls AS signature,
    replace(summary, '{{v}}', {_V}) AS summary
  FROM events JOIN tpl ON tpl.slot = event_id % {len(MESSAGES)}
)"""

RULES = f"""
rules(category, score, hypothesis, fix) AS (VALUES
{_values([(c, RULE_SCORE[c], h, f) for c, _, h, f in fv.RULES])}
)"""

RUNS = """
runs AS (
  SELECT workspace_id, job_id AS pipeline_name, run_id,
    CASE WHEN level = 'ERROR' THEN 'Failed' ELSE 'Success' END AS status, ts AS created_at, seq
  FROM log_events
  QUALIFY row_number() OVER (PARTITION BY workspace_id, run_id ORDER BY seq) = 1
),
pipelines AS (
  SELECT workspace_id, pipeline_name,
    arg_max(status, created_at) AS status, max(created_at) AS last_run
  FROM runs GROUP BY 1, 2
)"""

# Error table from rules alone: no AI result, so the fallback text stands where no rule fits.
ERRORS = f"""
analysed AS (
  SELECT e.*, coalesce(r.hypothesis, {lit(fv.AI_UNAVAILABLE_CAUSE)}) AS root_cause,
    coalesce(r.fix, {lit(fv.AI_UNAVAILABLE_FIX)}) AS fix
  FROM log_events e LEFT JOIN rules r USING (category)
  WHERE e.level = 'ERROR'
),
errors AS (
  SELECT workspace_id, job_id AS pipeline_name, signature AS error_type, root_cause, fix,
    ts AS detected_at, clean AS raw_log, severity, category, run_id, seq
  FROM analysed
  QUALIFY row_number() OVER (PARTITION BY workspace_id, job_id, signature ORDER BY seq DESC) = 1
)"""

# The AI step's answers, derived from the event: some missing, some unusable, scores 0.60 to 0.99.
AI = f"""
ai AS (
  SELECT seq,
    CASE seq % 5 WHEN 0 THEN {lit(fv.AI_UNAVAILABLE_CAUSE)} WHEN 1 THEN 'Service unavailable' WHEN 2 THEN ' '
      ELSE 'cause ' || v END AS cause,
    CASE seq % 5 WHEN 0 THEN {lit(fv.AI_UNAVAILABLE_FIX)} ELSE 'fix ' || v END AS ai_fix,
    CASE WHEN seq % 5 = 3 AND seq % 2 = 0 THEN 0.5 ELSE (60 + seq % 40) / 100.0 END::DOUBLE AS ai_score,
    seq % 5 IN (3, 4) AS usable
  FROM log_events
)"""


def with_views(*views: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(views) + "\n" + select


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
