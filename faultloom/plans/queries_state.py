"""Queries over runs, pipelines, errors, tenants, hypotheses and quota."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import hypotheses, quota, reports, state
from ..operators.positions import chunk_of
from ..sources.tables import read_table
from . import pipelines as pl
from . import testviews as tv
from .oracle_views import AI, ERRORS, LOG_EVENTS, RULES, RUNS, lit, with_views
from .oracle_views import stamp as sql_stamp
from .registry import query, stamp


@query(
    "run_dedup",
    with_views(LOG_EVENTS, RUNS, select=f"""
SELECT workspace_id, pipeline_name, run_id, status, {sql_stamp('created_at')} AS created_at FROM runs"""),
)
def run_dedup(spark, sf_dir):
    runs = state.pipeline_runs(tv.log_events(spark, sf_dir))
    return runs.select("workspace_id", "pipeline_name", "run_id", "status", stamp("created_at").alias("created_at"))


@query(
    "latest_run_status",
    with_views(LOG_EVENTS, RUNS, select=f"""
SELECT workspace_id, pipeline_name, status, {sql_stamp('last_run')} AS last_run FROM pipelines"""),
)
def latest_run_status(spark, sf_dir):
    return state.pipeline_state(state.pipeline_runs(tv.log_events(spark, sf_dir))).withColumn("last_run", stamp("last_run"))


@query(
    "status_counts",
    with_views(LOG_EVENTS, RUNS, select="""
SELECT workspace_id, count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status = 'Success') AS success,
  count(*) AS total
FROM pipelines GROUP BY 1"""),
)
def status_counts(spark, sf_dir):
    return reports.status_counts(state.pipeline_state(state.pipeline_runs(tv.log_events(spark, sf_dir))), ["workspace_id"])


def error_table(spark, sf_dir):
    return pl.process_events(pl.publish(tv.log_events(spark, sf_dir)))


@query(
    "errors_upsert",
    with_views(LOG_EVENTS, RULES, ERRORS, select=f"""
SELECT workspace_id, pipeline_name, error_type, root_cause, fix, {sql_stamp('detected_at')} AS detected_at, raw_log, run_id
FROM errors"""),
)
def errors_upsert(spark, sf_dir):
    return error_table(spark, sf_dir).select(
        "workspace_id", "pipeline_name", "error_type", "root_cause", "fix",
        stamp("detected_at").alias("detected_at"), "raw_log", "run_id",
    )


def ai_events(spark, sf_dir):
    """Every event with its signature and an AI result derived from it."""
    events = tv.log_events(spark, sf_dir)
    slot, v = F.pmod("seq", F.lit(5)), tv.value_text()
    cause = (
        F.when(slot == 0, F.lit(fv.AI_UNAVAILABLE_CAUSE))
        .when(slot == 1, F.lit("Service unavailable"))
        .when(slot == 2, F.lit(" "))
        .otherwise(F.concat(F.lit("cause "), v))
    )
    score = F.when(
        ~((slot == 3) & (F.pmod("seq", F.lit(2)) == 0)), (F.pmod("seq", F.lit(40)) + 60) / F.lit(100.0)
    )
    fix = F.when(slot == 0, F.lit(fv.AI_UNAVAILABLE_FIX)).otherwise(F.concat(F.lit("fix "), v))
    ai = F.struct(cause.alias("root_cause"), fix.alias("suggested_fix"), score.alias("confidence_score"))
    return pl.analyse(events.withColumn("ai_answer", ai), ai=F.col("ai_answer"))


_POOL = """
pool AS (
  SELECT seq, 'ai' AS source, cause AS hypothesis, ai_fix AS fix, ai_score AS score FROM ai WHERE usable
  UNION ALL
  SELECT seq, 'rule', hypothesis, fix, CAST(score AS DOUBLE) FROM log_events JOIN rules USING (category)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, source) AS rank FROM pool
)"""


@query(
    "rank_hypotheses",
    with_views(LOG_EVENTS, RULES, AI, _POOL, select="SELECT seq, CAST(rank AS INTEGER) AS rank, source, hypothesis, fix, score FROM ranked"),
)
def rank_hypotheses(spark, sf_dir):
    return hypotheses.hypothesis_rows(ai_events(spark, sf_dir), ["seq"])


@query(
    "rank_candidate_rows",
    with_views(LOG_EVENTS, RULES, AI, _POOL, select="SELECT seq, CAST(rank AS INTEGER) AS rank, source, score FROM ranked"),
)
def rank_candidate_rows(spark, sf_dir):
    pool = hypotheses.hypothesis_rows(ai_events(spark, sf_dir), ["seq"]).drop("rank")
    return hypotheses.rank_candidates(pool, ["seq"]).select("seq", "rank", "source", "score")


@query(
    "top_hypothesis",
    with_views(LOG_EVENTS, RULES, AI, _POOL, select="""
SELECT a.seq, r.source AS cause_source, coalesce(r.hypothesis, a.cause) AS root_cause, coalesce(r.fix, a.ai_fix) AS fix
FROM ai a LEFT JOIN ranked r ON r.seq = a.seq AND r.rank = 1"""),
)
def top_hypothesis(spark, sf_dir):
    return ai_events(spark, sf_dir).select(
        "seq", "cause_source", F.col("final_root_cause").alias("root_cause"), F.col("final_fix").alias("fix")
    )


@query(
    "rule_join",
    with_views(LOG_EVENTS, RULES, select="""
SELECT category, count(*) AS n, max(hypothesis) AS hypothesis, CAST(max(score) AS DOUBLE) AS score
FROM log_events LEFT JOIN rules USING (category) GROUP BY 1"""),
)
def rule_join(spark, sf_dir):
    analysed = pl.analyse(tv.log_events(spark, sf_dir), rules=hypotheses.rule_table(spark))
    top = F.get("hypotheses", F.lit(0))
    return analysed.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.max(top["hypothesis"]).alias("hypothesis"), F.max(top["score"]).alias("score")
    )


def keyed_events(spark, sf_dir):
    """Events with an API key; views come without one, clicks with a key nobody owns."""
    kind = F.col("event_type")
    key = (
        F.when(kind == "view", F.lit(None).cast("string"))
        .when(kind == "click", F.concat(F.lit("pk_test_"), F.col("user_id").cast("string")))
        .otherwise(F.concat(F.lit("pk_live_"), F.col("user_id").cast("string")))
    )
    return tv.log_events(spark, sf_dir).select("seq", "workspace_id", "job_id", key.alias("api_key"))


@query(
    "tenant_stamp",
    """SELECT event_id AS seq, 'ws_' || user_id AS workspace_id, 'job_' || (user_id % 7) AS job_id
FROM events JOIN customer ON c_custkey = user_id AND c_acctbal >= 0 WHERE event_type NOT IN ('view', 'click')""",
)
def tenant_stamp(spark, sf_dir):
    accepted, _ = state.stamp_tenants(keyed_events(spark, sf_dir), tv.api_keys(spark, sf_dir).drop("api_key"))
    return accepted


@query(
    "tenant_rejects",
    """SELECT event_id AS seq, CASE WHEN event_type = 'view' THEN 'missing_key'
  WHEN event_type = 'click' OR c_custkey IS NULL THEN 'unknown_key' ELSE 'revoked_key' END AS reason
FROM events LEFT JOIN customer ON c_custkey = user_id
WHERE event_type IN ('view', 'click') OR c_custkey IS NULL OR c_acctbal < 0""",
)
def tenant_rejects(spark, sf_dir):
    _, rejected = state.stamp_tenants(keyed_events(spark, sf_dir), tv.api_keys(spark, sf_dir).drop("api_key"))
    return rejected.select("seq", "reason")


def quota_users(spark, sf_dir):
    return tv.users(spark, sf_dir).select(F.col("id").cast("string").alias("workspace_id"), "ai_calls_used", "ai_calls_limit")


_ADMIT = """
quota AS (SELECT CAST(c_custkey AS VARCHAR) AS ws, 100 - (c_custkey * 7) % 120 AS remaining FROM customer),
admitted AS (
  SELECT seq, workspace_id, remaining IS NULL OR row_number() OVER (PARTITION BY workspace_id ORDER BY seq) <= remaining AS admitted,
    category, slot
  FROM log_events LEFT JOIN quota ON ws = workspace_id
)"""


@query("quota_admission", with_views(LOG_EVENTS, _ADMIT, select="SELECT seq, workspace_id, admitted FROM admitted"))
def quota_admission(spark, sf_dir):
    admitted = quota.admit(
        tv.log_events(spark, sf_dir).select("seq", "workspace_id"), quota_users(spark, sf_dir), chunk=chunk_of("seq", 2_000)
    )
    return admitted.select("seq", "workspace_id", "admitted")


_BILLED = """
quota AS (SELECT CAST(c_custkey AS VARCHAR) AS ws, 100 - (c_custkey * 7) % 120 AS remaining FROM customer),
billed AS (
  SELECT seq, workspace_id, remaining IS NULL OR coalesce(sum(CASE WHEN seq % 5 IN (3, 4) THEN 1 ELSE 0 END) OVER (
    PARTITION BY workspace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < remaining AS admitted
  FROM log_events LEFT JOIN quota ON ws = workspace_id
)"""


@query("quota_billed", with_views(LOG_EVENTS, _BILLED, select="SELECT seq, workspace_id, admitted FROM billed"))
def quota_billed(spark, sf_dir):
    """Admission where only calls that gave a result use up the quota."""
    admitted = quota.admit(
        tv.log_events(spark, sf_dir).select("seq", "workspace_id"), quota_users(spark, sf_dir), chunk=chunk_of("seq", 2_000),
        billable=F.pmod("seq", F.lit(5)).isin(3, 4),
    )
    return admitted.select("seq", "workspace_id", "admitted")


@query(
    "quota_usage",
    with_views(LOG_EVENTS, _ADMIT, select="""
SELECT workspace_id, count(*) FILTER (admitted AND seq % 5 IN (3, 4)) AS ai_calls FROM admitted GROUP BY 1"""),
)
def quota_usage(spark, sf_dir):
    events = tv.log_events(spark, sf_dir).select("seq", "workspace_id")
    admitted = quota.admit(events, quota_users(spark, sf_dir), chunk=chunk_of("seq", 2_000))
    return quota.usage(admitted, billable=F.pmod("seq", F.lit(5)).isin(3, 4))


@query(
    "quota_notice",
    with_views(LOG_EVENTS, RULES, _ADMIT, AI, select=f"""
SELECT d.seq, CASE WHEN NOT d.admitted THEN coalesce(r.hypothesis, {lit(fv.QUOTA_EXCEEDED_CAUSE)})
  WHEN a.usable AND (r.score IS NULL OR a.ai_score >= r.score) THEN a.cause
  ELSE coalesce(r.hypothesis, a.cause) END AS root_cause
FROM admitted d JOIN ai a USING (seq) LEFT JOIN rules r USING (category)"""),
)
def quota_notice(spark, sf_dir):
    answered = ai_events(spark, sf_dir).select("seq", "workspace_id", "signature", "ai")
    admitted = quota.admit(answered, quota_users(spark, sf_dir), chunk=chunk_of("seq", 2_000))
    chosen = hypotheses.pick_top(hypotheses.with_hypotheses(hypotheses.quota_substitute(admitted)))
    return chosen.select("seq", F.col("final_root_cause").alias("root_cause"))


@query(
    "quota_pct",
    """SELECT c_custkey AS id, (c_custkey * 7) % 120 AS used,
  CAST(least(100, floor((c_custkey * 7) % 120 * 100.0 / 100 + 0.5)) AS INTEGER) AS percent, (c_custkey * 7) % 120 >= 100 AS exceeded
FROM customer""",
)
def quota_pct(spark, sf_dir):
    used, limit = F.col("ai_calls_used"), F.col("ai_calls_limit")
    return tv.users(spark, sf_dir).select(
        "id", used.alias("used"), quota.quota_percent(used, limit).alias("percent"), quota.quota_exceeded(used, limit).alias("exceeded")
    )


@query(
    "quota_ledger",
    with_views(LOG_EVENTS, """
resets AS (
  SELECT workspace_id, max(seq) AS at FROM log_events WHERE event_type = 'signup' AND value > 40 GROUP BY 1
),
grants AS (
  SELECT g.workspace_id, g.ts, g.seq FROM log_events g LEFT JOIN resets r USING (workspace_id)
  WHERE g.event_type = 'purchase' AND (r.at IS NULL OR g.seq > r.at)
),
chain AS (
  SELECT workspace_id, min(ts) AS t, 1 AS n FROM grants GROUP BY 1
  UNION ALL
  SELECT c.workspace_id, (SELECT min(g.ts) FROM grants g WHERE g.workspace_id = c.workspace_id AND g.ts >= c.t + INTERVAL 24 HOUR), c.n + 1
  FROM chain c WHERE c.t IS NOT NULL
),
accepted AS (SELECT workspace_id, count(t) AS n, max(t) AS last_t FROM chain GROUP BY 1)""", select=f"""
SELECT CAST(c_custkey AS VARCHAR) AS workspace_id,
  CASE WHEN r.at IS NULL THEN (c_custkey * 7) % 120 ELSE 0 END AS ai_calls_used,
  CASE WHEN r.at IS NULL THEN 100 ELSE 1000 END + 1000 * coalesce(a.n, 0) AS ai_calls_limit,
  {sql_stamp('a.last_t')} AS last_grant_at
FROM customer LEFT JOIN resets r ON r.workspace_id = CAST(c_custkey AS VARCHAR)
LEFT JOIN accepted a ON a.workspace_id = CAST(c_custkey AS VARCHAR)"""),
)
def quota_ledger(spark, sf_dir):
    events = tv.log_events(spark, sf_dir)
    action = F.when(F.col("event_type") == "purchase", F.lit("grant")).when(
        (F.col("event_type") == "signup") & (F.col("value") > 40), F.lit("reset")
    )
    actions = events.select("workspace_id", "ts", "seq", action.alias("action")).filter(F.col("action").isNotNull())
    users = quota_users(spark, sf_dir).withColumn("last_grant_at", F.lit(None).cast("timestamp"))
    return quota.apply_ledger(users, actions).withColumn("last_grant_at", stamp("last_grant_at"))


@query(
    "unknown_pipelines",
    with_views(LOG_EVENTS, RUNS, select="""
SELECT CAST(c_custkey % 40 AS VARCHAR) AS workspace_id, 'job_' || (c_nationkey % 9) AS pipeline_name FROM customer
EXCEPT SELECT workspace_id, pipeline_name FROM pipelines"""),
)
def unknown_pipelines(spark, sf_dir):
    requests = read_table(spark, sf_dir, "customer").select(
        F.pmod("c_custkey", F.lit(40)).cast("string").alias("workspace_id"),
        F.concat(F.lit("job_"), F.pmod("c_nationkey", F.lit(9)).cast("string")).alias("pipeline_name"),
    )
    known = state.pipeline_state(state.pipeline_runs(tv.log_events(spark, sf_dir)))
    return state.unknown_pipelines(requests, known)
