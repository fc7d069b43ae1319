"""Alert payload queries."""

from pyspark.sql import functions as F

from ..operators import alerts
from . import pipelines as pl
from . import testviews as tv
from .oracle_views import ERRORS, LOG_EVENTS, RULES, with_views
from .oracle_views import stamp as sql_stamp
from .registry import query, stamp


def _alerts(spark, sf_dir):
    return pl.alert_rows(pl.analyse(pl.publish(tv.log_events(spark, sf_dir))))


_ALERTS = """
alerts AS (
  SELECT seq, workspace_id, job_id AS p, run_id, signature AS error_type, root_cause AS cause, fix, ts,
    CASE severity WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'ERROR' ELSE 'WARN' END AS lvl,
    CASE severity WHEN 'critical' THEN '🚨' WHEN 'high' THEN '❌' ELSE '⚠️' END AS emoji,
    CASE severity WHEN 'critical' THEN '8B0000' WHEN 'high' THEN 'CC0000' ELSE 'FFA500' END AS color,
    CASE severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'error' ELSE 'warning' END AS pager,
    strftime(ts, '%Y-%m-%d %H:%M UTC') AS seen
  FROM analysed
)"""


def _sql(select: str) -> str:
    return with_views(LOG_EVENTS, RULES, ERRORS, _ALERTS, select=select)


@query("alert_levels", _sql("SELECT seq, lvl AS severity, emoji, color, pager FROM alerts"))
def alert_levels(spark, sf_dir):
    severity = F.col("severity")
    return _alerts(spark, sf_dir).select(
        "seq", "severity", alerts.severity_emoji(severity).alias("emoji"), alerts.severity_color(severity).alias("color"),
        alerts.pager_severity(severity).alias("pager"),
    )


@query(
    "alert_fanout",
    _sql("""
SELECT seq, channel, channel IN ('slack', 'pagerduty') AS sent
FROM alerts, (SELECT unnest(['slack', 'teams', 'email', 'pagerduty']) AS channel)"""),
)
def alert_fanout(spark, sf_dir):
    return alerts.fan_out(_alerts(spark, sf_dir), ["slack", "pagerduty"]).select("seq", "channel", "sent")


@query(
    "alert_pagerduty",
    _sql("""
SELECT seq, CAST(json_object('routing_key', 'key', 'event_action', 'trigger', 'dedup_key', p || ':' || error_type,
  'payload', json_object('summary', 'Pipeline ' || p || ' failed — ' || error_type, 'severity', pager, 'source', 'faultloom',
    'timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'custom_details', json_object('pipeline_name', p, 'run_id', run_id,
      'error_type', error_type, 'root_cause', cause, 'suggested_fix', fix))) AS VARCHAR) AS body
FROM alerts"""),
)
def alert_pagerduty(spark, sf_dir):
    return _alerts(spark, sf_dir).select("seq", alerts.pagerduty_payload("key").alias("body"))


_MD = "json_object('type', 'mrkdwn', 'text', {})"


@query(
    "alert_slack",
    _sql(f"""
SELECT seq, CAST(json_object('text', emoji || ' Pipeline *' || p || '* failed — ' || error_type, 'blocks', json_array(
  json_object('type', 'header', 'text', json_object('type', 'plain_text', 'text', emoji || '  Pipeline Failed · ' || p, 'emoji', true)),
  json_object('type', 'section', 'fields', json_array(
    {_MD.format("'*Pipeline*' || chr(10) || '`' || p || '`'")}, {_MD.format("'*Severity*' || chr(10) || '`' || lvl || '`'")},
    {_MD.format("'*Run ID*' || chr(10) || '`' || run_id || '`'")}, {_MD.format("'*Detected*' || chr(10) || seen")})),
  json_object('type', 'section', 'fields', json_array({_MD.format("'*Error Type*' || chr(10) || '```' || error_type || '```'")})),
  json_object('type', 'divider'),
  json_object('type', 'section', 'text', {_MD.format("'*🔍  Root Cause*' || chr(10) || cause")}),
  json_object('type', 'section', 'text', {_MD.format("'*💡  Suggested Fix*' || chr(10) || fix")}),
  json_object('type', 'divider'),
  json_object('type', 'actions', 'elements', json_array(json_object('type', 'button', 'text',
    json_object('type', 'plain_text', 'text', 'View Dashboard →', 'emoji', true), 'style', 'primary', 'url', 'http://dash'))),
  json_object('type', 'context', 'elements', json_array({_MD.format("'*faultloom* · Run ID: `' || run_id || '`'")}))
)) AS VARCHAR) AS body FROM alerts"""),
)
def alert_slack(spark, sf_dir):
    return _alerts(spark, sf_dir).select("seq", alerts.slack_payload("http://dash").alias("body"))


@query(
    "alert_teams",
    _sql("""
SELECT seq, CAST(json_object('@type', 'MessageCard', '@context', 'http://schema.org/extensions', 'themeColor', color,
  'summary', 'Pipeline ' || p || ' failed', 'sections', json_array(
    json_object('activityTitle', emoji || ' **Pipeline Failed** · `' || p || '`',
      'activitySubtitle', 'Severity: **' || lvl || '** · Detected: ' || seen,
      'facts', json_array(json_object('name', 'Pipeline', 'value', p), json_object('name', 'Run ID', 'value', run_id),
        json_object('name', 'Error', 'value', error_type)), 'markdown', true),
    json_object('title', '🔍 Root Cause', 'text', cause), json_object('title', '💡 Suggested Fix', 'text', fix)),
  'potentialAction', json_array(json_object('@type', 'OpenUri', 'name', 'View Dashboard →',
    'targets', json_array(json_object('os', 'default', 'uri', 'http://dash'))))) AS VARCHAR) AS body
FROM alerts"""),
)
def alert_teams(spark, sf_dir):
    return _alerts(spark, sf_dir).select("seq", alerts.teams_payload("http://dash").alias("body"))


_ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(
    "alert_email",
    _sql(f"""
SELECT seq, emoji || ' Pipeline Failed: ' || p || ' [' || lvl || ']' AS subject,
  '<html><body><h2 style="background:#' || color || ';color:#fff">' || emoji || ' Pipeline Failed · ' || p || '</h2><table>'
  || '<tr><th>Pipeline</th><td>' || p || '</td></tr><tr><th>Severity</th><td>' || lvl || '</td></tr><tr><th>Run ID</th><td>' || run_id
  || '</td></tr><tr><th>Detected</th><td>' || seen || '</td></tr><tr><th>Error Type</th><td>' || error_type || '</td></tr>'
  || '</table><h3>🔍 Root Cause</h3><p>' || {_ESCAPE.format('cause')} || '</p><h3>💡 Suggested Fix</h3><p>' || {_ESCAPE.format('fix')}
  || '</p><a href="http://dash">View Dashboard →</a><p>faultloom · Run ID: ' || run_id || '</p></body></html>' AS body
FROM alerts"""),
)
def alert_email(spark, sf_dir):
    return _alerts(spark, sf_dir).select("seq", alerts.email_subject().alias("subject"), alerts.email_body("http://dash").alias("body"))


@query(
    "alert_dedup",
    _sql(f"""
SELECT workspace_id, p || ':' || error_type AS dedup_key, {sql_stamp("date_trunc('day', ts)")} AS window_start, min(seq) AS seq,
  arg_min(run_id, seq) AS run_id
FROM alerts GROUP BY 1, 2, 3"""),
)
def alert_dedup(spark, sf_dir):
    kept = alerts.dedup_alerts(_alerts(spark, sf_dir), "1 day")
    return kept.select("workspace_id", "dedup_key", stamp("window_start").alias("window_start"), "seq", "run_id")
