"""Alert payload tables.  Each operator adds columns to alert rows; nothing is sent.

Input rows carry pipeline_name, run_id, error_type, root_cause, fix, severity (CRITICAL, ERROR,
WARN or anything else) and detected (timestamp).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx

PRODUCT = "faultloom"


def alert_level(severity: Column) -> Column:
    """Alert level of a parsed severity (critical, high, medium, low)."""
    return tx.lookup(fv.ALERT_LEVEL_OF_SEVERITY, severity, "ERROR")


def severity_color(severity: Column) -> Column:
    return tx.lookup(fv.SEVERITY_COLORS, F.upper(severity), fv.SEVERITY_COLORS["ERROR"])


def severity_emoji(severity: Column) -> Column:
    return tx.lookup(fv.SEVERITY_EMOJI, F.upper(severity), fv.SEVERITY_EMOJI["ERROR"])


def pager_severity(severity: Column) -> Column:
    return tx.lookup(fv.PAGER_SEVERITY, F.upper(severity), fv.PAGER_SEVERITY["ERROR"])


def _parts() -> dict[str, Column]:
    severity = F.upper("severity")
    return {
        "pipeline": F.col("pipeline_name"),
        "level": severity,
        "emoji": severity_emoji(severity),
        "color": severity_color(severity),
        "run": tx.truncate_run_id(F.col("run_id"), fv.ALERT_RUN_ID_CHARS),
        "error": tx.truncate_ellipsis(F.col("error_type"), fv.ALERT_ERROR_CHARS),
        "cause": tx.truncate_ellipsis(F.col("root_cause"), fv.ALERT_CAUSE_CHARS),
        "fix": tx.truncate_ellipsis(F.col("fix"), fv.ALERT_FIX_CHARS),
        "at": F.date_format(tx.utc_ntz(F.col("detected")), "yyyy-MM-dd HH:mm 'UTC'"),
    }


def _join(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _obj(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _json(**fields) -> Column:
    return F.to_json(_obj(**fields))


def _raw_list(*items: Column) -> Column:
    """JSON array of objects with different fields: already rendered texts put side by side."""
    return _join("[", F.concat_ws(",", *items), "]")


def slack_payload(dashboard_url: str = "", product: str = PRODUCT) -> Column:
    p = _parts()

    def markdown(*parts) -> Column:
        return _obj(type="mrkdwn", text=_join(*parts))

    divider = _json(type="divider")
    blocks = _raw_list(
        _json(type="header", text=_obj(
            type="plain_text", text=_join(p["emoji"], "  Pipeline Failed · ", p["pipeline"]), emoji=True)),
        _json(type="section", fields=F.array(
            markdown("*Pipeline*\n`", p["pipeline"], "`"), markdown("*Severity*\n`", p["level"], "`"),
            markdown("*Run ID*\n`", p["run"], "`"), markdown("*Detected*\n", p["at"]))),
        _json(type="section", fields=F.array(markdown("*Error Type*\n```", p["error"], "```"))),
        divider,
        _json(type="section", text=markdown("*🔍  Root Cause*\n", p["cause"])),
        _json(type="section", text=markdown("*💡  Suggested Fix*\n", p["fix"])),
        divider,
        _json(type="actions", elements=F.array(_obj(
            type="button", text=_obj(type="plain_text", text="View Dashboard →", emoji=True),
            style="primary", url=dashboard_url))),
        _json(type="context", elements=F.array(markdown(f"*{product}* · Run ID: `", p["run"], "`"))),
    )
    title = _join(p["emoji"], " Pipeline *", p["pipeline"], "* failed — ", p["error"])
    return _join(F.regexp_replace(_json(text=title), r"\}$", ""), ',"blocks":', blocks, "}")


def teams_payload(dashboard_url: str = "") -> Column:
    p = _parts()

    def fact(name: str, value: Column) -> Column:
        return _obj(name=name, value=value)

    sections = _raw_list(
        _json(
            activityTitle=_join(p["emoji"], " **Pipeline Failed** · `", p["pipeline"], "`"),
            activitySubtitle=_join("Severity: **", p["level"], "** · Detected: ", p["at"]),
            facts=F.array(fact("Pipeline", p["pipeline"]), fact("Run ID", p["run"]), fact("Error", p["error"])),
            markdown=True,
        ),
        _json(title="🔍 Root Cause", text=p["cause"]),
        _json(title="💡 Suggested Fix", text=p["fix"]),
    )
    head = F.to_json(F.struct(
        F.lit("MessageCard").alias("@type"),
        F.lit("http://schema.org/extensions").alias("@context"),
        p["color"].alias("themeColor"),
        _join("Pipeline ", p["pipeline"], " failed").alias("summary"),
    ))
    action = F.to_json(F.struct(
        F.lit("OpenUri").alias("@type"),
        F.lit("View Dashboard →").alias("name"),
        F.array(_obj(os="default", uri=dashboard_url)).alias("targets"),
    ))
    return _join(F.regexp_replace(head, r"\}$", ""), ',"sections":', sections, ',"potentialAction":[', action, "]}")


def email_subject() -> Column:
    p = _parts()
    return _join(p["emoji"], " Pipeline Failed: ", p["pipeline"], " [", p["level"], "]")


def email_body(dashboard_url: str = "", product: str = PRODUCT) -> Column:
    """HTML body; all values are escaped."""
    p = {k: tx.html_escape(v) for k, v in _parts().items()}

    def row(label: str, value: Column) -> Column:
        return _join(f"<tr><th>{label}</th><td>", value, "</td></tr>")

    return _join(
        '<html><body><h2 style="background:#', p["color"], ';color:#fff">', p["emoji"], " Pipeline Failed · ",
        p["pipeline"], "</h2><table>", row("Pipeline", p["pipeline"]), row("Severity", p["level"]),
        row("Run ID", p["run"]), row("Detected", p["at"]), row("Error Type", p["error"]),
        "</table><h3>🔍 Root Cause</h3><p>", p["cause"], "</p><h3>💡 Suggested Fix</h3><p>", p["fix"],
        f'</p><a href="{dashboard_url}">View Dashboard →</a><p>{product} · Run ID: ', p["run"], "</p></body></html>",
    )


def dedup_key(*, compat: bool = False) -> Column:
    """Pipeline and whole signature; ``compat`` cuts the signature, so signatures with one beginning share a key."""
    error = F.col("error_type")
    return _join(F.col("pipeline_name"), ":", tx.truncate_ellipsis(error, fv.ALERT_ERROR_CHARS) if compat else error)


def pagerduty_payload(routing_key: str = "", source: str = PRODUCT, *, compat: bool = False) -> Column:
    p = _parts()
    return _json(
        routing_key=routing_key,
        event_action="trigger",
        dedup_key=dedup_key(compat=compat),
        payload=_obj(
            summary=_join("Pipeline ", p["pipeline"], " failed — ", p["error"]),
            severity=pager_severity(F.col("severity")),
            source=source,
            timestamp=tx.iso_utc(F.col("detected")),
            custom_details=_obj(
                pipeline_name=p["pipeline"], run_id=F.col("run_id"), error_type=p["error"],
                root_cause=p["cause"], suggested_fix=p["fix"],
            ),
        ),
    )


def fan_out(alerts: DataFrame, configured: list[str]) -> DataFrame:
    """One row per alert and channel; ``sent`` is false for channels that are not configured."""
    channels = F.array(*[F.lit(c) for c in fv.ALERT_CHANNELS])
    rows = alerts.select("*", F.explode(channels).alias("channel"))
    return rows.withColumn("sent", F.col("channel").isin(configured) if configured else F.lit(False))


def dedup_alerts(alerts: DataFrame, width: str = "1 hour", *, order: str = "seq", keys=("workspace_id",)) -> DataFrame:
    """First alert per dedup key and tumbling window.  Each map task keeps one row per key and window."""
    keyed = alerts.withColumn("dedup_key", dedup_key()).withColumn("_w", F.window("detected", width)["start"])
    names = [c for c in keyed.columns if c not in (*keys, "dedup_key", "_w")]
    first = keyed.groupBy(*keys, "dedup_key", "_w").agg(F.min_by(F.struct(*names), F.col(order)).alias("_r"))
    return first.select(*keys, "dedup_key", F.col("_w").alias("window_start"), "_r.*")
