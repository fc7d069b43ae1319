"""Prompt texts for an external analysis step, built from an event and its retrieved context."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import format_incident, format_section

# The headings below and the keys of the answer; the guidance sentences are this project's own.
_ROLE = "You are an expert Site Reliability Engineer (SRE)."
_USE_INCIDENTS = "Past incidents are listed for context: build on those that fit this error and skip the rest."
_USE_RUNBOOKS = (
    "The runbook sections are the team's own procedures and come first; name the section a fix is taken from."
)
_ANSWER = (
    "Answer with strict JSON and nothing else, using exactly these keys:\n"
    '- "root_cause": why the error occurred, in brief.\n'
    '- "suggested_fix": one concrete command or configuration change.\n'
    '- "confidence_score": a number from 0.0 to 1.0.'
)


def context_lists(incidents: DataFrame, sections: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Formatted hits per event in rank order (at most k per source, so the lists are small)."""
    def listed(hits: DataFrame, text: Column, name: str) -> DataFrame:
        entry = F.struct("rank", text.alias("text"))
        return hits.groupBy(event_id).agg(
            F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]).alias(name)
        )

    return listed(incidents, format_incident(), "similar_incidents").join(
        listed(sections, format_section(), "runbook_sections"), event_id, "full"
    )


def debug_prompt(error: str = "message", context: str = "pipeline_context") -> Column:
    """Prompt with the sections that have content; without any context the plain form."""
    incidents = F.coalesce(F.col("similar_incidents"), F.array().cast("array<string>"))
    runbooks = F.coalesce(F.col("runbook_sections"), F.array().cast("array<string>"))
    has_incidents, has_runbooks = F.size(incidents) > 0, F.size(runbooks) > 0
    about = F.coalesce(F.col(context), F.lit("No additional context provided."))
    bullets = F.array_join(F.transform(incidents, lambda x: F.concat(F.lit("  • "), x)), "\n")
    rag = F.concat_ws(
        "\n\n",
        F.concat(F.lit("## Current error\n"), F.col(error), F.lit("\n\nContext: "), about),
        F.when(
            has_incidents,
            F.concat(F.lit("## Similar past incidents (retrieved from your workspace history)\n"), bullets),
        ),
        F.when(
            has_runbooks,
            F.concat(
                F.lit("## Relevant internal runbook sections (retrieved from your documentation)\n"),
                F.array_join(runbooks, "\n\n---\n"),
            ),
        ),
        F.concat_ws(
            "\n",
            F.lit(_ROLE),
            F.when(has_incidents, F.lit(_USE_INCIDENTS)),
            F.when(has_runbooks, F.lit(_USE_RUNBOOKS)),
            F.lit(_ANSWER),
        ),
    )
    plain = F.concat(
        F.lit(_ROLE + "\n\nError Log:\n\""), F.col(error), F.lit('"\n\nContext:\n'), about, F.lit("\n\n" + _ANSWER)
    )
    return F.when(has_incidents | has_runbooks, rag).otherwise(plain)


def with_prompts(events: DataFrame, contexts: DataFrame, event_id: str = "event_id") -> DataFrame:
    return events.join(contexts, event_id, "left").withColumn("prompt", debug_prompt())
