"""Redaction of personal data and secrets (12 ordered categories) and its audit."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.rows import explode_rows


def _may_match(folded: Column, category: str) -> Column:
    if category in fv.REDACTION_GUARD_PATTERNS:
        return F.rlike(folded, F.lit(fv.REDACTION_GUARD_PATTERNS[category]))
    groups = fv.REDACTION_GUARD_LITERALS[category]
    return reduce(lambda a, b: a & b, [tx.contains_any(folded, g) for g in groups])


def scrubbed(text: Column) -> Column:
    """Struct (text, redactions) of a redacted text.

    One fold over the twelve categories: each works on the text that the previous one left.
    Substring checks on the case-folded original decide first which regexes need to run at all;
    tokens put into the text cannot make a skipped category match.
    """
    start = F.struct(
        text.alias("text"), tx.fold_case(text).alias("folded"), F.array().cast("array<string>").alias("redactions")
    )

    def step(state: Column, i: Column) -> Column:
        expr = None
        for n, (category, pattern, token) in enumerate(fv.REDACTION_PATTERNS):
            hit = _may_match(state["folded"], category) & F.rlike(state["text"], F.lit(pattern))
            replaced = F.struct(
                F.regexp_replace(state["text"], pattern, token).alias("text"),
                state["folded"].alias("folded"),
                F.array_append(state["redactions"], F.lit(category)).alias("redactions"),
            )
            result = F.when(hit, replaced).otherwise(state)
            expr = F.when(i == n, result) if expr is None else expr.when(i == n, result)
        return expr.otherwise(state)

    rounds = F.array(*[F.lit(n) for n in range(len(fv.REDACTION_PATTERNS))])
    return F.aggregate(
        rounds, start, step, lambda s: F.struct(s["text"].alias("text"), s["redactions"].alias("redactions"))
    )


_scrubbed_column = tx.remembered(lambda name: scrubbed(F.col(name)))


def scrub(df: DataFrame, column: str, *, out: str | None = None, redactions: str = "redactions") -> DataFrame:
    """Redact ``column``; adds the list of categories that hit, in category order.

    Null and empty texts come back unchanged with no redactions.  Row-local, so it needs no shuffle
    and works on streams.
    """
    staged = df.withColumn("_scrubbed", _scrubbed_column(column))
    return staged.withColumns(
        {out or column: F.col("_scrubbed.text"), redactions: F.col("_scrubbed.redactions")}
    ).drop("_scrubbed")


def redaction_audit(scrubbed: DataFrame, by: list[str], redactions: str = "redactions") -> DataFrame:
    """Rows per redaction category for each combination of ``by`` (partial counts before the shuffle)."""
    return (
        explode_rows(scrubbed, by, F.col(redactions), "category")
        .groupBy(*by, "category")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
