"""Root-cause hypotheses from AI results and rules, their ranking and the final pick."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.rows import explode_rows
from ..schemas import AI_RESULT


def rule_table(spark) -> DataFrame:
    """The default rules as a DataFrame (17 rows).

    They are an expression over one row, so Spark knows that the table is small and broadcasts it: sorted for a join,
    all events of a frequent category would meet in one task.
    """
    rules = [
        F.struct(F.lit(c).alias("category"), F.lit(h).alias("hypothesis"), F.lit(f).alias("fix"), F.lit(float(s)).alias("score"))
        for c, s, h, f in fv.RULES
    ]
    return spark.range(1).select(F.inline(F.array(*rules)))


def parse_ai_response(response: Column) -> Column:
    """Struct (root_cause, suggested_fix, confidence_score) of a JSON answer, code fences removed.

    Missing keys take defaults; an answer that is not a JSON object gives the fixed failure row.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(response, r"```json\s*", ""), r"```\s*", ""))
    fields = F.from_json(bare, "root_cause string, suggested_fix string, confidence_score string")
    is_object = F.get_json_object(bare, "$").isNotNull() & F.startswith(bare, F.lit("{"))
    raw_score = fields["confidence_score"]
    number = raw_score.try_cast("double")
    valid = is_object & (raw_score.isNull() | number.isNotNull())
    return F.struct(
        F.when(valid, F.coalesce(fields["root_cause"], F.lit(fv.AI_MISSING_CAUSE)))
        .otherwise(F.lit(fv.AI_UNPARSED_CAUSE)).alias("root_cause"),
        F.when(valid, F.coalesce(fields["suggested_fix"], F.lit(fv.AI_MISSING_FIX)))
        .otherwise(F.lit(fv.AI_UNAVAILABLE_FIX)).alias("suggested_fix"),
        F.when(valid, F.coalesce(number, F.lit(fv.DEFAULT_AI_SCORE))).otherwise(F.lit(0.0)).alias("confidence_score"),
    ).cast(AI_RESULT)


def usable_ai(root_cause: Column) -> Column:
    """An AI cause takes part unless it is blank, a failure text or the quota notice."""
    lowered = F.lower(F.coalesce(root_cause, F.lit("")))
    bad = F.btrim(lowered, F.lit(fv.WHITESPACE)) == ""
    for phrase in fv.AI_REJECT_PHRASES:
        bad = bad | F.contains(lowered, F.lit(phrase))
    return ~(bad | (F.coalesce(root_cause, F.lit("")) == fv.QUOTA_EXCEEDED_CAUSE))


def quota_substitute(df: DataFrame, admitted: str = "admitted", ai: str = "ai") -> DataFrame:
    """Replace the AI result of events that the quota kept out."""
    notice = F.struct(
        F.lit(fv.QUOTA_EXCEEDED_CAUSE).alias("root_cause"),
        F.lit(fv.QUOTA_EXCEEDED_FIX).alias("suggested_fix"),
        F.lit(None).cast("double").alias("confidence_score"),
    )
    return df.withColumn(ai, F.when(F.col(admitted), F.col(ai)).otherwise(notice))


def _rule(signature: Column) -> Column:
    """Rule hypothesis of a signature's category as a CASE expression; null when there is none."""

    def cases(category: Column) -> Column:
        expr = None
        for name, score, hypothesis, fix in fv.RULES:
            value = F.struct(
                F.lit("rule").alias("source"), F.lit(hypothesis).alias("hypothesis"),
                F.lit(fix).alias("fix"), F.lit(float(score)).alias("score"),
            )
            expr = F.when(category == name, value) if expr is None else expr.when(category == name, value)
        return expr

    return tx.let(F.substring_index(signature, ":", 1), cases)


def _ai_candidate(result: Column) -> Column:
    return F.when(
        usable_ai(result["root_cause"]),
        F.struct(
            F.lit("ai").alias("source"), result["root_cause"].alias("hypothesis"),
            F.coalesce(result["suggested_fix"], F.lit("")).alias("fix"),
            F.coalesce(result["confidence_score"], F.lit(fv.DEFAULT_AI_SCORE)).alias("score"),
        ),
    )


_rule_column = tx.remembered(lambda name: _rule(F.col(name)))
_ai_column = tx.remembered(lambda name: tx.let(F.col(name), _ai_candidate))


def with_hypotheses(
    df: DataFrame, *, ai: str = "ai", signature: str = "signature", rules: DataFrame | None = None
) -> DataFrame:
    """Add ``hypotheses``: the ranked array of (source, hypothesis, fix, score), best first.

    At most two candidates exist per row (AI, then rule), so ranking is a comparison in the row and
    needs no shuffle; AI wins a tie.  ``rules`` replaces the built-in table: it is joined on the
    category without a hint, one row per category.
    """
    if rules is None:
        staged, rule = df, _rule_column(signature)
    else:
        table = rules.select(
            F.col("category").alias("_category"),
            F.struct(
                F.lit("rule").alias("source"), "hypothesis", "fix", F.coalesce("score", F.lit(0.0)).alias("score")
            ).alias("_rule"),
        )
        keyed = df.withColumn("_key", F.substring_index(signature, ":", 1))
        staged = keyed.join(table, keyed["_key"] == table["_category"], "left").drop("_category", "_key")
        rule = F.col("_rule")

    def rank(pair: Column) -> Column:
        a, r = pair["ai"], pair["rule"]
        rule_first = a.isNotNull() & r.isNotNull() & (r["score"] > a["score"])
        return F.when(rule_first, F.array(r, a)).otherwise(F.array_compact(F.array(a, r)))

    pair = F.struct(_ai_column(ai).alias("ai"), rule.alias("rule"))
    return staged.withColumn("hypotheses", tx.let(pair, rank)).drop("_rule")


def pick_top(df: DataFrame, *, ai: str = "ai") -> DataFrame:
    """final_root_cause, final_fix and cause_source: the best hypothesis, else the raw AI text, else Pending."""
    top = F.get("hypotheses", F.lit(0))
    return (
        df.withColumn("cause_source", top["source"])
        .withColumn(
            "final_root_cause", F.coalesce(top["hypothesis"], F.col(ai)["root_cause"], F.lit(fv.PENDING))
        )
        .withColumn(
            "final_fix",
            F.when(top.isNotNull(), top["fix"])
            .otherwise(F.coalesce(F.col(ai)["suggested_fix"], F.lit(fv.PENDING))),
        )
    )


def hypothesis_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The ranked hypotheses as rows: (keys, rank, source, hypothesis, fix, score)."""
    rows = explode_rows(df, keys, F.col("hypotheses"), "_h", "_i")
    return rows.select(*keys, (F.col("_i") + 1).alias("rank"), "_h.*")


def rank_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Rank candidate rows (source, hypothesis, fix, score) per key: score descending, AI before rule.

    For pools that arrive as rows.  The key is an event, which has a handful of candidates.
    """
    score = F.coalesce("score", F.lit(0.0))
    best = Window.partitionBy(*keys).orderBy(score.desc(), F.when(F.col("source") == "ai", 0).otherwise(1), "hypothesis")
    return candidates.withColumn("score", score).withColumn("rank", F.row_number().over(best))
