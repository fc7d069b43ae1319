"""The data jobs: student grades, customer lifetime value, school join."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def join_grades(students: DataFrame, grades: DataFrame) -> DataFrame:
    return students.join(grades, "student_id")


def grades_per_department(joined: DataFrame) -> DataFrame:
    return joined.groupBy("department").agg(F.count("student_id").alias("total_grades"))


def score_value(score: Column) -> Column:
    """The numeric score, or null where the text is not a plain number."""
    text = tx.strip(score)
    return F.when(F.rlike(text, F.lit(_NUMBER)), text.try_cast("double"))


def letter_grade(score: Column) -> Column:
    value = score_value(score)
    return (
        F.when(value >= 90, F.lit("A"))
        .when(value >= 80, F.lit("B"))
        .when(value >= 70, F.lit("C"))
        .when(value >= 60, F.lit("D"))
        .when(value.isNotNull(), F.lit("F"))
    )


def corrupt_reason(score: Column) -> Column:
    """Why a score has no letter; null for good scores."""
    return (
        F.when(score.isNull(), F.lit("null"))
        .when(tx.strip(score) == "", F.lit("empty"))
        .when(score_value(score).isNull(), F.lit("not_a_number"))
    )


def grade(joined: DataFrame) -> DataFrame:
    return joined.withColumn("letter_grade", letter_grade(F.col("score"))).withColumn(
        "corrupt_reason", corrupt_reason(F.col("score"))
    )


def lifetime_value(customers: DataFrame) -> DataFrame:
    """Revenue over churn in double precision from the 32-bit inputs; zero churn gives null and a reason."""
    revenue = F.col("avg_monthly_revenue").cast("float").cast("double")
    churn = F.col("monthly_churn_rate").cast("float").cast("double")
    return customers.withColumn("lifetime_value_usd", F.try_divide(revenue, churn)).withColumn(
        "corrupt_reason", F.when(churn == 0, F.lit("zero_churn"))
    )


def quarantine_counts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows set aside per reason, the batch form of a failure notice."""
    bad = rows.filter(F.col("corrupt_reason").isNotNull())
    return bad.groupBy(*by, F.col("corrupt_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def school_join(students: DataFrame, schools: DataFrame, teachers: DataFrame) -> DataFrame:
    """Students with their school and its teacher; school_id appears once.

    No broadcast hint: Spark broadcasts the dimension tables while they are below its threshold.
    """
    return students.join(schools, "school_id").join(teachers, "school_id")


def join_sample(joined: DataFrame, n: int = 10) -> DataFrame:
    """The first n joined students by id (one top-n per task, then one merge)."""
    return joined.orderBy("student_id").limit(n)
