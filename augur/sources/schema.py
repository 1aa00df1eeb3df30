"""Schemas, and validation as a column: rows are marked, never raised on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augur.functions.text import strip

CUTOFF = "2024-06-30"

_FIELDS = {
    "id": T.StringType(), "question": T.StringType(), "outcome": T.IntegerType(), "freeze_date": T.DateType(), "resolved_at": T.DateType(), "source": T.StringType(),
    "url": T.StringType(), "background": T.StringType(), "resolution_criteria": T.StringType(), "categories": T.ArrayType(T.StringType()), "raw": T.StringType(),
}
QUESTION = T.StructType([T.StructField(n, k) for n, k in _FIELDS.items()])
#: The others as DDL text, which needs no session to be read.
BASE_RATE = "struct<value: double, n_reference_events: int, reference_window_years: int, explanation: string>"
NEWS = "array<struct<date: string, headline: string, summary: string>>"
CONTEXT = (f"question_id string, base_rate {BASE_RATE}, news_snapshot {NEWS}, leakage_filtered_count int, cache_hit boolean")
PARAPHRASES = (
    "question_id string, paraphrases array<struct<variant_index: int, text: string, is_original: boolean>>, "
    "rejected_count int, rejected_samples array<array<string>>, rounds int, cache_hit boolean"
)
TRAINING = (
    "id string, variant_index int, is_original boolean, split string, question string, outcome int, freeze_date date, "
    f"resolved_at date, source string, messages array<struct<role: string, content: string>>, base_rate {BASE_RATE}, "
    f"news_snapshot {NEWS}, categories array<string>"
)
#: Predictions as CSV holds them: all texts.
PREDICTION_CSV = (
    "id string, variant_index string, split string, outcome string, prediction string, parseable string, mode string, model string, question string, completion string"
)
#: Of a cached response.
RESPONSE = ("text string, usage struct<input_tokens: long, output_tokens: long>, stop_reason string")


def reject_reason() -> Column:
    """Why a canonical row is invalid, the first of the checks in order; null if it is valid."""
    return (
        F.when(~F.coalesce(F.col("outcome").isin(0, 1), F.lit(False)), "outcome")
        .when(F.col("freeze_date").isNull(), "freeze_date")
        .when(F.col("resolved_at").isNull(), "resolved_at")
        .when(F.col("freeze_date") > F.col("resolved_at"), "freeze_after_resolution")
        .when(~F.coalesce(F.col("id").contains("::"), F.lit(False)), "id")
        .when(F.coalesce(F.length(strip(F.col("question"))), F.lit(0)) == 0, "question")
    )


def is_post_cutoff(cutoff: str = CUTOFF) -> Column:
    """Both dates are strictly later."""
    day = F.lit(cutoff).cast("date")
    return (F.col("freeze_date") > day) & (F.col("resolved_at") > day)


def validated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with ``reject_reason``."""
    marked = df.withColumn("reject_reason", reject_reason())
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")


def reason_counts(marked: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows by reason. Counted from the data, since accumulators count retried tasks twice."""
    return marked.groupBy(reason).agg(F.count("*").alias("n"))
