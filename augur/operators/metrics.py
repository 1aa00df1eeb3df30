"""Metrics of grouped predictions: one row a (id, variant_index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augur.functions import scores as X


def _usable() -> Column:
    return F.when(F.col("parseable"), F.col("prediction"))


def group_metrics(predictions: DataFrame) -> DataFrame:
    """One row an id; split and outcome are those of its lowest variant."""
    p, first = _usable(), F.struct("variant_index", "outcome")
    rows = predictions.withColumn("_p", p).groupBy("id").agg(
        F.min_by("split", "variant_index").alias("split"),
        F.min(first)["outcome"].alias("outcome"),
        F.count("*").alias("n_variants"),
        F.count("_p").alias("n_parseable"),
        F.avg("_p").alias("mean_prob"),
        F.stddev_pop("_p").alias("parasd"),
        F.avg(F.col("_p") * F.col("_p")).alias("_sq"),
    )
    # mean (p - o)^2 over the group's own outcome, from the two moments
    brier = F.col("_sq") - 2 * F.col("outcome") * F.col("mean_prob") + F.col("outcome") * F.col("outcome")
    coverage = F.col("n_parseable") / F.col("n_variants")
    return rows.select("id", "split", "outcome", "n_variants", "n_parseable", coverage.alias("coverage"), "mean_prob", "parasd", F.when(F.col("n_parseable") > 0, brier).alias("mean_brier"))


def _variant_totals(predictions: DataFrame, n_bins: int) -> DataFrame:
    """Sums by calibration bin, from which every variant-level mean follows; a row a bin."""
    p = _usable()
    width = F.least(F.floor(F.col("_p") * n_bins), F.lit(n_bins - 1))
    return predictions.withColumn("_p", p).withColumn("bin", F.when(F.col("_p").isNotNull(), width).cast("int")).groupBy("bin").agg(
        F.count("*").alias("n"), F.count("_p").alias("n_ok"), F.sum("_p").alias("p"), F.sum(F.when(F.col("_p").isNotNull(), F.col("outcome"))).alias("y"),
        F.sum(X.brier(F.col("_p"), F.col("outcome"))).alias("brier"), F.sum(X.log_loss(F.col("_p"), F.col("outcome"))).alias("log_loss"),
        *[F.sum(F.when(F.col("outcome") == o, F.col("_p"))).alias(f"p{o}") for o in (0, 1)],
        *[F.count(F.when(F.col("outcome") == o, F.col("_p"))).alias(f"n{o}") for o in (0, 1)],
    )


def expected_calibration_error(predictions: DataFrame, n_bins: int = 10) -> DataFrame:
    """Bins of equal width, the last one closed; null without usable predictions."""
    b = _variant_totals(predictions, n_bins).where("n_ok > 0")
    return b.agg(F.try_divide(F.sum(F.abs(F.col("p") - F.col("y"))), F.sum("n_ok")).alias("ece"))


def summary(predictions: DataFrame, n_bins: int = 10) -> DataFrame:
    """One row: counts, coverage, Brier, log loss, spread over paraphrases, their weighted sums
    (frie), calibration and rates. Undefined values are null."""
    v = _variant_totals(predictions, n_bins).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_variant_predictions"), F.coalesce(F.sum("n_ok"), F.lit(0)).alias("n_parseable_variant_predictions"),
        F.try_divide(F.sum("brier"), F.sum("n_ok")).alias("mean_brier"), F.try_divide(F.sum("log_loss"), F.sum("n_ok")).alias("mean_log_loss"),
        F.try_divide(F.sum(F.abs(F.col("p") - F.col("y"))), F.sum("n_ok")).alias("ece_10"),
        *[F.try_divide(F.sum(f"p{o}"), F.sum(f"n{o}")).alias(f"mean_prob_outcome_{o}") for o in (0, 1)],
    )
    g = group_metrics(predictions).agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("n_parseable") > 0).alias("n_parseable_groups"),
        F.coalesce(F.avg((F.col("n_parseable") == F.col("n_variants")).cast("double")), F.lit(0.0)).alias("group_full_coverage"),
        F.avg("mean_brier").alias("mean_brier_group"), F.avg("parasd").alias("mean_parasd"), F.avg("outcome").alias("yes_rate"),
    )
    # Two one-row aggregates side by side.
    row = v.join(g, F.lit(True))
    return row.select(
        "n_groups", "n_parseable_groups", "n_variant_predictions", "n_parseable_variant_predictions",
        F.coalesce(F.try_divide("n_parseable_variant_predictions", "n_variant_predictions"), F.lit(0.0)).alias("variant_coverage"), "group_full_coverage",
        "mean_brier", F.col("mean_brier").alias("mean_brier_variant"), "mean_brier_group", "mean_log_loss", "mean_parasd", F.col("mean_brier").alias("frie_lambda_0"),
        (F.col("mean_brier") + F.col("mean_parasd")).alias("frie_lambda_1"), (F.col("mean_brier") + 5 * F.col("mean_parasd")).alias("frie_lambda_5"),
        "ece_10", "yes_rate", "mean_prob_outcome_0", "mean_prob_outcome_1",
    )


def train_base_rate(rows: DataFrame, split: str = "train") -> DataFrame:
    """Mean over the split's groups of the outcome of each group's last variant; null without."""
    groups = rows.where(F.col("split") == split).groupBy("id").agg(F.max_by("outcome", "variant_index").alias("outcome"))
    return groups.agg(F.avg("outcome").alias("train_base_rate"))


def filter_rows(rows: DataFrame, split: str, limit_groups: int | None = None) -> DataFrame:
    """Rows of a split, of its first ``limit_groups`` ids if given, by id and variant."""
    chosen = rows.where(F.col("split") == split)
    if limit_groups is not None:
        chosen = chosen.join(chosen.select("id").distinct().orderBy("id").limit(limit_groups), "id", "left_semi")
    return chosen.orderBy("id", "variant_index")


def predict(rows: DataFrame, mode: str, constant: Column | float = 0.5, model: str = "", source_mode: str | None = None) -> DataFrame:
    """Predictions of the deterministic modes: a constant, or each row's base rate (null and no
    completion where it isn't within [0, 1])."""
    if mode == "constant":
        p = F.lit(constant) if isinstance(constant, float | int) else constant
    elif mode == "context-base-rate":
        raw = F.col("base_rate")["value"].try_cast("double")
        p = F.when(raw.between(0.0, 1.0), raw)
    else:
        raise ValueError(f"no deterministic mode {mode!r}")
    completion = F.coalesce(F.format_string("Probability: %.6f", p.cast("double")), F.lit(""))
    done = rows.withColumn("prediction", p.cast("double")).withColumn("completion", F.when(F.col("prediction").isNotNull(), completion).otherwise(""))
    return prediction_rows(done, source_mode or mode, model)


def prediction_rows(rows: DataFrame, mode: str, model: str) -> DataFrame:
    return rows.select("id", "variant_index", "split", F.col("outcome").cast("int").alias("outcome"), "prediction", F.col("prediction").isNotNull().alias("parseable"), F.lit(mode).alias("mode"), F.lit(model).alias("model"), F.coalesce("question", F.lit("")).alias("question"), "completion")


def evaluate(rows: DataFrame, split: str, mode: str, constant: float = 0.5, limit_groups: int | None = None, model: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, group metrics and the summary row of a deterministic run. The train base
    rate joins as a scalar subquery, so nothing is collected."""
    chosen = filter_rows(rows, split, limit_groups)
    if mode == "train-base-rate":
        made = predict(chosen, "constant", train_base_rate(rows).scalar(), model, mode)
    else:
        made = predict(chosen, mode, constant, model)
    return made, group_metrics(made), summary(made).withColumns({"split": F.lit(split), "mode": F.lit(mode), "model": F.lit(model), "limit_groups": F.lit(limit_groups).cast("int")})
