"""Priors against posteriors: how predictions move from the base rates they were given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augur.functions import scores as X


def matched(predictions: DataFrame, training: DataFrame) -> DataFrame:
    """Every prediction with ``found`` (a training row exists) and, where both are usable, prior
    and posterior. Training rows are unique by (id, variant_index)."""
    t = training.select("id", "variant_index", F.col("outcome").alias("_outcome"), F.col("split").alias("_split"), F.col("base_rate")["value"].alias("_prior"), F.lit(True).alias("_found"))
    p = predictions.select("id", F.col("variant_index").cast("int").alias("variant_index"), "prediction", "parseable")
    prior, posterior = X.base_rate(F.col("_prior")), X.prediction_from_text(F.col("prediction"), F.col("parseable"))
    return p.join(t, ["id", "variant_index"], "left").select("id", "variant_index", F.coalesce("_found", F.lit(False)).alias("found"), F.col("_split").alias("split"), F.col("_outcome").cast("int").alias("outcome"), prior.alias("prior"), posterior.alias("posterior"))


def updates(all_rows: DataFrame) -> DataFrame:
    """Rows with prior and posterior, their scores and the change in log odds."""
    o, a, b = F.col("outcome"), F.col("prior"), F.col("posterior")
    return all_rows.where("found and prior is not null and posterior is not null").select(
        "id", "variant_index", "split", "outcome", "prior", "posterior", (X.logit(b) - X.logit(a)).alias("log_odds_update"), X.brier(a, o).alias("prior_brier"), X.brier(b, o).alias("posterior_brier"),
        X.log_loss(a, o).alias("prior_log_loss"), X.log_loss(b, o).alias("posterior_log_loss"), X.update_direction_correct(o, a, b).alias("update_direction_correct"),
    )


def groups(joined: DataFrame) -> DataFrame:
    return joined.groupBy("id").agg(
        F.min_by("split", "variant_index").alias("split"), F.min_by("outcome", "variant_index").alias("outcome"), F.count("*").alias("n_parseable"),
        F.avg("prior").alias("prior_mean"), F.avg("posterior").alias("posterior_mean"), F.avg("log_odds_update").alias("mean_log_odds_update"), F.stddev_pop("log_odds_update").alias("log_odds_update_sd"),
        F.stddev_pop("posterior").alias("posterior_sd"), F.avg("posterior_brier").alias("posterior_brier"), F.avg("prior_brier").alias("prior_brier"),
        F.avg(F.col("update_direction_correct").cast("double")).alias("update_direction_correct_rate"),
    )


def summary(predictions: DataFrame, training: DataFrame) -> DataFrame:
    """One row of counts, mean scores, improvements over the prior, and the correlation of updates
    with what was left to learn."""
    # One pass: a row's terms go into its group's sums, and the groups' sums into the table's.
    o, a, b = F.col("outcome"), F.col("prior"), F.col("posterior")
    use = F.col("found") & a.isNotNull() & b.isNotNull()
    u, rest = X.logit(b) - X.logit(a), o - a
    terms = {
        "prior_brier": X.brier(a, o), "posterior_brier": X.brier(b, o), "prior_log_loss": X.log_loss(a, o), "posterior_log_loss": X.log_loss(b, o),
        "direction": X.update_direction_correct(o, a, b).cast("double"), "abs": F.abs(u), "u": u, "uu": u * u, "r": rest, "rr": rest * rest, "ur": u * rest,
    }
    marked = matched(predictions, training).withColumn("use", use)
    g = marked.groupBy("id").agg(
        F.count("*").alias("all"), F.count_if(~F.col("found")).alias("missing"), F.count_if("use").alias("n"), *[F.sum(F.when(F.col("use"), c)).alias(f"s_{k}") for k, c in terms.items()],
        F.stddev_pop(F.when(F.col("use"), u)).alias("u_sd"), F.stddev_pop(F.when(F.col("use"), b)).alias("p_sd"),
    )
    per_row = lambda k: F.try_divide(F.sum(f"s_{k}"), F.sum("n"))
    n, cross = F.sum("n"), lambda x, y, xy: F.sum(f"s_{xy}") - F.try_divide(F.sum(f"s_{x}") * F.sum(f"s_{y}"), F.sum("n"))
    row = g.agg(
        F.coalesce(F.sum("all"), F.lit(0)).alias("n_variant_predictions"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_training_rows"), F.coalesce(n, F.lit(0)).alias("n_joined_parseable"), F.count_if(F.col("n") > 0).alias("n_groups"),
        per_row("prior_brier").alias("mean_prior_brier"), per_row("posterior_brier").alias("mean_posterior_brier"), per_row("prior_log_loss").alias("mean_prior_log_loss"), per_row("posterior_log_loss").alias("mean_posterior_log_loss"),
        per_row("direction").alias("update_direction_accuracy"), per_row("abs").alias("mean_abs_log_odds_update"), per_row("u").alias("mean_log_odds_update"),
        F.avg("u_sd").alias("mean_group_log_odds_update_sd"), F.avg("p_sd").alias("mean_group_posterior_sd"), n.alias("_n"), cross("u", "u", "uu").alias("_uu"), cross("r", "r", "rr").alias("_rr"), cross("u", "r", "ur").alias("_ur"),
    )
    # Without spread there is no correlation; sums leave a rounding error in its place.
    flat = (F.col("_n") < 2) | (F.least("_uu", "_rr") <= F.lit(1e-12) * F.col("_n"))
    row = row.withColumn("update_outcome_correlation", F.when(~F.coalesce(flat, F.lit(True)), F.col("_ur") / F.sqrt(F.col("_uu") * F.col("_rr"))))
    return row.select(
        "n_variant_predictions", "n_joined_parseable", "n_groups", "missing_training_rows", F.coalesce(F.try_divide("n_joined_parseable", "n_variant_predictions"), F.lit(0.0)).alias("coverage"),
        "mean_prior_brier", "mean_posterior_brier", (F.col("mean_prior_brier") - F.col("mean_posterior_brier")).alias("brier_improvement_vs_prior"), "mean_prior_log_loss", "mean_posterior_log_loss",
        (F.col("mean_prior_log_loss") - F.col("mean_posterior_log_loss")).alias("log_loss_improvement_vs_prior"), "update_direction_accuracy", "mean_abs_log_odds_update", "mean_log_odds_update",
        "mean_group_log_odds_update_sd", "mean_group_posterior_sd", "update_outcome_correlation",
    )
