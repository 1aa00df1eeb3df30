"""Grouped rewards and advantages of completions, as window columns over a rollout table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augur.functions.scores import brier
from augur.functions.text import has_punctuation_loop, parse_probability
from augur.sources.files import exists, write_csv


@dataclass(frozen=True)
class RewardConfig:
    lambda_invariance: float = 0.0
    parse_fail_reward: float = -2.0
    punctuation_loop_reward: float = -2.0
    allow_loose_parse: bool = False


@dataclass(frozen=True)
class SafetyConfig:
    min_parse_rate: float = 0.0
    max_punctuation_loop_rate: float = 1.0
    max_zero_std_frac: float = 1.0
    max_ppo_kl: float | None = None
    max_ppo_clip_frac: float | None = None
    start_step: int = 1


def group_rewards(completions: DataFrame, config: RewardConfig = RewardConfig(), group: tuple[str, ...] = ("id",)) -> DataFrame:
    """Adds prediction, parseable, punctuation_loop, brier, invariance_penalty and reward to rows
    with ``completion`` and ``outcome``: minus Brier and lambda times the squared distance from
    the group's mean; fixed rewards for loops and for completions without a probability."""
    rows = completions.withColumn("punctuation_loop", has_punctuation_loop(F.col("completion"))).withColumn("prediction", parse_probability(F.col("completion"), config.allow_loose_parse))
    rows = rows.withColumn("parseable", F.col("prediction").isNotNull() & ~F.col("punctuation_loop"))
    valid = F.when(F.col("parseable"), F.col("prediction"))
    mean = F.avg(valid).over(Window.partitionBy(*group))
    rows = rows.withColumn("brier", F.when(F.col("parseable"), brier(F.col("prediction"), F.col("outcome")))).withColumn("invariance_penalty", F.when(F.col("parseable"), (F.col("prediction") - mean) * (F.col("prediction") - mean)))
    reward = F.when(F.col("punctuation_loop"), config.punctuation_loop_reward).when(~F.col("parseable"), config.parse_fail_reward).otherwise(-(F.col("brier") + config.lambda_invariance * F.col("invariance_penalty")))
    return rows.withColumn("reward", reward)


def advantages(rewards: DataFrame, eps: float = 1e-6, clip: float | None = 5.0, scale: float = 1.0, group: tuple[str, ...] = ("id",)) -> DataFrame:
    """Adds advantage (the reward's z-score in its group, clipped, times scale) and zero_std
    (the group has no spread; its advantages are 0). Shares the window of the rewards."""
    w = Window.partitionBy(*group)
    std = F.stddev_pop("reward").over(w)
    z = (F.col("reward") - F.avg("reward").over(w)) / (std + eps)
    if clip is not None:
        z = F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))
    return rewards.withColumn("zero_std", std < eps).withColumn("advantage", F.when(std < eps, 0.0).otherwise(z * scale))


def summary(scored: DataFrame, by: tuple[str, ...] = (), group: tuple[str, ...] = ("id",)) -> DataFrame:
    """A row for all rollouts, or for each value of ``by`` such as the step."""
    keys = [*by, *[g for g in group if g not in by]]
    flags = scored.groupBy(*keys).agg(F.max(F.col("zero_std").cast("int")).alias("_z"), F.count("*").alias("_n"), F.sum("reward").alias("_r"), F.sum(F.col("reward") * F.col("reward")).alias("_r2"),
        F.min("reward").alias("_lo"), F.max("reward").alias("_hi"), F.count_if("parseable").alias("_p"), F.count_if("punctuation_loop").alias("_l"),
        F.sum(F.when(F.col("parseable"), F.col("prediction"))).alias("_m"), F.sum("brier").alias("_b"), F.sum("invariance_penalty").alias("_i"))
    n, mean = F.sum("_n"), F.try_divide(F.sum("_r"), F.sum("_n"))
    return flags.groupBy(*by).agg(
        mean.alias("reward_mean"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum("_r2"), n) - mean * mean)).alias("reward_std"), F.min("_lo").alias("reward_min"), F.max("_hi").alias("reward_max"),
        F.coalesce(F.try_divide(F.sum("_p"), n), F.lit(0.0)).alias("reward_parse_rate"), F.coalesce(F.try_divide(F.sum("_l"), n), F.lit(0.0)).alias("reward_punctuation_loop_rate"),
        F.try_divide(F.sum("_m"), F.sum("_p")).alias("reward_mean_probability"), F.try_divide(F.sum("_b"), F.sum("_p")).alias("reward_consensus_brier"),
        F.try_divide(F.sum("_i"), F.sum("_p")).alias("reward_paraphrase_variance"), F.coalesce(F.avg("_z"), F.lit(0.0)).alias("frac_reward_zero_std"),
    )


def safety_reason(config: SafetyConfig) -> Column:
    """Why a step's metrics stop the run, the first threshold in order; null where none does."""
    checks = [
        (F.coalesce("reward_parse_rate", F.lit(0.0)) < config.min_parse_rate, "parse rate"),
        (F.coalesce("reward_punctuation_loop_rate", F.lit(0.0)) > config.max_punctuation_loop_rate, "punctuation loop rate"),
        (F.coalesce("frac_reward_zero_std", F.lit(0.0)) > config.max_zero_std_frac, "zero-std reward fraction"),
    ]
    if config.max_ppo_kl is not None:
        checks.append((metric("ppo_kl") > config.max_ppo_kl, "PPO KL"))
    if config.max_ppo_clip_frac is not None:
        checks.append((metric("ppo_clip_frac") > config.max_ppo_clip_frac, "PPO clipped fraction"))
    out = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        out = F.when(bad, name).otherwise(out)
    return F.when(F.col("step") >= config.start_step, out)


def training_groups(rows: DataFrame, split: str) -> DataFrame:
    """Groups of a split with at least two variants, as id, outcome, variants in order. A group
    with differing outcomes raises when it is read."""
    g = rows.where(F.col("split") == split).groupBy("id").agg(F.count("*").alias("n"), F.min("outcome").alias("outcome"), F.max("outcome").alias("_hi"), F.array_sort(F.collect_list(F.struct("variant_index", "messages"))).alias("variants"))
    checked = F.when(F.col("outcome") == F.col("_hi"), F.col("outcome")).otherwise(F.raise_error(F.concat(F.lit("inconsistent outcomes in group "), F.col("id"))).cast("int"))
    return g.where("n >= 2").select("id", checked.alias("outcome"), "n", "variants")


def preflight(rows: DataFrame, split: str) -> DataFrame:
    """One row: groups, their distinct sizes in order, rate of yes."""
    g = rows.where(F.col("split") == split).groupBy("id").agg(F.count("*").alias("n"), F.min("outcome").alias("outcome")).where("n >= 2")
    return g.agg(F.count("*").alias("groups"), F.sort_array(F.collect_set("n")).alias("group_sizes"), F.avg("outcome").alias("yes_rate"))


def select_batch(groups: DataFrame, step: int, seed: int, n: int) -> DataFrame:
    """The ``n`` groups whose hash with seed and step is smallest: another draw each step."""
    return groups.orderBy(F.md5(F.concat_ws("::", F.lit(str(seed + step)), "id")), "id").limit(n)


#: Columns of a rollout, in order.
ROLLOUT = ["id", "variant_index", "outcome", "prediction", "parseable", "reward", "advantage", "stop_reason", "completion"]


def rollout_rows(scored: DataFrame) -> DataFrame:
    return scored.select(*ROLLOUT)


def metric(metrics: Column | str) -> Column:
    """A trainer's metric as a number; null for what is none, and for NaN, which is above nothing."""
    value = (F.col(metrics) if isinstance(metrics, str) else metrics).try_cast("double")
    return F.when(~F.isnan(value), value)


def export_rollouts(folder: str, spark: SparkSession, path: str) -> None:
    """All rollouts of a run as CSV, whatever they were appended in; header in every file."""
    write_csv(spark.read.parquet(f"{folder}/rollouts"), path, ["step", *ROLLOUT])


def run_state(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """The last finished step of a run, 0 before the first, and why it stopped, if it did."""
    at = f"{folder}/metrics"
    if not exists(spark, at):
        return 0, None
    last = spark.read.option("basePath", at).schema("stop string, step int").json(f"{at}/step=*").orderBy(F.desc("step")).first()
    return (last["step"], last["stop"]) if last else (0, None)


def train(rows: DataFrame, split: str, steps: int, groups_per_step: int, seed: int, sample, learn, folder: str, reward: RewardConfig = RewardConfig(), safety: SafetyConfig = SafetyConfig(), clip: float | None = 5.0, scale: float = 1.0, save_every: int = 0) -> str | None:
    """The step loop around a remote trainer: ``sample`` turns rows into rollouts (adds
    completion, stop_reason), ``learn`` takes scored rollouts and returns a dict of loss
    metrics, or a checkpoint's path when called with None. Rollouts, metrics and checkpoints are
    kept by step under ``folder``; returns the reason of a safety stop.

    What is there is the state of the run. Called again, it goes on after the last step with
    metrics; a step that broke off before is done again, but with the rollouts that it has, so
    none is sampled twice, and a stopped run stays stopped."""
    spark = rows.sparkSession
    mine = rows.where(F.col("split") == split)
    sizes = mine.groupBy("id").count().where("count >= 2").select("id")
    if sizes.isEmpty():
        raise ValueError(f"no groups of the split {split!r} to train on")
    last, stop = run_state(spark, folder)
    if stop:
        return stop
    if last and save_every and last % save_every == 0 and not exists(spark, f"{folder}/checkpoints/step={last}/_SUCCESS"):
        _save(spark, folder, last, learn)
    for step in range(last + 1, steps + 1):
        at = f"{folder}/rollouts/step={step}"
        if not exists(spark, f"{at}/_SUCCESS"):
            batch = mine.join(select_batch(sizes, step, seed, groups_per_step), "id", "left_semi")
            scored = advantages(group_rewards(sample(batch), reward), clip=clip, scale=scale)
            scored.drop("step").write.mode("overwrite").parquet(at)  # read back, so that a rollout is sampled once
        scored = spark.read.parquet(at).withColumn("step", F.lit(step))
        loss = learn(scored) or {}
        row = summary(scored, ("step",)).withColumns({k: F.lit(v) for k, v in loss.items()}).withColumn("stop", safety_reason(safety))
        row.drop("step").write.mode("overwrite").json(f"{folder}/metrics/step={step}")
        stop = row.first()["stop"]
        if save_every and step % save_every == 0 and not stop:
            _save(spark, folder, step, learn)
        if stop:
            return stop
    return None


def _save(spark: SparkSession, folder: str, step: int, learn) -> None:
    spark.createDataFrame([(str(learn(None)),)], "path string").write.mode("overwrite").json(f"{folder}/checkpoints/step={step}")
