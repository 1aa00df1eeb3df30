"""Reports over questions, and over the progress and cost of enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augur.functions.dates import month
from augur.functions.text import classify_response, fmt_cost, fmt_eta


def by_source(questions: DataFrame) -> DataFrame:
    return questions.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("outcome"), 3).alias("yes_rate"))


def by_month(questions: DataFrame) -> DataFrame:
    return questions.groupBy(month(F.col("resolved_at")).alias("month")).agg(F.count("*").alias("n"))


def top_categories(questions: DataFrame, n: int = 20) -> DataFrame:
    """Ties go to the name that sorts first."""
    return questions.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(n)


def report(questions: DataFrame) -> DataFrame:
    """One row with everything; ranges are minima and maxima."""
    entries = lambda df, k, v: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias("m"))
    head = questions.agg(
        F.count("*").alias("n"), F.round(F.avg("outcome"), 3).alias("yes_rate"), F.struct(F.min("freeze_date"), F.max("freeze_date")).alias("freeze_range"), F.struct(F.min("resolved_at"), F.max("resolved_at")).alias("resolved_range")
    )
    parts = {"by_source": entries(by_source(questions), "source", "n"), "yes_rate_by_source": entries(by_source(questions), "source", "yes_rate"), "resolved_months": entries(by_month(questions), "month", "n"), "top_categories": entries(top_categories(questions), "category", "n")}
    for name, df in parts.items():
        head = head.join(df.withColumnRenamed("m", name), F.lit(True))
    return head


def token_totals(cache: DataFrame) -> DataFrame:
    """Calls and tokens by kind of response, from ``read_cache``."""
    u = F.col("response")["usage"]
    return cache.groupBy(classify_response(F.coalesce(F.col("response")["text"], F.lit(""))).alias("kind")).agg(
        F.count("*").alias("calls"), F.sum(F.coalesce(u["input_tokens"], F.lit(0))).alias("input_tokens"), F.sum(F.coalesce(u["output_tokens"], F.lit(0))).alias("output_tokens"))


def trailing_rates(times: DataFrame, now, minutes: tuple[int, ...] = (1, 5, 15), ts: str = "ts") -> DataFrame:
    """Events a minute over windows that end at ``now``; their start counts as inside."""
    return times.agg(*[(F.count_if(F.col(ts) >= now - F.expr(f"INTERVAL {m} MINUTES")) / m).alias(f"per_minute_{m}") for m in minutes])


def rolling_rate(times: DataFrame, seconds: int, ts: str = "ts", key: str | None = None) -> DataFrame:
    """For every event the events of its bucket's trailing window, as a rate a minute: counts by
    second first, so that windows run over distinct seconds and not over events."""
    from pyspark.sql import Window

    keys = [key] if key else [F.col("_day")]
    s = times.withColumn("_s", F.unix_timestamp(ts)).withColumn("_day", F.to_date(ts))
    counts = s.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_s").rangeBetween(-seconds, 0)
    return counts.withColumn("per_minute", F.sum("_n").over(w) / (seconds / 60.0))


def projection(totals: DataFrame, targets: DataFrame, rate_per_minute: float, price_in: float = 3.0, price_out: float = 15.0) -> DataFrame:
    """Linear projection of tokens and cost to ``targets`` (kind, target): what a call has cost so
    far, times what is left, and the time that takes at the given rate."""
    t = targets.join(totals, "kind", "left").na.fill(0, ["calls", "input_tokens", "output_tokens"])
    left = F.greatest(F.lit(0), F.col("target") - F.col("calls"))
    per = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("calls")), F.lit(0.0)) * F.col("target")
    return t.select(
        "kind", "target", "calls", left.alias("remaining"), fmt_cost(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out).alias("spent"),
        fmt_cost(per("input_tokens"), per("output_tokens"), price_in, price_out).alias("projected"), fmt_eta(left.cast("double"), F.lit(float(rate_per_minute))).alias("eta"),
    )
