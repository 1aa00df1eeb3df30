"""Training rows: questions with contexts and paraphrases, K variants each, and their prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augur.functions.dates import parse_stripped_date
from augur.functions.text import blank_to_null, strip

SYSTEM_PROMPT = (
    "You forecast binary questions carefully and in a calibrated way. You are given a question, "
    "the date of the forecast, a prior from a base rate, and news from before that date. Rely on "
    "nothing else. Begin with a line of exactly `Probability: <number between 0 and 1>`, then "
    "give brief reasons."
)


def leakage_filter(news: Column, freeze_date: Column) -> Column:
    """struct(kept, filtered): items dated strictly before the freeze with a headline or summary,
    and how many were not."""
    # What an expression within a function of arrays names twice is computed twice, a variable is not.
    once = lambda c, f: F.transform(F.array(c), f)[0]
    texts = F.transform(F.coalesce(news, F.array().cast("array<struct<date: string, headline: string, summary: string>>")), lambda n: F.struct(
        strip(n["date"]).alias("date"), strip(F.coalesce(n["headline"], F.lit(""))).alias("headline"), strip(F.coalesce(n["summary"], F.lit(""))).alias("summary")))
    clean = F.transform(texts, lambda n: F.struct(parse_stripped_date(n["date"]).alias("day"), n["headline"].alias("headline"), n["summary"].alias("summary")))
    good = lambda items: F.filter(items, lambda n: F.coalesce(n["day"] < freeze_date, F.lit(False)) & ((F.length(n["headline"]) > 0) | (F.length(n["summary"]) > 0)))
    shown = lambda items: F.transform(items, lambda n: F.struct(F.date_format(n["day"], "yyyy-MM-dd").alias("date"), n["headline"].alias("headline"), n["summary"].alias("summary")))
    return once(clean, lambda every: once(good(every), lambda g: F.struct(shown(g).alias("kept"), (F.size(every) - F.size(g)).alias("filtered"))))


def render_user_prompt(question: Column, row: dict[str, Column]) -> Column:
    """The prompt of one variant. Numbers follow Java's rounding of %.3f."""
    b, opt = row["base_rate"], lambda c: blank_to_null(c)
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    item = lambda n: F.concat(F.lit("  ["), F.coalesce(n["date"], F.lit("")), F.lit("] "), strip(F.coalesce(n["headline"], F.lit(""))), F.coalesce(F.concat(F.lit(" — "), strip(opt(n["summary"]))), F.lit("")))
    prior = F.format_string(
        "Base-rate prior: %.3f (reference class size: %d; window: %d years)",
        F.coalesce(b["value"], F.lit(0.5)), F.coalesce(b["n_reference_events"], F.lit(0)), F.coalesce(b["reference_window_years"], F.lit(0)),
    )
    parts = [
        F.concat(F.lit("Forecast date: "), day(row["freeze_date"])), F.concat(F.lit("Resolution date: "), day(row["resolved_at"])), F.concat(F.lit("Source: "), row["source"]),
        F.lit(""), F.lit("Question:"), strip(question), F.lit(""), F.lit("Background:"), strip(F.coalesce(F.when(F.length(row["background"]) > 0, row["background"]), F.lit("(none provided)"))), F.lit(""),
        F.when(F.length(row["resolution_criteria"]) > 0, F.concat(F.lit("Resolution criteria:\n"), strip(row["resolution_criteria"]), F.lit("\n"))),
        prior, F.concat(F.lit("Base-rate reasoning: "), strip(opt(b["explanation"]))), F.lit(""),
        F.when(F.size(row["news"]) > 0, F.concat(F.lit("Relevant news (all dated before forecast date):\n"), F.array_join(F.transform(row["news"], item), "\n"), F.lit("\n"))),
        F.lit("Put your forecast on the first line exactly as:"), F.lit("Probability: <number between 0 and 1>"), F.lit("Then add a short rationale on the following lines."),
    ]
    return F.concat_ws("\n", *parts)


def last_row(df: DataFrame, key: str) -> DataFrame:
    """One row a key, the last by file and position, which ``read_rows`` adds. A frame without
    them must have one row a key; several are an error when they are met."""
    if not {"_file", "_row"} <= set(df.columns):
        one = F.when(F.count("*") > 1, F.raise_error(F.lit(f"several rows of a {key} and no order"))).otherwise(F.first(F.struct(*df.columns)))
        return df.groupBy(F.col(key).alias("_key")).agg(one.alias("r")).select("r.*")
    place = F.struct("_file", "_row")
    rest = [c for c in df.columns if c not in ("_file", "_row")]
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rest), place).alias("r")).select("r.*")


def checked(questions: DataFrame, contexts: DataFrame, paraphrases: DataFrame, splits: DataFrame, k: int) -> DataFrame:
    """Every question with ``reason`` (``ok`` or the first guard that fails), its split (test if it
    has none), context, and its first k variants in order."""
    c = last_row(contexts.where("question_id <> ''"), "question_id").select(F.col("question_id").alias("id"), F.coalesce("base_rate", F.lit(None)).alias("base_rate"), F.col("news_snapshot").alias("news"), F.lit(True).alias("_c"))
    p = last_row(paraphrases.where("question_id <> ''"), "question_id").select(F.col("question_id").alias("id"), F.coalesce("paraphrases", F.array().cast(paraphrases.schema["paraphrases"].dataType)).alias("_all"), F.lit(True).alias("_p"))
    rows = questions.join(c, "id", "left").join(p, "id", "left").join(splits, "id", "left").withColumn("split", F.coalesce("split", F.lit("test")))
    # Positions keep the order of equal indices.
    ordered = F.array_sort(F.transform("_all", lambda x, i: F.struct(F.coalesce(x["variant_index"], F.lit(0)).alias("v"), i.alias("i"), x["text"].alias("text"), x["is_original"].alias("is_original"))))
    rows = rows.withColumn("variants", F.slice(ordered, 1, k))
    first = F.try_element_at("variants", F.lit(1))
    reason = (
        F.when(F.col("_c").isNull(), "missing_context").when(F.col("_p").isNull(), "missing_paraphrase").when(F.size("_all") < k, "paraphrase_group_too_small")
        .when(~F.coalesce(first["is_original"], F.lit(False)), "original_not_first").when(strip(F.coalesce(first["text"], F.lit(""))) != strip(F.col("question")), "original_text_mismatch").otherwise("ok")
    )
    return rows.withColumn("reason", reason).drop("_c", "_p", "_all")


def assemble(questions: DataFrame, contexts: DataFrame, paraphrases: DataFrame, splits: DataFrame, k: int) -> DataFrame:
    """Training rows, one for each kept question and variant with text; indices follow the order
    of variants, and a variant without text leaves a gap."""
    return training_rows(checked(questions, contexts, paraphrases, splits, k))


def training_rows(checked_rows: DataFrame) -> DataFrame:
    """Training rows from the output of ``checked``."""
    rows = checked_rows.where("reason = 'ok'")
    rows = rows.select("*", F.posexplode("variants").alias("variant_index", "_v")).withColumn("_text", strip(F.coalesce(F.col("_v")["text"], F.lit("")))).where("_text <> ''")
    cols = {c: F.col(c) for c in ("freeze_date", "resolved_at", "source", "background", "resolution_criteria", "base_rate", "news")}
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", render_user_prompt(F.col("_text"), cols)))
    original = F.coalesce(F.col("_v")["is_original"], F.col("variant_index") == 0)
    return rows.select(
        "id", "variant_index", original.alias("is_original"), "split", F.col("_text").alias("question"), "outcome", "freeze_date", "resolved_at", "source", messages.alias("messages"), "base_rate",
        F.coalesce("news", F.array().cast(checked_rows.schema["news"].dataType)).alias("news_snapshot"), "categories",
    )


def assembly_stats(rows: DataFrame) -> DataFrame:
    """Counts by name from the output of ``checked``: guards, emitted groups in all and by split,
    kept questions without news, and variants without text."""
    good = F.col("reason") == "ok"
    empty = F.size(F.filter("variants", lambda v: F.length(strip(F.coalesce(v["text"], F.lit("")))) == 0))
    names = F.array_compact(F.array(
        F.when(good, F.lit("groups_emitted")), F.when(good, F.concat(F.lit("groups_emitted_"), F.col("split"))), F.when(~good, F.col("reason")), F.when(good & (F.coalesce(F.size("news"), F.lit(0)) <= 0), F.lit("empty_news_snapshot"))))
    names = F.concat(names, F.when(good, F.array_repeat(F.lit("empty_variant_text"), empty)).otherwise(F.array().cast("array<string>")))
    return rows.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
