"""Source payloads to canonical questions. Each mapping yields every input row with a
``reason`` (``ok`` or why it goes) and the question's columns, so that what is dropped can be
counted; ``accepted`` keeps the good ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augur.functions.dates import parse_any_date, parse_iso_date
from augur.functions.text import blank_to_null, flatten_richtext, has_placeholder, render_question_dates, strip
from augur.sources import schema as S

ORDER = ["resolved_at", "id"]

METACULUS = (
    "id string, title string, description string, scheduled_close_time string, resolution_set_time string, "
    "projects struct<category: array<struct<name: string>>>, question struct<id: string, type: string, status: string, title: string, "
    "description: string, resolution_criteria: string, fine_print: string, open_time: string, scheduled_close_time: string, close_time: string, "
    "actual_resolve_time: string, resolution_set_time: string, resolution: string>"
)
POLYMARKET = (
    "id string, conditionId string, slug string, question string, title string, description string, outcomes string, outcomePrices string, "
    "closed boolean, active boolean, volumeNum string, volume string, endDate string, umaEndDate string, tags array<string>"
)
MANIFOLD = (
    "id string, slug string, creatorUsername string, question string, textDescription string, description string, outcomeType string, isResolved boolean, "
    "resolution string, volume string, closeTime string, resolutionTime string, groupSlugs array<string>, url string, uniqueBettorCount string, totalLiquidity string"
)


def truthy(c: Column) -> Column:
    """A text unless it is null or empty."""
    return F.when(F.length(c) > 0, c)


def normalize_outcome(value: Column) -> Column:
    """0 or 1 of a scalar read as text, null where it is neither."""
    v = F.lower(strip(value))
    return F.when(v.isin("1", "1.0", "yes", "true"), 1).when(v.isin("0", "0.0", "no", "false"), 0)


def outcome_prices(value: Column) -> Column:
    """Exactly two numbers from a JSON list, or from a JSON text that holds one."""
    items = F.coalesce(F.from_json(value, "array<string>"), F.from_json(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0], "array<string>"))
    numbers = F.transform(items, lambda x: x.try_cast("double"))
    return F.when((F.size(items) == 2) & ~F.exists(numbers, lambda x: x.isNull()), numbers)


def outcome_names(value: Column) -> Column:
    return F.transform(F.coalesce(F.from_json(value, "array<string>"), F.from_json(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0], "array<string>")), lambda x: F.lower(strip(x)))


def is_yes_no(names: Column) -> Column:
    return F.coalesce(F.array_sort(names) == F.array(F.lit("no"), F.lit("yes")), F.lit(False))


def _reasons(*checks: tuple[Column, str]) -> Column:
    out = F.lit("ok")
    for bad, name in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(True)), name).otherwise(out)
    return out


def _dates_checks(cutoff: str, clamp: bool) -> list[tuple[Column, str]]:
    freeze, resolved = F.col("freeze_date"), F.col("resolved_at")
    late = [] if clamp else [(freeze > resolved, "freeze_after_resolution")]
    return [(freeze.isNull() | resolved.isNull(), "unparseable_dates"), *late, (~S.is_post_cutoff(cutoff), "pre_cutoff")]


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each: what follows refers to the columns'
    values. Else the optimiser would put a column's whole expression wherever it is named,
    and dates, which the checks name again and again, would make plans of many thousand nodes."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def _finished(df: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    rejected = F.coalesce(F.concat(F.lit("schema_reject:"), S.reject_reason()), F.lit("ok"))
    df = settled(df).withColumn("reason", F.coalesce(F.nullif(_reasons(*checks), F.lit("ok")), rejected))
    return settled(df).select("reason", *S.QUESTION.names)


def accepted(mapped: DataFrame) -> DataFrame:
    """Good questions by resolution date and id."""
    return mapped.where("reason = 'ok'").drop("reason").orderBy(*ORDER)


def pull(payload: DataFrame, platform: str, cutoff: str = S.CUTOFF, **options) -> tuple[DataFrame, DataFrame]:
    """Of items as JSON (column ``value``, as the paged source gives them): accepted questions by
    resolution date and id, and how many were skipped for what reason."""
    schema, mapping = {"metaculus": (METACULUS, metaculus), "polymarket": (POLYMARKET, polymarket), "manifold": (MANIFOLD, manifold)}[platform]
    mapped = mapping(payload.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*"), cutoff, **options)
    return accepted(mapped), skip_counts(mapped)


def skip_counts(mapped: DataFrame) -> DataFrame:
    return S.reason_counts(mapped.where("reason <> 'ok'"))


def _raw(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def metaculus(posts: DataFrame, cutoff: str = S.CUTOFF, tournament: str | None = None) -> DataFrame:
    q = lambda f: F.col("question")[f]
    value = F.lower(q("resolution"))
    pid, qid = truthy(F.col("id")), truthy(q("id"))
    fine, criteria = truthy(q("fine_print")), truthy(q("resolution_criteria"))
    names = F.filter(F.transform(F.col("projects")["category"], lambda c: c["name"]), lambda x: F.length(x) > 0)
    tags = F.coalesce(names, F.array().cast("array<string>"))
    df = posts.withColumn("_q", q("type")).select(
        F.concat(F.lit("metaculus::"), F.coalesce(F.concat(pid, F.lit("_"), qid), pid, qid)).alias("id"),
        F.coalesce(truthy(q("title")), truthy(F.col("title")), F.lit("")).alias("question"),
        F.when(value.isin("yes", "true", "1", "1.0"), 1).when(value.isin("no", "false", "0", "0.0"), 0).alias("outcome"),
        parse_any_date(F.coalesce(truthy(q("scheduled_close_time")), truthy(q("close_time")), F.col("scheduled_close_time"))).alias("freeze_date"),
        parse_any_date(F.coalesce(truthy(q("actual_resolve_time")), truthy(q("resolution_set_time")), F.col("resolution_set_time"))).alias("resolved_at"),
        F.lit("metaculus").alias("source"),
        F.concat(F.lit("https://www.metaculus.com/questions/"), pid, F.lit("/")).alias("url"),
        F.coalesce(truthy(q("description")), truthy(F.col("description"))).alias("background"),
        F.coalesce(F.concat(criteria, F.lit("\n\nFine print: "), fine), criteria, F.concat(F.lit("Fine print: "), fine)).alias("resolution_criteria"),
        (F.array_append(tags, F.lit(f"tournament:{tournament}")) if tournament else tags).alias("categories"),
        _raw(
            metaculus_post_id=F.col("id"), metaculus_question_id=q("id"), tournament_label=F.lit(tournament).cast("string"), open_time=q("open_time"),
            scheduled_close_time=q("scheduled_close_time"), actual_resolve_time=q("actual_resolve_time"), resolution_set_time=q("resolution_set_time"),
        ).alias("raw"),
        q("type").alias("_type"), q("status").alias("_status"),
    )
    checks = [(F.col("_type") != "binary", "not_binary"), (F.col("_status") != "resolved", "not_resolved"), (F.col("outcome").isNull(), "unclear_outcome"), *_dates_checks(cutoff, False)]
    return _finished(df, [*checks, (blank_to_null(F.col("question")).isNull(), "no_title"), (F.col("id").isNull(), "no_id")])


def polymarket(markets: DataFrame, cutoff: str = S.CUTOFF, min_volume: float = 1000.0) -> DataFrame:
    """The price of "Yes" decides wherever it stands in the list of outcomes."""
    names, prices = outcome_names(F.col("outcomes")), outcome_prices(F.col("outcomePrices"))
    yes = F.element_at(prices, F.array_position(names, "yes").cast("int"))
    no = F.element_at(prices, F.array_position(names, "no").cast("int"))
    volume = F.coalesce(F.nullif(F.col("volumeNum").try_cast("double"), F.lit(0.0)), F.when(truthy(F.col("volumeNum")).isNull() | (F.col("volumeNum").try_cast("double") == 0), F.col("volume").try_cast("double")), F.lit(0.0))
    resolved = parse_any_date(F.coalesce(truthy(F.col("umaEndDate")), F.col("endDate")))
    text = blank_to_null(strip(F.col("description")))
    tag = lambda t: F.when(t.startswith("{"), F.coalesce(truthy(F.get_json_object(t, "$.label")), F.get_json_object(t, "$.name"))).otherwise(t)
    df = markets.withColumn("_yn", is_yes_no(names)).select(
        F.concat(F.lit("polymarket::"), F.coalesce(truthy(F.col("conditionId")), truthy(F.col("id")), truthy(F.col("slug")))).alias("id"),
        strip(F.coalesce(truthy(F.col("question")), truthy(F.col("title")), F.lit(""))).alias("question"),
        F.when(F.col("_yn"), F.when((yes == 1) & (no == 0), 1).when((yes == 0) & (no == 1), 0)).alias("outcome"),
        F.least(parse_any_date(F.col("endDate")), resolved).alias("freeze_date"), resolved.alias("resolved_at"),
        F.lit("polymarket").alias("source"), F.concat(F.lit("https://polymarket.com/event/"), truthy(F.col("slug"))).alias("url"),
        text.alias("background"), text.alias("resolution_criteria"),
        F.coalesce(F.filter(F.transform("tags", tag), lambda x: F.length(x) > 0), F.array().cast("array<string>")).alias("categories"),
        _raw(polymarket_condition_id=F.col("conditionId"), polymarket_id=F.col("id"), slug=F.col("slug"), endDate=F.col("endDate"), umaEndDate=F.col("umaEndDate"), volume=volume).alias("raw"),
        "closed", "active", "_yn", volume.alias("_volume"), parse_any_date(F.col("endDate")).alias("_end"),
    )
    checks = [
        (~F.coalesce(F.col("closed"), F.lit(False)), "not_closed"), (F.coalesce(F.col("active"), F.lit(False)), "active"), (~F.col("_yn"), "not_yes_no"),
        (F.col("outcome").isNull(), "unclear_outcome"), (F.col("_volume") < min_volume, "low_volume"), (F.col("_end").isNull(), "unparseable_dates"),
        *_dates_checks(cutoff, True), (F.length("question") == 0, "no_title"), (F.col("id").isNull(), "no_id"),
    ]
    return _finished(df, checks)


def manifold(markets: DataFrame, cutoff: str = S.CUTOFF, min_volume: float = 100.0) -> DataFrame:
    volume = F.coalesce(F.col("volume").try_cast("double"), F.lit(0.0))
    resolved = parse_any_date(F.coalesce(F.nullif(truthy(F.col("resolutionTime")), F.lit("0")), F.col("closeTime")))
    given = F.coalesce(truthy(F.col("textDescription")), F.col("description"))
    text = blank_to_null(strip(F.when(given.startswith("{"), flatten_richtext(given)).otherwise(given)))
    page = F.concat(F.lit("https://manifold.markets/"), truthy(F.col("creatorUsername")), F.lit("/"), truthy(F.col("slug")))
    df = markets.select(
        F.concat(F.lit("manifold::"), F.coalesce(truthy(F.col("id")), truthy(F.col("slug")))).alias("id"), strip(F.coalesce("question", F.lit(""))).alias("question"),
        F.when(F.col("resolution") == "YES", 1).when(F.col("resolution") == "NO", 0).alias("outcome"),
        F.least(parse_any_date(F.col("closeTime")), resolved).alias("freeze_date"), resolved.alias("resolved_at"), F.lit("manifold").alias("source"),
        F.coalesce(page, F.col("url")).alias("url"), text.alias("background"), text.alias("resolution_criteria"), F.coalesce("groupSlugs", F.array().cast("array<string>")).alias("categories"),
        _raw(manifold_id=F.col("id"), slug=F.col("slug"), creatorUsername=F.col("creatorUsername"), closeTime=F.col("closeTime"), resolutionTime=F.col("resolutionTime"), volume=F.col("volume"), uniqueBettorCount=F.col("uniqueBettorCount"), totalLiquidity=F.col("totalLiquidity")).alias("raw"),
        "outcomeType", "isResolved", volume.alias("_volume"), parse_any_date(F.col("closeTime")).alias("_close"),
    )
    checks = [
        (F.col("outcomeType") != "BINARY", "not_binary"), (~F.coalesce(F.col("isResolved"), F.lit(False)), "not_resolved"), (F.col("outcome").isNull(), "unclear_outcome"),
        (F.col("_volume") < min_volume, "low_volume"), (F.col("_close").isNull(), "unparseable_dates"), *_dates_checks(cutoff, True),
        (F.length("question") == 0, "no_title"), (F.col("id").isNull(), "no_id"),
    ]
    return _finished(df, checks)


def forecastbench(resolutions: DataFrame, questions: DataFrame, cutoff: str = S.CUTOFF) -> DataFrame:
    """Resolutions joined to the question set that each names. Of an id that passes all checks
    up to the cutoff in several snapshots the first stays, by file name and position; it holds
    the id even if a check after that drops it."""
    r = resolutions.alias("r").join(questions.alias("q"), (F.col("r.set_name") == F.col("q.set_name")) & (F.col("r.id") == F.col("q.id")), "left")
    known_sets = questions.select(F.col("set_name").alias("_set")).distinct()
    r = r.join(known_sets, F.col("r.set_name") == F.col("_set"), "left")
    freeze, resolved = parse_iso_date(F.col("q.freeze_datetime")), parse_any_date(F.col("r.resolution_date"))
    rid = F.coalesce("r.id", F.lit(""))
    flag = F.lower(strip(F.col("r.resolved")))
    df = r.select(
        F.concat(F.lit("forecastbench::"), rid).alias("id"), render_question_dates(F.coalesce("q.question", F.lit("")), freeze, resolved).alias("question"),
        normalize_outcome(F.col("r.resolved_to")).alias("outcome"), freeze.alias("freeze_date"), resolved.alias("resolved_at"), F.lit("forecastbench").alias("source"),
        F.col("q.url"), F.col("q.background"), F.col("q.resolution_criteria"),
        F.when(F.length("q.source") > 0, F.array("q.source")).otherwise(F.array().cast("array<string>")).alias("categories"),
        _raw(
            forecastbench_question_set=F.col("r.set_name"), forecastbench_resolution_snapshot=F.col("r.snapshot"), fb_source=F.col("q.source"), freeze_datetime=F.col("q.freeze_datetime"),
            market_info_open_datetime=F.col("q.market_info_open_datetime"), market_info_close_datetime=F.col("q.market_info_close_datetime"),
            market_info_resolution_criteria=F.col("q.market_info_resolution_criteria"), freeze_datetime_value=F.col("q.freeze_datetime_value"),
        ).alias("raw"),
        F.col("r.snapshot").alias("_snapshot"), F.col("r.pos").alias("_pos"), F.col("r.set_name").alias("_name"), "_set",
        (~F.coalesce(flag.isin("true", "1"), F.lit(False))).alias("_open"), (rid.startswith("[") | rid.contains(",")).alias("_combo"), F.col("q.id").isNull().alias("_missing"),
    )
    first = _reasons(
        (F.coalesce("_name", F.lit("")) == "", "resolution_set_missing_question_set"), (F.col("_set").isNull(), "question_set_file_missing"), (F.col("_open"), "not_resolved"),
        (F.col("outcome").isNull(), "non_binary_outcome"), (F.col("_combo"), "combo_question"), (F.col("_missing"), "question_missing_for_resolution"), *_dates_checks(cutoff, False),
    )
    df = settled(settled(df).withColumn("_first", first))
    # Only rows that passed so far compete for an id; the others, often without one, stay put.
    rank = F.row_number().over(Window.partitionBy("id").orderBy("_snapshot", "_pos"))
    good = df.where("_first = 'ok'").withColumn("_rank", rank)
    df = good.unionByName(df.where("_first <> 'ok'").withColumn("_rank", F.lit(1)))
    later = _reasons((F.col("_rank") > 1, "duplicate_question_id"), (has_placeholder(F.col("question")), "unresolved_placeholder"))
    reason = F.when(F.col("_first") != "ok", F.col("_first")).otherwise(later)
    reason = F.when(reason != "ok", reason).otherwise(F.coalesce(F.concat(F.lit("schema_reject:"), S.reject_reason()), F.lit("ok")))
    return df.withColumn("reason", reason).select("reason", *S.QUESTION.names)


def restamp(questions: DataFrame, source: str = "mantic_q2_aib") -> DataFrame:
    """Questions of one platform under the name of a tournament: source, id and tag."""
    tag = F.lit(f"tournament:{source}")
    return questions.withColumns({
        "source": F.lit(source), "id": F.replace("id", F.lit("metaculus::"), F.lit(f"{source}::")),
        "categories": F.when(F.array_contains("categories", tag), F.col("categories")).otherwise(F.array_append("categories", tag)),
    })


def drop_in(questions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions whose post or question id is listed, restamped, and listed ids without one."""
    both = F.array(F.get_json_object("raw", "$.metaculus_post_id"), F.get_json_object("raw", "$.metaculus_question_id"))
    keyed = questions.select("id", F.explode(both).alias("key")).where("key <> ''")
    wanted = ids.select(F.col("id").alias("key"))
    hit = keyed.join(wanted, "key", "left_semi").select("id").distinct()
    matched = questions.join(hit, "id", "left_semi")
    seen = keyed.join(hit, "id", "left_semi").select("key")
    return restamp(matched), wanted.join(seen, "key", "left_anti").where("key <> ''").select(F.col("key").alias("id"))
