"""The registered queries and their SQL. Names begin with the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.functions import dates, entities, scores
from augur.functions import text as X
from augur.operators import assemble, audit, coherence, dedupe, metrics, rewards, split
from augur.plans import views as V
from augur.sources import platforms, schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CUTOFF = "1996-06-30"
#: Order priorities stand for the five sources.
RANKS = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql.replace("{P}", f"({V.text('duckdb', V.PREDICTIONS)}) p").replace("{Q}", f"({V.text('duckdb', V.QUESTIONS)}) q").replace("{C}", f"({V.text('duckdb', V.COMPLETIONS)}) c")
        return f

    return add


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _predictions(s: SparkSession, d: str) -> DataFrame:
    return V.view(s, d, V.PREDICTIONS)


def _questions(s: SparkSession, d: str) -> DataFrame:
    return V.view(s, d, V.QUESTIONS).withColumn("categories", F.array("source"))


def _training(p: DataFrame) -> DataFrame:
    """Training rows of the predictions view; every seventh event has none."""
    return p.where("event_id % 7 <> 0").select("id", "variant_index", "split", "outcome", F.struct(F.col("base_rate").alias("value")).alias("base_rate"))


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


_GROUP = """SELECT id, min_by(split, variant_index) AS split, min_by(outcome, variant_index) AS outcome, count(*) AS n_variants, count(prediction) AS n_parseable,
  count(prediction) / cast(count(*) AS double) AS coverage, avg(prediction) AS mean_prob, stddev_pop(prediction) AS parasd,
  avg((prediction - outcome) * (prediction - outcome)) AS mean_brier FROM {P} GROUP BY id"""
_LL = "-ln(CASE WHEN prediction IS NULL THEN NULL WHEN outcome = 1 THEN greatest(least(prediction, 1 - 1e-6), 1e-6) ELSE 1 - greatest(least(prediction, 1 - 1e-6), 1e-6) END)"
_ECE = "SELECT sum(abs(sp - sy)) / sum(n) AS ece FROM (SELECT sum(prediction) AS sp, cast(sum(outcome) AS double) AS sy, count(*) AS n FROM {P} WHERE prediction IS NOT NULL GROUP BY least(floor(prediction * 10), 9)) b"
_SUMMARY = f"""SELECT n_groups, n_parseable_groups, n_variant_predictions, n_parseable_variant_predictions, {_r('variant_coverage', 'group_full_coverage', 'mean_brier')},
  round(mean_brier, 9) AS mean_brier_variant, {_r('mean_brier_group', 'mean_log_loss', 'mean_parasd')}, round(mean_brier, 9) AS frie_lambda_0, round(mean_brier + mean_parasd, 9) AS frie_lambda_1,
  round(mean_brier + 5 * mean_parasd, 9) AS frie_lambda_5, round(ece, 9) AS ece_10, {_r('yes_rate', 'mean_prob_outcome_0', 'mean_prob_outcome_1')}
FROM (SELECT count(*) AS n_variant_predictions, count(prediction) AS n_parseable_variant_predictions, count(prediction) / cast(count(*) AS double) AS variant_coverage,
    avg((prediction - outcome) * (prediction - outcome)) AS mean_brier, avg({_LL}) AS mean_log_loss,
    avg(prediction) FILTER (WHERE outcome = 0) AS mean_prob_outcome_0, avg(prediction) FILTER (WHERE outcome = 1) AS mean_prob_outcome_1 FROM {{P}}) v,
  (SELECT count(*) AS n_groups, count(*) FILTER (WHERE n_parseable > 0) AS n_parseable_groups, avg(CASE WHEN n_parseable = n_variants THEN 1e0 ELSE 0e0 END) AS group_full_coverage,
    avg(mean_brier) AS mean_brier_group, avg(parasd) AS mean_parasd, avg(outcome) AS yes_rate FROM ({_GROUP}) g0) g, ({_ECE}) c"""
_REWARD = """SELECT *, CASE WHEN punctuation_loop THEN -2e0 WHEN prediction IS NULL THEN -2e0 ELSE -(brier + 5e-1 * invariance_penalty) END AS reward FROM
 (SELECT *, CASE WHEN parseable THEN (prediction - outcome) * (prediction - outcome) END AS brier, CASE WHEN parseable THEN (prediction - m) * (prediction - m) END AS invariance_penalty FROM
 (SELECT *, prediction IS NOT NULL AND NOT punctuation_loop AS parseable, avg(CASE WHEN NOT punctuation_loop THEN prediction END) OVER (PARTITION BY id) AS m FROM
 (SELECT *, CASE WHEN raw LIKE '%\\%' ESCAPE '\\' THEN try_cast(rtrim(raw, '%') AS double) / 100 ELSE try_cast(raw AS double) END AS prediction FROM
 (SELECT *, completion LIKE '%!!!!!!!!!!!!!!!!%' AS punctuation_loop, regexp_extract(completion, '(?im)(?:^|assistantfinal|\\b)\\s*(?:final\\s+)?probability\\s*:\\s*([+-]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)\\s*%?)(?:\\s|$)', 1) AS raw FROM {C}) a) b) c2) d2"""
_ADV = f"""SELECT *, coalesce(sd < 1e-6, true) AS zero_std, CASE WHEN sd < 1e-6 THEN 0e0 ELSE greatest(least((reward - mr) / (sd + 1e-6), 5e0), -5e0) END AS advantage FROM
 (SELECT *, stddev_pop(reward) OVER (PARTITION BY id) AS sd, avg(reward) OVER (PARTITION BY id) AS mr FROM ({_REWARD}) r0) r1"""
_CLIP = "greatest(least({}, 1 - 1e-6), 1e-6)"
_JOINED = f"""SELECT id, variant_index, split, outcome, prior, posterior, ln(posterior / (1 - posterior)) - ln(prior / (1 - prior)) AS log_odds_update, (prior - outcome) * (prior - outcome) AS prior_brier,
  (posterior - outcome) * (posterior - outcome) AS posterior_brier, -ln(CASE WHEN outcome = 1 THEN prior ELSE 1 - prior END) AS prior_log_loss, -ln(CASE WHEN outcome = 1 THEN posterior ELSE 1 - posterior END) AS posterior_log_loss,
  CASE WHEN (outcome = 1 AND posterior >= prior) OR (outcome = 0 AND posterior <= prior) THEN 1e0 ELSE 0e0 END AS good
 FROM (SELECT *, {_CLIP.format('base_rate')} AS prior, {_CLIP.format('prediction')} AS posterior FROM {{P}} WHERE event_id % 7 <> 0 AND prediction IS NOT NULL AND base_rate IS NOT NULL) j"""
_COH_GROUP = f"""SELECT id, min_by(split, variant_index) AS split, min_by(outcome, variant_index) AS outcome, count(*) AS n_parseable, avg(prior) AS prior_mean, avg(posterior) AS posterior_mean, avg(log_odds_update) AS mean_log_odds_update,
  stddev_pop(log_odds_update) AS log_odds_update_sd, stddev_pop(posterior) AS posterior_sd, avg(posterior_brier) AS posterior_brier, avg(prior_brier) AS prior_brier, avg(good) AS update_direction_correct_rate FROM ({_JOINED}) jj GROUP BY id"""


@_query("A3_group_metrics", f"SELECT id, split, outcome, n_variants, n_parseable, {_r('coverage', 'mean_prob', 'parasd', 'mean_brier')} FROM ({_GROUP}) g")
def _(s, d):
    return _rounded(metrics.group_metrics(_predictions(s, d)))


@_query("summary_frie", _SUMMARY)
def _(s, d):
    return _rounded(metrics.summary(_predictions(s, d)))


@_query("A6_ece_10", f"SELECT round(ece, 9) AS ece FROM ({_ECE}) e")
def _(s, d):
    return _rounded(metrics.expected_calibration_error(_predictions(s, d)))


@_query("X10_log_loss", f"SELECT id, variant_index, event_id, round((prediction - outcome) * (prediction - outcome), 9) AS brier, round({_LL}, 9) AS log_loss, round(ln({_CLIP.format('prediction')} / (1 - {_CLIP.format('prediction')})), 9) AS logit FROM {{P}} WHERE prediction IS NOT NULL")
def _(s, d):
    p, o = F.col("prediction"), F.col("outcome")
    return _rounded(_predictions(s, d).where("prediction is not null").select("id", "variant_index", "event_id", scores.brier(p, o).alias("brier"), scores.log_loss(p, o).alias("log_loss"), scores.logit(p).alias("logit")))


@_query("A7_train_base_rate", "SELECT round(avg(outcome), 9) AS train_base_rate FROM (SELECT id, max_by(outcome, variant_index) AS outcome FROM {P} WHERE split = 'train' GROUP BY id) g")
def _(s, d):
    return _rounded(metrics.train_base_rate(_predictions(s, d)))


@_query("A7_label_base_rate", "SELECT round(avg(quality), 9) AS train_base_rate FROM labels")
def _(s, d):
    rows = _table(s, d, "labels").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("variant_index"), F.lit("train").alias("split"), F.col("quality").alias("outcome"))
    return _rounded(metrics.train_base_rate(rows))


@_query("T3_limit_groups", "SELECT id, variant_index, event_id FROM {P} WHERE split = 'test' AND id IN (SELECT DISTINCT id FROM {P} WHERE split = 'test' ORDER BY id LIMIT 20)")
def _(s, d):
    return metrics.filter_rows(_predictions(s, d), "test", 20).select("id", "variant_index", "event_id")


@_query("P13_base_rate_modes", "SELECT id, variant_index, split, outcome, round(CASE WHEN base_rate BETWEEN 0 AND 1 THEN base_rate END, 9) AS prediction, base_rate BETWEEN 0 AND 1 AS parseable, 'context-base-rate' AS mode, count(*) AS n FROM {P} WHERE split = 'validation' GROUP BY ALL")
def _(s, d):
    rows = _predictions(s, d).withColumn("base_rate", F.struct(F.col("base_rate").alias("value"))).withColumn("question", F.lit("q"))
    made = metrics.predict(metrics.filter_rows(rows, "validation"), "context-base-rate")
    return _rounded(made).groupBy("id", "variant_index", "split", "outcome", "prediction", "parseable", "mode").agg(F.count("*").alias("n"))


@_query("C10_evaluate_train_base_rate", """WITH t AS (SELECT avg(outcome) AS p FROM (SELECT id, max_by(outcome, variant_index) AS outcome FROM {P} WHERE split = 'train' GROUP BY id) g),
 r AS (SELECT id, outcome, (SELECT p FROM t) AS p FROM {P} WHERE split = 'test'), g AS (SELECT id, any_value(outcome) AS outcome FROM r GROUP BY id)
 SELECT (SELECT count(*) FROM g) AS n_groups, (SELECT count(*) FROM r) AS n_variant_predictions, round((SELECT avg((p - outcome) * (p - outcome)) FROM r), 9) AS mean_brier, round((SELECT avg(outcome) FROM g), 9) AS yes_rate, 'train-base-rate' AS mode""")
def _(s, d):
    rows = _predictions(s, d).withColumn("question", F.lit("q"))
    return _rounded(metrics.evaluate(rows, "test", "train-base-rate")[2].select("n_groups", "n_variant_predictions", "mean_brier", "yes_rate", "mode"))


@_query("C5_coherence_group", f"SELECT id, split, outcome, n_parseable, {_r('prior_mean', 'posterior_mean', 'mean_log_odds_update', 'log_odds_update_sd', 'posterior_sd', 'posterior_brier', 'prior_brier', 'update_direction_correct_rate')} FROM ({_COH_GROUP}) g")
def _(s, d):
    p = _predictions(s, d)
    return _rounded(coherence.groups(coherence.updates(coherence.matched(p, _training(p)))))


@_query("A9_coherence_summary", f"""SELECT n_variant_predictions, n_joined_parseable, n_groups, missing_training_rows, round(n_joined_parseable / cast(n_variant_predictions AS double), 9) AS coverage, {_r('mean_prior_brier', 'mean_posterior_brier')},
  round(mean_prior_brier - mean_posterior_brier, 9) AS brier_improvement_vs_prior, {_r('mean_prior_log_loss', 'mean_posterior_log_loss')}, round(mean_prior_log_loss - mean_posterior_log_loss, 9) AS log_loss_improvement_vs_prior,
  {_r('update_direction_accuracy', 'mean_abs_log_odds_update', 'mean_log_odds_update', 'mean_group_log_odds_update_sd', 'mean_group_posterior_sd', 'update_outcome_correlation')}
 FROM (SELECT count(*) AS n_variant_predictions, count(*) FILTER (WHERE event_id % 7 = 0) AS missing_training_rows FROM {{P}}) a,
  (SELECT count(*) AS n_joined_parseable, avg(prior_brier) AS mean_prior_brier, avg(posterior_brier) AS mean_posterior_brier, avg(prior_log_loss) AS mean_prior_log_loss, avg(posterior_log_loss) AS mean_posterior_log_loss,
    avg(good) AS update_direction_accuracy, avg(abs(log_odds_update)) AS mean_abs_log_odds_update, avg(log_odds_update) AS mean_log_odds_update, corr(log_odds_update, outcome - prior) AS update_outcome_correlation FROM ({_JOINED}) j2) b,
  (SELECT count(*) AS n_groups, avg(log_odds_update_sd) AS mean_group_log_odds_update_sd, avg(posterior_sd) AS mean_group_posterior_sd FROM ({_COH_GROUP}) g2) c""")
def _(s, d):
    p = _predictions(s, d)
    return _rounded(coherence.summary(p, _training(p)))


@_query("A10_pearson", "SELECT split, round(corr(prediction, base_rate), 9) AS r, count(*) AS n FROM {P} WHERE prediction IS NOT NULL GROUP BY split")
def _(s, d):
    return _rounded(_predictions(s, d).where("prediction is not null").groupBy("split").agg(scores.pearson(F.col("prediction"), F.col("base_rate")).alias("r"), F.count("*").alias("n")))


def _scored(s: SparkSession, d: str) -> DataFrame:
    return rewards.advantages(rewards.group_rewards(V.view(s, d, V.COMPLETIONS), rewards.RewardConfig(lambda_invariance=0.5)))


@_query("X8_parse_probability", f"SELECT event_id, completion, round(prediction, 9) AS prediction, punctuation_loop FROM ({_REWARD}) r")
def _(s, d):
    c = F.col("completion")
    return _rounded(V.view(s, d, V.COMPLETIONS).select("event_id", "completion", X.parse_probability(c).alias("prediction"), X.has_punctuation_loop(c).alias("punctuation_loop")))


@_query("C6_group_rewards", f"SELECT id, variant_index, event_id, parseable, punctuation_loop, {_r('prediction', 'brier', 'invariance_penalty', 'reward')} FROM ({_REWARD}) r")
def _(s, d):
    rows = rewards.group_rewards(V.view(s, d, V.COMPLETIONS), rewards.RewardConfig(lambda_invariance=0.5))
    return _rounded(rows.select("id", "variant_index", "event_id", "parseable", "punctuation_loop", "prediction", "brier", "invariance_penalty", "reward"))


@_query("C7_advantages", f"SELECT id, variant_index, event_id, zero_std, round(advantage, 6) AS advantage FROM ({_ADV}) r")
def _(s, d):
    return _rounded(_scored(s, d).select("id", "variant_index", "event_id", "zero_std", "advantage"), 6)


@_query("A14_reward_summary", f"""SELECT split, {_r('reward_mean')}, round(reward_std, 6) AS reward_std, {_r('reward_min', 'reward_max', 'reward_parse_rate', 'reward_punctuation_loop_rate', 'reward_mean_probability', 'reward_consensus_brier', 'reward_paraphrase_variance', 'frac_reward_zero_std')} FROM
 (SELECT split, avg(reward) AS reward_mean, stddev_pop(reward) AS reward_std, min(reward) AS reward_min, max(reward) AS reward_max, avg(CASE WHEN parseable THEN 1e0 ELSE 0e0 END) AS reward_parse_rate, avg(CASE WHEN punctuation_loop THEN 1e0 ELSE 0e0 END) AS reward_punctuation_loop_rate,
  avg(CASE WHEN parseable THEN prediction END) AS reward_mean_probability, avg(brier) AS reward_consensus_brier, avg(invariance_penalty) AS reward_paraphrase_variance FROM ({_ADV}) x GROUP BY split) a
 JOIN (SELECT split, avg(z) AS frac_reward_zero_std FROM (SELECT split, id, max(CASE WHEN zero_std THEN 1e0 ELSE 0e0 END) AS z FROM ({_ADV}) y GROUP BY split, id) z0 GROUP BY split) b USING (split)""")
def _(s, d):
    out = rewards.summary(_scored(s, d), ("split",))
    return _rounded(out.withColumn("reward_std", F.round("reward_std", 6)))


@_query("C11_safety", f"""SELECT step, CASE WHEN pr < 8e-1 THEN 'parse rate' WHEN lr > 2e-2 THEN 'punctuation loop rate' END AS stop FROM (SELECT variant_index AS step, avg(CASE WHEN parseable THEN 1e0 ELSE 0e0 END) AS pr, avg(CASE WHEN punctuation_loop THEN 1e0 ELSE 0e0 END) AS lr FROM ({_ADV}) x WHERE variant_index >= 1 GROUP BY variant_index) y
 UNION ALL SELECT 0 AS step, NULL AS stop""")
def _(s, d):
    m = rewards.summary(_scored(s, d).withColumn("step", F.col("variant_index")), ("step",))
    return m.select("step", rewards.safety_reason(rewards.SafetyConfig(min_parse_rate=0.8, max_punctuation_loop_rate=0.02, start_step=1)).alias("stop"))


@_query("A15_preflight", "SELECT count(*) AS groups, array_to_string(list_sort(list(DISTINCT n)), ',') AS group_sizes, round(avg(outcome), 9) AS yes_rate FROM (SELECT id, count(*) AS n, min(outcome) AS outcome FROM {P} WHERE split = 'train' GROUP BY id HAVING count(*) >= 2) g")
def _(s, d):
    return _rounded(rewards.preflight(_predictions(s, d), "train").withColumn("group_sizes", F.array_join(F.col("group_sizes").cast("array<string>"), ",")))


@_query("C8_training_groups", "SELECT id, outcome, n, array_to_string(vs, ',') AS variants FROM (SELECT id, min(outcome) AS outcome, count(*) AS n, list_sort(list(variant_index)) AS vs FROM {P} WHERE split = 'train' GROUP BY id HAVING count(*) >= 2) g")
def _(s, d):
    rows = _predictions(s, d).withColumn("messages", F.lit(""))
    return rewards.training_groups(rows, "train").select("id", "outcome", "n", F.array_join(F.col("variants")["variant_index"].cast("array<string>"), ",").alias("variants"))


@_query("T6_select_batch", "SELECT id FROM (SELECT DISTINCT id FROM {P}) g ORDER BY md5('20::' || id), id LIMIT 8")
def _(s, d):
    return rewards.select_batch(_predictions(s, d).select("id").distinct(), 3, 17, 8)


@_query("X1_canonical_url", "SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '\\?.*$', ''), '/+$', ''), '^http://', 'https://'), '') AS canonical FROM pages")
def _(s, d):
    return _table(s, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical"))


_URL_ROWS = "SELECT 'a::' || cast(page_id AS string) AS id, 'forecastbench' AS source, url FROM pages UNION ALL SELECT 'b::' || cast(page_id AS string), 'polymarket', regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', '') || '?utm=x' FROM pages WHERE page_id % 3 = 0"


@_query("W9_url_dedupe", f"""WITH u AS (SELECT *, nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '\\?.*$', ''), '/+$', ''), '^http://', 'https://'), '') AS cu, CASE source WHEN 'polymarket' THEN 2 ELSE 4 END AS p FROM ({_URL_ROWS}) x),
 w AS (SELECT *, min(p) OVER (PARTITION BY cu) AS best FROM u) SELECT id, source FROM w WHERE cu IS NULL OR p = best""")
def _(s, d):
    pages = _table(s, d, "pages")
    a = pages.select(F.concat(F.lit("a::"), "page_id").alias("id"), F.lit("forecastbench").alias("source"), "url")
    stripped = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "[?].*$", "")
    b = pages.where("page_id % 3 = 0").select(F.concat(F.lit("b::"), "page_id").alias("id"), F.lit("polymarket").alias("source"), F.concat(stripped, F.lit("?utm=x")).alias("url"))
    return dedupe.url_arbitration(a.unionByName(b)).select("id", "source")


_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@_query("X2_normalize_text", f"SELECT item_id, {_NORM.format('text')} AS normalized, len(list_distinct(list_filter(string_split({_NORM.format('text')}, ' '), lambda t: length(t) >= 3))) AS n_tokens FROM benchmark")
def _(s, d):
    n = X.normalize_text(F.col("text"))
    return _table(s, d, "benchmark").select("item_id", n.alias("normalized"), F.size(X.token_set(n)).cast("long").alias("n_tokens"))


@_query("J6_fuzzy_pairs", f"""WITH t AS (SELECT doc_id, lang, source, list_distinct(list_filter(string_split({_NORM.format('text')}, ' '), lambda t: length(t) >= 3)) AS ts FROM documents),
 e AS (SELECT doc_id, lang, source, len(ts) AS n, unnest(ts) AS tok FROM t), c AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.tok = b.tok AND a.lang = b.lang AND a.source < b.source GROUP BY a.doc_id, b.doc_id)
 SELECT x AS a, y AS b, round(k / cast(na + nb - k AS double), 9) AS similarity FROM c WHERE k / cast(na + nb - k AS double) >= 7e-1""")
def _(s, d):
    rows = _table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.col("text").alias("question"))
    return _rounded(dedupe.similar_pairs(rows, 0.7, same=("lang",)))


@_query("X4_source_priority", "SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY url ORDER BY CASE source WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE 99 END, -length(background), -length(resolution_criteria), id) AS rn FROM {Q} WHERE url IS NOT NULL) x WHERE rn = 1")
def _(s, d):
    q = _questions(s, d).where("url is not null")
    return q.groupBy("url").agg(F.min_by(F.struct("source", "id"), dedupe.quality_order(RANKS)).alias("b")).select("b.source", "b.id")


_REASON = f"CASE WHEN outcome IS NULL THEN 'non_binary_outcome' WHEN resolved_at IS NULL THEN 'unparseable_dates' WHEN freeze_date > resolved_at THEN 'freeze_after_resolution' WHEN freeze_date <= DATE '{CUTOFF}' OR resolved_at <= DATE '{CUTOFF}' THEN 'pre_cutoff' ELSE 'ok' END"


def _reasoned(s: SparkSession, d: str) -> DataFrame:
    checks = [(F.col("outcome").isNull(), "non_binary_outcome"), *platforms._dates_checks(CUTOFF, False)]
    return _questions(s, d).withColumn("reason", platforms._reasons(*checks))


@_query("F16_post_cutoff", f"SELECT id, source, freeze_date, resolved_at FROM {{Q}} WHERE {_REASON} = 'ok' ORDER BY resolved_at, id")
def _(s, d):
    return _reasoned(s, d).where("reason = 'ok'").select("id", "source", "freeze_date", "resolved_at").orderBy("resolved_at", "id")


@_query("F15_validation", "SELECT coalesce(CASE WHEN outcome IS NULL THEN 'outcome' WHEN freeze_date IS NULL THEN 'freeze_date' WHEN resolved_at IS NULL THEN 'resolved_at' WHEN freeze_date > resolved_at THEN 'freeze_after_resolution' END, 'valid') AS reason, count(*) AS n FROM {Q} GROUP BY 1")
def _(s, d):
    return schema.reason_counts(_questions(s, d).withColumn("reason", F.coalesce(schema.reject_reason(), F.lit("valid"))))


@_query("C2_stratified_split", """WITH r AS (SELECT id, strftime(resolved_at, '%Y-%m') AS bucket FROM {Q} WHERE resolved_at IS NOT NULL), k AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5('17::' || bucket || '::' || id), id) AS rn, count(*) OVER (PARTITION BY bucket) AS n FROM r)
 SELECT id, CASE WHEN rn <= round_even(n * 8e-1, 0) THEN 'train' WHEN rn <= round_even(n * 8e-1, 0) + round_even(n * 1e-1, 0) THEN 'validation' ELSE 'test' END AS split FROM k""")
def _(s, d):
    return split.split_ids(_questions(s, d).where("resolved_at is not null"))


@_query("U2_split_overlap", "SELECT 'orders::' || cast(o_orderkey AS varchar) AS id, 2 AS n FROM orders WHERE o_orderkey % 7 = 0")
def _(s, d):
    """Every seventh order stands in a second split."""
    o = _table(s, d, "orders").select(F.concat(F.lit("orders::"), "o_orderkey").alias("id"), "o_orderkey")
    rows = o.select("id", F.lit("train").alias("split")).unionByName(o.where("o_orderkey % 7 = 0").select("id", F.lit("test").alias("split")))
    return split.overlap(rows.union(rows)).select("id", F.col("n").cast("int").alias("n"))


@_query("F7_leakage_filter", "SELECT o_orderkey, count(l_shipdate) FILTER (WHERE l_shipdate < o_orderdate) AS kept, count(l_shipdate) FILTER (WHERE NOT l_shipdate < o_orderdate) AS filtered FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(s, d):
    item = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_linenumber").cast("string").alias("headline"), F.lit("").alias("summary"))
    rows = _table(s, d, "orders").join(_table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.first(F.to_date("o_orderdate")).alias("day"), F.collect_list(item).alias("news"))
    done = rows.withColumn("l", assemble.leakage_filter(F.col("news"), F.col("day")))
    return done.select("o_orderkey", F.size("l.kept").cast("long").alias("kept"), F.col("l.filtered").cast("long").alias("filtered"))


_PAR_SQL = "SELECT o_orderkey, cast(l_linenumber AS int) AS v, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


_DAY = "strftime({}, '%Y-%m-%d')"


@_query("C3_assemble", f"""WITH q AS (SELECT * FROM {{Q}}), par AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
 r AS (SELECT q.*, i, CASE WHEN i = 0 THEN question ELSE question || ' v' || cast(i AS varchar) END AS text FROM q JOIN par ON id = 'orders::' || cast(k AS varchar) CROSS JOIN (SELECT unnest([0, 1, 2]) AS i) x WHERE n >= 3 AND outcome IS NOT NULL AND n % 4 <> 1)
 SELECT id, cast(i AS int) AS variant_index, i = 0 AS is_original, CASE WHEN resolved_at < DATE '1998-01-01' THEN 'train' ELSE 'test' END AS split, text AS question, outcome, freeze_date, resolved_at, source, 0.25e0 AS base_rate_value, 'last' AS explanation,
  CASE WHEN cast(substr(id, 9) AS bigint) % 2 = 0 THEN {_DAY.format("freeze_date - 1")} || '|head|' ELSE '' END AS news, source AS categories,
  'Forecast date: ' || {_DAY.format('freeze_date')} || chr(10) || 'Resolution date: ' || {_DAY.format('resolved_at')} || chr(10) || 'Source: ' || source || chr(10) || chr(10) || 'Question:' || chr(10) || text || chr(10) || chr(10) || 'Background:' || chr(10)
   || CASE WHEN background = '' THEN '(none provided)' ELSE background END || chr(10) || chr(10) || CASE WHEN resolution_criteria = '' THEN '' ELSE 'Resolution criteria:' || chr(10) || resolution_criteria || chr(10) || chr(10) END
   || 'Base-rate prior: 0.250 (reference class size: 4; window: 2 years)' || chr(10) || 'Base-rate reasoning: last' || chr(10) || chr(10)
   || CASE WHEN cast(substr(id, 9) AS bigint) % 2 = 0 THEN 'Relevant news (all dated before forecast date):' || chr(10) || '  [' || {_DAY.format("freeze_date - 1")} || '] head' || chr(10) || chr(10) ELSE '' END
   || 'Put your forecast on the first line exactly as:' || chr(10) || 'Probability: <number between 0 and 1>' || chr(10) || 'Then add a short rationale on the following lines.' AS prompt
 FROM r""")
def _(s, d):
    rows = assemble.assemble(*_assembly(s, d), 3)
    news = F.array_join(F.transform("news_snapshot", lambda n: F.concat_ws("|", n["date"], n["headline"], n["summary"])), ";")
    return rows.select(
        "id", "variant_index", "is_original", "split", "question", "outcome", "freeze_date", "resolved_at", "source", F.col("base_rate")["value"].alias("base_rate_value"), F.col("base_rate")["explanation"].alias("explanation"),
        news.alias("news"), F.array_join("categories", ",").alias("categories"), F.element_at("messages", 2)["content"].alias("prompt"),
    )


def _assembly(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as questions; as many paraphrases as lines; a context unless the lines are 1 mod 4."""
    q = _questions(s, d).where("outcome is not null")
    n = _table(s, d, "lineitem").groupBy(F.concat(F.lit("orders::"), "l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    both = q.select("id", "question").join(n, "id")
    made = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.cast("int").alias("variant_index"), F.when(i == 0, F.col("question")).otherwise(F.concat("question", F.lit(" v"), i)).alias("text"), (i == 0).alias("is_original")))
    par = both.select(F.col("id").alias("question_id"), F.shuffle(made, 7).alias("paraphrases"))
    base = F.struct(F.lit(0.25).alias("value"), F.lit(4).alias("n_reference_events"), F.lit(2).alias("reference_window_years"), F.col("e").alias("explanation"))
    none = F.array().cast("array<struct<date: string, headline: string, summary: string>>")
    item = F.array(F.struct(F.date_format(F.date_sub("freeze_date", 1), "yyyy-MM-dd").alias("date"), F.lit("head").alias("headline"), F.lit("").alias("summary")))
    news = F.when(F.substring("id", 9, 20).cast("long") % 2 == 0, item).otherwise(none)
    # Two lines a question, of which the later one counts.
    lines = q.select("id", "freeze_date").join(n.where("n % 4 <> 1"), "id").withColumn("e", F.explode(F.array(F.lit("first"), F.lit("last"))))
    ctx = lines.select(F.col("id").alias("question_id"), base.alias("base_rate"), news.alias("news_snapshot"), F.lit("contexts").alias("_file"), F.when(F.col("e") == "last", 7).otherwise(3).alias("_row"))
    splits = q.where("resolved_at < date '1998-01-01'").select("id", F.lit("train").alias("split"))
    return q, ctx, par, splits


@_query("F12_assembly_stats", """WITH q AS (SELECT * FROM {Q} WHERE outcome IS NOT NULL), par AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
 r AS (SELECT id, CASE WHEN n IS NULL OR n % 4 = 1 THEN 'missing_context' WHEN n < 3 THEN 'paraphrase_group_too_small' ELSE 'ok' END AS reason, CASE WHEN resolved_at < DATE '1998-01-01' THEN 'train' ELSE 'test' END AS split FROM q LEFT JOIN par ON id = 'orders::' || cast(k AS string))
 SELECT reason AS name, count(*) AS n FROM r WHERE reason <> 'ok' GROUP BY 1 UNION ALL SELECT 'groups_emitted', count(*) FROM r WHERE reason = 'ok' UNION ALL SELECT 'empty_news_snapshot', count(*) FROM r WHERE reason = 'ok' AND cast(substr(id, 9) AS bigint) % 2 = 1
 UNION ALL SELECT 'groups_emitted_' || split, count(*) FROM r WHERE reason = 'ok' GROUP BY split""")
def _(s, d):
    return assemble.assembly_stats(assemble.checked(*_assembly(s, d), 3))


@_query("P14_messages", """SELECT conv_id, count(*) FILTER (WHERE trim(role) IN ('system', 'user', 'assistant')) AS n_messages, string_agg(trim(role), ',' ORDER BY turn) FILTER (WHERE trim(role) IN ('system', 'user', 'assistant')) AS roles FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE trim(role) IN ('system', 'user', 'assistant')) > 0""")
def _(s, d):
    m = X.usable_messages(F.col("messages"))
    return _messages(s, d).withColumn("m", m).where("m is not null").select("conv_id", F.size("m").cast("long").alias("n_messages"), F.array_join("m.role", ",").alias("roles"))


def _messages(s: SparkSession, d: str) -> DataFrame:
    c = _table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    return c.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


@_query("P15_chat_render", "SELECT conv_id, md5(string_agg(upper(trim(role)) || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'ASSISTANT:' || chr(10)) AS prompt_md5 FROM conversations WHERE trim(role) IN ('system', 'user', 'assistant') AND text IS NOT NULL GROUP BY conv_id")
def _(s, d):
    m = X.usable_messages(F.filter("messages", lambda x: x["content"].isNotNull()))
    return _messages(s, d).withColumn("m", m).where("m is not null").select("conv_id", F.md5(X.render_chat_prompt(F.col("m"))).alias("prompt_md5"))


@_query("A11_audit_source", f"SELECT source, count(*) AS n, round(avg(outcome), 3) AS yes_rate FROM {{Q}} WHERE {_REASON} = 'ok' GROUP BY source")
def _(s, d):
    return audit.by_source(_reasoned(s, d).where("reason = 'ok'"))


@_query("A11_audit_month", f"SELECT strftime(resolved_at, '%Y-%m') AS month, count(*) AS n FROM {{Q}} WHERE {_REASON} = 'ok' GROUP BY 1")
def _(s, d):
    return audit.by_month(_reasoned(s, d).where("reason = 'ok'"))


@_query("T5_top_categories", "SELECT category, count(*) AS n FROM (SELECT source AS category FROM documents UNION ALL SELECT lang FROM documents) x WHERE category IS NOT NULL GROUP BY category ORDER BY n DESC, category LIMIT 20")
def _(s, d):
    return audit.top_categories(_table(s, d, "documents").select(F.array_compact(F.array("source", "lang")).alias("categories")))


@_query("J7_resume_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(s, d):
    from augur.sources.files import not_done

    return not_done(_table(s, d, "orders").select("o_orderkey"), _table(s, d, "labels"), "o_orderkey", "doc_id")


def _platform_rows(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = F.to_json(F.struct(F.col("o_orderkey").alias("metaculus_post_id"), F.col("o_custkey").alias("metaculus_question_id")))
    q = _table(s, d, "orders").select(F.concat(F.lit("metaculus::"), "o_orderkey").alias("id"), F.lit("metaculus").alias("source"), F.array().cast("array<string>").alias("categories"), raw.alias("raw"))
    wanted = _table(s, d, "labels").select((F.col("doc_id") * 3).cast("string").alias("id"))
    # Every fourth order is asked for under a number that none has.
    return q, wanted.union(_table(s, d, "orders").where("o_orderkey % 4 = 0").select((-F.col("o_orderkey") - 1).cast("string"))).distinct()


@_query("J4_drop_in_semi", "WITH w AS (SELECT DISTINCT doc_id * 3 AS k FROM labels) SELECT 'mantic_q2_aib::' || cast(o_orderkey AS string) AS id, 'mantic_q2_aib' AS source FROM orders WHERE o_orderkey IN (SELECT k FROM w) OR o_custkey IN (SELECT k FROM w)")
def _(s, d):
    return platforms.drop_in(*_platform_rows(s, d))[0].select("id", "source")


@_query("J5_drop_in_missing", "WITH w AS (SELECT DISTINCT doc_id * 3 AS k FROM labels UNION SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 4 = 0), h AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT k FROM w) OR o_custkey IN (SELECT k FROM w)) SELECT cast(k AS varchar) AS id FROM w WHERE k NOT IN (SELECT o_orderkey FROM h) AND k NOT IN (SELECT o_custkey FROM h)")
def _(s, d):
    return platforms.drop_in(*_platform_rows(s, d))[1]


@_query("W8_trailing_rate", "SELECT count(*) FILTER (WHERE ts >= m - INTERVAL 60 MINUTE) / 60e0 AS per_minute_60, count(*) FILTER (WHERE ts >= m - INTERVAL 1440 MINUTE) / 1440e0 AS per_minute_1440 FROM events, (SELECT max(ts) AS m FROM events) x")
def _(s, d):
    e = _table(s, d, "events")
    return audit.trailing_rates(e, e.agg(F.max("ts")).scalar(), (60, 1440))


@_query("A16_token_totals", """SELECT kind, count(*) AS calls, cast(sum(t) AS bigint) AS input_tokens, cast(sum(u) AS bigint) AS output_tokens FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'paraphrase' ELSE '?' END AS kind, event_id % 100 AS t, user_id AS u FROM events) x GROUP BY kind""")
def _(s, d):
    return audit.token_totals(_cache_rows(s, d))


def _cache_rows(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, '```json\n{"base_rate": 1}\n```').when(F.col("event_id") % 3 == 1, ' ["a", "b"]').otherwise("none")
    return _table(s, d, "events").select(F.struct(text.alias("text"), F.struct((F.col("event_id") % 100).alias("input_tokens"), F.col("user_id").alias("output_tokens")).alias("usage")).alias("response"))


@_query("A17_projection", """WITH t AS (SELECT CASE event_id % 3 WHEN 0 THEN 'context' ELSE 'paraphrase' END AS kind, count(*) AS calls, sum(event_id % 100) AS i, sum(user_id) AS o FROM events WHERE event_id % 3 < 2 GROUP BY 1)
 SELECT kind, cast(20000 AS bigint) AS target, calls, greatest(0, 20000 - calls) AS remaining, printf('$%.2f', i / 1e6 * 3 + o / 1e6 * 15) AS spent, printf('$%.2f', i / cast(calls AS double) * 20000 / 1e6 * 3 + o / cast(calls AS double) * 20000 / 1e6 * 15) AS projected,
  CASE WHEN greatest(0, 20000 - calls) / 12.5e0 < 60 THEN printf('%.1f min', greatest(0, 20000 - calls) / 12.5e0) ELSE printf('%.2f h (%.0f min)', greatest(0, 20000 - calls) / 12.5e0 / 60, greatest(0, 20000 - calls) / 12.5e0) END AS eta FROM t""")
def _(s, d):
    targets = s.createDataFrame([("context", 20000), ("paraphrase", 20000)], "kind string, target long")
    return audit.projection(audit.token_totals(_cache_rows(s, d)), targets, 12.5)


@_query("X5_parse_dates", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN cast(ts AS date) WHEN 1 THEN cast(ts AS date) WHEN 2 THEN NULL ELSE cast(make_timestamp(cast(event_id AS bigint) * 1000000000) AS date) END AS day FROM events""")
def _(s, d):
    shown = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 2, " N/a ").otherwise((F.col("event_id") * 1000).cast("string"))
    return _table(s, d, "events").select("event_id", dates.parse_any_date(shown).alias("day"))


@_query("F10_prediction_text", f"SELECT event_id, round(CASE WHEN event_type IN ('view', 'click') AND value / 400 <= 1 THEN {_CLIP.format('value / 400')} END, 9) AS posterior FROM events")
def _(s, d):
    e = _table(s, d, "events")
    marked = F.when(F.col("event_type") == "view", "True").when(F.col("event_type") == "click", "1").otherwise("False")
    return _rounded(e.select("event_id", scores.prediction_from_text((F.col("value") / 400).cast("string"), marked).alias("posterior")))


@_query("C1_deduplicate", f"""WITH q0 AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'polymarket' ELSE 'forecastbench' END AS source, text AS question, doc_id % 40 AS day FROM documents),
 t AS (SELECT *, list_distinct(list_filter(string_split({_NORM.format('question')}, ' '), lambda t: length(t) >= 3)) AS ts FROM q0), e AS (SELECT id, source, day, len(ts) AS n, unnest(ts) AS tok FROM t),
 c AS (SELECT a.id AS x, b.id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.tok = b.tok AND a.source < b.source AND abs(a.day - b.day) <= 14 GROUP BY a.id, b.id)
 SELECT cast(id AS string) AS id, source FROM q0 WHERE id NOT IN (SELECT x FROM c WHERE k / cast(na + nb - k AS double) >= 7e-1)""")
def _(s, d):
    return dedupe.deduplicate(_dedupe_rows(s, d)).select("id", "source")


def _dedupe_rows(s: SparkSession, d: str) -> DataFrame:
    day = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("doc_id") % 40).cast("int"))
    none = F.lit(None).cast("string")
    source = F.when(F.col("doc_id") % 2 == 0, "polymarket").otherwise("forecastbench")
    return _table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), source.alias("source"), F.col("text").alias("question"), none.alias("url"), none.alias("background"), none.alias("resolution_criteria"), F.array().cast("array<string>").alias("categories"), day.alias("resolved_at"))


@_query("A12_dedupe_stats", f"""SELECT (SELECT count(*) FROM documents) AS input, 0 AS url_duplicates_dropped, (SELECT count(*) FROM documents) - count(*) AS text_duplicates_dropped, count(*) AS kept FROM ({ORACLE_SQL['C1_deduplicate']}) k""")
def _(s, d):
    out = dedupe.dedupe_stats(_dedupe_rows(s, d))
    return out.withColumn("url_duplicates_dropped", F.col("url_duplicates_dropped").cast("int"))


def _said(s: SparkSession, d: str, *parts: Column) -> DataFrame:
    """Orders with a text made of parts."""
    return _table(s, d, "orders").select("o_orderkey", F.concat(*parts).alias("t"))


@_query("X14_extract_dates", """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%d') AS dd, '20' || strftime(o_orderdate, '%y') AS y FROM orders)
 SELECT o_orderkey, array_to_string(list_sort(list_distinct([y || '-' || m || '-' || dd, y || '/' || m || '/' || dd, 'March 7, ' || y, 'Sept 21', 'June ' || y, y])), '|') AS found FROM o""")
def _(s, d):
    y, m, day = F.concat(F.lit("20"), F.date_format("o_orderdate", "yy")), F.date_format("o_orderdate", "MM"), F.date_format("o_orderdate", "dd")
    t = _said(s, d, F.lit("due "), y, F.lit("-"), m, F.lit("-"), day, F.lit(" or "), y, F.lit("/"), m, F.lit("/"), day, F.lit(", (March 7, "), y, F.lit("), Sept 21; é"), y, F.lit("é, June "), y, F.lit("."))
    # "June 20" is also a month with a day, of which a year is no part
    return t.select("o_orderkey", F.array_join(F.array_sort(entities.extract_dates(F.col("t"))), "|").alias("found"))


@_query("X15_extract_numbers", """SELECT o_orderkey, array_to_string(list_sort(list_distinct([cast(o_orderkey AS varchar), '$' || cast(o_custkey AS varchar) || 'k', cast(o_orderkey % 90 + 7 AS varchar) || ',5 %', '٣٤'])), '|') AS numbers FROM orders""")
def _(s, d):
    t = _said(s, d, F.lit("Über "), "o_orderkey", F.lit(" Züge, $"), "o_custkey", F.lit("k und "), F.col("o_orderkey") % 90 + 7, F.lit(",5 % in ٣٤ Städten; é"), "o_orderkey", F.lit(", "), "o_orderkey", F.lit("ж zählen nicht"))
    return t.select("o_orderkey", F.array_join(F.array_sort(entities.extract_numbers(F.col("t"))), "|").alias("numbers"))


_CITY = "CASE o_orderkey % 3 WHEN 0 THEN 'São Paulo' WHEN 1 THEN 'Müller FC' ELSE 'Zürich' END"


@_query("X16_extract_proper_nouns", f"SELECT o_orderkey, array_to_string(list_sort(list_distinct([{_CITY}, 'Ab' || cast(o_orderkey AS varchar), 'Côte', 'Ivoire'])), '|') AS names FROM orders")
def _(s, d):
    city = F.when(F.col("o_orderkey") % 3 == 0, "São Paulo").when(F.col("o_orderkey") % 3 == 1, "Müller FC").otherwise("Zürich")
    t = _said(s, d, F.lit("Will "), city, F.lit(" beat Ab"), "o_orderkey", F.lit("? The éAx and X lose to Đoković in Côte d'Ivoire."))
    return t.select("o_orderkey", F.array_join(F.array_sort(entities.extract_proper_nouns(F.col("t"))), "|").alias("names"))


@_query("X17_validate_paraphrase", """SELECT o_orderkey, o_orderkey % 6 = 5 AS ok, CASE o_orderkey % 6 WHEN 0 THEN 'missing date(s): [''2031-05-06'']' WHEN 1 THEN 'missing number(s): [''' || cast(o_orderkey + 100000 AS varchar) || ''', ''٣٤'']' WHEN 2 THEN 'missing proper noun(s): [''São Paulo'']'
  WHEN 3 THEN 'missing date(s): [''2031'', ''2031-05-06'']' WHEN 4 THEN 'identical to original' ELSE '' END AS reason FROM orders""")
def _(s, d):
    k = F.col("o_orderkey")
    n = (k + 100000).cast("string")
    was = F.concat(F.lit("Will São Paulo sell "), n, F.lit(" or ٣٤ by 2031-05-06?"))
    now = (
        F.when(k % 6 == 0, F.concat(F.lit("In 2031, does São Paulo sell "), n, F.lit(" or ٣٤?"))).when(k % 6 == 1, F.lit("By 2031-05-06, does São Paulo sell any?"))
        .when(k % 6 == 2, F.concat(F.lit("By 2031-05-06, does it sell "), n, F.lit(" or ٣٤?"))).when(k % 6 == 3, F.lit("")).when(k % 6 == 4, F.concat(was, F.lit("  "))).otherwise(F.concat(F.lit("By 2031-05-06, does SÃO PAULO sell ٣٤ or "), n, F.lit("?")))
    )
    return _table(s, d, "orders").select("o_orderkey", entities.validate_paraphrase(was, now).alias("v")).select("o_orderkey", "v.ok", "v.reason")


@_query("P8_flatten_richtext", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN text || ' end' WHEN 1 THEN 'a ' || text || ' b c d' ELSE text END AS flat FROM benchmark")
def _(s, d):
    leaf = lambda t: F.concat(F.lit('{"type": "p", "text": '), t, F.lit("}"))
    quoted = F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")
    two = F.concat(F.lit('{"type": "doc", "content": ['), leaf(quoted), F.lit(', {"x": 1}, {"text": ""}, '), leaf(F.lit('"end"')), F.lit("]}"))
    deep = F.concat(F.lit('{"text": "a", "content": [{"children": [{"content": ['), leaf(quoted), F.lit(', "b"]}, {"children": [{"text": "c"}]}]}], "children": [{"text": "d"}]}'))
    tree = F.when(F.col("item_id") % 3 == 0, two).when(F.col("item_id") % 3 == 1, deep).otherwise(F.concat(F.lit("["), leaf(quoted), F.lit("]")))
    return _table(s, d, "benchmark").select("item_id", X.flatten_richtext(tree).alias("flat"))


@_query("P5_normalize_outcome", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS outcome FROM orders")
def _(s, d):
    raw: Column = F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "0.0").otherwise("MKT")
    return _table(s, d, "orders").select("o_orderkey", platforms.normalize_outcome(raw).alias("outcome"))


@_query("P2_polymarket", f"""SELECT 'polymarket::c' || cast(o_orderkey AS string) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS outcome, least(f, r) AS freeze_date, r AS resolved_at FROM (SELECT o_orderkey, o_totalprice, o_orderstatus, cast(o_orderdate AS date) AS f, cast(o_orderdate AS date) + cast(o_custkey % 9 - 2 AS int) AS r FROM orders) x
 WHERE o_orderstatus <> 'P' AND o_totalprice >= 1000 AND least(f, r) > DATE '{CUTOFF}'""")
def _(s, d):
    o = _table(s, d, "orders")
    yes = F.col("o_orderkey") % 2 == 0
    flipped = F.col("o_orderkey") % 3 == 0
    names = F.when(flipped, '["No", "Yes"]').otherwise('["Yes", "No"]')
    prices = F.when(F.col("o_orderstatus") == "P", '["0.5", "0.5"]').when(yes != flipped, '["1", "0"]').otherwise('["0", "1"]')
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    m = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("c"), "o_orderkey").alias("conditionId"), F.lit("s").alias("slug"), F.lit("Will it?").alias("question"), F.lit(None).cast("string").alias("title"), F.lit("d").alias("description"),
        names.alias("outcomes"), prices.alias("outcomePrices"), F.lit(True).alias("closed"), F.lit(False).alias("active"), F.col("o_totalprice").cast("string").alias("volumeNum"), F.lit(None).cast("string").alias("volume"),
        day("o_orderdate").alias("endDate"), F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 9 - 2).cast("int")), "yyyy-MM-dd").alias("umaEndDate"), F.array(F.lit('{"label": "x"}')).alias("tags"),
    )
    return platforms.accepted(platforms.polymarket(m, CUTOFF)).select("id", "outcome", "freeze_date", "resolved_at")


from augur.plans import catalog_flows, catalog_more  # noqa: E402, F401  (add to QUERIES and ORACLE_SQL)
