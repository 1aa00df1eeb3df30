"""Queries of whole flows: duplicates in order of visits, links of similar texts, cuts of one
stratum, paged sources, a broken training run, and runs from files to files."""

from __future__ import annotations

import json
import urllib.parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.operators import dedupe, rewards, split, visits
from augur import flows
from augur.functions.text import has_punctuation_loop
from augur.plans import views as V
from augur.plans.catalog import _ADV, _NORM, _query, _questions, _rounded, _table
from augur.sources import files, paged
from augur.sources.shared import new_path

_TOKENS = f"list_distinct(list_filter(string_split({_NORM.format('text')}, ' '), lambda t: length(t) >= 3))"

# Duplicates in order of visits: seven sources, of which two have no rank, months, urls in groups.

_IN_ORDER = f"""WITH RECURSIVE q0 AS (SELECT doc_id, cast(doc_id AS varchar) AS id, ['metaculus', 'polymarket', 'manifold', 'forecastbench', 'x', 'y', 'mantic_q2_aib'][cast(doc_id % 7 + 1 AS int)] AS source,
   CASE WHEN doc_id % 11 < 3 THEN 'u' || cast(doc_id // 22 AS varchar) END AS url, DATE '2025-01-01' + cast(doc_id * 37 % 75 AS int) AS day, cast(doc_id * 5 % 3 AS int) AS bg, {_TOKENS} AS ts FROM documents),
 q1 AS (SELECT *, CASE source WHEN 'mantic_q2_aib' THEN 0 WHEN 'metaculus' THEN 1 WHEN 'polymarket' THEN 2 WHEN 'manifold' THEN 3 WHEN 'forecastbench' THEN 4 ELSE 99 END AS rank FROM q0),
 kept AS (SELECT *, min(doc_id) OVER (PARTITION BY url) AS head FROM (SELECT *, min((rank, source)) OVER (PARTITION BY url) AS best FROM q1) b WHERE url IS NULL OR best = (rank, source)),
 placed AS (SELECT *, dense_rank() OVER (ORDER BY strftime(day, '%Y-%m')) AS m, row_number() OVER (ORDER BY strftime(day, '%Y-%m'), head, doc_id) AS o FROM kept),
 e AS (SELECT id, source, day, o, m, rank, bg, len(ts) AS n, unnest(ts) AS tok FROM placed),
 c AS (SELECT a.id AS a, b.id AS b, any_value(a.o) AS ao, any_value(b.o) AS bo, greatest(CASE WHEN any_value(a.m) = any_value(b.m) THEN any_value(a.m) - 1 ELSE any_value(a.m) END, 1) AS cohort,
   any_value((a.rank, -a.bg) <= (b.rank, -b.bg)) AS first_wins, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
   FROM e a JOIN e b ON a.tok = b.tok AND a.o < b.o AND a.source <> b.source AND abs(a.day - b.day) <= 14 GROUP BY a.id, b.id),
 ev AS (SELECT *, row_number() OVER (ORDER BY cohort, ao, bo) AS i FROM c WHERE k / cast(na + nb - k AS double) >= 7e-1),
 run(i, gone, piv, there) AS (SELECT cast(0 AS bigint), CAST([] AS varchar[]), '', false UNION ALL
   SELECT ev.i, CASE WHEN (CASE WHEN run.piv = ev.cohort || '-' || ev.a THEN run.there ELSE NOT list_contains(run.gone, ev.a) END) AND NOT list_contains(run.gone, ev.b) THEN list_append(run.gone, CASE WHEN first_wins THEN ev.b ELSE ev.a END) ELSE run.gone END,
     ev.cohort || '-' || ev.a, CASE WHEN run.piv = ev.cohort || '-' || ev.a THEN run.there ELSE NOT list_contains(run.gone, ev.a) END FROM run JOIN ev ON ev.i = run.i + 1)
 SELECT id, source FROM placed WHERE NOT list_contains((SELECT gone FROM run ORDER BY i DESC LIMIT 1), id)"""


def _in_order(s: SparkSession, d: str) -> DataFrame:
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    names = F.array(*map(F.lit, ("metaculus", "polymarket", "manifold", "forecastbench", "x", "y", "mantic_q2_aib")))
    url = F.when(i % 11 < 3, F.concat(F.lit("u"), F.floor(i / 22).cast("string")))
    day = F.date_add(F.lit("2025-01-01").cast("date"), (i * 37 % 75).cast("int"))
    background = F.repeat(F.lit("b"), (i * 5 % 3).cast("int"))
    return _table(s, d, "documents").select(
        i, i.cast("string").alias("id"), F.element_at(names, (i % 7 + 1).cast("int")).alias("source"), F.col("text").alias("question"), url.alias("url"),
        background.alias("background"), none.alias("resolution_criteria"), F.array().cast("array<string>").alias("categories"), day.alias("resolved_at"),
    )


@_query("C1_deduplicate_in_order", _IN_ORDER)
def _(s, d):
    return visits.deduplicate_in_order(_in_order(s, d), ["doc_id"]).select("id", "source")


_STATS = f"""{_IN_ORDER[:_IN_ORDER.index(" placed AS")].replace("WITH RECURSIVE", "WITH").rstrip().rstrip(",")},
 e AS (SELECT id, source, day, rank, bg, len(ts) AS n, unnest(ts) AS tok FROM kept),
 c AS (SELECT a.id AS x, any_value((b.rank, -b.bg, b.id) < (a.rank, -a.bg, a.id)) AS better, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.tok = b.tok AND a.source <> b.source AND abs(a.day - b.day) <= 14 GROUP BY a.id, b.id),
 lost AS (SELECT DISTINCT x FROM c WHERE better AND k / cast(na + nb - k AS double) >= 7e-1)
 SELECT (SELECT count(*) FROM q0) AS input, (SELECT count(*) FROM q0) - (SELECT count(*) FROM kept) AS url_duplicates_dropped, (SELECT count(*) FROM lost) AS text_duplicates_dropped, (SELECT count(*) FROM kept) - (SELECT count(*) FROM lost) AS kept"""


@_query("A12_dedupe_stats_with_urls", _STATS)
def _(s, d):
    return dedupe.dedupe_stats(_in_order(s, d))


@_query("X21_punctuation_loops", "SELECT event_id, event_id % 2 = 1 AS looping FROM events")
def _(s, d):
    """Each of the eleven signs, fifteen times and sixteen times in a row."""
    sign = F.substring(F.lit("!?.;,:-_=*#"), (F.col("event_id") % 11 + 1).cast("int"), F.lit(1))
    said = F.concat(F.lit("so "), F.repeat(sign, (15 + F.col("event_id") % 2).cast("int")), F.lit(" it ends"))
    return _table(s, d, "events").select("event_id", has_punctuation_loop(said).alias("looping"))


@_query("J6_fuzzy_links", f"""WITH t AS (SELECT doc_id, lang, source, list_sort({_TOKENS}) AS ts FROM documents), k AS (SELECT *, CASE WHEN len(ts) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY ts) END AS class_id FROM t),
 e AS (SELECT doc_id, lang, source, len(ts) AS n, unnest(ts) AS tok FROM t), c AS (SELECT a.doc_id AS x, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.tok = b.tok AND a.lang = b.lang AND a.source <> b.source GROUP BY a.doc_id, b.doc_id)
 SELECT doc_id AS id, class_id, count(x) AS n_links FROM k LEFT JOIN (SELECT x FROM c WHERE k / cast(na + nb - k AS double) >= 7e-1) l ON x = doc_id GROUP BY doc_id, class_id""")
def _(s, d):
    rows = _table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.col("text").alias("question"))
    return dedupe.similar_links(rows, 0.7, same=("lang",))


@_query("C2_split_of_one_stratum", """SELECT id, CASE WHEN rank <= round_even(n * 8e-1, 0) THEN 'train' WHEN rank <= round_even(n * 8e-1, 0) + round_even(n * 1e-1, 0) THEN 'validation' ELSE 'test' END AS split
 FROM (SELECT id, row_number() OVER (ORDER BY md5('17::all::' || id), id) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM {Q}) i) r""")
def _(s, d):
    return split.split_ids(_questions(s, d), split.SplitConfig(stratify_by="none"))


# Paged sources, read from pages that stand in the cache as the servers would have given them.

_SITE = "https://pages.invalid/x"


def _paged(s: SparkSession, d: str, preset: str, size: int, wrap: str, next_field: bool = False, keyset: bool = False, partitions: int = 1, stream: bool = False) -> DataFrame:
    """Orders through pages of a preset and back. Order keys run from 0 without gaps."""
    o = _table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    n = F.lit(o.count())
    page = F.floor((n - 1 - F.col("id") if keyset else F.col("id")) / size)
    item = F.struct(F.when(F.lit(keyset), -F.col("id")).otherwise(F.col("id")).alias("place"), F.struct("id", "status").alias("item"))
    rows = o.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(item))["item"].alias("items"))
    # Behind the last page there is an empty one, which scans in parts and full last pages come to.
    ends = s.range(1).select(F.explode(F.sequence(F.ceil(n / size), F.ceil(n / size) + partitions)).alias("page"), F.array().cast(rows.schema["items"].dataType).alias("items"))
    rows = rows.unionByName(ends)
    more = {"next": F.when((F.col("page") + 1) * size < n, "more")} if next_field else {}
    body = F.to_json(F.struct(F.col("items").alias(wrap), *(v.alias(k) for k, v in more.items()))) if wrap else F.to_json("items")
    o_ = {**paged.PRESETS[preset], "url": _SITE, "page_size": str(size), "throttle": "0"}
    fixed = urllib.parse.urlencode({**json.loads(o_.get("params", "{}")), "limit": size})
    if keyset:
        at = F.when(F.col("page") == 0, "").otherwise(F.concat(F.lit("&before="), F.greatest(n - F.col("page") * size, F.lit(0)).cast("string")))
    else:
        at = F.concat(F.lit("&offset="), (F.col("page") * size).cast("string"))
    folder = new_path(s, "pages")
    paged.store_pages(rows.select(F.concat(F.lit(f"{_SITE}?{fixed}"), at).alias("url"), body.alias("body")), folder)
    if stream:
        out, mark = new_path(s, "items"), new_path(s, "offsets")
        paged.scan_into(s, out, mark, cache=folder, batch_pages=7, **o_)
        got = s.read.text(out)
    else:
        got = paged.scan(s, cache=folder, partitions=partitions, **o_)
    return got.select(F.from_json("value", "id long, status string").alias("v")).select("v.id", "v.status")


_ORDERS = "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders"


@_query("S5_offset_pages", _ORDERS)
def _(s, d):
    return _paged(s, d, "metaculus", 100, "results", next_field=True, partitions=8)


@_query("S6_short_page_ends", _ORDERS)
def _(s, d):
    return _paged(s, d, "polymarket", 500, "markets", partitions=3)


@_query("S7_keyset_pages", _ORDERS)
def _(s, d):
    return _paged(s, d, "manifold", 1000, "", keyset=True)


@_query("S7_resumable_stream", _ORDERS)
def _(s, d):
    return _paged(s, d, "manifold", 1000, "", keyset=True, stream=True)


# A training run that was cut in two.

_PICKED = f"""WITH g AS (SELECT id FROM {{C}} WHERE split = 'train' GROUP BY id HAVING count(*) >= 2),
 picked AS (SELECT step, id FROM (SELECT step, id, row_number() OVER (PARTITION BY step ORDER BY md5(cast(17 + step AS varchar) || '::' || id), id) AS rn FROM g, (SELECT unnest([1, 2, 3]) AS step) s) r WHERE rn <= 60),
 scored AS (SELECT a.*, step FROM ({_ADV}) a JOIN picked USING (id) WHERE split = 'train')"""


def _broken_run(s: SparkSession, d: str) -> str:
    """Folder of a run of three steps whose trainer was lost in the second one, and which went on."""
    rows, folder = V.view(s, d, V.COMPLETIONS).withColumnRenamed("completion", "said"), new_path(s, "run")

    def learn(lost: bool):
        def run(scored: DataFrame | None) -> dict:
            if lost and scored.first()["step"] == 2:
                raise ConnectionError("the trainer is gone")
            return {"ppo_kl": 0.01}

        return run

    sample = lambda b: b.withColumn("completion", F.col("said")).withColumn("stop_reason", F.lit("stop"))
    for lost in (True, False):
        try:
            rewards.train(rows, "train", 3, 60, 17, sample, learn(lost), folder, rewards.RewardConfig(lambda_invariance=0.5), rewards.SafetyConfig(max_ppo_kl=0.5))
        except ConnectionError:
            pass
    return folder


@_query("C13_K7_metrics_of_a_broken_run", f"""{_PICKED} SELECT cast(r.step AS int) AS step, round(avg(reward), 9) AS reward_mean, round(count(*) FILTER (parseable) / cast(count(*) AS double), 9) AS reward_parse_rate, round(any_value(z.z), 9) AS frac_reward_zero_std, 1e-2 AS ppo_kl, NULL AS stop
 FROM scored r JOIN (SELECT step, avg(m) AS z FROM (SELECT step, id, max(cast(zero_std AS int)) AS m FROM scored GROUP BY step, id) y GROUP BY step) z ON r.step = z.step GROUP BY r.step""")
def _(s, d):
    rows = s.read.schema("reward_mean double, reward_parse_rate double, frac_reward_zero_std double, ppo_kl string, stop string, step int").json(f"{_broken_run(s, d)}/metrics")
    return _rounded(rows.withColumn("ppo_kl", rewards.metric("ppo_kl"))).select("step", "reward_mean", "reward_parse_rate", "frac_reward_zero_std", "ppo_kl", F.col("stop").cast("int").alias("stop"))


@_query("K6_P17_rollouts_csv", f"{_PICKED} SELECT cast(step AS int) AS step, id, variant_index, outcome, round(prediction, 9) AS prediction, parseable, round(reward, 9) AS reward, round(advantage, 9) AS advantage, 'stop' AS stop_reason, completion, count(*) AS n FROM scored GROUP BY ALL")
def _(s, d):
    path = new_path(s, "csv")
    rewards.export_rollouts(_broken_run(s, d), s, path)
    rows = s.read.schema("step int, id string, variant_index int, outcome int, prediction double, parseable boolean, reward double, advantage double, stop_reason string, completion string").csv(path, header=True, escape='"', quote='"')
    return _rounded(rows).groupBy("step", *rewards.ROLLOUT).agg(F.count("*").alias("n"))


@_query("X26_metric", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 25e-1 END AS m FROM events")
def _(s, d):
    e = _table(s, d, "events")
    said = F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).when(F.col("event_id") % 4 == 1, "2.5").when(F.col("event_id") % 4 == 2, "NaN").otherwise("much")
    return e.select("event_id", rewards.metric(said).alias("m"))


# From files to files.

@_query("flow_unify", "SELECT source, count(*) AS n, cast(sum(outcome) AS bigint) AS yes FROM {Q} WHERE outcome IS NOT NULL AND resolved_at IS NOT NULL AND freeze_date <= resolved_at GROUP BY source")
def _(s, d):
    """Two files of questions and one that is missing, to one pool: the texts differ in a number that
    counts as a token, and urls are of one source each, so all valid questions stay."""
    q = _questions(s, d).withColumns({"raw": F.lit(None).cast("string"), "url": F.concat("url", F.lit("&s="), "source"), "question": F.concat(F.lit("Order number"), F.regexp_extract("id", "[0-9]+", 0))})
    q = q.withColumn("url", F.concat(F.lit("http://host/"), F.md5(F.concat_ws("|", "url", "source"))))
    paths = [new_path(s, "lines") for _ in range(2)]
    for i, p in enumerate(paths):
        files.write_jsonl(q.where(F.pmod(F.xxhash64("id"), F.lit(2)) == i), p)
    out = new_path(s, "pool")
    flows.unify(s, [*paths, paths[0] + "-none"], out, new_path(s, "report"))
    return files.read_questions(s, out)[0].groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("outcome").cast("long")).alias("yes"))


@_query("C10_modes", """WITH r AS (SELECT id, variant_index, outcome, CASE WHEN base_rate BETWEEN 0 AND 1 THEN base_rate END AS b, (SELECT avg(outcome) FROM (SELECT id, max_by(outcome, variant_index) AS outcome FROM {P} WHERE split = 'train' GROUP BY id) g) AS t FROM {P} WHERE split = 'test'),
 m AS (SELECT 'constant' AS mode, id, outcome, 25e-2 AS p FROM r UNION ALL SELECT 'context-base-rate', id, outcome, b FROM r UNION ALL SELECT 'train-base-rate', id, outcome, t FROM r)
 SELECT mode, id, count(*) AS n_variants, count(p) AS n_parseable, round(avg((p - outcome) * (p - outcome)), 6) AS mean_brier FROM m GROUP BY mode, id""")
def _(s, d):
    """Training rows as a file, evaluated in every mode that needs no model; group metrics read back."""
    path, out = new_path(s, "lines"), None
    none = F.lit(None).cast
    rows = V.view(s, d, V.PREDICTIONS).select("id", "variant_index", "split", F.lit("q").alias("question"), "outcome", F.struct(F.col("base_rate").alias("value"), none("int").alias("n_reference_events")).alias("base_rate"))
    files.write_jsonl(rows, path)
    for mode in ("constant", "context-base-rate", "train-base-rate"):
        folder = new_path(s, "evaluation")
        flows.evaluate(s, path, folder, "test", mode, constant=0.25)
        back = s.read.csv(f"{folder}/group_metrics", header=True)
        got = back.select(F.lit(mode).alias("mode"), "id", F.col("n_variants").cast("long").alias("n_variants"), F.col("n_parseable").cast("long").alias("n_parseable"), F.round(F.col("mean_brier").cast("double"), 6).alias("mean_brier"))
        out = got if out is None else out.unionByName(got)
    return out
