"""Queries of sources, sinks, platform mappings and model calls. What is read is first written
to the shared folder in the form that the source has."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.functions import text as X
from augur.functions.dates import is_iso_date
from augur.operators import assemble, generate, split

from augur.plans.catalog import CUTOFF, _messages, _predictions, _query, _questions, _table
from augur.sources import files, platforms, schema
from augur.sources.shared import new_path


def _set_of_order() -> Column:
    """Orders lie in sets of their priority and of a range of keys, so that a set is of bounded size."""
    return F.floor(F.col("o_orderkey") / 4000)


def _iso(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# Scans and sinks


def _question_lines(s: SparkSession, d: str) -> str:
    """Questions, and for every tenth a line that is no JSON or has an unknown field."""
    path = new_path(s, "lines")
    q = _questions(s, d).withColumns({"raw": F.lit(None).cast("string"), "question": F.concat("question", F.lit(' "ß"\n'))})
    files.write_jsonl(q, path)
    odd = q.where("outcome is not null").select(F.substring("id", 9, 20).cast("long").alias("k"), F.to_json(F.struct("id", F.lit(1).alias("extra"))).alias("value"))
    odd.where("k % 10 = 3").select(F.when(F.col("k") % 20 == 3, F.lit("{broken")).otherwise(F.col("value"))).write.mode("append").text(path)
    return path


_VALID = "outcome IS NOT NULL AND resolved_at IS NOT NULL AND freeze_date <= resolved_at"


@_query("S1_read_questions", f"SELECT id, question || ' \"ß\"' || chr(10) AS question, outcome, freeze_date, resolved_at, source, url, background, source AS categories FROM {{Q}} WHERE {_VALID}")
def _(s, d):
    good, _ = files.read_questions(s, _question_lines(s, d))
    return good.select("id", "question", "outcome", "freeze_date", "resolved_at", "source", "url", "background", F.array_join("categories", ",").alias("categories"))


@_query("S1_rejected_lines", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN outcome IS NULL THEN 'outcome' WHEN resolved_at IS NULL THEN 'resolved_at' WHEN freeze_date > resolved_at THEN 'freeze_after_resolution' END AS reason FROM {Q}
 UNION ALL SELECT CASE WHEN k % 20 = 3 THEN 'json' ELSE 'unknown_column' END FROM (SELECT cast(substr(id, 9) AS bigint) AS k FROM {Q} WHERE outcome IS NOT NULL) x WHERE k % 10 = 3) y WHERE reason IS NOT NULL GROUP BY reason""")
def _(s, d):
    _, bad = files.read_questions(s, _question_lines(s, d))
    return bad.groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))


@_query("S2_last_line_wins", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(s, d):
    path = new_path(s, "lines")
    files.write_jsonl(_table(s, d, "events").select("user_id", "event_id").repartition("user_id").sortWithinPartitions("event_id"), path)
    return assemble.last_row(files.read_rows(s, path, "user_id long, event_id long, missing string", ordered=True), "user_id").select("user_id", "event_id")


@_query("S3_question_set", "SELECT 'q' || cast(o_orderkey AS varchar) AS id, max(CASE WHEN copy = 1 THEN 'second' ELSE 'only' END) AS question, any_value(o_orderpriority) AS source FROM (SELECT *, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM orders) x WHERE o_orderkey % 5 > 0 GROUP BY o_orderkey")
def _(s, d):
    path = new_path(s, "set")
    o = _table(s, d, "orders").withColumn("copy", F.explode(F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    q = F.struct(F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("q"), "o_orderkey")).alias("id"), F.when(F.col("copy") == 1, "second").otherwise("only").alias("question"), F.col("o_orderpriority").alias("source"))
    listed = o.groupBy("o_orderpriority", _set_of_order()).agg(F.array_sort(F.collect_list(F.struct("copy", "o_orderkey", q.alias("q"))))["q"].alias("questions"))
    listed.select(F.to_json(F.struct("questions"))).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_question_sets(s, path).select("id", "question", "source")


@_query("S4_resolution_set", """SELECT 'set' || o_orderpriority AS set_name, CASE WHEN o_orderkey % 4 = 0 THEN '["a","b"]' ELSE 'q' || cast(o_orderkey AS varchar) END AS id, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN 'no' ELSE 'true' END AS resolved_to, count(*) AS n FROM orders GROUP BY ALL""")
def _(s, d):
    path = new_path(s, "set")
    plain = F.to_json(F.struct(F.concat(F.lit("q"), "o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "no").alias("resolved_to")))
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('{"id": ["a", "b"], "resolved_to": '), F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", '"no"').otherwise("true"), F.lit("}")))
    raw = F.coalesce(raw, F.when(F.col("o_orderstatus") == "O", plain), F.concat(F.lit('{"id": "q'), "o_orderkey", F.lit('", "resolved_to": '), F.when(F.col("o_orderstatus") == "F", "1").otherwise("true"), F.lit("}")))
    doc = F.concat(F.lit('{"question_set": "set'), "o_orderpriority", F.lit('", "resolutions": ['), F.array_join(F.collect_list(raw), ","), F.lit("]}"))
    _table(s, d, "orders").groupBy("o_orderpriority", _set_of_order()).agg(doc.alias("v")).select("v").write.option("maxRecordsPerFile", 1).text(path)
    rows = files.read_resolution_sets(s, path)
    return rows.groupBy("set_name", "id", "resolved_to").agg(F.count("*").alias("n"))


@_query("S9_drop_in_ids", "SELECT kind, count(*) AS n, cast(sum(doc_id) AS bigint) AS total FROM labels CROSS JOIN (SELECT unnest(['csv', 'json', 'jsonl', 'txt']) AS kind) k GROUP BY kind")
def _(s, d):
    ids = _table(s, d, "labels").select(F.col("doc_id").cast("string").alias("id"))
    found = None
    for kind in ("csv", "json", "jsonl", "txt"):
        path = f"{new_path(s, 'ids')}.{kind}"
        if kind == "csv":
            ids.select(F.lit("").alias("id"), F.col("id").alias("question_id")).write.csv(path, header=True)
        elif kind == "json":
            both = F.array_agg(F.struct(F.when(F.col("id").cast("long") % 2 == 0, F.col("id")).alias("id"), F.col("id").alias("post_id")))
            ids.groupBy(F.floor(F.col("id").cast("long") / 4000)).agg(F.to_json(F.struct(both.alias("questions"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
        elif kind == "jsonl":
            ids.select(F.to_json(F.struct(F.lit("").alias("id"), F.col("id").alias("post_id")))).write.text(path)
        else:
            ids.union(ids).select(F.concat(F.lit("  "), "id", F.lit("\t"))).write.text(path)
        got = files.read_drop_in_ids(s, path).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("total"))
        found = got if found is None else found.unionByName(got)
    return found


@_query("S10_predictions_csv", "SELECT id, cast(variant_index AS varchar) AS variant_index, 'said \"yes\",' || chr(10) || 'then ' || event_type AS completion, count(*) AS n FROM {P} GROUP BY ALL")
def _(s, d):
    path = new_path(s, "csv")
    said = F.concat(F.lit('said "yes",\nthen '), "event_type")
    rows = _predictions(s, d).select("id", "variant_index", "split", "outcome", "prediction", "parseable", F.lit("m").alias("mode"), F.lit(None).cast("string").alias("model"), F.lit("q").alias("question"), said.alias("completion"), "event_id")
    files.write_csv(rows, path, [c.split()[0] for c in schema.PREDICTION_CSV.split(", ")])
    return files.read_predictions_csv(s, path).groupBy("id", "variant_index", "completion").agg(F.count("*").alias("n"))


@_query("S11_training_index", "SELECT id, variant_index, max_by(cast(event_id AS varchar), event_id) AS question FROM {P} GROUP BY id, variant_index")
def _(s, d):
    path = new_path(s, "lines")
    rows = _predictions(s, d).repartition("id").sortWithinPartitions("event_id")
    files.write_jsonl(rows.select("id", F.when(F.col("variant_index") > 0, F.col("variant_index")).alias("variant_index"), F.col("event_id").cast("string").alias("question")), path)
    return files.read_training_index(s, path).select("id", "variant_index", "question")


@_query("S12_read_cache", "SELECT s_name AS text, s_nationkey AS input_tokens, count(*) AS n FROM supplier WHERE s_suppkey % 5 > 0 GROUP BY ALL")
def _(s, d):
    path = new_path(s, "cache")
    usage = F.struct(F.col("s_nationkey").alias("input_tokens"), F.lit(1).alias("output_tokens"))
    body = F.to_json(F.struct(F.col("s_name").alias("text"), usage.alias("usage"), F.lit("end").alias("stop_reason")))
    rows = _table(s, d, "supplier").select(F.concat(F.lit("key-"), "s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 5 > 0, body).otherwise("{broken").alias("body"))
    files.store_cache(rows, path)
    kept = files.read_cache(s, path).where("key like 'key-%' and modified is not null")
    return kept.groupBy("response.text", F.col("response.usage.input_tokens").cast("int").alias("input_tokens")).agg(F.count("*").alias("n"))


@_query("S13_count_lines", "SELECT count(*) AS n, 0 AS missing FROM orders")
def _(s, d):
    path = new_path(s, "lines")
    _table(s, d, "orders").select(F.explode(F.array(F.lit(" \t"), F.col("o_orderkey").cast("string")))).write.text(path)
    there = F.col("path") == path
    return files.line_counts(s, [path, path + "-none"]).agg(F.sum(F.when(there, F.col("n"))).alias("n"), F.sum(F.when(~there, F.col("n"))).cast("int").alias("missing"))


@_query("K3_append_new", "SELECT 'added' AS what, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT 'all', count(*) FROM orders")
def _(s, d):
    path, fields = new_path(s, "lines"), "o_orderkey long, o_orderstatus string"
    o = _table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    files.append_new(o.where("o_orderkey % 3 = 0"), path, "o_orderkey", fields)
    added = files.append_new(o, path, "o_orderkey", fields)
    n = F.count("*").alias("n")
    return added.agg(F.lit("added").alias("what"), n).unionByName(s.read.schema(fields).json(path).agg(F.lit("all").alias("what"), n))


@_query("K8_report_json", """SELECT '{' || chr(10) || '  "a" : null,' || chr(10) || '  "n" : ' || count(*) || chr(10) || '}' AS value FROM orders""")
def _(s, d):
    return files.report_json(_table(s, d, "orders").agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("a")))


@_query("K10_drop_templated", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS dropped FROM orders")
def _(s, d):
    path, k = new_path(s, "lines"), F.col("o_orderkey")
    value = F.when(k % 4 == 0, F.lit('{"{resolution_date}": 1, "x": ["fine"]}')).when(k % 4 == 1, F.lit('{"x": [{"y": "until {resolution_date}"}]}')).when(k % 4 == 2, F.lit("{broken {forecast_due_date}")).otherwise('{"x": "{other}"}')
    _table(s, d, "orders").select(value).write.text(path)
    return files.drop_templated(s, path, new_path(s, "lines"))


@_query("K10_in_place", """SELECT CASE WHEN o_orderkey % 4 = 0 THEN '{"{resolution_date}": 1, "k": ' || o_orderkey || '}' WHEN o_orderkey % 4 = 2 THEN '{broken {forecast_due_date} ' || o_orderkey ELSE '{"x": "{other}", "k": ' || o_orderkey || '}' END AS value, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 1 GROUP BY 1""")
def _(s, d):
    """Filtered twice: the second run reads the backup and leaves the same lines."""
    path, k = new_path(s, "lines"), F.col("o_orderkey")
    own = lambda a, b: F.concat(F.lit(a), k.cast("string"), F.lit(b))
    value = F.when(k % 4 == 0, own('{"{resolution_date}": 1, "k": ', "}")).when(k % 4 == 1, own('{"x": [{"y": "until {resolution_date}"}], "k": ', "}")).when(k % 4 == 2, own("{broken {forecast_due_date} ", "")).otherwise(own('{"x": "{other}", "k": ', "}"))
    _table(s, d, "orders").select(value).write.text(path)
    for _ in range(2):
        files.drop_templated_in_place(s, path)
    return s.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@_query("K5_csv_columns", "SELECT 'all' AS what, 'event_id,user_id,value' AS columns, count(*) AS n FROM events UNION ALL SELECT 'none', 'event_id,user_id,value', count(*) FROM events WHERE event_id < 0")
def _(s, d):
    """Columns come from the data, also where no row is left."""
    e = _table(s, d, "events").select("event_id", "user_id", "value")
    out = None
    for what, rows in (("all", e), ("none", e.where("event_id < 0"))):
        path = new_path(s, "csv")
        files.write_csv(rows, path)
        back = s.read.csv(path, header=True)
        got = back.agg(F.lit(what).alias("what"), F.lit(",".join(back.columns)).alias("columns"), F.count("*").alias("n"))
        out = got if out is None else out.unionByName(got)
    return out


@_query("U1_read_present", "SELECT source, count(*) * 2 AS n FROM {Q} WHERE " + _VALID + " GROUP BY source")
def _(s, d):
    one = _question_lines(s, d)
    good, _, missing = files.read_present(s, [one, one + "-none", one])
    return good.where(F.lit(len(missing) == 1)).groupBy("source").agg(F.count("*").alias("n"))


# Platforms

_FB = f"""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS p, cast(o_orderdate AS date) AS f, cast(o_orderdate AS date) + cast(o_custkey % 9 - 2 AS int) AS r FROM orders),
 x AS (SELECT *, unnest(CASE WHEN k % 5 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS snap FROM o),
 y AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'resolution_set_missing_question_set' WHEN k % 13 = 0 THEN 'question_set_file_missing' WHEN k % 23 = 0 THEN 'not_resolved' WHEN st = 'P' THEN 'non_binary_outcome' WHEN k % 17 = 0 THEN 'combo_question'
   WHEN k % 19 = 0 THEN 'question_missing_for_resolution' WHEN k % 37 = 0 THEN 'unparseable_dates' WHEN f > r THEN 'freeze_after_resolution' WHEN f <= DATE '{CUTOFF}' OR r <= DATE '{CUTOFF}' THEN 'pre_cutoff' WHEN snap = 'b' THEN 'duplicate_question_id'
   WHEN k % 31 = 0 THEN 'schema_reject:question' WHEN k % 29 = 0 THEN 'unresolved_placeholder' ELSE 'ok' END AS reason FROM x)"""


def _forecastbench(s: SparkSession, d: str) -> DataFrame:
    """Orders as questions of five sets, resolved in one or two snapshots, with every fault of the chain."""
    o, k = _table(s, d, "orders"), F.col("o_orderkey")
    set_name, qid = F.concat("o_orderpriority", F.lit(".json")), F.concat(F.lit("q"), "o_orderkey")
    text = F.when(k % 31 == 0, " ").when(k % 29 == 0, "Will {other_field} do?").otherwise("Will {resolution_date} follow {forecast_due_date}?")
    none = F.lit(None).cast("string")
    q = o.where("o_orderkey % 19 > 0").select(
        set_name.alias("set_name"), qid.alias("id"), F.col("o_orderpriority").alias("source"), text.alias("question"), F.lit("b").alias("background"), F.lit("c").alias("resolution_criteria"), _iso("o_orderdate").alias("freeze_datetime"), F.lit("u").alias("url"),
        *[none.alias(c) for c in ("freeze_datetime_value", "market_info_open_datetime", "market_info_close_datetime", "market_info_resolution_criteria")],
    )
    day = F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 9 - 2).cast("int")), "yyyy-MM-dd")
    r = o.withColumn("snapshot", F.explode(F.when(k % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
    r = r.select(
        "snapshot", F.when(k % 11 == 0, "").when(k % 13 == 0, "gone.json").otherwise(set_name).alias("set_name"), k.alias("pos"), F.when(k % 17 == 0, '["a","b"]').otherwise(qid).alias("id"), F.lit("s").alias("source"),
        F.when(k % 37 == 0, "soon").otherwise(day).alias("resolution_date"), F.when(F.col("o_orderstatus") == "F", "1.0").when(F.col("o_orderstatus") == "O", "No").otherwise("0.5").alias("resolved_to"), F.when(k % 23 == 0, "false").otherwise("true").alias("resolved"),
    )
    return platforms.forecastbench(r, q, CUTOFF)


@_query("F1_question_reasons", f"{_FB} SELECT reason, count(*) AS n FROM y GROUP BY reason")
def _(s, d):
    return schema.reason_counts(_forecastbench(s, d))


@_query("P4_forecastbench", f"{_FB} SELECT 'forecastbench::q' || cast(k AS varchar) AS id, 'Will ' || strftime(r, '%Y-%m-%d') || ' follow ' || strftime(f, '%Y-%m-%d') || '?' AS question, CASE st WHEN 'F' THEN 1 ELSE 0 END AS outcome, f AS freeze_date, r AS resolved_at, p AS categories, p || '.json' AS in_set, snap AS snapshot FROM y WHERE reason = 'ok'")
def _(s, d):
    raw = lambda f: F.get_json_object("raw", f"$.{f}")
    return platforms.accepted(_forecastbench(s, d)).select("id", "question", "outcome", "freeze_date", "resolved_at", F.array_join("categories", ",").alias("categories"), raw("forecastbench_question_set").alias("in_set"), raw("forecastbench_resolution_snapshot").alias("snapshot"))


_META = f"""WITH y AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS p, f, r, CASE WHEN k % 7 = 0 THEN 'not_binary' WHEN k % 9 = 0 THEN 'not_resolved' WHEN o_orderstatus = 'P' THEN 'unclear_outcome' WHEN f > r THEN 'freeze_after_resolution'
   WHEN f <= DATE '{CUTOFF}' OR r <= DATE '{CUTOFF}' THEN 'pre_cutoff' WHEN k % 31 = 0 THEN 'no_title' ELSE 'ok' END AS reason FROM (SELECT *, o_orderkey AS k, cast(o_orderdate AS date) AS f, cast(o_orderdate AS date) + cast(o_custkey % 9 - 2 AS int) AS r FROM orders) o)"""


def _metaculus(s: SparkSession, d: str) -> DataFrame:
    o, k = _table(s, d, "orders"), F.col("o_orderkey")
    late = F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 9 - 2).cast("int")), "yyyy-MM-dd")
    question = F.struct(
        F.col("o_custkey").alias("id"), F.when(k % 7 == 0, "numeric").otherwise("binary").alias("type"), F.when(k % 9 == 0, "open").otherwise("resolved").alias("status"), F.when(k % 31 == 0, "").when(k % 2 == 0, F.concat(F.lit("Q"), "o_orderkey")).alias("title"),
        F.lit("d").alias("description"), F.when(k % 3 > 0, "rc").alias("resolution_criteria"), F.when(k % 4 > 0, "fp").alias("fine_print"), F.when(k % 2 == 0, _iso("o_orderdate")).alias("scheduled_close_time"), F.when(k % 2 == 1, _iso("o_orderdate")).alias("close_time"),
        F.when(k % 3 == 0, late).alias("actual_resolve_time"), F.when(k % 3 == 1, late).alias("resolution_set_time"), F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "NO").otherwise("annulled").alias("resolution"),
    )
    cats = F.struct(F.array(F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.lit("").alias("name"))).alias("category"))
    title = F.when(k % 31 == 0, " ").otherwise(F.concat(F.lit("T"), "o_orderkey"))
    return o.select(F.to_json(F.struct(k.alias("id"), title.alias("title"), late.alias("resolution_set_time"), cats.alias("projects"), question.alias("question"))).alias("value"))


@_query("P1_metaculus", f"""{_META} SELECT 'metaculus::' || cast(k AS varchar) || '_' || cast(c AS varchar) AS id, CASE WHEN k % 2 = 0 THEN 'Q' ELSE 'T' END || cast(k AS varchar) AS question, CASE st WHEN 'F' THEN 1 ELSE 0 END AS outcome, f AS freeze_date, r AS resolved_at, 'https://www.metaculus.com/questions/' || cast(k AS varchar) || '/' AS url,
  CASE WHEN k % 3 > 0 AND k % 4 > 0 THEN 'rc' || chr(10) || chr(10) || 'Fine print: fp' WHEN k % 3 > 0 THEN 'rc' WHEN k % 4 > 0 THEN 'Fine print: fp' END AS resolution_criteria, p || ',tournament:cup' AS categories FROM y WHERE reason = 'ok'""")
def _(s, d):
    got = platforms.pull(_metaculus(s, d), "metaculus", CUTOFF, tournament="cup")[0]
    return got.select("id", "question", "outcome", "freeze_date", "resolved_at", "url", "resolution_criteria", F.array_join("categories", ",").alias("categories"))


@_query("F4_metaculus_skips", f"{_META} SELECT reason, count(*) AS n FROM y WHERE reason <> 'ok' GROUP BY reason")
def _(s, d):
    return platforms.pull(_metaculus(s, d), "metaculus", CUTOFF)[1]


#: Times in milliseconds are told from seconds by their size, so orders move by twenty years.
_LATER = "2016-06-30"
_MANI = f"""WITH y AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'not_binary' WHEN k % 9 = 0 THEN 'not_resolved' WHEN o_orderstatus = 'P' THEN 'unclear_outcome' WHEN o_totalprice < 20000 THEN 'low_volume' WHEN least(f, r) <= DATE '{_LATER}' OR r <= DATE '{_LATER}' THEN 'pre_cutoff' ELSE 'ok' END AS reason
  FROM (SELECT *, o_orderkey AS k, cast(o_orderdate AS date) + 7305 AS f, cast(o_orderdate AS date) + cast(o_custkey % 9 + 7303 AS int) AS r FROM orders) o)"""


def _manifold(s: SparkSession, d: str) -> DataFrame:
    o, k = _table(s, d, "orders"), F.col("o_orderkey")
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    late = F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 9 + 7303).cast("int"))
    rich = F.to_json(F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("rich").alias("text"))).alias("content")))
    return o.select(F.to_json(F.struct(
        k.cast("string").alias("id"), F.lit("slug").alias("slug"), F.when(k % 2 == 0, "ann").alias("creatorUsername"), F.lit("u").alias("url"), F.concat(F.lit(" M"), "o_orderkey").alias("question"), F.when(k % 3 == 0, "plain ").alias("textDescription"), rich.alias("description"),
        F.when(k % 7 == 0, "MULTIPLE").otherwise("BINARY").alias("outcomeType"), (k % 9 > 0).alias("isResolved"), F.when(F.col("o_orderstatus") == "F", "YES").when(F.col("o_orderstatus") == "O", "NO").otherwise("MKT").alias("resolution"), F.col("o_totalprice").alias("volume"),
        ms(F.date_add(F.to_date("o_orderdate"), 7305)).alias("closeTime"), ms(late).alias("resolutionTime"), F.array("o_orderpriority").alias("groupSlugs"),
    )).alias("value"))


@_query("P3_manifold", f"""{_MANI} SELECT 'manifold::' || cast(k AS varchar) AS id, 'M' || cast(k AS varchar) AS question, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS outcome, least(f, r) AS freeze_date, r AS resolved_at, CASE WHEN k % 2 = 0 THEN 'https://manifold.markets/ann/slug' ELSE 'u' END AS url,
  CASE WHEN k % 3 = 0 THEN 'plain' ELSE 'rich' END AS background, o_orderpriority AS categories FROM y WHERE reason = 'ok'""")
def _(s, d):
    got = platforms.pull(_manifold(s, d), "manifold", _LATER, min_volume=20000.0)[0]
    return got.select("id", "question", "outcome", "freeze_date", "resolved_at", "url", "background", F.array_join("categories", ",").alias("categories"))


@_query("F6_manifold_skips", f"{_MANI} SELECT reason, count(*) AS n FROM y WHERE reason <> 'ok' GROUP BY reason")
def _(s, d):
    return platforms.pull(_manifold(s, d), "manifold", _LATER, min_volume=20000.0)[1]


@_query("C12_pull_polymarket", """SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'not_closed' WHEN o_orderkey % 4 = 1 THEN 'not_yes_no' WHEN o_totalprice < 5000 THEN 'low_volume' ELSE 'kept' END AS reason, count(*) AS n FROM orders WHERE cast(o_orderdate AS date) > DATE '1996-06-30' GROUP BY 1""")
def _(s, d):
    o, k = _table(s, d, "orders").where(F.to_date("o_orderdate") > F.lit(CUTOFF).cast("date")), F.col("o_orderkey")
    m = o.select(F.to_json(F.struct(k.cast("string").alias("id"), F.lit("Will it?").alias("question"), F.when(k % 4 == 1, '["A", "B"]').otherwise('["Yes", "No"]').alias("outcomes"), F.lit('["1", "0"]').alias("outcomePrices"), (k % 4 > 0).alias("closed"), F.lit(False).alias("active"), F.col("o_totalprice").alias("volumeNum"), _iso("o_orderdate").alias("endDate"))).alias("value"))
    good, skipped = platforms.pull(m, "polymarket", CUTOFF, min_volume=5000.0)
    return skipped.unionByName(good.agg(F.lit("kept").alias("reason"), F.count("*").alias("n")))


@_query("P9_restamp", "SELECT 'mantic_q2_aib::' || cast(o_orderkey AS varchar) AS id, 'mantic_q2_aib' AS source, CASE WHEN o_orderkey % 2 = 0 THEN 'tournament:mantic_q2_aib' ELSE 'x,tournament:mantic_q2_aib' END AS categories FROM orders")
def _(s, d):
    tags = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("tournament:mantic_q2_aib"))).otherwise(F.array(F.lit("x")))
    q = _table(s, d, "orders").select(F.concat(F.lit("metaculus::"), "o_orderkey").alias("id"), F.lit("metaculus").alias("source"), tags.alias("categories"))
    return platforms.restamp(q).withColumn("categories", F.array_join("categories", ","))


# Scalars


@_query("X6_iso_date", "SELECT event_id, event_id % 3 = 0 AS iso FROM events")
def _(s, d):
    shown = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-M")).otherwise("2025-02-30")
    return _table(s, d, "events").select("event_id", F.coalesce(is_iso_date(shown), F.lit(False)).alias("iso"))


@_query("F2_F3_marks", "SELECT event_id, event_id % 2 = 0 AS placeholder, 'by ' || strftime(ts, '%Y-%m-%d') || CASE WHEN event_id % 2 = 0 THEN ' {field_x}' ELSE ' {X}' END AS rendered FROM events")
def _(s, d):
    t = X.render_question_dates(F.concat(F.lit("by {resolution_date}"), F.when(F.col("event_id") % 2 == 0, " {field_x}").otherwise(" {X}")), F.to_date("ts"), F.to_date("ts"))
    return _table(s, d, "events").select("event_id", X.has_placeholder(t).alias("placeholder"), t.alias("rendered"))


@_query("P16_request_key", """SELECT event_id, sha256('{"max_tokens":10,"model":"m","user":"ask ' || cast(event_id AS varchar) || ' \\"é\\""}') AS key FROM events""")
def _(s, d):
    user = F.concat(F.lit("ask "), "event_id", F.lit(' "é"'))
    return _table(s, d, "events").select("event_id", X.request_key(F.struct(F.lit(10).alias("max_tokens"), F.lit("m").alias("model"), user.alias("user"))).alias("key"))


# Splits, training


@_query("J9_fixed_test", """WITH r AS (SELECT id, strftime(resolved_at, '%Y-%m') AS bucket, cast(substr(id, 9) AS bigint) % 9 = 0 AS fixed FROM {Q} WHERE resolved_at IS NOT NULL), k AS (SELECT id, row_number() OVER (PARTITION BY bucket ORDER BY md5('17::' || bucket || '::' || id), id) AS rn, count(*) OVER (PARTITION BY bucket) AS n FROM r WHERE NOT fixed)
 SELECT id, CASE WHEN rn <= round_even(n * 8e-1, 0) THEN 'train' WHEN rn <= round_even(n * 8e-1, 0) + round_even(n * 1e-1, 0) THEN 'validation' ELSE 'test' END AS split FROM k UNION ALL SELECT id, 'test' FROM r WHERE fixed""")
def _(s, d):
    q = _questions(s, d).where("resolved_at is not null")
    fixed = q.where(F.substring("id", 9, 20).cast("long") % 9 == 0).select("id").withColumn("id", F.concat(F.lit("metaculus::"), "id"))
    return split.split_ids(q, fixed_test=fixed)


@_query("T4_first_rows", "SELECT id, resolved_at FROM {Q} WHERE resolved_at IS NOT NULL ORDER BY resolved_at, id LIMIT 50")
def _(s, d):
    return generate.first_rows(_questions(s, d).where("resolved_at is not null"), 50).select("id", "resolved_at")


@_query("F7_kept_news", "SELECT o_orderkey, string_agg(strftime(l_shipdate, '%Y-%m-%d'), ',' ORDER BY l_shipdate) AS kept FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate AND l_linenumber > 1 GROUP BY o_orderkey")
def _(s, d):
    title = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("string")).otherwise(" ")
    item = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), title.alias("headline"), F.lit("").alias("summary"))
    rows = _table(s, d, "orders").join(_table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.first(F.to_date("o_orderdate")).alias("day"), F.array_sort(F.collect_list(item)).alias("news"))
    kept = rows.select("o_orderkey", assemble.leakage_filter(F.col("news"), F.col("day"))["kept"]["date"].alias("kept"))
    return kept.where(F.size("kept") > 0).withColumn("kept", F.array_join("kept", ","))


# Model calls, with a client that answers by rule


class Echo:
    """Answers from the request alone: an answer for each form that responses come in."""

    def complete(self, system: str, user: str) -> tuple[str, int, int]:
        key = int(user.split("#")[1].split("#")[0])
        if key % 5 == 4:
            raise ValueError("no answer")
        body = {"base_rate": {"value": (key % 101) / 100, "n_reference_events": 3, "reference_window_years": 2, "explanation": " e "}, "news_snapshot": [{"date": "1990-01-01", "headline": "h", "summary": None}, {"date": "2090-01-01", "headline": "late"}, "odd"]}
        forms = (json.dumps(body), f"```json\n{json.dumps(body)}\n```", f"Here: {body!r} as asked", "nothing")
        return forms[key % 5], len(user), 7


@_query("E2_contexts", """SELECT 'o::' || cast(o_orderkey AS varchar) AS question_id, CASE WHEN o_orderkey % 5 < 3 THEN round(o_orderkey % 101 / 100e0, 2) END AS value, CASE WHEN o_orderkey % 5 < 3 THEN 'h' ELSE '' END AS kept, cast(CASE WHEN o_orderkey % 5 < 3 THEN 2 ELSE 0 END AS int) AS filtered,
  CASE o_orderkey % 5 WHEN 3 THEN 'no JSON object' WHEN 4 THEN 'ERROR: ValueError: no answer' END AS error, o_orderkey % 5 < 4 AS cached FROM orders""")
def _(s, d):
    """Asked twice: the second run finds all answers but the errors in the cache."""
    o = _table(s, d, "orders")
    q = o.select(F.concat(F.lit("o::"), "o_orderkey").alias("id"), F.concat(F.lit("Ask #"), "o_orderkey", F.lit("#?")).alias("question"), F.to_date("o_orderdate").alias("freeze_date"), F.lit("").alias("background"), F.lit("").alias("resolution_criteria"))
    path = new_path(s, "cache")
    generate.contexts(q, Echo(), "m", path)
    got = generate.contexts(q, Echo(), "m", path)
    return got.select("question_id", F.round(F.col("base_rate")["value"], 2).alias("value"), F.array_join("news_snapshot.headline", ",").alias("kept"), F.col("leakage_filtered_count").alias("filtered"), "error", F.col("cache_hit").alias("cached"))


class Rewords:
    """A list of rewordings, of which the first round has one that drops the number."""

    def complete(self, system: str, user: str) -> tuple[str, int, int]:
        key = int(user.split("#")[1].split(" ")[0])
        if "Rejected:" in user:
            return json.dumps([{"text": f"Is order #{key} to ship?"}, f"Does order #{key} ship?"]), 1, 1
        if key % 4 == 3:
            return "```json\n" + json.dumps(["Does it ship?", f" Can order #{key} ship? "]) + "\n```", 1, 1
        return f'Sure: ["Does order #{key} ship?", "Can order #{key} ship?", ""] done', 1, 1


@_query("E3_paraphrases", """SELECT 'o::' || cast(o_orderkey AS varchar) AS question_id, 'Will order #' || cast(o_orderkey AS varchar) || ' ship?|' || CASE WHEN o_orderkey % 4 = 3 THEN 'Can order #' || cast(o_orderkey AS varchar) || ' ship?|Is order #' || cast(o_orderkey AS varchar) || ' to ship?' ELSE 'Does order #' || cast(o_orderkey AS varchar) || ' ship?|Can order #' || cast(o_orderkey AS varchar) || ' ship?' END AS texts,
  cast(CASE WHEN o_orderkey % 4 = 3 THEN 2 ELSE 1 END AS int) AS rounds, cast(CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END AS int) AS rejected, NULL AS error FROM orders""")
def _(s, d):
    q = _table(s, d, "orders").select(F.concat(F.lit("o::"), "o_orderkey").alias("id"), F.concat(F.lit("Will order #"), "o_orderkey", F.lit(" ship?")).alias("question"))
    got = generate.paraphrases(q, Rewords(), k=3)
    return got.select("question_id", F.array_join("paraphrases.text", "|").alias("texts"), "rounds", F.col("rejected_count").alias("rejected"), F.col("error").cast("int").alias("error"))


class Says:
    def complete(self, system: str, user: str) -> tuple[str, int, int]:
        if "USER:" not in user:
            raise ValueError("no question")
        return f"Probability: 0.{len(user) % 9}", 1, 1


@_query("E4_predictions", """WITH m AS (SELECT conv_id, string_agg(upper(trim(role)) || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'ASSISTANT:' || chr(10) AS p FROM conversations WHERE trim(role) IN ('system', 'user', 'assistant') AND text IS NOT NULL GROUP BY conv_id)
 SELECT cast(conv_id AS varchar) AS id, CASE WHEN contains(p, 'USER:') THEN length(p) % 9 / 10e0 END AS prediction, contains(p, 'USER:') AS parseable, CASE WHEN contains(p, 'USER:') THEN 'Probability: 0.' || cast(length(p) % 9 AS varchar) ELSE 'ERROR: ValueError: no question' END AS completion FROM m""")
def _(s, d):
    m = F.filter("messages", lambda x: x["content"].isNotNull())
    rows = _messages(s, d).select(F.col("conv_id").cast("string").alias("id"), F.lit(0).alias("variant_index"), F.lit("test").alias("split"), F.lit(1).alias("outcome"), F.lit("q").alias("question"), m.alias("messages")).where(X.usable_messages(F.col("messages")).isNotNull())
    return generate.predictions(rows, Says()).select("id", "prediction", "parseable", "completion")


class OutOfRange:
    """Contexts whose base rate is no probability, or no number, in two of three cases."""

    def complete(self, system: str, user: str) -> tuple[str, int, int]:
        key = int(user.split("#")[1].split("#")[0])
        value = (0.25, 1 + key / 100, "likely")[key % 3]
        return json.dumps({"base_rate": {"value": value, "n_reference_events": "4"}, "news_snapshot": []}), 1, 1


@_query("F14_base_rate_range", """SELECT 'o::' || cast(o_orderkey AS varchar) AS question_id, CASE o_orderkey % 3 WHEN 0 THEN 25e-2 WHEN 1 THEN CASE WHEN o_orderkey = 0 THEN 1e0 END END AS value,
  CASE o_orderkey % 3 WHEN 1 THEN 'base_rate.value outside [0, 1]' WHEN 2 THEN 'base_rate is not numeric' END AS error FROM orders""")
def _(s, d):
    q = _table(s, d, "orders").select(F.concat(F.lit("o::"), "o_orderkey").alias("id"), F.concat(F.lit("Ask #"), "o_orderkey", F.lit("#?")).alias("question"), F.to_date("o_orderdate").alias("freeze_date"), F.lit("").alias("background"), F.lit("").alias("resolution_criteria"))
    return generate.contexts(q, OutOfRange(), "m").select("question_id", F.col("base_rate")["value"].alias("value"), "error")


class RewordsBadly:
    """Six rewordings that lose the number and one that is fine twice; then as many as were named
    as rejected, and a good one that says how many."""

    def complete(self, system: str, user: str) -> tuple[str, int, int]:
        key = int(user.split("#")[1].split(" ")[0])
        if "Rejected:" in user:
            named = user.split("Rejected:")[1].count("  - ")
            return json.dumps([f"Could order #{key} ship{'!' * named}"]), 1, 1
        return json.dumps([f"Does it ship, case {'abcdef'[i]}?" for i in range(6)] + [f"Does order #{key} ship?"] * 2), 1, 1


@_query("T7_U6_rejected_samples", """SELECT 'o::' || cast(o_orderkey AS varchar) AS question_id, 'Will order #' || o_orderkey || ' ship?|Does order #' || o_orderkey || ' ship?|Could order #' || o_orderkey || ' ship!!!!!' AS texts,
  cast(6 AS int) AS rejected, 'Does it ship, case a?|Does it ship, case b?|Does it ship, case c?|Does it ship, case d?|Does it ship, case e?' AS samples, cast(2 AS int) AS rounds FROM orders""")
def _(s, d):
    """Equal candidates count once; the second request names the last five that were rejected, the
    result keeps the first five."""
    q = _table(s, d, "orders").select(F.concat(F.lit("o::"), "o_orderkey").alias("id"), F.concat(F.lit("Will order #"), "o_orderkey", F.lit(" ship?")).alias("question"))
    got = generate.paraphrases(q, RewordsBadly(), k=3)
    first = F.transform("rejected_samples", lambda x: x[0])
    return got.select("question_id", F.array_join("paraphrases.text", "|").alias("texts"), F.col("rejected_count").alias("rejected"), F.array_join(first, "|").alias("samples"), "rounds")
