"""The corpus operators as queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm import alignment, ann_forest, brown_lm, chat_format, decontam, filter_audit, fm_quality, langid_mix, secrets, sentencepiece_bpe, simhash, token_counts, url_cascade

#: The rules of the url query (action, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Fixed value: what both turns of conversation -7 say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_spans(table(spark, folder, "documents"))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann_forest.nearest(table(spark, folder, "embeddings"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_cascade.judge_urls(table(spark, folder, "pages"), url_cascade.rules_frame(spark, URL_RULES))


def op6_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    return brown_lm.score_texts(table(spark, folder, "documents"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return fm_quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    got = langid_mix.predict_languages(table(spark, folder, "documents"))
    return got.select("doc_id", "held_out", "lang_pred", "score", "gain", F.to_json("languages").alias("languages"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_corpus(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, k, r, CONTROL_TEXT) for k, r in enumerate(("user", "assistant"))], rows.schema))
    return chat_format.digests(chat_format.format_conversations(rows.withColumn("parts", chat_format.text_part(F.col("text")))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_secret_scan, op3_sentencepiece, op4_nearest, op5_url_filter,
        op6_class_lm, op7_simhash, op8_decontamination, op9_quality, op10_language,
        op11_alignment, op12_filter_audit, op13_chat_format,
    )
}

#: The url query: rules written out as a table, the longest that fits.
_OP5 = r"""
WITH rules(action, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (SELECT page_id,
  CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.action,
  row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC NULLS LAST) AS rn
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE rn = 1
"""

#: The filter audit: the first failing letter of each order by its place in the order.
_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(good, false) AS good, coalesce(lab.toxic, false) AS toxic,
  len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
  100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e
  FROM w LEFT JOIN lab USING (doc_id)),
g AS (SELECT part, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
  || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM f),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS letter FROM o, range(1, 6) k(step)),
r AS (SELECT part, good, toxic, fails, filter_order, step, letter, contains(fails, letter) AS bad,
  len(regexp_extract(filter_order, '^[^' || fails || '-]*', 0)) + 1 AS first FROM g, steps),
n AS (SELECT part, filter_order, step, letter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
  count(*) FILTER (bad AND first < step) AS redundant, count(*) FILTER (fails = letter) AS unique_fails,
  count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM n
"""

#: The chat query: lengths of the marks, of doubled backslashes and of the breaks in control strings.
_OP13 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(t) + (length(t) - length(replace(t, '\', '')))
  + 2 * list_sum(list_transform(['<s>', '</s>', '[INST]', '[/INST]', '[IMG]', '[AUDIO]', '[DOC]'], lambda x: (length(t) - length(replace(t, x, ''))) // length(x))) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(17 + length(role) + n) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS expanded_tokens
FROM e GROUP BY conv_id
"""
ORACLE_SQL: dict[str, str] = {"op5_url_filter": _OP5, "op12_filter_audit": _OP12, "op13_chat_format": _OP13}
