"""Views that shape the driver's tables like questions and predictions. One SQL text serves
both engines; ``{name}`` stands for a table, and what differs between them is in DIALECT."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DIALECT = {
    "spark": {"K": "cast(get_json_object(props, '$.k') AS double)", "LPAD": "lpad(cast({} AS string), 4, '0')", "REP": "repeat('x', {})"},
    "duckdb": {"K": "cast(json_extract_string(props, '$.k') AS double)", "LPAD": "lpad(cast({} AS varchar), 4, '0')", "REP": "repeat('x', {})"},
}

PREDICTIONS = """
SELECT 'events::' || cast(user_id AS string) || '_' || cast(blk AS string) AS id, cast(rn % 5 AS int) AS variant_index,
  CASE WHEN user_id % 10 < 8 THEN 'train' WHEN user_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
  cast(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, blk) AS int) AS outcome,
  CASE WHEN event_type <> 'error' THEN value / (value + 50e0) END AS prediction, event_type <> 'error' AS parseable,
  @K / 100e0 AS base_rate, event_id, event_type, value, ts
FROM (SELECT *, cast(floor(rn / 5e0) AS bigint) AS blk FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM {events}) a) b
"""
QUESTIONS = """
SELECT 'orders::' || cast(o_orderkey AS string) AS id, 'Will order ' || cast(o_orderkey AS string) || ' ship?' AS question,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS outcome, cast(o_orderdate AS date) AS freeze_date, cast(ship AS date) AS resolved_at,
  o_orderpriority AS source, CASE WHEN o_custkey % 3 > 0 THEN 'http://Host.example/q/' || cast(o_custkey % 997 AS string) || '/?r=1' END AS url,
  repeat('x', cast(o_custkey % 7 AS int)) AS background, repeat('y', cast(o_orderkey % 5 AS int)) AS resolution_criteria
FROM {orders} LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS ship FROM {lineitem} GROUP BY l_orderkey) l ON o_orderkey = l_orderkey
"""
COMPLETIONS = """
SELECT id, variant_index, split, outcome, event_id,
  CASE WHEN event_type = 'error' THEN 'I think ' || cast(cast(floor(value) AS bigint) AS string)
    WHEN event_type = 'signup' THEN 'Probability: 0.5 ' || repeat('!', 20)
    WHEN event_id % 3 = 0 THEN 'analysis final probability: ' || cast(cast(floor(value) AS bigint) % 100 AS string) || '%'
    ELSE 'Probability: 0.' || lpad(cast(cast(floor(value * 20) AS bigint) % 10000 AS string), 4, '0') END AS completion
FROM ({predictions}) p
"""


def text(engine: str, sql: str) -> str:
    """SQL of a view for an engine, with inner views in place."""
    sql = sql.replace("{predictions}", PREDICTIONS).replace("@K", DIALECT[engine]["K"])
    return re.sub(r"\{(\w+)\}", r"\1", sql) if engine == "duckdb" else sql


def view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    sql = text("spark", sql)
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)
