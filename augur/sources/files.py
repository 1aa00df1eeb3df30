"""Scans and sinks over files. Nothing here opens a path on the driver: paths are Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augur.functions.text import strip
from augur.sources import schema as S
from augur.sources.json_parts import document_keys, read_array
from augur.sources.shared import qualified, written
from augur.sources.shared_files import write_bytes

CORRUPT = "_corrupt_record"


def read_questions(spark: SparkSession, path: str | list[str], ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Canonical questions from line JSON: valid rows, and rejected ones with a reason
    (``json`` for lines that are none, ``unknown_column`` for fields outside the schema).
    ``ordered`` adds _file and _row, by which later lines follow earlier ones of a file."""
    place = [F.col("_metadata.file_path").alias("_file"), line_order().alias("_row")] if ordered else []
    lines = spark.read.text(path).select("value", *place).where(F.col("value").rlike(r"\S"))
    ddl = T.StructType([*S.QUESTION.fields[:3], T.StructField("freeze_date", T.StringType()), T.StructField("resolved_at", T.StringType()), *S.QUESTION.fields[5:], T.StructField(CORRUPT, T.StringType())])
    row = F.from_json("value", ddl, {"columnNameOfCorruptRecord": CORRUPT})
    at = ["_file", "_row"] if ordered else []
    df = lines.select("value", *at, row.alias("r"), F.json_object_keys("value").alias("k")).select("value", *at, "k", "r.*")
    from augur.functions.dates import is_iso_date

    for c in ("freeze_date", "resolved_at"):
        df = df.withColumn(c, F.when(is_iso_date(F.col(c)), F.try_to_date(F.col(c), "yyyy-MM-dd")))
    known = F.array(*[F.lit(f.name) for f in S.QUESTION.fields])
    reason = F.when(F.col(CORRUPT).isNotNull() | F.col("k").isNull(), "json").when(F.size(F.array_except("k", known)) > 0, "unknown_column").otherwise(S.reject_reason())
    df = df.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>"))).withColumn("reject_reason", reason).drop("k", CORRUPT)
    good = df.where("reject_reason is null").select(*S.QUESTION.names, *at)
    return good, df.where("reject_reason is not null").select("value", "reject_reason")


def line_order() -> Column:
    """Order of the lines of a file: by the start of the part that a task reads, then in it."""
    return F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("n"))


def read_rows(spark: SparkSession, path: str, schema: str, ordered: bool = False) -> DataFrame:
    """Line JSON read leniently: missing fields are null, further ones ignored. ``ordered`` adds
    _file and _row, by which later lines follow earlier ones of a file."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", line_order()) if ordered else rows


def read_present(spark: SparkSession, paths: list[str], ordered: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """Questions of all files that are there, as valid and rejected rows, and the paths that are
    missing, in one scan however many there are; a path that is listed twice is read twice.
    ``ordered`` adds _input, _file and _row: the first place of the path in the list, its file,
    and the line in it."""
    there = [p for p in paths if exists(spark, p)]
    missing = [p for p in paths if p not in there]
    if not there:
        at = "_input int, _file string, _row struct<part: long, n: long>" if ordered else ""
        empty = T.StructType([*S.QUESTION.fields, *(T.StructType.fromDDL(at).fields if at else [])])
        return spark.createDataFrame([], empty), spark.createDataFrame([], "value string, reject_reason string"), missing
    good, bad = read_questions(spark, there, ordered)
    if ordered:
        starts = F.array(*(F.lit(scheme_free(qualified(spark, p))) for p in there))
        path = F.regexp_replace("_file", "^[a-z0-9]+:/+", "/")
        good = good.withColumn("_input", F.array_position(F.transform(starts, lambda p: (path == p) | path.startswith(F.concat(p, F.lit("/")))), True).cast("int"))
    return good, bad, missing


def scheme_free(address: str) -> str:
    """An address without its file system."""
    import re

    return re.sub("^[a-z0-9]+:/+", "/", address)


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _document(column: str = "file") -> Column:
    """The name of a document's file."""
    return F.element_at(F.split(F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B"))), "/"), -1)


def read_question_sets(spark: SparkSession, pattern: str) -> DataFrame:
    """Question-set documents, one row a question: set_name and the question's fields; of equal
    ids in a set the last stays, entries that are no objects or lack an id go. A large
    document is read by many tasks."""
    fields = (
        "id string, source string, question string, background string, resolution_criteria string, freeze_datetime string, url string, "
        "freeze_datetime_value string, market_info_open_datetime string, market_info_close_datetime string, market_info_resolution_criteria string"
    )
    found = read_array(spark, pattern, "questions")
    rows = found.select(_document().alias("set_name"), F.struct("part", "n").alias("pos"), F.from_json("value", fields).alias("q")).select("set_name", "pos", "q.*")
    return last_by(rows.where("id <> ''"), ["set_name", "id"], ["pos"]).drop("pos")


def read_resolution_sets(spark: SparkSession, pattern: str) -> DataFrame:
    """Resolution-set documents, one row a resolution: snapshot (file name), set_name, pos (place
    in the document) and fields. Fields of changing type arrive as text, a list as its JSON. A large
    document is read by many tasks."""
    fields = "id string, source string, resolution_date string, resolved_to string, resolved string"
    names = document_keys(spark, pattern).where("key = 'question_set'").groupBy("file").agg(F.max_by(F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"], F.struct("part", "n")).alias("set_name"))
    rows = read_array(spark, pattern, "resolutions").join(names, "file", "left").withColumn("pos", F.struct("part", "n"))
    return rows.select(_document().alias("snapshot"), "set_name", "pos", F.from_json("value", fields).alias("r")).select("snapshot", "set_name", "pos", "r.*")


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Predictions as texts; completions may hold line ends and doubled quotes."""
    return spark.read.schema(S.PREDICTION_CSV).csv(path, header=True, multiLine=True, escape='"', quote='"', enforceSchema=False)


def read_training_index(spark: SparkSession, path: str) -> DataFrame:
    """Training rows by (id, variant_index), the last of each; order is that of lines in a file."""
    rows = spark.read.schema(S.TRAINING).json(path).withColumn("variant_index", F.coalesce("variant_index", F.lit(0)))
    rows = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", line_order())
    return last_by(rows, ["id", "variant_index"], ["_file", "_row"]).drop("_file", "_row")


def read_drop_in_ids(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Distinct ids (column ``id``) of a list given as json (a list, or an object with
    ``questions``), jsonl, csv (the first filled of four columns) or lines of text."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        # Texts arrive in quotes, objects and numbers as they are.
        rows = read_array(spark, path, "questions").select(F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"].alias("v"))
        obj = F.from_json("v", "id string, post_id string")
        ids = F.when(F.col("v").startswith("{"), F.coalesce(F.nullif(obj["id"], F.lit("")), obj["post_id"])).otherwise(F.col("v"))
    elif kind == "jsonl":
        rows, obj = spark.read.text(path).where(F.col("value").rlike(r"\S")), F.from_json("value", "id string, post_id string")
        ids = F.coalesce(F.nullif(obj["id"], F.lit("")), obj["post_id"])
    elif kind == "csv":
        rows = spark.read.csv(path, header=True)
        names = [c for c in ("id", "post_id", "question_id", "metaculus_id") if c in rows.columns]
        ids = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names])
    else:
        rows, ids = spark.read.text(path), strip(F.col("value"))
    return rows.select(ids.alias("id")).where("id <> ''").distinct()


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that are not blank; 0 where there is no file."""
    try:
        return spark.read.text(path).where(F.col("value").rlike(r"\S")).count()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def line_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, n): lines that are not blank; 0 where there is no file."""
    out = spark.createDataFrame([(p, 0) for p in paths], "path string, n long")
    for p in (p for p in paths if exists(spark, p)):
        out = out.unionByName(spark.read.text(p).where(F.col("value").rlike(r"\S")).agg(F.lit(p).alias("path"), F.count("*").alias("n")))
    return out.groupBy("path").agg(F.sum("n").alias("n"))


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Cached responses of a folder of JSON files: key, response, modified; files that hold no
    JSON object are left out."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True)
    rows = files.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("key"),
        F.from_json("value", f"{S.RESPONSE}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}).alias("r"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )
    return rows.where(f"r is not null and r.{CORRUPT} is null").select("key", F.struct("r.text", "r.usage", "r.stop_reason").alias("response"), "modified")


def store_cache(rows: DataFrame, folder: str) -> int:
    """Puts responses (key, body: JSON) into a folder of JSON files, each task its own, and counts them."""
    root = qualified(rows.sparkSession, folder)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for key, body in zip(*(c.to_pylist() for c in batch.columns)):
                write_bytes(f"{root}/{key}.json", body.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("key", "body").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


# Sinks. Spark's commit protocol makes each write atomic; row order carries no meaning.


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Line JSON with keys in order and nulls written."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV of the fields, all if none are named; further columns are left out."""
    df.select(*(fields or df.columns)).write.mode(mode).csv(path, header=True, escape='"', quote='"')


def append_new(df: DataFrame, path: str, key: str, schema: str) -> DataFrame:
    """Appends the rows whose key is not in ``path`` yet, and returns them."""
    new = not_done(df, df.sparkSession.read.schema(schema).json(path), key, key) if exists(df.sparkSession, path) else df
    new = written(new)  # else it would be compared with what it has added
    append_jsonl(new, path)
    return new


def not_done(df: DataFrame, done: DataFrame, key: str, done_key: str) -> DataFrame:
    """Rows that a resumed run still has to do."""
    return df.join(done.select(F.col(done_key).alias(key)).distinct(), key, "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def report_json(df: DataFrame) -> DataFrame:
    """A one-row report as JSON text with keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    report_json(df).coalesce(1).write.mode("overwrite").text(path)


PLACEHOLDERS = ("{resolution_date}", "{forecast_due_date}")


def _marked(spark: SparkSession, path: str, placeholders: tuple[str, ...]) -> DataFrame:
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    return lines.withColumn("hit", placeholder_in_values(F.col("value"), placeholders))


def drop_templated(spark: SparkSession, path: str, out: str, placeholders: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """Writes the lines of ``path`` without those whose JSON holds a placeholder in any value
    to ``out``, and returns counts (total, dropped). Lines that are no JSON stay."""
    lines = _marked(spark, path, placeholders)
    lines.where(~F.col("hit")).select("value").write.mode("overwrite").text(out)
    return lines.agg(F.count("*").alias("total"), F.count_if("hit").alias("dropped"))


def drop_templated_in_place(spark: SparkSession, path: str, placeholders: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """As :func:`drop_templated`, on ``path`` itself; a path that is not there gives zeros.

    The original is kept beside it as ``.bak``, by a rename that copies nothing, and every run
    reads from there, so a second run changes nothing. The rest is written under another name and
    moved at the end; a run that dies before leaves the original, and the next one begins anew."""
    home = spark._jvm.org.apache.hadoop.fs.Path
    backup, draft = f"{path}.bak", f"{path}.draft"
    system = home(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not exists(spark, backup):
        if not exists(spark, path):
            return spark.createDataFrame([(0, 0)], "total long, dropped long")
        if not system.rename(home(path), home(backup)):
            raise OSError(f"{path} cannot be moved to {backup}")
    counts = drop_templated(spark, backup, draft, placeholders)
    system.delete(home(path), True)
    if not system.rename(home(draft), home(path)):
        raise OSError(f"{draft} cannot be moved to {path}")
    return counts


def placeholder_in_values(json: Column, placeholders: tuple[str, ...]) -> Column:
    """Whether a value (not a key) of valid JSON holds a placeholder: keys with one are erased first."""
    import re

    any_of = "|".join(re.escape(p) for p in placeholders)
    values = F.regexp_replace(json, rf'"(?:[^"\\]|\\.)*(?:{any_of})(?:[^"\\]|\\.)*"\s*:', '"":')
    return F.coalesce(F.try_parse_json(json).isNotNull() & values.rlike(any_of), F.lit(False))
