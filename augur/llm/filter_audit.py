"""How filters of documents interact: a relational replay of all orders.

Each document's flags meet a broadcast table of the 120 orders of five filters, an order
is exploded into its steps, and the first failure in it decides where the document goes. Counts are
conditional sums, added up in every task before they are shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm.common import cut, join_hot

#: The filters' letters and the signs of filter D.
LETTERS = "ABCDE"
SIGNS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_flags(text: Column) -> dict[str, Column]:
    """Failures that a text shows by itself: few words, few distinct words, many capitals, signs."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    caps = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {"A": n < 200, "B": 100 * kinds < 50 * n, "C": 100 * caps > 2 * F.length(text), "D": text.rlike(SIGNS)}


def orders(spark: SparkSession) -> DataFrame:
    """The 120 orders: filter_order, and ``letters`` in order with their step and bit."""
    rows = [("".join(p), [(k + 1, x, 1 << LETTERS.index(x)) for k, x in enumerate(p)]) for p in permutations(LETTERS)]
    return spark.createDataFrame(rows, "filter_order string, letters array<struct<step: int, letter: string, bit: int>>")


def flagged(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, fails, good, toxic) of every document; ``fails`` has a bit for each filter.

    Copies are found by the digest of the text: the smallest id of each digest is an
    aggregation, and digests that very many rows share meet them where those are."""
    text_of = F.coalesce(F.col(text).cast("string"), F.lit(""))
    flags = text_flags(F.col("text"))
    bits = sum((F.when(c, 1 << LETTERS.index(x)).otherwise(0) for x, c in flags.items()), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of.alias("text"))
    rows = cut(rows.select("doc_id", "part", bits.alias("own"), F.unhex(F.sha2(F.col("text"), 256)).alias("digest")))
    heads = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1"))
    one = rows.join(heads.select("digest"), "digest", "left_anti").select("doc_id", "part", F.col("own").alias("fails"))
    copy = join_hot(rows, heads, "digest", "n").select("doc_id", "part", (F.col("own") + F.when(F.col("doc_id") > F.col("head"), 16).otherwise(0)).alias("fails"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    both = one.unionByName(copy).join(known, "doc_id", "left")
    no = F.lit(False)
    return both.select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def replay(flags: DataFrame) -> DataFrame:
    """Counts of each part, order and step from (part, fails, good, toxic)."""
    spark = flags.sparkSession
    step = F.explode("letters").alias("s")
    rows = flags.crossJoin(F.broadcast(orders(spark)))
    # The step at which a document goes: the first in the order whose bit it fails, else 6.
    hits = F.filter("letters", lambda x: F.col("fails").bitwiseAND(x["bit"]) != 0)
    first = F.coalesce(F.try_element_at(hits, F.lit(1))["step"], F.lit(6))
    rows = rows.select("part", "filter_order", "fails", "good", "toxic", first.alias("first"), step).select("*", "s.step", "s.letter", "s.bit").drop("s")
    fails, gone = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("first") == F.col("step")
    out = rows.groupBy("part", "filter_order", "step", "letter").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(gone).alias("removed"),
        F.count_if(fails & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("fails") == F.col("bit")).alias("unique_fails"),
        F.count_if(gone & F.col("good")).alias("good_lost"),
        F.count_if(gone & F.col("toxic")).alias("toxic_lost"),
    )
    out = cut(out)  # else the replay runs again for the shares
    share = out.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return out.join(share, ["part", "letter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """One row a part, order and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    Null texts are empty ones, and a null part is the part ''. A row under a null id is no copy of
    another and makes none; repeated ids are rows of their own, none of which is smaller than
    the other. Of several labels of an id any that says so counts; labels without an id don't.
    Further columns are not read; without documents there are no parts and no rows.
    """
    return replay(cut(flagged(docs, labels, text, doc_id, part)))
