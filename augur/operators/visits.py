"""Duplicates between sources in a fixed order of visits, decided in parallel rounds.

The sequential rule: months are taken in order; the rows of a month and of the next one that
occurs are compared, each row that is still there with all behind it that are; of two similar rows of
different sources within the window the worse one goes, and a row that goes while it is being
compared with the others is compared to the end. Which row goes when then depends on the order.

The same result without a sequence. Let O be a row's place: month, first place of its url's
group, own place. A row v goes by the first better neighbour u, in order of O, that is still there
when the two are compared. Rows of one set, source, day and standing have the same better
neighbours, so they form a group, and all that a group does to others follows from a few places:

* A: the first place from which a better row before it drops the group's rows. Rows behind A are
  gone before they are compared with others.
* T: until there the rows before A are dropped by better rows behind them; ``own`` is T with rows
  of the same month alone.
* F: the first place from which the group drops rows of its own month, and of the next one. The
  latter is compared later, when rows that went in their own month are not there any more.

A group is decided once all better neighbouring groups are; a round decides all such groups by an
aggregation over the pairs of groups. As the worse of two sources goes, there are
about as many rounds as ranks of sources; sources of equal rank may need more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augur.functions.dates import month
from augur.functions.text import canonical_url
from augur.operators.dedupe import PRIORITY, priority, quality_order, url_arbitration
from augur.operators.similarity import either_way, near_in_time, similar_sets, token_sets
from augur.sources.shared import own_tables, new_path, remove, written, written_at


def with_place(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``m``, the number of their month among those that occur, and ``o``, their
    place in the order of visits: rows of one url follow the first of them, and so do all
    rows without url. ``order``: columns that tell rows apart and give the order of input."""
    pos = F.struct(*order)
    keyed = rows.withColumn("_url", canonical_url(F.col("url"))).withColumn("_pos", pos)
    heads = keyed.where("_url is not null").groupBy("_url").agg(F.min("_pos").alias("_head"))
    bare = keyed.where("_url is null").agg(F.min("_pos").alias("_head"))
    placed = keyed.where("_url is not null").join(heads, "_url").unionByName(keyed.where("_url is null").crossJoin(F.broadcast(bare)))
    # One row a month.
    months = rows.select(month(F.col("resolved_at")).alias("_month")).distinct().withColumn("m", F.row_number().over(Window.orderBy("_month")) - 1)
    placed = placed.withColumn("_month", month(F.col("resolved_at"))).join(F.broadcast(months), "_month")
    return placed.withColumn("o", F.struct("m", "_head", "_pos")).drop("_url", "_pos", "_head", "_month")


def standing(ranks: dict[str, int]) -> Column:
    """What orders groups: the rank of the source, and for ranks that several sources share
    also what their rows hold; smaller is better."""
    shared = [r for r in {*ranks.values(), 99} if r == 99 or sum(x == r for x in ranks.values()) > 1]
    q = quality_order(ranks)
    both = q["rank"].isin(shared)
    return F.struct(q["rank"].alias("rank"), *(F.when(both, q[c]).otherwise(0).alias(c) for c in ("bg", "rc", "cats")))


def _groups(rows: DataFrame, threshold: float, window_days: int, ranks: dict[str, int], order: list[str], urls: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (id, gid, o, m), groups (gid, m, first, last), and pairs (u, v, tie, um, vm) of
    groups that are similar, of different sources and near in time, u the better one. With ``urls``
    they are of the rows that urls leave. Texts are cut first, so that none is shuffled."""
    columns = [F.col(c) for c in dict.fromkeys(["id", "source", "url", "resolved_at", *order])]
    every, sets = token_sets(rows, "question", 3, [*columns, standing(ranks).alias("q")], bare=True)
    first = written((url_arbitration(every, ranks) if urls else every).where("resolved_at is not null"))
    base = with_place(first, order).where("key is not null").select("id", "source", F.col("resolved_at").alias("day"), "m", "o", "q", "key")
    gid = F.unhex(F.sha2(F.to_json(F.struct(F.hex("key").alias("key"), "source", "day", "q")), 256))
    members = written(base.withColumn("gid", gid))
    groups = written(members.groupBy("gid", "key", "source", "day", "m", "q").agg(F.min("o").alias("first"), F.max("o").alias("last")))
    near = either_way(similar_sets(sets, threshold), sets).select("x", "y")
    other = groups.select(F.col("key").alias("y"), F.col("gid").alias("v"), F.col("source").alias("_source"), F.col("day").alias("_day"), F.col("m").alias("vm"), F.col("q").alias("_q"), F.col("first").alias("_first"))
    met = near_in_time(groups.join(near, groups.key == near.x).drop("x"), other, ["y"], "day", "_day", window_days)
    tie = F.col("q") == F.col("_q")
    better = (F.col("q") < F.col("_q")) | (tie & (F.col("first") < F.col("_first")))
    pairs = met.where((F.col("source") != F.col("_source")) & (F.abs(F.col("m") - F.col("vm")) <= 1) & better)
    return members.select("id", "gid", "o", "m"), groups.select("gid", "m", "first", "last"), written(pairs.select(F.col("gid").alias("u"), "v", tie.alias("tie"), F.col("m").alias("um"), "vm"))


def _decide(pairs: DataFrame, known: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(gid, a, t, same, next, top) of the groups in ``pairs`` whose better neighbours are all in
    ``known``: the places A, T, F of the own and the next month, and the last place from which
    its rows are still there for others."""
    got = pairs.join(known.select(F.col("gid").alias("u"), F.lit(True).alias("there"), "same", "next", "top"), "u", "left")
    before = F.when(F.col("um") == F.col("vm"), F.col("same")).when(F.col("um") < F.col("vm"), F.col("next"))
    behind = F.when(~F.col("tie") & (F.col("um") >= F.col("vm")), F.col("top"))
    own = F.when(~F.col("tie") & (F.col("um") == F.col("vm")), F.col("top"))
    sums = got.groupBy(F.col("v").alias("gid")).agg(F.count_if(F.col("there").isNull()).alias("missing"), F.min(before).alias("a"), F.max(behind).alias("t"), F.max(own).alias("own"))
    ready = sums.where("missing = 0").join(groups, "gid").drop("missing")
    free = F.col("a").isNull() | (F.col("first") < F.col("a"))
    top = F.when(F.col("a").isNotNull(), F.least("last", "a")).otherwise(F.col("last"))
    plain = F.col("own").isNull() | (F.col("m") == 0)
    ready = ready.withColumns({"same": F.when(free, F.col("first")), "top": top, "plain": plain})
    # The first row that did not go in its own month.
    late = ready.where("not plain").select("gid", "a", "own").join(members.select("gid", "o"), "gid")
    late = late.where((F.col("o") > F.col("own")) & (F.col("a").isNull() | (F.col("o") < F.col("a")))).groupBy("gid").agg(F.min("o").alias("late"))
    out = ready.join(late, "gid", "left")
    return out.select("gid", "a", "t", "same", F.when(F.col("plain"), F.col("same")).otherwise(F.col("late")).alias("next"), "top")


def losers(rows: DataFrame, order: list[str], threshold: float = 0.7, window_days: int = 14, ranks: dict[str, int] = PRIORITY, urls: bool = False) -> DataFrame:
    """Ids of the rows that go, with ``urls`` of those that urls leave."""
    spark = rows.sparkSession
    members, groups, pairs = _groups(rows, threshold, window_days, ranks, order, urls)
    # Groups without a better neighbour drop whatever they meet and lose nothing.
    free = pairs.select(F.col("u").alias("gid")).distinct().join(pairs.select(F.col("v").alias("gid")), "gid", "left_anti").join(groups, "gid")
    none = F.lit(None).cast(groups.schema["first"].dataType)
    known, path = written_at(free.select("gid", none.alias("a"), none.alias("t"), F.col("first").alias("same"), F.col("first").alias("next"), F.col("last").alias("top")))
    while True:
        left = pairs.join(known.select(F.col("gid").alias("v")), "v", "left_anti")
        if left.isEmpty():
            break
        to = new_path(spark)
        with own_tables(spark):
            known.unionByName(_decide(left, known, groups, members)).write.parquet(to)
        known = spark.read.schema(known.schema).parquet(to)
        remove(spark, path)
        path = to
    hit = members.join(known.where("a is not null or t is not null").select("gid", "a", "t"), "gid")
    return hit.where((F.col("a").isNotNull() & (F.col("o") > F.col("a"))) | (F.col("t").isNotNull() & (F.col("o") < F.col("t")))).select("id").distinct()


def deduplicate_in_order(rows: DataFrame, order: list[str], threshold: float = 0.7, window_days: int = 14, ranks: dict[str, int] = PRIORITY) -> DataFrame:
    """Rows that stay, by resolution date and id, where pairs are visited in the order of input,
    which the columns ``order`` give; they must tell rows apart. Rows without resolution date stay;
    rows without tokens are similar to none; pairs are of one month or of two that follow
    each other among those that occur."""
    return url_arbitration(rows, ranks).join(losers(rows, order, threshold, window_days, ranks, urls=True), "id", "left_anti").orderBy("resolved_at", "id")


def without_losers(first: DataFrame, order: list[str], threshold: float = 0.7, window_days: int = 14, ranks: dict[str, int] = PRIORITY) -> DataFrame:
    """The second pass alone: of rows that urls were judged of, those that similar ones leave."""
    gone = losers(first, order, threshold, window_days, ranks)
    return first.join(gone, "id", "left_anti")
