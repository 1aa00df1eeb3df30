"""Duplicates between sources: by url, then by wording within a window of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augur.functions.text import canonical_url
from augur.operators.similarity import either_way, near_in_time, similar_sets, token_sets
from augur.sources.shared import written

#: Sources from the most to the least trusted.
PRIORITY = {"mantic_q2_aib": 0, "metaculus": 1, "polymarket": 2, "manifold": 3, "forecastbench": 4}


def priority(source: Column, ranks: dict[str, int] = PRIORITY) -> Column:
    out = F.lit(99)
    for name, rank in ranks.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def url_arbitration(rows: DataFrame, ranks: dict[str, int] = PRIORITY) -> DataFrame:
    """Of rows whose canonical url occurs in several sources, those of the best source stay;
    rows without url, and urls of one source, stay whole. A url's best source is found by
    aggregation, so a url that very many rows share is reduced before the shuffle; rows
    without url join on a key of their own, as nulls would all meet in one task."""
    keyed = rows.withColumn("_url", canonical_url(F.col("url"))).withColumn("_p", F.struct(priority(F.col("source"), ranks).alias("rank"), F.col("source").alias("source")))
    best = keyed.where("_url is not null").groupBy("_url").agg(F.min("_p").alias("_best"), F.max("_p").alias("_worst")).where("_best <> _worst").select("_url", "_best")
    own = F.coalesce("_url", F.concat(F.lit("\0"), F.xxhash64("id").cast("string")))
    kept = keyed.withColumn("_url", own).join(best, "_url", "left").where("_best is null or _p.source = _best.source")
    return kept.select(*rows.columns)


def similar_pairs(rows: DataFrame, threshold: float = 0.7, min_len: int = 3, text: str = "question", same: tuple[str, ...] = (), window_days: int | None = None, date: str = "resolved_at") -> DataFrame:
    """(a, b, similarity): ids of different sources whose token sets have a Jaccard similarity of
    at least ``threshold``, agreeing in the columns ``same`` and within ``window_days``. Every
    pair of rows is given out; :func:`similar_links` counts them instead."""
    extra = [*same, *([date] if window_days is not None else [])]
    base, sets = token_sets(rows, text, min_len, [F.col(c) for c in ("id", "source", *extra)])
    left = base.join(either_way(similar_sets(sets, threshold), sets), base.key == F.col("x")).drop("key", "x")
    right = base.select(F.col("id").alias("b"), F.col("source").alias("_source"), F.col("key").alias("y"), *same, *([F.col(date).alias("_day")] if window_days is not None else []))
    met = left.join(right, ["y", *same]) if window_days is None else near_in_time(left, right, ["y", *same], date, "_day", window_days)
    return met.where("source < _source").select(F.col("id").alias("a"), "b", "similarity")


def similar_links(rows: DataFrame, threshold: float = 0.7, min_len: int = 3, text: str = "question", same: tuple[str, ...] = ()) -> DataFrame:
    """(id, class_id, n_links) of every row: the smallest id of the rows with its token set, and
    the number of rows of other sources that are similar and agree in ``same``. Rows are added up
    by set, source and ``same`` before they meet, so equal rows are never paired. Rows without
    tokens are classes of their own, without links."""
    base, sets = token_sets(rows, text, min_len, [F.col(c) for c in ("id", "source", *same)])
    gid = F.unhex(F.sha2(F.to_json(F.struct(F.hex("key").alias("key"), "source", *same)), 256))
    base = written(base.withColumn("gid", gid))
    groups = base.groupBy("gid", "key", "source", *same).agg(F.count("*").alias("n"))
    near = either_way(similar_sets(sets, threshold), sets).select("x", "y")
    other = groups.select(F.col("key").alias("y"), F.col("source").alias("_source"), *same, F.col("n").alias("_n"))
    links = groups.join(near, groups.key == near.x).drop("x").join(other, ["y", *same]).where("source <> _source").groupBy("gid").agg(F.sum("_n").alias("n_links"))
    classes = base.groupBy("key").agg(F.min("id").alias("class_id"))
    known = groups.select("gid", "key").join(links, "gid", "left").join(classes, "key").drop("key")
    found = base.join(known, "gid").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    bare = rows.select("id").join(base.select("id"), "id", "left_anti")
    return found.unionByName(bare.select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def quality_order(ranks: dict[str, int] = PRIORITY) -> Column:
    """Smaller is better: source, then more background, criteria and categories, then the id."""
    n = lambda c: -F.coalesce(F.length(c), F.lit(0))
    return F.struct(priority(F.col("source"), ranks).alias("rank"), n("background").alias("bg"), n("resolution_criteria").alias("rc"), (-F.greatest(F.size("categories"), F.lit(0))).alias("cats"), F.col("id").alias("id"))


def deduplicate(rows: DataFrame, threshold: float = 0.7, window_days: int = 14, ranks: dict[str, int] = PRIORITY) -> DataFrame:
    """Rows that stay, by resolution date and id. A row goes if a similar one of another source
    is better in ``quality_order``; the rule looks at all pairs and not at an order of visits.
    Pairs are formed of groups of equal token set, source and date, by their best rows, so
    that many equal questions cost no more than one."""
    return url_arbitration(rows, ranks).join(_losers(rows, threshold, window_days, ranks), "id", "left_anti").orderBy("resolved_at", "id")


def _losers(rows: DataFrame, threshold: float, window_days: int, ranks: dict[str, int]) -> DataFrame:
    """Of the rows that urls leave. Urls are judged once texts are cut, so that no text is shuffled."""
    columns = [F.col("id"), F.col("source"), F.col("url"), F.col("resolved_at").alias("day"), quality_order(ranks).alias("o")]
    every, sets = token_sets(rows, "question", 3, columns, bare=True)
    base = written(url_arbitration(every, ranks).where("key is not null"))
    groups = written(base.groupBy("key", "source", "day").agg(F.min("o").alias("best")))
    near = either_way(similar_sets(sets, threshold), sets).select("x", "y")
    other = groups.select(F.col("key").alias("y"), F.col("source").alias("_source"), F.col("day").alias("_day"), F.col("best").alias("_best"))
    met = near_in_time(groups.join(near, groups.key == near.x).drop("x"), other, ["y"], "day", "_day", window_days).where("source <> _source")
    rival = met.groupBy("key", "source", "day").agg(F.min("_best").alias("_best"))
    return base.join(rival, ["key", "source", "day"]).where("_best < o").select("id").distinct()


def dedupe_stats(rows: DataFrame, threshold: float = 0.7, window_days: int = 14, ranks: dict[str, int] = PRIORITY) -> DataFrame:
    """One row: input, url_duplicates_dropped, text_duplicates_dropped, kept."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    first = written(url_arbitration(rows, ranks).select("id"))
    kept = first.join(_losers(rows, threshold, window_days, ranks), "id", "left_anti")
    row = n(rows, "input").join(n(first, "first"), F.lit(True)).join(n(kept, "kept"), F.lit(True))
    return row.select("input", (F.col("input") - F.col("first")).alias("url_duplicates_dropped"), (F.col("first") - F.col("kept")).alias("text_duplicates_dropped"), "kept")


def greedy_losers(pairs: list[tuple[str, str]], order: dict[str, tuple]) -> set[str]:
    """A sequential replay over pairs in order of visits, for comparison on small inputs: a pair
    is skipped once either side is gone, and otherwise drops its worse side."""
    gone: set[str] = set()
    for a, b in pairs:
        if a not in gone and b not in gone:
            gone.add(b if order[a] <= order[b] else a)
    return gone


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
