"""Stratified splits with exact counts, decided by hashes instead of a generator's state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augur.functions.dates import stratify_key
from augur.sources.shared import written

#: Prefixes under which one platform's questions may be known.
TWINS = ("metaculus::", "mantic_q2_aib::")

#: Bits of the hash that make a range.
RANGES = 14


@dataclass(frozen=True)
class SplitConfig:
    train_frac: float = 0.8
    val_frac: float = 0.1
    seed: int = 17
    stratify_by: str = "resolved_month"


def split_ids(questions: DataFrame, config: SplitConfig = SplitConfig(), fixed_test: DataFrame | None = None) -> DataFrame:
    """(id, split): in every stratum the ids in order of md5(seed::stratum::id) are cut at
    round(n * train) and round(n * val), halves to even; listed ids go to test at once, under
    any of their twin prefixes.

    The cuts are found in counts by range of the hash, one row a stratum, which is broadcast. Ids in
    other ranges are placed by their range alone, and only those of the two ranges in
    which a cut falls are sorted; a range has about one in 2^14 of a stratum's ids."""
    rows = questions.select("id", stratify_key(F.col("resolved_at"), config.stratify_by).alias("bucket")).distinct()
    fixed = None
    if fixed_test is not None:
        bare = F.regexp_replace("id", "^(" + "|".join(TWINS) + ")", "")
        listed = fixed_test.select(bare.alias("_bare")).distinct()
        marked = written(rows.withColumn("_bare", bare))
        fixed = marked.join(listed, "_bare", "left_semi").select("id", F.lit("test").alias("split"))
        rows = marked.join(listed, "_bare", "left_anti").drop("_bare")
    hashed = F.md5(F.concat_ws("::", F.lit(str(config.seed)), "bucket", "id"))
    place = F.shiftright(F.conv(F.substring("h", 1, 4), 16, 10).cast("int"), 16 - RANGES)
    rows = written(rows.withColumn("h", hashed).withColumn("b", place))
    out = place_by_ranges(rows, [config.train_frac, config.val_frac]).select("id", F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), F.col("part") + 1).alias("split"))
    return out if fixed is None else out.unionByName(fixed)


def place_by_ranges(rows: DataFrame, fractions: list[float]) -> DataFrame:
    """``rows`` (id, bucket, h, b) with ``part``: 0 for the first round(n * fractions[0]) of a
    bucket's rows by h, then id, 1 for the next round(n * fractions[1]), and so on; what is left
    is the last part. ``b`` is a range of h, in its order. Null buckets are a bucket."""
    by_bucket = Window.partitionBy("bucket")
    ranges = rows.groupBy("bucket", "b").agg(F.count("*").alias("c"))
    ranges = ranges.withColumn("below", F.sum("c").over(by_bucket.orderBy("b")) - F.col("c")).withColumn("n", F.sum("c").over(by_bucket))
    ends, up_to = [], F.lit(0)
    for f in fractions:
        up_to = up_to + F.bround(F.col("n") * F.lit(f)).cast("long")
        ends.append(up_to)
    # The range in which each cut falls, and the rows below it; behind all ranges if the cut is behind all rows.
    last = F.struct(F.lit(1 << 30).alias("b"), F.lit(0).cast("long").alias("below"))
    at = [F.coalesce(F.min(F.when(F.col("below") + F.col("c") >= F.col(f"k{i}"), F.struct("b", "below"))), last).alias(f"at{i}") for i in range(len(ends))]
    cuts = ranges.withColumns({f"k{i}": k for i, k in enumerate(ends)}).groupBy("bucket", *(f"k{i}" for i in range(len(ends)))).agg(*at)
    met = rows.alias("r").join(F.broadcast(cuts).alias("c"), F.col("r.bucket").eqNullSafe(F.col("c.bucket"))).select("r.*", *(f"c.k{i}" for i in range(len(ends))), *(f"c.at{i}" for i in range(len(ends))))
    on_cut = F.lit(False)
    for i in range(len(ends)):
        on_cut = on_cut | (F.col("b") == F.col(f"at{i}.b"))
    count = lambda beyond: sum((beyond(i).cast("int") for i in range(len(ends))), F.lit(0))
    clear = met.where(~on_cut).withColumn("part", count(lambda i: F.col("b") > F.col(f"at{i}.b")))
    below = F.coalesce(*(F.when(F.col("b") == F.col(f"at{i}.b"), F.col(f"at{i}.below")) for i in range(len(ends))))
    rank = F.row_number().over(Window.partitionBy("bucket", "b").orderBy("h", "id")) + below
    sharp = met.where(on_cut).withColumn("rank", rank).withColumn("part", count(lambda i: F.col("rank") > F.col(f"k{i}")))
    return clear.select(*rows.columns, "part").unionByName(sharp.select(*rows.columns, "part"))


def overlap(splits: DataFrame) -> DataFrame:
    """Ids in more than one split; must be empty."""
    return splits.groupBy("id").agg(F.count_distinct("split").alias("n")).where("n > 1")
