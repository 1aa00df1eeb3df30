"""URL filters by cascades of Bloom filters, in DataFrame functions only.

A rule is a host and a path; its key is the two joined. For every url the keys that a rule
could have are enumerated: its host's suffixes with as many labels as rules have, each
with the url's path cut to the lengths that rule paths have. All of them, over the whole
corpus, are the key universe. A cascade answers exactly for this universe whether a key is
listed: level 0 holds the listed keys, level 1 those other keys of the universe that
level 0 lets pass, level 2 the listed keys that level 1 lets pass, and so on until none
passes wrongly. The first level that rejects a key decides by its parity. Judging is then
a scan without joins; the filters are literals of at most 2 ** POWER[1] bits a level. The
first level is made so sparse that about as many other keys pass it as are listed, however
large the universe is. Lists for which a level would need more bits are joined by key.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm.common import cut

POWER = (6, 24)
HASHES = 3


class TooLong(ValueError):
    """A level would need more bits than a literal may have."""



def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(u, pattern, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(u, pattern, 2)


@dataclass(frozen=True)
class Shape:
    """What candidate keys look like: most labels of a rule's host, lengths of rule paths."""

    labels: int
    lengths: tuple[int, ...]

    def keys(self, host: str, path: str) -> Column:
        if not self.lengths:
            return F.array().cast("array<string>")
        lengths = ", ".join(map(str, self.lengths))
        return F.expr(
            f"""flatten(transform(sequence(1, least({self.labels}, size(split({host}, '[.]', -1)))),
            n -> transform(filter(array({lengths}), l -> length({path}) >= l),
            l -> concat(array_join(slice(split({host}, '[.]', -1), -n, n), '.'), substring({path}, 1, l)))))"""
        )


@dataclass(frozen=True)
class Bloom:
    words: str  # 64-bit words, comma-separated
    power: int
    seed: int

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        out = F.lit(True)
        for place in _places(key, self.power, self.seed):
            word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
            out = out & (word.bitwiseAND(bit) != 0)
        return out


def _places(key: Column, power: int, seed: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(seed * HASHES + i)).bitwiseAND((1 << power) - 1) for i in range(HASHES)]


def bloom(keys: DataFrame, seed: int, wrong: float = 1 / 32, most: int = POWER[1]) -> Bloom | None:
    """A filter of the column ``key`` that passes about a share ``wrong`` of other keys; None
    without keys."""
    n = keys.count()
    if not n:
        return None
    # A share w of set bits lets w ** HASHES pass.
    power = max(POWER[0], math.ceil(math.log2(HASHES * n / -math.log(1 - wrong ** (1 / HASHES)))))
    if power > most:
        raise TooLong(f"{n} keys")
    at = keys.select(F.explode(F.array(*_places(F.col("key"), power, seed))).alias("i"))
    found = at.groupBy(F.shiftright("i", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(i & 63 as int))) as b")).collect()
    words = [0] * ((1 << power) // 64)
    for r in found:
        words[r["w"]] = r["b"]
    return Bloom(",".join(map(str, words)), power, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def lists(self, key: Column) -> Column:
        """Whether ``key``, one of the universe, is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].has(key), i % 2 == 1).otherwise(out)
        return out


def cascade(listed: DataFrame, universe: DataFrame, most: int = POWER[1]) -> Cascade:
    """Levels for distinct ``listed`` keys, exact over ``universe``; columns are ``key``.
    TooLong where a level would need more than 2 ** ``most`` bits."""
    n = listed.count()
    if not n:
        return Cascade(())
    first = bloom(listed, 0, min(1 / 32, n / max(1, universe.count())), most)
    levels = [first]
    own = listed
    other = cut(universe.where(first.has(F.col("key"))).distinct().join(listed, "key", "left_anti"))
    while (level := bloom(other, len(levels), most=most)) is not None:
        # ``other`` passes wrongly; the level tells it from ``own``.
        levels.append(level)
        own, other = other, cut(own.where(level.has(F.col("key"))))
    return Cascade(tuple(levels))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", default: str = "allow", most: int = POWER[1]) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    ``rules``: action (allow or block), host, path. A rule fits its host and all subdomains
    if the url's path starts with the rule's; the longest key wins, and block where a key is
    listed with both actions. Without a rule the verdict is ``default``: the cascades say
    that no key of the url is listed. Null urls have empty host and path; equal rows are
    judged alike; rules without host and nulls in rules are ignored; other columns are not read.
    Urls' hosts are lower-cased within A-Z, rules' hosts in all scripts, so a rule should be
    given with the other letters as urls have them.
    Rules that need filters of more than 2 ** ``most`` bits are found by a join instead.
    """
    rules = rules.where("action in ('allow', 'block') and host <> '' and path is not null").select("action", F.lower("host").alias("host"), "path")
    size = rules.agg(F.max(F.size(F.split("host", "[.]", -1))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    shape = Shape(size["labels"] or 0, tuple(size["lengths"] or ()))
    host, path = split_url(F.col(url))
    df = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    universe = df.select(F.explode(shape.keys("host", "path")).alias("key"))
    listed = cut(rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max(F.col("action") == "block").alias("block"), F.min(F.col("action") == "block").alias("only")))
    longest = lambda keys: F.array_max(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    try:
        allow, block = (cascade(listed.where(c).select("key"), universe, most) for c in ("not only", "block"))
    except TooLong:
        # Of distinct hosts and paths, so that a page that repeats is joined once.
        parts = df.select("host", "path").distinct()
        hits = parts.select("host", "path", F.explode(shape.keys("host", "path")).alias("key")).join(listed, "key")
        best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "block")).alias("b"))
        df = df.join(best.select("host", "path", F.col("b.key").alias("rule"), F.col("b.block").alias("_block")), ["host", "path"], "left")
        return df.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), default).when(F.col("_block"), "block").otherwise("allow").alias("verdict"))
    df = df.withColumn("rule", longest(F.filter(shape.keys("host", "path"), lambda k: allow.lists(k) | block.lists(k))))
    return df.withColumn("verdict", F.when(F.col("rule").isNull(), default).when(block.lists(F.col("rule")), "block").otherwise("allow"))
