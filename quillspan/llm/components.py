"""Connected components of a large link table by alternating stars.

Each round costs two shuffles of the links, is written to the shared folder and converges
in about log(longest path) rounds. Minima are taken with map-side combining and joined
back, so a node with a third of all links is one combined row per task, and the join's
hot side can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import stage


def _state(links: DataFrame) -> tuple:
    got = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
    return tuple(got)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link to another node; component is the smallest node reachable.

    Null ends, self links and repeated links are ignored; no link gives an empty result.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    pairs = stage(pairs.distinct(), "links")
    before = _state(pairs)
    while before[0]:
        pairs = stage(_small_star(_large_star(pairs)), "stars")
        after = _state(pairs)
        if after == before:
            break
        before = after
    own = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(own)
