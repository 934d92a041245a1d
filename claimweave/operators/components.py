"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.runtime import spread_join, stash


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, label: str = "cc") -> DataFrame:
    """(id, component): the least vertex each vertex of an edge is linked to, directly or through others.

    Alternates two steps (Kiveris et al., "Connected components in MapReduce and beyond", 2014) until nothing changes: every
    vertex links its larger neighbours to the least of its neighbourhood, then its smaller ones and itself. Chains shrink
    geometrically, and no step makes more edges than there were. Null ends and self-links add nothing. Minima are combined
    before the shuffle and reach the edges of hot vertices by broadcast (spread_join), so that no task gathers those.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).toDF("u", "v", "ok")
    now = stash(pairs.where("ok").select("u", "v").distinct(), label + "-0")
    was = None
    for k in range(1, rounds + 1):
        n, mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, mark) == was:
            members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return members.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        was = (n, mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = stash(spread_join(both.where("v > u"), near, "u", 2 * n, f"{label}-n{k}").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{label}-l{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = spread_join(large, least, "u", n, f"{label}-m{k}").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stash(met.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{label}-{k}")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
