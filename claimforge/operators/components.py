"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.operators.storage import materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    Each round groups by node with a partial minimum and joins that minimum back; both sides
    of the join are plain exchanges, so a hub that holds a large share of the edges is split
    by adaptive execution. The number of rounds grows with the logarithm of the longest
    chain. Nothing is collected but one count and checksum a round. Null ends and loops
    are dropped; an empty input gives an empty result. Repeated edges count once. When
    ``max_rounds`` is not enough an error is raised, never a partial answer. A round's tables are
    deleted as soon as the next one's are written.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    current = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    before = None
    for _ in range(max_rounds):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        large = _large_star(current)
        release(current)
        current = _small_star(large)
        release(large)
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-large")
    out = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _written(out.distinct(), least)


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _written(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), least)


def _written(edges: DataFrame, done: DataFrame) -> DataFrame:
    out = materialize(edges, "cc-edges")
    release(done)
    return out
