"""Connected components of a link table, by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): the smallest node of its component for every node of the links (a, b: long).

    A large star links every larger neighbour of a node to the least of its neighbourhood, a small star the node and its
    smaller neighbours. Both are aggregates with partial sums and one join; when a round changes nothing, the links are
    stars around the roots.
    """
    now = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    step = 0
    while True:
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # aggregates are written before they are joined: a join of two plain exchanges can be split where a star's centre is hot
        least = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}{step}m")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.save(large.where("a <> b").distinct(), f"{name}{step}l")
        least = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}{step}s")
        paired = large.join(least, "a")
        small = paired.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = scratch.save(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}{step}")
        scratch.drop(*(f"{name}{step}{x}" for x in "lms"), *([f"{name}{step - 2}"] if step > 1 else []))
        changed = _mark(now) != _mark(after)
        now = after
        if not changed:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.bit_xor(F.xxhash64("b", "a"))).first())
