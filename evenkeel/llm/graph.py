"""Connected components of links between 64-bit node names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import drop_scratch, write_scratch


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the smallest node it can reach, for every node of a link (``a``, ``b``).

    By contraction: every node takes the name of its smallest neighbour, or of
    that one's smallest neighbour, if that is smaller than its own. Links are then renamed, and those
    inside one name and doubles go. What is left is a graph of fewer nodes, to
    which the same is done until no link is left. The smallest node of a component
    never changes its name, so it is the last one. The names of all rounds are
    then followed from the last round back to the first.

    Every round is a written table of its own; tables nothing reads again are deleted.
    Cases: a link of a node with itself gives the node alone; doubles and both
    directions of a link are one; an empty table gives an empty one.
    """
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    left = write_scratch(_once(links, "a", "b"), "links")
    rounds = []
    while left.limit(1).count():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("near")))
        near = write_scratch(both.groupBy("node").agg(F.min("near").alias("near")).select(
            "node", F.least("node", "near").alias("name")), "near")
        further = near.select(F.col("node").alias("name"), F.col("name").alias("next"))
        names = write_scratch(near.join(further, "name").select(
            "node", F.least("name", "next").alias("name")), "names")
        drop_scratch(near)
        rounds.append(names)
        a = names.select(F.col("node").alias("a"), F.col("name").alias("x"))
        b = names.select(F.col("node").alias("b"), F.col("name").alias("y"))
        less = write_scratch(_once(left.join(a, "a").join(b, "b"), "x", "y"), "links")
        drop_scratch(left)
        left = less
    if not rounds:
        return nodes.select("node", F.col("node").alias("comp"))
    comp = rounds.pop().withColumnRenamed("name", "comp")
    while rounds:
        last = comp.withColumnRenamed("node", "name")
        # a name without links in the next round is the name of its component
        comp = rounds.pop().join(last, "name", "left").select("node", F.coalesce("comp", "name").alias("comp"))
        comp = write_scratch(comp, "components")
    loops = links.filter("a = b").select(F.col("a").alias("node")).distinct()
    alone = loops.join(comp, "node", "left_anti").select("node", F.col("node").alias("comp"))
    return comp.unionByName(alone)


def _once(links: DataFrame, a: str, b: str) -> DataFrame:
    """Each link between different nodes once, the smaller node first."""
    return links.filter(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
