"""Connected components of a table of edges, in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, lookup, save


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in edges, saved; component is the smallest node that edges reach.

    Each round every node points to its smallest neighbour, pointers are followed to their ends, and edges move to where
    their nodes' pointers end. Nodes only ever point to smaller ones of their own component, so a round never splits or
    joins wrongly, and the rounds end when no edge joins two different nodes. A step doubles how far pointers reach, and a
    round leaves at most half the nodes that still have edges, so a chain of n nodes, however it is numbered, takes about
    log(n) rounds of log(n) steps at most, and a star one of each. A node with many edges, as the centre of a star, is
    pre-aggregated where its smallest neighbour is sought, and where pointers are looked up its rows are dealt out
    (``lookup``).
    """
    with Steps(edges.sparkSession) as steps:
        edges = save(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
        points = None
        while not edges.isEmpty():
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("to"))
            least = _ended(save(least, "least"))
            one = least.select(F.col("node").alias("a"), F.col("to").alias("ta"))
            two = least.select(F.col("node").alias("b"), F.col("to").alias("tb"))
            moved = lookup(lookup(edges, one, ["a"]), two, ["b"])
            moved = moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a <> b").distinct()
            points = least if points is None else save(_followed(points, least), "points")
            edges = save(moved, "edges")
        out = edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if points is None else points.withColumnRenamed("to", "component")
        return steps.keep(out, "components")


def _ended(points: DataFrame) -> DataFrame:
    """points, a saved table that has all nodes, each followed until it ends at a node that points to itself."""
    while True:
        then = points.select(F.col("node").alias("to"), F.col("to").alias("then"))
        further = save(lookup(points, then, ["to"]).select("node", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved")), "least")
        points = further.select("node", "to")
        if further.filter("moved").isEmpty():
            return points


def _followed(points: DataFrame, by: DataFrame) -> DataFrame:
    """(node, to), each pointer followed once more, by pointers (a saved table) that needn't have all nodes."""
    then = by.select(F.col("node").alias("to"), F.col("to").alias("then"))
    return lookup(points, then, ["to"], "left").select("node", F.coalesce("then", "to").alias("to"))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1: the smallest node that the edges a, b reach."""
    label = np.arange(n)
    while len(a):
        # only roots move, or a node would leave what it was joined with before
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
