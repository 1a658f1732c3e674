"""Connected components of links by contraction: a constant share of the nodes goes in every round, whatever the links look like."""
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.session import settled


def connected_components(links: DataFrame, a="a", b="b") -> DataFrame:
    """(node, component): every node of the links with the smallest node of its component.

    In a round every node joins the neighbour (or itself) that comes first in a random order of the round, two steps along; links inside
    merged nodes vanish. The expected number of rounds grows with the logarithm of the nodes, also for long chains. Moves and remaining
    links are settled tables, whose sizes the planner knows: estimates kept by checkpoints would triple their digits in the driver with every
    round. Moves are put together from the last one on, a join per plan; nothing but "any links left?" reaches the driver.
    """
    edges = settled(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct())
    moves = []
    while not edges.isEmpty():
        def order(node):
            return F.struct(F.xxhash64(F.lit(len(moves)), node).alias("place"), node.alias("node"))

        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        step = both.groupBy("a").agg(F.least(F.min(order(F.col("b"))), order(F.col("a")))["node"].alias("to")).select(F.col("a").alias("node"), "to")
        twice = settled(step.alias("x").join(step.alias("y"), F.col("x.to") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.to").alias("to")))
        edges = settled(edges.join(twice.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(twice.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
                        .filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        moves.append(twice)
    labels = moves.pop() if moves else edges.select(F.col("a").alias("node"), F.col("b").alias("to"))
    while moves:   # the first move has every node of the links
        later = labels.select(F.col("node").alias("to"), F.col("to").alias("root"))
        labels = settled(moves.pop().join(later, "to", "left").select("node", F.coalesce("root", "to").alias("to")))
    labels = labels.select("node", F.col("to").alias("root"))
    least = settled(labels.groupBy("root").agg(F.min("node").alias("component")))   # a shuffle of its own: the join can be split at a large component
    return labels.join(least, "root").select("node", "component")


def united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parents (each pointing at a root) after joining the roots of linked rows."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
