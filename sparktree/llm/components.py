"""Connected components of a link table, as DataFrame rounds.

Each round every node takes the smallest label among its neighbours, then the label
of its label, in one job that also counts the labels that changed. Labels are written to the shared folder after each round, so that
nothing is recomputed if an executor is lost, and both sides of the label joins are
plain shuffles that Spark splits where a label is common.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialize


def joined(label: np.ndarray, pairs) -> np.ndarray:
    """``label`` (the smallest node of each node's group) after joining ``pairs``, an
    iterable of index arrays."""
    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable from each node of ``links``."""
    both = materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        seen = both.join(labels, both.u == labels.node).groupBy("v").agg(F.min("label").alias("least"))
        nearer = labels.join(seen, labels.node == seen.v, "left").select("node", F.least("label", "least").alias("label"), F.col("label").alias("old"))
        up = nearer.select(F.col("node").alias("above"), F.col("label").alias("further"))
        moved = Observation()
        jumped = nearer.join(up, nearer.label == up.above).select("node", F.col("further").alias("label"), "old").observe(moved, F.count(F.when(F.col("label") != F.col("old"), 1)).alias("n"))
        labels = materialize(jumped.select("node", "label"), "labels")
        if not moved.get["n"]:
            return labels
