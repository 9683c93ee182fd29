"""Connected components of a distributed list of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import stage


LOCAL_LINKS = 4_000_000  # links (64 MB) that one task contracts by itself


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node with the smallest node of its component: labels fall to neighbours' and to their own until none does."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[:a.size], place[a.size:]
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (further := new[new] < new).any():
            new[further] = new[new[further]]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for every node of ``links`` (a, b: long).

    Distinct links are written and counted. Up to ``LOCAL_LINKS`` are contracted by one task. More are
    contracted in rounds: a node takes the least label among its neighbours, then its label's own
    label; rounds grow with the logarithm of the longest path. Rounds are written to the shared
    folder, so a lost executor costs no earlier round; nothing but counts reaches the driver.
    """
    one_way = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if one_way.limit(LOCAL_LINKS + 1).count() <= LOCAL_LINKS:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
            if parts:
                node, label = contract(*(np.concatenate(c) for c in zip(*parts)))
                yield pa.RecordBatch.from_pydict({"node": pa.array(node), "label": pa.array(label)})

        return stage(one_way.coalesce(1).mapInArrow(run, "node long, label long"), "labels")
    return _rounds(one_way)


def _rounds(one_way: DataFrame) -> DataFrame:
    both = stage(one_way.union(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = new.join(jump, "label").select("node", "old", F.least("label", "further").alias("label"))
        new = stage(new, "labels")
        labels = new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            return labels
