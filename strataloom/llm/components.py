"""Connected components of a table of links, without gathering links or members anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import checkpointed

#: Links that one task contracts at once (two longs each).
TASK_LINKS = 200_000


def contract(batches):
    """Links of one partition as stars: every node is linked with the smallest node that it reaches here."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, dtype=np.int64, count=len(parent))
    roots = np.fromiter((find(x) for x in list(parent)), dtype=np.int64, count=len(parent))
    keep = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["u", "v"])


def component_labels(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """u, v: every linked node u that isn't the smallest of its component, with that smallest node v.

    links: two long columns, in any order, repeats allowed. Partitions contract their own links to stars, again and again as long as that leaves far fewer;
    what fits one task (TASK_LINKS) is then settled by one. If more are left, large-star
    and small-star steps (each a minimum for each node and one join) alternate until nothing changes. Every round is
    written to the shared folder.
    """
    first, second = links.columns
    edges = checkpointed(links.select(F.col(first).alias("u"), F.col(second).alias("v")).where("u <> v"))
    n, before = edges.count(), None
    while n > TASK_LINKS and (before is None or n < 0.7 * before):
        # dealt by both ends, so that no large star lies in one task, and with a salt, so that other links come together each time
        edges = checkpointed(edges.repartition(-(-n // TASK_LINKS), F.xxhash64("u", "v", F.lit(n))).mapInArrow(contract, "u long, v long").distinct())
        n, before = edges.count(), n
    if n <= TASK_LINKS:
        return checkpointed(edges.coalesce(1).mapInArrow(contract, "u long, v long"))
    state = None
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return edges
        state = now
        # large star: a node's larger neighbours go to the smallest of itself and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: its smaller neighbours and the node itself go to the smallest of them
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError("components did not settle")
