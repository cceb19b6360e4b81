"""Connected components of a graph, by least label with shortcuts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, release, staged

#: Graphs of up to this many edges are solved in one task; larger ones in rounds. Both give the least labels.
ONE_TASK = 200_000


def _solve(batches):
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([root(x) for x in nodes])], names=["node", "label"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges: a, b (long or string). One row a node that has an edge: node, label, the least node of its component.

    A graph of ONE_TASK edges or fewer, by count, is solved by union-find in one task. Of a larger one each round sends labels over the edges and then lets every node take the label of its label, so
    stars and chains shrink geometrically. Messages to a node are reduced before the shuffle (least of
    a task), and both sides of each join are staged tables, so a hub's rows can be split over tasks.
    """
    kind = edges.schema["a"].dataType
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = staged(pairs, f"{name}_pairs")
    if pairs.count() <= ONE_TASK:
        schema = T.StructType([T.StructField("node", kind), T.StructField("label", kind)])
        labels = staged(pairs.coalesce(1).mapInArrow(_solve, schema), f"{name}_labels")
        discard(pairs)
        return labels
    both = staged(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))), f"{name}_edges")
    labels = staged(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}_labels")
    while True:
        sent = both.join(labels, both.src == labels.node).select(F.col("dst").alias("node"), F.col("label").alias("m"))
        least = staged(labels.withColumnRenamed("label", "m").select("node", "m", F.col("m").alias("old")).unionByName(sent.select("node", "m", F.lit(None).cast(kind).alias("old"))).groupBy("node").agg(F.min("m").alias("label"), F.max("old").alias("old")), f"{name}_sent")
        up = least.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = staged(least.join(up, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"), "old"), f"{name}_labels")
        changed = jumped.where("label <> old").limit(1).count()
        discard(labels)
        discard(least)
        labels = jumped
        if not changed:
            release(edges.sparkSession)
            return labels.select("node", "label")
