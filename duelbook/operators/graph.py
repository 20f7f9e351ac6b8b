"""Connected components of many small or large graphs at once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.session import Relay

FOREST_LINKS = 4_000_000  # links of a task that are merged at once


def _forest(links: DataFrame, keys: list[str], most: int = FOREST_LINKS) -> DataFrame:
    """A few links that hold the same nodes together: each task hands on one per node and graph, to the least node it meets.

    A task keeps the nodes of at most ``most`` links; what it has merged by then is handed on and it starts anew.
    """
    links = links.select(*keys, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    n = len(keys)

    def merge(batches):
        graphs, held, schema = {}, 0, None

        def stars():
            for key, head in graphs.items():
                nodes, roots = [], []
                for node in head:
                    root = node
                    while head[root] != root:
                        root = head[root]
                    if root != node:
                        nodes.append(node)
                        roots.append(root)
                if nodes:
                    columns = [pa.array([v] * len(nodes), schema.field(i).type) for i, v in enumerate(key)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], schema=schema)

        for batch in batches:
            schema = batch.schema
            names = [batch.column(i).to_pylist() for i in range(n)]
            for key, a, b in zip(zip(*names), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                head = graphs.get(key)
                if head is None:
                    head = graphs[key] = {}
                a, b = head.setdefault(a, a), head.setdefault(b, b)
                while head[a] != a:
                    head[a] = a = head[head[a]]
                while head[b] != b:
                    head[b] = b = head[head[b]]
                if a < b:
                    head[b] = a
                elif b < a:
                    head[a] = b
            held += batch.num_rows
            if held >= most:
                yield from stars()
                graphs, held = {}, 0
        yield from stars()

    return links.mapInArrow(merge, links.schema)


def components(links: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, node, component)`` for the nodes of ``links (keys, a, b)``; each combination of keys is a graph of its own.

    A component is named by its smallest node.  Each round hands the least neighbour of every node to its larger
    neighbours, then to its smaller ones, so that trees flatten to stars in rounds that grow with the logarithm of the
    longest path.  Rounds are written in turn to two folders under the shared folder; least neighbours are combined
    before they are shuffled, and a node with very many links is a small row after that.  Before the first round each
    task leaves no more links than nodes, so the rounds grow with the nodes, not with the links.
    """
    relay = Relay(links.sparkSession, "components")
    edges = _forest(links.where("a <> b"), keys).distinct()
    lonely = links.where("a = b").select(*keys, "a", "b")
    edges, mark = relay.keep(edges), None
    while mark != (mark := _mark(edges, keys)):
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.min("b").alias("low"))
        large = both.where("b > a").join(least, [*keys, "a"]).select(
            *keys, F.col("b").alias("a"), F.least("a", "low").alias("b")).where("a <> b").distinct()
        low = large.groupBy(*keys, "a").agg(F.min("b").alias("low"))
        small = large.join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = relay.keep(small.unionByName(low.withColumnRenamed("low", "b")).distinct())
    stars = edges.unionByName(lonely).unionByName(edges.select(*keys, F.col("b").alias("a"), "b"))
    return stars.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _mark(edges: DataFrame, keys: list[str]) -> tuple:
    """What changes whenever the links change."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first())
