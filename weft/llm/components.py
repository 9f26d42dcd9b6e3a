"""Connected components of an edge table too large for one machine.

Each partition first runs union-find over its own edges and hands on one edge per node, to its local
root. Then the graph is contracted in rounds: each node moves to the neighbour (or itself) of least
random rank, which at least halves the nodes in expectation; each round draws new ranks. The maps of
the rounds, composed, give each node its root. All of it is joins and grouped minima. A node of very
many edges is folded by partial aggregation before a grouped shuffle, and dealt out to several tasks in
a join; so is a root of very many nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.skew import hot_keys, hot_keys_of, salted_join
from weft.runtime import materialize


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: (node, root) for each node that isn't a root."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    kind = None
    for batch in batches:
        kind = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if kind is not None:
        rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
        cols = [pa.array([r[i] for r in rows], kind.field(i).type) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(cols, names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v of one type); equal root, same component.

    No edges give no rows. Loops and repeated edges do no harm.
    """
    pairs = edges.select("u", "v").filter("u <> v")
    forest = pairs.mapInArrow(local_forest, pairs.schema)
    e, step, roots = materialize(forest, "forest"), 0, None
    while not e.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(step), c).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.select("u", rank("v").alias("best")).groupBy("u").agg(F.min("best").alias("best"), F.count("*").alias("edges"))
        moved = materialize(near.select("u", F.least(rank("u"), F.col("best"))["node"].alias("to"), "edges"), f"moved{step}")
        hot = hot_keys(moved, "u", "edges", 2 * e.count())
        at = lambda c, to: moved.select(F.col("u").alias(c), F.col("to").alias(to))  # noqa: B023, E731
        e = materialize(
            salted_join(salted_join(e, at("u", "a"), "u", hot, ["v"]), at("v", "b"), "v", hot.withColumnRenamed("u", "v"), ["u"])
            .filter("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(),
            f"edges{step}",
        )
        if roots is None:
            roots = at("node", "root")
        else:
            met = salted_join(roots, at("root", "next"), "root", hot_keys_of(roots, "root"), ["node"], "left")
            roots = materialize(met.select("node", F.coalesce("next", "root").alias("root")), f"roots{step}")
        step += 1
    if roots is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
