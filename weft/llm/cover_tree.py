"""Operator 7, exact top-k inner products by dual-tree search over cover trees.

One shallow cover tree over all data is shared by all tasks: its nodes come from a bounded sample, every
row is dealt to the node of nearest centre, and each node's covering radius and longest vector come from
all of its rows. A few numbers a node, at most NODES nodes, are broadcast. No member of two nodes with
centres q, x and covering radii s, r can score above <q,x> + |q| r + |x| s + r s.

Each query first meets the rows of its SEEDS best nodes, which gives a k-th score to beat. Then a tree of
the queries walks down the nodes: a pair of a query group and a node whose bound is below the group's
worst k-th score is pruned, and only queries are sent to the nodes they still have to see. The rows of a
node lie in parts of about PART bytes, never copied; a task holds one part, builds a cover tree over it,
and walks it with a tree of each batch of queries, starting from their bounds. So what moves is all data
twice and each query once for each part that its bound leaves open, however the vectors lie.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do
null ids. Only vectors of the query's length are candidates; no rows other than those are dropped. A
repeated row is a candidate as often as it occurs; queries that repeat an id and vector are one
query; vectors without components score 0 with each other. Scores are exact integers; beyond the range of a long they are held at its end. Of equal vectors
in a part only those are in its tree that can be among the k best of some query, whatever its own id and
however often that is repeated. An empty table, or no queries, gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.runtime import materialize, table

#: Rows of the sample that gives the nodes' centres, rows for each node, and the most nodes.
SAMPLE, ROWS, NODES = 4096, 2048, 1024
#: Bytes of vectors in a part, and queries that walk a part's tree at once.
PART, QUERIES = 8 << 20, 512
SEEDS, LEAF = 2, 16
#: Most children of a node; points that none of so many centres covers go to the nearest.
FAN = 64
SCALE = 1024


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centres, and how far it is, for each vector."""
    which = np.argmin((c * c).sum(1)[None, :] - 2 * (v @ c.T), axis=1)
    return which, np.sqrt(((v - c[which]) ** 2).sum(1))


class Node:
    """A centre, the radius that covers all points below, points held here, and children.

    Groups of at most ``hold`` points stay in the node itself: more than 0 for data, whose points are
    compared together anyway, 0 for queries, each group of which has a bound of its own.
    """

    __slots__ = ("all", "center", "children", "norm", "norms", "centers", "radii", "points", "radius")

    def __init__(self, v: np.ndarray, center: int, members: np.ndarray, dist: np.ndarray, hold: int):
        self.center, self.radius, self.all = v[center], float(dist.max(initial=0.0)), members
        self.norm = math.sqrt(float(self.center @ self.center))
        self.points, self.children = members, []
        if len(members) > LEAF and self.radius > 0:
            self.split(v, center, members, dist, hold)
        if self.children:
            self.centers = np.stack([c.center for c in self.children])
            self.norms = np.array([c.norm for c in self.children])
            self.radii = np.array([c.radius for c in self.children])

    def split(self, v: np.ndarray, center: int, members: np.ndarray, dist: np.ndarray, hold: int) -> None:
        """Centres more than half the radius apart, each with the points it covers first."""
        reach, loose = self.radius / 2, []
        near = dist <= reach
        groups = [(center, members[near], dist[near])]
        left = members[~near]
        while len(left) and len(groups) < FAN:
            d = np.sqrt(((v[left] - v[left[0]]) ** 2).sum(1))
            near = d <= reach
            groups.append((left[0], left[near], d[near]))
            left = left[~near]
        if len(left):
            which, d = nearest(v[left], v[np.array([c for c, _, _ in groups])])
            groups = [(c, np.concatenate([own, left[which == k]]), np.concatenate([near, d[which == k]])) for k, (c, own, near) in enumerate(groups)]
        for c, own, d in groups:
            if len(own) <= hold:
                loose.append(own)
            else:
                self.children.append(Node(v, c, own, d, hold))
        self.points = np.concatenate(loose) if loose else members[:0]


def tree(v: np.ndarray, hold: int = 4) -> Node:
    return Node(v, 0, np.arange(len(v)), np.sqrt(((v - v[0]) ** 2).sum(1)), hold)


def leaves(root: Node, most: int) -> list[Node]:
    """A cut of the tree of at most ``most`` nodes: the widest is opened first, its fullest children taken.

    Their centres need not cover the sample: every row goes to the nearest of them, and radii follow the rows.
    """
    cut_, done = [root], []
    while cut_:
        cut_.sort(key=lambda n: n.radius)
        wide = cut_.pop()
        room = most - len(cut_) - len(done)
        if wide.children and room > 1:
            cut_ += sorted(wide.children, key=lambda n: -len(n.all))[:room]
        else:
            done.append(wide)
    return done


class Search:
    """k best scores of each query against one part; scores below a query's ``floor`` don't matter."""

    def __init__(self, qid, q, xid, x, k, floor=None):
        self.qid, self.q, self.xid, self.x, self.k = qid, q, xid, x, k
        self.score = np.full((len(q), k), -np.inf)
        self.id = np.full((len(q), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(q), -np.inf) if floor is None else floor
        self.compared = 0

    def compare(self, rows: np.ndarray, cols: np.ndarray) -> None:
        if not len(rows) or not len(cols):
            return
        s = self.q[rows] @ self.x[cols].T
        self.compared += s.size
        s[self.qid[rows][:, None] == self.xid[cols][None, :]] = -np.inf
        hit = s.max(1) >= np.maximum(self.score[rows, -1], self.floor[rows])
        if not hit.any():
            return
        rows, s = rows[hit], s[hit]
        if s.shape[1] > 4 * self.k:  # all that can be among the k best, ties included
            s = np.where(s >= -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1 : self.k], s, -np.inf)
            some = np.flatnonzero(np.isfinite(s).any(0))
            s, cols = s[:, some], cols[some]
        s = np.concatenate([self.score[rows], s], 1)
        i = np.concatenate([self.id[rows], np.broadcast_to(self.xid[cols], (len(rows), len(cols)))], 1)
        best = np.lexsort((i, -s), axis=-1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)

    def worst(self, a: Node) -> float:
        return float(np.maximum(self.score[a.all, -1], self.floor[a.all]).min())

    def walk(self, a: Node, b: Node) -> None:
        if a.children and (not b.children or a.radius > b.radius):
            bound = a.centers @ b.center + a.norms * b.radius + b.norm * a.radii + a.radii * b.radius
            slack = 1e-9 * (a.norms + a.radii) * (b.norm + b.radius)
            for c, most in zip(a.children, bound + slack):
                if most >= self.worst(c):
                    self.walk(c, b)
            return
        self.compare(a.all, b.points)
        if b.children:
            bound = b.centers @ a.center + b.norms * a.radius + a.norm * b.radii + b.radii * a.radius
            bound = bound + 1e-9 * (b.norms + b.radii) * (a.norm + a.radius)
            for k in np.argsort(-bound, kind="stable"):
                if bound[k] >= self.worst(a):
                    self.walk(a, b.children[k])


def vectors(column: pa.Array) -> np.ndarray:
    """Scaled vectors of one length."""
    values = np.asarray(column.flatten(), np.float64)
    return np.floor(SCALE * values).reshape(len(column), -1 if len(values) else 0)


def exact_scores(q: np.ndarray, x: np.ndarray) -> list[list[int]]:
    """For components too large for floats: whole numbers without limit, held to a long at the end."""
    qi, xi = [[int(c) for c in r] for r in q], [[int(c) for c in r] for r in x]
    lo, hi = -(1 << 63), (1 << 63) - 1
    return [[min(hi, max(lo, sum(a * b for a, b in zip(r, s)))) for s in xi] for r in qi]


# --- the shared tree -----------------------------------------------------------------------------


@dataclass
class Nodes:
    """Centres of the shared tree's nodes by vector length, and what all of their rows say about them.

    A length that the sample lacks has one node, whose centre is the origin.
    """

    centers: dict[int, np.ndarray]
    first: dict[int, int]
    radius: dict[int, float]
    norm: dict[int, float]
    parts: dict[int, tuple[int, int]]  # node: first part, number of parts

    def node(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Centres for vectors of that length, and the nodes' names."""
        if dim in self.centers:
            return self.centers[dim], self.first[dim] + np.arange(len(self.centers[dim]))
        return np.zeros((1, dim)), np.array([-dim - 1])

    def known(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Centres, names, radii and longest vectors of the nodes that have rows."""
        c, names = self.node(dim)
        has = np.array([n in self.parts for n in names.tolist()])
        names = names[has]
        return c[has], names, np.array([self.radius[n] for n in names.tolist()]), np.array([self.norm[n] for n in names.tolist()])


def sampled(x: DataFrame) -> Nodes:
    """Centres from the SAMPLE rows of lowest hash; a bounded number of rows reaches the driver."""
    rows = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    dims = np.array(rows.value_lengths()) if len(rows) else np.empty(0, np.int64)
    total, centers, first, at = x.count(), {}, {}, 0
    for dim in sorted({*dims.tolist()}):
        v = vectors(rows.filter(pa.array(dims == dim)))
        most = max(1, min(NODES, math.ceil(total / ROWS)) * len(v) // len(rows))
        centers[dim] = np.unique(np.stack([n.center for n in leaves(tree(v, 0), most)]), axis=0) if most > 1 else v[:1]
        first[dim], at = at, at + len(centers[dim])
    return Nodes(centers, first, {}, {}, {})


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.array(batch.column(column).value_lengths())
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def assigned(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, dist, norm, vec_id, embedding) of data rows."""
    for b in batches:
        for dim, rows in by_length(b, "embedding"):
            v, (c, names) = vectors(rows.column("embedding")), shared.value.node(dim)
            with np.errstate(all="ignore"):
                which, dist = nearest(v, c)
                norm = np.sqrt((v * v).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(names[which]), pa.array(dist), pa.array(norm), *rows.columns], names=["node", "dist", "norm", *rows.schema.names])


def bound(q: np.ndarray, reach: float, c: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """No row of the nodes scores above this with a query within ``reach`` of ``q``."""
    size = math.sqrt(float(q @ q))
    ball = c @ q + size * radius + reach * (np.sqrt((c * c).sum(1)) + radius)
    most = np.minimum(ball, (size + reach) * norm)
    return most + 1e-9 * (size + reach) * (norm + radius)


def seeds(q: np.ndarray, qid: np.ndarray, nodes: Nodes) -> np.ndarray:
    """The parts that each query meets first."""
    c, names, _, _ = nodes.known(q.shape[1])
    best = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :SEEDS]
    place = np.array([nodes.parts[n] for n in names.tolist()])
    return place[best, 0] + qid[:, None] % place[best, 1] if len(names) else np.empty((len(q), 0), np.int64)


def sent(shared, again: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, kind 1, vec_id, embedding, floor): queries for their first parts, or ``again`` for the others left open."""
    nodes = shared.value
    for b in batches:
        for dim, rows in by_length(b, "embedding"):
            qid, q = rows.column("vec_id").to_numpy(), vectors(rows.column("embedding"))
            with np.errstate(all="ignore"):
                first = seeds(q, qid, nodes)
                if again:
                    floor = rows.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    found = list(open_parts(q, floor, first, nodes))
                    at = np.array([i for i, _ in found], np.int64)
                    parts = np.array([p for _, p in found], np.int64)
                else:
                    floor = np.full(len(q), -np.inf)
                    at, parts = np.repeat(np.arange(len(q)), first.shape[1]), first.ravel()
            for k in range(0, len(at), 4 * QUERIES):
                some = at[k : k + 4 * QUERIES]
                cols = [pa.array(parts[k : k + 4 * QUERIES]), pa.array(np.ones(len(some), np.int32)), rows.column("vec_id").take(pa.array(some)), rows.column("embedding").take(pa.array(some)), pa.array(floor[some])]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "kind", "vec_id", "embedding", "floor"])


def open_parts(q: np.ndarray, floor: np.ndarray, first: np.ndarray, nodes: Nodes) -> Iterator[tuple[int, int]]:
    """(query, part) that bounds leave open: a tree of the queries walks down the shared tree's nodes."""
    c, names, radius, norm = nodes.known(q.shape[1])
    place = [nodes.parts[n] for n in names.tolist()]
    done = [set(p) for p in first.tolist()]

    def alone(i: int, which: np.ndarray) -> Iterator[tuple[int, int]]:
        keep = which[~(np.maximum(bound(q[i], 0.0, c[which], radius[which], norm[which]), -(2.0**63)) < floor[i])]
        for k in keep.tolist():
            for p in range(place[k][0], place[k][0] + place[k][1]):
                if p not in done[i]:
                    yield i, p

    def down(a: Node, which: np.ndarray) -> Iterator[tuple[int, int]]:
        most = np.maximum(bound(a.center, a.radius, c[which], radius[which], norm[which]), -(2.0**63))
        which = which[~(most < floor[a.all].min())]
        if len(which):
            for child in a.children:
                yield from down(child, which)
            for i in a.points.tolist():
                yield from alone(i, which)

    if len(q) and len(names):
        yield from down(tree(q, 0), np.arange(len(names)))


# --- one part ------------------------------------------------------------------------------------

FOUND = "query_id long, vec_id long, score long, compared long, pairs long"


class Part:
    """The data rows of one part, ready to be searched."""

    def __init__(self, xid: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(xid, kind="stable")
        self.xid, self.x, self.rows, self.k = xid[order], x[order], len(x), k
        self.most = float(np.abs(x).max(initial=0))
        if len(x):
            _, group = np.unique(self.x, axis=0, return_inverse=True)
            by, sizes = np.argsort(group.reshape(-1), kind="stable"), np.bincount(group.reshape(-1))
            place = np.arange(len(by)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # a row is needed if some query, whose own id may hold any one run of the rows before it, finds fewer than k better
            key = np.stack([group.reshape(-1)[by], self.xid[by]])
            head = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
            run, of = np.diff(np.r_[head, len(by)]), key[0, head]
            widest = np.maximum.accumulate(run + of * (len(by) + 1)) - of * (len(by) + 1)
            before = np.where(place[head] > 0, np.r_[0, widest[:-1]], 0)
            keep = np.sort(by[place - np.repeat(before, run) < k])
            self.few, self.few_id = self.x[keep], self.xid[keep]
            self.tree = tree(self.few) if self.most < 2.0**50 else None

    def best(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray) -> tuple[list, list, list, int]:
        """Query ids, row ids and scores of the best of each query, and how many pairs were compared."""
        if not self.rows:
            return [], [], [], 0
        if self.most * float(np.abs(q).max(initial=0)) * max(1, q.shape[1]) < 2.0**52:
            s = Search(qid, q, self.few_id, self.few, self.k, floor)
            s.walk(tree(q, 0), self.tree)
            at, col = np.nonzero(np.isfinite(s.score) & (s.score >= floor[:, None]))
            return qid[at].tolist(), s.id[at, col].tolist(), s.score[at, col].astype(np.int64).tolist(), s.compared
        out: tuple[list, list, list] = ([], [], [])
        for i, row in zip(qid.tolist(), exact_scores(q, self.x)):
            for s_, j in sorted((-v, j) for v, j in zip(row, self.xid.tolist()) if j != i)[: self.k]:
                for c, value in zip(out, (i, j, -s_)):
                    c.append(value)
        return *out, len(q) * self.rows


def searched(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of the queries of each part, whose data rows (kind 0) come before its queries (kind 1).

    Each run of queries also gives a row without a query that says how many pairs of all were compared.
    """
    current, ids, rows, part = None, [], [], None
    for b in batches:
        key = b.column("part").to_numpy() * 2 + b.column("kind").to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for s, e in zip(edges[:-1], edges[1:]):
            some = b.slice(s, e - s)
            if not some.num_rows:
                continue
            if (name := some.column("part")[0].as_py()) != current:
                current, ids, rows, part = name, [], [], None
            xid, v = some.column("vec_id").to_numpy(), vectors(some.column("embedding"))
            if some.column("kind")[0].as_py() == 0:
                ids.append(xid)
                rows.append(v)
                continue
            if part is None:
                part = Part(np.concatenate(ids) if ids else xid[:0], np.concatenate(rows) if rows else v[:0], k)
                ids, rows = [], []
            floor = some.column("floor").to_numpy(zero_copy_only=False)
            for at in range(0, len(v), QUERIES):
                mine = slice(at, at + QUERIES)
                qids, found, scores, compared = part.best(xid[mine], v[mine], floor[mine])
                cols = [[*qids, None], [*found, None], [*scores, None], [0] * len(qids) + [compared], [0] * len(qids) + [len(v[mine]) * part.rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in FOUND.split(", ")])


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col(vector_col).isNotNull() & fine)


def best_first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = found.filter("query_id is not null").select("query_id", "vec_id", "score")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hits_of(queries: DataFrame, data: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Hits that hold the k best of each query, and rows that count the compared pairs (see ``searched``)."""
    spark = data.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q, x = usable(queries, id_col, vector_col).distinct(), usable(data, id_col, vector_col)
    nodes = sampled(x)
    near = spark.sparkContext.broadcast(nodes)
    dealt = materialize(x.mapInArrow(lambda b: assigned(near, b), "node long, dist double, norm double, vec_id long, embedding array<double>"), "dealt")
    of = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r"), F.max("norm").alias("m"), F.max(F.size("embedding")).alias("d"))
    at = 0
    for r in of.orderBy("node").collect():  # a row a node
        nodes.radius[r["node"]], nodes.norm[r["node"]] = r["r"], r["m"]
        nodes.parts[r["node"]] = (at, max(1, math.ceil(r["n"] * (r["d"] + 1) * 8 / PART)))
        at += nodes.parts[r["node"]][1]
    shared = spark.sparkContext.broadcast(nodes)
    names = spark.createDataFrame([(n, a, c) for n, (a, c) in nodes.parts.items()], "node long, first long, parts long")
    placed = dealt.join(F.broadcast(names), "node")  # at most a row a node
    rows = placed.select((F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("part"), F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(None).cast("double").alias("floor"))

    def meet(asked: DataFrame, again: bool) -> DataFrame:
        both = rows.unionByName(asked.mapInArrow(lambda b: sent(shared, again, b), "part long, kind int, vec_id long, embedding array<double>, floor double"))
        order = both.repartition(parts, "part").sortWithinPartitions("part", "kind")
        return materialize(order.mapInArrow(functools.partial(searched, k), FOUND), "hits")

    first = meet(q, False)
    floors = best_first(first, k).groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    bounded = q.join(floors.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left").select("vec_id", "embedding", "floor")
    return first.unionByName(meet(bounded, True))


def top_k(queries: DataFrame, data: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``data`` for each query, ties to the smaller id."""
    return best_first(hits_of(queries, data, k, id_col, vector_col), k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.filter("vec_id % 100 = 0"), rows)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id AND len(q.e) = len(x.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
