"""Operator 13, a prefix trie of conversations: adaptive radix trees over ranges of turn ids.

A turn's id is 16 bytes, big-endian: the MD5 digest of its role and text. A conversation is the string of
its turns' ids, so byte order is trie order, and a prefix of d turns is one of 16 d bytes. Conversations
are dealt by ranges of (ids, conv_id): a first turn, or a whole conversation, that a third of all rows share
fills as many ranges as it needs. A task reads its range in runs of at most KEYS conversations, builds
an adaptive radix tree of each run (``radix``), and walks it once from below; only byte depths that are
multiples of 16 give nodes of the trie, also inside compressed paths.

Nodes that hold the first or the last conversation of a run may go on in the next run: the *edge*. Their
numbers are partial sums. One pass over the edges in order keeps the open path alone and adds up what meets
on it; there are at most two paths a run, however many rows share them. What is inside a run is final
but for the smallest member of a parent on the edge, which one join brings, hot parents dealt out.

``rebuilt`` gives the conversations their shared heads: all conversations of one base meet through one
shuffle by it (at most 20 conversations), and the heads travel along as at most 3 turns.

Defined results: a null turn comes first; rows of equal turn go by role and then by the digest of role and
text; repeated rows are repeated turns; null role or text is empty; rows of a null conv_id take no part.
A conversation is one key, so its ids (not its texts) meet in one task. An empty table gives no nodes.
Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm import skew
from weft.llm.radix import Node, Tree
from weft.runtime import count_words, materialize, table

#: Bytes of a turn's id; conversations, and bytes of ids, of a run; bytes of ids a range.
WIDTH, KEYS, BYTES, RANGE = 16, 20_000, 8 << 20, 32 << 20
#: Rows of a batch of nodes.
BATCH = 8192
#: Ids of conversations are packed to texts of at most so many for the edge.
PACK = 4096
ROWS = (
    "range long, run long, place long, depth long, node binary, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, counted long, words long, own_words long, ends array<string>, ends_sha256 string"
)
ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[c.split()[1]]) for c in ROWS.split(", ")])
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# --- conversations -------------------------------------------------------------------------------


def turns_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, base, turns): the digests and words of a conversation's turns in order; texts stay where they are."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    one = rows.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            role.alias("role"),
            F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"),
            count_words(text).alias("words"),
        ).alias("t"),
    ).filter("conv_id is not null")
    one = one.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    # dealt by base: the groups and the window over the base need no further shuffle
    dealt = one.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "base")
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words")))
    return dealt.groupBy("base", "conv_id").agg(turns.alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, turns) after the first crc32(conv_id) % 4 turns are taken from the base conversation."""
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 3)), ignorenulls=True)
    headed = convs.withColumn("head", head.over(Window.partitionBy("base")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    heads = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return headed.select("conv_id", F.concat(heads, own).alias("turns"))


def keyed(convs: DataFrame) -> DataFrame:
    """(conv_id, key, words): ids of all turns as one string of bytes, and the turns' words."""
    return convs.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("key"), F.col("turns.words").alias("words"))


# --- runs ----------------------------------------------------------------------------------------


def sha(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def digests(key: bytes) -> list[bytes]:
    """A name for each prefix of whole turns, each made from the one before."""
    out = [b""]
    for at in range(0, len(key), WIDTH):
        out.append(hashlib.md5(out[-1] + key[at : at + WIDTH]).digest())
    return out


@dataclass(slots=True)
class Below:
    """What lies under a byte depth: members, the smallest, childless nodes, sums, top nodes, and the run's edges."""

    n: int = 0
    least: int = 1 << 63
    leaves: int = 0
    counted: int = 0
    words: int = 0
    first: bool = False
    last: bool = False
    tops: list[int] = field(default_factory=list)

    def take(self, other: Below) -> None:
        self.n, self.least = self.n + other.n, min(self.least, other.least)
        self.leaves, self.counted, self.words = self.leaves + other.leaves, self.counted + other.counted, self.words + other.words
        self.first, self.last = self.first or other.first, self.last or other.last
        if len(other.tops) > len(self.tops):
            self.tops, other.tops = other.tops, self.tops
        self.tops += other.tops


class Run:
    """Conversations in the order of their keys, as nodes of the trie."""

    def __init__(self):
        self.keys: list[bytes] = []
        self.words: list[np.ndarray] = []
        self.ids: list[list[int]] = []
        self.size = self.bytes = 0

    def add(self, key: bytes, words: np.ndarray, conv_id: int) -> None:
        if self.keys and self.keys[-1] == key:
            self.ids[-1].append(conv_id)
        else:
            self.keys.append(key)
            self.words.append(words)
            self.ids.append([conv_id])
            self.bytes += len(key)
        self.size += 1

    def full(self, most: int) -> bool:
        return self.size >= most or self.bytes >= BYTES

    def rows(self, range_: int, number: int) -> list[list]:
        """Rows of ROWS, parents after their children but numbered before them."""
        tree, out = Tree(), []
        for i, key in enumerate(self.keys):
            tree.put(key, i)
        names = {True: digests(self.keys[0]), False: digests(self.keys[-1])}
        stack: list[tuple[Node, bool]] = [(tree.root, False)]
        done: dict[int, Below] = {}
        any_of: dict[int, int] = {}
        while stack:
            node, met = stack.pop()
            if not met:
                stack.append((node, True))
                stack += [(c, False) for c in node.below or ()]
                continue
            below, some, ends = Below(), node.leaf, None
            for c in node.below or ():
                below.take(done.pop(id(c)))
                some = any_of.pop(id(c))
            if node.leaf is not None:
                some, ends = node.leaf, self.ids[node.leaf]
                below.n, below.least = below.n + len(ends), min(below.least, min(ends))
                below.first, below.last = below.first or some == 0, below.last or some == len(self.keys) - 1
            # a leaf ends at the node's end, which is then a whole number of turns
            lowest = node.start if node.start or node is not tree.root else -1
            for depth in range(node.end // WIDTH, lowest // WIDTH, -1):
                self.node(out, below, depth, int(self.words[some][depth - 1]) if depth else 0, ends if depth * WIDTH == node.end else None, names, some)
            done[id(node)], any_of[id(node)] = below, some
        for row in out:
            row[0], row[1] = range_, number
        return out

    def node(self, out: list[list], below: Below, depth: int, words: int, ends: list[int] | None, names: dict, some: int) -> None:
        """The node of ``depth`` turns over what is ``below``, which it becomes a part of."""
        edge, tops = below.first or below.last, below.tops
        name = names[below.first] if edge else None
        inside = [t for t in tops if out[t][4] is None]  # children that lie in this run alone
        below.counted += below.n * words
        if not edge:
            below.words += words
            below.leaves += not tops
        for t in inside:
            out[t][7] = below.least
            out[t][5] = name[depth] if edge else None
        packed = [",".join(map(str, ends[k : k + PACK])) for k in range(0, len(ends), PACK)] if edge and ends else []
        out.append([None, None, None, depth, name[depth] if edge else None, None, below.least, None, below.n, len(inside), below.leaves, below.counted, below.words, words, packed, None if edge else sha(ends or [])])
        if edge:
            # in order of keys: the first path from the top, then what the last path adds below it
            out[-1][2] = depth if below.first else (1 << 32) + depth
        below.tops = [len(out) - 1]


def batches_of(rows: list[list]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), BATCH):
        cols = list(zip(*rows[at : at + BATCH]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW)


def tries(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each run of one range, whose rows (conv_id, key, words) come in order."""
    run, number = Run(), 0
    for b in batches:
        keys, words, ids = b.column("key"), b.column("words"), b.column("conv_id").to_pylist()
        for i, conv_id in enumerate(ids):
            run.add(keys[i].as_py(), words[i].values.to_numpy() if len(words[i]) else np.empty(0, np.int64), conv_id)
            if run.full(most):
                yield from batches_of(run.rows(TaskContext.get().partitionId(), number))
                run, number = Run(), number + 1
    if run.size:
        yield from batches_of(run.rows(TaskContext.get().partitionId(), number))


# --- edges ---------------------------------------------------------------------------------------


class Open:
    """A node on the open path: sums of its rows so far, and what its closed descendants on the edge add."""

    def __init__(self, row: dict):
        self.depth, self.node, self.conv_id, self.own = row["depth"], row["node"], row["conv_id"], row["own_words"]
        self.n = self.children = self.leaves = self.counted = self.words = self.edge_leaves = self.edge_words = 0
        self.ends, self.some = hashlib.sha256(), False

    def take(self, row: dict) -> None:
        self.conv_id, self.n = min(self.conv_id, row["conv_id"]), self.n + row["n_convs"]
        self.children, self.leaves = self.children + row["n_children"], self.leaves + row["n_leaves"]
        self.counted, self.words = self.counted + row["counted"], self.words + row["words"]
        for text in row["ends"]:
            self.ends.update((("," if self.some else "") + text).encode())
            self.some = True


CLOSED = f"node binary, parent binary, {NODE}"
CLOSED_ARROW = pa.schema([("node", pa.binary()), ("parent", pa.binary()), *((c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in NODE.split(", "))])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge rows of all runs in order to whole nodes, each but for its parent's smallest member."""
    path: list[Open] = []
    out: list[tuple] = []

    def close(depth: int) -> None:
        while path and path[-1].depth >= depth:
            x = path.pop()
            x.edge_leaves += not x.children
            x.edge_words += x.own
            parent = path[-1] if path else None
            out.append((x.node, parent.node if parent else None, x.conv_id, x.depth, None, x.n, x.children, x.leaves + x.edge_leaves, x.counted - x.words - x.edge_words, x.ends.hexdigest()))
            if parent:  # its own rows hold the sums of x's rows, but not what only whole nodes have
                parent.edge_leaves, parent.edge_words = parent.edge_leaves + x.edge_leaves, parent.edge_words + x.edge_words

    def flush(least: int) -> Iterator[pa.RecordBatch]:
        if len(out) > least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), CLOSED_ARROW)], schema=CLOSED_ARROW)
            out.clear()

    for b in batches:
        for at in range(b.num_rows):
            row = b.slice(at, 1).to_pylist()[0]
            depth = row["depth"]
            if depth >= len(path) or path[depth].node != row["node"]:
                close(depth)
                if path:
                    path[-1].children += 1
                path.append(Open(row))
            path[depth].take(row)
            yield from flush(BATCH)
    close(0)
    yield from flush(0)


def trie(convs: DataFrame, most: int = KEYS) -> DataFrame:
    """Nodes (see NODE) of conversations (conv_id, turns), built in runs of at most ``most``."""
    spark = convs.sparkSession
    keys = materialize(keyed(convs), "keys")
    total = keys.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    dealt = keys.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    nodes = materialize(dealt.mapInArrow(functools.partial(tries, most), ROWS), "nodes")
    edge = nodes.filter("node is not null")
    ordered = edge.repartition(1).sortWithinPartitions("range", "run", "place")  # two paths a run
    closed = materialize(ordered.mapInArrow(joined, CLOSED), "edge")
    saved = (F.col("counted") - F.col("words")).alias("saved_tokens")
    columns = [c.split()[0] for c in NODE.split(", ")]
    inside = nodes.filter("node is null").select("parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, "ends_sha256")
    parents = closed.select(F.col("node").alias("parent"), F.col("conv_id").alias("of"))
    met = inside.filter("parent is not null").drop("parent_conv_id").unionByName(closed.filter("parent is not null").drop("node", "parent_conv_id"))
    hot = skew.hot_keys_of(met.select("parent"), "parent")
    brought = skew.salted_join(met, parents, "parent", hot, ["conv_id", "depth"]).withColumnRenamed("of", "parent_conv_id")
    alone = inside.filter("parent is null").unionByName(closed.filter("parent is null").drop("node"))
    return alone.select(columns).unionByName(brought.select(columns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


SQL = """
WITH r AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY k) AS t FROM r GROUP BY conv_id),
h AS (
  SELECT conv_id, t, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM c),
s AS (SELECT x.conv_id, list_concat(coalesce(list_slice(b.t, 1, x.h), []), list_slice(x.t, x.h + 1, len(x.t))) AS t FROM h x LEFT JOIN c b ON b.conv_id = x.base),
p AS (SELECT conv_id, d, list_slice(t, 1, d) AS node, len(t) = d AS ends FROM s, LATERAL (SELECT unnest(range(len(t) + 1)) AS d)),
n AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY node, d),
k AS (SELECT list_slice(node, 1, d - 1) AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children,
    CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.node[n.d].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM n LEFT JOIN k ON k.node = n.node),
u AS (
  SELECT list_slice(node, 1, e) AS node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM f, LATERAL (SELECT unnest(range(d + 1)) AS e) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved_tokens, f.ends_sha256
FROM f JOIN u ON u.node = f.node LEFT JOIN f q ON f.d > 0 AND q.node = list_slice(f.node, 1, f.d - 1)
"""
