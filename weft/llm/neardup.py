"""Operator 4, near-duplicates: SuperMinHash signatures, banding, verification, union-find grouping.

1. Each text becomes its set of 5-word shingles and a signature of BANDS * ROWS registers. Equal sets
   are one node, so any number of exact copies costs as much as one.
2. Each band of ROWS registers is a bucket key. Nodes with Jaccard similarity J share a band with
   probability 1 - (1 - J**ROWS)**BANDS: at the threshold of 0.75 all but 5 in a million do, at 0.8
   all but 5 in a hundred million.
3. In each bucket the node that shares most buckets with others is the pivot; every other member is
   paired with it. Pairs are confirmed on the full sets and grouped.
4. Buckets whose members are then still in several components hold what a pivot can't settle. In small
   ones every pair across components is confirmed; in larger ones the members outside the bucket's
   largest component are compared with all others of a like size, block by block: of each member the
   rarest shingles, of which a link must share one, name its candidates through an inverted index
   inside the task, and only these are counted. No pair that can be a link is skipped, and no pairs of
   a large bucket are emitted unless they are links.

Defined results: null text, or a text without words, has n_shingles 0, is linked with nothing and is
kept. Rows with one doc_id are told apart by their text. A null doc_id is never the smallest of a
component that holds another id. Extra columns are not read. A text is never cut; its set may be as long
as the text. Equal rows of one doc_id share a fate, and are all kept if their id is the component's.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.components import components
from weft.llm.skew import hot_keys, hot_keys_of, salted_join
from weft.llm.superminhash import WordHashes, band_keys, shingle_set, signature
from weft.runtime import materialize, table

BANDS, ROWS = 32, 4
#: Buckets up to this size emit their open pairs; larger ones are compared in blocks of about BLOCK members
#: or SHINGLES shingles, whichever are fewer.
SMALL, BLOCK, SHINGLES = 16, 1024, 1 << 20


def linked(inter, n_a, n_b):
    """100 * inter >= 75 * union, in whole numbers."""
    return 7 * inter >= 3 * (n_a + n_b)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, n, node, keys): hash of the text, set size, digest of the set, and one bucket key for each band."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select("id", F.xxhash64("text").alias("text_hash"), "text")
    schema = T.StructType([source.schema["id"], *T._parse_datatype_string("text_hash long, n long, node binary, keys array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore", RuntimeWarning)  # unsigned products wrap around by design
        hashes = WordHashes()
        for batch in batches:
            n, node, keys = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text or "", hashes)
                n.append(len(s))
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s, BANDS * ROWS), ROWS).view(np.int64) if len(s) else None)
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return source.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, sk: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, n, shingles) of the given nodes, from one document of each; the others' texts stay."""
    # grouped before the join, so that a node of many copies is one row of each task by then
    one = sk.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("o")).join(nodes, "node", "left_semi").select(F.col("o.id").alias("one"), F.col("o.text_hash").alias("hash"))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # by id and text, so that rows without an id, or of one id, aren't one task's
    same = F.col("id").eqNullSafe(F.col("one")) & (F.xxhash64("text") == F.col("hash"))
    source = source.join(one.distinct().hint("shuffle_hash"), same, "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore", RuntimeWarning)
        hashes = WordHashes()
        for batch in batches:
            sets = [s for t in batch.column(0).to_pylist() if len(s := shingle_set(t or "", hashes))]
            cols = [
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "n", "shingles"])

    return source.mapInArrow(run, "node binary, n long, shingles array<long>").dropDuplicates(["node"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    side = lambda c, k: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{k}"), F.col("shingles").alias(f"s_{k}"))
    both = salted_join(pairs, side("u", "a"), "u", hot_keys_of(pairs, "u"), ["v"])
    both = salted_join(both, side("v", "b"), "v", hot_keys_of(pairs, "v"), ["u"])
    inter = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(linked(inter, F.col("n_a"), F.col("n_b"))).select("u", "v")


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def sizes_allow(a: str, b: str):
    """No pair of sets of such sizes is similar enough otherwise."""
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def links_in_block(table_: pa.Table) -> pa.Table:
    """Links between the outside members (side 0) and all members (side 1) of one block of a bucket.

    A set linked to one of n shingles holds at least 3 of 4 of them, so it holds one of any n // 4 + 1. Those that are
    rarest in the block name the candidates, through an inverted index of side 1, and just their shared shingles are
    counted. Pairs of one component are left out.
    """
    side = table_.column("side").to_numpy()
    node, root = table_.column("node").to_pylist(), table_.column("root").to_pylist()
    number: dict = {}
    comp = np.array([number.setdefault(r, len(number)) for r in root])
    shingles = [np.frombuffer(b, np.int64) for b in table_.column("packed").to_pylist()]
    ins, outs = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    u, v = [], []
    if len(ins) and len(outs):
        n = np.array([len(s) for s in shingles])
        flat = np.concatenate([shingles[i] for i in ins])
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(ins)), n[ins])[order]
        flat = flat[order]
        for o in outs:
            lo, hi = np.searchsorted(flat, shingles[o], "left"), np.searchsorted(flat, shingles[o], "right")
            rare = np.argsort(hi - lo, kind="stable")[: n[o] // 4 + 1]
            lo, width = lo[rare], (hi - lo)[rare]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            near = ins[np.unique(owner[at])]
            near = near[(comp[near] != comp[o]) & (4 * np.minimum(n[o], n[near]) >= 3 * np.maximum(n[o], n[near]))]
            for k in near:
                few, many = sorted((shingles[o], shingles[k]), key=len)
                place = np.minimum(np.searchsorted(many, few), len(many) - 1)
                if linked(int((many[place] == few).sum()), int(n[o]), int(n[k])):
                    a, b = sorted((node[o], node[k]))
                    u.append(a)
                    v.append(b)
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})


def size_class(n):
    """Sets of sizes that allow a link are in one class or in neighbouring ones: a class ends at 4/3 of its start."""
    return F.floor(F.log(n) / F.log(F.lit(4 / 3))).cast("int")


def links_in_large(members: DataFrame, sets: DataFrame, hot: DataFrame) -> DataFrame:
    """Links across components in large buckets: (key, node, root, n) rows in blocks of like sizes.

    The members of a class outside the bucket's largest component meet all members of it and of the classes beside it.
    """
    members = members.withColumn("class", size_class("n"))
    per = materialize(members.groupBy("key", "root", "class").agg(F.count("*").alias("c"), F.sum("n").alias("s")), "per_root")
    main = per.groupBy("key", "root").agg(F.sum("c").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("main"))
    blocks = lambda c, s: F.ceil(F.greatest(F.sum(c) / BLOCK, F.sum(s) / SHINGLES)).cast("int")
    beside = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("of")
    n_out = per.join(main, "key").filter("root <> main").groupBy("key", F.col("class").alias("of")).agg(blocks("c", "s").alias("n_out"))
    n_all = per.select("key", beside, "c", "s").groupBy("key", "of").agg(blocks("c", "s").alias("n_all"))
    plan = n_out.join(n_all, ["key", "of"])
    # one row a bucket: its main root and, for each class with outside members, the numbers of blocks
    plan = plan.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("of", F.struct("n_out", "n_all")))).alias("plan")).join(main, "key")
    m = salted_join(members, plan, "key", hot, ["node"])
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    in_plan = m.select("key", "node", "root", "main", "class", "plan", beside)
    at = in_plan.withColumn("p", F.col("plan")[F.col("of")]).filter("p is not null").select("key", "node", "root", "main", "class", "of", "p.n_out", "p.n_all")
    every = at.select("key", "of", "node", "root", F.lit(1).alias("side"), block("n_all").alias("j"), F.explode(count("n_out")).alias("i"))
    out = at.filter("root <> main and class = of").select("key", "of", "node", "root", F.lit(0).alias("side"), block("n_out").alias("i"), F.explode(count("n_all")).alias("j"))
    packed = sets.mapInArrow(pack, "node binary, packed binary")
    rows = every.unionByName(out).join(packed, "node")  # a node is in a bucket of each band at most
    return rows.groupBy("key", "of", "i", "j").applyInArrow(links_in_block, "u binary, v binary")


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [np.asarray(s, np.int64).tobytes() for s in b.column("shingles").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(packed, pa.binary())], names=["node", "packed"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id, kept."""
    sk = materialize(sketch(docs, id_col, text_col), "sketch")
    nodes = sk.filter("node is not null").select("node", "n", "keys").dropDuplicates(["node"])
    bands = materialize(nodes.select("node", "n", F.explode("keys").alias("key")), "bands")
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    hot = hot_keys(shared, "key", "size", bands.count())
    members = materialize(salted_join(bands, shared, "key", hot, ["node"]), "members")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    sets = materialize(shingle_sets(docs, sk.select("id", "text_hash", "node"), weight.select("node"), id_col, text_col), "sets")

    weighed = members.join(weight, "node")
    pivot = weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"))
    stars = salted_join(members, pivot, "key", hot, ["node"]).filter((F.col("node") != F.col("pivot")) & sizes_allow("n", "pn")).select(*ordered("node", "pivot")).distinct()
    stars = materialize(stars, "stars")
    first = components(confirm(stars, sets))

    rooted = members.join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    still = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    rooted = materialize(salted_join(rooted, still, "key", hot, ["node"]), "open")
    small = rooted.filter(F.col("size") <= SMALL)
    a, b = small.alias("a"), small.alias("b")
    across = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & sizes_allow("a.n", "b.n")
    pairs = a.join(b, across).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct().join(stars, ["u", "v"], "left_anti")
    more = confirm(materialize(pairs, "pairs"), sets).unionByName(links_in_large(rooted.filter(F.col("size") > SMALL), sets, hot))
    at = lambda c, to: first.select(F.col("node").alias(c), F.col("root").alias(to))
    more = materialize(more, "more")
    lifted = salted_join(more, at("u", "a"), "u", hot_keys_of(more, "u"), ["v"], "left")
    lifted = salted_join(lifted, at("v", "b"), "v", hot_keys_of(more, "v"), ["u"], "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    second = components(lifted).select(F.col("node").alias("root"), F.col("root").alias("top"))
    roots = salted_join(first, second, "root", hot_keys_of(first, "root"), ["node"], "left").select("node", F.coalesce("top", "root").alias("top"))
    # a node that only the second pass linked is in `second` alone
    roots = roots.unionByName(second.select(F.col("root").alias("node"), "top")).dropDuplicates(["node"])

    least = sk.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"))
    named = least.join(roots, "node", "left").withColumn("top", F.coalesce("top", "node"))
    named = materialize(named, "named")
    lowest = materialize(named.groupBy("top").agg(F.min("id").alias("component"), F.count("*").alias("size")), "lowest")
    large = hot_keys(lowest, "top", "size", named.count())
    label = materialize(salted_join(named, lowest.drop("size"), "top", large, ["node"]).select("node", "component"), "labels")
    copies = hot_keys_of(sk.filter("node is not null"), "node")
    return salted_join(sk.select("id", "n", "node"), label, "node", copies, ["id"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component", "id")).alias("kept"),
    )


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT e.v, r.low FROM r JOIN e ON e.u = r.doc_id WHERE r.low < e.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(low) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
