"""A stored keyword index of blocks, and the best hits of a query from the blocks that can hold them.

Rows of like length share a block of about BLOCK_ROWS rows, the same blocks for every term. A stored row is one
term in one block: how many rows of the block hold it, the best impact it has in any of them (the part of BM25
that a row's own counts decide), and its occurrences. Stored rows are dealt out by ranges of (term, impact), so a
frequent term fills as many parts as it needs, and a lower bound on the impact is a run of a term's rows.

A query first reads the small columns of its terms' rows. They give each block a bound that no row in it exceeds;
the blocks of highest bound are scored, and of the others only those whose bound reaches the worst score of the page.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weft.operators.search import B, K1, document_lengths, index_terms, phrase_counts, query_phrases
from weft.runtime import materialize

#: Rows of a block; term occurrences of a part of the stored index.
BLOCK_ROWS, PART_TERMS = 128, 4_000_000
#: Blocks scored at first; more, and then all, where they hold too few hits.
FIRST = (16, 256)


def impact(tf: Column, length: Column, mean: Column) -> Column:
    """What a row's counts add to the score, before the weight of the term; it rises with ``tf``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def length_class(length: Column) -> Column:
    return F.floor(F.log2(length) * 2).cast("int")


def write_index(search: DataFrame, columns: tuple[str, ...], key: list[str], root: str) -> None:
    """Store the index of ``columns`` under ``root``: ``stats`` (one row) and ``postings``.

    Rows are told apart by ``key``; a null text has no terms, and a row without terms isn't indexed.
    """
    lengths = materialize(document_lengths(search, columns, key), "lengths")
    # there are at most 63 classes of length, whatever the table
    classes = lengths.groupBy(length_class(F.col("length")).alias("class")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    stats = lengths.agg(F.count(F.lit(1)).alias("rows"), F.avg("length").alias("mean"), F.coalesce(F.sum("length"), F.lit(0)).alias("terms"))
    stats.write.mode("overwrite").parquet(f"{root}/stats")
    total = search.sparkSession.read.parquet(f"{root}/stats").first()
    same = reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in key))
    number = F.col("class").cast("long") * (1 << 40) + F.pmod(F.xxhash64(*key), F.col("blocks"))
    dealt = lengths.withColumn("class", length_class(F.col("length"))).join(F.broadcast(classes), "class")
    dealt = dealt.select(*key, "length", number.alias("block"))
    rows = search.select(*key, *(c for c in columns if c not in key)).alias("r").join(dealt.alias("l"), same)
    rows = rows.select("r.*", "l.length", "l.block")
    # one shuffle: both groupings below follow the partitioning by block and term
    each = index_terms(rows, columns, [*key, "length", "block"]).repartition("block", "term")
    per = each.groupBy("block", "term", *key, "length").agg(F.collect_list(F.struct("col", "pos")).alias("places"))
    best = F.max(impact(F.size("places"), F.col("length"), F.lit(total["mean"] or 1.0)))
    held = F.collect_list(F.struct(*key, "length", "places"))
    blocks = per.groupBy("block", "term").agg(F.count(F.lit(1)).alias("n"), best.alias("best"), held.alias("held"))
    order = ["term", F.desc("best"), "block"]
    parts = blocks.repartitionByRange(max(1, -(-total["terms"] // PART_TERMS)), *order)
    parts.sortWithinPartitions(*order).write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{root}/postings")


class Query:
    """A query over a stored index: the bounds of its blocks, its weights, and the rows of chosen blocks."""

    def __init__(self, spark: SparkSession, root: str, query: str, key: list[str]):
        self.key, self.phrases = key, query_phrases(query)
        self.terms = sorted({t for p in self.phrases for t in p})
        self.postings = spark.read.parquet(f"{root}/postings").filter(F.col("term").isin(*self.terms))
        self.stats: Row = spark.read.parquet(f"{root}/stats").first()
        self.heads = self.postings.select("term", "block", "n", "best")
        self.weights = self.weigh()

    def blocks_with(self, phrases: list[list[str]]) -> DataFrame:
        """(block, best of each phrase) of the blocks that hold every term of the phrases."""
        terms = sorted({t for p in phrases for t in p})
        at = {t: f"b{k}" for k, t in enumerate(terms)}
        by = self.heads.filter(F.col("term").isin(*terms)).groupBy("block")
        every = by.agg(*(F.max(F.when(F.col("term") == t, F.col("best"))).alias(c) for t, c in at.items())).dropna(subset=[*at.values()])
        # a phrase occurs no more often than the rarest of its terms
        least = lambda p: F.least(*cs) if len(cs := [F.col(at[t]) for t in dict.fromkeys(p)]) > 1 else cs[0]
        return every.select("block", *(least(p).alias(f"p{k}") for k, p in enumerate(phrases)))

    def weigh(self) -> list[float]:
        """The weight of each phrase by the rows that hold it: a term's are in the heads, a longer phrase's are counted."""
        held = {r["term"]: r["n"] for r in self.heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the query's terms
        out = []
        for p in self.phrases:
            n = held.get(p[0], 0) if len(p) == 1 else 0
            if len(p) > 1:
                n = phrase_counts(self.occurrences(self.blocks_with([p])), [p], self.key).filter("tf0 > 0").count()
            rows = self.stats["rows"]
            out.append(max(math.log((rows - n + 0.5) / (n + 0.5)), 1e-6))
        return out

    def bounds(self) -> DataFrame:
        """(block, bound): no row of the block scores higher."""
        bound = reduce(lambda a, b: a + b, (F.col(f"p{k}") * w for k, w in enumerate(self.weights)))
        return self.blocks_with(self.phrases).select("block", bound.alias("bound"))

    def occurrences(self, blocks: DataFrame) -> DataFrame:
        """Occurrences of the query's terms in those blocks, one a row."""
        rows = self.postings.join(blocks.select("block"), "block", "left_semi").select("term", F.inline("held"))
        return rows.select("term", *self.key, "length", F.inline("places"))

    def scored(self, blocks: DataFrame) -> DataFrame:
        """``key`` and ``score`` of the rows of those blocks that hold every phrase."""
        tf = phrase_counts(self.occurrences(blocks), self.phrases, [*self.key, "length"])
        mean, score = F.lit(self.stats["mean"]), F.lit(0.0)
        for k, w in enumerate(self.weights):
            tf = tf.filter(F.col(f"tf{k}") > 0)
            score = score + F.lit(w) * impact(F.col(f"tf{k}"), F.col("length"), mean)
        return tf.select(*self.key, score.alias("score"))


def best_blocks(q: Query, limit: int, allowed: DataFrame | None, digits: int) -> tuple[DataFrame, float | None]:
    """The blocks that can hold one of the ``limit`` best rows, and the score that such a row has at least."""
    bounds = materialize(q.bounds(), "bounds")
    for first in FIRST:
        top = bounds.orderBy(F.desc("bound"), "block").limit(first)
        hits = rounded(q.scored(top), allowed, q.key, digits)
        worst = hits.orderBy(F.desc("score")).limit(limit).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        if worst["n"] >= limit > 0:
            # rows are compared by their rounded scores, which may lie above the bound by a unit of the last digit
            return bounds.filter(F.col("bound") >= worst["least"] - 10.0**-digits), worst["least"]
    return bounds, None


def rounded(hits: DataFrame, allowed: DataFrame | None, key: list[str], digits: int) -> DataFrame:
    hits = hits.withColumn("score", F.round("score", digits))
    return hits if allowed is None else hits.join(allowed.select(*key), key, "left_semi")


def top_hits(spark: SparkSession, root: str, query: str, key: list[str], limit: int, allowed: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """``key`` and ``score`` of all rows whose score is at least that of the ``limit``-th best, ties included.

    ``allowed`` holds the keys that a filter leaves; weights are those of the whole index. A query with a keyword
    that has no term finds nothing.
    """
    if not all(query_phrases(query)):
        none = spark.read.parquet(f"{root}/postings").select(F.inline("held"))
        return none.select(*key, F.lit(0.0).alias("score")).limit(0)
    q = Query(spark, root, query, key)
    blocks, least = best_blocks(q, limit, allowed, digits)
    hits = rounded(q.scored(blocks), allowed, key, digits)
    return hits if least is None else hits.filter(F.col("score") >= least)
