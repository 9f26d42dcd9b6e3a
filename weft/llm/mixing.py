"""Operator 2, mixing sources to target weights by Pareto order sampling.

A source's target is its share of the budget by weight, at most MOST times its own size; what sources
at that limit leave is shared out again among the others by weight. A document's expected copies are
its source's target over its size: the whole part is allocated for certain, the rest is a sample whose
words are to fill the room that is left.

Inclusion odds follow a document's merit, here the logarithm of its length, so probabilities are unequal
within a source. They are solved for: what is above 1 is held at 1 and shared out among the others, until
the expected words of the sample are the room. Documents with odds of 1 are taken. The others are ranked
by random odds, from a hash, over inclusion odds (Rosen's Pareto sampling), and those of lowest rank are
taken while their words fit. One fill step follows: the document whose size is nearest to the words still
missing is taken once more, if that brings the source nearer to its target. A source is thus within half
its longest document of its target.

The odds depend on a size alone, so they are solved on counts of sizes. The cut is found without sorting
a source: words are summed in BUCKETS buckets of the rank, and only the bucket in which the sum passes
the room is ordered. What is decided for each source is a few numbers, which a join applies to all rows.

Defined results: null or empty text has size 0 and is never sampled; a null source is a source of its
own and comes last; equal rows (id and text) share one rank and so one fate; an empty table gives an
empty table; a text is never cut, only counted. Reruns agree, as ranks are hashes. One row for each
source is ranked in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.runtime import count_words, materialize, table

BUCKETS = 4096


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources by code point; ``budget`` is a multiple of all words."""

    weights: tuple[int, ...] = (3, 1, 2)
    budget: float = 1.5
    most: float = 2.0
    seed: int = 20


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target) from one row a source: the shares, filled up to the limits."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.row_number().over(by_name) - 1) % len(mix.weights) + 1)
    s = sizes.withColumn("w", weight.cast("double")).withColumn("cap", mix.most * F.col("source_size"))
    # by ascending limit per weight; row k is at its limit if the share of what rows before leave exceeds it
    rise = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before, everything = rise.rowsBetween(Window.unboundedPreceding, -1), rise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(mix.budget * F.col("source_size")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rate = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("rate", rate).withColumn("full", F.col("rate") * F.col("w") > F.col("cap"))
    shared = F.first(F.when(~F.col("full"), F.col("rate")), ignorenulls=True).over(everything)
    return s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(shared * F.col("w"))).select("source", "source_size", "target")


def merit(size: Column) -> Column:
    return F.log2(size + 2.0)


def uniform(seed: int, id_col: str, text_col: str) -> Column:
    """A number in (0, 1) from a row's id and text."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 11)
    return (bits + 0.5) / float(1 << 53)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Each row's id, source, size, and uniform random number from its id and text."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), uniform(seed, id_col, text_col).alias("u")
    )


def on_source(rows: DataFrame, each: DataFrame) -> DataFrame:
    """Join what each source has to its rows, nulls alike."""
    r, e = rows.alias("r"), each.withColumnRenamed("source", "__source").alias("e")
    return r.join(e, F.col("r.source").eqNullSafe(F.col("__source")), "left").drop("__source")


def cut(rows: DataFrame, name: str) -> DataFrame:
    """(source, name_b, name_q, name_left): rows up to there, by rank q, hold at most ``room`` words.

    A row is within the cut if its bucket is below name_b, or in it with a rank of at most name_q.
    """
    summed = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    run = Window.partitionBy("source").orderBy("bucket")
    summed = summed.withColumn("upto", F.sum("words").over(run))
    over = F.col("upto") > F.col("room")
    edge = summed.groupBy("source").agg(
        F.coalesce(F.min(F.when(over, F.col("bucket"))), F.lit(BUCKETS)).alias("b"),
        F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("base"),
        F.first("room").alias("room"),
    )
    inside = on_source(rows.select("source", "bucket", "q", "size"), edge).filter(F.col("bucket") == F.col("b"))
    tied = inside.groupBy("source", "q").agg(F.sum("size").alias("words"), F.first("base").alias("base"), F.first("room").alias("room"))
    tied = tied.withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("q"))).filter(F.col("upto") <= F.col("room"))
    last = tied.groupBy("source").agg(F.max("q").alias("q"), F.max("upto").alias("held"))
    both = on_source(edge, last)
    return both.select(
        "source",
        F.col("b").alias(f"{name}_b"),
        F.coalesce("q", F.lit(-1.0)).alias(f"{name}_q"),
        (F.col("room") - F.coalesce("held", "base")).alias(f"{name}_left"),
    )


def within(name: str) -> Column:
    b, q = F.col(f"{name}_b"), F.col(f"{name}_q")
    return F.coalesce((F.col("bucket") < b) | ((F.col("bucket") == b) & (F.col("q") <= q)), F.lit(False))


def odds(counts: DataFrame) -> DataFrame:
    """(source, top, rate): documents longer than ``top`` are certain, others have odds of rate * merit.

    From (source, size, n, room): going down the sizes, the first at which the rest of the room, spread
    over it and all shorter ones by merit, gives it odds of at most 1.
    """
    words = F.col("n") * F.col("size")
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    before = lambda x: F.coalesce(F.sum(x).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(words * merit(F.col("size"))).over(down.rowsBetween(0, Window.unboundedFollowing))
    rows = counts.withColumn("rate", (F.col("room") - before(words)) / rest)
    fits = rows.filter((F.col("rate") >= 0) & (F.col("rate") * merit(F.col("size")) <= 1))
    return fits.groupBy("source").agg(F.max(F.struct("size", "rate")).alias("m")).select("source", F.col("m.size").alias("top"), F.col("m.rate").alias("rate"))


def ranked(rows: DataFrame) -> DataFrame:
    """Pareto rank q of each row from its u and its odds, and the bucket of q; none for certain rows."""
    pi = F.least(F.lit(1.0), F.col("rate") * merit(F.col("size")))
    q = F.col("u") / (1.0 - F.col("u")) * (1.0 - pi) / pi
    rows = rows.withColumn("q", F.when((F.col("size") <= F.col("top")) & (F.col("size") > 0) & (pi > 0), q))
    return rows.withColumn("bucket", F.least(F.floor(F.col("q") / (1.0 + F.col("q")) * BUCKETS).cast("int"), F.lit(BUCKETS - 1)))


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, u, size, source_size, target, pi, q, copies."""
    rows = materialize(sized(docs, id_col, text_col, source_col, mix.seed), "sized")
    counts = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    sizes = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    each = targets(sizes, mix)
    share = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    each = each.withColumn("whole", F.floor(share)).withColumn("room", F.col("target") - F.col("whole") * F.col("source_size"))
    each = materialize(each, "targets")
    positive = on_source(counts, each.select("source", "room")).filter("size > 0 and room > 0")
    solved = on_source(each, odds(positive))
    certain = F.sum(F.when(F.col("size") > F.col("top"), F.col("n") * F.col("size")).otherwise(0))
    sure = on_source(positive.drop("room"), solved.select("source", "top")).groupBy("source").agg(certain.alias("sure"))
    solved = materialize(on_source(solved, sure).withColumn("room", F.col("room") - F.coalesce("sure", F.lit(0))).drop("sure"), "odds")
    rows = ranked(on_source(rows, solved))
    cuts = materialize(cut(rows.filter("q is not null"), "one"), "cut")
    # where no document has a rank, all of the room is left
    cuts = on_source(solved.select("source", "room"), cuts).withColumn("one_left", F.coalesce("one_left", "room")).drop("room")
    copies = F.col("whole") + F.when(within("one") | (F.col("size") > F.col("top")), 1).otherwise(0)
    open_ = on_source(rows, cuts).withColumn("copies", copies)
    # equal rows are taken together, so a document counts as often as it occurs
    free = open_.filter((F.col("size") > 0) & (F.col("copies") + 1 <= mix.most))
    near = free.groupBy("source").agg(F.min(F.struct(F.abs(F.col("one_left") - F.col("size")), "u")).alias("f")).select("source", F.col("f.u").alias("fill_u"))
    alike = on_source(free, near).filter("u = fill_u").groupBy("source").agg(F.sum("size").alias("added"), F.first("fill_u").alias("fill_u"), F.first("one_left").alias("left"))
    fill = materialize(alike.filter(F.abs(F.col("left") - F.col("added")) < F.col("left")).select("source", "fill_u"), "fill")
    filled = F.coalesce((F.col("u") == F.col("fill_u")) & (F.col("size") > 0) & (F.col("copies") + 1 <= mix.most), F.lit(False))
    pi = F.when((F.col("size") > 0) & F.col("top").isNotNull(), F.least(F.lit(1.0), F.when(F.col("size") > F.col("top"), 1.0).otherwise(F.col("rate") * merit(F.col("size"))))).otherwise(0.0)
    return on_source(open_, fill).select(
        F.col("id").alias(id_col), "u", "size", "source_size", "target", pi.alias("pi"), "q", F.when(F.col("size") > 0, F.col("copies") + F.when(filled, 1).otherwise(0)).otherwise(0).cast("long").alias("copies")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the mix that SQL can state: sizes, and the targets of the sources."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


#: By ascending limit per weight, a source is at its limit if its share of what is left exceeds it.
TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(k - 1) % 3 + 1]::DOUBLE AS w, 2.0 * source_size::DOUBLE AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS r FROM w),
rate AS (SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM o),
t AS (SELECT source, source_size, CASE WHEN rate * w > cap THEN cap ELSE w * (SELECT arg_min(rate, r) FROM rate WHERE rate * w <= cap) END AS target FROM rate)
SELECT doc_id, size, source_size, round(target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
