"""Operator 3, quality rules: a learned decision list, in DataFrame expressions only.

Statistics of each text (base counts, and ratios made from them) are labelled by the labels table.
Sequential covering grows one rule at a time: on two thirds of the labelled rows it adds the threshold
condition of highest FOIL gain while bad and good rows are mixed, on the other third it cuts the rule
back to the prefix that tells them apart best, and accepts it if it is precise enough there. Rows that
the rule covers are set aside, and the next rule is grown on the rest. The list becomes one ordered
conditional expression, so applying it is a projection.

Candidates come from one grouped count per step over binned statistics; the driver sees counts of
bins, whose number is fixed, never rows. At most SAMPLE labelled rows are used to fit.

Defined results: null or empty text has no words and fails the base rule; a text is never cut; ties in
gain go to the first feature and lowest threshold; repeated rows repeat; without usable labels the
list is empty and the base rule alone decides; an empty table gives an empty table. Only the id and
text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.runtime import materialize, table

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: At most so many labelled rows fit the list, chosen by a hash of their id.
SAMPLE = 500_000
BINS, MAX_RULES, MAX_CONDITIONS, PRECISION, LEAST = 24, 6, 3, 0.95, 3
WINDOW = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where lambdas name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(grams: Column) -> Column:
    """Words in windows that occur twice or more: sorted windows show their equals side by side."""

    def covered(e: Column) -> Column:
        same = F.filter(e, lambda s, k: F.coalesce(s["g"] == F.get(e, k - 1)["g"], F.lit(False)) | F.coalesce(s["g"] == F.get(e, k + 1)["g"], F.lit(False)))
        starts = F.sort_array(F.transform(same, lambda s: s["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(pairs, covered)).otherwise(0)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, ratios and a hash of each whole text; one projection, no shuffle.

    Windows of a text are compared by 64-bit hashes.
    """
    t = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.select("id", "text_hash", "text", F.array_remove(F.split("text", SPACE), "").alias("words"), F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    at = lambda i, k: F.get("words", i + k)
    grams = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))))
    t = t.withColumn("grams", F.coalesce(grams, F.array().cast("array<bigint>")))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    t = t.select(
        "id",
        "text_hash",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("grams")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        count(r"[A-Z]").alias("n_upper"),
        count(r"[!?]").alias("n_marks"),
        count(r"[0-9]").alias("n_digits"),
    )
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return t.withColumns(
        {
            "mean_word": per("word_chars", "n_words"),
            "symbols_per_char": per("n_symbols", "word_chars"),
            "dup_line_share": per("n_dup_lines", "n_lines"),
            "repeat_share": per("n_repeat_words", "n_words"),
            # falls little with length, unlike the plain share of distinct words
            "log_distinct_share": F.coalesce(F.try_divide(F.log(F.greatest(F.col("n_distinct"), F.lit(1))), F.log(F.greatest(F.col("n_words"), F.lit(2)))), F.lit(0.0)),
            "upper_per_char": per("n_upper", "word_chars"),
            "marks_per_word": per("n_marks", "n_words"),
            "digits_per_char": per("n_digits", "word_chars"),
            "words_per_line": per("n_words", "n_lines"),
        }
    )


FEATURES = ("n_words", "mean_word", "symbols_per_char", "dup_line_share", "repeat_share", "log_distinct_share", "upper_per_char", "marks_per_word", "digits_per_char", "words_per_line")


@dataclass(frozen=True)
class Condition:
    """``feature <= threshold``, or above it; ``bin`` is the threshold's number in the fit."""

    feature: int
    above: bool
    bin: int
    threshold: float

    def on_bins(self) -> Column:
        b = F.get("bins", F.lit(self.feature))
        return b > self.bin if self.above else b <= self.bin

    def on_values(self) -> Column:
        x = F.col(FEATURES[self.feature])
        return x > self.threshold if self.above else x <= self.threshold


def both(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[tuple[Condition, ...], ...]

    def rule(self) -> Column:
        """Number of the first rule that a row meets, 0 if none: an ordered conditional expression."""
        chain = F
        for k, conditions in enumerate(self.rules, 1):
            chain = chain.when(both([c.on_values() for c in conditions]), F.lit(k))
        return chain.otherwise(F.lit(0)) if self.rules else F.lit(0)

    def __str__(self) -> str:
        text = [" and ".join(f"{FEATURES[c.feature]} {'>' if c.above else '<='} {c.threshold:.4g}" for c in r) for r in self.rules]
        return "; ".join(f"if {t} then reject" for t in text) + " else keep"


def binned(stats: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, list[list[float]]]:
    """(bins, bad, part) of labelled rows, and the thresholds of each feature's bins."""
    marked = labels.filter("quality in (0, 1)").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).cast("int").alias("bad"))
    total = marked.count()
    if total > sample:
        marked = marked.filter(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < F.lit(int(sample / total * (1 << 30))))
    rows = materialize(stats.join(marked, "id").select("id", "bad", *(F.col(f).cast("double").alias(f) for f in FEATURES)), "labelled")
    cuts = rows.agg(*(F.percentile_approx(f, [k / BINS for k in range(BINS)], 1000).alias(f) for f in FEATURES)).first()
    edges = [sorted(set(cuts[f] or [])) for f in FEATURES]
    place = lambda f, e: F.size(F.filter(F.array(*map(F.lit, e)), lambda c: c < F.col(f))) if e else F.lit(0)
    bins = rows.select(F.array(*(place(f, e) for f, e in zip(FEATURES, edges))).alias("bins"), "bad", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(3)).alias("part"))
    return materialize(bins, "bins"), edges


def grow(rows: DataFrame, edges: list[list[float]]) -> list[Condition]:
    """Add the condition of highest FOIL gain until only bad rows are covered or none gains."""
    found: list[Condition] = []
    while len(found) < MAX_CONDITIONS:
        inside = rows.filter(both([c.on_bins() for c in found]))
        counts = inside.select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        by: dict[int, dict[int, tuple[int, int]]] = {}
        for r in counts:
            by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
        p0, n0 = (sum(x[i] for x in by.get(0, {}).values()) for i in (0, 1))
        if not p0 or not n0:
            break
        best, before = None, math.log2(p0 / (p0 + n0))
        for f in sorted(by):
            p = n = 0
            for b, threshold in enumerate(edges[f]):
                p, n = p + by[f].get(b, (0, 0))[0], n + by[f].get(b, (0, 0))[1]
                for above, (x, y) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    gain = x * (math.log2(x / (x + y)) - before) if x else 0.0
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, Condition(f, above, b, threshold))
        if best is None:
            break
        found.append(best[1])
    return found


def prune(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The prefix that separates best on rows it wasn't grown on; none if it isn't precise there."""
    if not rule:
        return []
    inside = [both([c.on_bins() for c in rule[: k + 1]]) for k in range(len(rule))]
    sums = rows.agg(*(F.sum(F.when(c, F.col("bad"))).alias(f"p{k}") for k, c in enumerate(inside)), *(F.count(F.when(c, 1)).alias(f"t{k}") for k, c in enumerate(inside))).first()
    worth = lambda k: (2 * (sums[f"p{k}"] or 0) - sums[f"t{k}"]) / max(1, sums[f"t{k}"])
    best = max(range(len(rule)), key=lambda k: (worth(k), -k))
    p, t = sums[f"p{best}"] or 0, sums[f"t{best}"]
    return rule[: best + 1] if p >= LEAST and p >= PRECISION * t else []


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    rows, edges = binned(stats, labels, sample)
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < MAX_RULES:
        rule = prune(rows.filter("part = 2"), grow(rows.filter("part < 2"), edges))
        if not rule:
            break
        rules.append(tuple(rule))
        rows = rows.filter(~both([c.on_bins() for c in rule]))
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of each row of ``docs``, base_failed, the number of the rule it meets, and kept."""
    stats = materialize(statistics(docs, id_col, text_col), "statistics")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    # the list decides only where the base rule doesn't, and so it learns from those rows
    learned = learn(stats.filter(~F.col("base_failed")), labels)
    out = stats.withColumn("rule", learned.rule())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).withColumnRenamed("id", id_col)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the rules that SQL can state: base counts and the base rule."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *BASE)


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, generate_subscripts(w, 1) AS i, w FROM d WHERE len(w) >= 5),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS n FROM g WHERE i + 4 <= len(w)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win, range(5) t(j) WHERE win.n > 1 GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
"""
