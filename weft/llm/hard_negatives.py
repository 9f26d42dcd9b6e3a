"""Operator 12, hard negatives by segment summaries.

A vector cut into segments of m components each is summarised by each segment's mean and deviation. Two
vectors' inner product over a segment is m * (mean * mean) give or take m * (deviation * deviation), so the
sums over segments bound their score from both sides. LEVELS holds the numbers of segments: a pair that the
bounds of one level leave open is bounded again at the next, finer one, and is scored exactly only when
no level settles it.

The same summaries, taken over many vectors, keep whole groups away. Rows are dealt to the leaves of a
k-d tree over the means of FINEST segments, split on a bounded sample; a leaf keeps the range of each
mean and the largest deviation of all its rows. At most LEAVES leaves a vector length are broadcast. A
leaf's rows lie in parts of about PART bytes, and an anchor is sent to the parts that its bounds leave open.

Three passes: an anchor meets one part of its SEEDS best leaves, which gives a fifth best positive to beat;
then the other parts that could hold a better one; then, with its positives' scores known, the parts that
could hold a score in the range that one of them asks for. In a part rows lie by label, so an anchor of a
label is compared with that label's rows alone in the first two passes and with all others in the third.

Defined results: rows of a null id take no part, nor do those with a null label or vector or a null or
non-finite component. Only vectors of an anchor's length are its candidates. Rows of an anchor's own id
are none of its candidates; other repeated rows are candidates as often as they occur; equal anchors
are one anchor, and rows of one id that differ in vector or label are anchors of their own. Scores are
exact integers, held at the ends of a long beyond it. A positive without negatives has no rows. An empty
table, or no anchors, gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.cover_tree import by_length, exact_scores
from weft.runtime import materialize, table

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Numbers of segments, coarse to fine; the last one's means split the leaves.
LEVELS = (1, 4, 16)
FINEST = LEVELS[-1]
#: Rows of the sample that splits the leaves, rows for each leaf, and the most leaves a vector length.
SAMPLE, ROWS, LEAVES = 8192, 4096, 256
#: Vector lengths that have leaves of their own; all rarer ones share one leaf without bounds.
LENGTHS = 16
#: Bytes of vectors in a part, anchors compared at once, rows compared with them at once, first leaves met.
PART, ANCHORS, COLUMNS, SEEDS = 8 << 20, 256, 2048, 2
LOW, HIGH = -(1 << 63), (1 << 63) - 1


# --- summaries -----------------------------------------------------------------------------------


def edges(dim: int, segments: int) -> np.ndarray:
    """Borders of about equal segments."""
    return np.unique(np.linspace(0, dim, min(segments, max(1, dim)) + 1).round().astype(int))


@dataclass(frozen=True)
class Summary:
    """Means and deviations of the segments of some vectors, each times the root of the segment's length."""

    mean: np.ndarray
    deviation: np.ndarray

    @staticmethod
    def of(v: np.ndarray, segments: int) -> Summary:
        cut = edges(v.shape[1], segments)
        if len(cut) < 2:
            return Summary(np.zeros((len(v), 1)), np.zeros((len(v), 1)))
        m = np.diff(cut).astype(float)
        mean = np.add.reduceat(v, cut[:-1], axis=1) / m
        loose = v - np.repeat(mean, np.diff(cut), axis=1)
        return Summary(mean * np.sqrt(m), np.sqrt(np.add.reduceat(loose * loose, cut[:-1], axis=1)))

    def rows(self, which) -> Summary:
        return Summary(self.mean[which], self.deviation[which])

    def bounds(self, other: Summary) -> tuple[np.ndarray, np.ndarray]:
        """No score of the two sides' vectors lies outside."""
        middle, reach = self.mean @ other.mean.T, self.deviation @ other.deviation.T
        # rounding of sums of products is far below this share of their sizes
        slack = 1e-9 * (np.abs(self.mean) @ np.abs(other.mean).T + reach) + 1e-9
        return middle - reach - slack, middle + reach + slack


def vectors(column: pa.Array) -> np.ndarray:
    """Scaled vectors of one length."""
    values = np.asarray(column.flatten(), np.float64)
    return np.floor(SCALE * values).reshape(len(column), -1 if len(values) else 0)


@dataclass
class Leaves:
    """For each vector length: splits of the k-d tree, and what all rows of its leaves say about them.

    A split is (segment, threshold, left, right); a child below 0 is leaf ``-child - 1`` of the length. ``parts``
    has the first part of each leaf, by (length, leaf), and their number.
    """

    splits: dict[int, list[tuple[int, float, int, int]]]
    low: dict[tuple[int, int], np.ndarray]
    high: dict[tuple[int, int], np.ndarray]
    deviation: dict[tuple[int, int], np.ndarray]
    parts: dict[tuple[int, int], tuple[int, int]]

    def leaf(self, dim: int, s: Summary) -> np.ndarray:
        """The leaf of each vector of length ``dim``, by its finest summary."""
        out = np.zeros(len(s.mean), np.int64)
        splits = self.splits.get(dim)
        if not splits:
            return out
        stack = [(0, np.arange(len(out)))]
        while stack:
            at, rows = stack.pop()
            segment, threshold, left, right = splits[at]
            below = s.mean[rows, segment] <= threshold
            for child, some in ((left, rows[below]), (right, rows[~below])):
                if child < 0:
                    out[some] = -child - 1
                elif len(some):
                    stack.append((child, some))
        return out

    def known(self, dim: int) -> list[tuple[int, int]]:
        """Leaves that have rows of that length."""
        shared = [(-1, 0)] if (-1, 0) in self.parts and dim not in self.splits else []
        return shared + [k for k in self.parts if k[0] == dim]

    def bounds(self, dim: int, q: Summary) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """Leaves, and what scores of each anchor with their rows lie between."""
        names = self.known(dim)
        lo, hi = np.full((len(q.mean), len(names)), -np.inf), np.full((len(q.mean), len(names)), np.inf)
        for j, name in enumerate(names):
            if name[0] < 0:
                continue
            a, b = q.mean * self.low[name], q.mean * self.high[name]
            reach = q.deviation @ self.deviation[name]
            slack = 1e-9 * (np.maximum(np.abs(a), np.abs(b)).sum(1) + reach) + 1e-9
            lo[:, j] = np.minimum(a, b).sum(1) - reach - slack
            hi[:, j] = np.maximum(a, b).sum(1) + reach + slack
        return names, lo, hi


def split(s: Summary, most: int) -> list[tuple[int, float, int, int]]:
    """Halve the sample's fullest group at the median of its most spread mean until there are ``most`` leaves."""
    splits: list[list] = []
    groups: list[tuple[np.ndarray, int, int]] = [(np.arange(len(s.mean)), -1, 0)]  # rows, split above, side
    done: list[tuple[np.ndarray, int, int]] = []
    while groups and len(groups) + len(done) < most:
        groups.sort(key=lambda g: len(g[0]))
        rows, above, side = groups.pop()
        m = s.mean[rows]
        spread = m.max(0, initial=-np.inf) - m.min(0, initial=np.inf) if len(rows) else np.zeros(1)
        segment = int(np.argmax(m.std(0))) if len(rows) else 0
        if len(rows) < 2 or not spread[segment] > 0:
            done.append((rows, above, side))
            continue
        threshold = float(np.median(m[:, segment]))
        below = m[:, segment] <= threshold
        if below.all():
            threshold = float(np.nextafter(threshold, -np.inf))
            below = m[:, segment] <= threshold
        if above >= 0:
            splits[above][2 + side] = len(splits)
        groups += [(rows[below], len(splits), 0), (rows[~below], len(splits), 1)]
        splits.append([segment, threshold, 0, 0])
    for leaf, (_, above, side) in enumerate([*groups, *done]):
        if above >= 0:
            splits[above][2 + side] = -leaf - 1
    return [tuple(x) for x in splits]


def sampled(rows: DataFrame) -> Leaves:
    """Leaves from the SAMPLE rows of lowest hash; a bounded number of rows reaches the driver."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    dims = np.array(some.value_lengths()) if len(some) else np.empty(0, np.int64)
    total, splits = rows.count(), {}
    names, counts = np.unique(dims, return_counts=True)
    for dim, n in sorted(zip(names.tolist(), counts.tolist()), key=lambda x: (-x[1], x[0]))[:LENGTHS]:
        with np.errstate(all="ignore"):
            s = Summary.of(vectors(some.filter(pa.array(dims == dim))), FINEST)
        fine = np.isfinite(s.mean).all()
        splits[dim] = split(s, max(1, min(LEAVES, math.ceil(total / ROWS)) * n // len(some))) if fine else []
    return Leaves(splits, {}, {}, {}, {})


DEALT = "length long, leaf long, vec_id long, label long, embedding {kind}"


def dealt(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the length and number of its leaf."""
    leaves = shared.value
    for b in batches:
        for dim, rows in by_length(b, "embedding"):
            with np.errstate(all="ignore"):
                s = Summary.of(vectors(rows.column("embedding")), FINEST)
            length = np.full(rows.num_rows, dim if dim in leaves.splits else -1)
            cols = [pa.array(length), pa.array(leaves.leaf(dim, s)), rows.column("vec_id"), rows.column("label"), rows.column("embedding")]
            yield pa.RecordBatch.from_arrays(cols, names=["length", "leaf", "vec_id", "label", "embedding"])


RANGES = "length long, leaf long, n long, size long, low array<double>, high array<double>, deviation array<double>"


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the rows of each leaf in a batch: their number, longest vector, and the ranges of their finest summaries."""
    for b in batches:
        for dim, rows in by_length(b, "embedding"):
            with np.errstate(all="ignore"):
                s = Summary.of(vectors(rows.column("embedding")), FINEST)
            length, leaf = rows.column("length")[0].as_py(), rows.column("leaf").to_numpy()
            out = []
            for name in np.unique(leaf).tolist():
                mine = s.rows(leaf == name)
                known = [x.tolist() for x in (mine.mean.min(0), mine.mean.max(0), mine.deviation.max(0))] if length >= 0 else [[]] * 3
                out.append((length, name, len(mine.mean), dim, *known))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in RANGES.split(", ")])


# --- which parts an anchor meets -----------------------------------------------------------------


def sent(shared, step: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors (anchor, vec_id, label, embedding, floor, lows, highs), one row for each part to meet.

    ``seed``: one part of each of the best leaves. ``rest``: all other parts with a bound from the floor up.
    ``range``: all parts whose bounds meet one of the ranges.
    """
    leaves = shared.value
    for b in batches:
        for dim, rows in by_length(b, "embedding"):
            ids = rows.column("vec_id").to_numpy()
            with np.errstate(all="ignore"):
                s = Summary.of(vectors(rows.column("embedding")), FINEST)
                names, lo, hi = leaves.bounds(dim, s)
                lo, hi = np.where(np.isnan(lo), -np.inf, lo), np.where(np.isnan(hi), np.inf, hi)
            if not names:
                continue
            best = np.argsort(-hi, axis=1, kind="stable")[:, :SEEDS]
            floor = rows.column("floor").to_numpy(zero_copy_only=False)
            at, parts = [], []
            for i in range(rows.num_rows):
                first = {leaves.parts[names[j]][0] + int(ids[i]) % leaves.parts[names[j]][1] for j in best[i].tolist()}
                if step == "seed":
                    found = first
                else:
                    if step == "rest":
                        # a score held at a long's end may be the floor of one below it
                        open_ = ~(np.maximum(hi[i], float(LOW)) < floor[i])
                    else:
                        low, high = (np.array(rows.column(c)[i].as_py(), float) for c in ("lows", "highs"))
                        held = np.clip(lo[i], LOW, HIGH), np.clip(hi[i], LOW, HIGH)
                        open_ = ((held[1][:, None] >= low - 1024 * (np.abs(low) > 2**52)) & (held[0][:, None] <= high + 1024 * (np.abs(high) > 2**52))).any(1)
                    found = {p for j in np.flatnonzero(open_).tolist() for p in range(leaves.parts[names[j]][0], sum(leaves.parts[names[j]]))}
                    if step == "rest":
                        found -= first
                at += [i] * len(found)
                parts += sorted(found)
            for k in range(0, len(at), 1024):
                some = rows.take(pa.array(at[k : k + 1024], pa.int64()))
                cols = [pa.array(parts[k : k + 1024], pa.int64()), pa.array(np.ones(some.num_rows, np.int32)), *some.columns]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "kind", *some.schema.names])


# --- one part ------------------------------------------------------------------------------------

FOUND = "anchor long, slot int, vec_id long, score long, compared long, pairs long"


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(row, id, score) of the k best finite scores of each row, ties to the smaller id."""
    if score.shape[1] > k:
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        score = np.where(score >= least, score, -np.inf)
    at, col = np.nonzero(np.isfinite(score))
    order = np.lexsort((ids[col], -score[at, col], at))
    at, col = at[order], col[order]
    start = np.searchsorted(at, at, "left")
    keep = np.arange(len(at)) - start < k
    return list(zip(at[keep].tolist(), ids[col[keep]].tolist(), score[at[keep], col[keep]].astype(np.int64).tolist()))


class Part:
    """The rows of one part by label and length, and the summaries that were made when first asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        self.most = float(np.abs(v).max(initial=0))
        self.levels: dict[int, Summary] = {}
        self.compared = self.pairs = 0

    def summary(self, level: int) -> Summary:
        if level not in self.levels:
            self.levels[level] = Summary.of(self.v, LEVELS[level])
        return self.levels[level]

    def columns(self, label: int, same: bool) -> Iterator[np.ndarray]:
        """Places of rows of that label, or of all others, some at a time."""
        a, b = np.searchsorted(self.labels, [label, label], "left")[0], np.searchsorted(self.labels, label, "right")
        for s, e in [(a, b)] if same else [(0, a), (b, len(self.labels))]:
            for at in range(s, e, COLUMNS):
                yield np.arange(at, min(e, at + COLUMNS))

    def open_scores(self, q: np.ndarray, qs: list[Summary], ids: np.ndarray, cols: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and exact scores of the pairs that no level settles; settled ones are -inf."""
        rows = np.arange(len(q))
        self.pairs += len(rows) * len(cols)
        for level in range(len(LEVELS)):
            lo, hi = qs[level].rows(rows).bounds(self.summary(level).rows(cols))
            maybe = wanted(rows, lo, hi)
            keep_r, keep_c = maybe.any(1), maybe.any(0)
            rows, cols = rows[keep_r], cols[keep_c]
            if not len(rows) or not len(cols):
                return rows, cols, np.empty((len(rows), len(cols)))
            if keep_r.all() and keep_c.all() and level + 1 < len(LEVELS) and maybe.mean() > 0.9:
                break  # where a level settles next to nothing, the score itself is the finer bound
        score = q[rows] @ self.v[cols].T
        self.compared += score.size
        score[ids[rows][:, None] == self.ids[cols][None, :]] = -np.inf
        return rows, cols, score

    def positives(self, label: int, ids: np.ndarray, q: np.ndarray, floor: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(anchor, 0, id, score): all of the best POSITIVES in this part of each anchor that reach its floor."""
        qs = [Summary.of(q, k) for k in LEVELS]
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        floor = floor.copy()
        for cols in self.columns(label, True):
            rows, cols, score = self.open_scores(q, qs, ids, cols, lambda r, lo, hi: hi >= floor[r][:, None])
            for i, j, x in best_of(np.where(score >= floor[rows][:, None], score, -np.inf), self.ids[cols], POSITIVES) if len(cols) else ():
                best[rows[i]].append((-x, j))
            for i in rows.tolist():
                best[i] = sorted(best[i])[:POSITIVES]
                if len(best[i]) == POSITIVES:
                    floor[i] = max(floor[i], -best[i][-1][0])
        return [(i, 0, j, -x) for i, found in enumerate(best) for x, j in found]

    def negatives(self, label: int, ids: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(anchor, slot, id, score): the first NEGATIVES of this part in each of an anchor's ranges."""
        qs = [Summary.of(q, k) for k in LEVELS]
        best: dict[tuple[int, int], list[tuple[int, int]]] = {}
        low = low.copy()  # what can still be among the first rises

        def wanted(r: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            out = np.zeros(lo.shape, bool)
            for s in range(low.shape[1]):
                out |= (hi >= low[r, s][:, None]) & (lo <= high[r, s][:, None])
            return out

        for cols in self.columns(label, False):
            rows, cols, score = self.open_scores(q, qs, ids, cols, wanted)
            if not len(cols):
                continue
            for s in range(low.shape[1]):
                inside = (score >= low[rows, s][:, None]) & (score <= high[rows, s][:, None])
                for i, j, x in best_of(np.where(inside, score, -np.inf), self.ids[cols], NEGATIVES) if inside.any() else ():
                    best.setdefault((int(rows[i]), s), []).append((-x, j))
            for (i, s), found in best.items():
                found.sort()
                del found[NEGATIVES:]
                if len(found) == NEGATIVES:
                    low[i, s] = max(low[i, s], -found[-1][0])
        return [(i, s, j, -x) for (i, s), found in best.items() for x, j in found]

    def exact(self, label: int, same: bool, ids: np.ndarray, q: np.ndarray, ranges: list[list[tuple[int, int]]], k: int) -> list[tuple[int, int, int, int]]:
        """The same for components too large for floats: whole numbers without limit, held to a long."""
        out = []
        for cols in self.columns(label, same):
            self.pairs, self.compared = self.pairs + len(q) * len(cols), self.compared + len(q) * len(cols)
            for i, scores in enumerate(exact_scores(q, self.v[cols])):
                others = [(x, j) for x, j in zip(scores, self.ids[cols].tolist()) if j != ids[i]]
                for s, (low, high) in enumerate(ranges[i]):
                    out += [(i, s, j, x) for x, j in sorted((o for o in others if low <= o[0] <= high), key=lambda o: (-o[0], o[1]))[:k]]
        return out

    def answer(self, b: pa.RecordBatch, q: np.ndarray, same: bool) -> Iterator[tuple[int, int, int, int]]:
        """(anchor, slot, id, score) for anchors of one label."""
        ids, label = b.column("vec_id").to_numpy(), b.column("label")[0].as_py()
        small = self.most * float(np.abs(q).max(initial=0)) * max(1, q.shape[1]) < 2.0**50
        if same:
            floor = b.column("floor").to_numpy(zero_copy_only=False)
            if small:
                found = self.positives(label, ids, q, floor)
            else:
                found = self.exact(label, True, ids, q, [[(LOW, HIGH)]] * len(q), POSITIVES)
        else:
            lows, highs = b.column("lows").to_pylist(), b.column("highs").to_pylist()
            if small:
                # a range beyond all scores here is empty, and floats hold what is within exactly
                limit = float(1 << 53)
                low, high = np.full((len(q), POSITIVES), np.inf), np.full((len(q), POSITIVES), -np.inf)
                for i, (a, c) in enumerate(zip(lows, highs)):
                    low[i, : len(a)], high[i, : len(c)] = np.clip(np.array(a, float), -limit, limit), np.clip(np.array(c, float), -limit, limit)
                found = self.negatives(label, ids, q, low, high)
            else:
                found = self.exact(label, False, ids, q, [list(zip(a, c)) for a, c in zip(lows, highs)], NEGATIVES)
        names = b.column("anchor").to_pylist()
        for i, s, j, x in found:
            yield names[i], s, j, x


def searched(same: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of the anchors (kind 1) of each part, whose rows (kind 0) come before them; anchors lie by label.

    Each run of anchors also gives a row without an anchor: how many pairs of all were scored.
    """
    current, held, parts = None, [], {}
    for b in batches:
        key = list(zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), [x if k else 0 for x, k in zip(b.column("label").to_pylist(), b.column("kind").to_pylist())]))
        starts = [i for i in range(len(key)) if not i or key[i] != key[i - 1]] + [len(key)]
        for s, e in zip(starts[:-1], starts[1:]):
            some, (name, kind, _) = b.slice(s, e - s), key[s]
            if name != current:
                current, held, parts = name, [], {}
            if kind == 0:
                held.append(some)
                continue
            if held:
                for dim in {d for r in held for d in np.unique(r.column("embedding").value_lengths()).tolist()}:
                    mine = [r for h in held for d, r in by_length(h, "embedding") if d == dim]
                    parts[dim] = Part(*(np.concatenate([r.column(c).to_numpy() for r in mine]) for c in ("vec_id", "label")), np.concatenate([vectors(r.column("embedding")) for r in mine]))
                held = []
            for dim, asked in by_length(some, "embedding"):
                if dim not in parts:
                    continue
                part = parts[dim]
                for at in range(0, asked.num_rows, ANCHORS):
                    mine, was = asked.slice(at, ANCHORS), (part.compared, part.pairs)
                    found = list(part.answer(mine, vectors(mine.column("embedding")), same))
                    rows = [(*f, 0, 0) for f in found] + [(None, None, None, None, part.compared - was[0], part.pairs - was[1])]
                    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in FOUND.split(", ")])


# --- the whole -----------------------------------------------------------------------------------


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part; vectors keep their type."""
    v = F.col(vector_col)
    fine = F.forall(v.cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("embedding"))
    return kept.filter("vec_id is not null and label is not null and embedding is not null").filter(fine)


@dataclass
class Mined:
    """``negatives``: the result; ``positives``: (anchor, anchor_id, slot, positive_id, positive_score); ``work``: compared, pairs a pass."""

    negatives: DataFrame
    positives: DataFrame
    work: list[DataFrame]


def mine(anchors: DataFrame, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> Mined:
    """Hard negatives of ``anchors``, of the same columns, among ``rows``."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = F.col("label") if label is None else label
    x, q = usable(rows, id_col, vector_col, label), usable(anchors, id_col, vector_col, label)
    kind = x.schema["embedding"].dataType.simpleString()
    none = F.lit(None).cast("array<long>")
    q = materialize(q.distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    leaves = sampled(x)
    splits = spark.sparkContext.broadcast(leaves)  # at most LENGTHS * LEAVES splits
    placed = materialize(x.mapInArrow(lambda b: dealt(splits, b), DEALT.format(kind=kind)), "dealt")
    ends = lambda f, c: F.array(*(f(F.get(c, F.lit(k))) for k in range(FINEST))).alias(c)
    of = placed.mapInArrow(ranges, RANGES).groupBy("length", "leaf").agg(F.sum("n").alias("n"), F.max("size").alias("d"), ends(F.min, "low"), ends(F.max, "high"), ends(F.max, "deviation"))
    at = 0
    for r in of.orderBy("length", "leaf").collect():  # a row a leaf
        name = (r["length"], r["leaf"])
        cut = lambda c: np.array([v for v in r[c] if v is not None], float)  # noqa: B023, E731
        leaves.low[name], leaves.high[name], leaves.deviation[name] = cut("low"), cut("high"), cut("deviation")
        leaves.parts[name] = (at, max(1, math.ceil(r["n"] * (r["d"] + 4) * 8 / PART)))
        at += leaves.parts[name][1]
    shared = spark.sparkContext.broadcast(leaves)
    names = spark.createDataFrame([(*n, *p) for n, p in leaves.parts.items()], "length long, leaf long, first long, parts long")
    extra = f"part long, kind int, anchor long, vec_id long, label long, embedding {kind}, floor double, lows array<long>, highs array<long>"
    data = placed.join(F.broadcast(names), ["length", "leaf"]).select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("anchor"),
        "vec_id", "label", "embedding", F.lit(None).cast("double").alias("floor"), none.alias("lows"), none.alias("highs"),
    )

    def meet(asked: DataFrame, step: str) -> DataFrame:
        both = data.unionByName(asked.mapInArrow(lambda b: sent(shared, step, b), extra))
        order = both.repartition(tasks, "part").sortWithinPartitions("part", "kind", F.when(F.col("kind") == 1, F.col("label")))
        return materialize(order.mapInArrow(functools.partial(searched, step != "range"), FOUND), step)

    def best(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
        return found.filter("anchor is not null").select("anchor", "slot", "vec_id", "score", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)

    asks = lambda d, floor: d.select("anchor", "vec_id", "label", "embedding", floor.alias("floor"), none.alias("lows"), none.alias("highs"))
    seed = meet(asks(q, F.lit(float("-inf"))), "seed")
    floors = best(seed, POSITIVES).groupBy("anchor").agg(F.min("score").cast("double").alias("held"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == POSITIVES)
    # a long beyond 2^53 rounds to the nearest double, which may lie above it
    under = F.col("held") - F.when(F.abs("held") > 2.0**52, 2048.0).otherwise(0.0)
    rest = meet(asks(q.join(floors, "anchor", "left"), F.coalesce(under, F.lit(float("-inf")))), "rest")
    first = best(seed.unionByName(rest), POSITIVES).select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    first = materialize(first, "positives")
    # 50 p <= 100 n <= 95 p in whole numbers: n from ceil(p / 2) to floor(19 p / 20)
    p = F.col("positive_score")
    low = F.ceil(p.cast("decimal(20,0)") / 2).cast("long")
    high = F.floor(p.cast("decimal(20,0)") * 19 / 20).cast("long")
    asked = first.filter(low <= high).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", low.alias("low"), high.alias("high")))).alias("r"))  # at most POSITIVES a row
    ranged = q.join(asked, "anchor").select("anchor", "vec_id", "label", "embedding", F.lit(float("-inf")).alias("floor"), F.col("r.low").alias("lows"), F.col("r.high").alias("highs"))
    found = meet(ranged, "range")
    place = asked.select("anchor", F.posexplode("r").alias("at", "r")).select("anchor", F.col("at").alias("slot"), F.col("r.slot").alias("of"))
    whole = first.join(q.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    chosen = best(found, NEGATIVES).join(place, ["anchor", "slot"]).select("anchor", F.col("of").alias("slot"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = chosen.join(whole, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    work = [d.filter("anchor is null").agg(F.sum("compared").alias("compared"), F.sum("pairs").alias("pairs")) for d in (seed, rest, found)]
    return Mined(out, whole, work)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.filter("vec_id % 50 = 0"), rows, label=label).negatives


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_inner_product(a.e, x.e)::BIGINT AS score
  FROM v a JOIN v x ON a.vec_id % 50 = 0 AND a.vec_id <> x.vec_id AND len(a.e) = len(x.e)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
