"""Operator 11, quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Each whole text is one row of statistics (``STATISTICS``), all of them counts and shares made in one pass
over its bytes, words and lines. Cosines of D random projections of the standardised statistics
approximate a Gaussian kernel, so a linear fit on them is a kernel fit whose size doesn't depend on the
rows. Tasks add up their rows' normal equations (D x D), by fold; the sums of all tasks meet in as many
small groups as there are blocks of rows of the matrix, and the driver solves D equations for each fold.

Folds do three things in the one pass: the ridge penalty is the one whose fits predict the folds they
haven't seen best, which the sums of a fold are enough to tell; each row's raw score by the fit without
its fold calibrates; and the fit of all folds scores. Calibration pools adjacent violators over at most
BINS counted bins and is interpolated between the pools, so that scores keep their order.

At most about SAMPLE labelled documents fit the model, chosen by a hash of their id, so the labels that
are broadcast and the rows of the fit are bounded; every document is scored.

Defined results: a null or empty text has no bytes, words or lines, and is scored like any other; texts
are never cut. Labels other than 0 and 1, or of a null id, are no labels; an id with several has their
mean. An id with several rows teaches its text of least hash, once. A null id is in no fold and not held
out. Without labels of both classes every score is 0.5. Equal texts have equal scores; repeated rows
repeat. An empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.runtime import materialize, table

#: Labelled documents that fit the model, about; tasks that add up their normal equations.
SAMPLE, TASKS = 200_000, 24
#: Random features, width of the kernel in units of the root of the number of statistics, folds, bins of the calibration.
FEATURES, WIDTH, FOLDS, BINS, SEED = 384, 1.5, 3, 400, 11
#: Ridge penalties tried, as shares of the rows; standardised statistics are held to +-REACH.
PENALTIES, REACH = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1), 4.0

#: Bytes of each kind, counted from one histogram of a text's bytes.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "comma": b",;:",
    "stop": b".",
    "mark": b"!?",
    "bar": b"|",
    "symbol": b"#*$%&<>=~^_\\{}[]@",
    "quote": b"\"'()/-+",
}
STATISTICS = (
    "log_words", "word_bytes", "word_spread", "log_lines", "line_words", "dup_line_share", "dup_line_bytes", "distinct_words", "top_word", "repeats",
    "window_repeats", "shouted_words", "marked_words", *KINDS, "other_bytes",
)
MARKED = frozenset(b"#*$%&|<>!?=~^_\\{}[]@")


def statistics_of(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``STATISTICS``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()  # ASCII white space, as in [^\x20\x09-\x0D]+
    lines = [line for line in data.split(b"\n") if line.strip()]
    n, size = max(1, len(words)), max(1, len(data))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen: set[bytes] = set()
    twice = [line for line in lines if line in seen or seen.add(line)]  # type: ignore[func-returns-value]
    repeats = float((ids[1:] == ids[:-1]).sum()) / n
    windows = 0.0
    if len(words) >= 5:
        with np.errstate(over="ignore"):
            key = ids[: len(ids) - 4].copy()
            for k in range(1, 5):
                key = key * np.int64(6364136223846793005) + ids[k : len(ids) - 4 + k] + np.int64(1442695040888963407)
        windows = 1 - len(np.unique(key)) / len(key)
    shares = [float(count[list(kind)].sum()) / size for kind in KINDS.values()]
    return [
        np.log1p(len(words)),
        np.log1p(float(lengths.mean())),
        np.log1p(float(lengths.std())),
        np.log1p(len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        len(twice) / max(1, len(lines)),
        sum(map(len, twice)) / size,
        np.log1p(len(number)) / np.log1p(n),
        float(np.bincount(ids).max()) / n if len(ids) else 0.0,
        repeats,
        windows,
        sum(w.isupper() for w in words) / n,
        sum(w[-1] in MARKED or w[0] in MARKED for w in words) / n,
        *np.sqrt(shares).tolist(),
        float(count[128:].sum()) / size,
    ]


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, hash, stats), some rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            some = b.slice(at, 256)
            stats = pa.array([statistics_of(t.as_py()) for t in some.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([some.column("id"), some.column("hash"), stats], names=["id", "hash", "stats"])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash of the text, stats) of every row; one map, no shuffle."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(described, f"id {kind}, hash long, stats array<double>")


# --- the fit -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Features:
    """Standardisation of the statistics and the random projections; cosines of these are the features."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) * self.scale, -REACH, REACH)
        z = np.cos(x @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([z, np.ones((len(x), 1))], 1)


def drawn(mean: np.ndarray, deviation: np.ndarray, n: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> Features:
    """Features of a Gaussian kernel of that width; a statistic that doesn't vary counts nothing."""
    rnd = np.random.default_rng(seed)
    frequencies = rnd.standard_normal((len(mean), n)) / (width * np.sqrt(len(mean)))
    scale = np.where(deviation > 1e-9, 1 / np.maximum(deviation, 1e-9), 0.0)
    return Features(mean, scale, frequencies, rnd.uniform(0, 2 * np.pi, n))


def rows_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1 if len(column) else len(STATISTICS))


BLOCK = 64
SUMS = "fold int, block int, task int, sums binary"


def added_up(features: Features, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normal equations of a task's rows by fold, cut into blocks of BLOCK rows of the matrix.

    The last column is Z'y, and one more block holds y'y and the number of rows.
    """
    from pyspark import TaskContext

    sums: dict[int, list] = {}
    for b in batches:
        z, y, fold = features(rows_of(b.column("stats"))), b.column("y").to_numpy(), b.column("fold").to_numpy()
        for f in np.unique(fold).tolist():
            mine = fold == f
            parts = [z[mine].T @ np.concatenate([z[mine], y[mine, None]], 1), np.array([[float((y[mine] ** 2).sum()), mine.sum()]])]
            sums[f] = [a + c for a, c in zip(sums[f], parts)] if f in sums else parts
    out = []
    for f, (m, rest) in sums.items():
        out += [(f, k, TaskContext.get().partitionId(), m[at : at + BLOCK].tobytes()) for k, at in enumerate(range(0, len(m), BLOCK))]
        out.append((f, -1, TaskContext.get().partitionId(), rest.tobytes()))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["fold", "block", "task", "sums"])


def met(rows: pa.Table) -> pa.Table:
    """The sums of all tasks for one block of one fold, added in the order of the tasks."""
    rows = rows.sort_by("task")
    total = sum(np.frombuffer(s.as_py(), np.float64) for s in rows.column("sums"))
    return pa.table({"fold": rows.column("fold")[:1], "block": rows.column("block")[:1], "task": rows.column("task")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def equations(train: DataFrame, features: Features) -> dict[int, tuple[np.ndarray, np.ndarray, float, float]]:
    """Z'Z, Z'y, y'y and the number of rows of each fold."""
    partial = train.select("stats", "y", "fold").mapInArrow(functools.partial(added_up, features), SUMS)
    found = partial.groupBy("fold", "block").applyInArrow(met, SUMS).orderBy("fold", "block").collect()  # FOLDS * (D / BLOCK + 1) rows
    size, out = len(features.phases) + 1, {}
    for f in sorted({r["fold"] for r in found}):
        rest, *blocks = [np.frombuffer(r["sums"], np.float64) for r in found if r["fold"] == f]
        m = np.concatenate(blocks).reshape(size, size + 1)
        out[f] = (m[:, :size], m[:, size], float(rest[0]), float(rest[1]))
    return out


def solved(parts: list[tuple], penalty: float) -> np.ndarray:
    a, b, n = sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[3] for p in parts)
    ridge = np.full(len(a), penalty * n)
    ridge[-1] = 1e-9 * n  # the constant is free
    return np.linalg.solve(a + np.diag(ridge), b)


def unseen_error(eq: dict[int, tuple], penalty: float) -> float:
    """Squared error on each fold of the fit on the others, from the folds' sums alone."""
    total = 0.0
    for f, (a, b, yy, _) in eq.items():
        w = solved([p for g, p in eq.items() if g != f], penalty)
        total += yy - 2 * float(w @ b) + float(w @ a @ w)
    return total


def isotonic(score: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools of adjacent violators: mean raw score and share of good rows of each, both rising.

    ``score``, ``y`` and ``n`` are sums over bins in rising order. One good row below all and one bad row above all
    keep the ends off 0 and 1.
    """
    pools: list[list[float]] = []
    y, mean, n = y.astype(float), score / n, n.astype(float)
    y[0] += 1
    n[0] += 1
    n[-1] += 1
    score = mean * n
    for s, g, k in zip(score, y, n):
        pools.append([s, g, k])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


@dataclass(frozen=True)
class Model:
    """Features, weights, and the calibration's points (raw score, share)."""

    features: Features | None
    weights: np.ndarray | None
    raw: np.ndarray
    share: np.ndarray

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), 0.5)
        return np.interp(self.features(stats) @ self.weights, self.raw, self.share)


def raw_scores(features: Features, weights: dict[int, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(raw, y) of each row by the fit that hasn't seen its fold."""
    for b in batches:
        z, fold = features(rows_of(b.column("stats"))), b.column("fold").to_numpy()
        raw = np.zeros(len(z))
        for f, w in weights.items():
            raw[fold == f] = z[fold == f] @ w
        yield pa.RecordBatch.from_arrays([pa.array(raw), b.column("y")], names=["raw", "y"])


def crc(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def training(stats: DataFrame, labels: DataFrame, teaches: Callable[[str], Column], sample: int) -> DataFrame:
    """(id, y, fold, stats) of labelled documents that may teach, in at most TASKS partitions."""
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & teaches("doc_id"))
    marked = marked.groupBy(F.col("doc_id").alias("id")).agg(F.avg("quality").cast("double").alias("y"))
    known = materialize(marked, "marked")
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    rows = stats.join(F.broadcast(known), "id")  # about SAMPLE pairs of numbers at most
    one = rows.groupBy("id", "y").agg(F.min(F.struct("hash", "stats")).alias("of"))
    fold = F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(FOLDS)).cast("int")
    return materialize(one.select("id", "y", fold.alias("fold"), F.col("of.stats").alias("stats")).repartition(TASKS, "id").sortWithinPartitions("id"), "training")


def fit(train: DataFrame) -> Model:
    none = Model(None, None, np.empty(0), np.empty(0))
    at = lambda k: F.get("stats", F.lit(k))
    sums = train.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("share"), *(F.avg(at(k)).alias(f"m{k}") for k in range(len(STATISTICS))), *(F.stddev_pop(at(k)).alias(f"d{k}") for k in range(len(STATISTICS)))).first()
    if not sums["n"] or not 0 < sums["share"] < 1:
        return none
    # sums of tasks meet in any order: half the digits are the same each time
    mean, deviation = (np.array([sums[f"{c}{k}"] for k in range(len(STATISTICS))]).astype(np.float32).astype(float) for c in "md")
    features = drawn(mean, deviation)
    eq = equations(train, features)
    if len(eq) == 1:  # one fold alone: it is fitted and calibrated on the same rows
        eq = {**eq, -1: next(iter(eq.values()))}
    penalty = min(PENALTIES, key=lambda p: unseen_error(eq, p))
    without = {f: solved([p for g, p in eq.items() if g != f], penalty) for f in eq}
    raw = materialize(train.mapInArrow(functools.partial(raw_scores, features, without), "raw double, y double"), "raw")
    cuts = raw.select(F.percentile_approx("raw", [k / BINS for k in range(1, BINS)], 10_000).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("raw")))
    bins = raw.groupBy(place.alias("bin")).agg(F.sum("raw").alias("s"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # BINS rows at most
    points = isotonic(*(np.array([r[c] for r in bins], float) for c in ("s", "y", "n")))
    return Model(features, solved([p for f, p in eq.items() if f >= 0], penalty), *(p.astype(np.float32).astype(float) for p in points))


def scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = [model(rows_of(b.column("stats").slice(at, 4096))) for at in range(0, b.num_rows, 4096)]
        out = np.concatenate(score) if score else np.empty(0)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("hash"), pa.array(out)], names=["id", "hash", "score"])


def classify(docs: DataFrame, labels: DataFrame, teaches: Callable[[str], Column], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``id_col``, hash of the text, score and predicted of every row; ids that don't ``teaches`` teach nothing."""
    stats = materialize(statistics(docs, id_col, text_col), "statistics")
    model = fit(training(stats, labels, teaches, sample))
    kind = stats.schema["id"].dataType.simpleString()
    out = stats.mapInArrow(functools.partial(scored, model), f"id {kind}, hash long, score double")
    return out.select(F.col("id").alias(id_col), "hash", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda c: F.coalesce(crc(c) % 3 == 1, F.lit(False))
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda c: ~held_out(c))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
