"""Operators 11 to 13: classifier, hard negatives and prefix trie, against brute force and held-out labels."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import hard_negatives, prefix_trie, radix, rff
from weft.runtime import table

# --- 11: classifier ------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, stats string, hash string, id string, fold string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "l", "s", 1, "x", "h", "i", "f") for i, t in rows], DOCS)


def test_statistics_of_any_text():
    for text in (None, "", " \n\t", "a", "|", "x" * 100_000, "é😀 \n" * 50, "A B\nA B\nc!", "\udcff"):
        found = rff.statistics_of(text)
        assert len(found) == len(rff.STATISTICS) and all(map(math.isfinite, found))
    assert rff.statistics_of(None) == rff.statistics_of("")
    got = dict(zip(rff.STATISTICS, rff.statistics_of("A B\nA B\nc! c!")))
    assert got["log_words"] == pytest.approx(math.log1p(6)) and got["dup_line_share"] == pytest.approx(1 / 3) and got["repeats"] == pytest.approx(1 / 6)
    assert got["shouted_words"] == pytest.approx(4 / 6) and got["marked_words"] == pytest.approx(2 / 6) and got["top_word"] == pytest.approx(2 / 6)
    whole = " ".join(f"w{i}" for i in range(5000))
    assert rff.statistics_of(whole + " a b c d e" * 3000) != rff.statistics_of(whole)  # texts are read to their end


def test_features_approximate_a_gaussian_kernel():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(30, 6))
    f = rff.drawn(np.zeros(6), np.ones(6), n=20_000, width=1.0)
    z = f(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 6))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_isotonic_is_the_least_squares_fit():
    rnd = random.Random(2)
    for _ in range(200):
        k = rnd.randint(1, 12)
        n = np.array([rnd.randint(1, 5) for _ in range(k)], float)
        y = np.array([rnd.randint(0, int(c)) for c in n], float)
        s = np.cumsum([rnd.random() + 0.01 for _ in range(k)]) * n
        raw, share = rff.isotonic(s, y, n)
        assert (np.diff(raw) > 0).all() and (np.diff(share) > 0).all() and share.min() > 0 and share.max() < 1
        y[0] += 1
        n[0] += 1
        n[-1] += 1
        mean = lambda a, b: y[a : b + 1].sum() / n[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)]
        assert np.allclose(sorted({round(w, 9) for w in want}), share)


def test_sums_of_partitions_are_the_normal_equations(spark):
    rnd = np.random.default_rng(5)
    x, y, fold = rnd.normal(size=(300, len(rff.STATISTICS))), rnd.integers(0, 2, 300).astype(float), np.arange(300) % 3
    train = spark.createDataFrame([(v.tolist(), float(a), int(f)) for v, a, f in zip(x, y, fold)], "stats array<double>, y double, fold int").repartition(5)
    features = rff.drawn(x.mean(0), x.std(0), n=100)
    eq, z = rff.equations(train, features), features(x)
    for f in range(3):
        a, b, yy, n = eq[f]
        assert np.allclose(a, z[fold == f].T @ z[fold == f]) and np.allclose(b, z[fold == f].T @ y[fold == f]) and (yy, n) == (y[fold == f].sum(), 100)
    w = rff.solved(list(eq.values()), 1e-3)
    ridge = np.diag([0.3] * 100 + [3e-7])
    assert np.allclose((z.T @ z + ridge) @ w, z.T @ y)


def test_classifier_on_held_out_labels(spark, data):
    got = {r.doc_id: r for r in rff.op11_quality_classifier(spark, data).collect()}
    docs = {r.doc_id for r in table(spark, data, "documents").select("doc_id").collect()}
    assert set(got) == docs and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    known = [(got[r.doc_id], r.quality) for r in table(spark, data, "labels").collect() if r.doc_id in got]
    for held in (True, False):
        some = [(r, q) for r, q in known if r.held_out == held]
        assert sum(r.predicted == q for r, q in some) >= 0.85 * len(some)


def test_classifier_learns_only_from_teaching_rows(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    teaches = lambda c: F.coalesce(rff.crc(c) % 3 != 1, F.lit(True))
    turned = labels.withColumn("quality", F.when(teaches("doc_id"), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = ({r.doc_id: r.score for r in rff.classify(docs, x, teaches).collect()} for x in (labels, turned))
    assert a == pytest.approx(b, abs=1e-6)


def test_classifier_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, None, 0), (4, 7, 0), (None, 1, 0), (5, 1, None), (5, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(None, None), (None, "a"), (1, "good words in a line."), (1, None), (2, "### $$$ !!!"), (2, "### $$$ !!!"), (3, ""), (9, "x" * 300_000), (6, "&&& ***"), (5, "a b")]
    every = lambda c: F.lit(True)
    got = rff.classify(documents(spark, rows), labels, every).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got if r.doc_id) == sorted((i is None, i) for i, _ in rows if i) and len(got) == len(rows)
    assert len({r.score for r in got if r.doc_id == 2}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 and r.predicted == 1 for r in rff.classify(documents(spark, rows), labels.filter("quality = 1"), every).collect())
    assert rff.classify(documents(spark, rows), labels.limit(0), every).count() == len(rows)
    assert rff.classify(documents(spark, []), labels, every).count() == 0
    small = rff.training(rff.statistics(documents(spark, [(i, f"w{i}") for i in range(2000)])), spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")), every, 200)
    assert 120 < small.count() < 300  # the sample's size is a bound in expectation


# --- 12: hard negatives --------------------------------------------------------------------------


def plain_mining(rows, anchors):
    """(anchor, positive, rank, negative, scores) by comparing everything; rows are (id, vector, label)."""
    lo, hi = -(1 << 63), (1 << 63) - 1
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and fine(v)]
    out = []
    for ai, av, ac in sorted({(i, tuple(v), c) for i, v, c in rows if anchors(i)}):
        scored = [(-min(hi, max(lo, sum(a * b for a, b in zip(av, v)))), i, c) for i, v, c in rows if i != ai and len(v) == len(av)]
        for ps, pi, _ in sorted(x for x in scored if x[2] == ac)[:5]:
            p = -ps
            found = sorted(x for x in scored if x[2] != ac and 50 * p <= -100 * x[0] <= 95 * p)[:3]
            out += [(ai, pi, k, ni, p, -n) for k, (n, ni, _) in enumerate(found, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<{}>, label int, score string, anchor string, part string, kind string, mean string"


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x", "a", "p", "k", "m") for r in rows], VECTORS.format(kind))


def mined(df, anchors):
    return hard_negatives.mine(df.filter(anchors), df)


def test_segment_bounds_hold():
    rnd = np.random.default_rng(2)
    for dim in (1, 3, 12, 64, 100):
        a, b = np.floor(256 * rnd.normal(size=(20, dim))), np.floor(256 * rnd.normal(size=(30, dim)) + 50)
        wide = math.inf
        for k in hard_negatives.LEVELS:
            lo, hi = hard_negatives.Summary.of(a, k).bounds(hard_negatives.Summary.of(b, k))
            assert (lo <= a @ b.T).all() and (a @ b.T <= hi).all()
            assert (hi - lo).mean() <= wide * (1 + 1e-6) + 1e-6  # finer segments are never looser
            wide = (hi - lo).mean()


@pytest.mark.parametrize("shift", [0.0, 0.4])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, shift):
    rnd = np.random.default_rng(7)
    centers = rnd.normal(size=(5, 20)) + shift
    rows = [(i, [float(np.float32(x)) for x in centers[i % 5] + 0.3 * rnd.normal(size=20)], int(rnd.integers(0, 4))) for i in range(900)]
    rows += [(2000 + i, rows[50][1], i % 3) for i in range(60)] + [(100, rows[3][1], 1)] * 7 + [(3000, [1.0, 2.0], 1), (3001, [1.0, 1.5], 2), (3002, [1.0, 3.0], 1), (3050, [], 1), (3051, [], 2), (3052, [], 1)]
    odd = [(4000, None, 1), (4050, [None] + [0.0] * 19, 1), (4100, [float("nan")] * 20, 1), (4150, [float("inf")] * 20, 1), (None, [1.0] * 20, 1), (4200, [1.0] * 20, None)]
    for rows_, part in ((400, 4000), (50, 1000)):
        monkeypatch.setattr(hard_negatives, "ROWS", rows_)
        monkeypatch.setattr(hard_negatives, "PART", part)
        got = sorted(map(tuple, mined(vectors(spark, rows + odd), "vec_id % 50 = 0").negatives.collect()))
        assert got == plain_mining(rows + odd, lambda i: i % 50 == 0) and got


def test_hard_negatives_of_huge_scores_and_rare_lengths(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(1e5, 4e6), rnd.choice([2.5, 1e6]), rnd.uniform(1, 4e6)], i % 2) for i in range(40)]
    rows += [(50 + i, [rnd.choice([1e15, -1e15, 1.0, 1e300]) for _ in range(3)], i % 2) for i in range(20)]
    rows += [(100 + i, [1.0 + 0.1 * (i % 7)] * (1 + i // 6), i % 3) for i in range(120)]
    monkeypatch.setattr(hard_negatives, "LENGTHS", 2)
    got = sorted(map(tuple, mined(vectors(spark, rows, "double"), "vec_id % 10 = 0").negatives.collect()))
    assert got == plain_mining(rows, lambda i: i % 10 == 0) and any(abs(r[4]) > 1 << 53 for r in got)


def test_summaries_settle_most_pairs_of_structured_vectors(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    level = rnd.normal(size=(40, 8)).repeat(4, axis=1)
    rows = [(i, [float(x) for x in level[i % 40] + 0.02 * rnd.normal(size=32)], i % 40 % 10) for i in range(4000)]
    monkeypatch.setattr(hard_negatives, "ROWS", 100)
    monkeypatch.setattr(hard_negatives, "PART", 30_000)
    found = mined(vectors(spark, rows), "vec_id % 200 = 0")
    assert sorted(map(tuple, found.negatives.collect())) == plain_mining(rows, lambda i: i % 200 == 0)
    seed, rest, ranged = (w.first() for w in found.work)
    whole = 20 * 4000
    assert rest.compared < 0.1 * whole and ranged.compared < 0.5 * whole


def test_hard_negatives_of_nothing(spark):
    df = vectors(spark, [(50, [1.0], 1), (1, [1.0], 1)])
    assert mined(df, "vec_id % 50 = 0").negatives.count() == 0
    assert mined(df.limit(0), "true").negatives.count() == 0 and mined(df, "false").negatives.count() == 0
    zero = vectors(spark, [(50, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2), (3, [0.0], 2)])
    assert sorted(map(tuple, mined(zero, "vec_id % 50 = 0").negatives.collect())) == [(50, 1, 1, 2, 0, 0), (50, 1, 2, 3, 0, 0)]


# --- 13: prefix trie -----------------------------------------------------------------------------


def test_radix_tree_holds_any_keys():
    rnd = random.Random(4)
    for alphabet, size in ((2, 300), (20, 2000), (256, 3000)):
        keys = {bytes(rnd.randrange(alphabet) for _ in range(rnd.choice([0, 1, 2, 5, 16]))) for _ in range(size)}
        tree, order = radix.Tree(), list(keys)
        rnd.shuffle(order)
        for k in order:
            tree.put(k, k)
        kinds, out, stack = set(), [], [(tree.root, 0)]
        while stack:
            node, start = stack.pop()
            assert node.start == start and (node.leaf is None or node.leaf == node.key[: node.end])
            if node.leaf is not None:
                out.append(node.leaf)
            if node.below is not None:
                assert node.leaf is not None or len(list(node.below)) > 1 or node is tree.root  # paths are compressed
                kinds.add((type(node.below).__name__, getattr(node.below, "room", 0)))
                stack += [(c, node.end) for c in reversed(list(node.below))]
        assert out == sorted(keys)  # children come in the order of their bytes
    assert kinds >= {("Few", 4), ("Direct", 0)}


def plain_trie(rows):
    """Nodes of (conv_id, turn, role, text) rows, by dictionaries of prefixes."""
    convs: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    convs = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    nodes: dict = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    words = lambda p: len(p[-1][1].encode().split()) if p else 0
    kids = {p: 0 for p in nodes}
    leaves, saved = dict(kids), dict(kids)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, c in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(c) - 1) * words(p)
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if built[c] == p).encode()).hexdigest() for p in nodes}
    return sorted(repr((min(c), len(p), min(nodes[p[:-1]]) if p else None, len(c), kids[p], leaves[p], saved[p], ends[p])) for p, c in nodes.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONVERSATIONS = "conv_id long, turn long, role string, text string, base string, key string, words string, node string, parent string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "b", "k", "w", "n", "p") for r in rows], CONVERSATIONS)


def nodes_of(df, **how):
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(df)), **how)
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in found.collect())


def made(seed, n=120, variety=3, longest=6):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-30, 3 * n), n):
        for turn in range(rnd.randint(1, longest)):
            text = " ".join(f"w{rnd.randrange(variety)}" for _ in range(rnd.randrange(3)))
            rows.append((c, turn, rnd.choice(["user", "assistant", None]), text or None))
    return rows


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_trie_equals_brute_force(spark, most):
    rows = made(most)
    rows += [(5000 + i, t, "user", f"same {t}") for i in range(70) for t in range(4)]  # whole copies
    rows += [(9000 + i, t, "user", f"line {t}" if t < 3 else f"x {i}") for i in range(40) for t in range(4)]  # one host prefix
    rows += [(1_000_000, t, "user", f"t {t % 5}") for t in range(300)] + [(1_000_020, t, "user", f"t {t % 5}") for t in range(299)]
    assert nodes_of(conversations(spark, rows), most=most) == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    assert nodes_of(conversations(spark, [])) == []
    rows = [(None, 1, "user", "x"), (3, None, None, None), (3, None, None, None), (3, 1, "", ""), (3, 1, "user", "a  b"), (20, 5, "user", "y" * 50_000), (21, 1, "user", "z"), (22, 1, "user", "z"), (43, 1, "a", "bc"), (45, 1, "ab", "c")]
    assert nodes_of(conversations(spark, rows)) == plain_trie(rows)
    assert nodes_of(conversations(spark, [(None, 1, "user", "x")])) == []


def test_runs_and_edges_without_spark():
    """Any cut of the sorted keys into runs gives the same trie, also inside a group of equal keys."""
    rnd = random.Random(6)
    for _ in range(60):
        keys = []
        for c in range(rnd.randint(1, 40)):
            turns = [rnd.randrange(3) for _ in range(rnd.randint(0, 5))]
            keys.append((b"".join(bytes([7] * 15 + [t]) for t in turns), np.array([t + 1 for t in turns], np.int64), c))
        keys.sort(key=lambda k: (k[0], k[2]))
        whole = None
        for most in (1, 2, 3, 7, 100):
            inside, edge, run, number = [], [], prefix_trie.Run(), 0
            for i, k in enumerate(keys):
                run.add(*k)
                if run.full(most) or i == len(keys) - 1:
                    rows = run.rows(0, number)
                    inside += [r for r in rows if r[4] is None]
                    edge += [r for r in rows if r[4] is not None]
                    run, number = prefix_trie.Run(), number + 1
            edge.sort(key=lambda r: r[:3])
            closed = [x for b in prefix_trie.joined(prefix_trie.batches_of(edge)) for x in pa.RecordBatch.to_pylist(b)]
            found = sorted([(r[3], r[6], r[8], r[9], r[10], r[11] - r[12], r[15]) for r in inside] + [(r["depth"], r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in closed])
            whole = whole or found
            assert found == whole
