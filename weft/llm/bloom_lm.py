"""Operator 8, LM scoring: a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and of word pairs come from all training documents. A count c is stored as its level
1 + floor(log2(c)): the filter holds the entries (n-gram, 1) ... (n-gram, level), and a reader probes
levels upward until one is missing (Talbot and Osborne, 2007). The filter is cut into segments by the
high bits of the keys, and each segment has PER_ENTRY bits for every entry of its own, so no n-gram is
left out at any size. Errors are one-sided: a level may be read too high with a chance of about two in
a hundred.

Texts are cut into words once and kept as chunks. Neighbouring segments make a run of about RUN_TOKENS
tokens, and each chunk sends one packed row of its distinct keys and their training counts to each run,
so a row's size follows chunks and runs and not the number of segments. A run's task sums the counts,
cuts the keys into segments, builds their bits and answers the exact counts of the words. A filter of at
most BITS bits, which twice the training tokens bound before anything is counted, is broadcast and
probed where the chunks are scored. Beyond that, the run's task probes its bits for the keys it got, and
levels travel back with the answers. Both ways read the same bits, so scores are the same. A key is sent
once by each chunk, however often it occurs there, and a task holds one run or one chunk at a time.

A text's score is the sum of log10 P(word | word before) from the filter's counts alone, with Dirichlet
smoothing toward the add-half unigram estimate. The base score uses the exact counts of all words.

Defined results: null or empty text is the end token alone; a null id counts as remainder 0; repeated
rows are scored alike and count as often as they occur; an empty table gives an empty table; other
columns are not read; a text is never cut, and one beyond CHUNK bytes is a chunk of its own. Words are
told apart by 64-bit hashes. With no training documents every score uses N = V = 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.segments import slices
from weft.llm.superminhash import GOLDEN, ROLL, U64, mix
from weft.runtime import materialize, table

#: At most so many bits in a filter that is broadcast (64 MiB), so many for each entry, and probes of each entry.
BITS, PER_ENTRY, PROBES = 1 << 29, 9, 4
#: Training and other tokens for each segment of the filter, and the fewest segments.
SEGMENT_TOKENS, LEAST_SEGMENTS = 1 << 20, 256
#: Tokens whose keys a task holds at once, as one run of segments.
RUN_TOKENS = 1 << 24
#: Weight of the unigram estimate, in tokens.
PRIOR = 3.0
END = U64(0xE17A1465D2C0FFEE)
#: Bytes of texts that make a chunk.
CHUNK = 6 << 20


# --- chunks: texts as numbered words -------------------------------------------------------------


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys: the first, the bytes of the widest gap, and the gaps in so many bytes each."""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return keys[:1].tobytes() + bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    if len(data) < 9:
        return np.empty(0, U64)
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[8])
    gaps = np.zeros((len(raw), 8), np.uint8)
    gaps[:, : data[8]] = raw
    return np.cumsum(np.concatenate([np.frombuffer(data, U64, 1), gaps.view(U64).ravel()]), dtype=U64)


def planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers by place, so that the high ones, mostly zeros, take little when compressed."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : data[0]] = raw.T
    return out.view(np.int64).ravel()


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending hashes of the distinct words and the end, each text's tokens, and which hash each token is."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = parts.flatten().dictionary_encode()
    names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat.dictionary)], pa.int32()), flat.dictionary), " ")[0].as_py().encode().split(b" ")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), U64, len(names))
    words, to = np.unique(np.append(hashes[[n != b"" for n in names]], END), return_inverse=True)
    place = np.zeros(len(names), np.int64)
    place[[n != b"" for n in names]] = to[:-1]
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    if b"" in names:  # white space at the ends of a text
        full = code != names.index(b"")
        code, row = code[full], row[full]
    lengths = np.bincount(row, minlength=len(texts)) + 1
    codes = np.full(int(lengths.sum()), to[-1], np.int64)
    codes[np.arange(len(code)) + row] = place[code]
    return words, lengths, codes


@dataclass(frozen=True)
class Chunk:
    """The words of some texts: hashes, tokens of each text, which hash each token is, and which texts are held out."""

    words: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    held_out: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def before(self) -> np.ndarray:
        """The number of the token before each; the end token before the first of a text."""
        out = np.empty_like(self.codes)
        out[1:] = self.codes[:-1]
        out[0] = np.searchsorted(self.words, END)  # every text ends with it, so it also stands before the next
        return out

    def pairs(self) -> np.ndarray:
        h = self.words
        return mix(mix(h * ROLL + GOLDEN)[self.before()] + h[self.codes])

    def pack(self) -> list[bytes]:
        return [pack(self.words), planes(self.lengths), planes(self.codes), np.packbits(self.held_out).tobytes()]

    @staticmethod
    def unpack(words: bytes, lengths: bytes, codes: bytes, held_out: bytes) -> Chunk:
        n = unplanes(lengths)
        return Chunk(unpack(words), n, unplanes(codes), np.unpackbits(np.frombuffer(held_out, np.uint8), count=len(n)).astype(bool))


PACKED = ("words", "lengths", "codes", "held_out")


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, held_out, text) as one row for each chunk."""
    np.seterr(over="ignore")
    k = 0
    for b in batches:
        at = 0
        for texts in slices(pc.fill_null(b.column(2), ""), CHUNK):
            rows = b.slice(at, len(texts))
            at += len(texts)
            held = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
            c = Chunk(*numbered(texts), held)
            kept = pa.StructArray.from_arrays(rows.columns[:2], fields=list(rows.schema)[:2])
            sums = [[TaskContext.get().partitionId() << 32 | k], [int(c.lengths.sum())], [int(c.lengths[~held].sum())]]
            k += 1
            cols = [*(pa.array(s, pa.int64()) for s in sums), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([x], pa.binary()) for x in c.pack())], names=["chunk", "n", "n_train", "rows", *PACKED])


# --- the filter ----------------------------------------------------------------------------------


def probes(keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
    """PROBES numbers below 2 ** 32 for each key and level."""
    x = mix(keys + GOLDEN * U64(level))
    step = (x << U64(31)) | U64(1)
    for _ in range(PROBES):
        yield x >> U64(32)
        x = x + step


def built(keys: np.ndarray, level: np.ndarray, per_entry: int) -> np.ndarray:
    """Bits of a segment that holds levels 1 to ``level`` of each key, packed."""
    size = max(64, -(-int(level.sum()) * per_entry // 64) * 64)
    bits = np.zeros(size, np.bool_)
    for k in range(1, int(level.max(initial=0)) + 1):
        for p in probes(keys[level >= k], k):
            bits[p * U64(size) >> U64(32)] = True
    return np.packbits(bits, bitorder="little")


def probe(bits: np.ndarray, keys: np.ndarray, base: np.ndarray | int, size: np.ndarray | int) -> np.ndarray:
    """Highest level up to which all levels of each key are found in its segment of ``bits``."""
    out, live = np.zeros(len(keys), np.int8), np.arange(len(keys))
    base, size = (np.broadcast_to(np.asarray(x, U64), len(keys)) for x in (base, size))
    level = 0
    while len(live):
        level += 1
        found = np.ones(len(live), bool)
        for p in probes(keys[live], level):
            at = base[live] + (p * size[live] >> U64(32))
            found &= (bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)
        live = live[found]
        out[live] = level
    return out


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(c)), 0 for none."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int8)


def mean_count(level: np.ndarray) -> np.ndarray:
    """Mean count of a level; 0 for none."""
    x = level.astype(np.float64)
    return np.where(x > 0, (2.0 ** (x - 1) + 2.0**x - 1) / 2, 0.0)


def cut(keys: np.ndarray, shift: int) -> tuple[np.ndarray, list[slice]]:
    """The groups of ascending keys that share their bits above ``shift``: names and places."""
    names, starts = np.unique((keys >> U64(shift)).astype(np.int64), return_index=True)
    return names, [slice(s, e) for s, e in zip(starts, [*starts[1:], len(keys)])]


@dataclass(frozen=True)
class Layout:
    """How many segments the filter has, how many runs they make and how many tasks share the runs; powers of two but the last."""

    segments: int
    runs: int
    tasks: int

    @staticmethod
    def of(tokens: int, tasks: int) -> Layout:
        """At least ``tasks`` tasks, and more where runs of RUN_TOKENS leave each of them over four."""
        segments = LEAST_SEGMENTS
        while segments * SEGMENT_TOKENS < tokens:
            segments *= 2
        runs = 1
        while runs < segments and (runs < tasks or runs * RUN_TOKENS < tokens):
            runs *= 2
        return Layout(segments, runs, max(min(tasks, runs), runs // 4))

    @staticmethod
    def shift(names: int) -> int:
        """Bits below the name of one of ``names`` equal ranges of keys."""
        return 65 - names.bit_length()


def sent(shift: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, chunk, order, keys, counts): each chunk's distinct words (1) and pairs (2) with their training counts."""
    np.seterr(over="ignore")
    for b in batches:
        for k in range(b.num_rows):
            c = Chunk.unpack(*(b.column(i)[k].as_py() for i in range(1, 5)))
            train = ~c.held_out[c.row]
            words = np.bincount(c.codes[train], minlength=len(c.words))
            all_pairs = c.pairs()
            pairs = np.unique(all_pairs)
            some, n = np.unique(all_pairs[train], return_counts=True)
            counts = np.zeros(len(pairs), np.int64)
            counts[np.searchsorted(pairs, some)] = n
            for order, keys, x in ((1, c.words, words), (2, pairs, counts)):
                names, places = cut(keys, shift)
                cols = [pa.array(names), pa.array([b.column(0)[k].as_py()] * len(names), pa.int64()), pa.array([order] * len(names), pa.int8())]
                cols += [pa.array([pack(keys[at]) for at in places], pa.binary()), pa.array([planes(x[at]) for at in places], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["run", "chunk", "order", "keys", "counts"])


ANSWER = "run long, chunk long, order byte, levels binary, counts binary, segment long, bits binary, distinct long"


def segments_of(layout: Layout, run: int, entries: list[tuple[np.ndarray, np.ndarray]], per_entry: int) -> list[np.ndarray]:
    """Bits of each segment of a run, from (ascending keys, levels) of the words and of the pairs."""
    each = layout.segments // layout.runs
    edges = np.array([(run * each + k) << Layout.shift(layout.segments) for k in range(1, each)], U64)
    cuts = [np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]) for keys, _ in entries]
    some = lambda x, c, k: x[c[k] : c[k + 1]]
    return [built(*(np.concatenate([some(e[i], c, k) for e, c in zip(entries, cuts)]) for i in (0, 1)), per_entry) for k in range(each)]


def answered(layout: Layout, per_entry: int, probing: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to the rows of ``sent``, which come by run; then each segment's bits, unless they are probed here, and the
    run's number of distinct training words."""
    np.seterr(over="ignore")
    names = [f.split()[0] for f in ANSWER.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int8(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
    each, shift = layout.segments // layout.runs, Layout.shift(layout.segments)

    def flush(run: int, held: list[tuple]) -> pa.RecordBatch:
        out, distinct, entries = [], 0, []
        asked = []
        for order in (1, 2):
            rows = [(chunk, unpack(keys), unplanes(counts)) for chunk, o, keys, counts in held if o == order]
            if not rows:
                continue
            keys, back = np.unique(np.concatenate([k for _, k, _ in rows]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, back, np.concatenate([c for _, _, c in rows]))
            entries.append((keys[total > 0], levels_of(total[total > 0])))
            asked.append((order, [(chunk, len(k)) for chunk, k, _ in rows], keys, back, total))
            if order == 1:
                distinct = int((total > 0).sum())
        bits = segments_of(layout, run, entries, per_entry)
        sizes = np.array([len(b) * 8 for b in bits], U64)
        starts, joined = np.cumsum(sizes) - sizes, np.concatenate(bits)
        for order, rows, keys, back, total in asked:
            if probing:
                at_segment = (keys >> U64(shift)).astype(np.int64) - run * each
                level = probe(joined, keys, starts[at_segment], sizes[at_segment])
            at = 0
            for chunk, n in rows:
                mine, at = back[at : at + n], at + n
                if order == 1 or probing:
                    out.append((run, chunk, order, level[mine].tobytes() if probing else None, planes(total[mine]) if order == 1 else None, None, None, None))
        if not probing:
            out += [(run, None, None, None, None, run * each + k, b.tobytes(), None) for k, b in enumerate(bits)]
        out.append((run, None, None, None, None, None, None, distinct))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    current, held = None, []
    for b in batches:
        for run, *row in zip(*(c.to_pylist() for c in b.columns)):
            if held and run != current:
                yield flush(current, held)
                held = []
            current = run
            held.append(row)
    if held:
        yield flush(current, held)


@dataclass(frozen=True)
class Model:
    """Totals, and the filter where it is broadcast: its bits, and the first bit and the size of each segment."""

    total: int
    distinct: int
    shift: int
    bits: np.ndarray | None = None
    starts: np.ndarray | None = None
    sizes: np.ndarray | None = None

    def levels(self, keys: np.ndarray) -> np.ndarray:
        segment = (keys >> U64(self.shift)).astype(np.int64)
        return probe(self.bits, keys, self.starts[segment], self.sizes[segment])

    def unigram(self, c):
        return (c + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def log10(self, before_counts, pair_counts, word_counts) -> np.ndarray:
        p = (np.minimum(pair_counts, before_counts) + PRIOR * self.unigram(word_counts)) / (before_counts + PRIOR)
        return np.log10(np.minimum(p, 1.0))


def whole_filter(answers: DataFrame, model: Model, segments: int) -> Model:
    """The model with all bits, of which the training tokens have shown that there are at most BITS."""
    rows = answers.filter("bits is not null").select("segment", "bits").toArrow()
    order = np.argsort(rows.column("segment").to_numpy())
    parts = [rows.column("bits")[int(k)].as_py() for k in order]
    sizes = np.full(segments, 64, np.int64)
    starts = np.zeros(segments, np.int64)
    at = rows.column("segment").to_numpy()[order]
    sizes[at] = [len(p) * 8 for p in parts]
    starts[at] = np.cumsum(sizes[at]) - sizes[at] + 64  # a segment that no key named is 64 empty bits
    bits = np.frombuffer(bytes(8) + b"".join(parts), np.uint8)
    return Model(model.total, model.distinct, model.shift, bits, starts, sizes)


# --- scores --------------------------------------------------------------------------------------


def scored(c: Chunk, m: Model, exact: np.ndarray, word_level: np.ndarray, pair_level: np.ndarray | None, pairs: np.ndarray) -> list[pa.Array]:
    """n_tokens, n_known, base_score and score of each text of a chunk."""
    add = lambda x: np.bincount(c.row, x, len(c.lengths))
    words = mean_count(word_level)
    pair = mean_count(pair_level[np.searchsorted(np.unique(pairs), pairs)] if pair_level is not None else m.levels(pairs))
    lm = m.log10(words[c.before()], pair, words[c.codes])
    base = np.log10(m.unigram(exact.astype(np.float64)))
    return [pa.array(c.lengths), pa.array(add((exact > 0)[c.codes]).astype(np.int64)), pa.array(add(base[c.codes])), pa.array(add(lm))]


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, per_entry: int = PER_ENTRY) -> DataFrame:
    """Scores of every row of ``docs``; the model learns from the rows that aren't ``held_out``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    packed = ", ".join(f"{c} binary" for c in PACKED)
    chunks = materialize(rows.mapInArrow(chunked, f"chunk long, n long, n_train long, rows array<struct<id:{id_type},held_out:boolean>>, {packed}"), "chunks")
    n, total = (x or 0 for x in chunks.agg(F.sum("n"), F.sum("n_train")).first())
    layout = Layout.of(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    run_shift = Layout.shift(layout.runs)
    # a token adds at most one entry for its word and one for its pair
    apart = 2 * total * per_entry + 128 * layout.segments > bits
    requests = chunks.select("chunk", *PACKED).mapInArrow(lambda b: sent(run_shift, b), "run long, chunk long, order byte, keys binary, counts binary")
    # runs are equal ranges of hashes, so tasks that get equal numbers of them get equal work
    met = requests.repartitionById(layout.tasks, F.expr(f"cast(run * {layout.tasks} div {layout.runs} as int)")).sortWithinPartitions("run")
    answers = materialize(met.mapInArrow(lambda b: answered(layout, per_entry, apart, b), ANSWER), "answers")
    distinct = answers.agg(F.sum("distinct")).first()[0] or 0
    model = Model(total, distinct, Layout.shift(layout.segments))
    shared = spark.sparkContext.broadcast(model if apart else whole_filter(answers, model, layout.segments))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        m = shared.value
        levels: dict[int, list[bytes]] = {1: [], 2: []}
        counts: list[np.ndarray] = []
        for b in batches:
            for k in range(b.num_rows):
                order = b.column(2)[k].as_py()
                if order is not None:
                    levels[order].append(b.column(3)[k].as_py() or b"")
                    if order == 1:
                        counts.append(unplanes(b.column(4)[k].as_py()))
                    continue
                c = Chunk.unpack(*(b.column(i)[k].as_py() for i in range(6, 10)))
                told = [np.frombuffer(b"".join(levels[o]), np.int8) for o in (1, 2)] if apart else [m.levels(c.words), None]
                cols = scored(c, m, np.concatenate(counts), *told, c.pairs())
                levels, counts = {1: [], 2: []}, []
                yield pa.RecordBatch.from_arrays([*b.column(5)[k].values.flatten(), *cols], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    # a chunk's answers by run, which is the order of its keys, and then the chunk
    told_of = answers.filter("chunk is not null").select("run", "chunk", "order", "levels", "counts")
    both = told_of.unionByName(chunks.drop("n", "n_train"), allowMissingColumns=True)
    both = both.repartition(layout.tasks, "chunk").sortWithinPartitions("chunk", F.asc_nulls_last("run")).select("chunk", "run", "order", "levels", "counts", "rows", *PACKED)
    found = both.mapInArrow(finish, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return score_documents(table(spark, sf_dir, "documents"), held_out)
