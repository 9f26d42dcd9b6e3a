"""Operator 5, token-id output: fixed-width bit packing with block offsets.

A token file is a table of *shards* in ascending document order. A shard is a run of whole documents:
its header row says how many bits an id takes (the fewest that hold the vocabulary), how many ids a
block has, the byte offset of each block and the id offset of each document; its payload is the packed
ids, each block starting at a byte. Any document is read by unpacking only the blocks it touches, with
numpy's bit operations. The table is written by Spark's Parquet writer, so it lands on any store.

One shuffle deals documents out by ranges of the order column, and each task encodes its range in order
and writes it as shards. Positions in the whole output come from a prefix sum over the shards' totals.

Defined results: null or empty text is just the end id; rows with equal order values are ordered by a
hash of their texts, then by the texts; a null order value comes first; an empty table gives an empty
table; other columns are not read; a text is never cut, and one beyond SHARD ids is a shard of its own.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.byte_bpe import byte_characters, vocabulary_path
from weft.llm.segments import SegmentCodes
from weft.runtime import scratch_path, table

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
BLOCK = 1024
#: Ids after which a shard is closed; a longer document is a shard of its own.
SHARD = 1 << 20
#: Bytes of texts for one range, where the session's number of partitions would give more to each.
RANGE = 256 << 20
SHARD_SCHEMA = (
    "range int, seq int, first_id long, n_docs long, n_ids long, bits int, block int, "
    "doc_ids array<long>, doc_offsets array<long>, block_offsets array<long>, payload binary"
)


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """Packed bytes and the byte offset of each block (one more than blocks)."""
    n = len(ids)
    if bits in (8, 16, 32):
        payload = np.ascontiguousarray(ids, f">u{bits // 8}").tobytes()
        ends = np.minimum(np.arange(0, n + block, block), n) * (bits // 8)
        return payload, ends[: -(-n // block) + 1]
    wide = np.ascontiguousarray(ids, ">u4").view(np.uint8).reshape(n, 4)
    out, offsets = [], [0]
    for at in range(0, n, block):
        planes = np.unpackbits(wide[at : at + block], axis=1)[:, 32 - bits :]
        out.append(np.packbits(planes).tobytes())
        offsets.append(offsets[-1] + len(out[-1]))
    return b"".join(out), np.array(offsets)


def unpack(payload: bytes, offsets, bits: int, start: int, end: int, block: int = BLOCK) -> np.ndarray:
    """Ids start..end of a shard; reads only the blocks that hold them."""
    if end <= start:
        return np.empty(0, np.uint32)
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(payload, f">u{width}", end - start, start * width).astype(np.uint32)
    first, last = start // block, (end - 1) // block
    parts = []
    for b in range(first, last + 1):
        count = min(block, (end if b == last else (b + 1) * block) - b * block)
        raw = np.frombuffer(payload, np.uint8, offsets[b + 1] - offsets[b], offsets[b])
        planes = np.zeros((count, 32), np.uint8)
        planes[:, 32 - bits :] = np.unpackbits(raw, count=count * bits).reshape(count, bits)
        parts.append(np.packbits(planes, axis=1).view(">u4").reshape(-1).astype(np.uint32))
    return np.concatenate(parts)[start - first * block : end - first * block]


#: Letters of which a run is one piece in any version of the pattern's tables.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")


def letters(s: str) -> bool:
    return s.isalpha() and (s.isascii() or LETTERS.fullmatch(s) is not None)


class JoinedCodes(SegmentCodes):
    """Segments through the tokenizers library.

    A word of letters alone is one piece, so the library's model gets it byte-mapped and at once. A
    letter before a closing comma or stop ends a piece, so such a word's ids are those of the word and
    of the mark. Other segments are joined to one text: among its ids, just the first of each word is
    a token that starts with a space; line starts are told apart by the line end's own id.
    """

    def __init__(self, tok, tokens: list[bytes]):
        super().__init__(id_type(len(tokens)))
        self.tok = tok
        self.spaced = np.array([t[:1] == b" " for t in tokens])
        self.newline = tokens.index(b"\n")
        self.marks = {m: np.array([tokens.index(m.encode())], self.dtype).tobytes() for m in ",."}
        self.names = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def whole(self, text: str) -> bytes:
        return self.ids(text).astype(self.dtype).tobytes() if text else b""

    def cut(self, ids: np.ndarray, starts: list[int]) -> list[bytes]:
        raw, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        return [raw[s * width : e * width] for s, e in zip(starts, [*starts[1:], len(ids)])]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each with a space before it."""
        if not words:
            return []
        space, gap = " ".translate(self.names), "\n".translate(self.names)
        mapped = "\n".join(words).encode().decode("latin-1").translate(self.names).split(gap)
        found = [[t.id for t in self.tok.model.tokenize(space + w)] for w in mapped]
        starts = np.cumsum([0, *map(len, found)])[:-1].tolist()
        return self.cut(np.array([i for ids in found for i in ids], np.int64), starts)

    def joined(self, segments: list[str], lead: str) -> list[bytes]:
        if not segments:
            return []
        ids = self.ids("".join([lead + s for s in segments]))
        at = np.flatnonzero(self.spaced[ids] if lead else ids == self.newline)
        if len(at) != len(segments):  # a vocabulary in which ids don't tell where a segment starts
            return [self.whole(lead + s) for s in segments]
        return self.cut(ids, at.tolist())

    def learn(self, names: list[str]) -> list[bytes]:
        kinds: dict[str, list[str]] = {"word": [], "mark": [], "line": [], "other": []}
        for s in names:
            if letters(s):
                kinds["word"].append(s)
            elif s[-1] in ",." and letters(s[:-1]):
                kinds["mark"].append(s)
            else:
                kinds["line" if s[0] == "\n" else "other"].append(s)
        bare = {s[:-1] for s in kinds["mark"]}.difference(self.known, self.older, kinds["word"])
        words = kinds["word"] + list(bare)
        new = dict(zip(words, self.words(words)))
        new |= zip(kinds["other"], self.joined(kinds["other"], " "))
        new |= zip(kinds["line"], self.joined(kinds["line"], ""))
        for s in kinds["mark"]:
            new[s] = (new.get(s[:-1]) or self.known.get(s[:-1]) or self.older[s[:-1]]) + self.marks[s[-1]]
        return [new[s] for s in names]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> tuple[JoinedCodes, int]:
    """Encoder of texts, and the vocabulary's size; one for each worker."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # their strings in a text are ordinary text
    size = tok.get_vocab_size()
    byte = {c: b for b, c in enumerate(byte_characters())}
    tokens = [bytes(byte.get(c, 0) for c in tok.id_to_token(i)) for i in range(size)]
    return JoinedCodes(tok, tokens), size


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, out_path: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Write the ids of all documents, each with ``end_id``, to ``out_path`` in ascending id order.

    Texts are dealt out by ranges of (id, hash of the text), so rows of one id can fill many ranges. There are
    ``parts`` of them, by default as many as leave about RANGE bytes to each, and no fewer than the session's partitions.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("salt", F.xxhash64("text"))
    order = [F.asc_nulls_first("id"), F.asc("salt")]
    dealt = rows.repartitionByRange(parts or ranges_of(rows), *order)
    ordered = dealt.sortWithinPartitions(*order, F.asc_nulls_first("text")).select("id", "text")
    ordered.mapInArrow(functools.partial(write_shards, path, end_id), SHARD_SCHEMA).write.parquet(out_path)


def ranges_of(rows: DataFrame) -> int:
    """How many ranges the texts of ``rows`` need."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))


def write_shards(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shards of one range, whose rows (id, text) come in order."""
    codes, size = encoder(path)
    bits, key, seq = bits_for(size), TaskContext.get().partitionId(), 0
    docs, held, lengths, total = [], [], [], 0

    def shard() -> pa.RecordBatch:
        payload, blocks = pack(np.concatenate(held), bits)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        row = [key, seq, next((d for d in docs if d is not None), None), len(docs), total, bits, BLOCK, docs, ends, blocks, payload]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SHARD_ARROW)], schema=SHARD_ARROW)

    end = np.array([end_id], codes.dtype)
    for b in batches:
        ids_of_rows, at = b.column(0).to_pylist(), 0
        for ids, sizes in codes.runs(b.column(1)):
            start = 0
            for n in sizes.tolist():
                if docs and total + n + 1 > SHARD:
                    yield shard()
                    seq, docs, held, lengths, total = seq + 1, [], [], [], 0
                docs.append(ids_of_rows[at])
                held += [ids[start : start + n], end]
                lengths.append(n + 1)
                total, start, at = total + n + 1, start + n, at + 1
    if docs:
        yield shard()


LONGS = pa.list_(pa.int64())
SHARD_ARROW = pa.schema(
    [("range", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("block", pa.int32())]
    + [("doc_ids", LONGS), ("doc_offsets", LONGS), ("block_offsets", LONGS), ("payload", pa.binary())]
)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(range, seq, before): how many ids all shards before hold.

    A prefix sum in two steps: over the totals of the ranges, one small row a range, and within each range.
    """
    totals = shards.groupBy("range").agg(F.sum("n_ids").alias("n"))
    before = lambda by, n: F.coalesce(F.sum(n).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = totals.select("range", before(Window.orderBy("range"), "n").alias("low"))
    inside = shards.select("range", "seq", before(Window.partitionBy("range").orderBy("seq"), "n_ids").alias("at"))
    return inside.join(ranges, "range").select("range", "seq", (F.col("low") + F.col("at")).alias("before"))


def read_digests(shards: DataFrame) -> DataFrame:
    """One row a document from the packed shards: doc_id, start, n_tokens, ids_crc32.

    Payloads are unpacked where they are read; only the documents' small rows meet the shards' starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                ends = row["doc_offsets"]
                ids = unpack(row["payload"], row["block_offsets"], row["bits"], 0, row["n_ids"], row["block"]).astype("<u4")
                spans = list(zip(ends[:-1], ends[1:]))
                cols = [row["doc_ids"], [s for s, _ in spans], [e - s for s, e in spans], [zlib.crc32(ids[s:e]) for s, e in spans]]
                places = [pa.array([row[c]] * len(spans), pa.int32()) for c in ("range", "seq")]
                yield pa.RecordBatch.from_arrays([*places, *(pa.array(c, pa.int64()) for c in cols)], names=["range", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    packed = shards.select("range", "seq", "n_ids", "bits", "block", "doc_ids", "doc_offsets", "block_offsets", "payload")
    rows = packed.mapInArrow(run, "range int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    both = rows.join(shard_starts(shards), ["range", "seq"])
    return both.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_document(shards: DataFrame, doc_id: int) -> np.ndarray | None:
    """Random access: the ids of one document, unpacked from its blocks alone.

    Shards are in document order, so the document is in the last one that starts no later; the others are told by
    their first ids alone. Of several documents with that id it is one in that shard.
    """
    first = shards.filter(F.col("first_id") <= doc_id).agg(F.max("first_id")).first()[0]
    at = F.array_position("doc_ids", F.lit(doc_id).cast("long"))
    row = shards.filter(F.col("first_id") == first).withColumn("k", at).filter("k > 0").first() if first is not None else None
    if row is None:
        return None
    s, e = row["doc_offsets"][row["k"] - 1], row["doc_offsets"][row["k"]]
    return unpack(bytes(row["payload"]), row["block_offsets"], row["bits"], s, e, row["block"])


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents"), out, vocabulary_path(VOCABULARY))
    return read_digests(read_token_files(spark, out))
