"""Operator 10, byte-level BPE encoding and decoding through a sentencepiece model.

The model is serialised straight from a rank file: every token's bytes become one printable character
each, its score is its negative rank, the type is BPE and normalisation is the identity. Merging by
highest score is then merging by lowest rank. A text is cut into pre-tokens by the vocabulary's
pattern, each is byte-mapped and encoded by sentencepiece; decoding maps each id back to its bytes.

Defined results: null or empty text has no ids and decodes to nothing; repeated rows repeat; an empty
table gives an empty table; other columns are not read. Lone surrogates cannot come out of Spark.
One pass without a shuffle; a text is encoded segment by segment, so its length doesn't matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.segments import SegmentCodes
from weft.runtime import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> str:
    """256 printable characters: a byte that is one in Latin-1 stands for itself, others for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(0x100, 0x200))
    return "".join(chr(b if b in set(plain) else next(extra)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank; ranks must run from 0 without a gap."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(r): base64.b64decode(t) for t, r in pairs}
    return [tokens[k] for k in range(len(tokens))]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def message(number: int, body: bytes) -> bytes:
    """A length-delimited protobuf field."""
    return varint(number << 3 | 2) + varint(len(body)) + body


def flag(number: int, value: int) -> bytes:
    return varint(number << 3) + varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto; piece k is token k, and the unknown piece comes after them all.

    Field numbers are those of sentencepiece_model.proto: pieces 1 (piece 1, score 2, type 3),
    trainer 2 (model_type 3, vocab_size 4, unk_id 40, bos_id 41, eos_id 42, pad_id 43),
    normalizer 3 (name 1, charsmap 2, dummy prefix 3, remove spaces 4, escape spaces 5).
    """
    names = byte_characters()
    pieces = []
    for rank, token in enumerate(tokens):
        score = b"\x15" + np.float32(-rank).tobytes()
        pieces.append(message(1, message(1, "".join(names[b] for b in token).encode()) + score + flag(3, 1)))
    pieces.append(message(1, message(1, b"<unk>") + b"\x15" + np.float32(0).tobytes() + flag(3, 2)))
    none = (1 << 64) - 1  # -1 as a 64-bit varint
    trainer = flag(3, 2) + flag(4, len(tokens) + 1) + flag(40, len(tokens)) + flag(41, none) + flag(42, none) + flag(43, none)
    normal = message(1, b"identity") + message(2, b"") + flag(3, 0) + flag(4, 0) + flag(5, 0)
    return b"".join(pieces) + message(2, trainer) + message(3, normal)


class ByteBpe(SegmentCodes):
    """Encoder and decoder for one vocabulary."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        super().__init__("<u2" if len(self.tokens) <= 1 << 16 else "<u4")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.cut = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.names = [str(i).encode() for i in range(len(self.tokens))]
        self.latin = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})

    def pieces(self, text: str) -> list[str]:
        """Byte-mapped pre-tokens of a text."""
        return [p.encode().decode("latin-1").translate(self.latin) for p in self.cut(text)]

    def whole(self, text: str) -> bytes:
        found = self.model.encode(self.pieces(text), num_threads=1) if text else []
        return np.array([i for ids in found for i in ids], self.dtype).tobytes()

    def learn(self, names: list[str]) -> list[bytes]:
        each = [self.pieces(s if s[0] == "\n" else " " + s) for s in names]
        found = iter(self.model.encode([p for ps in each for p in ps], num_threads=1))
        return [np.array([i for _ in ps for i in next(found)], self.dtype).tobytes() for ps in each]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.of([text])[0], self.dtype).tolist()

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


@functools.lru_cache(maxsize=1)
def loaded(path: str) -> ByteBpe:
    """One encoder for each Python worker."""
    return ByteBpe(path)


def digests(bpe: ByteBpe, texts: pa.Array) -> list[tuple[int, str, str]]:
    """Number of ids, digest of the ids in decimal, and digest of what they decode to, for each text."""
    out = []
    for ids, sizes in bpe.runs(texts):
        at = 0
        for n in sizes.tolist():
            mine, at = ids[at : at + n].tolist(), at + n
            written = b",".join([bpe.names[i] for i in mine])
            out.append((n, hashlib.sha256(written).hexdigest(), hashlib.sha256(bpe.decode(mine)).hexdigest()))
    return out


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, digest of the ids in decimal joined by commas, digest of the decoded bytes."""
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([source.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            if b.num_rows:
                n, ids, text = zip(*digests(bpe, b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], names=schema.names)

    return source.mapInArrow(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary_path())
