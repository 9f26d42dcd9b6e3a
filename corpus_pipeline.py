"""From raw documents to token ids: stages that each take a DataFrame of documents and return one.

Every stage but the last returns the columns of ``documents``. ``run`` writes each result as Parquet
to the shared scratch folder and reads it again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import byte_bpe, mixing, neardup, quality, secrets
from weft.runtime import materialize, scratch_path, table


def packed(docs: DataFrame) -> DataFrame:
    """(row, id, hash): each row whole, beside its doc_id and a hash of its text, as rows may share an id or have none.

    Columns of ``docs`` lie within ``row``, so none meets a name that a stage uses.
    """
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))


def rows_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The packed rows of ``docs`` whose id and text hash are among ``keys`` (id, hash), nulls among them like any other."""
    keys = keys.select(F.col("id").alias("key_id"), F.col("hash").alias("key_hash")).distinct()
    same = F.col("id").eqNullSafe(F.col("key_id")) & (F.col("hash") == F.col("key_hash"))
    return packed(docs).join(keys.hint("shuffle_hash"), same, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list let pass.

    Null or empty texts go; long ones are judged whole. Each row is judged by its own text, also among rows of one
    id. An empty table stays empty; other columns, whatever their names, go along unread.
    """
    judged = quality.judge(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")).filter("kept")
    return rows_of(docs, judged.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of smallest id, then of smallest text hash.

    Of rows equal in id and text one stays. Documents without words are in no group and stay, as does an empty
    table; long texts are compared whole; other columns, whatever their names, go along unread.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    found = neardup.near_duplicates(docs.select(key.alias("doc"), "text"), id_col="doc").filter("kept")
    return rows_of(docs, found.select("doc.id", "doc.hash")).dropDuplicates(["id", "hash"]).select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; a null text stays null, n_chars follows the text.

    Rows of one id are scanned each by its own text, long texts whole; an empty table stays empty; other columns,
    whatever their names, go along unread.
    """
    found = secrets.scan_history(docs.select("doc_id", "text"), scratch_path(spark, "ledger"))
    return secrets.redact(docs, found).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; texts without words never. Equal rows share a fate.

    A null source is one of its own. An empty table stays empty; a long text is taken whole or not; other columns,
    whatever their names, go along unread.
    """
    mix = mixing.Mix()
    few = docs.select("doc_id", "text", "source")
    taken = mixing.mix_sources(few, mix).filter("copies > 0").select(F.col("doc_id").alias("key_id"), F.col("u").alias("key_u"), "copies").distinct()
    both = packed(docs).withColumn("u", mixing.uniform(mix.seed, "row.doc_id", "row.text"))
    both = both.join(taken.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("key_id")) & (F.col("u") == F.col("key_u")))
    return both.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the byte-level BPE ids of every row of the mix, and of what they decode to; null text has no ids.

    Texts are encoded whole; an empty table gives no rows; other columns are not read.
    """
    return byte_bpe.encode_digests(docs, byte_bpe.vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("encode", encode),
]
#: A learned list, hashed sampling and a tokenizer are beyond SQL; tests hold the stages to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
