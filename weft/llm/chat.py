"""Operator 9, chat formatting in Spark expressions only.

The rows of a conversation are collected as structs and sorted by turn; adjacent turns of one role
become one block by array aggregation; blocks are concatenated to one string. A block is

    ### role:\\n text </turn>

and the texts of merged turns are divided by ``<part>``. Control strings inside texts and roles are
made harmless by a backslash *within* them (``<\\/turn>``, ``<\\part>``, ``#\\##``) and each backslash
is doubled, so no escaped text holds a control string, whatever stands next to it, and taking away one
backslash of each pair restores the text. The loss mask is a list of spans of assistant texts, as byte
and as code-point offsets into the formatted string.

Defined results: a null text is empty; a null role is ``unknown``; rows of equal turn are ordered by
role and text, a null turn first; repeated rows are repeated turns; an empty table gives an empty
table; a null conv_id is a conversation of its own; other columns are not read. Rows of a conversation
are merged by partial aggregation before the shuffle; its one output row is as long as its texts, and
work is linear in its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.runtime import materialize, table

TURN_END, PART, HEAD = "</turn>", "<part>", "### "
ODD_TEXT = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\)|(?<=<)(?=/turn>|part>)|(?<=#)(?=##)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(turns: Column) -> Column:
    """Adjacent turns of one role as one struct of the role and its texts."""

    def of(v: Column) -> Column:
        first = F.transform(v["role"], lambda r, i: F.when((i == 0) | (r != F.get(v["role"], i - 1)), i))
        return let(F.array_compact(first), lambda heads: merged(v, heads))

    def merged(v: Column, heads: Column) -> Column:
        ends = F.concat(F.slice(heads, 2, F.size(heads)), F.array(F.size(v["role"])))
        return F.zip_with(heads, ends, lambda s, e: F.struct(F.get(v["role"], s).alias("role"), F.slice(v["text"], s + 1, e - s).alias("parts")))

    return let(F.struct(turns["role"].alias("role"), turns["text"].alias("text")), of)


def formatted(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: ``id_col``, formatted, loss_spans (code points), loss_bytes (bytes)."""
    one = rows.select(
        F.col(id_col).alias("id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.regexp_replace(escape(F.coalesce(F.col(role_col), F.lit("unknown"))), "(?<=:)(?=\n)", r"\\").alias("role"),
            escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    conv = one.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    conv = conv.withColumn("blocks", blocks(F.col("turns")))
    # pieces: each text, and the control strings around it, in order
    head = lambda b: F.concat(F.lit(HEAD), b["role"], F.lit(":\n"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def of_block(b: Column) -> Column:
        loss = b["role"] == "assistant"
        texts = F.transform(
            b["parts"],
            lambda t, i: F.array(piece(F.when(i == 0, head(b)).otherwise(F.lit(PART)), F.lit(False)), piece(t, loss)),
        )
        return F.concat(F.flatten(texts), F.array(piece(F.lit(TURN_END + "\n"), F.lit(False))))

    conv = conv.select("id", F.flatten(F.transform("blocks", of_block)).alias("pieces"))
    return conv.select(
        F.col("id").alias(id_col),
        F.array_join(F.col("pieces")["text"], "").alias("formatted"),
        mask(F.col("pieces"), F.length).alias("loss_spans"),
        mask(F.col("pieces"), F.octet_length).alias("loss_bytes"),
    )


#: Elements of a run that ``running`` sums at once, and levels of runs: beyond the longest array there can be.
RUN, LEVELS = 32, 6


def running(x: Column, levels: int = LEVELS) -> Column:
    """The sum of the elements before each one: that of the runs before its run, and of the run's elements before it.

    The sums of runs are taken in the same way, so work is linear in the elements.
    """
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda n, k: n + k)

    def of(x: Column) -> Column:
        last = F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / RUN).cast("int")
        runs = F.transform(F.sequence(F.lit(0), last), lambda r: total(F.slice(x, r * RUN + 1, F.lit(RUN))))
        before = running(runs, levels - 1) if levels else F.array(zero)
        return let(before, lambda b: F.transform(x, lambda _, i: F.get(b, F.floor(i / RUN).cast("int")) + total(F.slice(x, i - i % RUN + 1, i % RUN))))

    return let(x, of)


def mask(pieces: Column, length) -> Column:
    """Start and length of each piece under the loss, by running sums of the pieces before it."""

    def of(lengths: Column) -> Column:
        spans = F.zip_with(running(lengths), lengths, lambda s, n: F.struct(s.alias("start"), n.alias("n")))
        marked = F.zip_with(spans, pieces["loss"], lambda s, loss: F.when(loss, s))
        return F.array_compact(marked)

    return let(F.transform(pieces, lambda p: length(p["text"]).cast("long")), of)


def parsed(text: Column) -> Column:
    """The turns of a formatted string: array of (role, text), merged ones apart again."""
    rows = F.filter(F.split(text, "</turn>\n"), lambda s: s != "")

    def of_block(s: Column) -> Column:
        role = F.substring_index(s, ":\n", 1)
        body = F.substring(s, F.length(role) + F.lit(3), F.length(s))
        name = unescape(F.substring(role, F.lit(len(HEAD) + 1), F.length(role)))
        return F.transform(F.split(body, PART), lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(rows, of_block))


def read_back(out: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of what the formatted strings and their masks hold."""
    turns = out.select(id_col, "formatted", "loss_bytes", parsed(F.col("formatted")).alias("turns"))
    bytes_ = F.col("formatted").cast("binary")
    cut = F.transform("loss_bytes", lambda s: unescape(F.substring(bytes_, (s["start"] + 1).cast("int"), s["n"].cast("int")).cast("string")))
    return turns.withColumn("loss", F.array_join(cut, "")).select(
        F.col(id_col),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_odd_conversation(rows: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts hold control strings."""
    odd = rows.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ODD_TEXT).alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(odd)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(materialize(formatted(with_odd_conversation(table(spark, sf_dir, "conversations"))), "chat"))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM c),
s AS (
  SELECT conv_id, role, text, k,
    length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
      + len(regexp_extract_all(text, '</turn>|<part>'))
      + list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda h: length(h) - 2))::BIGINT AS n,
    CASE WHEN role IS NOT DISTINCT FROM before THEN 6 ELSE 4 + length(role) + 2 END
      + CASE WHEN role IS NOT DISTINCT FROM after THEN 0 ELSE 8 END AS around FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(coalesce(n, length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '</turn>|<part>'))) + around)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
