"""Search over turns: keyword ranking, literal and regex evidence, staged file names, path globs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import checked_regex, fold, fold_text, let, like_contains, like_prefix, preview
from weft.operators.paging import TURN_ORDER, capped, page
from weft.operators.sessions import matches_glob
from weft.runtime import materialize
from weft.schema import TURN_KEY

CONTEXT = 80
#: Evidence fields; tool output takes part on request only.
FIELDS = (
    "user_message", "final_answer", "commentary", "reasoning_summary", "tool_name", "tool_arguments", "tool_output",
    "delegation_summary", "delegation_metadata", "hook_summary", "attachment_metadata", "provider_response_item_metadata",
)
MODES = ("keyword", "literal", "regex", "file-name", "path-fragment", "file-path")
K1, B = 1.2, 0.75


def check_arguments(mode: str, match_limit: int | None = None, include: tuple = (), exclude: tuple = (), tool_output: bool = False) -> tuple[str, ...]:
    """Allowed evidence fields; raises where the flags don't fit the mode or each other."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode not in ("literal", "regex") and (match_limit is not None or include or exclude or tool_output):
        raise ValueError("match limits and fields go with literal and regex search only")
    if unknown := {*include, *exclude} - {*FIELDS}:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    if {*include} & {*exclude}:
        raise ValueError("a field is both included and excluded")
    if "tool_output" in include and not tool_output:
        raise ValueError("tool output must be asked for")
    allowed = [f for f in FIELDS if (f in include or not include) and f not in exclude]
    return tuple(f for f in allowed if f != "tool_output" or tool_output)


# --- keyword -------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters they stand on; both sides of a search fold by this one table."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))[0]) for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def terms(c: Column) -> Column:
    """Lower-cased alphanumeric runs without marks, in order."""
    plain = F.translate(F.lower(c), *accents())
    return F.array_remove(F.split(F.regexp_replace(plain, r"\p{M}+", ""), r"[^\p{L}\p{N}]+"), "")


def terms_of(text: str) -> list[str]:
    """``terms`` of one Python string."""
    low = text.lower().translate(str.maketrans(*accents()))
    kept = "".join(c if unicodedata.category(c)[0] in "LN" else "" if unicodedata.category(c)[0] == "M" else " " for c in low)
    return kept.split()


def index_terms(search: DataFrame, columns: tuple[str, ...], key: list[str]) -> DataFrame:
    """The inverted index: one row a term occurrence, with its column and position; phrases stay within a column."""
    every = F.array(*(F.struct(F.lit(k).alias("col"), terms(F.coalesce(F.col(c), F.lit(""))).alias("terms")) for k, c in enumerate(columns)))
    rows = search.select(*key, F.explode(every).alias("c"))
    return rows.select(*key, F.col("c.col").alias("col"), F.posexplode("c.terms").alias("pos", "term"))


def document_lengths(search: DataFrame, columns: tuple[str, ...], key: list[str]) -> DataFrame:
    """Terms of each row that has any, counted without unfolding them."""
    n = F.lit(0)
    for c in columns:
        n = n + F.size(terms(F.coalesce(F.col(c), F.lit(""))))
    return search.select(*key, n.cast("long").alias("length")).filter("length > 0")


def term_statistics(index: DataFrame, key: list[str]) -> DataFrame:
    """Occurrences of each term, and rows that hold it."""
    per = index.groupBy("term", *key).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("rows"))


def query_phrases(query: str) -> list[list[str]]:
    """Each keyword as the terms it is indexed under; a keyword without any term is an empty phrase."""
    words = [w for w in re.split(r"[^\w.\-\u0300-\u036f]+", query) if w]
    if not words:
        raise ValueError("the query has no keyword")
    return [terms_of(w) for w in words]


def phrase_counts(index: DataFrame, phrases: list[list[str]], key: list[str]) -> DataFrame:
    """``key``, tf0, tf1, ...: how often each phrase occurs in a row that holds one of them.

    One pass over the index: each occurrence of a term proposes the starts of the phrases it belongs to,
    and a start that all terms of a phrase propose is an occurrence of the phrase.
    """
    places: dict[str, list[tuple[int, int]]] = {}
    for k, phrase in enumerate(phrases):
        for j, term in enumerate(phrase):
            places.setdefault(term, []).append((k, j))
    chain = F
    for term, at in places.items():
        chain = chain.when(F.col("term") == term, F.array(*(F.struct(F.lit(k).alias("k"), (F.col("pos") - j).alias("start")) for k, j in at)))
    starts = index.filter(F.col("term").isin(*places)).select(*key, "col", F.inline(chain)).groupBy(*key, "col", "k", "start").agg(F.count(F.lit(1)).alias("n"))
    whole = F.get(F.array(*(F.lit(len(p)) for p in phrases)), F.col("k")) == F.col("n")
    return starts.filter(whole).groupBy(*key).agg(*(F.count_if(F.col("k") == k).alias(f"tf{k}") for k in range(len(phrases))))


def keyword_search(index: DataFrame, lengths: DataFrame, query: str, key: list[str]) -> DataFrame:
    """``key`` and ``score`` of the rows that hold every phrase, by BM25 over the whole corpus."""
    phrases = query_phrases(query)
    if not all(phrases):
        return lengths.select(*key, F.lit(0.0).alias("score")).limit(0)
    tf = phrase_counts(index, phrases, key)
    tf = materialize(tf, "term_counts")
    n = tf.agg(*(F.count_if(F.col(f"tf{k}") > 0).alias(f"n{k}") for k in range(len(phrases))))
    stats = lengths.agg(F.count(F.lit(1)).alias("rows"), F.avg("length").alias("mean"))
    both = tf
    for k in range(len(phrases)):
        both = both.filter(F.col(f"tf{k}") > 0)
    hits = both.join(lengths, key).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(stats))  # one row each
    score = F.lit(0.0)
    for k in range(len(phrases)):
        n_k, tf_k = F.col(f"n{k}"), F.col(f"tf{k}")
        idf = F.greatest(F.log((F.col("rows") - n_k + 0.5) / (n_k + 0.5)), F.lit(1e-6))
        score = score + idf * tf_k * (K1 + 1) / (tf_k + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.select(*key, score.alias("score"))


def ranked_turns(hits: DataFrame, turns: DataFrame, limit: int, offset: int = 0, query: str | None = None) -> DataFrame:
    """The best turns: score, then newest first; given the query, each with a snippet of its texts."""
    keys = page(hits.join(turns.select(*TURN_KEY, "started_at"), TURN_KEY), [F.desc("score"), *TURN_ORDER()], limit, offset)
    if query is None:
        return keys.join(turns.drop("started_at"), TURN_KEY).orderBy(F.desc("score"), *TURN_ORDER())
    # texts are read for the page alone
    rows = keys.join(turns.drop("started_at"), TURN_KEY)
    found = keyword_snippet(query, F.col("user_message"), F.col("final_answer_text"))
    shown = F.coalesce(F.when(F.trim(found) != "", found), preview(F.col("user_message"), 300)[0])
    return rows.withColumn("snippet", shown).orderBy(F.desc("score"), *TURN_ORDER())


# --- evidence ------------------------------------------------------------------------------------


def snippet(text: Column, start: Column, length: Column, context: int = CONTEXT) -> Column:
    """``context`` characters around a match at 0-based ``start``, with ellipses where text is left out."""
    low, high = F.greatest(start - context, F.lit(0)), start + length + context
    cut = F.substring(text, low + 1, high - low)
    return F.concat(F.when(low > 0, F.lit("…")).otherwise(F.lit("")), cut, F.when(high < F.length(text), F.lit("…")).otherwise(F.lit("")))


def literal_matches(evidence: DataFrame, needle: str, fields: tuple[str, ...]) -> DataFrame:
    """Evidence rows of those fields that hold the needle, with a snippet of the first place."""
    if not needle.strip():
        raise ValueError("the search text is blank")
    at = F.locate(needle, F.col("text")) - 1
    return evidence.filter(F.col("field").isin(*fields) & F.col("text").contains(needle)).withColumn("snippet", snippet(F.col("text"), at, F.lit(len(needle))))


def required_literal(pattern: str) -> str | None:
    """The longest literal that every match starts with, if it has 8 characters or more."""
    m = re.match(r"[\w \-/:,=@#%&'\"<>;!~`]+", pattern)
    found = m[0] if m else ""
    if found and m.end() < len(pattern) and pattern[m.end()] in "?*{+|":
        found = found[:-1]
    return found if len(found) >= 8 and "|" not in pattern else None


def regex_matches(evidence: DataFrame, pattern: str, fields: tuple[str, ...]) -> DataFrame:
    """Evidence rows of those fields that match, with a snippet of the first match."""
    java = checked_regex(pattern)
    rows = evidence.filter(F.col("field").isin(*fields))
    if literal := required_literal(pattern):
        rows = rows.filter(F.col("text").contains(literal))  # cheaper than the pattern, and implied by it
    rows = rows.filter(F.col("text").rlike(java))
    at = F.regexp_instr("text", F.lit(java)) - 1
    return rows.withColumn("snippet", snippet(F.col("text"), at, F.length(F.regexp_extract("text", java, 0))))


def turn_hits(matches: DataFrame, key: list[str], limit: int = 20) -> DataFrame:
    """Matches of each turn in order, at most ``limit``; the count is that of the kept ones.

    Ranked within the turn first, so no turn's matches are gathered beyond the limit.
    """
    order = Window.partitionBy(*key).orderBy("evidence_ordinal")
    kept = matches.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit + 1)
    listed = kept.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("evidence_ordinal", "field", "snippet"))).alias("matches"))
    return listed.withColumns(
        {"matches_truncated": F.size("matches") > limit, "matches": F.slice("matches", 1, limit), "matches_count": F.least(F.size("matches"), F.lit(limit)).cast("long")}
    )


# --- files ---------------------------------------------------------------------------------------


def staged(c: Column, query: str) -> Column:
    """0 for the whole name, 1 for a prefix, 2 for a part; null for none. Case of A-Z doesn't count."""
    return F.when(like_contains(c, query), F.when(fold(c) == fold_text(query), 0).when(like_prefix(c, query), 1).otherwise(2))


def file_hits(accesses: DataFrame, stage: Column, key: list[str], shown: Column, cap: int = 20) -> DataFrame:
    """Each turn once, at its best stage, with the first of the paths that matched and how many there are.

    Paths are ranked within the turn before any are gathered, so a turn of very many paths is a sorted run.
    """
    rows = accesses.select(*key, shown.alias("shown"), stage.alias("stage")).filter(F.col("stage").isNotNull())
    each = rows.groupBy(*key, "shown").agg(F.min("stage").alias("stage"))
    ranked = each.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("shown"))))
    out = ranked.groupBy(*key).agg(F.min("stage").alias("stage"), F.sort_array(F.collect_list(F.when(F.col("rn") <= cap, F.col("shown")))).alias("matched_paths"), F.count("shown").alias("matched_paths_count"))
    return out.withColumn("matched_paths_truncated", F.col("matched_paths_count") > cap)


def name_search(accesses: DataFrame, query: str, key: list[str] = TURN_KEY) -> DataFrame:
    return file_hits(accesses, staged(F.col("file_name"), query), key, F.col("path"))


def fragment_search(accesses: DataFrame, query: str, key: list[str] = TURN_KEY) -> DataFrame:
    best = F.least(staged(F.col("repo_relative_path"), query), staged(F.col("path"), query))
    return file_hits(accesses, best, key, F.col("path"))


def glob_search(accesses: DataFrame, glob: str, root: str | None, key: list[str] = TURN_KEY, paths: DataFrame | None = None) -> DataFrame:
    """Turns with an access that matches a glob; with a dictionary, paths are matched there and only hits' accesses kept."""
    if paths is None:
        return file_hits(accesses, F.when(matches_glob(glob, root), 0), key, F.col("path"))
    hits = paths.filter(matches_glob(glob, root, F.col("shown"), F.col("normal"))).select("path_id", F.col("path").alias("__path"))
    return file_hits(accesses.join(hits, "path_id"), F.lit(0), key, F.col("__path"))


def staged_page(hits: DataFrame, turns: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Better stages first, then newest turns."""
    return page(hits.join(turns, TURN_KEY), [F.asc("stage"), *TURN_ORDER()], limit, offset)


def match_range(text: str, query: str, mode: str) -> tuple[int, int] | None:
    """Where a result line matches: the earliest keyword, or the query within the base name of a path."""
    low = fold_text(text)
    if mode == "keyword":
        places = [(low.find(fold_text(w)), len(w)) for w in re.split(r"[^\w.\-]+", query) if w]
        places = [(p, n) for p, n in places if p >= 0]
        return (min(places)[0], min(places)[0] + min(places)[1]) if places else None
    start = text.rfind("/") + 1 if mode == "file-name" else 0
    at = low.find(fold_text(query), start)
    return (at, at + len(query)) if at >= 0 else None


#: A term with what stands before it.
PIECE = r"[^\p{L}\p{N}]*[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


def keyword_snippet(query: str, *texts: Column, width: int = 16) -> Column:
    """The ``width`` terms of one of the texts that hold most of the query's phrases, as the text has them.

    A window starts at each occurrence of a phrase. The best one has most different phrases, then most occurrences,
    then comes first; it is then moved so that its occurrences lie in its middle. Ellipses stand where text is left
    out. Without an occurrence it is the first text's start. Work is linear in the occurrences.
    """
    phrases = query_phrases(query)
    near = width * len(phrases)  # occurrences that one window can hold

    def holds(ts: Column, i: Column, p: list[str]) -> Column:
        return reduce(lambda a, b: a & b, (F.get(ts, i + j) == t for j, t in enumerate(p)))

    def window(found: Column, at: Column, k: Column) -> Column:
        inside = F.filter(F.slice(found, k + 1, near), lambda o: o["at"] < at + width)
        return F.struct(
            F.size(F.array_distinct(F.transform(inside, lambda o: o["phrase"]))).alias("different"),
            F.size(inside).alias("n"),
            (-at).alias("before"),
            F.array_max(F.transform(inside, lambda o: o["end"])).alias("end"),
        )

    def best(c: int, text: Column) -> Column:
        pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
        ts = F.transform(pieces, lambda p: F.get(terms(p), F.lit(0)))
        of = lambda ts, i: F.array_compact(
            F.array(*(F.when(holds(ts, i, p), F.struct(i.alias("at"), F.lit(k).alias("phrase"), (i + len(p)).alias("end"))) for k, p in enumerate(phrases) if p))
        )
        found = let(ts, lambda ts: F.flatten(F.transform(ts, lambda _, i: of(ts, i)))) if any(phrases) else F.array().cast("array<struct<at:int,phrase:int,end:int>>")
        windows = let(found, lambda f: F.transform(f, lambda o, k: window(f, o["at"], k)))
        none = F.struct(F.lit(0).alias("different"), F.lit(0).alias("n"), F.lit(0).alias("before"), F.lit(width).alias("end"))
        top = F.coalesce(F.array_max(windows), none)
        return F.struct(top["different"].alias("different"), top["n"].alias("n"), F.lit(-c).alias("column"), top["before"].alias("before"), top["end"].alias("end"), pieces.alias("pieces"), F.coalesce(text, F.lit("")).alias("text"))

    def cut(w: Column) -> Column:
        size = F.size(w["pieces"])
        middle = -w["before"] - F.floor((F.lit(width) - (w["end"] + w["before"])) / 2).cast("int")
        return let(F.greatest(F.lit(0), F.least(middle, size - width)), lambda start: shown(w, start, size))

    def shown(w: Column, start: Column, size: Column) -> Column:
        piece = F.array_join(F.slice(w["pieces"], start + 1, width), "")
        body = F.when(start > 0, F.concat(F.lit("…"), F.regexp_replace(piece, r"^[^\p{L}\p{N}]+", ""))).otherwise(piece)
        rest = F.substring(w["text"], F.length(F.array_join(w["pieces"], "")) + 1, F.length(w["text"]))
        return F.concat(body, F.when(start + width < size, F.lit("…")).otherwise(rest))

    return let(F.array_max(F.array(*(best(c, t) for c, t in enumerate(texts)))), cut)
