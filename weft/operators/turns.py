"""Turn reads: lists with previews, one turn, pages of steps, bundles, token usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import first_line, preview
from weft.operators import scope
from weft.operators.paging import page
from weft.schema import TOKENS, TURN_KEY

PREVIEW, ONELINE = 500, 300
#: Step fields that hold bulk; the narrative view keeps the structure and blanks these.
BULKY = ("arguments", "output", "payload_json", "text", "encrypted")
NARRATED = ("commentary",)


def list_turns(turns: DataFrame, session: dict | None = None, since: str | None = None, until: str | None = None, limit: int | None = 10, offset: int = 0, oneline: bool = False) -> DataFrame:
    """A session's turns by ordinal with previews of prompt and answer; without a limit all turns, in no order."""
    rows = scope.in_window(scope.equal(turns, **(session or {})), since, until)
    cap, cut = (ONELINE, first_line) if oneline else (PREVIEW, lambda c: c)
    for source, name in (("user_message", "user_prompt_preview"), ("final_answer_text", "agent_answer_preview")):
        text, chars, total = preview(cut(F.col(source)), cap)
        rows = rows.withColumns({name: text, f"{name}_chars": chars, f"{name}_total_chars": total})
    rows = rows.withColumn("has_final_answer", F.col("final_answer_text").isNotNull())
    # previews come first, so that a page of them alone orders keys and short texts
    return page(rows, [F.asc(k) for k in TURN_KEY], limit, offset) if limit is not None or offset else rows


def token_usage() -> Column:
    """The token counters as one struct; null if every counter is."""
    return F.when(F.coalesce(*TOKENS).isNotNull(), F.struct(*TOKENS))


def show_turn(turns: DataFrame, key: dict, step_limit: int = 10, step_offset: int = 0, narrative: bool = True, raw_steps: bool = False) -> DataFrame:
    """One turn with a page of its steps; raw steps only with the full view."""
    if raw_steps and narrative:
        raise ValueError("raw steps need the full view")
    rows = scope.equal(turns, **key).withColumn("token_usage", token_usage())
    steps = narrated(F.col("steps")) if narrative else F.col("steps")
    out = rows.withColumns(
        {
            "step_count": F.size("steps").cast("long"),
            "shown": F.slice(steps, step_offset + 1, step_limit) if step_limit else F.slice(steps, 1, 0),
            "steps_has_more": F.size("steps") > step_offset + step_limit,
        }
    )
    if raw_steps:
        out = out.withColumn("raw_steps_json", F.to_json("steps"))
    return out.drop("steps").withColumnRenamed("shown", "steps")


def show_turns(turns: DataFrame, session: dict, limit: int | None = None, offset: int = 0, narrative: bool = True) -> DataFrame:
    """Details of a session's turns by ordinal: all of them, or a page."""
    rows = scope.equal(turns, **session).withColumn("token_usage", token_usage())
    if narrative:
        rows = rows.withColumn("steps", narrated(F.col("steps")))
    return page(rows, [F.asc("turn_ordinal")], limit, offset)


def narrated(steps: Column) -> Column:
    """Steps whose bulky fields are blank, but for commentary's text."""

    def one(s: Column) -> Column:
        for name in BULKY:
            held = s["type"].isin(*NARRATED) if name == "text" else F.lit(False)
            blank = F.lit(None) if name in ("encrypted",) else F.when(s[name].isNotNull(), F.lit(""))
            s = s.withField(name, F.when(held, s[name]).otherwise(blank))
        return s

    return F.transform(steps, one)


def turn_exists(turns: DataFrame, key: dict) -> bool:
    return not scope.equal(turns, **key).limit(1).isEmpty()


def bundle(sessions: DataFrame, turns: DataFrame, files: DataFrame, key: dict, turn_limit: int = 5, turn_offset: int = 0, file_limit: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A session's summary, a page of its turns and its files, all from the tables given, which fix the version."""
    from weft.operators.sessions import list_sessions

    one = list_sessions(scope.equal(sessions, **key), scope.equal(turns, **key), origin="all", limit=1, full=True)
    return one, list_turns(turns, key, limit=turn_limit, offset=turn_offset), files.limit(file_limit)
