"""Provider lines to turns: the rules of sessionisation as windows and grouped aggregates.

A session file is ordered by line; every rule is a running sum, a lag, or an argmax over the file, so
files are independent and lines of a file stay together only for their window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.times import iso_of_epoch
from weft.schema import STEP, TOKENS

FILE = ["file"]


def lines(raw: DataFrame) -> DataFrame:
    """(file, line, json) of whole-file text rows (file, text): 1-based numbers, blank lines left out."""
    rows = raw.select("file", F.posexplode(F.split("text", "\r?\n")).alias("line", "json"))
    return rows.withColumn("line", F.col("line") + 1).filter(F.trim("json") != "")


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that parse, with ``v``, and files that have one that doesn't, with its number."""
    parsed = rows.withColumn("v", F.try_parse_json("json"))
    bad = parsed.filter("v is null").groupBy("file").agg(F.min("line").alias("line"))
    return parsed.join(bad.select("file"), "file", "left_anti"), bad.withColumn("reason", F.concat(F.lit("line "), "line", F.lit(" is not JSON")))


def text_of(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def message_text(v: Column, path: str) -> Column:
    """Text of a content field: a string, or the texts of an array's items or of one object, line by line."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    items = F.try_variant_get(v, path, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.filter(F.transform(items, lambda i: i["text"]), lambda t: t.isNotNull()), "\n")
    return F.when(kind == "STRING", text_of(v, path)).when(kind.startswith("OBJECT"), text_of(v, f"{path}.text")).otherwise(joined)


def event_time(v: Column, path: str) -> Column:
    """Time of a lifecycle event: its text, or whole seconds since 1970; null if it is neither."""
    kind, text, seconds = F.schema_of_variant(F.try_variant_get(v, path, "variant")), text_of(v, path), F.try_variant_get(v, path, "long")
    return F.when(kind == "STRING", F.when(text != "", text)).when((kind == "BIGINT") & (seconds >= 0), iso_of_epoch(seconds))


def filled(c: Column) -> Column:
    """A text without the space around it; null if nothing is left."""
    return F.when(F.trim(c) != "", F.regexp_replace(c, r"^\s+|\s+$", ""))


#: Openings of user items that a client writes itself.
BOILERPLATE = ("# AGENTS.md instructions for ", "<environment_context>", "<turn_aborted>")

#: The counters of a Codex usage object.
COUNTERS = {"input": "input_tokens", "cached": "cached_input_tokens", "output": "output_tokens", "reasoning": "reasoning_output_tokens", "all": "total_tokens"}

#: Items of a Codex response that a step type of its own stands for.
PLAIN_ITEMS = ("message", "function_call", "custom_tool_call", "function_call_output", "custom_tool_call_output", "reasoning")


def codex_events(parsed: DataFrame) -> DataFrame:
    """(file, line, at, kind, text, …): what each line of a Codex file means for its turns."""
    v = F.col("v")
    top, sub = text_of(v, "$.type"), text_of(v, "$.payload.type")
    role = text_of(v, "$.payload.role")
    event, item = top == "event_msg", top == "response_item"
    content = F.when(event, text_of(v, "$.payload.message")).otherwise(message_text(v, "$.payload.content"))
    boilerplate = F.trim(content) == ""
    for b in BOILERPLATE:
        boilerplate = boilerplate | F.ltrim(content).startswith(b)
    call = sub.isin("function_call", "custom_tool_call")
    kind = (
        F.when(event & (sub == "user_message"), "user_event")
        .when(item & (sub == "message") & (role == "user") & ~boilerplate, "user_item")
        .when(item & (sub == "message") & (role == "assistant"), "assistant")
        .when(event & sub.isin("task_started", "turn_started"), "started")
        .when(event & sub.isin("task_complete", "turn_complete"), "complete")
        .when(event & (sub == "turn_aborted"), "abort")
        .when(event & (sub == "token_count"), "tokens")
        .when(top == "turn_context", "model")
        .when(item & call, "tool_call")
        .when(item & sub.isin("function_call_output", "custom_tool_call_output"), "tool_call_output")
        .when(item & (sub == "reasoning"), "reasoning")
        .when(item & ~sub.isin(*PLAIN_ITEMS), "item")
        .otherwise("other")
    )
    number = lambda path: F.try_variant_get(v, path, "long")
    total = F.try_variant_get(v, "$.payload.info.total_token_usage", "variant")
    value = lambda path: F.coalesce(text_of(v, path), F.to_json(F.try_variant_get(v, path, "variant")))
    summaries = F.try_variant_get(v, "$.payload.summary", "array<variant>")
    model = F.regexp_replace(text_of(v, "$.payload.model"), r"^\s+|\s+$", "")
    return parsed.select(
        "file",
        "line",
        text_of(v, "$.timestamp").alias("at"),
        kind.alias("kind"),
        content.alias("text"),
        filled(text_of(v, "$.payload.last_agent_message")).alias("last_message"),
        F.when(sub.isin("task_started", "turn_started"), event_time(v, "$.payload.started_at")).otherwise(event_time(v, "$.payload.completed_at")).alias("event_at"),
        text_of(v, "$.payload.phase").alias("phase"),
        F.when((model != "") & ~(model.startswith("<") & model.endswith(">")), model).alias("model"),
        (total.isNotNull() & ~F.coalesce(F.is_variant_null(total), F.lit(False))).alias("counted"),
        *(number(f"$.payload.info.{kind}_token_usage.{field}").alias(f"{kind}_{name}") for name, field in COUNTERS.items() for kind in ("total", "last")),
        text_of(v, "$.payload.turn_id").alias("turn_id"),
        text_of(v, "$.payload.call_id").alias("call_id"),
        text_of(v, "$.payload.name").alias("name"),
        F.when(sub == "custom_tool_call", filled(value("$.payload.input"))).otherwise(filled(value("$.payload.arguments"))).alias("arguments"),
        filled(value("$.payload.output")).alias("output"),
        F.filter(F.transform(summaries, lambda x: filled(F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$", "string")))), lambda t: t.isNotNull()).alias("summaries"),
        F.try_variant_get(v, "$.payload.encrypted_content", "variant").isNotNull().alias("encrypted"),
        F.when(kind == "item", sub).alias("item_type"),
        F.when(kind == "item", F.to_json(F.try_variant_get(v, "$.payload", "variant"))).alias("payload"),
    )


def choose_boundaries(events: DataFrame) -> DataFrame:
    """``boundary``: user events with a text if the file has any user event, else user items."""
    any_event = F.bool_or(F.col("kind") == "user_event").over(Window.partitionBy(*FILE))
    return events.withColumn("boundary", F.when(any_event, (F.col("kind") == "user_event") & F.col("text").isNotNull()).otherwise(F.col("kind") == "user_item"))


def lifecycle(events: DataFrame) -> DataFrame:
    """Lines with the turn that they belong to, ``turn_ordinal``, and ``open``: whether they lie in an open turn.

    A boundary opens a turn, the next complete or abort line closes it. What a line between two turns says
    belongs to the turn to come, and so does the start event of a turn, also while the one before is open. A
    start takes back models and counts that came since the last boundary; such lines are left out, as are
    counts between turns before anything names the turn to come, and content between turns.
    """
    whole = Window.partitionBy(*FILE).orderBy("line")
    till, before = whole.rowsBetween(Window.unboundedPreceding, 0), whole.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("boundary"), True).when(F.col("kind").isin("complete", "abort"), False)
    e = choose_boundaries(events).withColumns({"number": F.sum(F.when(F.col("boundary"), 1).otherwise(0)).over(till), "open": F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False))})
    # between two boundaries; the one that ends the gap is part of it
    e = e.withColumn("gap", F.col("number") - F.when(F.col("boundary"), 1).otherwise(0))
    start = F.col("kind") == "started"
    gap = Window.partitionBy(*FILE, "gap").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumns({"starts": F.sum(F.when(start, 1).otherwise(0)).over(gap), "named": F.coalesce(F.last(F.when(start, F.col("turn_id").isNotNull()), ignorenulls=True).over(gap), F.lit(False))})
    loose = ~F.col("open") & ~F.col("boundary")
    modelled = loose & (F.col("kind") == "model") & F.col("model").isNotNull()
    e = e.withColumn("modelled", F.coalesce(F.bool_or(modelled).over(Window.partitionBy(*FILE, "gap", "starts").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    last = F.col("starts") == F.max("starts").over(Window.partitionBy(*FILE, "gap"))
    kept = F.when(start, last).when(~loose, F.lit(True)).otherwise(last & (modelled | ((F.col("kind") == "tokens") & (F.col("named") | F.col("modelled")))))
    ahead = start | loose
    out = e.withColumns({"kept": kept, "turn_ordinal": F.when(ahead, F.col("gap") + 1).otherwise(F.col("number"))})
    return out.drop("number", "gap", "starts", "named", "modelled")


def sessionise(events: DataFrame, by: list[str] = FILE, order: str = "line") -> DataFrame:
    """``turn_ordinal`` from 1 by a running count of boundaries; lines before the first have 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("turn_ordinal", F.sum(F.when(F.col("boundary"), 1).otherwise(0)).over(w))


def counter_delta(rows: DataFrame, by: list[str], order: list, total: str, last: str | None = None, name: str = "delta") -> DataFrame:
    """``name``: the rise of a running total since the row before.

    Without a total before, or after a reset, the last request's own value counts, else the total; without
    a total the last request's value alone.
    """
    before = F.lag(total).over(Window.partitionBy(*by).orderBy(*order))
    single = F.col(last) if last else F.lit(None).cast("long")
    rise = F.when(F.col(total) >= before, F.col(total) - before).when(F.col(total).isNotNull(), F.coalesce(single, F.col(total))).otherwise(single)
    return rows.withColumn(name, rise)


def held(value: Column) -> Column:
    """A decimal as a long, at the largest long where it lies beyond."""
    return F.least(value, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def saturating_add(*values: Column) -> Column:
    """Sum of longs that stops at the largest long; null if any is null."""
    total = F.lit(0).cast("decimal(30,0)")
    for v in values:
        total = total + v.cast("decimal(30,0)")
    return held(total)


def saturating_sum(c: Column | str) -> Column:
    """Sum of a long column over a group that stops at the largest long; null if every value is."""
    return held(F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")))


def codex_usage(events: DataFrame) -> DataFrame:
    """(file, turn_ordinal, TOKENS): the rises of the file's running totals, summed by turn.

    Every total is the base of the next rise, also one whose own rise belongs to no turn.
    """
    rows = events.filter("kind = 'tokens' and counted")
    for c in COUNTERS:
        rows = counter_delta(rows, FILE, ["line"], f"total_{c}", f"last_{c}", c)
    uncached = F.greatest(F.col("input") - F.coalesce("cached", F.lit(0)), F.lit(0).cast("long"))
    both = F.when(F.col("input").isNotNull() & F.col("output").isNotNull(), saturating_add(F.col("input"), F.col("output"))).otherwise(F.col("all"))
    values = (F.when(F.col("input").isNotNull(), uncached), F.col("cached"), F.lit(None).cast("long"), F.col("output"), F.col("reasoning"), F.col("all"), both)
    rows = rows.filter("kept").select("file", "turn_ordinal", *(v.cast("long").alias(t) for t, v in zip(TOKENS, values)))
    return rows.groupBy("file", "turn_ordinal").agg(*(saturating_sum(t).alias(t) for t in TOKENS))


def codex_turns(events: DataFrame) -> DataFrame:
    """Turns of Codex files: prompt, last final answer, status, tokens, first real model, steps.

    Id and start time are those of the turn's start event, the model that of the last ``turn_context`` before
    the prompt or the first one after it.
    """
    e = lifecycle(events)
    kind, time, inside = F.col("kind"), F.col("at"), F.col("open")
    answer = inside & (kind == "assistant") & (F.coalesce("phase", F.lit("final_answer")) == "final_answer") & F.col("text").isNotNull()
    called = F.col("call_id").isNotNull()
    step = F.when(
        inside,
        F.when((kind == "tool_call") & called & F.col("name").isNotNull() & F.col("arguments").isNotNull(), make_step("tool_call", timestamp=time, call_id=F.col("call_id"), name=F.col("name"), arguments=F.col("arguments")))
        .when((kind == "tool_call_output") & called & F.col("output").isNotNull(), make_step("tool_call_output", timestamp=time, call_id=F.col("call_id"), output=F.col("output")))
        .when(kind == "reasoning", make_step("reasoning", timestamp=time, summary_list=F.coalesce("summaries", F.array().cast("array<string>")), encrypted=F.col("encrypted")))
        .when((kind == "assistant") & (F.col("phase") == "commentary") & F.col("text").isNotNull(), make_step("commentary", timestamp=time, text=F.col("text")))
        .when(kind == "item", make_step("provider_response_item", timestamp=time, item_type=F.col("item_type"), payload_json=F.col("payload"))),
    )
    model = lambda when: F.when((kind == "model") & F.col("model").isNotNull() & when, F.struct("line", "model"))
    closing = lambda k, at, *more: F.min(F.when(inside & (kind == k), F.struct(F.col("line"), at.alias("at"), *more)))
    g = e.filter("kept").groupBy("file", "turn_ordinal").agg(
        F.min(F.when(F.col("boundary"), F.struct("line", "at", "text"))).alias("prompt"),
        F.max(F.when(kind == "started", F.struct(F.col("line"), F.col("turn_id"), F.coalesce("event_at", "at").alias("at")))).alias("start"),
        F.max(F.when(answer, F.struct(F.col("line"), F.col("at"), F.col("text")))).alias("said"),
        closing("complete", F.coalesce("event_at", "at"), F.col("last_message")).alias("done"),
        closing("abort", F.col("at")).alias("aborted"),
        F.max(model(~inside)).alias("ahead"),
        F.min(model(inside)).alias("first"),
        F.sort_array(F.collect_list(F.when(step.isNotNull(), F.struct("line", step.alias("step"))))).alias("steps"),
    )
    g = g.filter("prompt is not null").join(codex_usage(e), ["file", "turn_ordinal"], "left")
    status = F.when(F.col("aborted").isNotNull(), "aborted").when(F.col("done").isNotNull() | F.col("said").isNotNull(), "completed").otherwise("incomplete")
    return g.select(
        "file",
        F.col("turn_ordinal").cast("long"),
        F.col("start.turn_id").alias("turn_id"),
        F.coalesce("start.at", "prompt.at").alias("started_at"),
        F.when(F.col("aborted").isNotNull(), F.col("aborted.at")).otherwise(F.coalesce("done.at", "said.at")).alias("completed_at"),
        status.alias("status"),
        F.col("prompt.text").alias("user_message"),
        F.coalesce("said.at", F.when(F.col("done.last_message").isNotNull(), F.col("done.at"))).alias("final_answer_at"),
        F.coalesce("said.text", "done.last_message").alias("final_answer_text"),
        F.coalesce("ahead.model", "first.model").alias("primary_model"),
        *TOKENS,
        F.transform("steps", lambda x: x["step"]).alias("steps"),
    )


# --- what a version may hold ---------------------------------------------------------------------

#: The first version that writes an item, by its place in the file.
CODEX_SINCE = {
    "line": {"compacted": "0.35.0-alpha.3", "turn_context": "0.35.0-alpha.3"},
    "event": {"task_started": "0.80.0-alpha.6", "turn_started": "0.80.0-alpha.6", "task_complete": "0.80.0-alpha.6", "turn_complete": "0.80.0-alpha.6"},
    "item": {
        "message": "0.0.0", "reasoning": "0.0.0", "local_shell_call": "0.0.0", "function_call": "0.0.0", "function_call_output": "0.0.0",
        "custom_tool_call": "0.0.0", "custom_tool_call_output": "0.0.0", "web_search_call": "0.0.0", "ghost_snapshot": "0.51.0",
        "compaction": "0.59.0", "image_generation_call": "0.108.0", "tool_search_call": "0.115.0", "tool_search_output": "0.115.0",
        "other": "0.128.0", "context_compaction": "0.129.0", "compaction_trigger": "0.131.0", "agent_message": "0.138.0",
    },
    "shape": {"message phases": "0.95.0", "structured tool output": "0.97.0"},
}
#: Other lines of a Codex file, and the last version whose files hold nothing but the above.
CODEX_LINES, CODEX_EXACT = ("session_meta", "event_msg", "response_item"), "0.142.5"


def known(name: Column, key: Column, since: dict[str, str], otherwise: bool) -> Column:
    """Whether an item of that name is written by a version of that key."""
    out = F.when(name.isNull(), F.lit(True))
    for item, first in since.items():
        out = out.when(name == item, key >= version_literal(first))
    return out.otherwise(F.lit(otherwise))


def codex_unsupported(parsed: DataFrame, versions: DataFrame) -> DataFrame:
    """(file, reason) of files whose version is known exactly and that hold what it can't have written.

    ``versions`` are (file, cli_version). Later versions than CODEX_EXACT may hold anything.
    """
    v, key = F.col("v"), F.col("key")
    rows = parsed.join(versions.select("file", version_key(F.col("cli_version")).alias("key")).filter(key <= version_literal(CODEX_EXACT)), "file")
    top, sub = text_of(v, "$.type"), text_of(v, "$.payload.type")
    shape = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    item, output, content = top == "response_item", shape("$.payload.output"), shape("$.payload.content")
    result = item & sub.isin("function_call_output", "custom_tool_call_output")
    phases, structured = (key >= version_literal(CODEX_SINCE["shape"][n]) for n in ("message phases", "structured tool output"))
    wrong = (
        F.when(~known(top, key, CODEX_SINCE["line"] | dict.fromkeys(CODEX_LINES, "0.0.0"), False), F.concat(F.lit("line type "), top))
        .when((top == "event_msg") & ~known(sub, key, CODEX_SINCE["event"], True), F.concat(F.lit("event "), sub))
        .when(item & ~known(sub, key, CODEX_SINCE["item"], False), F.concat(F.lit("item "), sub))
        .when(item & (sub == "message") & text_of(v, "$.payload.phase").isNotNull() & ~phases, "message phases")
        .when(item & (sub == "message") & text_of(v, "$.payload.role").isNotNull() & ~(content.startswith("ARRAY") | content.startswith("OBJECT") | (content == "VOID")), "content of another shape")
        .when(result & output.startswith("ARRAY") & ~structured, "structured tool output")
        .when(result & ~(output.startswith("ARRAY") | output.isin("STRING", "VOID")), "tool output of another shape")
    )
    first = F.min(F.when(wrong.isNotNull(), F.struct(F.col("line"), wrong.alias("what"))))
    found = rows.groupBy("file").agg(first.alias("x")).filter("x is not null")
    return found.select("file", F.concat(F.lit("line "), "x.line", F.lit(": "), "x.what", F.lit(" is not part of its version")).alias("reason"))


def claude_events(parsed: DataFrame) -> DataFrame:
    """(file, line, …): prompts, answers and usage of Claude files."""
    v = F.col("v")
    kind, content = text_of(v, "$.type"), message_text(v, "$.message.content")
    items = F.try_variant_get(v, "$.message.content", "array<struct<type:string,text:string,id:string,name:string,thinking:string,tool_use_id:string>>")
    types = F.transform(items, lambda i: i["type"])
    only_results = F.coalesce((F.size(items) > 0) & F.forall(types, lambda t: t == "tool_result"), F.lit(False))
    images = F.filter(types, lambda t: t.isNotNull() & ~t.isin("text", "tool_result"))
    prompt_text = F.when(F.coalesce(content, F.lit("")) != "", content).otherwise(F.concat(F.lit("<"), F.array_join(F.array_distinct(images), " + "), F.lit(" prompt>")))
    origin = F.try_variant_get(v, "$.origin", "variant")
    meta = F.coalesce(F.try_variant_get(v, "$.isMeta", "boolean"), F.lit(False)) | (origin.isNotNull() & ~F.is_variant_null(origin))
    stop = text_of(v, "$.message.stop_reason")
    uses_tool = F.coalesce(F.exists(types, lambda t: t == "tool_use"), F.lit(False))
    version = text_of(v, "$.version")
    texts = F.filter(F.transform(F.filter(items, lambda i: i["type"] == "text"), lambda i: i["text"]), lambda t: F.coalesce(F.trim(t) != "", F.lit(False)))
    answer = F.when(F.schema_of_variant(F.try_variant_get(v, "$.message.content", "variant")) == "STRING", content).otherwise(F.array_join(texts, "\n\n"))
    terminal = stop.isin("end_turn", "stop_sequence") | (text_ends_turn(version) & ~uses_tool)
    error = F.coalesce(F.try_variant_get(v, "$.isApiErrorMessage", "boolean"), F.lit(False)) | F.try_variant_get(v, "$.error", "variant").isNotNull()
    direct, delegated = usage(v, "$.message.usage", F.lit(None).cast("long")), usage(v, "$.toolUseResult.usage", F.try_variant_get(v, "$.toolUseResult.totalTokens", "long"))
    return parsed.select(
        "file",
        "line",
        text_of(v, "$.timestamp").alias("at"),
        kind.alias("kind"),
        F.coalesce((kind == "user") & ~meta & ~only_results, F.lit(False)).alias("boundary"),
        F.when(kind == "user", prompt_text).otherwise(answer).alias("text"),
        F.when(text_of(v, "$.message.model").rlike("^<.*>$"), F.lit(None)).otherwise(text_of(v, "$.message.model")).alias("model"),
        F.coalesce(text_of(v, "$.requestId"), text_of(v, "$.message.id"), text_of(v, "$.timestamp")).alias("request"),
        F.when(kind == "assistant", direct).alias("direct"),
        F.when(kind == "user", delegated).alias("delegated"),
        F.coalesce((kind == "assistant") & terminal & (F.coalesce(answer, F.lit("")) != ""), F.lit(False)).alias("ends"),
        F.coalesce((kind == "assistant") & error, F.lit(False)).alias("failed"),
        F.coalesce((stop != "end_turn") | stop.isNull(), F.lit(True)).alias("open_stop"),
        text_of(v, "$.uuid").alias("uuid"),
        text_of(v, "$.sessionId").alias("session"),
        text_of(v, "$.agentId").alias("agent"),
        text_of(v, "$.cwd").alias("cwd"),
        version.alias("version"),
    )


def text_ends_turn(version: Column) -> Column:
    """Whether text without a tool call ends a turn whatever the stop reason: so it was before 2.1.84."""
    return F.coalesce(version_key(version) < version_literal("2.1.84"), F.lit(False))


#: The counters of a Claude usage object.
USAGE = ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens")


def usage(v: Column, path: str, provider_total: Column) -> Column:
    """TOKENS of a usage object as a struct, null without any; a provider's own total stands for the sum."""
    get = lambda f: F.try_variant_get(v, f"{path}.{f}", "long")
    fresh, read, written, out = map(get, USAGE)
    whole = F.when(fresh.isNotNull() & read.isNotNull() & written.isNotNull() & out.isNotNull(), saturating_add(fresh, read, written, out))
    whole = whole.when(fresh.isNotNull() & out.isNotNull() & read.isNull() & written.isNull(), saturating_add(fresh, out))
    values = (fresh, read, written, out, F.lit(None).cast("long"), provider_total, F.coalesce(provider_total, whole))
    return F.when(F.coalesce(fresh, read, written, out, provider_total).isNotNull(), F.struct(*(x.cast("long").alias(t) for t, x in zip(TOKENS, values))))


def token_dedupe(rows: DataFrame, by: list[str], request: str, fields: tuple[str, ...]) -> DataFrame:
    """Sums over requests of each field's maximum within the request: a line repeated counts once."""
    each = rows.groupBy(*by, request).agg(*(F.max(f).alias(f) for f in fields))
    return each.groupBy(*by).agg(*(saturating_sum(f).alias(f) for f in fields))


def claude_usage(events: DataFrame) -> DataFrame:
    """(file, turn_ordinal, TOKENS): each request's largest counters, and what delegated agents report."""
    by = ["file", "turn_ordinal"]
    direct = events.filter("direct is not null").select(*by, "request", "direct.*")
    each = direct.groupBy(*by, "request").agg(*(F.max(t).alias(t) for t in TOKENS)).drop("request")
    every = each.unionByName(events.filter("delegated is not null").select(*by, "delegated.*"))
    return every.groupBy(*by).agg(*(saturating_sum(t).alias(t) for t in TOKENS))


def claude_turns(events: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Turns of Claude files; status and answer are those of the last line that ends the turn.

    Without such a line the turn is incomplete and ends with its last error, if any. ``parsed`` are the
    lines the events came from; given these, turns have their steps.
    """
    e = sessionise(events).filter("turn_ordinal > 0")
    broken = F.col("open_stop") & (F.col("failed") | (F.col("text") == "No response requested."))
    ended = F.when(F.col("ends"), F.struct("line", "at", "text", F.when(broken, "incomplete").otherwise("completed").alias("status")))
    g = e.groupBy("file", "turn_ordinal").agg(
        F.min_by("text", "line").alias("user_message"),
        F.min_by("at", "line").alias("started_at"),
        F.min_by("uuid", "line").alias("turn_id"),
        F.max(ended).alias("done"),
        F.max(F.when(F.col("failed"), F.struct("line", "at"))).alias("error"),
        F.min(F.when(F.col("model").isNotNull(), F.struct("line", "model"))).alias("first_model"),
    )
    g = g.join(claude_usage(e), ["file", "turn_ordinal"], "left")
    if parsed is not None:
        g = g.join(claude_steps(parsed, e.select("file", "line", "turn_ordinal", F.col("ends").alias("final"))), ["file", "turn_ordinal"], "left")
    steps = F.col("steps") if parsed is not None else F.lit(None)
    return g.select(
        "file",
        F.col("turn_ordinal").cast("long"),
        "turn_id",
        "started_at",
        F.coalesce("done.at", "error.at").alias("completed_at"),
        F.coalesce("done.status", F.lit("incomplete")).alias("status"),
        "user_message",
        F.col("done.at").alias("final_answer_at"),
        F.col("done.text").alias("final_answer_text"),
        F.col("first_model.model").alias("primary_model"),
        *TOKENS,
        F.coalesce(steps, F.array()).cast(f"array<{STEP}>").alias("steps"),
    )


def identity_checks(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Each Claude file against its archive identity (file, session, agent): why it is left out, and how sure its rules are.

    A line of another session or agent, or a file that names no folder, is no part of the archive's session;
    a folder or version that changes within the file is only less sure.
    """
    bare = lambda c: F.regexp_replace(c, "^agent-", "")
    g = events.groupBy("file").agg(
        F.collect_set("session").alias("seen"), F.collect_set("agent").alias("agents"), F.count_distinct("cwd").alias("cwds"), F.count_distinct("version").alias("versions")
    )  # a file's own ids: one each, unless it is wrong
    g = g.join(expected, "file")
    other = F.exists("seen", lambda s: s != F.col("session"))
    agent = F.exists("agents", lambda a: bare(a) != bare(F.col("agent"))) & F.col("agent").isNotNull()
    reason = F.when(other, F.concat(F.lit("session id is not "), "session")).when(agent, F.concat(F.lit("agent id is not "), bare(F.col("agent")))).when(F.col("cwds") == 0, "no folder")
    sure = F.when((F.col("cwds") > 1) | (F.col("versions") > 1), "best_effort_forward").otherwise("exact")
    return g.select("file", reason.alias("reason"), sure.alias("determinism"))


def version_key(version: Column) -> Column:
    """Comparable form of a dotted version, a pre-release before its release; null if it has no three numbers."""
    core = F.split(F.regexp_extract(version, r"^(\d+\.\d+\.\d+)", 1), r"\.")
    alpha = F.regexp_extract(version, r"^\d+\.\d+\.\d+-alpha\.(\d+)$", 1)
    last = F.when(alpha != "", alpha.cast("int")).otherwise(F.lit((1 << 31) - 1))
    return F.when(version.rlike(r"^\d+\.\d+\.\d+"), F.concat(F.transform(core, lambda p: p.cast("int")), F.array(last)))


def version_literal(version: str) -> Column:
    core, _, alpha = version.partition("-alpha.")
    return F.array(*(F.lit(int(p)) for p in core.split(".")), F.lit(int(alpha) if alpha else (1 << 31) - 1))


def epoch(version: Column, starts: list[tuple[str, str]], last_exact: str) -> tuple[Column, Column]:
    """Schema epoch of a version and how sure it is; ``starts`` are (first version, id) in rising order."""
    key = version_key(version)
    name = F.lit(None).cast("string")
    for first, label in starts:
        name = F.when(key >= version_literal(first), F.lit(label)).otherwise(name)
    return name, F.when(name.isNotNull(), F.when(key <= version_literal(last_exact), "exact").otherwise("best_effort_forward"))


#: First versions of the providers' schema epochs.
CODEX_EPOCHS = (("0.33.0", "initial"), ("0.35.0-alpha.3", "compaction_prelude"), ("0.35.0-alpha.8", "legacy"), ("0.95.0", "phased_messages"), ("0.97.0", "structured_tool_output"), ("0.104.0-alpha.1", "turn_lifecycle"))
CLAUDE_EPOCHS = (
    ("1.0.88", "2.0.5"), ("2.0.8", "2.0.28"), ("2.0.29", "2.0.52"), ("2.0.53", "2.0.72"), ("2.0.73", "2.1.15"), ("2.1.16", "2.1.37"),
    ("2.1.38", "2.1.61"), ("2.1.62", "2.1.83"), ("2.1.84", "2.1.89"), ("2.1.90", "2.1.160"), ("2.1.161", "2.1.197"), ("2.1.198", "latest"),
)


def claude_schema(version: Column, kind: Column) -> Column:
    """Schema id of a Claude file; versions before the first epoch count to it, unknown ones to the last."""
    name = lambda e: "_to_".join(x.replace(".", "_") for x in e)
    key, out = version_key(version), F.lit(name(CLAUDE_EPOCHS[0]))
    for e in CLAUDE_EPOCHS[1:]:
        out = F.when(key >= version_literal(e[0]), F.lit(name(e))).otherwise(out)
    return F.concat(F.lit("claude."), kind, F.lit("_transcript."), F.when(key.isNull(), F.lit(name(CLAUDE_EPOCHS[-1]))).otherwise(out))


def dedupe_priority(candidates: DataFrame, key: list[str], size: str, modified: str, path: str, readable: str | None = None) -> DataFrame:
    """One file a session: largest, then newest, then last by path; files that don't parse give way to those that do."""
    order = [F.desc(readable)] if readable else []
    order += [F.desc(size), F.desc(modified), F.desc(path)]
    ranked = candidates.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter(F.col("rn") == 1 if not readable else (F.col("rn") == 1) & F.col(readable)).drop("rn")


def owner_by_prefix(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root", owner: str = "project_id") -> DataFrame:
    """The project whose root is the longest that holds each path: an equi join on the path's ancestors.

    Each path is exploded into its ancestors, a handful, so roots are matched by hash and not compared one by one.
    """
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.select(path, F.explode(up).alias(root)).join(roots.select(root, owner), root)
    best = each.groupBy(path).agg(F.max_by(owner, F.struct(F.length(root), F.col(owner))).alias(owner))
    return paths.join(best, path, "left")


def ancestors(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` once for each folder above or at ``path``: ``root`` and its number of parts, ``depth``."""
    parts = F.split(F.regexp_replace(path, "(?<=.)/+$", ""), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("root"), n.alias("depth"), (n == F.size(parts)).alias("exact")))
    return rows.select("*", F.inline(up))


#: How a project's root meets a session's folder.
ABOVE, EXACT, LINKED = 0, 1, 2


def owners_of(sessions: DataFrame, roots: DataFrame, upstreams: DataFrame, key: list[str]) -> DataFrame:
    """(key, project_id) of the projects that own each session, by its folder and its repository.

    ``sessions`` has ``cwd`` and ``repository_url``. ``roots`` (root, project_id, linked) are the projects'
    folders, ``upstreams`` (project_id, root, url) their repositories: of the whole project where root is
    null. The deepest root above the folder decides whose path it is; several projects at one depth all
    may have it. There a session without a repository belongs, one whose repository is an upstream of a
    folder at that depth or below, one in the very folder, and, unless the folder is only linked, one
    whose repository is the project's or for which no repository of project or folder is known. A folder
    below no root goes to the projects that have its repository as an upstream.
    """
    s = sessions.select(*key, "cwd", "repository_url")
    up = ancestors(s.filter(F.coalesce("cwd", F.lit("")) != ""), "cwd")
    hits = up.join(roots, "root")
    deepest = hits.groupBy(*key).agg(F.max("depth").alias("deepest"))
    # of one depth a linked folder counts before the very folder, and that before a folder above
    rank = F.when(F.col("exact"), EXACT).when(F.col("linked"), LINKED).otherwise(ABOVE)
    mine = hits.groupBy(*key, "project_id").agg(F.max(F.struct("depth", rank.alias("rank"))).alias("m"), F.first("repository_url").alias("url")).join(deepest, key).filter("m.depth = deepest")
    scoped = up.join(upstreams.filter("root is not null").withColumnRenamed("url", "known"), "root").select(*key, "project_id", F.col("depth").alias("at"), "known")
    whole = upstreams.filter("root is null").groupBy("project_id").agg(F.collect_set("url").alias("urls"))
    below = mine.join(scoped, [*key, "project_id"], "left").withColumn("known", F.when(F.col("at") >= F.col("m.depth"), F.col("known")))
    seen = below.groupBy(*key, "project_id", "m", "url").agg(F.collect_set("known").alias("path_urls")).join(whole, "project_id", "left")
    urls = F.coalesce("urls", F.array().cast("array<string>"))
    listed = F.array_contains(urls, F.col("url"))
    nothing = (F.size(urls) == 0) & (F.size("path_urls") == 0)
    belongs = F.col("url").isNull() | F.array_contains("path_urls", F.col("url")) | (F.col("m.rank") == EXACT) | ((F.col("m.rank") == ABOVE) & (listed | nothing))
    inside = seen.filter(belongs).select(*key, "project_id")
    outside = s.join(deepest.select(*key), key, "left_anti").join(upstreams.filter("root is null").select("project_id", F.col("url").alias("repository_url")).distinct(), "repository_url")
    return inside.unionByName(outside.select(*key, "project_id"))


def archive_kind(path: Column) -> tuple[Column, Column, Column]:
    """(session_id, kind, parent) of an archive path; kind is null for what isn't a session file.

    A Codex file is named by its session's 36 characters; a Claude file lies in its session's folder, a
    subagent's one level below that of its parent.
    """
    codex = F.regexp_extract(path, r"/codex/(?:.*/)?rollout-[^/]*-([^/]{36})\.jsonl$", 1)
    main = F.regexp_extract(path, r"/claude/([^/]+)/\1\.jsonl$", 1)
    parent, agent = (F.regexp_extract(path, r"/claude/([^/]+)/subagents/([^/]+)\.jsonl$", k) for k in (1, 2))
    session = F.when(codex != "", codex).when(main != "", main).when(agent != "", F.concat(parent, F.lit("/subagents/"), agent))
    return session, F.when((codex != "") | (main != ""), "primary").when(agent != "", "subagent"), F.when(agent != "", parent)


# --- steps of Claude turns -----------------------------------------------------------------------


def make_step(kind: str, **fields: Column) -> Column:
    """A step of the given fields, the others null, typed as the step schema says."""
    names = [f.split(":")[0] for f in STEP[len("struct<") : -1].split(",")]
    values = {"type": F.lit(kind), **fields}
    return F.struct(*(values.get(n, F.lit(None)).alias(n) for n in names)).cast(STEP)


def claude_steps(parsed: DataFrame, turns_of_lines: DataFrame) -> DataFrame:
    """(file, turn_ordinal, steps): every item of every line of a turn as a step, in order.

    ``turns_of_lines`` gives (file, line, turn_ordinal, final), where a final line's text is the turn's
    answer and no commentary.
    """
    rows = parsed.join(turns_of_lines.filter("turn_ordinal > 0"), ["file", "line"])
    v = F.col("v")
    get = lambda c, p, t="string": F.try_variant_get(c, p, t)
    at, kind, sub = get(v, "$.timestamp"), get(v, "$.type"), get(v, "$.subtype")
    items = F.coalesce(get(v, "$.message.content", "array<variant>"), F.array(F.lit(None).cast("variant")))
    each = rows.select("file", "turn_ordinal", "line", "final", "v", at.alias("at"), kind.alias("kind"), sub.alias("sub"), F.posexplode(items).alias("pos", "i"))
    i, item, time = F.col("i"), get(F.col("i"), "$.type"), F.col("at")
    result = F.coalesce(get(i, "$.content"), F.to_json(get(i, "$.content", "variant")))
    wrapped = F.when(F.coalesce(get(i, "$.is_error", "boolean"), F.lit(False)), F.to_json(F.struct(F.lit(True).alias("is_error"), result.alias("content")))).otherwise(result)
    data = lambda p: get(F.col("v"), p)
    whole = F.to_json(F.col("v"))
    plain = (F.col("kind") == "assistant") & i.isNull()
    step = (
        F.when(item == "thinking", make_step("reasoning", timestamp=time, summary_list=F.array(get(i, "$.thinking"))))
        .when((item == "text") & (F.col("kind") == "assistant") & ~F.col("final"), make_step("commentary", timestamp=time, text=get(i, "$.text")))
        .when(plain & ~F.col("final") & data("$.message.content").isNotNull(), make_step("commentary", timestamp=time, text=data("$.message.content")))
        .when(item == "tool_use", make_step("tool_call", timestamp=time, call_id=get(i, "$.id"), name=get(i, "$.name"), arguments=F.to_json(get(i, "$.input", "variant"))))
        .when(item == "tool_result", make_step("tool_call_output", timestamp=time, call_id=get(i, "$.tool_use_id"), output=wrapped))
        .when(F.col("kind") == "attachment", make_step("attachment", timestamp=time, attachment_type=data("$.attachment.type"), payload_json=F.to_json(get(F.col("v"), "$.attachment", "variant"))))
        .when(
            (F.col("kind") == "progress") & (data("$.data.type") == "agent_progress"),
            make_step("delegation", timestamp=time, event=F.lit("agent_progress"), agent_id=data("$.data.agentId"), summary=data("$.data.prompt"), payload_json=whole),
        )
        .when(
            (F.col("kind") == "system") & F.col("sub").startswith("task_"),
            make_step("delegation", timestamp=time, event=F.col("sub"), task_id=data("$.task_id"), status=data("$.status"), summary=data("$.summary"), payload_json=whole),
        )
        .when(
            (F.col("kind") == "system") & (F.col("sub") == "stop_hook_summary"),
            make_step(
                "hook_summary", timestamp=time, hook_count=get(F.col("v"), "$.hookCount", "long"), prevented_continuation=get(F.col("v"), "$.preventedContinuation", "boolean"),
                has_output=get(F.col("v"), "$.hasOutput", "boolean"), level=data("$.level"),
            ),
        )
        .when((item == "text") | item.isNull() | F.col("kind").isin("user"), F.lit(None))
        .otherwise(make_step("provider_response_item", timestamp=time, item_type=F.coalesce(item, F.col("kind")), payload_json=F.to_json(i)))
    )
    each = each.withColumn("step", step).filter("step is not null")
    g = each.groupBy("file", "turn_ordinal").agg(F.sort_array(F.collect_list(F.struct("line", "pos", "step"))).alias("s"))
    return g.select("file", "turn_ordinal", F.transform("s", lambda x: x["step"]).alias("steps"))
