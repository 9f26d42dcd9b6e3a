"""Child rows of turns: tool calls, file accesses, evidence, search text, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import collapse, file_name, let
from weft.functions.times import millis_between
from weft.schema import TURN_KEY

# --- tool calls ----------------------------------------------------------------------------------


def steps_of(turns: DataFrame, *kinds: str) -> DataFrame:
    """One row a step of those types, with its position."""
    rows = turns.select(*TURN_KEY, F.posexplode("steps").alias("pos", "s"))
    return rows.filter(F.col("s.type").isin(*kinds)) if kinds else rows


def pair_calls(turns: DataFrame) -> DataFrame:
    """Tool calls with their outputs: an output answers the latest open call of its id.

    Within a turn and call id the steps nest like brackets: a running sum of calls less outputs gives
    each its depth, and an output belongs to the last call of its depth before it. Outputs without a
    call stay, and a later call of their id takes the last of them.
    """
    s = steps_of(turns, "tool_call", "tool_call_output").select(*TURN_KEY, "pos", F.col("s.call_id").alias("call_id"), "s")
    by_id = Window.partitionBy(*TURN_KEY, "call_id").orderBy("pos")
    call = F.col("s.type") == "tool_call"
    depth = F.sum(F.when(call, 1).otherwise(-1)).over(by_id.rowsBetween(Window.unboundedPreceding, 0))
    # a call opens level `depth`, an output closes level `depth + 1`; levels below 1 are outputs that came first
    s = s.withColumn("call", call).withColumn("depth", depth)
    s = s.withColumn("level", F.when(call, F.col("depth")).otherwise(F.col("depth") + 1))
    at_level = Window.partitionBy(*TURN_KEY, "call_id", "level").orderBy("pos")
    s = s.withColumn("pair", F.floor((F.row_number().over(at_level) - 1) / 2))
    rows = s.groupBy(*TURN_KEY, "call_id", "level", "pair").agg(
        F.min("pos").alias("pos"), F.max(F.when(call, F.col("s"))).alias("c"), F.max(F.when(~call, F.col("s"))).alias("o")
    )
    order = Window.partitionBy(*TURN_KEY).orderBy("pos")
    status, failed = outcome(F.col("o.output"))
    return rows.select(
        *TURN_KEY,
        (F.row_number().over(order) - 1).cast("long").alias("call_ordinal"),
        "call_id",
        F.coalesce("c.timestamp", "o.timestamp").alias("timestamp"),
        F.col("c.name").alias("tool_name"),
        F.col("c.arguments").alias("arguments_text"),
        F.col("o.output").alias("output_text"),
        status.alias("status"),
        failed.alias("is_error"),
    )


def outcome(output: Column) -> tuple[Column, Column]:
    """Status and error flag of a tool's JSON output; text that isn't JSON says nothing."""
    v = F.try_parse_json(output)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    is_text = F.schema_of_variant(F.try_variant_get(v, "$.status", "variant")) == "STRING"
    status = F.when(is_text, get("$.status", "string"))
    low = F.lower(status)
    bad_status = F.coalesce(low.rlike("error|fail|abort|denied"), F.lit(False))
    flagged = F.coalesce(get("$.is_error", "boolean"), F.lit(False))
    error = get("$.error", "variant")
    has_error = error.isNotNull() & ~F.is_variant_null(error)
    code = F.coalesce(get("$.metadata.exit_code", "long") != 0, F.lit(False))
    failed = bad_status | flagged | has_error | code
    return F.coalesce(status, F.when(failed, F.lit("error"))), failed


# --- file accesses -------------------------------------------------------------------------------


def access_kind(tool: Column) -> Column:
    """What a tool does to files, by its name; listing wins over editing, writing and reading."""
    n = F.lower(tool)
    has = lambda *words: _any([n.contains(w) for w in words])
    return (
        F.when(has("glob", "list"), "list")
        .when(has("edit", "replace", "patch"), "edit")
        .when(has("write"), "write")
        .when(has("read", "view", "grep"), "read")
        .otherwise("other")
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def looks_like_directory(path: Column) -> Column:
    """No extension, and a name that is hidden, a variable, or all lower-case letters, digits, _ and -."""
    p = F.regexp_replace(F.trim(F.regexp_replace(F.trim(path), "^[\"']+|[\"']+$", "")), "/+$", "")
    name = F.element_at(F.split(p, "/"), -1)
    extended = name.rlike(r"^.+\.[^.]*$") & ~name.isin(".", "..")
    return (p != "") & ~extended & (name.isin(".", "..", "~") | name.rlike(r"^[.$]") | name.rlike(r"^[a-z0-9_-]+$"))


def clean_path(path: Column, shell: bool = False) -> Column:
    """A usable path, trimmed; null for what isn't one. Shell words are held to more."""
    p = F.trim(path)
    bad = p.isin("", ".", "..", "-", "/dev/null")
    if shell:
        bad = bad | p.isin("EOF", "PATCH") | p.rlike(r"^[-(][^/]*$") | p.rlike(r"[$*?<>|;&]")
    return F.when(~bad, p)


def relative_to(path: Column, cwd: Column) -> Column:
    """The path below the session's folder, or itself if it is relative."""
    slash = lambda c: F.regexp_replace(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), "(?<=.)/+$", "")
    p, root = slash(path), slash(cwd)
    below = F.when((root != "") & p.startswith(F.concat(root, F.lit("/"))), F.substring(p, F.length(root) + 2, F.length(p)))
    return F.coalesce(F.when(below != "", below), F.when(~path.startswith("/"), path))


def explicit_paths(calls: DataFrame) -> DataFrame:
    """(…, access_type, path) of calls whose arguments name files: a string or strings under the known keys."""
    v = F.try_parse_json("arguments_text")
    texts = []
    for key in ("file_path", "path", "file"):
        one, many = F.try_variant_get(v, f"$.{key}", "string"), F.try_variant_get(v, f"$.{key}", "array<string>")
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
        texts.append(F.coalesce(many, F.when(kind == "STRING", F.array(one)), F.array().cast("array<string>")))
    found = F.array_distinct(F.flatten(F.array(*texts)))
    rows = calls.withColumn("access_type", access_kind(F.col("tool_name"))).filter("access_type <> 'other'")
    rows = rows.withColumn("path", F.explode(found)).withColumn("path", clean_path(F.col("path"))).filter("path is not null")
    return rows.filter((F.col("access_type") != "list") | ~looks_like_directory(F.col("path")))


def patch_changes(patch: Column) -> Column:
    """Files of an apply-patch text: array of (access_type, path, added, removed).

    Each header starts a block; a block's lines are counted by their first character.
    """
    body = F.when(patch.contains("*** Begin Patch"), F.substring_index(patch, "*** Begin Patch", -1)).otherwise(patch)
    blocks = F.split(F.concat(F.lit("\n"), body), r"\r?\n(?=\*\*\* )")

    def one(b: Column) -> Column:
        lines = F.split(b, r"\r?\n")
        head = F.get(lines, F.lit(0))
        path = F.trim(F.regexp_extract(head, r"^\*\*\* (?:Add File|Update File|Delete File|Move to): (.*)$", 1))
        kind = F.when(head.rlike(r"^\*\*\* (Add File|Move to): "), "write").otherwise("edit")
        count = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign))).cast("long")
        return F.struct(kind.alias("access_type"), path.alias("path"), count("+").alias("added"), count("-").alias("removed"))

    return F.filter(F.transform(blocks, one), lambda c: ~c["path"].isin("", ".", "..", "-", "/dev/null"))


def file_accesses(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """File accesses of all calls: explicit paths, patches and shell commands, each once a call, kind and path."""
    from weft.operators.shell import shell_accesses, shell_commands

    base = [*TURN_KEY, "call_ordinal", "call_id", "timestamp", "tool_name"]
    patch = F.coalesce(F.try_variant_get(F.try_parse_json("arguments_text"), "$.input", "string"), F.col("arguments_text"))
    patches = calls.filter(F.lower("tool_name").contains("patch")).select(*base, F.inline(patch_changes(patch))).drop("added", "removed")
    plain = explicit_paths(calls.filter(~F.lower("tool_name").contains("patch"))).select(*base, "access_type", "path")
    shell = shell_commands(calls).select(*base, F.inline(shell_accesses("command")))
    rows = plain.unionByName(patches).unionByName(shell.select(*base, "access_type", "path")).dropDuplicates([*TURN_KEY, "call_ordinal", "access_type", "path"])
    cwd = sessions.select(*TURN_KEY[:3], "cwd")
    rows = rows.join(cwd, TURN_KEY[:3], "left").withColumn("repo_relative_path", relative_to(F.col("path"), F.col("cwd")))
    return rows.withColumn("file_name", file_name(F.col("path"))).drop("cwd")


# --- evidence, search text, metrics --------------------------------------------------------------

# Where a step's evidence comes from.
PLAIN = {"tool_call": (("name", "tool_name"), ("arguments", "tool_arguments")), "tool_call_output": (("output", "tool_output"),), "commentary": (("text", "commentary"),)}
METADATA = {
    "attachment": ("attachment_metadata", ("attachment_type",)),
    "delegation": ("delegation_metadata", ("call_id", "task_id", "event", "agent_id", "agent_type", "status")),
    "hook_summary": ("hook_summary", ("call_id", "hook_count", "prevented_continuation", "has_output", "level")),
    "provider_response_item": ("provider_response_item_metadata", ("item_type",)),
}
PAYLOAD = {
    "id": "id", "call_id": "call_id", "payload_type": "type", "status": "status", "name": "name", "role": "role", "model": "model", "action_type": "action.type",
}


def evidence(turns: DataFrame) -> DataFrame:
    """Ordered non-blank fragments of each turn: prompt, answer, then what each step says."""
    entry = lambda field, text: F.struct(F.lit(field).alias("field"), text.cast("string").alias("text"))

    def of_step(s: Column) -> Column:
        out = F.array().cast("array<struct<field:string,text:string>>")
        chain = F
        for kind, parts in PLAIN.items():
            chain = chain.when(s["type"] == kind, F.array(*(entry(f, s[c]) for c, f in parts)))
        chain = chain.when(s["type"] == "reasoning", F.transform(s["summary_list"], lambda t: entry("reasoning_summary", t)))
        for kind, (field, parts) in METADATA.items():
            values = {p: s[p] for p in parts}
            if kind == "provider_response_item":
                values |= {n: F.get_json_object(s["payload_json"], f"$.{path}") for n, path in PAYLOAD.items()}
            # keys in order; a null or blank value leaves its key out
            meta = F.to_json(F.struct(*(F.when(F.trim(v.cast("string")) != "", v).alias(n) for n, v in sorted(values.items()))))
            texts = [entry(field, meta)]
            if kind == "delegation":
                texts.insert(0, entry("delegation_summary", s["summary"]))
            chain = chain.when(s["type"] == kind, F.array(*texts))
        return F.coalesce(chain.otherwise(out), out)

    every = F.concat(F.array(entry("user_message", F.col("user_message")), entry("final_answer", F.col("final_answer_text"))), F.flatten(F.transform("steps", of_step)))
    kept = F.filter(every, lambda e: F.coalesce(F.trim(e["text"]) != "", F.lit(False)))
    rows = turns.select(*TURN_KEY, F.posexplode(kept).alias("evidence_ordinal", "e"))
    return rows.select(*TURN_KEY, F.col("evidence_ordinal").cast("long"), "e.field", "e.text")


FRAGMENT, TOTAL = 256, 2048


def search_text(turns: DataFrame) -> DataFrame:
    """Keyword text of each turn: prompt, answer, and the commentary, tool names and delegations of its steps."""
    piece = lambda s: F.when(s["type"] == "commentary", s["text"]).when(s["type"] == "tool_call", s["name"]).when(s["type"] == "delegation", s["summary"])
    texts = F.filter(F.transform("steps", lambda s: F.substring(collapse(piece(s)), 1, FRAGMENT)), lambda t: F.coalesce(t != "", F.lit(False)))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))

    def add(a: Column, t: Column) -> Column:
        cut = F.substring(t, F.lit(1), F.lit(TOTAL) - a["n"])
        return F.when(a["n"] >= TOTAL, a).otherwise(F.struct(F.concat(a["out"], F.array(cut)).alias("out"), (a["n"] + F.length(cut)).alias("n")))

    tool = F.aggregate(texts, zero, add, lambda a: F.array_join(a["out"], "\n"))
    whole = lambda c: F.substring(collapse(F.coalesce(c, F.lit(""))), 1, TOTAL)
    return turns.select(*TURN_KEY, whole("user_message").alias("user_message_text"), whole("final_answer_text").alias("final_answer_text"), F.coalesce(tool, F.lit("")).alias("tool_text"))


def metrics(turns: DataFrame) -> DataFrame:
    """Counts of step kinds, duration, runtime with delegated time, and patch line counts."""
    count = lambda kind: F.size(F.filter("steps", lambda s: s["type"] == kind)).cast("long")
    duration = millis_between(F.col("started_at"), F.col("completed_at"))
    delegated = F.aggregate(
        F.filter("steps", lambda s: s["type"] == "delegation"),
        F.lit(0).cast("long"),
        lambda a, s: a + F.coalesce(F.get_json_object(s["payload_json"], "$.totalDurationMs").cast("long"), F.lit(0).cast("long")),
    )
    patches = F.flatten(
        F.transform(
            F.filter("steps", lambda s: (s["type"] == "tool_call") & F.lower(s["name"]).contains("patch")),
            lambda s: patch_changes(F.coalesce(F.get_json_object(s["arguments"], "$.input"), s["arguments"])),
        )
    )
    add = lambda p, f: F.aggregate(p, F.lit(0).cast("long"), lambda a, c: a + c[f])
    totals = let(
        patches,
        lambda p: F.struct(
            F.size(F.array_distinct(F.transform(p, lambda c: c["path"]))).cast("long").alias("changed_file_count"), add(p, "added").alias("added_line_count"), add(p, "removed").alias("removed_line_count")
        ),
    )
    return turns.withColumns(
        {
            "step_count": F.size("steps").cast("long"),
            "tool_call_count": count("tool_call"),
            "tool_output_count": count("tool_call_output"),
            "attachment_count": count("attachment"),
            "delegation_count": count("delegation"),
            "hook_summary_count": count("hook_summary"),
            "has_final_answer": F.col("final_answer_text").isNotNull(),
            "duration_ms": duration,
            "effective_agent_runtime_ms": duration + delegated,
            "patch": totals,
        }
    ).select("*", "patch.*").drop("patch")
