"""Column types of the normalised tables and the values their enumerations take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SESSION_KEY = ["project_id", "provider", "session_id"]
TURN_KEY = [*SESSION_KEY, "turn_ordinal"]

SESSIONS = (
    "project_id string, provider string, session_id string, parent_session_id string, session_kind string, "
    "archive_path string, cwd string, cli_version string, schema_id string, determinism string, source_size long, "
    "source_mtime_ms long, origin_kind string, origin_user_id string, origin_remote string, imported_at string, share_state string"
)
STEP = (
    "struct<type:string,timestamp:string,text:string,summary:string,summary_list:array<string>,encrypted:boolean,"
    "call_id:string,name:string,arguments:string,output:string,attachment_type:string,task_id:string,event:string,"
    "agent_id:string,agent_type:string,status:string,hook_count:bigint,prevented_continuation:boolean,"
    "has_output:boolean,level:string,item_type:string,payload_json:string>"
)
#: A turn's token counters.
TOKENS = (
    "input_uncached_token_count", "cache_read_token_count", "cache_write_token_count", "output_token_count", "reasoning_token_count",
    "provider_total_token_count", "total_token_count",
)
TURNS = (
    "project_id string, provider string, session_id string, turn_ordinal long, turn_id string, started_at string, "
    "completed_at string, status string, user_message string, final_answer_at string, final_answer_text string, "
    f"primary_model string, {', '.join(f'{t} long' for t in TOKENS)}, steps array<{STEP}>"
)
#: Measures that are counted when a turn is taken in, before anything is redacted.
METRICS = (
    "step_count", "tool_call_count", "tool_output_count", "attachment_count", "delegation_count", "hook_summary_count",
    "duration_ms", "effective_agent_runtime_ms", "changed_file_count", "added_line_count", "removed_line_count",
)
TOOL_CALLS = (
    "project_id string, provider string, session_id string, turn_ordinal long, call_ordinal long, call_id string, "
    "timestamp string, tool_name string, arguments_text string, output_text string, status string, is_error boolean"
)
FILE_ACCESSES = (
    "project_id string, provider string, session_id string, turn_ordinal long, call_ordinal long, call_id string, "
    "timestamp string, tool_name string, access_type string, path string, repo_relative_path string, file_name string"
)
EVIDENCE = "project_id string, provider string, session_id string, turn_ordinal long, evidence_ordinal long, field string, text string"
SEARCH = "project_id string, provider string, session_id string, turn_ordinal long, user_message_text string, final_answer_text string, tool_text string"
USERS = "user_id string, display_name string, email string, public_key string, source string, updated_at string"

#: The enumerations of the tables.
ENUMS = {
    "provider": ("claude", "codex"),
    "session_kind": ("primary", "subagent"),
    "status": ("completed", "aborted", "incomplete"),
    "origin_kind": ("local", "shared"),
    "share_state": ("unset", "included", "excluded"),
    "access_type": ("read", "write", "edit", "list", "other"),
    "determinism": ("exact", "best_effort_forward"),
}


def checked(df: DataFrame) -> DataFrame:
    """``df`` whose enumerated columns fail on any other value when they are read."""
    kept: dict[str, Column] = {}
    for name, values in ENUMS.items():
        if name in df.columns:
            kept[name] = F.when(F.col(name).isNull() | F.col(name).isin(*values), F.col(name)).otherwise(
                F.raise_error(F.concat(F.lit(f"unknown {name}: "), F.col(name))).cast("string")
            )
    return df.withColumns(kept) if kept else df
