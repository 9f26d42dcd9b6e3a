"""Files that shell commands touch: a table of what each command does to its operands.

One pass over a command line gives its simple commands: their words without quotes, the files that they
redirect to or from, and the here-documents that they are given. Commands outside the table touch nothing
that is known.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tools that run a shell, and the keys of their arguments that hold the command.
TOOLS = ("exec_command", "shell_command", "shell", "Bash")
KEYS = ("cmd", "command", "script", "command_string")

# Options of a command that take the next word.
VALUES = {
    "head": "-n -c", "tail": "-n -c", "sort": "-k -t -o -S", "stat": "-c -f", "xxd": "-l -s -c", "rustfmt": "--edition --config --config-path",
    "sed": "-e -f -i --expression --file", "grep": "-e -f -A -B -C -m --include --exclude --exclude-dir", "rg": "-e -f -g -t -T -A -B -C -m --glob --type",
    "awk": "-f -F -v --file", "jq": "--arg --argjson --rawfile --slurpfile -f --from-file --indent", "chmod": "--reference", "chown": "--reference", "chgrp": "--reference",
    "touch": "-r -d -t --reference --date", "curl": "-o --output -H -d -X -u --header --data --request --user", "diff": "-U -C -I", "fd": "-e -t -d -E", "node": "-r", "nl": "-w -s", "perl": "-e -E -M -I",
}
# Commands by what happens to their operands.
READ = {"cat", "nl", "head", "tail", "wc", "sort", "mdls", "file", "stat", "rustfmt", "xxd", "diff"}
AFTER_FIRST_READ = {"grep", "rg", "awk", "jq"}
SCRIPTS = {"bash", "sh", "zsh", "node", "python", "python3", "ruby"}
AFTER_FIRST_EDIT = {"chmod", "chown", "chgrp"}
ONLY_REDIRECTIONS = {"mkdir", "rmdir", "echo", "printf", ":", "lsof"}
PREFIXES = {"sudo", "env", "time", "nohup", "command", "exec", "then", "do", "else", "if", "while", "!", "{"}
FILE_OPTIONS = {
    "awk": {"-f": "read", "--file": "read"}, "jq": {"-f": "read", "--from-file": "read"}, "touch": {"-r": "read", "--reference": "read"},
    "chmod": {"--reference": "read"}, "chown": {"--reference": "read"}, "chgrp": {"--reference": "read"}, "curl": {"-o": "write", "--output": "write"}, "cargo": {"--manifest-path": "read"},
}
REDIRECT = {">": "write", ">>": "write", ">|": "write", "&>": "write", "&>>": "write", "<": "read", "<>": "edit"}
#: Operators, longest first; those that take no file, and those that end a command.
OPERATORS = ("&>>", "<<<", "<<-", "&>", "<<", ">>", ">|", "<>", ">&", "<&", "&&", "||", "|&", ";;", "<", ">", "|", ";", "(", ")", "\n")
ENDS = {"&&", "||", "|&", ";;", "|", ";", "(", ")", "\n"}
#: What stands for a substitution's output in a word: no usable path holds it.
OUTPUT = "$()"
PATCH = re.compile(r"^\*\*\* (Add File|Update File|Delete File|Move to): (.+)$", re.M)


def directory_like(path: str) -> bool:
    name = path.strip("'\" ").rstrip("/").rsplit("/", 1)[-1]
    if not name or (re.fullmatch(r".+\.[^.]*", name) and name not in (".", "..")):
        return False
    return name in (".", "..", "~") or name[0] in ".$" or re.fullmatch(r"[a-z0-9_-]+", name) is not None


def usable(path: str) -> bool:
    p = path.strip()
    return not (p in ("", ".", "..", "-", "/dev/null", "EOF", "PATCH") or re.match(r"^[-(][^/]*$", p) or re.search(r"[$*?<>|;&`]", p))


@dataclass
class Command:
    """A simple command: words, (kind, path) of its redirections, and the bodies of its here-documents."""

    words: list[str] = field(default_factory=list)
    files: list[tuple[str, str]] = field(default_factory=list)
    bodies: list[str] = field(default_factory=list)


class Lexer:
    """One pass over a command line. A quote or substitution that isn't closed goes on to the end."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.commands = [Command()]
        self.waiting: list[tuple[str, Command]] = []  # here-documents whose bodies come behind the line

    def quoted(self, at: int) -> tuple[str, int]:
        """What stands between the quote at ``at`` and its end, and the place behind it."""
        text, quote, out, k = self.text, self.text[at], [], at + 1
        while k < len(text) and text[k] != quote:
            if quote == '"' and text[k] == "\\" and text[k + 1 : k + 2] in ('"', "\\", "$", "`", "\n"):
                out.append(text[k + 1].replace("\n", ""))
                k += 2
            elif quote == '"' and text.startswith("$(", k):
                out.append(OUTPUT)
                k = self.behind(k + 1)
            else:
                out.append(text[k])
                k += 1
        return "".join(out), k + 1

    def behind(self, at: int) -> int:
        """The place behind the bracket that closes the one at ``at``; quotes within hide brackets."""
        depth, k = 0, at
        while k < len(self.text):
            c = self.text[k]
            if c == "\\":
                k += 1
            elif c in "'\"":
                k = self.quoted(k)[1] - 1
            elif c in "()":
                depth += 1 if c == "(" else -1
                if not depth:
                    return k + 1
            k += 1
        return len(self.text)

    def word(self) -> str:
        """The word that starts here, without its quotes."""
        text, out = self.text, []
        while self.at < len(text):
            c = text[self.at]
            if c == "\\":
                out.append(text[self.at + 1 : self.at + 2].replace("\n", ""))
                self.at += 2
            elif c in "'\"":
                inside, self.at = self.quoted(self.at)
                out.append(inside)
            elif c == "`":
                end = text.find("`", self.at + 1)
                out.append(OUTPUT)
                self.at = len(text) if end < 0 else end + 1
            elif text.startswith("$(", self.at):
                out.append(OUTPUT)
                self.at = self.behind(self.at + 1)
            elif c.isspace() or c in ";|<>()" or text.startswith(("&&", "&>"), self.at):
                break
            else:
                out.append(c)
                self.at += 1
        return "".join(out)

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at] != "\n" and self.text[self.at].isspace():
            self.at += 1

    def take_bodies(self) -> None:
        """Read the here-documents that the line before asked for, each up to its delimiter on a line of its own."""
        for delimiter, command in self.waiting:
            body = []
            while self.at < len(self.text):
                end = self.text.find("\n", self.at)
                end = len(self.text) if end < 0 else end
                line, self.at = self.text[self.at : end], end + 1
                if line.strip() == delimiter:
                    break
                body.append(line)
            command.bodies.append("\n".join(body))
        self.waiting = []

    def redirect(self, operator: str, bare: bool) -> None:
        """Take the operator's word; digits right before it name a descriptor and are no word."""
        command = self.commands[-1]
        if bare and command.words and command.words[-1].isdigit():
            command.words.pop()
        self.space()
        target = self.word()
        if operator in ("<<", "<<-"):
            if target:
                self.waiting.append((target, command))
        elif operator in REDIRECT and target and not target.isdigit():
            command.files.append((REDIRECT[operator], target))

    def read(self) -> list[Command]:
        text, ended = self.text, -1  # where the last word ended
        while self.at < len(text):
            if text.startswith(("<(", ">("), self.at):
                self.at = self.behind(self.at + 1)
                continue
            operator = next((o for o in OPERATORS if text.startswith(o, self.at)), None)
            if operator is None:
                if text[self.at].isspace():
                    self.at += 1
                    continue
                self.commands[-1].words.append(self.word())
                ended = self.at
                continue
            bare = ended == self.at
            self.at += len(operator)
            if operator in ENDS:
                if operator == "\n":
                    self.take_bodies()
                self.commands.append(Command())
            else:
                self.redirect(operator, bare)
        return [c for c in self.commands if c.words or c.files]


def operands(name: str, words: list[str]) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """Operands, options, and files that options name."""
    takes, named = set(VALUES.get(name, "").split()), FILE_OPTIONS.get(name, {})
    ops, options, found, k = [], [], [], 0
    while k < len(words):
        w = words[k]
        if w == "--":
            ops += words[k + 1 :]
            break
        if w.startswith("-") and len(w) > 1:
            option, eq, value = w.partition("=")
            options.append(option)
            if option in named and (eq or k + 1 < len(words)):
                found.append((named[option], value if eq else words[k + 1]))
            if option in ("--rawfile", "--slurpfile") and k + 2 < len(words):
                found.append(("read", words[k + 2]))
                k += 1
            k += 1 if option in takes and not eq else 0
        else:
            ops.append(w)
        k += 1
    return ops, options, found


def touched(command: Command) -> list[tuple[str, str]]:
    """(kind, path) of one simple command."""
    words, out = command.words, command.files
    while words and (words[0] in PREFIXES or re.fullmatch(r"[A-Za-z_]\w*=.*", words[0], re.S)):
        words = words[1:]
    if not words:
        return []
    name = words[0].rsplit("/", 1)[-1]
    ops, options, named = operands(name, words[1:])
    out = named + out
    files = [p for p in ops if not directory_like(p)]
    given = bool({"-e", "-f", "--expression", "--file", "--regexp", "--from-file"} & {*options})
    body = ops if given else ops[1:]
    flags = "".join(o[1:] for o in options if re.fullmatch(r"-[A-Za-z]+", o))
    as_ = lambda kind, paths: [(kind, p) for p in paths]
    if name in ("bash", "sh", "zsh") and "c" in flags and ops:
        return accesses(ops[0]) + out
    if name in SCRIPTS:
        stop = {"-c", "-m", "-e"} & {*options}
        return as_("read", ops[:1] if not stop else []) + out
    if name == "sed":
        return as_("edit" if any(o.startswith("-i") for o in options) else "read", ops[1:]) + out
    if name == "rg" and "--files" in options:
        return as_("list", files) + out
    if name in AFTER_FIRST_READ:
        keep = body if name in ("awk", "jq") else [p for p in body if not directory_like(p)]
        return as_("read", keep) + out
    if name in READ:
        recursive = name == "diff" and "r" in flags
        return as_("read", files if recursive else ops) + out
    if name in ("ls", "tree"):
        return as_("list", files) + out
    if name == "find":
        roots = []
        for w in words[1:]:
            if w.startswith("-") or w in ("(", "!"):
                break
            roots.append(w)
        return as_("list", [p for p in roots if not directory_like(p)]) + out
    if name == "fd":
        return as_("list", [p for p in ops[1:] if not directory_like(p)]) + out
    if name == "cargo":
        return (as_("edit", words[words.index("--") + 1 :]) if "fmt" in ops and "--" in words else []) + out
    if name in ("cp", "ln") and len(ops) >= 2:
        return as_("read", ops[:-1] if name == "cp" else ops[:1]) + as_("write", ops[-1:]) + out
    if name == "mv" and len(ops) >= 2:
        return as_("edit", ops[:-1]) + as_("write", ops[-1:]) + out
    if name == "rm":
        return as_("edit", files if "r" in flags or "R" in flags else ops) + out
    if name in AFTER_FIRST_EDIT:
        return as_("edit", ops if "--reference" in options else ops[1:]) + out
    if name == "touch":
        return as_("write", ops) + out
    if name in ("source", "."):
        return as_("read", ops[:1]) + out
    if name in ("test", "["):
        words = [w for w in words[1:] if w != "]"]
        pairs = [(words[k - 1], words[k + 1]) for k, w in enumerate(words) if w in ("-ef", "-nt", "-ot") and 0 < k < len(words) - 1]
        tests = [(w, words[k + 1]) for k, w in enumerate(words[:-1]) if re.fullmatch(r"-[abcdefghkprstuwxLOGNS]", w)]
        return as_("read", [p for pair in pairs for p in pair] + [p for t, p in tests if t != "-d" or not directory_like(p)]) + out
    if name == "perl":
        scripted = any(re.fullmatch(r"-\w*[eE]", o) for o in options)
        return (as_("edit", ops if scripted else ops[1:]) if "i" in flags else []) + out
    if name in ONLY_REDIRECTIONS or name == "curl":
        return out
    return []


def accesses(command: str) -> list[tuple[str, str]]:
    """Distinct (kind, path) of a command line, in order; here-documents are data, but patches count."""
    found = []
    for c in Lexer(command).read():
        if "apply_patch" in c.words:
            found += [("write" if k in ("Add File", "Move to") else "edit", p.strip()) for body in c.bodies for k, p in PATCH.findall(body)]
        found += touched(c)
    return list(dict.fromkeys((k, p.strip()) for k, p in found if usable(p)))


ACCESSES = T.ArrayType(T.StructType([T.StructField("access_type", T.StringType()), T.StructField("path", T.StringType())]))


@F.pandas_udf(ACCESSES)
def shell_accesses(commands: pd.Series) -> pd.Series:
    return pd.Series([[{"access_type": k, "path": p} for k, p in accesses(c)] if c else [] for c in commands], dtype=object)


def shell_commands(calls: DataFrame) -> DataFrame:
    """Calls of shell tools with their ``command``: a string, the last of ``bash -lc``, words, or the raw text."""
    v = F.try_parse_json("arguments_text")
    kind = lambda key: F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    texts = []
    for key in KEYS:
        words = F.try_variant_get(v, f"$.{key}", "array<string>")
        line = F.when(F.get(words, F.lit(1)).isin("-lc", "-c"), F.get(words, F.lit(2))).otherwise(F.array_join(words, " "))
        texts.append(F.when(kind(key) == "STRING", F.try_variant_get(v, f"$.{key}", "string")).otherwise(line))
    raw = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.col("arguments_text"))
    return calls.filter(F.col("tool_name").isin(*TOOLS)).withColumn("command", F.coalesce(*texts, raw))
