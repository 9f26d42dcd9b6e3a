"""Text helpers as column expressions: folding, previews, patterns, path forms."""

from __future__ import annotations

import re

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(c: Column) -> Column:
    """Lower-case A-Z only: the case-insensitive comparison of paths and ids leaves other letters alone."""
    return F.translate(c, UPPER, LOWER)


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def first_line(c: Column) -> Column:
    return F.element_at(F.split(c, "\r?\n"), 1)


def preview(c: Column, cap: int) -> tuple[Column, Column, Column]:
    """Collapsed text of at most ``cap`` characters, the last one an ellipsis if cut; chars; total chars."""
    whole = collapse(c)
    total = F.length(whole)
    text = F.when(total <= cap, whole).otherwise(F.concat(F.substring(whole, 1, cap - 1), F.lit("…")))
    return text, F.least(total, F.lit(cap)).cast("long"), total.cast("long")


def like_escape(s: str) -> str:
    """``s`` as a literal part of a LIKE pattern whose escape is ``!``."""
    return re.sub(r"([!%_])", r"!\1", s)


def like_prefix(c: Column, s: str) -> Column:
    return F.like(fold(c), F.lit(like_escape(fold_text(s)) + "%"), F.lit("!"))


def like_contains(c: Column, s: str) -> Column:
    return F.like(fold(c), F.lit("%" + like_escape(fold_text(s)) + "%"), F.lit("!"))


def glob_to_regex(glob: str) -> str:
    """Regex of a path glob: ``*`` and ``?`` stay within a component, ``**`` crosses components.

    ``**`` stands as a whole component only; ``[...]`` and ``[!...]`` are character classes. The
    result matches whole strings and expects both sides folded.
    """
    g, out, k = fold_text(glob), [], 0
    while k < len(g):
        c = g[k]
        if c == "*":
            run = len(g[k:]) - len(g[k:].lstrip("*"))
            if run > 2:
                raise ValueError("a wildcard is * or **")
            if run == 2:
                before, after = k == 0 or g[k - 1] == "/", k + 2 == len(g) or g[k + 2] == "/"
                if not (before and after):
                    raise ValueError("** must be a whole path component")
                if k + 2 < len(g):
                    out.append("(?:.*/)?")
                    k += 3
                    continue
                out.append(".*")
            else:
                out.append("[^/]*")
            k += run
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[":
            end = g.find("]", k + 3 if g[k + 1 : k + 2] == "!" else k + 2)
            if end < 0:
                raise ValueError("a character class is not closed")
            negated = g[k + 1] == "!"
            inner = g[k + 2 if negated else k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&", "\\&")
            out.append(f"[{'^/' if negated else ''}{inner}]")
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return "(?s)^" + "".join(out) + "$"


#: Constructs that a linear-time regex engine rejects: look-around and back-references.
NOT_LINEAR = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|[*+?]\+|\{\d+(?:,\d*)?\}\+)")
#: A repeated group that itself holds an unbounded repeat: exponential time for a backtracking engine.
NESTED = re.compile(r"\((?:[^()\\]|\\.)*(?:[*+]|,\})\??(?:[^()\\]|\\.)*\)(?:[*+]|\{\d+,\})")
MAX_PATTERN = 1024
# Long names of general categories, which Java knows by their letters alone.
CATEGORIES = {
    "Letter": "L", "Lowercase_Letter": "Ll", "Uppercase_Letter": "Lu", "Titlecase_Letter": "Lt", "Modifier_Letter": "Lm", "Other_Letter": "Lo",
    "Mark": "M", "Number": "N", "Decimal_Number": "Nd", "Letter_Number": "Nl", "Punctuation": "P", "Symbol": "S", "Separator": "Z", "Other": "C",
}


def java_regex(pattern: str) -> str:
    """A pattern of the linear engine's dialect in Java's: Unicode classes, ``\\n`` as the only line end.

    ``$`` means the very end unless (?m) is on, groups are named ``(?P<n>...)`` and scripts ``\\p{Greek}``.
    Different stay: classes of classes (``[a&&b]`` reads alike, ``[a--b]`` and ``[a~~b]`` don't).
    """
    lines = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    out, k, inside = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            name = re.match(r"\\([pP])\{(\^?)(?:Script=|sc=|General_Category=|gc=)?([A-Za-z_]{3,})\}", pattern[k:])
            if name:
                known = CATEGORIES.get(name[3])
                out.append(f"\\{'P' if (name[1] == 'P') != bool(name[2]) else 'p'}{{{known or 'Is' + name[3]}}}")
                k += name.end()
                continue
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            # a bracket that comes first in a class is a plain one
            first = re.match(r"\[\^?\]", pattern[k:])
            if first:
                out.append(first[0][:-1] + "\\]")
                k += first.end()
                continue
        elif c == "$" and not lines:
            c = "\\z"
        elif pattern.startswith("(?P<", k):
            out.append("(?<")
            k += 4
            continue
        out.append(c)
        k += 1
    return "(?Ud)" + "".join(out)


def checked_regex(pattern: str) -> str:
    """``pattern`` in Java's dialect; refuses what a linear engine wouldn't take or Java can't compile."""
    if not pattern:
        raise ValueError("the pattern is empty")
    if len(pattern) > MAX_PATTERN:
        raise ValueError(f"the pattern has over {MAX_PATTERN} characters")
    if NOT_LINEAR.search(pattern):
        raise ValueError("look-around, back-references and possessive repeats are not supported")
    if NESTED.search(pattern):
        raise ValueError("an unbounded repeat of an unbounded repeat is not supported")
    java = java_regex(pattern)
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(java)
        except IllegalArgumentException as e:
            raise ValueError(f"the pattern can't be compiled: {e}") from None
    return java


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: What a path needs to hold for its normal form to be another: most paths are left as they are.
NOT_NORMAL = r"\\|//|(^|/)\.\.?(/|$)|^\s|\s$|[^/]/$"


def normal_path(c: Column) -> Column:
    """Slash-separated form: ``\\`` to ``/``, empty and ``.`` parts dropped, ``..`` folded where it can be."""
    return F.when(~c.rlike(NOT_NORMAL), c).otherwise(let(plain_path(F.replace(F.trim(c), F.lit("\\"), F.lit("/"))), lambda p: F.when(p.rlike(LEFT), folded(p)).otherwise(p)))


#: A part that the next one, ``..``, takes back.
TAKEN_BACK = r"(^|/)(?!\.\.?(?:/|$))[^/]+/\.\.(?:/|$)"
#: What the replacements of ``plain_path`` may leave: parts still to be taken back, or ends still to be trimmed.
LEFT = TAKEN_BACK + r"|[^/]/$|(^|/)\.(/|$)|//|^/\.\.(/|$)"


def plain_path(p: Column) -> Column:
    """Most paths' normal form by replacements alone, which stay in generated code; rare ones are left for ``folded``."""
    p = F.regexp_replace(p, r"/(?:\.?/)+", "/")
    p = F.regexp_replace(p, r"^(?:\./)+", "")
    p = F.regexp_replace(p, r"(?:^|(?<=/))\.$", "")
    for _ in range(2):
        p = F.regexp_replace(p, TAKEN_BACK, "$1")
    p = F.regexp_replace(p, r"^/(?:\.\.(?:/|$))+", "/")
    return F.regexp_replace(p, r"(?<=[^/])/$", "")


def folded(path: Column) -> Column:
    absolute = path.startswith("/")
    empty = F.array().cast("array<string>")
    parts = F.array_join(F.aggregate(F.split(path, "/"), empty, lambda d, p: fold_part(d, p, absolute)), "/")
    return F.when(absolute, F.concat(F.lit("/"), parts)).otherwise(parts)


def fold_part(done: Column, part: Column, absolute: Column) -> Column:
    last = F.get(done, F.size(done) - 1)
    can_pop = (F.size(done) > 0) & (last != "..")
    kept = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    up = F.when(can_pop, kept).when(absolute, done).otherwise(F.concat(done, F.array(part)))
    return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))


def inside_project(c: Column) -> Column:
    """A normal path that is relative and doesn't leave the project; else null."""
    # most paths are normal already and stay in generated code
    return F.when(~c.rlike("^/|^$|" + NOT_NORMAL), c).otherwise(inside_of(c))


def inside_of(c: Column) -> Column:
    return let(normal_path(c), lambda p: F.when((p != "") & ~p.rlike(r"^(/|\.\.(/|$))"), p))


def display_path(relative: Column, path: Column, root: str | None) -> Column:
    """Project-scoped identity of an access: its relative path, else its path below ``root``.

    ``/private`` may stand before either side's path without making a difference.
    """
    found = inside_project(relative)
    if root is None:
        return found
    bare = re.sub(r"^/private(?=/)", "", root.replace("\\", "/").rstrip("/"))
    below = let(F.regexp_extract(normal_path(path), "^(?:/private)?" + re.escape(bare) + "/(.+)$", 1), lambda p: F.when(p != "", p))
    plain = path.startswith(f"{bare}/") & ~path.rlike(NOT_NORMAL)
    return F.coalesce(found, F.when(plain, F.substring(path, len(bare) + 2, 1 << 20)).otherwise(below))


def file_name(c: Column) -> Column:
    name = F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)
    return F.when(name != "", name)


def path_hash(path: str) -> str:
    """12 hex digits of FNV-1a over the path's bytes: a stable project id."""
    h = 0xCBF29CE484222325
    for b in path.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"[:12]


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", fold_text(name)).strip("-") or "project"


def git_url(c: Column) -> Column:
    """Comparable form of a Git URL: host/path, no scheme, user, port, ``.git`` or trailing slash."""
    u = F.regexp_replace(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"^[^@/]+@", "")
    u = F.regexp_replace(u, r"^([^/:]+):(?!\d+/)", "$1/")
    u = F.regexp_replace(u, r"^([^/:]+):\d+/", "$1/")
    u = F.regexp_replace(u, r"(\.git)?/*$", "")
    host = F.substring_index(u, "/", 1)
    return F.concat(fold(host), F.substring(u, F.length(host) + 1, F.length(u)))
