"""Structural comparison of JSON schemas, such as ``df.schema.jsonValue()``."""

from __future__ import annotations

UNORDERED = ("required", "enum", "oneOf", "anyOf", "allOf")


def normal(node, key: str | None = None):
    """Objects by key, unordered lists sorted: equal meaning, equal value."""
    if isinstance(node, dict):
        return {k: normal(v, k) for k, v in sorted(node.items())}
    if isinstance(node, list):
        each = [normal(v) for v in node]
        return sorted(each, key=repr) if key in UNORDERED else each
    return node


def differences(old, new, limit: int = 8) -> list[str]:
    """Paths at which the two differ, at most ``limit``."""
    out: list[str] = []

    def walk(a, b, at: str) -> None:
        if len(out) >= limit or a == b:
            return
        if isinstance(a, dict) and isinstance(b, dict):
            for k in sorted({*a, *b}):
                if k not in a or k not in b:
                    out.append(f"{at}/{k}: {'added' if k not in a else 'removed'}")
                else:
                    walk(a[k], b[k], f"{at}/{k}")
        elif isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
            for k, (x, y) in enumerate(zip(a, b)):
                walk(x, y, f"{at}/{k}")
        else:
            out.append(f"{at or '/'}: changed")

    walk(normal(old), normal(new), "")
    return out[:limit]
