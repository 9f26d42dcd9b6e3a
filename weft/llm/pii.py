"""Operator 1, PII: patterns propose spans, checksums confirm them, context words adjust the score.

Four base kinds (email, ip, card, phone) are always kept once their own check passes. The other
kinds are weaker alone: each has a prior score, a checksum or context words near the span raise it,
words that speak against it lower it, and the span stays if its score reaches the threshold. Context
words are those of English, German, French and Spanish. Where a checksum fails, the span is tried again
without the words at its end, then the search goes on behind its first character, so that words before or
after a number don't hide it.

Defined results: null or empty text has no spans; a repeated row gives a repeated result; an empty
table gives an empty table; other columns of the input are ignored, so their names cannot clash.
Every pattern is written to scan a text in linear time, so very long texts need no cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weft.llm.spans import digest, joined, map_texts
from weft.runtime import table

BASE = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A run of digits that starts no address is taken whole, which keeps the scan linear.
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)|[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an account number: letters count from 10, the first four go last."""
    flat = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def account_end(text: str, start: int, end: int) -> int | None:
    """Where an account number from ``start`` ends: the longest run of its groups that passes the check."""
    while end - start >= 15:
        if len(text[start:end].replace(" ", "")) <= 34 and mod97(text[start:end]):
            return end
        end = text.rfind(" ", start, end)
    return None


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each ``@``; the local part goes back no further than the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1) if at >= floor else None
        if m:
            start = at
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                floor = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if m.lastindex and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return found


@dataclass(frozen=True)
class Detector:
    """A proposing pattern, an optional checksum, and words nearby that count for or against."""

    kind: str
    pattern: re.Pattern
    prior: float
    confirm: Callable[[str, int, int], int | None] | None = None
    confirmed: float = 0.0
    near: re.Pattern | None = None
    against: re.Pattern | None = None


def words(*alternatives: str) -> re.Pattern:
    return re.compile(r"(?<![^\W\d_])(?:" + "|".join(alternatives) + r")(?![^\W\d_])", re.I)


#: The method's own kinds.
DETECTORS = (
    Detector(
        "iban",
        re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
        0.2,
        account_end,
        0.6,
        words("iban", "account", "bank", "transfer", "konto", "überweisung", "compte", "banque", "virement", "cuenta", "banco", "transferencia"),
        words("isbn", "part", "order", "serial", "teil", "bestellung", "pièce", "commande", "pieza", "pedido"),
    ),
    Detector(
        "ssn",
        re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
        0.4,
        near=words("ssn", "social", "security", "taxpayer", "sozialversicherung", "sécurité", "sociale", "seguridad"),
        against=words("part", "order", "serial", "ticket", "teil", "bestellung", "pièce", "commande", "pieza", "pedido"),
    ),
    Detector(
        "phone_local",
        re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"),
        0.4,
        near=words("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "telefon", "handy", "anruf", "téléphone", "tél", "portable", "teléfono", "móvil", "llamar"),
        against=words("part", "order", "serial", "version", "teil", "bestellung", "pièce", "commande", "pieza", "pedido"),
    ),
)
THRESHOLD, WINDOW, NEAR, AGAINST = 0.7, 48, 0.35, -0.4
RANK = {k: i for i, k in enumerate([*BASE, *(d.kind for d in DETECTORS)])}


def confirmed_spans(d: Detector, text: str) -> Iterator[tuple[int, int]]:
    """Proposals that the checksum, if there is one, confirms; proposals are short, so retries keep the scan linear."""
    m = d.pattern.search(text)
    while m:
        end = d.confirm(text, *m.span()) if d.confirm else m.end()
        if end is not None:
            yield m.start(), end
        m = d.pattern.search(text, m.start() + 1 if end is None else end)


def score(d: Detector, text: str, start: int, end: int) -> float:
    """Prior and the checksum's weight, plus or less that of words within WINDOW characters."""
    total = d.prior + d.confirmed
    around = text[max(0, start - WINDOW) : start] + "\n" + text[end : end + WINDOW]
    if d.near and d.near.search(around):
        total += NEAR
    if d.against and d.against.search(around):
        total += AGAINST
    return total


def scored_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float]]:
    """Spans of the method's own kinds that reach THRESHOLD and overlap no base span."""
    found = []
    taken = sorted((s, e) for s, e, _ in base)
    starts, reach = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]
    for d in DETECTORS:
        for start, end in confirmed_spans(d, text):
            x = score(d, text, start, end)
            # base spans that start before the end reach no further than reach[...]
            if x >= THRESHOLD and reach[bisect_left(starts, end)] <= start:
                found.append((start, end, d.kind, x))
    return found


def pii_row(text: str) -> tuple:
    base = base_spans(text)
    more = scored_spans(text, base) if text else []
    counts = [sum(k == kind for _, _, k in base) for kind in BASE]
    scores = ",".join(f"{k}:{s}:{e}:{x:.2f}" for s, e, k, x in sorted(more))
    return *counts, digest(joined(base, RANK)), joined([*base, *(x[:3] for x in more)], RANK), scores


FIELDS = [(f"n_{k}", T.LongType()) for k in BASE] + [(c, T.StringType()) for c in ("base_sha256", "spans", "scored")]


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, counts of the base kinds, digest of the base spans, all spans, and scores.

    One pass, no shuffle: rows stay where they were read.
    """
    return map_texts(df, [id_col], text_col, FIELDS, pii_row)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
