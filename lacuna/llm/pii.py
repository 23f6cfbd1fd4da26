"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

``find_spans`` works on one text; ``detect`` maps it over a table; ``redact`` replaces what was found.

Kinds that any text yields when pattern and validator hold (the base): ``email``, ``ip``, ``card`` (Luhn),
``phone`` (international form). Kinds that the method adds: ``iban`` (mod-97), ``ssn`` and ``phone_local``
(both only where nearby context words lift the score to the threshold).

Defined results: a null text counts as empty and has no spans; an empty table gives an empty result; repeated
rows each give their own row; columns other than the id and the text are ignored. Offsets are code points, the
end is exclusive. Every scan is linear in the length of the text.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "phone_local")
KINDS = BASE_KINDS + ADDED_KINDS
ORDER = {k: i for i, k in enumerate(KINDS)}
#: A span of an added kind is kept from this score on.
THRESHOLD = 0.6
#: So many code points on either side are searched for context words.
CONTEXT = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Four dotted numbers. A match can only begin where a run of digits begins, as no digit is a dot.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Per kind: the score of a confirmed match, what a context word adds, and the context words.
SCORES = {
    "email": (0.8, 0.15, re.compile(r"(?i)\b(?:e-?mail|contact|mailto|write to)\b")),
    "ip": (0.7, 0.2, re.compile(r"(?i)\b(?:ip|address|host|server|login|client)\b")),
    "card": (0.8, 0.2, re.compile(r"(?i)\b(?:card|credit|visa|mastercard|amex|payment|cvv)\b")),
    "phone": (0.7, 0.2, re.compile(r"(?i)\b(?:phone|tel|telephone|mobile|call|fax)\b")),
    "iban": (0.8, 0.2, re.compile(r"(?i)\b(?:iban|bank|account|bic|swift|konto|cuenta)\b")),
    "ssn": (0.3, 0.5, re.compile(r"(?i)\b(?:ssn|social security|social-security)\b")),
    "phone_local": (0.3, 0.4, re.compile(r"(?i)\b(?:phone|tel|telephone|mobile|call|fax)\b")),
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The Luhn check over a string of decimal digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 mod-97 check of an account number without spaces."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain; anchored at each @, so linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans as disjoint ones."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether no disjoint span of ``taken`` overlaps (a, b)."""
    i = bisect.bisect_left(taken, (b, 0))
    return i == 0 or taken[i - 1][1] <= a


def _score(kind: str, text: str, start: int, end: int) -> float:
    base, more, words = SCORES[kind]
    near = f"{text[max(0, start - CONTEXT):start]} {text[end:end + CONTEXT]}"
    return min(1.0, base + more) if words.search(near) else base


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind as listed in ``KINDS``."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or "0") <= 255 for q in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
        taken = _merged(sorted((a, b) for _, a, b in found))
        added = [("iban", *m.span()) for m in _IBAN.finditer(text) if 15 <= len(bare := m[0].replace(" ", "")) <= 34 and mod97(bare)]
        if "-" in text:
            added += [("ssn", *m.span()) for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"]
        added += [("phone_local", *m.span()) for m in _PHONE_LOCAL.finditer(text)]
        for kind, a, b in added:
            if _free(taken, a, b) and _score(kind, text, a, b) >= THRESHOLD:
                found.append((kind, a, b))
    found.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return [Span(k, a, b, _score(k, text, a, b)) for k, a, b in found]


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    last = -1
    for kind, a, b, _ in spans:
        if a < last:
            last = max(last, b)
            done = max(done, last)
            continue
        out += [text[done:a], f"<{kind}>"]
        done = last = b
    return "".join(out) + text[done:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id and ``spans``, an array of (kind, start, end, score)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            spans = [[s._asdict() for s in find_spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS)], [id_col, "spans"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind string, `start` bigint, `end` bigint, score double>>")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its columns as they are, but for the spans of the text, each replaced by ``<kind>``. Null stays null."""
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = [t if not t or not (s := find_spans(t)) else masked(t, s) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of what ``detect`` found."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(id_col, *[of(k) for k in BASE_KINDS], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
