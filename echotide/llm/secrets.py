"""Secret scans by assignment-aware lexing.

Plain patterns (assign, access, hex) find the well-known shapes. Beyond them a small lexer reads source and configuration
syntax around each assignment sign: the name before it (also where a type stands between) and the literals after it, quoted
(with escapes, prefixes, or three quotes) or bare, also joined with `+`; comparisons and calls assign nothing. A name on the
right-hand side stands for the literals it was given earlier in the text: constants are propagated by reference, so that a
name doubled again and again stays small. What a sensitive name receives is scored by the words of the name, and by length,
mixture and entropy of the value; from THRESHOLD on, its literals are reported as `named`, unless a plain span covers them.

Defined cases: a null or empty text has no spans. Every row is scanned by itself, over its whole text. Other columns take no
part. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex", "named")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Runs are maximal, so a longer run never starts inside a shorter one that fails.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts of names, lower case and without separators, and how sensitive they make a name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0,
    "privatekey": 1.0, "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "credential": 0.8, "bearer": 0.8, "authkey": 0.9,
    "connectionstring": 0.7, "dsn": 0.6,
}
#: Those that are as sensitive in the plural; `tokens` are mostly counted.
PLURAL = ("password", "passwd", "secret", "credential", "apikey", "accesskey")
#: Values that stand for no secret.
PLACEHOLDER = re.compile(
    r"example|changeme|change_me|placeholder|dummy|redacted|your[-_]?|xxxx|\*\*\*|^<.*>$|^\$\{.*\}$|^%.*%$", re.I)
THRESHOLD = 0.6

SIGN = re.compile(r"[=!<>]=+|:=|=>|[=:]")
ASSIGNS = (":=", "=>", "=", ":")  # every other sign compares
BLANKS = " \t\n\r\f\v"
NAME_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-"
#: The words of a name: parts between other characters, and humps of camel case.
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Between a colon and the sign of the value: a type. Before the sign in Go: `var name type`.
TYPE = re.compile(r"[ \t]*[A-Za-z_][\w.\[\]<>,|? \t*]*")
DECLARED = re.compile(r"\b(?:var|const)[ \t]+(\w+)[ \t]+[\w.\[\]*]+[ \t]*\Z")
PART = re.compile(
    r'''[ \t]*(?:[A-Za-z]{0,2}(?:"""(?P<long>(?:[^"\\]|\\.|"(?!""))*)"""|"(?P<double>(?:[^"\\\n]|\\.)*)"|'(?P<single>(?:[^'\\\n]|\\.)*)')'''
    r"|(?P<bare>[A-Za-z0-9+/_.=\-]+))", re.A | re.S)
JOIN = re.compile(r"[ \t]*\+[ \t]*\n?")


class Span(NamedTuple):
    start: int
    kind: int  # place in KINDS
    end: int
    score: float = 1.0


def base_spans(text: str) -> list[Span]:
    spans = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        spans += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def name_score(name: str) -> float:
    """How sensitive a name is: a part of the table is the end of one of its words, or of two neighbouring words together."""
    words = [w.lower() for w in WORDS.findall(name)]
    ends = words + [a + b for a, b in zip(words, words[1:])]
    return max((score for part, score in SENSITIVE.items() for w in ends if w.removesuffix("s" if part in PLURAL else " ").endswith(part)),
               default=0.0)


def value_score(signs: Counter) -> float:
    """0 for what is no secret; otherwise more with length, entropy and mixture of letters, digits and signs. A value is judged
    by how often each character occurs in it; one with blanks must mix three kinds of others."""
    size = sum(signs.values())
    blanks = sum(n for c, n in signs.items() if c.isspace())
    if size < 8:
        return 0.0
    entropy = -sum(n / size * math.log2(n / size) for n in signs.values())
    solid = [c for c in signs if not c.isspace()]
    classes = sum(any(map(test, solid)) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if classes < (3 if blanks else 2) or entropy < 2.5:
        return 0.0
    return min(1.0, 0.4 + 0.05 * (min(size, 1000) - 8) + 0.1 * classes + 0.1 * (entropy - 2.5))


def name_before(gap: str) -> str:
    """The name at the end of what lies between two signs, maybe quoted, then maybe a bracket; empty if there is none."""
    gap = gap.rstrip(BLANKS).removesuffix("]").rstrip(BLANKS)
    if gap.endswith(('"', "'")):
        gap = gap[:-1]
    return gap[len(gap.rstrip(NAME_SIGNS)):].lstrip("0123456789.-")


#: Where the count of a character stops growing: beyond that a value only repeats itself.
MOST = 1 << 40


class Value:
    """What a name was given: literals by place, and values of other names by reference, so that its size is that of its text
    however often it repeats. Characters are counted over all of it."""

    def __init__(self):
        self.places: list[tuple[int, int]] = []
        self.parts: list[Value] = []
        self.signs: Counter = Counter()
        self.placeholder = False

    def add_literal(self, text: str, place: tuple[int, int]) -> None:
        self.places.append(place)
        self.signs.update(text)
        self.placeholder = self.placeholder or bool(PLACEHOLDER.search(text))

    def add_value(self, other: Value) -> None:
        self.parts.append(other)
        for sign, n in other.signs.items():
            self.signs[sign] = min(MOST, self.signs[sign] + n)
        self.placeholder = self.placeholder or other.placeholder


def assigned_value(text: str, at: int, known: dict[str, Value]) -> Value | None:
    """The literals and known names after a sign, joined with `+`; None where there are none. A call is no literal."""
    value = Value()
    while part := PART.match(text, at):
        kind, at = part.lastgroup, part.end()
        literal = part.group(kind)
        if kind == "bare" and literal in known:
            value.add_value(known[literal])
        elif kind == "bare" and text.startswith("(", at):
            break
        elif literal:
            value.add_literal(literal, part.span(kind))
        joined = JOIN.match(text, at)
        if not joined:
            break
        at = joined.end()
    return value if value.places or value.parts else None


def named_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name. Each value is looked through once, by its best score."""
    known: dict[str, Value] = {}
    reported: list[tuple[float, int, Value]] = []
    before, last, colon = "", 0, False  # the name at the sign before, where that sign ended, and whether it was a colon
    for sign in SIGN.finditer(text):
        gap, last = text[last : sign.start()], sign.end()  # no part of a name is a sign
        if sign[0] not in ASSIGNS:
            before, colon = "", False
            continue
        name = name_before(gap)
        if sign[0] == "=":
            declared = DECLARED.search(gap)
            if colon and before and TYPE.fullmatch(gap):
                name = before
            elif declared:
                name = declared[1]
        before, colon = name, sign[0] == ":"
        value = assigned_value(text, sign.end(), known) if name else None
        if value is None:
            continue
        known[name] = value
        score = 0.0 if value.placeholder else name_score(name)
        if score and (score := score * value_score(value.signs)) >= THRESHOLD:
            reported.append((score, len(reported), value))
    spans, seen = [], set()
    for score, _, value in sorted(reported, key=lambda r: (-r[0], r[1])):
        waiting = [value]
        while waiting:
            value = waiting.pop()
            if id(value) not in seen:
                seen.add(id(value))
                spans += [Span(start, 3, end, score) for start, end in value.places]
                waiting += value.parts
    return spans


def scan_text(text: str | None) -> list[Span]:
    """All spans by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    named = named_spans(text) if "=" in text or ":" in text else []
    more = {s[:3]: s for s in named if not any(b.start <= s.start and s.end <= b.end for b in base)}
    return sorted(base + list(more.values()))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, score) of every row, by start, then kind as listed."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            found = [[(KINDS[s.kind], s.start, s.end, s.score) for s in scan_text(x.as_py())] for x in batch.column(1)]
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in row] for row in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>")
