"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

The base kinds are those of the contract: email, ip, card and phone, matched leftmost and non-overlapping per kind
over the whole text; a match that fails its check is dropped. The method adds iban (of its country's length, confirmed mod 97) and ssn
(three number groups with valid ranges). Every span has a score: the kind's own, raised when one of the kind's
context words stands within `near` characters before it, lowered for repeated-digit fillers. Base spans stay whatever
their score; an added span stays only with LEAST or more, so three number groups need a context word to be a ssn.

All offsets are code points, ends exclusive. Matching is linear in the text: e-mail addresses are looked for
around each @, digit runs are entered at their first digit only.

Defined cases: a null or empty text has no spans; a null id stays null; repeated rows are searched each; an empty
table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, batch

SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
# The base patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# The length of a country's numbers.
LENGTHS = """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18
FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20
LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31
SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20
"""
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.6}
LEAST = 0.65
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account"),
    "ssn": ("ssn", "social", "security"),
}


def _of_length(n: int) -> re.Pattern:
    """A number of n characters in groups of four, each with or without a blank before it."""
    groups, rest = divmod(n - 4, 4)
    tail = f"(?:[ ]?[A-Z0-9]{{{rest}}})" if rest else ""
    return re.compile(f"[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{{groups}}}{tail}(?![A-Za-z0-9])")


SHAPES = {x[:2]: _of_length(int(x[2:])) for x in LENGTHS.split()}


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        if at > free and LOCAL.match(text, at - 1) and (m := DOMAIN.match(text, at)):
            start = at - 1
            while start > free and LOCAL.match(text, start - 1):
                start -= 1
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers of their country's length, so a word in capitals after them is no part; of countries not listed, as far as the groups go."""
    free = 0
    for m in HEAD.finditer(text):
        if m.start() >= free and (x := SHAPES.get(m.group()[:2], IBAN).match(text, m.start())) and mod97(x.group()):
            yield x.span()
            free = x.end()


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of confirmed spans, by kind as listed, then by start."""
    if "@" in text:
        for s, e in emails(text):
            yield "email", s, e
    for m in IP.finditer(text):
        if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m.group().split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield "phone", *m.span()
    for s, e in ibans(text):
        yield "iban", s, e
    if "-" in text:
        for m in SSN.finditer(text):
            a, b, c = m.groups()
            if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
                yield "ssn", *m.span()


def score(text: str, kind: str, start: int, end: int, near: int) -> float:
    before = text[max(0, start - near) : start].lower()
    value = SCORE[kind] + 0.1 * any(w in before for w in CONTEXT[kind])
    digits = [c for c in text[start:end] if c.isdigit()]
    return round(value - 0.4 * (kind != "email" and len(set(digits)) == 1), 3)


def spans(text: str | None, near: int = 40) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of base spans and of added ones with enough score."""
    found = [(k, s, e, score(text, k, s, e, near)) for k, s, e in candidates(text)] if text else []
    return [x for x in found if x[0] in BASE or x[3] >= LEAST]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = 40) -> DataFrame:
    """doc_id and its spans, ordered by kind as listed, then by start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in spans(t, near)] for t in b.column(1).to_pylist()]
            yield batch(["doc_id", "spans"], b.column(0).cast(pa.int64()), pa.array(found, kind))

    return arrow_map(docs, [id_col, text_col], run, SCHEMA)


def masked(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the earliest, then the longest."""
    out, at = [], 0
    for kind, s, e, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
        else:  # the part beyond an earlier span goes too
            at = max(at, e)
    return "".join([*out, text[at:]])
