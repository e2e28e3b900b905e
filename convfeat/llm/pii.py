"""Personal data by patterns that propose spans, validators that confirm them and nearby words.

Four base kinds (email, ip, card, phone) follow fixed patterns; a card number must pass the Luhn test.
Two further kinds are added: an IBAN of its country's length that passes the mod-97 test, and a US
social security number that a nearby word announces. Each span has a score: that of its pattern, plus
what a passed checksum and a context word in the 48 characters before or 24 after it add. Base spans
stay whatever their score; added ones need ``LEAST_SCORE``.

Searches are linear in the text: an email is found from its ``@``, and an address only from the first
digit of a run. Cases: a null or empty text has no spans. Rows with equal ids are rows of their own.
Extra columns pass through untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convfeat.llm.common import as_row, map_texts, per_row, row_schema, text_bytes, text_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
LEAST_SCORE = 0.6

#: Score of a pattern, and words that raise it.
PATTERN_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.5, "iban": 0.3, "ssn": 0.4}
CHECKSUM_SCORE = {"card": 0.4, "iban": 0.5}
CONTEXT_SCORE = 0.3
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "visa", "mastercard", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
#: Length of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# after a run's first digit failed, its later digits fail as well, so only the first is tried
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# at most 34 characters: a candidate costs bounded work wherever the search resumes
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_CONTEXT = {kind: re.compile(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])") for kind, words in CONTEXT.items()}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float = 0.0


def luhn(number: str) -> bool:
    """Luhn test over the digits of ``number``."""
    digits = [ord(c) - 48 for c in number if "0" <= c <= "9"]
    total = sum(digits[-1::-2]) + sum(d * 2 - 9 * (d > 4) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 test of an IBAN without blanks."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if 12 <= sum(m[0].count(d) for d in "0123456789") <= 19 and luhn(m[0]):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum(m[0].count(d) for d in "0123456789") <= 15:
            yield m.span()


def _ibans(text: str):
    """Candidates cut at their country's length; after a failed one the search resumes at its next character."""
    m = _IBAN.search(text)
    while m:
        left, end = IBAN_LENGTH.get(m[0][:2], 0), m.start()
        while left and end < m.end():
            left -= text[end] != " "
            end += 1
        follows = text[end : end + 1]
        if not left and end > m.start() and not (follows.isascii() and follows.isalnum()) and mod97(text[m.start() : end].replace(" ", "")):
            yield m.start(), end
            m = _IBAN.search(text, end)
        else:
            m = _IBAN.search(text, m.start() + 1)


def _ssns(text: str):
    return (m.span() for m in _SSN.finditer(text))


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - 48) : start]} {text[end : end + 24]}".lower()
    told = CONTEXT_SCORE if _CONTEXT[kind].search(near) else 0.0
    return min(1.0, PATTERN_SCORE[kind] + CHECKSUM_SCORE.get(kind, 0.0) + told)


def find(text: str, digits: bool = True) -> list[Span]:
    """All spans by start, then kind. ``digits`` tells that the text has any."""
    kinds = [k for k in KINDS if digits and (k != "phone" or "+" in text) and k != "email"]
    found = []
    for kind in (["email"] if "@" in text else []) + kinds:
        for start, end in FINDERS[kind](text):
            span = Span(kind, start, end, score(text, kind, start, end))
            if kind in BASE or span.score >= LEAST_SCORE:
                found.append(span)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _find_all(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = text_of(batch)
    data, offsets = text_bytes(texts)
    digits = per_row((data >= 48) & (data <= 57), offsets).tolist()
    found = [find(text or "", n > 0) for text, n in zip(texts.to_pylist(), digits)]
    spans = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in x] for x in found]
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    counts = [pa.array([sum(s.kind == k for s in x) for x in found], pa.int64()) for k in BASE]
    base = [hashlib.sha256(listed([s for s in x if s.kind in BASE]).encode()).hexdigest() for x in found]
    return pa.RecordBatch.from_arrays(
        [batch.column("row"), pa.array(spans, pa.list_(kind)), *counts, pa.array(base, pa.string()), pa.array(map(listed, found), pa.string())],
        names=["row", "found", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
    )


def personal_data(documents: DataFrame) -> DataFrame:
    """``row`` (all columns), ``found`` (kind, start, end, score), counts of base kinds, ``base_sha256``, ``spans``."""
    rows = as_row(documents)
    fields = "found array<struct<kind:string,start:long,end:long,score:double>>, "
    fields += ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return map_texts(rows, _find_all, row_schema(rows, fields))


def span_digests(documents: DataFrame) -> DataFrame:
    """Per document the counts, the hash of base spans and the list of all spans."""
    out = personal_data(documents.select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), *(f"n_{k}" for k in BASE), "base_sha256", "spans")
