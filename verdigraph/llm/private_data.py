"""Operator 8: personal data by pattern, checksum and context.

Regular expressions propose spans, validators (Luhn, mod-97, number ranges, digit counts, the
variety of a secret's characters) confirm them, and words in the 48 characters before and
after move a span's score. The four base kinds stay whatever their context; iban, ssn and
secret are added by the method, and stay when their score reaches the threshold: a valid
mod-97 is enough for an iban, while the digits of an ssn need a word that speaks of it. An
iban ends at its country's length; of other countries' at the last group with which mod-97
holds. A secret is a value assigned to a name such as token or password.

Defined results: a null or empty text has no spans; a null doc_id and repeated rows give a
row each; other columns are never read. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
THRESHOLD = 0.5
AROUND = 48

# The base patterns as the contract states them.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches: a run of digits that fails from its beginning fails from each later digit, so one try a run is enough.
_IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
_SECRET = re.compile(r"(?i:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|credential)s?[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?(?P<value>[A-Za-z0-9+/_.=~-]{12,})")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")

# The length of each country's account numbers.
_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SV": 28, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

# Words that speak for a kind, and words that speak against personal data.
_FOR = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "client"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("bearer", "authorization", "aws", "github", "login", "key"),
}
_AGAINST = ("example", "sample", "test", "dummy", "order", "version", "serial", "isbn")
_FIRST = {"email": 0.7, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.8, "ssn": 0.3, "secret": 0.6}
_WORD = re.compile(r"[a-z-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    text = iban.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    return True


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers among the matches of _IBAN: each as far as its country's length, else as far as mod-97 holds."""
    for m in _IBAN.finditer(text):
        s, length = m.group(), _LENGTHS.get(m.group()[:2])
        ends = [k for k in range(len(s), 0, -1) if k == len(s) or s[k] == " "]  # after the last group, the one before it ...
        for k in ends:
            if (length is None or len(s[:k].replace(" ", "")) == length) and mod97(s[:k]):
                yield m.start(), m.start() + k
                break


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values assigned to a name that speaks of a secret: letters and digits, and not a few of them over and over."""
    for m in _SECRET.finditer(text):
        value = m.group("value").rstrip(".=")
        different = len(set(value))
        if len(value) >= 12 and different >= 8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            yield m.start("value"), m.start("value") + len(value)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of _EMAIL. A match's part before the @ is the run that ends there, so each search begins at such a run."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = set(_WORD.findall((text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]).lower()))
    score = _FIRST[kind] + 0.3 * any(w in near for w in _FOR[kind]) - 0.3 * any(w in near for w in _AGAINST)
    return min(1.0, max(0.0, score))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as in KINDS and then by start."""
    if not text:
        return []
    proposed: list[tuple[str, int, int]] = []
    if "@" in text:
        proposed += [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP_RUNS), ("card", _CARD), ("phone", _PHONE)):
            if kind == "phone" and "+" not in text:
                continue
            proposed += [(kind, *m.span()) for m in pattern.finditer(text) if _valid(kind, m.group())]
        proposed += [("iban", *s) for s in _ibans(text)]
        proposed += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        proposed += [("secret", *s) for s in _secrets(text)]
    scored = [(k, a, b, _score(k, text, a, b)) for k, a, b in proposed]
    return [x for x in scored if x[0] in BASE or x[3] >= THRESHOLD]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and its spans: array<struct<kind, start, end, score>>, for every row of docs (doc_id, text)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, found, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the spans as text, their scores in the same order, and how many there are."""
    text = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", *counts, F.sha2(text(lambda s: s["kind"].isin(*BASE)), 256).alias("base_sha256"), text(lambda s: F.lit(True)).alias("spans"), scores.alias("scores"), F.size("spans").cast("long").alias("n_spans"))


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b, _ in sorted(find_spans(text), key=lambda s: s[1:3]):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])

