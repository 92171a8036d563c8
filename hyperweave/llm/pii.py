"""PII (5): patterns propose spans, checksums confirm them, context words adjust a score.

Four base kinds (email, ip, card, phone) are reported whenever pattern and check hold; their score
is informative. Further kinds (iban, idnum, localphone) are reported only from ``threshold`` on:
an IBAN needs its mod-97 check, the others need a context word nearby. Every scan is linear in
the text: e-mail scans start at an @ and walk left once, digit scans start where a run of digits
starts.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, own, table, utf8_rows

KINDS = ("email", "ip", "card", "phone", "iban", "idnum", "localphone")
BASE = KINDS[:4]
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_IDNUM = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCALPHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
#: Score of a confirmed match without context, and words that add to it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "idnum": 0.3, "localphone": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "idnum": ("ssn", "social", "security", "tax"),
    "localphone": ("phone", "call", "tel", "mobile", "fax"),
}
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_part(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def ibans(text: str):
    """Spans of the longest reading of each candidate that holds: 15 to 34 characters that end at a word boundary."""
    at = 0
    while m := _IBAN.search(text, at):
        start, at = m.start(), m.start() + 1
        for end in range(m.end(), start + 14, -1):
            if text[end - 1] == " " or text[end : end + 1].isascii() and text[end : end + 1].isalnum():
                continue
            plain = text[start:end].replace(" ", "")
            if len(plain) >= 15 and mod97(plain):
                yield start, end
                at = end
                break


def candidates(text: str):
    """(kind, start, end) whose check holds."""
    for start, end in emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(map(small_part, m.groups())):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            yield "phone", *m.span()
    yield from (("iban", *span) for span in ibans(text))
    for kind, pattern in (("idnum", _IDNUM), ("localphone", _LOCALPHONE)):
        for m in pattern.finditer(text):
            yield kind, *m.span()


def score(text: str, kind: str, start: int, end: int, window: int = 40) -> float:
    """The kind's prior plus 0.4 if one of its context words is nearby, at most 1."""
    near = set(_WORD.findall((text[max(0, start - window) : start] + " " + text[end : end + window]).lower()))
    return min(1.0, PRIOR[kind] + 0.4 * any(w in near for w in CONTEXT[kind]))


def spans_of(text: str, threshold: float = 0.6) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; code points, end exclusive."""
    found = []
    for kind, start, end in candidates(text):
        points = score(text, kind, start, end)
        if kind in BASE or points >= threshold:
            found.append((kind, start, end, points))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def find_pii(df: DataFrame, text: str = "text", out: str = "pii", threshold: float = 0.6) -> DataFrame:
    """Add array ``out`` of struct(kind, start, end, score).

    Null and empty texts give an empty array; repeated rows give equal arrays; spans of different
    kinds may overlap and tie on start (then in the order of KINDS); other columns pass through; an
    empty table stays empty. A very long text is read whole, in a few times its size of memory.
    """

    @F.arrow_udf("array<struct<kind: string, start: long, end: long, score: double>>")
    def spans(batch: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        rows = ((t or b"").decode("utf-8", "replace") for t in utf8_rows(batch))
        return pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t, threshold)] for t in rows], kind)

    return df.withColumn(free_name(df, out), spans.asNondeterministic()(own(df, text)))


def redact(text: str, spans) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first one's kind."""
    parts, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            parts += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join(parts) + text[done:]


def joined(spans, kinds=KINDS):
    """kind:start:end of a span array column, comma-joined."""
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii(spark, sf_dir):
    docs = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("pii"), BASE), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def digest(text: str) -> str:
    """SHA-256 of the base spans of a text (for tests)."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans_of(text) if k in BASE).encode()).hexdigest()
