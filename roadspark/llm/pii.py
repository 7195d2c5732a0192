"""Personal data: patterns propose spans, validators confirm them, nearby words adjust the score, and the score decides.

Every pattern is scanned in linear time: runs of characters are taken whole (possessive quantifiers) and a run is entered
at its start alone, which leaves the leftmost matches as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.llm.common import count_kind, span_text

# The patterns that propose spans. An e-mail address is found from its "@".
LOCAL = r"[A-Za-z0-9._%+-]++"
DOMAIN = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# Words that make a kind likelier, or less likely, when they stand shortly before the span.
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "@"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
AGAINST = {"email": ("example",), "ip": ("version", "release"), "card": ("order", "serial"), "phone": ("order", "serial"), "iban": (), "ssn": ("order", "serial")}
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
FOR, LESS = 0.2, 0.1
LEAST_SCORE = 0.5  # base kinds start above it by more than LESS, so words nearby never drop a confirmed base span
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
CONTEXT_CHARS = 40

DIGIT = re.compile("[0-9]")
SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def _card(s: str) -> bool:
    return 13 <= len(s) - s.count(" ") - s.count("-") <= 19 and luhn(_digits(s))


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


_LOCAL, _DOMAIN = re.compile(LOCAL), re.compile(DOMAIN)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The spans of addresses: the run before each "@", as far as no span before has it, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        if (domain := _DOMAIN.match(text, at + 1)) and at > done:
            size = 64
            while True:
                back = text[max(done, at - size) : at][::-1]
                run = _LOCAL.match(back)
                if run is None or run.end() < len(back) or at - size <= done:
                    break
                size *= 2
            if run is not None:
                yield at - run.end(), domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def _matches(pattern: str):
    return lambda text, scan=re.compile(pattern).finditer: (m.span() for m in scan(text))


#: kind, scan, validator, what must occur for the scan to be worth it
RULES = (
    ("email", emails, lambda s: True, "@"),
    ("ip", _matches(IP), lambda s: all(map(_part, s.split("."))), "."),
    ("card", _matches(CARD), _card, ""),
    ("phone", _matches(PHONE), lambda s: 9 <= len(_digits(s)) <= 15, "+"),
    ("iban", _matches(IBAN), lambda s: mod97(s.replace(" ", "")), ""),
    ("ssn", _matches(SSN), lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000", "-"),
)


def spans_of(text: str) -> list[tuple]:
    """All confirmed spans of LEAST_SCORE or more, by kind, then start. Offsets are code points, the end is exclusive."""
    found: list[tuple] = []
    has_digit = DIGIT.search(text) is not None
    for kind, scan, valid, needs in RULES:
        if (kind != "email" and not has_digit) or (needs and needs not in text):
            continue
        for start, end in scan(text):
            value = text[start:end]
            if valid(value):
                before = text[max(0, start - CONTEXT_CHARS) : start].lower()
                score = BASE_SCORE[kind] + FOR * any(w in before for w in CONTEXT[kind]) - LESS * any(w in before for w in AGAINST[kind])
                if (score := round(min(1.0, score), 2)) >= LEAST_SCORE:
                    found.append((kind, start, end, value, score))
    return found


_OUT = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("score", pa.float64())])))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("kind", "start", "end", "value", "score")
    for batch in batches:
        rows = [[dict(zip(names, s, strict=True)) for s in spans_of(t or "")] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _OUT.field(1).type)], schema=_OUT)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans(kind, start, end, value, score), one row per row of docs.

    A span's score starts with its kind and goes up or down with the words before it; below LEAST_SCORE it is dropped.
    Null and empty texts have no spans; null ids, repeated rows and other columns change nothing (only the id and the
    text are read); an empty table gives an empty table. Spans of different kinds may overlap: each is listed.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, SCHEMA)


def pii_digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
