r"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Base kinds: email, ip, card (Luhn), phone. The method adds IBANs (mod-97) and, where context words make them likely,
national identity numbers. Spans count code points, end exclusive. A base span is reported whatever its score.

Defined cases: a null or empty text has no spans; texts of any length are searched in linear time; overlapping kinds
are all reported; null or repeated ids each keep a row; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id")
SPANS = "array<struct<kind:int,start:int,end:int,score:double>>"
WINDOW = 48
THRESHOLD = 0.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})")
_IBAN_TOKEN = re.compile(r" ?([A-Z0-9]+)")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Lengths of the IBAN registry; other codes are tried at every length.
IBAN_LENGTH = {
    code: int(n)
    for n, codes in (
        x.split(":")
        for x in (
            "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
            "23:AE,GI,IL,IQ,OM,TL,SO 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
            "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for code in codes.split(",")
}

#: Score without context, and words that raise it.
PRIOR = (0.9, 0.6, 0.8, 0.6, 0.9, 0.3)
CONTEXT = tuple(
    re.compile(rf"\b(?:{x})\b", re.I)
    for x in (
        "e-?mail|mail|contact|courriel|correo|kontakt",
        "ip|address|host|server|client|login|adresse",
        "card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta|payment",
        "phone|tel|telephone|mobile|call|fax|telefon|téléphone|teléfono",
        "iban|bank|account|konto|compte|cuenta",
        "ssn|social security|identity|national id|passport|ausweis|dni",
    )
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An @ whose domain fits is taken with the run of local characters before it, back to the last span's end."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at:
            yield start, m.end()
            last = m.end()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start the end of a token where the country's length is reached, of other codes the last that passes."""
    last = 0
    for m in _IBAN.finditer(text):
        if m.start() < last:
            continue
        length, at, value, found = IBAN_LENGTH.get(m[0][:2]), m.end(), m[0], 0
        while len(value) < 34 and (t := _IBAN_TOKEN.match(text, at, at + 36 - len(value))):
            at, value = t.end(), value + t[1]
            whole = not (text[at : at + 1].isascii() and (text[at : at + 1].isdigit() or text[at : at + 1].isupper()))
            if whole and 15 <= len(value) <= 34 and length in (None, len(value)) and mod97(value):
                found = at
        if found:
            yield m.start(), found
            last = found


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """Confirmed (kind, start, end), by kind and start."""
    if "@" in text:
        yield from ((0, a, b) for a, b in emails(text))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
                yield 1, m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield 2, m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield 3, m.start(), m.end()
    yield from ((4, a, b) for a, b in ibans(text))
    if "-" in text:
        for m in _ID.finditer(text):
            yield 5, m.start(), m.end()


def find(text: str | None) -> list[tuple[int, int, int, float]]:
    out = []
    for kind, a, b in proposals(text or ""):
        near = text[max(0, a - WINDOW) : a] + " " + text[b : b + WINDOW // 2]
        score = min(1.0, PRIOR[kind] + 0.3 * bool(CONTEXT[kind].search(near)))
        if kind < len(BASE) or score >= THRESHOLD:
            out.append((kind, a, b, score))
    return out


def spans_of(text: Column) -> Column:
    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "score"), x)) for x in find(t)] for t in batch], dtype=object)

    return run(text)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id and ``pii``, an array of (kind, start, end, score); kind indexes ``KINDS``."""
    return docs.select(F.col(id_col), spans_of(F.col(text_col)).alias("pii"))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def op5(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)
    n = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("pii", lambda x: x["kind"] < len(BASE))
    return found.select("doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
