"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score.

Kinds with a fixed pattern (``email``, ``ip``, ``card``, ``phone``) are always kept when their check holds. The method
adds ``iban`` (mod-97), ``short_card`` (13 to 15 digits, Luhn) and ``secret`` (16 and more letters and digits without order, by
their entropy), which are kept from a score of ``KEEP`` on: a secret needs a known prefix or a word nearby that names one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame

from duelbook.llm.common import chunks, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "short_card", "secret")
KEEP = 0.75
NEAR = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs and the look-behind only spare retries that cannot succeed; they change no match.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_/-])[A-Za-z0-9_-]{16,}+(?!/)")
PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|eyJ")  # how keys of known services begin
LEAST_BITS = 2.8  # a letter's entropy in a key; words and numbers with order have less
NOT_DIGIT = re.compile(r"[^0-9]+")

# Checked by a sum: 0.8; by form alone: 0.6. Words near a span raise or lower that.
START = {"email": 0.6, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "short_card": 0.6, "secret": 0.6, "known": 0.8}
HELPS = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "short_card": ("card", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    "secret": ("token", "password", "passwd", "pwd", "secret", "key", "apikey", "api_key", "access_key", "credential", "passwort", "clave", "auth", "bearer"),
}
HURTS = {
    "ip": ("version", "release", "section"), "card": ("isbn", "order", "serial"), "phone": ("isbn", "serial"),
    "iban": ("serial", "part"), "secret": ("sha", "sha1", "md5", "checksum", "commit", "digest"), "short_card": ("isbn", "order", "serial", "id"),
}
WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def without_order(text: str) -> bool:
    """Letters and digits mixed, with the entropy of a key."""
    if not (any(map(str.isdigit, text)) and any(map(str.isalpha, text))):
        return False
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) >= LEAST_BITS


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, @ and domain, found from each @ outwards so that long runs cost their length only."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def score(text: str, kind: str, start: int, end: int) -> float:
    near = set(WORD.findall(text[max(0, start - NEAR) : start].lower())) | set(WORD.findall(text[end : end + NEAR].lower()))
    value = START["known" if kind == "secret" and PREFIX.match(text, start) else kind] + 0.2 * (not near.isdisjoint(HELPS[kind])) - 0.2 * (not near.isdisjoint(HURTS.get(kind, ())))
    return min(1.0, max(0.0, value))


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` in code points, end exclusive, by kind as listed, then start."""
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small_part, m[0].split(".")))]
    short = []
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            (found if len(digits) >= 16 else short).append(("card" if len(digits) >= 16 else "short_card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    found += [("iban", *m.span()) for m in IBAN.finditer(text) if mod97(m[0].replace(" ", ""))]
    secrets = [("secret", *m.span()) for m in SECRET.finditer(text) if without_order(m[0])]
    scored = [(kind, a, b, round(score(text, kind, a, b), 2)) for kind, a, b in found + short + secrets]
    return [s for s in scored if s[0] in BASE or s[3] >= KEEP]


def joined(found) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in found)


def find_spans(docs: DataFrame) -> DataFrame:
    """For each row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, scores``.

    ``n_spans`` counts the spans of all kinds, secrets included; ``scores`` follows the order of ``spans``. A null text is empty and gives no spans; rows that repeat a doc_id are
    each reported; an empty table gives no rows.
    """

    def find(frames):
        for frame in chunks(frames):
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                found = spans(text) if isinstance(text, str) else []
                base = [s for s in found if s[0] in BASE]
                counts = [sum(s[0] == kind for s in base) for kind in BASE]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((doc, *counts, digest, joined(found), len(found), [s[3] for s in found]))
            out = pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "scores"])
            yield out.astype({"doc_id": "Int64"})

    return texts(docs).mapInPandas(
        find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, scores array<double>")
