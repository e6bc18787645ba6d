"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues in one pass; at each anchor
a small deterministic parser expands the match to its bounds and validates it. The base kinds (email, ip, card, phone)
are leftmost and don't overlap within a kind; a match that fails its validation is dropped and not tried again from
inside. The cues, in upper or lower case, add account numbers (iban and ssn by their own rules; account: 8 to 17 digits,
not one digit repeated) and links with user names (url).

Null texts count as empty. Equal texts have equal spans. Offsets are code points, ends exclusive. Only the id and text
columns are read."""
from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, map_documents

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account", "url")
BASE = 4
#: The patterns that bound the base kinds, and the cues of the others.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account"}
AFTER = {
    "iban": re.compile(r"(?:\s*(?:no|number|nr)\.?)?[\s:#=]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.IGNORECASE),
    "ssn": re.compile(r"(?:\s*(?:no|number)\.?)?[\s:#=]*([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])", re.IGNORECASE),
    "account": re.compile(r"(?:\s*(?:no|number|nr)\.?)?[\s:#=]*([0-9](?:[\x20-]?[0-9]){7,16})(?![0-9])", re.IGNORECASE),
}
LINK = re.compile(r"://([^\s/?#@:]+)(?::[^\s/?#@]*)?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DIGITS = frozenset("0123456789")
_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for c in "@+0123456789":
            a.add_word(c, (c, 1))
        a.add_word("://", ("://", 3))
        for cue, kind in CUES.items():
            a.add_word(cue, (kind, len(cue)))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def lowered(text: str) -> str:
    """The text in lower case, at its own length: the few letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _good(kind: str, value: str) -> bool:
    if kind == "iban":
        return iban_ok(value)
    if kind == "ssn":
        return value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000"
    return len(set(_digits(value))) > 1  # an account number isn't one digit repeated


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """Spans (start, number of the kind, end) in order."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    ended = dict.fromkeys(KINDS, 0)
    for last, (anchor, size) in _automaton().iter(lowered(text)):
        at = last - size + 1
        if anchor == "@":
            start = at
            while start > ended["email"] and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                found.append((start, 0, m.end()))
                ended["email"] = m.end()
        elif anchor == "+":
            if at >= ended["phone"] and (m := PHONE.match(text, at)):
                ended["phone"] = m.end()
                if 10 <= len(_digits(m.group())) <= 15:
                    found.append((at, 3, m.end()))
        elif anchor in DIGITS:
            if at and text[at - 1] in DIGITS:
                continue
            if at >= ended["ip"] and (m := IP.match(text, at)):
                ended["ip"] = m.end()
                if all(len(x) <= 3 and int(x) <= 255 for x in (x.lstrip("0") or "0" for x in m.group().split("."))):
                    found.append((at, 1, m.end()))
            if at >= ended["card"] and (m := CARD.match(text, at)):
                ended["card"] = m.end()
                digits = _digits(m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, 2, m.end()))
        elif anchor == "://":
            start = at
            while start > ended["url"] and text[start - 1] in SCHEME:
                start -= 1
            if start < at and at >= ended["url"] and (m := LINK.match(text, at)):
                ended["url"] = m.end()
                found.append((start, 7, m.end()))
        elif (at == 0 or not text[at - 1].isalnum()) and last + 1 >= ended[anchor] and (m := AFTER[anchor].match(text, last + 1)):
            value = m.group(1)
            if _good(anchor, value):
                ended[anchor] = m.end(1)
                found.append((m.start(1), KINDS.index(anchor), m.end(1)))
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(block: pa.RecordBatch) -> dict:
        out: dict = {doc_id: block.column(0), **{f"n_{k}": [] for k in KINDS[:BASE]}, "base_sha256": [], "spans": []}
        for t in block.column(1).to_pylist():
            spans = scan(t)
            for n, k in enumerate(KINDS[:BASE]):
                out[f"n_{k}"].append(sum(s[1] == n for s in spans))
            out["base_sha256"].append(hashlib.sha256(written([s for s in spans if s[1] < BASE]).encode()).hexdigest())
            out["spans"].append(written(spans))
        return out
    return map_documents(documents(docs, doc_id, text), text, f"`{doc_id}` {kind}, {', '.join(f'n_{k} long' for k in KINDS[:BASE])}, base_sha256 string, spans string", run)
