"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs, digits, URL schemes and identifier cues.
A deterministic parser for the anchor's kind expands around it, sets the boundaries and validates what it found.

Base kinds are email, ip, card and phone. The method adds: url (a scheme with user data before the host), iban (a cue
and a number whose check digits hold), ssn (a cue and nnn-nn-nnnn) and account (a cue and 6 to 20 digits).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.common import steps, tidy

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "ssn", "account")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}

#: Identifier cues (fixed values), each also with a capital and in capitals.
CUES = {
    "iban": "iban",
    "ssn": "ssn",
    "social security": "ssn",
    "account no": "account",
    "account number": "account",
    "acct": "account",
    "passport no": "account",
    "passport number": "account",
    "customer id": "account",
}
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
USER_URL = re.compile(r"[A-Za-z]+://[A-Za-z0-9._~%+-]+(?::[^\s@/]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
IBAN = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
SSN = re.compile(r"[ :#]{0,3}(?:no\.?|number)?[ :#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
ACCOUNT = re.compile(r"\.?[ :#]{0,3}([0-9](?:[ -]?[0-9]){5,19})(?![0-9A-Za-z])")
DIGITS = "0123456789"


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in DIGITS:
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for s in SCHEMES:
        found.add_word(s, ("scheme", len(s)))
    for cue, kind in CUES.items():
        for form in (cue, cue.capitalize(), cue.title(), cue.upper()):
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def ascii_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every finding, in order; code points, end exclusive."""
    out: list[tuple[int, str, int]] = []
    #: Where the last match of each base kind ends, whether it was valid or not: matches of one kind don't overlap.
    past = dict.fromkeys((*BASE, *ADDED), 0)
    for last, (anchor, size) in anchors().iter(text):
        at = last - size + 1
        if anchor == "digit":
            if at and text[at - 1] in DIGITS and at > past["ip"] and at > past["card"]:
                continue  # inside a run whose first digit was tried
            if at >= past["ip"] and (m := IP.match(text, at)):
                past["ip"] = m.end()
                parts = (p.lstrip("0") for p in m[0].split("."))  # of any length: leading zeros don't count
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                    out.append((at, "ip", m.end()))
            if at >= past["card"] and (m := CARD.match(text, at)):
                past["card"] = m.end()
                digits = ascii_digits(m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, "card", m.end()))
        elif anchor == "at":
            start = at
            while start > past["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                past["email"] = m.end()
                out.append((start, "email", m.end()))
        elif anchor == "plus":
            if at >= past["phone"] and (m := PHONE.match(text, at)):
                past["phone"] = m.end()
                if 10 <= len(ascii_digits(m[0])) <= 15:
                    out.append((at, "phone", m.end()))
        elif at and text[at - 1].isalnum():
            continue  # a cue or scheme begins a word
        elif anchor == "scheme":
            if at >= past["url"] and (m := USER_URL.match(text, at)):
                past["url"] = m.end()
                out.append((at, "url", m.end()))
        else:
            pattern = {"iban": IBAN, "ssn": SSN, "account": ACCOUNT}[anchor]
            if (m := pattern.match(text, last + 1)) and m.start(1) >= past[anchor] and (anchor != "iban" or iban_holds(m[1])):
                past[anchor] = m.end(1)
                out.append((m.start(1), anchor, m.end(1)))
    out.sort(key=lambda s: (s[0], ORDER[s[1]], s[2]))
    return out


def joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in found)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added. No shuffle.

    A null or empty text has no findings and the hash of an empty string. A null doc_id stays null. A very long text is
    read whole, as a step of its own, and so are numbers of any length in it. Findings of one kind that begin at the same
    place can't tie; of different kinds, the order of kinds decides. Repeated rows have a row each; an empty table has none.
    Other columns are not read, so clashing names do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                counts: list[list[int]] = [[] for _ in range(5)]
                digests, every = [], []
                for text in part.column("text").to_pylist():
                    found = spans(text) if text else []
                    base = [s for s in found if s[1] in BASE]
                    for k, kind in enumerate(BASE):
                        counts[k].append(sum(s[1] == kind for s in base))
                    counts[4].append(len(found) - len(base))
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    every.append(joined(found))
                longs = [pa.array(c, pa.int64()) for c in counts]
                columns = [part.column("doc_id"), *longs[:4], pa.array(digests, pa.string()), pa.array(every, pa.string()), longs[4]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with every finding replaced by its kind in brackets. A null text stays null; of findings
    that overlap, the first to begin gives the name and all are covered."""

    def masked(text: str | None) -> str | None:
        if not text:
            return text
        out, past = [], 0
        for start, kind, end in spans(text):
            if start >= past:
                out += [text[past:start], f"[{kind}]"]
            past = max(past, end)
        return "".join([*out, text[past:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                texts = pa.array(map(masked, part.column("text").to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts], ["doc_id", "text"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(tidy(run), rows.schema)
