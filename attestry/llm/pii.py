"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over the whole text once and finds the anchors: at-signs, `://`, a plus before a digit, two
digits with at most one separator between them, and words that announce an account. At each anchor a small deterministic parser
expands the boundaries to both sides and validates what it has found. Every match of the base patterns contains an anchor, so
the base spans are those of a leftmost, non-overlapping search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from attestry.llm.common import prepare, pylist_batches, texts

BASE_KINDS = ("email", "ip", "card", "phone")
# Spans that the method adds: addresses with user data in them, accounts announced by a word.
EXTRA_KINDS = ("uri", "account")
CUES = ("iban", "account", "acct", "ssn")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USERINFO = re.compile(r"[^\s/?#@\"'<>]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?")
ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|nr\.?|code))?\x20{0,3}[:=#]?\x20{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8,17})(?![A-Za-z0-9])", re.ASCII)

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def anchors():
    """The automaton: anchor text -> (kind, length)."""
    import ahocorasick

    found: dict[str, list[str]] = {"@": ["email"], "://": ["uri"]}
    for a in "0123456789":
        found[f"+{a}"] = ["phone"]
        for b in "0123456789":
            found[f"{a}.{b}"] = ["ip"]
            for sep in ("", " ", "-"):
                found[f"{a}{sep}{b}"] = ["card"]
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            found[form] = ["account"]
    automaton = ahocorasick.Automaton()
    for text, kinds in found.items():
        automaton.add_word(text, (kinds[0], len(text)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def iban(text: str) -> bool:
    """The check of ISO 13616: letters as numbers from 10, first four signs last, remainder 1 by 97."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _left(text: str, at: int, allowed: frozenset, stop: int) -> int:
    while at > stop and text[at - 1] in allowed:
        at -= 1
    return at


def _email(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    start = _left(text, at, LOCAL, done)
    found = start < at and DOMAIN.match(text, at + 1)
    return (start, found.end(), True) if found else None


def _ip(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    found = IP.match(text, _left(text, at, DIGITS, done))
    if not found:
        return None
    parts = [p.lstrip("0") for p in found[0].split(".")]
    return found.start(), found.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _card(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    found = CARD.match(text, at)
    digits = found[0].replace(" ", "").replace("-", "")
    return found.start(), found.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    found = PHONE.match(text, at)
    return (found.start(), found.end(), 8 <= sum(c in DIGITS for c in found[0]) <= 15) if found else None


def _uri(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    start = _left(text, at, SCHEME, done)
    while start < at and not text[start].isalpha():
        start += 1
    found = start < at and USERINFO.match(text, at + 3)
    return (start, found.end(), True) if found else None


def _account(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    cue = next(c for c in CUES if text[at : at + len(c)].lower() == c)
    if at and text[at - 1].isalnum():
        return None
    found = ACCOUNT.match(text, at + len(cue))
    if not found:
        return None
    value = found[1].replace(" ", "")
    good = iban(value) if value[0].isalpha() else value[:3] not in ("000", "666") and value[0] != "9" if "-" in value else cue != "ssn"
    return found.start(1), found.end(1), good


PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "uri": _uri, "account": _account}


def spans(text: str, automaton) -> dict[str, list[tuple[int, int]]]:
    """Kind -> spans in code points, end exclusive, in order."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in PARSERS}
    done = dict.fromkeys(PARSERS, 0)
    for end, (kind, length) in automaton.iter(text):
        at = end - length + 1
        if at < done[kind]:
            continue
        got = PARSERS[kind](text, at, done[kind])
        if got:
            done[kind] = got[1]
            if got[2]:
                found[kind].append(got[:2])
    return found


def _joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = anchors()
    for ids, bodies in pylist_batches(batches, "doc_id", "text"):
        out = [spans(t, automaton) for t in bodies]
        base = [_joined(f, BASE_KINDS) for f in out]
        columns = [pa.array(ids, pa.int64()), *(pa.array([len(f[k]) for f in out], pa.int64()) for k in BASE_KINDS)]
        columns += [pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array([_joined(f, BASE_KINDS + EXTRA_KINDS) for f in out])]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row for each input row, no shuffle.

    Null text counts as empty: no spans, the digest of the empty string. A null or repeated id is carried as it is. An empty
    table gives an empty result; of extra columns none is read.
    """
    prepare(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(_rows, SCHEMA)
