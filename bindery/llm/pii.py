"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, schemes, digit neighbourhoods and cue
words); a small deterministic parser for each kind expands an anchor to its borders and
validates it. Every parser runs in time linear in what it reads, and never reads behind the
end of the match before it, so a text is processed in linear time.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are leftmost matches of fixed patterns, taken
without overlap inside a kind, and dropped (not retried) when validation fails. Kinds
``url``, ``iban``, ``account`` and ``secret`` are found behind schemes and cues only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from bindery.llm.shared import bounded_batches, documents, per_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret")

# Fixed patterns of the base kinds, each to be applied at an anchor.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")

_URL = re.compile(r"[^\s\"'<>]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_CUE_NUMBER = re.compile(r"[\s:#=.]{0,4}(?:no|nr|number)?[\s:#=.]{0,4}([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])")
_CUE_SECRET = re.compile(r"[\s\"']{0,3}[:=][\s\"']{0,3}([A-Za-z0-9+/_=.-]{8,})")
_SCHEMES = ("http", "https", "ftp", "ftps", "ssh", "postgres", "mysql", "mongodb")
_NUMBER_CUES = ("account", "acct", "ssn", "passport", "konto", "compte", "cuenta")
_SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban_sound(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def anchors() -> ahocorasick.Automaton:
    """Keys with what they announce; lengths give back where an anchor begins."""
    cues: dict[str, tuple[str, int]] = {"@": ("email", 1), "://": ("url", 3), "IBAN": ("iban", 4)}
    for d in "0123456789":
        cues["+" + d] = ("phone", 2)
        cues[d + "."] = ("ip", 2)
        for e in "0123456789":
            for between in ("", " ", "-"):
                cues[d + between + e] = ("card", 2 + len(between))
    for kind, words in (("account", _NUMBER_CUES), ("secret", _SECRET_CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                cues[form] = (kind, len(form))
    found = ahocorasick.Automaton()
    for key, value in cues.items():
        found.add_word(key, value)
    found.make_automaton()
    return found


def _left(text: str, at: int, stop: int, allowed: frozenset) -> int:
    while at > stop and text[at - 1] in allowed:
        at -= 1
    return at


def _email(text: str, begin: int, end: int, stop: int):
    start = _left(text, begin, stop, _LOCAL)
    domain = _DOMAIN.match(text, end) if start < begin else None
    return (start, domain.end(), True) if domain else None


def _ip(text: str, begin: int, end: int, stop: int):
    start = _left(text, begin, stop, _DIGITS)
    found = _IP.match(text, start)
    if not found:
        return None
    # a part of over three digits may still be at most 255: leading zeros
    parts = (p.lstrip("0") for p in found.group().split("."))
    return start, found.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _card(text: str, begin: int, end: int, stop: int):
    found = _CARD.match(text, begin)
    digits = found.group().replace(" ", "").replace("-", "") if found.end() - begin < 64 else ""
    return begin, found.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, begin: int, end: int, stop: int):
    found = _PHONE.match(text, begin)
    return found and (begin, found.end(), 8 <= sum(c in _DIGITS for c in found.group()) <= 15)


def _url(text: str, begin: int, end: int, stop: int):
    start = begin
    while start > stop and text[start - 1].isascii() and text[start - 1].isalnum():
        start -= 1
    rest = _URL.match(text, end) if text[start:begin].lower() in _SCHEMES else None
    if not rest:
        return None
    stop_at = end + len(rest.group().rstrip(".,;:!?)]}#$%&*"))
    return (start, stop_at, True) if stop_at > end else None


def _iban(text: str, begin: int, end: int, stop: int):
    at = end
    while at < len(text) and at < end + 4 and text[at] in " :=\t":
        at += 1
    found = _IBAN.match(text, at)
    return found and (at, found.end(), _iban_sound(found.group().replace(" ", "")))


def _behind_cue(pattern: re.Pattern) -> Callable:
    def parse(text: str, begin: int, end: int, stop: int):
        if begin > 0 and text[begin - 1].isalnum():
            return None
        found = pattern.match(text, end)
        return found and (found.start(1), found.end(1), True)

    return parse


_PARSERS: dict[str, Callable] = {
    "email": _email, "ip": _ip, "card": _card, "phone": _phone, "url": _url, "iban": _iban,
    "account": _behind_cue(_CUE_NUMBER), "secret": _behind_cue(_CUE_SECRET),
}


def find_spans(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) of each kind, in order and without overlap inside a kind."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    stops = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in automaton.iter(text):
        begin = last + 1 - size
        if begin < stops[kind]:
            continue
        found = _PARSERS[kind](text, begin, last + 1, stops[kind])
        if found:
            start, end, sound = found
            stops[kind] = end
            if sound:
                spans[kind].append((start, end))
    return spans


def mask(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with every span replaced by its kind in brackets; where spans overlap, they
    are replaced together, under the kind of the first."""
    out, at = [], 0
    pending: tuple[int, int, str] | None = None
    for start, end, kind in sorted((s, e, k) for k, found in spans.items() for s, e in found):
        if pending and start < pending[1]:
            pending = (pending[0], max(end, pending[1]), pending[2])
            continue
        if pending:
            out += [text[at:pending[0]], f"[{pending[2].upper()}]"]
            at = pending[1]
        pending = (start, end, kind)
    if pending:
        out += [text[at:pending[0]], f"[{pending[2].upper()}]"]
        at = pending[1]
    return "".join([*out, text[at:]])


def _written(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: counts of the base kinds, a digest of their spans, all spans.

    Offsets are code points, ends exclusive. A null text is the empty one and has no spans;
    a null id stays null; repeated rows give repeated results; no rows give no rows. Other
    columns are not read. Rows are independent: one pass without a shuffle.
    """

    def make():
        automaton = anchors()

        def step(columns):
            rows = []
            for doc_id, text in zip(*columns, strict=True):
                spans = find_spans(text, automaton)
                base = hashlib.sha256(_written(spans, BASE_KINDS).encode()).hexdigest()
                counts = [len(spans[k]) for k in BASE_KINDS]
                rows.append((doc_id, *counts, base, _written(spans, KINDS)))
            return rows

        return step

    return per_text(
        documents(df, id_col, text_col), make,
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
        "base_sha256 string, spans string",
    )


def mask_pii(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with personal data in ``text`` replaced by ``[KIND]``.

    ``n_chars``, where there is one, is counted anew; all other columns stay as they are. A null
    text stays null with its ``n_chars``, an empty one empty.
    """
    bounded_batches(df.sparkSession)

    def run(batches):
        automaton = anchors()
        for batch in batches:
            texts = [None if t is None else mask(t, find_spans(t, automaton)) for t in batch.column("text").to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                sizes = [n if t is None else len(t) for t, n in zip(texts, old, strict=True)]
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return df.mapInArrow(run, df.schema)
