"""Exact token counts of every prefix of a text, for a BPE model with scored pieces.

No piece holds a space mark behind another character, nor a line feed, so a text falls into
units (a space mark and the word behind it, or a line feed and what follows) whose tokens do
not depend on each other: the count at a prefix is the count before its last unit plus the
count of the unit's own prefix.

Inside a unit, a table over prefixes holds the last token of each prefix's encoding. A token
t that ends at position i is the last one exactly if the last token of the prefix before t
and t stay two tokens when encoded together; the count follows from the one before t. Each
distinct unit is done once, and units in sorted order reuse the entries of the prefix that
they share. The library's own count of the unit confirms each table.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame

from bindery.llm.shared import documents
from bindery.llm.words import with_word_values

SPACE = "▁"
# How units travel: b"word" stands for a space mark and the word, b"\1rest" for a line feed
# and the rest, b"\2..." for what follows as it is.
_FEED, _LITERAL = b"\x01", b"\x02"
_UNIT = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def units_of(text: str) -> list[bytes]:
    raw = text.encode()
    if not raw:
        return []
    odd = b"  " in raw or raw[:1] == b" " or raw[-1:] == b" " or SPACE in text
    marked = _FEED in raw or _LITERAL in raw
    if not odd and not marked:
        return raw.replace(b"\n", b" \x01").split(b" ") if raw[:1] != b"\n" else (
            [b""] + raw.replace(b"\n", b" \x01")[1:].split(b" ")
        )
    return [_LITERAL + u.encode() for u in _UNIT.findall(SPACE + text.replace(" ", SPACE))]


def unit_text(unit: bytes) -> str:
    if unit[:1] == _LITERAL:
        return unit[1:].decode()
    if unit[:1] == _FEED:
        return "\n" + unit[1:].decode()
    return SPACE + unit.decode()


class PrefixTables:
    """Counts of all prefixes of units under one model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.model
        pieces = [
            (model.get_score(i), model.id_to_piece(i)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.score = {p: s for s, p in pieces}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.score):
            raise ValueError("pieces of this model cross words")
        self.longest = max(map(len, self.score))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.text, self.last, self.count = "", [""], [0]

    def merged(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best-scored adjacent pair merges, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, before: str, token: str) -> bool:
        key = (before, token)
        found = self.pairs.get(key)
        if found is None:
            if before not in self.score:  # a start, or a character without a piece
                found = self.merged(token) == [token]
            else:
                found = self.merged(before + token) == [before, token]
            if len(self.pairs) > 2_000_000:  # only a memory of earlier answers
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def prefixes(self, text: str) -> list[int]:
        """Token counts of ``text[:0]``, ``text[:1]``, ... for a unit's text."""
        same, most = 0, min(len(text), len(self.text))
        while same < most and text[same] == self.text[same]:
            same += 1
        last, count = self.last[:same + 1], self.count[:same + 1]
        for end in range(same + 1, len(text) + 1):
            for size in range(1, min(end, self.longest) + 1):
                token = text[end - size:end]
                known = token in self.score
                if (known and self.stay_apart(last[end - size], token)) or (size == 1 and not known):
                    last.append(token)
                    count.append(count[end - size] + (1 if known else len(token.encode())))
                    break
            else:
                raise ValueError(f"no last token for a prefix of {text[:80]!r}")
        self.text, self.last, self.count = text, last, count
        return count

    def confirmed(self, texts: list[str]) -> list[list[int]]:
        tables = [self.prefixes(t) for t in texts]
        # the library puts a space mark in front; a unit without one gets it as a token more
        asked = [t[1:] if t[0] == SPACE else t for t in texts]
        counts = self.model.encode([a.replace(SPACE, " ") for a in asked], num_threads=1)
        for text, table, ids in zip(texts, tables, counts, strict=True):
            if text != SPACE and table[-1] != len(ids) - (text[0] != SPACE):
                raise ValueError(f"prefix table and library differ on {text[:80]!r}")
        return tables


def _units() -> Callable[[str], list[bytes]]:
    return units_of


def _encoder(path: str) -> Callable:
    def make():
        tables = PrefixTables(path)

        def encode(units: list[bytes]) -> list[bytes]:
            tables_of = tables.confirmed([unit_text(u) for u in units])
            return [" ".join(map(str, t)).encode() for t in tables_of]

        return encode

    return make


def _counts(value: bytes) -> list[int]:
    return [int(c) for c in value.split()]


def _total(value: bytes) -> int:
    return int(value[value.rfind(b" ") + 1:])


def cut_at(units: list[bytes], value_of: dict[bytes, tuple[int, bytes]], limit: int) -> int:
    """Characters of the longest prefix of the text with at most ``limit`` tokens.

    The stored counts answer this: whole units by their running total, the rest from the
    table of the unit that crosses the limit.
    """
    ends = list(accumulate(value_of[u][0] for u in units))
    whole = bisect_right(ends, limit)
    chars = sum(len(unit_text(u)) for u in units[:whole]) - (whole > 0)
    if whole < len(units):
        counts = _counts(value_of[units[whole]][1])
        left = limit - (ends[whole - 1] if whole else 0)
        inside = max(i for i in range(len(counts)) if counts[i] <= left)
        chars += inside - (whole == 0 and inside > 0)
    return chars


def count_documents(
    df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, kept_chars``, one row per row of ``df``.

    ``kept_chars`` is the length in code points of the longest prefix with at most ``limit``
    tokens. A null text is the empty one, with no tokens; null ids stay null, repeated rows
    are repeated, no rows give no rows; other columns are not read. ``path`` is the model's
    file, which every executor must have.
    """

    def assembler():
        def make(doc_id, text, units, value_of):
            n_tokens = sum([value_of[u][0] for u in units])
            kept = cut_at(units, value_of, limit) if n_tokens > limit else len(text)
            return doc_id, len(text.encode()), n_tokens, n_tokens > limit, kept

        return make

    return with_word_values(
        documents(df, id_col, text_col), _units, _encoder(path), assembler,
        "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, kept_chars bigint",
        prepare=lambda value: (_total(value), value),
    )


def prefix_counts(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens_at`` where entry k is the count of the text's first k characters.

    Cases as in ``count_documents``; the empty text has one entry, 0.
    """

    def assembler():
        def make(doc_id, text, units, value_of):
            at, before = [0], 0
            for k, unit in enumerate(units):
                counts = value_of[unit]
                at += [before + c for c in counts[1 + (k == 0):]]
                before += counts[-1]
            return doc_id, at

        return make

    return with_word_values(
        documents(df, id_col, text_col), _units, _encoder(path), assembler,
        "doc_id bigint, n_tokens_at array<int>",
        prepare=_counts,
    )
