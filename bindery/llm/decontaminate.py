"""Benchmark items inside documents: size-partitioned MinHash containment search.

The set asked about is the short item, so the sketch is the item's: its ``SKETCH`` smallest
shingle hashes (all, if it has no more). Items are partitioned by the size of their sets,
in powers of two; the items of a class have similar largest sketch values, and the class's
bound is the greatest of them. A document's sketch for a class is every shingle hash up to the
bound, so its size adapts to the class and a passage is found in a document of any length:
the share of an item's sketch that a document's sketch holds estimates containment. Pairs
with enough of the sketch are verified on the full sets.

The share asked for is so far below the threshold (six deviations of a sample) that pairs
which contain the threshold's share are not lost; sketches that are whole sets ask for the
threshold itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.shared import per_text, plain
from bindery.llm.shingles import WordHashes, letter_words, shingle_hashes
from bindery.staging import staged

SKETCH = 24
#: Items travel with the tasks up to so many hashes in all (16 MB); beyond, tables are joined.
MAX_CARRIED = 2_000_000


def _needed(size: int, num: int, den: int) -> int:
    """Sketch hashes a document must hold for an item with ``size`` shingles."""
    if size <= SKETCH:
        return -(-size * num // den)
    t = num / den
    return max(1, math.floor(SKETCH * t - 6 * math.sqrt(SKETCH * t * (1 - t))))


def _width(n_words: int, width: int) -> int:
    return min(width, n_words)


def item_sets(items: DataFrame, width: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, width, size, size_class, hashes`` of items with a word; an item with fewer
    words than ``width`` is searched for as one shingle of its own width."""
    rows = plain(items, {"item_id": item_col, "text": text_col}).where("text is not null")

    def make():
        known = WordHashes()

        def step(columns):
            out = []
            for item_id, text in zip(*columns, strict=True):
                words = letter_words(text)
                if words:
                    own = _width(len(words), width)
                    h = shingle_hashes(words, own, known)
                    signed = (h ^ np.uint64(1 << 63)).view(np.int64)  # keeps the order
                    out.append((item_id, own, len(h), len(h).bit_length(), signed.tolist()))
            return out

        return step

    return per_text(
        rows, make, "item_id bigint, width int, size int, size_class int, hashes array<bigint>"
    ).distinct()


@dataclass
class _Carried:
    """Items of one width and size class: sketch hashes in order with their items, and the full sets."""

    width: int
    bound: int
    sketch: np.ndarray
    owner: np.ndarray
    needed: np.ndarray
    ids: list
    full: list[np.ndarray]

    def low(self, document: np.ndarray) -> np.ndarray:
        """The document's sketch for the class: its hashes up to the class's bound."""
        return document[:np.searchsorted(document, self.bound, "right")]

    def found(self, document: np.ndarray, num: int, den: int) -> list[tuple[int, int, int]]:
        low = self.low(document)
        left = np.searchsorted(self.sketch, low, "left")
        n = np.searchsorted(self.sketch, low, "right") - left
        if not n.any():
            return []
        hits = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        counts = np.bincount(self.owner[hits], minlength=len(self.ids))
        out = []
        for i in np.flatnonzero(counts >= self.needed):
            at = np.searchsorted(document, self.full[i])
            at[at == len(document)] = 0
            shared = int((document[at] == self.full[i]).sum())
            if den * shared >= num * len(self.full[i]):
                out.append((self.ids[i], shared, len(self.full[i])))
        return out


def _carried(rows: list, num: int, den: int) -> list[_Carried]:
    """One index for each width and size class that occurs, with a bound of its own."""
    out = []
    for width, size_class in sorted({(r["width"], r["size_class"]) for r in rows}):
        own = [r for r in rows if (r["width"], r["size_class"]) == (width, size_class)]
        full = [np.array(r["hashes"], np.int64) for r in own]
        sketches = [f[:SKETCH] for f in full]
        sketch = np.concatenate(sketches)
        owner = np.repeat(np.arange(len(own)), [len(s) for s in sketches])
        order = np.argsort(sketch, kind="stable")
        out.append(_Carried(
            width, sketch.max(), sketch[order], owner[order],
            np.array([_needed(len(f), num, den) for f in full]), [r["item_id"] for r in own], full,
        ))
    return out


def _signed_shingles(words: list[bytes], width: int, known: WordHashes) -> np.ndarray:
    if len(words) < width:
        return np.empty(0, np.int64)
    return (shingle_hashes(words, width, known) ^ np.uint64(1 << 63)).view(np.int64)


def _matcher(carried: list[_Carried], num: int, den: int) -> Callable[[], Callable[[str], list]]:
    def make():
        known = WordHashes()

        def match(text: str) -> list[tuple[int, int, int]]:
            words = letter_words(text)
            sets = {w: _signed_shingles(words, w, known) for w in {c.width for c in carried}}
            return [m for c in carried for m in c.found(sets[c.width], num, den)]

        return match

    return make


def _pairs_carried(docs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    carried = _carried(sets.collect(), num, den)
    matcher = _matcher(carried, num, den)

    def make():
        match = matcher()

        def step(columns):
            return [
                (key, item, shared, size)
                for key, text in zip(*columns, strict=True) if text
                for item, shared, size in match(text)
            ]

        return step

    return per_text(docs, make, "key binary, item_id bigint, n_shared int, n_item int")


def _pairs_joined(docs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The same pairs through shuffles: sketches meet by hash, then full sets by pair."""
    numbered = staged(sets.withColumn("item", F.monotonically_increasing_id()), "items")
    sketches = numbered.select("item", "width", "size_class", F.explode(F.slice("hashes", 1, SKETCH)).alias("hash"))
    # at most 5 widths and 64 classes
    bounds = [tuple(r) for r in sketches.groupBy("width", "size_class").agg(F.max("hash")).collect()]
    widths = sorted({w for w, _, _ in bounds})

    def sketched():
        known = WordHashes()

        def step(columns):
            rows = []
            for key, text in zip(*columns, strict=True):
                words = letter_words(text or "")
                sets = {w: _signed_shingles(words, w, known) for w in widths}
                rows += [(key, w, c, sets[w][:np.searchsorted(sets[w], bound, "right")].tolist()) for w, c, bound in bounds]
            return rows

        return step

    def whole():
        known = WordHashes()

        def step(columns):
            return [
                (key, w, _signed_shingles(letter_words(text or ""), w, known).tolist())
                for key, text in zip(*columns, strict=True) for w in widths
            ]

        return step

    low = per_text(docs, sketched, "key binary, width int, size_class int, hashes array<bigint>")
    met = low.select("key", "width", "size_class", F.explode("hashes").alias("hash")).distinct().join(
        sketches, ["width", "size_class", "hash"]
    ).groupBy("key", "item").agg(F.count("*").alias("met"))
    items = numbered.select("item", "item_id", "width", "size", "hashes")
    t = num / den
    sampled = max(1, math.floor(SKETCH * t - 6 * math.sqrt(SKETCH * t * (1 - t))))
    needed = F.when(F.col("size") <= SKETCH, F.ceil(F.col("size") * num / den)).otherwise(sampled)
    close = staged(
        met.join(items.select("item", "size"), "item").where(F.col("met") >= needed).select("key", "item"),
        "close",
    )
    texts = docs.join(close.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    full = per_text(texts, whole, "key binary, width int, hashes array<bigint>")
    shared = (
        close.join(items, "item").select("key", "item", "item_id", "width", "size", F.explode("hashes").alias("hash"))
        .join(full.select("key", "width", F.explode("hashes").alias("hash")), ["key", "width", "hash"])
        .groupBy("key", "item", "item_id", "size").agg(F.count("*").cast("int").alias("n_shared"))
    )
    return shared.where(F.col("n_shared") * den >= F.col("size") * num).select(
        "key", "item_id", "n_shared", F.col("size").alias("n_item")
    )


def _pairs(docs: DataFrame, items: DataFrame, width: int, num: int, den: int, carried: int) -> DataFrame:
    """(key, item_id, n_shared, n_item) for (key, text) rows."""
    sets = staged(item_sets(items, width), "sets")
    total = sets.agg(F.sum("size").alias("n")).head()["n"] or 0
    return (_pairs_carried if total <= carried else _pairs_joined)(docs, sets, num, den)


def contaminated(
    df: DataFrame, items: DataFrame, width: int = 5, num: int = 80, den: int = 100,
    id_col: str = "doc_id", text_col: str = "text", max_carried: int = MAX_CARRIED,
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item``: items of which a document holds at least num/den of
    the distinct ``width``-word shingles (words: runs of letters and digits, lower-cased).

    Rows with the same id and pairs found twice give one row, that with the largest share.
    Null or empty texts and items without a word match nothing; null ids are kept as null; no
    rows in either table give no rows; other columns are not read.
    """
    docs = plain(df, {"doc_id": id_col, "text": text_col})
    keyed = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), "text")
    pairs = _pairs(keyed.select("key", "text"), items, width, num, den, max_carried).distinct()
    pairs = staged(pairs, "pairs")
    return keyed.select("doc_id", "key").join(pairs, "key").groupBy("doc_id", "item_id").agg(
        F.max(F.struct("n_shared", "n_item")).alias("m")
    ).select("doc_id", "item_id", "m.n_shared", "m.n_item")


def drop_contaminated(df: DataFrame, items: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``df`` whose ``text`` holds no item; cases as in ``contaminated``."""
    key = F.unhex(F.md5(F.coalesce(df["text"], F.lit(""))))
    texts = df.select(key.alias("key"), "text")
    pairs = staged(_pairs(texts, items, width, num, den, MAX_CARRIED).select("key").distinct(), "pairs")
    return df.join(pairs, key == pairs["key"], "left_anti")
