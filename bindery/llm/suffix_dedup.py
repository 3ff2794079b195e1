"""Repeated byte strings, found by suffix sorting with a difference cover.

A suffix is a place in a text where a string of ``length`` bytes starts. Two equal strings are
neighbours in the sorted order of all suffixes, so every repeated one is found by comparing each
suffix's first ``length`` bytes with those of its neighbour. The order is built by the difference
cover modulo 3: suffixes at two of three places are sorted by triples, triples get names,
the string of names is sorted in the same way, and the remaining suffixes are merged in by their first
symbol and the order known behind it.

The work is divided by content, so that suffixes which may be equal are sorted together:

1. Every suffix has a key, the least hash of the 64-byte strings inside its first ``length`` bytes.
   Neighbouring suffixes mostly share it, so a text falls into pieces of suffixes with one key.
   Equal strings have equal keys wherever they stand.
2. Equal pieces (by 128-bit digest) are counted and sorted once. A piece that occurs twice is
   repeated as a whole. A key with one piece, whose hash occurs in it once, repeats nothing else.
3. The distinct pieces of all other keys are dealt to buckets by key, and each bucket is sorted.
   A key with more text than a bucket should hold has its strings compared by 128-bit digests,
   through a shuffle on the digest.

Documents travel in compressed packs, and only pieces that need sorting leave them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.shared import bounded_batches, documents, partitions
from bindery.staging import staged

PACK_BYTES = 2_000_000
#: Text of one bucket, and the most text of a key that is sorted in a bucket.
BUCKET_BYTES = 1_000_000
HEAVY_BYTES = 2_000_000
#: Suffixes whose keys are computed at once, and the most suffixes of a piece.
SLICE = 1 << 20
PIECE = 4096

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


# ---------------------------------------------------------------- difference cover


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Places of ``s`` (positive numbers) ordered by their suffixes. Every level of names is two
    thirds as long as the one before, so all of them together cost three times the first."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    # a place behind the end in the first class keeps its last triple apart from the second's
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.r_[one, two]
    names, distinct = _named(t[sample], t[sample + 1], t[sample + 2])
    order = np.argsort(names, kind="stable") if distinct == len(sample) else suffix_order(names + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sample = sample[order]
    sample = sample[sample < n]

    wide = n + 3
    first = t * wide
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(first[rest] + rank[rest + 1], kind="stable")]
    in_one, in_two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    pair, _ = _named(t[:-2], t[1:-1], None)
    second = pair * wide
    before_one = np.searchsorted(first[in_one] + rank[in_one + 1], first[rest] + rank[rest + 1])
    before_two = np.searchsorted(second[in_two] + rank[in_two + 2], second[rest] + rank[rest + 2])
    at = np.arange(len(rest)) + before_one + before_two
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = rest
    out[~taken] = sample
    return out


def _named(a: np.ndarray, b: np.ndarray, c: np.ndarray | None) -> tuple[np.ndarray, int]:
    """Names of pairs or triples in their order, from 0, and how many there are."""
    base = int(max(a.max(), b.max(), 0 if c is None else c.max())) + 1
    key = a * base + b
    if c is not None:
        if base ** 3 >= 2**62:
            key, _ = _named(a, b, None)
        key = key * base + c
    values, names = np.unique(key, return_inverse=True)
    return names, len(values)


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, whether the ``length`` bytes at each place occur anywhere else among all."""
    sizes = np.array([len(p) for p in pieces])
    whole = np.frombuffer(b"\0".join(pieces), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    symbols = whole.astype(np.int64) + 2
    symbols[ends[:-1]] = 1  # between two pieces
    order = suffix_order(symbols)
    valid = np.zeros(len(whole), bool)
    for a, e in zip(starts, ends, strict=True):
        valid[a:max(a, e - length + 1)] = True
    order = order[valid[order]]
    found = np.zeros(len(whole), bool)
    if len(order) > 1:
        strings = np.lib.stride_tricks.sliding_window_view(whole, length)
        left, right = order[:-1], order[1:]
        for probe in (length - 1, length // 2, 3 * length // 4):  # cheap before whole strings
            same = whole[left + probe] == whole[right + probe]
            left, right = left[same], right[same]
        for at in range(0, len(left), 8192):
            a, b = left[at:at + 8192], right[at:at + 8192]
            same = (strings[a] == strings[b]).all(axis=1)
            found[a[same]] = True
            found[b[same]] = True
    return [found[a:max(a, e - length + 1)] for a, e in zip(starts, ends, strict=True)]


def _ranges(flags: np.ndarray) -> np.ndarray:
    """(begin, end) of the stretches of true flags."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return edges.reshape(-1, 2)


# ---------------------------------------------------------------- pieces


class Cutter:
    """Cuts a text into pieces of neighbouring suffixes with one key."""

    def __init__(self, length: int):
        self.length = length
        self.gram = min(64, max(1, length // 6))
        self.wide = length - self.gram + 1
        n = SLICE + length + 1
        self.power, self.inverse = (
            np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)])
            for b in (_BASE, pow(_BASE, -1, 1 << 64))
        )

    def hashes(self, part: np.ndarray) -> np.ndarray:
        """A hash of the ``gram`` bytes at every place."""
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=sums[1:])
        h = (sums[self.gram:] - sums[:-self.gram]) * self.inverse[:n - self.gram + 1]
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        return h

    def pieces(self, text: bytes) -> Iterator[tuple[int, int, int, bool]]:
        """(key, first suffix, number of suffixes, whether the key's hash occurs more than once)."""
        data = np.frombuffer(text, np.uint8)
        for at in range(0, len(text) - self.length + 1, SLICE):
            part = data[at:at + SLICE + self.length - 1]
            h = self.hashes(part)
            least, size = h, 1
            while 2 * size <= self.wide:
                least, size = np.minimum(least[:-size], least[size:]), 2 * size
            if size < self.wide:
                rest = self.wide - size
                least = np.minimum(least[:-rest], least[rest:])
            new = np.flatnonzero(least[1:] != least[:-1]) + 1
            for begin, end in zip([0, *new.tolist()], [*new.tolist(), len(least)], strict=True):
                key = least[begin]
                for b in range(begin, end, PIECE):
                    e = min(end, b + PIECE)
                    several = e - b > self.wide or np.count_nonzero(h[b:e + self.wide - 1] == key) > 1
                    yield int(key), at + b, e - b, bool(several)


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_ids, sizes, data): documents by the pack, texts end to end and compressed."""

    def row(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
            pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], pa.binary()),
        ], names=["doc_ids", "sizes", "data"])

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text.encode()
                if texts and size + len(text) > PACK_BYTES:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield row(ids, texts)

    return docs.mapInArrow(run, "doc_ids array<bigint>, sizes array<bigint>, data binary")


def _bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pieces(packs: DataFrame, length: int) -> DataFrame:
    """(key, d1, d2, pack, start, n, several): every piece with the digest of its text."""

    def run(batches):
        cutter = Cutter(length)
        for batch in batches:
            for pack, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("pack", "sizes", "data")), strict=True):
                whole, at = _bytes(data), 0
                keys, digests, starts, counts, several = [], [], [], [], []
                for size in sizes:
                    text = whole[at:at + size]
                    for key, start, n, more in cutter.pieces(text):
                        keys.append(key)
                        digests.append(xxhash.xxh3_128_digest(text[start:start + n + length - 1]))
                        starts.append(at + start)
                        counts.append(n)
                        several.append(more)
                    at += size
                digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(keys, np.uint64).view(np.int64)),
                    pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1])),
                    pa.array(np.full(len(keys), pack, np.int64)), pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int32()), pa.array(several, pa.bool_()),
                ], names=["key", "d1", "d2", "pack", "start", "n", "several"])

    return packs.select("pack", "sizes", "data").mapInArrow(
        run, "key bigint, d1 bigint, d2 bigint, pack bigint, start bigint, n int, several boolean"
    )


def _distinct(pieces: DataFrame, length: int) -> DataFrame:
    """Distinct pieces that are repeated, or may hold something that is: with their number of
    copies, one place, whether they are to be sorted (``open``) and whether their key is heavy."""
    text = (F.col("n") + length - 1).cast("bigint")
    distinct = pieces.groupBy("d1", "d2").agg(
        F.count("*").alias("copies"), F.min(F.struct("pack", "start")).alias("place"),
        F.first("key").alias("key"), F.first("n").alias("n"), F.first("several").alias("several"),
    )
    keys = distinct.groupBy("key").agg(
        ((F.count("*") > 1) | F.max("several")).alias("open"), F.sum(text).alias("size")
    ).where("open").withColumn("heavy", F.col("size") > HEAVY_BYTES)
    marked = distinct.join(keys.select("key", "open", "heavy"), "key", "left")
    return marked.where("open or copies > 1").select(
        "key", "d1", "d2", "copies", "place.pack", "place.start", "n",
        F.coalesce("open", F.lit(False)).alias("open"), F.coalesce("heavy", F.lit(False)).alias("heavy"),
    )


def _texts(packs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(bucket, d1, d2, single, heavy, text) of the pieces to be sorted, cut out of their packs."""
    listed = wanted.groupBy("pack").agg(
        F.collect_list(F.struct("bucket", "d1", "d2", "start", "n", "single", "heavy")).alias("listed")
    )

    def run(batches):
        for batch in batches:
            for data, rows in zip(*(batch.column(c).to_pylist() for c in ("data", "listed")), strict=True):
                whole = _bytes(data)
                for at in range(0, len(rows), 4096):
                    part = rows[at:at + 4096]
                    columns = [pa.array([r[c] for r in part]) for c in ("bucket", "d1", "d2", "single", "heavy")]
                    texts = [whole[r["start"]:r["start"] + r["n"] + length - 1] for r in part]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(texts, pa.binary())],
                        names=["bucket", "d1", "d2", "single", "heavy", "text"],
                    )

    return packs.select("pack", "data").join(listed, "pack").select("data", "listed").mapInArrow(
        run, "bucket bigint, d1 bigint, d2 bigint, single boolean, heavy boolean, text binary"
    )


_FOUND = "d1 bigint, d2 bigint, begin int, end int"


def _sorted(texts: DataFrame, length: int) -> DataFrame:
    """Stretches of repeated suffixes in pieces that occur once, bucket by bucket."""

    def run(table: pa.Table) -> pa.Table:
        flags = repeated_starts(table.column("text").to_pylist(), length)
        d1, d2, single = (table.column(c).to_numpy() for c in ("d1", "d2", "single"))
        out = [(d1[i], d2[i], b, e) for i, f in enumerate(flags) if single[i] for b, e in _ranges(f)]
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.table({
            name: pa.array(c, kind) for name, c, kind in zip(("d1", "d2", "begin", "end"), columns, kinds, strict=True)
        })

    spread = texts.repartition(partitions(texts.sparkSession), "bucket")
    return spread.groupBy("bucket").applyInArrow(run, _FOUND)


def _compared(texts: DataFrame, length: int) -> DataFrame:
    """The same for heavy keys: a row per string, counted by its digest."""

    def strings(batches):
        for batch in batches:
            for d1, d2, single, text in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "single", "text")), strict=True):
                n = len(text) - length + 1
                digest = np.frombuffer(
                    b"".join(xxhash.xxh3_128_digest(text[i:i + length]) for i in range(n)), np.int64
                ).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1])),
                    pa.array(np.full(n, d1)), pa.array(np.full(n, d2)),
                    pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, single)),
                ], names=["s1", "s2", "d1", "d2", "begin", "single"])

    every = texts.select("d1", "d2", "single", "text").mapInArrow(
        strings, "s1 bigint, s2 bigint, d1 bigint, d2 bigint, begin int, single boolean"
    )
    again = every.groupBy("s1", "s2").agg(F.count("*").alias("c")).where("c > 1")
    found = every.where("single").join(again, ["s1", "s2"], "left_semi")
    # a row for each stretch, not for each string; a piece has no more than PIECE of them
    places = found.groupBy("d1", "d2").agg(F.sort_array(F.collect_set("begin")).alias("p"))
    begins = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1))
    stretches = F.arrays_zip(begins.alias("begin"), F.transform(ends, lambda x: x + 1).alias("end"))
    return places.select("d1", "d2", F.inline(stretches))


def _kept(packs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """One row for each document, with the bytes that no repeated string covers."""
    listed = spans.groupBy("pack").agg(F.collect_list(F.struct("start", "n")).alias("listed"))

    def run(batches):
        for batch in batches:
            for ids, sizes, data, rows in zip(
                *(batch.column(c).to_pylist() for c in ("doc_ids", "sizes", "data", "listed")), strict=True
            ):
                whole, at = _bytes(data), 0
                rows = sorted((r["start"], r["start"] + r["n"] + length - 1) for r in rows or ())
                place, kept, removed = 0, [], []
                for size in sizes:
                    runs, stop = [], at + size
                    while place < len(rows) and rows[place][0] < stop:
                        begin, end = rows[place]
                        if runs and begin <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], end)
                        else:
                            runs.append([begin, end])
                        place += 1
                    cuts = [at, *(x for r in runs for x in r), stop]
                    kept.append(b"".join(whole[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                    removed.append([{"begin": b - at, "end": e - at} for b, e in runs])
                    at = stop
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ], names=["doc_id", "n_bytes", "removed", "kept"])

    return packs.join(listed, "pack", "left").select("doc_ids", "sizes", "data", "listed").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, removed array<struct<begin: bigint, end: bigint>>, kept binary"
    )


def drop_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` for every row: its UTF-8 bytes without those
    covered by a string of ``length`` bytes that also starts anywhere else, in the same or another row.

    ``removed`` lists the maximal removed runs in order, ``kept`` holds the bytes that stay.
    Strings are judged on the input, not on what is left, and never cross rows. A null text is
    the empty one and a text shorter than ``length`` stays whole; rows with one id or with null ids
    are texts of their own, so repeated rows lose everything of ``length`` bytes or more; no rows
    give none; other columns are not read. A task holds a pack of 2 MB (or one longer text), or a bucket.
    """
    bounded_batches(df.sparkSession)
    packs = staged(_packed(documents(df, id_col, text_col)).withColumn("pack", F.monotonically_increasing_id()), "packs")
    pieces = staged(_pieces(packs, length), "pieces")
    distinct = staged(_distinct(pieces, length), "distinct")
    size = distinct.where("open and not heavy").agg(F.sum(F.col("n") + F.lit(length - 1))).head()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    texts = staged(_texts(packs, distinct.where("open").select(
        F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "d1", "d2", "pack", "start", "n",
        (F.col("copies") == 1).alias("single"), "heavy",
    ), length), "texts")
    whole = distinct.where("copies > 1").select("d1", "d2", F.lit(0).alias("begin"), F.col("n").alias("end"))
    found = (
        whole.unionByName(_sorted(texts.where("not heavy"), length))
        .unionByName(_compared(texts.where("heavy"), length))
    )
    spans = pieces.join(found, ["d1", "d2"]).select(
        "pack", (F.col("start") + F.col("begin")).alias("start"), (F.col("end") - F.col("begin")).alias("n")
    )
    return _kept(packs, spans, length)
