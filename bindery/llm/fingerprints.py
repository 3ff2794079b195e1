"""Document fingerprints by a randomised edit embedding.

A walk over a text emits its current character at every step and moves on to the next one
when a random bit, shared by all texts and set by the step and the character, is one. Two texts
that differ by few edits walk in step but for short stretches, so their edit distance turns
into a Hamming distance of what the walks emit. A character is left after a number of steps
that its class and the first step there fix, so a walk is one table lookup per character.

A fingerprint samples what ``WALKS`` walks emit. Positions are drawn in octaves [2^k, 2^(k+1)), as
many in each, and the last ``OCTAVES`` that a text reaches are kept: four bits per position,
written as one hexadecimal digit. Octaves count by their length when two fingerprints are
compared, so the result estimates the share of steps that agree at any length of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.shared import bounded_batches, documents, partitions, plain

WALKS = 2
OCTAVES = 6
SAMPLES = 24
CLASSES = 32
PERIOD = 1 << 16
BANDS = 6
BAND_SIZE = 6
#: Ids of a band in one block.
BAND_BLOCK = 256

#: Walks that are worth a step of numpy; fewer go on one by one.
LEAST_TOGETHER = 48

_PAD = "f"
_DIGITS = np.frombuffer(b"0123456789abcde", np.uint8)
#: Agreement of unrelated texts by chance, about.
_CHANCE = 0.13


def _stay_tables() -> list[bytes]:
    """For each walk, steps until a one, by class and step (modulo the period)."""
    tables = []
    for walk in range(WALKS):
        bits = np.random.default_rng(7_001 + walk).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
        stay = np.zeros((CLASSES, PERIOD), np.int64)
        after = np.full(CLASSES, 0)
        for j in range(2 * PERIOD - 1, -1, -1):
            after = np.where(bits[:, j % PERIOD] == 1, 1, after + 1)
            if j < PERIOD:
                stay[:, j] = after
        tables.append(stay.astype(np.uint8).tobytes())
    return tables


def _positions() -> np.ndarray:
    """Sampled steps of each octave, ascending; short octaves repeat steps."""
    rng = np.random.default_rng(7_100)
    return np.array([sorted(rng.integers(1 << k, 2 << k, SAMPLES).tolist()) for k in range(48)])


class Embedder:
    """Walks over many texts at once: one step of numpy for a character of each of them."""

    def __init__(self):
        self.tables = _stay_tables()
        self.stay = np.frombuffer(b"".join(self.tables), np.uint8)
        self.positions = _positions()

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class offsets into a table and four-bit symbols below 15, as digits, of all characters;
        and where each text begins (and the last ends)."""
        begin = np.cumsum([0, *map(len, texts)])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        mixed = points * np.uint32(2654435761)
        offsets = (mixed >> np.uint32(27)).astype(np.int64) * PERIOD
        return offsets, _DIGITS[(mixed >> np.uint32(15)) % np.uint32(15)], begin

    def walk(self, offsets: np.ndarray, begin: np.ndarray, length: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
        """For each stretch of ``offsets`` the step after each character, a line for each walk,
        from the steps in ``start`` (stretches by walks)."""
        order = np.argsort(-length, kind="stable")
        length, lines = length[order], WALKS * len(order)
        out_begin = np.cumsum(length) - length
        total = int(length.sum())
        ends = np.empty((WALKS, total), np.int64)
        flat = ends.reshape(-1)
        walk = np.tile(np.arange(WALKS), len(order))
        read = np.repeat(begin[order], WALKS).astype(np.int64)
        write = np.repeat(out_begin, WALKS) + walk * total
        table = walk * (CLASSES * PERIOD)
        j = start[order].reshape(-1).astype(np.int64)
        done, n = 0, len(order)
        while n * WALKS >= LEAST_TOGETHER and done < length[0]:
            n = int(np.searchsorted(-length, -done, "left"))  # texts longer than ``done``
            if n * WALKS < LEAST_TOGETHER:
                break
            lines, until = n * WALKS, int(length[n - 1])
            r, w, k, c, at = read[:lines] + done, write[:lines] + done, table[:lines], j[:lines], np.empty(lines, np.int64)
            for _ in range(done, until):
                np.bitwise_and(c, PERIOD - 1, out=at)
                at += offsets[r]
                at += k
                c += self.stay[at]
                flat[w] = c
                r += 1
                w += 1
            done = until
        for i in range(int(np.searchsorted(-length, -done, "left"))):
            rest = offsets[begin[order[i]] + done:begin[order[i]] + length[i]].tolist()
            for v in range(WALKS):
                stay, mask, step, steps = self.tables[v], PERIOD - 1, int(j[i * WALKS + v]), []
                add = steps.append
                for c in rest:
                    step += stay[c + (step & mask)]
                    add(step)
                ends[v, out_begin[i] + done:out_begin[i] + length[i]] = steps
        out: list = [None] * len(order)
        for i, place in enumerate(order):
            out[place] = ends[:, out_begin[i]:out_begin[i] + length[i]]
        return out

    def digits(self, ends: np.ndarray, symbols: np.ndarray) -> tuple[int, np.ndarray]:
        """The last octave, and the digits by walk and octave."""
        out = np.full((WALKS, OCTAVES * SAMPLES), ord(_PAD), np.uint8)
        if not ends.shape[1]:
            return -1, out
        top = int(ends[:, -1].max()).bit_length() - 1
        first = max(0, top - OCTAVES + 1)
        wanted = self.positions[first:top + 1].reshape(-1)
        for line, own in zip(out, ends, strict=True):
            at = np.searchsorted(own, wanted, "right")
            there = at < len(own)
            line[len(line) - len(wanted):][there] = symbols[at[there]]
        return top, out

    def of(self, text: str) -> str:
        offsets, symbols, begin = self.codes([text])
        ends = self.walk(offsets, begin[:-1], np.diff(begin), np.zeros((1, WALKS), np.int64))[0]
        return _written(*self.digits(ends, symbols))


def _written(top: int, digits: np.ndarray) -> str:
    """Two digits for the last octave (plus one), then those of the walks."""
    return f"{top + 1:02x}{digits.tobytes().decode()}"


def likenesses(top_a: np.ndarray, a: np.ndarray, top_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of steps that agree, 0 for unrelated texts to 1 for equal fingerprints, of
    the pairs of fingerprints given by last octaves and digits (pairs by walks by digits)."""
    n, pad = len(top_a), ord(_PAD)
    shape = (n, WALKS, OCTAVES, SAMPLES)
    a, b = a.reshape(shape), b.reshape(shape)
    equal = (top_a == top_b) & (a == b).all(axis=(1, 2, 3))
    swap = top_a < top_b
    high, low = np.where(swap[:, None, None, None], b, a), np.where(swap[:, None, None, None], a, b)
    moved = np.full(shape, pad, np.uint8)  # the shorter one's octaves, under the longer one's
    for gap in np.unique(np.abs(top_a - top_b)):
        if gap < OCTAVES:
            rows = np.abs(top_a - top_b) == gap
            moved[rows, :, :OCTAVES - gap] = low[rows, :, gap:]
    octave = 2.0 ** np.arange(OCTAVES)  # steps in an octave, against the first that was kept
    weight = ((high != pad) | (moved != pad)).sum(axis=3) @ octave
    same = ((high == moved) & (high != pad)).sum(axis=3) @ octave
    share = np.divide(same, weight, out=np.zeros_like(weight), where=weight > 0).max(axis=1)
    share = np.clip((share - _CHANCE) / (1 - _CHANCE), 0.0, 1.0)
    return np.where(equal, 1.0, np.where((top_a < 0) | (top_b < 0), 0.0, share))


def _read(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Last octaves and digits of written fingerprints."""
    size = 2 + WALKS * OCTAVES * SAMPLES
    flat = np.frombuffer("".join(fingerprints).encode(), np.uint8).reshape(len(fingerprints), size)
    tops = np.array([int(f[:2], 16) - 1 for f in fingerprints], np.int64)
    return tops, flat[:, 2:].reshape(len(fingerprints), WALKS, OCTAVES * SAMPLES)


def likeness(a: str, b: str) -> float:
    """``likenesses`` of one pair of written fingerprints."""
    return float(likenesses(*_read([a]), *_read([b]))[0])


def _followed(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text) in buckets of ascending ids, each with the row that
    follows its last one as a guest, partitioned by bucket and sorted.

    Cuts between buckets and the first row's key of each are the only things gathered: a few
    numbers per partition. An id (or null) that holds several partitions' share of the rows is
    cut by the hash that orders its texts.
    """
    n = partitions(docs.sparkSession)
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(-(2**63)).cast("bigint")).alias("key"), F.xxhash64("text").alias("place"),
        "doc_id", "text",
    )
    cuts = keyed.agg(
        F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("c")
    ).head()["c"] or []
    marks = [
        (c, -(2**63) + i * 2**64 // cuts.count(c)) for c in sorted(set(cuts)) for i in range(cuts.count(c))
    ]
    listed = F.array(*[
        F.struct(F.lit(c).cast("bigint").alias("key"), F.lit(p).cast("bigint").alias("place")) for c, p in marks
    ])
    own = F.struct("key", "place")
    bucket = F.size(F.filter(listed, lambda mark: mark <= own)) if marks else F.lit(0)
    bucketed = keyed.select(bucket.alias("bucket"), F.lit(False).alias("guest"), "key", "place", "doc_id", "text")
    heads = bucketed.groupBy("bucket").agg(F.min(F.struct("key", "place")).alias("least")).orderBy("bucket").collect()
    if not heads:
        return bucketed.select("bucket", "guest", "doc_id", "text")
    before = [(heads[i - 1]["bucket"], *h["least"]) for i, h in enumerate(heads)]
    guests = keyed.join(
        F.broadcast(docs.sparkSession.createDataFrame(before, "bucket int, key bigint, place bigint")), ["key", "place"]
    ).groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    return (
        bucketed.unionByName(
            guests.select("bucket", F.lit(True).alias("guest"), "row.doc_id", "row.text"), allowMissingColumns=True
        )
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "place", "text")
        .select("bucket", "guest", "doc_id", "text")
    )


def _beside(embed: Embedder, ids: list, texts: list[str], own: np.ndarray) -> list:
    """Result columns of the rows ``own``, each with the row after it."""
    offsets, symbols, begin = embed.codes(texts)
    length = np.diff(begin)
    walks = embed.walk(offsets, begin[:-1], length, np.zeros((len(texts), WALKS), np.int64))
    prints = [embed.digits(w, symbols[a:a + n]) for w, a, n in zip(walks, begin, length, strict=False)]
    cut = length[own] // 4
    kept, added = length[own] - cut, np.minimum(cut, length[own + 1])
    start = np.array([
        walks[i][:, k - 1] if k else np.zeros(WALKS, np.int64) for i, k in zip(own, kept, strict=True)
    ], np.int64).reshape(-1, WALKS)
    tails = embed.walk(offsets, begin[own + 1], added, start)
    edited, digests = [], []
    for i, k, m, tail in zip(own, kept, added, tails, strict=True):
        changed = np.concatenate([symbols[begin[i]:begin[i] + k], symbols[begin[i + 1]:begin[i + 1] + m]])
        edited.append(embed.digits(np.concatenate([walks[i][:, :k], tail], axis=1), changed))
        digests.append(hashlib.sha256((texts[i][:k] + texts[i + 1][:m]).encode()).hexdigest())
    tops, digits = (np.array(c) for c in zip(*prints, strict=True))
    tops_e, digits_e = (np.array(c) for c in zip(*edited, strict=True))
    return [
        [ids[i] for i in own], length[own], digests, [_written(*prints[i]) for i in own],
        [_written(*e) for e in edited], likenesses(tops[own], digits[own], tops_e, digits_e),
        likenesses(tops[own], digits[own], tops[own + 1], digits[own + 1]),
    ]


def edit_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    Rows are in the order of their ids, nulls first, equal ids by the hash of the text; the first
    follows the last, and a single row follows itself. The edited text has the last quarter of the
    characters replaced by as many (or all) of the text that follows. A null text is the empty
    one, whose fingerprint is all padding; repeated rows give a row each; no rows give none;
    other columns are not read. Texts cross the network once, and a task holds one batch of them.
    """
    rows = _followed(documents(df, id_col, text_col))
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = Embedder()
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        waiting: list[tuple] = []
        for batch in batches:
            listed = waiting + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            # a row is paired with the next one of its bucket; the last waits for the next batch
            own = np.array([
                i for i, (row, after) in enumerate(zip(listed, listed[1:], strict=False))
                if not row[1] and row[0] == after[0]
            ], np.int64)
            if len(own):
                columns = _beside(embed, [r[2] for r in listed], [r[3] for r in listed], own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
                )
            waiting = listed[-1:]

    return rows.mapInArrow(
        run,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


def close_pairs(
    fingerprints: DataFrame, texts: DataFrame, least: float = 0.7, most_edits: int = 200
) -> DataFrame:
    """``a, b, edits``: documents that share a band and lie within ``most_edits`` of each other.

    Bands are ``BANDS`` samples of ``BAND_SIZE`` positions from each walk in the last two octaves that a text fills,
    so texts whose lengths fall on both sides of a power of two share one. Equal texts are linked
    to their least id, which stands for them; all pairs of a band are then verified by likeness of
    the whole fingerprints and by the edit distance of the texts. A band of more than
    ``BAND_BLOCK`` ids is dealt in blocks, each against every other. ``fingerprints`` and ``texts`` hold
    ``doc_id`` with ``fingerprint`` and ``text``; null ids and texts take no part.
    """
    rng = np.random.default_rng(7_200)
    picks = [sorted(rng.choice(SAMPLES, BAND_SIZE, replace=False).tolist()) for _ in range(BANDS)]
    rows = plain(fingerprints, {"doc_id": "doc_id", "fingerprint": "fingerprint"}).where(
        "doc_id is not null and left(fingerprint, 2) <> '00'"
    )
    top = F.conv(F.left("fingerprint", F.lit(2)), 16, 10).cast("int")
    bands = []
    for walk in range(WALKS):
        for back in (1, 2):
            begin = 2 + (walk * OCTAVES + OCTAVES - 1 - back) * SAMPLES
            for i, pick in enumerate(picks):
                digits = F.concat(*[F.substring("fingerprint", begin + p + 1, 1) for p in pick])
                bands.append(F.concat_ws(":", F.lit(walk), top - back, F.lit(i), digits))
    text = plain(texts, {"doc_id": "doc_id", "text": "text"}).where("text is not null")
    named = rows.join(text.select("doc_id", F.md5("text").alias("md5")), "doc_id")
    leads = named.groupBy("md5").agg(F.min("doc_id").alias("lead"))
    copies = named.join(leads, "md5").where("lead <> doc_id").select(
        F.col("lead").alias("a"), F.col("doc_id").alias("b"), F.lit(0).alias("edits")
    )
    single = rows.join(leads.select(F.col("lead").alias("doc_id")).distinct(), "doc_id", "left_semi")
    banded = single.select("doc_id", F.explode(F.array(*bands)).alias("band"))
    sizes = banded.groupBy("band").agg(F.ceil(F.count("*") / BAND_BLOCK).cast("bigint").alias("blocks"))
    placed = banded.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc_id"
    )
    left = dealt.withColumnsRenamed({"doc_id": "a", "block": "block_a"})
    right = dealt.withColumnsRenamed({"doc_id": "b", "block": "block_b"})
    links = left.join(right, ["band", "low", "high"]).where(
        "a < b and (low = high or block_a <> block_b)"
    ).select("a", "b").distinct()
    both = links
    for side in ("a", "b"):
        both = both.join(rows.select(F.col("doc_id").alias(side), F.col("fingerprint").alias(f"f{side}")), side)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shares = likenesses(*_read(batch.column(2).to_pylist()), *_read(batch.column(3).to_pylist()))
                yield batch.select(["a", "b"]).filter(pa.array(shares >= least))

    both = both.select("a", "b", "fa", "fb").mapInArrow(alike, "a bigint, b bigint")
    for side in ("a", "b"):
        both = both.join(text.select(F.col("doc_id").alias(side), F.col("text").alias(f"t{side}")), side)
    return both.select(
        "a", "b", F.levenshtein("ta", "tb", most_edits).alias("edits")
    ).where("edits >= 0").unionByName(copies).distinct()
