"""Token ids on disk in training order.

Documents are tokenised and cut into sequences of a fixed number of ids. Sequences are numbered
densely, a keyed Feistel permutation of these numbers gives each its global slot, and slots
are laid out one after the other in shards of equal size. A shard is one Parquet row whose
payload has every sequence at ``(slot - first_slot) * stride`` bytes, so training reads slots
in order, starts again at any slot, and asks ``sequence_at`` for what stands in a slot.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.shared import bounded_batches, documents, partitions
from bindery.llm.token_counts import SPACE, unit_text, units_of
from bindery.staging import shared_folder

SEQUENCE = 512
SHARD_ROWS = 8192
ROUNDS = 6
PAD = 0

_KEPT_UNITS = 600_000


class Feistel:
    """A keyed permutation of 0 .. n-1.

    A balanced Feistel network permutes the next even power of two; numbers that fall outside
    of 0 .. n-1 are put through it again until they fall inside (cycle walking; fewer than four
    times on average), which keeps it a permutation.
    """

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.default_rng(key).integers(0, 2**63, ROUNDS, dtype=np.uint64)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ self._mix(right, k)
        # halves are swapped at the end, so that the reversed keys undo it
        return (right << np.uint64(self.half)) | left

    def _walk(self, numbers, keys: np.ndarray) -> np.ndarray:
        x = self._once(np.asarray(numbers, np.uint64), keys)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slots(self, numbers) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def numbers(self, slots) -> np.ndarray:
        return self._walk(slots, self.keys[::-1])


class UnitIds:
    """Ids of texts as bytes of 16-bit numbers, from units that are remembered; the memory is
    cleared when it is full. New units of a batch go to the library together."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if self.model.get_piece_size() > 1 << 16:
            raise ValueError("ids of this model do not fit 16 bits")
        self.end = array("H", [self.model.eos_id()]).tobytes()
        self.mark = array("H", [self.model.piece_to_id(SPACE)]).tobytes()
        self.known: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        # the library puts a space mark in front, which units that have one of their own leave out
        texts = [unit_text(u) for u in new]
        asked = [(t[1:] if t[0] == SPACE else t).replace(SPACE, " ") for t in texts]
        for unit, text, ids in zip(new, texts, self.model.encode(asked, num_threads=1), strict=True):
            own = array("H", ids if text[0] == SPACE else ids[1:]).tobytes()
            self.known[unit] = self.mark if text == SPACE else own

    def of(self, texts: list[str]) -> list[bytes]:
        units = list(map(units_of, texts))
        if len(self.known) > _KEPT_UNITS:
            self.known.clear()
        self._learn(list(set().union(*units).difference(self.known)))
        ids = self.known.__getitem__
        return [b"".join(map(ids, u)) + self.end for u in units]


def _tokenised(docs: DataFrame, path: str, sequence: int) -> DataFrame:
    """(part, first, n_sequences, doc_id, ids), written once: ``first`` numbers the sequences of
    the task that wrote them, so numbers stand for the rows that are on disk."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, first, part = UnitIds(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            doc_ids, texts = (c.to_pylist() for c in batch.columns)
            ids = ids_of.of(texts)
            counts = [-(-len(i) // (2 * sequence)) for i in ids]
            ends = list(accumulate(counts, initial=first))
            first = ends[-1]
            yield pa.record_batch({
                "part": pa.array([part] * len(ids), pa.int32()), "first": pa.array(ends[:-1], pa.int64()),
                "n_sequences": pa.array(counts, pa.int64()),
                "doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(ids, pa.binary()),
            })

    spark = docs.sparkSession
    place = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    schema = "part int, first bigint, n_sequences bigint, doc_id bigint, ids binary"
    docs.mapInArrow(run, schema).write.option("compression", "zstd").parquet(place)
    return spark.read.schema(schema).parquet(place)


def write_shards(
    df: DataFrame, path: str, tokenizer: str, key: int = 0, sequence: int = SEQUENCE,
    shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text",
) -> int:
    """Write the shards of ``df`` to ``path`` (Parquet) and return the number of sequences.

    Every document ends with the end id; its last sequence is padded with id 0. So a null or
    empty text is one sequence with one id. Null ids stay null, repeated rows get sequences of
    their own, no rows write an empty table; other columns are not read. Two things are gathered:
    a count per written part, and the total.
    """
    spark = df.sparkSession
    tokens = _tokenised(documents(df, id_col, text_col), tokenizer, sequence)
    counts = tokens.groupBy("part").agg(F.sum("n_sequences").alias("n")).orderBy("part").collect()
    base = dict(zip([r["part"] for r in counts], accumulate([r["n"] for r in counts], initial=0)))
    total = sum(r["n"] for r in counts)
    stride = 2 * sequence

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Feistel(total, key)
        for batch in batches:
            part, first, n, doc_id, ids = (c.to_pylist() for c in batch.columns)
            numbers, owners, at, used, records = [], [], [], [], []
            for p, f, k, d, data in zip(part, first, n, doc_id, ids, strict=True):
                for i in range(k):
                    record = data[i * stride:(i + 1) * stride]
                    numbers.append(base[p] + f + i)
                    owners.append(d)
                    at.append(i)
                    used.append(len(record) // 2)
                    records.append(record.ljust(stride, PAD.to_bytes()))
            slots = order.slots(numbers) if numbers else np.empty(0, np.int64)
            yield pa.record_batch({
                "shard": pa.array(slots // shard_rows, pa.int64()), "slot": pa.array(slots, pa.int64()),
                "doc_id": pa.array(owners, pa.int64()), "sequence": pa.array(at, pa.int64()),
                "n_tokens": pa.array(used, pa.int32()), "record": pa.array(records, pa.binary()),
            })

    fields = ("shard", "slot", "doc_id", "sequence", "n_tokens", "record")

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []

        def done():
            slot, doc_id, at, used, records = zip(*rows, strict=True)
            if slot != tuple(range(shard * shard_rows, shard * shard_rows + len(rows))):
                raise ValueError(f"slots of shard {shard} are not complete")
            return pa.record_batch({
                "shard": pa.array([shard], pa.int64()), "first_slot": pa.array([slot[0]], pa.int64()),
                "n_rows": pa.array([len(rows)], pa.int32()), "stride": pa.array([stride], pa.int32()),
                "doc_ids": pa.array([doc_id], pa.list_(pa.int64())),
                "sequences": pa.array([at], pa.list_(pa.int64())),
                "n_tokens": pa.array([used], pa.list_(pa.int32())),
                "payload": pa.array([b"".join(records)], pa.binary()),
            })

        for batch in batches:
            for s, *row in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                if s != shard and rows:
                    yield done()
                    rows = []
                shard = s
                rows.append(row)
        if rows:
            yield done()

    bounded_batches(spark)
    sequences = tokens.mapInArrow(
        placed, "shard bigint, slot bigint, doc_id bigint, sequence bigint, n_tokens int, record binary"
    )
    # even ranges of shards, known from the total: files in order hold slots in order, and
    # nothing is sampled to find the ranges
    n_shards, n = max(1, -(-total // shard_rows)), partitions(spark)
    place = F.floor(F.col("shard") * n / n_shards).cast("int")
    shards = sequences.repartitionById(n, place).sortWithinPartitions("shard", "slot").mapInArrow(
        laid_out,
        "shard bigint, first_slot bigint, n_rows int, stride int, doc_ids array<bigint>, "
        "sequences array<bigint>, n_tokens array<int>, payload binary",
    )
    shards.write.option("compression", "zstd").parquet(path)
    return total


def read_sequences(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """``slot, shard, byte_offset, doc_id, sequence, n_tokens, record`` from a slot on; shards
    before it are not read."""
    shards = spark.read.parquet(path).where(F.col("first_slot") + F.col("n_rows") > from_slot)
    fields = ("shard", "first_slot", "n_rows", "stride", "doc_ids", "sequences", "n_tokens", "payload")
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, n, stride = (batch.column(c)[i].as_py() for c in range(4))
                payload = pa.py_buffer(batch.column(7)[i].as_buffer())
                ends = pa.py_buffer(np.arange(0, (n + 1) * stride, stride, dtype=np.int32))
                at = np.arange(n, dtype=np.int64)
                rows = pa.record_batch({
                    "slot": pa.array(first + at), "shard": pa.array(np.full(n, shard)),
                    "byte_offset": pa.array(at * stride), "doc_id": batch.column(4)[i].values,
                    "sequence": batch.column(5)[i].values, "n_tokens": batch.column(6)[i].values,
                    "record": pa.BinaryArray.from_buffers(pa.binary(), n, [None, ends, payload]),
                })
                for begin in range(max(0, from_slot - first), n, 1024):
                    yield rows.slice(begin, 1024)

    return shards.select(*fields).mapInArrow(
        run,
        "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, sequence bigint, n_tokens int, record binary",
    )


def sequence_at(slots, total: int, key: int = 0) -> np.ndarray:
    """Numbers of the sequences that stand in ``slots``."""
    return Feistel(total, key).numbers(slots)
