"""A value for every distinct word of a corpus, brought back to the documents.

Three stages, each bounded by one pack or one hash range of the words:

1. Documents are put into packs of about ``PACK_CHARS`` characters, which travel compressed.
2. Each pack lists its distinct words, divided by the hash range a word belongs to. The task
   that owns a range holds the table of its distinct words and computes each value once.
3. Packs meet the values of their own words, and rows are made document by document.

A frequent word occurs once in each pack's list, so no word and no document is a hot key; the
cost of stage 2 follows distinct words per pack, not words.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from bindery.llm.shared import bounded_batches, partitions

PACK_CHARS = 8_000_000


def _packed(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    codec = pa.Codec("zstd", compression_level=6)
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as w:
        w.write_batch(batch)
    return out.getvalue()


def _joined(parts: list[bytes], between: bytes) -> bytes:
    """Compressed text of ``parts``, none of which holds ``between``."""
    return zstandard.ZstdCompressor(level=9).compress(between.join(parts))


def _parted(data: bytes, between: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(between)


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _pack_rows(doc_ids: list, texts: list) -> pa.RecordBatch:
    data = _packed(pa.record_batch(
        {"doc_id": pa.array(doc_ids, pa.int64()), "text": pa.array(texts, pa.large_string())}
    ))
    # the name is the content's digest: a task that runs again gives the same packs, and packs
    # that changed would find no words, which is an error and not a wrong result
    name = hashlib.blake2b(data, digest_size=16).digest()
    return pa.record_batch({"pack": pa.array([name], pa.binary()), "data": pa.array([data], pa.binary())})


def packs(docs: DataFrame) -> DataFrame:
    """(pack, data) of (doc_id, text) rows, spread by pack; a longer text is a pack by itself."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if texts and size + len(text) > PACK_CHARS:
                    yield _pack_rows(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
                doc_ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield _pack_rows(doc_ids, texts)

    return docs.mapInArrow(run, "pack binary, data binary").repartition(partitions(spark), "pack")


def with_word_values(
    docs: DataFrame,
    splitter: Callable[[], Callable[[str], list[bytes]]],
    encoder: Callable[[], Callable[[list[bytes]], list[bytes]]],
    assembler: Callable[[], Callable[[int, str, list[bytes], dict[bytes, bytes]], tuple]],
    schema: str,
    prepare: Callable[[bytes], object] | None = None,
) -> DataFrame:
    """Rows of ``schema`` for (doc_id, text) rows, one each.

    ``splitter`` gives a text's words in order, none with a blank in it, and ``encoder`` the
    values of distinct words, none with a line feed in it;
    ``assembler`` the row of a document from its words and the values of its pack's words
    (each passed through ``prepare`` once a pack). Each of them is a factory, called once a
    task. No rows give no rows.
    """
    spark = docs.sparkSession
    spread = packs(docs)
    ranges = partitions(spark)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in batches:
            for name, data in zip(*(batch.column(c).to_pylist() for c in ("pack", "data")), strict=True):
                distinct: set[bytes] = set()
                for text in _unpacked(data).column("text"):
                    distinct.update(split(text.as_py()))
                owned: dict[int, list[bytes]] = {}
                for word in distinct:
                    owned.setdefault(zlib.crc32(word) % ranges, []).append(word)
                for part, words in owned.items():
                    words.sort()
                    yield pa.record_batch({
                        "part": pa.array([part], pa.int32()), "pack": pa.array([name], pa.binary()),
                        "words": pa.array([_joined(words, b" ")], pa.binary()),
                    })

    def values_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for name, listed in zip(*(batch.column(c).to_pylist() for c in ("pack", "words")), strict=True):
                words = _parted(listed, b" ")
                new = [w for w in words if w not in known]
                known.update(zip(new, encode(new), strict=True))
                coded = _joined([known[w] for w in words], b"\n")
                yield pa.record_batch({
                    "pack": pa.array([name], pa.binary()), "words": pa.array([listed], pa.binary()),
                    "coded": pa.array([coded], pa.binary()),
                })

    target = spark.createDataFrame([], schema).schema

    def rows_of(pack: pa.Table, values: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        split, make = splitter(), assembler()
        value: dict[bytes, object] = {}
        for listed, coded in zip(*(values.column(c).to_pylist() for c in ("words", "coded")), strict=True):
            found = _parted(coded, b"\n")
            value.update(zip(_parted(listed, b" "), map(prepare, found) if prepare else found, strict=True))
        rows = []
        for data in pack.column("data").to_pylist():
            whole = _unpacked(data)
            for doc_id, text in zip(whole.column("doc_id"), whole.column("text"), strict=True):
                text = text.as_py()
                rows.append(make(doc_id.as_py(), text, split(text), value))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
        return pa.Table.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
        )

    listed = spread.mapInArrow(words_of, "part int, pack binary, words binary")
    coded = listed.repartition(ranges, "part").mapInArrow(values_of, "pack binary, words binary, coded binary")
    return spread.groupBy("pack").cogroup(coded.groupBy("pack")).applyInArrow(rows_of, target)
