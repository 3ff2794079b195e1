"""BPE encoding and decoding through a table of distinct words.

The tokenizer splits at white space whatever stands around it, so the ids of a text are the
ids of its words in order. Words here are the runs between ASCII white space; the tokenizers
library itself encodes each distinct word once, with its normalisation and special tokens.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.shared import documents, one_thread, plain
from bindery.llm.words import with_word_values


def _words() -> Callable[[str], list[bytes]]:
    def split(text: str) -> list[bytes]:
        raw = text.encode()
        # the tokenizer lower-cases all but its special tokens; those all hold "<|"
        return (raw if b"<|" in raw else raw.lower()).split()

    return split


def _encoder(path: str) -> Callable:
    def make():
        one_thread()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def encode(words: list[bytes]) -> list[bytes]:
            found = tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)
            return [" ".join(map(str, e.ids)).encode() for e in found]

        return encode

    return make


def piece_table(path: str) -> dict[int, str]:
    """id -> piece; its size is the vocabulary's."""
    one_thread()
    from tokenizers import Tokenizer

    return {i: p for p, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=True).items()}


def encode_documents(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids`` with ``ids`` an array of token ids, one row per row of ``df``.

    A null text is the empty one, which has no ids; null ids stay null, repeated rows are
    repeated, no rows give no rows; other columns are not read. ``path`` is the tokenizer's
    file, which every executor must have.
    """

    def assembler():
        def make(doc_id, text, words, ids_of):
            ids = np.frombuffer(b"".join(map(ids_of.__getitem__, words)), np.int32)
            return doc_id, len(ids), ids

        return make

    return with_word_values(
        documents(df, id_col, text_col), _words, _encoder(path), assembler,
        "doc_id bigint, n_tokens bigint, ids array<int>",
        prepare=lambda ids: array("i", map(int, ids.split())).tobytes(),
    )


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded`` of ``doc_id, ids`` rows: pieces joined by one space, as the
    tokenizer (which has no decoder of its own) joins them.

    Ids meet their pieces in a join with the piece table, whose size the vocabulary bounds,
    so it may be broadcast. Null or empty ids give the empty text; an id outside of the
    vocabulary has no piece and is left out, as in the library. Rows are numbered within
    their document list, so repeated rows stay apart.
    """
    spark = encoded.sparkSession
    pieces = spark.createDataFrame(list(piece_table(path).items()), "id int, piece string")
    rows = plain(encoded, {"doc_id": "doc_id", "ids": "ids"}).withColumn(
        "row", F.monotonically_increasing_id()
    )
    found = rows.select("row", "doc_id", F.posexplode_outer("ids").alias("at", "id")).join(
        F.broadcast(pieces), "id", "left"
    )
    joined = found.groupBy("row", "doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))).alias("p")
    )
    return joined.select("doc_id", F.array_join("p.piece", " ").alias("decoded"))


def round_trip_digest(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded and again decoded texts.

    Decoding looks every id up in the piece table, once for each distinct word of a pack.
    Cases as in ``encode_documents``.
    """

    def assembler():
        pieces = {str(i).encode(): p.encode() for i, p in piece_table(path).items()}
        decoded: dict[bytes, bytes] = {}

        def decode(ids: bytes) -> bytes:
            found = decoded.get(ids)
            if found is None:
                found = decoded[ids] = b" ".join([pieces[i] for i in ids.split()])
            return found

        def make(doc_id, text, words, ids_of):
            lists = [i for i in map(ids_of.__getitem__, words) if i]
            ids = b" ".join(lists)
            plain_text = b" ".join(map(decode, lists))
            return (
                doc_id, ids.count(b" ") + 1 if ids else 0,
                hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain_text).hexdigest(),
            )

        return make

    return with_word_values(
        documents(df, id_col, text_col), _words, _encoder(path), assembler,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
