"""Column expressions on number arrays and on arrays of residue vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.constants import PAD_SYMBOL, PAIRED_LENGTH, RESIDUES, UNKNOWN_SYMBOL
from bindery.functions.text import residue_ids

SYMBOLS = len(RESIDUES) + 2


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _range(n: int | Column) -> Column:
    """0 .. n-1, empty for n = 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def indicator(index: Column, size: int) -> Column:
    """``size`` zeros with a one at ``index``; all zero when the index is null."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.when(i == index, 1.0).otherwise(0.0).cast("float"),
    ) if size else F.array().cast("array<float>")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A plain expression inside a lambda is computed again for every element; bound as the
    variable of an outer one-element transform it is not.
    """
    return F.get(F.transform(F.array(value), use), 0)


def one_hot_sequence(seq: str | Column, max_len: int) -> Column:
    """A sequence as ``max_len`` blocks of 22 numbers, one of them 1 (padding included)."""
    # Written as one literal: 484 separate column objects would take seconds to build.
    rows = (", ".join("1F" if i == x else "0F" for i in range(SYMBOLS)) for x in range(SYMBOLS))
    blocks = F.expr(f"array({', '.join(f'array({row})' for row in rows)})")
    return F.flatten(F.transform(residue_ids(seq, max_len), lambda x: F.get(blocks, x)))


def ones_text(vec: str | Column) -> Column:
    """The places of the ones of a vector as comma text, null for null.

    NumPy looks through whole batches, as a lambda takes 0.1 microseconds for each number.
    """

    @F.arrow_udf("string")
    def places(vecs: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(vecs), 0).to_numpy(zero_copy_only=False))
        hits = np.flatnonzero(vecs.flatten().to_numpy(zero_copy_only=False) == 1)
        row = np.searchsorted(ends, hits, side="right")
        inside = hits - np.concatenate([[0], ends])[row]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(vecs)))])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(inside, pa.int64()).cast(pa.string()))
        return pc.if_else(vecs.is_null(), pa.scalar(None, pa.string()), pc.binary_join(lists, ","))

    return places(_col(vec))


def decode_one_hot(vec: str | Column, max_len: int) -> Column:
    """The sequence a one-hot vector stands for, without padding; null for null.

    Each block of 22 numbers is the symbol at its first greatest number; NumPy reads whole batches.
    """
    symbols = np.frombuffer((PAD_SYMBOL + RESIDUES + UNKNOWN_SYMBOL).encode("ascii"), np.uint8)
    width = len(symbols)

    @F.arrow_udf("string")
    def letters(vecs: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(vecs)
        for size in pc.unique(sizes).to_pylist():
            if size not in (None, max_len * width):
                raise ValueError(f"vector length is not {max_len}*{width}: {size}")
        numbers = pc.fill_null(vecs.flatten(), float("-inf")).to_numpy(zero_copy_only=False)
        spots = numbers.reshape(-1, max_len, width).argmax(axis=2)
        kept = spots != 0
        held = np.zeros(len(vecs), np.int64)
        held[vecs.is_valid().to_numpy(zero_copy_only=False)] = kept.sum(axis=1)
        offsets = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
        buffers = pa.py_buffer(offsets), pa.py_buffer(symbols[spots[kept]].tobytes())
        text = pa.StringArray.from_buffers(len(vecs), *buffers)
        return pc.if_else(vecs.is_null(), pa.scalar(None, pa.string()), text)

    return letters(_col(vec))


def unfold(vec: str | Column, length: int, channels: int) -> Column:
    """A flat vector as ``length`` positions of ``channels`` numbers."""
    vec = _col(vec)
    wrong = F.raise_error(
        F.concat(F.lit(f"vector length is not {length}*{channels}: "), F.size(vec).cast("string"))
    )
    checked = F.when(F.size(vec) == length * channels, vec).otherwise(wrong.cast("array<float>"))
    starts = F.sequence(F.lit(0), F.lit(length - 1))
    return once(checked, lambda v: F.transform(starts, lambda i: F.slice(v, i * channels + 1, channels)))


def channels_first(positions: Column, channels: int) -> Column:
    """Positions × channels turned into channels × positions."""
    places = F.sequence(F.lit(0), F.lit(channels - 1))
    return once(positions, lambda ps: F.transform(places, lambda c: F.transform(ps, lambda p: F.get(p, c))))


def span(residues: str | Column, start: str | Column, end: str | Column) -> Column:
    """``residues[start:end]``, half-open from 0; null without a span."""
    start, end = _col(start), _col(end)
    return F.when(
        start.isNotNull() & end.isNotNull(),
        F.slice(_col(residues), start + 1, F.greatest(end - start, F.lit(0))),
    )


def truncated(residues: str | Column, max_len: int) -> Column:
    return F.slice(_col(residues), 1, max_len)


def length_of(residues: str | Column) -> Column:
    """Number of residue vectors, 0 for null (whatever the session's rule for ``size``)."""
    residues = _col(residues)
    return F.when(residues.isNotNull(), F.size(residues)).otherwise(F.lit(0))


def kept_length(residues: str | Column, max_len: int) -> Column:
    """Number of residue vectors kept, 0 when there are none."""
    return F.least(length_of(residues), F.lit(max_len))


def _pooled(residues: str | Column, one: Callable[[Column, Column], Column]) -> Column:
    """``one(residues, d)`` for every dimension d; null when there are no residues."""
    def use(rs: Column) -> Column:
        dims = _range(F.size(F.get(rs, 0)))
        return F.when(F.size(rs) > 0, F.transform(dims, lambda d: one(rs, d)))

    return once(_col(residues), use)


def mean_pool(residues: str | Column) -> Column:
    """Element-wise mean of the residue vectors; null when there are none."""
    def mean(rs: Column, d: Column) -> Column:
        return F.aggregate(rs, F.lit(0.0), lambda a, r: a + F.get(r, d).cast("double")) / F.size(rs)

    return _pooled(residues, mean)


def max_pool(residues: str | Column) -> Column:
    """Element-wise maximum of the residue vectors; null when there are none."""
    return _pooled(
        residues, lambda rs, d: F.array_max(F.transform(rs, lambda r: F.get(r, d).cast("double")))
    )


def masked_mean(residues: str | Column, mask: str | Column, width: int) -> Column:
    """Element-wise mean over positions with mask 1; zeros when no position has it."""
    kept = F.filter(F.arrays_zip(_col(residues).alias("r"), _col(mask).alias("m")), lambda x: x["m"] == 1)
    rows = F.transform(kept, lambda x: x["r"])
    zeros = F.array_repeat(F.lit(0.0), width)
    return F.coalesce(mean_pool(rows), zeros)


def paired_residues(alpha: Column, beta: Column, max_len: int) -> Column:
    """Alpha then beta residue vectors, cut at ``max_len``; a missing chain adds nothing."""
    none = F.array().cast("array<array<float>>")
    return F.slice(F.concat(F.coalesce(alpha, none), F.coalesce(beta, none)), 1, max_len)


def beta_slice(paired: str | Column, alpha_len: str | Column, beta_len: str | Column, max_len: int) -> Column:
    """The beta part of a paired array, from where the stored alpha part really ends."""
    return F.slice(_col(paired), _col(alpha_len) + 1, F.least(_col(beta_len), F.lit(max_len)))


def appended(*vectors: str | Column) -> Column:
    """Vectors end to end."""
    return F.concat(*[_col(v) for v in vectors])


def text_of(vec: str | Column) -> Column:
    """Whole numbers as comma text, for reports."""
    return F.array_join(F.transform(_col(vec), lambda x: x.cast("int").cast("string")), ",")


def paired_core_vectors(
    alpha: tuple[str, str, str], beta: tuple[str, str, str], max_len: int = PAIRED_LENGTH
) -> dict[str, Column]:
    """Columns for the two CDR3s of a pair, from the residue vectors of its full chains.

    ``alpha`` and ``beta`` name a CDR3, the full chain it stands in and the chain's residue
    vectors. Each CDR3 is located in its chain and its vectors are cut out: ``pooled`` is the
    mean of alpha's followed by that of beta's, ``residues`` are both, cut at ``max_len``, and
    ``alpha_len`` and ``beta_len`` say how many of each there are. A CDR3 that does not stand in
    its chain, or beyond the stored vectors, makes the row ``misaligned``; its ``pooled`` is null.
    """
    parts = []
    for core, full, stored in (alpha, beta):
        at = F.instr(_col(full), _col(core)) - 1
        at = F.when((F.length(core) > 0) & (at >= 0), at)
        parts.append(span(stored, at, at + F.length(core)))
    whole = [
        (length_of(p) == F.length(names[0])) & (F.length(names[0]) > 0)
        for p, names in zip(parts, (alpha, beta))
    ]
    aligned = F.coalesce(whole[0] & whole[1], F.lit(False))
    return {
        "pooled": F.when(aligned, F.concat(mean_pool(parts[0]), mean_pool(parts[1]))),
        "residues": paired_residues(parts[0], parts[1], max_len),
        "alpha_len": length_of(parts[0]),
        "beta_len": length_of(parts[1]),
        "misaligned": ~aligned,
    }
