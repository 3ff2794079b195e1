"""Sharding by extendible hashing.

Rows hash to a long bit string. A shard is a prefix of it: the shortest one whose rows fit
the byte limit although those of its parent do not. Prefixes that are too large are the only
ones whose rows are looked at again, with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.shared import plain
from bindery.staging import staged

WORD = 60
STEP = 8


def _bits(of: Column) -> Column:
    """60 bits of the md5 of a string, as text."""
    return F.lpad(F.conv(F.substring(F.md5(of), 1, 15), 16, 2), WORD, "0")


def _split(cells: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Shards and buckets still too large, from cells (path, bytes, n) with ``high`` bits.

    Every path in ``cells`` has a prefix of ``low`` bits that is known to be too large (or
    ``low`` is 0). A bucket with one row is final.
    """
    levels = cells.select(
        F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "path", "bytes", "n"
    ).select("depth", F.expr("left(path, depth)").alias("shard"), "bytes", "n")
    sums = levels.groupBy("depth", "shard").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    final = (F.col("bytes") <= limit) | (F.col("n") == 1)
    known = sums.select("*", final.alias("final"))
    parents = known.where(~F.col("final")).select(
        (F.col("depth") + 1).alias("depth"), F.col("shard").alias("above")
    )
    leaves = known.where(F.col("final"))
    nested = leaves.where(F.col("depth") > low).withColumn(
        "above", F.expr("left(shard, depth - 1)")
    ).join(parents, ["depth", "above"], "left_semi").drop("above")
    top = leaves.where(F.col("depth") == low)
    columns = ["shard", "depth", "bytes", "n"]
    return (
        nested.select(*columns).unionByName(top.select(*columns)),
        known.where(~F.col("final") & (F.col("depth") == high)).select("shard"),
    )


def extendible_shards(
    df: DataFrame,
    key_col: str = "doc_id",
    content_cols: tuple[str, ...] = ("text",),
    limit: int = 1 << 20,
) -> DataFrame:
    """One row per input row: ``key, n_bytes, shard, depth, shard_bytes, shard_rows``.

    ``shard`` is the hash prefix as text of 0 and 1 (empty: everything fits one shard).
    ``n_bytes`` is the UTF-8 length of the content columns; null counts as 0, and a null key
    is a key of its own. Rows of one key go on to be split by their content, equal rows by
    a number given to each, so no key keeps a shard above the limit; only a single row that
    is larger by itself does, alone in its shard. No rows give no rows.

    The directory is an aggregate of (prefix, bytes): rows themselves are never grouped, and
    its cells are pre-aggregated in the map tasks. The table that assigns shards is joined,
    not broadcast by hint.
    """
    named = {f"content{i}": c for i, c in enumerate(content_cols)}
    rows = plain(df, {"key": key_col, **named})
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in named), F.lit(0))
    key_text = F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.lit("null"))
    sized = rows.select(
        "key", size.cast("bigint").alias("n_bytes"), _bits(key_text).alias("path"),
        *[F.coalesce(F.md5(F.col(c).cast("binary")), F.lit("null")).alias(c) for c in named],
    )
    content = F.concat_ws(",", *named) if named else F.lit("")
    total = sized.agg(F.sum("n_bytes").alias("bytes")).head()["bytes"] or 0
    open_rows, low = sized, 0
    assigned: DataFrame | None = None
    high = min(WORD, max(0, math.ceil(math.log2(max(total, 1) / limit))) + 4)
    while True:
        cells = open_rows.groupBy(F.expr(f"left(path, {high})").alias("path")).agg(
            F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")
        )
        shards, large = _split(staged(cells, "cells"), low, high, limit)
        shards = staged(
            shards.select(
                "shard", "depth", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows")
            ), "shards"
        )
        large = staged(large, "large")
        # every cell under a shard: its depth lies between low and high
        depths = [r["depth"] for r in shards.select("depth").distinct().collect()]
        if depths or large.isEmpty():
            placed = _assign(open_rows, shards, depths or [0])
            assigned = placed if assigned is None else assigned.unionByName(placed)
        if large.isEmpty():
            return assigned
        rest = open_rows.withColumn("large", F.expr(f"left(path, {high})")).join(
            large.withColumnRenamed("shard", "large"), "large", "left_semi"
        ).select(*sized.columns)
        low = high
        if high == WORD:  # equal keys: go on with the bits of their content
            rest = staged(rest.withColumn("path", F.concat("path", _bits(content))), "rest")
        elif high == 2 * WORD:  # equal rows: each gets a number of its own, fixed by writing it
            number = F.monotonically_increasing_id().cast("string")
            rest = staged(rest.withColumn("path", F.concat("path", _bits(number))), "rest")
        open_rows = rest
        bound = next(w for w in (WORD, 2 * WORD, 3 * WORD) if high < w)
        high = min(bound, high + STEP)


def _assign(rows: DataFrame, shards: DataFrame, depths: list[int]) -> DataFrame:
    """Rows with the shard that is a prefix of their path; at most one is.

    ``depths`` are the few depths that occur, so a row probes a few prefixes.
    """
    prefixes = F.array(*[F.expr(f"left(path, {d})") for d in sorted(depths)])
    probes = rows.select("key", "n_bytes", F.explode(prefixes).alias("shard"))
    return probes.join(shards, "shard").select(
        "key", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows"
    )
