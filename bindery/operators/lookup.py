"""Joining stored vectors and labels to rows by key."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.staging import staged

# What runs in tasks travels with the job, as executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOT_SHARE = 64


def first_occurrence(store: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one that is first in ``order``. Combines before it shuffles."""
    rest = [c for c in store.columns if c not in key]
    kept = store.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return kept.select(*key, *[f"_first.{c}" for c in rest])


def hot_keys(df: DataFrame, key: Sequence[str], share: int | None = None) -> list[tuple]:
    """Keys that hold more than 1/share of all rows: fewer than ``share`` of them exist.

    A quarter of a shuffle partition's even part is the limit unless ``share`` is given.
    """
    return hot_keys_by(df, {"key": list(key)}, share)["key"]


def hot_keys_by(
    df: DataFrame, keys: dict[str, Sequence[str]], share: int | None = None
) -> dict[str, list[tuple]]:
    """``hot_keys`` for several keys by name, all from one pass that shuffles no rows.

    A frequent-item sketch of the hashes names every key above the limit (its error is below a
    quarter of that) and perhaps others; only the rows of these are then counted exactly.
    """
    if share is None:
        share = max(HOT_SHARE, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashes = {name: F.xxhash64(*key) for name, key in keys.items()}
    kept, tracked = 2 * share, min(1_000_000, 1 << (16 * share - 1).bit_length())
    hashed = df.select(*[h.alias(f"_h{i}") for i, h in enumerate(hashes.values())])
    sketch = hashed.agg(F.count("*").alias("n"), *[
        F.expr(f"approx_top_k(_h{i}, {min(kept, tracked)}, {tracked})").alias(f"t{i}") for i in range(len(keys))
    ]).first()
    found = {}
    for i, (name, key) in enumerate(keys.items()):
        likely = [t["item"] for t in sketch[f"t{i}"] or [] if 2 * t["count"] * share > sketch["n"]]
        rows = []
        if likely:
            counts = df.where(hashes[name].isin(likely)).groupBy(*key).agg(F.count("*").alias("_n"))
            rows = counts.where(F.col("_n") * share > sketch["n"]).collect()
        found[name] = [tuple(r[c] for c in key) for r in sorted(rows, key=lambda r: -r["_n"])]
    return found


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    how: str = "inner",
    hot: Sequence[tuple] | None = None,
    salts: int = HOT_SHARE,
    row: str | None = None,
) -> DataFrame:
    """Equi join (inner or left) that splits the rows of hot keys of the left side.

    Rows of a hot key get one of ``salts`` numbers by their position and the matching right
    rows are repeated for each number; all other rows join as usual. ``hot`` is looked
    up in the left rows unless it is given. ``row`` names a column that numbers the rows, as
    ``numbered_rows`` adds it; without one the left side is written with its numbers if there
    are hot keys, so that a task that runs again finds the same ones.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, list(key), how)
    out = [*left.columns, *[c for c in right.columns if c not in key]]
    if row is None:
        row, left = "_row", numbered_rows(left)
    keys = [f"_hot_{c}" for c in key]
    types = ", ".join(f"`_hot_{c}` {left.schema[c].dataType.simpleString()}" for c in key)
    listed = left.sparkSession.createDataFrame(list(hot), types).withColumn("_is_hot", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(key, keys)])

    def marked(side: DataFrame) -> DataFrame:  # as many rows as hot_keys may return
        return side.join(F.broadcast(listed), same, "left").drop(*keys)

    spot = F.pmod(F.col(row), F.lit(salts)).cast("int")
    salted = marked(left).withColumn("_salt", F.when(F.col("_is_hot"), spot).otherwise(F.lit(0)))
    copies = F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
    repeated = marked(right).withColumn("_salt", F.explode(F.coalesce(copies, F.array(F.lit(0)))))
    joined = salted.drop("_is_hot").join(repeated.drop("_is_hot"), [*key, "_salt"], how)
    return joined.select(*out)


def numbered_rows(df: DataFrame, row: str = "_row") -> DataFrame:
    """``df`` written once with a number for each row."""
    return staged(df.withColumn(row, F.monotonically_increasing_id()), "numbered")


def checked_dim(store: DataFrame, vector: str = "vec") -> int:
    """The common vector length of a store; an error when lengths differ."""
    row = store.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).first()
    if row["lo"] != row["hi"]:
        raise ValueError(f"vectors of different length: {row['lo']} to {row['hi']}")
    return row["lo"] or 0


def with_vectors(
    pairs: DataFrame, receptors: DataFrame, peptides: DataFrame, drop_missing: bool = False,
    order: str | None = None,
) -> DataFrame:
    """Add ``receptor_vec`` and ``peptide_vec`` by sequence.

    ``receptors(cdr3, vec)`` and ``peptides(peptide, vec)`` hold vectors by sequence; of
    several for one sequence the first by ``order`` is taken, or the least without ``order``.
    A pair without a vector is an error that shows five examples, or is dropped.
    """
    receptors, peptides = _one_vector(receptors, "cdr3", order), _one_vector(peptides, "peptide", order)
    if not drop_missing:
        for store, column in ((receptors, "cdr3"), (peptides, "peptide")):
            _raise_missing(pairs, store, column)
    # Hot keys are looked up in the pairs, not in the joined rows with their vectors.
    hot = hot_keys_by(pairs, {"cdr3": ["cdr3"], "peptide": ["peptide"]})
    columns = pairs.columns
    row = "_row" if any(hot.values()) else None
    joined = numbered_rows(pairs) if row else pairs
    for store, column, name in ((receptors, "cdr3", "receptor_vec"), (peptides, "peptide", "peptide_vec")):
        vectors = store.select(column, F.col("vec").alias(name))
        joined = spread_join(joined, vectors, [column], hot=hot[column], row=row)
    return joined.select(*columns, "receptor_vec", "peptide_vec")


def _one_vector(store: DataFrame, column: str, order: str | None) -> DataFrame:
    one = F.min_by("vec", order) if order else F.min("vec")
    return store.groupBy(column).agg(one.alias("vec"))


class MissingVectors(KeyError):
    """Pairs whose sequences have no vector in a store."""


def missing_keys(pairs: DataFrame, store: DataFrame, column: str) -> DataFrame:
    """Sequences without a vector and the rows that need them."""
    needed = pairs.groupBy(column).agg(F.count("*").alias("n_rows"))
    return needed.join(store.select(column), column, "left_anti")


def _raise_missing(pairs: DataFrame, store: DataFrame, column: str) -> None:
    lacking = missing_keys(pairs, store, column)
    total = lacking.agg(F.sum("n_rows")).first()[0]
    if total:
        shown = ", ".join(str(r[0]) for r in lacking.orderBy(column).limit(5).collect())
        raise MissingVectors(f"{total} rows without a {column} vector. Examples: {shown}")


def vector_coverage(pairs: DataFrame, receptors: DataFrame, peptides: DataFrame) -> DataFrame:
    """Rows in all, with a receptor vector, with a peptide vector, and with both.

    Counted per distinct sequence pair first, so no vector and no hot key is shuffled.
    """
    cells = pairs.groupBy("cdr3", "peptide").agg(F.count("*").alias("n"))
    have_r = receptors.select("cdr3", F.lit(1).alias("_r"))
    have_p = peptides.select("peptide", F.lit(1).alias("_p"))
    marked = cells.join(have_r, "cdr3", "left").join(have_p, "peptide", "left")
    rows = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    r, p = F.col("_r").isNotNull(), F.col("_p").isNotNull()
    return marked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), rows(r).alias("with_receptor"),
        rows(p).alias("with_peptide"), rows(r & p).alias("with_both"),
    )


def residue_store(store: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Per key the first row that has residues (``length > 0``)."""
    return first_occurrence(store.filter(F.col("length") > 0), key, order)


def with_residues(pairs: DataFrame, store: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Pairs with their residue vectors; pairs without any are dropped."""
    slim = residue_store(store, key, order).select(*key, "residues", "length")
    return spread_join(pairs, slim, key)


def dropped_rows(pairs: DataFrame, store: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows in all and rows that ``with_residues`` drops."""
    have = store.filter(F.col("length") > 0).select(*key).distinct().withColumn("_has", F.lit(1))
    needed = pairs.groupBy(*key).agg(F.count("*").alias("n"))
    marked = needed.join(have, list(key), "left")
    return marked.agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_has").isNull(), F.col("n"))), F.lit(0)).alias("n_dropped"),
    )


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join after making sure that the key is unique on both sides."""
    for side, df in (("left", left), ("right", right)):
        twice = df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        if not twice.isEmpty():
            raise ValueError(f"{key} is not unique on the {side} side")
    return left.join(right, key)


def with_labels(test: DataFrame, solutions: DataFrame) -> DataFrame:
    """Test rows with ``label`` (int) and ``usage`` from the solutions, matched by ``id``."""
    for name, df in (("test", test), ("solutions", solutions)):
        if "id" not in df.columns:
            raise ValueError(f"the {name} table needs an id column, it has {df.columns[:6]}")
    kept = [c for c in ("id", "label", "usage") if c in solutions.columns]
    merged = one_to_one(test, solutions.select(*kept), "id")
    return merged.withColumn("label", F.col("label").cast("int"))


def align_by_row(store: DataFrame, full: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Metadata of the very row each vector was made from."""
    columns = [c for c in full.columns if c == row_id or c not in store.columns]
    return store.join(full.select(*columns), row_id)


def align_by_pair(store: DataFrame, full: DataFrame, order: str) -> DataFrame:
    """Metadata by (cdr3, peptide), from the first such row; vectors without one stay."""
    key = ["cdr3", "peptide"]
    columns = [c for c in full.columns if c in key or c not in store.columns]
    first = first_occurrence(full, key, order)
    return store.join(first.select(*columns), key, "left")


def by_length(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """Rows spread by sequence length and sorted inside each partition.

    Batches then hold sequences of similar length, which keeps padding small. The
    sequence is part of the order, so many rows of one length still spread out.
    """
    length = F.length(column)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, length, F.col(column)).sortWithinPartitions(length)


def within_budget(
    frames: Iterator[pd.DataFrame], texts: Sequence[str], budget: int | None
) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in order, in pieces whose number of rows times the sum of their longest
    texts stays within ``budget``; a row beyond it is a piece of its own."""
    for frame in frames:
        if budget is None or not texts:
            yield frame
            continue
        sizes = frame[list(texts)].apply(lambda c: c.str.len().fillna(0).astype("int64")).to_numpy()
        begin, longest = 0, [0] * len(texts)
        for i, row in enumerate(sizes):
            wider = [max(a, b) for a, b in zip(longest, row, strict=True)]
            if i > begin and sum(wider) * (i + 1 - begin) > budget:
                yield frame.iloc[begin:i]
                begin, wider = i, list(row)
            longest = wider
        if len(frame) > begin:
            yield frame.iloc[begin:]


def encode_distinct(
    df: DataFrame,
    column: str,
    encoder: Callable[[pd.Series], pd.DataFrame],
    schema: T.StructType | str,
    budget: int | None = None,
) -> DataFrame:
    """Run a user's encoder once per distinct sequence and join the result to all rows.

    ``encoder`` maps a batch of sequences to one row each, in order, with the columns of
    ``schema``. Empty and null sequences are not encoded. With ``budget`` a batch has at most so many
    residues, padded to its longest sequence; a longer sequence is a batch by itself.
    """
    words = df.select(column).filter(F.col(column).isNotNull() & (F.col(column) != "")).distinct()
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = T.StructType([T.StructField(column, T.StringType()), *fields.fields])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in within_budget(frames, [column], budget):
            encoded = encoder(frame[column]).reset_index(drop=True)
            if len(encoded) != len(frame):
                raise ValueError(f"encoder gave {len(encoded)} rows for {len(frame)} sequences")
            yield pd.concat([frame[[column]].reset_index(drop=True), encoded], axis=1)

    encoded = by_length(words, column).mapInPandas(batches, out)
    return spread_join(df, encoded, [column], "left")


def score_batches(
    df: DataFrame,
    predict: Callable[[pd.DataFrame], pd.Series],
    inputs: Sequence[str],
    score: str = "score",
    budget: int | None = None,
) -> DataFrame:
    """Add the score that a user's function gives each batch of rows.

    With ``budget`` a batch has at most so many residues in its text inputs, each padded to its
    longest; a larger row is a batch by itself. Sort by length first (``by_length``) to pad little.
    """
    keep = list(df.columns)
    out = T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())])

    texts = [c for c in inputs if df.schema[c].dataType == T.StringType()]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in within_budget(frames, texts, budget):
            result = frame[keep].copy()
            result[score] = pd.Series(predict(frame[list(inputs)])).to_numpy(dtype="float64")
            yield result

    return df.mapInPandas(batches, out)


def feature_table(pairs: DataFrame, extra: Column | None = None) -> DataFrame:
    """Receptor vector, peptide vector and, if given, one more, as one ``features`` array."""
    parts = [F.col("receptor_vec"), F.col("peptide_vec")]
    return pairs.withColumn("features", F.concat(*parts, *([extra] if extra is not None else [])))
