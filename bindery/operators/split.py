"""Train / val / test splits and stratified samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.operators.order import hash_text, hashed_rank, running_totals, take_hashed


@dataclass(frozen=True)
class HoldoutRule:
    """Keys up to the first cut are test, up to the second val, the rest train.

    Keys are compared by ``(md5(seed|key), key)``, so a split is a plain expression on
    the row: applying it to a table of any size moves no data.
    """

    key: str
    seed: int
    test_cut: tuple[str, str]
    val_cut: tuple[str, str]

    def column(self) -> Column:
        spot = F.struct(hash_text(self.seed, self.key), F.col(self.key).cast("string"))
        upto = lambda cut: spot <= F.struct(F.lit(cut[0]), F.lit(cut[1]))
        return F.when(upto(self.test_cut), "test").when(upto(self.val_cut), "val").otherwise("train")


def holdout_rule(
    df: DataFrame, key: str, test_frac: float = 0.2, val_frac: float = 0.1, seed: int = 42
) -> HoldoutRule:
    """Find the cuts that put the given share of distinct keys into test and val.

    One job over the distinct keys that returns at most two of them. Both shares are
    rounded half to even and at least one key.
    """
    keys = df.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct()
    ranked = hashed_rank(keys, [], [key], seed, "r", "n")
    share = lambda frac: F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(float(frac))))
    n_test, n_val = share(test_frac), share(val_frac)
    ends = ranked.filter((F.col("r") == n_test) | (F.col("r") == F.least(F.col("n"), n_test + n_val)))
    rows = ends.select(hash_text(seed, key).alias("h"), key).orderBy("h", key).take(2)
    if not rows:
        raise ValueError("nothing to split: the table has no key")
    return HoldoutRule(key, seed, tuple(rows[0]), tuple(rows[-1]))


def holdout(
    df: DataFrame, key: str, test_frac: float = 0.2, val_frac: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add ``split`` so that no key is in two splits (``key`` is ``peptide`` or ``cdr3``)."""
    rule = holdout_rule(df, key, test_frac, val_frac, seed)
    return df.withColumn("split", rule.column())


def random_split(
    df: DataFrame, test_frac: float = 0.2, val_frac: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add ``split`` by row: the test part is rounded up, then val from what remains.

    The hashes alone are ranked to find the two cuts; rows are then assigned by comparing
    their hash, so the table itself is not shuffled. Only when a cut falls between copies
    of one row are the rows ranked, to keep the sizes exact.
    """
    rescaled = val_frac / (1.0 - test_frac)
    n_test = F.ceil(F.col("_n") * F.lit(float(test_frac)))
    n_val = F.ceil((F.col("_n") - n_test) * F.lit(rescaled))
    hashes = df.select(hash_text(seed, *df.columns).alias("_h"))
    hashes = hashes.withColumn("_cell", F.substring("_h", 1, 3))
    ranked = running_totals(hashes, [], "_cell", ["_h"], {"_r": F.lit(1)}, {"_r": "_n"})
    ends = ranked.select("_h", "_r", n_test.alias("t"), (n_test + n_val).alias("v"))
    ends = ends.filter(F.col("_r").isin(F.col("t"), F.col("t") + 1, F.col("v"), F.col("v") + 1))
    rows = ends.collect()
    at = {r["_r"]: r["_h"] for r in rows}
    cuts = [(rows[0][c], at.get(rows[0][c])) for c in ("t", "v")] if rows else []
    if all(h is not None and at.get(r + 1) != h for r, h in cuts):
        spot = hash_text(seed, *df.columns)
        split = F.lit("train")
        for name, (_, h) in reversed(list(zip(("test", "val"), cuts))):
            split = F.when(spot <= h, name).otherwise(split)
        return df.withColumn("split", split)
    ranked = hashed_rank(df, [], df.columns, seed, "_r", "_n")
    split = (
        F.when(F.col("_r") <= n_test, "test")
        .when(F.col("_r") <= n_test + n_val, "val")
        .otherwise("train")
    )
    return ranked.withColumn("split", split).drop("_r", "_n")


def assign_by_key(df: DataFrame, key_splits: DataFrame, key: str) -> DataFrame:
    """Rows with the split listed for their key; rows with an unlisted key are dropped."""
    return df.join(key_splits.select(key, "split").distinct(), key)


def stratified_val(
    df: DataFrame, val_frac: float = 0.1, seed: int = 42, by: str = "peptide"
) -> DataFrame:
    """Add ``split``: each peptide gives about ``val_frac`` of its rows to val.

    At least one row goes to val and, where there are two or more, one stays in train.
    """
    ranked = hashed_rank(df, [by], df.columns, seed, "_r", "_n")
    n_val = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(val_frac))))
    n_val = F.when(n_val >= F.col("_n"), F.greatest(F.lit(1), F.col("_n") - 1)).otherwise(n_val)
    split = F.when(F.col("_r") <= n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_r", "_n")


def split_stats(df: DataFrame) -> DataFrame:
    """Rows, distinct peptides and distinct CDR3s per split."""
    return df.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("peptide").alias("n_peptides"),
        F.countDistinct("cdr3").alias("n_cdr3s"),
    )


def stratified_folds(
    df: DataFrame, label: str, k: int, key: Sequence[str], seed: int = 42, fold: str = "fold"
) -> DataFrame:
    """Add ``fold`` 0..k-1, dealing out the rows of each class in seeded order."""
    ranked = hashed_rank(df, [label], key, seed, "_r")
    return ranked.withColumn(fold, ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def top_classes(df: DataFrame, label: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of ``label`` with their counts; ties by value."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), label).limit(n)


def balanced_subset(
    df: DataFrame, label: str, n_classes: int, per_class: int, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """Up to ``per_class`` seeded rows from each of the most frequent classes."""
    top = F.broadcast(top_classes(df, label, n_classes).select(label))
    ranked = hashed_rank(df.join(top, label, "left_semi"), [label], key, seed, "_r")
    return ranked.filter(F.col("_r") <= per_class).drop("_r")


def stratified_sample(
    df: DataFrame,
    n: int,
    label: str,
    vector: str,
    key: Sequence[str],
    stratify: bool = True,
    seed: int = 42,
) -> DataFrame:
    """``n`` rows, spread evenly over the classes when ``stratify`` is set.

    Rows without vector or label are left out first. With stratification each class
    gives ``max(1, n // classes)`` rows; all rows come back when ``n`` covers them.
    """
    whole = df.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
    counted = whole.agg(F.count("*").alias("rows"), F.countDistinct(label).alias("classes")).first()
    if n >= counted["rows"]:
        return whole
    limit = max(1, n // counted["classes"]) if stratify else n
    ranked = hashed_rank(whole, [label] if stratify else [], key, seed, "_r")
    return ranked.filter(F.col("_r") <= limit).drop("_r")


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """A seeded sample of ``n`` rows; all rows when there are no more than that."""
    return take_hashed(df, n, key, seed)


def first_rows(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by key, for trial runs (``n`` small: they pass the driver)."""
    return df.orderBy(*key).limit(n)


