"""Summary tables of data sets and of finished experiments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.constants import (
    EMBEDDING_ALIASES,
    EMBEDDING_LABELS,
    METADATA_MARKS,
    METADATA_TEXTS,
    MODEL_ORDER,
    MODEL_SHORT_NAMES,
    REPRESENTATION_ORDER,
    REPRESENTATION_TEXTS,
    REPRESENTATION_WORDS,
    UNKNOWN_REPRESENTATION,
)
from bindery.operators.features import long_values

# --- data sets ------------------------------------------------------------------------


def dataset_summary(pairs: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, distinct values of five columns, and rows per source: ``quantity, value``.

    Exact distinct counts come from one list of (column, value) cells that is combined
    before it is shuffled; ``approximate`` uses sketches and shuffles next to nothing.
    """
    columns = ["cdr3", "peptide", "v_gene", "j_gene", "mhc_a"]
    sources = pairs.groupBy(F.concat(F.lit("rows from "), F.col("source")).alias("quantity")).agg(
        F.count("*").alias("value")
    )
    rows = sources.agg(F.sum("value").alias("value")).select(F.lit("rows").alias("quantity"), "value")
    if approximate:
        wide = pairs.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        cells = F.array(*[F.struct(F.lit(f"unique {c}").alias("quantity"), F.col(c).alias("value")) for c in columns])
        unique = wide.select(F.explode(cells).alias("c")).select("c.*")
    else:
        cells = long_values(pairs, columns).filter(F.col("value").isNotNull()).distinct()
        unique = cells.groupBy(F.concat(F.lit("unique "), F.col("col")).alias("quantity")).agg(
            F.count("*").alias("value")
        )
    return rows.unionByName(unique).unionByName(sources)


def top_values(df: DataFrame, columns: Sequence[str], n: int = 20) -> DataFrame:
    """The ``n`` most frequent values of each column; ties by value."""
    counts = long_values(df, columns).filter(F.col("value").isNotNull())
    counts = counts.groupBy("col", "value").agg(F.count("*").alias("n_rows"))
    order = Window.partitionBy("col").orderBy(F.desc("n_rows"), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def length_histogram(df: DataFrame, bins: dict[str, int]) -> DataFrame:
    """Equal-width histogram of sequence lengths per column; the last bin is closed."""
    pick = lambda f: F.array(*[F.struct(F.lit(c).alias("col"), f(c, n).alias("x")) for c, n in bins.items()])
    lengths = df.select(F.explode(pick(lambda c, n: F.length(c))).alias("c")).select("c.*")
    counts = lengths.filter(F.col("x").isNotNull()).groupBy("col", "x").agg(F.count("*").alias("n"))
    # One row per length from here on.
    whole = Window.partitionBy("col")
    number = reduce(lambda a, cn: F.when(F.col("col") == cn[0], cn[1]).otherwise(a), bins.items(), F.lit(1))
    placed = counts.withColumns({"lo": F.min("x").over(whole), "hi": F.max("x").over(whole), "bins": number})
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins")).otherwise(F.lit(1.0))
    spot = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.col("bins") - 1)
    placed = placed.withColumns({"width": width, "bin": spot.cast("int")})
    left = F.first("lo") + F.col("bin") * F.first("width")
    return placed.groupBy("col", "bin").agg(left.alias("left_edge"), F.sum("n").alias("n_rows"))


# --- experiment names -----------------------------------------------------------------


def canonical_embedding(name: Column) -> Column:
    """The full embedding name for an alias; other names stay."""
    clean = F.replace(F.trim(name), F.lit("\\"), F.lit("/"))
    table = F.create_map(*[F.lit(x) for item in EMBEDDING_ALIASES.items() for x in item])
    return F.coalesce(table[clean], clean)


def experiment_name(receptor: Column, categorical: Column) -> Column:
    """Short embedding label, with ``_meta`` when categories are used.

    Unknown embeddings and category modes are errors.
    """
    method = canonical_embedding(receptor)
    labels = F.create_map(*[F.lit(x) for item in EMBEDDING_LABELS.items() for x in item])
    fail = lambda what, c: F.raise_error(F.concat(F.lit(f"unsupported {what}: "), c)).cast("string")
    base = F.coalesce(labels[method], fail("embedding", method))
    suffix = (
        F.when(categorical.isNull(), "")
        .when(categorical.isin("one_hot", "cat_ae"), "_meta")
        .otherwise(fail("categorical mode", categorical))
    )
    return F.concat(base, suffix)


def representation(name: Column) -> Column:
    """The sequence representation an experiment name stands for; the first rule counts."""
    n = F.lower(name)
    found = [F.when(n.contains(text), label) for text, label in REPRESENTATION_TEXTS]
    words = F.split(n, "_")
    found += [F.when(F.array_contains(words, word), label) for word, label in REPRESENTATION_WORDS]
    return F.coalesce(*found, F.lit(UNKNOWN_REPRESENTATION))


def metadata_flag(df: DataFrame) -> Column:
    """``+`` when any of the settings or the name says that categories were used."""
    said = [
        F.coalesce(F.col(c).contains(text), F.lit(False))
        for c, texts in METADATA_TEXTS.items() if c in df.columns for text in texts
    ]
    yes, no = METADATA_MARKS
    return F.when(reduce(lambda a, b: a | b, said, F.lit(False)), yes).otherwise(no)


def labelled_results(ledger: DataFrame) -> DataFrame:
    """A ledger with ``representation``, ``meta`` and the short ``model_name``."""
    short = F.create_map(*[F.lit(x) for item in MODEL_SHORT_NAMES.items() for x in item])
    return ledger.withColumns({
        "representation": representation(F.col("experiment_name")),
        "meta": metadata_flag(ledger),
        "model_name": F.coalesce(short[F.col("model")], F.col("model")),
    })


# --- experiment results ---------------------------------------------------------------


def result_pivot(results: DataFrame, metric: str) -> DataFrame:
    """Best value per model and (representation, metadata): fixed rows and columns."""
    cells = [f"{r} {m}" for r in REPRESENTATION_ORDER for m in ("–", "+")]
    keyed = results.withColumn("_cell", F.concat_ws(" ", "representation", "meta"))
    table = keyed.groupBy("model_name").pivot("_cell", cells).agg(F.max(metric))
    rank = F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("model_name"))
    every = results.sparkSession.createDataFrame([(m,) for m in MODEL_ORDER], "model_name string")
    return every.join(table, "model_name", "left").orderBy(rank)


def best_per_representation(
    results: DataFrame, metric: str = "auprc", without: Sequence[str] = ("RF",)
) -> DataFrame:
    """The best run of each representation, best first; ties by model and name."""
    kept = results.filter(~F.col("model_name").isin(list(without)) & (F.col("representation") != "Unknown"))
    order = F.struct((-F.col(metric)).alias("down"), F.col("model_name"), F.col("experiment_name"))
    run = F.struct("model_name", "experiment_name", "meta", metric)
    best = kept.filter(F.col(metric).isNotNull()).groupBy("representation").agg(F.min_by(run, order).alias("run"))
    return best.select("representation", "run.*").orderBy(F.desc(metric), "representation")


def metadata_ablation(
    results: DataFrame, metric: str = "auprc", without: Sequence[str] = ("RF",)
) -> DataFrame:
    """Per representation its best model's best value with and without metadata."""
    best = best_per_representation(results, metric, without)
    best = best.select("representation", F.col("model_name").alias("best_model"), F.col(metric).alias("_top"))
    runs = results.join(best, "representation").filter(F.col("model_name") == F.col("best_model"))
    of = lambda flag: F.max(F.when(F.col("meta") == flag, F.col(metric)))
    table = runs.groupBy("representation", "best_model").agg(
        of("+").alias("with_meta"), of("–").alias("without_meta"), F.max("_top").alias("_top")
    )
    return table.orderBy(F.desc("_top"), "representation").drop("_top")


def leaderboard(per_peptide: DataFrame) -> DataFrame:
    """Mean partial AUC per model over ``model, peptide, auc01`` rows, best first."""
    table = per_peptide.groupBy("model").agg(F.avg("auc01").alias("macro_auc01"))
    return table.orderBy(F.desc_nulls_last("macro_auc01"), "model")


def model_by_peptide(per_peptide: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per peptide and one column per model."""
    return per_peptide.groupBy("peptide").pivot("model", list(models)).agg(F.max("auc01")).orderBy("peptide")


# --- ledgers --------------------------------------------------------------------------


def upsert(ledger: DataFrame | None, new: DataFrame, key: str = "experiment_name") -> DataFrame:
    """The ledger with rows of the same key replaced; columns of both are kept.

    The columns of the new rows come first.
    """
    if ledger is None:
        return new
    kept = ledger.join(new.select(key), key, "left_anti")
    merged = kept.unionByName(new, allowMissingColumns=True)
    return merged.select(*new.columns, *[c for c in merged.columns if c not in new.columns])


def missing_runs(
    grid: DataFrame, ledger: DataFrame | None, only: Sequence[str] | None = None, force: bool = False,
    key: str = "experiment_name",
) -> DataFrame:
    """Grid rows still to run: those not in the ledger, of the wanted embeddings."""
    if only:
        grid = grid.filter(F.col("receptor_embedding").isin(list(only)))
    if force or ledger is None:
        return grid
    return grid.join(ledger.select(key), key, "left_anti")


def merge_ledgers(ledgers: dict[str, DataFrame]) -> DataFrame:
    """Ledgers of several model families as one table with a ``model`` column."""
    named = [df.withColumn("model", F.lit(name)) for name, df in ledgers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
