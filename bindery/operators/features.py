"""Feature columns from sequences and categories, fitted on the training rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.constants import PAIRED_CATEGORIES, PEPTIDE_LENGTH, RECEPTOR_LENGTH
from bindery.functions.text import residue_ids
from bindery.functions.vectors import SYMBOLS, indicator, one_hot_sequence
from bindery.staging import staged

UNKNOWN = "<UNK>"


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per cell: ``col, value``."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return df.select(F.explode(cells).alias("c")).select("c.*")


def fit_vocabulary(
    train: DataFrame, columns: Sequence[str], unknown_slot: bool = False
) -> DataFrame:
    """Distinct values per column numbered in sort order: ``col, value, idx``.

    With ``unknown_slot`` number 0 is kept for values not seen and empty text is skipped.
    """
    seen = long_values(train, columns).filter(F.col("value").isNotNull())
    if unknown_slot:
        seen = seen.filter((F.col("value") != "") & (F.col("value") != UNKNOWN))
    seen = seen.distinct()
    order = Window.partitionBy("col").orderBy("value")
    first = 1 if unknown_slot else 0
    table = seen.select("col", "value", (F.row_number().over(order) - 1 + first).alias("idx"))
    if unknown_slot:
        slots = seen.sparkSession.createDataFrame([(c, UNKNOWN, 0) for c in columns], table.schema)
        table = table.unionByName(slots)
    return table


@dataclass
class Categories:
    """A fitted vocabulary with the number of slots per column."""

    columns: list[str]
    table: DataFrame
    sizes: dict[str, int]
    unknown_slot: bool = False

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str] = ("v_gene", "j_gene"), unknown_slot: bool = False):
        missing = [c for c in columns if c not in train.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        # written, so that the training rows are read once and joins know how small it is
        table = staged(fit_vocabulary(train, columns, unknown_slot), "vocabulary")
        counts = {r["col"]: r["n"] for r in table.groupBy("col").agg(F.count("*").alias("n")).collect()}
        return cls(list(columns), table, {c: counts.get(c, 0) for c in columns}, unknown_slot)

    @classmethod
    def fit_paired(cls, train: DataFrame):
        return cls.fit(train, PAIRED_CATEGORIES, unknown_slot=True)

    @property
    def feature_dim(self) -> int:
        return sum(self.sizes.values()) + (0 if self.unknown_slot else 1)

    def breakdown(self) -> dict[str, int]:
        first = {} if self.unknown_slot else {"mhc_class": 1}
        return {**first, **self.sizes}

    def index(self, df: DataFrame) -> DataFrame:
        """Add ``<column>_idx``: the slot, null (or slot 0) for a value not seen."""
        for c in self.columns:
            slots = self.table.filter(F.col("col") == c).select(
                F.col("value").alias(c), F.col("idx").alias(f"{c}_idx")
            )
            df = df.join(slots, c, "left")
            if self.unknown_slot:
                df = df.withColumn(f"{c}_idx", F.coalesce(f"{c}_idx", F.lit(0)))
        return df

    def transform(self, df: DataFrame, out: str = "meta") -> DataFrame:
        """Add the one-hot vector: the class bit (single-chain form), then each column."""
        indexed = self.index(df)
        parts = [] if self.unknown_slot else [F.array(class_bit())]
        parts += [indicator(F.col(f"{c}_idx"), self.sizes[c]) for c in self.columns]
        return indexed.withColumn(out, F.concat(*parts)).select(*df.columns, out)

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, columns: Sequence[str], unknown_slot: bool = False):
        table = spark.read.parquet(path)
        counts = {r["col"]: r["n"] for r in table.groupBy("col").agg(F.count("*").alias("n")).collect()}
        return cls(list(columns), table, {c: counts.get(c, 0) for c in columns}, unknown_slot)


def class_bit(column: str = "mhc_class") -> Column:
    """1 for MHCII, 0 for anything else and for null."""
    return (F.coalesce(F.col(column), F.lit("MHCI")) == "MHCII").cast("float")


def category_vectors(
    df: DataFrame,
    vectors: DataFrame,
    columns: Sequence[str],
    defaults: dict[str, Sequence[float]],
    out: str = "meta",
    with_class_bit: bool = True,
) -> DataFrame:
    """Concatenate a supplied dense vector per category value.

    ``vectors(col, value, vec)``; a value without one gets the column's default vector
    (for a trained encoder, its output for an all-zero input).
    """
    columns_before = df.columns
    parts = [F.array(class_bit())] if with_class_bit else []
    for c in columns:
        own = vectors.filter(F.col("col") == c)
        own = own.select(F.col("value").alias(c), F.col("vec").alias(f"_vec_{c}"))
        df = df.join(own, c, "left")
        default = F.array(*[F.lit(float(x)) for x in defaults[c]]).cast("array<float>")
        parts.append(F.coalesce(F.col(f"_vec_{c}").cast("array<float>"), default))
    return df.withColumn(out, F.concat(*parts)).select(*columns_before, out)


def one_hot_pairs(
    df: DataFrame, receptor_len: int = RECEPTOR_LENGTH, peptide_len: int = PEPTIDE_LENGTH
) -> DataFrame:
    """Add ``receptor_vec`` and ``peptide_vec`` (dense one-hot; 660 and 330 numbers)."""
    return df.withColumns({
        "receptor_vec": one_hot_sequence("cdr3", receptor_len),
        "peptide_vec": one_hot_sequence("peptide", peptide_len),
    })


def sparse_pair_features(
    df: DataFrame,
    categories: Categories | None = None,
    receptor_len: int = RECEPTOR_LENGTH,
    peptide_len: int = PEPTIDE_LENGTH,
    out: str = "features",
) -> DataFrame:
    """The same one-hot features (and categories) as one sparse vector for ``pyspark.ml``.

    Each feature is a term; counting the terms of a row against the fixed term list
    gives its sparse vector in the JVM. Of 990 numbers only 45 are stored.
    """
    place = lambda tag, ids: F.transform(ids, lambda x, i: F.concat(
        F.lit(tag), i.cast("string"), F.lit("_"), x.cast("string")
    ))
    terms = [place("r", residue_ids("cdr3", receptor_len)), place("p", residue_ids("peptide", peptide_len))]
    names = [f"r{i}_{x}" for i in range(receptor_len) for x in range(SYMBOLS)]
    names += [f"p{i}_{x}" for i in range(peptide_len) for x in range(SYMBOLS)]
    keep = df.columns
    if categories is not None:
        df = categories.index(df)
        if not categories.unknown_slot:
            names.append("mhc_class")
            terms.append(F.when(class_bit() == 1, F.array(F.lit("mhc_class"))).otherwise(F.array().cast("array<string>")))
        for c in categories.columns:
            names += [f"{c}_{i}" for i in range(categories.sizes[c])]
            slot = F.concat(F.lit(f"{c}_"), F.col(f"{c}_idx").cast("string"))
            terms.append(F.when(F.col(f"{c}_idx").isNotNull(), F.array(slot)).otherwise(F.array().cast("array<string>")))
    model = CountVectorizerModel.from_vocabulary(names, inputCol="_terms", outputCol=out)
    model.setBinary(True).setMinTF(1.0)
    return model.transform(df.withColumn("_terms", F.concat(*terms))).select(*keep, out)


def residue_graph(
    pairs: DataFrame, receptor_len: int = RECEPTOR_LENGTH, peptide_len: int = PEPTIDE_LENGTH
) -> DataFrame:
    """Each pair with one compressed adjacency of its real residues: ``nodes``, and for each edge
    type ``offsets_t`` and ``targets_t``.

    Receptor residues are numbered from 0, peptide residues from ``receptor_len``. Type 0
    joins neighbours in the receptor, 1 neighbours in the peptide, 2 every receptor
    residue with every peptide residue; each edge is listed in both directions. The
    neighbours of ``nodes[i]`` stand in ``targets_t`` from ``offsets_t[i]`` up to ``offsets_t[i + 1]``.
    """
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    r = F.least(F.length("cdr3"), F.lit(receptor_len))
    p = F.least(F.length("peptide"), F.lit(peptide_len))
    at = F.lit(receptor_len)
    front, back = every(r), F.transform(every(p), lambda j: at + j)

    def beside(node: Column, first: Column, n: Column) -> Column:
        return F.filter(F.array(node - 1, node + 1), lambda x: (x >= first) & (x < first + n))

    zero = F.lit(0)
    targets = {
        0: F.flatten(F.transform(front, lambda i: beside(i, zero, r))),
        1: F.flatten(F.transform(back, lambda j: beside(j, at, p))),
        2: F.flatten(F.concat(F.transform(front, lambda _: back), F.transform(back, lambda _: front))),
    }
    # residues inside a chain have two neighbours, those at its ends one
    chain = lambda i, n: F.greatest(zero, F.least(2 * i - 1, 2 * n - 2))
    ends = {
        0: lambda i: chain(i, r),
        1: lambda i: chain(i - r, p),
        2: lambda i: F.when(i <= r, i * p).otherwise(r * p + (i - r) * r),
    }
    known = F.col("cdr3").isNotNull() & F.col("peptide").isNotNull()
    places = F.sequence(zero, r + p)
    out = pairs.withColumn("nodes", F.when(known, F.concat(front, back)))
    for t, own in targets.items():
        offsets = F.when(known, F.transform(places, ends[t]))
        out = out.withColumns({f"offsets_{t}": offsets, f"targets_{t}": F.when(known, own)})
    return out


def graph_edges(graph: DataFrame) -> DataFrame:
    """The adjacency of ``residue_graph`` spelled out: a row ``src, dst, etype`` for each edge."""
    added = ["nodes", *[f"{what}_{t}" for t in range(3) for what in ("offsets", "targets")]]
    keep = [c for c in graph.columns if c not in added]

    def of_type(t: int) -> Column:
        offsets, targets = F.col(f"offsets_{t}"), F.col(f"targets_{t}")

        def of_node(src: Column, i: Column) -> Column:
            begin, end = offsets[i], offsets[i + 1]
            return F.transform(F.slice(targets, begin + 1, end - begin), lambda dst: F.struct(
                src.alias("src"), dst.alias("dst"), F.lit(t).alias("etype")
            ))

        return F.flatten(F.transform("nodes", of_node))

    listed = graph.select(*keep, F.explode(F.concat(*[of_type(t) for t in range(3)])).alias("_e"))
    return listed.select(*keep, "_e.src", "_e.dst", "_e.etype")


def residue_edges(
    pairs: DataFrame, receptor_len: int = RECEPTOR_LENGTH, peptide_len: int = PEPTIDE_LENGTH
) -> DataFrame:
    """The edges of ``residue_graph`` as rows; up to 986 for a pair, so store the graph instead.

    Edges depend on the two lengths only. Their graphs are made once for each pair of lengths, at
    most ``(receptor_len + 1) * (peptide_len + 1)`` of them, and broadcast.
    """
    spark = pairs.sparkSession
    sides = spark.range(receptor_len + 1).selectExpr("repeat('A', cast(id as int)) AS cdr3")
    shapes = sides.crossJoin(spark.range(peptide_len + 1).selectExpr("repeat('A', cast(id as int)) AS peptide"))
    edges = graph_edges(residue_graph(shapes, receptor_len, peptide_len))
    edges = edges.groupBy(F.length("cdr3").alias("_r"), F.length("peptide").alias("_p"))
    edges = edges.agg(F.collect_list(F.struct("src", "dst", "etype")).alias("_e"))
    # least() would pass over the null length of a null text
    known = F.col("cdr3").isNotNull() & F.col("peptide").isNotNull()
    lengths = {
        "_r": F.when(known, F.least(F.length("cdr3"), F.lit(receptor_len))),
        "_p": F.when(known, F.least(F.length("peptide"), F.lit(peptide_len))),
    }
    listed = pairs.withColumns(lengths).join(F.broadcast(edges), ["_r", "_p"])
    return listed.select(*pairs.columns, F.inline("_e"))
