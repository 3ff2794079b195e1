"""Full receptor chains from germline residue tables, and where the CDR3 sits in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.constants import FULL_SEQUENCE_COLUMNS
from bindery.functions.text import core_span, cut_span
from bindery.operators.clean import keep_existing
from bindery.staging import staged

DEFAULT_TERMINAL = "F"


def stitch_full_sequence(
    pairs: DataFrame,
    v_ref: DataFrame,
    j_ref: DataFrame,
    constant: str = "",
    leader: bool = False,
) -> DataFrame:
    """Add ``full_aa`` = leader + V + CDR3 + J + constant, null when it cannot be built.

    ``v_ref(v_gene, body, leader, anchor)`` ends before the CDR3 and names the residues a
    CDR3 of that gene begins with; ``j_ref(j_gene, body, terminal)`` begins after the CDR3
    and names the residue it ends with, ``F`` where it names none. A J gene is looked up by its
    symbol as it is, and without an allele also as its first one. A missing leading ``C`` is always put back. Then the first
    attempt that fits is taken, in this order: as is; with the terminal added; without the
    anchor check; with the terminal and without the check; and the same four without the
    leader for genes that have none. A result with a stop (``*``) is void.

    Both gene tables are written first, so that joins know how small they are: pairs share few
    genes, and dealt by them would end in as many tasks as there are genes.
    """
    base = F.when(F.col("cdr3").startswith("C"), F.col("cdr3")).otherwise(
        F.concat(F.lit("C"), F.col("cdr3"))
    )
    v = v_ref.select("v_gene", F.col("body").alias("_v"), F.col("leader").alias("_l"), F.col("anchor").alias("_a"))
    j = j_ref.select(
        F.col("j_gene").alias("_j_gene"), F.col("body").alias("_j"),
        F.coalesce("terminal", F.lit(DEFAULT_TERMINAL)).alias("_t"),
    )
    # a first allele also goes by the bare symbol, unless that has a row of its own
    bare = F.when(F.col("_j_gene").endswith("*01"), F.expr("left(_j_gene, length(_j_gene) - 3)"))
    names = F.array(
        F.struct(F.col("_j_gene").alias("name"), F.lit(0).alias("turn")),
        F.struct(bare.alias("name"), F.lit(1).alias("turn")),
    )
    named = staged(j, "genes").select(F.explode(names).alias("_n"), "_j", "_t").where("_n.name is not null")
    turns = named.groupBy(F.col("_n.name").alias("_j_gene")).agg(F.min("_n.turn").alias("_turn"))
    j = named.select(F.col("_n.name").alias("_j_gene"), F.col("_n.turn").alias("_turn"), "_j", "_t")
    v, j = staged(v, "genes"), staged(j.join(turns, ["_j_gene", "_turn"]), "genes")
    parts = pairs.join(v, "v_gene", "left").join(j, F.col("_j_gene") == F.col("j_gene"), "left")
    parts = parts.withColumn("_core", base)

    def attempt(add_terminal: bool, skip_anchor: bool, skip_leader: bool) -> Column:
        core = F.concat(F.col("_core"), F.col("_t")) if add_terminal else F.col("_core")
        fits = core.endswith(F.col("_t"))
        if add_terminal:
            fits = fits & ~F.col("_core").endswith(F.col("_t"))
        if not skip_anchor:
            fits = fits & core.startswith(F.col("_a"))
        front = F.lit("") if skip_leader or not leader else F.col("_l")
        return F.when(fits, F.concat(front, F.col("_v"), core, F.col("_j"), F.lit(constant)))

    order = [(False, False), (True, False), (False, True), (True, True)]
    full = F.coalesce(*[attempt(t, a, no_l) for no_l in (False, True) for t, a in order])
    full = F.when(~full.contains("*"), full)
    return parts.withColumn("full_aa", full).select(*pairs.columns, "full_aa")


def with_core_span(stitched: DataFrame) -> DataFrame:
    """Add ``cdr3_start`` and ``cdr3_end`` (half-open, from 0; null when not found)."""
    marked = stitched.withColumn("_span", core_span("full_aa", "cdr3"))
    return marked.withColumns(
        {"cdr3_start": F.col("_span.start"), "cdr3_end": F.col("_span.end")}
    ).drop("_span")


def full_sequence_table(stitched: DataFrame) -> DataFrame:
    """The rows with a full chain, in the fixed column order."""
    built = with_core_span(stitched.filter(F.col("full_aa").isNotNull()))
    return keep_existing(built, FULL_SEQUENCE_COLUMNS)


def stitch_report(stitched: DataFrame) -> DataFrame:
    """Rows, failures and their share, spans not found, and spans that hold the CDR3."""
    marked = with_core_span(stitched)
    failed = F.sum(F.col("full_aa").isNull().cast("bigint"))
    missed = F.col("full_aa").isNotNull() & F.col("cdr3_start").isNull()
    inside = cut_span("full_aa", "cdr3_start", "cdr3_end").contains(F.upper("cdr3"))
    return marked.agg(
        F.count("*").alias("n_rows"),
        failed.alias("n_failed"),
        F.round(failed * 100.0 / F.count("*"), 2).alias("failed_pct"),
        F.sum(missed.cast("bigint")).alias("span_misses"),
        F.sum(F.coalesce(inside, F.lit(False)).cast("bigint")).alias("span_ok"),
    )


def check_not_empty(stitched: DataFrame) -> DataFrame:
    """``stitched`` itself, or an error when no chain could be built."""
    if stitched.filter(F.col("full_aa").isNotNull()).isEmpty():
        raise RuntimeError("no full chain could be built: check the germline tables")
    return stitched
