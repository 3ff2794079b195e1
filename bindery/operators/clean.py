"""Raw database exports → one clean pair table, with a row count for every step."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.constants import (
    HUMAN_TAXON,
    PAIR_COLUMNS,
    PAIRED_SEQUENCES,
    REQUIRED_WITHOUT_MHC_B,
    STEPS,
    STRONG_METHODS,
    UNSEEN_PEPTIDES,
    VDJDB_COLUMNS,
)
from bindery.functions.text import (
    all_nonempty,
    choose_nonempty,
    has_wildcard,
    mhc_class,
    preclean_gene,
    same_scheme,
    strip,
    strip_gaps,
)
from bindery.staging import staged


# --- small steps ----------------------------------------------------------------------


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def keep_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns, as far as they exist, in the listed order."""
    return df.select(*[f"`{c}`" for c in columns if c in df.columns])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def normalize_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null to ``''``, text type, outer white space removed."""
    return df.withColumns({c: strip(F.col(f"`{c}`")) for c in columns})


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in all, rows with a null in any of the columns, and rows left without them."""
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    hit = F.coalesce(F.sum(any_null.cast("bigint")), F.lit(0))
    return df.agg(
        F.count("*").alias("n_rows"),
        hit.alias("n_dropped"),
        (F.count("*") - hit).alias("n_left"),
    )


def keep_peptides(df: DataFrame, peptides: Sequence[str] = tuple(UNSEEN_PEPTIDES)) -> DataFrame:
    """Rows whose peptide, upper-cased, is listed."""
    return df.filter(F.upper("peptide").isin(list(peptides)))


# --- two-chain tables -----------------------------------------------------------------


def normalise_paired(df: DataFrame) -> DataFrame:
    """Lower-case column names; alignment gaps out of the sequence columns."""
    df = lower_names(df)
    return df.withColumns({c: strip_gaps(c) for c in PAIRED_SEQUENCES if c in df.columns})


def paired_to_single(df: DataFrame) -> DataFrame:
    """A two-chain table as single-chain rows of its beta chain."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    return df.withColumns({
        "cdr3": F.col("cdr3b"),
        "v_gene": text("vb"),
        "j_gene": text("jb"),
        "mhc_a": text("hla"),
        "mhc_class": F.lit("MHCI"),
    })


def attach_paired_cdr3(df: DataFrame) -> DataFrame:
    """``cdr3`` as alpha then beta CDR3; rows without either are dropped."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.withColumn("cdr3", F.concat(text("cdr3a"), text("cdr3b"))).filter(F.length("cdr3") > 0)


# --- assay methods --------------------------------------------------------------------


def assay_methods(assays: DataFrame) -> DataFrame:
    """Distinct methods per (epitope, reference): ``epi, ref, methods``."""
    flat = _assay_keys(assays)
    return flat.groupBy("epi", "ref").agg(F.sort_array(F.collect_set("method")).alias("methods"))


def _assay_keys(assays: DataFrame) -> DataFrame:
    return assays.select(
        same_scheme("`Epitope|IEDB IRI`").alias("epi"),
        same_scheme("`Reference|IEDB IRI`").alias("ref"),
        F.col("`Assay|Method`").alias("method"),
    )


def strong_assays(assays: DataFrame, methods: Sequence[str] = tuple(STRONG_METHODS)) -> DataFrame:
    """Distinct (epitope, reference) with at least one of the methods.

    The method test runs before the shuffle, so no set of methods is ever built.
    """
    return _assay_keys(assays).filter(F.col("method").isin(list(methods))).select("epi", "ref").distinct()


# --- gene symbols ---------------------------------------------------------------------


def preclean_genes(df: DataFrame) -> DataFrame:
    return df.withColumns({c: preclean_gene(c) for c in ("v_gene", "j_gene")})


def standardize_genes(df: DataFrame, gene_ref: DataFrame) -> DataFrame:
    """Replace V and J symbols by their allele; drop rows without a functional allele.

    ``gene_ref(symbol, allele, functional)`` has one row per symbol.
    """
    alleles = gene_ref.filter("functional").select("symbol", "allele")
    for column in ("v_gene", "j_gene"):
        named = alleles.select(F.col("symbol").alias(column), F.col("allele").alias("_allele"))
        joined = df.join(named, column)
        df = joined.select(
            *[F.col("_allele").alias(c) if c == column else F.col(c) for c in df.columns]
        )
    return df


def mark_genes(df: DataFrame, gene_ref: DataFrame | None, flag: str) -> DataFrame:
    """As ``standardize_genes`` but rows stay and ``flag`` tells which would have."""
    if gene_ref is None:
        known = (F.col("v_gene") != "") & (F.col("j_gene") != "")
        return df.withColumn(flag, known)
    alleles = gene_ref.filter("functional").select("symbol", "allele")
    columns = df.columns
    for column in ("v_gene", "j_gene"):
        named = alleles.select(F.col("symbol").alias(column), F.col("allele").alias(f"_{column}"))
        df = df.join(named, column, "left")
    known = F.col("_v_gene").isNotNull() & F.col("_j_gene").isNotNull()
    kept = [
        F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in ("v_gene", "j_gene") else F.col(c)
        for c in columns
    ]
    return df.select(*kept, known.alias(flag))


# --- the three sources ----------------------------------------------------------------
#
# Every source is first turned into "marked" rows: the standard columns plus one flag per
# step that says whether the row passes it. The clean table filters on all flags; the
# funnel counts rows passing the flags up to each step. Both come from one pass.


def mark_vdjdb(
    raw: DataFrame, gene_ref: DataFrame | None = None, chain: str = "TRB", min_score: int = 1
) -> DataFrame:
    """VDJdb rows in the standard columns with a flag per step."""
    require_columns(raw, VDJDB_COLUMNS)
    df = normalize_text(raw, VDJDB_COLUMNS)
    q = lambda c: F.col(f"`{c}`")
    scored = q("vdjdb.score") >= min_score if "vdjdb.score" in raw.columns else F.lit(True)
    df = df.select(
        F.col("cdr3"),
        F.col("gene").alias("tcr_chain"),
        q("v.segm").alias("v_gene"),
        q("j.segm").alias("j_gene"),
        q("antigen.epitope").alias("peptide"),
        q("mhc.a").alias("mhc_a"),
        q("mhc.b").alias("mhc_b"),
        q("mhc.class").alias("mhc_class"),
        (F.col("species") == "HomoSapiens").alias("_species"),
        (F.col("gene") == chain).alias("_chain"),
        all_nonempty([q(c) for c in VDJDB_COLUMNS]).alias("_required_fields"),
        (~has_wildcard("cdr3", q("antigen.epitope"))).alias("_wildcards"),
        F.coalesce(scored, F.lit(False)).alias("_confidence_filter"),
    )
    return mark_genes(preclean_genes(df), gene_ref, "_gene_standardization")


def mark_iedb(
    raw: DataFrame,
    assays: DataFrame | None = None,
    gene_ref: DataFrame | None = None,
    chain: str = "TRB",
    strict_class_names: bool = False,
) -> DataFrame:
    """IEDB receptor rows in the standard columns with a flag per step.

    Without an assay table the confidence step is skipped.
    """
    _beta_only(chain)
    q = lambda c: F.col(f"`{c}`")
    organism = F.coalesce(q("Chain 2|Organism IRI"), F.lit(""))
    df = raw.select(
        choose_nonempty(q("Chain 2|CDR3 Curated"), q("Chain 2|CDR3 Calculated")).alias("cdr3"),
        F.lit("TRB").alias("tcr_chain"),
        choose_nonempty(q("Chain 2|Curated V Gene"), q("Chain 2|Calculated V Gene")).alias("v_gene"),
        choose_nonempty(q("Chain 2|Curated J Gene"), q("Chain 2|Calculated J Gene")).alias("j_gene"),
        strip(q("Epitope|Name")).alias("peptide"),
        strip(q("Assay|MHC Allele Names")).alias("mhc_a"),
        F.lit("").alias("mhc_b"),
        mhc_class(q("Assay|MHC Allele Names"), strict_class_names).alias("mhc_class"),
        organism.contains(HUMAN_TAXON).alias("_species"),
        (strip(q("Chain 2|Type")) == "beta").alias("_chain"),
        same_scheme(q("Epitope|IEDB IRI")).alias("epi"),
        same_scheme(q("Reference|IEDB IRI")).alias("ref"),
    )
    if assays is not None:
        strong = strong_assays(assays).withColumn("_strong", F.lit(True))
        df = df.join(strong, ["epi", "ref"], "left")
        df = df.withColumn("_confidence_filter", F.coalesce("_strong", F.lit(False))).drop("_strong")
    return mark_genes(preclean_genes(_mark_common(df.drop("epi", "ref"))), gene_ref, "_gene_standardization")


def mark_mcpas(
    raw: DataFrame,
    gene_ref: DataFrame | None = None,
    chain: str = "TRB",
    strict_class_names: bool = False,
) -> DataFrame:
    """McPAS rows in the standard columns with a flag per step."""
    _beta_only(chain)
    df = raw.select(
        strip("`CDR3.beta.aa`").alias("cdr3"),
        F.lit("TRB").alias("tcr_chain"),
        strip("TRBV").alias("v_gene"),
        strip("TRBJ").alias("j_gene"),
        strip("`Epitope.peptide`").alias("peptide"),
        strip("MHC").alias("mhc_a"),
        F.lit("").alias("mhc_b"),
        mhc_class("MHC", strict_class_names).alias("mhc_class"),
        (strip("Species") == "Human").alias("_species"),
    )
    return mark_genes(preclean_genes(_mark_common(df)), gene_ref, "_gene_standardization")


def _mark_common(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "_required_fields": all_nonempty(REQUIRED_WITHOUT_MHC_B),
        "_wildcards": ~has_wildcard("cdr3", "peptide"),
    })


def _beta_only(chain: str) -> None:
    if chain != "TRB":
        raise ValueError(f"this source holds beta chains only, not {chain}")


def steps_of(marked: DataFrame, source: str) -> list[str]:
    return [s for s in STEPS[source] if f"_{s}" in marked.columns]


def sized(marked: DataFrame, source: str) -> DataFrame:
    """Rows by the number of steps they pass (``_depth``) and, if all, by their values, with
    their number ``_n``: what both the cleaned rows and the funnel are made from."""
    steps = steps_of(marked, source)
    depth, running = F.lit(0), F.lit(True)
    for step in steps:
        running = running & F.col(f"_{step}")
        depth = depth + running.cast("int")
    # Only rows that pass everything need their values told apart.
    done = F.col("_depth") == len(steps)
    told = [F.when(done, F.col(c)).alias(c) for c in PAIR_COLUMNS]
    rows = marked.withColumn("_depth", depth).select(F.col("_depth"), *told)
    return rows.groupBy("_depth", *PAIR_COLUMNS).agg(F.count("*").alias("_n"))


def clean_rows(marked: DataFrame, source: str, groups: DataFrame | None = None) -> DataFrame:
    """Distinct standard rows that pass every step, tagged with their source."""
    groups = sized(marked, source) if groups is None else groups
    passed = groups.filter(F.col("_depth") == len(steps_of(marked, source)))
    return passed.select(*PAIR_COLUMNS, F.lit(source).alias("source"))


def funnel(marked: DataFrame, source: str, groups: DataFrame | None = None) -> DataFrame:
    """Rows left after each step: ``source, step_no, step, n_rows, n_removed``."""
    steps = steps_of(marked, source)
    groups = sized(marked, source) if groups is None else groups
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    names = ["loaded_rows", *[f"after_{s}" for s in steps], "after_dedup"]
    counts = [whole("_n"), *[whole(F.when(F.col("_depth") > i, F.col("_n"))) for i in range(len(steps))]]
    counts.append(whole(F.when(F.col("_depth") == len(steps), 1)))
    row = groups.agg(*[c.alias(n) for c, n in zip(counts, names)])
    entries = [
        F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(n).alias("n_rows"))
        for i, n in enumerate(names)
    ]
    long = row.select(F.explode(F.array(*entries)).alias("e")).select(F.lit(source).alias("source"), "e.*")
    return removed_per_step(long)


def removed_per_step(counts: DataFrame) -> DataFrame:
    """Add the rows each step removed to a ``source, step_no, n_rows`` table."""
    order = Window.partitionBy("source").orderBy("step_no")
    before = F.lag("n_rows").over(order)
    return counts.withColumn("n_removed", F.coalesce(before - F.col("n_rows"), F.lit(0)))


def combine(*clean: DataFrame) -> DataFrame:
    """The cleaned sources as one table, distinct over all columns."""
    return reduce(lambda a, b: a.unionByName(b), clean).dropDuplicates()


def promiscuous_cdr3s(pairs: DataFrame) -> DataFrame:
    """CDR3s seen with more than one peptide."""
    seen = pairs.groupBy("cdr3").agg(F.min("peptide").alias("lo"), F.max("peptide").alias("hi"))
    return seen.filter(F.col("lo") != F.col("hi")).select("cdr3")


def drop_promiscuous(pairs: DataFrame) -> DataFrame:
    """Rows of CDR3s that bind a single peptide."""
    return pairs.join(promiscuous_cdr3s(pairs), "cdr3", "left_anti")


def promiscuous_count(pairs: DataFrame) -> DataFrame:
    """Rows, and CDR3s, that ``drop_promiscuous`` removes."""
    seen = pairs.groupBy("cdr3").agg(
        F.min("peptide").alias("lo"), F.max("peptide").alias("hi"), F.count("*").alias("n")
    )
    many = F.col("lo") != F.col("hi")
    return seen.agg(
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("n_rows"),
        F.count(F.when(many, 1)).alias("n_cdr3s"),
    )


def pooled_summary(parts: DataFrame, combined: DataFrame) -> DataFrame:
    """Rows per cleaned source, their sum, rows lost in pooling, and final rows."""
    per_source = parts.groupBy(F.concat(F.col("source"), F.lit(" cleaned rows")).alias("quantity"))
    rows = per_source.agg(F.count("*").alias("value"))
    both = parts.select(F.lit(1).alias("before"), F.lit(0).alias("after")).unionByName(
        combined.select(F.lit(0).alias("before"), F.lit(1).alias("after"))
    )
    sums = both.agg(F.sum("before").alias("b"), F.sum("after").alias("a"))
    total = lambda name, c: F.struct(F.lit(name).alias("quantity"), c.alias("value"))
    extra = sums.select(F.explode(F.array(
        total("sum before pooling", F.col("b")),
        total("removed during pooling", F.col("b") - F.col("a")),
        total("final combined rows", F.col("a")),
    )).alias("e")).select("e.*")
    return rows.unionByName(extra)


def build_pairs(
    marked: dict[str, DataFrame], drop_multi: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(combined clean pairs, funnel of all sources) from marked tables by source name.

    Each source is read once: its rows, grouped by result, are written, and both are made from that.
    """
    groups = {s: staged(sized(m, s), "sized") for s, m in marked.items()}
    pairs = combine(*[clean_rows(m, s, groups[s]) for s, m in marked.items()])
    steps = reduce(lambda a, b: a.unionByName(b), [funnel(m, s, groups[s]) for s, m in marked.items()])
    return (drop_promiscuous(pairs) if drop_multi else pairs), steps
