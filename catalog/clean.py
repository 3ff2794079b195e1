"""Queries on cleaning and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindery.functions.text import mhc_class, preclean_gene, strip
from bindery.operators import clean as cl
from bindery.operators import stitch as st
from bindery.staging import staged
from catalog.views import stored, view, with_views

# Names of the raw export columns by the plain names used in the views.
_VDJDB = {
    "gene": "gene", "cdr3": "cdr3", "v_segm": "v.segm", "j_segm": "j.segm", "species": "species",
    "mhc_a": "mhc.a", "mhc_b": "mhc.b", "mhc_class": "mhc.class",
    "antigen_epitope": "antigen.epitope", "score": "vdjdb.score",
}
_IEDB = {
    "cdr3_curated": "Chain 2|CDR3 Curated", "cdr3_calculated": "Chain 2|CDR3 Calculated",
    "v_curated": "Chain 2|Curated V Gene", "v_calculated": "Chain 2|Calculated V Gene",
    "j_curated": "Chain 2|Curated J Gene", "j_calculated": "Chain 2|Calculated J Gene",
    "chain_type": "Chain 2|Type", "organism": "Chain 2|Organism IRI", "epitope_name": "Epitope|Name",
    "epitope_iri": "Epitope|IEDB IRI", "reference_iri": "Reference|IEDB IRI",
    "mhc_allele_names": "Assay|MHC Allele Names",
}
_TCELL = {
    "epitope_iri": "Epitope|IEDB IRI", "reference_iri": "Reference|IEDB IRI", "method": "Assay|Method",
}
_MCPAS = {
    "cdr3_beta": "CDR3.beta.aa", "trbv": "TRBV", "trbj": "TRBJ", "epitope_peptide": "Epitope.peptide",
    "mhc": "MHC", "species": "Species",
}


def raw(spark, folder, name, names, positives=None):
    return view(spark, folder, name, positives).select(*[F.col(a).alias(b) for a, b in names.items()])


def vdjdb(spark, folder, positives=None):
    return raw(spark, folder, "raw_vdjdb", _VDJDB, positives)


def iedb(spark, folder, positives=None):
    return raw(spark, folder, "raw_iedb", _IEDB, positives)


def tcell(spark, folder, positives=None):
    return raw(spark, folder, "tcell", _TCELL, positives)


def mcpas(spark, folder, positives=None):
    return raw(spark, folder, "raw_mcpas", _MCPAS, positives)


def genes(spark, folder, positives=None):
    """The gene table, written first: it is joined twice per source."""
    return staged(view(spark, folder, "gene_ref", positives), "genes")


def marked(spark, folder, *only):
    base = stored(spark, folder, "positives")
    ref = genes(spark, folder, base)
    make = {
        "VDJdb": lambda: cl.mark_vdjdb(vdjdb(spark, folder, base), ref),
        "IEDB": lambda: cl.mark_iedb(iedb(spark, folder, base), tcell(spark, folder, base), ref),
        "McPAS": lambda: cl.mark_mcpas(mcpas(spark, folder, base), ref),
    }
    return {name: make[name]() for name in only or make}


def q_clean_vdjdb(spark, folder):
    return cl.clean_rows(marked(spark, folder, "VDJdb")["VDJdb"], "VDJdb")


def q_clean_iedb(spark, folder):
    return cl.clean_rows(marked(spark, folder, "IEDB")["IEDB"], "IEDB")


def q_clean_mcpas(spark, folder):
    return cl.clean_rows(marked(spark, folder, "McPAS")["McPAS"], "McPAS")


def q_clean_pairs(spark, folder):
    return cl.build_pairs(marked(spark, folder))[0]


def q_clean_funnel(spark, folder):
    return cl.build_pairs(marked(spark, folder))[1]


def q_pooled_summary(spark, folder):
    parts = [cl.clean_rows(m, s) for s, m in marked(spark, folder).items()]
    each = staged(parts[0].unionByName(parts[1]).unionByName(parts[2]), "cleaned")
    return cl.pooled_summary(each, each.dropDuplicates())


def q_assay_methods(spark, folder):
    methods = cl.assay_methods(tcell(spark, folder))
    return methods.withColumn("methods", F.array_join("methods", ";"))


def q_assay_semi_join(spark, folder):
    rows = iedb(spark, folder).select(
        cl.same_scheme("`Epitope|IEDB IRI`").alias("epi"),
        cl.same_scheme("`Reference|IEDB IRI`").alias("ref"),
        F.col("`Chain 2|CDR3 Curated`").alias("cdr3"),
    )
    return rows.join(cl.strong_assays(tcell(spark, folder)), ["epi", "ref"], "left_semi")


def q_drop_promiscuous(spark, folder):
    return cl.drop_promiscuous(view(spark, folder, "positives"))


def q_promiscuous_count(spark, folder):
    return cl.promiscuous_count(view(spark, folder, "positives"))


def q_mhc_class(spark, folder):
    pairs = view(spark, folder, "positives")
    return pairs.groupBy(
        "mhc_a", mhc_class("mhc_a").alias("cls"), mhc_class("mhc_a", True).alias("strict_cls")
    ).agg(F.count("*").alias("n_rows"))


def q_gene_preclean(spark, folder):
    rows = view(spark, folder, "raw_vdjdb")
    return rows.groupBy(
        preclean_gene(strip("v_segm")).alias("v_gene"), preclean_gene(strip("j_segm")).alias("j_gene")
    ).agg(F.count("*").alias("n_rows"))


def q_gene_standardize(spark, folder):
    rows = view(spark, folder, "positives")
    rows = rows.withColumn("v_gene", F.when(F.length("cdr3") % 2 == 0, F.regexp_replace("v_gene", r"\*01$", "")).otherwise(F.col("v_gene")))
    return cl.standardize_genes(rows, genes(spark, folder))


def q_normalise_paired(spark, folder):
    return cl.normalise_paired(view(spark, folder, "paired")).select(
        "cdr3a", "cdr3b", "tcra", "tcrb", "peptide", "va", "hla"
    )


def q_paired_to_single(spark, folder):
    single = cl.paired_to_single(cl.normalise_paired(view(spark, folder, "paired")))
    return single.select("cdr3", "v_gene", "j_gene", "mhc_a", "mhc_class", "peptide")


def q_attach_paired_cdr3(spark, folder):
    paired = cl.normalise_paired(view(spark, folder, "paired"))
    return cl.attach_paired_cdr3(paired).select("cdr3", "cdr3a", "cdr3b", "peptide")


def q_keep_peptides(spark, folder):
    from bindery.operators.split import top_classes

    paired = view(spark, folder, "paired")
    top = [r[0].upper() for r in top_classes(paired, "peptide", 3).collect()]
    return cl.keep_peptides(paired, top).select("peptide", "cdr3a", "cdr3b", "hla")


def q_null_counts(spark, folder):
    return cl.null_counts(iedb(spark, folder), ["`Chain 2|CDR3 Calculated`", "`Chain 2|Curated J Gene`"])


# V and J germline tables by rule from the gene symbols that occur.
V_REF = """v_ref AS (
  SELECT v_gene, translate(substr(md5('v' || v_gene), 1, 12), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS body,
         CASE WHEN v_gene < 'TRBV15' THEN 'MG' || substr(translate(md5('l' || v_gene), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 1, 5) END AS leader,
         CASE WHEN length(v_gene) % 2 = 0 THEN 'CASS' ELSE 'CAT' END AS anchor
  FROM (SELECT DISTINCT v_gene FROM positives) v)"""
J_REF = """j_ref AS (
  SELECT j_gene, CASE WHEN j_gene = 'TRBJ2-2*01' THEN 'GEG*S' ELSE 'G' || translate(substr(md5('j' || j_gene), 1, 6), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') END AS body,
         CASE WHEN j_gene LIKE '%-4*01' THEN 'L' WHEN j_gene NOT LIKE '%-3*01' THEN 'F' END AS terminal
  FROM (SELECT DISTINCT j_gene FROM positives) j WHERE j_gene <> 'TRBJ1-7*01')"""
_CORE = "CASE WHEN length(cdr3) % 3 = 0 THEN substr(cdr3, 2) ELSE cdr3 END"


def germline(spark, folder):
    pairs = stored(spark, folder, "positives")
    pairs.createOrReplaceTempView("positives")
    v_ref = spark.sql(f"WITH {V_REF} SELECT * FROM v_ref")
    j_ref = spark.sql(f"WITH {J_REF} SELECT * FROM j_ref")
    return pairs.withColumn("cdr3", F.expr(_CORE)), v_ref, j_ref


def q_stitch_full_sequence(spark, folder):
    pairs, v_ref, j_ref = germline(spark, folder)
    full = st.stitch_full_sequence(pairs, v_ref, j_ref, constant="EDLNK", leader=True)
    return st.full_sequence_table(full)


def q_stitch_report(spark, folder):
    pairs, v_ref, j_ref = germline(spark, folder)
    return st.stitch_report(st.stitch_full_sequence(pairs, v_ref, j_ref, constant="EDLNK", leader=True))


QUERIES = {
    "clean_vdjdb": q_clean_vdjdb,
    "clean_iedb": q_clean_iedb,
    "clean_mcpas": q_clean_mcpas,
    "clean_pairs": q_clean_pairs,
    "clean_funnel": q_clean_funnel,
    "pooled_summary": q_pooled_summary,
    "assay_methods": q_assay_methods,
    "assay_semi_join": q_assay_semi_join,
    "drop_promiscuous": q_drop_promiscuous,
    "promiscuous_count": q_promiscuous_count,
    "mhc_class": q_mhc_class,
    "gene_preclean": q_gene_preclean,
    "gene_standardize": q_gene_standardize,
    "normalise_paired": q_normalise_paired,
    "paired_to_single": q_paired_to_single,
    "attach_paired_cdr3": q_attach_paired_cdr3,
    "keep_peptides": q_keep_peptides,
    "null_counts": q_null_counts,
    "stitch_full_sequence": q_stitch_full_sequence,
    "stitch_report": q_stitch_report,
}

# --- SQL ------------------------------------------------------------------------------


def _pre(c):
    return (
        rf"trim(regexp_replace(regexp_replace({c}, ':(\d)', '*\1', 'g'), '(?i)/.*|\s+or\s+.*', '', 'g'))"
    )


def _cls(c, one="HLA CLASS I"):
    up = f"upper(trim(coalesce({c}, '')))"
    first = rf"regexp_matches({up}, '{one}|HLA-[ABCEXFG]\b|B2M|HLA-E|HLA-C|HLA-A|HLA-B')"
    second = rf"regexp_matches({up}, 'HLA CLASS II|HLA-DP|HLA-DQ|HLA-DR')"
    return (
        f"CASE WHEN {first} AND NOT {second} THEN 'MHCI' WHEN {second} AND NOT {first} THEN 'MHCII' ELSE '' END"
    )


def _t(c):
    return f"trim(coalesce({c}, ''))"


def _iri(c):
    return f"trim(replace(coalesce({c}, ''), 'https://', 'http://'))"


_WILD = r"regexp_matches(cdr3, '[X*?]') OR regexp_matches(peptide, '[X*?]')"
_STD = "cdr3, tcr_chain, v_gene, j_gene, peptide, mhc_a, mhc_b, mhc_class"
_STRONG = "'multimer/tetramer', 'surface plasmon resonance (SPR)', 'x-ray crystallography'"
_NEED7 = "cdr3 <> '' AND tcr_chain <> '' AND v_gene <> '' AND j_gene <> '' AND peptide <> '' AND mhc_a <> '' AND mhc_class <> ''"


def _gened(name, source):
    """Standard rows with cleaned gene symbols replaced by their functional allele."""
    return f"""{name} AS (SELECT cdr3, tcr_chain, gv.allele AS v_gene, gj.allele AS j_gene, peptide, mhc_a, mhc_b, mhc_class
      FROM (SELECT * REPLACE ({_pre('v_gene')} AS v_gene, {_pre('j_gene')} AS j_gene) FROM {source}) s
      JOIN gene_ref gv ON gv.symbol = s.v_gene AND gv.functional
      JOIN gene_ref gj ON gj.symbol = s.j_gene AND gj.functional)"""


CLEAN_SQL = f"""
  v0 AS (SELECT {_t('cdr3')} AS cdr3, {_t('gene')} AS tcr_chain, {_t('v_segm')} AS v_gene, {_t('j_segm')} AS j_gene,
                {_t('antigen_epitope')} AS peptide, {_t('mhc_a')} AS mhc_a, {_t('mhc_b')} AS mhc_b, {_t('mhc_class')} AS mhc_class,
                {_t('species')} AS species, score FROM raw_vdjdb),
  v1 AS (SELECT * FROM v0 WHERE species = 'HomoSapiens'),
  v2 AS (SELECT * FROM v1 WHERE tcr_chain = 'TRB'),
  v3 AS (SELECT * FROM v2 WHERE {_NEED7} AND mhc_b <> '' AND species <> ''),
  v4 AS (SELECT * FROM v3 WHERE NOT ({_WILD})),
  v5 AS (SELECT * FROM v4 WHERE score >= 1),
  {_gened('v6', 'v5')},
  v7 AS (SELECT DISTINCT {_STD} FROM v6),
  i0 AS (SELECT CASE WHEN {_t('cdr3_curated')} <> '' THEN {_t('cdr3_curated')} ELSE {_t('cdr3_calculated')} END AS cdr3,
                'TRB' AS tcr_chain,
                CASE WHEN {_t('v_curated')} <> '' THEN {_t('v_curated')} ELSE {_t('v_calculated')} END AS v_gene,
                CASE WHEN {_t('j_curated')} <> '' THEN {_t('j_curated')} ELSE {_t('j_calculated')} END AS j_gene,
                {_t('epitope_name')} AS peptide, {_t('mhc_allele_names')} AS mhc_a, '' AS mhc_b,
                {_cls('mhc_allele_names')} AS mhc_class, coalesce(organism, '') AS organism, {_t('chain_type')} AS chain_type,
                {_iri('epitope_iri')} AS epi, {_iri('reference_iri')} AS ref FROM raw_iedb),
  i1 AS (SELECT * FROM i0 WHERE contains(organism, 'NCBITaxon_9606')),
  i2 AS (SELECT * FROM i1 WHERE chain_type = 'beta'),
  i3 AS (SELECT * FROM i2 WHERE EXISTS (SELECT 1 FROM tcell t WHERE {_iri('t.epitope_iri')} = epi
           AND {_iri('t.reference_iri')} = ref AND t.method IN ({_STRONG}))),
  i4 AS (SELECT * FROM i3 WHERE {_NEED7}),
  i5 AS (SELECT * FROM i4 WHERE NOT ({_WILD})),
  {_gened('i6', 'i5')},
  i7 AS (SELECT DISTINCT {_STD} FROM i6),
  m0 AS (SELECT {_t('cdr3_beta')} AS cdr3, 'TRB' AS tcr_chain, {_t('trbv')} AS v_gene, {_t('trbj')} AS j_gene,
                {_t('epitope_peptide')} AS peptide, {_t('mhc')} AS mhc_a, '' AS mhc_b, {_cls('mhc')} AS mhc_class,
                {_t('species')} AS species FROM raw_mcpas),
  m1 AS (SELECT * FROM m0 WHERE species = 'Human'),
  m2 AS (SELECT * FROM m1 WHERE {_NEED7}),
  m3 AS (SELECT * FROM m2 WHERE NOT ({_WILD})),
  {_gened('m4', 'm3')},
  m5 AS (SELECT DISTINCT {_STD} FROM m4)
"""
_ALL_VIEWS = ["raw_vdjdb", "raw_iedb", "tcell", "raw_mcpas", "gene_ref"]


def _clean(sql):
    return with_views(f"WITH {CLEAN_SQL} {sql}", *_ALL_VIEWS)


def _funnel_rows(source, steps):
    out = []
    for no, (step, rel) in enumerate(steps):
        prior = f"(SELECT count(*) FROM {steps[no - 1][1]}) - (SELECT count(*) FROM {rel})" if no else "0"
        out.append(
            f"SELECT '{source}' AS source, {no} AS step_no, '{step}' AS step, "
            f"(SELECT count(*) FROM {rel}) AS n_rows, {prior} AS n_removed"
        )
    return " UNION ALL ".join(out)


_FUNNEL = " UNION ALL ".join([
    _funnel_rows("VDJdb", [
        ("loaded_rows", "v0"), ("after_species", "v1"), ("after_chain", "v2"), ("after_required_fields", "v3"),
        ("after_wildcards", "v4"), ("after_confidence_filter", "v5"), ("after_gene_standardization", "v6"),
        ("after_dedup", "v7")]),
    _funnel_rows("IEDB", [
        ("loaded_rows", "i0"), ("after_species", "i1"), ("after_chain", "i2"), ("after_confidence_filter", "i3"),
        ("after_required_fields", "i4"), ("after_wildcards", "i5"), ("after_gene_standardization", "i6"),
        ("after_dedup", "i7")]),
    _funnel_rows("McPAS", [
        ("loaded_rows", "m0"), ("after_species", "m1"), ("after_required_fields", "m2"), ("after_wildcards", "m3"),
        ("after_gene_standardization", "m4"), ("after_dedup", "m5")]),
])
_UNION = (
    f"SELECT {_STD}, 'VDJdb' AS source FROM v7 UNION ALL SELECT {_STD}, 'IEDB' AS source FROM i7 "
    f"UNION ALL SELECT {_STD}, 'McPAS' AS source FROM m5"
)
_GAPLESS = "upper(trim(translate(coalesce({c}, ''), '-.', ''))) AS {c}"

_STITCH = f"""
  WITH {V_REF}, {J_REF},
  cut AS (SELECT * REPLACE ({_CORE} AS cdr3) FROM positives),
  parts AS (SELECT cut.*, v.body AS vb, v.leader, v.anchor, j.body AS jb, coalesce(j.terminal, 'F') AS terminal,
                   CASE WHEN cut.cdr3 LIKE 'C%' THEN cut.cdr3 ELSE 'C' || cut.cdr3 END AS base
            FROM cut LEFT JOIN v_ref v USING (v_gene) LEFT JOIN j_ref j USING (j_gene)),
  built AS (SELECT *, CASE WHEN vb IS NULL OR jb IS NULL THEN NULL ELSE coalesce(leader, '') || vb || base ||
                     CASE WHEN ends_with(base, terminal) THEN '' ELSE terminal END || jb || 'EDLNK' END AS full_any FROM parts),
  done AS (SELECT *, CASE WHEN contains(full_any, '*') THEN NULL ELSE full_any END AS full_aa FROM built),
  spans AS (SELECT *, list_filter([cdr3, CASE WHEN cdr3 NOT LIKE 'C%' THEN 'C' || cdr3 END,
      cdr3 || 'F', CASE WHEN cdr3 NOT LIKE 'C%' THEN 'C' || cdr3 || 'F' END,
      cdr3 || 'W', CASE WHEN cdr3 NOT LIKE 'C%' THEN 'C' || cdr3 || 'W' END,
      cdr3 || 'L', CASE WHEN cdr3 NOT LIKE 'C%' THEN 'C' || cdr3 || 'L' END,
      cdr3 || 'V', CASE WHEN cdr3 NOT LIKE 'C%' THEN 'C' || cdr3 || 'V' END],
      lambda t: t IS NOT NULL AND contains(full_aa, t))[1] AS hit FROM done)
"""

ORACLE = {
    "clean_vdjdb": _clean("SELECT *, 'VDJdb' AS source FROM v7"),
    "clean_iedb": _clean("SELECT *, 'IEDB' AS source FROM i7"),
    "clean_mcpas": _clean("SELECT *, 'McPAS' AS source FROM m5"),
    "clean_pairs": _clean(_UNION),
    "clean_funnel": _clean(_FUNNEL),
    "pooled_summary": _clean(
        f"""SELECT source || ' cleaned rows' AS quantity, count(*) AS value FROM ({_UNION}) GROUP BY source
            UNION ALL SELECT 'sum before pooling', count(*) FROM ({_UNION})
            UNION ALL SELECT 'removed during pooling', count(*) - count(DISTINCT u) FROM ({_UNION}) u
            UNION ALL SELECT 'final combined rows', count(DISTINCT u) FROM ({_UNION}) u"""
    ),
    "assay_methods": with_views(
        f"""SELECT {_iri('epitope_iri')} AS epi, {_iri('reference_iri')} AS ref,
                   coalesce(string_agg(DISTINCT method, ';' ORDER BY method), '') AS methods
            FROM tcell GROUP BY 1, 2""",
        "tcell",
    ),
    "assay_semi_join": with_views(
        f"""SELECT {_iri('epitope_iri')} AS epi, {_iri('reference_iri')} AS ref, cdr3_curated AS cdr3
            FROM raw_iedb r WHERE ({_iri('epitope_iri')}, {_iri('reference_iri')}) IN
              (SELECT ({_iri('epitope_iri')}, {_iri('reference_iri')}) FROM tcell WHERE method IN ({_STRONG}))""",
        "raw_iedb", "tcell",
    ),
    "drop_promiscuous": with_views(
        """SELECT * FROM positives WHERE cdr3 NOT IN
             (SELECT cdr3 FROM positives GROUP BY cdr3 HAVING count(DISTINCT peptide) > 1)""",
        "positives",
    ),
    "promiscuous_count": with_views(
        """SELECT count(*) AS n_rows, count(DISTINCT cdr3) AS n_cdr3s FROM positives WHERE cdr3 IN
             (SELECT cdr3 FROM positives GROUP BY cdr3 HAVING count(DISTINCT peptide) > 1)""",
        "positives",
    ),
    "mhc_class": with_views(
        f"""SELECT mhc_a, {_cls('mhc_a')} AS cls, {_cls('mhc_a', one="HLA CLASS I" + chr(92) + "b")} AS strict_cls,
                   count(*) AS n_rows FROM positives GROUP BY 1, 2, 3""",
        "positives",
    ),
    "gene_preclean": with_views(
        f"""SELECT {_pre('trim(v_segm)')} AS v_gene, {_pre('trim(j_segm)')} AS j_gene, count(*) AS n_rows
            FROM raw_vdjdb GROUP BY 1, 2""",
        "raw_vdjdb",
    ),
    "gene_standardize": with_views(
        r"""SELECT p.* REPLACE (gv.allele AS v_gene, gj.allele AS j_gene)
            FROM (SELECT * REPLACE (CASE WHEN length(cdr3) % 2 = 0 THEN regexp_replace(v_gene, '\*01$', '') ELSE v_gene END AS v_gene) FROM positives) p
            JOIN gene_ref gv ON gv.symbol = p.v_gene AND gv.functional
            JOIN gene_ref gj ON gj.symbol = p.j_gene AND gj.functional""",
        "positives", "gene_ref",
    ),
    "normalise_paired": with_views(
        f"""SELECT {', '.join(_GAPLESS.format(c=c) for c in ('cdr3a', 'cdr3b', 'tcra', 'tcrb', 'peptide'))}, va, hla
            FROM paired""",
        "paired",
    ),
    "paired_to_single": with_views(
        f"""SELECT {_GAPLESS.format(c='cdr3b').replace(' AS cdr3b', ' AS cdr3')}, vb AS v_gene, jb AS j_gene, hla AS mhc_a,
                   'MHCI' AS mhc_class, upper(peptide) AS peptide FROM paired""",
        "paired",
    ),
    "attach_paired_cdr3": with_views(
        f"""SELECT cdr3a || cdr3b AS cdr3, cdr3a, cdr3b, peptide
            FROM (SELECT {_GAPLESS.format(c='cdr3a')}, {_GAPLESS.format(c='cdr3b')}, upper(peptide) AS peptide FROM paired)
            WHERE length(cdr3a || cdr3b) > 0""",
        "paired",
    ),
    "keep_peptides": with_views(
        """SELECT peptide, cdr3a, cdr3b, hla FROM paired WHERE upper(peptide) IN
             (SELECT upper(peptide) FROM (SELECT peptide, count(*) AS n FROM paired GROUP BY 1 ORDER BY n DESC, peptide LIMIT 3))""",
        "paired",
    ),
    "null_counts": with_views(
        """SELECT count(*) AS n_rows, count(*) FILTER (WHERE cdr3_calculated IS NULL OR j_curated IS NULL) AS n_dropped,
                  count(*) FILTER (WHERE cdr3_calculated IS NOT NULL AND j_curated IS NOT NULL) AS n_left
           FROM raw_iedb""",
        "raw_iedb",
    ),
    "stitch_full_sequence": with_views(
        f"""{_STITCH} SELECT full_aa, instr(full_aa, hit) - 1 AS cdr3_start, instr(full_aa, hit) - 1 + length(hit) AS cdr3_end,
              peptide, cdr3, v_gene, j_gene, mhc_a, mhc_b, mhc_class, source FROM spans WHERE full_aa IS NOT NULL""",
        "positives",
    ),
    "stitch_report": with_views(
        f"""{_STITCH} SELECT count(*) AS n_rows, count(*) FILTER (WHERE full_aa IS NULL) AS n_failed,
              round(100.0::DOUBLE * count(*) FILTER (WHERE full_aa IS NULL) / count(*), 2) AS failed_pct,
              count(*) FILTER (WHERE full_aa IS NOT NULL AND hit IS NULL) AS span_misses,
              count(*) FILTER (WHERE hit IS NOT NULL AND contains(hit, upper(cdr3))) AS span_ok FROM spans""",
        "positives",
    ),
}
