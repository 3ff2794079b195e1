"""Receptor-shaped tables derived from the driver's tables.

Each view is one SQL text that both Spark and the checking engine accept, so a query and its
check start from the same rows. Spark gets the rows of ``paired`` made distinct earlier (see
``DISTINCT_FIRST``), which changes no row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from bindery.staging import staged

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# One row per line item. Brand and size name a family of near peptides; the item's keys decide on
# the member, so that the first members are common and the last ones rare.
LINES = """
SELECT
  'CASS' || translate(substr(md5('t' || cast(c.c_custkey AS string)), 1, cast(6 + c.c_custkey % 5 AS int)),
                      '0123456789abcdef', 'ACDEFGHIKLMNPQRS') || 'F'                  AS cdr3,
  'TRB'                                                                               AS tcr_chain,
  'TRBV' || cast(c.c_nationkey + 1 AS string) || '*01'                                AS v_gene,
  'TRBJ' || cast(1 + c.c_custkey % 2 AS string) || '-' ||
            cast(1 + c.c_custkey % 7 AS string) || '*01'                              AS j_gene,
  substr(b.base, 1, cast(l.pos - 1 AS int)) || 'W' || substr(b.base, cast(l.pos + 1 AS int)) AS peptide,
  CASE c.c_mktsegment WHEN 'BUILDING'   THEN 'HLA-A*02:01'
                      WHEN 'MACHINERY'  THEN 'HLA-B*07:02'
                      WHEN 'AUTOMOBILE' THEN 'HLA-DRB1*04:01'
                      WHEN 'HOUSEHOLD'  THEN 'HLA class II'
                      ELSE 'HLA class I' END                                          AS mhc_a,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'B2M' ELSE '' END                                AS mhc_b,
  CASE c.c_mktsegment WHEN 'BUILDING'   THEN 'MHCI'
                      WHEN 'MACHINERY'  THEN 'MHCI'
                      WHEN 'AUTOMOBILE' THEN 'MHCII'
                      WHEN 'HOUSEHOLD'  THEN 'MHCII'
                      ELSE 'MHCI' END                                                 AS mhc_class,
  CASE o.o_orderstatus WHEN 'O' THEN 'VDJdb' WHEN 'F' THEN 'IEDB' ELSE 'McPAS' END    AS source,
  l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
FROM (SELECT *, CASE WHEN k < 80 THEN 1 WHEN k < 130 THEN 2 WHEN k < 160 THEN 3
                    WHEN k < 178 THEN 4 WHEN k < 188 THEN 5 WHEN k < 194 THEN 6
                    WHEN k < 197 THEN 7 WHEN k < 199 THEN 8 ELSE 9 END AS pos
      FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   (l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 200 AS k FROM lineitem) n) l
JOIN orders   o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey  = c.c_custkey
JOIN (SELECT p_partkey,
             translate(substr(md5('p' || p_brand || cast(p_size % 8 AS string)), 1, 9),
                       '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS base
      FROM part) b ON l.l_partkey = b.p_partkey
"""

POSITIVES = """
SELECT DISTINCT cdr3, tcr_chain, v_gene, j_gene, peptide, mhc_a, mhc_b, mhc_class, source FROM lines
"""

# A second chain for every positive; gaps and lower case are put in on purpose.
PAIRED = """
SELECT cdr3b, peptide, va, ja, vb, jb, hla, cdr3a, cdr1a, cdr2a, cdr1b, cdr2b,
       'AQKV' || cdr1a || 'QSPR' || cdr2a || 'YLC' || replace(cdr3a, '-', '') || 'GKLTV' AS tcra,
       'EAGV' || cdr1b || 'FSPN' || cdr2b || 'YFC' || replace(cdr3b, '.', '') || 'GEGSR' AS tcrb,
       'C' || cdr3a || 'W' AS cdr3a_extended,
       'C' || cdr3b || 'F' AS cdr3b_extended
FROM (
  SELECT DISTINCT
    substr(cdr3, 1, 6) || '.' || substr(cdr3, 7) AS cdr3b,
    lower(peptide) AS peptide,
    'CA-' || translate(substr(md5('a' || cdr3), 1, 8), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') || 'F' AS cdr3a,
    'TRAV' || substr(v_gene, 5) AS va,
    'TRAJ' || cast(1 + length(cdr3) AS string) || '*01' AS ja,
    v_gene AS vb,
    j_gene AS jb,
    translate(substr(md5('1' || v_gene), 1, 5), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS cdr1a,
    translate(substr(md5('2' || v_gene), 1, 6), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS cdr2a,
    translate(substr(md5('3' || v_gene), 1, 5), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS cdr1b,
    translate(substr(md5('4' || v_gene), 1, 6), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS cdr2b,
    mhc_a AS hla
  FROM positives)
"""

# Raw exports: blanks around values, empty cells, wildcards and odd gene spellings.
RAW_VDJDB = """
SELECT gene, cdr3, v_segm, j_segm, species, mhc_a, mhc_b, mhc_class, antigen_epitope, score FROM (
SELECT CASE WHEN p.l_linenumber % 5 = 0 THEN 'TRA' ELSE 'TRB' END AS gene,
       CASE WHEN p.l_partkey % 17 = 0 THEN ''
            WHEN p.l_partkey % 19 = 0 THEN p.cdr3 || '*'
            ELSE ' ' || p.cdr3 END AS cdr3,
       CASE WHEN p.l_suppkey % 3 = 0 THEN replace(p.v_gene, '*', ':')
            WHEN p.l_suppkey % 3 = 1 THEN p.v_gene || '/4'
            ELSE p.v_gene END AS v_segm,
       CASE WHEN p.l_suppkey % 4 = 0 THEN p.j_gene || ' or TRBJ9-9' ELSE p.j_gene || '  ' END AS j_segm,
       CASE WHEN p.l_linenumber % 7 = 3 THEN 'MusMusculus' ELSE 'HomoSapiens' END AS species,
       p.mhc_a AS mhc_a,
       CASE WHEN p.l_partkey % 11 = 0 THEN NULL ELSE 'B2M' END AS mhc_b,
       p.mhc_class AS mhc_class,
       CASE WHEN p.l_partkey % 23 = 0 THEN p.peptide || 'X' ELSE p.peptide END AS antigen_epitope,
       cast(p.l_orderkey % 4 AS int) AS score
FROM lines p) t
"""

RAW_IEDB = """
SELECT p.cdr3 AS cdr3_curated,
       CASE WHEN length(p.cdr3) % 2 = 0 THEN NULL ELSE p.cdr3 || 'F' END AS cdr3_calculated,
       CASE WHEN length(p.cdr3) % 3 = 0 THEN '  ' ELSE p.v_gene END AS v_curated,
       replace(p.v_gene, '*', ':') AS v_calculated,
       CASE WHEN length(p.cdr3) % 4 = 0 THEN NULL ELSE p.j_gene || ' OR x' END AS j_curated,
       p.j_gene AS j_calculated,
       CASE WHEN substr(p.peptide, 1, 1) = 'A' THEN 'alpha' ELSE ' beta ' END AS chain_type,
       CASE WHEN substr(p.peptide, 2, 1) = 'C' THEN 'http://purl.obolibrary.org/obo/NCBITaxon_10090'
            ELSE 'http://purl.obolibrary.org/obo/NCBITaxon_9606' END AS organism,
       p.peptide AS epitope_name,
       'https://www.iedb.org/epitope/' || substr(md5(p.peptide), 1, 6) || ' ' AS epitope_iri,
       'http://www.iedb.org/reference/' || substr(md5(p.cdr3), 1, 2) AS reference_iri,
       p.mhc_a AS mhc_allele_names
FROM positives p
"""

TCELL = """
SELECT 'http://www.iedb.org/epitope/' || substr(md5(p.peptide), 1, 6) AS epitope_iri,
       'https://www.iedb.org/reference/' || substr(md5(p.cdr3), 1, 2) AS reference_iri,
       CASE WHEN length(p.cdr3) % 5 = 0 THEN 'multimer/tetramer'
            WHEN length(p.cdr3) % 5 = 1 THEN 'ELISPOT'
            WHEN length(p.cdr3) % 5 = 2 THEN 'surface plasmon resonance (SPR)'
            WHEN length(p.cdr3) % 5 = 3 THEN NULL
            ELSE 'ICS' END AS method
FROM positives p
"""

RAW_MCPAS = """
SELECT CASE WHEN substr(p.cdr3, 5, 1) = 'A' THEN NULL ELSE p.cdr3 || ' ' END AS cdr3_beta,
       p.v_gene AS trbv,
       p.j_gene AS trbj,
       CASE WHEN substr(p.peptide, 3, 1) = 'D' THEN p.peptide || '?' ELSE p.peptide END AS epitope_peptide,
       p.mhc_a AS mhc,
       CASE WHEN substr(p.cdr3, 6, 1) = 'C' THEN 'Mouse' ELSE 'Human ' END AS species
FROM positives p
"""

GENE_REF = """
SELECT DISTINCT symbol, allele, functional FROM (
  SELECT v_gene AS symbol, v_gene AS allele, length(v_gene) % 2 = 0 OR v_gene < 'TRBV5' AS functional FROM positives
  UNION ALL
  SELECT replace(v_gene, '*01', '') AS symbol, v_gene AS allele, length(v_gene) % 2 = 0 OR v_gene < 'TRBV5' AS functional FROM positives
  UNION ALL
  SELECT j_gene AS symbol, j_gene AS allele, j_gene <> 'TRBJ1-3*01' AS functional FROM positives) g
"""

# Many ties: 50 score values; the group size is uneven (group 0 holds over a third).
SCORED = """
SELECT CASE WHEN l_partkey % 5 < 2 THEN 'G0' ELSE 'G' || cast(l_partkey % 13 AS string) END AS peptide,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       l_quantity / 50 AS score,
       l_extendedprice / 100000 AS fine_score
FROM lineitem
"""

VIEWS = {
    "lines": LINES,
    "positives": POSITIVES,
    "paired": PAIRED,
    "raw_vdjdb": RAW_VDJDB,
    "raw_iedb": RAW_IEDB,
    "tcell": TCELL,
    "raw_mcpas": RAW_MCPAS,
    "gene_ref": GENE_REF,
    "scored": SCORED,
}
#: Rows of ``positives`` told apart by the columns that PAIRED makes all its own from. Its ``cdr3b``
#: tells every ``cdr3`` apart, ``vb``, ``jb`` and ``hla`` are columns as they are, and the others follow
#: from these; so its wide rows are distinct if these are, and need not be shuffled.
DISTINCT_FIRST = "SELECT DISTINCT cdr3, lower(peptide) AS peptide, v_gene, j_gene, mhc_a FROM {positives}"
_NEEDS = {
    "positives": ["lines"], "raw_vdjdb": ["lines"],
    **dict.fromkeys(["paired", "raw_iedb", "tcell", "raw_mcpas", "gene_ref"], ["positives"]),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(
    spark: SparkSession, folder: str, name: str, positives: DataFrame | None = None
) -> DataFrame:
    """A derived view as a DataFrame; ``positives`` stands in for that view when given."""
    if name == "positives" and positives is not None:
        return positives
    text = VIEWS[name]
    sources = {other: view(spark, folder, other, positives) for other in _NEEDS.get(name, [])}
    for base in TABLES:
        if re.search(rf"\b(FROM|JOIN)\s+{base}\b", text):
            sources[base] = table(spark, folder, base)
    if name == "paired":
        sources["positives"] = spark.sql(DISTINCT_FIRST, positives=sources["positives"])
        text = text.replace("SELECT DISTINCT", "SELECT")
    for key, df in sources.items():
        text = re.sub(rf"\b(FROM|JOIN)\s+{key}\b", rf"\1 {{{key}}}", text)
    return spark.sql(text, **sources)


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived view written once, for queries that read it several times."""
    return staged(view(spark, folder, name), name)


def _with_needs(name: str) -> list[str]:
    """The views that a view stands on, and itself, in order of definition."""
    return [v for need in _NEEDS.get(name, []) for v in _with_needs(need)] + [name]


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the named views, and those they need, as leading WITH terms."""
    wanted: list[str] = []
    for name in names:
        for part in _with_needs(name):
            if part not in wanted:
                wanted.append(part)
    terms = [f"{n} AS ({VIEWS[n]})" for n in wanted]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(terms)}, {body[5:]}"
    return f"WITH {', '.join(terms)} {body}"
