"""Queries on negative sampling and their SQL."""

from __future__ import annotations

from bindery.operators import negatives as neg
from bindery.operators import split as sp
from bindery.operators.clean import normalise_paired
from bindery.staging import staged
from catalog.views import stored, view, with_views

ALL = "cdr3, tcr_chain, v_gene, j_gene, peptide, mhc_a, mhc_b, mhc_class, source"
RECEPTOR = "cdr3, v_gene, j_gene"
CONTEXT = "tcr_chain, mhc_a, mhc_b, mhc_class"


def _draws(seed_key: str, most: int, rest: str) -> str:
    """Columns c0.. of the numbers drawn by one pair, and ``e`` as each of them: number t is
    a hash up to m - k + t, or that bound where the hash was drawn before."""
    lines = []
    for t in range(most):
        draw = f"('0x' || substr(md5(concat_ws('|', '42', {seed_key}, {t})), 1, 15))::BIGINT % greatest(1, m - k + {t + 1})"
        before = ", ".join(f"c{s}" for s in range(t))
        lines.append(f"h{t} AS MATERIALIZED (SELECT *, {draw} AS d FROM {'base' if not t else f'g{t - 1}'})")
        taken = f"CASE WHEN d IN ({before}) THEN m - k + {t} ELSE d END" if t else "d"
        lines.append(f"g{t} AS MATERIALIZED (SELECT * EXCLUDE (d), {taken} AS c{t} FROM h{t})")
    chosen = ", ".join(f"c{t}" for t in range(most))
    return f"""{', '.join(lines)},
    asked AS (SELECT {rest}, unnest(list_slice([{chosen}], 1, k)) AS e FROM g{most - 1})"""


def drawn_sql(by: str = "", source: str = "positives", cap: bool = True) -> str:
    """The brute-force statement of the draw: every pool written out and ranked.

    ``by`` is empty or a column name followed by a comma.
    """
    on = f"using ({by} peptide)"
    split_col = by.rstrip(", ")
    same_part = f"AND a.{split_col} = b.{split_col}" if by else ""
    both = f"a.{split_col}," if by else ""
    limit = (
        f"""capped AS (SELECT * FROM (SELECT *, row_number() OVER (
              {'PARTITION BY ' + split_col if by else ''}
              ORDER BY md5(concat_ws('|', 'cap42', {RECEPTOR}, peptide)), {RECEPTOR}, peptide) AS q FROM kept) z
            {'JOIN (SELECT ' + by + ' count(*) * 2 AS lim FROM ' + source + ' GROUP BY ' + split_col + ') USING (' + split_col + ')' if by else ', (SELECT count(*) * 2 AS lim FROM ' + source + ') y'}
            WHERE q <= lim)"""
        if cap
        else "capped AS (SELECT * FROM kept)"
    )
    return f"""
    numbered AS (SELECT *, row_number() OVER (PARTITION BY {by} peptide
                   ORDER BY md5(concat_ws('|', '42', {ALL}{', ' + split_col if by else ''})), {ALL}) AS i,
                 CASE WHEN count(*) OVER (PARTITION BY {by} peptide) >= 10 THEN 'test' ELSE 'left-out' END AS grp
                 FROM {source}),
    bound AS (SELECT DISTINCT {by} grp, {RECEPTOR}, peptide FROM numbered),
    donors AS (SELECT *, row_number() OVER (PARTITION BY {by} grp
                   ORDER BY md5(concat_ws('|', '42', {RECEPTOR})), {RECEPTOR}) AS pos
               FROM (SELECT DISTINCT {by} grp, {RECEPTOR} FROM bound)),
    words AS (SELECT DISTINCT {by} peptide FROM {source}),
    far AS (SELECT {both} a.peptide, b.peptide AS other FROM words a JOIN words b
              ON levenshtein(a.peptide, b.peptide) > 3 {same_part}),
    pool AS (SELECT DISTINCT {('f.' + by) if by else ''} f.peptide, b.grp, b.cdr3, b.v_gene, b.j_gene
             FROM far f JOIN bound b ON b.peptide = f.other {'AND b.' + split_col + ' = f.' + split_col if by else ''}
             WHERE NOT EXISTS (SELECT 1 FROM {source} k WHERE k.cdr3 = b.cdr3 AND k.peptide = f.peptide
                               {'AND k.' + split_col + ' = f.' + split_col if by else ''})),
    ranked AS (SELECT pool.*, row_number() OVER (PARTITION BY {by} peptide, grp ORDER BY pos) - 1 AS e,
                      count(*) OVER (PARTITION BY {by} peptide, grp) AS m
               FROM pool JOIN donors USING ({by} grp, {RECEPTOR})),
    pools AS (SELECT DISTINCT {by} peptide, grp, m, least(CASE grp WHEN 'test' THEN 3 ELSE 2 END, m) AS k
              FROM ranked),
    base AS (SELECT {by} peptide, p.grp, n.i, {CONTEXT}, m, k FROM numbered n JOIN pools p {on}),
    {_draws(f"{by} peptide, grp, i", 3, f"{by} peptide, grp, i, {CONTEXT}")},
    kept AS (SELECT {by} {RECEPTOR}, peptide, {CONTEXT} FROM
               (SELECT *, row_number() OVER (PARTITION BY {by} {RECEPTOR}, peptide
                          ORDER BY i, CASE WHEN grp = 'test' THEN 0 ELSE 1 END) AS first
                FROM asked JOIN ranked USING ({by} peptide, grp, e)) x WHERE first = 1),
    {limit}
    """


def q_peptide_groups(spark, folder):
    return neg.peptide_groups(view(spark, folder, "positives"))


def q_peptide_distance(spark, folder):
    return neg.near_peptides(view(spark, folder, "positives"))


def q_donor_pool(spark, folder):
    pairs = stored(spark, folder, "positives")
    numbered = staged(neg.number_pairs(pairs, [], 42, neg.MIN_PAIRS), "numbered")
    donors = staged(neg.number_donors(numbered, [], neg.RECEPTOR_KEY, 42), "donors")
    out = neg.left_out_donors(numbered, donors, [], neg.RECEPTOR_KEY, ["cdr3"], neg.FAR_DISTANCE)
    sizes = neg.pool_sizes(numbered, donors, out, [])
    return sizes.select("peptide", "grp", "pool")


def q_negatives(spark, folder):
    return neg.negatives(stored(spark, folder, "positives"))


def q_negatives_uncapped(spark, folder):
    return neg.negatives(stored(spark, folder, "positives"), max_ratio=None)


def q_labelled_pairs(spark, folder):
    pairs = stored(spark, folder, "positives")
    return neg.labelled(pairs, neg.negatives(pairs))


def q_ratio_report(spark, folder):
    pairs = stored(spark, folder, "positives")
    return neg.ratio_report(pairs, neg.negatives(pairs))


def q_overall_ratio(spark, folder):
    pairs = stored(spark, folder, "positives")
    return neg.overall_ratio(neg.ratio_counts(pairs, neg.negatives(pairs)))


def q_labelled_splits(spark, folder):
    pairs = sp.holdout(stored(spark, folder, "positives"), "peptide", seed=42)
    return neg.labelled(pairs, neg.negatives(pairs, by=["split"]))


def q_paired_negatives(spark, folder):
    pairs = staged(normalise_paired(view(spark, folder, "paired")), "paired")
    return neg.paired_negatives(pairs)


def q_random_swap_negatives(spark, folder):
    return neg.random_swaps(stored(spark, folder, "positives"))


def q_shuffled_pairs(spark, folder):
    return neg.shuffled_pairs(stored(spark, folder, "positives"))


SPLIT_SQL = """
    keys AS (SELECT peptide, row_number() OVER (ORDER BY md5(concat_ws('|', '42', peptide)), peptide) AS r,
                    count(*) OVER () AS n FROM (SELECT DISTINCT peptide FROM positives)),
    cuts AS (SELECT *, greatest(1, round_even(n * 0.2::DOUBLE, 0)) AS n_test,
                       greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS n_val FROM keys),
    parts AS (SELECT peptide, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_val THEN 'val'
                              ELSE 'train' END AS split FROM cuts),
    placed AS (SELECT positives.*, split FROM positives JOIN parts USING (peptide))
"""

_PAIRED_NORMAL = """
    pn AS (SELECT upper(trim(translate(cdr3b, '-.', ''))) AS cdr3b, upper(peptide) AS peptide,
                  va, ja, vb, jb, hla, upper(trim(translate(cdr3a, '-.', ''))) AS cdr3a,
                  upper(cdr1a) AS cdr1a, upper(cdr2a) AS cdr2a, upper(cdr1b) AS cdr1b, upper(cdr2b) AS cdr2b,
                  upper(translate(tcra, '-.', '')) AS tcra, upper(translate(tcrb, '-.', '')) AS tcrb,
                  upper(translate(cdr3a_extended, '-.', '')) AS cdr3a_extended,
                  upper(translate(cdr3b_extended, '-.', '')) AS cdr3b_extended FROM paired)
"""
_PAIRED_COLUMNS = (
    "cdr3b, peptide, va, ja, vb, jb, hla, cdr3a, cdr1a, cdr2a, cdr1b, cdr2b, "
    "tcra, tcrb, cdr3a_extended, cdr3b_extended"
)
_PAIRED_KEY = "cdr3a, cdr3b, va, vb"
_PAIRED_REST = (
    "ja, tcra, cdr1a, cdr2a, cdr3a_extended, jb, tcrb, cdr1b, cdr2b, cdr3b_extended"
)
PAIRED_SQL = f"""
    {_PAIRED_NORMAL},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY peptide
                   ORDER BY md5(concat_ws('|', '42', {_PAIRED_COLUMNS})), {_PAIRED_COLUMNS}) AS i FROM pn),
    bound AS (SELECT DISTINCT {_PAIRED_KEY}, peptide FROM pn),
    donors AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', {_PAIRED_KEY})), {_PAIRED_KEY}) AS pos
               FROM (SELECT DISTINCT {_PAIRED_KEY} FROM pn)),
    words AS (SELECT DISTINCT peptide FROM pn),
    far AS (SELECT a.peptide, b.peptide AS other FROM words a JOIN words b
              ON levenshtein(a.peptide, b.peptide) > 3),
    pool AS (SELECT DISTINCT f.peptide, b.cdr3a, b.cdr3b, b.va, b.vb
             FROM far f JOIN bound b ON b.peptide = f.other
             WHERE NOT EXISTS (SELECT 1 FROM pn k WHERE k.cdr3a = b.cdr3a AND k.cdr3b = b.cdr3b
                               AND k.peptide = f.peptide)),
    ranked AS (SELECT pool.*, row_number() OVER (PARTITION BY peptide ORDER BY pos) - 1 AS e,
                      count(*) OVER (PARTITION BY peptide) AS m
               FROM pool JOIN donors USING ({_PAIRED_KEY})),
    pools AS (SELECT DISTINCT peptide, m, least(5, m) AS k FROM ranked),
    base AS (SELECT peptide, n.i, hla, m, k FROM numbered n JOIN pools p USING (peptide)),
    {_draws("peptide, 'test', i", 5, "peptide, i, hla")},
    kept AS (SELECT {_PAIRED_KEY}, peptide, hla FROM
               (SELECT *, row_number() OVER (PARTITION BY {_PAIRED_KEY}, peptide ORDER BY i) AS first
                FROM asked JOIN ranked USING (peptide, e)) x WHERE first = 1),
    records AS (SELECT * FROM (SELECT {_PAIRED_KEY}, {_PAIRED_REST}, row_number() OVER (
                  PARTITION BY {_PAIRED_KEY} ORDER BY {_PAIRED_REST}) AS q FROM pn) WHERE q = 1)
"""

QUERIES = {
    "peptide_groups": q_peptide_groups,
    "peptide_distance": q_peptide_distance,
    "donor_pool": q_donor_pool,
    "negatives": q_negatives,
    "negatives_uncapped": q_negatives_uncapped,
    "labelled_pairs": q_labelled_pairs,
    "ratio_report": q_ratio_report,
    "overall_ratio": q_overall_ratio,
    "labelled_splits": q_labelled_splits,
    "paired_negatives": q_paired_negatives,
    "random_swap_negatives": q_random_swap_negatives,
    "shuffled_pairs": q_shuffled_pairs,
}

_SHARED = "cdr3, tcr_chain, v_gene, j_gene, peptide, mhc_a, mhc_b, mhc_class"
_REPORT = """
    counts AS (SELECT peptide, coalesce(n_pos, 0) AS n_pos, coalesce(n_neg, 0) AS n_neg,
                      ((200 * coalesce(n_neg, 0) + n_pos) // (2 * n_pos)) / 100 AS ratio
               FROM (SELECT peptide, count(*) AS n_pos FROM positives GROUP BY peptide)
               FULL JOIN (SELECT peptide, count(*) AS n_neg FROM capped GROUP BY peptide) USING (peptide))
"""

ORACLE = {
    "peptide_groups": with_views(
        """SELECT peptide, count(*) AS n_pairs,
                  CASE WHEN count(*) >= 10 THEN 'test' ELSE 'left-out' END AS grp
           FROM positives GROUP BY peptide""",
        "positives",
    ),
    "peptide_distance": with_views(
        """WITH words AS (SELECT DISTINCT peptide FROM positives)
           SELECT a.peptide AS p1, b.peptide AS p2, levenshtein(a.peptide, b.peptide) AS dist
           FROM words a JOIN words b ON a.peptide < b.peptide
           WHERE levenshtein(a.peptide, b.peptide) <= 3""",
        "positives",
    ),
    "donor_pool": with_views(
        f"""WITH {drawn_sql(cap=False)}
            SELECT w.peptide, g.grp, count(p.cdr3) AS pool
            FROM words w CROSS JOIN (VALUES ('test'), ('left-out')) g(grp)
            LEFT JOIN pool p ON p.peptide = w.peptide AND p.grp = g.grp GROUP BY w.peptide, g.grp""",
        "positives",
    ),
    "negatives": with_views(
        f"""WITH {drawn_sql()} SELECT {RECEPTOR}, peptide, {CONTEXT}, 0 AS label FROM capped""",
        "positives",
    ),
    "negatives_uncapped": with_views(
        f"""WITH {drawn_sql(cap=False)}
            SELECT {RECEPTOR}, peptide, {CONTEXT}, 0 AS label FROM capped""",
        "positives",
    ),
    "labelled_pairs": with_views(
        f"""WITH {drawn_sql()} SELECT {_SHARED}, 1 AS label FROM positives
            UNION ALL SELECT {_SHARED}, 0 AS label FROM capped""",
        "positives",
    ),
    "ratio_report": with_views(
        f"""WITH {drawn_sql()}, {_REPORT} SELECT * FROM counts WHERE ratio < 5""", "positives"
    ),
    "overall_ratio": with_views(
        f"""WITH {drawn_sql()}, {_REPORT}
            SELECT sum(n_pos)::BIGINT AS n_pos, sum(n_neg)::BIGINT AS n_neg,
                   ((200 * sum(n_neg) + sum(n_pos))::BIGINT // (2 * sum(n_pos))::BIGINT) / 100 AS ratio FROM counts""",
        "positives",
    ),
    "labelled_splits": with_views(
        f"""WITH {SPLIT_SQL}, {drawn_sql('split,', 'placed')}
            SELECT {_SHARED}, split, 1 AS label FROM placed
            UNION ALL SELECT {_SHARED}, split, 0 AS label FROM capped""",
        "positives",
    ),
    "paired_negatives": with_views(
        f"""WITH {PAIRED_SQL}
            SELECT kept.*, {_PAIRED_REST}, 0 AS label FROM kept JOIN records USING ({_PAIRED_KEY})""",
        "paired",
    ),
    "random_swap_negatives": with_views(
        f"""WITH words AS (SELECT peptide AS negative,
                    row_number() OVER (ORDER BY md5(concat_ws('|', '0', peptide)), peptide) - 1 AS pos
                    FROM (SELECT DISTINCT peptide FROM positives)),
             free AS (SELECT c.cdr3, w.negative, row_number() OVER (PARTITION BY c.cdr3 ORDER BY w.pos) - 1 AS e,
                             count(*) OVER (PARTITION BY c.cdr3) AS m
                      FROM (SELECT DISTINCT cdr3 FROM positives) c CROSS JOIN words w
                      WHERE NOT EXISTS (SELECT 1 FROM positives k WHERE k.cdr3 = c.cdr3 AND k.peptide = w.negative)),
             sizes AS (SELECT DISTINCT cdr3, m FROM free)
             SELECT p.*, f.negative FROM positives p JOIN sizes s USING (cdr3) JOIN free f
               ON f.cdr3 = p.cdr3
              AND f.e = ('0x' || substr(md5(concat_ws('|', '0', {ALL})), 1, 8))::BIGINT % s.m""",
        "positives",
    ),
    "shuffled_pairs": with_views(
        """WITH l AS (SELECT cdr3, row_number() OVER (
                         ORDER BY md5(concat_ws('|', 'left7', cdr3, peptide)), cdr3, peptide) AS n FROM positives),
                r AS (SELECT peptide, row_number() OVER (
                         ORDER BY md5(concat_ws('|', 'right7', cdr3, peptide)), cdr3, peptide) AS n FROM positives)
           SELECT cdr3, peptide, 1 AS label FROM positives
           UNION ALL SELECT cdr3, peptide, 0 AS label FROM l JOIN r USING (n)""",
        "positives",
    ),
}
