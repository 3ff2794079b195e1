"""Negative pairs: a receptor is swapped onto a peptide far from the ones it binds.

The pool of a peptide is every receptor of the group with at least one far peptide that
is not a known binder. Nearly every receptor qualifies for nearly every peptide, so a
pool is never written out: only the receptors it leaves out are, and draws step over
them (``nth_unlisted``). Work grows with the draws plus the left-out receptors.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.constants import (
    DRAWS_COMMON,
    DRAWS_PAIRED,
    DRAWS_RARE,
    FAR_DISTANCE,
    LABELLED_COLUMNS,
    MAX_RATIO,
    MIN_PAIRS,
    PAIRED_RECEPTOR,
    SPLIT_COLUMN,
)
from bindery.functions.text import deletions
from bindery.operators.order import (
    CELL_ROWS,
    MAX_CELLS,
    distinct_draws,
    group_digits,
    hash_int,
    hash_text,
    hashed_rank,
    nth_unlisted,
    ranked_by_hash,
    take_hashed,
    take_hashed_by,
)
from bindery.staging import staged

RECEPTOR_KEY = ["cdr3", "v_gene", "j_gene"]
CONTEXT = ["tcr_chain", "mhc_a", "mhc_b", "mhc_class"]
#: Parts in which the receptors of one peptide meet its near peptides.
PARTS = 32


def peptide_groups(
    pairs: DataFrame, min_pairs: int = MIN_PAIRS, by: Sequence[str] = ()
) -> DataFrame:
    """Pairs per peptide; peptides with fewer than ``min_pairs`` are ``left-out``."""
    counts = pairs.groupBy(*by, "peptide").agg(F.count("*").alias("n_pairs"))
    return counts.withColumn("grp", _group_name(F.col("n_pairs"), min_pairs))


def _group_name(n: Column, min_pairs: int) -> Column:
    return F.when(n >= min_pairs, "test").otherwise("left-out")


def near_peptides(peptides: DataFrame, threshold: int = FAR_DISTANCE) -> DataFrame:
    """Pairs ``p1 < p2`` of distinct peptides within ``threshold`` edits, with the distance.

    Two texts within t edits share a text that each reaches by removing at most t
    characters, so an equi join on those texts finds every near pair; the distance is
    then computed for the candidates only. All other pairs are far.
    """
    words = peptides.select("peptide").distinct()
    cuts = words.select("peptide", F.explode(deletions(F.col("peptide"), threshold)).alias("cut"))
    left = cuts.select("cut", F.col("peptide").alias("p1"))
    right = cuts.select("cut", F.col("peptide").alias("p2"))
    found = left.join(right, "cut").filter(F.col("p1") < F.col("p2"))
    found = found.select("p1", "p2").distinct()
    distance = F.levenshtein("p1", "p2", threshold)
    return found.select("p1", "p2", distance.alias("dist")).filter(F.col("dist") >= 0)


def _near_or_same(pairs: DataFrame, threshold: int) -> DataFrame:
    """``(peptide, other)`` for every peptide itself and its near ones, both ways."""
    near = near_peptides(pairs, threshold)
    same = pairs.select("peptide").distinct()
    return (
        near.select(F.col("p1").alias("peptide"), F.col("p2").alias("other"))
        .unionByName(near.select(F.col("p2").alias("peptide"), F.col("p1").alias("other")))
        .unionByName(same.select("peptide", F.col("peptide").alias("other")))
    )


def number_pairs(
    pairs: DataFrame, by: Sequence[str], seed: int, min_pairs: int | None, keep: Sequence[str] | None = None
) -> DataFrame:
    """Number the pairs of each peptide (``i`` from 1, of ``n_pairs``) and name its group.

    Pairs are ranked by the hash of all their columns; with ``keep`` only these travel, beside ``by`` and
    the peptide. Texts with a null among them may give one hash to unlike pairs, so such pairs keep all, to be
    told apart.
    """
    by = [*by, "peptide"]
    digits = group_digits(pairs, by)
    if keep is None:
        ranked = hashed_rank(pairs, by, pairs.columns, seed, "i", "n_pairs", digits)
    else:
        alike = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pairs.columns])
        own = list(dict.fromkeys([*by, *keep]))
        slim = pairs.select(*own, hash_text(seed, *pairs.columns).alias("_digest"), F.when(alike, F.struct(*pairs.columns)).alias("_whole"))
        ranked = ranked_by_hash(slim, by, "_digest", ["_whole"], "i", "n_pairs", digits).select(*own, "i", "n_pairs")
    group = F.lit("test") if min_pairs is None else _group_name(F.col("n_pairs"), min_pairs)
    return ranked.withColumn("grp", group)


def number_donors(
    numbered: DataFrame, by: Sequence[str], key: Sequence[str], seed: int
) -> DataFrame:
    """Distinct receptors per group with position ``pos`` of ``n_donors``.

    ``first`` and ``last`` are the least and the greatest of a receptor's peptides in the group;
    ``whole`` says that none of them is null.
    """
    donors = numbered.groupBy(*by, "grp", *key).agg(
        F.min("peptide").alias("first"),
        F.max("peptide").alias("last"),
        F.min(F.col("peptide").isNotNull()).alias("whole"),
    )
    ranked = hashed_rank(donors, [*by, "grp"], list(key), seed, "pos", "n_donors")
    return ranked.withColumn("pos", F.col("pos") - 1)


def left_out_donors(
    numbered: DataFrame,
    donors: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    known: Sequence[str],
    threshold: int,
) -> DataFrame:
    """Positions a peptide's pool leaves out: ``(by, peptide, grp, pos, n_donors)``.

    A receptor is left out when all its peptides in the group are near, or when its ``known``
    columns already form a positive with the peptide. If all are near, so are the first and the last:
    only where these two are, the peptides between are compared as well. Near peptides are few, so each is
    repeated for every part of the receptors, and one peptide that comes first for a third of all
    receptors is met in ``PARTS`` places.
    """
    close = all_near(numbered, donors, by, key, threshold)
    # dealt by the columns of the join below, so that they are dealt once
    positives = numbered.select(*by, *known, "peptide").repartition(*by, *known).distinct()
    binders = positives.join(donors, [*by, *known])
    columns = [*by, "peptide", "grp", "pos", "n_donors"]
    return close.select(*columns).unionByName(binders.select(*columns)).distinct()


def all_near(
    numbered: DataFrame, donors: DataFrame, by: Sequence[str], key: Sequence[str], threshold: int
) -> DataFrame:
    """Each peptide with the ``donors`` that have none but near peptides in their group.

    Receptors with a null in their key or among their peptides are in no row.
    """
    part = F.pmod(F.xxhash64(*key), F.lit(PARTS)).alias("part")
    sound = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, *key]], F.col("whole"))
    firsts = donors.filter(sound).select("*", F.col("first").alias("other"), part)
    near = staged(_near_or_same(numbered, threshold), "near")
    targets = numbered.select(*by, "peptide").distinct()
    here = near.join(targets, "peptide") if by else near
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint")))
    close = firsts.join(here.withColumn("part", parts), [*by, "other", "part"]).drop("other", "part")
    close = close.join(near.withColumnRenamed("other", "last"), ["peptide", "last"], "left_semi")
    # the peptides between, of the few receptors that are still in question
    place = [*by, "grp", "peptide", "pos"]
    asked = close.filter(F.col("first") < F.col("last")).select(*place, *key, "first", "last")
    asked = staged(asked, "asked")
    between = numbered.select(*by, "grp", *key, F.col("peptide").alias("between"))
    between = between.join(asked.select(*by, "grp", *key).distinct(), [*by, "grp", *key], "left_semi").distinct()
    compared = asked.join(between, [*by, "grp", *key])
    compared = compared.filter((F.col("between") > F.col("first")) & (F.col("between") < F.col("last")))
    far = compared.join(near.withColumnRenamed("other", "between"), ["peptide", "between"], "left_anti")
    return close.join(far.select(*place).distinct(), place, "left_anti")


def pool_sizes(
    numbered: DataFrame,
    donors: DataFrame,
    left_out: DataFrame,
    by: Sequence[str],
    groups: Sequence[str] = ("test", "left-out"),
) -> DataFrame:
    """Receptors a peptide may draw from each group: ``(by, peptide, grp, n_donors, pool)``."""
    names = F.explode(F.array(*[F.lit(g) for g in groups])).alias("grp")
    targets = numbered.select(*by, "peptide").distinct().select("*", names)
    held = donors.groupBy(*by, "grp").agg(F.first("n_donors").alias("n_donors"))
    struck = left_out.groupBy(*by, "peptide", "grp").agg(F.count("*").alias("n_out"))
    sizes = targets.join(held, [*by, "grp"], "left").join(struck, [*by, "peptide", "grp"], "left")
    n_donors = F.coalesce(F.col("n_donors"), F.lit(0)).alias("n_donors")
    pool = F.coalesce(F.col("n_donors") - F.coalesce(F.col("n_out"), F.lit(0)), F.lit(0))
    return sizes.select(*by, "peptide", "grp", n_donors, pool.alias("pool"))


def swap_receptors(
    pairs: DataFrame,
    key: Sequence[str],
    known: Sequence[str],
    context: Sequence[str],
    draws: dict[str, int],
    by: Sequence[str] = (),
    min_pairs: int | None = MIN_PAIRS,
    threshold: int = FAR_DISTANCE,
    seed: int = 42,
) -> DataFrame:
    """Draw receptors for every pair and keep each (receptor, peptide) once.

    ``draws`` gives the number wanted per group. Every pair draws that many distinct entries of its
    peptide's pool, or all of a smaller pool, independently of all other pairs: so pairs of
    one peptide may draw the same receptor. Of such repeats the first pair's context stays.
    """
    numbered = staged(number_pairs(pairs, by, seed, min_pairs, [*key, *known, *context]), "numbered")
    donors = staged(number_donors(numbered, by, key, seed), "donors")
    left_out = staged(left_out_donors(numbered, donors, by, key, known, threshold), "leftout")
    pools = pool_sizes(numbered, donors, left_out, by, list(draws))

    # Draws are many times the pairs: until repeats are gone they are numbers, of the peptide
    # (``target``), its pool, the pair, its context and the receptor.
    targets = numbered.select(*by, "peptide", "n_pairs").distinct()
    targets = staged(targets.withColumn("target", F.monotonically_increasing_id()), "targets")
    groups = list(draws)
    wanted = F.create_map(*[F.lit(x) for item in draws.items() for x in item])[F.col("grp")]
    turn = (F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("grp")) - 1).alias("turn")
    pools = pools.withColumn("k", F.least(wanted.cast("bigint"), F.col("pool"))).filter(F.col("k") > 0)
    pools = pools.join(targets, [*by, "peptide"])
    pools = pools.withColumn("pool_id", F.col("target") * len(groups) + turn)
    # a pool is cut into cells of about CELL_ROWS draws and left-out receptors, so most are one cell
    entries = F.col("n_pairs") * F.col("k") + F.col("n_donors") - F.col("pool")
    pools = pools.withColumn("_cells", F.least(F.lit(MAX_CELLS), 1 + (entries / CELL_ROWS).cast("bigint")).cast("int"))
    columns = [*by, "peptide", "grp", "target", "pool_id", "n_donors", "pool", "k", "_cells"]
    pools = staged(pools.select(*columns, turn), "pools")

    contexts = numbered.select(*context).distinct()
    contexts = staged(contexts.withColumn("told", F.monotonically_increasing_id()), "contexts")
    of_pair = reduce(lambda a, b: a & b, [numbered[c].eqNullSafe(contexts[c]) for c in context])
    told = numbered.join(contexts, of_pair).select(*[numbered[c] for c in [*by, "peptide", "i"]], "told")
    asking = told.join(pools, [*by, "peptide"])
    chosen = distinct_draws(F.col("k"), F.col("pool"), seed, *by, "peptide", "grp", "i")
    asking = asking.select("pool_id", "i", "told", "n_donors", "_cells", F.explode(chosen).alias("want"))
    struck = left_out.join(pools.select(*by, "peptide", "grp", "pool_id", "_cells"), [*by, "peptide", "grp"])
    struck = struck.select("pool_id", "pos", "n_donors", "_cells")
    placed = nth_unlisted(asking, struck, ["pool_id"], "n_donors", "want", "pos", "_cells", no_nulls=True, once="i")

    # A receptor goes by its place in its first group: only those of more groups have to be looked up.
    place = (F.col("pos") * len(groups) + F.col("turn")).alias("place")
    places = donors.filter(F.col("grp").isin(groups)).select(*by, *key, turn, "pos")
    receptors = places.groupBy(*by, *key).agg(
        F.min(F.struct("turn", "pos")).alias("first"), F.collect_list(F.struct("turn", "pos")).alias("_places")
    )
    first = F.col("first.pos") * len(groups) + F.col("first.turn")
    receptors = staged(receptors.select(*by, *key, first.alias("receptor"), "_places"), "receptors")
    again = receptors.select(*by, "receptor", F.inline("_places")).select(*by, "receptor", place)
    again = staged(again.filter(F.col("place") != F.col("receptor")), "again")
    drawn = placed.select("pool_id", "i", "told", "pos").join(pools.select("pool_id", "target", "turn", *by), "pool_id")
    drawn = drawn.select(*by, "target", "i", "told", "turn", place)
    if len(groups) > 1:
        drawn = drawn.join(again, [*by, "place"], "left")
    else:
        drawn = drawn.withColumn("receptor", F.lit(None).cast("bigint"))
    # The same receptor may come from both groups: the common group counts as earlier. Draws are dealt
    # by receptor, for the repeats and for its columns.
    order = F.col("i") * len(groups) + F.col("turn")
    drawn = drawn.select(*by, F.coalesce("receptor", "place").alias("receptor"), "target", "told", order.alias("order"))
    kept = drawn.repartition(*by, "receptor").groupBy(*by, "receptor", "target").agg(F.min_by("told", "order").alias("told"))
    kept = kept.join(receptors.drop("_places"), [*by, "receptor"])
    kept = kept.join(targets.select("target", "peptide"), "target").join(contexts, "told")
    return kept.select(*by, *key, "peptide", *context)


def negatives(
    pairs: DataFrame,
    n_test: int = DRAWS_COMMON,
    n_leftout: int = DRAWS_RARE,
    min_pairs: int = MIN_PAIRS,
    threshold: int = FAR_DISTANCE,
    max_ratio: float | None = MAX_RATIO,
    seed: int = 42,
    by: Sequence[str] = (),
) -> DataFrame:
    """Single-chain negatives with label 0, capped at ``max_ratio`` per positive.

    ``by`` (for instance ``["split"]``) keeps pools and caps inside each part.
    """
    drawn = swap_receptors(
        pairs, RECEPTOR_KEY, ["cdr3"], CONTEXT,
        {"test": n_test, "left-out": n_leftout}, by, min_pairs, threshold, seed,
    )
    columns = [*by, *RECEPTOR_KEY, "peptide", *CONTEXT]
    drawn = drawn.select(*columns)
    if max_ratio is not None:
        drawn = cap_negatives(drawn, pairs, max_ratio, seed, by)
    return drawn.withColumn("label", F.lit(0))


def cap_negatives(
    drawn: DataFrame, pairs: DataFrame, max_ratio: float, seed: int, by: Sequence[str] = ()
) -> DataFrame:
    """A seeded sample of at most ``int(positives * max_ratio)`` negatives (per ``by``)."""
    key = [*RECEPTOR_KEY, "peptide"]
    drawn = staged(drawn, "drawn")
    if not by:
        return take_hashed(drawn, int(pairs.count() * max_ratio), key, f"cap{seed}")
    limits = pairs.groupBy(*by).agg(F.floor(F.count("*") * max_ratio).alias("_limit"))
    return take_hashed_by(drawn, limits, by, key, f"cap{seed}", "_limit")


def paired_negatives(
    pairs: DataFrame,
    per_positive: int = DRAWS_PAIRED,
    threshold: int = FAR_DISTANCE,
    seed: int = 42,
) -> DataFrame:
    """Two-chain negatives: the whole receptor moves, peptide and HLA stay.

    There is one donor group and no cap; a peptide without any far receptor gets none.
    A receptor is identified by both CDR3s and both V genes; the rest of its columns
    come from one record of it, the least in sort order.
    """
    key = ["cdr3a", "cdr3b", "va", "vb"]
    drawn = swap_receptors(
        pairs, key, ["cdr3a", "cdr3b"], ["hla"], {"test": per_positive},
        min_pairs=None, threshold=threshold, seed=seed,
    )
    rest = [c for c in PAIRED_RECEPTOR if c in pairs.columns and c not in key]
    if rest:
        record = F.min(F.struct(*rest)).alias("_record")
        records = pairs.groupBy(*key).agg(record)
        drawn = drawn.join(records, key)
        drawn = drawn.select(*key, "peptide", "hla", *[f"_record.{c}" for c in rest])
    return drawn.withColumn("label", F.lit(0))


def labelled(positives: DataFrame, drawn: DataFrame) -> DataFrame:
    """Positives (label 1) and negatives in the labelled schema, with ``split`` once assigned.

    Tables of other shapes (two chains) are united on the columns of the negatives.
    """
    schema = LABELLED_COLUMNS if set(LABELLED_COLUMNS) <= set(drawn.columns) else drawn.columns
    if SPLIT_COLUMN in drawn.columns and SPLIT_COLUMN not in schema:
        schema = [*schema, SPLIT_COLUMN]
    tagged = {1: positives.withColumn("label", F.lit(1)), 0: drawn}
    return tagged[1].select(*schema).unionByName(tagged[0].select(*schema))


def _ratio() -> Column:
    """Negatives per positive to 2 digits, in whole numbers: a half is a half in every engine."""
    return F.when(F.col("n_pos") > 0, F.expr("((200 * n_neg + n_pos) div (2 * n_pos)) / 100"))


def ratio_counts(positives: DataFrame, drawn: DataFrame) -> DataFrame:
    """Positives and negatives per peptide with ``ratio`` rounded to 2 digits, halves up."""
    pos = positives.groupBy("peptide").agg(F.count("*").alias("n_pos"))
    neg = drawn.groupBy("peptide").agg(F.count("*").alias("n_neg"))
    both = pos.join(neg, "peptide", "full").fillna(0, ["n_pos", "n_neg"])
    return both.withColumn("ratio", _ratio())


def ratio_report(
    positives: DataFrame, drawn: DataFrame, wanted: int = DRAWS_COMMON + DRAWS_RARE
) -> DataFrame:
    """The peptides below the wanted ratio, lowest first."""
    counts = ratio_counts(positives, drawn)
    return counts.filter(F.col("ratio") < wanted).orderBy("ratio", "peptide")


def overall_ratio(counts: DataFrame) -> DataFrame:
    """Sums of ``ratio_counts`` and their ratio."""
    sums = counts.agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    return sums.withColumn("ratio", _ratio())


def random_swaps(pairs: DataFrame, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """One negative peptide per pair, drawn evenly from those the receptor does not bind.

    A receptor that binds every peptide gets any peptide: there is nothing else to draw.
    """
    words = pairs.select("peptide").distinct()
    words = hashed_rank(words, [], ["peptide"], seed, "pos", "n_words")
    words = staged(words.withColumn("pos", F.col("pos") - 1), "words")
    # only the receptor and the number drawn decide, so only they travel until a peptide is found
    slim = staged(pairs.select("cdr3", "peptide", hash_int(seed, *pairs.columns).alias("_drawn")), "slim")
    known = slim.select("cdr3", "peptide").distinct().join(words, "peptide")
    known = known.select("cdr3", "pos", "n_words")
    counts = known.groupBy("cdr3").agg(
        F.count("*").alias("n_known"), F.max("n_words").alias("n_words")
    )
    drawn = slim.filter(F.col("cdr3").isNotNull()).select("cdr3", "_drawn").distinct()
    held = drawn.groupBy("cdr3").agg(F.count("*").alias("_n"))
    # a receptor's draws and peptides are cut into cells of about CELL_ROWS, so most are one cell
    cells = F.least(F.lit(MAX_CELLS), 1 + F.expr(f"(_n + n_known) div {CELL_ROWS}")).cast("int")
    counts = counts.join(held, "cdr3").withColumn("_cells", cells)
    counts = staged(counts.withColumn("free", F.col("n_words") - F.col("n_known")).drop("_n", "n_known"), "counts")
    modulus = F.when(F.col("free") > 0, F.col("free")).otherwise(F.col("n_words"))
    asking = drawn.join(counts, "cdr3").withColumn("want", F.pmod("_drawn", modulus)).drop("free")
    listed = known.join(counts.filter("free > 0").select("cdr3", "_cells"), "cdr3")
    placed = nth_unlisted(asking, listed, ["cdr3"], "n_words", "want", "pos", cells="_cells", no_nulls=True)
    placed = placed.join(words.select("pos", F.col("peptide").alias("negative")), "pos")
    numbered = pairs.withColumn("_drawn", hash_int(seed, *pairs.columns))
    return numbered.join(placed.select("cdr3", "_drawn", "negative"), ["cdr3", "_drawn"]).drop("_drawn")


def shuffled_pairs(pairs: DataFrame, seed: int = 7) -> DataFrame:
    """Positives with label 1 and as many rows with peptides permuted, label 0.

    Receptors and peptides are put in two unrelated seeded orders and joined by number;
    a permuted row may happen to be a known pair.
    """
    pairs = pairs.select("cdr3", "peptide")
    left = hashed_rank(pairs, [], ["cdr3", "peptide"], f"left{seed}", "n").select("cdr3", "n")
    right = hashed_rank(pairs, [], ["cdr3", "peptide"], f"right{seed}", "n").select("peptide", "n")
    mixed = left.join(right, "n").select("cdr3", "peptide", F.lit(0).alias("label"))
    return pairs.withColumn("label", F.lit(1)).unionByName(mixed)

