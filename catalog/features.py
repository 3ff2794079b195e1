"""Queries on feature columns and lookups, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from bindery.constants import RESIDUES
from bindery.functions import text as tx
from bindery.functions import vectors as vx
from bindery.operators import features as ft
from bindery.operators import lookup as lk
from bindery.operators import split as sp
from catalog.negatives import ALL
from catalog.views import stored, table, view, with_views

_AA = RESIDUES


def pairs(spark, folder):
    return view(spark, folder, "positives")


def stored_pairs(spark, folder):
    return stored(spark, folder, "positives")


def residues(spark, folder):
    """Each stored vector as 8 residues of 8 numbers, with a span by rule from its id."""
    rows = table(spark, folder, "embeddings")
    start = (F.col("vec_id") % 5).cast("int")
    end = start + (F.col("vec_id") % 4).cast("int")
    return rows.select(
        "vec_id", "label", vx.unfold("embedding", 8, 8).alias("residues"),
        F.when(F.col("vec_id") % 7 != 0, start).alias("start"),
        F.when(F.col("vec_id") % 7 != 0, end).alias("end"),
    )


def exploded(df, keys, vec):
    """One row per number, rounded: the form in which vectors are compared."""
    rows = df.select(*keys, F.posexplode(vec).alias("dim", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


def q_tokenize_pad(spark, folder):
    words = pairs(spark, folder).select("cdr3", "peptide").distinct()
    odd = F.when(F.length("cdr3") % 2 == 0, F.concat(F.col("cdr3"), F.lit("Z*"))).otherwise(F.col("cdr3"))
    return words.select(
        "cdr3", "peptide",
        vx.text_of(tx.residue_ids(odd, 12)).alias("ids"),
        vx.text_of(tx.residue_mask(odd, 12)).alias("mask"),
        vx.text_of(tx.residue_ids("peptide", 15)).alias("peptide_ids"),
        vx.text_of(tx.residue_mask("peptide", 15)).alias("peptide_mask"),
    )


def q_onehot_sequences(spark, folder):
    words = ft.one_hot_pairs(pairs(spark, folder).select("cdr3", "peptide").distinct())
    return words.select(
        "cdr3", "peptide", vx.ones_text("receptor_vec").alias("receptor_ones"), vx.ones_text("peptide_vec").alias("peptide_ones"),
        F.size(vx.appended("receptor_vec", "peptide_vec")).alias("dim"),
    )


def q_decode_onehot(spark, folder):
    words = ft.one_hot_pairs(pairs(spark, folder).select("cdr3", "peptide").distinct(), 12, 15)
    return words.select(
        "cdr3", vx.decode_one_hot("receptor_vec", 12).alias("cut"), vx.decode_one_hot("peptide_vec", 15).alias("peptide")
    )


def split_pairs(spark, folder):
    return sp.holdout(stored(spark, folder, "positives"), "cdr3")


def q_vocab_fit(spark, folder):
    return ft.fit_vocabulary(pairs(spark, folder), ["v_gene", "j_gene"])


def q_vocab_fit_paired(spark, folder):
    return ft.fit_vocabulary(view(spark, folder, "paired"), ["va", "ja", "vb", "jb", "hla"], unknown_slot=True)


def q_onehot_categories(spark, folder):
    rows = split_pairs(spark, folder)
    cats = ft.Categories.fit(rows.filter((F.col("split") == "train") & (F.col("v_gene") != "TRBV3*01")))
    out = cats.transform(rows)
    place = F.filter(F.transform("meta", lambda x, i: F.when(x == 1, i).otherwise(-1)), lambda i: i >= 0)
    return out.select(*ALL.split(", "), vx.text_of(place).alias("ones"), F.size("meta").alias("dim"))


def q_onehot_paired(spark, folder):
    rows = stored(spark, folder, "paired")
    cats = ft.Categories.fit_paired(rows.filter(F.col("va") != "TRAV3*01"))
    out = cats.transform(rows)
    place = F.filter(F.transform("meta", lambda x, i: F.when(x == 1, i).otherwise(-1)), lambda i: i >= 0)
    return out.select("cdr3a", "cdr3b", "peptide", "va", "ja", "vb", "jb", "hla", vx.text_of(place).alias("ones"))


def q_sparse_features(spark, folder):
    rows = stored_pairs(spark, folder)
    cats = ft.Categories.fit(rows.filter(F.col("v_gene") != "TRBV3*01"))
    out = ft.sparse_pair_features(rows, cats).withColumn("dense", vector_to_array("features", "float32"))
    place = F.filter(F.transform("dense", lambda x, i: F.when(x == 1, i).otherwise(-1)), lambda i: i >= 0)
    return out.select(*ALL.split(", "), vx.text_of(place).alias("ones"), F.size("dense").alias("dim"))


def q_category_vectors(spark, folder):
    rows = pairs(spark, folder)
    vocab = ft.fit_vocabulary(rows.filter(F.col("v_gene") != "TRBV3*01"), ["v_gene", "j_gene"])
    vectors = vocab.select("col", "value", F.array(F.col("idx") * 0.5, F.col("idx") + 1.0).cast("array<float>").alias("vec"))
    out = ft.category_vectors(rows, vectors, ["v_gene", "j_gene"], {"v_gene": [9.5, -1.0], "j_gene": [0.0, 0.0]})
    return exploded(out, ALL.split(", "), "meta")


def q_unfold_vector(spark, folder):
    rows = table(spark, folder, "embeddings")
    first = vx.channels_first(vx.unfold("embedding", 8, 8), 8)
    return exploded(rows.select("vec_id", F.flatten(first).alias("v")), ["vec_id"], "v")


def q_pooled_vectors(spark, folder):
    rows = residues(spark, folder)
    part = vx.span("residues", "start", "end")
    mean = exploded(rows.select("vec_id", F.lit("mean").alias("mode"), vx.mean_pool(part).alias("v")), ["vec_id", "mode"], "v")
    top = exploded(rows.select("vec_id", F.lit("max").alias("mode"), vx.max_pool(part).alias("v")), ["vec_id", "mode"], "v")
    whole = exploded(rows.select("vec_id", F.lit("all").alias("mode"), vx.mean_pool("residues").alias("v")), ["vec_id", "mode"], "v")
    return mean.unionByName(top).unionByName(whole)


def q_residue_slices(spark, folder):
    rows = residues(spark, folder)
    part = vx.span("residues", "start", "end")
    cut = rows.select("vec_id", vx.truncated(part, 2).alias("kept"), vx.kept_length(part, 2).alias("length"))
    flat = F.coalesce(F.flatten("kept"), F.array().cast("array<float>"))
    return cut.select("vec_id", "length", F.size(flat).alias("n_numbers"), F.round(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


def q_paired_concat(spark, folder):
    rows = residues(spark, folder)
    alpha = vx.span("residues", "start", "end")
    beta = vx.truncated("residues", 6)
    out = rows.select(
        "vec_id", vx.paired_residues(alpha, beta, 7).alias("both"),
        vx.length_of(alpha).alias("alpha_len"), F.size(beta).alias("beta_len"),
    )
    return exploded(out.select("vec_id", "alpha_len", F.flatten("both").alias("v")), ["vec_id", "alpha_len"], "v")


def q_paired_core_vectors(spark, folder):
    """One number per residue; the gaps left in some alpha CDR3s keep them from aligning."""
    rows = view(spark, folder, "paired")
    numbers = lambda c: F.transform(F.split(c, ""), lambda x: F.array(F.ascii(x).cast("float")))
    ready = rows.select(
        "peptide", "va", "hla", "tcra", "tcrb",
        F.when(F.length("cdr3b") % 3 == 0, F.col("cdr3a")).otherwise(F.replace("cdr3a", F.lit("-"), F.lit(""))).alias("cdr3a"),
        F.replace("cdr3b", F.lit("."), F.lit("")).alias("cdr3b"),
        numbers("tcra").alias("alpha"), numbers("tcrb").alias("beta"),
    )
    found = ready.select("*", *[
        c.alias(name) for name, c in vx.paired_core_vectors(("cdr3a", "tcra", "alpha"), ("cdr3b", "tcrb", "beta"), 20).items()
    ])
    return found.select(
        "peptide", "va", "hla", "cdr3a", "cdr3b", "alpha_len", "beta_len", "misaligned",
        F.round(F.col("pooled")[0], 6).alias("alpha_mean"), F.round(F.col("pooled")[1], 6).alias("beta_mean"),
        vx.text_of(F.flatten("residues")).alias("residues"),
    )


def q_misaligned_count(spark, folder):
    return q_paired_core_vectors(spark, folder).agg(
        F.count("*").alias("n_rows"), F.count_if("misaligned").alias("n_misaligned")
    )


def q_beta_slice(spark, folder):
    rows = residues(spark, folder)
    alpha, beta = vx.span("residues", "start", "end"), vx.truncated("residues", 6)
    out = rows.select(
        "vec_id", vx.paired_residues(alpha, beta, 40).alias("both"),
        vx.length_of(alpha).alias("alpha_len"), F.size(beta).alias("beta_len"),
    )
    back = out.select("vec_id", F.flatten(vx.beta_slice("both", "alpha_len", "beta_len", 5)).alias("v"))
    return exploded(back, ["vec_id"], "v")


def q_masked_mean(spark, folder):
    rows = residues(spark, folder)
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i < F.col("vec_id") % 9, 1).otherwise(0))
    return exploded(rows.select("vec_id", vx.masked_mean("residues", mask, 8).alias("v")), ["vec_id"], "v")


def q_residue_edges(spark, folder):
    words = pairs(spark, folder).select("cdr3", "peptide").distinct()
    edges = ft.residue_edges(words)
    return edges.groupBy("cdr3", "peptide", "etype").agg(
        F.count("*").alias("n_edges"), F.sum(F.col("src") * 100 + F.col("dst")).cast("bigint").alias("checksum")
    )


_FULL = """SELECT cdr3, CASE length(cdr3) % 4 WHEN 0 THEN 'MKAV' || lower('x') || cdr3 || 'GEG' WHEN 1 THEN 'QQ' || substr(cdr3, 2) || 'W'
             WHEN 2 THEN 'QQC' || cdr3 ELSE 'NONE' END AS full_aa,
             CASE WHEN length(cdr3) % 4 = 1 THEN substr(cdr3, 2) WHEN length(cdr3) % 4 = 2 THEN lower(cdr3) ELSE cdr3 END AS core
           FROM (SELECT DISTINCT cdr3 FROM positives) p"""


def q_cdr3_span(spark, folder):
    pairs(spark, folder).createOrReplaceTempView("positives")
    rows = spark.sql(_FULL).withColumn("s", tx.core_span("full_aa", "core"))
    return rows.select(
        "cdr3", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"),
        tx.cut_span("full_aa", "s.start", "s.end").alias("cut"),
    )


def q_locate(spark, folder):
    rows = view(spark, folder, "paired")
    return rows.select(
        "cdr3a", "tcra", "peptide", tx.locate("tcra", tx.strip_gaps("cdr3a")).alias("at_alpha"),
        tx.locate("tcra", F.lit("")).alias("at_empty"), tx.locate("tcrb", F.col("cdr3b")).alias("at_raw_beta"),
    )


# --- lookups --------------------------------------------------------------------------


def receptor_store(rows):
    """A vector for every receptor but some, made by rule; several rows per receptor."""
    rows = rows.filter(F.col("v_gene") != "TRBV3*01")
    vec = F.transform(tx.residue_ids("cdr3", 6), lambda x: (x / 2).cast("float"))
    return rows.select("cdr3", "v_gene", F.concat(vec, F.array(F.length("v_gene").cast("float"))).alias("vec"))


def peptide_store(rows):
    rows = rows.select("peptide").distinct().filter(~F.col("peptide").startswith("A"))
    return rows.select("peptide", F.transform(tx.residue_ids("peptide", 4), lambda x: x.cast("float")).alias("vec"))


def q_first_occurrence(spark, folder):
    order = F.concat_ws("|", "peptide", "source", "mhc_a").alias("row_order")
    rows = pairs(spark, folder).select("cdr3", "peptide", "source", order)
    return lk.first_occurrence(rows, ["cdr3"], "row_order")


def q_embedding_lookup(spark, folder):
    rows = stored_pairs(spark, folder)
    store = lk.first_occurrence(receptor_store(rows), ["cdr3"], "v_gene")
    found = lk.with_vectors(rows.select("cdr3", "peptide", "source"), store, peptide_store(rows), drop_missing=True)
    out = lk.feature_table(found)
    return out.select("cdr3", "peptide", "source", F.array_join(F.transform("features", lambda x: (x * 2).cast("int").cast("string")), ",").alias("features"))


def q_missing_keys(spark, folder):
    rows = stored_pairs(spark, folder)
    return lk.missing_keys(rows, receptor_store(rows), "cdr3")


def q_vector_coverage(spark, folder):
    rows = stored_pairs(spark, folder)
    store = lk.first_occurrence(receptor_store(rows), ["cdr3"], "v_gene")
    return lk.vector_coverage(rows, store, peptide_store(rows))


def q_residue_lookup(spark, folder):
    rows = stored_pairs(spark, folder)
    length = F.when(F.col("v_gene") == "TRBV5*01", 0).otherwise(F.length("cdr3"))
    store = rows.select(
        "cdr3", F.concat_ws("|", "v_gene", "peptide", "source", "mhc_a").alias("row_order"), length.alias("length"),
        F.transform(F.split("peptide", ""), lambda x: F.array(F.ascii(x).cast("float"))).alias("residues"),
    )
    found = lk.with_residues(rows.select("cdr3", "peptide", "source"), store, ["cdr3"], "row_order")
    return found.select("cdr3", "peptide", "source", "length", vx.text_of(F.flatten("residues")).alias("residues"))


def q_dropped_rows(spark, folder):
    rows = pairs(spark, folder)
    store = rows.select("cdr3", F.when(F.col("v_gene") == "TRBV5*01", 0).otherwise(1).alias("length"))
    return lk.dropped_rows(rows, store, ["cdr3"])


def q_one_to_one_labels(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    solutions = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).cast("double").alias("label"),
        F.when(F.col("c_custkey") % 2 == 0, "Public").otherwise("Private").alias("usage"),
    )
    unmatched = solutions.withColumn("id", -1 - F.col("id"))
    return lk.with_labels(customers, solutions.unionByName(unmatched))


def q_align_by_row(spark, folder):
    store = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("kind"))
    full = table(spark, folder, "customer").select(F.col("c_custkey").alias("row_id"), "c_name", "c_mktsegment")
    return lk.align_by_row(store, full)


def q_align_by_pair(spark, folder):
    rows = pairs(spark, folder)
    store = rows.select("cdr3", F.when(F.col("source") == "IEDB", F.concat("peptide", F.lit("X"))).otherwise(F.col("peptide")).alias("peptide"), "source")
    full = rows.select("cdr3", "peptide", "v_gene", "j_gene", "mhc_class", F.concat_ws("|", "v_gene", "mhc_a", "source").alias("row_order"))
    return lk.align_by_pair(store, full, "row_order").drop("row_order")


def residue_counts(seqs: pd.Series) -> pd.DataFrame:
    """A stand-in encoder: how often each residue occurs, as text, and the length."""
    counts = [",".join(str(s.count(a)) for a in _AA) for s in seqs]
    return pd.DataFrame({"counts": counts, "n": [len(s) for s in seqs]})


def q_encode_distinct(spark, folder):
    rows = pairs(spark, folder).select("cdr3", "peptide", "source")
    return lk.encode_distinct(rows, "cdr3", residue_counts, "counts string, n int")


def q_score_batches(spark, folder):
    rows = pairs(spark, folder).select("cdr3", "peptide", "source")
    return lk.score_batches(rows, lambda b: b["cdr3"].str.len() / (1.0 + b["peptide"].str.count("A")), ["cdr3", "peptide"])


def q_by_length(spark, folder):
    words = pairs(spark, folder).select("cdr3").distinct()
    return lk.by_length(words, "cdr3").select("cdr3", F.length("cdr3").alias("n"))


QUERIES = {
    "tokenize_pad": q_tokenize_pad,
    "onehot_sequences": q_onehot_sequences,
    "decode_onehot": q_decode_onehot,
    "vocab_fit": q_vocab_fit,
    "vocab_fit_paired": q_vocab_fit_paired,
    "onehot_categories": q_onehot_categories,
    "onehot_paired": q_onehot_paired,
    "sparse_features": q_sparse_features,
    "category_vectors": q_category_vectors,
    "unfold_vector": q_unfold_vector,
    "pooled_vectors": q_pooled_vectors,
    "residue_slices": q_residue_slices,
    "paired_concat": q_paired_concat,
    "paired_core_vectors": q_paired_core_vectors,
    "misaligned_count": q_misaligned_count,
    "beta_slice": q_beta_slice,
    "masked_mean": q_masked_mean,
    "residue_edges": q_residue_edges,
    "cdr3_span": q_cdr3_span,
    "locate": q_locate,
    "first_occurrence": q_first_occurrence,
    "embedding_lookup": q_embedding_lookup,
    "missing_keys": q_missing_keys,
    "vector_coverage": q_vector_coverage,
    "residue_lookup": q_residue_lookup,
    "dropped_rows": q_dropped_rows,
    "one_to_one_labels": q_one_to_one_labels,
    "align_by_row": q_align_by_row,
    "align_by_pair": q_align_by_pair,
    "encode_distinct": q_encode_distinct,
    "score_batches": q_score_batches,
    "by_length": q_by_length,
}


def _ids(seq, n):
    """List expression: residue numbers of ``seq`` padded to ``n``."""
    kept = f"substr({seq}, 1, {n})"
    code = f"CASE WHEN instr('-{_AA}', {kept}[i]) > 0 THEN instr('-{_AA}', {kept}[i]) - 1 ELSE 21 END"
    return f"list_transform(range(1, {n} + 1), lambda i: CASE WHEN i > length({kept}) THEN 0 ELSE {code} END)"


def _mask(seq, n):
    return f"list_transform(range(1, {n} + 1), lambda i: CASE WHEN i <= length({seq}) THEN 1 ELSE 0 END)"


def _text(lst):
    return f"array_to_string({lst}, ',')"


def _ones(seq, n):
    return _text(f"list_transform({_ids(seq, n)}, lambda x, k: (k - 1) * 22 + x)")


_WORDS = "words AS (SELECT DISTINCT cdr3, peptide FROM positives)"
_ODD = "(CASE WHEN length(cdr3) % 2 = 0 THEN cdr3 || 'Z*' ELSE cdr3 END)"
_RES = """res AS (SELECT vec_id, label, list_transform(range(0, 8), lambda i: embedding[i * 8 + 1 : i * 8 + 8]) AS r,
    CASE WHEN vec_id % 7 <> 0 THEN (vec_id % 5)::INT END AS s,
    CASE WHEN vec_id % 7 <> 0 THEN (vec_id % 5 + vec_id % 4)::INT END AS e FROM embeddings),
    cut AS (SELECT *, CASE WHEN s IS NOT NULL THEN r[s + 1 : e] END AS part FROM res)"""


def _spread(source, vec, keys="vec_id"):
    return f"""SELECT {keys}, dim::INT - 1 AS dim, round(v::DOUBLE, 6) AS value
        FROM (SELECT {keys}, unnest(range(1, len({vec}) + 1)) AS dim, unnest({vec}) AS v FROM {source})"""


def _pool(part, fn):
    return f"CASE WHEN len({part}) > 0 THEN list_transform(range(1, 9), lambda d: {fn}(list_transform({part}, lambda x: x[d]::DOUBLE))) END"


_VOCAB = """vocab AS (SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) - 1 AS idx FROM
     (SELECT DISTINCT 'v_gene' AS col, v_gene AS value FROM {src} UNION SELECT DISTINCT 'j_gene', j_gene FROM {src}))"""
_PAIRED_VOCAB = """pv AS (SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) AS idx FROM ({cells})
     UNION ALL SELECT unnest(['va', 'ja', 'vb', 'jb', 'hla']), '<UNK>', 0)"""


def _cells(src):
    return " UNION ".join(f"SELECT DISTINCT '{c}' AS col, {c} AS value FROM {src}" for c in ("va", "ja", "vb", "jb", "hla"))


_HOLD = """ranked AS (SELECT cdr3, row_number() OVER (ORDER BY md5(concat_ws('|', '42', cdr3)), cdr3) AS r,
       count(*) OVER () AS n FROM (SELECT DISTINCT cdr3 FROM positives)),
    train AS (SELECT p.* FROM positives p JOIN ranked USING (cdr3)
      WHERE r > greatest(1, round_even(n * 0.2::DOUBLE, 0)) + greatest(1, round_even(n * 0.1::DOUBLE, 0)) AND v_gene <> 'TRBV3*01')"""
_SIZE = "(SELECT count(*) FROM vocab WHERE col = '{c}')"
_STORE = f"""rs AS (SELECT cdr3, list_append(list_transform({_ids('cdr3', 6)}, lambda x: x / 2), length(v_gene)) AS vec FROM (
      SELECT cdr3, min(v_gene) AS v_gene FROM positives WHERE v_gene <> 'TRBV3*01' GROUP BY cdr3)),
    ps AS (SELECT peptide, {_ids('peptide', 4)} AS vec FROM (SELECT DISTINCT peptide FROM positives WHERE peptide NOT LIKE 'A%'))"""

_CORES = """
  raw AS (SELECT peptide, va, hla, tcra, tcrb, replace(cdr3b, '.', '') AS cdr3b,
                 CASE WHEN length(cdr3b) % 3 = 0 THEN cdr3a ELSE replace(cdr3a, '-', '') END AS cdr3a FROM paired),
  cut AS (SELECT *, CASE WHEN instr(tcra, cdr3a) > 0 THEN cdr3a ELSE '' END AS a,
                 CASE WHEN instr(tcrb, cdr3b) > 0 THEN cdr3b ELSE '' END AS b FROM raw),
  coded AS (SELECT *, list_transform(range(1, length(a) + 1), lambda i: ascii(substr(a, i, 1))) AS na,
                   list_transform(range(1, length(b) + 1), lambda i: ascii(substr(b, i, 1))) AS nb FROM cut),
  cores AS (SELECT peptide, va, hla, cdr3a, cdr3b, length(a)::INT AS alpha_len, length(b)::INT AS beta_len,
                   a = '' OR b = '' AS misaligned,
                   CASE WHEN a <> '' AND b <> '' THEN round(list_sum(na)::DOUBLE / length(a), 6) END AS alpha_mean,
                   CASE WHEN a <> '' AND b <> '' THEN round(list_sum(nb)::DOUBLE / length(b), 6) END AS beta_mean,
                   array_to_string(list_concat(na, nb)[1:20], ',') AS residues FROM coded)"""

ORACLE = {
    "tokenize_pad": with_views(
        f"""WITH {_WORDS} SELECT cdr3, peptide, {_text(_ids(_ODD, 12))} AS ids, {_text(_mask(_ODD, 12))} AS mask,
            {_text(_ids('peptide', 15))} AS peptide_ids, {_text(_mask('peptide', 15))} AS peptide_mask FROM words""",
        "positives",
    ),
    "onehot_sequences": with_views(
        f"""WITH {_WORDS} SELECT cdr3, peptide, {_ones('cdr3', 30)} AS receptor_ones, {_ones('peptide', 15)} AS peptide_ones,
            990 AS dim FROM words""",
        "positives",
    ),
    "decode_onehot": with_views(f"WITH {_WORDS} SELECT cdr3, substr(cdr3, 1, 12) AS cut, peptide FROM words", "positives"),
    "vocab_fit": with_views(f"WITH {_VOCAB.format(src='positives')} SELECT * FROM vocab", "positives"),
    "vocab_fit_paired": with_views(f"WITH {_PAIRED_VOCAB.format(cells=_cells('paired'))} SELECT * FROM pv", "paired"),
    "onehot_categories": with_views(
        f"""WITH {_HOLD}, {_VOCAB.format(src='train')}
            SELECT p.*, array_to_string(list_filter([CASE WHEN mhc_class = 'MHCII' THEN 0 END, v.idx + 1,
                   j.idx + 1 + {_SIZE.format(c='v_gene')}], lambda x: x IS NOT NULL), ',') AS ones,
                   1 + (SELECT count(*) FROM vocab) AS dim
            FROM positives p LEFT JOIN vocab v ON v.col = 'v_gene' AND v.value = v_gene
            LEFT JOIN vocab j ON j.col = 'j_gene' AND j.value = j_gene""",
        "positives",
    ),
    "sparse_features": with_views(
        f"""WITH few AS (SELECT * FROM positives WHERE v_gene <> 'TRBV3*01'), {_VOCAB.format(src='few')}
            SELECT p.*, concat_ws(',', {_ones('cdr3', 30)},
                     array_to_string(list_transform({_ids('peptide', 15)}, lambda x, k: 660 + (k - 1) * 22 + x), ','),
                     CASE WHEN mhc_class = 'MHCII' THEN '990' END, v.idx + 991, j.idx + 991 + {_SIZE.format(c='v_gene')}) AS ones,
                   991 + (SELECT count(*) FROM vocab) AS dim
            FROM positives p LEFT JOIN vocab v ON v.col = 'v_gene' AND v.value = v_gene
            LEFT JOIN vocab j ON j.col = 'j_gene' AND j.value = j_gene""",
        "positives",
    ),
    "onehot_paired": with_views(
        f"""WITH few AS (SELECT * FROM paired WHERE va <> 'TRAV3*01'), {_PAIRED_VOCAB.format(cells=_cells('few'))},
             z AS (SELECT col, count(*) AS n FROM pv GROUP BY col),
             o AS (SELECT 0 AS va, (SELECT n FROM z WHERE col = 'va') AS ja,
                  (SELECT sum(n) FROM z WHERE col IN ('va', 'ja')) AS vb, (SELECT sum(n) FROM z WHERE col IN ('va', 'ja', 'vb')) AS jb,
                  (SELECT sum(n) FROM z WHERE col <> 'hla') AS hla)
            SELECT cdr3a, cdr3b, peptide, p.va, p.ja, p.vb, p.jb, p.hla, concat_ws(',',
              {', '.join(f"(coalesce(x{c}.idx, 0) + o.{c})::BIGINT" for c in ('va', 'ja', 'vb', 'jb', 'hla'))}) AS ones
            FROM paired p, o {' '.join(f"LEFT JOIN pv x{c} ON x{c}.col = '{c}' AND x{c}.value = p.{c}" for c in ('va', 'ja', 'vb', 'jb', 'hla'))}""",
        "paired",
    ),
    "category_vectors": with_views(
        f"""WITH few AS (SELECT * FROM positives WHERE v_gene <> 'TRBV3*01'), {_VOCAB.format(src='few')},
             m AS (SELECT p.*, [CASE WHEN mhc_class = 'MHCII' THEN 1 ELSE 0 END, coalesce(v.idx * 0.5, 9.5), coalesce(v.idx + 1, -1),
                   coalesce(j.idx * 0.5, 0), coalesce(j.idx + 1, 0)] AS vec
                FROM positives p LEFT JOIN vocab v ON v.col = 'v_gene' AND v.value = v_gene
                LEFT JOIN vocab j ON j.col = 'j_gene' AND j.value = j_gene)
            {_spread('m', 'vec', ALL)}""",
        "positives",
    ),
    "unfold_vector": f"""WITH f AS (SELECT vec_id, list_transform(range(0, 64), lambda k: embedding[(k % 8) * 8 + k // 8 + 1]) AS v FROM embeddings)
        {_spread('f', 'v')}""",
    "pooled_vectors": f"""WITH {_RES}, p AS (
          SELECT vec_id, 'mean' AS mode, {_pool('part', 'list_avg')} AS v FROM cut
          UNION ALL SELECT vec_id, 'max', {_pool('part', 'list_max')} FROM cut
          UNION ALL SELECT vec_id, 'all', {_pool('r', 'list_avg')} FROM cut)
        {_spread('p', 'v', 'vec_id, mode')}""",
    "residue_slices": f"""WITH {_RES}, k AS (SELECT vec_id, least(coalesce(len(part), 0), 2) AS length,
            coalesce(flatten(part[1:2]), []) AS v FROM cut)
        SELECT vec_id, length, len(v) AS n_numbers, round(coalesce(list_sum(list_transform(v, lambda x: x::DOUBLE)), 0), 6) AS total FROM k""",
    "paired_concat": f"""WITH {_RES}, k AS (SELECT vec_id, coalesce(len(part), 0) AS alpha_len,
            flatten(list_concat(coalesce(part, []), r[1:6])[1:7]) AS v FROM cut) {_spread('k', 'v', 'vec_id, alpha_len')}""",
    "paired_core_vectors": with_views(f"WITH {_CORES} SELECT * FROM cores", "paired"),
    "misaligned_count": with_views(
        f"WITH {_CORES} SELECT count(*) AS n_rows, count(*) FILTER (WHERE misaligned) AS n_misaligned FROM cores", "paired"
    ),
    "beta_slice": f"WITH {_RES}, k AS (SELECT vec_id, flatten(r[1:5]) AS v FROM cut) {_spread('k', 'v')}",
    "masked_mean": f"""WITH {_RES}, k AS (SELECT vec_id, list_transform(range(1, 9), lambda d:
            coalesce(list_sum(list_transform(r[1 : vec_id % 9], lambda x: x[d]::DOUBLE)), 0) / greatest(1, least(8, vec_id % 9))) AS v FROM cut)
        {_spread('k', 'v')}""",
    "residue_edges": with_views(
        f"""WITH {_WORDS},
            n AS (SELECT cdr3, peptide, least(length(cdr3), 30) AS r, least(length(peptide), 15) AS p FROM words),
            e AS (SELECT cdr3, peptide, 0 AS etype, i AS src, i + 1 AS dst FROM n, range(0, 29) t(i) WHERE i < r - 1
              UNION ALL SELECT cdr3, peptide, 1, 30 + i, 31 + i FROM n, range(0, 14) t(i) WHERE i < p - 1
              UNION ALL SELECT cdr3, peptide, 2, i, 30 + j FROM n, range(0, 30) t(i), range(0, 15) u(j) WHERE i < r AND j < p)
            SELECT cdr3, peptide, etype, 2 * count(*) AS n_edges, sum(src * 100 + dst + dst * 100 + src)::BIGINT AS checksum
            FROM e GROUP BY ALL""",
        "positives",
    ),
    "cdr3_span": with_views(
        f"""WITH f AS ({_FULL}), u AS (SELECT *, upper(core) AS k FROM f),
            h AS (SELECT *, list_filter([k, CASE WHEN k NOT LIKE 'C%' THEN 'C' || k END,
              k || 'F', CASE WHEN k NOT LIKE 'C%' THEN 'C' || k || 'F' END, k || 'W', CASE WHEN k NOT LIKE 'C%' THEN 'C' || k || 'W' END,
              k || 'L', CASE WHEN k NOT LIKE 'C%' THEN 'C' || k || 'L' END, k || 'V', CASE WHEN k NOT LIKE 'C%' THEN 'C' || k || 'V' END],
              lambda t: t IS NOT NULL AND contains(full_aa, t))[1] AS hit FROM u)
            SELECT cdr3, instr(full_aa, hit) - 1 AS span_start, instr(full_aa, hit) - 1 + length(hit) AS span_end, hit AS cut FROM h""",
        "positives",
    ),
    "locate": with_views(
        """SELECT cdr3a, tcra, peptide, instr(tcra, upper(replace(replace(cdr3a, '-', ''), '.', ''))) - 1 AS at_alpha,
                  -1 AS at_empty, instr(tcrb, cdr3b) - 1 AS at_raw_beta FROM paired""",
        "paired",
    ),
    "first_occurrence": with_views(
        """SELECT cdr3, peptide, source, row_order FROM (SELECT *, row_number() OVER (PARTITION BY cdr3 ORDER BY row_order) AS q
             FROM (SELECT cdr3, peptide, source, concat_ws('|', peptide, source, mhc_a) AS row_order FROM positives)) WHERE q = 1""",
        "positives",
    ),
    "embedding_lookup": with_views(
        f"""WITH {_STORE} SELECT p.cdr3, p.peptide, p.source,
              array_to_string(list_transform(list_concat(rs.vec, ps.vec), lambda x: (x * 2)::INT), ',') AS features
            FROM positives p JOIN rs USING (cdr3) JOIN ps USING (peptide)""",
        "positives",
    ),
    "missing_keys": with_views(
        f"WITH {_STORE} SELECT cdr3, count(*) AS n_rows FROM positives WHERE cdr3 NOT IN (SELECT cdr3 FROM rs) GROUP BY cdr3",
        "positives",
    ),
    "vector_coverage": with_views(
        f"""WITH {_STORE} SELECT count(*) AS n_rows, count(rs.cdr3) AS with_receptor, count(ps.peptide) AS with_peptide,
              count(*) FILTER (WHERE rs.cdr3 IS NOT NULL AND ps.peptide IS NOT NULL) AS with_both
            FROM positives p LEFT JOIN rs ON rs.cdr3 = p.cdr3 LEFT JOIN ps ON ps.peptide = p.peptide""",
        "positives",
    ),
    "residue_lookup": with_views(
        """WITH s AS (SELECT cdr3, concat_ws('|', v_gene, peptide, source, mhc_a) AS row_order, length(cdr3) AS length,
                 array_to_string(list_transform(string_split(peptide, ''), lambda x: ascii(x)), ',') AS residues
               FROM positives WHERE v_gene <> 'TRBV5*01'),
             f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cdr3 ORDER BY row_order) AS q FROM s) WHERE q = 1)
           SELECT p.cdr3, p.peptide, p.source, f.length, f.residues FROM positives p JOIN f USING (cdr3)""",
        "positives",
    ),
    "dropped_rows": with_views(
        """SELECT count(*) AS n_rows, count(*) FILTER (WHERE cdr3 NOT IN
             (SELECT cdr3 FROM positives WHERE v_gene <> 'TRBV5*01')) AS n_dropped FROM positives""",
        "positives",
    ),
    "one_to_one_labels": """SELECT c_custkey AS id, c_name, c_mktsegment, (c_acctbal > 0)::INT AS label,
        CASE WHEN c_custkey % 2 = 0 THEN 'Public' ELSE 'Private' END AS usage FROM customer""",
    "align_by_row": """SELECT vec_id AS row_id, label AS kind, c_name, c_mktsegment FROM embeddings JOIN customer ON c_custkey = vec_id""",
    "align_by_pair": with_views(
        """WITH s AS (SELECT cdr3, CASE WHEN source = 'IEDB' THEN peptide || 'X' ELSE peptide END AS peptide, source FROM positives),
             f AS (SELECT * FROM (SELECT cdr3, peptide, v_gene, j_gene, mhc_class, row_number() OVER (PARTITION BY cdr3, peptide
                    ORDER BY concat_ws('|', v_gene, mhc_a, source)) AS q FROM positives) WHERE q = 1)
           SELECT s.cdr3, s.peptide, s.source, v_gene, j_gene, mhc_class FROM s LEFT JOIN f USING (cdr3, peptide)""",
        "positives",
    ),
    "encode_distinct": with_views(
        f"""SELECT cdr3, peptide, source, {_text(f"list_transform(string_split('{','.join(_AA)}', ','), lambda a: length(cdr3) - length(replace(cdr3, a, '')))")} AS counts,
            length(cdr3) AS n FROM positives""",
        "positives",
    ),
    "score_batches": with_views(
        """SELECT cdr3, peptide, source, length(cdr3) / (1.0::DOUBLE + length(peptide) - length(replace(peptide, 'A', ''))) AS score
           FROM positives""",
        "positives",
    ),
    "by_length": with_views("SELECT DISTINCT cdr3, length(cdr3) AS n FROM positives", "positives"),
}
