"""Fixed values that results depend on."""

# --- fixed values: schemas -------------------------------------------------------
PAIR_COLUMNS = [
    "cdr3", "tcr_chain", "v_gene", "j_gene", "peptide", "mhc_a", "mhc_b", "mhc_class",
]
LABELLED_COLUMNS = [*PAIR_COLUMNS, "label"]
SPLIT_COLUMN = "split"
VDJDB_COLUMNS = [
    "gene", "cdr3", "v.segm", "j.segm", "species", "mhc.a", "mhc.b", "mhc.class",
    "antigen.epitope",
]
REQUIRED_WITHOUT_MHC_B = [
    "cdr3", "tcr_chain", "v_gene", "j_gene", "peptide", "mhc_a", "mhc_class",
]
PAIRED_SEQUENCES = [
    "tcra", "cdr1a", "cdr2a", "cdr3a", "cdr3a_extended",
    "tcrb", "cdr1b", "cdr2b", "cdr3b", "cdr3b_extended", "peptide",
]
PAIRED_CATEGORIES = ["va", "ja", "vb", "jb", "hla"]
PAIRED_RECEPTOR = [
    "va", "ja", "tcra", "cdr1a", "cdr2a", "cdr3a", "cdr3a_extended",
    "vb", "jb", "tcrb", "cdr1b", "cdr2b", "cdr3b", "cdr3b_extended",
]
FULL_SEQUENCE_COLUMNS = [
    "full_aa", "cdr3_start", "cdr3_end", "peptide", "cdr3", "v_gene", "j_gene",
    "mhc_a", "mhc_b", "mhc_class", "source",
]

# --- fixed values: cleaning ------------------------------------------------------
WILDCARD_PATTERN = r"[X*?]"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CLASS_ONE_PATTERN = r"HLA CLASS I|HLA-[ABCEXFG]\b|B2M|HLA-E|HLA-C|HLA-A|HLA-B"
CLASS_ONE_PATTERN_STRICT = r"HLA CLASS I\b|HLA-[ABCEXFG]\b|B2M|HLA-E|HLA-C|HLA-A|HLA-B"
CLASS_TWO_PATTERN = r"HLA CLASS II|HLA-DP|HLA-DQ|HLA-DR"
HUMAN_TAXON = "NCBITaxon_9606"
STRONG_METHODS = [
    "multimer/tetramer", "surface plasmon resonance (SPR)", "x-ray crystallography",
]
# Spellings of a missing value that the table reader treats as null.
NULL_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Cleaning steps by source, in the order in which they are reported.
STEPS = {
    "VDJdb": ["species", "chain", "required_fields", "wildcards", "confidence_filter", "gene_standardization"],
    "IEDB": ["species", "chain", "confidence_filter", "required_fields", "wildcards", "gene_standardization"],
    "McPAS": ["species", "required_fields", "wildcards", "gene_standardization"],
}
# Gene symbols: an allele behind a colon, and what follows the first of several genes.
COLON_ALLELE_PATTERN = r":(\d)"
LATER_GENES_PATTERN = r"(?i)/.*|\s+or\s+.*"
# Files of an export that hold no table.
SKIPPED_TABLES = ["LICENSE.txt", "latest-version.txt"]

# --- fixed values: metrics -------------------------------------------------------
TRAIN_EPS = 1e-8
CALIBRATION_EPS = 1e-12

# --- fixed values: sequences -----------------------------------------------------
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
PAD_SYMBOL = "-"
UNKNOWN_SYMBOL = "X"
RECEPTOR_LENGTH = 30
PEPTIDE_LENGTH = 15
PAIRED_LENGTH = 40
FULL_LENGTH = 160
SPAN_TERMINALS = ["F", "W", "L", "V"]

# --- fixed values: negatives -----------------------------------------------------
MIN_PAIRS = 10
FAR_DISTANCE = 3
DRAWS_COMMON = 3
DRAWS_RARE = 2
DRAWS_PAIRED = 5
MAX_RATIO = 2

# --- fixed values: reports -------------------------------------------------------
EMBEDDING_ALIASES = {
    "ae_plain": "autoencoder/plain_ae",
    "plain_ae": "autoencoder/plain_ae",
    "ae_vae": "autoencoder/vae",
    "vae": "autoencoder/vae",
    "esm_cdr3": "esm/cdr3",
    "esm_full": "esm/full",
}
EMBEDDING_LABELS = {
    "one_hot": "onehot",
    "autoencoder/plain_ae": "ae",
    "autoencoder/vae": "vae",
    "esm/cdr3": "esm_cdr3",
    "esm/full": "esm_vdj",
}
MODEL_SHORT_NAMES = {
    "cnn": "CNN", "cross_attention": "CA", "gnn": "GNN", "mlp": "MLP", "random_forest": "RF",
}
MODEL_ORDER = ["RF", "MLP", "CNN", "CA", "GNN"]
# What an experiment name says about its representation; the first text found counts.
REPRESENTATION_TEXTS = [
    ("esm_cdr3", "ESM (CDR3)"), ("esm-cdr3", "ESM (CDR3)"),
    ("esm_full", "ESM (Full VDJ)"), ("esm-full", "ESM (Full VDJ)"),
    ("vae", "VAE"), ("one_hot", "One-hot"), ("onehot", "One-hot"),
    ("raw", "Raw Sequence"), ("gnn", "Graph"), ("autoencoder", "AE"),
]
REPRESENTATION_WORDS = [("ae", "AE")]
UNKNOWN_REPRESENTATION = "Unknown"
# Texts that say that categories were used, by ledger column, and the two marks.
METADATA_TEXTS = {
    "metadata": ["cat_ae", "one_hot"], "feature_augment": ["cat_ae", "one_hot"],
    "categorical": ["cat_ae", "one_hot"], "experiment_name": ["meta"],
}
METADATA_MARKS = ("+", "–")
REPRESENTATION_ORDER = [
    "One-hot", "AE", "VAE", "ESM (CDR3)", "ESM (Full VDJ)", "Raw Sequence", "Graph",
]
UNSEEN_PEPTIDES = ["SALPTNADLY", "TSDACMMTMY", "FTDALGIDEY"]
