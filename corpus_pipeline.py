"""Cleaning a corpus end to end: five stages, each a table of documents to the next.

Toxic documents go, one document of each group of near copies stays, documents that hold a
benchmark item go, personal data is masked, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bindery.llm import bpe, decontaminate, near_dup, pii, toxicity
from bindery.llm.shared import table
from bindery.staging import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``toxicity.TOXIC_FROM`` under a model learnt from the labelled
    ones among them.

    A text without a toxic passage stays, so null and empty ones do. Long texts are read whole. Rows are judged one by one, so repeated rows and
    rows with one id or none are treated alike; a document with several labels, or a null one, is
    learnt from as its rows say. Without usable labels nothing is rejected. Empty tables stay
    empty, and all columns of ``docs`` are kept.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text").join(labels, "doc_id"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each component: five-word shingles, similarity 0.8.

    Null and empty texts, and texts without a word, are linked with nothing and stay. A text of fewer
    than five words is one shingle. Long texts are compared whole. Equal similarities need no
    order, as all links count. Rows with a kept id all stay, repeated rows among them; a null id is
    kept only if its component has no other. Empty tables stay empty, all columns are kept.
    """
    return near_dup.drop_near_copies(docs, width=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than 0.8 of the five-word shingles of every benchmark item.

    Null and empty texts hold nothing and stay; null items and items without a word match nothing, and
    an item of fewer than five words is one shingle of its own width. Passages are found in texts
    of any length. Rows are judged by their text alone, so repeated rows and ids, and null ids,
    are treated alike. Empty tables of documents or items change nothing, all columns are kept.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind.

    A null text stays null and an empty one empty; long texts are masked whole; of overlapping spans the
    union is masked once. ``n_chars`` is counted anew; ids, repeated rows and other columns stay as they
    are. Empty tables stay empty.
    """
    return pii.mask_pii(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document.

    Null and empty texts have no ids; long texts are encoded whole, without truncation; null ids stay
    null and repeated rows are repeated. An empty table gives no rows.
    """
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: The model of the first stage and the ids of the last are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
