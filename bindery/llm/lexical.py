"""Ranked lexical search by the Best Position Algorithm.

Each term of a query has an impact list: the documents that hold it, highest impact first.
The lists of a query are read downwards together. A document that turns up is looked up in
all lists at once (direct access), which gives its whole score and also its place in each of them.
The best position of a list is the end of the stretch from its top whose places have all been
seen, by reading or by look-up. A document not seen yet lies below every list's best position, so
the impacts there sum to a bound that falls faster than the one at the last places read. Reading
stops when the bound is strictly below the k-th best score, so equal scores are never missed.

Documents are searched in shards that a task holds at a time. The best of a task's earlier shards
already count for the k-th score, and the best of all tasks are ranked per query.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.shared import bounded_batches, plain
from bindery.staging import staged

#: Characters of the queries that travel with the tasks at a time.
QUERY_CHARS = 4_000_000
#: Entries of the impact lists of one shard.
SHARD_ENTRIES = 1_000_000
#: Places read from each list before the first look-ups; doubled each time.
FIRST_STEP = 32
#: Direct accesses made at once.
ACCESSES = 1 << 20

_LAST = np.iinfo(np.int64).max


def _lowered() -> bytes:
    """Byte by byte: A-Z to lower case, other ASCII but letters and digits to a blank."""
    table = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        table[i] = ord(c.lower()) if c.isalnum() else 0x20
    return bytes(table)


_LOWERED = _lowered()


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_LOWERED).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Shard:
    """Impact lists of some documents: sorted for reading, and by document for direct access."""

    def __init__(self, ids: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.n = ids, len(ids)
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        key = term[order].astype(np.int64) * self.n + self.doc
        self.by_key = np.argsort(key)
        self.keys = key[self.by_key]

    def look_up(self, lists: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is there, its place among all entries) for each list and document."""
        wanted = lists[:, None] * self.n + docs[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted, self.by_key[at]


def best_positions(
    shard: Shard, lists: np.ndarray, times: np.ndarray, k: int, least: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """(document numbers, scores, places read) of the shard's k best documents for a query.

    ``lists`` are the query's distinct terms and ``times`` their numbers in it. Documents that
    score below ``least``, the k-th best of elsewhere, or 0 are not needed.
    """
    there = shard.start[lists + 1] > shard.start[lists]
    lists, times = lists[there], times[there]
    begin, end = shard.start[lists], shard.start[lists + 1]
    begin_of = np.r_[0, np.cumsum(end - begin)]
    seen_place = np.zeros(begin_of[-1] + 1, bool)  # one place after the last stays unseen
    seen_doc = np.zeros(shard.n, bool)
    found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    best, depth, step, read = begin.copy(), 0, FIRST_STEP, 0
    while len(lists):
        slices = [shard.doc[b + depth:min(b + depth + step, e)] for b, e in zip(begin, end, strict=True)]
        reached = np.concatenate(slices)
        read += len(reached)
        new = np.unique(reached[~seen_doc[reached]])
        seen_doc[new] = True
        size = max(1, ACCESSES // len(lists))
        for at in range(0, len(new), size):
            docs = new[at:at + size]
            hit, place = shard.look_up(lists, docs)
            score = (np.where(hit, shard.impact[place], 0) * times[:, None]).sum(axis=0)
            line, _ = np.nonzero(hit)
            place = place[hit]
            seen_place[begin_of[line] + place - begin[line]] = True
            wanted = score >= max(least, 1)
            found, scores = np.r_[found, docs[wanted]], np.r_[scores, score[wanted]]
        if len(found) > k:
            kept = np.lexsort((found, -scores))[:k]
            found, scores = found[kept], scores[kept]
        depth, step = depth + step, 2 * step
        bound = 0
        for i, (b, e) in enumerate(zip(begin, end, strict=True)):
            at = best[i] - b
            ahead = seen_place[begin_of[i] + at:begin_of[i + 1]]
            ahead = int(np.argmin(ahead)) if len(ahead) and not ahead.all() else len(ahead)
            best[i] += ahead
            if best[i] < e:
                bound += int(times[i]) * int(shard.impact[best[i]])
        kth = int(scores.min()) if len(found) >= k else 0
        if bound < max(least, kth, 1):
            break
    return found, scores, read


class Search:
    """Queries with term numbers, weights, and what is best so far for each."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int, total: int, k: int):
        self.queries, self.weights, self.n, self.total, self.k = queries, weights, n, total, k
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in queries]

    def add(self, ids: list, lengths: list, listed: list, counts: list) -> None:
        """Search the documents given by id (or null), terms in all, and query terms with counts."""
        null = np.array([i is None for i in ids])
        key = np.array([_LAST if i is None else i for i in ids], np.int64)
        order = np.lexsort((null, key))  # a document's number follows its id, nulls last
        sizes = np.array([len(listed[i]) for i in order])
        term = np.concatenate([listed[i] for i in order]).astype(np.int64)
        tf = np.concatenate([counts[i] for i in order]).astype(np.int64)
        length = np.array([100 - 75 + (75 * lengths[i] * self.n) // self.total for i in order], np.int64)
        doc = np.repeat(np.arange(len(order)), sizes)
        impact = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[doc]))
        used = impact > 0
        shard = Shard(key[order], term[used], doc[used], impact[used], len(self.weights))
        if not used.any():
            return
        for q, (lists, times) in enumerate(self.queries):
            old_ids, old_scores, old_null = self.best[q]
            least = int(old_scores.min()) if len(old_scores) >= self.k else 0
            found, scores, _ = best_positions(shard, lists, times, self.k, least)
            if len(found):
                all_ids = np.r_[old_ids, shard.ids[found]]
                all_scores = np.r_[old_scores, scores]
                all_null = np.r_[old_null, null[order][found]]
                kept = np.lexsort((all_null, all_ids, -all_scores))[:self.k]
                self.best[q] = all_ids[kept], all_scores[kept], all_null[kept]


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_terms, listed, counts): terms in all, and the query terms with their counts."""

    def run(batches):
        for batch in batches:
            numbers, counts, sizes, lengths = [], [], [0], []
            for text in batch.column("text").to_pylist():
                words = terms(text)
                lengths.append(len(words))
                for word, n in Counter(words).items():
                    number = vocabulary.get(word)
                    if number is not None:
                        numbers.append(number)
                        counts.append(n)
                sizes.append(len(numbers))
            offsets = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
            ], names=["doc_id", "n_terms", "listed", "counts"])

    return docs.mapInArrow(run, "doc_id bigint, n_terms bigint, listed array<int>, counts array<int>")


def _searched(
    postings: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int, total: int, k: int
) -> DataFrame:
    """(query, doc_id, score): each task's best documents of each query."""

    def run(batches):
        search = Search(queries, weights, n, total, k)
        waiting, entries = [], 0
        for batch in batches:
            listed, counts = batch.column("listed"), batch.column("counts")
            numbers, times = listed.flatten().to_numpy(), counts.flatten().to_numpy()
            cuts = listed.offsets.to_numpy() - listed.offsets[0].as_py()
            for i, (doc_id, length) in enumerate(zip(
                batch.column("doc_id").to_pylist(), batch.column("n_terms").to_pylist(), strict=True
            )):
                if cuts[i] == cuts[i + 1]:
                    continue
                waiting.append((doc_id, length, numbers[cuts[i]:cuts[i + 1]], times[cuts[i]:cuts[i + 1]]))
                entries += int(cuts[i + 1] - cuts[i])
                if entries >= SHARD_ENTRIES:
                    search.add(*zip(*waiting, strict=True))
                    waiting, entries = [], 0
        if waiting:
            search.add(*zip(*waiting, strict=True))
        for q, (ids, scores, null) in enumerate(search.best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, mask=null), pa.array(scores),
                ], names=["query", "doc_id", "score"])

    return postings.mapInArrow(run, "query int, doc_id bigint, score bigint")


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """Ranked documents of some queries, given as rows (item_id, text); None without terms."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    queries, names = [], []
    for item_id, text in rows:
        counted = Counter(terms(text))
        if counted:
            lists = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in counted], np.int64)
            queries.append((lists, np.array(list(counted.values()), np.int64)))
            names.append((len(names), item_id))
    if not queries:
        return None
    postings = staged(_postings(docs, vocabulary), "postings")
    n, total = postings.agg(F.count_if(F.col("n_terms") > 0), F.coalesce(F.sum("n_terms"), F.lit(0))).head()
    held = dict(postings.select(F.explode("listed").alias("t")).groupBy("t").agg(F.count("*")).collect())
    weights = np.array([weight(n, held[t]) if t in held else 0 for t in range(len(vocabulary))], np.int64)
    found = _searched(postings, queries, weights, n, max(1, total), k)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    numbered = spark.createDataFrame(names, "query int, item_id bigint")
    return ranked.join(numbered, "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text",
    item_id: str = "item_id", item_text: str = "text", query_chars: int = QUERY_CHARS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of highest score above 0 for each item.

    Equal scores go by ascending doc_id, null ids last. Rows of ``docs`` that share an id are documents of
    their own; empty and null texts hold no term. Rows of ``items`` equal in both columns count
    once; those that share an id only are ranked each by itself; an item without a term, or
    whose terms no document holds, gives no row. No documents or no items give none. Other
    columns are not read. Queries travel with the tasks, ``query_chars`` of text at a time; more
    of them are searched block by block, each over all documents.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = plain(docs, {"doc_id": doc_id, "text": doc_text}).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    asked = plain(items, {"item_id": item_id, "text": item_text}).where("text is not null")
    asked = asked.withColumn("item_id", F.col("item_id").cast("bigint")).distinct()
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    blocks = max(1, -(-size // query_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    results = []
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in asked.where(part == b).orderBy("item_id", "text").collect()]
        found = _block(docs, rows, k)
        if found is not None:
            results.append(found)
    if not results:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole
