import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from bindery.llm import lexical
from bindery.llm.lexical import Shard, best_positions, rank_documents, terms

from .cases import ODD_TEXTS, frame, no_documents, odd_documents

ITEMS = "item_id bigint, text string"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k):
    """Ranked rows by scoring every document for every item."""
    counted = [(d, Counter(words(t))) for d, t in docs]
    lengths = [sum(c.values()) for _, c in counted]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in sorted({(i, t) for i, t in items if t is not None}, key=repr):
        found = []
        for (d, c), size in zip(counted, lengths, strict=True):
            score = 0
            for w in words(text):
                if c[w]:
                    m = 25 + (75 * size * n) // total
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    score += weight * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def result(docs, items, **how):
    return sorted(map(tuple, rank_documents(docs, items, **how).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(vocabulary[int(300 * rng.random() ** 3)] for _ in range(n))
    docs = [(i, draw(rng.randrange(1, 80))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # equal scores
    docs += [(2000, None), (2001, ""), (2002, "The END of w3, w3; W3!"), (3, "w250 w251"), (None, docs[7][1])]
    items = [(i, draw(rng.randrange(1, 25))) for i in range(25)]
    items += [(3, "w3 w3 w200"), (90, "unheard of"), (91, None), (92, ""), (93, docs[7][1]), (93, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("k", [1, 10])
def test_ranks_are_those_of_all_scores(spark, monkeypatch, corpus, small, k):
    docs, items = corpus
    how = {}
    if small:
        monkeypatch.setattr(lexical, "SHARD_ENTRIES", 200)
        monkeypatch.setattr(lexical, "FIRST_STEP", 1)
        monkeypatch.setattr(lexical, "ACCESSES", 50)
        how = {"query_chars": 400}
    assert result(frame(spark, docs).repartition(3), frame(spark, items, ITEMS), k=k, **how) == brute(docs, items, k)


def test_terms():
    for text in [t or "" for t in ODD_TEXTS] + ["É-École_x9\x7fÀb", "İI ſ K"]:
        assert [w.decode() for w in terms(text)] == words(text)


def test_reading_stops_early_and_keeps_ties():
    rng = np.random.default_rng(1)
    n = 5000
    doc = np.tile(np.arange(n), 3)
    term = np.repeat(np.arange(3), n)
    impact = rng.integers(1, 1000, 3 * n)
    for leader in range(20):
        impact[[leader, n + leader, 2 * n + leader]] = 1000 + leader // 4
    shard = Shard(np.arange(n), term, doc, impact, 3)
    lists, times = np.arange(3), np.array([1, 2, 1])
    found, scores, read = best_positions(shard, lists, times, 10, 0)
    whole = impact[:n] + 2 * impact[n:2 * n] + impact[2 * n:]
    want = np.lexsort((np.arange(n), -whole))[:10]
    assert sorted(found) == sorted(want) and sorted(scores) == sorted(whole[want])
    assert read < 3 * n // 10


def test_odd_rows(spark):
    df, items = odd_documents(spark), [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "word")]
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = result(df, frame(spark, items, ITEMS))
    want = brute(rows, items, 10)
    assert got == want and any(r[0] is None for r in got)
    empty = frame(spark, [], ITEMS)
    assert result(df, empty) == result(no_documents(spark), frame(spark, items, ITEMS)) == []
    assert rank_documents(df, empty).columns == rank_documents(df, frame(spark, items, ITEMS)).columns
