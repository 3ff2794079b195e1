import random
from collections import Counter

import numpy as np
import pytest

from bindery.llm import suffix_dedup
from bindery.llm.suffix_dedup import drop_repeats, repeated_starts, suffix_order

from .cases import frame, no_documents, odd_documents, prose


def brute(rows, length):
    """(doc_id, n_bytes, removed runs, kept bytes) of each row, string by string."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(t[p:p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        covered = set()
        for p in range(len(t) - length + 1):
            if counts[t[p:p + length]] > 1:
                covered.update(range(p, p + length))
        runs = [p for p in covered if p - 1 not in covered], [p + 1 for p in covered if p + 1 not in covered]
        out.append((
            i, len(t), list(zip(*map(sorted, runs), strict=True)),
            bytes(b for p, b in enumerate(t) if p not in covered),
        ))
    return sorted(out, key=repr)


def result(df, length):
    return sorted((
        (r["doc_id"], r["n_bytes"], [tuple(x) for x in r["removed"]], bytes(r["kept"]))
        for r in drop_repeats(df, length).collect()
    ), key=repr)


def test_suffix_order_is_the_sorted_order():
    rng = random.Random(1)
    for _ in range(1500):
        most = rng.choice([1, 2, 3, 26, 10**6])
        s = [rng.randrange(1, most + 1) for _ in range(rng.randrange(60))]
        assert suffix_order(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])  # noqa: B023


def test_neighbours_tell_what_is_repeated():
    rng = random.Random(2)
    for _ in range(500):
        length, letters = rng.randrange(1, 8), rng.choice(["a", "ab", "abc"])
        pieces = ["".join(rng.choices(letters, k=rng.randrange(20))).encode() for _ in range(rng.randrange(1, 6))]
        counts = Counter(p[i:i + length] for p in pieces for i in range(len(p) - length + 1))
        for p, flags in zip(pieces, repeated_starts(pieces, length), strict=True):
            assert flags.tolist() == [counts[p[i:i + length]] > 1 for i in range(len(p) - length + 1)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, passages shared in part, passages just long enough or not, repeats inside a text."""
    rng = random.Random(3)
    rows = [(i, prose(i, 60)) for i in range(30)]
    passage = prose(500, 40)
    for i in range(25):
        a, b = sorted(rng.sample(range(len(passage)), 2))
        rows.append((100 + i, f"{prose(600 + i, 8)} {passage[a:b]} {prose(700 + i, 8)}"))
    rows += [(200 + i, rows[3][1]) for i in range(20)]
    rows += [(300, "x" * 400), (301, "y" * 37 + "x" * 50), (302, "ab" * 100), (303, prose(9, 10) * 4)]
    rows += [(400 + n, prose(800, 20)[:n]) for n in (38, 39, 40, 41, 42)]
    return rows


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("length", [1, 7, 40])
def test_removed_runs_are_those_of_a_plain_loop(spark, monkeypatch, corpus, length, small):
    if small:  # packs, slices, pieces and buckets end within texts, and no key fits into a bucket
        for name, value in {"PACK_BYTES": 900, "BUCKET_BYTES": 700, "HEAVY_BYTES": 300, "SLICE": 64, "PIECE": 16}.items():
            monkeypatch.setattr(suffix_dedup, name, value)
    assert result(frame(spark, corpus), length) == brute(corpus, length)


def test_one_passage_in_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY_BYTES", 2000)
    passage = prose(1, 12)
    rows = [(i, prose(10 + i, 20)) for i in range(200)]
    rows += [(1000 + i, f"{prose(2000 + i, 3)} {passage} {prose(4000 + i, 3)}") for i in range(100)]
    assert result(frame(spark, rows), 30) == brute(rows, 30)


def test_odd_rows(spark):
    df = odd_documents(spark)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    for length in (3, 400):
        assert result(df, length) == brute(rows, length)
    assert drop_repeats(no_documents(spark)).collect() == []
    assert result(frame(spark, [(None, None), (None, "")]), 400) == [(None, 0, [], b"")] * 2


def test_matches_end_with_their_document(spark):
    rows = [(1, "abcdefgh"), (2, "xyzabcd"), (3, "efghxyz")]
    assert [r[2] for r in result(frame(spark, rows), 8)] == [[], [], []]


def test_strings_of_heavy_keys_are_told_by_the_stretch(spark):
    same = b"abcdefghijklmnopqrstuvwxyz" * 3
    rows = [(1, 1, True, b"01" + same + b"23"), (2, 2, True, b"4" + same), (3, 3, False, same[:40]), (4, 4, True, same[20:60] + b"#!?" + same[:11])]
    df = spark.createDataFrame(rows, "d1 bigint, d2 bigint, single boolean, text binary")
    texts, n = [bytes(r[3]) for r in rows], 10
    counts = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    want = []
    for d1, _, single, t in rows:
        flags = [counts[t[i:i + n]] > 1 for i in range(len(t) - n + 1)]
        if single:
            want += [(d1, int(b), int(e)) for b, e in suffix_dedup._ranges(np.array(flags))]
    assert sorted((r["d1"], r["begin"], r["end"]) for r in suffix_dedup._compared(df, n).collect()) == sorted(want)
