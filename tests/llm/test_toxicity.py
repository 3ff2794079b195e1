import random

from hypothesis import given, settings
from hypothesis import strategies as st

from bindery.llm.toxicity import drop_toxic, fit, maximal_segments, score_documents

from .cases import frame, no_documents, odd_documents, odd_rows, prose

LABELLED = "doc_id bigint, text string, toxic int"


def by_definition(scores):
    """Maximal segments, recursively: the best segment, then those left and right of it."""
    best, at = 0, None
    for b in range(len(scores)):
        total = 0
        for e in range(b, len(scores)):
            total += scores[e]
            if total > best or (total == best and at and e + 1 - b < at[1] - at[0]):
                best, at = total, (b, e + 1)
    if not at:
        return []
    left = by_definition(scores[:at[0]])
    right = [(b + at[1], e + at[1], s) for b, e, s in by_definition(scores[at[1]:])]
    return [*left, (*at, best), *right]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(-100, 100).filter(bool), max_size=20))
def test_scan_finds_all_maximal_segments(scores):
    # sums of distinct powers avoid ties between segments
    scores = [s + (i + 1) * 1e-6 for i, s in enumerate(scores)]
    got = [(b, e) for b, e, _ in maximal_segments(scores)]
    assert got == [(b, e) for b, e, _ in by_definition(scores)]


def test_scan_is_linear():
    rng = random.Random(0)
    assert maximal_segments([rng.choice([-1.0, 1.0]) for _ in range(300_000)])
    assert len(maximal_segments([1.0 if i % 2 else -2.0 for i in range(200_000)])) == 100_000


def labelled(n):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        words = prose(i, rng.randrange(30, 120), 500).split()
        if i % 5 == 0:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["vilest", "vilely", f"grubbo{rng.randrange(30)}"]) for _ in range(rng.randrange(2, 7))]
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def test_unseen_documents_are_told_apart(spark):
    rows = labelled(700)
    model = fit(frame(spark, rows[:500], LABELLED))
    scored = {r["doc_id"]: r for r in score_documents(frame(spark, [r[:2] for r in rows]), model).collect()}
    wrong = [d for d, _, y in rows[500:] if (scored[d]["score"] >= 0.3) != y]
    assert len(wrong) <= 4
    text = "fine words " * 20 + "grubbo999 vilest grubbo998 " + "fine words " * 20  # unseen words, known stem
    hit = score_documents(frame(spark, [(1, text)]), model).head()
    assert hit["score"] > 0.5 and any(p["start"] <= 41 < p["end"] for p in hit["passages"])


def test_odd_rows(spark):
    model = fit(frame(spark, labelled(100), LABELLED))
    rows = score_documents(odd_documents(spark), model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    kept = drop_toxic(odd_documents(spark), model)
    assert kept.columns == odd_documents(spark).columns and kept.count() == len(odd_rows())
    assert kept.exceptAll(odd_documents(spark)).isEmpty()
    assert drop_toxic(frame(spark, [(1, "no other columns")]), model).count() == 1
    assert score_documents(no_documents(spark), model).collect() == []
    assert drop_toxic(no_documents(spark), model).collect() == []


def test_without_labels_or_with_one_class(spark):
    odd = [(1, None, 1), (None, "x", 1), (2, "y", None)]
    for rows in ([], odd, [(1, "a b", 0), (2, "c d", 0)], [(1, "a b", 1), (2, "c d", 1)]):
        model = fit(frame(spark, rows, LABELLED))
        got = score_documents(frame(spark, [(1, "a b"), (2, "")]), model).collect()
        assert got[0]["score"] == got[1]["score"]
