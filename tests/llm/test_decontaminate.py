import re

from bindery.llm import decontaminate
from bindery.llm.decontaminate import contaminated, drop_contaminated
from bindery.llm.shingles import WordHashes, letter_words

from .cases import frame, no_documents, odd_documents, prose

ITEMS = "item_id bigint, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, width=5, num=80, den=100):
    out = set()
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        own = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
        for doc, body in docs:
            b = words(body)
            there = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)}
            shared = len(own & there)
            if own and den * shared >= num * len(own):
                out.add((doc, item, shared, len(own)))
    return out


def tables():
    items = [(i, prose(i, 12 + 5 * i)) for i in range(30)] + [(100, "Two words"), (101, "four short words here"), (102, None), (103, "..."), (30, prose(30, 9))]
    docs = []
    for i in range(30):
        w = prose(i, 12 + 5 * i).split()
        docs.append((i, prose(500 + i, 300) + " " + " ".join(w).upper() + "! " + prose(600 + i, 300)))
        half = len(w) // 2
        docs.append((100 + i, " ".join(w[:half]) + " " + prose(700 + i, 50)))  # only a half
        w[half] = "changed"
        docs.append((200 + i, prose(800 + i, 3000) + " " + ", ".join(w)))  # 0.8 or not, by length
    docs += [(900, "here are two words"), (901, "four short words there"), (902, ""), (903, None)]
    return docs, items


def test_pairs_are_those_of_all_comparisons(spark):
    docs, items = tables()
    df, it = frame(spark, docs), frame(spark, items, ITEMS)
    want = brute(docs, items)
    assert {tuple(r) for r in contaminated(df, it).collect()} == want
    assert {tuple(r) for r in contaminated(df, it, max_carried=0).collect()} == want
    kept = {r["doc_id"] for r in drop_contaminated(df, it).collect()}
    assert kept == {d for d, _ in docs} - {w[0] for w in want}


def test_odd_rows(spark):
    df = odd_documents(spark)
    items = frame(spark, [(1, "again again again again again again"), (2, None), (None, "two words"), (2, "x")], ITEMS)
    for most in (0, 100):
        got = {(r["doc_id"], r["item_id"]) for r in contaminated(df, items, max_carried=most).collect()}
        assert (16, 1) in got and (6, None) in got
    kept = drop_contaminated(df, items)
    assert kept.columns == df.columns and kept.exceptAll(df).isEmpty() and kept.where("__key = 'x'").count() > 10
    assert kept.where("doc_id = 16").isEmpty() and not kept.where("doc_id = 5").isEmpty()


def test_no_rows(spark):
    none, items = no_documents(spark), frame(spark, [], ITEMS)
    assert contaminated(none, frame(spark, [(1, "a b")], ITEMS)).collect() == []
    assert contaminated(odd_documents(spark), items).collect() == []
    assert drop_contaminated(odd_documents(spark), items).count() == odd_documents(spark).count()


def test_each_size_class_reads_up_to_its_own_bound():
    """One short item must not make documents give all their hashes for the long ones."""
    known = WordHashes()
    sets = {size: decontaminate._signed_shingles(letter_words(prose(size, size + 4, 10**6)), 5, known) for size in (10, 900)}
    rows = [
        {"item_id": n, "width": 5, "size": n, "size_class": n.bit_length(), "hashes": s.tolist()} for n, s in sets.items()
    ]
    short, long = sorted(decontaminate._carried(rows, 80, 100), key=lambda c: len(c.full[0]))
    document = decontaminate._signed_shingles(letter_words(prose(1, 5000, 10**6)), 5, known)
    assert len(short.low(document)) > len(document) / 2
    assert len(long.low(document)) < len(document) / 10
