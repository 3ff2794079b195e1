import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.llm import near_dup
from bindery.llm.components import connected_components
from bindery.llm.near_dup import drop_near_copies, near_components

from .cases import frame, no_documents, odd_documents, prose


def brute(rows, width, num, den):
    """Component of each row by comparing every pair of sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width
                    else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and den * common >= num * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return {d: (len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows)}


def family(seed, copies, n_words, edits, first_id):
    """Copies of one text, each with its own words replaced."""
    rng, base = random.Random(seed), prose(seed, n_words).split()
    rows = []
    for i in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(n_words)] = f"e{rng.random()}"
        rows.append((first_id + i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def corpus():
    rows = [r for f in range(12) for r in family(f, 8, 40 + 10 * f, 6, 100 * f)]
    rows += family(50, 60, 80, 9, 5000)  # one large group, whose pairs lie on both sides
    shared = prose(77, 60)
    rows += [(7000 + i, f"{shared} {prose(700 + i, 120)}") for i in range(40)]  # a common passage
    rows += [(8000 + i, prose(900 + i, 30)) for i in range(60)]
    rows += [(9000 + i, "Exactly  the SAME words\nhere") for i in range(20)] + [(9100, "exactly the same words here")]
    rows += [(9200, "a b"), (9201, "A\tb"), (9202, "a"), (9203, ""), (9204, None)]
    random.Random(0).shuffle(rows)
    return rows


def result(df, **how):
    return {r["doc_id"]: tuple(r)[1:] for r in near_components(df, **how).collect()}


def test_components_are_those_of_all_pairs(spark, corpus):
    assert result(frame(spark, corpus), width=3, num=85, den=100) == brute(corpus, 3, 85, 100)


def test_five_words(spark, corpus):
    assert result(frame(spark, corpus)) == brute(corpus, 5, 80, 100)


@pytest.mark.parametrize(("region", "shingles"), [(8, 10**9), (1024, 500), (16, 500)])
def test_deep_regions_and_large_clusters(spark, corpus, monkeypatch, region, shingles):
    monkeypatch.setattr(near_dup, "REGION", region)
    monkeypatch.setattr(near_dup, "CLUSTER_SHINGLES", shingles)
    assert result(frame(spark, corpus), width=3, num=85, den=100) == brute(corpus, 3, 85, 100)


def test_odd_rows(spark):
    df = odd_documents(spark)
    rows = near_components(df).collect()
    assert len(rows) == df.count()
    assert all(r["kept"] and r["n_shingles"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert drop_near_copies(df).columns == df.columns
    assert near_components(no_documents(spark)).collect() == drop_near_copies(no_documents(spark)).collect() == []


def test_long_paths_are_one_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (2000, 2000)]
    got = {r["node"]: r["component"] for r in connected_components(frame(spark, edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(3)}}
    assert connected_components(frame(spark, [], "a bigint, b bigint")).collect() == []


def fringed(seed, copies, fringe):
    """A text, copies of it with another last word, and texts at 0.81 of it but 0.79 of its copies."""
    rng, base = random.Random(seed), prose(seed, 100, 10**6).split()
    rows = [(0, " ".join(base))] + [(1 + i, " ".join([*base[:-1], f"c{i}"])) for i in range(copies)]
    for i in range(fringe):
        words = list(base)
        for p in (rng.randrange(5, 45), rng.randrange(50, 90)):
            words[p] = f"f{i}.{p}"
        rows.append((10_000 + i, " ".join(words)))
    return rows


def test_hot_regions_are_searched_whole(spark, monkeypatch):
    rows = fringed(3, 60, 20) + [(20_000 + i, prose(i, 30)) for i in range(40)]
    monkeypatch.setattr(near_dup, "REGION", 8)
    assert result(frame(spark, rows)) == brute(rows, 5, 80, 100)


def test_large_clusters_are_confirmed_over_all_pairs(spark, monkeypatch):
    rows = fringed(5, 60, 20)
    monkeypatch.setattr(near_dup, "REGION", 8)
    monkeypatch.setattr(near_dup, "CLUSTER_SHINGLES", 3000)
    assert result(frame(spark, rows)) == brute(rows, 5, 80, 100)


def test_repeated_and_null_ids_keep_their_own_texts(spark):
    """Texts under one id are in one cluster but not linked; another text is linked to one only."""
    rows, want = [], {}
    for f in range(6):
        base = prose(600 + f, 120, 10**6).split()
        near = [*base[:-8], *(f"n{k}" for k in range(8))]
        far = [*(f"f{k}" for k in range(22)), *base[22:]]
        shared, least = (None if f % 2 else 100 + f), f
        rows += [(shared, " ".join(base)), (shared, " ".join(far)), (least, " ".join(near))]
        want |= {(shared, rows[-3][1]): least, (shared, rows[-2][1]): shared, (least, rows[-1][1]): least}
    sizes = {}
    for i, t in rows:
        sizes.setdefault((i, len(t.split())), []).append(want[i, t])
    got = {}
    for r in near_components(frame(spark, rows)).collect():
        got.setdefault((r["doc_id"], r["n_shingles"] + 4), []).append(r["component_id"])
    order = lambda v: sorted(v, key=str)
    assert {k: order(v) for k, v in got.items()} == {k: order(v) for k, v in sizes.items()}


def test_regions_get_as_deep_as_they_must(monkeypatch):
    monkeypatch.setattr(near_dup, "REGION", 4)
    rng = np.random.default_rng(1)
    paths = rng.integers(0, 3, (300, near_dup.HASHES)).astype(np.uint8)
    paths = np.concatenate([paths, np.repeat(paths[:1], 6, axis=0)])
    paths = paths[np.lexsort(paths.T[::-1])]
    regions = sorted(near_dup._deeper(paths))
    assert regions[0][0] == 0 and regions[-1][1] == len(paths)
    assert all(a[1] == b[0] for a, b in zip(regions, regions[1:], strict=False))
    large = [(a, b) for a, b in regions if b - a > 4]
    assert len(large) == 1 and (paths[large[0][0]:large[0][1]] == paths[large[0][0]]).all()


def test_copies_of_a_template_are_joined_in_linear_time(spark, monkeypatch):
    """Nodes of one piece never meet each other on the way up."""
    monkeypatch.setattr(near_dup, "REGION", 16)
    rows = fringed(9, 400, 10)
    nodes = near_dup.signatures(frame(spark, rows), 5).select("node", "signature").distinct()
    asked = []
    plain = near_dup._by_blocks
    monkeypatch.setattr(near_dup, "_by_blocks", lambda blocks, *how: asked.append(blocks) or plain(blocks, *how))
    near_dup._clusters(nodes, 0.8).collect()
    n = nodes.count()
    pairs = asked[0].alias("x").join(asked[0].alias("y"), F.expr("x.part = y.part and x.node < y.node and x.piece <> y.piece"))
    assert n > 300 and pairs.count() < n * n / 10
    whole = asked[0].where("high > low").selectExpr("max(high - low)").first()[0]
    assert whole and whole > 5
