"""Near duplicates with an LSH forest.

1. Every text becomes a set of hashed word shingles and a signature of ``HASHES`` minima. Rows
   with equal sets are one node from here on.
2. The forest: ``TREES`` orders of the signature's values, in each of which nodes are sorted. Nodes
   whose first ``DEPTH`` values are equal form a region, and all its nodes are candidates of
   each other. Regions of one node, which are almost all, end there.
3. In a region, nodes whose signatures agree in enough places hang together; a region passes on
   a spanning star of each such piece, not its pairs. Neighbours in the sorted order, who have the
   longest common prefixes, are compared first, and then only what is not joined yet.
4. A region of more than ``REGION`` nodes is entered deeper: it falls into the regions of the least
   depth at which they are small enough, found from the common prefixes of neighbours. These are
   searched first. Then the way goes up again: pieces joined so far are compared with all others
   that share regions with them, in blocks, and a piece larger than a block is never
   compared with itself. So no link of a region is left out, and what a template has
   in copies is joined in linear time.
5. Components of these are *clusters*: they hold every link of a region (the agreement asked for
   lies five deviations below the threshold's), and more. Two texts with a similarity of 0.80
   have a region in common but for a chance of 1 in 97,000.
6. Clusters get their whole texts, and all links inside one are confirmed on full sets. A
   cluster with more than ``CLUSTER_SHINGLES`` is confirmed in blocks of a quarter of that, each
   on its own and then against every other, with the same result.
7. Components of the confirmed links, named by their least document.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.components import connected_components
from bindery.llm.shared import bounded_batches, documents, partitions, per_text
from bindery.llm.shingles import WordHashes, minhash, permutations, shingle_hashes, space_words
from bindery.operators.lookup import spread_join
from bindery.staging import staged

HASHES = 64
TREES = 16
#: Values in a region's prefix.
DEPTH = 3
#: Nodes of a region in one task; also of a block, as long as a group has no more than ``BLOCKS``.
REGION = 1024
BLOCKS = 64
CLUSTER_SHINGLES = 8_000_000


def _order(tree: int) -> list[int]:
    """A tree's order of the signature; the first four places differ between all trees."""
    first = [(4 * tree + i) % HASHES for i in range(4)]
    step = 2 * tree + 5
    return first + [p for p in ((4 * tree + step * i) % HASHES for i in range(HASHES)) if p not in first]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, node, signature, md5`` of (doc_id, text) rows; ``node`` is a digest of the set,
    null for the empty set, and ``md5`` one of the text."""

    def make():
        import hashlib

        known, functions = WordHashes(), permutations(HASHES)

        def step(columns):
            rows = []
            for doc_id, text in zip(*columns, strict=True):
                hashes = shingle_hashes(space_words(text), width, known)
                if len(hashes):
                    node = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
                    digest = hashlib.md5(text.encode(), usedforsecurity=False).digest()
                    rows.append((doc_id, len(hashes), node, minhash(hashes, functions).tobytes(), digest))
                else:
                    rows.append((doc_id, 0, None, None, None))
            return rows

        return step

    return per_text(docs, make, "doc_id bigint, n bigint, node binary, signature binary, md5 binary")


def _ordered(tree: int) -> Column:
    """A byte of each value of the signature, in the tree's order."""
    return F.concat(*[F.substring("signature", 4 * p + 1, 1) for p in _order(tree)])


def _keyed(nodes: DataFrame) -> DataFrame:
    """(key, node, path) for each tree: a hash of the prefix, and a byte of each value in order."""
    trees = F.array(*[
        F.struct(
            F.xxhash64(F.lit(t), F.lit(DEPTH), F.concat(*[F.substring("signature", 4 * p + 1, 4) for p in _order(t)[:DEPTH]])).alias("key"),
            _ordered(t).alias("path"),
        )
        for t in range(TREES)
    ])
    return nodes.select("node", F.explode(trees).alias("tree")).select("tree.key", "node", "tree.path")


def _agreement(threshold: float) -> int:
    """Equal places that a pair at the threshold has but for five deviations."""
    return math.floor(HASHES * threshold - 5 * math.sqrt(HASHES * threshold * (1 - threshold)))


def _grown(label: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each place the first place of its component. Places with one label are together from
    the start; ``linked(i, left)`` gives those of ``left`` that have a link to place ``i``, and is
    asked for every place and all that no component has reached by then."""
    order = np.argsort(label, kind="stable")
    begin = np.searchsorted(label[order], label, "left")
    end = np.searchsorted(label[order], label, "right")
    first, open_ = np.empty(len(label), np.int64), np.ones(len(label), bool)
    left = np.arange(len(label))
    while len(left):
        root, found = left[0], left[:1]
        front: list[int] = []
        while True:
            for i in np.unique(begin[found]):
                together = order[i:end[order[i]]]
                open_[together], first[together] = False, root
                front += together.tolist()
            if len(found):
                left = left[open_[left]]
            if not front or not len(left):
                break
            found = linked(front.pop(), left)
    return first


def _alike(shorts: list[np.ndarray], least: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Links by agreement of signatures: in one block, or from one block to another."""
    short, side = np.concatenate(shorts), np.repeat(np.arange(len(shorts)), [len(s) for s in shorts])

    def linked(i: int, left: np.ndarray) -> np.ndarray:
        if len(shorts) > 1:
            left = left[side[left] != side[i]]
        return left[(short[left] == short[i]).sum(axis=1) >= least]

    return linked


def _by_blocks(
    rows: DataFrame, payload: Callable[[pa.Table], object], linker: Callable[[list], Callable]
) -> DataFrame:
    """(a, b) star edges of the pieces of each part, from (part, block, blocks, low, high, piece,
    node, ...) rows; nodes with one ``piece`` are together already.

    A block is packed with its own pieces; each pair of blocks is one group of two packs, and
    passes on an edge for every piece that grows there, so edges do not grow with the pairs. Blocks
    from ``low`` up to ``high`` hold parts of one piece with the row's and do not meet it.
    """

    def solve(table: pa.Table) -> pa.Table:
        nodes, own = table.column("node").to_pylist(), payload(table)
        codes: dict[bytes, int] = {}
        label = np.array([codes.setdefault(p, i) for i, p in enumerate(table.column("piece").to_pylist())])
        first = _grown(label, linker([own]))
        data = pickle.dumps((nodes, first, own), protocol=5)
        keys = {c: table.column(c)[:1].combine_chunks() for c in ("part", "block", "blocks", "low", "high")}
        return pa.table({**keys, "size": pa.array([len(data)]), "data": pa.array([pa.compress(data, "zstd", asbytes=True)])})

    def opened(size: int, data: bytes) -> tuple:
        return pickle.loads(pa.decompress(data, size, "zstd", asbytes=True))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes, first, _ = opened(size, data)
                yield _edge_batch(_star(nodes, first))

    def across(table: pa.Table) -> pa.Table:
        packs = [opened(s, d) for s, d in zip(table.column("size").to_pylist(), table.column("data").to_pylist(), strict=True)]
        if len(packs) < 2:  # no node fell into the other block
            return pa.Table.from_batches([_edge_batch([])])
        (nodes, label, one), (more, other, two) = packs
        nodes, label = nodes + more, np.concatenate([label, other + len(nodes)])
        first = _grown(label, linker([one, two]))
        return pa.Table.from_batches([_edge_batch([(nodes[first[i]], nodes[i]) for i in np.unique(label) if first[i] != i])])

    bounded_batches(rows.sparkSession)
    kind = rows.schema["part"].dataType.simpleString()
    packs = staged(rows.groupBy("part", "block", "blocks").applyInArrow(
        solve, f"part {kind}, block bigint, blocks bigint, low bigint, high bigint, size bigint, data binary"
    ), "packs")
    blocks = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    others = F.filter(blocks, lambda j: (j != F.col("block")) & ((j < F.col("low")) | (j >= F.col("high"))))
    pairs = packs.withColumn("other", F.explode(others)).select(
        "part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "size", "data"
    )
    edges = "a binary, b binary"
    return packs.select("size", "data").mapInArrow(inside, edges).unionByName(
        pairs.groupBy("part", "low", "high").applyInArrow(across, edges)
    )


def _star(nodes: list[bytes], first: np.ndarray) -> list[tuple[bytes, bytes]]:
    """An edge from the least node of each piece to each other one, so that trees which find
    the same piece pass on the same edges."""
    least: dict[int, bytes] = {}
    pieces = first.tolist()
    for f, node in zip(pieces, nodes, strict=True):
        if f not in least or node < least[f]:
            least[f] = node
    return [(least[f], node) for f, node in zip(pieces, nodes, strict=True) if node != least[f]]


def _together(*labels: np.ndarray) -> np.ndarray:
    """Pieces of places that are together in any of the labellings (by first places)."""
    root = list(range(len(labels[0])))

    def of(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for label in labels:
        for i, f in enumerate(label.tolist()):
            root[of(i)] = of(f)
    return np.array([of(i) for i in range(len(root))], np.int64)


def _nearby(paths: np.ndarray, least: int) -> np.ndarray:
    """Pieces of sorted paths (by their first places) that neighbours alone join."""
    joined = (paths[1:] == paths[:-1]).sum(axis=1) >= least
    return np.maximum.accumulate(np.where(np.r_[False, joined], 0, np.arange(len(paths))))


def _searched(paths: np.ndarray, least: int) -> np.ndarray:
    """For each of the sorted paths of a region the first place of its piece."""
    return _grown(_nearby(paths, least), _alike([paths], least))


def _deeper(paths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of the regions into which sorted paths fall: each at the least depth at
    which it has no more than ``REGION`` nodes, or at the last."""
    same = paths[1:] == paths[:-1]
    common = np.where(same.all(axis=1), HASHES, np.argmin(same, axis=1))  # of each and the next
    todo = [(0, len(paths), DEPTH)]
    while todo:
        begin, end, depth = todo.pop()
        if end - begin <= REGION or depth >= HASHES:
            yield begin, end
            continue
        cuts = begin + 1 + np.flatnonzero(common[begin:end - 1] <= depth)
        edges = [begin, *cuts.tolist(), end]
        todo += [(a, b, depth + 1) for a, b in zip(edges, edges[1:], strict=False)]


def _stars(regions: DataFrame, least: int, deep: bool = False) -> DataFrame:
    """(a, b) star edges of the pieces of each region, from rows sorted by key and path.

    With ``deep`` the regions are large: they come in runs of up to 16 ``REGION`` nodes, neighbours in
    the order, and each run is searched in its deeper regions and between neighbours.
    """
    bounded_batches(regions.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, read = None, [], []

        def done():
            if len(nodes) < 2:
                return []
            paths = np.frombuffer(b"".join(read), np.uint8).reshape(len(nodes), HASHES)
            if not deep:
                return _star(nodes, _searched(paths, least))
            inside = np.arange(len(nodes))
            for begin, end in _deeper(paths):
                if end - begin <= REGION:
                    inside[begin:end] = begin + _searched(paths[begin:end], least)
            return _star(nodes, _together(_nearby(paths, least), inside))

        for batch in batches:
            edges = []
            for k, node, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key or (deep and len(nodes) >= 16 * REGION):
                    edges += done()
                    key, nodes, read = k, [], []
                nodes.append(node)
                read.append(path)
            yield _edge_batch(edges)
        yield _edge_batch(done())

    return regions.mapInArrow(run, "a binary, b binary")


def _edge_batch(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _clusters(nodes: DataFrame, threshold: float) -> DataFrame:
    least = _agreement(threshold)
    rows = _keyed(nodes)
    counts = rows.groupBy("key").agg(F.count("*").alias("in_region"))
    found = rows.join(counts.where(f"in_region between 2 and {REGION}"), "key").select("key", "node", "path")
    every = staged(_stars(found.sortWithinPartitions("key", "path"), least).distinct(), "stars")
    keys = staged(counts.where(F.col("in_region") > REGION).select("key"), "hot")
    if not keys.isEmpty():
        every = every.unionByName(_hot_stars(nodes, rows.join(keys, "key").select("key", "node", "path"), least))
    return connected_components(every)


def _hot_stars(nodes: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """(a, b) edges that join all pieces of regions of more than ``REGION`` nodes."""
    hot = staged(rows, "hot")
    spread = hot.repartitionByRange(partitions(hot.sparkSession), "key", "path")
    deep = staged(_stars(spread.sortWithinPartitions("key", "path"), least, deep=True).distinct(), "deep")
    # hot regions of different trees hold much the same nodes: one search for all of them
    first = hot.groupBy("key").agg(F.min("node").alias("a"))
    group = staged(
        connected_components(hot.join(first, "key").select("a", F.col("node").alias("b")))
        .withColumnRenamed("component", "part"), "groups",
    )
    joined = connected_components(deep).withColumnRenamed("component", "piece")
    placed = staged(group.join(joined, "node", "left").select(
        "node", "part", F.coalesce("piece", "node").alias("piece")
    ), "pieces")
    blocks = _blocks_of(placed).join(nodes.select("node", _ordered(0).alias("path")), "node")

    def payload(table: pa.Table) -> np.ndarray:
        paths = b"".join(table.column("path").to_pylist())
        return np.frombuffer(paths, np.uint8).reshape(table.num_rows, HASHES)

    up = staged(_by_blocks(blocks, payload, lambda paths: _alike(paths, least)), "stars")
    return deep.unionByName(up)


def _blocks_of(placed: DataFrame) -> DataFrame:
    """(part, piece, node, block, blocks, low, high) for (part, piece, node) rows.

    A piece with more nodes than a block has blocks of its own, from ``low`` up to ``high``; the
    others of a part are dealt to the first blocks, each in one of them.
    """
    pieces = placed.groupBy("part", "piece").agg(F.count("*").alias("n"))
    total = pieces.groupBy("part").agg(F.sum("n").alias("in_part")).withColumn("size", F.greatest(
        F.lit(REGION), F.least(F.ceil(F.col("in_part") / BLOCKS), F.ceil(F.sqrt(F.col("in_part") * REGION))),
    ).cast("bigint"))
    sized = pieces.join(total.select("part", "size"), "part")
    small = sized.where("n <= size").groupBy("part").agg(
        F.ceil(F.sum("n") / F.first("size")).cast("bigint").alias("shared")
    )
    # the large pieces of a part are no more than its blocks
    before = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    own = sized.where("n > size").withColumn("own", F.ceil(F.col("n") / F.col("size")).cast("bigint"))
    large = own.select(
        "part", "piece", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("bigint").alias("before"),
    )
    counts = total.select("part").join(small, "part", "left").join(
        own.groupBy("part").agg(F.sum("own").alias("in_large")), "part", "left"
    ).select("part", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("in_large", F.lit(0)).alias("in_large"))
    numbered = staged(large.join(counts, "part"), "large").select(
        "part", "piece", (F.col("shared") + F.col("before")).alias("low"),
        (F.col("shared") + F.col("before") + F.col("own")).alias("high"),
    )
    marked = placed.join(counts, "part").join(numbered, ["part", "piece"], "left")
    block = F.when(
        F.col("low").isNotNull(), F.col("low") + F.pmod(F.xxhash64("node"), F.col("high") - F.col("low"))
    ).otherwise(F.pmod(F.xxhash64("piece"), F.col("shared")))
    return marked.select(
        "part", "piece", "node", block.alias("block"), (F.col("shared") + F.col("in_large")).alias("blocks"),
        F.coalesce("low", F.lit(-1).cast("bigint")).alias("low"), F.coalesce("high", F.lit(-1).cast("bigint")).alias("high"),
    )


def _packed_sets(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of the ``text`` column: their sizes, all distinct shingles, and for each set the
    ascending places of its own among these, as differences (near copies then compress well)."""
    known = WordHashes()
    sets = [shingle_hashes(space_words(t.as_py()), width, known) for t in table.column("text")]
    distinct, places = np.unique(np.concatenate(sets), return_inverse=True)
    return np.array([len(s) for s in sets]), distinct, np.diff(places, prepend=0).astype(np.int32)


def _overlapping(
    packs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], num: int, den: int
) -> Callable[[int, np.ndarray], np.ndarray]:
    """Links ``den * |a & b| >= num * |a | b|`` in one block, or from one block to another."""
    sizes = np.concatenate([p[0] for p in packs])
    side = np.repeat(np.arange(len(packs)), [len(p[0]) for p in packs])
    distinct, at = np.unique(np.concatenate([p[1] for p in packs]), return_inverse=True)
    offsets = np.cumsum([0] + [len(p[1]) for p in packs])
    ids = np.concatenate([at[o + np.cumsum(p[2], dtype=np.int64)] for o, p in zip(offsets, packs, strict=False)])
    ends = np.cumsum(sizes)
    owner, starts, lengths, indexed = None, None, None, 0

    def linked(i: int, left: np.ndarray) -> np.ndarray:
        nonlocal owner, starts, lengths, indexed
        if owner is None or 2 * len(left) < indexed:  # who holds a shingle, of those still left
            within = np.zeros(len(sizes), bool)
            within[left] = True
            keep = np.repeat(within, sizes)
            held, owner = ids[keep], np.repeat(np.arange(len(sizes)), sizes)[keep]
            owner = owner[np.argsort(held, kind="stable")]
            lengths = np.bincount(held, minlength=len(distinct))
            starts, indexed = np.cumsum(lengths) - lengths, len(left)
        mine = ids[ends[i] - sizes[i]:ends[i]]
        n = lengths[mine]
        spread = np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if len(packs) > 1:
            left = left[side[left] != side[i]]
        common = np.bincount(owner[spread], minlength=len(sizes))[left]
        return left[den * common >= num * (sizes[i] + sizes[left] - common)]

    return linked


def _confirmed(groups: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b) star edges of confirmed links, from (part, node, text) rows, one part at a time."""

    def solve(rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").to_pylist()
        first = _grown(np.arange(len(nodes)), _overlapping([_packed_sets(rows, width)], num, den))
        return pa.Table.from_batches([_edge_batch([(nodes[f], n) for f, n in zip(first, nodes, strict=True)])])

    return groups.groupBy("part").applyInArrow(solve, "a binary, b binary")


def near_components(
    df: DataFrame, width: int = 5, num: int = 80, den: int = 100,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: documents are linked where
    ``den * |a & b| >= num * |a | b|`` on their sets of ``width``-word shingles, and a component
    is named by its least document; ``kept`` marks that document.

    A text with fewer words is one shingle; an empty or null text has none and is alone. Rows
    with equal sets are linked (repeated rows too, and all rows with the least id are kept); a null
    id is above all others and never kept unless its component has no other. No rows give no
    rows; other columns are not read.
    """
    docs = documents(df, id_col, text_col)
    rows = staged(signatures(docs, width), "signatures")
    nodes = staged(
        rows.where("node is not null").groupBy("node").agg(
            F.first("signature").alias("signature"), F.min("doc_id").alias("doc_id"),
            F.first("n").alias("n"), F.min(F.struct("doc_id", "md5")).alias("source"),
        ), "nodes",
    )
    clusters = staged(_clusters(nodes, num / den), "clusters").withColumnRenamed("component", "part")
    members = clusters.join(nodes.select("node", "source", "n"), "node")
    # one text of each node: ids may repeat or be null, so a row is told by its text as well
    source = F.struct("doc_id", F.unhex(F.md5("text")).alias("md5"))
    texts = docs.select("text", source.alias("source")).join(members, "source")
    texts = texts.groupBy("part", "node").agg(F.first("text").alias("text"))
    sums = members.groupBy("part").agg(F.sum("n").alias("n"))
    blocks = F.ceil(4 * F.col("n") / CLUSTER_SHINGLES).alias("blocks")
    large = staged(sums.where(F.col("n") > CLUSTER_SHINGLES).select("part", blocks), "large")
    if large.isEmpty():
        links = _confirmed(texts, width, num, den)
    else:
        none = F.lit(-1).cast("bigint")
        split = texts.join(large, "part").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        links = _confirmed(texts.join(large, "part", "left_anti"), width, num, den).unionByName(
            _by_blocks(
                split.select(
                    "part", "block", "blocks", none.alias("low"), none.alias("high"), F.col("node").alias("piece"),
                    "node", "text",
                ),
                lambda table: _packed_sets(table, width), lambda packs: _overlapping(packs, num, den),
            )
        )
    links = staged(links.where("a <> b"), "links")
    named = connected_components(links).join(nodes.select("node", "doc_id"), "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    of_node = named.join(least, "component").select("node", "least")
    alone = nodes.select("node", F.col("doc_id").alias("own"))
    every = alone.join(of_node, "node", "left").select(
        "node", F.coalesce("least", "own").alias("component_id")
    )
    # copies of one text may be a third of all rows
    numbered = rows.select("doc_id", "n", "node", F.coalesce("doc_id", F.lit(0)).alias("row"))
    joined = spread_join(numbered, every, ["node"], "left", row="row")
    component = F.coalesce("component_id", "doc_id")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(df: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``df`` whose ``doc_id`` is kept by ``near_components``: of each component the
    least document, and with it rows that repeat its id."""
    kept = near_components(df, width, num, den).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return df.join(kept, df["doc_id"].eqNullSafe(kept["__id"]), "left_semi")
