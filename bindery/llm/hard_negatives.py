"""Hard negatives by segment summary filtering.

Vectors are cut into segments, and each segment's mean and deviation (the root of the summed squares
around the mean) are stored. Over one segment the inner product of two vectors is the
length times the product of the means, plus or minus at most the product of the deviations, so a
few numbers bound a score. Bounds start with one segment for the whole vector; what they cannot
decide is bounded again with segments a quarter as long, down to two components, and only what
is left then is scored exactly.

Anchors are a stated set of queries that meet all rows, block against block. Each pair of blocks
keeps its own best rows, and the best of these are chosen per anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.shared import bounded_batches, partitions, plain
from bindery.staging import staged

#: Most anchors, and most rows, in one block.
BLOCK = 32_768
#: Blocks of rows for a table of 1,024 rows each or more, so that small tables spread as well.
LEAST_BLOCKS = 48
#: Anchors bounded at once inside a task.
CHUNK = 64


def segment_lengths(width: int) -> list[int]:
    """Lengths of the segments by level: the whole vector, then quarters, two at last."""
    lengths = []
    while width > 2:
        lengths.append(width)
        width //= 4
    return [*lengths, 2]


def summarise(vectors: np.ndarray) -> np.ndarray:
    """Means and deviations of every segment of every level, side by side."""
    parts = []
    for length in segment_lengths(vectors.shape[1]):
        cut = vectors.reshape(len(vectors), -1, length).astype(np.float64)
        mean = cut.mean(axis=2)
        parts += [mean, np.sqrt(((cut - mean[:, :, None]) ** 2).sum(axis=2))]
    return np.concatenate(parts, axis=1).astype(np.float32)


class Side:
    """The anchors or the rows of one block."""

    def __init__(self, table: pa.Table, width: int):
        n = table.num_rows
        self.ids, self.marks, self.labels = (
            table.column(c).to_numpy() for c in ("vec_id", "mark", "label")
        )
        self.vectors = _matrix(table, "ints", n, width)
        summary = _matrix(table, "summary", n, -1).astype(np.float64)
        self.levels, at = [], 0
        for length in segment_lengths(width):
            k = width // length
            self.levels.append((length, summary[:, at:at + k], summary[:, at + k:at + 2 * k]))
            at += 2 * k
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))


def _matrix(table: pa.Table, name: str, n: int, width: int) -> np.ndarray:
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, width if width > 0 else len(flat) // max(1, n))


class Pairs:
    """Bounds and scores between a chunk of anchors and the rows of a block."""

    def __init__(self, anchors: Side, rows: Side, chunk: slice):
        self.a, self.r, self.chunk = anchors, rows, chunk
        widest = rows.norms.max() if len(rows.norms) else 0.0
        #: Room for the rounding of stored summaries.
        self.slack = (1e-6 * anchors.norms[chunk] * widest + 1e-3)[:, None]

    def bounds(self, level: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length, means, devs = self.a.levels[level]
        _, row_means, row_devs = self.r.levels[level]
        middle = length * (means[self.chunk] @ row_means[columns].T)
        spread = devs[self.chunk] @ row_devs[columns].T + self.slack
        return middle - spread, middle + spread

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), 1 << 16):
            piece = slice(at, at + (1 << 16))
            out[piece] = (self.a.vectors[self.chunk][i[piece]] * self.r.vectors[j[piece]]).sum(axis=1)
        return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each line, or minus infinity."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _first(k: int, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the k best entries of each anchor: by score, then by smaller id."""
    order = np.lexsort((ids, -score, anchor))
    ordered = anchor[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.empty(0, bool)
    starts = np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))
    return order[np.arange(len(ordered)) - starts < k]


def _nearest(pairs: Pairs, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the k best rows of each anchor's own label."""
    a, r, chunk = pairs.a, pairs.r, pairs.chunk
    same = a.labels[chunk][:, None] == r.labels[None, :]
    same &= (a.ids[chunk][:, None] != r.ids[None, :]) | (a.marks[chunk][:, None] != r.marks[None, :])
    columns = np.flatnonzero(same.any(axis=0))
    alive, least = same[:, columns], np.full(len(same), -np.inf)
    for level in range(len(a.levels)):
        low, high = pairs.bounds(level, columns)
        least = np.maximum(least, _kth(np.where(alive, low, -np.inf), k))
        alive &= high >= least[:, None]
        kept = alive.any(axis=0)
        columns, alive = columns[kept], alive[:, kept]
    i, j = np.nonzero(alive)
    score = pairs.exact(i, columns[j])
    best = _first(k, i, score, r.ids[columns[j]])
    return i[best], columns[j][best], score[best]


def _inside(
    pairs: Pairs, k: int, lows: np.ndarray, highs: np.ndarray
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each window (a column of ``lows`` and ``highs``): (anchor, row, score) of the k best
    rows of other labels whose scores lie in it."""
    a, r, chunk = pairs.a, pairs.r, pairs.chunk
    other = a.labels[chunk][:, None] != r.labels[None, :]
    columns = np.flatnonzero(other.any(axis=0))
    alive = [other[:, columns].copy() for _ in range(lows.shape[1])]
    floors = [lows[:, w].astype(np.float64) for w in range(lows.shape[1])]
    for level in range(len(a.levels)):
        low, high = pairs.bounds(level, columns)
        for w, mask in enumerate(alive):
            sure = mask & (low >= lows[:, w:w + 1]) & (high <= highs[:, w:w + 1])
            floors[w] = np.maximum(floors[w], _kth(np.where(sure, low, -np.inf), k))
            mask &= (high >= floors[w][:, None]) & (low <= highs[:, w:w + 1])
        kept = np.any([mask.any(axis=0) for mask in alive], axis=0)
        columns, alive = columns[kept], [mask[:, kept] for mask in alive]
    i, j = np.nonzero(np.any(alive, axis=0)) if alive else (np.empty(0, int), np.empty(0, int))
    score = pairs.exact(i, columns[j])
    found = []
    for w in range(lows.shape[1]):
        fits = np.flatnonzero((score >= lows[i, w]) & (score <= highs[i, w]))
        best = fits[_first(k, i[fits], score[fits], r.ids[columns[j[fits]]])]
        found.append((i[best], columns[j[best]], score[best]))
    return found


def _chunks(n: int):
    return [slice(at, min(n, at + CHUNK)) for at in range(0, n, CHUNK)]


def _output(parts: list[dict[str, np.ndarray]], names: list[str]) -> pa.Table:
    return pa.table({
        n: pa.array(np.concatenate([p[n] for p in parts]) if parts else np.empty(0, np.int64), pa.int64())
        for n in names
    })


def _prepared(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, label, ints) of the rows that take part, each once."""
    rows = plain(df, {"vec_id": id_col, "label": label_col, "vector": vector_col})
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.transform("vector", lambda x: F.floor(x.cast("double") * scale)).alias("ints"),
    ).distinct().withColumn("mark", F.xxhash64("label", "ints"))


def _summarised(rows: DataFrame, width: int) -> DataFrame:
    """Vectors filled up with zeros to ``width``, with their summaries."""
    most = int((2**62 / width) ** 0.5)  # inner products of such components fit in 64 bits

    def run(batches):
        for batch in batches:
            vectors = np.zeros((batch.num_rows, width), np.int64)
            column = batch.column("ints")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(column.offsets.to_numpy())
            line = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            vectors[line, place] = np.clip(flat, -most, most)
            summary = summarise(vectors)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"), batch.column("mark"),
                pa.FixedSizeListArray.from_arrays(vectors.ravel(), width).cast(pa.list_(pa.int64())),
                pa.FixedSizeListArray.from_arrays(summary.ravel(), summary.shape[1]).cast(pa.list_(pa.float32())),
            ], names=["vec_id", "label", "mark", "ints", "summary"])

    return rows.select("vec_id", "label", "mark", "ints").mapInArrow(
        run, "vec_id bigint, label bigint, mark bigint, ints array<bigint>, summary array<float>"
    )


def _blocks(n: int) -> int:
    return max(1, -(-n // BLOCK), min(LEAST_BLOCKS, n // 1024))


def _meet(anchors: DataFrame, rows: DataFrame, n_a: int, n_r: int, step, schema: str) -> DataFrame:
    """``step`` over every block of anchors with every block of rows."""
    spread = partitions(rows.sparkSession)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # columns of its own, as both sides come from one table
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])
    left = anchors.withColumn("r", every(n_r)).repartition(spread, "a", "r")
    right = rows.withColumn("a", every(n_a)).repartition(spread, "a", "r")
    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(step, schema)


def _best(df: DataFrame, by: list[str], score: str, other: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(other))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    scale: float = 256.0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)`` and a score is the integer inner product. Anchors are
    the rows whose id is divisible by ``every``; their positives are the first ``positives`` other
    rows of their label, by score and then by smaller id. For each of these come the first
    ``negatives`` rows of other labels with ``low`` to ``high`` percent of the positive's score.
    An anchor without positives, and a positive without such rows, give none.

    Rows with a null id, label, vector or component, or one that is not finite, take no part;
    rows equal in all three columns count once, and rows that share an id only are rows of
    their own. Vectors of unlike length are filled up with zeros, an empty one is all zeros, and
    components are held within what 64-bit scores allow. No rows give none, other columns are
    not read. A task holds one block of anchors and one of rows, whatever the labels' shares.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    clean = staged(_prepared(df, id_col, label_col, vector_col, scale), "vectors")
    is_anchor: Column = F.col("vec_id") % every == 0
    facts = clean.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("ints"))).head()
    width = max(2, 1 << (int(facts[2] or 1) - 1).bit_length())
    n_r, n_a = _blocks(facts[0]), max(1, -(-facts[1] // BLOCK))
    rows = staged(_summarised(clean, width), "summaries")
    rows = rows.withColumn("r", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(n_r)).cast("int"))
    anchors = rows.where(is_anchor).drop("r").withColumn(
        "a", F.pmod(F.xxhash64("mark", "vec_id"), F.lit(n_a)).cast("int")
    )

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            a, r = Side(left, width), Side(right, width)
            for chunk in _chunks(left.num_rows):
                i, j, score = _nearest(Pairs(a, r, chunk), positives)
                parts.append({
                    "anchor_id": a.ids[chunk][i], "mark": a.marks[chunk][i],
                    "positive_id": r.ids[j], "positive_score": score,
                })
        return _output(parts, ["anchor_id", "mark", "positive_id", "positive_score"])

    found = _meet(anchors, rows, n_a, n_r, near, "anchor_id bigint, mark bigint, positive_id bigint, positive_score bigint")
    best = _best(found, ["anchor_id", "mark"], "positive_score", "positive_id", positives)
    listed = staged(
        best.groupBy("anchor_id", "mark").agg(F.array_sort(F.collect_list(
            F.struct("rank", "positive_id", "positive_score")
        )).alias("positives")), "positives",
    ).select(F.col("anchor_id").alias("vec_id"), "mark", "positives")

    def between(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_id", "mark", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
        parts = []
        if left.num_rows and right.num_rows:
            a, r = Side(left, width), Side(right, width)
            own = left.column("positives").to_pylist()
            ids = np.zeros((len(own), positives), np.int64)
            scores = np.zeros((len(own), positives), np.int64)
            absent = np.ones((len(own), positives), bool)
            for n, entries in enumerate(own):
                for w, entry in enumerate(entries):
                    ids[n, w], scores[n, w], absent[n, w] = entry["positive_id"], entry["positive_score"], False
            # low * s <= 100 * x <= high * s, in whole numbers without overflow
            least = low * (scores // 100) + -(-(low * (scores % 100)) // 100)
            most = high * (scores // 100) + (high * (scores % 100)) // 100
            least[absent], most[absent] = 1, 0
            for chunk in _chunks(left.num_rows):
                for w, (i, j, score) in enumerate(
                    _inside(Pairs(a, r, chunk), negatives, least[chunk], most[chunk])
                ):
                    parts.append({
                        "anchor_id": a.ids[chunk][i], "mark": a.marks[chunk][i], "place": np.full(len(i), w),
                        "positive_id": ids[chunk][i, w], "positive_score": scores[chunk][i, w],
                        "negative_id": r.ids[j], "negative_score": score,
                    })
        return _output(parts, names)

    found = _meet(
        anchors.join(listed, ["vec_id", "mark"]), rows, n_a, n_r, between,
        "anchor_id bigint, mark bigint, place bigint, positive_id bigint, positive_score bigint, "
        "negative_id bigint, negative_score bigint",
    )
    best = _best(found, ["anchor_id", "mark", "place"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
