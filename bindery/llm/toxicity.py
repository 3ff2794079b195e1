"""Toxic passages as maximum-scoring segments.

1. Log-odds. Every word has a chain of prefixes (3 to 6 letters, then the whole word). Each
   node's share of toxic documents is estimated with a Dirichlet prior centred on its
   parent's share, and the root is the base rate; so rare and unseen words take what their
   stem has shown. A word's score is its log-odds above the base rate, less a constant cost.
2. Segments. A linear-time scan (Ruzzo and Tompa) finds all maximal scoring segments of a text.
3. Extreme values. Segment scores of clean text follow exp(-K n exp(-lambda S)); lambda solves
   E[exp(lambda x)] = 1 over the words of clean documents and K is its maximum-likelihood
   value there. The evidence of a document is the sum of lambda S - log(K n) over segments
   that exceed chance; a logistic curve turns it into a probability.

Steps 3's numbers come from labelled documents scored with word counts that leave their own
fold out, so no document helps to score itself.

What is learnt is small: it comes from a sample of at most about ``MAX_LABELLED`` labelled
documents and is kept for nodes seen in ``MIN_TOXIC`` toxic documents of it, or below a node
that is. Scoring reads whole texts of all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.shared import bounded_batches, documents, per_text, plain
from bindery.staging import staged

#: Labelled documents the classifier is fitted on, at most (about: the sample is by hash).
MAX_LABELLED = 40_000
MIN_TOXIC = 3
FOLDS = 4
PREFIXES = (3, 4, 5, 6)
PRIOR = 8.0
COST = 1.0

_LETTERS = "[^\\p{L}]+"


@dataclass
class ToxicityModel:
    """Counts by node and what calibrates them; plain data that travels to the executors."""

    #: node -> documents in which it stands: toxic by fold, all by fold
    nodes: dict[str, tuple[list[int], list[int]]] = field(default_factory=dict)
    toxic: list[int] = field(default_factory=lambda: [0] * FOLDS)
    total: list[int] = field(default_factory=lambda: [0] * FOLDS)
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    intercept: float = 0.0
    slope: float = 0.0

    def base(self, without: int | None = None) -> float:
        t = sum(n for f, n in enumerate(self.toxic) if f != without)
        a = sum(n for f, n in enumerate(self.total) if f != without)
        return (t + 0.5) / (a + 1.0)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-(self.intercept + self.slope * math.log1p(evidence))))


class WordScores:
    """Scores of words under a model, optionally without one fold's counts."""

    def __init__(self, model: ToxicityModel, without: int | None = None, kept: int = 150_000):
        self.model, self.without, self.kept = model, without, kept
        self.base = model.base(without)
        self.known: dict[str, float] = {}

    def _share(self, node: str, before: float) -> float:
        counts = self.model.nodes.get(node)
        if counts is None:
            return before
        toxic = sum(n for f, n in enumerate(counts[0]) if f != self.without)
        total = sum(n for f, n in enumerate(counts[1]) if f != self.without)
        return (toxic + PRIOR * before) / (total + PRIOR)

    def of(self, chunk: str) -> float:
        """Log-odds less cost of the letters of a white-space word; words without letters cost."""
        found = self.known.get(chunk)
        if found is None:
            word = "".join(c for c in chunk.lower() if c.isalpha())
            share = self.base
            for n in PREFIXES:
                if len(word) >= n:
                    share = self._share(word[:n], share)
            share = self._share(word + "$", share) if word else share
            odds = math.log(share / (1 - share)) - math.log(self.base / (1 - self.base))
            if len(self.known) > self.kept:  # only a memory of earlier answers
                self.known.clear()
            found = self.known[chunk] = odds - COST
        return found


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in linear time.

    ``before[k]`` is the nearest earlier candidate that begins at a lower running total;
    candidates between the two cannot matter to a later one that passes over ``k``.
    """
    begin, end, low, high, before = [], [], [], [], []
    total = 0.0
    for i, x in enumerate(scores):
        total += x
        if x <= 0:
            continue
        start, floor = i, total - x
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= floor:
                j = before[j]
            if j < 0 or high[j] >= total:
                break
            start, floor = begin[j], low[j]
            for kept in (begin, end, low, high, before):
                del kept[j:]
        for kept, value in ((begin, start), (end, i + 1), (low, floor), (high, total), (before, j)):
            kept.append(value)
    return [(b, e, h - v) for b, e, v, h in zip(begin, end, low, high, strict=True)]


def evidence_of(segments, n_words: int, model: ToxicityModel) -> list[tuple[int, int, float]]:
    """Segments above chance with the logarithm of how far: lambda S - log(K n)."""
    chance = math.log(max(model.scale * n_words, 1e-9)) if n_words else 0.0
    found = ((b, e, model.rate * s - max(chance, 0.0)) for b, e, s in segments)
    return [(b, e, v) for b, e, v in found if v > 0]


def _rate(histogram: list[tuple[float, int]]) -> float:
    """lambda > 0 with mean(exp(lambda x)) = 1, between 0.05 and 3."""
    n = sum(c for _, c in histogram)
    if not n or not any(x > 0 for x, _ in histogram):
        return 3.0
    low, high = 0.05, 3.0
    for _ in range(60):
        mid = (low + high) / 2
        if sum(c * math.exp(mid * x) for x, c in histogram) / n > 1:
            high = mid
        else:
            low = mid
    return low


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope over (x, toxic, all), slope shrunk a little, by Newton steps."""
    a, b = 0.0, 0.0
    for _ in range(50):
        ga = gb = haa = hab = hbb = 0.0
        for x, y, n in [*rows, (0.0, 0.5, 1)]:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            r, w = y - n * p, n * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + r, gb + r * x, haa + w, hab + w * x, hbb + w * x * x
        gb, hbb, haa = gb - 0.1 * b, hbb + 0.1, haa + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da) / 2, abs(db) / 2)
        a, b = a + da / size, b + db / size
    return a, max(b, 0.0)


def fit(labelled: DataFrame) -> ToxicityModel:
    """A model from (doc_id, text, toxic) rows; rows without a label or id are not used.

    Without any row, or with one class only, every document gets the base rate.
    """
    rows = plain(labelled, {"doc_id": "doc_id", "text": "text", "toxic": "toxic"}).where(
        F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
    )
    n = rows.count()
    if n > MAX_LABELLED:
        rows = rows.where(
            F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < 1_000_000 * MAX_LABELLED // n
        )
    folded = rows.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"),
        (F.col("toxic") > 0).cast("int").alias("toxic"),
    )
    sample = staged(folded, "labelled")
    model = ToxicityModel()
    for r in sample.groupBy("fold").agg(F.sum("toxic").alias("t"), F.count("*").alias("a")).collect():
        model.toxic[r["fold"]], model.total[r["fold"]] = r["t"], r["a"]
    if 0 < sum(model.toxic) < sum(model.total):
        model.nodes = _nodes(sample, sum(model.toxic) / sum(model.total))
    _calibrate(sample, model)
    return model


def _nodes(sample: DataFrame, base: float) -> dict[str, tuple[list[int], list[int]]]:
    """Document counts of the nodes worth keeping; their number is bounded by the sample's."""
    words = sample.select(
        "fold", "toxic",
        F.explode(F.array_distinct(F.transform(
            F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, _LETTERS, "")
        ))).alias("word"),
    ).where("word <> ''")
    folds = range(FOLDS)
    counted = words.groupBy("word").agg(
        *[F.sum(F.when(F.col("fold") == f, F.col("toxic")).otherwise(0)).alias(f"t{f}") for f in folds],
        *[F.sum(F.when(F.col("fold") == f, 1).otherwise(0)).alias(f"a{f}") for f in folds],
    )
    sums = [f"{k}{f}" for k in "ta" for f in folds]
    levels = F.array(
        *[F.when(F.length("word") >= n, F.left("word", F.lit(n))) for n in PREFIXES],
        F.concat("word", F.lit("$")),
    )
    nodes = staged(
        counted.select(F.explode(F.array_compact(levels)).alias("node"), *sums)
        .groupBy("node").agg(*[F.sum(c).alias(c) for c in sums])
        .select(
            "*", sum((F.col(f"t{f}") for f in folds), F.lit(0)).alias("t"),
            sum((F.col(f"a{f}") for f in folds), F.lit(0)).alias("a"),
        ), "nodes",
    )
    often = nodes.where((F.col("t") >= MIN_TOXIC) & (F.col("t") > 1.2 * base * F.col("a")))
    stems = often.where("node not like '%$'").select("node")
    below = nodes.where((F.col("a") >= MIN_TOXIC) & (F.length("node") > PREFIXES[0]))
    kept = often.select("node", *sums)
    for n in PREFIXES:  # what is known about words below a suspicious stem
        under = below.where(F.length("node") > n).withColumn("stem", F.left("node", F.lit(n)))
        kept = kept.unionByName(
            under.join(stems.withColumnRenamed("node", "stem"), "stem", "left_semi").select("node", *sums)
        )
    return {
        r["node"]: ([r[f"t{f}"] for f in folds], [r[f"a{f}"] for f in folds])
        for r in kept.distinct().collect()
    }


def _calibrate(sample: DataFrame, model: ToxicityModel) -> None:
    def make():
        scores = [WordScores(model, f, kept=40_000) for f in range(FOLDS)]

        def step(columns):
            rows = []
            for doc_id, text, fold, toxic in zip(*columns, strict=True):
                x = [scores[fold].of(w) for w in text.split()]
                best = [s for _, _, s in maximal_segments(x)]
                bins: dict[int, int] = {}
                for v in x if not toxic else ():
                    bins[round(4 * v)] = bins.get(round(4 * v), 0) + 1
                rows.append((doc_id, toxic, len(x), best, list(bins), list(bins.values())))
            return rows

        return step

    scored = staged(per_text(
        sample.select("doc_id", "text", "fold", "toxic"), make,
        "doc_id bigint, toxic int, n_words int, best array<double>, bin array<int>, n array<int>",
    ), "calibration")
    clean = scored.where("toxic = 0")
    bins = clean.select(F.explode(F.arrays_zip("bin", "n")).alias("b")).groupBy("b.bin").agg(
        F.sum("b.n").alias("n")
    )
    model.rate = _rate([(r["bin"] / 4, r["n"]) for r in bins.collect()])
    top = F.coalesce(F.array_max("best"), F.lit(0.0))
    k = clean.where("n_words > 0").agg(
        F.count("*").alias("n"), F.sum(F.col("n_words") * F.exp(-model.rate * top)).alias("s")
    ).head()
    model.scale = k["n"] / k["s"] if k["s"] else 1.0
    chance = F.greatest(F.log(F.greatest(F.col("n_words") * model.scale, F.lit(1e-9))), F.lit(0.0))
    evidence = F.aggregate(
        F.transform("best", lambda s: F.greatest(s * model.rate - chance, F.lit(0.0))),
        F.lit(0.0), lambda a, v: a + v,
    )
    # log1p(evidence) to two decimals: the rows collected are as many as there are such values
    curve = scored.groupBy(F.round(F.log1p(evidence), 2).alias("x")).agg(
        F.sum("toxic").alias("y"), F.count("*").alias("n")
    ).collect()
    model.intercept, model.slope = _logistic([(r["x"], r["y"], r["n"]) for r in curve])


def score_documents(
    df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, score, passages`` for every row: the probability that a document is toxic, and
    its passages above chance as (first word, end word, evidence).

    Words are counted between white space, ends are exclusive. A null or empty text has no
    passage and the score of no evidence; null ids stay null, repeated rows are repeated, no
    rows give no rows; other columns are not read. Rows are independent: one pass without a
    shuffle, linear in the text.
    """

    def make():
        scores = WordScores(model)

        def step(columns):
            rows = []
            for doc_id, text in zip(*columns, strict=True):
                x = list(map(scores.of, text.split()))
                found = evidence_of(maximal_segments(x), len(x), model)
                passages = [{"start": b, "end": e, "evidence": v} for b, e, v in found]
                rows.append((doc_id, model.probability(sum(v for _, _, v in found)), passages))
            return rows

        return step

    return per_text(
        documents(df, id_col, text_col), make,
        "doc_id bigint, score double, passages array<struct<start: int, end: int, evidence: double>>",
    )


#: A document that scores as much is toxic, for ``op1`` and for the pipeline.
TOXIC_FROM = 0.3


def drop_toxic(df: DataFrame, model: ToxicityModel, at: float = TOXIC_FROM) -> DataFrame:
    """The rows of ``df`` whose ``text`` scores below ``at`` or has no toxic passage at all, with all
    their columns; a null text stays. Cases as in ``score_documents``."""
    bounded_batches(df.sparkSession)

    def run(batches):
        scores = WordScores(model)

        def kept(text: str | None) -> bool:
            x = list(map(scores.of, (text or "").split()))
            found = evidence_of(maximal_segments(x), len(x), model)
            return not found or model.probability(sum(v for _, _, v in found)) < at

        for batch in batches:
            yield batch.filter(pa.array(map(kept, batch.column("text").to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
