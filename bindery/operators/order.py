"""Repeatable random order, ranks and running sums that do not depend on group size.

A window over one group is one task, so a group with a third of all rows would stall
the job. Here every group is cut into cells along its sort order; ranks and sums run
inside a cell and are lifted by the totals of the cells before it, which are a small
pre-aggregated table.

All seeded draws order rows by ``md5(seed|key)``: the same rows come out whatever the
partitioning, after a task is retried, and in any other engine that has md5.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.staging import staged

MAX_CELLS = 4096
#: Rows of a cell, where groups are cut by their own size.
CELL_ROWS = 10_000


def hash_text(seed: object, *cols: str | Column) -> Column:
    """``md5`` over the seed and the columns, joined by ``|`` (nulls are skipped)."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_int(seed: object, *cols: str | Column) -> Column:
    """A non-negative integer below 2**32 from the leading digits of ``hash_text``."""
    return F.conv(F.substring(hash_text(seed, *cols), 1, 8), 16, 10).cast("bigint")


def distinct_draws(k: Column, pool: Column, seed: object, *key: str | Column) -> Column:
    """``k`` distinct numbers from 0..pool-1 (``k <= pool``) as an array, every set equally likely.

    Floyd's rule: draw t (from 0) is a number up to ``pool - k + t``, and that bound itself if the
    number is there already. The hash of seed, key and t decides, so rows with unlike keys
    draw independently, in exactly ``k`` steps.
    """

    def one(taken: Column, t: Column) -> Column:
        top = pool - k + t
        draw = F.pmod(F.conv(F.substring(hash_text(seed, *key, t), 1, 15), 16, 10).cast("bigint"), top + 1)
        return F.array_append(taken, F.when(F.array_contains(taken, draw), top).otherwise(draw))

    turns = F.when(k > 0, F.sequence(F.lit(0).cast("bigint"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(turns, F.array().cast("array<bigint>"), one)


def hash_digits(df: DataFrame) -> int:
    """Leading hash digits that cut a table into 16 cells or more per shuffle partition."""
    wanted = 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return next(d for d in range(3, 9) if 16**d >= wanted or d == 8)


def group_digits(df: DataFrame, by: Sequence[str]) -> int:
    """Leading hash digits that cut the largest group into cells of about ``CELL_ROWS``; one job over ``by``."""
    most = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return next(d for d in range(9) if 16**d * CELL_ROWS >= most or d == 8)


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    cell: str,
    order: Sequence[Column | str],
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
    no_nulls: bool = False,
) -> DataFrame:
    """Add running sums over ``order`` within ``by``.

    ``cell`` must rise with ``order`` inside a group. ``totals`` maps a name in ``sums``
    to a column that receives the group's grand total. Null is a group of its own. ``no_nulls`` is
    the caller's word that ``by`` and ``cell`` hold none. ``sums`` read no column of ``by``, nor ``cell``.
    """
    totals = totals or {}
    keys = [*by, cell]
    if not no_nulls:
        # one value that is never null, whatever its parts: rows are dealt by it once, for the sums and the join
        spot = F.struct(*keys).alias("_in_cell")
        order = [c for c in order if not (isinstance(c, str) and c in keys)]
        rows = df.select(spot, *[c for c in df.columns if c not in keys])
        cells = _cell_totals(rows, ["_in_cell"], [F.col("_in_cell")[c] for c in by], F.col("_in_cell")[cell], sums, totals)
        joined = _inside(rows, ["_in_cell"], order, sums).join(cells, F.col("_in_cell") == F.col("_key__in_cell"))
        found = {k: F.col("_in_cell")[k].alias(k) for k in keys}
    else:
        cells = _cell_totals(df, keys, [F.col(c) for c in by], F.col(cell), sums, totals)
        same = [F.col(k) == F.col(f"_key_{k}") for k in keys]
        joined = _inside(df, keys, order, sums).join(cells, reduce(lambda a, b: a & b, same))
        found = {}
    return joined.select(
        *[found.get(c, F.col(c)) for c in df.columns],
        *[(F.col(f"_run_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums],
        *totals.values(),
    )


def _cell_totals(
    rows: DataFrame, keys: Sequence[str], group: Sequence[Column], cell: Column, sums: dict[str, Column], totals: dict[str, str]
) -> DataFrame:
    """For each cell (``_key_...``) the sums of the cells before it, and of its whole group."""
    group = list(group) or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_own_{n}") for n, c in sums.items()])
    return cells.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_own_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.sum(f"_own_{n}").over(Window.partitionBy(*group)).alias(out) for n, out in totals.items()],
    )


def _inside(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Rows with their running sums inside of their cell."""
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[F.sum(c).over(inside).alias(f"_run_{n}") for n, c in sums.items()])


def hashed_rank(
    df: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    seed: object,
    rank: str = "rank",
    size: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Rank rows 1..n in seeded random order within ``by``; ``size`` adds n.

    ``key`` should identify a row; rows with equal keys are interchangeable. A group is
    cut into ``16**digits`` cells, as many as ``hash_digits`` says unless given.
    """
    hashed = df.withColumn("_digest", hash_text(seed, *key))
    return ranked_by_hash(hashed, by, "_digest", key, rank, size, digits).select(*df.columns, rank, *([size] if size else []))


def ranked_by_hash(
    df: DataFrame, by: Sequence[str], digest: str, key: Sequence[str], rank: str, size: str | None, digits: int | None
) -> DataFrame:
    """``hashed_rank`` of rows that have their hash text in ``digest``, which is dropped."""
    digits = hash_digits(df) if digits is None else digits
    # the hash travels as 16 bytes, which sort as its 32 digits do
    hashed = df.withColumns({"_cell": F.substring(digest, 1, digits), "_hash": F.unhex(digest)}).drop(digest)
    ranked = running_totals(
        hashed, by, "_cell", ["_hash", *key], {rank: F.lit(1)}, {rank: size} if size else None,
        no_nulls=not by,
    )
    return ranked.drop("_hash", "_cell")


def take_hashed(
    df: DataFrame, n: int, key: Sequence[str], seed: object, digits: int | None = None
) -> DataFrame:
    """The first ``n`` rows in seeded random order, exactly, without a global sort.

    Cells are counted first, in at most ``16**digits`` rows; a broadcast is asked for up to
    ``MAX_CELLS`` of them. A cell that lies wholly inside the limit passes untouched and only
    the one cell that the limit cuts is sorted.
    """
    digits = digits or hash_digits(df)
    hashed = df.withColumn("_hash", hash_text(seed, *key))
    hashed = hashed.withColumn("_cell", F.substring("_hash", 1, digits))
    upto = Window.partitionBy(F.lit(0)).orderBy("_cell")
    cells = hashed.groupBy("_cell").agg(F.count("*").alias("_n"))
    cells = cells.select("_cell", "_n", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    wanted = cells.filter(F.col("_before") < n)
    placed = hashed.join(F.broadcast(wanted) if 16**digits <= MAX_CELLS else wanted, "_cell")
    passed = placed.filter(F.col("_before") + F.col("_n") <= n)
    inside = Window.partitionBy("_cell").orderBy("_hash", *key)
    cut = placed.filter(F.col("_before") + F.col("_n") > n)
    cut = cut.withColumn("_rank", F.row_number().over(inside) + F.col("_before"))
    cut = cut.filter(F.col("_rank") <= n).drop("_rank")
    return passed.select(*df.columns).unionByName(cut.select(*df.columns))


def take_hashed_by(
    df: DataFrame, limits: DataFrame, by: Sequence[str], key: Sequence[str], seed: object, limit: str
) -> DataFrame:
    """The first rows of each group in seeded random order, as many as ``limits`` (``by``, ``limit``) says.

    Rows stay where they are: their cells are counted, and only those of the one cell of a group that its
    limit cuts are sorted. Groups without a limit are left out. Reads ``df`` three times.
    """
    hashed = df.withColumn("_hash", hash_text(seed, *key))
    hashed = hashed.withColumn("_cell", F.substring("_hash", 1, hash_digits(df)))
    upto = Window.partitionBy(*by).orderBy("_cell")
    cells = hashed.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    cells = cells.select(*by, "_cell", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    begun = cells.join(limits, list(by)).filter(F.col("_before") < F.col(limit))
    last = begun.groupBy(*by).agg(F.max(F.struct("_cell", F.col(limit) - F.col("_before"))).alias("_last"))
    last = staged(last.select(*by, "_last.*").toDF(*by, "_cut", "_left"), "cuts")
    placed = hashed.join(last, list(by))
    inside = Window.partitionBy(*by).orderBy("_hash", *key)
    cut = placed.filter(F.col("_cell") == F.col("_cut")).withColumn("_rank", F.row_number().over(inside))
    cut = cut.filter(F.col("_rank") <= F.col("_left"))
    return placed.filter(F.col("_cell") < F.col("_cut")).select(*df.columns).unionByName(cut.select(*df.columns))


def value_cuts(df: DataFrame, value: str | Column, cells: int | None = None) -> list[float]:
    """Numbers that cut the rows into about even parts by a numeric value.

    Approximate quantiles from one pass without a shuffle of rows: at most ``cells``
    numbers come back, to be used as plan constants. Every later read of the plan then
    cuts at the same places. They decide balance only, never results.
    """
    if cells is None:
        cells = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = min(max(2, cells), MAX_CELLS)
    steps = [i / cells for i in range(1, cells)]
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    row = df.agg(F.percentile_approx(number, steps, 10 * cells).alias("cuts")).first()
    return sorted({c for c in (row["cuts"] or []) if c == c})


def with_value_cell(df: DataFrame, value: str, cell: str, cuts: Sequence[float]) -> DataFrame:
    """Add an integer ``cell`` that rises with a numeric column.

    Cells hold even shares of the whole table, so no group has more than one share of
    it in a cell.
    """
    if not cuts:
        return df.withColumn(cell, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_value", outputCol="_cut", handleInvalid="keep")
    marked = cut.transform(df.withColumn("_value", F.col(value).cast("double")))
    return marked.withColumn(cell, F.col("_cut").cast("int")).drop("_value", "_cut")


def ordered_rank(df: DataFrame, key: str, rank: str = "rank", size: str | None = None) -> DataFrame:
    """Rank rows 1..n by a numeric key over the whole table."""
    celled = with_value_cell(df, key, "_cell", value_cuts(df, key))
    ranked = running_totals(
        celled, [], "_cell", [key], {rank: F.lit(1)}, {rank: size} if size else None
    )
    return ranked.drop("_cell")


def every_nth(df: DataFrame, key: str, step: int) -> DataFrame:
    """Rows 1, 1 + step, 1 + 2·step … in order of a unique numeric key."""
    ranked = ordered_rank(df, key, "_rank")
    return ranked.filter((F.col("_rank") - 1) % step == 0).drop("_rank")


def nth_unlisted(
    draws: DataFrame,
    listed: DataFrame,
    by: Sequence[str],
    size: str,
    want: str,
    position: str,
    cells: int | str = MAX_CELLS,
    no_nulls: bool = False,
    once: str | None = None,
) -> DataFrame:
    """For each draw, the position of the ``want``-th entry that is not listed.

    A group has positions 0..size-1, of which ``listed`` strikes some out (distinct
    rows of ``by, position, size``). With the struck positions p(0) < p(1) < …, entry r
    of the rest sits at r plus the number of t with p(t) - t <= r. Both steps are
    running counts, so nothing but the draws and the struck entries is ever dealt out, the draws once.
    ``no_nulls`` says that ``by`` holds none. ``cells`` is the number of cells a group is cut into, or
    names a column of both tables with that of each group: where groups are many and small, cells
    as many as positions would be as many as rows. With ``once``, only the draw with the least of that column is
    kept of those that want the same entry.
    """
    many = F.col(cells) if isinstance(cells, str) else F.lit(cells)
    width = F.greatest(F.lit(1), F.ceil(F.col(size) / many)).cast("bigint")
    struck = listed.withColumn("_cell", F.floor(F.col(position) / width).cast("int"))
    # running_totals reads its input twice; what took joins and counts to make is written once
    struck = running_totals(staged(struck, "struck"), by, "_cell", [position], {"_t": F.lit(1)}, no_nulls=no_nulls)
    struck = struck.withColumn("_at", F.col(position) - (F.col("_t") - 1))
    struck = struck.select(*by, many.alias("_many"), "_at", F.floor(F.col("_at") / width).cast("int").alias("_cell"))
    struck = staged(struck, "unlisted")
    # struck entries before each cell: a group of one cell has none, others are few
    parts = struck.filter("_many > 1").groupBy(*by).agg(F.max("_many").alias("_many"))
    parts = parts.select(*by, F.explode(F.sequence(F.lit(0), F.col("_many").cast("int") - 1)).alias("_cell"), F.lit(0).alias("_in"))
    held = struck.filter("_many > 1").groupBy(*by, "_cell").agg(F.count("*").alias("_in"))
    before = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    lift = parts.unionByName(held).groupBy(*by, "_cell").agg(F.sum("_in").alias("_in"))
    lift = lift.select(
        *[F.col(k).alias(f"_key_{k}") for k in [*by, "_cell"]], F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before")
    )
    lift = staged(lift, "lift")

    asked = draws.withColumns({"_at": F.col(want), "_struck": F.lit(0)})
    asked = asked.withColumn("_cell", F.floor(F.col("_at") / width).cast("int")).drop(want)
    both = asked.unionByName(struck.drop("_many").withColumn("_struck", F.lit(1)), allowMissingColumns=True)
    sorted_by = ["_at", F.col("_struck").desc(), *([once] if once else [])]
    inside = Window.partitionBy(*by, "_cell").orderBy(*sorted_by)
    shift = F.sum("_struck").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    repeat = F.lag("_at").over(inside).eqNullSafe(F.col("_at")) & F.lag("_struck").over(inside).eqNullSafe(F.lit(0))
    both = both.select("*", shift.alias("_shift"), (repeat if once else F.lit(False)).alias("_repeat"))
    found = both.filter((F.col("_struck") == 0) & ~F.col("_repeat"))
    same = [F.col(k) == F.col(f"_key_{k}") if no_nulls else F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in [*by, "_cell"]]
    found = found.join(lift, reduce(lambda a, b: a & b, same), "left")
    place = F.col("_at") + F.col("_shift") + F.coalesce(F.col("_before"), F.lit(0))
    return found.select(*[F.col("_at").alias(c) if c == want else F.col(c) for c in draws.columns], place.alias(position))
