"""Joins and ranks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casebook.session import materialise

#: Pairs of rows of one key that one task takes; keys with more are split on both sides.
ROWS_PER_SALT = 1_000_000
#: The keys of most pairs that are split, so the list to broadcast has at most so many short rows. Any other key holds
#: less than that share of all pairs.
HOTTEST = 100_000


def key_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key; only the key columns are read."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread_by: str,
    counts: DataFrame,
    rows_per_salt: int = ROWS_PER_SALT,
    small_by: Column | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Inner equi-join on ``keys``; keys of many pairs are split into a grid.

    Rows of ``big`` are dealt by a hash of ``spread_by``, rows of ``small`` by ``small_by`` or one of their ``query_id`` or ``entity``;
    each is repeated for the other's parts. ``counts`` (keys, n) holds the rows of ``big`` per key. Ordinary keys pay
    nothing. With ``asked`` (keys, n: the rows of ``small`` per key) keys to split are looked for first; without any,
    sides that are already partitioned by ``keys`` are not shuffled again.
    """
    dealt_by = next((c for c in ("query_id", "entity") if c in small.columns), None) if small_by is None else small_by
    pairs = F.col("n") * F.col("_asked")
    # a key asked for by few is split on the big side alone
    small_parts = F.ceil(F.col("_asked") / rows_per_salt**0.5) if dealt_by is not None else F.lit(1)
    met = key_counts(small, keys) if asked is None else asked
    grid = counts.join(met.withColumnRenamed("n", "_asked"), keys).where(pairs > rows_per_salt).select(
        *keys, pairs.alias("_pairs"), F.ceil(pairs / rows_per_salt / small_parts).cast("int").alias("_rows"),
        small_parts.cast("int").alias("_columns"),
    )
    split = grid.orderBy(F.desc("_pairs")).limit(HOTTEST).drop("_pairs")
    if asked is not None:
        split = materialise(split)
        if split.isEmpty():
            return big.join(small, keys)
    hot = F.broadcast(split)

    def dealt(rows: DataFrame, own: str, other: str, by: Column | str | None) -> DataFrame:
        parts, repeats = F.coalesce(F.col(own), F.lit(1)), F.coalesce(F.col(other), F.lit(1))
        place = F.when(parts == 1, 0).otherwise(F.pmod(F.xxhash64(by), parts).cast("int")) if by is not None else F.lit(0)
        return (
            rows.join(hot, keys, "left")
            .withColumn(f"_at{own}", place)
            .withColumn(f"_at{other}", F.explode(F.sequence(F.lit(0), repeats - 1)))
            .drop("_rows", "_columns")
        )

    left, right = dealt(big, "_rows", "_columns", spread_by), dealt(small, "_columns", "_rows", dealt_by)
    return left.join(right, [*keys, "_at_rows", "_at_columns"]).drop("_at_rows", "_at_columns")


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows per key. Spark cuts to ``k`` per map task before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def rank_within(
    rows: DataFrame, keys: list[str], order: list[Column], name: str, rows_per_task: int = ROWS_PER_SALT,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Exact 1-based rank of every row within ``keys``, without one task for a large key.

    Ordinary keys are ranked by a window, one shuffle. Keys of more than ``rows_per_task`` rows, if there are any, are
    range-sorted instead. ``counts`` (keys, n) tells them where the caller has it.
    """
    large = (key_counts(rows, keys) if counts is None else counts).where(F.col("n") > rows_per_task).orderBy(F.desc("n")).limit(HOTTEST).select(*keys)
    large = materialise(large)
    if large.isEmpty():
        return _ranked_by_window(rows, keys, order, name)
    listed = F.broadcast(large)
    return _ranked_by_window(rows.join(listed, keys, "left_anti"), keys, order, name).unionByName(
        _ranked_by_range(rows.join(listed, keys, "left_semi"), keys, order, name)
    )


def _ranked_by_window(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def _ranked_by_range(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows are range-sorted over (keys, order), so a large key spans many tasks; the rank is the row's offset inside
    its task plus the count of the key's rows in earlier tasks. The sorted rows are written once, so both readers
    see the same layout even when an executor is lost."""
    placed = materialise(
        rows.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_task", F.shiftright("_at", 33))
    spans = placed.groupBy(*keys, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # One row per (key, task): never more than the number of sort tasks for a key.
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select(
        *keys, "_task", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        placed.join(starts, [*keys, "_task"])
        .withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long"))
        .drop("_at", "_task", "_first", "_before")
    )
