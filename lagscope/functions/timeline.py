"""Windows over time that do not put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(time)`` sends all rows of a key to one task. With one
group holding a third of all snapshots that task decides the run time. The helpers here slice
every key into time buckets and shuffle on (key, bucket):

* ``trailing``: for frames that look back a bounded time. Rows near the end of a bucket are
  also sent to the next one, used there as history, and dropped again.
* ``runs``: for "since when has this value been unchanged", which looks back without bound.
  Each bucket is first summed up in one row; a window over those few rows finds what every
  bucket has to start from, and a join on (key, bucket) brings it back.

Both give exactly the rows of the plain window. The bucket length changes speed only, and so does
``tasks``, the number of tasks that the rows of ``runs`` and ``previous`` are dealt to by (key,
bucket); where it is left out, the session's setting decides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .columns import micros


def slice_of(ts: str, seconds: int, shift_us: int = 0) -> Column:
    """Number of the time slice of a row. Never null, so that a join on it adds no filter to one
    side only, and both sides of ``runs`` and ``previous`` can share one shuffle."""
    return F.coalesce(
        F.expr(f"(unix_micros(`{ts}`) + {shift_us}) div {seconds * 1_000_000}"), F.lit(0).cast("bigint")
    )


def _dealt(sliced: DataFrame, keys: Sequence[str], tasks: int | None) -> DataFrame:
    return sliced.repartition(tasks, *keys, "_slice") if tasks else sliced


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    lookback_seconds: int,
    bucket_seconds: int,
    build: Callable[[WindowSpec], dict[str, Column]],
) -> DataFrame:
    """Add window columns whose frames reach back at most ``lookback_seconds``.

    ``build`` gets a window ordered by ``_us`` (microseconds) and returns the new columns; it
    must use frames that stay inside the lookback, or check the age of what they find.
    """
    home = slice_of(ts, bucket_seconds)
    last = slice_of(ts, bucket_seconds, int(lookback_seconds * 1_000_000))
    sliced = df.select(
        "*",
        micros(ts).alias("_us"),
        home.alias("_home"),
        F.explode(F.sequence(home, last)).alias("_slice"),
    )
    w = Window.partitionBy(*keys, "_slice").orderBy("_us")
    added = build(w)
    return (
        sliced.select("*", *[c.alias(n) for n, c in added.items()])
        .filter(F.col("_slice") == F.col("_home"))
        .drop("_us", "_home", "_slice")
    )


def runs(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    bucket_seconds: int,
    tasks: int | None = None,
) -> DataFrame:
    """Add ``run_start`` (time of the first row of the current run of equal values) and
    ``run_open`` (true while no change has been seen since the first row of the key).

    ``value`` must not be null and ``ts`` must be unique per key.
    """
    sliced = _dealt(df.withColumn("_slice", slice_of(ts, bucket_seconds)), keys, tasks)
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts)
    before = F.lag(value).over(inside)
    marked = sliced.withColumn(
        "_change", F.when(before.isNotNull() & (before != F.col(value)), F.col(ts))
    )

    # The whole last row is kept so that this branch reads the same columns as the other one,
    # and the shuffle below both is run once.
    per_slice = marked.groupBy(*keys, "_slice").agg(
        F.min(ts).alias("_first_ts"),
        F.min_by(value, ts).alias("_first_value"),
        F.max_by(F.struct(*df.columns), ts).alias("_last_row"),
        F.max("_change").alias("_last_change"),
    )
    across = Window.partitionBy(*keys).orderBy("_slice") if keys else Window.orderBy("_slice")
    carried = F.lag(F.col("_last_row")[value]).over(across)
    entry = (
        per_slice.withColumn("_known", carried.isNotNull())
        .withColumn(
            "_edge",
            F.when(carried.isNotNull() & (carried != F.col("_first_value")), F.col("_first_ts")),
        )
        .withColumn("_origin", F.first("_first_ts").over(across))
        .withColumn(
            "_carry",
            F.last(F.coalesce("_last_change", "_edge"), ignorenulls=True).over(
                across.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(
            *keys, "_slice", "_origin", F.coalesce("_edge", "_carry").alias("_entry_change")
        )
    )

    joined = marked.join(entry, [*keys, "_slice"])
    change = F.coalesce(
        F.max("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        F.col("_entry_change"),
    )
    return (
        joined.withColumn("_at", change)
        .withColumn("run_start", F.coalesce("_at", "_origin"))
        .withColumn("run_open", F.col("_at").isNull())
        .drop("_slice", "_change", "_at", "_origin", "_entry_change")
    )


def previous(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    bucket_seconds: int,
    tasks: int | None = None,
) -> DataFrame:
    """Add ``prev_<column>`` for each column: its value on the row before, however long ago."""
    sliced = _dealt(df.withColumn("_slice", slice_of(ts, bucket_seconds)), keys, tasks)
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts)
    per_slice = sliced.groupBy(*keys, "_slice").agg(
        F.max_by(F.struct(*df.columns), ts).alias("_last_row")
    )
    across = Window.partitionBy(*keys).orderBy("_slice") if keys else Window.orderBy("_slice")
    carried = F.struct(*[F.col(f"_last_row.{c}").alias(c) for c in columns])
    entry = per_slice.select(*keys, "_slice", F.lag(carried).over(across).alias("_entry"))
    row = F.coalesce(F.lag(F.struct(*columns)).over(inside), F.col("_entry"))
    return (
        sliced.join(entry, [*keys, "_slice"])
        .withColumn("_prev", row)
        .select(*df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in columns])
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, name: str, bucket_seconds: int
) -> DataFrame:
    """Add the sum of ``value`` from the first row of the key up to each row."""
    sliced = df.withColumn("_slice", slice_of(ts, bucket_seconds))
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_sum"))
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    entry = per_slice.select(
        *keys, "_slice", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_before")
    )
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        sliced.join(entry, [*keys, "_slice"])
        .withColumn(name, F.sum(value).over(inside) + F.col("_before"))
        .drop("_slice", "_before")
    )


def numbered(
    df: DataFrame, keys: Sequence[str], groups: Sequence[str], rest: Sequence[str], name: str
) -> DataFrame:
    """Add the position (from 1) of each row within ``keys``, ordered by ``groups`` then ``rest``.

    Rows are numbered per (keys, groups) and moved up by the count of all groups before, so no
    task has to see all rows of one ``keys`` value. Columns must not be null.
    """
    sizes = df.groupBy(*keys, *groups).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, *groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, *groups).orderBy(*rest)
    return (
        df.join(offsets, [*keys, *groups])
        .withColumn(name, F.row_number().over(inside) + F.col("_offset"))
        .drop("_offset")
    )
