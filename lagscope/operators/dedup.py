"""De-duplication with a time to live: a hit passes, then the same key is silent for a while.

Which hits pass depends on which passed before, so this is not a window function. Done for a
whole key in one task it would not scale; here every key is cut into time slices:

1. each slice works out, for every hit that could be its first to pass, the last one that
   would then pass in the slice (all slices at once);
2. per key, the slices are walked in order with only those few rows, which tells each slice
   when the last hit before it passed;
3. each slice then picks its hits (all slices at once).

Only hits in the first ``ttl`` of a slice can be affected from outside, so step 2 sees about
``ttl / slice`` of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store


def dedup_key(group: str = "group_id", cls: str = "lag_classification", topic: str = "topic"):
    """Text key of a hit."""
    return F.concat_ws(":", group, cls, topic)


def _walk(times: np.ndarray, last: int | None, ttl: int) -> list[int]:
    """Times that pass, given the last pass before; one step per pass."""
    passed = []
    at = 0 if last is None else int(np.searchsorted(times, last + ttl, "left"))
    while at < len(times):
        passed.append(int(times[at]))
        at = int(np.searchsorted(times, times[at] + ttl, "left"))
    return passed


def ttl_dedup(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ttl_seconds: int = 600,
    slice_seconds: int | None = None,
) -> DataFrame:
    """Rows that pass: the first of each key, then the first at least ``ttl_seconds`` after the
    last that passed. A row that is dropped does not extend the silence. Of several rows with
    the same key and time the smallest one stands for all."""
    ttl = ttl_seconds * 1_000_000
    width = (slice_seconds or 144 * ttl_seconds) * 1_000_000
    keys = list(keys)
    key_fields = [df.schema[k] for k in keys]
    others = [c for c in df.columns if c not in (*keys, ts)]

    # Read three times below, so it is written once.
    rows = store(
        df.groupBy(*keys, ts).agg(
            *([F.min(F.struct(*others)).alias("_row")] if others else [F.count(F.lit(1)).alias("_row")])
        ),
        "hits",
    )
    hits = rows.select(
        *keys, F.unix_micros(ts).alias("_t"), F.expr(f"unix_micros(`{ts}`) div {width}").alias("_slice")
    )
    long = T.LongType()
    by_slice = [*keys, "_slice"]

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_t"].to_numpy())
        start = int(pdf["_slice"].iloc[0]) * width
        count = min(int(np.searchsorted(times, start + ttl, "left")) + 1, len(times))
        following = np.searchsorted(times, times + ttl, "left")
        at = np.arange(count)
        while True:
            ahead = following[at]
            go = ahead < len(times)
            if not go.any():
                break
            at = np.where(go, np.minimum(ahead, len(times) - 1), at)
        out = pd.DataFrame({"_slice": pdf["_slice"].iloc[0], "_t": times[:count], "_exit": times[at]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_slice", "_t", "_exit"]]

    table = hits.groupBy(*by_slice).applyInPandas(
        entries,
        T.StructType([*key_fields, T.StructField("_slice", long), T.StructField("_t", long), T.StructField("_exit", long)]),
    )

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_slice", "_t"])
        last, found = None, []
        for number, part in pdf.groupby("_slice", sort=True):
            found.append((number, last))
            times, exits = part["_t"].to_numpy(), part["_exit"].to_numpy()
            at = 0 if last is None else int(np.searchsorted(times, last + ttl, "left"))
            if at < len(times):
                last = int(exits[at])
        out = pd.DataFrame(found, columns=["_slice", "_last"]).astype({"_last": "Int64"})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_slice", "_last"]]

    before = table.groupBy(*keys).applyInPandas(
        carry, T.StructType([*key_fields, T.StructField("_slice", long), T.StructField("_last", long)])
    )

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["_last"].iloc[0]
        passed = _walk(np.sort(pdf["_t"].to_numpy()), None if pd.isna(first) else int(first), ttl)
        out = pd.DataFrame({"_t": pd.Series(passed, dtype="int64")})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_t"]]

    passing = (
        hits.join(before, by_slice)
        .groupBy(*by_slice)
        .applyInPandas(choose, T.StructType([*key_fields, T.StructField("_t", long)]))
    )
    kept = rows.withColumn("_t", F.unix_micros(ts)).join(passing, [*keys, "_t"], "left_semi")
    return kept.select(
        *[F.col(f"_row.{c}").alias(c) if c in others else F.col(c) for c in df.columns]
    )
