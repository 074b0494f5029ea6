"""State that has to see rows in the order of their event time.

Rows reach a stream in any order within the watermark delay. ``in_event_order`` holds back the
rows of each key until the watermark has passed them, then hands them to ``step`` one by one in
order; what ``step`` returns does not depend on how rows were spread over batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Memory = list[int]
Step = Callable[[Memory, tuple[int, ...]], tuple[Memory, tuple | None]]

STATE = "memory array<bigint>, pending array<bigint>"


def in_event_order(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    added: T.StructType,
    step: Step,
    forget_after: Callable[[Memory], int | None],
) -> DataFrame:
    """Run ``step`` over the rows of each key in event order.

    ``columns`` are BIGINT. ``step(memory, (time, *columns))`` returns the new memory and the
    added values of the row, or ``None`` to drop it. A key whose rows are all handled is
    forgotten once the watermark passes ``forget_after(memory)``.
    """
    width = 1 + len(columns)
    keys = list(keys)
    source = stream.select(*keys, ts, *[F.col(c).cast("bigint").alias(c) for c in columns])
    out_schema = T.StructType(
        [*[source.schema[k] for k in keys], source.schema[ts], *[source.schema[c] for c in columns], *added.fields]
    )
    names = [f.name for f in out_schema.fields]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memory, pending = ([list(x) for x in state.get]) if state.exists else ([], [])
        rows = [tuple(pending[i : i + width]) for i in range(0, len(pending), width)]
        if not state.hasTimedOut:
            for pdf in batches:
                times = pdf[ts].to_numpy().astype("datetime64[us]").astype("int64")
                rows += zip(times.tolist(), *[pdf[c].tolist() for c in columns])
        mark = state.getCurrentWatermarkMs() * 1000
        rows.sort()
        ready, waiting = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        done = []
        for row in ready:
            memory, extra = step(memory, row)
            if extra is not None:
                done.append((*key, np.datetime64(row[0], "us"), *row[1:], *extra))
        expiry = waiting[0][0] if waiting else forget_after(memory)
        if not waiting and (expiry is None or expiry <= mark):
            if state.exists:
                state.remove()
        else:
            state.update((memory, [int(v) for r in waiting for v in r]))
            state.setTimeoutTimestamp(max(expiry // 1000, mark // 1000) + 1)
        if done:
            yield pd.DataFrame(done, columns=names)

    return source.groupBy(*keys).applyInPandasWithState(
        run, out_schema, STATE, "append", "EventTimeTimeout"
    )
