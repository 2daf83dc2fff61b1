"""Trends and gates that answer while readings arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.times import epoch_micros

SAMPLES = 5


def slope(micros: Sequence[int], values: Sequence[float | None]) -> float | None:
    """Least-squares slope per second; null for fewer than two readings, or readings of one moment."""
    known = [(t, v) for t, v in zip(micros, values) if v is not None]
    if len(known) < 2:
        return None
    x = np.array([t - known[0][0] for t, _ in known]) / 1e6
    y = np.array([v for _, v in known])
    spread = ((x - x.mean()) ** 2).sum()
    return float(((x - x.mean()) * (y - y.mean())).sum() / spread) if spread else None


def live_trend(
    stream: DataFrame, by: Sequence[str] = ("instance", "metric"), ts: str = "ts", value: str = "value", n: int = SAMPLES, delay: str = "1 hour",
    keep: str = "1 day",
) -> DataFrame:
    """A stream of ``(by, ts, value, samples, slope)``: after each batch one row for every series it had readings of.

    The row is that of ``windows.trend`` for the newest reading: the slope over
    it and the ``n - 1`` before it. A series keeps its last ``n`` readings and
    no more; a late reading takes its place among them if it belongs there,
    and a repeated one replaces itself. A series without readings for ``keep``
    of event time is given up when the watermark (``delay`` behind) says so.
    """
    by = list(by)
    rows = stream.select(*by, F.col(ts).cast("timestamp").alias("_at"), F.col(value).cast("double").alias("_value")).withWatermark("_at", delay)
    rows = rows.withColumn("_micros", epoch_micros(F.col("_at")))
    out = T.StructType([*[stream.schema[c] for c in by], T.StructField("micros", T.LongType()), T.StructField("value", T.DoubleType()),
                        T.StructField("samples", T.LongType()), T.StructField("slope", T.DoubleType())])
    held = T.StructType([T.StructField("micros", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType()))])
    span = pd.Timedelta(keep)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = dict(zip(*state.get)) if state.exists else {}
        for part in parts:
            # Only the newest of a part can stay.
            part = part.sort_values("_micros", kind="stable").drop_duplicates("_micros", keep="last").tail(n)
            last |= {int(t): None if pd.isna(v) else float(v) for t, v in zip(part["_micros"], part["_value"])}
            last = dict(sorted(last.items())[-n:])
        micros, values = list(last), list(last.values())
        state.update((micros, values))
        state.setTimeoutTimestamp(max(micros[-1] // 1000 + int(span.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        known = sum(v is not None for v in values)
        row = {**dict(zip(by, key)), "micros": micros[-1], "value": values[-1], "samples": known, "slope": slope(micros, values)}
        yield pd.DataFrame([row], columns=[f.name for f in out])

    found = rows.groupBy(*by).applyInPandasWithState(step, out, held, "update", GroupStateTimeout.EventTimeTimeout)
    return found.select(*by, F.timestamp_micros("micros").alias("ts"), "value", "samples", "slope")
