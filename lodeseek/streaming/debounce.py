"""Debouncing on a stream, and a refresh that runs one at a time."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeseek.operators.bursts import BURSTS, WIDTH_MICROS, relevant, root_of

log = logging.getLogger(__name__)


def debounced(events: DataFrame, width: int = WIDTH_MICROS, delay: str = "10 seconds") -> DataFrame:
    """Bursts (see ``operators.bursts``) of a stream of events with path, kind and ts.

    Events may be late by ``delay``; later ones are dropped. A root's state holds the events that the watermark hasn't
    passed yet, and the burst that is open there: as much as arrives within the delay. A burst comes out once the
    watermark has passed its end.
    """
    times = relevant(events).select(root_of(F.col("path")).alias("root"), F.col("ts").cast("timestamp").alias("at"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, start, last, count = state.get if state.exists else ([], -1, -1, 0)
        waiting = list(waiting)
        for batch in batches:
            waiting += (pd.to_datetime(batch["at"]).astype("datetime64[us]").astype("int64")).tolist()
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        out = []
        while waiting and waiting[0] <= passed:
            at = waiting.pop(0)
            if count and at > start + width:
                out.append((key[0], start, last, count))
                count = 0
            start, last, count = (start if count else at), at, count + 1
        if count and passed > start + width:
            out.append((key[0], start, last, count))
            start, last, count = -1, -1, 0
        if waiting or count:
            state.update((waiting, start, last, count))
            due = min(waiting[:1] + ([start + width] if count else []))
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["root", "start", "last", "events"])

    return (
        times.withWatermark("at", delay)
        .groupBy("root")
        .applyInPandasWithState(
            fold, BURSTS, "waiting array<long>, start long, last long, events long", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def refresh_on(events: DataFrame, refresh: Callable[[DataFrame], object], checkpoint: str, every: str = "500 milliseconds", **trigger) -> StreamingQuery:
    """Call ``refresh`` with the paths of each micro-batch that has relevant events.

    Micro-batches run one after the other, so a slow refresh holds back the next one. A failure is logged and the
    stream goes on. A batch may be repeated after a restart: ``refresh`` has to be idempotent.
    """

    def run(batch: DataFrame, number: int) -> None:
        paths = relevant(batch).select("path").distinct()
        try:
            if not paths.isEmpty():
                refresh(paths)
        except Exception:
            log.exception("refresh of batch %s failed", number)

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": every})).start()
