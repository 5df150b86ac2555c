"""Debouncing of change events: a burst begins with the first event after the burst before and lasts a fixed time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("create", "modify", "remove")
WIDTH_MICROS = 500_000

BURSTS = "root string, start long, last long, events long"


def relevant(events: DataFrame) -> DataFrame:
    """Events of the watched kinds that have a path and a time; kinds are compared as written."""
    return events.where(F.col("kind").isin(*KINDS) & F.col("path").isNotNull() & F.col("ts").isNotNull())


def root_of(path: Column) -> Column:
    return F.split(path, "/")[0]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def debounce(events: DataFrame, width: int = WIDTH_MICROS, slice_widths: int = 7200) -> DataFrame:
    """Bursts of each root (first part of the path): root, start, last (microseconds since 1970), events.

    An event within ``width`` of its burst's first event, inclusive, belongs to the burst. Whatever is further than
    ``width`` from the event before surely begins a burst, so a root's events fall into islands that are independent of
    each other. Islands are found in time slices, whose edges are joined over one row a slice; no task orders all the
    events of a root. Then each island is folded in order, one event at a time, in sorted partitions.
    Events of other kinds and with a null path or time are left out; repeated events count each.
    """
    times = relevant(events).select(root_of(F.col("path")).alias("root"), micros(F.col("ts")).alias("at"))
    span = F.lit(width * slice_widths)
    sliced = times.withColumn("slice", F.floor(F.col("at") / span))
    ordered = W.partitionBy("root", "slice").orderBy("at")
    sliced = sliced.withColumn("before", F.lag("at").over(ordered))
    edges = sliced.groupBy("root", "slice").agg(F.max("at").alias("edge"))
    edges = edges.withColumn("edge_before", F.lag("edge").over(W.partitionBy("root").orderBy("slice"))).drop("edge")
    sliced = sliced.join(edges, ["root", "slice"])
    gap = F.col("at") - F.coalesce("before", "edge_before")
    sliced = sliced.withColumn("opens", F.when(gap.isNull() | (gap > width), F.col("at")))
    opened = sliced.groupBy("root", "slice").agg(F.max("opens").alias("opened"))
    so_far = W.partitionBy("root").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    opened = opened.withColumn("open_before", F.max("opened").over(so_far)).drop("opened")
    within = ordered.rangeBetween(W.unboundedPreceding, 0)  # by value: events of one moment belong together
    islands = sliced.withColumn("island", F.max("opens").over(within)).join(opened, ["root", "slice"])
    islands = islands.select("root", F.coalesce("island", "open_before").alias("island"), "at")
    islands = islands.repartition("root", "island").sortWithinPartitions("root", "island", "at")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, last, count = None, 0, 0, 0
        for batch in batches:
            out = []
            for root, island, at in zip(batch["root"], batch["island"], batch["at"]):
                if (root, island) != key or at > start + width:
                    if key is not None:
                        out.append((key[0], start, last, count))
                    key, start, count = (root, island), at, 0
                last, count = at, count + 1
            yield pd.DataFrame(out, columns=["root", "start", "last", "events"])
        if key is not None:
            yield pd.DataFrame({"root": [key[0]], "start": [start], "last": [last], "events": [np.int64(count)]})

    return islands.mapInPandas(fold, BURSTS)
