"""Putting the texts of files together again from their chunk rows, one file after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = ["file_path", "language"]


def map_files(
    chunks: DataFrame, one: Callable[[str, str | None, str | None, str], list[tuple]], schema: str
) -> DataFrame:
    """Apply ``one(file_path, language, repo, text)`` to every file of ``chunks``; it returns rows of ``schema``.

    A file is told by its path and language. Its text is made of its rows' contents in the order of start_line,
    end_line, id, each distinct (id, content) once, with a line break between rows. Rows with a null path or content are
    left out; a null start or end line counts as 0; if rows disagree on ``repo``, the first in order is taken. Only
    file_path, language, repo, id, content, start_line and end_line are read.

    Repeated rows are removed before rows meet by file, with a partial step ahead of the first shuffle, so that copies
    of one row don't gather in one task. Files are then streamed in order from sorted partitions: a task holds one
    file's text at a time, not a group of files.
    """
    rows = chunks.where(F.col("file_path").isNotNull() & F.col("content").isNotNull()).select(
        *_KEY,
        "repo",
        F.coalesce("id", F.lit("")).alias("id"),
        "content",
        F.coalesce("start_line", F.lit(0)).alias("start_line"),
        F.coalesce("end_line", F.lit(0)).alias("end_line"),
    )
    order = [*_KEY, "start_line", "end_line", "id", "content"]
    rows = rows.distinct().repartition("file_path").sortWithinPartitions(*order)
    names = [f.split()[0] for f in schema.split(", ")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, repo, parts, seen, out = None, None, [], None, []
        for batch in batches:
            columns = (batch[c] for c in ("file_path", "language", "repo", "id", "content"))
            for path, language, own, ident, content in zip(*columns):
                if (path, language) != key:
                    if key is not None:
                        out += one(*key, repo, "\n".join(parts))
                    key, repo, parts, seen = (path, language), own, [], None
                if (ident, content) != seen:  # the same row with other values of repo
                    parts.append(content)
                    seen = (ident, content)
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if key is not None:
            out += one(*key, repo, "\n".join(parts))
        yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(stream, schema)
