"""Listing a directory tree and reading its files as DataFrames."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.text import glob_regex, listed
from lodeseek.sources.tables import cut_lineage

ENTRIES = "kind string, rel_path string, size long, modified long"
#: Bytes of files that are handed on together.
BATCH = 16 << 20


def list_files(
    spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, tasks: int = 200
) -> DataFrame:
    """abs_path, rel_path, size, modified (microseconds) of the regular files below ``root`` (a folder that all executors
    see) that a listing keeps.

    The tree is listed level by level, the directories of a level by up to ``tasks`` tasks, so that it doesn't matter how
    files are spread over directories. Hidden directories, those whose every child is excluded, and links aren't entered;
    hidden files are listed. (Spark's own file source would drop names that begin with ``_`` or ``.``.)
    """
    pruned = [re.compile(p) for p in map(glob_regex, exclude or []) if p]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for directory in batch["rel_path"]:
                rows = []
                try:
                    entries = list(os.scandir(os.path.join(root, directory)))
                except OSError:  # gone or not ours to read
                    continue
                for e in entries:
                    rel = os.path.join(directory, e.name)
                    if e.is_dir(follow_symlinks=False):
                        if not e.name.startswith(".") and not any(p.search(f"{rel}/x") for p in pruned):
                            rows.append(("d", rel, None, None))
                    elif e.is_file(follow_symlinks=False):
                        stat = e.stat(follow_symlinks=False)
                        rows.append(("f", rel, stat.st_size, stat.st_mtime_ns // 1000))
                frame = pd.DataFrame(rows, columns=["kind", "rel_path", "size", "modified"])
                yield frame.astype({"size": "Int64", "modified": "Int64"})

    level = spark.createDataFrame([("d", "", None, None)], ENTRIES)
    found = spark.createDataFrame([], ENTRIES)
    while True:
        directories = level.where("kind = 'd'").select("rel_path")
        count = directories.count()
        if not count:
            break
        level = cut_lineage(directories.repartition(min(count, tasks)).mapInPandas(scan, ENTRIES))
        found = found.unionByName(level.where("kind = 'f'"))
    kept = found.where(listed(F.col("rel_path"), include, exclude))
    return kept.select(F.concat(F.lit(root.rstrip("/") + "/"), "rel_path").alias("abs_path"), "rel_path", "size", "modified")


def read_files(files: DataFrame) -> DataFrame:
    """rel_path, bytes, error for each row of ``files`` (abs_path, rel_path); bytes are null where reading failed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for path, rel in zip(batch["abs_path"], batch["rel_path"]):
                content = error = None
                try:
                    with open(path, "rb") as file:
                        content = file.read()
                except OSError as e:
                    error = str(e)
                rows.append((rel, content, error))
                held += len(content or b"")
                if held >= BATCH:
                    yield pd.DataFrame(rows, columns=["rel_path", "bytes", "error"], dtype=object)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=["rel_path", "bytes", "error"], dtype=object)

    return files.select("abs_path", "rel_path").mapInPandas(read, "rel_path string, bytes binary, error string")
