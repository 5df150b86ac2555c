"""The refresh of a chunk table as one plan: classify, parse, embed, replace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.embed import embed
from lodeseek.operators.chunking import MAX_LINES, parse_files
from lodeseek.operators.refresh import classify, content_hash
from lodeseek.sources.snapshots import Store
from lodeseek.sources.tables import cut_lineage


def embedded_chunks(files: DataFrame, dim: int, max_lines: int = MAX_LINES) -> DataFrame:
    """Rows of the chunk table for ``files`` (rel_path, bytes). A chunk without a vector is dropped."""
    hashes = files.select(F.col("rel_path").alias("file_path"), content_hash(F.col("bytes")).alias("file_hash"))
    chunks = parse_files(files, max_lines).join(hashes, "file_path")
    rows = chunks.select(
        F.concat_ws(":", "file_path", "start_line").alias("id"),
        "file_path",
        "file_hash",
        "language",
        "symbol",
        "content",
        "start_line",
        "end_line",
        "summary",
        embed(F.col("content"), dim).alias("vector"),
        embed(F.col("summary"), dim).alias("summary_vector"),
    )
    return rows.where(F.col("vector").isNotNull())


def refresh(listing: DataFrame, store: Store, dim: int = 64, max_lines: int = MAX_LINES) -> DataFrame:
    """Bring the table to the state of ``listing`` (rel_path, bytes); returns status, files.

    Only new and changed files are parsed and embedded, and only the partitions of touched files are rewritten. If nothing
    changed, nothing is written.
    """
    status = cut_lineage(classify(listing, store.read()))  # before the table changes
    touched = status.where(F.col("status").isin("new", "changed", "removed"))
    if not store.exists() or not touched.isEmpty():
        fresh = listing.join(
            touched.where("status != 'removed'").select(F.col("file_path").alias("rel_path")), "rel_path", "left_semi"
        )
        store.upsert(embedded_chunks(fresh, dim, max_lines), touched, dim)
    return status.groupBy("status").agg(F.count("*").alias("files"))
