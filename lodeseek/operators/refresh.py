"""Keeping a chunk table current: which files are new, changed, unchanged or gone, and what a refresh does to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("new", "changed", "unchanged", "removed", "unreadable")


def content_hash(content: Column) -> Column:
    """SHA-256 of bytes in lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def valid_text(content: Column) -> Column:
    """Whether bytes are valid UTF-8; null for null."""
    return F.is_valid_utf8(content.cast("string"))


def stored_hashes(chunks: DataFrame) -> DataFrame:
    """file_path, file_hash of each stored file; all rows of a file agree, and if not, the smallest hash counts."""
    return chunks.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.min("file_hash").alias("stored_hash"))


def classify(listing: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_path, file_hash, stored_hash, status of every listed or stored file.

    ``listing`` has rel_path and bytes (null if it couldn't be read), ``chunks`` file_path and file_hash. One full join on
    the path replaces a look-up for each file; both sides are one row a path, and a path listed twice counts once.
    Null paths are left out.
    """
    listed = listing.where(F.col("rel_path").isNotNull()).select(
        F.col("rel_path").alias("file_path"), content_hash(F.col("bytes")).alias("file_hash")
    )
    listed = listed.groupBy("file_path").agg(F.min("file_hash").alias("file_hash"), F.lit(True).alias("listed"))
    both = listed.join(stored_hashes(chunks), "file_path", "full")
    status = (
        F.when(F.col("listed").isNull(), "removed")
        .when(F.col("file_hash").isNull(), "unreadable")
        .when(F.col("stored_hash").isNull(), "new")
        .when(F.col("stored_hash") == F.col("file_hash"), "unchanged")
        .otherwise("changed")
    )
    return both.select("file_path", "file_hash", "stored_hash", status.alias("status"))


def counters(listing: DataFrame, chunks: DataFrame) -> DataFrame:
    """outcome, files: what a refresh would report. Unchanged, binary and empty files are skipped, unreadable ones count as
    neither indexed nor skipped, files that are gone are purged."""
    kinds = listing.where(F.col("rel_path").isNotNull()).groupBy(F.col("rel_path").alias("file_path")).agg(
        F.max(F.coalesce(valid_text(F.col("bytes")) & (F.length("bytes") > 0), F.lit(False))).alias("text")
    )
    status = classify(listing, chunks).join(kinds, "file_path", "left")
    outcome = (
        F.when(F.col("status") == "removed", "purged")
        .when(F.col("status") == "unreadable", "unreadable")
        .when((F.col("status") == "unchanged") | ~F.col("text"), "skipped")
        .otherwise("indexed")
    )
    return status.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("files"))


def delete_files(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """``chunks`` without the rows of the files in ``paths`` (file_path). Rows with a null path stay."""
    return chunks.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def upsert(chunks: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """The next state of the table: rows of files that are gone or come anew make room for ``fresh``.

    One anti-join and one union; ``fresh`` has the columns of ``chunks``.
    """
    touched = gone.select("file_path").unionByName(fresh.select("file_path"))
    return delete_files(chunks, touched).unionByName(fresh.select(*chunks.columns))


def stats(chunks: DataFrame) -> DataFrame:
    """chunks, files: number of rows and of different files (null paths don't count as a file)."""
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"))
