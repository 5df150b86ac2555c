"""Cutting texts into line windows and into definitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.text import language_of, lines, window_starts
from lodeseek.operators.definitions import definitions
from lodeseek.operators.refresh import valid_text

MAX_LINES = 150


def decoded(files: DataFrame) -> DataFrame:
    """rel_path and text of the files that are valid UTF-8 and not empty."""
    kept = files.where(F.col("rel_path").isNotNull() & F.col("bytes").isNotNull() & (F.length("bytes") > 0))
    return kept.where(valid_text(F.col("bytes"))).select("rel_path", F.col("bytes").cast("string").alias("text"))


def line_windows(texts: DataFrame, key: str, text_col: str, size: int = MAX_LINES) -> DataFrame:
    """Windows of at most ``size`` lines, one after the other: id (key:start_line), key, start_line, end_line, content.

    Line numbers are 0-based and inclusive; line ends become LF. Null and empty texts have no window; a text of one line
    end has one window of an empty line. Only the two named columns are read.
    """
    cut = texts.where(F.col(text_col).isNotNull()).select(F.col(key).alias("_key"), lines(F.col(text_col)).alias("_lines"))
    cut = cut.select("_key", "_lines", F.explode(window_starts(F.col("_lines"), size)).alias("start_line"))
    part = F.slice("_lines", F.col("start_line") + 1, size)
    return cut.select(
        F.concat_ws(":", "_key", "start_line").alias("id"),
        F.col("_key").alias(key),
        "start_line",
        (F.col("start_line") + F.size(part) - 1).alias("end_line"),
        F.array_join(part, "\n").alias("content"),
    )


def split_oversized(chunks: DataFrame, size: int = MAX_LINES) -> DataFrame:
    """``chunks`` with those of more than ``size`` lines cut into windows; symbol, kind and summary go to every part.

    Needs content and start_line (null counts as 0); all other columns are kept. Rows with null content stay as they are.
    """
    whole = F.split("content", "\n", -1)
    starts = F.when(F.size(whole) > size, F.sequence(F.lit(0), F.size(whole) - 1, F.lit(size))).otherwise(F.array(F.lit(0)))
    cut = chunks.withColumn("_lines", whole).withColumn("_at", F.explode(starts))
    part = F.slice("_lines", F.col("_at") + 1, size)
    first = F.coalesce("start_line", F.lit(0)) + F.col("_at")
    return (
        cut.withColumn("content", F.when(F.col("content").isNotNull(), F.array_join(part, "\n")))
        .withColumn("end_line", F.when(F.col("content").isNotNull(), first + F.size(part) - 1).otherwise(F.col("end_line")))
        .withColumn("start_line", first)
        .drop("_lines", "_at")
    )


CHUNKS = "file_path string, language string, symbol string, content string, start_line int, end_line int, node_kind string, summary string"


def parse_files(files: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """Chunks of source files: definitions, or windows of the whole file (of an empty kind) where none is found.

    ``files`` has rel_path and bytes; line ends become LF. Unreadable, binary and empty files and those of an unknown extension give no chunk.
    Definitions of more than ``max_lines`` lines are cut into windows. Columns as in ``CHUNKS``. Files are independent:
    nothing is shuffled.
    """
    texts = decoded(files).withColumn("language", language_of(F.col("rel_path"))).where(F.col("language").isNotNull())

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, language, text in zip(batch["rel_path"], batch["language"], batch["text"]):
                text = text.replace("\r\n", "\n")
                found = definitions(language, text)
                for d in found:
                    out.append((path, language, d.symbol, text[d.start : d.end], d.first, d.last, d.kind, d.summary))
                if not found:
                    text = text.removesuffix("\n")
                    out.append((path, language, "", text, 0, text.count("\n"), "", None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return split_oversized(texts.mapInPandas(parse, CHUNKS), max_lines)
