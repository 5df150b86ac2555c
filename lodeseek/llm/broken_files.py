"""Problem 1: source files that don't parse in the language of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.file_text import map_files
from lodeseek.llm.nesting import room_for

ERRORS = (
    "file_path string, language string, repo string, n_lines int, n_errors int, first_line int, first_cause string, "
    "error_lines array<int>, error_causes array<string>"
)


def syntax_errors(language: str, text: str) -> list[tuple[int, str]] | None:
    """Errors of a text as (line, cause), or None if there is no grammar for the language."""
    from lodeseek.llm.syntax import CHECKERS

    check = CHECKERS.get(language)
    if check is None:
        return None
    with room_for(text):
        return check(text)


def check_files(chunks: DataFrame) -> DataFrame:
    """Every file of ``chunks`` with its syntax errors.

    Columns: file_path, language, repo, n_lines, n_errors (null without a grammar for the language), first_line (0-based,
    counted in the file's joined rows) and first_cause of the first error, and all errors as error_lines and error_causes. An empty text has no errors. How rows make up a file, and what becomes of nulls and repeated
    rows, is told in ``map_files``.
    """

    def one(path: str, language: str | None, repo: str | None, text: str) -> list[tuple]:
        errors = syntax_errors(language, text)
        n_lines = text.count("\n") + 1 if text else 0
        if errors is None:
            return [(path, language, repo, n_lines, None, None, None, None, None)]
        first = errors[0] if errors else (None, None)
        return [(path, language, repo, n_lines, len(errors), *first, [e[0] for e in errors], [e[1] for e in errors])]

    return map_files(chunks, one, ERRORS)


def broken_files(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("n_errors") > 0)


def rates(checked: DataFrame) -> DataFrame:
    """For each repo and language: files with a grammar, broken files, rate. Null repos and languages are groups too."""
    broken = F.sum((F.col("n_errors") > 0).cast("long"))
    return (
        checked.where(F.col("n_errors").isNotNull())
        .groupBy("repo", "language")
        .agg(F.count("*").alias("files"), broken.alias("broken"), F.round(broken / F.count("*"), 6).alias("rate"))
    )


def acceptance(checked: DataFrame) -> DataFrame:
    """For each language: files, accepted files, and the most frequent first cause of the others."""
    by_cause = checked.where(F.col("n_errors") > 0).groupBy("language", "first_cause").agg(F.count("*").alias("n"))
    cause = by_cause.groupBy("language").agg(
        F.min_by("first_cause", F.struct(-F.col("n"), "first_cause")).alias("top_cause")
    )
    files = checked.where(F.col("n_errors").isNotNull()).groupBy("language").agg(
        F.count("*").alias("files"), F.sum((F.col("n_errors") == 0).cast("long")).alias("accepted")
    )
    same = files["language"].eqNullSafe(cause["language"])
    return files.join(cause, same, "left").select(files["language"], "files", "accepted", "top_cause")
