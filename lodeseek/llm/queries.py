"""Queries of the nine training-data problems: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import broken_files, documented, foreign_files, leakage, mixing, neighbours, similarity, splitting, truncation
from lodeseek.sources.tables import cut_lineage, read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = broken_files.check_files(read_table(spark, sf_dir, "chunks"))
    return broken_files.broken_files(checked).select("file_path").distinct()


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of broken files for each repository and language."""
    return broken_files.rates(broken_files.check_files(read_table(spark, sf_dir, "chunks")))


def p1_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance of each language's grammar, with the most frequent first cause."""
    return broken_files.acceptance(cut_lineage(broken_files.check_files(read_table(spark, sf_dir, "chunks"))))


def p1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of every broken file: line (0-based) and cause, numbered in order."""
    broken = broken_files.broken_files(broken_files.check_files(read_table(spark, sf_dir, "chunks")))
    return broken.select("file_path", "language", F.posexplode(F.arrays_zip("error_lines", "error_causes")).alias("no", "e")).select(
        "file_path", "language", "no", F.col("e.error_lines").alias("line"), F.col("e.error_causes").alias("cause")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = foreign_files.classify_files(read_table(spark, sf_dir, "chunks"), told=True)
    return files.where("kind != 'hand'").select("file_path").distinct()


def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its kind, the reason, and the file of another repository that holds it, told or not."""
    return foreign_files.classify_files(read_table(spark, sf_dir, "chunks"))


def p2_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of which one in another repository holds at least four fifths, with the share."""
    found = foreign_files.containment(cut_lineage(foreign_files.file_signs(read_table(spark, sf_dir, "chunks"))))
    return found.select("file_path", "language", F.round("contained", 6).alias("contained"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, pairs = similarity.similar_texts(read_table(spark, sf_dir, "chunks"), "chunk_id", "content")
    found = similarity.row_pairs(members, pairs)
    return found.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of links and group of each row of at least 40 tokens."""
    members, pairs = similarity.similar_texts(read_table(spark, sf_dir, "chunks"), "chunk_id", "content")
    return similarity.near_duplicate_groups(members, pairs).withColumnRenamed("id", "chunk_id")


def p3_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs tiles, bitmaps and intersection leave."""
    return similarity.similarity_stages(read_table(spark, sf_dir, "chunks"), "chunk_id", "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = neighbours.similar_vectors(read_table(spark, sf_dir, "chunks"), "chunk_id", ["vector", "summary_vector"])
    found = neighbours.neighbour_pairs(lists)
    return found.select("field", F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p4_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors, whatever their cosine, of every row whose id is divisible by 100."""
    chunks = read_table(spark, sf_dir, "chunks")
    lists = neighbours.query_neighbours(chunks, "chunk_id", ["vector", "summary_vector"], F.col("chunk_id") % 100 == 0)
    return lists.select("field", F.col("id").alias("chunk_id"), F.col("other").alias("chunk_id_b"), F.round("cosine", 6).alias("cosine"), "rank")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = documented.documented_functions(read_table(spark, sf_dir, "parsed_chunks"))
    return pairs.select("file_path", "func_name").distinct()


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description of each documented function."""
    return documented.documented_functions(read_table(spark, sf_dir, "parsed_chunks")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(read_table(spark, sf_dir, "chunks"))
    return pieces.where(~F.col("long_line")).select("chunk_id", "piece_no", "start_line", "end_line").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces cut at the strongest boundaries, rows with overlong lines included."""
    return splitting.split_oversized(read_table(spark, sf_dir, "chunks"), order="weakest")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = leakage.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return leaks.select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item that leaked: the documents that hold it and its longest run in any of them."""
    leaks = leakage.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return leaks.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("longest").alias("longest"))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked documents without the leaked passages."""
    return leakage.remove_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized_documents(read_table(spark, sf_dir, "documents"))
    by_leaf = sized.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"))
    plan = mixing.plan_mix(cut_lineage(by_leaf), read_table(spark, sf_dir, "mix_targets"))
    return mixing.short_sources(plan).select("source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection: how often each document is taken."""
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = truncation.find_truncated(read_table(spark, sf_dir, "documents"))
    return found.where("truncated").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_rates(truncation.find_truncated(read_table(spark, sf_dir, "documents")))


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The storage limits that show in the lengths of each source."""
    return truncation.hidden_limits(read_table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit() and callable(f)}
