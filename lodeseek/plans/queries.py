"""The core's queries: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.functions import text as X
from lodeseek.functions import vector as V
from lodeseek.functions.embed import QUERY_PREFIX, embed
from lodeseek.operators import bursts, chunking, refresh, search
from lodeseek.sources.tables import read_table

DIM = 64
WINDOW = 20


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "chunks")


def _usable(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    return _chunks(spark, sf_dir).where(V.usable(F.col(field), DIM))


def _query(spark: SparkSession, sf_dir: str) -> list[float] | None:
    """The vector of the first row whose vector can be used: one vector, read once for all rankings of a query."""
    first = _usable(spark, sf_dir, "vector").agg(F.min_by("vector", "chunk_id")).first()
    return first[0]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents and summaries closest to one vector, fused and ranked."""
    return ranked_results(spark, sf_dir)


# -- search ---------------------------------------------------------------------------------------------------------


def knn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    hits = search.knn(vectors, search.query_vector(vectors, "vec_id", "embedding", 0), "vec_id", "embedding")
    return hits.select("vec_id", F.round("score", 6).alias("score"))


def knn_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.knn(_usable(spark, sf_dir, "vector"), _query(spark, sf_dir), "chunk_id", "vector")
    return hits.select("chunk_id", "file_path", F.round("score", 6).alias("score"))


def knn_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries: only rows that have one are ranked, and only those whose summary vector can be used."""
    rows = _usable(spark, sf_dir, "summary_vector")
    hits = search.knn(rows, _query(spark, sf_dir), "chunk_id", "summary_vector", where=F.col("summary").isNotNull())
    return hits.select("chunk_id", "file_path", F.round("score", 6).alias("score"))


def knn_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.knn(_usable(spark, sf_dir, "vector"), _query(spark, sf_dir), "chunk_id", "vector", metric="squared_l2")
    return hits.select("chunk_id", F.round("score", 6).alias("score"))


def _fused(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    kept = ["chunk_id", "id", "file_path", "start_line", "end_line", "symbol", "content", "summary", "score"]
    query = _query(spark, sf_dir)
    content = search.knn(_usable(spark, sf_dir, "vector"), query, "chunk_id", "vector", k).select(*kept)
    rows = _usable(spark, sf_dir, "summary_vector")
    summary = search.knn(rows, query, "chunk_id", "summary_vector", k, where=F.col("summary").isNotNull()).select(*kept)
    return search.fuse([content, summary], "id", tie="chunk_id", k=k)


def rrf_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content and summary rankings fused by id; rows appended twice share an id and add up."""
    return _fused(spark, sf_dir).select("id", "chunk_id", F.round("score", 8).alias("score"))


def find_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score filter comes after the top-k."""
    hits = search.knn(_usable(spark, sf_dir, "vector"), _query(spark, sf_dir), "chunk_id", "vector", k=50)
    return search.min_score(hits, 1.0).select("chunk_id", F.round("score", 6).alias("score"))


def find_max_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.knn(_usable(spark, sf_dir, "vector"), _query(spark, sf_dir), "chunk_id", "vector", k=50)
    return search.max_distance(hits, 1.1).select("chunk_id", F.round("score", 6).alias("score"))


def query_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.min_score(_fused(spark, sf_dir), 0.0155).select("id", F.round("score", 8).alias("score"))


def ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks are given after the score filter."""
    kept = search.min_score(_fused(spark, sf_dir), 0.0145)
    out = search.ranked(kept, F.desc("score"), "id")
    return out.select("rank", "id", "file_path", "start_line", "end_line", F.round("score", 8).alias("score"))


def render_text_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.ranked(_fused(spark, sf_dir), F.desc("score"), "id")
    return out.select("rank", search.text_line("rrf").alias("line"))


def render_text_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.knn(_usable(spark, sf_dir, "vector"), _query(spark, sf_dir), "chunk_id", "vector")
    return search.ranked(hits, "score", "chunk_id").select("rank", search.text_block("dist").alias("block"))


def render_query_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fused result with its summary and the first lines of its content."""
    out = search.ranked(_fused(spark, sf_dir), F.desc("score"), "id")
    return out.select("rank", search.text_block("rrf").alias("block"))


def render_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.ranked(_fused(spark, sf_dir), F.desc("score"), "id")
    return out.select("rank", search.json_object().alias("json"))


def preview_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", X.preview(F.col("content")).alias("preview"))


def hash_embed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents closest to a query text under hashed embeddings; only the query has the prefix for queries."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", embed(F.col("text"), DIM).alias("vector"))
    query = spark.range(1).select(embed(F.lit("which chunks carry a summary after the last change"), DIM, QUERY_PREFIX).alias("_query"))
    hits = search.knn(documents, query, "doc_id", "vector")
    return hits.select("doc_id", F.round("score", 6).alias("score"))


# -- vectors --------------------------------------------------------------------------------------------------------


def vector_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _usable(spark, sf_dir, "vector")
    unit = F.transform(V.normalized(F.col("vector")), lambda x: F.round(x, 5))
    return rows.select("chunk_id", F.round(V.norm(F.col("vector")), 5).alias("norm"), unit[0].alias("first"), unit[63].alias("last"))


def vector_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each length and field, and how many of them can be used."""
    parts = [
        _chunks(spark, sf_dir).select(F.lit(f).alias("field"), F.size(f).alias("dim"), V.usable(F.col(f), DIM).alias("usable"), F.col(f).isNull().alias("gone"))
        for f in ("vector", "summary_vector")
    ]
    rows = parts[0].unionByName(parts[1]).where("not gone")
    return rows.groupBy("field", "dim").agg(F.count("*").alias("vectors"), F.sum(F.col("usable").cast("long")).alias("usable"))


# -- refresh --------------------------------------------------------------------------------------------------------


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed file, as an index restricted to four languages sees it: files of others count as gone."""
    return read_table(spark, sf_dir, "source_files").where(X.listed(F.col("rel_path"), ["**/*.py", "**/*.rs", "**/*.go", "**/*.java"]))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored chunks as a refresh could find them: every seventh file has an old hash, every tenth isn't stored.

    The choice is by the first hex digits of the hash, so that it is the same wherever it is made.
    """
    digit = F.conv(F.substring("file_hash", 1, 4), 16, 10).cast("int")
    old = F.when(digit % 7 == 0, F.concat(F.lit("old"), F.col("file_hash"))).otherwise(F.col("file_hash"))
    return _chunks(spark, sf_dir).where(digit % 10 != 0).withColumn("file_hash", old)


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.classify(_listing(spark, sf_dir), _stored(spark, sf_dir)).select("file_path", "status")


def _with_status(status: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return file_status(spark, sf_dir).where(F.col("status") == status).select("file_path")

    return query


def refresh_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.counters(_listing(spark, sf_dir), _stored(spark, sf_dir))


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a file after an upsert: files that are gone or changed make room, new and changed ones come as line windows."""
    stored = _stored(spark, sf_dir).select("id", "file_path", "start_line")
    status = refresh.classify(_listing(spark, sf_dir), _stored(spark, sf_dir))
    texts = chunking.decoded(_listing(spark, sf_dir)).withColumnRenamed("rel_path", "file_path")
    anew = texts.join(status.where(F.col("status").isin("new", "changed")), "file_path", "left_semi")
    fresh = chunking.line_windows(anew, "file_path", "text", chunking.MAX_LINES).select("id", "file_path", "start_line")
    gone = status.where(F.col("status").isin("removed", "changed")).select("file_path")
    return refresh.upsert(stored, fresh, gone).groupBy("file_path").agg(F.count("*").alias("rows"), F.max("start_line").alias("last_start"))


def delete_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each language if all files with a quote in their path are deleted."""
    chunks = _chunks(spark, sf_dir)
    left = refresh.delete_files(chunks, chunks.where(F.col("file_path").contains("'")))
    return left.groupBy("language").agg(F.count("*").alias("rows"), F.countDistinct("file_path").alias("files"))


def escape_free_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hash of each file whose path holds a quote."""
    found = refresh.stored_hashes(_chunks(spark, sf_dir).where(F.col("file_path").contains("'")))
    return found.select("file_path", "stored_hash")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "source_files")
    return files.select("rel_path", refresh.content_hash(F.col("bytes")).alias("hash"))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.stats(_chunks(spark, sf_dir))


def valid_utf8_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "source_files").where(F.col("bytes").isNotNull())
    return files.select("rel_path", refresh.valid_text(F.col("bytes")).alias("valid"))


# -- listing --------------------------------------------------------------------------------------------------------


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("file_path").distinct()


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "source_files").select("rel_path")


def glob_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(X.matches_any(F.col("rel_path"), ["**/core/**/*.py", "*/src/*_0[0-9]*.rs", "*.tsx"]))


def glob_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(~X.matches_any(F.col("rel_path"), [*X.DEFAULT_EXCLUDES, "**/tests/**", "**/vendor/**"]))


def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _paths(spark, sf_dir).where(X.extension(F.col("rel_path")).isin("rs", "go", "kt"))
    return kept.select("rel_path", X.extension(F.col("rel_path")).alias("extension"))


def default_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(X.listed(F.col("rel_path"), None, X.DEFAULT_EXCLUDES))


def language_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _paths(spark, sf_dir).groupBy(X.language_of(F.col("rel_path")).alias("language"))
    return by.agg(F.count("*").alias("files"))


# -- text -----------------------------------------------------------------------------------------------------------


def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = chunking.line_windows(read_table(spark, sf_dir, "documents"), "doc_id", "text", WINDOW)
    return windows.select("id", "doc_id", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def file_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = chunking.line_windows(chunking.decoded(read_table(spark, sf_dir, "source_files")), "rel_path", "text")
    return windows.select("id", "start_line", "end_line", F.length("content").alias("length"))


def oversize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "parsed_chunks").select("parse_id", "symbol", "summary", "content", "start_line", "end_line")
    return chunking.split_oversized(rows, 40).select("parse_id", "symbol", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def strip_xml_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).where("language = 'csharp'").select("chunk_id", X.strip_xml_tags(F.col("content")).alias("text"))


#: How lines of comments begin, by language; the others use "//".
_LINE_COMMENTS = {"python": "#", "ruby": "#", "haskell": "--"}
#: Lines that count as documentation above a function, for languages that document by line.
_DOC_LINES = {"go": "//", "rust": "///", "fsharp": "///", "python": "#", "ruby": "#"}
_BLOCK_LANGUAGES = ("rust", "java", "csharp", "javascript", "typescript", "tsx", "go", "scala", "fsharp", "kotlin")


def _by_language(values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("language"))


def strip_comment_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each content that are comments, without their markers."""
    rows = _chunks(spark, sf_dir).where(F.col("language").isNotNull())
    mark = F.coalesce(_by_language(_LINE_COMMENTS), F.lit("//"))
    rows = rows.select("chunk_id", "language", F.filter(F.split("content", "\n", -1), lambda x: X.trim(x).startswith(mark)).alias("remarks"))
    bare = F.transform("remarks", lambda x: X.strip_line_markers(x, F.col("language")))
    return rows.where(F.size("remarks") > 0).select("chunk_id", F.array_join(bare, "\n").alias("text"))


def strip_block_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block comment of each content without its markers, numbered from 0."""
    rows = _chunks(spark, sf_dir).where(F.col("language").isin(*_BLOCK_LANGUAGES))
    blocks = F.regexp_extract_all("content", F.lit(r"(?s)/\*.*?\*/"), F.lit(0))
    return rows.select("chunk_id", F.posexplode(blocks).alias("no", "block")).select("chunk_id", "no", X.strip_block_markers(F.col("block")).alias("text"))


def dedent_docstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in triple quotes of each Python content, dedented, numbered from 0."""
    rows = _chunks(spark, sf_dir).where("language = 'python'")
    quoted = F.regexp_extract_all("content", F.lit("(?s)\"\"\".*?\"\"\"|'''.*?'''"), F.lit(0))
    found = rows.select("chunk_id", F.posexplode(quoted).alias("no", "doc"))
    return found.select("chunk_id", "no", X.dedent(F.col("doc").substr(F.lit(4), F.length("doc") - 6)).alias("text"))


def doc_comment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of documentation lines that stand right above a function: gaps and islands over lines."""
    rows = _chunks(spark, sf_dir).where(F.col("language").isin(*_DOC_LINES))
    rows = rows.select("chunk_id", _by_language(_DOC_LINES).alias("mark"), F.posexplode(F.split("content", "\n", -1)).alias("no", "line"))
    rows = rows.withColumn("remark", F.ltrim("line").startswith(F.col("mark")))
    order = W.partitionBy("chunk_id").orderBy("no")
    opens = F.when(F.col("remark") & ~F.coalesce(F.lag("remark").over(order), F.lit(False)), F.col("no"))
    rows = rows.withColumn("run", F.max(opens).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.lag("remark").over(order)).withColumn("run_before", F.lag("run").over(order))
    found = rows.where(F.col("line").rlike(r"^\s*(pub(\([a-z]+\))? )?(async )?(fn|func|def|let) ") & F.col("before"))
    return found.select("chunk_id", F.col("no").alias("function_line"), F.col("run_before").alias("first_line"), (F.col("no") - F.col("run_before")).alias("lines"))


def parse_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of all source files, with their summaries."""
    return chunking.parse_files(read_table(spark, sf_dir, "source_files"))


def function_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the functions of Go, Rust and Ruby files begin that stand at the margin."""
    files = read_table(spark, sf_dir, "source_files").where(X.language_of(F.col("rel_path")).isin("go", "rust", "ruby"))
    found = chunking.parse_files(files, 1 << 30)
    texts = chunking.decoded(files).select(F.col("rel_path").alias("file_path"), X.lines(F.col("text")).alias("lines"))
    kinds = ("function_declaration", "method_declaration", "function_item", "method", "singleton_method")
    found = found.where(F.col("node_kind").isin(*kinds)).join(texts, "file_path")
    return found.where(F.get("lines", F.col("start_line")).rlike(r"^\S")).select("file_path", "symbol", "start_line")


# -- change events --------------------------------------------------------------------------------------------------


def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bursts.relevant(read_table(spark, sf_dir, "change_event"))
    return events.groupBy("kind").agg(F.count("*").alias("events"), F.countDistinct("path").alias("files"))


def debounce_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.debounce(read_table(spark, sf_dir, "change_event"))


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        knn_embeddings, knn_content, knn_prefiltered, knn_squared, rrf_fused, find_min_score, find_max_distance, query_min_score,
        ranked_results, render_text_line, render_text_block, render_query_block, render_json, preview_lines, hash_embed_search, vector_l2_normalize,
        vector_dim_check, file_status, refresh_counters, upsert_snapshot, delete_file_rows, escape_free_lookup, content_hash,
        index_stats, valid_utf8_filter, list_files, glob_include, glob_exclude, extension_filter, default_listing, language_dispatch,
        line_windows, file_windows, oversize_split, strip_xml_tags, strip_comment_markers, strip_block_comments, dedent_docstring,
        doc_comment_runs, parse_chunks, function_heads, event_kinds, debounce_bursts,
    ]
    named = {f"{s}_files": _with_status(s) for s in ("new", "changed", "unchanged", "removed")}
    return {f.__name__: f for f in plain} | named
