"""Exact nearest-neighbour search, reciprocal-rank fusion, and how results are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.functions.text import preview
from lodeseek.functions.vector import distance_to

#: Added to a rank before it is inverted.
FUSION_CONSTANT = 60

#: Fields of a result as JSON, in order.
JSON_FIELDS = ("rank", "file_path", "start_line", "end_line", "symbol", "score", "content", "summary")


def query_vector(vectors: DataFrame, id_col: str, vec_col: str, wanted: int) -> DataFrame:
    """One row with the vector of ``wanted``, or no row if there is none."""
    return vectors.where(F.col(id_col) == wanted).select(F.col(vec_col).alias("_query")).limit(1)


def knn(
    vectors: DataFrame,
    query: DataFrame | list[float] | None,
    id_col: str,
    vec_col: str,
    k: int = 10,
    metric: str = "euclidean",
    where: Column | None = None,
) -> DataFrame:
    """The ``k`` rows closest to one query vector: all their columns and ``score``, the distance.

    ``query`` is a list of numbers, None, or a DataFrame whose first row has the column ``_query``: one vector, which the
    driver reads. ``where`` is applied before the ranking. Rows whose vector is null, holds a null or NaN, or has another
    length than the query are left out (a null distance would sort first). Equal distances are ordered by ``id_col``. An
    empty table or query gives no rows.

    Only id and vector are ranked, by a top-k in each partition and a merge of k rows a partition; the other columns are
    fetched for the k rows that are left.
    """
    if isinstance(query, DataFrame):
        first = query.select("_query").first()
        query = first and first[0]
    rows = vectors if where is None else vectors.where(where)
    if query is None:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    narrow = rows.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == len(query))).select(id_col, vec_col)
    scored = narrow.withColumn("score", distance_to(F.col(vec_col), query, metric)).where(~F.isnan("score"))
    best = scored.orderBy("score", id_col).limit(k)
    if set(vectors.columns) == {id_col, vec_col}:
        return best
    # Rows with the same id and vector have the same score; all of them are fetched, and k are kept.
    found = rows.join(F.broadcast(best.dropDuplicates([id_col, vec_col])), [id_col, vec_col])  # k rows
    return found.select(*vectors.columns, "score").orderBy("score", id_col).limit(k)


def min_score(ranked: DataFrame, least: float | None) -> DataFrame:
    """Keep results with ``score >= least``. It comes after the top-k, so it never pulls in further rows; on distances
    it keeps the far ones, as the reference does."""
    return ranked if least is None else ranked.where(F.col("score") >= least)


def max_distance(ranked: DataFrame, most: float | None) -> DataFrame:
    """Keep results at most so far away: the useful filter for distances."""
    return ranked if most is None else ranked.where(F.col("score") <= most)


def ranked(results: DataFrame, *order: Column | str) -> DataFrame:
    """Add ``rank`` from 1; results are at most k rows, so one task is enough."""
    return results.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def fuse(lists: list[DataFrame], key: str = "id", tie: str | None = None, k: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists of the same columns (with ``score``, a distance).

    Each list gives 1 / (60 + rank) to the key of each of its rows; terms of a key add up, also within one list. The
    other columns are those of the key's first row, earlier lists first. The best ``k`` by descending sum come out, ties
    ordered by key; ``score`` is the sum. A null key is a key of its own.
    """
    tie = tie or key
    parts = [ranked(one, "score", tie).withColumn("_list", F.lit(n)) for n, one in enumerate(lists)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    rest = [c for c in lists[0].columns if c not in (key, "score")]
    first = F.min_by(F.struct(*rest), F.struct("_list", "rank"))
    fused = union.groupBy(key).agg(
        F.sum(F.lit(1.0) / (F.lit(FUSION_CONSTANT) + F.col("rank"))).alias("score"), first.alias("_first")
    )
    return fused.select(key, *[F.col(f"_first.{c}").alias(c) for c in rest], "score").orderBy(F.desc("score"), key).limit(k)


def text_line(label: str) -> Column:
    """``[rank] label:score  path:start-end  symbol`` with the score to four places; an empty symbol shows nothing."""
    symbol = F.when(F.coalesce(F.col("symbol"), F.lit("")) == "", "").otherwise(F.concat(F.lit("  "), F.col("symbol")))
    where = F.format_string("%s:%d-%d", "file_path", F.col("start_line"), F.col("end_line"))
    return F.concat(F.format_string(f"[%d] {label}:%.4f  ", "rank", "score"), where, symbol)


def text_block(label: str) -> Column:
    """The line, the summary if there is one, and the first lines of the content."""
    summary = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.concat(F.lit("  "), F.col("summary")))
    return F.concat_ws("\n", text_line(label), summary, preview(F.col("content")))


def json_object() -> Column:
    """A result as JSON, fields in their fixed order, nulls kept."""
    return F.to_json(F.struct(*JSON_FIELDS), {"ignoreNullFields": "false"})
