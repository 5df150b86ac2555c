"""Changes below a directory, told by the difference between its listing and the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeseek.sources.listing import list_files
from lodeseek.sources.tables import cut_lineage

LISTING = "rel_path string, size long, modified long, number long"


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, kind (create, modify, remove), ts: what turns one listing (rel_path, size, modified) into the other.

    One full join on the path. A file whose size and time are the same counts as unchanged; paths are unique in a listing.
    """
    a = before.select("rel_path", F.struct("size", "modified").alias("was"))
    b = now.select("rel_path", F.struct("size", "modified").alias("is"))
    kind = F.when(F.col("was").isNull(), "create").when(F.col("is").isNull(), "remove").when(F.col("was") != F.col("is"), "modify")
    both = a.join(b, "rel_path", "full").withColumn("kind", kind).where(F.col("kind").isNotNull())
    return both.select(F.col("rel_path").alias("path"), "kind", F.current_timestamp().alias("ts"))


class Watched:
    """A directory with the listing of its last state kept in the shared folder ``state``, so that nothing that happens
    while no one watches is lost. Two listings are kept in turn; the one with the larger number counts."""

    def __init__(self, spark: SparkSession, root: str, state: str, include: list[str] | None = None, exclude: list[str] | None = None):
        self.spark, self.root, self.state, self.include, self.exclude = spark, root, state, include, exclude

    def _slot(self, slot: int) -> tuple[int, DataFrame | None]:
        try:
            kept = self.spark.read.schema(LISTING).parquet(f"{self.state}/{slot}")
        except AnalysisException:  # not written yet
            return -1, None
        number = kept.agg(F.max("number")).first()[0]
        return (-1, None) if number is None else (number, kept.where(F.col("rel_path").isNotNull()))

    def look(self, handle: Callable[[DataFrame], object]) -> bool:
        """Hand the changes since the last look to ``handle``, if there are any, and keep the new listing.

        If ``handle`` fails, the old listing stays and the changes come again. The first look reports every file.
        """
        number, before = max((self._slot(0), self._slot(1)), key=lambda x: x[0])
        now = cut_lineage(list_files(self.spark, self.root, self.include, self.exclude).select("rel_path", "size", "modified"))
        if before is None:
            before = self.spark.createDataFrame([], LISTING)
        found = cut_lineage(changes(before, now))
        if found.isEmpty() and number >= 0:
            return False
        if not found.isEmpty():
            handle(found)
        marked = now.withColumn("number", F.lit(number + 1).cast("long"))
        marker = self.spark.createDataFrame([(None, None, None, number + 1)], LISTING)  # an empty directory has a listing too
        marked.unionByName(marker).write.mode("overwrite").parquet(f"{self.state}/{(number + 1) % 2}")
        return True


def watch(watched: Watched, handle: Callable[[DataFrame], object], checkpoint: str, every: str = "500 milliseconds") -> StreamingQuery:
    """Look again and again, one look after the other, as the micro-batches of a stream."""
    ticks = watched.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda batch, number: watched.look(handle)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start()
