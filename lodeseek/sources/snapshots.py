"""The chunk table: Parquet partitioned by a hash of the file's path, of which a refresh rewrites only what it touches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunk_schema() -> T.StructType:
    """The columns of the chunk table; Spark has no list of fixed length, so the length is checked on writing."""
    text, line, vector = T.StringType(), T.IntegerType(), T.ArrayType(T.FloatType())
    columns = [
        ("id", text, False), ("file_path", text, False), ("file_hash", text, False), ("language", text, False),
        ("symbol", text, False), ("content", text, False), ("start_line", line, False), ("end_line", line, False),
        ("summary", text, True), ("vector", vector, False), ("summary_vector", vector, True),
    ]
    return T.StructType([T.StructField(*c) for c in columns])


class Store:
    """A table below ``path``, on any file system that Spark can reach.

    All rows of a file are in one of ``buckets`` partitions; choose their number so that one is a convenient piece of work
    (``files`` Parquet files each). Spark replaces the partitions that are written in one commit and leaves the others
    alone. It can't replace one by nothing, so each written partition has a row without an id, which reading leaves out.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, files: int = 4):
        self.spark, self.path, self.buckets, self.files = spark, path, buckets, files
        self.schema = chunk_schema()

    def bucket(self, file_path: Column) -> Column:
        return F.pmod(F.xxhash64(file_path), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(T.StructType([*self.schema, T.StructField("bucket", T.IntegerType())])).parquet(self.path)
        except AnalysisException:  # no such path
            return None

    def exists(self) -> bool:
        return self._stored() is not None

    def read(self) -> DataFrame:
        """All rows; an empty table with the schema if there is none."""
        stored = self._stored()
        if stored is None:
            return self.spark.createDataFrame([], self.schema)
        return stored.where(F.col("id").isNotNull()).drop("bucket")

    def dim(self) -> int | None:
        """Elements of the stored vectors; None for an empty table."""
        first = self.read().select(F.size("vector").alias("dim")).first()
        return first.dim if first else None

    def _write(self, rows: DataFrame, buckets: DataFrame, dim: int | None, mode: str) -> None:
        dim = dim or self.dim()
        rows = rows.select(*self.schema.fieldNames()).withColumn("bucket", self.bucket(F.col("file_path")))
        if dim:
            wrong = F.coalesce(F.size("vector") != dim, F.lit(True)) | F.coalesce(F.size("summary_vector") != dim, F.lit(False))
            told = F.raise_error(F.concat(F.lit(f"a vector isn't of {dim} elements: "), F.coalesce("id", F.lit("?"))))
            rows = rows.withColumn("vector", F.when(wrong, told.cast("array<float>")).otherwise(F.col("vector")))
        rows = rows.unionByName(buckets.select("bucket"), allowMissingColumns=True)
        part = F.pmod(F.xxhash64("file_path", F.lit(1)), F.lit(self.files))
        writer = rows.repartition("bucket", part).write.mode("overwrite").option("partitionOverwriteMode", mode)
        writer.partitionBy("bucket").parquet(self.path)

    def replace(self, rows: DataFrame, dim: int | None = None) -> None:
        """Make ``rows`` the whole table. Vectors that aren't all of ``dim`` elements (else: as those stored) are an error,
        which leaves the table as it is."""
        self._write(rows, self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket")), dim, "dynamic")

    def upsert(self, fresh: DataFrame, touched: DataFrame, dim: int | None = None) -> None:
        """Put ``fresh`` in the place of all rows of the files in ``touched`` (file_path), which has those of ``fresh``.

        Only the partitions of these files are read and written. The driver sees their numbers, not the files.
        """
        stored = self._stored()
        buckets = touched.select(self.bucket(F.col("file_path")).alias("bucket")).distinct()
        if stored is None:
            self.replace(fresh, dim)
            return
        named = [r.bucket for r in buckets.collect()]
        kept = stored.where(F.col("bucket").isin(named) & F.col("id").isNotNull()).drop("bucket")
        kept = kept.join(touched.select("file_path").distinct(), "file_path", "left_anti")
        listed = self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket")).where(F.col("bucket").isin(named))
        self._write(kept.unionByName(fresh.select(*kept.columns)), listed, dim, "dynamic")

    def clear(self) -> None:
        """An empty table."""
        self.replace(self.spark.createDataFrame([], self.schema))

    def drop(self) -> None:
        """Forget the table."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
