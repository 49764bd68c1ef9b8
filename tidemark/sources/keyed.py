"""Tables that are kept up by key and read by page.

``Keyed`` holds the changed rows of each upsert below the bucket of their key, so that an upsert reads the buckets that it
touches and writes what differs.  ``Pages`` is a table in the order of its keys with the bounds of each file beside it, so
that a page is read from the file or two that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import table_at

PUBLISHED = "generation long, bucket int, rows long"


class Keyed:
    """Rows of a schema with distinct keys, not null, below a folder: ``rows`` by bucket and generation, ``state`` last."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.columns = spark.createDataFrame([], schema).columns

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _state(self, before: int | None) -> DataFrame:
        state = table_at(self.spark, f"{self.path}/state", PUBLISHED)
        return state if before is None else state.where(F.col("generation") < before)

    def rows(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The newest row of each key in the published generations (before one), of all or of some buckets.

        A bucket is read from its last fold on; of other buckets, no file is read.
        """
        state = self._state(before)
        known = state.select("generation").distinct()
        folds = state.where("bucket is not null").groupBy("bucket").agg(F.max("generation").alias("_fold"))
        rows = table_at(self.spark, f"{self.path}/rows", f"{self.schema}, bucket int, generation long")
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        rows = rows.join(known, "generation", "left_semi").join(folds, "bucket", "left").where("_fold is null or generation >= _fold")
        rest = [c for c in self.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "generation").alias("_row"))
        return newest.select(*(F.col(c) if c in self.keys else F.col("_row")[c].alias(c) for c in self.columns))

    def _published(self, rows: DataFrame, generation: int, folded: list[int] | None) -> int:
        out = rows.select(*self.columns, self._bucket().alias("bucket"), F.lit(generation).cast("long").alias("generation"))
        # each bucket is one folder of a generation; the same number again replaces what it wrote
        out.repartition(self.buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "generation").parquet(f"{self.path}/rows")
        n = table_at(self.spark, f"{self.path}/rows", f"{self.schema}, bucket int, generation long").where(F.col("generation") == generation).count()
        if n:
            marks = [(generation, b, n) for b in folded or [None]]
            self.spark.createDataFrame(marks, PUBLISHED).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(f"{self.path}/state")
        return n

    def upsert(self, new: DataFrame, generation: int) -> int:
        """Write the rows of new that are not there with the same values in all columns; how many.  No row, no file.

        new has one row a key and is read twice; generations grow.
        """
        touched = [r[0] for r in new.select(self._bucket().alias("b")).distinct().collect()]
        rest = [c for c in self.columns if c not in self.keys]
        old = self.rows(generation, touched).select(*self.keys, F.struct(*rest).alias("_old"))
        differs = new.select(self.columns).join(old, list(self.keys), "left").where(F.col("_old").isNull() | ~F.struct(*rest).eqNullSafe(F.col("_old")))
        return self._published(differs, generation, None)

    def fold(self, generation: int, most: int = 8) -> list[int]:
        """Write the buckets with over ``most`` generations as one; which they are.  Older generations stay for their readers."""
        seen = table_at(self.spark, f"{self.path}/rows", f"{self.schema}, bucket int, generation long").select("bucket", "generation").distinct()
        folds = self._state(generation).where("bucket is not null").groupBy("bucket").agg(F.max("generation").alias("_fold"))
        many = seen.join(folds, "bucket", "left").where("_fold is null or generation >= _fold").groupBy("bucket").count().where(F.col("count") > most)
        buckets = sorted(r.bucket for r in many.collect())
        if buckets:
            self._published(self.rows(generation, buckets), generation, buckets)
        return buckets


class Pages:
    """A snapshot in the order of its keys (together unique, not null), written in ``files`` parts, with each file's bounds."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def write(self, df: DataFrame, files: int) -> None:
        df.repartitionByRange(files, *self.keys).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(f"{self.path}/data")
        place = F.struct(*self.keys)
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/data").select(F.col("_metadata.file_path").alias("file"), place.alias("at"))
        rows.groupBy("file").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bounds")

    def files(self, after: tuple | None, n: int) -> list[str]:
        """The files that hold the n rows behind ``after``: the first may have none of them left, any other has a row at least."""
        bounds = self.spark.read.parquet(f"{self.path}/bounds")
        if after is not None:
            bounds = bounds.where(F.col("last") > F.struct(*(F.lit(v).cast(bounds.schema["last"].dataType[k].dataType).alias(k) for v, k in zip(after, self.keys, strict=True))))
        out, rows = [], 0
        for i, r in enumerate(bounds.orderBy("first").limit(n + 1).select("file", "n").collect()):
            if rows >= n:
                break
            out.append(r.file)
            rows += r.n if i or after is None else 0
        return out

    def page(self, after: tuple | None, n: int) -> DataFrame:
        """The next n rows behind ``after`` and one more, if there are, in order."""
        files = self.files(after, n + 1)
        schema = self.spark.read.parquet(f"{self.path}/data").schema
        df = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        if after is not None:
            df = df.where(F.struct(*self.keys) > F.struct(*(F.lit(v).cast(schema[k].dataType).alias(k) for v, k in zip(after, self.keys, strict=True))))
        return df.orderBy(*self.keys).limit(n + 1)
