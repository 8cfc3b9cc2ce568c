"""Tables that change by keyed delta files: a batch writes what it changes and no more, readers see the last change of each key.

A table is a folder with a base version and deltas by key bucket: <path>/base=<n>/bucket=<b>/ and <path>/delta=<batch>/bucket=<b>/.
A change is a row with its order and whether it deletes its key; the last one wins, by order and then by batch.
Compaction folds a table's deltas into a new base, bucket by bucket; a base's number is the last batch that it holds. A
batch that is written again replaces itself, so that a stream's replay changes nothing. Versions that no reader needs go by `vacuum`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DeltaTable:
    """schema holds the rows' columns, among them key and order; buckets is fixed for a table's life."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str, buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.stored = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType()), T.StructField("_batch", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def folders(self, kind: str) -> list[int]:
        """The numbers of finished bases or deltas."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(place)] if fs.exists(place) else []
        done = [p.getName() for p in found if p.getName().startswith(f"{kind}=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.partition("=")[2]) for n in done)

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, folder: str) -> None:
        out = rows.withColumn("bucket", self.bucket_of(F.col(self.key))).select(*self.stored.names)
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def last(self, rows: DataFrame) -> DataFrame:
        """The last change of each key, which combines before its shuffle."""
        rest = [c for c in self.stored.names if c not in (self.key, self.order, "_batch", "bucket")]
        top = rows.groupBy("bucket", self.key).agg(F.max_by(F.struct(*rest, self.order, "_batch"), F.struct(self.order, "_batch", "_gone")).alias("l"))
        return top.select("bucket", self.key, "l.*")

    def change(self, rows: DataFrame, batch: int, gone: Column | None = None) -> None:
        """Writes a batch's changes, of each key its last; gone says which rows delete their keys. Rows without a key are left out."""
        rows = rows.filter(F.col(self.key).isNotNull()).select(*self.schema.names, (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("_gone"), F.lit(batch).cast("long").alias("_batch"))
        self.write(self.last(rows.withColumn("bucket", self.bucket_of(F.col(self.key)))), f"delta={batch}")

    def upsert(self, batch: DataFrame, n: int) -> None:
        """For foreachBatch."""
        self.change(batch, n)

    def parts(self, upto: int | None = None) -> list[str]:
        """The folders that make up the table: the newest base, and the deltas after it."""
        bases = [b for b in self.folders("base") if upto is None or b <= upto]
        base = bases[-1] if bases else -1
        deltas = [d for d in self.folders("delta") if d > base and (upto is None or d <= upto)]
        return ([f"base={base}"] if bases else []) + [f"delta={d}" for d in deltas]

    def changes(self, parts: list[str], bucket: int | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], self.stored)
        if parts:
            # one reader a folder: its bucket column is its partition
            for p in parts:
                out = out.unionByName(self.spark.read.schema(self.stored).parquet(f"{self.path}/{p}"))
        return out if bucket is None else out.filter(F.col("bucket") == bucket)

    def read(self, upto: int | None = None) -> DataFrame:
        """The table, or its state after batch `upto` while that base's deltas are kept."""
        return self.last(self.changes(self.parts(upto))).filter(~F.col("_gone")).select(*self.schema.names)

    def lookup(self, value) -> DataFrame:
        """The row of a key: only its bucket's files are read."""
        bucket = self.spark.range(1).select(self.bucket_of(F.lit(value).cast(self.schema[self.key].dataType))).first()[0]
        return self.last(self.changes(self.parts(), bucket).filter(F.col(self.key) == value)).filter(~F.col("_gone")).select(*self.schema.names)

    def update_where(self, where: Column, batch: int, **columns: Column) -> None:
        """Changes columns of the rows for which a condition holds: only these rows are written."""
        rows = self.read().filter(where)
        self.change(rows.withColumns(columns), batch)

    def delete_where(self, where: Column, batch: int) -> None:
        self.change(self.read().filter(where), batch, F.lit(True))

    def compact(self) -> None:
        """Folds all deltas into a new base. Deleted keys leave it."""
        parts, deltas = self.parts(), self.folders("delta")
        if deltas and f"base={deltas[-1]}" not in parts:
            self.write(self.last(self.changes(parts)).filter(~F.col("_gone")), f"base={deltas[-1]}")

    def vacuum(self) -> None:
        """Removes bases and deltas that the newest base replaces; no reader may still be at them."""
        bases = self.folders("base")
        old = [f"base={b}" for b in bases[:-1]] + [f"delta={d}" for d in self.folders("delta") if bases and d <= bases[-1]]
        for name in old:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
